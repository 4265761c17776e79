import random

import brute
import numpy as np
import odd

from pixelloom.llm import neardup, shingling
from pixelloom.llm.components import components


def test_classes_equal_brute_force(spark, docs):
    group = [(100 + i, odd.edited(odd.A, 50 + i, seed=i), "g") for i in range(60)]
    borders = [(300 + i, odd.edited(odd.prose(50, 150), 18 + i, seed=7), "g") for i in range(20)]
    shared = [(400 + i, odd.prose(60, 40) + " " + odd.prose(70 + i, 60), "g") for i in range(60)]
    rows = odd.ROWS + group + borders + shared
    got = neardup.near_duplicates(odd.table(spark, rows)).collect()
    number, sizes = brute.classes([t for _, t, _ in rows])
    least = {}
    for (i, _, _), n in zip(rows, number, strict=True):
        if n is not None and i is not None:
            least[n] = min(least.get(n, i), i)
    want = [(i, s, i if n is None else least.get(n)) for (i, _, _), n, s in zip(rows, number, sizes, strict=True)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)

    left = neardup.deduplicated(docs)
    number, _ = brute.classes([t for _, t, _ in odd.ROWS])
    assert left.columns == docs.columns
    assert left.count() == len({n for n in number if n is not None}) + sum(n is None for n in number)


def test_empty_table(nothing):
    assert neardup.near_duplicates(nothing).count() == 0 and neardup.deduplicated(nothing).count() == 0


def test_large_nodes_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "DEPTH", 1)
    monkeypatch.setattr(neardup, "CORE", 0.95)
    monkeypatch.setattr(neardup, "LEAF", 4)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = [(i, odd.edited(odd.prose(80, 120), 25, seed=i % 40), "g") for i in range(80)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(odd.table(spark, rows)).collect()}
    number, _ = brute.classes([t for _, t, _ in rows])
    assert got == {i: rows[n][0] for (i, _, _), n in zip(rows, number, strict=True)}


def test_borders_of_a_dense_group_that_one_core_links(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 4)
    base = odd.prose(90, 300, 100_000).split(" ")

    def but(text, at, name):
        return [f"{name}x{i}" if i in at else w for i, w in enumerate(text)]

    r, rows = random.Random(4), []
    for c in range(150):
        core = but(base, set(r.sample(range(10, 290), 3)), f"c{c}")
        rows += [(2 * c, " ".join(core), "g"), (2 * c + 1, " ".join(but(core, set(r.sample(range(10, 290), 8)), f"b{c}")), "g")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(odd.table(spark, rows)).collect()}
    number, _ = brute.classes([t for _, t, _ in rows])
    assert got == {i: rows[n][0] for (i, _, _), n in zip(rows, number, strict=True)}


def test_rest_of_a_cluster_meets_every_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    base = odd.prose(95, 300, 100_000).split(" ")
    r, rows = random.Random(6), []
    for c in range(100):
        core = [f"c{c}x{i}" if i in {7 + c, 150 + c} else w for i, w in enumerate(base)]
        rows.append((c, " ".join(core), "g"))
        if c % 4 == 0:  # similar to its core and to few others
            at = set(r.sample(range(300), 9))
            rows.append((1000 + c, " ".join(f"b{c}x{i}" if i in at else w for i, w in enumerate(core)), "g"))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(odd.table(spark, rows)).collect()}
    number, _ = brute.classes([t for _, t, _ in rows])
    assert got == {i: rows[n][0] for (i, _, _), n in zip(rows, number, strict=True)}


def test_copies_similar_to_the_pivot_make_no_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    seen, plain = [], neardup._task_links
    monkeypatch.setattr(neardup, "_task_links", lambda tasks, *rest: (seen.append(tasks.count()), plain(tasks, *rest))[1])
    base = odd.prose(96, 300, 100_000).split(" ")
    rows = [(c, " ".join(f"c{c}" if i == 20 + c else w for i, w in enumerate(base)), "g") for c in range(200)]
    signed = neardup.signatures(odd.table(spark, rows))
    known = signed.selectExpr("id vid", "named_struct('id', id, 'tk', tk) rep", "n", "sketch")
    members = known.selectExpr("cast(0 as bigint) pivot", "cast(vid as bigint) vid", "cast(vid as bigint) comp", "true core")
    links = neardup.cluster_links(members, known, neardup._rows(odd.table(spark, rows), "doc_id", "text")).collect()
    assert {x.a for x in links if x.b == 0} == set(range(1, 200))
    assert len(seen) == 1 and seen[0] == 200 + 13 - 1


def test_components_of_a_long_chain_and_a_star(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    chain = list(zip(order[:99], order[1:100], strict=True))
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(1005, 1005), (1001, 1000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert all(got[x] == min(order[:100]) for x in order[:100]) and all(got[1000 + i] == 1000 for i in range(300))


def test_numpy_words_and_sets():
    texts = ["", None, "one", " A b\tC\nd e f ", "a b c d e f", "été ÉTÉ été x y z", "q" * 50, "x " * 40]
    sets = [set(s.tolist()) for s in shingling.shingle_sets(texts)]
    assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in texts] and sets[3] == sets[4]


def test_pieces_do_not_change_a_text(monkeypatch):
    text = odd.prose(5, 3000) + " " + "z" * 5000 + " " + odd.prose(6, 200)
    whole = next(shingling.word_hashes([text]))
    shingling._powers.cache_clear()
    monkeypatch.setattr(shingling, "PIECE", 1000)
    cut = next(shingling.word_hashes([text]))
    shingling._powers.cache_clear()
    assert len(whole) == len(cut) == 3201
    assert np.array_equal(np.delete(whole, 3000), np.delete(cut, 3000))


def test_minhash_estimates_similarity():
    a, b = (np.unique(shingling.mixed(np.arange(x, y, dtype=np.uint64))) for x, y in ((1, 3001), (501, 3501)))
    f = shingling.multipliers(512, 1)
    same = (shingling.minhash(a, f) == shingling.minhash(b, f)).mean()
    assert abs(same - 2500 / 3500) < 0.08
