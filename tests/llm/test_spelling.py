import collections
import random
import re
import zlib

import odd
import pyarrow as pa

from pixelloom.llm import runs, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, least=5, every=199):
    n = collections.Counter()
    for i, t, _ in rows:
        for run in RUN.findall(t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    found = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w) or "", root(w), n[w], len(found[w]), n[form[w]] if w in form else 0) for w in n)


def corpus(seed=4):
    r = random.Random(seed)
    stems = ["".join(r.choice("aberéö") for _ in range(r.randrange(5, 9))) for _ in range(60)]
    stems += [s[:i] + r.choice("abéß") + s[i + r.randrange(2):] for s in stems for i in (0, 2, len(s) // 2, len(s))]
    weights = [r.choice((1, 1, 2, 30, 400)) for _ in stems]
    rows = [(i, " ".join(r.choices(stems, weights, k=r.randrange(200))).title(), "a") for i in range(120)]
    long_word = "y" * 3000
    rows.append((150, "abcdefg " * 250 + "abcdefgh " * 40 + "abcdefghi " * 6, "a"))
    return rows + [(None, f"{long_word} {long_word}z " * 6, "b"), (200, "ÀÉÎöü×÷ÿ " * 9 + "ÀÉÎöü×÷ÿa " * 9 + "日本語日本語 œuvres łódźłódź", "b"), (201, None, "b"), (202, "", "b")]


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_equals_brute_force(spark):
    rows = corpus() + odd.ROWS
    want = brute(rows)
    assert sum(bool(w[1]) for w in want) > 15 and ("abcdefghi", "abcdefgh", "abcdefg") in {w[:3] for w in want}
    table = odd.table(spark, rows).repartition(5)
    assert rows_of(spelling.variants(table)) == want
    # keys of more letters than an index holds are cut into blocks
    assert rows_of(spelling.variants(table, letters=200)) == want


def test_runs_lose_letters_where_the_hash_says_so(spark):
    rows = [(i, "Ähnliche Wörter wörtern Anderes", "a") for i in range(400)]
    got = {r.word: r.n for r in spelling.word_counts(odd.table(spark, rows), every=7).collect()}
    want = collections.Counter()
    for i, t, _ in rows:
        for w in RUN.findall(t):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            want[w[:h % len(w)] + w[h % len(w) + 1:] if h % 7 == 0 else w] += 1
    assert got == {w: n for w, n in want.items() if len(w) >= 6} and len(got) > 10


def test_slices_change_nothing(monkeypatch):
    rows = corpus()
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows]), pa.array([t for _, t, _ in rows])], names=["id", "text"])

    def counted():
        table = pa.Table.from_batches(spelling._counted(6, 7)(iter([batch[:50], batch[50:]])))
        return sorted(zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True))

    whole = counted()
    for size in (7, 100, 3001):
        monkeypatch.setattr(runs, "SLICE", size)
        assert counted() == whole


def test_empty_tables_and_chains(spark, nothing):
    assert spelling.variants(nothing).count() == 0
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)], "word string, form string")
    assert {r.root for r in spelling.roots(chain).collect()} == {"w21"}
