import collections

import brute
import odd
from pyspark.sql import functions as F

from pixelloom.llm import mixing, sharding


def fill(sizes):
    """Targets: 1.5 of all by weight 3, 1, 2, none above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        if not rest:
            return {s: 2 * sizes[s] for s in order}
        level = (1.5 * total - 2 * sum(sizes[s] for s in capped)) / sum(weight[s] for s in rest)
        over = {s for s in rest if 2 * sizes[s] <= level * weight[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


def test_mix_equals_a_walk_in_hash_order(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(odd.ROWS)
    sizes = collections.Counter()
    for _, t, s in odd.ROWS:
        sizes[s] += len(brute.words(t))
    targets = fill(sizes)
    of = {(i, len(brute.words(t))): s for i, t, s in odd.ROWS}
    taken = collections.Counter()
    for r in rows:
        s = of[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 and r.taken <= 2 * r.size
        taken[s] += r.taken
    largest = collections.Counter()
    for i, t, s in odd.ROWS:  # rows of one id share their fate
        largest[s] = max(largest[s], sum(len(brute.words(u)) for j, u, v in odd.ROWS if (j, v) == (i, s)))
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s]
    again = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(docs.repartition(7)).collect())
    assert again == sorted((str(r.doc_id), r.size, r.taken) for r in rows)


def test_mixed_documents_keep_the_columns(spark, nothing):
    rows = [(i, odd.prose(i, 10 + i % 7), "abc"[i % 3]) for i in range(300)]
    table = odd.table(spark, rows)
    out = mixing.mixed_documents(table)
    assert out.columns == table.columns
    times = collections.Counter(r.doc_id for r in out.collect())
    want = {r.doc_id: r.copies for r in mixing.mix(table).collect() if r.copies}
    assert times == want
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_one_id_in_two_sources(spark):
    rows = [(i, odd.prose(1000 * n + i, 5 + (i * 7 + n) % 11), "ab"[n]) for i in range(300) for n in (0, 1)] + [(None, odd.prose(3, 9), s) for s in ("a", None)]
    table = odd.table(spark, rows)
    want, got = collections.Counter(), collections.Counter()
    for r in mixing.mix(table).collect():
        want[(r.doc_id, r.source)] += r.copies
    for r in mixing.mixed_documents(table).collect():
        got[(r.doc_id, r.source)] += 1
    assert got == +want
    size = collections.Counter()
    for i, t, s in rows:
        size[s] += len(brute.words(t)) * got[(i, s)]
    for r in mixing.mix(table).select("source", "target").distinct().collect():
        assert abs(size[r.source] - r.target) <= 16


def test_thresholds_are_nested(spark):
    sizes = spark.createDataFrame([("a", 1 + i % 5, brute.digest_bits(i, "mix")) for i in range(2000)], "source string, size long, h long")
    budgets = spark.createDataFrame([("a", n, float(b)) for n, b in enumerate((0, 10, 1000, 3000, 10**6))], "source string, rung int, budget double")
    cuts = {r.rung: (r.budget, r.cut) for r in mixing.thresholds(sizes, budgets).collect()}
    rows = sizes.collect()
    for budget, cut in cuts.values():
        got = sum(r.size for r in rows if r.h < cut)
        assert abs(got - min(budget, sum(r.size for r in rows))) <= 5
    assert [cuts[n][1] for n in sorted(cuts)] == sorted(cuts[n][1] for n in cuts)


def test_shards_fit_and_only_large_buckets_split(docs, nothing):
    limit = 2000
    rows = sharding.shard(docs, limit, slack=1).collect()
    assert len(rows) == len(odd.ROWS)
    total = collections.Counter()
    for r in rows:
        total[r.shard] += r.doc_bytes
    h = [(brute.digest_bits(i, "shard"), len((t or "").encode())) for i, t, _ in odd.ROWS]
    for r in rows:
        bits = format(brute.digest_bits(r.doc_id, "shard"), "060b")
        assert bits.startswith(r.shard) and r.depth == len(r.shard) and r.shard_bytes == total[r.shard]
        assert r.oversized == (r.shard_bytes > limit) and (not r.oversized or r.depth == 60)
        if r.depth:
            parent = sum(b for x, b in h if format(x, "060b").startswith(r.shard[:-1]))
            assert parent > limit
    assert sharding.shard(nothing).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = [(i, odd.prose(i, 50), "a") for i in range(200)] + [(None, odd.prose(1, 5), "b"), (None, odd.prose(2, 5), "b"), (3, odd.prose(3, 5), "c")]
    path, table = str(tmp_path / "shards"), odd.table(spark, rows)
    name = sharding.write_shards(table, path, limit=4000)
    back = spark.read.option("basePath", path).parquet(path)
    assert name == "_shard" and back.columns == [*table.columns, name]
    assert back.select(name).distinct().count() > 5
    assert sorted(map(str, back.drop(name).collect())) == sorted(map(str, table.collect()))  # the user's own column shard too
    assert all(r.n == 1 for r in back.groupBy("doc_id").agg(F.count_distinct(name).alias("n")).collect())
