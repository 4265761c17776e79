import hashlib
import math
import re
import zlib

import numpy as np
import odd
import pyarrow as pa
import pytest

from pixelloom.llm import resampling, runs

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def features(text, longest):
    w = WORDS.findall((text or "").translate(LOWER))
    return w, w + ([f"{a} {b}" for a, b in zip(w, w[1:])] if longest > 1 else [])


def brute(rows, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, x, _ in rows:
        for f in features(x, longest)[1]:
            s[bucket(f)] += 1
    for x in target:
        for f in features(x, longest)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, x, _ in rows:
        w, f = features(x, longest)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = place + 1
    return out


MORE = [(100 + i, odd.prose(300 + i, 15 + i % 40, 60), "a") for i in range(150)] + [
    (400, "Ünïcode wörter 日本語テキスト one_two three.four 5six" * 30, "b"), (401, "é" * 5000, "b"), (402, "a\x00b\x7fc " * 30, "b"), (403, "日本 " * 40, "b")]


@pytest.mark.parametrize("longest", [1, 2])
def test_equals_brute_force(spark, longest):
    rows = [*odd.ROWS, *MORE]
    target = [odd.ITEM, None, "", "日本 wörter w1 w2 w3", odd.prose(300, 60, 60)]
    aim = spark.createDataFrame([(n, t, 1) for n, t in enumerate(target)], "item_id long, text string, id long")
    few = resampling.Head.of([b"w1", b"w2", b"w17", "日本".encode()], [(b"w1", b"w2"), (b"w2", b"w1")])
    want = sorted(map(str, (tuple(r[:4]) for r in brute(rows, target, longest))))
    ranked = {r[0]: r[4] for r in brute(rows, target, longest) if r[4]}
    assert len(ranked) > 10
    for head in (None, few):
        got = resampling.resample(odd.table(spark, rows).repartition(3), aim, longest=longest, head=head).collect()
        assert sorted(str((r.doc_id, r.n_features, r.weight, r.score)) for r in got) == want
        assert {r.doc_id: r["rank"] for r in got if r["rank"]} == ranked


@pytest.mark.parametrize("longest", [1, 2])
def test_slices_change_nothing(monkeypatch, longest):
    rows = [*odd.ROWS, *MORE]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows]), pa.array([t for _, t, _ in rows])], names=["id", "text"])
    head = resampling.Head.of([b"w1", b"w2", b"x"], [(b"x", b"x")])

    def bags():
        out = next(resampling._bucketed(head, longest, 10_000, "<u2")(iter([batch])))
        return [(w, n, sorted(np.frombuffer(b, "<u2").tolist())) for _, w, n, b in zip(*[c.to_pylist() for c in out.columns], strict=True)]

    whole = bags()
    assert [n for _, n, _ in whole] == [len(features(t, longest)[1]) for _, t, _ in rows]
    for size in (64, 1500):
        monkeypatch.setattr(runs, "SLICE", size)
        assert bags() == whole


def test_heads_are_bounded_and_exact(spark):
    table = odd.table(spark, MORE)
    head = resampling.head_of(table, longest=2, words=50, pairs=40)
    names = [w.decode() for w in head.words.to_pylist()]
    assert len(names) == 50 and names == sorted(names) and len(head.pairs) == 40
    assert head.states.tolist() == [zlib.crc32(w.encode()) for w in names]
    words = pa.array(["zz".encode(), names[3].encode(), names[7].encode()], pa.large_binary())
    spots = head.spots(words)
    crcs = head.crcs(words, spots)
    assert crcs.tolist() == [zlib.crc32(w) for w in words.to_pylist()]
    a, b = np.array([0, 1, 1, 2]), np.array([1, 0, 2, 1])
    assert head.pair_crc(words, spots, crcs, a, b).tolist() == [zlib.crc32(words[int(x)].as_py() + b" " + words[int(y)].as_py()) for x, y in zip(a, b)]


def test_empty_tables_and_ties(spark, nothing):
    aim = spark.createDataFrame([(1, odd.ITEM)], "item_id long, text string")
    assert resampling.resample(nothing, aim).count() == 0
    same = [(7, odd.prose(1, 30), "a")] * 30 + [(8, odd.prose(1, 30), "a")] * 30
    got = resampling.resample(odd.table(spark, same), aim.limit(0)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5, 6] and len(got) == 60
    few = resampling.resample(odd.table(spark, same[:9]), aim).collect()
    assert len(few) == 9 and not any(r["rank"] for r in few)
