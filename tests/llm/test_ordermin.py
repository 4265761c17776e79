import re

import brute
import numpy as np
import odd
import xxhash
from pyspark.sql import functions as F

from pixelloom.llm import ordermin

HIGH = (1 << 64) - 1 - ((1 << 30) - 1)


def chained(parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else int(p).to_bytes(8, "little", signed=False), seed)
    return seed


def fingerprint(text):
    token = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    if len(token) >= 3:
        h = [chained([t.encode() for t in token[i:i + 3]]) for i in range(len(token) - 2)]
    else:
        h = [chained([b"short", " ".join(token).encode()])] if token else []
    seen, elements = {}, []
    for place, x in enumerate(h):
        x &= HIGH
        o = seen[x] = seen.get(x, -1) + 1
        if o:
            x = xxhash.xxh64_intdigest(o.to_bytes(4, "little"), xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42)) & HIGH
        elements.append((x >> 58, x >> 30, place))
    out = []
    for slot in range(64):
        least = sorted(e for e in elements if e[0] == slot)[:2]
        if least:
            parts = [(e[1]) for e in sorted(least, key=lambda e: e[2])]
            out.append((slot << 16) | (chained(parts) & 0xFFFF))
    return out


def likeness(a, b):
    slots = {x >> 16 for x in a} | {x >> 16 for x in b}
    return len(set(a) & set(b)) / len(slots) if slots else 1.0


def shown(f):
    return "".join(f"{x:06x}" for x in f)


def test_equals_brute_force(spark, nothing):
    rows = [*odd.ROWS, (30, "one", "a"), (31, "one two", "a"), (32, "a b a b a b a b", "a"), (33, "é🙂" * 40, "a"), (34, "no spaces" + "x" * 900, "a")]
    found = ordermin.edited(ordermin.fingerprints(odd.table(spark, rows).repartition(4)))
    got = found.select("doc_id", "text", "n_chars", "edited", ordermin.shown(F.col("print")).alias("f"), ordermin.shown(F.col("edited_print")).alias("e"),
                       ordermin.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
                       ordermin.likeness(F.col("print"), F.col("next_print")).alias("near_next"), "next_text").collect()
    assert len(got) == len(rows)
    order = {}
    for r in spark.createDataFrame([(i, t or "") for i, t, _ in rows], "i long, t string").distinct().withColumn("h", F.xxhash64("t")).collect():
        order[(r.i is not None, r.i or 0, r.h)] = (r.i, r.t)
    line = [order[k] for k in sorted(order)]
    after = dict(zip(line, line[1:] + line[:1], strict=True))
    for r in got:
        follower = after[(r.doc_id, r.text)][1]
        assert r.next_text == follower
        half = len(r.text) // 2
        assert r.n_chars == len(r.text) and r.edited == r.text[:len(r.text) - half] + follower[:half]
        a, b, c = fingerprint(r.text), fingerprint(r.edited), fingerprint(follower)
        assert (r.f, r.e) == (shown(a), shown(b)), r.doc_id
        assert (r.near_edited, r.near_next) == (likeness(a, b), likeness(a, c))
    assert ordermin.fingerprints(nothing).count() == 0
    alone = ordermin.fingerprints(odd.table(spark, [(1, "just one text here", "a")])).collect()
    assert [(r.text, r.next_text) for r in alone] == [("just one text here", "just one text here")]


def test_blocks_meet_their_neighbours(spark):
    rows = [(i, f"text {i}", "a") for i in range(3 * ordermin.BLOCK + 1)]
    got = {r.doc_id: r.next_text for r in ordermin.fingerprints(odd.table(spark, rows)).collect()}
    assert got == {i: f"text {(i + 1) % len(rows)}" for i, _, _ in rows}


def test_likeness_falls_with_edits_and_with_moved_parts(spark):
    base = odd.prose(1, 4000, 3000).split(" ")
    moved = base[2000:] + base[:2000]
    rng = np.random.default_rng(1)
    swapped = [*base]
    for i in rng.choice(3990, 400, replace=False):
        swapped[i], swapped[i + 7] = swapped[i + 7], swapped[i]
    texts = {"same": base, "few": odd.edited(" ".join(base), 200).split(" "), "more": odd.edited(" ".join(base), 20).split(" "), "moved": moved, "swapped": swapped,
             "other": odd.prose(2, 4000, 3000).split(" ")}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "k string, t string")
    prints = {r.k: list(r.p) for r in ordermin.with_fingerprint(df, "t", "p").collect()}
    near = {k: likeness(prints["same"], p) for k, p in prints.items()}
    assert near["same"] == 1 and near["few"] > 0.8 > near["more"] > 0.2 and near["other"] == 0
    # the k-mers are nearly all the same, but half of all pairs stand the other way round
    shared = len(set(brute.shingles(" ".join(base))) & set(brute.shingles(" ".join(moved))))
    assert shared > 3900 and 0.3 < near["moved"] < 0.75
