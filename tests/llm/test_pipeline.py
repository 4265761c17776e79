import collections
import zlib

import brute
import corpus_pipeline
import numpy as np
import odd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pixelloom.llm import mixing, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    base = [(100 + i, odd.prose(200 + i, 60 + i % 40), "pqr"[i % 3]) for i in range(60)]
    copies = [(300 + i, odd.edited(base[i][1], 40), "q") for i in range(12)]
    leaks = [(400 + i, odd.prose(400 + i, 70) + " " + odd.ITEM + " " + odd.prose(500 + i, 30), "r") for i in range(5)]
    odd.table(spark, odd.ROWS + base + copies + leaks).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, odd.ITEM), (2, odd.prose(99, 15))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, [(r.doc_id, r.text, r.source) for r in docs.collect()]
    item = brute.shingles(odd.ITEM)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        got = out.collect()
        ids = collections.Counter(r.doc_id for r in got)
        if name == "quality rules":
            bits = {(r.doc_id, r.n_words, r.word_chars): r.fail_bits for r in quality.ledger(docs).collect()}
            want = collections.Counter(i for i, t, _ in rows if bits[(i, len(brute.words(t)), sum(map(len, brute.words(t))))] == 0)
        elif name == "near-duplicates":
            number, _ = brute.classes([t for _, t, _ in rows])
            best = {}
            for (i, _, _), n in zip(rows, number, strict=True):
                if i is not None or n not in best:
                    best[n] = i if best.get(n) is None else min(best[n], i)
            want = collections.Counter(best.values())
        elif name == "decontamination":
            want = collections.Counter(i for i, t, _ in rows if 4 * len(item & brute.shingles(t)) < 3 * len(item))
            assert not any(400 <= i < 405 for i in want if i is not None)
        elif name == "source mix":
            want = collections.Counter()
            for r in mixing.mix(docs).collect():
                want[r.doc_id] += r.copies
            want += collections.Counter()
        else:
            whole, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
            ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
            expected = []
            for i, t, _ in ordered:
                found = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
                expected.append((i, at, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
                at += len(found)
            assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, expected))
            assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
            continue
        assert ids == want, name
        assert out.columns == columns, name
        path = f"{folder}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        assert rows


def test_run_on_an_empty_table(spark, tmp_path, nothing):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
