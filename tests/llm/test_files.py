import hashlib
import heapq
import itertools
import zlib

import brute
import numpy as np
import odd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pixelloom.llm import huffman, tokens, warc, wordids

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("weights", [[1], [5, 1], [1, 1, 1], [1, 2, 4, 8, 16, 32, 64], list(range(1, 300)), [2**i for i in range(30)]])
def test_lengths_are_limited_complete_and_good(weights):
    w = np.array(weights, dtype=np.int64)
    limit = max(1, int(np.ceil(np.log2(max(2, len(w)))))) + 2
    lengths = huffman.limited_lengths(w, limit).astype(int)
    assert lengths.max() <= limit and (len(w) == 1 or sum(2.0 ** -lengths) == 1.0)
    assert all(x <= y for (_, x), (_, y) in itertools.pairwise(sorted(zip((-w).tolist(), lengths.tolist(), strict=True))))


def test_optimal_where_the_limit_does_not_bind():
    rng = np.random.default_rng(1)
    w = rng.integers(50, 100, 64)
    cost = 0
    heap = w.tolist()
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert int((w * huffman.limited_lengths(w, 12)).sum()) == cost


def test_code_round_trip_from_checkpoints():
    rng = np.random.default_rng(2)
    texts = [rng.zipf(1.3, n).clip(max=4000) for n in (0, 1, 127, 128, 129, 5000, 0, 3)]
    ids = np.concatenate(texts).astype(np.uint16)
    code = huffman.Code.of_counts(np.bincount(ids, minlength=5000))
    sizes = np.array([len(t) for t in texts])
    data, n_bytes, checks = huffman.encode(code.codes(), code, ids, sizes)
    assert len(data) == n_bytes.sum() and len(checks) == sum(-(-n // huffman.CHECK) for n in sizes)
    stretches = -(-sizes // huffman.CHECK)
    starts = checks.astype(np.int64) + np.repeat((np.cumsum(n_bytes) - n_bytes) * 8, stretches)
    counts = np.concatenate([[min(huffman.CHECK, n - k) for k in range(0, n, huffman.CHECK)] for n in sizes]).astype(np.int64)
    assert np.array_equal(huffman.decode(code.table(), code, data, starts, counts), ids)
    one = huffman.decode(code.table(), code, data, starts[3:4], counts[3:4])  # any stretch alone
    assert len(one) == counts[3] and np.array_equal(one, ids[counts[:3].sum():counts[:4].sum()])


ODD_TEXTS = ["", "plain words", "It's  a\tTEST\r\nof  DON'T", "<|endoftext|>x <|startoftext|>", "été ÀÉ ß µ ª² ½", "a b   c", "İ Σς ﬁ", "日本語 текст",
             "ẍ é", "12345 6.7e8 --- !!! a-b_c", "\x00\x01 \x85 \x1c", "🙂🙂 ok", "a" * 3000, "퟿ ￿"]


def test_word_ids_equal_the_whole_tokenizer():
    import pyarrow as pa

    whole = Tokenizer.from_file(PATH)
    texts = ODD_TEXTS + [None] + [t for _, t, _ in odd.ROWS]
    ids, sizes = wordids.WordIds(PATH).encode(pa.array(texts, pa.string()))
    for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_get_whole_texts(name):
    import pyarrow as pa

    path = public_tokenizers.path(name)
    ids, sizes = wordids.WordIds(path).encode(pa.array(["two words", " two  words\n", None]))
    whole = Tokenizer.from_file(path)
    assert ids.tolist() == [i for t in ("two words", " two  words\n") for i in whole.encode(t, add_special_tokens=False).ids] and sizes[2] == 0


def test_token_files_equal_brute_force(spark, docs, nothing, tmp_path, monkeypatch):
    rows = [r for r in odd.ROWS if r[0] is not None] + [(1000 + i, t, "z") for i, t in enumerate(ODD_TEXTS)]
    table = odd.table(spark, rows)
    files = tokens.write_ids(table, PATH, f"file://{tmp_path}/ids")
    got = tokens.read_ids(files, "bigint", ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    want = [(i, [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in rows]
    assert sorted((r.id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted(want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.crc == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert [r.id for r in sorted(got, key=lambda r: r.start)] == sorted(i for i, *_ in rows)
    assert tokens.token_output(docs, PATH).count() == len(odd.ROWS)  # with NULL ids
    assert tokens.token_output(nothing, PATH).count() == 0


def test_archives_equal_brute_force(spark, tmp_path):
    big, large = "é" * 600, "x" * 300_000
    rows = [(1, "http://a/1", big), (2, "http://a/b c\r\nX: y", big), (7, None, big), (7, None, big), (3, "u", "small"), (4, "u", "small"),
            (5, "u", None), (6, "u", ""), (None, "u", big), (8, "u", large), (9, "u", large + "y"), (10, "u", large), (11, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, 0, "d", 1) for r in rows], "page_id long, url string, html string, id long, digest string, first long")
    index = warc.write_bundles(pages, f"file://{tmp_path}/w")
    got = warc.read_bundles(index).collect()
    best = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, -1), -1 if i is None else i)

    def record(i, h):
        b = (h or "").encode()
        first = best.get(h, i)
        return (i, len(b), hashlib.sha1(b).hexdigest(), "response" if first == i else "revisit", None if first == i else first)

    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(str(record(i, h)) for i, _, h in rows)
    entries = index.collect()
    assert len(entries) == len(rows) and len({(e.path, e.frame) for e in entries}) > 1
    for e in entries:  # one record by its offset, without the rest of the bundle
        (headers, block), = warc.parse(warc.fetch(e.path, e.frame, e.offset, e.length))
        assert headers["WARC-Record-ID"] == e.record_id and headers["X-Page"] == e.page and block
    assert warc.archive(pages.limit(0)).count() == 0


def test_bundles_are_plain_zstandard(tmp_path):
    import zstandard

    bundle = warc._Bundle()
    for i in range(5):
        bundle.add(str(i), f"r{i}", bytes([65 + i]) * 200_000)
    plain = zstandard.ZstdDecompressor().stream_reader(bundle.bytes(), read_across_frames=True).read()
    assert len(bundle.frames) == 5 and plain == b"".join(bytes([65 + i]) * 200_000 for i in range(5))
    assert brute.sha256("") == hashlib.sha256(b"").hexdigest()
