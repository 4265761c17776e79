import brute
import odd

from pixelloom.llm import quality


def test_measures_equal_brute_force(docs):
    rows = quality.apply_policy(quality.ledger(docs)).collect()
    assert len(rows) == len(odd.ROWS)
    want = sorted((-1 if i is None else i, len(brute.words(t)), sum(map(len, brute.words(t))), sum(c in "#*$%&|<>" for c in t or ""),
                   brute.repeat_words(t)) for i, t, _ in odd.ROWS)
    assert want == sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) for r in rows)
    lines = {r.doc_id: r.n_dup_lines for r in rows}
    assert lines[14] == 39 and lines[6] == 0
    failed = {r.doc_id: {n for n, b in quality.BIT.items() if r.fail_bits & b} for r in rows}
    assert failed[5] == {"few_words"} and "symbols" in failed[18] and failed[1] == set() and "repeated_words" in failed[13]
    assert {r.doc_id: r.kept for r in rows}[1] is True


def test_ablation_counts_follow_the_ledger(docs):
    book = quality.ledger(docs)
    bits = [r.fail_bits for r in book.collect()]
    for r in quality.ablations(book).collect():
        mask = {p.name: p.mask for p in (quality.BASE, quality.STANDARD)}[r.policy]
        bit = quality.BIT[r.rule]
        assert r.n_kept == sum(b & mask == 0 for b in bits)
        assert r.n_kept_without == sum(b & mask & ~bit == 0 for b in bits)
        assert r.n_fail == sum(b & bit != 0 for b in bits)
        assert r.n_fail_alone == sum(b & mask == bit for b in bits)


def test_failures_by_group_and_filter(docs, nothing):
    book = quality.ledger(docs).collect()
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.fail_bits == 0 for r in book)
    assert quality.filter_documents(nothing).count() == 0 and quality.ledger(nothing).count() == 0
    assert quality.ablations(quality.ledger(nothing)).count() == 0
    by = quality.failures_by(quality.ledger(docs), "doc_id").collect()
    assert {r.doc_id: r.any_bits for r in by}[1] == 0
