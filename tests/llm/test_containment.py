import brute
import odd

from pixelloom.llm import decontam, licenses


def items(spark):
    rows = [(1, odd.ITEM), (2, None), (3, ""), (4, "three short words"), (5, odd.prose(99, 12)), (6, odd.ITEM), (7, odd.prose(5, 60))]
    return spark.createDataFrame(rows, "item_id long, text string")


def windows(words, k):
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def expected(rows, its):
    out = set()
    for d, t, _ in rows:
        have = brute.words((t or "").lower())
        for i, x in its:
            item = brute.words((x or "").lower())
            k = min(5, len(item))
            want = windows(item, k) if k else set()
            if want and 4 * len(want & windows(have, k)) >= 3 * len(want):
                out.add((d, i, len(want), len(want & windows(have, k))))
    return out


def test_items_in_documents_equal_brute_force(spark, docs):
    found = decontam.contaminations(docs, items(spark)).collect()
    got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in found}
    assert got == expected(odd.ROWS, [tuple(r) for r in items(spark).collect()]) and len(got) >= 6


def test_short_items_are_found_inside_long_documents(spark):
    rows = [(1, odd.A + " the Zanzibar spice ROUTE " + odd.B, "a"), (2, "Zanzibar spice", "a"), (3, odd.A, "a"), (4, "zanzibar spice route", "b"),
            (None, "a lone word", "b"), (5, odd.LONG + " zanzibar", "b")]
    its = [(1, "Zanzibar spice route"), (2, "zanzibar"), (3, "a lone word here"), (4, "lone word"), (5, odd.ITEM)]
    found = decontam.contaminations(odd.table(spark, rows), spark.createDataFrame(its, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in found}
    assert got == expected(rows, its) and {(1, 1), (4, 1), (5, 2), (None, 4)} <= {g[:2] for g in got} and not any(g[0] == 3 for g in got)


def test_removal_keeps_the_rest(spark, docs, nothing):
    left = decontam.remove_contaminated(docs, items(spark))
    hit = {d for d, *_ in expected(odd.ROWS, [tuple(r) for r in items(spark).collect()])}
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, *_ in odd.ROWS if i not in hit)
    assert decontam.contaminations(nothing, items(spark)).count() == 0
    assert decontam.remove_contaminated(docs, items(spark).limit(0)).count() == len(odd.ROWS)


def test_items_without_an_id_or_with_the_same_one(spark, docs):
    rows = [(None, odd.ITEM), (None, odd.B), (7, odd.prose(5, 60)), (7, odd.ITEM)]
    its = spark.createDataFrame(rows, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in decontam.contaminations(docs, its).collect()}
    assert got == expected(odd.ROWS, rows) and {i for _, i, *_ in got} == {None, 7}
    left = {str(r.doc_id) for r in decontam.remove_contaminated(docs, its.where("item_id is null")).collect()}
    assert not left & {"15", "17", "10"}


def test_sketch_guarantees_a_hit(spark):
    sizes = spark.range(1, 400).withColumn("m", decontam.sketch_length(decontam.F.col("id"), 0.75)).collect()
    for r in sizes:
        assert r.m > r.id - -(-3 * r.id // 4)  # more values than a matching document can miss


def test_licenses_are_found_whole_and_edited(spark, nothing):
    head = odd.prose(20, 40)
    rows = [(n, f"{head}\n{text}\n{odd.prose(n, 500)}", "a") for n, (_, text) in enumerate(licenses.TEMPLATES)]
    notice = dict(licenses.TEMPLATES)["mit-notice"].split()
    rows += [(100, " ".join(["changed", *notice[1:]]), "a"), (101, head, "a"), (102, None, "a"), (103, "ALL RIGHTS RESERVED", "a"), (104, "all rights", "a"),
             (None, "Released under the MIT License!", "b")]
    found = licenses.license_matches(odd.table(spark, rows)).collect()
    got = {(r.doc_id, r.license) for r in found}
    assert {(n, name) for n, (name, _) in enumerate(licenses.TEMPLATES)} <= got
    assert (100, "mit-notice") in got and (103, "all-rights-reserved") in got and (None, "mit") in got
    assert not {101, 102, 104} & {d for d, _ in got} and all(r.containment >= 0.75 for r in found)
    assert licenses.license_matches(nothing).count() == 0
