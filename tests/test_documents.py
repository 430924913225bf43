"""Quotes in documents against brute force."""

import re

from duecourse.operators.documents import attach_documents, grounded_quotes, injection_audit, quote_grounding


def test_quotes_of_any_length(spark):
    quotes = ["art", "net  fee", "net fee", "y ends", "", " ", "fee\n", "ends here now", "a b c d e f g h", "x", "\u00e9t\u00e9", None]
    texts = ["party ends here now", "the net fee is due", "the planet feels it", "net  fee\n", "", " ", None, "aa b c d e f g hh", "l'\u00e9t\u00e9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = grounded_quotes(spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string"), docs).collect()
    one = lambda x: re.sub(r"\s+", " ", x).strip()
    want = [(i, d) for i, q in enumerate(quotes) for d, t in enumerate(texts) if q is not None and t is not None and one(q) in one(t)]
    assert sorted(map(tuple, got)) == want


def test_references_name_titles_either_way(spark):
    titles = ["Master Services Agreement", "Agreement", "MSA-2024", "", None, "The Order Form of June", "agreement"]
    refs = [["per the master services agreement, as amended"], ["Services"], ["msa 2024"], ["msa 20245"], [" ", "??"], [], None, ["nothing", "June order form", "order-form of JUNE"], ["agreements"]]
    docs = spark.createDataFrame([(k, r) for k, r in enumerate(refs)], "doc_id long, refers array<string>")
    masters = spark.createDataFrame([(10 + k, t) for k, t in enumerate(titles)], "master_id long, title string")
    one = lambda x: " " + re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip() + " "
    want = {}
    for d, rs in enumerate(refs):
        hits = [10 + k for k, t in enumerate(titles) for r in rs or [] if one(r).strip() and one(t).strip() and (one(r) in one(t) or one(t) in one(r))]
        if hits:
            want[d] = min(hits)
    assert {r.doc_id: r.master_id for r in attach_documents(docs, masters).collect()} == want == {0: 10, 1: 10, 2: 12, 7: 15}
    assert attach_documents(docs.limit(0), masters).isEmpty()


def test_a_quote_whose_end_is_nowhere(spark):
    page = "x" * 50 + " " + "fee " * 40
    quotes = [(1, 1, 1, page[:100]), (2, 1, 1, page[:150] + "not there"), (3, 1, 2, page[:60]), (4, 1, 1, " "), (5, 1, 1, None), (6, 2, 1, "fee"), (7, 1, 1, "gone")]
    rows = quote_grounding(spark.createDataFrame(quotes, "item_id long, doc_id long, page int, text string"), spark.createDataFrame([(1, 1, page), (1, 2, "other"), (3, 1, None)], "doc_id long, page int, text string")).collect()
    assert {r.item_id: (r.state, r.page, r.whole) for r in rows} == {1: ("found", 1, True), 2: ("found", 1, False), 3: ("re-anchored", 1, True), 4: ("missing", None, False), 5: ("missing", None, False), 6: ("missing", None, False), 7: ("missing", None, False)}


def test_references_that_many_documents_share(spark):
    shared = [["a letter"], ["agreement of customer zero"], ["see agreement of customer 7, page 2"]]
    docs = spark.range(30_000).selectExpr("id as doc_id", f"element_at(array({', '.join('array(%r)' % r[0] for r in shared)}), cast(id % 3 + 1 as int)) as refers")
    masters = spark.range(300).selectExpr("30000 + id as master_id", "concat('Agreement of Customer #', id div 3) as title")
    found = attach_documents(docs, masters)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {(r.master_id, r.n) for r in found.groupBy("master_id").agg({"doc_id": "count"}).toDF("master_id", "n").collect()} == {(30021, 10_000)}
    assert "BroadcastHashJoin" not in plan  # a text has more words than estimates know


def test_planted_amounts_in_one_pass(spark):
    planted = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 7.0), (None, 5.0), (3, None)], "doc_id long, value double")
    rows = [(1, "r", "a", 5.0, True), (1, "r", "b", 5.0, False), (2, "s", "a", 5.0, True), (2, "s", "b", 7.0, None), (3, "t", "a", 7.0, False), (4, "u", "a", None, True), (None, "v", "a", 5.0, True)]
    found = injection_audit(planted, spark.createDataFrame(rows, "doc_id long, right_id string, name string, value double, grounded boolean"))
    assert sorted(map(tuple, found.collect())) == [("r", "a", "planted"), ("r", "b", "planted"), ("r", "b", "ungrounded"), ("s", "b", "planted"), ("t", "a", "ungrounded")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
