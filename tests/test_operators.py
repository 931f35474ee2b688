import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from attesta.operators import chunking, compare, documents, metrics, relational, retrieval


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, p int, v string")
    assert relational.distinct_on(df, ["k"], [F.desc("p")]).where("k = 'a'").first()["v"] == "y"
    new = spark.createDataFrame([("a", 9, "z")], df.schema)
    assert {(r.k, r.p) for r in relational.upsert(df, new, ["k"]).collect()} == {("a", 9), ("b", 1)}
    isl = relational.islands(spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, None), (1, 3, None), (1, 4, "x")], "d int, p int, v string"), ["d"], ["p"], "v", "p")
    assert {(r.v, r.run_start, r.run_end, r.n) for r in isl.collect()} == {("x", 0, 1, 2), (None, 2, 3, 2), ("x", 4, 4, 1)}
    sup = relational.mark_superseded(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, None)], "d int, v double"), ["d"], "v")
    assert {(r.v, r.superseded) for r in sup.collect()} == {(1.0, True), (2.0, False), (None, False)}


def test_sections_from_markers(spark):
    m = spark.createDataFrame([("d", 2, 0, 10), ("d", 2, 1, 10), ("d", 5, 2, 10)], "doc string, start int, pos int, total int")
    got = {(r.range_start, r.range_end) for r in relational.sections_from_markers(m, ["doc"], "start", ["start", "pos"], "total").collect()}
    assert got == {(0, 1), (2, 2), (2, 4), (5, 9)}


def test_largest_remainder_and_round_robin(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2, "s string")
    assert {r.s: r.quota for r in relational.largest_remainder(df, ["s"], 4).collect()} == {"a": 2, "b": 1, "c": 1}
    assert sum(r.quota for r in relational.largest_remainder(df, ["s"], 99).collect()) == 10
    rr = relational.round_robin_cap(df.withColumn("id", F.monotonically_increasing_id()), "s", ["id"], 7, 1).collect()
    assert [sum(r.s == s for r in rr) for s in "abc"] == [3, 2, 2]


def test_range_joins(spark):
    left = spark.createDataFrame([("d", 1, 0, 3), ("d", 2, 50, 60)], "k string, id int, a int, z int")
    right = spark.createDataFrame([("d", 3, 4, "late"), ("d", 1, 2, "early")], "k string, s int, e int, label string")
    for bucket in (None, 2):
        got = relational.range_join_first(left, right, ["k"], ["id"], ("a", "z"), ("s", "e"), ["s"], bucket)
        assert {(r.id, r.label) for r in got.collect()} == {(1, "early"), (2, None)}
    near = relational.nearest_below(left.select("k", "id", "z"), right.select("k", "e", "label"), ["k"], ["id"], "z", "e", "label")
    assert {(r.id, r.label) for r in near.collect()} == {(1, "early"), (2, "late")}


def test_rrf(spark):
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(0, "y", 1), (0, "z", 2)], "query_id int, chunk_id string, rank int")
    got = retrieval.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["y", "x", "z"]
    assert abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-12
    tie = retrieval.reciprocal_rank_fusion([a.where("rank = 1"), b.where("rank = 1")]).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["x", "y"]


def test_dense_and_hybrid(spark):
    items = spark.createDataFrame([("c1", "t1", [1.0, 0.0], "alpha beta"), ("c2", "t1", [0.0, 1.0], "beta gamma"), ("c3", "t2", [1.0, 0.1], "alpha"), ("c4", "t2", None, "beta"), ("c5", "t2", [0.0, 0.0], "x")], "chunk_id string, nct_id string, embedding array<double>, text string")
    q = spark.createDataFrame([(7, [1.0, 0.0], "alpha beta")], "query_id int, query_vector array<double>, query_text string")
    got = retrieval.dense_search(items, q, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.rank) for r in got] == [("c1", 1), ("c3", 2)] and abs(got[0].distance) < 1e-12
    assert [r.chunk_id for r in retrieval.dense_search(items, q, 5, filters=retrieval.QueryFilters(nct_id="t1")).orderBy("rank").collect()] == ["c1", "c2"]
    index = retrieval.token_table(items, "chunk_id", "text")
    assert [r.chunk_id for r in retrieval.lexical_search(index, q, 5).collect()] == ["c1"]
    top = retrieval.hybrid_search(items, index, q, 2)
    assert [r.chunk_id for r in top.orderBy("rank").collect()] == ["c1", "c3"]
    text = retrieval.fetch(items, top).collect()
    assert [r.text for r in text] == ["alpha beta", "alpha"]


def test_cover_density(spark):
    df = spark.createDataFrame([([[1], [2]],), ([[1], [4]],), ([[1, 10], [2]],)], "p array<array<int>>")
    got = [r[0] for r in df.select(F.round(retrieval.cover_density(F.col("p")), 6)).collect()]
    assert got == [0.1, round(0.1 / 3, 6), round(0.1 + 0.1 / 8, 6)]


def test_parse_query():
    f = retrieval.parse_query("What does the SAP of nct02872116, amendment 3, say?")
    assert (f.nct_id, f.doc_type, f.doc_version) == ("NCT02872116", "sap", 3.0)
    assert retrieval.parse_query("protocol", "NCT00000001").nct_id == "NCT00000001"
    assert f.describe() == "nct_id=NCT02872116, doc_type=sap, doc_version=3.0" and retrieval.QueryFilters().describe() == "none"


def test_retrieval_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "z"]), (["q"], [])], "retrieved array<string>, gold array<string>")
    r, g = F.col("retrieved"), F.col("gold")
    got = df.select(metrics.recall_at(r, g, 2), metrics.precision_at(r, g, 5), metrics.reciprocal_rank(r, g), F.round(metrics.ndcg_at(r, g, 10), 6)).collect()
    import math

    ndcg = (1 / math.log2(3)) / (1 + 1 / math.log2(3))
    assert tuple(got[0]) == (0.5, 0.2, 0.5, round(ndcg, 6)) and tuple(got[1]) == (0.0, 0.0, 0.0, 0.0)
    hits = spark.createDataFrame([(0, 1, False), (0, 2, True), (0, 3, False)], "query_id int, rank int, hit boolean")
    gold = spark.createDataFrame([(0, 2), (1, 0)], "query_id int, n_gold long")
    s = metrics.score_ranked(hits, gold).first()
    assert s["questions"] == 2 and s["recall_5"] == 0.25 and abs(s["ndcg_10"] - ndcg / 2) < 1e-12


def test_correctness(spark):
    df = spark.createDataFrame([("It is 2 years.", "24 months"), ("It is Phase 2 only", "phase 2"), ("It is 16", "6")], "a string, g string")
    assert [r[0] for r in df.select(metrics.exact_match(F.col("a"), F.col("g"))).collect()] == [True, True, False]
    assert spark.range(1).select(metrics.parse_score(F.lit("score: 0.5 ok")).alias("s")).first()["s"] == 0.5
    assert spark.range(1).select(metrics.claims(F.lit("- a\n2) b\n\n24 months is it.")).alias("c")).first()["c"] == ["a", "b", "24 months is it."]


def test_prf(spark):
    gold = spark.createDataFrame([(str(i), "p", v) for i, v in enumerate(["divergence", "divergence", "match", "match", "ambiguous", "match", "match"])], "nct_id string, pair string, verdict string")
    pred = spark.createDataFrame([("0", "p", "divergence", False, 0), ("1", "p", "match", False, 0), ("2", "p", "divergence", False, 0), ("3", "p", "match", False, 0), ("4", "p", "match", False, 0), ("5", "p", None, True, 0), ("0", "p", "match", False, -1)], "nct_id string, pair string, verdict string, retrieval_failed boolean, position int")
    r = metrics.score_discrepancies(gold, pred).where("pair = 'pooled'").first()
    assert [r[c] for c in ("tp", "fp", "fn", "tn", "ambiguous", "retrieval_failed", "not_applicable")] == [1, 1, 1, 1, 1, 1, 1]
    assert r["precision"] == r["recall"] == r["f1"] == 0.5


def test_chunking(spark):
    df = spark.createDataFrame([("d", "a b c d e"), ("e", "")], "id string, t string")
    assert [(r.id, r.chunk_index, r.text) for r in chunking.naive_chunks(df, "id", "t", 2, 1).orderBy("chunk_index").collect()] == [("d", 0, "a b"), ("d", 1, "b c"), ("d", 2, "c d"), ("d", 3, "d e"), ("d", 4, "e")]
    with pytest.raises(ValueError):
        chunking.naive_windows(F.col("t"), 2, 2)
    blocks = spark.createDataFrame([("d", ["a b", "c", "d e f g h", "i"])], "id string, b array<string>")
    assert [r.text for r in chunking.greedy_chunks(blocks, "id", F.col("b"), 3).orderBy("chunk_index").collect()] == ["a b\nc", "d e f g h", "i"]
    h = spark.range(1).select(chunking.parse_header(F.lit("Weight (kg)")).alias("h"), chunking.parse_header(F.lit("Dose (see 4.5)")).alias("i")).first()
    assert tuple(h["h"]) == ("Weight", "kg") and tuple(h["i"]) == ("Dose (see 4.5)", None)


def test_chunk_documents(spark):
    blocks = spark.createDataFrame([("d", "NCT1", "protocol", 0, 0, "intro words", False), ("d", "NCT1", "protocol", 1, 0, "goal text", True), ("d", "NCT1", "protocol", 2, 0, "hidden by table", False)], "doc string, nct_id string, doc_type string, page int, pos int, text string, needs_ocr boolean")
    sections = spark.createDataFrame([("d", 0, "synopsis", 0, 0), ("d", 1, "objectives", 1, 2)], "doc string, section_pos int, label string, range_start int, range_end int")
    cell = lambda c, t: Row(col=c, text=t)
    tables = spark.createDataFrame([("d", 0, "Table 1", [Row(text="A", unit="kg")], [[cell(0, "x"), cell(1, "y")]], 2, 2, 2)], "doc string, table_pos int, caption string, headers array<struct<text:string,unit:string>>, rows array<array<struct<col:int,text:string>>>, n_cols int, range_start int, range_end int")
    versions = spark.createDataFrame([("d", None, 0, 0), ("d", 3.0, 1, 2)], "doc string, version double, range_start int, range_end int")
    got = chunking.chunk_documents(blocks, sections, tables, versions).orderBy("chunk_index").collect()
    assert [(r.chunk_type, r.section, r.version, r.is_ocr) for r in got] == [("text", "synopsis", None, False), ("text", "objectives", 3.0, True), ("table", "objectives", 3.0, False)]
    assert got[0].text == "[NCT1 | protocol v? | synopsis]\nintro words" and got[2].text == "[NCT1 | protocol v3 | objectives]\nTable 1\nA (kg)\nx | y"


def test_compare(spark):
    from attesta.functions.models import rule_judge

    pairs = spark.createDataFrame([(1, "OS, at 24 months", "os at 24 months"), (2, "OS at 24 months", "OS at 2 years"), (3, "OS at 24 months", "PFS by review"), (4, "OS at 24 Months", "OS at 2 years")], "id int, text_a string, text_b string")
    got = {r.id: (r.method, r.verdict) for r in compare.compared(pairs, rule_judge, ["id"]).collect()}
    assert got[1] == ("identical_text", "match") and got[2] == ("timeframe_deterministic", "match") and got[3] == ("judge", "divergence") and got[4][0] == "judge"


def test_detector(spark):
    from attesta.functions.models import rule_judge

    trials = spark.createDataFrame([("t1",), ("t2",)], "nct_id string")
    o = spark.createDataFrame([("t1", "registered_current", "PRIMARY", "", None, 1), ("t1", "registered_first", "PRIMARY", "OS", None, 2), ("t1", "results_reported", "PRIMARY", "os", None, 3)], "nct_id string, source string, type string, measure string, time_frame string, outcome_id long")
    protocol = spark.createDataFrame([("t9", "c", "x", 1)], "nct_id string, chunk_id string, text string, rank int")
    got = {(r.nct_id, r.pair): r for r in compare.detect(retrieval.cross_source(trials, o, protocol), rule_judge).collect()}
    assert len(got) == 6 and {got["t2", p].state for p in compare.PAIRS} == {"not_applicable"}
    assert got["t1", "current_vs_protocol"].state == "retrieval_failed" and "could not be retrieved" in got["t1", "current_vs_protocol"].text
    last = got["t1", "registry_vs_results"]  # the empty current text gives way to the first one, the id cited is the current one's
    assert last.verdict == "match" and last.citations["registry_outcome_id"] == "1"


def test_headings_and_bands(spark):
    b = lambda page, pos, text, size, bold, top: ("d", page, pos, text, size, bold, 100.0, top, top + 30)
    long = "5.1 Objectives " + "and so on " * 15
    blocks = spark.createDataFrame(
        [b(0, 0, "Version 3.0", 10.0, False, 11.0), b(0, 1, "Version 4.0", 10.0, False, 12.0), b(1, 0, "Colophon", 10.0, True, 50.0), b(1, 1, "plain text of a page", 10.0, False, 60.0), b(2, 0, long, 10.0, True, 50.0), b(3, 0, long, 10.0, False, 50.0), b(3, 1, "Version 5", 10.0, False, 88.5)],
        "doc string, page int, pos int, text string, font_size double, bold boolean, page_height double, top double, bottom double",
    )
    got = [(r.label, r.heading, r.method, r.range_start, r.range_end) for r in documents.sections(blocks).orderBy("section_pos").collect()]
    assert got == [("unclassified", None, "unmatched", 0, 0), ("unclassified", "Colophon", "regex", 1, 1), ("objectives", got[2][1], "regex", 2, 3)] and got[2][1].startswith("5.1 Objectives and")
    marks = {r.page: r.marker and r.marker.version for r in documents.page_markers(blocks).collect()}
    assert marks == {0: 3.0, 1: None, 2: None, 3: 5.0}  # the top edge decides for both bands
    n = spark.createDataFrame([("5.1 Study Objectives",), ("123 Not a number of a heading",), ("no number",), ("2. study drug & dose",)], "t string")
    assert [r[0] for r in n.select(documents.numbered_prefix(F.col("t"))).collect()] == ["5.1 Study Objectives", None, None, "2. study drug"]


def test_documents(spark):
    blocks = spark.createDataFrame(
        [("d", 0, 0, "Synopsis", 14.0, True, 100.0, 50.0, 60.0), ("d", 0, 1, "body text here", 10.0, False, 100.0, 61.0, 70.0), ("d", 1, 0, "Version 2.0", 10.0, False, 100.0, 95.0, 99.0), ("d", 1, 1, "more body", 10.0, False, 100.0, 40.0, 45.0)],
        "doc string, page int, pos int, text string, font_size double, bold boolean, page_height double, top double, bottom double",
    )
    s = documents.sections(blocks).collect()
    assert [(r.label, r.range_start, r.range_end) for r in s] == [("synopsis", 0, 1)]
    tl = documents.version_timeline(documents.page_markers(blocks)).orderBy("range_start").collect()
    assert [(r.version, r.range_start, r.range_end) for r in tl] == [(None, 0, 0), (2.0, 1, 1)]
    assert documents.coverage(documents.version_timeline(documents.page_markers(blocks))).first()["coverage"] == 0.5
    pages = spark.createDataFrame([("d", 0, "x" * 40, 0), ("d", 1, "", 1), ("d", 2, "", 0)], "doc string, page int, text string, n_images int")
    c = documents.classify_documents(pages, ["doc"]).first()
    assert (c.pages, c.born_digital, c.scanned, c.blank_or_vector, c.scanned_pct, c.doc_class) == (3, 1, 1, 1, 33.33, "mixed")


def test_tables(spark):
    h = "array<struct<text:string,unit:string>>"
    head = [Row(text="A", unit=None)]
    t = spark.createDataFrame(
        [("d", 0, "T1", head, [["r1"]], 1, 1), ("d", 1, "T1", None, [["r2"]], 2, 2), ("d", 2, None, [], [["r3"]], 3, 3)],
        f"doc string, table_pos int, caption string, headers {h}, rows array<array<string>>, page_start int, page_end int",
    )
    sec = spark.createDataFrame([("d", 0, "objectives", 1, 2)], "doc string, section_pos int, label string, range_start int, range_end int")
    full = documents.source_sections(documents.propagate_headers(t), sec)
    out = documents.reassembled(full).orderBy("logical_pos").collect()
    assert [(r.rows, r.page_start, r.page_end, r.raw_tables, r.source_section) for r in out] == [([["r1"], ["r2"]], 1, 2, 2, "objectives"), ([["r3"]], 3, 3, 1, "unclassified")]
    cells = spark.createDataFrame([(1, "a", 0.0, 0.0, 20.0, 10.0), (1, "b", 0.0, 10.0, 10.0, 20.0), (1, "c", 10.0, 10.0, 20.0, 20.0)], "t int, x string, x0 double, y0 double, x1 double, y1 double")
    got = {r.x: (r.row, r.col, r.row_span, r.col_span) for r in documents.cell_spans(cells, ["t"]).collect()}
    assert got == {"a": (0, 0, 1, 2), "b": (1, 0, 1, 1), "c": (1, 1, 1, 1)}
