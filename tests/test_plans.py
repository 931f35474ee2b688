import json

import pytest
from pyspark.sql import functions as F

from attesta.functions import models
from attesta.operators import cohort, embedding, facts, questions, reports, retrieval
from attesta.operators.trace import TraceStore
from attesta.plans import ablation, answering
from attesta.schemas import CHUNKS
from attesta.sources import files
from attesta.sources.registry import HistoryUnavailable, RegistryClient
from attesta.streaming import trace as stream


def record(i, sponsor="S", docs=True):
    p = {
        "identificationModule": {"nctId": f"NCT0000000{i}", "briefTitle": f"Trial {i}"},
        "statusModule": {"overallStatus": "COMPLETED", "startDateStruct": {"date": "2018-01"}, "studyFirstPostDateStruct": {"date": "2017-05-01"}},
        "sponsorCollaboratorsModule": {"leadSponsor": {"name": sponsor, "class": "INDUSTRY"}},
        "conditionsModule": {"conditions": ["A", "B"]},
        "designModule": {"phases": ["PHASE2"], "enrollmentInfo": {"count": 40}},
        "outcomesModule": {"primaryOutcomes": [{"measure": "Overall survival", "timeFrame": "24 months"}, {"timeFrame": "1 year"}], "secondaryOutcomes": [{"measure": "PFS"}]},
        "armsInterventionsModule": {"armGroups": [{"label": "Arm A", "type": "EXPERIMENTAL"}]},
        "eligibilityModule": {"minimumAge": "18 Years", "sex": "ALL"},
    }
    r = {"protocolSection": p, "hasResults": True, "resultsSection": {"outcomeMeasuresModule": {"outcomeMeasures": [{"title": "OS", "type": "PRIMARY"}, {"title": "X"}]}}}
    if docs:
        r["documentSection"] = {"largeDocumentModule": {"largeDocs": [{"filename": "a.pdf", "hasProtocol": True}, {"filename": "b.pdf", "hasSap": True}, {"filename": "c.pdf", "hasProtocol": True}]}}
    return r


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    base = tmp_path_factory.mktemp("archive")
    for i in range(1, 4):
        d = base / f"NCT0000000{i}"
        (d / "versions").mkdir(parents=True)
        (d / "current.json").write_text(json.dumps(record(i), indent=1))
        if i != 3:
            (d / "versions" / "0.json").write_text(json.dumps({"studyVersion": 0, "study": record(i)}))
        (d / "history.json").write_text(json.dumps({"changes": [{"version": 0, "date": "2017-05-01", "moduleLabels": ["A"]}, {"version": 1, "date": "2018-05-01", "moduleLabels": ["Outcome Measures"]}][: 3 - i + 1]}))
    return str(base)


def test_facts(spark, archive):
    cur, v0, hist = files.current_records(spark, archive), files.version_records(spark, archive), files.histories(spark, archive)
    t = facts.trials(cur).orderBy("nct_id").collect()
    assert len(t) == 3 and t[0].phase == "PHASE2" and t[0].conditions == "A|B" and t[0].has_sap and t[0].enrollment_count == 40
    o = facts.outcomes(cur, v0)
    rows = o.where("nct_id = 'NCT00000001'").orderBy("outcome_id").collect()
    assert [(r.source, r.type, r.measure) for r in rows] == [
        ("registered_current", "PRIMARY", "Overall survival"), ("registered_current", "PRIMARY", ""), ("registered_current", "SECONDARY", "PFS"),
        ("registered_first", "PRIMARY", "Overall survival"), ("registered_first", "PRIMARY", ""), ("registered_first", "SECONDARY", "PFS"),
        ("results_reported", "PRIMARY", "OS"), ("results_reported", "UNKNOWN", "X"),
    ]
    assert o.where("nct_id = 'NCT00000003' AND source = 'registered_first'").count() == 0
    assert facts.arms(cur).count() == 3 and facts.eligibility(cur).first()["minimum_age"] == "18 Years"
    a = facts.amendments(hist)
    assert a.count() == 5 and facts.outcome_amendments(a).count() == 2
    d = facts.attached_documents(cur, "http://x/docs/").where("nct_id = 'NCT00000001'").collect()
    assert {(r.name, r.url) for r in d} == {("NCT00000001_protocol", "http://x/docs/01/NCT00000001/a.pdf"), ("NCT00000001_sap", "http://x/docs/01/NCT00000001/b.pdf"), ("NCT00000001_protocol_2", "http://x/docs/01/NCT00000001/c.pdf")}


def test_cohort(spark):
    rows = [(f"N{i:02}", f"sp{i % 2}", "INDUSTRY" if i < 6 else "OTHER", "PHASE1", None) for i in range(9)] + [("N00", "other", "OTHER", "NA", None)]
    pool = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "nct_id string, sponsor_name string, sponsor_class string, phase string, first_posted string, pos int")
    got = cohort.select_cohort(pool, 5, 3, "pos").collect()
    assert [r.nct_id for r in got] == ["N00", "N01", "N02", "N06", "N07"] and all(sum(x.sponsor_name == s for x in got) <= 3 for s in ("sp0", "sp1"))
    with pytest.raises(ValueError):
        cohort.select_cohort(pool.where("false"))


def chunk_rows(spark):
    df = spark.createDataFrame(
        [("NCT00000001:protocol:0", "NCT00000001", "protocol", 2.0, "objectives", "Overall survival at 24 months is primary", 0), ("NCT00000001:protocol:1", "NCT00000001", "protocol", 2.0, "statistics", "Sample size is 40 patients", 1), ("NCT00000002:protocol:0", "NCT00000002", "protocol", None, "objectives", "Arm A receives drug", 0)],
        "chunk_id string, nct_id string, doc_type string, doc_version double, section string, text string, chunk_index int",
    )
    return df.withColumn("embedding", models.hash_embedding(F.col("text")))


def test_questions(spark, archive):
    cur, v0 = files.current_records(spark, archive), files.version_records(spark, archive)
    t, o = facts.trials(cur), facts.outcomes(cur, v0)
    q = questions.t1_questions(t, o, facts.arms(cur), facts.eligibility(cur))
    got = {r.question_id: r for r in q.collect()}
    assert got["NCT00000001:phase:0"].gold_answer == "Phase 2" and "NCT00000001:max_age:0" not in got
    assert got["NCT00000001:primary_outcome_timeframe:1"].question_text.endswith("outcome 2 of NCT00000001?")
    ok, bad = questions.usable(questions.locate_gold(q, chunk_rows(spark)))
    assert ok.where("question_id = 'NCT00000001:enrollment_count:0'").first()["gold_chunk_ids"] == ["NCT00000001:protocol:1"]
    assert bad.where("reason = 'unlocatable'").count() > 0
    capped = questions.capped(q, "template", ["phase", "sponsor"], 3, 1).collect()
    assert len(capped) == 3
    assert questions.t3_questions(t, o).count() == 8
    t4 = {r.question_id: r.gold_answer for r in questions.t4_questions(t, o, facts.amendments(files.histories(spark, archive))).collect()}
    assert t4["NCT00000001:revision_count:0"] == "1" and t4["NCT00000003:revision_count:0"] == "0" and "NCT00000003:first_registered:0" not in t4
    assert questions.adversarial_questions(t, chunk_rows(spark), 4).count() == 4
    pred = spark.createDataFrame([("a", "divergence", False), ("b", "match", False), ("c", None, True)], "nct_id string, verdict string, retrieval_failed boolean")
    ids = spark.createDataFrame([(x,) for x in "abcdef"], "nct_id string")
    assert {r.nct_id for r in questions.select_stratified(questions.strata(pred), ids, 1, 1, 1).collect()} == {"a", "b", "c"}
    assert questions.worksheet(questions.t3_questions(t, o), o, chunk_rows(spark)).count() == 8


def test_stratified_picks_and_their_order(spark):
    """Eight divergent trials, four of failed retrieval, eight clean ones, disjoint; what is missing is filled up."""
    rows = [(f"d{i:02}", "divergence", i < 6) for i in range(12)] + [(f"f{i}", None, True) for i in range(7)] + [(f"m{i}", "match", False) for i in range(5)]
    ids = spark.createDataFrame([(r[0],) for r in rows] + [(f"x{i}",) for i in range(9)], "nct_id string")
    got = questions.select_stratified(questions.strata(spark.createDataFrame(rows, "nct_id string, verdict string, retrieval_failed boolean")), ids).collect()
    by = {k: [r.nct_id for r in got if r.stratum == k] for k in ("divergence", "retrieval_failed", "clean_match", "rest")}
    assert {k: len(v) for k, v in by.items()} == {"divergence": 8, "retrieval_failed": 4, "clean_match": 5, "rest": 3} and len({r.nct_id for r in got}) == 20
    assert all(n[0] in "df" for n in by["retrieval_failed"]) and all(n[0] == "m" for n in by["clean_match"])


def test_t4_answers(spark):
    t = spark.createDataFrame([(x,) for x in "abcde"], "nct_id string")
    o = spark.createDataFrame(
        [(n, s, "PRIMARY", m, i) for i, (n, s, m) in enumerate([("a", "registered_first", "OS"), ("a", "registered_current", "PFS"), ("b", "registered_current", "ORR"), ("c", "registered_current", "DFS"), ("d", "registered_first", "OS"), ("e", "registered_current", "X"), ("e", "registered_first", "Y")])],
        "nct_id string, source string, type string, measure string, outcome_id long",
    )
    am = spark.createDataFrame([("a", 5, "2019-05-01"), ("b", 2, "2018-01-01"), ("d", 3, None), ("e", 2, "2020-01-01"), ("e", 9, "2021-02-02")], "nct_id string, version int, date string")
    am = am.withColumn("modules_changed", F.array(F.lit(facts.OUTCOME_MODULE)))
    got = {r.question_id: r.gold_answer for r in questions.t4_questions(t, o, am).collect()}
    assert got["a:changed_when_what:0"] == "Yes, the primary outcome was changed, from 'OS' to 'PFS', at version 5 (2019-05-01)."
    assert "b:changed_when_what:0" not in got and "d:changed_when_what:0" not in got  # no first, no current outcome
    assert got["c:changed_when_what:0"] == "No, the primary outcome was not changed after first posting."
    assert got["e:changed_when_what:0"] == "Yes, the primary outcome was changed across 2 revisions (most recently at version 9, 2021-02-02). It now reads: 'X'."
    assert got["a:first_registered:0"] == "OS" and got["d:revision_count:0"] == "1"


def test_phase_without_a_number_and_refusals(spark):
    t = spark.createDataFrame([("n1", "NA", 3, "s"), ("n2", "PHASE1|PHASE2", None, "")], "nct_id string, phase string, enrollment_count int, sponsor_name string")
    none = lambda cols: spark.createDataFrame([], cols)
    q = questions.t1_questions(t, none("nct_id string, source string, type string, measure string, time_frame string, outcome_id long"), none("nct_id string, arm_id long, label string"), none("nct_id string, minimum_age string, maximum_age string"))
    assert {r.question_id: (r.question_text, r.gold_answer) for r in q.collect()} == {
        "n1:phase:0": ("What phase is the n1 trial?", "N/A"), "n1:enrollment_count:0": ("What is the target enrollment for n1?", "3"), "n1:sponsor:0": ("Who is the sponsor of n1?", "s"),
    }
    adv = questions.adversarial_questions(t, spark.createDataFrame([("n1", "sap")], "nct_id string, doc_type string"), 4).collect()
    assert sorted((r.category, r.nct_id) for r in adv) == [("fact_not_in_corpus", "n1"), ("fact_not_in_corpus", "n2"), ("unposted_document", "n2")]
    assert all(r.expected_behavior == "refuse" and r.nct_id in r.question_text for r in adv)


def test_embedding_cache(spark):
    c = chunk_rows(spark).drop("embedding")
    first = embedding.embedded(c, None, models.hash_embedding, "r1")
    again = embedding.embedded(c.withColumn("text", F.when(F.col("chunk_index") == 1, "changed").otherwise(F.col("text"))), first, models.hash_embedding, "r1")
    assert sorted(r.from_cache for r in again.collect()) == [False, True, True]
    paged = c.withColumn("page_start", F.lit(1)).withColumn("page_end", F.lit(2))
    table, counts = embedding.loaded(None, paged, first.where("chunk_id LIKE '%:0'"), spark.createDataFrame([("NCT00000001",)], "nct_id string"))
    assert table.count() == 2 and tuple(counts.first()) == (2, 1, 1)
    good, bad = embedding.valid_chunks(paged.withColumn("chunk_type", F.lit("text")).withColumn("text", F.when(F.col("chunk_index") == 1, " ").otherwise(F.col("text"))))
    assert good.count() == 2 and bad.first()["error"] == "empty text"

    class Fixed:
        def encode(self, texts):
            return [[float(len(t))] for t in texts]

    assert c.select(models.embed_with(Fixed)(F.col("text")).alias("e")).first()["e"]


def test_answer_and_trace(spark, tmp_path):
    c = chunk_rows(spark)
    index = retrieval.token_table(c, "chunk_id", "text")
    store = TraceStore(spark, str(tmp_path / "trace"))
    assert store.find_generation("d", "h") is None
    events = list(answering.answer(spark, c, index, "What is the sample size of patients?", "NCT00000001", store))
    assert events[-1]["type"] == "done" and events[-1]["cited_chunk_ids"] == ["NCT00000001:protocol:1"]
    assert store.table("retrieval_step").count() == 5 and store.table("chunk_hit").agg(F.min("rank")).first()[0] == 0
    id_ = store.log_generation(1, "d", "h", "x", 1.0, 3, 5, False)
    assert store.find_generation("d", "h")["generation_id"] == id_ and store.usage().where("model_digest = 'd'").first()["tokens_in"] == 5
    assert answering.sse({"a": 1}) == 'data: {"a": 1}\n\n' and answering.healthy(spark)
    refused = list(answering.answer(spark, c, index, "zzz qqq", "NCT00000002"))
    assert refused[-1]["is_refusal"]


def test_ablation(spark):
    c = chunk_rows(spark)
    q = spark.createDataFrame([(0, "overall survival", "NCT00000001"), (1, "arm drug", "NCT00000002")], "query_id int, query_text string, nct_id string").withColumn("query_vector", models.hash_embedding(F.col("query_text")))
    gold = spark.createDataFrame([(0, "NCT00000001:protocol:0"), (1, "NCT00000002:protocol:0")], "query_id int, chunk_id string")
    got = {r.rung: r for r in ablation.run(c, retrieval.token_table(c, "chunk_id", "text"), q, gold).collect()}
    assert set(got) == set(ablation.RUNGS) and got["reranked"].mrr == 1.0 and got["lexical"].recall_1 == 1.0
    assert "| reranked |" in reports.md_table(["rung"], [["reranked"]])


def test_json_lines_and_manifest(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    good, bad = files.json_lines(spark, str(p), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["not json"]
    m = files.manifest(spark, str(p)).first()
    import hashlib

    assert m.sha256 == hashlib.sha256(p.read_bytes()).hexdigest() and m.bytes == p.stat().st_size


def test_registry_client():
    from urllib.error import HTTPError, URLError

    calls = []

    def fetch(url, params=None):
        calls.append((url, params))
        if "history" in url:
            raise HTTPError(url, 404, "gone", None, None)
        if len(calls) == 1:
            raise URLError("down")
        return {"studies": [{"n": len(calls)}], **({"nextPageToken": "t"} if not params.get("pageToken") else {})}

    slept = []
    c = RegistryClient("http://r/", fetch=fetch, spacing_s=0, retries=1, sleep=slept.append)
    assert [s["n"] for s in c.search(query="x")] == [2, 3] and calls[2][1]["pageToken"] == "t" and len(slept) == 1
    with pytest.raises(HistoryUnavailable):
        c.history("NCT1")


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda i, t: json.dumps({"step_id": i, "query_id": 1, "stage": "dense", "latency_ms": 2.0 * i, "filters_applied": "none", "created_at": t})
    (tmp_path / "in" / "a.json").write_text(line(1, "2024-01-01T00:00:00Z") + "\n" + line(1, "2024-01-01T00:00:00Z") + "\n" + line(2, "2024-01-01T00:01:00Z"))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    stream.ingest(*args).awaitTermination(60)
    (tmp_path / "in" / "b.json").write_text(line(3, "2024-01-01T00:02:00Z"))
    stream.ingest(*args).awaitTermination(60)
    steps = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.step_id for r in steps.collect()) == [1, 2, 3]
    w = stream.latency_windows(steps).first()
    assert (w.n, w.max_ms) == (3, 6.0)


def test_schema_strings(spark):
    assert spark.createDataFrame([], CHUNKS).columns[0] == "chunk_id"
