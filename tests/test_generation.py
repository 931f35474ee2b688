"""Cached generation, judges, traced retrieval, normalization, jobs and the service."""

import json
import random
import threading
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_plans import archive, chunk_rows, record  # noqa: F401

from attesta import jobs
from attesta.functions import models
from attesta.operators import chunking, cohort, compare, reports, retrieval
from attesta.operators.trace import TraceStore
from attesta.plans import ablation, answering, generation, normalization, service
from attesta.sources.registry import HistoryUnavailable


def says(mapping, otherwise="?"):
    """A generator that answers a prompt by the first key that it holds."""
    def respond(prompt):
        out = F.lit(otherwise)
        for k, v in reversed(mapping.items()):
            out = F.when(F.contains(prompt, F.lit(k)), v).otherwise(out)
        return out

    return generation.column_generator(respond)


@pytest.fixture
def store(spark, tmp_path):
    return TraceStore(spark, str(tmp_path / "trace"))


def test_cache(spark, store):
    p = spark.createDataFrame([(1, "ask a", "x"), (2, "ask b", "y"), (3, "ask a", "z"), (4, None, "w")], "query_id long, prompt string, more string")
    first = {r.query_id: r for r in generation.cached_generate(p, store, "m1", says({"ask a": "A", "ask b": "B"})).collect()}
    assert {i: (r.response_text, r.from_cache, r.more) for i, r in first.items()} == {1: ("A", False, "x"), 2: ("B", False, "y"), 3: ("A", True, "z"), 4: ("?", False, "w")}
    again = {r.query_id: r for r in generation.cached_generate(p, store, "m1", says({}, "never asked")).collect()}
    assert all(r.from_cache and r.response_text == first[i].response_text for i, r in again.items())
    other = generation.cached_generate(p.where("query_id = 1"), store, "m2", says({}, "another model")).first()
    assert other.response_text == "another model" and not other.from_cache
    assert store.table("generation").count() == 9 and store.table("generation").select("generation_id").distinct().count() == 9
    assert store.table("cost_record").where("from_cache").agg(F.sum("wall_clock_ms")).first()[0] == 0
    assert store.usage().where("model_digest = 'm1'").first()["tokens_in"] == 4  # two asks of two words; an empty prompt has none
    assert store.find_generation("m2", store.table("generation").where("model_digest = 'm2'").first()["prompt_hash"])["response_text"] == "another model"


def test_worker_generator(spark, store):
    class Echo:
        def generate(self, prompt):
            return {"response": prompt.upper(), "tokens_in": 2, "tokens_out": 1}

    p = spark.createDataFrame([(1, "abc"), (2, "def")], "query_id long, prompt string")
    assert sorted(r.response_text for r in generation.cached_generate(p, store, "m", generation.worker_generator(Echo)).collect()) == ["ABC", "DEF"]
    assert store.usage().first()["tokens_in"] == 4


def test_judges(spark, store):
    a = spark.createDataFrame([(1, "q one", "good {notes}", "n"), (2, "q two", "strange", "n"), (3, "q three", "silent", "n")], "query_id long, question_text string, answer string, notes string")
    judge = says({"required format": "SCORE: 0.5", "ANSWER: good {notes}": "SCORE: 1\nJUSTIFICATION: fine", "ANSWER: strange": "no idea"}, "nothing")
    got = {r.query_id: r.score for r in generation.judged_correctness(a, store, "j", judge).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.5}  # what could not be read was asked again
    f = spark.createDataFrame([(1, "two claims", ["t1", "t2"]), (2, "refusal", ["t"])], "query_id long, answer string, texts array<string>")
    split = says({"ANSWER: two claims": "- claim x\n- claim y", "ANSWER: refusal": "", "CLAIM: claim x": " yes, it is", "CLAIM: claim y": "NO"})
    assert {r.query_id: (r.claims, r.score) for r in generation.faithfulness(f, store, "j", split).collect()} == {1: (2, 0.5), 2: (0, 0.0)}
    pairs = spark.createDataFrame([(1, "OS", "os"), (2, "OS rate", "PFS"), (3, "odd", "pair")], "id int, text_a string, text_b string")
    judge = generation.outcome_judge(store, "j", says({"OUTCOME A: OS rate": "VERDICT: divergence"}, "unclear"))
    got = {r.id: (r.verdict, r.method) for r in compare.compared(pairs, judge, ["id"]).collect()}
    assert got == {1: ("match", "identical_text"), 2: ("divergence", "judge"), 3: ("ambiguous", "judge")}


def test_prompts_are_read_back(spark):
    df = spark.createDataFrame([("What [1] is it?", ["first\n\ntext", "second {question}"]), ("none", [])], "q string, t array<string>")
    seen = models.prompted(lambda q, t: F.concat_ws("#", q, F.array_join(t, "|")))
    got = [r[0] for r in df.select(seen(generation.answer_prompt(F.col("q"), F.col("t")))).collect()]
    assert got == ["What [1] is it?#first\n\ntext|second {question}", "none#"]


def test_traced_answers_and_stages(spark, store):
    c = chunk_rows(spark)
    index = retrieval.token_table(c, "chunk_id", "text")
    events = list(answering.answer(spark, c, index, "What is the sample size of patients?", "NCT00000001", store))
    assert events[-1]["cited_chunk_ids"] == ["NCT00000001:protocol:1"] and not events[-1]["from_cache"] and len(events) > 2
    assert {r.stage for r in store.table("retrieval_step").collect()} == {"prefilter", "dense", "bm25", "rrf", "rerank"}
    again = list(answering.answer(spark, c, index, "What is the sample size of patients?", "NCT00000001", store))
    assert len(again) == 2 and again[-1]["from_cache"] and again[0]["text"] == again[-1]["response_text"]
    hits = store.table("chunk_hit").join(store.table("retrieval_step"), "step_id")
    assert hits.where("stage = 'rerank'").agg(F.min("rank")).first()[0] == 0 and hits.where("stage = 'prefilter'").count() == 0
    o = spark.createDataFrame([("NCT00000001", "registered_first", "PRIMARY", "OS", None, 1), ("NCT00000001", "registered_current", "PRIMARY", "PFS", None, 2)], "nct_id string, source string, type string, measure string, time_frame string, outcome_id long")
    ranked = answering.source_excerpts(spark, "NCT00000001", c.where("chunk_index = 0").select(F.lit(5).alias("query_id"), "chunk_id", F.lit(1).alias("rank"), "text"), o, 5)
    assert [(r.rank, r.chunk_id) for r in ranked.where("text in ('OS', 'PFS')").orderBy("rank").collect()] == [(2, "NCT00000001:registered_first"), (3, "NCT00000001:registered_current")]
    t3 = list(answering.answer(spark, c, index, "overall survival", "NCT00000001", store, tier="T3", outcomes=o))
    assert t3[-1]["type"] == "done"


def test_traced_ablation(spark, store):
    c = chunk_rows(spark)
    q = spark.createDataFrame([(0, "overall survival", "NCT00000001", "24 months", None), (1, "arm drug", "NCT00000002", None, "drug")], "query_id long, query_text string, nct_id string, gold_answer string, notes string").withColumn("query_vector", models.hash_embedding(F.col("query_text")))
    gold = spark.createDataFrame([(0, "NCT00000001:protocol:0"), (1, "NCT00000002:protocol:0")], "query_id long, chunk_id string")
    index = retrieval.token_table(c, "chunk_id", "text")

    def both(prompts):
        judged = F.when(F.contains("prompt", F.lit("REFERENCE NOTES")), "SCORE: 1").when(F.contains("prompt", F.lit("CLAIM: ")), "YES").when(F.contains("prompt", F.lit("atomic factual claims")), "one claim")
        return generation.column_generator(lambda p: F.coalesce(judged, models.prompted()(p)))(prompts)

    scores, latency = ablation.run_traced(c, index, q, gold, store, ("dense", "lexical", "reranked"), "m", both)
    got = {r.rung: r for r in scores.collect()}
    plain = {r.rung: r for r in ablation.run(c, index, q.drop("gold_answer", "notes"), gold, ("dense", "lexical", "reranked")).collect()}
    assert all(got[k].mrr == plain[k].mrr and got[k].recall_1 == plain[k].recall_1 for k in plain)
    assert got["reranked"].correctness_t1 == 1.0 and got["reranked"].correctness_t2 == 1.0 and got["reranked"].faithfulness == 1.0
    stages = {(r.rung, r.stage): r.n for r in latency.collect()}
    assert stages == {("dense", "dense"): 2, ("lexical", "bm25"): 2, **{("reranked", s): 2 for s in ("prefilter", "dense", "bm25", "rrf", "rerank")}}
    assert "rerank" in reports.ablation_report(scores, latency)


def test_normalization(spark):
    p = normalization.phrase_pairs(spark)
    assert p.count() == 100 and {r.label: r["count"] for r in p.groupBy("label").count().collect()} == {"match": 40, "divergence": 35, "ambiguous": 25}
    assert p.select("pair_id").distinct().count() == 100
    g = normalization.graded(p, models.rule_judge).cache()
    assert g.where("category = 'timeframe_reword' AND verdict = 'match' AND method = 'timeframe_deterministic'").count() == 24
    o = spark.createDataFrame([("a", "registered_first", "PRIMARY", "OS", 1), ("a", "registered_current", "PRIMARY", "os", 2), ("a", "registered_current", "PRIMARY", "z", 3), ("b", "registered_current", "PRIMARY", "x", 1), ("c", "registered_first", "PRIMARY", "one two", 1), ("c", "registered_current", "PRIMARY", "three", 2)], "nct_id string, source string, type string, measure string, outcome_id long")
    check = normalization.corpus_check(o, models.rule_judge)
    assert check.first().asDict() == {"n": 2, "match": 1, "divergence": 1, "ambiguous": 0, "by_rule": 1, "divergence_share": 0.5}
    assert normalization.corpus_check(o.where("false"), models.rule_judge).first()["divergence_share"] == 0.0
    text = normalization.normalization_report(g, check)
    assert "(n=100)" in text and "| timeframe_reword | 24 | 24 |" in text


def test_service(spark, store):
    c = chunk_rows(spark)
    o = spark.createDataFrame([("NCT00000001", "registered_first", "PRIMARY", "OS", None, 1), ("NCT00000001", "registered_current", "PRIMARY", "os", None, 2)], "nct_id string, source string, type string, measure string, time_frame string, outcome_id long")
    tables = service.Tables(spark, spark.createDataFrame([("NCT00000001",)], "nct_id string"), o, c, retrieval.token_table(c, "chunk_id", "text"), store)
    server = service.serve(tables, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert json.load(urlopen(f"{base}/health")) == {"status": "ok"}
        report = json.load(urlopen(f"{base}/discrepancy/NCT00000001"))
        assert report["pairs"]["first_posted_vs_current"]["verdict"] == "match" and report["pairs"]["registry_vs_results"] is None
        for path, status in (("/discrepancy/NCT9", 404), ("/nothing", 404)):
            with pytest.raises(HTTPError) as e:
                urlopen(base + path)
            assert e.value.code == status
        with pytest.raises(HTTPError) as e:
            urlopen(Request(f"{base}/answer", data=b"{}"))
        assert e.value.code == 422
        body = urlopen(Request(f"{base}/answer", data=json.dumps({"nct_id": "NCT00000001", "question": "What is the sample size of patients?"}).encode())).read().decode()
        events = [json.loads(x.removeprefix("data: ")) for x in body.strip().split("\n\n")]
        assert events[-1]["type"] == "done" and events[-1]["cited_chunk_ids"] == ["NCT00000001:protocol:1"]
    finally:
        server.shutdown()
        server.server_close()


def test_jobs_end_to_end(spark, tmp_path, archive):  # noqa: F811
    base = jobs.Base(spark, str(tmp_path / "base"))
    assert jobs.select_cohort(base, archive, 2)["count"] == 2
    assert jobs.load_facts(base, archive)["trials"] == 3 and jobs.load_facts(base, archive)["trials"] == 3  # again: replaced, not added
    docs = [("NCT00000001_protocol", 0, 0, "Study Objectives", 14.0, True), ("NCT00000001_protocol", 0, 1, "Overall survival at 24 months is primary for 40 patients", 10.0, False), ("NCT00000001_protocol", 1, 0, "Version 2.0", 10.0, False), ("NCT00000002_protocol", 0, 0, "nothing named here", 10.0, False)]
    pages = spark.createDataFrame([(*d, 100.0, 5.0, 9.0, False) for d in docs], "doc string, page int, pos int, text string, font_size double, bold boolean, page_height double, top double, bottom double, needs_ocr boolean")
    base.write("blocks", pages)
    assert jobs.segment(base)["detected"] == 1 and base.read("detection_failures").first()["sponsor_name"] == "S"
    assert jobs.chunk(base)["documents"] == 2
    assert jobs.embed(base)["loaded"] >= 2 and jobs.embed(base)["from_cache"] >= 2
    assert sum(jobs.detect(base).values()) == 9
    counts = jobs.build_questions(base)
    assert counts["t1"] > 0 and counts["t3"] > 0 and counts["t4"] > 0 and counts["adversarial"] > 0
    assert "reranked" in jobs.ablate(base) and "Refusal accuracy" in jobs.refusals(base)
    assert "(n=100)" in jobs.normalize(base) and "## Chunks" in jobs.report(base)
    assert jobs.worksheet(base)["rows"] == counts["t3"]
    filled = tmp_path / "filled.jsonl"
    filled.write_text("\n".join(json.dumps({"nct_id": "NCT00000001", "pair": p, "verdict": "match", "minutes": 2.0}) for p in ("first_posted_vs_current", "current_vs_protocol")) + "\nbroken\n")
    assert jobs.export_gold(base, str(filled)) == {"labelled": 2, "minutes": 4.0, "trials": 1, "unreadable": 1}
    assert "pooled" in jobs.score_detector(base)
    assert len(jobs.JOBS) >= 15
    with pytest.raises(SystemExit):
        jobs.main(["no-such-job", "--base", "x"])


def test_snapshot_download_and_extraction(spark, tmp_path, archive):  # noqa: F811
    base = jobs.Base(spark, str(tmp_path / "base"))
    jobs.select_cohort(base, archive, 3)

    class Client:
        def get_study(self, nct_id):
            return record(1)

        def history(self, nct_id):
            if nct_id.endswith("3"):
                raise HistoryUnavailable("gone")
            return {"changes": []}

        def history_version(self, nct_id, version):
            return {"studyVersion": version}

    out = str(tmp_path / "snap")
    assert jobs.snapshot(base, out, "http://x", client=Client()) == {"fetched": 8, "present": 0, "without_history": 1}
    assert jobs.snapshot(base, out, "http://x", client=Client())["present"] == 8  # only what is missing is asked for

    def body(url):
        if url.endswith("b.pdf"):
            raise ValueError("no such file")
        yield b"content"

    got = jobs.download(base, archive, "http://x", str(tmp_path / "pdf"), lambda url: 7, body, spacing=0.0)
    assert got == {"documents": 6, "failed": 3} and base.read("download_errors").where("error like 'ValueError%'").count() == 3
    assert {r.status for r in base.read("downloads").collect()} == {"downloaded"}
    assert jobs.download(base, archive, "http://x", str(tmp_path / "pdf"), lambda url: 7, body, spacing=0.0)["documents"] == 6
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise URLError("later")
        return "done"

    assert jobs.spaced(flaky, 0.0, sleep=lambda s: None)() == "done" and len(calls) == 3

    def blocks(content):
        if content == b"bad":
            raise ValueError("not a document")
        return [{"page": 0, "pos": 0, "text": content.decode(), "font_size": 9.0, "bold": False, "page_height": 10.0, "top": 1.0, "bottom": 2.0, "needs_ocr": False}]

    d = tmp_path / "raw"
    d.mkdir()
    (d / "NCT1_protocol.bin").write_bytes(b"hello")
    (d / "NCT2_sap.bin").write_bytes(b"bad")
    assert jobs.extract_pages(base, f"{d}/*.bin", blocks) == {"blocks": 1}
    assert base.read("blocks").first()["doc"] == "NCT1_protocol" and base.read("extract_errors").first()["error"] == "ValueError: not a document"


def test_dense_search_is_one_path(spark, monkeypatch):
    """The result does not depend on how many matrices the queries make, nor on vectors that have no distance."""
    r = np.random.default_rng(5)
    v = [list(map(float, x)) for x in r.normal(size=(60, 6))] + [[float("nan")] * 6, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], None, [1.0, 2.0]]
    v[7] = v[3]
    items = spark.createDataFrame([(i, x, "ab"[i % 2] if i % 5 else None) for i, x in enumerate(v)], "chunk_id long, embedding array<double>, kind string")
    q = items.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"), "kind")
    fit = [i for i in range(60)]
    unit = np.array([v[i] for i in fit]) / np.linalg.norm([v[i] for i in fit], axis=1)[:, None]
    far = 1 - unit @ unit.T
    kind = [("ab"[i % 2] if i % 5 else None) for i in fit]
    for rows in (retrieval.QUERY_ROWS, 7):
        monkeypatch.setattr(retrieval, "QUERY_ROWS", rows)
        for match in (None, "kind"):
            got = {}
            for x in retrieval.dense_search(items, q, 4, match=match).orderBy("query_id", "rank").collect():
                got.setdefault(x.query_id, []).append(x.chunk_id)
            want = {i: [j for _, j in sorted((round(far[i, j], 12), j) for j in fit if match is None or kind[i] == kind[j])][:4] for i in fit}
            assert {i: x for i, x in got.items() if i < 60} == want and set(got) - set(fit) <= {64}


def test_long_documents_are_chunked_in_one_pass(spark):
    words = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([("d", words)], "id string, t string")
    got = chunking.naive_chunks(df, "id", "t", 512).orderBy("chunk_index").collect()
    assert len(got) == 59 and " ".join(r.text for r in got) == words
    costs = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda x: (x % 7).cast("long")).alias("c"))
    groups = costs.select(chunking.greedy_groups(F.col("c"), 20).alias("g")).first()["g"]
    used, group, want = 0, -1, []
    for i in range(1, 40_001):
        c = i % 7
        if group < 0 or used + c > 20:
            group, used = group + 1, 0
        used += c
        want.append(group)
    assert groups == want
    none = spark.createDataFrame([(None,)], "c array<long>")
    assert none.select(chunking.greedy_groups(F.col("c"), 20).alias("g")).first()["g"] is None


def test_cohort_equals_the_sequential_rule(spark):
    r = random.Random(9)
    rows = [(f"N{i:03}", f"sp{r.randrange(9)}", r.choice("AB"), r.choice(["P1", "P2"]), None, i) for i in range(150)]
    for target, cap in ((20, 3), (12, 1), (400, 2)):
        got = [x.nct_id for x in cohort.select_cohort(spark.createDataFrame(rows, "nct_id string, sponsor_name string, sponsor_class string, phase string, first_posted string, pos int"), target, cap, "pos").collect()]
        strata = {}
        for x in rows:
            strata.setdefault((x[2], x[3]), []).append(x)
        want, total = min(target, len(rows)), len(rows)
        quota = {k: len(v) * want // total for k, v in strata.items()}
        rest = sorted(strata, key=lambda k: (-(len(strata[k]) * want / total - quota[k]), k))
        for k in rest[: want - sum(quota.values())]:
            quota[k] += 1
        used, chosen, left = {}, [], []
        for k in sorted(strata):
            n = 0
            for x in sorted(strata[k]):
                if n < quota[k] and used.get(x[1], 0) < cap:
                    chosen.append(x[0])
                    used[x[1]] = used.get(x[1], 0) + 1
                    n += 1
                else:
                    left.append(x)
        for x in sorted(left):
            if len(chosen) < want and used.get(x[1], 0) < cap:
                chosen.append(x[0])
                used[x[1]] = used.get(x[1], 0) + 1
        assert got == sorted(chosen)
