"""Jobs over a folder of tables, and the command line that runs them: ``python -m attesta.jobs <job> --base <folder> ...``.

A job reads the tables it needs from ``<base>/<name>`` and writes its own there, whole; running one again gives the same
tables. Models are stand-ins unless a job is called with others.
"""

from __future__ import annotations

import argparse
import json
import os
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .functions import models
from .operators import chunking, cohort, documents, embedding, facts, metrics, questions, reports, retrieval
from .operators.trace import TraceStore
from .plans import ablation, answering, generation, normalization, service
from .sources import files
from .sources.registry import RETRIES, SPACING_S, Downloader, RegistryClient

JOBS: dict[str, Callable] = {}


def job(f):
    JOBS[f.__name__] = f
    return f


class Base:
    """The folder of tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def has(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Writes beside the old table and puts the new one in its place, so a job may read what it replaces."""
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        new, old = fs_path(f"{self.path}/_new-{name}"), fs_path(f"{self.path}/{name}")
        df.write.mode("overwrite").parquet(str(new))
        fs = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(new, old)
        return self.read(name)

    def lines(self, name: str, df: DataFrame) -> None:
        files.write_json_lines(df, f"{self.path}/{name}.jsonl")

    def report(self, name: str, text: str) -> str:
        """A report is a few kilobytes and goes out as one file."""
        rows = self.spark.createDataFrame([(text,)], "text string").coalesce(1)
        rows.write.mode("overwrite").text(f"{self.path}/{name}.md")
        return text

    @property
    def trace(self) -> TraceStore:
        return TraceStore(self.spark, f"{self.path}/trace")


@job
def select_cohort(base: Base, archive: str, target: int = cohort.TARGET) -> dict:
    """Chooses trials among an archive's records; writes ``cohort`` and returns its manifest."""
    chosen = base.write("cohort", cohort.select_cohort(cohort.candidates(files.current_records(base.spark, archive)), target))
    return cohort.manifest(chosen)


@job
def snapshot(base: Base, archive: str, url: str, internal: str | None = None, client: RegistryClient | None = None) -> dict:
    """Fetches record, revisions and version 0 of every trial of ``cohort`` that the local folder ``archive`` lacks; trials without a history get their record.

    Requests are spaced, so trials go one after the other, on the driver; a cohort has some hundreds.
    """
    client = client or RegistryClient(url, internal)
    done = {"fetched": 0, "present": 0, "without_history": 0}
    for nct_id in [r.nct_id for r in base.read("cohort").select("nct_id").orderBy("nct_id").collect()]:
        get = {"current.json": lambda: client.get_study(nct_id), "history.json": lambda: client.history(nct_id), "versions/0.json": lambda: client.history_version(nct_id, 0)}
        for name, fetch in get.items():
            path = os.path.join(archive, nct_id, name)
            if os.path.exists(path):
                done["present"] += 1
                continue
            try:
                data = fetch()
            except RuntimeError:
                done["without_history"] += 1
                continue
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path + ".part", "w", encoding="utf-8") as f:
                json.dump(data, f)
            os.replace(path + ".part", path)
            done["fetched"] += 1
    return done


@job
def load_facts(base: Base, archive: str) -> dict:
    """Loads an archive's records as ``trials, outcomes, arms, eligibility, amendments``; what loaded trials had is replaced as a whole."""
    current, first = files.current_records(base.spark, archive), files.version_records(base.spark, archive)
    tables = {
        "trials": facts.trials(current), "outcomes": facts.outcomes(current, first), "arms": facts.arms(current), "eligibility": facts.eligibility(current),
        "amendments": facts.amendments(files.histories(base.spark, archive)),
    }
    return {name: base.write(name, facts.load(base.read(name) if base.has(name) else None, df, ["nct_id"])).count() for name, df in tables.items()}


def spaced(ask: Callable, spacing_s: float = SPACING_S, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``ask`` with a least time between calls, tried again after longer and longer pauses where the network fails."""
    last = [0.0]

    def run(*args):
        for attempt in range(retries + 1):
            wait = spacing_s - (time.monotonic() - last[0])
            if wait > 0:
                sleep(wait)
            last[0] = time.monotonic()
            try:
                return ask(*args)
            except (HTTPError, URLError, TimeoutError, ConnectionError):
                if attempt == retries:
                    raise
                sleep(2**attempt)

    return run


def _head(url: str) -> int | None:
    with urlopen(Request(url, method="HEAD"), timeout=30) as r:
        size = r.headers.get("Content-Length")
        return int(size) if size else None


def _body(url: str) -> Iterator[bytes]:
    with urlopen(url, timeout=60) as r:
        while data := r.read(1 << 16):
            yield data


@job
def download(base: Base, archive: str, url: str, dest: str, head: Callable = _head, chunks: Callable = _body, spacing: float = SPACING_S) -> dict:
    """Downloads the documents of ``cohort`` to the local folder ``dest``; writes ``downloads`` and ``download_errors``. A document that fails doesn't stop the others."""
    docs = facts.attached_documents(files.current_records(base.spark, archive).where(facts.nct_id().isNotNull()), url)
    rows = docs.join(base.read("cohort").select("nct_id"), "nct_id", "left_semi").orderBy("name").collect()  # those of a cohort
    loader = Downloader(spaced(head, spacing), chunks)
    found, failed = [], []
    for r in rows:
        try:
            got = spaced(loader.fetch, 0.0)(r["url"], os.path.join(dest, r["nct_id"], f"{r['name']}.pdf"))
            found.append((r["nct_id"], r["doc_type"], r["filename"], got["url"], got["path"], got["bytes"], got["sha256"], got["status"]))
        except Exception as e:
            failed.append((r["nct_id"], r["url"], f"{type(e).__name__}: {e}"))
    base.write("downloads", base.spark.createDataFrame(found, "nct_id string, doc_type string, filename string, url string, path string, bytes long, sha256 string, status string"))
    base.write("download_errors", base.spark.createDataFrame(failed, "nct_id string, url string, error string"))
    return {"documents": len(found), "failed": len(failed)}


@job
def extract_pages(base: Base, pattern: str, extract: Callable[[bytes], list[dict]]) -> dict:
    """Blocks of the files that match ``pattern``, by ``extract(content)``, which gives dicts ``page, pos, text, font_size, bold, page_height, top, bottom, needs_ocr``.

    The reader of the files' format is the caller's; it runs in the workers, a file at a time. Writes ``blocks`` and ``extract_errors``.
    """
    schema = "doc string, page int, pos int, text string, font_size double, bold boolean, page_height double, top double, bottom double, needs_ocr boolean, error string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for doc, content in zip(batch.column("doc").to_pylist(), batch.column("content").to_pylist()):
                try:
                    found = [{**b, "doc": doc} for b in extract(content)]
                except Exception as e:
                    found = [{"doc": doc, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    raw = base.spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("doc"), "content")
    rows = base.write("extracted", raw.mapInArrow(run, schema))
    base.write("extract_errors", rows.where("error is not null").select("doc", "error"))
    return {"blocks": base.write("blocks", rows.where("error is null").drop("error")).count()}


def _typed(blocks: DataFrame) -> DataFrame:
    """Trial and kind of document from names such as ``NCT01234567_sap_2``, unless the table has them."""
    have = set(blocks.columns)
    name = F.split("doc", "_")
    return blocks.withColumn("nct_id", F.col("nct_id") if "nct_id" in have else name[0]).withColumn("doc_type", F.col("doc_type") if "doc_type" in have else F.get(name, F.lit(1)))


@job
def segment(base: Base) -> dict:
    """Writes ``sections``, ``versions`` and ``detection_failures`` of ``blocks``, with bookmarks where there are any."""
    blocks = _typed(base.read("blocks"))
    found = base.write("sections", documents.sections(blocks, base.read("bookmarks") if base.has("bookmarks") else None))
    base.write("versions", documents.version_timeline(documents.page_markers(blocks)))
    named = found.join(blocks.select("doc", "nct_id").distinct(), "doc")
    base.write("detection_failures", documents.detection_failures(named, base.read("trials")))
    return documents.detection(found).first().asDict()


@job
def reassemble(base: Base) -> dict:
    """Writes ``logical_tables`` of ``tables``: captions, headers and sections completed, continued tables put together."""
    raw = base.read("tables")
    t = documents.captions(raw, base.read("blocks")) if "top" in raw.columns else raw
    t = documents.source_sections(documents.propagate_headers(t).drop("source_section"), base.read("sections"))
    return reports.table_stats(raw, base.write("logical_tables", documents.reassembled(t))).first().asDict()


@job
def chunk(base: Base) -> dict:
    """Writes ``chunks`` with ids and pages, and ``naive_chunks``, of blocks, sections, tables and versions."""
    blocks = _typed(base.read("blocks"))
    if base.has("logical_tables"):
        tables = base.read("logical_tables").withColumn("n_cols", F.size("headers")).select("doc", F.col("logical_pos").alias("table_pos"), "caption", "headers", "rows", "n_cols", F.col("page_start").alias("range_start"), F.col("page_end").alias("range_end"))
    else:
        tables = base.spark.createDataFrame([], "doc string, table_pos int, caption string, headers array<struct<text:string,unit:string>>, rows array<array<struct<col:int,text:string>>>, n_cols int, range_start int, range_end int")
    rows = chunking.chunk_documents(blocks, base.read("sections"), tables, base.read("versions"))
    meta = blocks.groupBy("doc").agg(F.min("nct_id").alias("nct_id"), F.min("doc_type").alias("doc_type"))
    rows = rows.join(meta, "doc").withColumn("chunk_id", embedding.chunk_id(F.col("nct_id"), F.col("doc"), F.col("chunk_index"))).withColumn("doc_version", F.col("version"))
    whole = blocks.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    base.write("naive_chunks", chunking.naive_chunks(whole, "doc", "text"))
    return reports.chunk_stats(base.write("chunks", rows)).first().asDict()


@job
def embed(base: Base, model: Callable = models.hash_embedding, revision: str = "stand-in") -> dict:
    """Writes ``embeddings`` of ``chunks``, reusing those whose text is as it was, and the loaded ``chunk_table``; chunks that don't hold to the schema go to ``chunk_errors``."""
    good, bad = embedding.valid_chunks(base.read("chunks"))
    base.write("chunk_errors", bad)
    old = base.read("embeddings") if base.has("embeddings") else None
    found = base.write("embeddings", embedding.embedded(good, old, model, revision))
    table, counts = embedding.loaded(None, good, found, base.read("trials"))
    base.write("chunk_table", table)
    return counts.first().asDict() | found.agg(F.count(F.lit(1)).alias("embedded"), F.count_if("from_cache").alias("from_cache")).first().asDict()


@job
def build_questions(base: Base, target: int = 200, seed: int = 0) -> dict:
    """Writes the question sets T1, T3, T4 and those to be refused as tables and JSON lines; T1 questions without usable gold chunks go to ``t1_unlocatable``."""
    trials, outcomes, chunks = base.read("trials"), base.read("outcomes"), base.read("chunk_table")
    ok, lost = questions.usable(questions.locate_gold(questions.t1_questions(trials, outcomes, base.read("arms"), base.read("eligibility")), chunks))
    base.write("t1_unlocatable", lost)
    sets = {"t1": questions.capped(ok, "template", list(questions.T1_TEXTS), target, seed), "t4": questions.capped(questions.t4_questions(trials, outcomes, base.read("amendments")), "template", list(questions.T4_TEXTS), 40, seed), "adversarial": questions.adversarial_questions(trials, chunks, 30, seed)}
    t3 = questions.t3_questions(trials, outcomes)
    if base.has("discrepancies"):
        picked = questions.select_stratified(questions.strata(base.read("discrepancies").where("state <> 'not_applicable'")), trials.select("nct_id"), seed=seed)
        t3 = t3.join(picked.select("nct_id"), "nct_id", "left_semi")
    sets["t3"] = questions.capped(t3, "pair", list(questions.T3_TEXTS), 60, seed)
    counts = {}
    for name, df in sets.items():
        rows = base.write(name, df)
        base.lines(name, rows)
        counts[name] = rows.count()
    return counts


@job
def detect(base: Base, judge: Callable[[DataFrame], DataFrame] = models.rule_judge) -> dict:
    """Writes ``discrepancies``: a verdict for every pair of sources of every trial."""
    found = base.write("discrepancies", answering.discrepancies(base.read("trials"), base.read("outcomes"), base.read("chunk_table"), judge))
    return {r["state"]: r["count"] for r in found.groupBy("state").count().collect()}


@job
def worksheet(base: Base) -> dict:
    """Writes ``worksheet``: what a reader needs to judge every T3 question."""
    return {"rows": base.write("worksheet", questions.worksheet(base.read("t3"), base.read("outcomes"), base.read("chunk_table"))).count()}


@job
def export_gold(base: Base, filled: str) -> dict:
    """Reads a filled worksheet (JSON lines with nct_id, pair, verdict, minutes) and writes ``gold`` and its JSON lines."""
    rows, dead = files.json_lines(base.spark, filled, "nct_id string, pair string, verdict string, justification string, minutes double")
    labelled, sums = questions.gold_labels(rows)
    gold = base.write("gold", labelled.select("nct_id", "pair", "verdict", "justification"))
    base.lines("gold", gold)
    return sums.first().asDict() | {"unreadable": dead.count()}


@job
def score_detector(base: Base) -> str:
    """Scores ``discrepancies`` against ``gold`` and writes the report."""
    found = base.read("discrepancies").where("state <> 'not_applicable'").withColumn("position", F.lit(0))
    gold = base.read("gold")
    return base.report("discrepancy_eval", reports.discrepancy_report(metrics.score_discrepancies(gold, found), gold.select("nct_id").distinct().count()))


def _asked(base: Base, name: str, embed_: Callable) -> DataFrame:
    rows = base.read(name)
    text = "question_text"
    ids = F.abs(F.xxhash64("question_id"))
    return rows.select(ids.alias("query_id"), "nct_id", F.col(text).alias("query_text"), *[F.col(c) for c in ("gold_answer", "gold_chunk_ids") if c in rows.columns]).withColumn("query_vector", embed_(F.col("query_text")))


@job
def ablate(base: Base, embed_: Callable = models.hash_embedding) -> str:
    """Runs every rung of the ladder on T1 with its stages in the trace and writes the report."""
    chunks = base.read("chunk_table").where("embedding is not null")
    q = _asked(base, "t1", embed_)
    gold = q.select("query_id", F.explode("gold_chunk_ids").alias("chunk_id"))
    index = base.write("index", retrieval.token_table(chunks, "chunk_id", "text", terms=retrieval.query_terms(q)))
    scores, latency = ablation.run_traced(chunks, index, q, gold, base.trace)
    return base.report("ablation", reports.ablation_report(scores, latency))


@job
def refusals(base: Base, embed_: Callable = models.hash_embedding, generate: generation.Generator | None = None) -> str:
    """Answers the questions that have to be refused and as many that can be answered, and writes the report."""
    chunks = base.read("chunk_table").where("embedding is not null")
    generate = generate or generation.column_generator(models.prompted())
    said = {}
    for name in ("adversarial", "t1"):
        q = _asked(base, name, embed_)
        index = retrieval.token_table(chunks, "chunk_id", "text", terms=retrieval.query_terms(q))
        fused = retrieval.hybrid_search(chunks, index, q, retrieval.CANDIDATES, match="nct_id")
        best = retrieval.rerank(retrieval.fetch(chunks, fused), q, models.overlap_score)
        said[name] = generation.generate_answers(q, answering.excerpts(best), base.trace, answering.DIGEST, generate).withColumn("nct", F.lit(name))
    scores = metrics.refusal_metrics(said["adversarial"], said["t1"])
    named = base.read("adversarial").select(F.abs(F.xxhash64("question_id")).alias("query_id"), "category").join(said["adversarial"], "query_id")
    return base.report("refusal_eval", reports.refusal_report(scores, named.groupBy("category").agg(F.count_if("is_refusal").alias("refused"), F.count(F.lit(1)).alias("total"))))


@job
def normalize(base: Base, judge: Callable[[DataFrame], DataFrame] = models.rule_judge) -> str:
    """Grades the labelled phrase pairs and all trials' first and current outcomes, and writes the report."""
    graded = base.write("phrase_pairs", normalization.graded(normalization.phrase_pairs(base.spark), judge))
    return base.report("normalization", normalization.normalization_report(graded, normalization.corpus_check(base.read("outcomes"), judge)))


@job
def report(base: Base) -> str:
    """Writes the ingestion report over sections, tables and chunks."""
    blocks = _typed(base.read("blocks"))
    meta = blocks.select("doc", "nct_id").distinct()
    tables = base.read("tables") if base.has("tables") else base.spark.createDataFrame([], "doc string")
    logical = base.read("logical_tables") if base.has("logical_tables") else tables
    backlog = documents.pages_needing_ocr(blocks.select("nct_id", "doc_type", "doc", "page", "needs_ocr").distinct())
    return base.report("ingestion", reports.ingestion_report(base.read("sections").join(meta, "doc"), base.read("trials"), tables, logical, base.read("chunks"), backlog))


@job
def serve(base: Base, host: str = "127.0.0.1", port: int = 8000) -> None:
    """Serves answers and discrepancy reports until stopped."""
    chunks = base.read("chunk_table").where("embedding is not null")
    index = base.write("index", retrieval.token_table(chunks, "chunk_id", "text"))
    service.serve(service.Tables(base.spark, base.read("trials"), base.read("outcomes"), chunks, index, base.trace), host, int(port)).serve_forever()


def main(argv: list[str] | None = None) -> int:
    """``<job> --base <folder>`` and the job's own options as ``--name value``; prints what the job returns."""
    parser = argparse.ArgumentParser(prog="attesta", description=main.__doc__)
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--base", required=True)
    known, rest = parser.parse_known_args(argv)
    if len(rest) % 2 or not all(k.startswith("--") for k in rest[::2]):
        parser.error("options come as --name value")
    options = {k[2:].replace("-", "_"): int(v) if v.isdigit() else v for k, v in zip(rest[::2], rest[1::2])}
    spark = SparkSession.builder.appName(f"attesta {known.job}").getOrCreate()
    out = JOBS[known.job](Base(spark, known.base), **options)
    print(out if isinstance(out, str) else json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
