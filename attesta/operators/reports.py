"""Reports: small aggregates, rendered as Markdown on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .relational import histogram

BUCKET_PAGES = 50


def md_table(headers: Sequence[str], rows: Sequence[Sequence]) -> str:
    cell = lambda v: "n/a" if v is None else str(v).replace("|", r"\|").replace("\n", " ")
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in [headers, ["---"] * len(headers), *rows])


def as_md(df: DataFrame, most: int = 1000) -> str:
    """A small frame as a table; reports are aggregates, and one with more than ``most`` rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return md_table(df.columns, [tuple(r) for r in rows])


def page_distribution(documents: DataFrame) -> DataFrame:
    """Least, median, mean (one decimal) and greatest number of pages; zeros without documents."""
    return documents.agg(F.min("pages").alias("min"), F.median("pages").alias("median"), F.bround(F.avg("pages"), 1).alias("mean"), F.max("pages").alias("max")).na.fill(0)


def corpus_report(documents: DataFrame, cohort: DataFrame) -> str:
    """Corpus report over ``classify_documents`` rows with ``doc_type``."""
    pct = documents.agg(F.bround(100.0 * F.sum("scanned") / F.nullif(F.sum("pages"), F.lit(0)), 2).alias("p")).withColumn("bracket", T.gate_bracket(F.coalesce("p", F.lit(0.0)))).first()
    return "\n\n".join([
        "# Corpus", f"{cohort.count()} trials, {documents.count()} documents; {pct['p']} % of pages scanned (bracket {pct['bracket']}).",
        "## Pages", as_md(page_distribution(documents)), "## Histogram", as_md(histogram(documents, "pages", BUCKET_PAGES).orderBy("bucket")),
        "## Documents by type", as_md(documents.groupBy("doc_type").agg(F.count(F.lit(1)).alias("documents")).orderBy("doc_type")),
    ])


def detection_by_sponsor_class(sections: DataFrame, sponsors: DataFrame) -> DataFrame:
    """Documents with a named section per sponsor class; trials without a sponsor count as UNKNOWN."""
    per = sections.groupBy("doc", "nct_id").agg(F.bool_or(F.col("label") != T.UNCLASSIFIED).alias("named"))
    j = per.join(sponsors.select("nct_id", "sponsor_class"), "nct_id", "left").na.fill("UNKNOWN", ["sponsor_class"])
    return j.groupBy("sponsor_class").agg(F.count(F.lit(1)).alias("documents"), F.count_if("named").alias("detected"), F.bround(100.0 * F.count_if("named") / F.count(F.lit(1)), 1).alias("rate"))


def depth_split(sections: DataFrame) -> DataFrame:
    """Documents where no, every, or some section has a name."""
    named = F.col("label") != T.UNCLASSIFIED
    per = sections.groupBy("doc").agg(F.when(~F.bool_or(named), "zero").when(F.bool_and(named), "full").otherwise("partial").alias("depth"))
    n = F.col("documents")
    return per.groupBy("depth").agg(F.count(F.lit(1)).alias("documents")).withColumn("pct", F.bround(100.0 * n / F.sum("documents").over(Window.partitionBy()), 1))


def table_stats(raw: DataFrame, logical: DataFrame) -> DataFrame:
    """Raw tables, logical ones, and how many the reassembly took away."""
    return raw.agg(F.count(F.lit(1)).alias("raw")).join(logical.agg(F.count(F.lit(1)).alias("logical")), F.lit(True)).withColumn("collapsed", F.col("raw") - F.col("logical"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks: count, mean and median per document, count per type, from OCR. Documents first, then all."""
    per = chunks.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("chunk_type") == t).alias(t) for t in ("text", "table", "assessment_schedule")], F.count_if("is_ocr").alias("ocr"))
    return per.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chunks"), F.bround(F.avg("n"), 1).alias("mean"), F.median("n").alias("median"), *[F.sum(c).alias(c) for c in ("text", "table", "assessment_schedule", "ocr")])


def ocr_backlog(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("nct_id", "doc_type").alias("documents"))


def naive_and_aware(naive: DataFrame, aware: DataFrame, doc: str, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Naive chunks that overlap a page range, and aware ones that have just this range."""
    return (
        naive.where((F.col("doc") == doc) & (F.col("page_start") <= end) & (F.col("page_end") >= start)),
        aware.where((F.col("doc") == doc) & (F.col("page_start") == start) & (F.col("page_end") == end)),
    )


def ingestion_report(sections: DataFrame, sponsors: DataFrame, raw_tables: DataFrame, tables: DataFrame, chunks: DataFrame, backlog: DataFrame) -> str:
    return "\n\n".join([
        "# Ingestion", "## Sections by sponsor class", as_md(detection_by_sponsor_class(sections, sponsors).orderBy("sponsor_class")), "## Depth", as_md(depth_split(sections).orderBy("depth")),
        "## Tables", as_md(table_stats(raw_tables, tables)), "## Chunks", as_md(chunk_stats(chunks)), "## OCR backlog", as_md(ocr_backlog(backlog)),
    ])


def discrepancy_report(scores: DataFrame, trials: int) -> str:
    """Scores of ``score_discrepancies``: counts over their denominators, rates to three decimals with their intervals, and what was not scored."""
    of = lambda c, n: F.concat_ws("/", F.col(c).cast("string"), n.cast("string"))
    shown = scores.select("pair", of("tp", F.col("tp") + F.col("fp")).alias("precise"), of("tp", F.col("tp") + F.col("fn")).alias("found"), "tp", "fp", "fn", "tn", "ambiguous", "retrieval_failed", "not_applicable", *[F.coalesce(F.format_number(c, 3), F.lit("n/a")).alias(c) for c in ("precision", "precision_low", "precision_high", "recall", "recall_low", "recall_high", "f1")])
    return f"# Discrepancies\n\n{trials} trials with gold labels. Differences are candidates for review.\n\n" + as_md(shown.orderBy("pair"))


def ablation_report(scores: DataFrame, latency: DataFrame) -> str:
    return "# Ablation\n\n" + as_md(scores) + "\n\n## Latency (ms)\n\n" + as_md(latency)


def refusal_report(scores: DataFrame, by_category: DataFrame | None = None) -> str:
    """Rates of ``metrics.refusal_metrics`` in percent, and of each category ``(category, refused, total)``."""
    r = scores.first()
    shown = lambda v: "n/a" if v is None else f"{v:.1%}"
    lines = ["# Refusals", f"Refusal accuracy {shown(r['refusal_accuracy'])} (n={r['n_adversarial']}); over-refusal {shown(r['over_refusal_rate'])} (n={r['n_answerable']})."]
    return "\n\n".join(lines + ([as_md(by_category.orderBy("category"))] if by_category is not None else []))


def comparison_report(naive: DataFrame, aware: DataFrame, doc: str, start: int, end: int, most: int = 400) -> str:
    """What naive windows and section-aware chunks make of one page range, side by side."""
    a, b = naive_and_aware(naive, aware, doc, start, end)
    part = lambda df, keys: as_md(df.select(*keys, T.snippet(F.col("text"), most).alias("text")).orderBy(*keys))
    return "\n\n".join(["# Chunking", f"{doc}, pages {start} to {end}.", "## Naive windows", part(a, ["chunk_index", "page_start", "page_end"]), "## Section-aware chunks", part(b, ["chunk_index", "chunk_type", "section"])])
