"""Registry records as relational tables: trials, outcomes, arms, eligibility, amendments, attached documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .relational import upsert

OUTCOME_MODULE = "Outcome Measures"
_P = "protocolSection"


def _joined(array: Column) -> Column:
    """Elements joined by bars; null for none."""
    return F.nullif(F.array_join(array, "|"), F.lit(""))


def nct_id() -> Column:
    return F.col(f"{_P}.identificationModule.nctId")


def documents(records: DataFrame) -> Column:
    docs = F.col("documentSection.largeDocumentModule.largeDocs")
    return F.coalesce(docs, F.array().cast(records.select(docs.alias("d")).schema["d"].dataType))


def trials(records: DataFrame) -> DataFrame:
    """One row per current record; absent paths are null."""
    docs = documents(records)
    flag = lambda name: F.exists(docs, lambda d: F.coalesce(d[name], F.lit(False)))
    return records.select(
        nct_id().alias("nct_id"),
        F.col(f"{_P}.identificationModule.briefTitle").alias("brief_title"),
        F.col(f"{_P}.sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor_name"),
        F.col(f"{_P}.sponsorCollaboratorsModule.leadSponsor.class").alias("sponsor_class"),
        _joined(F.col(f"{_P}.designModule.phases")).alias("phase"),
        _joined(F.col(f"{_P}.conditionsModule.conditions")).alias("conditions"),
        F.col(f"{_P}.designModule.enrollmentInfo.count").alias("enrollment_count"),
        F.col(f"{_P}.statusModule.overallStatus").alias("overall_status"),
        F.col(f"{_P}.statusModule.startDateStruct.date").alias("start_date"),
        F.col(f"{_P}.statusModule.primaryCompletionDateStruct.date").alias("primary_completion_date"),
        F.col(f"{_P}.statusModule.studyFirstPostDateStruct.date").alias("first_post_date"),
        F.coalesce("hasResults", F.lit(False)).alias("has_results"),
        flag("hasProtocol").alias("has_protocol"),
        flag("hasSap").alias("has_sap"),
    )


def _registered(df: DataFrame, prefix: str, source: str, source_pos: int) -> DataFrame:
    base = f"{prefix}{_P}.outcomesModule."
    parts = []
    for kind_pos, (field, kind) in enumerate((("primaryOutcomes", "PRIMARY"), ("secondaryOutcomes", "SECONDARY"))):
        rows = df.select(F.col(f"{prefix}{_P}.identificationModule.nctId").alias("nct_id"), F.posexplode(base + field).alias("pos", "o"))
        parts.append(rows.select("nct_id", F.lit(source).alias("source"), F.lit(kind).alias("type"), F.coalesce("o.measure", F.lit("")).alias("measure"), F.col("o.timeFrame").alias("time_frame"), F.col("o.description").alias("description"), F.lit(source_pos).alias("sp"), F.lit(kind_pos).alias("kp"), "pos"))
    return parts[0].unionByName(parts[1])


def outcomes(records: DataFrame, version0: DataFrame | None = None) -> DataFrame:
    """Registered (current, then first-posted) and reported outcomes with ``outcome_id``.

    The id is the place within the trial: source, then primary before secondary, then the order of the record; it is
    the same on every load. A missing measure is an empty text, a missing type of a reported one UNKNOWN. A trial
    without version 0 has no first-posted rows.
    """
    rows = _registered(records, "", "registered_current", 0)
    if version0 is not None:
        rows = rows.unionByName(_registered(version0, "study.", "registered_first", 1))
    results = records.select(nct_id().alias("nct_id"), F.posexplode("resultsSection.outcomeMeasuresModule.outcomeMeasures").alias("pos", "o"))
    rows = rows.unionByName(results.select("nct_id", F.lit("results_reported").alias("source"), F.coalesce("o.type", F.lit("UNKNOWN")).alias("type"), F.coalesce("o.title", F.lit("")).alias("measure"), F.col("o.timeFrame").alias("time_frame"), F.col("o.description").alias("description"), F.lit(2).alias("sp"), F.lit(0).alias("kp"), "pos"))
    w = Window.partitionBy("nct_id").orderBy("sp", "kp", "pos")
    return rows.withColumn("outcome_id", F.row_number().over(w).cast("long")).drop("sp", "kp", "pos")


def arms(records: DataFrame) -> DataFrame:
    rows = records.select(nct_id().alias("nct_id"), F.posexplode(f"{_P}.armsInterventionsModule.armGroups").alias("pos", "a"))
    return rows.select("nct_id", F.col("a.label").alias("label"), F.col("a.type").alias("type"), F.col("a.description").alias("description"), (F.col("pos") + 1).cast("long").alias("arm_id"))


def eligibility(records: DataFrame) -> DataFrame:
    """One row per record that has the module."""
    e = f"{_P}.eligibilityModule"
    return records.where(F.col(e).isNotNull()).select(nct_id().alias("nct_id"), F.col(f"{e}.minimumAge").alias("minimum_age"), F.col(f"{e}.maximumAge").alias("maximum_age"), F.col(f"{e}.sex").alias("sex"), F.col(f"{e}.eligibilityCriteria").alias("criteria"))


def amendments(history: DataFrame) -> DataFrame:
    """One row per revision of ``history (nct_id, changes)``."""
    rows = history.select("nct_id", F.explode("changes").alias("c"))
    return rows.select("nct_id", F.col("c.version").alias("version"), F.col("c.date").alias("date"), F.col("c.status").alias("status"), F.coalesce("c.moduleLabels", F.array().cast("array<string>")).alias("modules_changed"))


def outcome_amendments(amendments_: DataFrame) -> DataFrame:
    """Revisions that touched the outcomes, in order of version."""
    return amendments_.where(F.array_contains("modules_changed", OUTCOME_MODULE)).orderBy("nct_id", "version")


def attached_documents(records: DataFrame, base_url: str) -> DataFrame:
    """``nct_id, doc_type, name, url, filename``: attached documents, numbered from the second one of a type on."""
    docs = records.select(nct_id().alias("nct_id"), F.posexplode(documents(records)).alias("pos", "d"))
    typed = docs.withColumn("doc_type", T.doc_type(*[F.coalesce(f"d.{c}", F.lit(False)) for c in ("hasProtocol", "hasSap", "hasIcf")]))
    n = F.row_number().over(Window.partitionBy("nct_id", "doc_type").orderBy("pos"))
    name = F.concat("nct_id", F.lit("_"), "doc_type", F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""))
    bucket = F.right(F.regexp_replace("nct_id", r"\D", ""), F.lit(2))
    return typed.withColumn("n", n).select("nct_id", "doc_type", name.alias("name"), F.concat_ws("/", F.lit(base_url.rstrip("/")), bucket, "nct_id", "d.filename").alias("url"), F.col("d.filename").alias("filename"))


def load(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """A table after loading trials: what the loaded trials had is replaced as a whole."""
    return new if old is None else upsert(old, new, keys)
