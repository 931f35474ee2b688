"""Choosing a cohort: candidates, stratified quotas and a cap per sponsor."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import documents, nct_id
from .relational import distinct_on, first_n, largest_remainder

TARGET, PER_SPONSOR = 200, 3
# The candidate query.
CANDIDATE_QUERY = {
    "query.cond": "cancer",
    "filter.overallStatus": "COMPLETED",
    "filter.advanced": "AREA[StudyFirstPostDate]RANGE[2017-01-01,MAX]",
    "aggFilters": "results:with",
    "fields": "NCTId,LeadSponsorName,LeadSponsorClass,Phase,LargeDocHasProtocol,LargeDocHasSAP,StudyFirstPostDate,OverallStatus",
}


def candidates(records: DataFrame) -> DataFrame:
    """``nct_id, sponsor_name, sponsor_class, phase, first_posted`` of records with a protocol or analysis plan."""
    has = F.exists(documents(records), lambda d: F.coalesce(d["hasProtocol"], F.lit(False)) | F.coalesce(d["hasSap"], F.lit(False)))
    sponsor, p = "protocolSection.sponsorCollaboratorsModule.leadSponsor", "protocolSection.designModule.phases"
    return records.where(has).select(
        nct_id().alias("nct_id"), F.coalesce(f"{sponsor}.name", F.lit("UNKNOWN")).alias("sponsor_name"), F.coalesce(f"{sponsor}.class", F.lit("UNKNOWN")).alias("sponsor_class"),
        F.coalesce(F.nullif(F.array_join(F.col(p), "|"), F.lit("")), F.lit("NA")).alias("phase"), F.col("protocolSection.statusModule.studyFirstPostDateStruct.date").alias("first_posted"),
    )


def select_cohort(pool: DataFrame, target: int = TARGET, per_sponsor: int = PER_SPONSOR, position: str | None = None) -> DataFrame:
    """At most ``target`` candidates, by stratum quota, at most ``per_sponsor`` of one sponsor.

    Repeated ids: the first by ``position`` (or by all columns). Quotas are largest remainders over (class, phase). The cap
    is spent in order of stratum and id, and places left go to the rest by id: a sequential rule over one group. Of
    a stratum and sponsor only the first ``per_sponsor`` ids can be chosen, so no more go into that group. Raises on an empty pool.
    """
    rows = distinct_on(pool, ["nct_id"], [position] if position else [c for c in pool.columns if c != "nct_id"])
    quota = largest_remainder(rows, ["sponsor_class", "phase"], target).select("sponsor_class", "phase", "quota")
    schema = rows.schema
    names = rows.columns

    def pick(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["sponsor_class", "phase", "nct_id"], kind="stable")
        used: dict = {}
        taken: dict = {}
        chosen, rest = [], []
        for i, r in zip(df.index, df.itertuples(index=False)):
            key = (r.sponsor_class, r.phase)
            if taken.get(key, 0) < r.quota and used.get(r.sponsor_name, 0) < per_sponsor:
                chosen.append(i)
                taken[key] = taken.get(key, 0) + 1
                used[r.sponsor_name] = used.get(r.sponsor_name, 0) + 1
            else:
                rest.append((r.nct_id, i, r.sponsor_name))
        for _, i, sponsor in sorted(rest):
            if len(chosen) >= min(target, len(df)):
                break
            if used.get(sponsor, 0) < per_sponsor:
                chosen.append(i)
                used[sponsor] = used.get(sponsor, 0) + 1
        return df.loc[chosen, names].sort_values("nct_id")

    if pool.isEmpty():
        raise ValueError("there are no candidates to select from")
    able = first_n(rows, ["sponsor_class", "phase", "sponsor_name"], ["nct_id"], per_sponsor)
    return able.join(quota, ["sponsor_class", "phase"]).groupBy(F.lit(1).alias("all")).applyInPandas(pick, schema).orderBy("nct_id")


def stratification(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("sponsor_class", "phase").agg(F.count(F.lit(1)).alias("n")).orderBy("sponsor_class", "phase")


def manifest(cohort: DataFrame) -> dict:
    """The cohort, its strata and the query as one record; a cohort is small by its target."""
    return {
        "filters": CANDIDATE_QUERY,
        "count": cohort.count(),
        "stratification": {f"{r['sponsor_class']}|{r['phase']}": r["n"] for r in stratification(cohort).collect()},
        "trials": [r.asDict() for r in cohort.orderBy("nct_id").collect()],
    }
