"""Queries that run the registry, document, comparison and question operators on analogues made of the driver's tables.

Customers stand for trials, their orders for outcomes, events for revisions, line items for blocks, tables and cells of
documents. Every query goes through the library's operator and has SQL that says the same over the plain tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import models, stats
from ..functions import text as T
from ..operators import chunking, cohort, compare, documents, embedding, facts, metrics, questions, reports, retrieval
from ..schemas import HISTORY, RECORD, VERSION0
from ..sources import files
from .driver_queries import _COS, _asked, _chunks, query, table

_KEY = "'NCT' || lpad({}::VARCHAR, 8, '0')"


def _key(column: str):
    return F.concat(F.lit("NCT"), F.lpad(F.col(column).cast("string"), 8, "0"))


def _array(*values):
    return F.array(*values)


# ---- trials, as nested records


def _orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    return o.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("o"))


def _outcome_array(keep, months: int, named: bool = False):
    """Outcomes of the orders that ``keep`` holds for, in order of id."""
    def one(x):
        span = F.concat((x["o_orderkey"] % months + 1).cast("string"), F.lit(" months"))
        text = F.concat(F.lit("Overall survival at "), span)
        if named:
            return F.struct(F.when(F.startswith(x["o_orderpriority"], F.lit("1")), "PRIMARY").alias("type"), text.alias("title"), span.alias("timeFrame"), x["o_orderpriority"].alias("description"))
        return F.struct(text.alias("measure"), span.alias("timeFrame"), x["o_orderpriority"].alias("description"))

    return F.transform(F.filter("o", keep), one)


def _primary(x):
    return F.startswith(x["o_orderpriority"], F.lit("1")) | F.startswith(x["o_orderpriority"], F.lit("2"))


def _protocol(months: int):
    k = F.col("c_custkey")
    phases = F.when(k % 5 == 1, _array(F.lit("PHASE1"))).when(k % 5 == 2, _array(F.lit("PHASE2"))).when(k % 5 == 3, _array(F.lit("PHASE1"), F.lit("PHASE2"))).when(k % 5 == 4, _array(F.lit("NA")))
    arms = F.transform(F.when(k % 3 > 0, F.sequence(F.lit(1), (k % 3).cast("int"))), lambda i: F.struct(F.concat(F.lit("Arm "), i.cast("string")).alias("label"), F.lit("EXPERIMENTAL").alias("type"), F.lit(None).cast("string").alias("description")))
    date = lambda c: F.struct(c.alias("date"))
    eligibility = F.when(k % 4 > 0, F.struct(F.concat((F.col("c_nationkey") + 18).cast("string"), F.lit(" Years")).alias("minimumAge"), F.when(k % 2 == 0, "99 Years").alias("maximumAge"), F.lit("ALL").alias("sex"), F.col("c_name").alias("eligibilityCriteria")))
    return F.struct(
        F.struct(_key("c_custkey").alias("nctId"), F.col("c_name").alias("briefTitle")).alias("identificationModule"),
        F.struct(F.lit("COMPLETED").alias("overallStatus"), date(F.lit("2018-01")).alias("startDateStruct"), date(F.lit(None).cast("string")).alias("primaryCompletionDateStruct"), date(F.lit("2018-02-03")).alias("studyFirstPostDateStruct")).alias("statusModule"),
        F.struct(F.struct(F.concat(F.lit("Sponsor "), F.col("c_nationkey").cast("string")).alias("name"), F.col("c_mktsegment").alias("class")).alias("leadSponsor")).alias("sponsorCollaboratorsModule"),
        F.struct(_array(F.lit("cancer"), F.lower("c_mktsegment")).alias("conditions")).alias("conditionsModule"),
        F.struct(phases.alias("phases"), F.struct(F.when(k % 7 > 0, (k % 500).cast("int")).alias("count")).alias("enrollmentInfo")).alias("designModule"),
        F.struct(_outcome_array(_primary, months).alias("primaryOutcomes"), _outcome_array(lambda x: ~_primary(x), months).alias("secondaryOutcomes")).alias("outcomesModule"),
        F.struct(arms.alias("armGroups")).alias("armsInterventionsModule"),
        eligibility.alias("eligibilityModule"),
    )


def _customers(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.join(_orders(spark, sf_dir).withColumnRenamed("k", "c_custkey"), "c_custkey", "left")


def _records(spark, sf_dir) -> DataFrame:
    """Current records: nested JSON, read with the library's schema."""
    docs = F.when(F.col("c_custkey") % 4 > 0, F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 4).cast("int")), lambda i: F.struct(F.concat(F.lit("d"), i.cast("string"), F.lit(".pdf")).alias("filename"), (i != 2).alias("hasProtocol"), (i == 2).alias("hasSap"))))
    json = F.to_json(F.struct(
        _protocol(36).alias("protocolSection"), F.when(F.col("c_custkey") % 2 == 0, F.lit(True)).alias("hasResults"),
        F.struct(F.struct(_outcome_array(lambda x: x["o_orderstatus"] == "F", 36, named=True).alias("outcomeMeasures")).alias("outcomeMeasuresModule")).alias("resultsSection"),
        F.struct(F.struct(docs.alias("largeDocs")).alias("largeDocumentModule")).alias("documentSection"),
    ))
    return _customers(spark, sf_dir).select(F.from_json(json, RECORD).alias("r")).select("r.*")


def _first_versions(spark, sf_dir) -> DataFrame:
    json = F.to_json(F.struct(F.lit(0).alias("studyVersion"), F.struct(_protocol(35).alias("protocolSection")).alias("study")))
    return _customers(spark, sf_dir).where("c_custkey % 3 > 0").select(F.from_json(json, VERSION0).alias("r")).select("r.*")


def _histories(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    labels = F.when(F.col("event_type") == "purchase", _array(F.lit("Outcome Measures"), F.lit("Study Status"))).when(F.col("event_type") != "error", _array(F.col("event_type")))
    change = F.struct(F.col("version"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("status"), labels.alias("moduleLabels"))
    per = e.withColumn("version", version).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("version", change.alias("c")))).alias("l"))
    json = F.to_json(F.struct(F.transform("l", lambda x: x["c"]).alias("changes")))
    return per.select(_key("user_id").alias("nct_id"), F.from_json(json, HISTORY)["changes"].alias("changes"))


def _outcomes(spark, sf_dir) -> DataFrame:
    return facts.outcomes(_records(spark, sf_dir), _first_versions(spark, sf_dir))


_SPAN = "(o_orderkey % {m} + 1)::VARCHAR || ' months'"
_PRIMARY = "(o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')"
#: Outcomes, trials and revisions as the SQL has them.
_OUTCOMES = f"""
oc AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sp, kp, o_orderkey) AS outcome_id FROM (
  SELECT o_custkey AS k, 'registered_current' AS source, CASE WHEN {_PRIMARY} THEN 'PRIMARY' ELSE 'SECONDARY' END AS type, {_SPAN.format(m=36)} AS span, 0 AS sp, CASE WHEN {_PRIMARY} THEN 0 ELSE 1 END AS kp, o_orderkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT o_custkey, 'registered_first', CASE WHEN {_PRIMARY} THEN 'PRIMARY' ELSE 'SECONDARY' END, {_SPAN.format(m=35)}, 1, CASE WHEN {_PRIMARY} THEN 0 ELSE 1 END, o_orderkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 3 > 0
  UNION ALL SELECT o_custkey, 'results_reported', CASE WHEN o_orderpriority LIKE '1%' THEN 'PRIMARY' ELSE 'UNKNOWN' END, {_SPAN.format(m=36)}, 2, 0, o_orderkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'))"""
_FIRST = """
fo AS (SELECT k, max(span) FILTER (source = 'registered_first' AND n = 1) AS first, max(span) FILTER (source = 'registered_current' AND n = 1) AS current, max(span) FILTER (source = 'results_reported' AND n = 1) AS results,
  max(outcome_id) FILTER (source = 'registered_first' AND n = 1) AS first_id, max(outcome_id) FILTER (source = 'registered_current' AND n = 1) AS current_id, max(outcome_id) FILTER (source = 'results_reported' AND n = 1) AS results_id
  FROM (SELECT *, row_number() OVER (PARTITION BY k, source ORDER BY outcome_id) AS n FROM oc WHERE type = 'PRIMARY') GROUP BY k)"""
_PHASE = "CASE c_custkey % 5 WHEN 1 THEN 'PHASE1' WHEN 2 THEN 'PHASE2' WHEN 3 THEN 'PHASE1|PHASE2' WHEN 4 THEN 'NA' END"
_REVISIONS = "rv AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, strftime(ts, '%Y-%m-%d') AS date, event_type FROM events)"
_C = _KEY.format("c_custkey")
_K = _KEY.format("k")


@query(f"""SELECT {_C} AS nct_id, c_name AS brief_title, 'Sponsor ' || c_nationkey AS sponsor_name, c_mktsegment AS sponsor_class, {_PHASE} AS phase, 'cancer|' || lower(c_mktsegment) AS conditions,
CASE WHEN c_custkey % 7 > 0 THEN (c_custkey % 500)::INT END AS enrollment_count, 'COMPLETED' AS overall_status, '2018-01' AS start_date, NULL::VARCHAR AS primary_completion_date, '2018-02-03' AS first_post_date,
c_custkey % 2 = 0 AS has_results, c_custkey % 4 > 0 AS has_protocol, c_custkey % 4 > 1 AS has_sap FROM customer""")
def facts_trials(spark, sf_dir):
    """Trials of nested records; absent paths are null."""
    return facts.trials(_records(spark, sf_dir))


@query(f"""WITH {_OUTCOMES} SELECT {_K} AS nct_id, source, type, 'Overall survival at ' || span AS measure, span AS time_frame, o_orderpriority AS description, outcome_id::BIGINT AS outcome_id FROM oc""")
def facts_outcomes(spark, sf_dir):
    """Outcomes of three sources with their ids."""
    return _outcomes(spark, sf_dir)


@query(f"SELECT {_C} AS nct_id, 'Arm ' || i AS label, 'EXPERIMENTAL' AS type, NULL::VARCHAR AS description, i::BIGINT AS arm_id FROM customer, range(1, 3) t(i) WHERE i <= c_custkey % 3")
def facts_arms(spark, sf_dir):
    return facts.arms(_records(spark, sf_dir))


@query(f"SELECT {_C} AS nct_id, (c_nationkey + 18) || ' Years' AS minimum_age, CASE WHEN c_custkey % 2 = 0 THEN '99 Years' END AS maximum_age, 'ALL' AS sex, c_name AS criteria FROM customer WHERE c_custkey % 4 > 0")
def facts_eligibility(spark, sf_dir):
    return facts.eligibility(_records(spark, sf_dir))


@query(f"""WITH {_REVISIONS} SELECT {_K} AS nct_id, version::INT AS version, date, event_type AS status, CASE event_type WHEN 'purchase' THEN 'Outcome Measures|Study Status' WHEN 'error' THEN '' ELSE event_type END AS modules FROM rv""")
def facts_amendments(spark, sf_dir):
    """Revisions with the modules that they changed, joined by bars."""
    return facts.amendments(_histories(spark, sf_dir)).withColumn("modules", F.array_join("modules_changed", "|")).drop("modules_changed")


@query(f"WITH {_REVISIONS} SELECT {_K} AS nct_id, version::INT AS version, date FROM rv WHERE event_type = 'purchase'")
def outcome_amendments(spark, sf_dir):
    return facts.outcome_amendments(facts.amendments(_histories(spark, sf_dir))).select("nct_id", "version", "date")


@query(f"""WITH d AS (SELECT c_custkey AS k, i, CASE i WHEN 2 THEN 'sap' ELSE 'protocol' END AS doc_type FROM customer, range(1, 4) t(i) WHERE i <= c_custkey % 4), n AS (SELECT *, row_number() OVER (PARTITION BY k, doc_type ORDER BY i) AS n FROM d)
SELECT {_K} AS nct_id, doc_type, {_K} || '_' || doc_type || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS name, 'http://x/' || lpad((k % 100)::VARCHAR, 2, '0') || '/' || {_K} || '/d' || i || '.pdf' AS url, 'd' || i || '.pdf' AS filename FROM n""")
def attached_documents(spark, sf_dir):
    """Names and addresses of attached documents."""
    return facts.attached_documents(_records(spark, sf_dir), "http://x/")


@query(f"""WITH {_OUTCOMES} SELECT {_K} AS nct_id, outcome_id::BIGINT AS outcome_id, CASE WHEN k % 2 = 0 THEN 'new' ELSE 'old' END AS run FROM oc""")
def facts_load(spark, sf_dir):
    """Loading replaces what the loaded trials had: the trials with an even number are loaded again."""
    o = _outcomes(spark, sf_dir).select("nct_id", "outcome_id")
    even = o.where(F.right("nct_id", F.lit(1)).cast("int") % 2 == 0)
    return facts.load(o.withColumn("run", F.lit("old")), even.withColumn("run", F.lit("new")), ["nct_id"])


@query(f"SELECT {_C} AS nct_id, 'Sponsor ' || c_nationkey AS sponsor_name, c_mktsegment AS sponsor_class, coalesce({_PHASE}, 'NA') AS phase, '2018-02-03' AS first_posted FROM customer WHERE c_custkey % 4 > 0")
def cohort_candidates(spark, sf_dir):
    """Records with a protocol or analysis plan."""
    return cohort.candidates(_records(spark, sf_dir))


@query("SELECT c_mktsegment AS sponsor_class, coalesce(" + _PHASE + ", 'NA') AS phase, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 4 > 0 GROUP BY 1, 2")
def cohort_stratification(spark, sf_dir):
    return cohort.stratification(cohort.candidates(_records(spark, sf_dir)))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'protocol' WHEN p_size % 3 = 0 THEN 'sap' WHEN p_size % 5 = 0 THEN 'icf' ELSE 'other' END AS doc_type FROM part")
def doc_type_flags(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", T.doc_type(s % 2 == 0, s % 3 == 0, s % 5 == 0).alias("doc_type"))


@query(f"""WITH e AS (SELECT {_C} AS nct_id, ['current.json', 'history.json', 'versions/0.json'][i] AS file, i, c_custkey AS k FROM customer, range(1, 4) t(i))
SELECT nct_id, file FROM e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = k AND o_orderkey % 3 = i - 1)""")
def archive_missing(spark, sf_dir):
    """Files of an archive that are not there yet; an order stands for a file that was fetched."""
    names = F.array(*[F.lit(x) for x in ("current.json", "history.json", "versions/0.json")])
    found = table(spark, sf_dir, "orders").select(_key("o_custkey").alias("nct_id"), F.element_at(names, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("file"))
    return files.missing(files.expected_files(table(spark, sf_dir, "customer").select(_key("c_custkey").alias("nct_id"))), found)


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 3 = 0 AND sha256(coalesce(o.text, '')) = sha256(coalesce(d.text, '')))""")
def changed_files(spark, sf_dir):
    """Documents whose digest was not worked on yet; those with a number divisible by three were."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return files.changed(d, d.where("doc_id % 3 = 0"), ["digest"])


# ---- questions


@query(f"""WITH {_OUTCOMES},
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY outcome_id) AS n FROM oc WHERE source = 'registered_current' AND type = 'PRIMARY'),
q AS (
  SELECT c_custkey AS k, 'enrollment_count' AS template, 1 AS n, 'What is the target enrollment for ' || {_C} || '?' AS question_text, (c_custkey % 500)::VARCHAR AS gold_answer FROM customer WHERE c_custkey % 7 > 0
  UNION ALL SELECT c_custkey, 'phase', 1, 'What phase is the ' || {_C} || ' trial?', CASE c_custkey % 5 WHEN 1 THEN 'Phase 1' WHEN 2 THEN 'Phase 2' ELSE 'N/A' END FROM customer WHERE c_custkey % 5 IN (1, 2, 4)
  UNION ALL SELECT c_custkey, 'sponsor', 1, 'Who is the sponsor of ' || {_C} || '?', 'Sponsor ' || c_nationkey FROM customer
  UNION ALL SELECT c_custkey, 'min_age', 1, 'What is the minimum age for participants in ' || {_C} || '?', (c_nationkey + 18) || ' Years' FROM customer WHERE c_custkey % 4 > 0
  UNION ALL SELECT c_custkey, 'max_age', 1, 'What is the maximum age for participants in ' || {_C} || '?', '99 Years' FROM customer WHERE c_custkey % 4 > 0 AND c_custkey % 2 = 0
  UNION ALL SELECT k, 'primary_outcome_measure', n, 'What is primary outcome ' || n || ' for ' || {_K} || '?', 'Overall survival at ' || span FROM p WHERE n <= 2
  UNION ALL SELECT k, 'primary_outcome_timeframe', n, 'What is the timeframe for primary outcome ' || n || ' of ' || {_K} || '?', span FROM p WHERE n <= 2
  UNION ALL SELECT c_custkey, 'arm_label', i, 'What is the label of arm ' || i || ' in ' || {_C} || '?', 'Arm ' || i FROM customer, range(1, 3) t(i) WHERE i <= c_custkey % 3)
SELECT {_K} || ':' || template || ':' || (n - 1) AS question_id, 't1' AS tier, {_K} AS nct_id, template, question_text, gold_answer FROM q""")
def t1_questions(spark, sf_dir):
    """One question for every fact that a trial has."""
    r = _records(spark, sf_dir)
    return questions.t1_questions(facts.trials(r), _outcomes(spark, sf_dir), facts.arms(r), facts.eligibility(r))


@query(f"""WITH {_OUTCOMES}, h AS (SELECT c_custkey AS k, coalesce(bool_or(source = 'registered_first'), false) AS f, coalesce(bool_or(source = 'registered_current'), false) AS c, coalesce(bool_or(source = 'results_reported'), false) AS r FROM customer LEFT JOIN oc ON oc.k = c_custkey GROUP BY c_custkey)
SELECT {_K} || ':' || pair AS question_id, 't3' AS tier, {_K} AS nct_id, pair, text AS question_text FROM (
  SELECT k, 'first_posted_vs_current' AS pair, 'Does the current registry record for ' || {_K} || ' match what was first posted?' AS text FROM h WHERE f
  UNION ALL SELECT k, 'current_vs_protocol', 'Does the protocol''s stated primary endpoint for ' || {_K} || ' match the current registry record?' FROM h WHERE c
  UNION ALL SELECT k, 'registry_vs_results', 'Do the reported results for ' || {_K} || ' match the registered primary outcome?' FROM h WHERE r AND (c OR f))""")
def t3_questions(spark, sf_dir):
    """Questions across sources, for the pairs that apply to a trial."""
    return questions.t3_questions(facts.trials(_records(spark, sf_dir)), _outcomes(spark, sf_dir))


@query(f"""WITH {_OUTCOMES}, {_FIRST}, {_REVISIONS},
e AS (SELECT k, count(*) AS n, max(version) AS v, max_by(date, version) AS d FROM rv WHERE event_type = 'purchase' GROUP BY k),
t AS (SELECT c_custkey AS k, coalesce(n, 0) AS n, v, d, 'Overall survival at ' || first AS first, 'Overall survival at ' || current AS current FROM customer LEFT JOIN e ON e.k = c_custkey LEFT JOIN fo ON fo.k = c_custkey),
q AS (
  SELECT k, 'changed_when_what' AS template, 'Was the primary outcome changed after first posting for ' || {_K} || '? When, and to what?' AS question_text,
    CASE WHEN current IS NULL THEN NULL WHEN n = 0 THEN 'No, the primary outcome was not changed after first posting.'
         WHEN n = 1 THEN 'Yes, the primary outcome was changed, from ''' || first || ''' to ''' || current || ''', at version ' || v || ' (' || d || ').'
         ELSE 'Yes, the primary outcome was changed across ' || n || ' revisions (most recently at version ' || v || ', ' || d || '). It now reads: ''' || current || '''.' END AS gold_answer FROM t
  UNION ALL SELECT k, 'revision_count', 'How many revisions touched the primary outcome for ' || {_K} || '?', n::VARCHAR FROM t
  UNION ALL SELECT k, 'first_registered', 'What was the primary outcome as first registered for ' || {_K} || '?', first FROM t)
SELECT {_K} || ':' || template || ':0' AS question_id, 't4' AS tier, {_K} AS nct_id, template, question_text, gold_answer FROM q WHERE gold_answer IS NOT NULL""")
def t4_questions(spark, sf_dir):
    """Questions on how and when the primary outcome changed."""
    return questions.t4_questions(facts.trials(_records(spark, sf_dir)), _outcomes(spark, sf_dir), facts.amendments(_histories(spark, sf_dir)))


def _seeded(seed: int, *ids: str) -> str:
    return "sha256('" + str(seed) + ":' || " + " || ':' || ".join(ids) + ")"


@query(f"""WITH p AS (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'divergence' WHEN o_orderstatus = 'O' THEN 'match' END AS verdict, o_orderpriority LIKE '5%' AS failed FROM orders),
s AS (SELECT {_K} AS id, bool_or(coalesce(verdict = 'divergence', false)) AS d, bool_or(failed) AS f, bool_and(coalesce(verdict = 'match', false) AND NOT failed) AS m FROM p GROUP BY k),
a AS (SELECT id FROM s WHERE d ORDER BY {_seeded(0, "'divergence'", "id")}, id LIMIT 8),
b AS (SELECT id FROM s WHERE f AND id NOT IN (SELECT id FROM a) ORDER BY {_seeded(0, "'retrieval_failed'", "id")}, id LIMIT 4),
c AS (SELECT id FROM s WHERE m AND id NOT IN (SELECT id FROM a UNION ALL SELECT id FROM b) ORDER BY {_seeded(0, "'clean_match'", "id")}, id LIMIT 8),
u AS (SELECT id, 'divergence' AS stratum FROM a UNION ALL SELECT id, 'retrieval_failed' FROM b UNION ALL SELECT id, 'clean_match' FROM c),
r AS (SELECT {_C} AS id FROM customer WHERE {_C} NOT IN (SELECT id FROM u) ORDER BY {_seeded(0, "'rest'", _C)}, id LIMIT 20)
SELECT id AS nct_id, stratum FROM u UNION ALL SELECT id, 'rest' FROM (SELECT id FROM r ORDER BY id LIMIT (SELECT 20 - count(*) FROM u))""")
def select_stratified(spark, sf_dir):
    """Eight divergent trials, four of failed retrieval, eight clean ones, and others for those missing."""
    o = table(spark, sf_dir, "orders")
    verdict = F.when(F.col("o_orderstatus") == "F", "divergence").when(F.col("o_orderstatus") == "O", "match")
    p = o.select(_key("o_custkey").alias("nct_id"), verdict.alias("verdict"), F.startswith("o_orderpriority", F.lit("5")).alias("retrieval_failed"))
    return questions.select_stratified(questions.strata(p), table(spark, sf_dir, "customer").select(_key("c_custkey").alias("nct_id")))


@query("""WITH p AS (SELECT o_custkey AS k, o_orderstatus AS s, o_orderpriority LIKE '5%' AS failed FROM orders)
SELECT """ + _K + """ AS nct_id, bool_or(s = 'F') AS divergence, bool_or(failed) AS retrieval_failed, bool_and(s = 'O' AND NOT failed) AS clean_match FROM p GROUP BY k""")
def question_strata(spark, sf_dir):
    verdict = F.when(F.col("o_orderstatus") == "F", "divergence").when(F.col("o_orderstatus") == "O", "match")
    return questions.strata(table(spark, sf_dir, "orders").select(_key("o_custkey").alias("nct_id"), verdict.alias("verdict"), F.startswith("o_orderpriority", F.lit("5")).alias("retrieval_failed")))


@query(f"""WITH t AS (SELECT {_seeded(3, "event_id")} AS h, event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_seeded(3, "event_id")}, event_id::VARCHAR) AS turn FROM events WHERE event_type <> 'error')
SELECT event_id::VARCHAR AS question_id, event_type AS template FROM t ORDER BY turn, list_position(['view', 'click', 'purchase', 'signup'], event_type) LIMIT 50""")
def questions_capped(spark, sf_dir):
    """Fifty questions, taken from the templates in turn."""
    q = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("event_id").cast("string").alias("question_id"), F.col("event_type").alias("template"))
    return questions.capped(q, "template", ["view", "click", "purchase", "signup"], 50, 3)


_UNPOSTED = ", ".join("'" + t.replace("'", "''") + "'" for t in questions.ADVERSARIAL_TEXTS["unposted_document"])
_ABSENT = ", ".join("'" + t.replace("'", "''") + "'" for t in questions.ADVERSARIAL_TEXTS["fact_not_in_corpus"])


@query(f"""WITH t AS (SELECT {_C} AS id, c_custkey % 3 = 0 AS sap FROM customer),
u AS (SELECT id, row_number() OVER (ORDER BY {_seeded(0, "'unposted_document'", "id")}, id) - 1 AS i FROM t WHERE NOT sap QUALIFY i < 15),
f AS (SELECT id, row_number() OVER (ORDER BY {_seeded(0, "'fact_not_in_corpus'", "id")}, id) - 1 AS i FROM t QUALIFY i < 15)
SELECT id || ':unposted_document:' || i AS question_id, id AS nct_id, replace([{_UNPOSTED}][i % 5 + 1], '{{}}', id) AS question_text, 'unposted_document' AS category, 'refuse' AS expected_behavior FROM u
UNION ALL SELECT id || ':fact_not_in_corpus:' || i, id, replace([{_ABSENT}][i % 8 + 1], '{{}}', id), 'fact_not_in_corpus', 'refuse' FROM f""")
def adversarial_questions(spark, sf_dir):
    """Thirty questions that have to be refused."""
    c = table(spark, sf_dir, "customer").select(_key("c_custkey").alias("nct_id"), "c_custkey")
    return questions.adversarial_questions(c.select("nct_id"), c.where("c_custkey % 3 = 0").select("nct_id", F.lit("sap").alias("doc_type")))


@query(f"""WITH q AS (SELECT c_custkey AS k, (c_custkey % 500)::VARCHAR AS a FROM customer), c AS (SELECT o_custkey AS k, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'sap' ELSE 'protocol' END AS d, 'enrolled ' || (o_orderkey % 40) || ' of ' || (o_custkey % 500) // 2 || ' or ' || (CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 500 ELSE 7 END) AS t FROM orders),
h AS (SELECT q.k, d, o_orderkey FROM q JOIN c USING (k) WHERE regexp_matches(t, '\\b' || a || '\\b')),
b AS (SELECT * FROM h WHERE d = 'protocol' OR k NOT IN (SELECT k FROM h WHERE d = 'protocol'))
SELECT {_K} AS question_id, count(o_orderkey)::BIGINT AS n_gold, coalesce(string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey::VARCHAR), '') AS gold,
  CASE WHEN count(o_orderkey) = 0 THEN 'unlocatable' WHEN count(o_orderkey) > 30 THEN 'too_many_matches' END AS reason FROM q LEFT JOIN b USING (k) GROUP BY k""")
def locate_gold(spark, sf_dir):
    """Chunks that hold a short answer as a whole token: the protocol's, or the plan's where the protocol has none."""
    q = table(spark, sf_dir, "customer").select(_key("c_custkey").alias("question_id"), _key("c_custkey").alias("nct_id"), F.lit("enrollment_count").alias("template"), (F.col("c_custkey") % 500).cast("string").alias("gold_answer"))
    k, n = F.col("o_custkey") % 500, F.col("o_orderkey")
    text = F.concat(F.lit("enrolled "), (n % 40).cast("string"), F.lit(" of "), F.floor(k / 2).cast("string"), F.lit(" or "), F.when(n % 3 == 0, k).otherwise(7).cast("string"))
    c = table(spark, sf_dir, "orders").select(_key("o_custkey").alias("nct_id"), F.when(F.col("o_orderstatus") == "P", "sap").otherwise("protocol").alias("doc_type"), n.cast("string").alias("chunk_id"), text.alias("text"))
    found = questions.locate_gold(q, c)
    reasons = questions.usable(found)[1].select("question_id", "reason")
    return found.join(reasons, "question_id", "left").select("question_id", F.size("gold_chunk_ids").cast("long").alias("n_gold"), F.array_join("gold_chunk_ids", "|").alias("gold"), "reason")


# ---- comparison


def _sources(spark, sf_dir) -> DataFrame:
    """Sources of every trial; the protocol's first chunk is made of the customer's last order."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("n"))
    chunk = last.where("o_custkey % 4 > 0").select(_key("o_custkey").alias("nct_id"), F.concat(F.lit("c"), F.col("n").cast("string")).alias("chunk_id"), F.concat(F.lit("Overall Survival, at "), (F.col("n") % 36 + 1).cast("string"), F.lit(" months.")).alias("text"), F.lit(1).alias("rank"))
    return retrieval.cross_source(facts.trials(_records(spark, sf_dir)), _outcomes(spark, sf_dir), chunk)


_SOURCES = f"""{_OUTCOMES}, {_FIRST},
pr AS (SELECT o_custkey AS k, max(o_orderkey) AS n FROM orders WHERE o_custkey % 4 > 0 GROUP BY 1),
so AS (SELECT c_custkey AS k, first, current, results, first_id, current_id, results_id, n, (n % 36 + 1) || ' months' AS leg FROM customer LEFT JOIN fo ON fo.k = c_custkey LEFT JOIN pr ON pr.k = c_custkey),
pa AS (SELECT k, 'first_posted_vs_current' AS pair, CASE WHEN first IS NULL OR current IS NULL THEN 'not_applicable' ELSE 'graded' END AS state, first AS a, current AS b FROM so
  UNION ALL SELECT k, 'current_vs_protocol', CASE WHEN current IS NULL THEN 'not_applicable' WHEN leg IS NULL THEN 'retrieval_failed' ELSE 'graded' END, current, leg FROM so
  UNION ALL SELECT k, 'registry_vs_results', CASE WHEN results IS NULL OR coalesce(current, first) IS NULL THEN 'not_applicable' ELSE 'graded' END, coalesce(current, first), results FROM so)"""


@query(f"WITH {_SOURCES} SELECT {_K} AS nct_id, 'Overall survival at ' || first AS registered_first, 'Overall survival at ' || current AS registered_current, 'Overall survival at ' || results AS results_reported, first_id::BIGINT AS registered_first_outcome_id, current_id::BIGINT AS registered_current_outcome_id, results_id::BIGINT AS results_reported_outcome_id, 'Overall Survival, at ' || leg || '.' AS protocol_leg, 'c' || n AS protocol_chunk_id FROM so")
def cross_source(spark, sf_dir):
    """First primary outcome of every source and the protocol's chunk, one row a trial."""
    return _sources(spark, sf_dir).select("nct_id", "registered_first", "registered_current", "results_reported", "registered_first_outcome_id", "registered_current_outcome_id", "results_reported_outcome_id", "protocol_leg", "protocol_chunk_id")


@query(f"WITH {_SOURCES} SELECT {_K} AS nct_id, pair, state FROM pa")
def source_pairs(spark, sf_dir):
    return compare.source_pairs(_sources(spark, sf_dir)).select("nct_id", "pair", "state")


# texts of a pair differ in their months alone, so tokens overlap in all but one, or in all
_VERDICT = "CASE WHEN state <> 'graded' THEN NULL WHEN a = b THEN 'match' WHEN 4 / 6 >= 0.8 THEN 'match' ELSE 'ambiguous' END"


@query(f"""WITH {_SOURCES}, g AS (SELECT *, {_VERDICT} AS verdict, CASE pair WHEN 'first_posted_vs_current' THEN 'current registry' WHEN 'current_vs_protocol' THEN 'current registry' ELSE 'registry' END AS x,
  CASE pair WHEN 'first_posted_vs_current' THEN 'first-posted registry' WHEN 'current_vs_protocol' THEN 'protocol document' ELSE 'results-reported' END AS y FROM pa)
SELECT {_K} AS nct_id, pair, state, verdict, state = 'retrieval_failed' AS retrieval_failed, CASE WHEN state = 'graded' THEN CASE WHEN a = b THEN 'identical_text' ELSE 'judge' END END AS method,
  CASE WHEN state = 'retrieval_failed' THEN y || ' primary outcome could not be retrieved for this trial -- no comparison was made.' WHEN verdict = 'match' THEN x || ' primary outcome matches ' || y || ' primary outcome.'
    WHEN verdict = 'ambiguous' THEN x || ' primary outcome could not be confidently compared to ' || y || ' primary outcome -- flagged for human review.' END AS text FROM g""")
def detect_discrepancies(spark, sf_dir):
    """Verdict, method and sentence for every pair of sources of every trial, with the stand-in judge."""
    return compare.detect(_sources(spark, sf_dir), models.rule_judge).drop("citations")


@query("""SELECT p_partkey, 'overall survival at ' || p_size || ' ' || ['days', 'weeks', 'months', 'years'][p_size % 4 + 1] AS construct,
 CASE WHEN p_partkey % 2 = 0 THEN round_even(p_size * 12.0::DOUBLE, 2) ELSE round_even(p_size * [12.0::DOUBLE / 365, 12.0::DOUBLE / 52, 1.0::DOUBLE, 12.0::DOUBLE][p_size % 4 + 1], 2) END AS timeframe FROM part""")
def normal_outcome(spark, sf_dir):
    """Normal text of a measure, and the months of its time frame or else of itself."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("days", "weeks", "months", "years")]), F.col("p_size") % 4 + 1)
    p = table(spark, sf_dir, "part").withColumn("m", F.concat(F.lit("Overall survival, at "), F.col("p_size").cast("string"), F.lit(" "), unit, F.lit("!")))
    n = compare.normal_outcome(F.col("m"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" yrs"))))
    return p.select("p_partkey", n["construct"].alias("construct"), n["timeframe"].alias("timeframe"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'VERDICT: Match, as it is' WHEN 1 THEN 'I say verdict:divergence' WHEN 2 THEN 'VERDICT: AMBIGUOUS' ELSE 'verdict unclear' END AS t FROM events)
SELECT event_id, nullif(lower(regexp_extract(t, '(?i)VERDICT:\\s*(match|divergence|ambiguous)', 1)), '') AS verdict FROM r""")
def parse_verdict(spark, sf_dir):
    i = F.col("event_id") % 4
    t = F.when(i == 0, "VERDICT: Match, as it is").when(i == 1, "I say verdict:divergence").when(i == 2, "VERDICT: AMBIGUOUS").otherwise("verdict unclear")
    return table(spark, sf_dir, "events").select("event_id", compare.parse_verdict(t).alias("verdict"))


_LABELS = "['match', 'divergence', 'ambiguous']"


@query(f"""WITH x AS (SELECT {_LABELS}[o_orderkey % 3 + 1] AS label, {_LABELS}[o_custkey % 3 + 1] AS verdict FROM orders)
SELECT label, count(*) FILTER (verdict = 'match')::BIGINT AS match, count(*) FILTER (verdict = 'divergence')::BIGINT AS divergence, count(*) FILTER (verdict = 'ambiguous')::BIGINT AS ambiguous FROM x GROUP BY label""")
def normalization_confusion(spark, sf_dir):
    """Labels of phrase pairs against verdicts."""
    kinds = F.array(*[F.lit(k) for k in ("match", "divergence", "ambiguous")])
    x = table(spark, sf_dir, "orders").select(F.element_at(kinds, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("label"), F.element_at(kinds, (F.col("o_custkey") % 3 + 1).cast("int")).alias("verdict"), F.lit("judge").alias("method"))
    return compare.evaluate_normalization(x)[1]


# ---- scores


@query("""WITH x AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'divergence' WHEN 1 THEN 'match' ELSE 'ambiguous' END AS gold, c_mktsegment AS pair FROM customer),
p AS (SELECT o_custkey AS k, max_by(o_orderstatus, o_orderkey) AS s, max_by(o_orderpriority, o_orderkey) AS f FROM orders GROUP BY 1),
b AS (SELECT pair, CASE WHEN s IS NULL THEN 'na' WHEN f LIKE '5%' OR s = 'P' THEN 'failed' WHEN gold = 'ambiguous' THEN 'amb' WHEN gold = 'divergence' AND s = 'F' THEN 'tp' WHEN s = 'F' THEN 'fp' WHEN gold = 'divergence' THEN 'fn' ELSE 'tn' END AS b FROM x LEFT JOIN p USING (k))
SELECT coalesce(pair, 'pooled') AS pair, count(*) FILTER (b = 'tp')::BIGINT AS tp, count(*) FILTER (b = 'fp')::BIGINT AS fp, count(*) FILTER (b = 'fn')::BIGINT AS fn, count(*) FILTER (b = 'tn')::BIGINT AS tn,
 count(*) FILTER (b = 'amb')::BIGINT AS ambiguous, count(*) FILTER (b = 'failed')::BIGINT AS retrieval_failed, count(*) FILTER (b = 'na')::BIGINT AS not_applicable FROM b GROUP BY ROLLUP (pair)""")
def score_discrepancies(spark, sf_dir):
    """Gold verdicts against predictions, of which the last counts, per pair and pooled."""
    k = F.col("c_custkey") % 3
    gold = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("nct_id"), F.col("c_mktsegment").alias("pair"), F.when(k == 0, "divergence").when(k == 1, "match").otherwise("ambiguous").alias("verdict"))
    verdict = F.when(F.col("o_orderstatus") == "F", "divergence").when(F.col("o_orderstatus") == "O", "match")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("nct_id"), verdict.alias("verdict"), F.startswith("o_orderpriority", F.lit("5")).alias("retrieval_failed"), F.col("o_orderkey").alias("position"))
    reports_ = o.join(gold.select("nct_id", "pair"), "nct_id")
    return metrics.score_discrepancies(gold, reports_).select("pair", "tp", "fp", "fn", "tn", "ambiguous", "retrieval_failed", "not_applicable")


@query("""WITH x AS (SELECT CASE WHEN value <= 0.25 * 200 THEN 0.0 WHEN value <= 0.75 * 200 THEN 0.5 ELSE 1.0 END::DOUBLE AS human, CASE WHEN (event_id % 100) / 100 <= 0.25 THEN 0.0 WHEN (event_id % 100) / 100 <= 0.75 THEN 0.5 ELSE 1.0 END AS j FROM events)
SELECT human, count(*) FILTER (j = 0)::BIGINT AS j0, count(*) FILTER (j = 0.5)::BIGINT AS j05, count(*) FILTER (j = 1)::BIGINT AS j1 FROM x GROUP BY human""")
def confusion_counts(spark, sf_dir):
    """Confusion of two raters' labels, snapped to 0, 0.5 and 1."""
    x = table(spark, sf_dir, "events").select((F.col("value") / 200).alias("h"), ((F.col("event_id") % 100) / 100).alias("j"))
    return stats.confusion(x, "h", "j")


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 9) || ' months' WHEN 1 THEN 'Phase ' || (o_orderkey % 4) ELSE (o_orderkey % 20)::VARCHAR END AS g, CASE WHEN o_orderkey % 2 = 0 THEN 'It is phase ' || (o_custkey % 4) || '.' ELSE 'It is ' || (o_custkey % 9) || ' months, or ' || (o_custkey % 20) || '.' END AS a FROM orders)
SELECT o_orderkey, CASE WHEN g LIKE '% months' THEN coalesce(regexp_extract(a, '(\\d+) months', 1) = regexp_extract(g, '(\\d+) months', 1), false) ELSE regexp_matches(lower(a), '\\b' || lower(g) || '\\b') END AS hit FROM x""")
def exact_match(spark, sf_dir):
    """Gold answers in generated ones: as a duration, else as a whole token."""
    n, k = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda c: c.cast("string")
    gold = F.when(n % 3 == 0, F.concat(s(n % 9), F.lit(" months"))).when(n % 3 == 1, F.concat(F.lit("Phase "), s(n % 4))).otherwise(s(n % 20))
    answer = F.when(n % 2 == 0, F.concat(F.lit("It is phase "), s(k % 4), F.lit("."))).otherwise(F.concat(F.lit("It is "), s(k % 9), F.lit(" months, or "), s(k % 20), F.lit(".")))
    return table(spark, sf_dir, "orders").select("o_orderkey", metrics.exact_match(answer, gold).alias("hit"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 END::DOUBLE AS score FROM events")
def parse_score(spark, sf_dir):
    i = F.col("event_id") % 5
    t = F.when(i == 0, "Score: 0.5 as parts lack").when(i == 1, "SCORE: 1\nJUSTIFICATION: all there").when(i == 2, "score:0").when(i == 3, "SCORE: high").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", metrics.parse_score(t).alias("score"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\s*(?:[-*•]\s+|\d+[.)]\s+)', ''))), lambda x: x <> '') AS c FROM documents)
SELECT doc_id, len(coalesce(c, []))::BIGINT AS n, sha256(array_to_string(coalesce(c, []), chr(10))) AS claims FROM l""")
def answer_claims(spark, sf_dir):
    """Lines of every document as claims, without list markers."""
    c = metrics.claims(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(c).cast("long").alias("n"), F.sha2(F.array_join(c, "\n"), 256).alias("claims"))


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS g FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, n::BIGINT AS claims, round(CASE WHEN n > 0 THEN g / n ELSE 0 END, 6) AS score FROM c""")
def faithfulness(spark, sf_dir):
    """Grounded claims over claims; an answer without claims scores 0."""
    g = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    graded = g.select("c_custkey", F.col("o_orderkey").cast("string").alias("claim"), (F.col("o_orderstatus") == "F").alias("grounded"))
    return metrics.faithfulness(graded, ["c_custkey"]).select("c_custkey", "claims", F.round("score", 6).alias("score"))


@query("""SELECT (SELECT round(avg(CASE WHEN turn % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) FROM conversations WHERE role = 'user') AS refusal_accuracy, (SELECT count(*) FROM conversations WHERE role = 'user')::BIGINT AS n_adversarial,
(SELECT round(avg(CASE WHEN turn % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) FROM conversations WHERE role <> 'user') AS over_refusal_rate, (SELECT count(*) FROM conversations WHERE role <> 'user')::BIGINT AS n_answerable""")
def refusal_metrics(spark, sf_dir):
    """Refusals where they are right and where they are not, with every third turn made one."""
    c = table(spark, sf_dir, "conversations").select("role", F.when(F.col("turn") % 3 == 0, F.lit("  NOT_ANSWERABLE\n")).otherwise(F.lit("not NOT_ANSWERABLE")).alias("response_text"))
    out = metrics.refusal_metrics(c.where("role = 'user'"), c.where("role <> 'user'"))
    return out.select(F.round("refusal_accuracy", 6).alias("refusal_accuracy"), "n_adversarial", F.round("over_refusal_rate", 6).alias("over_refusal_rate"), "n_answerable")


@query("""SELECT event_type AS stage, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, count(value)::BIGINT AS n FROM events WHERE event_id >= 100 GROUP BY 1""")
def stage_latency(spark, sf_dir):
    """Latency per stage of the queries from one id on, as a run leaves them in the trace."""
    steps = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.col("event_type").alias("stage"), F.col("value").alias("latency_ms"))
    out = metrics.stage_latency(steps, 100, 1 << 62)
    return out.select("stage", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean")], "n")


# ---- texts


@query("""WITH x AS (SELECT o_orderkey, 'Shown in [' || (o_orderkey % 7) || '] and [' || (o_custkey % 5) || '][' || (o_orderkey % 7) || '], not [x].' AS t, o_orderkey % 7 AS a, o_custkey % 5 AS b FROM orders)
SELECT o_orderkey, CASE WHEN a BETWEEN 1 AND 4 THEN 'c' || a ELSE '' END || CASE WHEN b BETWEEN 1 AND 4 AND b <> a THEN CASE WHEN a BETWEEN 1 AND 4 THEN '|' ELSE '' END || 'c' || b ELSE '' END AS cited FROM x""")
def citations(spark, sf_dir):
    """Chunks that an answer cites, of four, in order of first mention."""
    s = lambda c: c.cast("string")
    n, k = F.col("o_orderkey"), F.col("o_custkey")
    t = F.concat(F.lit("Shown in ["), s(n % 7), F.lit("] and ["), s(k % 5), F.lit("]["), s(n % 7), F.lit("], not [x]."))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.citations(t, F.array(*[F.lit(f"c{i}") for i in range(1, 5)])), "|").alias("cited"))


_FOOTERS = ("Revised Protocol No.: 0{n} Date: 16-Sep-2019", "Amendment {n} of the plan", "Version {n}.5", "made with SAS version {n}.4", "Amendment {n}24-Mar-2022", "page {n}")


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN p_size + 0.5 END::DOUBLE AS version, CASE p_size % 6 WHEN 0 THEN '0' || p_size WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size || '.5' END AS raw_version,
CASE p_size % 6 WHEN 0 THEN '16-Sep-2019' END AS date, CASE p_size % 6 WHEN 0 THEN 'revised_protocol' WHEN 1 THEN 'amendment' WHEN 2 THEN 'version' END AS pattern FROM part""")
def version_marker(spark, sf_dir):
    """Version markers of six kinds of footers, three of which hold none."""
    t = F.element_at(F.array(*[F.replace(F.lit(f), F.lit("{n}"), F.col("p_size").cast("string")) for f in _FOOTERS]), F.col("p_size") % 6 + 1)
    m = T.version_marker(t)
    return table(spark, sf_dir, "part").select("p_partkey", *[m[c].alias(c) for c in ("version", "raw_version", "date", "pattern")])


@query("""SELECT p_partkey, '[' || p_brand || ' | ' || p_type || ' v' || CASE WHEN p_size % 3 = 0 THEN '?' WHEN p_size % 3 = 1 THEN p_size::VARCHAR ELSE (p_size + 0.25)::VARCHAR END || ' | synopsis]' AS header FROM part""")
def contextual_header(spark, sf_dir):
    """Headers of chunks; a missing version is shown as a question mark."""
    s = F.col("p_size")
    v = F.when(s % 3 == 1, s.cast("double")).when(s % 3 == 2, s + F.lit(0.25))
    return table(spark, sf_dir, "part").select("p_partkey", T.contextual_header(F.col("p_brand"), F.col("p_type"), v, F.lit("synopsis")).alias("header"))


@query("SELECT page_id, CASE WHEN length(url) > 20 THEN left(url, 20) || '…' ELSE url END AS snippet, replace('a|b ' || url, '|', '\\|') AS cell FROM pages")
def snippets_and_cells(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.snippet(F.col("url"), 20).alias("snippet"), T.escape_cell(F.concat(F.lit("a|b "), "url")).alias("cell"))


@query("SELECT p_partkey, CASE WHEN p_size < 15 THEN 'under_15' WHEN p_size <= 40 THEN '15_to_40' ELSE 'over_40' END AS bracket, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_size / (p_partkey % 9) > 2 THEN 'high' WHEN p_size / (p_partkey % 9) < 0.5 THEN 'low' END AS flag FROM part")
def gates(spark, sf_dir):
    """Bracket of a percentage, and whether a ratio leaves 0.5 to 2."""
    return table(spark, sf_dir, "part").select("p_partkey", T.gate_bracket(F.col("p_size")).alias("bracket"), T.divergence_flag(F.col("p_size"), F.col("p_partkey") % 9).alias("flag"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_name || ' (see 4.5)' ELSE p_name END AS text, CASE WHEN p_size % 2 = 0 THEN 'mg/kg' END AS unit, CASE WHEN p_size % 2 = 0 THEN p_name || ' (mg/kg)' WHEN p_size % 3 = 0 THEN p_name || ' (see 4.5)' ELSE p_name END AS cell FROM part""")
def parse_header(spark, sf_dir):
    """Units in the headers of table columns, and headers put together again."""
    s = F.col("p_size")
    raw = F.when(s % 2 == 0, F.concat("p_name", F.lit(" (mg/kg)"))).when(s % 3 == 0, F.concat("p_name", F.lit(" (see 4.5)"))).otherwise(F.col("p_name"))
    h = chunking.parse_header(raw)
    return table(spark, sf_dir, "part").select("p_partkey", h["text"].alias("text"), h["unit"].alias("unit"), chunking.header_cell(h).alias("cell"))


# ---- documents: an order is a document, its line numbers are pages, its lines are blocks

_BLOCKS = """
bl AS (SELECT l_orderkey AS doc, l_linenumber - 1 AS page, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos, l_partkey % 5 + 8 AS font, l_returnflag = 'R' AS bold, l_quantity * 2 AS top,
  ['Synopsis', 'Appendix', 'Study Objectives', 'plain words of a page', 'Version ' || (l_suppkey % 4), '2. Statistical Methods and so on'][l_partkey % 6 + 1] AS text FROM lineitem)"""


def _blocks(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    s = F.array(F.lit("Synopsis"), F.lit("Appendix"), F.lit("Study Objectives"), F.lit("plain words of a page"), F.concat(F.lit("Version "), (F.col("l_suppkey") % 4).cast("string")), F.lit("2. Statistical Methods and so on"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), _key("l_orderkey").alias("nct_id"), (F.col("l_linenumber") - 1).alias("page"), (F.row_number().over(order) - 1).alias("pos"), F.element_at(s, (F.col("l_partkey") % 6 + 1).cast("int")).alias("text"),
        (F.col("l_partkey") % 5 + 8).cast("double").alias("font_size"), (F.col("l_returnflag") == "R").alias("bold"), F.lit(100.0).alias("page_height"), (F.col("l_quantity") * 2.0).alias("top"), (F.col("l_quantity") * 2.0 + 1).alias("bottom"),
    )


_BODY = "bo AS (SELECT doc, font AS body FROM (SELECT doc, font, row_number() OVER (PARTITION BY doc ORDER BY n DESC, f) AS rn FROM (SELECT doc, font, count(*) AS n, min(page * 1000 + pos) AS f FROM bl GROUP BY 1, 2)) WHERE rn = 1)"
_SECTIONS = f"""{_BLOCKS}, {_BODY}, tot AS (SELECT doc, max(page) + 1 AS total FROM bl GROUP BY 1),
mk AS (SELECT doc, page, pos, text, CASE text WHEN 'Synopsis' THEN 'synopsis' WHEN 'Study Objectives' THEN 'objectives' WHEN '2. Statistical Methods and so on' THEN 'statistics' ELSE 'unclassified' END AS label FROM bl JOIN bo USING (doc) WHERE bold OR font > 1.15 * body),
se AS (SELECT doc, label, text AS heading, 'regex' AS method, page AS s, greatest(page, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY page, pos), total) - 1) AS e, pos FROM mk JOIN tot USING (doc)
  UNION ALL SELECT doc, 'unclassified', NULL, 'unmatched', 0, min(page) - 1, NULL FROM mk GROUP BY doc HAVING min(page) > 0
  UNION ALL SELECT doc, 'unclassified', NULL, 'unmatched', 0, total - 1, NULL FROM tot WHERE doc NOT IN (SELECT doc FROM mk)),
sn AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY s, pos NULLS FIRST) - 1 AS section_pos FROM se)"""


@query(f"WITH {_BLOCKS}, {_BODY} SELECT doc, body::DOUBLE AS body FROM bo")
def body_font_sizes(spark, sf_dir):
    """The most frequent font size of every document, the first met on ties."""
    return documents.body_font_sizes(_blocks(spark, sf_dir))


@query(f"WITH {_SECTIONS} SELECT doc, section_pos::INT AS section_pos, label, heading, method, s::INT AS range_start, e::INT AS range_end FROM sn")
def document_sections(spark, sf_dir):
    """Sections by headings in bold or large type."""
    return documents.sections(_blocks(spark, sf_dir))


@query(f"WITH {_SECTIONS} SELECT count(*)::BIGINT AS documents, count(*) FILTER (n)::BIGINT AS detected, round_even(100.0::DOUBLE * count(*) FILTER (n) / count(*), 1) AS rate FROM (SELECT doc, bool_or(label <> 'unclassified') AS n FROM sn GROUP BY doc)")
def section_detection(spark, sf_dir):
    return documents.detection(documents.sections(_blocks(spark, sf_dir)))


def _with_trial(sections: DataFrame) -> DataFrame:
    return sections.withColumn("nct_id", (F.col("doc") % 100).cast("string"))


def _sponsors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey < 80").select(F.col("c_custkey").cast("string").alias("nct_id"), F.col("c_name").alias("sponsor_name"), F.col("c_mktsegment").alias("sponsor_class"))


@query(f"""WITH {_SECTIONS} SELECT doc, (doc % 100)::VARCHAR AS nct_id, coalesce(c_name, 'UNKNOWN') AS sponsor_name, coalesce(c_mktsegment, 'UNKNOWN') AS sponsor_class
FROM (SELECT doc FROM sn GROUP BY doc HAVING NOT bool_or(label <> 'unclassified')) LEFT JOIN customer ON c_custkey = doc % 100 AND c_custkey < 80""")
def detection_failures(spark, sf_dir):
    """Documents without a named section, with their sponsor."""
    return documents.detection_failures(_with_trial(documents.sections(_blocks(spark, sf_dir))), _sponsors(spark, sf_dir)).select("doc", "nct_id", "sponsor_name", "sponsor_class")


@query(f"""WITH {_SECTIONS} SELECT coalesce(c_mktsegment, 'UNKNOWN') AS sponsor_class, count(*)::BIGINT AS documents, count(*) FILTER (n)::BIGINT AS detected, round_even(100.0::DOUBLE * count(*) FILTER (n) / count(*), 1) AS rate
FROM (SELECT doc, bool_or(label <> 'unclassified') AS n FROM sn GROUP BY doc) LEFT JOIN customer ON c_custkey = doc % 100 AND c_custkey < 80 GROUP BY 1""")
def detection_by_sponsor_class(spark, sf_dir):
    return reports.detection_by_sponsor_class(_with_trial(documents.sections(_blocks(spark, sf_dir))), _sponsors(spark, sf_dir))


@query(f"""WITH {_SECTIONS}, d AS (SELECT doc, CASE WHEN NOT bool_or(label <> 'unclassified') THEN 'zero' WHEN bool_and(label <> 'unclassified') THEN 'full' ELSE 'partial' END AS depth FROM sn GROUP BY doc)
SELECT depth, count(*)::BIGINT AS documents, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM d), 1) AS pct FROM d GROUP BY depth""")
def depth_split(spark, sf_dir):
    return reports.depth_split(documents.sections(_blocks(spark, sf_dir)))


_TIMELINE = f"""{_BLOCKS},
ma AS (SELECT doc, page, max(v) AS v FROM (SELECT doc, page, first_value(CASE WHEN text LIKE 'Version %' AND (top < 12 OR top > 88) THEN substr(text, 9)::DOUBLE END IGNORE NULLS) OVER (PARTITION BY doc, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM bl) GROUP BY 1, 2),
ru AS (SELECT *, sum(f) OVER (PARTITION BY doc ORDER BY page) AS run FROM (SELECT *, CASE WHEN row_number() OVER w > 1 AND v IS NOT DISTINCT FROM lag(v) OVER w THEN 0 ELSE 1 END AS f FROM ma WINDOW w AS (PARTITION BY doc ORDER BY page))),
ti AS (SELECT doc, run, any_value(v) AS version, min(page) AS s, max(page) AS e FROM ru GROUP BY doc, run)"""


@query(f"WITH {_TIMELINE} SELECT doc, run::BIGINT AS run, version, s::INT AS range_start, e::INT AS range_end, coalesce(version < max(version) OVER (PARTITION BY doc), false) AS superseded FROM ti")
def version_timeline(spark, sf_dir):
    """Runs of pages of one version, by markers in their top and bottom bands."""
    return documents.version_timeline(documents.page_markers(_blocks(spark, sf_dir))).drop("date")


@query(f"""WITH {_TIMELINE}, c AS (SELECT doc, sum(CASE WHEN version IS NOT NULL THEN e - s + 1 ELSE 0 END) / sum(e - s + 1) AS coverage FROM ti GROUP BY doc) SELECT doc, round(coverage, 6) AS coverage, coverage < 0.5 AS low FROM c""")
def version_coverage(spark, sf_dir):
    c = documents.coverage(documents.version_timeline(documents.page_markers(_blocks(spark, sf_dir))))
    return c.select("doc", F.round("coverage", 6).alias("coverage"), "low")


@query(f"""WITH {_TIMELINE}, d AS (SELECT doc, max(version) AS v FROM ti GROUP BY doc), r AS (SELECT user_id, min(event_id % 4) AS low, max(event_id % 3) AS high FROM events GROUP BY 1)
SELECT doc, v AS doc_version, CASE WHEN v IS NULL OR low IS NULL THEN 'unresolvable' WHEN v BETWEEN low AND high THEN 'agreement' ELSE 'mismatch' END AS status FROM d LEFT JOIN r ON user_id = doc % 100 AND low <= high""")
def reconcile_versions(spark, sf_dir):
    """Greatest version of every document against the range of versions that its trial has in the registry."""
    t = _with_trial(documents.version_timeline(documents.page_markers(_blocks(spark, sf_dir))))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.col("event_id") % 4).alias("low"), F.max(F.col("event_id") % 3).alias("high"))
    registry = e.where("low <= high").select(F.col("user_id").cast("string").alias("nct_id"), F.explode(F.array(F.col("low").cast("double"), F.col("high").cast("double"))).alias("version"))
    return documents.reconcile(t, registry).select("doc", "doc_version", "status")


@query("""WITH p AS (SELECT o_custkey AS doc, CASE WHEN o_orderstatus = 'F' THEN 'born_digital' WHEN o_orderkey % 2 = 0 THEN 'scanned' ELSE 'blank_or_vector' END AS c FROM orders)
SELECT doc, count(*)::BIGINT AS pages, count(*) FILTER (c = 'born_digital')::BIGINT AS born_digital, count(*) FILTER (c = 'scanned')::BIGINT AS scanned, count(*) FILTER (c = 'blank_or_vector')::BIGINT AS blank_or_vector,
 round_even(100.0::DOUBLE * count(*) FILTER (c = 'scanned') / count(*), 2) AS scanned_pct, CASE WHEN count(*) FILTER (c = 'scanned') = 0 THEN 'born_digital' WHEN count(*) FILTER (c = 'scanned') = count(*) THEN 'scanned' ELSE 'mixed' END AS doc_class FROM p GROUP BY doc""")
def classify_documents(spark, sf_dir):
    """Classes of pages and documents: 40 characters of text are born digital, an image without them a scan."""
    return documents.classify_documents(_pages(spark, sf_dir), ["doc"])


def _pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderstatus") == "F", F.repeat(F.lit("x"), 40)).otherwise(F.lit(" " * 50 + "short")).alias("text"), F.when(F.col("o_orderkey") % 2 == 0, 1).alias("n_images"))


@query("""WITH p AS (SELECT o_custkey AS doc, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 2 = 0) AS s FROM orders GROUP BY 1)
SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS pages, round_even(100.0::DOUBLE * sum(s) / sum(n), 2) AS scanned_pct, count(*) FILTER (s = 0)::BIGINT AS born_digital_documents, count(*) FILTER (s = n)::BIGINT AS scanned_documents, count(*) FILTER (s > 0 AND s < n)::BIGINT AS mixed_documents FROM p""")
def classify_corpus(spark, sf_dir):
    return documents.classify_corpus(documents.classify_documents(_pages(spark, sf_dir), ["doc"]))


@query("WITH p AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey) SELECT min(n)::BIGINT AS min, median(n)::DOUBLE AS median, round_even(avg(n), 1) AS mean, max(n)::BIGINT AS max FROM p")
def page_distribution(spark, sf_dir):
    return reports.page_distribution(documents.classify_documents(_pages(spark, sf_dir), ["doc"]))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount <= 0.05 AND l_quantity BETWEEN 6 AND 40 AND l_partkey % 60 >= 20 AND l_suppkey % 10 >= 1 AND l_suppkey % 10 * 10 + l_quantity <= 90 AS redacted FROM lineitem""")
def redaction_boxes(spark, sf_dir):
    """Dark boxes of the size of a line of text, away from the margins."""
    l = table(spark, sf_dir, "lineitem")
    top = (F.col("l_suppkey") % 10 * 10).cast("double")
    box = F.struct(F.when(F.col("l_discount") <= 0.05, F.array(F.lit(0.0), F.lit(0.1))).otherwise(F.array(F.lit(0.9), F.lit(1.0))).alias("fill"), F.lit(0.0).alias("x0"), (F.col("l_partkey") % 60).cast("double").alias("x1"), top.alias("y0"), (top + F.col("l_quantity")).alias("y1"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", documents.redaction_candidate(box, F.lit(100.0)).alias("redacted"))


# ---- tables: an order is a table, its lines are cells

_CELLS = "ce AS (SELECT l_orderkey AS t, l_partkey, l_suppkey, l_extendedprice, (l_partkey % 4) * 10 AS x0, (l_partkey % 4 + 1 + l_suppkey % 2) * 10 AS x1, (l_linenumber % 3) * 10 AS y0, (l_linenumber % 3 + 1) * 10 AS y1 FROM lineitem)"


@query(f"""WITH {_CELLS}, ex AS (SELECT t, e, row_number() OVER (PARTITION BY t ORDER BY e) - 1 AS n FROM (SELECT t, x0 AS e FROM ce UNION SELECT t, x1 FROM ce)), ey AS (SELECT t, e, row_number() OVER (PARTITION BY t ORDER BY e) - 1 AS n FROM (SELECT t, y0 AS e FROM ce UNION SELECT t, y1 FROM ce))
SELECT ce.t, l_partkey, l_suppkey, l_extendedprice, a.n::INT AS col, (b.n - a.n)::INT AS col_span, c.n::INT AS row, (d.n - c.n)::INT AS row_span FROM ce JOIN ex a ON a.t = ce.t AND a.e = x0 JOIN ex b ON b.t = ce.t AND b.e = x1 JOIN ey c ON c.t = ce.t AND c.e = y0 JOIN ey d ON d.t = ce.t AND d.e = y1""")
def cell_spans(spark, sf_dir):
    """Rows and columns of cells, and how many of each they span, from their rectangles."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    d = lambda c: (c * 10 + 0.2).cast("double")
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("t"), "l_partkey", "l_suppkey", "l_extendedprice", d(p % 4).alias("x0"), d(p % 4 + 1 + s % 2).alias("x1"), d(n % 3).alias("y0"), d(n % 3 + 1).alias("y1"))
    return documents.cell_spans(c, ["t"]).select("t", "l_partkey", "l_suppkey", "l_extendedprice", "col", "col_span", "row", "row_span")


_TABLES = """
tb AS (SELECT user_id AS doc, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS table_pos, (event_id // 50) AS page_start, (event_id // 50) + event_id % 2 AS page_end, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'Table 1 (continued)' ELSE 'Table ' || (event_id % 3) END AS caption,
  CASE WHEN event_type IN ('view', 'click') THEN 'A' WHEN event_type = 'purchase' THEN 'B' END AS h FROM events)"""


def _tables(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    page = F.floor(F.col("event_id") / 50).cast("int")
    name = F.when(F.col("event_type").isin("view", "click"), "A").when(F.col("event_type") == "purchase", "B")
    headers = F.when(name.isNotNull(), F.array(F.struct(name.alias("text"), F.lit(None).cast("string").alias("unit")))).otherwise(F.array().cast("array<struct<text:string,unit:string>>"))
    caption = F.when(F.col("event_type") == "view", "Table 1 (continued)").when(F.col("event_type") != "error", F.concat(F.lit("Table "), (F.col("event_id") % 3).cast("string")))
    return e.select(
        F.col("user_id").alias("doc"), "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("table_pos"), page.alias("page_start"), (page + F.col("event_id") % 2).cast("int").alias("page_end"), caption.alias("caption"), headers.alias("headers"),
        F.array(F.array(F.struct(F.lit(0).alias("col"), F.col("event_id").cast("string").alias("text")))).alias("rows"), F.lit("unclassified").alias("source_section"),
    )


@query(f"""WITH {_TABLES} SELECT doc, event_id, CASE WHEN h IS NOT NULL THEN h WHEN caption IS NULL THEN NULL ELSE last_value(h IGNORE NULLS) OVER (PARTITION BY doc, caption ORDER BY page_start, table_pos ROWS UNBOUNDED PRECEDING) END AS header FROM tb""")
def propagate_headers(spark, sf_dir):
    """Tables without headers take those of the last one with their caption."""
    return documents.propagate_headers(_tables(spark, sf_dir)).select("doc", "event_id", F.get("headers", F.lit(0))["text"].alias("header"))


_LOGICAL = f"""{_TABLES},
lo AS (SELECT *, sum(CASE WHEN h IS NOT NULL AND h IS NOT DISTINCT FROM ph AND (page_start = pe + 1 OR coalesce(caption LIKE '%(continued)%', false)) THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page_start, table_pos ROWS UNBOUNDED PRECEDING) AS logical_pos
  FROM (SELECT *, lag(h) OVER w AS ph, lag(page_end) OVER w AS pe FROM tb WINDOW w AS (PARTITION BY doc ORDER BY page_start, table_pos)))"""


@query(f"WITH {_LOGICAL} SELECT doc, logical_pos::BIGINT AS logical_pos, min_by(coalesce(caption, ''), page_start * 100000 + table_pos) AS caption, string_agg(event_id::VARCHAR, ',' ORDER BY page_start, table_pos) AS rows, min(page_start)::INT AS page_start, max(page_end)::INT AS page_end, count(*)::BIGINT AS raw_tables FROM lo GROUP BY doc, logical_pos")
def reassembled_tables(spark, sf_dir):
    """Continued tables put together, with their rows in order."""
    r = documents.reassembled(_tables(spark, sf_dir))
    return r.select("doc", "logical_pos", F.coalesce("caption", F.lit("")).alias("caption"), F.array_join(F.transform("rows", lambda x: x[0]["text"]), ",").alias("rows"), "page_start", "page_end", "raw_tables")


@query(f"WITH {_LOGICAL} SELECT (SELECT count(*) FROM tb)::BIGINT AS raw, count(DISTINCT (doc, logical_pos))::BIGINT AS logical, ((SELECT count(*) FROM tb) - count(DISTINCT (doc, logical_pos)))::BIGINT AS collapsed FROM lo")
def table_stats(spark, sf_dir):
    raw = _tables(spark, sf_dir)
    return reports.table_stats(raw, documents.reassembled(raw))


@query(f"""WITH {_TABLES}, cb AS (SELECT user_id AS doc, event_id // 50 AS page, value AS bottom, 'Figure ' || event_id AS above FROM events WHERE event_type = 'signup')
SELECT doc, event_id, coalesce(caption, (SELECT max_by(above, bottom) FROM cb WHERE cb.doc = tb.doc AND cb.page = tb.page_start AND bottom <= tb.event_id % 200)) AS caption FROM tb""")
def table_captions(spark, sf_dir):
    """A missing caption is the nearest caption above the table on its page."""
    t = _tables(spark, sf_dir).withColumn("page", F.col("page_start")).withColumn("top", (F.col("event_id") % 200).cast("double"))
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    b = e.select(F.col("user_id").alias("doc"), F.floor(F.col("event_id") / 50).cast("int").alias("page"), F.concat(F.lit(" Figure "), F.col("event_id").cast("string")).alias("text"), F.col("value").alias("bottom"))
    b = b.withColumn("text", F.trim("text"))
    return documents.captions(t, b).select("doc", "event_id", "caption")


@query(f"""WITH {_TABLES}, s AS (SELECT user_id AS doc, event_type AS label, min(event_id) // 50 AS s0, max(event_id) // 50 AS s1, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS section_pos FROM events GROUP BY 1, 2)
SELECT doc, event_id, coalesce((SELECT min_by(label, section_pos) FROM s WHERE s.doc = tb.doc AND page_start <= s1 AND s0 <= page_end), 'unclassified') AS source_section FROM tb""")
def table_sections(spark, sf_dir):
    """The first section that overlaps a table's pages."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc"), F.col("event_type").alias("label")).agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    page = lambda c: F.floor(F.col(c) / 50).cast("int")
    s = e.select("doc", "label", page("a").alias("range_start"), page("b").alias("range_end"), F.row_number().over(Window.partitionBy("doc").orderBy("a")).alias("section_pos"))
    return documents.source_sections(_tables(spark, sf_dir).drop("source_section"), s).select("doc", "event_id", "source_section")


# ---- chunks


@query("""WITH RECURSIVE r AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, 'order ' || o_orderkey || ' | ' || o_orderpriority AS line FROM orders),
c AS (SELECT *, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) AS n FROM r),
f(k, i, g, used) AS (SELECT k, i, 0, n FROM c WHERE i = 1 UNION ALL SELECT c.k, c.i, CASE WHEN f.used + c.n > 14 THEN f.g + 1 ELSE f.g END, CASE WHEN f.used + c.n > 14 THEN c.n ELSE f.used + c.n END FROM f JOIN c ON c.k = f.k AND c.i = f.i + 1)
SELECT f.k, g::INT AS part, sha256('Orders of ' || f.k || chr(10) || 'Id (no) | Priority' || chr(10) || string_agg(line, chr(10) ORDER BY i)) AS text_key FROM f JOIN c USING (k, i) GROUP BY f.k, g""")
def table_chunks(spark, sf_dir):
    """Tables of orders split by rows; caption and header stand in every part and count in its budget."""
    cell = lambda i, c: F.struct(F.lit(i).alias("col"), c.alias("text"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.struct("o_orderkey", F.array(cell(0, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))), cell(1, F.col("o_orderpriority"))).alias("r")).alias("x"))
    t = o.groupBy("k").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("rows"))
    head = F.array(F.struct(F.lit("Id").alias("text"), F.lit("no").alias("unit")), F.struct(F.lit("Priority").alias("text"), F.lit(None).cast("string").alias("unit")))
    t = t.withColumn("caption", F.concat(F.lit("Orders of "), F.col("k").cast("string"))).withColumn("headers", head).withColumn("n_cols", F.lit(2))
    # the header has 7 tokens, so 14 are left for rows
    return chunking.table_chunks(t, ["k"], 21).select("k", "part", F.sha2("text", 256).alias("text_key"))


@query(f"""WITH {_SECTIONS},
inn AS (SELECT bl.doc, section_pos, label, page, bl.pos, bl.text FROM bl JOIN sn ON sn.doc = bl.doc AND page BETWEEN s AND e),
ve AS (SELECT doc, page::INT AS page, min(substr(text, 9)::DOUBLE) AS v FROM bl WHERE text LIKE 'Version %' GROUP BY 1, 2),
ck AS (SELECT doc, section_pos, label, min(page) AS p0, max(page) AS p1, string_agg(text, chr(10) ORDER BY page, pos) AS body FROM inn GROUP BY 1, 2, 3),
vv AS (SELECT doc, section_pos, min_by(v, ve.page) AS v FROM ck JOIN ve USING (doc) WHERE p0 <= ve.page AND ve.page <= p1 GROUP BY 1, 2)
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY section_pos) - 1)::INT AS chunk_index, 'text' AS chunk_type, label AS section, v AS version, p0::INT AS page_start, p1::INT AS page_end, p0 = 0 AS is_ocr,
 sha256('[' || {_KEY.format('doc')} || ' | protocol v' || coalesce(v::INT::VARCHAR, '?') || ' | ' || label || ']' || chr(10) || body) AS text_key FROM ck LEFT JOIN vv USING (doc, section_pos)""")
def chunk_documents(spark, sf_dir):
    """Chunks of every document: its sections' text with version, pages and context header; first pages are from OCR."""
    b = _blocks(spark, sf_dir)
    blocks = b.select("doc", "nct_id", F.lit("protocol").alias("doc_type"), "page", "pos", "text", (F.col("page") == 0).alias("needs_ocr"))
    versions = b.where("text LIKE 'Version %'").groupBy("doc", F.col("page").alias("range_start")).agg(F.min(F.substring("text", 9, 9).cast("double")).alias("version")).withColumn("range_end", F.col("range_start"))
    tables = spark.createDataFrame([], "doc long, table_pos int, caption string, headers array<struct<text:string,unit:string>>, rows array<array<struct<col:int,text:string>>>, n_cols int, range_start int, range_end int")
    out = chunking.chunk_documents(blocks, documents.sections(b), tables, versions, budget=1 << 20)
    return out.select("doc", "chunk_index", "chunk_type", "section", "version", "page_start", "page_end", "is_ocr", F.sha2("text", 256).alias("text_key"))


_CHUNK_ROWS = "cr AS (SELECT o_orderkey, 'NCT' || o_custkey AS nct_id, o_custkey AS doc, CASE o_orderstatus WHEN 'F' THEN 'text' WHEN 'O' THEN 'table' ELSE 'assessment_schedule' END AS chunk_type, o_orderkey % 5 = 0 AS is_ocr FROM orders)"


def _chunk_rows(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "text").when(F.col("o_orderstatus") == "O", "table").otherwise("assessment_schedule")
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        embedding.chunk_id(F.concat(F.lit("NCT"), F.col("o_custkey").cast("string")), F.lit("protocol"), n).alias("chunk_id"), F.concat(F.lit("NCT"), F.col("o_custkey").cast("string")).alias("nct_id"), F.col("o_custkey").alias("doc"), kind.alias("chunk_type"),
        (n % 5 == 0).alias("is_ocr"), n.alias("chunk_index"), F.when(n % 11 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("text"), F.lit(3).alias("page_start"), F.when(n % 13 == 0, 2).otherwise(4).alias("page_end"),
    )


@query(f"""WITH {_CHUNK_ROWS}, d AS (SELECT doc, count(*) AS n, count(*) FILTER (chunk_type = 'text') AS a, count(*) FILTER (chunk_type = 'table') AS b, count(*) FILTER (chunk_type = 'assessment_schedule') AS c, count(*) FILTER (is_ocr) AS o FROM cr GROUP BY doc)
SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS chunks, round_even(avg(n), 1) AS mean, median(n)::DOUBLE AS median, sum(a)::BIGINT AS text, sum(b)::BIGINT AS "table", sum(c)::BIGINT AS assessment_schedule, sum(o)::BIGINT AS ocr FROM d""")
def chunk_stats(spark, sf_dir):
    return reports.chunk_stats(_chunk_rows(spark, sf_dir))


@query("""SELECT 'NCT' || o_custkey || ':protocol:' || o_orderkey AS chunk_id, CASE WHEN o_orderkey % 11 = 0 THEN 'empty text' WHEN o_orderkey % 13 = 0 THEN 'page range out of order' END AS error FROM orders""")
def valid_chunks(spark, sf_dir):
    """Chunks that hold to the schema, and the others with what is wrong."""
    good, bad = embedding.valid_chunks(_chunk_rows(spark, sf_dir))
    return good.select("chunk_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("chunk_id", "error"))


@query("""SELECT 'NCT' || o_custkey || ':protocol:' || o_orderkey AS chunk_id, sha256('r1' || 'NCT' || o_custkey || ':protocol:' || o_orderkey || o_orderpriority) AS cache_key, o_orderkey % 2 = 0 AS from_cache FROM orders WHERE o_orderkey % 11 > 0""")
def embedding_cache(spark, sf_dir):
    """Vectors from the cache where revision, id and text are as they were: the even chunks; the odd ones had another text."""
    c = _chunk_rows(spark, sf_dir)
    old = c.withColumn("text", F.when(F.col("chunk_index") % 2 == 1, F.concat("text", F.lit(" then"))).otherwise(F.col("text")))
    cache = embedding.embedded(old, None, models.hash_embedding, "r1").select("chunk_id", "cache_key", "embedding")
    return embedding.embedded(c, cache, models.hash_embedding, "r1").select("chunk_id", "cache_key", "from_cache")


@query("""SELECT count(*) FILTER (o_custkey % 2 = 0)::BIGINT AS loaded, count(*) FILTER (o_custkey % 2 = 0 AND o_orderkey % 3 = 0)::BIGINT AS missing_embedding, count(*) FILTER (o_custkey % 2 = 1)::BIGINT AS skipped FROM orders""")
def load_chunks(spark, sf_dir):
    """Counts of loading chunks: those of unknown trials are skipped, those without a vector are loaded without it."""
    c = _chunk_rows(spark, sf_dir)
    vectors = c.where("chunk_index % 3 > 0").select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    known = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.concat(F.lit("NCT"), F.col("o_custkey").cast("string")).alias("nct_id")).distinct()
    return embedding.loaded(None, c, vectors, known)[1]


@query("""SELECT count(*)::BIGINT AS pages, count(DISTINCT (o_custkey, o_orderstatus))::BIGINT AS documents FROM orders WHERE o_orderkey % 5 = 0""")
def ocr_backlog(spark, sf_dir):
    """Pages that need OCR, and the documents that they are in."""
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("nct_id"), F.col("o_orderstatus").alias("doc_type"), F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 5 == 0).alias("needs_ocr"))
    return reports.ocr_backlog(documents.pages_needing_ocr(p))


_NORMAL_WORDS = r"list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(f"""WITH ch AS (SELECT vec_id, embedding, {_NORMAL_WORDS.format("text")} AS w FROM embeddings JOIN documents ON doc_id = vec_id),
d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_distinct(q.w) AS qw, e.w AS ew, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, e.vec_id) AS rank FROM ch e, ch q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 50),
s AS (SELECT query_id, id, rank, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, ew)) / len(qw) ELSE 0 END AS score FROM d)
SELECT query_id, id AS chunk_id, round(score, 9) AS score, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, id) AS n FROM s) WHERE n <= 8""")
def rerank_candidates(spark, sf_dir):
    """Of the fifty chunks nearest to every query of the stated set, the eight best by the stand-in reranker, which reads the texts."""
    chunks = _chunks(spark, sf_dir)
    q = chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("text").alias("query_text"))
    found = retrieval.dense_search(chunks, q, 50)
    texts = found.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "text"), "chunk_id")
    return retrieval.rerank(texts, q, models.overlap_score).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH ch AS (SELECT vec_id, embedding, sha256(text) AS text_key FROM embeddings JOIN documents ON doc_id = vec_id)
SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, e.vec_id)::INT AS rank, e.text_key FROM ch e, ch q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5""")
def fetch_ranked(spark, sf_dir):
    """Texts of the five chunks nearest to every query of the stated set."""
    chunks = _chunks(spark, sf_dir)
    found = retrieval.fetch(chunks, retrieval.dense_search(chunks, _asked(chunks), 5))
    return found.select("query_id", "chunk_id", "rank", F.sha2("text", 256).alias("text_key"))
