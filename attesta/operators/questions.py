"""Question sets made from the tables: single-fact (T1), cross-source (T3), amendments (T4), unanswerable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .facts import outcome_amendments
from .relational import priority_union, seeded_order

# Readable phases, question texts and ids, answers.
PHASES = {"EARLY_PHASE1": "Early Phase 1", "PHASE1": "Phase 1", "PHASE2": "Phase 2", "PHASE3": "Phase 3", "PHASE4": "Phase 4", "NA": "N/A"}
FUZZY, FUZZY_CHARS, MOST_GOLD = 85, 6, 30
T1_TEXTS = {
    "enrollment_count": "What is the target enrollment for {}?",
    "phase": "What phase is the {} trial?",
    "sponsor": "Who is the sponsor of {}?",
    "min_age": "What is the minimum age for participants in {}?",
    "max_age": "What is the maximum age for participants in {}?",
    "primary_outcome_measure": "What is primary outcome # for {}?",
    "primary_outcome_timeframe": "What is the timeframe for primary outcome # of {}?",
    "arm_label": "What is the label of arm # in {}?",
}
T3_TEXTS = {
    "current_vs_protocol": "Does the protocol's stated primary endpoint for {} match the current registry record?",
    "first_posted_vs_current": "Does the current registry record for {} match what was first posted?",
    "registry_vs_results": "Do the reported results for {} match the registered primary outcome?",
}
T4_TEXTS = {
    "changed_when_what": "Was the primary outcome changed after first posting for {}? When, and to what?",
    "revision_count": "How many revisions touched the primary outcome for {}?",
    "first_registered": "What was the primary outcome as first registered for {}?",
}
T4_NEVER = "No, the primary outcome was not changed after first posting."
ADVERSARIAL_TEXTS = {
    "unposted_document": (
        "What does the statistical analysis plan specify for handling missing data in {}?",
        "What multiplicity adjustment method does the statistical analysis plan use for {}?",
        "According to the statistical analysis plan for {}, what is the primary analysis population (ITT, per-protocol, or other)?",
        "What sensitivity analyses does the statistical analysis plan specify for {}?",
        "What is the pre-specified Type I error allocation across endpoints in the statistical analysis plan for {}?",
    ),
    "fact_not_in_corpus": (
        "What is the manufacturing lot number of the study drug used in {}?",
        "What brand of laptop computer did site staff use to enter data for {}?",
        "What is the personal cell phone number of the principal investigator for {}?",
        "What is the color of the packaging box used to ship the study drug for {}?",
        "How many parking spaces are available at the primary study site for {}?",
        "What is the home address of the study's biostatistician for {}?",
        "What software version of Microsoft Excel was used to create the case report forms for {}?",
        "What was the weather like on the day the first patient was enrolled in {}?",
    ),
}


def _filled(template: str, value: Column, number: Column | None = None) -> Column:
    """The template with ``value`` in place of ``{}`` and ``number`` in place of ``#``."""
    text = F.replace(F.lit(template), F.lit("{}"), value)
    return text if number is None else F.replace(text, F.lit("#"), number.cast("string"))


def _numbered(rows: DataFrame, tier: str) -> DataFrame:
    """Question ids ``trial:template:n`` count the answers that are not empty, from 0, per trial and template; texts keep the number the source had."""
    kept = rows.where(F.trim(F.coalesce("gold_answer", F.lit(""))) != "")
    n = F.row_number().over(Window.partitionBy("nct_id", "template").orderBy("pos")) - 1
    return kept.select(F.concat_ws(":", "nct_id", "template", n.cast("string")).alias("question_id"), F.lit(tier).alias("tier"), "nct_id", "template", "question_text", "gold_answer")


def t1_questions(trials: DataFrame, outcomes: DataFrame, arms: DataFrame, eligibility: DataFrame) -> DataFrame:
    """One question for every fact that a trial has; of outcomes and arms the first two."""
    def facts(df, template, text, answer, pos=F.lit(1)):
        return df.select("nct_id", F.lit(template).alias("template"), text.alias("question_text"), answer.cast("string").alias("gold_answer"), pos.cast("int").alias("pos"))

    phase = F.element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), F.col("phase"))
    id_ = F.col("nct_id")
    primary = outcomes.where("source = 'registered_current' AND type = 'PRIMARY'").withColumn("pos", F.row_number().over(Window.partitionBy("nct_id").orderBy("outcome_id"))).where("pos <= 2")
    arm = arms.withColumn("pos", F.row_number().over(Window.partitionBy("nct_id").orderBy("arm_id"))).where("pos <= 2")
    text = lambda name: _filled(T1_TEXTS[name], id_, F.col("pos") if "#" in T1_TEXTS[name] else None)
    sources = {
        "enrollment_count": (trials, F.col("enrollment_count")), "phase": (trials.where(~F.contains("phase", F.lit("|"))), phase), "sponsor": (trials, F.col("sponsor_name")),
        "min_age": (eligibility, F.col("minimum_age")), "max_age": (eligibility, F.col("maximum_age")),
        "primary_outcome_measure": (primary, F.col("measure")), "primary_outcome_timeframe": (primary, F.col("time_frame")), "arm_label": (arm, F.col("label")),
    }
    parts = [facts(df, name, text(name), answer, F.col("pos") if "#" in T1_TEXTS[name] else F.lit(1)) for name, (df, answer) in sources.items()]
    return _numbered(reduce(DataFrame.unionByName, parts), "t1")


def locate_gold(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions with ``gold_chunk_ids``: chunks of the trial that hold the answer as a whole token, or that are alike in tokens for answers of six characters or more.

    The protocol's chunks count; those of the analysis plan only where the protocol has none.
    """
    q = questions.select("question_id", "nct_id", T.collapse(F.col("gold_answer")).alias("_a"))
    c = chunks.where(F.col("doc_type").isin("protocol", "sap")).select("nct_id", "doc_type", "chunk_id", T.collapse(F.col("text")).alias("_t"))
    met = q.join(c, "nct_id").withColumn("_whole", F.coalesce(T.contains_whole_token(F.col("_a"), F.col("_t")), F.lit(False)))
    # the likeness is only worked out where the whole answer isn't there
    alike = met.where(~F.col("_whole") & (F.length("_a") >= FUZZY_CHARS)).where(T.token_set_ratio(F.col("_a"), F.col("_t")) >= FUZZY)
    hits = met.where("_whole").unionByName(alike).select("question_id", "doc_type", "chunk_id")
    best = priority_union(hits.where("doc_type = 'protocol'"), hits.where("doc_type = 'sap'"), ["question_id"])
    gold = best.groupBy("question_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("gold_chunk_ids"))
    return questions.join(gold, "question_id", "left").withColumn("gold_chunk_ids", F.coalesce("gold_chunk_ids", F.array().cast("array<string>")))


def usable(located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions with 1 to 30 gold chunks, and the others with the reason."""
    n = F.size("gold_chunk_ids")
    reason = F.when(n == 0, "unlocatable").when(n > MOST_GOLD, "too_many_matches")
    return located.where(n.between(1, MOST_GOLD)), located.withColumn("reason", reason).where("reason is not null").select("question_id", "nct_id", "template", "gold_answer", "reason")


def capped(questions: DataFrame, bucket: str, order: list[str], target: int, seed: int) -> DataFrame:
    """``target`` questions, taken from the buckets in turn in the given order of buckets, in seeded order inside each."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(bucket))
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(seeded_order(seed, F.col("question_id")), "question_id"))
    return questions.withColumn("_turn", turn).where(F.col("_turn") <= target).withColumn("_place", place).orderBy("_turn", "_place").limit(target).drop("_turn", "_place")


def strata(predictions: DataFrame) -> DataFrame:
    """Per trial of ``(nct_id, verdict, retrieval_failed)``: any divergence, any failed retrieval, all clean matches. A trial may be in several."""
    return predictions.groupBy("nct_id").agg(
        F.bool_or(F.coalesce(F.col("verdict") == "divergence", F.lit(False))).alias("divergence"), F.bool_or("retrieval_failed").alias("retrieval_failed"),
        F.bool_and(F.coalesce(F.col("verdict") == "match", F.lit(False)) & ~F.col("retrieval_failed")).alias("clean_match"),
    )


def select_stratified(strata_: DataFrame, all_ids: DataFrame, n_divergence: int = 8, n_failed: int = 4, n_clean: int = 8, seed: int = 0) -> DataFrame:
    """``nct_id, stratum``: disjoint picks of divergence, then failed retrieval, then clean match, and others in place of picks that are missing."""
    wanted = n_divergence + n_failed + n_clean
    picked = None
    for flag, n in (("divergence", n_divergence), ("retrieval_failed", n_failed), ("clean_match", n_clean)):
        pool = strata_.where(F.col(flag)).select("nct_id")
        if picked is not None:
            pool = pool.join(picked, "nct_id", "left_anti")
        part = pool.orderBy(seeded_order(seed, F.lit(flag), F.col("nct_id")), "nct_id").limit(n).withColumn("stratum", F.lit(flag))
        picked = part if picked is None else picked.union(part)
    rest = all_ids.select("nct_id").distinct().join(picked, "nct_id", "left_anti").orderBy(seeded_order(seed, F.lit("rest"), F.col("nct_id")), "nct_id")
    filled = picked.withColumn("_p", F.lit(0)).union(rest.limit(wanted).select("nct_id", F.lit("rest"), F.lit(1)))
    return filled.orderBy("_p", "nct_id").limit(wanted).select("nct_id", "stratum")


def t3_questions(trials: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A question for every pair of sources of a trial that applies."""
    has = outcomes.groupBy("nct_id").agg(*[F.bool_or(F.col("source") == s).alias(s) for s in ("registered_first", "registered_current", "results_reported")])
    t = trials.select("nct_id").join(has, "nct_id", "left").na.fill(False)
    applies = {"first_posted_vs_current": F.col("registered_first"), "current_vs_protocol": F.col("registered_current"), "registry_vs_results": F.col("results_reported") & (F.col("registered_current") | F.col("registered_first"))}
    rows = F.array(*[F.when(c, F.struct(F.lit(p).alias("pair"), _filled(T3_TEXTS[p], F.col("nct_id")).alias("question_text"))) for p, c in applies.items()])
    out = t.select("nct_id", F.inline(F.filter(rows, lambda r: r.isNotNull())))
    return out.select(F.concat_ws(":", "nct_id", "pair").alias("question_id"), F.lit("t3").alias("tier"), "nct_id", "pair", "question_text")


def t4_questions(trials: DataFrame, outcomes: DataFrame, amendments: DataFrame) -> DataFrame:
    """Questions on how and when the primary outcome changed."""
    events = outcome_amendments(amendments).groupBy("nct_id").agg(F.array_sort(F.collect_list(F.struct("version", "date"))).alias("events"))
    first = lambda s: outcomes.where((F.col("source") == s) & (F.col("type") == "PRIMARY")).groupBy("nct_id").agg(F.min_by("measure", "outcome_id").alias(s))
    t = trials.select("nct_id").join(events, "nct_id", "left").join(first("registered_first"), "nct_id", "left").join(first("registered_current"), "nct_id", "left")
    n = F.when(F.col("events").isNull(), 0).otherwise(F.size("events"))
    last, current, began = F.try_element_at("events", F.lit(-1)), F.col("registered_current"), F.col("registered_first")
    at = F.concat(F.lit("at version "), last["version"].cast("string"))
    when = F.coalesce(last["date"].cast("string"), F.lit("None"))
    once = F.concat(F.lit("Yes, the primary outcome was changed, from '"), began, F.lit("' to '"), current, F.lit("', "), at, F.lit(" ("), when, F.lit(")."))
    often = F.concat(F.lit("Yes, the primary outcome was changed across "), n.cast("string"), F.lit(" revisions (most recently "), at, F.lit(", "), when, F.lit("). It now reads: '"), current, F.lit("'."))
    # without a current outcome, or a first one where both are named, there is no answer
    changed = F.when(current.isNotNull(), F.when(n == 0, T4_NEVER).when(n == 1, once).otherwise(often))
    answers = {"changed_when_what": changed, "revision_count": n.cast("string"), "first_registered": began}
    parts = [t.select("nct_id", F.lit(k).alias("template"), _filled(T4_TEXTS[k], F.col("nct_id")).alias("question_text"), a.alias("gold_answer"), F.lit(1).alias("pos")) for k, a in answers.items()]
    return _numbered(reduce(DataFrame.unionByName, parts), "t4")


def adversarial_questions(trials: DataFrame, chunks: DataFrame, target: int = 30, seed: int = 0) -> DataFrame:
    """Questions that have to be refused: half on analysis plans of trials without a chunk of one, half on facts that no document states."""
    without = trials.select("nct_id").distinct().join(chunks.where("doc_type = 'sap'").select("nct_id").distinct(), "nct_id", "left_anti")
    parts = []
    for category, pool, n in (("unposted_document", without, target // 2), ("fact_not_in_corpus", trials.select("nct_id").distinct(), target - target // 2)):
        i = F.row_number().over(Window.orderBy(seeded_order(seed, F.lit(category), F.col("nct_id")), "nct_id")) - 1
        texts = ADVERSARIAL_TEXTS[category]
        rows = pool.orderBy(seeded_order(seed, F.lit(category), F.col("nct_id")), "nct_id").limit(n).withColumn("i", i)
        text = reduce(lambda acc, k: F.when(F.pmod("i", F.lit(len(texts))) == k, _filled(texts[k], F.col("nct_id"))).otherwise(acc), range(len(texts)), F.lit(None).cast("string"))
        parts.append(rows.select(F.concat_ws(":", "nct_id", F.lit(category), F.col("i").cast("string")).alias("question_id"), "nct_id", text.alias("question_text"), F.lit(category).alias("category"), F.lit("refuse").alias("expected_behavior")))
    return parts[0].unionByName(parts[1])


def worksheet(questions: DataFrame, outcomes: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a reader needs to judge a T3 question: first primary outcome of each source, and at most eight excerpts of the protocol."""
    per = outcomes.where("type = 'PRIMARY'").groupBy("nct_id").agg(*[F.min_by(F.struct("measure", "time_frame"), F.when(F.col("source") == s, F.col("outcome_id"))).alias(s) for s in ("registered_first", "registered_current", "results_reported")])
    p = chunks.where("doc_type = 'protocol'")
    rank = F.row_number().over(Window.partitionBy("nct_id").orderBy("chunk_id"))
    excerpts = p.where(F.col("section").isin("objectives", "synopsis", "statistics")).withColumn("rn", rank).where("rn <= 8").groupBy("nct_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "section", "text"))).alias("excerpts"))
    names = p.groupBy("nct_id").agg(F.sort_array(F.collect_set("section")).alias("available_sections"))
    return questions.join(per, "nct_id", "left").join(excerpts, "nct_id", "left").join(names, "nct_id", "left")


def gold_labels(worksheet_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled rows of a filled worksheet, and minutes and number of trials in one row; a label that is none of the three is an error."""
    ok = F.col("verdict").isin("match", "divergence", "ambiguous")
    rows = worksheet_.where(F.trim(F.coalesce("verdict", F.lit(""))) != "").withColumn("verdict", F.when(ok, F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("not a verdict: "), "verdict"))))
    return rows, rows.agg(F.count(F.lit(1)).alias("labelled"), F.sum("minutes").alias("minutes"), F.countDistinct("nct_id").alias("trials"))
