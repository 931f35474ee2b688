"""Column functions over text: normal forms, durations, tokens, citations, labels."""



from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of duration in months, and the pattern of a duration.
MONTHS = {
    "year": 12.0, "years": 12.0, "yr": 12.0, "yrs": 12.0, "month": 1.0, "months": 1.0, "mo": 1.0, "mos": 1.0,
    "week": 12.0 / 52.0, "weeks": 12.0 / 52.0, "wk": 12.0 / 52.0, "wks": 12.0 / 52.0, "day": 12.0 / 365.0, "days": 12.0 / 365.0,
}
DURATION = r"\b(\d+(?:\.\d+)?)\s*(years?|yrs?|months?|mos?|weeks?|wks?|days?)\b"

# Section labels and what their headings look like, first match wins.
SECTION_LABELS = (
    ("synopsis", r"\bsynopsis\b"),
    ("background", r"\b(background|introduction|study rationale)\b"),
    ("objectives", r"\b(study objectives?|objectives?)\b"),
    ("study_design", r"\b(investigational plan|study design|trial design|overview of study design)\b"),
    ("eligibility", r"\b(population|eligibility|inclusion criteria|exclusion criteria|patient eligibility|subject eligibility)\b"),
    ("interventions", r"\b(study drugs?|study treatments?|treatment regimen|treatment|arms? and interventions?|investigational product)\b"),
    ("assessment_schedule", r"\b(visit schedule|study assessments?( and procedures)?|study procedures|study activities|schedule of (assessments|activities|events)|assessment schedule|time and events schedule)\b"),
    ("statistics", r"\b(statistical (considerations|methods|analysis|analyses)|data analysis|planned statistical methods|sample size)\b"),
    ("ethics", r"\b(ethical considerations|ethics committee|informed consent|institutional review board|independent ethics committee)\b"),
    ("administrative", r"\b(administrative (considerations|information)|study management|record retention|data handling|publication policy|quality (control|assurance))\b"),
)
UNCLASSIFIED = "unclassified"
REFUSAL = "NOT_ANSWERABLE"
CONTINUED = r"(?i)\(\s*cont(?:'d|inued)?\.?\s*\)"
UNIT = r"\(([A-Za-z0-9/%°µ]{1,10})\)\s*$"


def normalize_text(text: Column) -> Column:
    """Lower case, punctuation deleted, white space collapsed and trimmed."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def collapse(text: Column) -> Column:
    """Lower case and collapsed white space; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def quoted(text: Column) -> Column:
    """``text`` as a regular expression that matches it literally."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1")


def contains_whole_token(needle: Column, haystack: Column) -> Column:
    """Whether ``needle`` stands in ``haystack`` between word boundaries; an empty needle never does."""
    pattern = F.concat(F.lit(r"(?U)\b"), quoted(needle), F.lit(r"\b"))
    return F.when(F.length(needle) > 0, F.regexp_like(haystack, pattern)).otherwise(F.lit(False))


def tokens(text: Column) -> Column:
    """White-space tokens; none for an empty text."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " "), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def _months_of(unit: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), unit)


def durations_in_months(text: Column) -> Column:
    """Distinct durations of a text in months, rounded to two places, in rising order."""
    low = F.lower(text)
    found = F.regexp_extract_all(low, F.lit(DURATION), F.lit(0))
    months = F.transform(found, lambda m: F.bround(F.regexp_extract(m, DURATION, 1).cast("double") * _months_of(F.regexp_extract(m, DURATION, 2)), 2))
    return F.array_sort(F.array_distinct(months))


def strip_durations(text: Column) -> Column:
    """The text without its durations; unlike their extraction this minds the case of units."""
    return F.regexp_replace(text, DURATION, "")


def timeframe_in_months(text: Column) -> Column:
    """The one duration of a text; null where it has none or several."""
    found = durations_in_months(text)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def section_label(heading: Column) -> Column:
    """Label of a heading, null where none fits."""
    return F.coalesce(*[F.when(heading.rlike("(?i)" + p), F.lit(label)) for label, p in SECTION_LABELS])


def is_refusal(text: Column) -> Column:
    """Whether a response is the refusal token alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "") == REFUSAL


def citations(response: Column, ids: Column) -> Column:
    """Ids cited by ``[n]`` (from 1), in order of first mention; numbers out of range are left out."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(response, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int")))
    valid = F.filter(numbers, lambda n: n.isNotNull() & (n >= 1) & (n <= F.size(ids)))
    return F.transform(valid, lambda n: F.element_at(ids, n))


def snippet(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def escape_cell(value: Column) -> Column:
    return F.replace(value, F.lit("|"), F.lit(r"\|"))


def page_class(text: Column, images: Column) -> Column:
    """born_digital from 40 characters on, else scanned with an image, else blank_or_vector."""
    return F.when(F.length(F.trim(text)) >= 40, "born_digital").when(images > 0, "scanned").otherwise("blank_or_vector")


def doc_type(has_protocol: Column, has_sap: Column, has_icf: Column) -> Column:
    return F.when(has_protocol, "protocol").when(has_sap, "sap").when(has_icf, "icf").otherwise("other")


def divergence_flag(full: Column, sample: Column) -> Column:
    """``high`` or ``low`` where the ratio leaves 0.5 to 2; null where the sample is 0 or less."""
    return F.when(sample > 0, F.when(full / sample > 2, "high").when(full / sample < 0.5, "low"))


def gate_bracket(scanned_pct: Column) -> Column:
    return F.when(scanned_pct < 15, "under_15").when(scanned_pct <= 40, "15_to_40").otherwise("over_40")


_NO_DATE = r"(?!\s*[/-]\d)(?!-[A-Za-z]{3}-\d)"
# Markers of a document's version, in order.
VERSION_MARKERS = (
    ("revised_protocol", r"(?i)revised\s+protocol\s+(?:no\.?|number)\s*:?\s*((?>\d+))" + _NO_DATE),
    ("amendment", r"(?i)\bamendment\s*#?\s*((?>\d+))" + _NO_DATE),
    ("version", r"(?i)\bversion\s*:?\s*((?>\d+(?:\.\d+)?))" + _NO_DATE + r"(?!\.\d)"),
)
MARKER_DATE = r"(?i)date\s*:?\s*(\d{1,2}-[A-Za-z]{3}-\d{4})"
SOFTWARE = r"(?i)\b(?:sas|spss|stata)\b.{0,3}$"


def version_marker(text: Column) -> Column:
    """The version marker of a header or footer as ``(version, raw_version, date, pattern)``, null without one.

    Patterns are tried in order. A ``version`` that follows the name of statistics software within 15 characters is that software's.
    """
    date = F.nullif(F.regexp_extract(text, MARKER_DATE, 1), F.lit(""))

    def one(name: str, pattern: str) -> Column:
        raw = F.regexp_extract(text, pattern, 1)
        found = raw != ""
        if name == "version":
            at = F.regexp_instr(text, F.lit(pattern))
            start = F.greatest(F.lit(1), at - 15)
            found = found & ~F.substr(text, start, at - start).rlike(SOFTWARE)
        shown = F.when(raw.contains("."), raw.cast("double")).otherwise(raw.cast("long").cast("double"))
        return F.when(found, F.struct(shown.alias("version"), raw.alias("raw_version"), date.alias("date"), F.lit(name).alias("pattern")))

    return F.coalesce(*[one(*m) for m in VERSION_MARKERS])


def shown_version(version: Column) -> Column:
    """``v9`` or ``v4.03`` as a header shows it, ``v?`` for null."""
    whole = version == F.floor(version)
    return F.when(version.isNull(), "v?").when(whole, F.concat(F.lit("v"), version.cast("long").cast("string"))).otherwise(F.concat(F.lit("v"), version.cast("string")))


def contextual_header(nct_id: Column, doc_type_: Column, version: Column, section: Column) -> Column:
    return F.concat(F.lit("["), nct_id, F.lit(" | "), doc_type_, F.lit(" "), shown_version(version), F.lit(" | "), section, F.lit("]"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Likeness 0 to 100 of two texts as sets of lower-case tokens, by longest common subsequences.

    The shared tokens are compared with either text's tokens and these with each other, as sorted strings; the best
    ratio counts, so a text whose tokens are a subset of the other's scores 100. Runs in Arrow batches.
    """

    @F.pandas_udf("double")
    def ratio_of(x: pd.Series, y: pd.Series) -> pd.Series:
        def common(p: str, q: str) -> int:
            """Length of the longest common subsequence, one machine word of rows at a time in a big integer."""
            at: dict[str, int] = {}
            for i, c in enumerate(p):
                at[c] = at.get(c, 0) | 1 << i
            full = (1 << len(p)) - 1
            row = full
            for c in q:
                hit = row & at.get(c, 0)
                row = ((row + hit) | (row - hit)) & full
            return len(p) - row.bit_count()

        def ratio(p: str, q: str) -> float:
            return 200.0 * common(p, q) / (len(p) + len(q)) if p or q else 100.0

        def one(s: str | None, t: str | None) -> float:
            u, v = set((s or "").lower().split()), set((t or "").lower().split())
            both = sorted(u & v)
            if both and (len(both) == len(u) or len(both) == len(v)):
                return 100.0
            left, right = (" ".join([*both, *sorted(w - set(both))]) for w in (u, v))
            if not both:
                return ratio(left, right)
            shared = " ".join(both)
            return max(ratio(shared, left), ratio(shared, right), ratio(left, right))

        return pd.Series([one(s, t) for s, t in zip(x, y)])

    return ratio_of(a, b)
