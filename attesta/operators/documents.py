"""Documents as page blocks: page classes, sections, tables, version timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .relational import islands, mark_superseded, mode_first, nearest_below, priority_union, propagate_last, range_join_first, sections_from_markers

BAND, BAND_CHARS, LOW_COVERAGE, HEADING_RATIO = 0.12, 150, 0.5, 1.15


def classify_documents(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Per document of ``pages (keys, page, text, n_images)``: pages, counts per class, scanned percentage and a class of three values."""
    p = pages.withColumn("_c", T.page_class(F.coalesce("text", F.lit("")), F.coalesce("n_images", F.lit(0))))
    g = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(F.col("_c") == c).alias(c) for c in ("born_digital", "scanned", "blank_or_vector")])
    pct = F.bround(100.0 * F.col("scanned") / F.col("pages"), 2)
    return g.withColumn("scanned_pct", pct).withColumn("doc_class", F.when(F.col("scanned") == 0, "born_digital").when(F.col("scanned") == F.col("pages"), "scanned").otherwise("mixed"))


def classify_corpus(documents: DataFrame) -> DataFrame:
    """One row over ``classify_documents``: sums, scanned percentage over pages, documents per class."""
    return documents.agg(
        F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.bround(100.0 * F.sum("scanned") / F.sum("pages"), 2).alias("scanned_pct"),
        *[F.count_if(F.col("doc_class") == c).alias(f"{c}_documents") for c in ("born_digital", "scanned", "mixed")],
    )


def redaction_candidate(drawing: Column, page_height: Column) -> Column:
    """A dark filled box of the size of a line of text, away from the page's margins."""
    fill, top, bottom = drawing["fill"], drawing["y0"], drawing["y1"]
    bright = F.aggregate(fill, F.lit(0.0), lambda acc, x: acc + x) / F.size(fill)
    return fill.isNotNull() & (bright <= 0.25) & (bottom - top).between(6, 40) & (drawing["x1"] - drawing["x0"] >= 20) & (top >= page_height * 0.1) & (bottom <= page_height * 0.9)


def block_of_spans(spans: Column) -> Column:
    """``(text, font_size, bold)`` of a block's spans ``(text, size, flags)``; bit 4 of the flags is bold."""
    return F.struct(
        F.array_join(F.transform(spans, lambda s: s["text"]), "").alias("text"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["size"])), F.lit(0.0)).alias("font_size"),
        F.exists(spans, lambda s: s["flags"].bitwiseAND(16) != 0).alias("bold"),
    )


def body_font_sizes(blocks: DataFrame) -> DataFrame:
    """``doc, body``: the most frequent rounded font size over 0, the first met on ties; 0 where there is none."""
    sized = blocks.withColumn("body", F.bround("font_size")).where("body > 0").withColumn("_at", F.struct("page", "pos"))
    order = Window.partitionBy("doc").orderBy("page", "pos")
    return blocks.select("doc").distinct().join(mode_first(sized.withColumn("_n", F.row_number().over(order)), ["doc"], "body", "_n"), "doc", "left").na.fill({"body": 0.0})


def heading_candidate(text: Column, font_size: Column, bold: Column, body: Column) -> Column:
    t = F.trim(text)
    return F.length(t).between(3, 100) & (T.token_count(t) <= 12) & (bold | ((body > 0) & (font_size > HEADING_RATIO * body)))


def numbered_prefix(text: Column) -> Column:
    """A leading number such as ``5.1`` and the heading after it, null without one."""
    # Fixed value: the pattern of a numbered heading.
    return F.nullif(F.trim(F.regexp_extract(F.trim(text), r"^\s*\d{1,2}(?:\.\d{1,2})*\.?\s+([A-Za-z][A-Za-z /\-]{2,60})", 0)), F.lit(""))


def sections(blocks: DataFrame, bookmarks: DataFrame | None = None) -> DataFrame:
    """``doc, section_pos, label, heading, method, range_start, range_end`` of ``blocks (doc, page, pos, text, font_size, bold)``.

    Level-1 ``bookmarks (doc, pos, level, title, page)`` (pages from 1) make the sections; documents without any take headings found in the
    text, and documents without those are one unclassified section. Short blocks in bold or large type are headings, and so is a number with words
    of the taxonomy at the start of a long one. Headings outside the taxonomy are unclassified sections. ``method`` is bookmark, regex or unmatched.
    """
    total = blocks.groupBy("doc").agg((F.max("page") + 1).alias("total"))
    b = blocks.join(body_font_sizes(blocks), "doc")
    styled = (F.col("body") > 0) & (F.col("bold") | (F.col("font_size") > HEADING_RATIO * F.col("body")))
    head = styled & heading_candidate(F.col("text"), F.col("font_size"), F.col("bold"), F.col("body"))
    prefix = numbered_prefix(F.col("text"))
    label = F.when(head, T.section_label(F.col("text"))).otherwise(T.section_label(prefix))
    found = b.withColumn("label", label).withColumn("heading", F.when(head, F.trim("text")).otherwise(prefix)).where(head | (styled & F.col("label").isNotNull()))
    scan = found.select("doc", F.col("page").alias("start"), F.col("pos").cast("long").alias("pos"), "label", "heading", F.lit("regex").alias("method"))
    markers = scan
    if bookmarks is not None:
        toc = bookmarks.where("level = 1").select("doc", F.greatest(F.col("page") - 1, F.lit(0)).alias("start"), F.col("pos").cast("long").alias("pos"), T.section_label(F.col("title")).alias("label"), F.col("title").alias("heading"), F.lit("bookmark").alias("method"))
        markers = priority_union(toc, scan, ["doc"])
    ranges = sections_from_markers(markers.join(total, "doc"), ["doc"], "start", ["start", "pos"], "total")
    whole = total.join(markers.select("doc").distinct(), "doc", "left_anti").select("doc", F.lit(0).alias("range_start"), (F.col("total") - 1).alias("range_end"), F.lit("unmatched").alias("method"))
    out = ranges.unionByName(whole, allowMissingColumns=True)
    order = Window.partitionBy("doc").orderBy("range_start", F.col("pos").asc_nulls_first())
    return out.select("doc", (F.row_number().over(order) - 1).alias("section_pos"), F.coalesce("label", F.lit(T.UNCLASSIFIED)).alias("label"), "heading", F.coalesce("method", F.lit("unmatched")).alias("method"), "range_start", "range_end")


def detection(sections_: DataFrame) -> DataFrame:
    """One row: documents, those with a named section, percentage."""
    per = sections_.groupBy("doc").agg(F.bool_or(F.col("label") != T.UNCLASSIFIED).alias("named"))
    return per.agg(F.count(F.lit(1)).alias("documents"), F.count_if("named").alias("detected"), F.bround(100.0 * F.count_if("named") / F.count(F.lit(1)), 1).alias("rate"))


def detection_failures(sections_: DataFrame, sponsors: DataFrame) -> DataFrame:
    """Documents ``(doc, nct_id)`` without a named section, with their sponsor or UNKNOWN."""
    bad = sections_.groupBy("doc", "nct_id").agg(F.bool_or(F.col("label") != T.UNCLASSIFIED).alias("named")).where("not named").drop("named")
    return bad.join(sponsors.select("nct_id", "sponsor_name", "sponsor_class"), "nct_id", "left").na.fill("UNKNOWN", ["sponsor_name", "sponsor_class"])


def cell_spans(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Row and column, and how many of each a cell spans, from rectangles ``(x0, y0, x1, y1)``: dense ranks of the rounded boundaries."""
    c = cells.select("*", *[F.bround(v, 0).alias(f"_{v}") for v in ("x0", "y0", "x1", "y1")])

    def ranked(a: str, b: str, name: str) -> DataFrame:
        edges = c.select(*keys, F.explode(F.array(a, b)).alias("edge")).distinct()
        return edges.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("edge")) - 1)

    for a, b, name, span in (("_x0", "_x1", "col", "col_span"), ("_y0", "_y1", "row", "row_span")):
        r = ranked(a, b, name)
        c = c.join(r.withColumnRenamed("edge", a), [*keys, a]).join(r.select(*keys, F.col("edge").alias(b), F.col(name).alias("_to")), [*keys, b]).withColumn(span, F.col("_to") - F.col(name)).drop("_to")
    return c.drop("_x0", "_x1", "_y0", "_y1")


def captions(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """``tables (doc, page, table_pos, top, caption)``; a missing caption is the nearest caption block above the table on its page."""
    found = blocks.where(F.col("text").rlike(r"(?i)^(table|figure)\s+\d")).select("doc", "page", F.col("bottom").alias("_b"), F.trim("text").alias("above"))
    return nearest_below(tables, found, ["doc", "page"], ["table_pos"], "top", "_b", "above").withColumn("caption", F.coalesce("caption", "above")).drop("above")


def propagate_headers(tables: DataFrame) -> DataFrame:
    """Tables without headers take those of the last table of the document with the same caption; without a caption never."""
    t = tables.withColumn("_h", F.when(F.size(F.coalesce("headers", F.array().cast(tables.schema["headers"].dataType))) > 0, F.col("headers")))
    t = propagate_last(t, ["doc", "caption"], ["page_start", "table_pos"], "_h", "_last")
    return t.withColumn("headers", F.when(F.col("_h").isNull() & F.col("caption").isNotNull(), F.coalesce("_last", "headers")).otherwise(F.col("headers"))).drop("_h", "_last")


def reassembled(tables: DataFrame) -> DataFrame:
    """Runs of continued tables as one: equal headers, and the next page or a ``(continued)`` caption. Rows are put together in order."""
    w = Window.partitionBy("doc").orderBy("page_start", "table_pos")
    names = F.transform("headers", lambda h: h["text"])
    same = (F.size(names) > 0) & names.eqNullSafe(F.lag(names).over(w))
    near = (F.col("page_start") == F.lag("page_end").over(w) + 1) | F.coalesce(F.col("caption").rlike(T.CONTINUED), F.lit(False))
    t = tables.withColumn("_new", F.when(F.coalesce(same & near, F.lit(False)), 0).otherwise(1)).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = F.struct("page_start", "table_pos")
    return t.groupBy("doc", F.col("_i").alias("logical_pos")).agg(
        F.min_by("caption", at).alias("caption"), F.min_by("headers", at).alias("headers"), F.min_by("source_section", at).alias("source_section"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_start", "table_pos", "rows"))), lambda x: x["rows"])).alias("rows"),
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.count(F.lit(1)).alias("raw_tables"),
    )


def source_sections(tables: DataFrame, sections_: DataFrame) -> DataFrame:
    """Adds ``source_section``: the first section that overlaps the table's pages, or unclassified."""
    s = sections_.select("doc", "section_pos", F.col("label").alias("source_section"), F.col("range_start").alias("_s"), F.col("range_end").alias("_e"))
    return range_join_first(tables, s, ["doc"], ["table_pos"], ("page_start", "page_end"), ("_s", "_e"), ["section_pos"]).na.fill(T.UNCLASSIFIED, ["source_section"]).drop("section_pos", "_s", "_e")


def page_markers(blocks: DataFrame) -> DataFrame:
    """``doc, page, marker``: the version marker in the short blocks whose top edge lies in each page's top or bottom band."""
    margin = BAND * F.col("page_height")
    short = (F.length("text") <= BAND_CHARS) & (F.col("page_height") > 0) & ((F.col("top") < margin) | (F.col("top") > F.col("page_height") - margin))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(short, F.struct("pos", "text")))), lambda x: x["text"]), " ")
    return blocks.groupBy("doc", "page").agg(T.version_marker(text).alias("marker"))


def version_timeline(markers: DataFrame) -> DataFrame:
    """Runs of pages of one version: ``doc, run, version, date, range_start, range_end, superseded``; pages without a marker are runs too."""
    m = markers.select("doc", "page", F.col("marker.version").alias("version"), "marker")
    runs = islands(m, ["doc"], ["page"], "version", "page")
    dated = runs.join(m.select("doc", F.col("page").alias("run_start"), F.col("marker.date").alias("date")), ["doc", "run_start"])
    return mark_superseded(dated, ["doc"], "version").select("doc", "run", "version", "date", F.col("run_start").alias("range_start"), F.col("run_end").alias("range_end"), "superseded")


def coverage(timeline: DataFrame) -> DataFrame:
    pages = F.col("range_end") - F.col("range_start") + 1
    return timeline.groupBy("doc").agg((F.sum(F.when(F.col("version").isNotNull(), pages).otherwise(0)) / F.sum(pages)).alias("coverage")).withColumn("low", F.col("coverage") < LOW_COVERAGE)


def reconcile(timeline: DataFrame, registry: DataFrame) -> DataFrame:
    """Per ``(doc, nct_id)`` whether the greatest version of the document lies within the registry's versions."""
    d = timeline.groupBy("doc", "nct_id").agg(F.max("version").alias("doc_version"))
    r = registry.groupBy("nct_id").agg(F.min("version").alias("low"), F.max("version").alias("high"))
    j = d.join(r, "nct_id", "left")
    return j.withColumn("status", F.when(F.col("doc_version").isNull() | F.col("low").isNull(), "unresolvable").when(F.col("doc_version").between(F.col("low"), F.col("high")), "agreement").otherwise("mismatch"))


def pages_needing_ocr(pages: DataFrame) -> DataFrame:
    return pages.where("needs_ocr").select("nct_id", "doc_type", "doc", "page")
