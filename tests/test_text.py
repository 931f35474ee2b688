from pyspark.sql import functions as F

from attesta.functions import stats
from attesta.functions import text as T


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("x")).first()["x"]


def test_normalize(spark):
    f = lambda s: one(spark, T.normalize_text(F.col("t")), t=s)
    assert f("  Intent-to-Treat,\n population! ") == "intenttotreat population"
    assert f("Étude №1") == "étude 1"
    assert f("") == ""


def test_whole_token(spark):
    f = lambda a, b: one(spark, T.contains_whole_token(F.col("a"), F.col("b")), a=a, b=b)
    assert f("6", "at 6 months") and not f("6", "at 16 months") and not f("", "x")
    assert f("a.b", "x a.b y") and not f("a.b", "x acb y")


def test_durations(spark):
    d = lambda s: one(spark, T.durations_in_months(F.col("t")), t=s)
    assert d("24 months or 2 years") == [24.0]
    assert d("52 weeks, 365 days, 1.5 yrs") == [12.0, 18.0]
    assert d("nothing") == []
    assert one(spark, T.timeframe_in_months(F.col("t")), t="3 weeks and 1 year") is None
    assert one(spark, T.strip_durations(F.col("t")), t="OS at 24 months, 2 Years") == "OS at , 2 Years"


def test_tokens_and_labels(spark):
    assert one(spark, T.token_count(F.col("t")), t="") == 0
    assert one(spark, T.token_count(F.col("t")), t=" a\n b\tc ") == 3
    label = lambda s: one(spark, T.section_label(F.col("t")), t=s)
    assert label("5.1 Study Design") == "study_design" and label("SYNOPSIS") == "synopsis" and label("Appendix") is None


def test_version_marker(spark):
    m = lambda s: one(spark, T.version_marker(F.col("t")), t=s)
    assert m("Revised Protocol No.: 09 Date: 12-Jan-2018").asDict() == {"version": 9.0, "raw_version": "09", "date": "12-Jan-2018", "pattern": "revised_protocol"}
    assert m("Amendment 324-Mar-2022") is None
    assert m("using SAS version 9.4") is None
    assert m("Version: 2.1")["version"] == 2.1
    assert m("Version: 02.19.16") is None
    assert one(spark, T.shown_version(F.col("v")), v=9.0) == "v9"


def test_citations_and_refusal(spark):
    got = spark.createDataFrame([("x [2][1] y [2] [9]", ["a", "b", "c"])], "t string, ids array<string>").select(T.citations(F.col("t"), F.col("ids")).alias("c")).first()["c"]
    assert got == ["b", "a"]
    assert one(spark, T.is_refusal(F.col("t")), t=" NOT_ANSWERABLE\n") and not one(spark, T.is_refusal(F.col("t")), t="NOT_ANSWERABLE.")


def test_token_set_ratio(spark):
    f = lambda a, b: one(spark, T.token_set_ratio(F.col("a"), F.col("b")), a=a, b=b)
    assert f("phase two", "this is a phase two trial") == 100.0
    assert f("alpha", "omega") < 60


def test_wilson_and_kappa(spark):
    lo, hi = stats.wilson(F.lit(8.0), F.lit(10.0))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert abs(r["lo"] - 0.4902) < 1e-3 and abs(r["hi"] - 0.9433) < 1e-3
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.0, 1.0), (1.0, 1.0)], "h double, j double")
    assert stats.weighted_kappa(df, "h", "j").first()["kappa"] == 0.5
    assert stats.weighted_kappa(df.where("h = j AND h = 1"), "h", "j").first()["kappa"] == 1.0
    assert stats.weighted_kappa(df.where("false"), "h", "j").first()["kappa"] is None
