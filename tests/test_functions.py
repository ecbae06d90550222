import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import (
    blank_to_null, first_token, gsub, parse_dmy, parse_month_year, part, paste, percent_to_double,
    split_fixed, word_to_number, year_month,
)
from tessera.functions.numeric import rnd
from tessera.functions.text import leading_digits


def test_split_fixed_pads_and_keeps_rest(spark):
    df = spark.createDataFrame([("a|b|c|d",), ("a",), ("",), (None,), ("x|y",)], "s string")
    rows = df.select(split_fixed("s", r"\|", 3).alias("p")).collect()
    assert rows[0]["p"] == ["a", "b", "c|d"]
    assert rows[1]["p"] == ["a", "", ""]
    assert rows[2]["p"] == ["", "", ""]
    assert rows[3]["p"] is None
    assert rows[4]["p"] == ["x", "y", ""]
    assert df.select(part(split_fixed("s", r"\|", 3), 0).alias("x")).first()["x"] == "a"


def test_first_token_and_words(spark):
    df = spark.createDataFrame([("alfa romero giulia", "four"), ("bmw", "twelve"), ("vw x", None)], "n string, w string")
    r = df.select(first_token("n").alias("b"), word_to_number("w").alias("c")).collect()
    assert [x["b"] for x in r] == ["alfa", "bmw", "vw"]
    assert [x["c"] for x in r] == [4, 12, 12]          # unknown and missing words -> 12


def test_text_cleaning(spark):
    df = spark.createDataFrame([("< 1 year", "10.65%", ""), ("10+ years", " 7% ", "x"), (None, "", None)],
                               "e string, r string, t string")
    r = df.select(gsub("e", "< 1", "0").alias("e"), percent_to_double("r").alias("r"),
                  blank_to_null("t").alias("t"), paste("e", "t", sep="-").alias("p")).collect()
    assert r[0]["e"] == "0 year" and r[0]["r"] == 10.65 and r[0]["t"] is None
    assert r[1]["r"] == 7.0 and r[1]["p"] == "10+ years-x"
    assert r[2]["r"] is None and r[2]["p"] == "NA-NA"


def test_text_cleaning_without_regex_keeps_its_results(spark):
    """plain replacement, leading digits and percent text give what the patterns give."""
    odd = ["", " ", "5%", " 5.5% ", "5%%", "5%\n", "%5", "5 %", "5%\n%", "%", "1e3%", "x", "< 1 year", "< 1< 1", "10+ years", "12", "7\n8", "\u0663 years", None]
    df = spark.createDataFrame([(v,) for v in odd], "s string")
    zero = F.regexp_replace("s", "< 1", "0")
    r = df.select(gsub("s", "< 1", "0").eqNullSafe(zero).alias("a"),
                  leading_digits("s").eqNullSafe(F.regexp_extract("s", r"^(\d+)", 1)).alias("b"),
                  percent_to_double("s").eqNullSafe(F.regexp_replace(F.trim("s"), "%$", "").try_cast("double")).alias("c"))
    assert all(all(x) for x in r.collect())
    assert "regexp" not in df.select(gsub("s", "< 1", "0"))._jdf.queryExecution().optimizedPlan().toString()
    assert df.select(gsub("s", "[0-9]", "$0$0").alias("x")).where("s = '12'").first()["x"] == "1122"


def test_dates(spark):
    df = spark.createDataFrame([("Dec-11", "31/12/2014"), ("Jan-70", "1-2-2013"), ("Jun-68", "junk"), ("bad", None)],
                               "m string, d string")
    r = df.select(parse_month_year("m").alias("m"), parse_dmy("d").alias("d")).collect()
    assert r[0]["m"] == dt.date(2011, 12, 1) and r[0]["d"] == dt.date(2014, 12, 31)
    assert r[1]["m"] == dt.date(1970, 1, 1) and r[1]["d"] == dt.date(2013, 2, 1)
    assert r[2]["m"] == dt.date(2068, 6, 1) and r[2]["d"] is None
    assert r[3]["m"] is None
    assert df.select(year_month(parse_dmy("d")).alias("y")).first()["y"] == "2014-12"


def test_rnd_matches_binary_rounding(spark):
    """rnd(x, d) == round(x * 10^d) / 10^d on doubles, as DuckDB rounds."""
    import duckdb
    import random

    rng = random.Random(3)
    vals = [2.675, 1.005, -1.5, 0.125, 615215.025, -341337.01335] + [round(rng.uniform(-1e6, 1e6), 5) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r["r"] for r in df.select(rnd("v", 2).alias("r")).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT round(CAST(? AS DOUBLE), 2)", [v]).fetchone()[0] for v in vals]
    assert got == want


def test_scale_settings():
    from tessera.session import scale_settings

    s = scale_settings(100 * 10**12, 8000)
    assert s["spark.sql.shuffle.partitions"] == "100000"
    assert scale_settings(10**9, 8)["spark.sql.shuffle.partitions"] == "24"
