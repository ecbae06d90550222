"""Readers and writers (S1-S7) on files written to a fresh scratch folder."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.sources import (
    clean_headers, clean_name, read_csv, read_delimited, read_headerless, read_slices, write_slices,
)


def test_clean_name():
    assert clean_name("Automotive & Sports") == "Automotive_Sports"
    assert clean_name("Order.Date") == "Order_Date"
    assert clean_name("Social, Finance/Analytics-Advertising") == "Social_Finance_Analytics_Advertising"
    assert clean_name("2nd col") == "c_2nd_col"


def test_delimited_headerless_and_slices(spark):
    d = tempfile.mkdtemp(prefix="tessera-src-")
    tsv = os.path.join(d, "companies.txt")
    with open(tsv, "w") as f:
        f.write("permalink\tcountry_code\tcategory_list\n/Org/A\tUSA\tTech|Media\n/org/b\t\t\n")
    df = read_delimited(spark, tsv, "permalink string, country_code string, category_list string")
    rows = df.orderBy("permalink").collect()
    assert rows[0]["permalink"] == "/Org/A" and rows[1]["country_code"] == ""
    csv = os.path.join(d, "digits.csv")
    with open(csv, "w") as f:
        f.write("7,0,255\n2,10,0\n")
    h = read_headerless(spark, csv, "_c0 int, _c1 int, _c2 int", {"_c0": "Digit"})
    assert h.columns[0] == "Digit" and sorted(r["Digit"] for r in h.collect()) == [2, 7]
    hdr = os.path.join(d, "store.csv")
    with open(hdr, "w") as f:
        f.write("Row ID,Order Date,Sales\n1,31/12/2014,10.5\n")
    s = clean_headers(read_csv(spark, hdr, "`Row ID` int, `Order Date` string, Sales double"))
    assert s.columns == ["Row_ID", "Order_Date", "Sales"]
    out = os.path.join(d, "slices")
    sl = spark.createDataFrame([("EU-Consumer", "2014-01", 1.0), ("APAC-Consumer", "2014-01", 2.0),
                                ("EU-Consumer", "2014-02", 3.0)], "series string, month string, x double")
    write_slices(sl, out, ["series"])
    back = read_slices(spark, out, "month string, x double, series string", "series = 'EU-Consumer'")
    assert sorted(r["x"] for r in back.collect()) == [1.0, 3.0]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(series" in plan


def test_csv_as_the_scripts_read_it(spark, tmp_path):
    from tessera.sources.files import write_csv

    p = tmp_path / "a.csv"
    p.write_text('b,a,n\n"say ""hi"", ok",x,1\nNA,,NA\n"","two\nlines",zz\n')
    rows = read_csv(spark, str(p), "a string, b string, n int", multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("x", 'say "hi", ok', 1), ("", None, None), ("two\nlines", "", None)]
    try:
        read_csv(spark, str(p), "c string")
        raise AssertionError("a column that isn't there was read")
    except ValueError:
        pass
    df = spark.createDataFrame([(1, ' q"1, ', 2.5), (2, None, None), (3, "", 0.0)], "id int, s string, x double")
    write_csv(df, str(tmp_path / "b"))
    back = read_csv(spark, str(tmp_path / "b"), "x double, s string, id int")
    assert sorted(map(tuple, back.select("id", "s", "x").collect())) == [(1, ' q"1, ', 2.5), (2, None, None), (3, "", 0.0)]
