"""Rounds and loans semantics on tiny fixtures (null keys, strict band, ties,
sum of repeated counts, data-dependent drops)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.aggregate import in_open_range, totals_on_rows
from tessera.operators.profile import (
    column_profile, constant_columns, drop_sparse, drop_uninformative, duplicate_count, null_profile, sparse_columns,
)
from tessera.operators.rank import rank_within, top_row_per_group
from tessera.plans.rounds import fill_amount, master_frame, sector_long


def _rounds_tiny(spark):
    rounds = spark.createDataFrame([
        (1, "ACME", "venture", 5_000_000.0), (2, "acme", "venture", 15_000_000.0), (3, "Beta", "venture", 7e6),
        (4, None, "seed", 1e5), (5, "beta", "venture", None), (6, "gamma", "angel", 9e6),
    ], "round_id long, company_permalink string, funding_round_type string, raised_amount_usd double")
    companies = spark.createDataFrame([
        ("acme", "Acme", "USA", "Tech|Hardware"), ("BETA", "Beta", "GBR", "Media"),
        (None, "Ghost", None, ""), ("gamma", "Gamma", "USA", "Tech"),
    ], "permalink string, name string, country_code string, category_list string")
    return rounds, companies


def test_null_keys_match_and_sentinel(spark):
    r, c = _rounds_tiny(spark)
    m = master_frame(r, c)
    assert m.count() == 6                      # NULL key matches NULL key (N2)
    f = fill_amount(m).where(F.col("round_id") == 5).first()
    assert f["raised_amount_usd"] == -1.0 and f["was_missing"]


def test_strict_band_excludes_both_ends(spark):
    r, _ = _rounds_tiny(spark)
    kept = sorted(x["round_id"] for x in r.where(in_open_range("raised_amount_usd", 5e6, 15e6)).collect())
    assert kept == [3, 6]


def test_totals_on_rows_equals_window_and_sum_of_squares(spark):
    df = spark.createDataFrame([("USA", "a", 1.0), ("USA", "a", 2.0), ("USA", "b", 3.0), ("GBR", None, 4.0),
                                ("GBR", None, 5.0)], "c string, s string, v double")
    got = totals_on_rows(df, ["c", "s"], "v", "tot", "cnt")
    w = Window.partitionBy("c", "s")
    want = df.withColumns({"tot": F.sum("v").over(w), "cnt": F.count(F.lit(1)).over(w)})
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    n2 = got.groupBy("c").agg(F.sum("cnt").alias("s")).orderBy("c").collect()
    assert [x["s"] for x in n2] == [4, 5]       # sum of n^2 per country (N6)


def test_top_row_ties_and_nulls(spark):
    df = spark.createDataFrame([("g", "b", 10.0, 2), ("g", "a", 10.0, 3), ("g", "c", None, 1), ("h", "z", 1.0, 9)],
                               "g string, k string, amt double, rid int")
    best = {r["g"]: r["k"] for r in top_row_per_group(df, ["g"], [("amt", False), ("k", True)]).collect()}
    assert best == {"g": "a", "h": "z"}
    rk = rank_within(df, ["g"], [F.col("amt").desc_nulls_last(), "k"], 2, "r").where("g = 'g'").collect()
    assert [x["k"] for x in sorted(rk, key=lambda x: x["r"])] == ["a", "b"]


def test_wide_to_long_mapping(spark):
    wide = spark.createDataFrame([("Tech", 1, 0, 1), ("Media", 0, 0, 0), (None, 0, 1, 0)],
                                 "category_list string, A int, B int, C int")
    got = sorted(map(tuple, sector_long(wide).collect()), key=str)
    assert got == sorted([("Tech", "A"), ("Tech", "C"), (None, "B")], key=str)


def _loans_tiny(spark):
    rows = []
    for i in range(100):
        rows.append((i, "INDIVIDUAL", 1, 0.0 if i < 39 else float(i), None if i < 41 else float(i),
                     "" if i % 2 else "x", "< 1 year" if i % 3 == 0 else "2 years"))
    return spark.createDataFrame(rows, "id long, app string, policy int, z39 double, z41 double, half string, emp string")


def test_profiles_and_drops(spark):
    df = _loans_tiny(spark)
    shares = {r["column_name"]: r["zero_or_null_share"] for r in sparse_columns(df, 0.4).collect()}
    assert abs(shares["z39"] - 0.39) < 1e-12 and abs(shares["z41"] - 0.41) < 1e-12
    assert "z41" not in drop_sparse(df, 0.4).columns and "z39" in drop_sparse(df, 0.4).columns
    cons = {r["column_name"]: r["constant"] for r in constant_columns(df).collect()}
    assert cons["app"] and cons["policy"] and not cons["z39"]
    kept = drop_uninformative(df, 0.4).columns
    assert "app" not in kept and "policy" not in kept and "half" not in kept and "emp" in kept
    nulls = {r["column_name"]: r["null_count"] for r in null_profile(df).collect()}
    assert nulls["z41"] == 41 and nulls["id"] == 0
    assert drop_sparse(df.select("id"), 0.4).columns == ["id"]        # nothing qualifies -> nothing dropped (N11)
    assert duplicate_count(df.unionAll(df.limit(3)), ["id"]).first()[0] == 3


def test_column_summary_in_place(spark):
    import numpy as np

    from tessera.operators.profile import column_summary
    v = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(x, int(10 * x) if x > 1 else None) for x in v], "a double, b long")
    kept = {"a": v, "b": [10 * x for x in v if x > 1]}
    for r in column_summary(df, ["a", "b"]).collect():
        x = kept[r.column_name]
        assert [r["min"], r.q1, r.median, r["mean"], r.q3, r["max"]] == [min(x), *np.quantile(x, [0.25, 0.5]), sum(x) / len(x), np.quantile(x, 0.75), max(x)]
    rough = {r.column_name: r for r in column_summary(df, ["a", "b"], exact=False).collect()}
    assert set(rough) == {"a", "b"} and all(r["min"] <= r.q1 <= r.median <= r.q3 <= r["max"] for r in rough.values())


def test_factor_codes_on_any_partitions(spark):
    from tessera.functions.encode import factor_codes

    df = spark.createDataFrame([(i, f"{(i * 7) % 13}%") for i in range(40)] + [(99, None)], "id long, r string")
    small = {x["id"]: x["r_code"] for x in factor_codes(df, "r", "r_code").collect()}
    big = {x["id"]: x["r_code"] for x in factor_codes(df.repartition(7), "r", "r_code").collect()}
    levels = sorted({f"{(i * 7) % 13}%" for i in range(40)})
    assert small == big and small[99] is None
    assert all(small[i] == levels.index(f"{(i * 7) % 13}%") + 1 for i in range(40))


def test_fallback_paths_without_broadcast(spark):
    """Above the checked bound the join is left to the planner (no hint): same result."""
    from tessera.operators.relate import lookup, maybe_broadcast

    df = spark.createDataFrame([(f"c{i % 7}", f"s{i % 3}", float(i)) for i in range(60)], "c string, s string, v double")
    a = sorted(map(tuple, totals_on_rows(df, ["c", "s"], "v", "t", "n").collect()))
    b = sorted(map(tuple, totals_on_rows(df, ["c", "s"], "v", "t", "n", max_groups=2).collect()))
    assert a == b
    small = spark.createDataFrame([("c1", "one"), ("c2", "two")], "k string, name string")
    plan = maybe_broadcast(small, 1)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" not in plan and "broadcast" not in plan.lower()
    got = {r["c"]: r["name"] for r in lookup(df, small, "c", "k", "name", max_rows=1).collect()}
    assert got["c1"] == "one" and got["c0"] is None


def test_clean_loans_tiny(spark):
    import datetime as dt

    from tessera.functions.lookups import states_frame
    from tessera.plans.loans import clean_loans

    rows = [
        (1, "10.65%", "83.7%", "", "< 1 year", None, "Dec-11", "CA", 1, 0.0, "Charged Off"),
        (2, " 7%", "", "nurse", "10+ years", "car", "Jan-70", "PR", 1, 0.0, "Fully Paid"),
        (3, "junk", "5%", "clerk", "2 years", "home", "bad", "NY", 1, 5.0, "Current"),
    ]
    raw = spark.createDataFrame(rows, "id long, int_rate string, revol_util string, emp_title string, "
                                      "emp_length string, title string, issue_d string, addr_state string, "
                                      "policy_code int, delinq_amnt double, loan_status string")
    out = clean_loans(raw, states_frame(spark))
    assert "policy_code" not in out.columns and "delinq_amnt" not in out.columns   # constant, 2/3 zero
    r = {x["id"]: x for x in out.collect()}
    assert r[1]["int_rate"] == 10.65 and r[2]["int_rate"] == 7.0 and r[3]["int_rate"] is None
    assert r[1]["revol_util"] == 83.7 and r[2]["revol_util"] is None
    assert r[1]["emp_title"] is None and r[1]["emp_length"] == "0 year" and r[1]["title"] == "0"
    assert (r[1]["emp_years"], r[2]["emp_years"], r[3]["emp_years"]) == (0, 10, 2)
    assert r[1]["issue_d"] == dt.date(2011, 12, 1) and r[2]["issue_d"] == dt.date(1970, 1, 1) and r[3]["issue_d"] is None
    assert r[1]["addr_state"] == "California" and r[2]["addr_state"] is None


def test_distinct_count_exact_and_sketch(spark):
    from tessera.operators.profile import distinct_count

    df = spark.createDataFrame([(f"k{i % 500}",) for i in range(5000)] + [(None,)], "k string")
    assert distinct_count(df, "k").first()[0] == 501                 # NULL counts once
    assert abs(distinct_count(df, "k", approx=0.02).first()[0] - 501) < 30


def test_param_grid_is_the_full_product(spark):
    from tessera.operators.relate import param_grid

    g = param_grid(spark, sigma=[0.01, 0.02, 0.03], C=[1, 2])
    rows = sorted((r["sigma"], r["C"]) for r in g.collect())
    assert rows == sorted((s, c) for s in [0.01, 0.02, 0.03] for c in [1, 2])


def test_profile_in_passes_of_few_columns(spark):
    """every pass takes few columns; the decisions are those of all columns at once."""
    nan = float("nan")
    df = spark.createDataFrame([("a", "", 0, 1.5, nan, None, None, "0"), ("a", " ", 3, 1.5, nan, None, "x", "0"), ("a", "b", None, 1.5, nan, None, "x", "1")],
                               "same string, blank string, n long, d double, nan double, none string, some string, zero string")
    wide = column_profile(df, at_once=100)
    assert column_profile(df, at_once=3) == wide == column_profile(df, at_once=1)
    p = {r["column_name"]: r for r in wide}
    assert [c for c in df.columns if p[c]["constant"]] == ["same", "d", "none"]
    assert p["blank"]["blank_share"] == 2 / 3 and p["n"]["zero_or_null_share"] == 2 / 3 and p["zero"]["zero_or_null_share"] == 2 / 3
    assert p["some"]["null_share"] == 1 / 3 and p["none"]["null_share"] == 1
    empty = column_profile(df.where("false"))
    assert all(r["constant"] and r["null_share"] is None for r in empty)
