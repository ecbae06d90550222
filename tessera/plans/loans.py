"""Loan book workload: column profiling, data-dependent drops, cleaning, and the
tables behind the default analysis (counts, histogram, box, trend, correlation)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import parse_month_year
from tessera.functions.encode import factor_codes
from tessera.functions.lookups import states_frame, states_sql
from tessera.functions.numeric import rnd, rnd_sig, rnd_sig_sql
from tessera.functions.text import blank_to_null, first_token, gsub, leading_digits, percent_to_double
from tessera.operators.aggregate import binned_trend, box_stats, corr_matrix, histogram, quantile_bins
from tessera.operators.profile import (
    constant_columns, drop_profiled, duplicate_count, null_profile, sparse_columns,
)
from tessera.operators.relate import lookup
from tessera.operators.spline import smooth_sql, smooth_trend
from tessera.plans import bind
from tessera.session import checkpoint_dir, materialize
from tessera.sources.files import clean_headers, read_csv, read_headerless, read_table, write_csv

SPARSE_SHARE = 0.4
BLANK_SHARE = 0.4
DEFAULT_STATUS = "Charged Off"
MONTH_YEAR_COLS = ["issue_d", "earliest_cr_line", "last_credit_pull_d", "last_pymnt_d", "next_pymnt_d"]
PERCENT_COLS = ["int_rate", "revol_util"]
CORR_COLS = ["funded_amnt_inv", "int_rate", "annual_inc", "dti"]
CROSSTAB_DIMS = ["verification_status", "term", "home_ownership", "emp_length"]
HIST_BINS = 30
INCOME_BINS = 10


# ------------------------------------------------------------------ operators
def clean_loans(raw: DataFrame, states: DataFrame) -> DataFrame:
    """Profile-driven drops (A15, A16), then the cleaning projection:
    blank -> NULL (F6), NULL title -> "0" (F5), ``< 1`` -> ``0`` (X4),
    month-year text -> date (X8), percent text -> number (X10), state code ->
    name with unknown codes NULL (J4)."""
    return clean_columns(drop_profiled(raw, SPARSE_SHARE, BLANK_SHARE), states)


def clean_columns(x: DataFrame, states: DataFrame) -> DataFrame:
    """The cleaning projection of ``clean_loans`` on the columns that are there."""
    cols = set(x.columns)
    fix = {}
    if "emp_title" in cols:
        fix["emp_title"] = blank_to_null("emp_title")
    if "title" in cols:
        fix["title"] = F.coalesce(F.col("title"), F.lit("0"))
    if "emp_length" in cols:
        fix["emp_length"] = gsub("emp_length", "< 1", "0")          # faithful text: "0 year" (N10)
        fix["emp_years"] = leading_digits(gsub("emp_length", "< 1", "0")).try_cast("int")
    fix.update({c: parse_month_year(c) for c in MONTH_YEAR_COLS if c in cols})
    fix.update({c: percent_to_double(c) for c in PERCENT_COLS if c in cols})
    x = x.withColumns(fix)
    if "addr_state" in cols:
        x = (lookup(x, states, "addr_state", "state_code", "state_name")
             .withColumn("addr_state", F.col("state_name")).drop("state_name"))
    return x


def defaulters(clean: DataFrame) -> DataFrame:
    return clean.where(F.col("loan_status") == DEFAULT_STATUS)


def stacked_counts(df: DataFrame, dims: list[str], by: str) -> DataFrame:
    """A19 for several dimensions in one pass: rows are stacked (Expand) as
    (dimension, level) and counted with ``by`` -> (dimension, level, by, n)."""
    st = df.select(F.col(by), F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dims
    ])).alias("s")).select("s.dimension", "s.level", by)
    return st.groupBy("dimension", "level", by).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ bindings
def _raw(spark, sf_dir):
    return bind.loans_view(spark, sf_dir)


def _clean(spark, sf_dir):
    """The joined view is written once, so that its profile and its projection don't both join."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/loans-{uuid.uuid4().hex}"
    raw = _raw(spark, sf_dir)
    raw.write.parquet(folder)
    return clean_loans(spark.read.schema(raw.schema).parquet(folder), states_frame(spark))


def _chart(spark, sf_dir, *cols):
    """The cleaned columns that a chart needs: no profile of the others, one scan."""
    return clean_columns(_raw(spark, sf_dir).select(*cols), states_frame(spark))


def q_loans_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir)


def q_sparse_columns(spark, sf_dir):
    s = sparse_columns(_raw(spark, sf_dir), SPARSE_SHARE)
    return s.select("column_name", rnd("zero_or_null_share", 6).alias("zero_or_null_share"), "dropped")


def q_constant_columns(spark, sf_dir):
    return constant_columns(_raw(spark, sf_dir))


def q_null_profile(spark, sf_dir):
    return null_profile(bind.store_view(spark, sf_dir))


def q_duplicate_count(spark, sf_dir):
    a = duplicate_count(_raw(spark, sf_dir), ["id"]).first()[0]
    b = duplicate_count(bind.price_view(spark, sf_dir).drop("obs_id")).first()[0]
    c = duplicate_count(bind.store_view(spark, sf_dir), ["Row_ID"]).first()[0]
    return spark.createDataFrame([(a, b, c)], "dup_loan_ids long, dup_price_rows long, dup_store_ids long")


def q_factor_codes(spark, sf_dir):
    r = _raw(spark, sf_dir).select("id", "int_rate")
    return factor_codes(r, "int_rate", "int_rate_code").select("id", "int_rate", "int_rate_code")


def q_parse_month_year(spark, sf_dir):
    r = _raw(spark, sf_dir)
    return r.select("id", "issue_d", parse_month_year("issue_d").alias("issue_date"),
                    parse_month_year("earliest_cr_line").alias("earliest_cr_date"))


def q_code_lookup(spark, sf_dir):
    r = _raw(spark, sf_dir).select("id", "addr_state")
    out = lookup(r, states_frame(spark), "addr_state", "state_code", "state_name")
    return out.select("id", "addr_state", "state_name")


def q_default_by_purpose(spark, sf_dir):
    d = defaulters(_chart(spark, sf_dir, "purpose", "loan_status"))
    return d.groupBy("purpose").agg(F.count(F.lit(1)).alias("n"))


def q_status_crosstab(spark, sf_dir):
    return stacked_counts(_chart(spark, sf_dir, "loan_status", *CROSSTAB_DIMS), CROSSTAB_DIMS, "loan_status")


def q_amount_histogram(spark, sf_dir):
    h = histogram(defaulters(_chart(spark, sf_dir, "loan_amnt", "loan_status")), "loan_amnt", HIST_BINS)
    return h.select("bin", rnd("lo", 4).alias("lo"), rnd("hi", 4).alias("hi"), "n")


def q_box_stats(spark, sf_dir):
    # the narrow defaulter rows are read by several passes: materialise them once
    d = materialize(defaulters(_chart(spark, sf_dir, "term", "grade", "int_rate", "funded_amnt_inv", "loan_status")))
    a = box_stats(d.withColumn("grp", F.col("term")), ["grp"], "int_rate").withColumn("panel", F.lit("int_rate_by_term"))
    b = (box_stats(d.withColumn("grp", F.col("grade")), ["grp"], "funded_amnt_inv")
         .withColumn("panel", F.lit("funded_inv_by_grade")))
    u = a.unionByName(b)
    return u.select("panel", "grp", *[rnd(c, 6).alias(c) for c in ["q1", "median", "q3", "whisker_lo", "whisker_hi"]],
                    "n_outliers", "n")


def q_binned_trend(spark, sf_dir):
    t = binned_trend(_chart(spark, sf_dir, "issue_d", "funded_amnt"), F.col("issue_d"), "funded_amnt")
    return t.select(F.col("bin").alias("issue_month"), "n", rnd("mean", 4).alias("mean"),
                    rnd("se", 4).alias("se"), rnd("moving_mean", 4).alias("moving_mean"))


def q_loans_corr_matrix(spark, sf_dir):
    c = corr_matrix(defaulters(_chart(spark, sf_dir, "loan_status", *CORR_COLS)), CORR_COLS)
    return c.select("row_var", "col_var", rnd("corr", 6).alias("corr"), "n_complete")


def q_income_trend(spark, sf_dir):
    """Installment of defaulters over ten quantile bins of annual income."""
    d = materialize(defaulters(_chart(spark, sf_dir, "installment", "annual_inc", "loan_status"))
                    .where("annual_inc IS NOT NULL"))
    return quantile_bins(d, "annual_inc", "installment", INCOME_BINS).select(
        "bin", "n", rnd("lo", 4).alias("lo"), rnd("hi", 4).alias("hi"), rnd("mean", 4).alias("mean"), rnd("se", 4).alias("se"))


def q_issue_smooth(spark, sf_dir):
    """The smooth of the funded amount over the issue date (days), with standard errors."""
    d = _chart(spark, sf_dir, "issue_d", "funded_amnt")
    return _smooth(smooth_trend(d, F.unix_date("issue_d"), "funded_amnt"))


def q_income_smooth(spark, sf_dir):
    """The smooth of the defaulters' installment over annual income, with standard errors."""
    d = defaulters(_chart(spark, sf_dir, "installment", "annual_inc", "loan_status"))
    return _smooth(smooth_trend(d, "annual_inc", "installment"))


def _smooth(t):
    return t.select(rnd("x", 4).alias("x"), *[rnd_sig(c, 6).alias(c) for c in ("fit", "std_error")])


def q_defaulter_ownership(spark, sf_dir):
    """Defaulters by home ownership."""
    d = defaulters(_chart(spark, sf_dir, "home_ownership", "loan_status"))
    return d.groupBy("home_ownership").agg(F.count(F.lit(1)).alias("n"))


def q_ownership_verification(spark, sf_dir):
    """Defaulters by home ownership and verification status."""
    d = defaulters(_chart(spark, sf_dir, "home_ownership", "verification_status", "loan_status"))
    return d.groupBy("home_ownership", "verification_status").agg(F.count(F.lit(1)).alias("n"))


def q_category_frequency(spark, sf_dir):
    p = bind.price_view(spark, sf_dir).withColumn("brand", first_token("car_name"))
    return stacked_counts(p.withColumn("__all", F.lit("all")), ["status", "ptype", "cylinders", "brand"], "__all") \
        .select("dimension", "level", "n")


def q_csv_round_trip(spark, sf_dir):
    """The raw loan columns written as CSV to the shared folder and read back by name."""
    raw = _raw(spark, sf_dir).select("id", "emp_title", "title", "int_rate", "revol_util", "loan_amnt")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    write_csv(raw, folder)
    return read_csv(spark, folder, "loan_amnt double, revol_util string, id long, title string, emp_title string, int_rate string")


def q_headerless_round_trip(spark, sf_dir):
    """S4 + S5: a table written without a header, read back by position, named, and its names made one style."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    customers.write.option("header", False).option("escape", '"').csv(folder)
    named = read_headerless(spark, folder, "_c0 long, `Customer Name` string, `Nation-Key` long, `Balance & Credit` double", {"_c0": "Customer/Key"})
    return clean_headers(named)


QUERIES = {
    "csv_round_trip": q_csv_round_trip,
    "headerless_round_trip": q_headerless_round_trip,
    "loans_clean": q_loans_clean,
    "sparse_columns": q_sparse_columns,
    "constant_columns": q_constant_columns,
    "null_profile": q_null_profile,
    "duplicate_count": q_duplicate_count,
    "factor_codes": q_factor_codes,
    "parse_month_year": q_parse_month_year,
    "code_lookup": q_code_lookup,
    "default_by_purpose": q_default_by_purpose,
    "status_crosstab": q_status_crosstab,
    "amount_histogram": q_amount_histogram,
    "box_stats": q_box_stats,
    "binned_trend": q_binned_trend,
    "loans_corr_matrix": q_loans_corr_matrix,
    "income_trend": q_income_trend,
    "issue_smooth": q_issue_smooth,
    "income_smooth": q_income_smooth,
    "defaulter_ownership": q_defaulter_ownership,
    "ownership_verification": q_ownership_verification,
    "category_frequency": q_category_frequency,
}


# ------------------------------------------------------------------ oracles
def _my_sql(x: str) -> str:
    """Month-year text -> first of month, two-digit years pivoting at 69."""
    yy = f"TRY_CAST(trim(split_part(trim({x}), '-', 2)) AS INTEGER)"
    mon = f"month(try_strptime('2000-' || trim(split_part(trim({x}), '-', 1)) || '-01', '%Y-%b-%d'))"
    year = (f"CASE WHEN length(trim(split_part(trim({x}), '-', 2))) > 2 THEN {yy} "
            f"WHEN {yy} < 69 THEN {yy} + 2000 ELSE {yy} + 1900 END")
    return f"make_date({year}, {mon}, 1)"


def _pct_sql(x: str) -> str:
    return f"TRY_CAST(regexp_replace(trim({x}), '%$', '') AS DOUBLE)"


_CTE = f"""WITH raw AS ({bind.LOANS_SQL}),
st AS {states_sql()},
clean AS (
  SELECT id, loan_amnt, funded_amnt, funded_amnt_inv, term, {_pct_sql('int_rate')} AS int_rate, installment, grade,
    CASE WHEN emp_title = '' THEN NULL ELSE emp_title END AS emp_title,
    replace(emp_length, '< 1', '0') AS emp_length,
    TRY_CAST(regexp_extract(replace(emp_length, '< 1', '0'), '^([0-9]+)', 1) AS INTEGER) AS emp_years,
    home_ownership, annual_inc, verification_status,
    {_my_sql('issue_d')} AS issue_d, loan_status, purpose, coalesce(title, '0') AS title,
    st.state_name AS addr_state, dti, pub_rec, {_my_sql('earliest_cr_line')} AS earliest_cr_line,
    {_pct_sql('revol_util')} AS revol_util, {_my_sql('last_credit_pull_d')} AS last_credit_pull_d
  FROM raw LEFT JOIN st ON raw.addr_state = st.state_code),
dflt AS (SELECT * FROM clean WHERE loan_status = '{DEFAULT_STATUS}')
"""


def _smooth_sql(rows: str) -> str:
    return _CTE.replace("WITH raw", "WITH RECURSIVE raw").rstrip() + f""", xy AS MATERIALIZED (SELECT * FROM ({rows}) WHERE x IS NOT NULL AND y IS NOT NULL),
{smooth_sql("xy")}
SELECT round(x, 4) AS x, {rnd_sig_sql("fit", 6)} AS fit, {rnd_sig_sql("std_error", 6)} AS std_error FROM smooth"""


def _box_sql(panel: str, grp: str, col: str) -> str:
    return f"""SELECT '{panel}' AS panel, q.grp, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_lo,
  round(max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END), 6) AS whisker_hi,
  CAST(sum(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers,
  count(*) AS n
FROM (SELECT {grp} AS grp, {col} AS v FROM dflt WHERE {col} IS NOT NULL) d
JOIN (SELECT {grp} AS grp, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median,
             quantile_cont({col}, 0.75) AS q3 FROM dflt WHERE {col} IS NOT NULL GROUP BY {grp}) q
  ON d.grp = q.grp
GROUP BY q.grp, q1, median, q3"""


def _stack_sql(src: str, dims: list[str], by: str) -> str:
    parts = [f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS level, {by} FROM {src}" for d in dims]
    return "(" + " UNION ALL ".join(parts) + ")"


_RAW_COLS = ["id", "loan_amnt", "funded_amnt", "funded_amnt_inv", "term", "int_rate", "installment", "grade",
             "emp_title", "emp_length", "home_ownership", "annual_inc", "verification_status", "issue_d",
             "loan_status", "pymnt_plan", "purpose", "title", "addr_state", "dti", "delinq_amnt", "pub_rec",
             "earliest_cr_line", "revol_util", "initial_list_status", "next_pymnt_d", "last_credit_pull_d",
             "policy_code", "application_type"]
_RAW_NUM = {"id", "loan_amnt", "funded_amnt", "funded_amnt_inv", "installment", "annual_inc", "dti",
            "delinq_amnt", "pub_rec", "policy_code"}


def _profile_sql(exprs: dict[str, str], value: str) -> str:
    sel = ", ".join(f"{e} AS {c}" for c, e in exprs.items())
    return (f"SELECT column_name, {value} FROM (SELECT {sel} FROM raw) "
            f"UNPIVOT ({value} FOR column_name IN ({', '.join(exprs)}))")


def _sparse_sql() -> str:
    ex = {c: f"avg(CASE WHEN {c} IS NULL OR {c} = {'0' if c in _RAW_NUM else chr(39) + '0' + chr(39)} "
             f"THEN 1.0 ELSE 0.0 END)" for c in _RAW_COLS}
    return (_CTE + f"SELECT column_name, round(v, 6) AS zero_or_null_share, v > {SPARSE_SHARE} AS dropped FROM ("
            + _profile_sql(ex, "v") + ")")


def _constant_sql() -> str:
    parts = []
    for c in _RAW_COLS:
        blank = "0" if c in _RAW_NUM else f"sum(CASE WHEN trim(CAST({c} AS VARCHAR)) = '' THEN 1 ELSE 0 END)"
        parts.append(f"""SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS min_value,
  CAST(max({c}) AS VARCHAR) AS max_value, count(*) AS n, count(*) - count({c}) AS nulls, {blank} AS blanks FROM raw""")
    return (_CTE + "SELECT column_name, min_value, max_value, round(nulls / n, 6) AS null_share, "
            "round(blanks / n, 6) AS blank_share, (nulls = n) OR (nulls = 0 AND min_value = max_value) AS constant FROM ("
            + " UNION ALL ".join(parts) + ")")


ORACLES = {
    "csv_round_trip": _CTE + "SELECT id, emp_title, title, int_rate, revol_util, loan_amnt FROM raw",
    "loans_clean": _CTE + "SELECT * FROM clean",
    "sparse_columns": _sparse_sql(),
    "constant_columns": _constant_sql(),
    "null_profile": f"""WITH s AS ({bind.STORE_SQL})
SELECT column_name, null_count FROM (SELECT
  {', '.join(f"CAST(count(*) - count({c}) AS BIGINT) AS {c}" for c in
             ['Row_ID', 'Order_Date', 'Ship_Date', 'Postal_Code', 'Market', 'Segment', 'Sales', 'Quantity', 'Profit'])}
  FROM s) UNPIVOT (null_count FOR column_name IN (Row_ID, Order_Date, Ship_Date, Postal_Code, Market, Segment, Sales, Quantity, Profit))""",
    "duplicate_count": _CTE + f""", pr AS ({bind.PRICE_SQL}), so AS ({bind.STORE_SQL})
SELECT (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM raw GROUP BY id)) AS dup_loan_ids,
  (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM pr
     GROUP BY car_name, status, flag, ptype, cylinders, quantity, discount, tax, size, retail, price)) AS dup_price_rows,
  (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM so GROUP BY Row_ID)) AS dup_store_ids""",
    "factor_codes": _CTE + """SELECT id, raw.int_rate, l.code AS int_rate_code FROM raw JOIN
  (SELECT int_rate, row_number() OVER (ORDER BY int_rate) AS code FROM (SELECT DISTINCT int_rate FROM raw WHERE int_rate IS NOT NULL)) l
  ON raw.int_rate = l.int_rate""",
    "parse_month_year": _CTE + f"""SELECT id, issue_d, {_my_sql('issue_d')} AS issue_date,
  {_my_sql('earliest_cr_line')} AS earliest_cr_date FROM raw""",
    "code_lookup": _CTE + "SELECT id, raw.addr_state, st.state_name FROM raw LEFT JOIN st ON raw.addr_state = st.state_code",
    "headerless_round_trip": """SELECT CAST(c_custkey AS BIGINT) AS Customer_Key, c_name AS Customer_Name, CAST(c_nationkey AS BIGINT) AS Nation_Key,
  CAST(c_acctbal AS DOUBLE) AS Balance_Credit FROM customer""",
    "issue_smooth": _smooth_sql("SELECT CAST(date_diff('day', DATE '1970-01-01', issue_d) AS DOUBLE) AS x, CAST(funded_amnt AS DOUBLE) AS y FROM clean"),
    "income_smooth": _smooth_sql("SELECT CAST(annual_inc AS DOUBLE) AS x, CAST(installment AS DOUBLE) AS y FROM dflt"),
    "income_trend": _CTE + f""", cuts AS (SELECT quantile_cont(annual_inc, [{", ".join(str(k / 10) for k in range(1, 10))}]) AS q
  FROM dflt WHERE annual_inc IS NOT NULL),
b AS (SELECT len(list_filter(q, lambda x: x < annual_inc)) AS bin, annual_inc, installment FROM dflt, cuts WHERE annual_inc IS NOT NULL)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(min(annual_inc), 4) AS lo, round(max(annual_inc), 4) AS hi,
  round(avg(installment), 4) AS mean, round(stddev_samp(installment) / sqrt(count(installment)), 4) AS se FROM b GROUP BY bin""",
    "defaulter_ownership": _CTE + "SELECT home_ownership, count(*) AS n FROM dflt GROUP BY home_ownership",
    "ownership_verification": _CTE + "SELECT home_ownership, verification_status, count(*) AS n FROM dflt GROUP BY ALL",
    "default_by_purpose": _CTE + "SELECT purpose, count(*) AS n FROM dflt GROUP BY purpose",
    "status_crosstab": _CTE + f"""SELECT dimension, level, loan_status, count(*) AS n
  FROM {_stack_sql('clean', CROSSTAB_DIMS, 'loan_status')} GROUP BY ALL""",
    "amount_histogram": _CTE + f""", rg AS (SELECT min(loan_amnt) AS lo, max(loan_amnt) AS hi FROM dflt),
b AS (SELECT CAST(CASE WHEN (hi - lo) / {HIST_BINS - 1} = 0 THEN 0
    ELSE least(greatest(ceil((loan_amnt - lo) / ((hi - lo) / {HIST_BINS - 1}) - 0.5), 0), {HIST_BINS - 1}) END AS INTEGER) AS bin,
  lo, hi FROM dflt, rg WHERE loan_amnt IS NOT NULL)
SELECT bin, round(lo + (bin - 0.5) * ((hi - lo) / {HIST_BINS - 1}), 4) AS lo,
  round(lo + (bin + 0.5) * ((hi - lo) / {HIST_BINS - 1}), 4) AS hi, count(*) AS n FROM b GROUP BY bin, b.lo, b.hi""",
    "box_stats": _CTE + _box_sql("int_rate_by_term", "term", "int_rate") + " UNION ALL "
                 + _box_sql("funded_inv_by_grade", "grade", "funded_amnt_inv"),
    "binned_trend": _CTE + """, pb AS (SELECT issue_d AS bin, count(*) AS n, avg(funded_amnt) AS mean,
  stddev_samp(funded_amnt) AS sd FROM clean WHERE funded_amnt IS NOT NULL GROUP BY issue_d)
SELECT bin AS issue_month, n, round(mean, 4) AS mean, round(sd / sqrt(n), 4) AS se,
  round(avg(mean) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS moving_mean FROM pb""",
    "loans_corr_matrix": _CTE + f""", comp AS (SELECT {', '.join(CORR_COLS)} FROM dflt
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in CORR_COLS)})
SELECT a.v AS row_var, b.v AS col_var, round(CASE WHEN a.v = b.v THEN 1.0 ELSE
  CASE {' '.join(f"WHEN least(a.i, b.i) = {i} AND greatest(a.i, b.i) = {j} THEN (SELECT corr({x}, {y}) FROM comp)"
                 for i, x in enumerate(CORR_COLS) for j, y in enumerate(CORR_COLS) if i < j)} END END, 6) AS corr,
  (SELECT count(*) FROM comp) AS n_complete
FROM (SELECT unnest({bind._sql_list(CORR_COLS)}) AS v, unnest(range({len(CORR_COLS)})) AS i) a,
     (SELECT unnest({bind._sql_list(CORR_COLS)}) AS v, unnest(range({len(CORR_COLS)})) AS i) b""",
    "category_frequency": f"""WITH p AS (SELECT *, split_part(car_name, ' ', 1) AS brand FROM ({bind.PRICE_SQL}))
SELECT dimension, level, count(*) AS n FROM {_stack_sql('p', ['status', 'ptype', 'cylinders', 'brand'], "'all' AS a")}
GROUP BY dimension, level""",
}
