"""Stand-in inputs built from the driver tables.

Each view only renames and re-types driver columns into the schema a workload
expects (text dates, percent text, blanks, NULL amounts); none of the
workload's own work happens here. Every view exists twice: as a DataFrame and
as SQL text for the DuckDB oracle, built from the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relate import maybe_broadcast
from tessera.sources.files import read_table

# Fixed values of the driver schema: the five region names.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
# Money amounts are exact decimals: sums do not depend on summation order.
MONEY = "decimal(18,4)"
# Dimension tables are tiny in TPC-H style data; their broadcast is size-checked.
DIM_ROWS = 100_000


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def _geo(spark, sf_dir) -> DataFrame:
    nation = t(spark, sf_dir, "nation")
    region = t(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # 5 rows


def _customer_geo(spark, sf_dir) -> DataFrame:
    cust = t(spark, sf_dir, "customer")
    geo = maybe_broadcast(_geo(spark, sf_dir), DIM_ROWS)
    return cust.join(geo, cust.c_nationkey == geo.n_nationkey)


GEO_SQL = "nation JOIN region ON n_regionkey = r_regionkey"
CUSTOMER_GEO_SQL = f"customer JOIN {GEO_SQL} ON c_nationkey = n_nationkey"


# ---------------------------------------------------------------- rounds
def rounds_view(spark, sf_dir) -> DataFrame:
    """Funding rounds: one per order; amount missing for status P; key in mixed case."""
    o = t(spark, sf_dir, "orders")
    key = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    return o.select(
        F.col("o_orderkey").alias("round_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.upper(key)).otherwise(key).alias("company_permalink"),
        F.col("o_orderpriority").alias("funding_round_type"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice")).alias("raised_amount_usd"),
    )


ROUNDS_SQL = """SELECT o_orderkey AS round_id,
  CASE WHEN o_orderkey % 2 = 0 THEN upper('Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'))
       ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS company_permalink,
  o_orderpriority AS funding_round_type,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS raised_amount_usd
FROM orders"""


def companies_view(spark, sf_dir) -> DataFrame:
    """Companies: key, name, country, and a ``|`` separated category list (4 parts)."""
    cg = _customer_geo(spark, sf_dir)
    return cg.select(
        F.col("c_name").alias("permalink"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("country_code"),
        F.concat_ws("|", "c_mktsegment", "r_name", "n_name", "c_name").alias("category_list"),
    )


COMPANIES_SQL = f"""SELECT c_name AS permalink, c_name AS name, n_name AS country_code,
  c_mktsegment || '|' || r_name || '|' || n_name || '|' || c_name AS category_list
FROM {CUSTOMER_GEO_SQL}"""


def _region_col(r: str) -> str:
    return r.replace(" ", "_")


def mapping_wide_view(spark, sf_dir) -> DataFrame:
    """Wide category -> sector 0/1 table: one column per region, 1 where the
    segment has its most customers (ties give two 1s)."""
    cg = _customer_geo(spark, sf_dir)
    counts = cg.groupBy("c_mktsegment").pivot("r_name", REGIONS).count().fillna(0)
    top = F.greatest(*[F.col(r) for r in REGIONS])
    return counts.select(
        F.col("c_mktsegment").alias("category_list"),
        *[F.when(F.col(r) == top, 1).otherwise(0).alias(_region_col(r)) for r in REGIONS])


MAPPING_COLS = [_region_col(r) for r in REGIONS]
MAPPING_WIDE_SQL = (
    "SELECT category_list, "
    + ", ".join(f"CASE WHEN {_region_col(r)} = greatest({', '.join(_region_col(x) for x in REGIONS)}) "
                f"THEN 1 ELSE 0 END AS {_region_col(r)}" for r in REGIONS)
    + " FROM (SELECT c_mktsegment AS category_list, "
    + ", ".join(f"CAST(sum(CASE WHEN r_name = '{r}' THEN 1 ELSE 0 END) AS BIGINT) AS {_region_col(r)}"
                for r in REGIONS)
    + f" FROM {CUSTOMER_GEO_SQL} GROUP BY c_mktsegment)"
)


# ---------------------------------------------------------------- loans
# Two-letter codes given to the 25 nations; three are not US states.
NATION_STATE_CODES = ["CA", "NY", "TX", "FL", "IL", "PA", "OH", "GA", "NC", "MI",
                      "NJ", "VA", "WA", "AZ", "MA", "XX", "MD", "CO", "MN", "PR",
                      "WI", "MO", "DC", "OR", "KY"]


def _arr(vals: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in vals])


def _sql_list(vals: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in vals) + "]"


def loans_view(spark, sf_dir) -> DataFrame:
    """Loan book: lineitem x orders x customer x part, with text dates, percent
    text, blanks, NULLs, constant and mostly-zero columns."""
    li = t(spark, sf_dir, "lineitem")
    o = t(spark, sf_dir, "orders")
    c = t(spark, sf_dir, "customer")
    p = t(spark, sf_dir, "part")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(c, o.o_custkey == c.c_custkey)
           .join(p, li.l_partkey == p.p_partkey))
    q = F.col("l_quantity")
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_extendedprice").alias("loan_amnt"),
        F.col("l_extendedprice").alias("funded_amnt"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast(MONEY).cast("double").alias("funded_amnt_inv"),
        F.when(F.col("l_linestatus") == "F", " 36 months").otherwise(" 60 months").alias("term"),
        F.concat(F.format_number(F.col("l_discount") * 100 + 5, 2), F.lit("%")).alias("int_rate"),
        (F.col("l_extendedprice") / 36).cast(MONEY).cast("double").alias("installment"),
        F.substring("o_orderpriority", 1, 1).alias("grade"),
        F.when(F.col("l_linenumber") == 1, F.lit("")).otherwise(F.col("p_name")).alias("emp_title"),
        F.when(q < 5, F.lit("< 1 year")).when(q >= 45, F.lit("10+ years"))
         .otherwise(F.concat(F.floor(q / 5).cast("string"), F.lit(" years"))).alias("emp_length"),
        F.col("c_mktsegment").alias("home_ownership"),
        F.col("c_acctbal").alias("annual_inc"),
        F.when(F.col("o_orderstatus") == "F", "Verified").when(F.col("o_orderstatus") == "O", "Not Verified")
         .otherwise("Source Verified").alias("verification_status"),
        F.date_format("o_orderdate", "MMM-yy").alias("issue_d"),
        F.when(F.col("l_returnflag") == "R", "Charged Off").when(F.col("l_returnflag") == "A", "Fully Paid")
         .otherwise("Current").alias("loan_status"),
        F.lit("n").alias("pymnt_plan"),
        F.lower("p_type").alias("purpose"),
        F.when(F.col("l_linenumber") == 2, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("title"),
        F.element_at(_arr(NATION_STATE_CODES), F.col("c_nationkey") + 1).alias("addr_state"),
        F.round(F.col("l_tax") * 100, 2).alias("dti"),
        F.when(q <= 25, F.lit(0.0)).otherwise(q - 25).alias("delinq_amnt"),
        F.when(q <= 10, F.lit(0.0)).otherwise(q).alias("pub_rec"),
        F.date_format("l_shipdate", "MMM-yy").alias("earliest_cr_line"),
        F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(
            F.concat(F.format_number(F.col("l_tax") * 1000, 1), F.lit("%"))).alias("revol_util"),
        F.lit("f").alias("initial_list_status"),
        F.when(F.col("l_orderkey") % 2 == 0, F.lit("")).otherwise(
            F.date_format("l_shipdate", "MMM-yy")).alias("next_pymnt_d"),
        F.date_format("o_orderdate", "MMM-yy").alias("last_credit_pull_d"),
        F.lit(1).alias("policy_code"),
        F.lit("INDIVIDUAL").alias("application_type"),
    )


LOANS_SQL = f"""SELECT l_orderkey * 10 + l_linenumber AS id,
  l_extendedprice AS loan_amnt, l_extendedprice AS funded_amnt,
  CAST(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS DOUBLE) AS funded_amnt_inv,
  CASE WHEN l_linestatus = 'F' THEN ' 36 months' ELSE ' 60 months' END AS term,
  printf('%.2f', l_discount * 100 + 5) || '%' AS int_rate,
  CAST(CAST(l_extendedprice / 36 AS DECIMAL(18,4)) AS DOUBLE) AS installment,
  substr(o_orderpriority, 1, 1) AS grade,
  CASE WHEN l_linenumber = 1 THEN '' ELSE p_name END AS emp_title,
  CASE WHEN l_quantity < 5 THEN '< 1 year' WHEN l_quantity >= 45 THEN '10+ years'
       ELSE CAST(CAST(floor(l_quantity / 5) AS BIGINT) AS VARCHAR) || ' years' END AS emp_length,
  c_mktsegment AS home_ownership, c_acctbal AS annual_inc,
  CASE WHEN o_orderstatus = 'F' THEN 'Verified' WHEN o_orderstatus = 'O' THEN 'Not Verified'
       ELSE 'Source Verified' END AS verification_status,
  strftime(o_orderdate, '%b-%y') AS issue_d,
  CASE WHEN l_returnflag = 'R' THEN 'Charged Off' WHEN l_returnflag = 'A' THEN 'Fully Paid'
       ELSE 'Current' END AS loan_status,
  'n' AS pymnt_plan, lower(p_type) AS purpose,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE p_brand END AS title,
  {_sql_list(NATION_STATE_CODES)}[c_nationkey + 1] AS addr_state,
  round(l_tax * 100, 2) AS dti,
  CASE WHEN l_quantity <= 25 THEN 0.0 ELSE l_quantity - 25 END AS delinq_amnt,
  CASE WHEN l_quantity <= 10 THEN 0.0 ELSE l_quantity END AS pub_rec,
  strftime(l_shipdate, '%b-%y') AS earliest_cr_line,
  CASE WHEN l_linenumber = 7 THEN '' ELSE printf('%.1f', l_tax * 1000) || '%' END AS revol_util,
  'f' AS initial_list_status,
  CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE strftime(l_shipdate, '%b-%y') END AS next_pymnt_d,
  strftime(o_orderdate, '%b-%y') AS last_credit_pull_d,
  1 AS policy_code, 'INDIVIDUAL' AS application_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey"""


# ---------------------------------------------------------------- price
# The cylinder words given to line numbers 1..7 ("ten", "twelve"
# are outside the rule's word list and fall to its default).
CYLINDER_BY_LINE = ["four", "six", "five", "eight", "two", "twelve", "ten"]


def price_view(spark, sf_dir) -> DataFrame:
    """Price observations: lineitem x part, numeric, two-level and multi-level attributes."""
    li = t(spark, sf_dir, "lineitem")
    p = t(spark, sf_dir, "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs_id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("car_name"),
        F.col("l_linestatus").alias("status"),
        F.col("l_returnflag").alias("flag"),
        F.col("p_type").alias("ptype"),
        F.element_at(_arr(CYLINDER_BY_LINE), F.col("l_linenumber")).alias("cylinders"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("retail"),
        F.col("l_extendedprice").alias("price"),
    )


PRICE_SQL = f"""SELECT l_orderkey * 10 + l_linenumber AS obs_id,
  p_name || ' ' || p_brand AS car_name, l_linestatus AS status, l_returnflag AS flag,
  p_type AS ptype, {_sql_list(CYLINDER_BY_LINE)}[l_linenumber] AS cylinders,
  l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
  CAST(p_size AS DOUBLE) AS size, p_retailprice AS retail, l_extendedprice AS price
FROM lineitem JOIN part ON l_partkey = p_partkey"""


# ---------------------------------------------------------------- digits
def digits_view(spark, sf_dir) -> DataFrame:
    """Digit images: id, label, 64 features as an array (pixels = features scaled to 0..255)."""
    e = t(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), F.col("label").alias("digit"),
                    F.col("embedding").cast("array<double>").alias("features"))


# ---------------------------------------------------------------- forecast
def store_view(spark, sf_dir) -> DataFrame:
    """Store order lines: text dates (``dd-MM-yyyy``, mixed ``/`` and ``-``),
    market, segment, sales, quantity, profit, a mostly-NULL postal code.

    A line is shuffled twice, for its part and for its order, as numbers; the order's
    customer, region and text date are found once an order.
    """
    discounted = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate", discounted.alias("__sales"))
    p = t(spark, sf_dir, "part")
    lines = li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "__sales",
        (F.col("__sales") - F.col("l_quantity") * F.col("p_retailprice")).alias("__profit"))
    def text_date(key, date):
        d = F.date_format(date, "dd-MM-yyyy")
        return F.when(F.col(key) % 2 == 1, F.translate(d, "-", "/")).otherwise(d)

    o = t(spark, sf_dir, "orders")
    cg = _customer_geo(spark, sf_dir)
    orders = o.join(cg, o.o_custkey == cg.c_custkey).select(
        "o_orderkey", text_date("o_orderkey", "o_orderdate").alias("__order_date"), "r_name", "c_mktsegment",
        F.when(F.col("c_nationkey") == 0, F.col("c_custkey")).alias("__postal"))
    j = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("Row_ID"),
        F.col("__order_date").alias("Order_Date"),
        text_date("l_orderkey", "l_shipdate").alias("Ship_Date"),
        F.col("__postal").alias("Postal_Code"),
        F.col("r_name").alias("Market"),
        F.col("c_mktsegment").alias("Segment"),
        F.col("__sales").cast(MONEY).alias("Sales"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        F.col("__profit").cast(MONEY).alias("Profit"),
    )


STORE_SQL = f"""SELECT l_orderkey * 10 + l_linenumber AS Row_ID,
  CASE WHEN l_orderkey % 2 = 1 THEN replace(strftime(o_orderdate, '%d-%m-%Y'), '-', '/')
       ELSE strftime(o_orderdate, '%d-%m-%Y') END AS Order_Date,
  CASE WHEN l_orderkey % 2 = 1 THEN replace(strftime(l_shipdate, '%d-%m-%Y'), '-', '/')
       ELSE strftime(l_shipdate, '%d-%m-%Y') END AS Ship_Date,
  CASE WHEN c_nationkey = 0 THEN c_custkey END AS Postal_Code,
  r_name AS Market, c_mktsegment AS Segment,
  CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS Sales,
  CAST(l_quantity AS INTEGER) AS Quantity,
  CAST(l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice AS DECIMAL(18,4)) AS Profit
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN {CUSTOMER_GEO_SQL} ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey"""
