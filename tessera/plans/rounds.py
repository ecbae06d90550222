"""Investment rounds workload: join, clean, sector mapping, country and sector ranking.

Semantics kept from the reference: NULL keys match (N2), a missing amount
becomes -1 before means and sums (N1), the deal band is strict (N5), the
"total number of investments" is also reported as the sum of the repeated
per-sector count (N6), ties break on the key (N7), ranks are computed, not
typed in (N20).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import lower_key, part, split_fixed
from tessera.operators.aggregate import group_means, in_open_range, totals_on_rows
from tessera.operators.profile import distinct_count
from tessera.operators.rank import rank_within, top_n, top_row_per_group
from tessera.operators.relate import maybe_broadcast, null_safe_join
from tessera.operators.reshape import wide_to_long
from tessera.functions.numeric import rnd
from tessera.plans import bind
from tessera.session import materialize

# Parameters of the workload (the reference's four named round types, its
# 9 / 3 country counts; amounts are scaled to the driver tables).
ROUND_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
ROUND_TYPE = "1-URGENT"
BAND = (50_000.0, 150_000.0)
SENTINEL = -1.0
TOP_COUNTRIES = 9
DEAL_COUNTRIES = 3
SECTOR_RANKS = 3
MAPPING_ROWS = 100_000


# ------------------------------------------------------------------ operators
def master_frame(rounds: DataFrame, companies: DataFrame) -> DataFrame:
    """J1 + X1: lower-cased keys, inner join where NULL matches NULL."""
    r = rounds.withColumn("company_permalink", lower_key("company_permalink"))
    c = companies.withColumn("permalink", lower_key("permalink"))
    return null_safe_join(r, c, "company_permalink", "permalink")


def fill_amount(master: DataFrame, col: str = "raised_amount_usd", sentinel: float | None = SENTINEL) -> DataFrame:
    """Missing amount -> sentinel (``None`` keeps NULL, i.e. NULL-skipping)."""
    out = master.withColumn("was_missing", F.col(col).isNull())
    return out if sentinel is None else out.withColumn(col, F.coalesce(F.col(col), F.lit(sentinel)))


def sector_long(mapping_wide: DataFrame, category: str = "category_list") -> DataFrame:
    """R1 + P4: wide 0/1 mapping -> (primary_sector, main_sector)."""
    cols = [c for c in mapping_wide.columns if c != category]
    return (wide_to_long(mapping_wide, [category], cols, "main_sector", "flag")
            .withColumnRenamed(category, "primary_sector"))


def with_primary_sector(master: DataFrame) -> DataFrame:
    """X2 + N22: first of at most three ``|`` parts of the category list."""
    return master.withColumn("primary_sector", part(split_fixed("category_list", r"\|", 3), 0))


def sector_merge(master: DataFrame, mapping_long: DataFrame) -> DataFrame:
    """Inner join with the (checked-small) long mapping on the primary sector."""
    m = maybe_broadcast(mapping_long, MAPPING_ROWS)
    return null_safe_join(with_primary_sector(master), m, "primary_sector", "primary_sector")


def country_ranking(filled: DataFrame, round_type: str = ROUND_TYPE) -> DataFrame:
    """Total amount per country for one round type (-1 sentinels included)."""
    return (filled.where(F.col("funding_round_type") == round_type)
                  .groupBy("country_code").agg(F.sum("raised_amount_usd").alias("total_invest")))


def deals(merged: DataFrame, countries: DataFrame, round_type: str = ROUND_TYPE,
          band: tuple[float, float] = BAND) -> DataFrame:
    """F2 + J3 + W5: deals of the chosen countries, type and strict band, with
    the per-(country, sector) sum and count on every row."""
    chosen = merged.join(F.broadcast(countries.select("country_code")), "country_code", "left_semi")
    d = chosen.where((F.col("funding_round_type") == round_type)
                     & in_open_range("raised_amount_usd", *band))
    # the filtered deals are read twice (totals + join back): materialise them once
    return totals_on_rows(materialize(d), ["country_code", "main_sector"], "raised_amount_usd")


# ------------------------------------------------------------------ bindings
def _inputs(spark, sf_dir):
    return bind.rounds_view(spark, sf_dir), bind.companies_view(spark, sf_dir)


def _filled(spark, sf_dir):
    return fill_amount(master_frame(*_inputs(spark, sf_dir)))


def _top_countries(filled, n=TOP_COUNTRIES):
    return top_n(country_ranking(filled), [F.col("total_invest").desc(), "country_code"], n)


def _deals(spark, sf_dir):
    filled = _filled(spark, sf_dir)
    merged = sector_merge(filled, sector_long(bind.mapping_wide_view(spark, sf_dir)))
    return deals(merged, _top_countries(filled, DEAL_COUNTRIES))


def q_rounds_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = master_frame(*_inputs(spark, sf_dir))
    return m.select("round_id", "company_permalink", "funding_round_type",
                    rnd("raised_amount_usd", 2).alias("raised_amount_usd"),
                    "country_code", "category_list")


def q_distinct_keys(spark, sf_dir):
    r, c = _inputs(spark, sf_dir)
    m = master_frame(r, c)
    a = distinct_count(r.select(lower_key("company_permalink").alias("k")), "k").first()[0]
    b = distinct_count(c.select(lower_key("permalink").alias("k")), "k").first()[0]
    n = m.count()
    return spark.createDataFrame([(a, b, n, len(m.columns))],
                                 "n_round_companies long, n_companies long, n_master_rows long, n_master_cols int")


def q_fill_missing(spark, sf_dir):
    f = _filled(spark, sf_dir)
    return f.select("round_id", rnd("raised_amount_usd", 2).alias("raised_amount_usd"), "was_missing")


def q_funding_type_mean(spark, sf_dir):
    g = group_means(_filled(spark, sf_dir), "funding_round_type", "raised_amount_usd", ROUND_TYPES)
    return g.select("funding_round_type", rnd("mean_amount", 2).alias("mean_amount"), "n")


def q_funding_type_fit(spark, sf_dir):
    g = group_means(_filled(spark, sf_dir), "funding_round_type", "raised_amount_usd", ROUND_TYPES)
    return g.select("funding_round_type", rnd("mean_amount", 2).alias("mean_amount"),
                    in_open_range("mean_amount", *BAND).alias("in_band"))


def q_top_countries(spark, sf_dir):
    top = _top_countries(_filled(spark, sf_dir))
    return top.select("country_code", rnd("total_invest", 2).alias("total_invest"))


def q_wide_to_long(spark, sf_dir):
    return sector_long(bind.mapping_wide_view(spark, sf_dir))


def q_split_category(spark, sf_dir):
    c = bind.companies_view(spark, sf_dir)
    parts = split_fixed("category_list", r"\|", 3)
    return c.select("permalink", part(parts, 0).alias("part1"), part(parts, 1).alias("part2"),
                    part(parts, 2).alias("part3"))


def q_sector_merge(spark, sf_dir):
    filled = _filled(spark, sf_dir)
    merged = sector_merge(filled, sector_long(bind.mapping_wide_view(spark, sf_dir)))
    return merged.select("round_id", "primary_sector", "main_sector", "country_code",
                         rnd("raised_amount_usd", 2).alias("raised_amount_usd"))


def q_country_sector_deals(spark, sf_dir):
    d = _deals(spark, sf_dir)
    return d.select("round_id", "country_code", "main_sector", "company_permalink",
                    rnd("raised_amount_usd", 2).alias("raised_amount_usd"),
                    rnd("total_invest", 2).alias("total_invest"), "number_of_investments")


def q_sector_counts(spark, sf_dir):
    d = _deals(spark, sf_dir)
    return d.groupBy("country_code", "main_sector").agg(F.count(F.lit(1)).alias("n"))


def q_country_totals(spark, sf_dir):
    d = _deals(spark, sf_dir)
    return d.groupBy("country_code").agg(
        F.count(F.lit(1)).alias("total_investments"),
        F.sum("number_of_investments").alias("sum_repeated_count"),
        rnd(F.sum("raised_amount_usd"), 2).alias("total_amount"))


def _sector_rank(d):
    s = d.select("country_code", "main_sector", "number_of_investments").distinct()
    return rank_within(s, ["country_code"], [F.col("number_of_investments").desc(), "main_sector"],
                       SECTOR_RANKS, "sector_rank")


def q_top3_sectors(spark, sf_dir):
    return _sector_rank(_deals(spark, sf_dir))


def q_top_company(spark, sf_dir):
    d = _deals(spark, sf_dir)
    ranks = _sector_rank(d).where(F.col("sector_rank") <= 2).select("country_code", "main_sector", "sector_rank")
    best = top_row_per_group(
        d.join(F.broadcast(ranks), ["country_code", "main_sector"]),   # <= 2 rows per chosen country
        ["country_code", "main_sector"],
        [("raised_amount_usd", False), ("company_permalink", True), ("round_id", True)])
    return best.select("country_code", "sector_rank", "main_sector", "company_permalink",
                       rnd("raised_amount_usd", 2).alias("raised_amount_usd"))


QUERIES = {
    "rounds_master": q_rounds_master,
    "distinct_keys": q_distinct_keys,
    "fill_missing": q_fill_missing,
    "funding_type_mean": q_funding_type_mean,
    "funding_type_fit": q_funding_type_fit,
    "top_countries": q_top_countries,
    "wide_to_long": q_wide_to_long,
    "split_category": q_split_category,
    "sector_merge": q_sector_merge,
    "country_sector_deals": q_country_sector_deals,
    "sector_counts": q_sector_counts,
    "country_totals": q_country_totals,
    "top3_sectors": q_top3_sectors,
    "top_company": q_top_company,
}

# ------------------------------------------------------------------ oracles
_types = ", ".join(f"'{x}'" for x in ROUND_TYPES)
_CTE = f"""WITH r AS ({bind.ROUNDS_SQL}),
c AS ({bind.COMPANIES_SQL}),
master AS (
  SELECT r.round_id, lower(r.company_permalink) AS company_permalink, r.funding_round_type,
         r.raised_amount_usd, c.name, c.country_code, c.category_list
  FROM r JOIN c ON lower(r.company_permalink) IS NOT DISTINCT FROM lower(c.permalink)),
filled AS (
  SELECT *, raised_amount_usd IS NULL AS was_missing,
         coalesce(raised_amount_usd, {SENTINEL}) AS amt FROM master),
mw AS ({bind.MAPPING_WIDE_SQL}),
ml AS (
  SELECT category_list AS primary_sector, main_sector
  FROM mw UNPIVOT (flag FOR main_sector IN ({', '.join(bind.MAPPING_COLS)})) WHERE NOT (flag = 0)),
merged AS (
  SELECT f.*, ml.primary_sector, ml.main_sector
  FROM filled f JOIN ml ON split_part(f.category_list, '|', 1) IS NOT DISTINCT FROM ml.primary_sector),
ranking AS (
  SELECT country_code, sum(amt) AS total_invest FROM filled
  WHERE funding_round_type = '{ROUND_TYPE}' GROUP BY country_code),
top3c AS (SELECT country_code FROM ranking ORDER BY total_invest DESC, country_code LIMIT {DEAL_COUNTRIES}),
d0 AS (
  SELECT * FROM merged WHERE country_code IN (SELECT country_code FROM top3c)
    AND funding_round_type = '{ROUND_TYPE}' AND amt > {BAND[0]} AND amt < {BAND[1]}),
d AS (
  SELECT *, sum(amt) OVER (PARTITION BY country_code, main_sector) AS total_invest,
         count(*) OVER (PARTITION BY country_code, main_sector) AS number_of_investments FROM d0),
srank AS (
  SELECT * FROM (
    SELECT country_code, main_sector, number_of_investments,
           row_number() OVER (PARTITION BY country_code ORDER BY number_of_investments DESC, main_sector) AS sector_rank
    FROM (SELECT DISTINCT country_code, main_sector, number_of_investments FROM d)) WHERE sector_rank <= {SECTOR_RANKS})
"""

ORACLES = {
    "rounds_master": _CTE + """SELECT round_id, company_permalink, funding_round_type,
  round(raised_amount_usd, 2) AS raised_amount_usd, country_code, category_list FROM master""",
    "distinct_keys": _CTE + """SELECT
  (SELECT count(DISTINCT lower(company_permalink)) + max(CASE WHEN company_permalink IS NULL THEN 1 ELSE 0 END) FROM r) AS n_round_companies,
  (SELECT count(DISTINCT lower(permalink)) + max(CASE WHEN permalink IS NULL THEN 1 ELSE 0 END) FROM c) AS n_companies,
  (SELECT count(*) FROM master) AS n_master_rows, 7 AS n_master_cols""",
    "fill_missing": _CTE + "SELECT round_id, round(amt, 2) AS raised_amount_usd, was_missing FROM filled",
    "funding_type_mean": _CTE + f"""SELECT funding_round_type, round(avg(amt), 2) AS mean_amount, count(*) AS n
  FROM filled WHERE funding_round_type IN ({_types}) GROUP BY funding_round_type""",
    "funding_type_fit": _CTE + f"""SELECT funding_round_type, round(avg(amt), 2) AS mean_amount,
  avg(amt) > {BAND[0]} AND avg(amt) < {BAND[1]} AS in_band
  FROM filled WHERE funding_round_type IN ({_types}) GROUP BY funding_round_type""",
    "top_countries": _CTE + f"""SELECT country_code, round(total_invest, 2) AS total_invest
  FROM ranking ORDER BY total_invest DESC, country_code LIMIT {TOP_COUNTRIES}""",
    "wide_to_long": _CTE + "SELECT * FROM ml",
    "split_category": _CTE + """SELECT permalink,
  split_part(category_list, '|', 1) AS part1,
  CASE WHEN len(string_split(category_list, '|')) >= 2 THEN split_part(category_list, '|', 2) ELSE '' END AS part2,
  CASE WHEN len(string_split(category_list, '|')) >= 3
       THEN array_to_string(list_slice(string_split(category_list, '|'), 3, len(string_split(category_list, '|'))), '|') ELSE '' END AS part3
  FROM c""",
    "sector_merge": _CTE + """SELECT round_id, primary_sector, main_sector, country_code,
  round(amt, 2) AS raised_amount_usd FROM merged""",
    "country_sector_deals": _CTE + """SELECT round_id, country_code, main_sector, company_permalink,
  round(amt, 2) AS raised_amount_usd, round(total_invest, 2) AS total_invest, number_of_investments FROM d""",
    "sector_counts": _CTE + "SELECT country_code, main_sector, count(*) AS n FROM d GROUP BY ALL",
    "country_totals": _CTE + """SELECT country_code, count(*) AS total_investments,
  CAST(sum(number_of_investments) AS BIGINT) AS sum_repeated_count, round(sum(amt), 2) AS total_amount
  FROM d GROUP BY country_code""",
    "top3_sectors": _CTE + "SELECT country_code, main_sector, number_of_investments, CAST(sector_rank AS INTEGER) AS sector_rank FROM srank",
    "top_company": _CTE + """SELECT country_code, sector_rank, main_sector, company_permalink, raised_amount_usd FROM (
  SELECT d.country_code, CAST(s.sector_rank AS INTEGER) AS sector_rank, d.main_sector, d.company_permalink,
         round(d.amt, 2) AS raised_amount_usd,
         row_number() OVER (PARTITION BY d.country_code, d.main_sector
                            ORDER BY d.amt DESC, d.company_permalink, d.round_id) AS rn
  FROM d JOIN srank s ON d.country_code = s.country_code AND d.main_sector = s.main_sector
  WHERE s.sector_rank <= 2) WHERE rn = 1""",
}
