"""Bounded-memory exact quantiles, and physical-plan properties."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators.quantile import exact_quantiles
from conftest import SF_SMALL


def test_exact_quantiles_large_hot_group(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=30000)                 # one group holds most rows
    ints = rng.integers(0, 20, size=3000)        # many ties
    rows = [("hot", float(v)) for v in hot] + [("ties", float(v)) for v in ints] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    # accuracy 1000: the hot group (n = 30000 >= 2 * accuracy) takes the bracketed path
    got = {r["g"]: [r[f"q_{i}"] for i in range(5)] for r in exact_quantiles(df, ["g"], "v", probs, 1000).collect()}
    for g, xs in [("hot", hot), ("ties", ints.astype(float)), ("one", np.array([7.0]))]:
        assert np.allclose(got[g], np.percentile(xs, [p * 100 for p in probs]), rtol=0, atol=1e-12), g
    whole = exact_quantiles(df, [], "v", [0.5], 1000).first()
    assert abs(whole["q_0"] - np.percentile(np.concatenate([hot, ints, [7.0]]), 50)) < 1e-12


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    from tessera.plans import bind

    li = bind.t(spark, SF_SMALL, "lineitem")
    q = li.where(F.col("l_quantity") > 10).select("l_orderkey", "l_quantity")
    plan = _plan(q)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_dimension_joins_are_broadcast(spark):
    from tessera.plans import rounds, bind

    merged = rounds.sector_merge(rounds.fill_amount(rounds.master_frame(
        bind.rounds_view(spark, SF_SMALL), bind.companies_view(spark, SF_SMALL))),
        rounds.sector_long(bind.mapping_wide_view(spark, SF_SMALL)))
    plan = _plan(merged)
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_rollup_is_partial_aggregate(spark):
    from tessera.plans import forecast

    q = forecast.q_segment_month_rollup(spark, SF_SMALL)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2         # partial (map side) + final
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_lines_meet_orders_that_have_their_customer(spark):
    from tessera.plans import bind

    plan = bind.store_view(spark, SF_SMALL).select("Market", "Profit")._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    depth = {k: next(len(x) - len(x.lstrip(" :+-")) for x in joins if f"{k}#" in x) for k in ("l_orderkey", "o_custkey", "l_partkey")}
    assert depth["l_orderkey"] < depth["o_custkey"] and depth["l_orderkey"] < depth["l_partkey"]


def test_scores_and_slices_join_the_lines_once(spark):
    from tessera.plans import forecast

    for query in (forecast.q_segment_score, forecast.q_top_segments):
        plan = query(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan, query.__name__
