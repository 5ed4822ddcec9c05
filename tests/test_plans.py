"""Physical-plan checks: no cartesian products or Python evaluation, and
the layouts the design relies on."""

import re

import pytest

import __spark_entry__ as E


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["adjacency_pairs", "attraction_half_pct", "competition_affected", "features_stacked", "profile_demo", "profile_sv"],
)
def test_no_cartesian_or_python(spark, sf_small, name):
    p = plan_of(E.queries()[name](spark, sf_small))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in p, f"{name} plan contains {bad}"


def test_flagship_has_no_exchange_after_pair_join(spark, sf_small):
    # Exchanges: polygon aggregate and the explicit repartition by POSTALCODE
    # of the postal-code table; pairs, windows and the cut share that layout.
    p = E.queries()["attraction_half_pct"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange hashpartitioning") == 2
    assert "REPARTITION_BY_NUM" in p


def test_competition_has_no_exchange_after_pair_join(spark, sf_small):
    p = plan_of(E.queries()["competition_affected"](spark, sf_small))
    assert p.count("Exchange hashpartitioning") == 2


def test_profile_shuffles_no_store_text_below_the_sums(spark, sf_small):
    settings = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k in settings:
            spark.conf.set(k, "-1")
        df = E.queries()["profile_demo"](spark, sf_small)
        initial = plan_of(df)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    sums = initial[initial.index("partial_sum((PERCENT_ATTRACTION"):]
    # the cells keep their own layout; of the shares only code, share and number are exchanged for the join
    assert "SortMergeJoin [POSTALCODE" in sums and "REPARTITION_BY_NUM" in sums
    assert len(re.findall(r"hashpartitioning\(POSTALCODE#\d+, \d+\), ENSURE", sums)) == 1
    # both sides of the sums: (store number, metadata group)
    assert re.search(r"hashpartitioning\(__sid#\d+L, __gid#\d+L, \d+\)", initial)


def test_stage_lookup_pushes_the_filter_to_parquet(spark, sf_small):
    p = plan_of(E.queries()["postal_lookup_staged"](spark, sf_small))
    assert "PushedFilters: [IsNotNull(POSTALCODE), EqualTo(POSTALCODE,P0000003)]" in p


def test_bucketed_stage_reread_needs_no_exchange(spark, sf_small):
    df = E.queries()["attraction_half_pct_staged"](spark, sf_small)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange" not in final
