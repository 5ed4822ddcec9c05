"""The staged batch pipeline reproduces the registered queries' results."""

from catchment import schemas
from catchment.operators import levels as lv
from catchment.plans import inputs
from catchment.plans import staged as P
from catchment.sources import fixtures as fx


def _rows(df, cols):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=str)


def test_staged_pipeline_matches_queries(spark, sf_small):
    sf = sf_small
    g = P.gravity(spark, fx.stores_raw(spark, sf), [fx.ldu_part1(spark, sf), fx.ldu_part2(spark, sf)])
    assert g["store_postal_attraction_half_pct"].count() == inputs.half_pct(spark, sf).count()
    assert g["store_postal_attraction_full_pct"].count() == inputs.one_pct(spark, sf).count()
    assert P.competition(spark).count() > 0
    melted = P.features(spark, fx.feature_parts(spark, sf), fx.master_dim(spark))
    assert melted.count() == inputs.features_melted(spark, sf).count()

    staged = P.profiles(spark, fx.language_mapping(spark))
    direct = lv.demographic_store_table(inputs.demographic_profile(spark, sf))
    assert _rows(staged, schemas.PROFILE_FINAL_COLUMNS) == _rows(direct, schemas.PROFILE_FINAL_COLUMNS)

    sv_staged = P.social(spark, fx.social_value_parts(spark, sf))
    sv_direct = lv.social_store_table(inputs.social_profile(spark, sf))
    assert _rows(sv_staged, sv_direct.columns) == _rows(sv_direct, sv_direct.columns)
