"""Profiles recomputed by brute force in pandas on the sf0.001 fixture:
join every share row to every feature row of its postal code and sum."""

import pandas as pd
from pyspark.sql import functions as F

from catchment.operators.profiles import EXCLUDED_CATEGORIES, STORE_KEYS
from catchment.plans import inputs
from catchment.sources import fixtures as fx


def _close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) <= 1e-9 * max(1.0, abs(b)))


def test_social_value_profile_importance_of_price(spark, sf_small):
    shares = inputs.half_pct(spark, sf_small).toPandas()
    melted = inputs.social_values_melted(spark, sf_small).toPandas()
    melted = melted[melted["val"].notna()]
    j = shares.merge(melted, on="POSTALCODE")
    j["wv"] = j["PERCENT_ATTRACTION"] * j["val"]
    j["wp"] = j["PERCENT_ATTRACTION"] * j["TOTAL_POPULATION"]
    keys = ["STORE_NUM", "variable", "YEAR"]
    want = j[j["Description"] == "Importance of Price"].groupby(keys)[["wv", "wp"]].sum()
    got = (
        inputs.social_profile(spark, sf_small)
        .filter(F.col("Description") == "Importance of Price")
        .select(*keys, "val", "TOTAL_POPULATION")
        .toPandas()
        .set_index(keys)
    )
    assert len(got) == len(want) > 0
    for idx, row in want.iterrows():
        assert _close(got.loc[idx, "val"], row["wv"])
        assert _close(got.loc[idx, "TOTAL_POPULATION"], row["wp"])


def test_demographic_profile_by_brute_force(spark, sf_small):
    shares = inputs.half_pct(spark, sf_small).select("POSTALCODE", "PERCENT_ATTRACTION", *STORE_KEYS).toPandas()
    melted = inputs.features_melted(spark, sf_small).toPandas()
    melted = melted[melted["val"].notna() & melted["Category"].notna() & ~melted["Category"].isin(EXCLUDED_CATEGORIES)]
    lang = fx.language_mapping(spark).toPandas().rename(columns={"Variable": "variable"})
    melted = melted.merge(lang, on="variable", how="left")
    j = shares.merge(melted, on="POSTALCODE")
    j["val_w"] = j["PERCENT_ATTRACTION"] * j["val"]
    j["pop_w"] = j["PERCENT_ATTRACTION"] * j["TOTAL_POPULATION"]
    keys = ["STORE_NUM", "variable", "YEAR", "Language_Grouping"]
    want = j.groupby(keys, dropna=False)[["val_w", "pop_w"]].sum(min_count=1)
    got = inputs.demographic_profile(spark, sf_small).select(*keys, "val", "TOTAL_POPULATION").toPandas()
    got = got.set_index(keys)
    assert len(got) == len(want) > 0
    want = want.reindex(got.index)
    assert want["val_w"].notna().all()
    for idx in got.index:
        assert _close(float(got.loc[idx, "val"]), float(want.loc[idx, "val_w"]))
        g, w = got.loc[idx, "TOTAL_POPULATION"], want.loc[idx, "pop_w"]
        assert (pd.isna(g) and pd.isna(w)) or _close(float(g), float(w))
