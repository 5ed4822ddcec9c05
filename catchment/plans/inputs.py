"""Pipeline inputs and stages for a data folder, as lazy DataFrames.

Each function takes ``(spark, sf_dir)`` and returns the plan of one stage;
nothing is computed until an action runs.  Production jobs read warehouse
tables instead of the fixtures and may write each stage with
``sinks.write_stage`` to cut lineage (see ``plans.staged``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import attraction as att
from ..operators import features as feat
from ..operators import profiles as prof
from ..operators import spatial
from ..sources import fixtures as fx
from ..sources import tables


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load_stores(fx.stores_raw(spark, sf_dir))


def ldu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load_ldu(fx.ldu_part1(spark, sf_dir), fx.ldu_part2(spark, sf_dir))


def full_attraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return att.full_attraction(stores(spark, sf_dir), ldu(spark, sf_dir))


def half_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares after the 0.5% cut (feeds the profiles)."""
    return spatial.pruned_shares(stores(spark, sf_dir), ldu(spark, sf_dir), att.HALF_PERCENT)


def one_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares after the 1% cut (feeds competition)."""
    return spatial.pruned_shares(stores(spark, sf_dir), ldu(spark, sf_dir), att.ONE_PERCENT)


# ---------------------------------------------------------------------------
# Features
# ---------------------------------------------------------------------------
def features_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load_features(*fx.feature_parts(spark, sf_dir))


def features_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.select_variables(features_union(spark, sf_dir), fx.master_dim(spark))


def features_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.tag_year(features_selected(spark, sf_dir))


def features_melted_keyed(spark: SparkSession, sf_dir: str) -> feat.Melted:
    """Keyed melted demographic table.

    The source unions the raw tables with SQL ``UNION`` (distinct) before
    pivoting.  For the melted table that distinct is redundant: an exact
    duplicate row lands in the same (code, variable) cell, whose value is
    picked by ``max``, and adds no new variable or metadata.  So the raw
    tables are stacked (``UNION ALL``) and the melt's single exchange by CODE
    is the only shuffle of the raw rows."""
    parts, dim = fx.feature_parts(spark, sf_dir), fx.master_dim(spark)
    raw = tables.stack_by_position(*parts)
    tagged = feat.tag_year(feat.select_variables(raw, dim))
    # Metadata depends on (code, description, category) only: take that
    # distinct right after the scan, then select / tag / clean the few rows.
    meta_source = feat.tag_year(feat.select_variables(raw.select("var_code", "Description", "Category").distinct(), dim))
    return feat.melt_demographics_keyed(tagged, meta_source=meta_source)


def features_melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stacked melted demographic table (four legs)."""
    return features_melted_keyed(spark, sf_dir).table()


def social_values_by_year(spark: SparkSession, sf_dir: str) -> dict[int, DataFrame]:
    return {yr: tables.load_social_values(df) for yr, df in fx.social_value_parts(spark, sf_dir).items()}


def social_values_melted_keyed(spark: SparkSession, sf_dir: str) -> feat.Melted:
    return feat.melt_social_values_keyed(social_values_by_year(spark, sf_dir))


def social_values_melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return social_values_melted_keyed(spark, sf_dir).table()


# ---------------------------------------------------------------------------
# Profiles
# ---------------------------------------------------------------------------
def demographic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.demographic_profile(
        half_pct(spark, sf_dir), features_melted_keyed(spark, sf_dir), fx.language_mapping(spark)
    )


def social_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.social_profile(half_pct(spark, sf_dir), social_values_melted_keyed(spark, sf_dir))
