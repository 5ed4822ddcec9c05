"""End-to-end batch pipeline on warehouse tables, stage by stage.

Each stage is written as a table under the shared stage folder and the next
stage reads it back, as the source pipeline does: this cuts lineage at the
natural boundaries, so a lost executor only costs the current stage, and
every stage can be re-run alone.  The stages keyed by postal code (the
attraction, share and melted tables) are bucketed by POSTALCODE with one
bucket count, so the per-postal windows read them
without a shuffle.

    gravity      stores + polygon parts  -> attraction, shares 0.5%, shares 1%
    competition  shares 1%               -> leave-one-out rows (affected only)
    features     raw feature tables + dim -> melted demographic table
    profiles     shares 0.5% + melted    -> published store table
    social       shares 0.5% + social values -> social-value store table
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import attraction as att
from ..operators import competition as comp
from ..operators import features as feat
from ..operators import levels as lv
from ..operators import profiles as prof
from ..sinks import tables as sinks
from ..sources import tables


KEY = ["POSTALCODE"]


@dataclass
class StageNames:
    attraction: str = "store_postal_attraction"
    shares_half: str = "store_postal_attraction_half_pct"
    shares_full: str = "store_postal_attraction_full_pct"
    competition: str = "store_postal_attraction_competition"
    melted: str = "postal_features_melted"
    profile: str = "store_profiles_published"
    social: str = "postal_social_values_melted"
    social_store: str = "store_social_values"


def gravity(spark: SparkSession, stores_raw: DataFrame, polygon_parts: list[DataFrame], names=StageNames(),
            mass: str = "REVENUE_CY", partitions: int | None = None) -> dict[str, DataFrame]:
    """Attraction and the two share tables, each a stage bucketed by
    POSTALCODE: every later per-postal window or POSTALCODE join reads them
    without a shuffle."""
    stores = tables.load_stores(stores_raw)
    ldu = tables.load_ldu(*polygon_parts)
    full = sinks.read_bucketed_stage(
        spark, sinks.write_bucketed_stage(att.full_attraction(stores, ldu, mass, partitions), names.attraction, KEY, partitions)
    )
    for name, cut in ((names.shares_half, att.HALF_PERCENT), (names.shares_full, att.ONE_PERCENT)):
        sinks.write_bucketed_stage(att.shares(full, cut), name, KEY, partitions)
    return {n: sinks.read_bucketed_stage(spark, n) for n in (names.attraction, names.shares_half, names.shares_full)}


def competition(spark: SparkSession, level: str = "BANNER", names=StageNames()) -> DataFrame:
    shares = sinks.read_bucketed_stage(spark, names.shares_full)
    sinks.write_stage(comp.affected(comp.leave_one_out(shares, level)), f"{names.competition}_{level.lower()}")
    return sinks.read_stage(spark, f"{names.competition}_{level.lower()}")


def _write_melted(spark: SparkSession, melted: feat.Melted, name: str) -> DataFrame:
    """Write a melted table in both forms: the published table (dense, with
    attributes) and its keyed form for the profiles (present cells, bucketed
    by POSTALCODE, plus the small metadata table)."""
    sinks.write_bucketed_stage(melted.table(), name, KEY)
    sinks.write_bucketed_stage(melted.present, f"{name}_cells", KEY)
    sinks.write_stage(melted.meta, f"{name}_meta")
    return sinks.read_bucketed_stage(spark, name)


def _read_keyed(spark: SparkSession, name: str, totals: list[str], metadata_columns: list[str]) -> feat.Melted:
    """The keyed form written by ``_write_melted``."""
    cells = sinks.read_bucketed_stage(spark, f"{name}_cells")
    meta = sinks.read_stage(spark, f"{name}_meta")
    return feat.Melted(cells, meta, totals, metadata_columns, present=cells)


def features(spark: SparkSession, raw_parts: list[DataFrame], dim: DataFrame, names=StageNames()) -> DataFrame:
    # UNION ALL: duplicates collapse in the melt's cells (see inputs.features_melted_keyed)
    raw = tables.stack_by_position(*raw_parts)
    tagged = feat.tag_year(feat.select_variables(raw, dim))
    meta_source = feat.tag_year(feat.select_variables(raw.select("var_code", "Description", "Category").distinct(), dim))
    return _write_melted(spark, feat.melt_demographics_keyed(tagged, meta_source=meta_source), names.melted)


def profiles(spark: SparkSession, language: DataFrame, names=StageNames()) -> DataFrame:
    """Profile from the bucketed shares and keyed cells (same buckets: the
    join needs no shuffle)."""
    shares = sinks.read_bucketed_stage(spark, names.shares_half)
    melted = _read_keyed(spark, names.melted, list(feat.DEMO_TOTALS), feat.METADATA_COLUMNS)
    profile = prof.demographic_profile(shares, melted, language)
    sinks.write_stage(lv.demographic_store_table(profile), names.profile)
    return sinks.read_stage(spark, names.profile)


def social(spark: SparkSession, sv_by_year: dict[int, DataFrame], names=StageNames()) -> DataFrame:
    sv = {y: tables.load_social_values(df) for y, df in sv_by_year.items()}
    _write_melted(spark, feat.melt_social_values_keyed(sv), names.social)
    shares = sinks.read_bucketed_stage(spark, names.shares_half)
    melted = _read_keyed(spark, names.social, list(feat.SV_TOTALS), ["variable", "Description", "Category"])
    profile = prof.social_profile(shares, melted)
    sinks.write_stage(lv.social_store_table(profile), names.social_store)
    return sinks.read_stage(spark, names.social_store)
