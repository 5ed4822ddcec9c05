"""Feature preparation: variable selection, year tagging, description
clean-up, year legs, pivot / melt with totals, and stacking of the legs.

Layout notes
* The variable dimension and the category list are small; they are
  broadcast after a size check, so selection is a map-side pass.
* The melt does not pivot and needs no variable list on the driver: the legs'
  variables are numbered by Spark, cells are laid out by CODE once, and the
  totals are read from the same per-code map instead of a join back.
* Only the wide form lists its variables, since they are its columns.  It is
  made of column blocks, a pivot each, joined on the key without a further
  shuffle, so it has no limit of its own on columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.codes import newcomer_year, suffix_key, year_from_code
from ..functions.text import clean_description
from ..plans.layout import materialize, maybe_broadcast, numbered, shuffle_partitions

# Population totals lifted to columns, by name of the output
# column and the variable suffix that holds it (prefixed with the leg's year
# code); the social-value total is its Household Population 15+ variable.
DEMO_TOTALS = {
    "TOTAL_HOUSEHOLDS": "BASHHD",
    "TOTAL_HOUSEHOLD_POPULATION_15_YEARS_OR_OVER": "BAS15HP",
    "TOTAL_HOUSEHOLD_POPULATION": "BASHPOP",
    "TOTAL_POPULATION": "BASPOP",
}
SV_TOTALS = {"TOTAL_POPULATION": "SVBAS15HP"}

METADATA_COLUMNS = ["variable", "Description", "Category"] + schemas.DIM_COLUMNS


@dataclass(frozen=True)
class Leg:
    """One projection-year leg of the melted table."""

    name: str
    filter: Column  # rows of the tagged features in this leg
    total_prefix: str  # prefix of the total variables
    year: Column  # YEAR of the melted rows


# Prefix of the total variables of each leg.
LEG_PREFIXES = {"2023": "ECY", "2026": "P3Y", "2028": "P5Y", "2033": "P0Y"}


def demographic_legs() -> list[Leg]:
    """2023 (with newcomer rows), 2026, 2028 and 2033 legs."""
    y, whole = F.col("YEAR"), F.col("WHOLE_YEAR")
    current = Leg("2023", y.isin(2023, 2024) | whole.isNotNull(), LEG_PREFIXES["2023"], newcomer_year("variable"))
    later = [name for name in LEG_PREFIXES if name != "2023"]
    return [current] + [Leg(name, y == int(name), LEG_PREFIXES[name], F.lit(int(name))) for name in later]


# ---------------------------------------------------------------------------
# Selection and tagging
# ---------------------------------------------------------------------------
def profile_categories(dim: DataFrame) -> DataFrame:
    """Categories admitted to profiles: those with a variable flagged
    ADD_TO_PROFILE = 1 or carrying a whole-table YEAR."""
    keep = (F.col("ADD_TO_PROFILE") == 1) | F.col("YEAR").isNotNull()
    return dim.filter(keep).select(F.col("Category").alias("__keep_category")).distinct()


def select_variables(features: DataFrame, dim: DataFrame, dim_keep: DataFrame | None = None) -> DataFrame:
    """Attach the variable dimension on the code suffix (left join on
    ``substr(code, 4)``) and keep rows where

        (Category in profile categories AND dim.ADD_TO_PROFILE = 1)
        OR dim.YEAR IS NOT NULL

    ``dim_keep`` is the dimension the category list is read from (the same
    table by default).  Output: the raw columns plus the dimension's
    Hierarchy_Description, MEDIAN_AVERAGE, ADD_TO_PROFILE, LEAF_NODE_FLAG,
    TOTAL_FLAG and its YEAR as WHOLE_YEAR.
    """
    dim_keep = dim if dim_keep is None else dim_keep
    d = dim.select(
        suffix_key("variable").alias("__suffix"),
        *schemas.DIM_COLUMNS,
        F.col("YEAR").alias("WHOLE_YEAR"),
    )
    cats = profile_categories(dim_keep)
    joined = features.join(d, suffix_key("var_code") == d["__suffix"], "left")
    joined = joined.join(cats, joined["Category"] == cats["__keep_category"], "left")
    in_profile = F.col("__keep_category").isNotNull()
    keep = (in_profile & (F.col("ADD_TO_PROFILE") == 1)) | F.col("WHOLE_YEAR").isNotNull()
    return joined.filter(keep).select(*features.columns, *schemas.DIM_COLUMNS, "WHOLE_YEAR")


def tag_year(selected: DataFrame) -> DataFrame:
    """YEAR from the code prefix; VARIABLES / VALUES renamed to variable /
    value; descriptions cleaned."""
    return (
        selected.withColumn("YEAR", year_from_code("var_code"))
        .withColumnsRenamed({"var_code": "variable", "var_value": "value"})
        .withColumn("Description", clean_description("Description"))
    )


def leg_rows(tagged: DataFrame, leg: Leg) -> DataFrame:
    return tagged.filter(leg.filter)


# ---------------------------------------------------------------------------
# Pivot / melt
# ---------------------------------------------------------------------------
def leg_assignment(legs: list[Leg]) -> Column:
    """Names of the legs a row belongs to (legs may overlap)."""
    names = F.array(*[F.when(leg.filter, F.lit(leg.name)) for leg in legs])
    return F.filter(names, lambda x: x.isNotNull())


def by_leg(tagged: DataFrame, legs: list[Leg]) -> DataFrame:
    """The rows of every leg, with the leg's name as LEG (a row of several
    legs comes once for each)."""
    return tagged.withColumn("LEG", F.explode(leg_assignment(legs)))


def total_prefix(legs: list[Leg], leg: Column) -> Column:
    """Prefix of the total variables of the leg named by ``leg``."""
    prefixes = F.create_map(*[x for lg in legs for x in (F.lit(lg.name), F.lit(lg.total_prefix))])
    return F.element_at(prefixes, leg)


def leg_metadata(tagged: DataFrame, legs: list[Leg], metadata_columns: list[str]) -> DataFrame:
    """Distinct (__leg, metadata...) rows of every leg.  A NULL variable is
    listed once per leg, as NULL_VARIABLE without metadata."""
    rows = tagged.select(F.explode(leg_assignment(legs)).alias("__leg"), *metadata_columns)
    known = F.col("variable").isNotNull()
    rest = [F.when(known, F.col(c)).alias(c) for c in metadata_columns if c != "variable"]
    return rows.select("__leg", F.coalesce("variable", F.lit(NULL_VARIABLE)).alias("variable"), *rest).distinct()


def variables_by_leg(tagged: DataFrame, legs: list[Leg]) -> dict[str, list]:
    """Distinct variables of every leg, as the columns of a pivot need them:
    checked against ``spark.sql.pivotMaxValues`` as Spark's own pivot does."""
    limit = int(tagged.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = tagged.select(F.explode(leg_assignment(legs)).alias("__leg"), "variable").distinct()
    sizes = {r["__leg"]: r["count"] for r in found.groupBy("__leg").count().collect()}  # a row per leg
    for name, size in sizes.items():
        if size > limit:
            raise ValueError(f"leg {name} has {size} variables, above spark.sql.pivotMaxValues")
    out: dict[str, list] = {leg.name: [] for leg in legs}
    for row in found.collect():  # at most the limit a leg
        out[row["__leg"]].append(row["variable"])
    return {k: sorted(v, key=lambda x: (x is None, x)) for k, v in out.items()}


def pivot_features(rows: DataFrame, values: list | None = None, key: str = "CODE") -> DataFrame:
    """Long -> wide: one row per code (renamed POSTALCODE), one column per
    variable holding its value.  ``max`` picks a value deterministically when a
    (code, variable) pair repeats (the source took an arbitrary first one)."""
    return rows.groupBy(key).pivot("variable", values).agg(F.max("value")).withColumnRenamed(key, "POSTALCODE")


#: Columns of one pivot of the wide form.
PIVOT_BLOCK = 2000


def pivot_wide(rows: DataFrame, keys: list, block: int = PIVOT_BLOCK) -> DataFrame:
    """Long -> wide for any number of variables: one row per ``keys`` (columns
    or names; NULLs are a key like any other) and one column per variable, in
    code-point order.

    The cells (``max``, so copies collapse before the shuffle) are written
    once, sorted by variable.  A block of columns reads its own cells only and
    pivots them, which moves each cell through one shuffle in all; the blocks
    leave it partitioned by the key and are joined as they are.  The variables
    are listed on the driver because they are the schema of the result."""
    variable = F.coalesce("variable", F.lit(NULL_VARIABLE)).alias("variable")
    cells = rows.select(F.struct(*keys).alias("__key"), variable, "value")
    cells = materialize(
        cells.groupBy("__key", "variable").agg(F.max("value").alias("value")).sortWithinPartitions("variable")
    )
    names = sorted(r[0] for r in cells.select("variable").distinct().collect())
    wide = cells.select("__key").distinct()
    for start in range(0, len(names), block):
        part = names[start : start + block]
        own = cells.filter(F.col("variable").between(part[0], part[-1]))
        wide = wide.join(own.groupBy("__key").pivot("variable", part).agg(F.max("value")), "__key", "left")
    return wide.select("__key.*", "*").drop("__key")


@dataclass
class Melted:
    """A dense melted table in keyed form.

    ``keyed``: POSTALCODE, __mid (metadata id), val and the totals, hash
    partitioned by POSTALCODE.  ``meta``: one row per metadata id with the
    leg, variable, its metadata and YEAR; a written table, so the planner
    knows its size and broadcasts it only while it is small.
    """

    keyed: DataFrame
    meta: DataFrame
    totals: list[str]
    metadata_columns: list[str]
    present: DataFrame | None = None  # keyed rows of the cells that hold a value

    def table(self, leg: str | None = None) -> DataFrame:
        """The melted table with attribute columns (pivot + melt layout);
        ``leg`` names one more column for the leg of each row."""
        mc = self.metadata_columns
        out_cols = ["variable", "POSTALCODE", *[c for c in mc if c in ("Description", "Category")], "val"]
        out_cols += self.totals + [c for c in mc if c not in ("variable", "Description", "Category")] + ["YEAR"]
        legs = [F.col("__leg").alias(leg)] if leg else []
        return self.keyed.join(self.meta, "__mid").select(*out_cols, *legs)


def melt_legs_keyed(
    tagged: DataFrame,
    legs: list[Leg],
    totals: dict[str, str],
    metadata_columns: list[str],
    partitions: int | None = None,
    meta_source: DataFrame | None = None,
) -> Melted:
    """Dense melted table of all legs in one pass (pivot + melt semantics):
    for every leg, every (postal code of the leg, variable of the leg) pair,
    with the value (NULL when absent), the variable's metadata and the postal
    code's totals, and the leg's YEAR.

    * The legs' metadata rows (distinct leg, variable, metadata) are read
      from ``meta_source`` (default ``tagged``; a source without the final
      distinct gives the same set more cheaply) and numbered by Spark
      (``layout.numbered``): any number of variables, none on the driver.
    * Rows tagged with their legs are aggregated into cells (``max``,
      deterministic) with map-side partial aggregation, so copies of a row
      collapse before any shuffle; the distinct cells are hash-partitioned by
      CODE and the per-(code, leg) map variable -> value is aggregated there
      (a group holds at most one entry per variable of the leg).
    * Each (code, leg) meets the leg's metadata rows: that is the dense
      (postal code x variable) grid, with values and totals looked up in the
      map.  The ids are broadcast after their size was measured; beyond the
      bound the codes of a leg are dealt to buckets, each with its copy of the
      leg's ids.  The keyed output stays partitioned by POSTALCODE, the layout
      of the share table.
    """
    source = meta_source if meta_source is not None else tagged
    n = partitions or shuffle_partitions(tagged)
    meta = numbered(leg_metadata(source, legs, metadata_columns), "__mid")
    year = None
    for lg in legs:
        year = (F.when if year is None else year.when)(F.col("__leg") == lg.name, lg.year)
    meta = meta.withColumn("YEAR", year)

    legged = tagged.filter(F.col("CODE").isNotNull()).select(
        "CODE",
        F.coalesce(F.col("variable"), F.lit(NULL_VARIABLE)).alias("variable"),
        "value",
        F.explode(leg_assignment(legs)).alias("__leg"),
    )
    # Cells first, with map-side partial aggregation: any number of copies of
    # a row collapse before the shuffle (which spreads a code's cells by
    # variable).  The distinct cells are then laid out by CODE, where a code
    # holds at most one cell per variable of each leg.
    cells = legged.groupBy("CODE", "__leg", "variable").agg(F.max("value").alias("__val"))
    laid = cells.repartition(n, "CODE")
    per_code = laid.groupBy("CODE", "__leg").agg(
        F.map_from_entries(F.collect_list(F.struct("variable", "__val"))).alias("__cells")
    )
    ids = meta.select("__mid", F.col("__leg").alias("__gleg"), F.col("variable").alias("__gvar"))
    side, small = maybe_broadcast(ids)
    if small:
        grid = per_code.join(side, F.col("__leg") == F.col("__gleg"))
    else:  # a leg's codes in buckets, each with the leg's ids
        dealt = per_code.withColumn("__bucket", F.pmod(F.xxhash64("CODE"), F.lit(n)).cast("int"))
        copies = side.withColumn("__gbucket", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        on = (F.col("__leg") == F.col("__gleg")) & (F.col("__bucket") == F.col("__gbucket"))
        grid = dealt.join(copies, on).drop("__bucket", "__gbucket").repartition(n, "CODE")
    prefix = total_prefix(legs, F.col("__leg"))
    total_cols = [
        F.try_element_at("__cells", F.concat(prefix, F.lit(sfx))).alias(name)
        for name, sfx in totals.items()
    ]
    keyed = grid.select(
        F.col("CODE").alias("POSTALCODE"),
        "__mid",
        F.try_element_at("__cells", F.col("__gvar")).alias("val"),
        *total_cols,
    )
    # Sparse form for consumers that drop NULL values (the profiles): only
    # the cells present in the map, matched to their metadata ids; no grid.
    cell = per_code.select("CODE", "__leg", "__cells", F.explode("__cells").alias("__pvar", "val"))
    cell = cell.filter(F.col("val").isNotNull()).join(
        side, (F.col("__leg") == F.col("__gleg")) & (F.col("__pvar") == F.col("__gvar"))
    )
    present = cell.select(F.col("CODE").alias("POSTALCODE"), "__mid", "val", *total_cols)
    return Melted(keyed, meta, list(totals), metadata_columns, present)


# A NULL variable becomes a pivot column named "null", which the metadata
# join (on the real, NULL, variable) never matches.
NULL_VARIABLE = "null"


def postal_totals(rows: DataFrame, totals: dict[str, str], total_prefix: str, key: str = "CODE") -> DataFrame:
    """Per-postal-code totals as columns (conditional aggregation)."""
    aggs = [
        F.max(F.when(F.col("variable") == total_prefix + suffix, F.col("value"))).alias(name)
        for name, suffix in totals.items()
    ]
    return rows.groupBy(F.col(key).alias("POSTALCODE")).agg(*aggs)


def totals_by_leg(tagged: DataFrame, legs: list[Leg], totals: dict[str, str], key: str = "CODE") -> DataFrame:
    """The totals of every (postal code, leg), in one pass."""
    prefix = total_prefix(legs, F.col("LEG"))
    aggs = [
        F.max(F.when(F.col("variable") == F.concat(prefix, F.lit(suffix)), F.col("value"))).alias(name)
        for name, suffix in totals.items()
    ]
    return by_leg(tagged, legs).groupBy(F.col(key).alias("POSTALCODE"), "LEG").agg(*aggs)


def variable_metadata(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct variable metadata (of each value of ``keys``, say the leg)."""
    return rows.select(*keys, *METADATA_COLUMNS).distinct()


def melt_demographics_keyed(
    tagged: DataFrame, legs: list[Leg] | None = None, meta_source: DataFrame | None = None
) -> Melted:
    """The stacked melted demographic table: the current-year leg (with
    newcomer variables as 2024) and the three projection legs."""
    return melt_legs_keyed(tagged, legs or demographic_legs(), DEMO_TOTALS, METADATA_COLUMNS, meta_source=meta_source)


def melt_demographics(
    tagged: DataFrame, legs: list[Leg] | None = None, meta_source: DataFrame | None = None
) -> DataFrame:
    return melt_demographics_keyed(tagged, legs, meta_source).table()


def social_value_legs(years: list[int]) -> list[Leg]:
    return [Leg(str(y), F.col("YEAR") == y, "", F.lit(y)) for y in years]


def melt_social_values_keyed(sv_by_year: dict[int, DataFrame]) -> Melted:
    """Stacked melted social values: one leg per year table, with the
    Household Population 15+ total as TOTAL_POPULATION."""
    tagged = None
    for year, raw in sv_by_year.items():
        part = raw.withColumn("YEAR", F.lit(year))
        tagged = part if tagged is None else tagged.unionByName(part)
    legs = social_value_legs(list(sv_by_year))
    return melt_legs_keyed(tagged, legs, SV_TOTALS, ["variable", "Description", "Category"])


def melt_social_values(sv_by_year: dict[int, DataFrame]) -> DataFrame:
    return melt_social_values_keyed(sv_by_year).table()
