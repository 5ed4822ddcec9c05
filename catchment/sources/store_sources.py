"""Union of several store sources into one store table.

Each source is given as (DataFrame, rename map, predicate, label): columns are
renamed to the common names, rows filtered, a SOURCE label added, and the
sources are stacked by column name; a column missing from a source is NULL
there.

``checked_union`` also holds every source against a contract (type, required,
range of each column).  One pass types the rows and lists what is wrong with
each; ``write_checked`` writes both kinds in one job, in two folders.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.tables import read_stage, write_partitioned_stage


@dataclass(frozen=True)
class Field:
    """What a column must be: its Spark type, whether NULL is refused, and the
    bounds its values must lie in (both included)."""

    type: str
    required: bool = False
    low: float | None = None
    high: float | None = None


@dataclass
class StoreSource:
    df: DataFrame
    label: str
    renames: dict[str, str] = field(default_factory=dict)
    predicate: Column | None = None


def union_sources(sources: list[StoreSource]) -> DataFrame:
    out = None
    for src in sources:
        part = src.df.withColumnsRenamed(src.renames) if src.renames else src.df
        if src.predicate is not None:
            part = part.filter(src.predicate)
        part = part.withColumn("SOURCE", F.lit(src.label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def reason(name: str, rule: Field, typed: Column) -> Column:
    """What is wrong with a value of column ``name`` (NULL: nothing)."""
    raw = F.col(f"`{name}`")
    why = F.when(raw.isNotNull() & typed.isNull(), F.lit(f"{name} is not a {rule.type}"))
    if rule.required:
        why = why.when(raw.isNull(), F.lit(f"{name} is missing"))
    if rule.low is not None:
        why = why.when(typed < F.lit(rule.low), F.lit(f"{name} is out of range"))
    if rule.high is not None:
        why = why.when(typed > F.lit(rule.high), F.lit(f"{name} is out of range"))
    return why


def checked_union(sources: list[StoreSource], contract: dict[str, Field]) -> DataFrame:
    """All rows of the sources in the contract's columns and types, with their
    SOURCE and REASONS: what is wrong, in the contract's order, joined by "; "
    (empty: the row is accepted).  A value that is not of its type is NULL; a
    column that a source lacks is NULL there, and missing if required."""
    parts = []
    for src in sources:
        have = set(src.df.withColumnsRenamed(src.renames).columns)
        lacking = {c: F.lit(None).cast(rule.type) for c, rule in contract.items() if c not in have}
        part = union_sources([src]).withColumns(lacking) if lacking else union_sources([src])
        typed = {c: F.col(f"`{c}`").try_cast(rule.type) for c, rule in contract.items()}
        why = F.concat_ws("; ", *[reason(c, rule, typed[c]) for c, rule in contract.items()])
        parts.append(part.select(*[v.alias(c) for c, v in typed.items()], "SOURCE", why.alias("REASONS")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_checked(checked: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of ``checked_union``, written in one job as a
    stage with a folder for each; accepted rows come without REASONS."""
    flagged = checked.withColumn("ACCEPTED", (F.col("REASONS") == "").cast("int"))
    write_partitioned_stage(flagged, name, ["ACCEPTED"])
    spark = checked.sparkSession
    accepted = read_stage(spark, name, F.col("ACCEPTED") == 1).drop("ACCEPTED", "REASONS")
    return accepted, read_stage(spark, name, F.col("ACCEPTED") == 0).drop("ACCEPTED")
