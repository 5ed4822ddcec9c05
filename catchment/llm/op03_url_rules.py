"""URL filter: sort-merge range join of urls with host/path rules.

Method.  A host is written with its labels reversed and each followed by a
dot (``www.example.com`` -> ``com.example.www.``), so a rule host and all its
subdomains are one interval of such keys, and intervals of rules with the
same path nest.  Each url is probed once for every length that rule paths
have, with the key (path cut to that length, reversed host).  Urls and the
starts and ends of rule intervals are range-partitioned together by key.
Sweeping a partition in key order, the running sum of +1 / -1 at starts and
ends is the height of the stack of open rules, and the open rule of a height
is the last one started at that height: both are window functions, so the
sweep needs no Python.  Rules still open where a partition begins are
repeated at its front; they are found by an equi-join of starts and ends.

A hot host (or even one url repeated in a third of the rows) spreads over
partitions, because the row number is the last part of the range key.

Defined results: a null url, or one without ``://``, has an empty host and
path and no rule; repeated rows each get their row; an empty table gives an
empty result; a rule listed twice counts once (``block`` wins over ``allow``);
extra input columns are not carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stage import written

#: Fixed rules of the query: (verdict, host and path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

#: What the method says of a url that no rule fits: a filter passes it.
DEFAULT_VERDICT = "allow"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Rules as rows (rule, verdict, rule_host, rule_path)."""
    df = spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")
    return df.select(
        "rule", "verdict",
        F.regexp_extract("rule", r"(?s)^([^/]*)", 1).alias("rule_host"),
        F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("rule_path"),
    )


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``df``: id, host, path, the longest fitting rule
    (null: none) and the verdict."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = df.select(
        F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    ).withColumn("rid", F.monotonically_increasing_id())

    rule = rules.groupBy("rule", "rule_host", "rule_path").agg(F.max("verdict").alias("verdict")).select(
        "rule", "verdict", F.col("rule_path").alias("p"), F.length("rule_path").alias("plen"),
        reversed_host(F.translate("rule_host", UPPER, LOWER)).alias("lo"), F.length("rule").alias("rule_len"),
    )
    # One value: the distinct lengths that rule paths have.
    lengths = rule.agg(F.collect_set("plen")).scalar()
    # ``.`` is followed by ``/`` in byte order: the first key past every key that begins with lo.
    upper = F.expr("concat(substr(lo, 1, length(lo) - 1), '/')")
    edge = ["p", "rule", "verdict", "rule_len"]
    starts = rule.select(F.col("lo").alias("k"), F.lit(1).alias("kind"), F.lit(1).alias("delta"), *edge)
    ends = rule.select(upper.alias("k"), F.lit(0).alias("kind"), F.lit(-1).alias("delta"), *edge)
    probes = (
        urls.withColumn("lens", lengths)
        .withColumn("plen", F.explode(F.array_union(
            F.filter(F.coalesce("lens", F.array().cast("array<int>")), lambda n: n <= F.length("path")),
            F.array(F.lit(-1)),  # every url keeps at least this row, whatever its path
        )))
        .select(
            F.when(F.col("plen") >= 0, F.expr("substr(path, 1, plen)")).alias("p"),
            reversed_host(F.col("host")).alias("k"), F.lit(2).alias("kind"), F.lit(0).alias("delta"),
            "rid", "id", F.when(F.col("plen") < 0, F.col("host")).alias("host"),
            F.when(F.col("plen") < 0, F.col("path")).alias("path"),
        )
    )
    # Written once: the bounds of the range partitions are then the same for all who read them.
    swept = written(
        starts.unionByName(ends).unionByName(probes, allowMissingColumns=True)
        .repartitionByRange(parts, "p", "k", "kind", "rid")
        .withColumn("bucket", F.spark_partition_id()),
        "url-sweep",
    )
    opened = swept.filter("kind = 1").select("bucket", *edge, F.col("k"))
    closed = swept.filter("kind = 0").select(F.col("bucket").alias("closed_in"), "rule")
    carried = (
        opened.join(closed, "rule").filter("closed_in > bucket")
        .withColumn("bucket", F.explode(F.sequence(F.col("bucket") + 1, F.col("closed_in"))))
        .select("bucket", "k", *edge, F.lit(-1).alias("kind"), F.lit(1).alias("delta"))
    )
    # Rules carried in come first, outer before inner, then the partition's own rows in key order.
    order = [F.when(F.col("kind") < 0, 0).otherwise(1), "p", "k", "kind", "rule_len", "rid"]
    sweep = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = Window.partitionBy("bucket", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        swept.unionByName(carried, allowMissingColumns=True)
        .withColumn("height", F.sum("delta").over(sweep))
        .withColumn("top", F.last(F.when(F.col("delta") == 1, F.struct("rule_len", "rule", "verdict")), True).over(stack))
        .filter("kind = 2")
        .withColumn("top", F.when((F.col("height") > 0) & F.col("p").isNotNull(), F.col("top")))
    )
    best = found.groupBy("rid").agg(
        F.first("id", True).alias("id"), F.max("host").alias("host"), F.max("path").alias("path"),
        F.max("top").alias("top"),
    )
    return best.select(
        F.col("id").alias(id_col), "host", "path", F.col("top.rule").alias("rule"),
        F.coalesce("top.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"),
    )
