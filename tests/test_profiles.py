"""Profiles, benchmarks and store values."""

from pyspark.sql import functions as F

from catchment.operators import features as feat
from catchment.operators import levels as lv
from catchment.operators import profiles as prof
from catchment.plans import inputs
from catchment.sources import fixtures as fx


def _rows(df, cols, digits=9):
    out = []
    for r in df.select(*cols).collect():
        out.append(tuple(round(v, digits) if isinstance(v, float) else v for v in r))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_keyed_profile_equals_plain_table_profile(spark, sf_small):
    shares = inputs.half_pct(spark, sf_small)
    keyed = inputs.features_melted_keyed(spark, sf_small)
    lang = fx.language_mapping(spark)
    a = prof.demographic_profile(shares, keyed, lang)
    b = prof.demographic_profile(shares, keyed.table(), lang)
    cols = prof.DEMO_PROFILE_COLUMNS + ["STORE_CHAIN", "Region"]
    assert _rows(a, cols) == _rows(b, cols)


def _variants(spark, dims=1, languages=1):
    """One store, one postal code, one variable with value 4 and population 10,
    whose dimension or language rows repeat."""
    shares = spark.createDataFrame(
        [("P1", 1.0, *[None] * 7, 1.0, 2.0, "ON")],
        "POSTALCODE string, PERCENT_ATTRACTION double, CUSTOMER_GROUP string, STORE_NAME string, STORE_NUM long, "
        "CHANNEL string, SALES_GROUP string, BANNER string, STORE_STREET string, STORE_LONGITUDE double, "
        "STORE_LATITUDE double, STORE_PROVINCE string",
    )
    cells = spark.createDataFrame(
        [("P1", m, 4.0, 1.0, 1.0, 1.0, 10.0) for m in range(dims)],
        "POSTALCODE string, __mid long, val double, TOTAL_HOUSEHOLDS double, TOTAL_HOUSEHOLD_POPULATION double, "
        "TOTAL_HOUSEHOLD_POPULATION_15_YEARS_OR_OVER double, TOTAL_POPULATION double",
    )
    meta = spark.createDataFrame(
        [(m, "v1", "d", "c", f"h{m}", "x", 1, 1, m, 2023) for m in range(dims)],
        "__mid long, variable string, Description string, Category string, Hierarchy_Description string, "
        "MEDIAN_AVERAGE string, ADD_TO_PROFILE int, LEAF_NODE_FLAG int, TOTAL_FLAG int, YEAR int",
    )
    language = spark.createDataFrame([("v1", "EN")] * languages, "Variable string, Language_Grouping string")
    names = [c for c in meta.columns if c not in ("__mid", "YEAR")]
    return shares, feat.Melted(cells, meta, list(feat.DEMO_TOTALS), names, present=cells), language


def test_dimension_variants_are_one_row(spark):
    shares, melted, language = _variants(spark, dims=2)
    for m in (melted, melted.table()):
        rows = prof.demographic_profile(shares, m, language).collect()
        assert [(r.val, r.TOTAL_POPULATION, r.Hierarchy_Description, r.TOTAL_FLAG) for r in rows] == [(8.0, 20.0, "h0", 0)]


def test_language_repeats_weigh_the_sums(spark):
    shares, melted, language = _variants(spark, languages=2)
    for m in (melted, melted.table()):
        rows = prof.demographic_profile(shares, m, language).collect()
        assert [(r.val, r.TOTAL_POPULATION, r.Language_Grouping) for r in rows] == [(8.0, 20.0, "EN")]
    missing = prof.demographic_profile(shares, melted, language.limit(0)).collect()
    assert [(r.val, r.Language_Grouping) for r in missing] == [(4.0, None)]


def test_profile_computes_the_pairs_once(spark, sf_small):
    plan = inputs.demographic_profile(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    # The pairs ran when their shares were written; the profile reads that copy for rows and for stores.
    assert "HAVERSINE" not in plan and "supplier.parquet" not in plan and "PERCENT_ATTRACTION" in plan


def test_stores_are_numbered_once_each(spark):
    shares, _, _ = _variants(spark)
    other = shares.withColumn("BANNER", F.lit("x")).withColumn("POSTALCODE", F.lit("P2"))
    coded, stores = prof.numbered_stores(shares.unionByName(other).unionByName(other).unionByName(shares))
    assert sorted(r["__sid"] for r in stores.collect()) == [0, 1]
    assert coded.columns == ["POSTALCODE", "PERCENT_ATTRACTION", "__sid"]
    rows = [(r.POSTALCODE, r["__sid"]) for r in coded.collect()]
    assert len(rows) == 4 and len(set(rows)) == 2
    coded, stores = prof.numbered_stores(shares.limit(0))
    assert coded.collect() == [] and stores.collect() == []


def test_null_store_attributes_are_kept_apart(spark):
    shares, melted, language = _variants(spark)
    other = shares.withColumn("BANNER", F.lit("x"))
    third = shares.withColumn("CHANNEL", F.lit("x"))
    rows = prof.demographic_profile(shares.unionByName(other).unionByName(third), melted, language).collect()
    assert sorted((r.BANNER or "", r.CHANNEL or "", r.val) for r in rows) == [("", "", 4.0), ("", "x", 4.0), ("x", "", 4.0)]


def test_store_name_conflicts(spark):
    rows = [(1, "B", "ON", "a"), (1, "B", "ON", "b"), (1, "B", "ON", "a"), (1, "B", "QC", "a"), (2, "B", "ON", "c")]
    df = spark.createDataFrame(rows, "STORE_NUM long, BANNER string, STORE_PROVINCE string, STORE_NAME string")
    assert [tuple(r) for r in prof.store_name_conflicts(df).collect()] == [(1, "B", "ON", 2)]


def test_ratio_by_category_branches(spark):
    cats = ["Households by Type", "Household Population 15 Years or Over by X", "Household Population by Age", "Other", None]
    df = spark.createDataFrame(
        [(c, 12.0, 2.0, 3.0, 4.0, 6.0) for c in cats],
        "Category string, val double, TOTAL_HOUSEHOLDS double, TOTAL_HOUSEHOLD_POPULATION double, "
        "TOTAL_HOUSEHOLD_POPULATION_15_YEARS_OR_OVER double, TOTAL_POPULATION double",
    )
    got = {r.Category: r.STORE_RATIO for r in prof.ratio_by_category(df).collect()}
    assert got == dict(zip(cats, [6.0, 3.0, 4.0, 2.0, 2.0], strict=True))


def test_profile_drops_trends_and_null_values(spark, sf_small):
    p = inputs.demographic_profile(spark, sf_small)
    assert p.filter(F.col("Category").isin("Trends", "Attitudes") | F.col("Category").isNull()).count() == 0
    assert p.filter(F.col("val").isNull()).count() == 0


def test_store_value_rules(spark):
    df = spark.createDataFrame(
        [
            ("Household Population For Recent Immigration By Place Of Birth", 10.0, 40.0, 99.0, 0, 1),
            ("Other", 10.0, 40.0, 20.0, 1, 0),
            ("Other", 10.0, 40.0, 20.0, 0, 0),
            ("Other", 10.0, 40.0, 0.0, 1, 0),
        ],
        "Description string, val double, TOTAL_HOUSEHOLD_POPULATION double, TOTAL_CATEGORY double, "
        "LEAF_NODE_FLAG int, TOTAL_FLAG int",
    )
    got = [r.STORE_VALUE for r in lv.store_value(df).collect()]
    assert got == [0.25, 0.5, 0.0, None]


def test_basics_join_without_year_repeats_rows(spark, sf_small):
    bench = lv.social_benchmarks(inputs.social_profile(spark, sf_small))
    n = bench.count()
    faithful = lv.attach_basics_total(bench).count()
    per_year = lv.attach_basics_total(bench, match_year=True).count()
    assert per_year == n
    assert faithful == 2 * n  # two years of Basics rows per store


def test_level_percent_denominators_match_windows(spark, sf_small):
    from pyspark.sql import Window

    with_values = lv.level_values(inputs.demographic_profile(spark, sf_small))
    name, value, keys = lv.LEVEL_PERCENTS[0]
    grouped = lv.level_percents(with_values, [(name, value, keys)])
    w = Window.partitionBy(*keys)
    windowed = with_values.withColumn(
        name, F.try_divide(F.col(value), F.sum(F.when(F.col("LEAF_NODE_FLAG") == 1, F.col(value)).otherwise(0.0)).over(w))
    )
    cols = ["STORE_NUM", "variable", "YEAR", "Language_Grouping", name]
    assert _rows(grouped, cols) == _rows(windowed, cols)


def test_region_percent_per_year_option(spark, sf_small):
    with_values = lv.level_values(inputs.demographic_profile(spark, sf_small))
    name, value, keys = [p for p in lv.LEVEL_PERCENTS if p[0] == "REGION_VALUE_PERCENT"][0]
    faithful = lv.level_percents(with_values, [(name, value, keys)])
    per_year = lv.level_percents(with_values, [(name, value, keys)], per_year=True)
    # per-year denominators are sums over fewer rows, so the percents grow
    f = {r.k: r.p for r in faithful.select(F.concat_ws("|", "STORE_NUM", "variable", "YEAR", "Language_Grouping").alias("k"), F.col(name).alias("p")).collect()}
    y = {r.k: r.p for r in per_year.select(F.concat_ws("|", "STORE_NUM", "variable", "YEAR", "Language_Grouping").alias("k"), F.col(name).alias("p")).collect()}
    assert f.keys() == y.keys()
    pairs = [(f[k], y[k]) for k in f if f[k] is not None and y[k] is not None]
    assert pairs and all(b >= a - 1e-12 for a, b in pairs) and any(b > a + 1e-9 for a, b in pairs)


def test_median_exact_option(spark):
    df = spark.createDataFrame([("d", "B", float(x)) for x in range(4)], "Description string, BANNER string, V double")
    approx = lv.median_by(df, "BANNER", "V").first()["Median_V"]
    exact = lv.median_by(df, "BANNER", "V", exact=True).first()["Median_V"]
    assert approx == 1.0 and exact == 1.5


def test_two_total_rows_in_a_category_fan_out(spark):
    df = spark.createDataFrame(
        [
            ("Income", 1, "S1", 2026, "v1", 10.0, 0, 1),
            ("Income", 1, "S1", 2026, "v2", 30.0, 0, 1),
            ("Income", 1, "S1", 2026, "v3", 5.0, 1, 0),
        ],
        "Category string, STORE_NUM long, STORE_NAME string, YEAR int, variable string, val double, "
        "LEAF_NODE_FLAG int, TOTAL_FLAG int",
    )
    out = lv.attach_category_total(df).collect()
    assert len(out) == 6  # every row once per total row
    assert sorted({r.TOTAL_CATEGORY for r in out}) == [10.0, 30.0]


def test_level_values_equal_windows_without_hot_groups(spark):
    rows = [(f"B{i % 3}" if i % 11 else None, f"R{i % 2}", f"C{i % 4}" if i % 7 else None, "v" if i % 3 else f"v{i % 5}",
             2023 + i % 2, float(i % 13), float(i % 5)) for i in range(600)]
    df = spark.createDataFrame(
        rows, "BANNER string, Region string, CHANNEL string, variable string, YEAR int, val double, TOTAL_POPULATION double")
    got = lv.level_values(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "RepartitionByExpression" not in plan
    sums = {}
    for r in rows:
        named = dict(zip(df.columns, r, strict=True))
        for name, keys in lv.LEVEL_VALUES:
            s = sums.setdefault((name, *(named[k] for k in keys)), [0.0, 0.0])
            s[0] += r[5]
            s[1] += r[6]
    assert got.count() == len(rows)
    for r in got.collect():
        for name, keys in lv.LEVEL_VALUES:
            a, b = sums[(name, *(r[k] for k in keys))]
            assert (r[name] is None and b == 0) or abs(r[name] - a / b) < 1e-9
