"""Feature selection, year legs and the dense melt."""

from pyspark.sql import functions as F

from catchment import schemas
from catchment.operators import features as feat
from catchment.plans import inputs
from catchment.sources import fixtures as fx


def raw(spark, rows):
    return spark.createDataFrame(rows, schemas.RAW_FEATURES)


def dim(spark, rows):
    return spark.createDataFrame(rows, schemas.MASTER_DIM)


def test_selection_or_binds_loosest(spark):
    d = dim(
        spark,
        [
            ("ECYA", "Keep", "h", "N", 1, 1, 0, None),
            ("ECYB", "Drop", "h", "N", 0, 1, 0, None),
            ("ECYC", "Keep", "h", "N", 0, 1, 0, 2024),  # YEAR set: admitted whatever the category
        ],
    )
    f = raw(
        spark,
        [
            ("P1", "ECYA", 1.0, "a", "Keep"),  # in category, flag 1 -> kept
            ("P1", "ECYB", 1.0, "b", "Drop"),  # flag 0 -> dropped
            ("P1", "P3YC", 1.0, "c", "Other"),  # dim YEAR set -> kept although category not admitted
            ("P1", "ECYZ", 1.0, "z", "Keep"),  # no dimension row -> dropped
        ],
    )
    got = {r.var_code for r in feat.select_variables(f, d).collect()}
    assert got == {"ECYA", "P3YC"}


def test_suffix_join_fans_out(spark):
    d = dim(spark, [("ECYA", "Keep", "h1", "N", 1, 1, 0, None), ("P3YA", "Keep", "h2", "N", 1, 1, 0, None)])
    f = raw(spark, [("P1", "ECYA", 1.0, "a", "Keep")])
    assert feat.select_variables(f, d).count() == 2


def test_newcomer_rows_are_2024_in_current_leg(spark, sf_small):
    m = inputs.features_melted(spark, sf_small)
    years = {r.YEAR for r in m.filter(F.col("variable").startswith("NC24")).select("YEAR").distinct().collect()}
    assert years == {2024}
    assert m.filter(F.col("Category") == fx.NEWCOMER_CATEGORY).count() > 0


def test_melt_is_dense_codes_times_variables(spark, sf_small):
    t = inputs.features_tagged(spark, sf_small)
    m = inputs.features_melted(spark, sf_small)
    for leg in feat.demographic_legs():
        rows = feat.leg_rows(t, leg)
        codes = rows.select("CODE").distinct().count()
        variables = rows.select("variable").distinct().count()
        if leg.name == "2023":
            got = m.filter(F.col("YEAR").isin(2023, 2024)).count()
        else:
            got = m.filter(F.col("YEAR") == int(leg.name)).count()
        assert got == codes * variables


def test_melt_equals_pivot_then_unpivot(spark, sf_small):
    t = inputs.features_tagged(spark, sf_small)
    leg = feat.demographic_legs()[1]  # 2026
    rows = feat.leg_rows(t, leg)
    values = feat.variables_by_leg(t, [leg])[leg.name]
    wide = feat.pivot_features(rows, values)
    long = wide.unpivot(["POSTALCODE"], values, "variable", "val")
    a = sorted((r.POSTALCODE, r.variable, r.val) for r in long.collect())
    m = feat.melt_demographics(t, [leg])
    b = sorted((r.POSTALCODE, r.variable, r.val) for r in m.select("POSTALCODE", "variable", "val").collect())
    assert a == b


def test_totals_are_on_every_melted_row(spark, sf_small):
    m = inputs.features_melted(spark, sf_small).filter(F.col("YEAR") == 2026)
    pt = m.filter(F.col("variable") == "P3YBASPOP").select("POSTALCODE", F.col("val").alias("pop"))
    j = m.join(pt, "POSTALCODE")
    assert j.filter(~F.col("TOTAL_POPULATION").eqNullSafe(F.col("pop"))).count() == 0


def test_social_values_keep_null_category(spark, sf_small):
    m = inputs.social_values_melted(spark, sf_small)
    assert m.filter(F.col("Category").isNull()).count() > 0
    assert {r.YEAR for r in m.select("YEAR").distinct().collect()} == {2023, 2024}


def _tagged(spark, rows):
    """rows: (CODE, variable, value, Description, Category, ADD, LEAF, TOTAL, YEAR)."""
    df = spark.createDataFrame(
        rows,
        "CODE string, variable string, value double, Description string, Category string, "
        "ADD_TO_PROFILE int, LEAF_NODE_FLAG int, TOTAL_FLAG int, YEAR int",
    )
    return df.select(
        "*", F.lit("h").alias("Hierarchy_Description"), F.lit("N").alias("MEDIAN_AVERAGE"),
        F.lit(None).cast("int").alias("WHOLE_YEAR"),
    )


def test_null_variable_becomes_null_column_without_metadata(spark):
    t = _tagged(
        spark,
        [
            ("P1", "P3YBASPOP", 10.0, "Pop", "Basics", 1, 0, 1, 2026),
            ("P1", None, 5.0, "Orphan", "Basics", 1, 1, 0, 2026),
            ("P2", "P3YBASPOP", 20.0, "Pop", "Basics", 1, 0, 1, 2026),
        ],
    )
    leg = feat.demographic_legs()[1]
    m = feat.melt_demographics(t, [leg]).collect()
    nulls = [r for r in m if r.variable == "null"]
    assert len(nulls) == 2  # one per postal code (dense)
    assert all(r.Description is None and r.Category is None for r in nulls)
    assert {r.POSTALCODE: r.val for r in nulls} == {"P1": 5.0, "P2": None}
    assert all(r.TOTAL_POPULATION in (10.0, 20.0) for r in m)


def test_variable_with_two_descriptions_fans_out(spark):
    t = _tagged(
        spark,
        [
            ("P1", "P3YBASPOP", 10.0, "Pop", "Basics", 1, 0, 1, 2026),
            ("P1", "P3YINC0", 3.0, "Income A", "Income", 1, 1, 0, 2026),
            ("P2", "P3YINC0", 4.0, "Income B", "Income", 1, 1, 0, 2026),
            ("P2", "P3YBASPOP", 20.0, "Pop", "Basics", 1, 0, 1, 2026),
        ],
    )
    leg = feat.demographic_legs()[1]
    m = feat.melt_demographics(t, [leg]).filter(F.col("variable") == "P3YINC0").collect()
    # 2 postal codes x 2 metadata rows of the variable, as the metadata join does
    assert len(m) == 4 and {r.Description for r in m} == {"Income A", "Income B"}


def test_melt_has_no_variable_limit(spark, sf_small):
    want = sorted(map(repr, inputs.features_melted(spark, sf_small).collect()))
    for key, value in (("spark.sql.pivotMaxValues", "2"), ("catchment.broadcast.maxBytes", "10")):
        spark.conf.set(key, value)
        try:
            assert sorted(map(repr, inputs.features_melted(spark, sf_small).collect())) == want
        finally:
            spark.conf.unset(key)


def test_leg_of_many_variables_melts(spark):
    rows = spark.range(60_000).selectExpr(
        "concat('P', id % 2) AS CODE", "concat('ECY', id) AS variable", "CAST(id AS DOUBLE) AS value",
        "'d' AS Description", "'c' AS Category", "2023 AS YEAR")
    leg = feat.Leg("2023", F.col("YEAR") == 2023, "ECY", F.lit(2023))
    table = feat.melt_legs_keyed(rows, [leg], {"T": "7"}, ["variable", "Description", "Category"]).table()
    got = table.agg(F.count("*"), F.count("val"), F.sum("val"), F.count("T")).first()
    assert tuple(got) == (120_000, 60_000, 60_000 * 59_999 / 2, 60_000)


def test_wide_form_in_blocks_equals_one_pivot(spark):
    rows = spark.createDataFrame(
        [(c, f"V{v}", float(c_no * 100 + v)) for c_no, c in enumerate(["a", "b", None]) for v in range(17) if (c_no + v) % 5]
        + [("a", "V1", -1.0), ("a", None, 7.0), ("only", "V16", None)],
        "CODE string, variable string, value double",
    )
    one = feat.pivot_wide(rows, [F.col("CODE").alias("POSTALCODE")])
    names = one.columns
    assert names == ["POSTALCODE"] + sorted([f"V{v}" for v in range(17)] + ["null"])
    key = lambda r: (r[0] is None, r[0] or "")
    expected = sorted((tuple(r) for r in one.collect()), key=key)
    assert [r[0] for r in expected] == ["a", "b", "only", None]
    assert one.filter("POSTALCODE = 'a'").first()["V1"] == 1.0
    for block in (1, 4, 5):
        got = feat.pivot_wide(rows, [F.col("CODE").alias("POSTALCODE")], block)
        assert got.columns == names
        assert sorted((tuple(r) for r in got.collect()), key=key) == expected


def test_wide_form_of_no_rows_has_only_keys(spark):
    empty = spark.createDataFrame([], "CODE string, variable string, value double")
    assert feat.pivot_wide(empty, ["CODE"]).columns == ["CODE"]


def test_wide_form_joins_blocks_without_a_further_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(400).selectExpr("cast(id % 20 as string) CODE", "cast(id % 9 as string) variable", "cast(id as double) value")
        plan = feat.pivot_wide(rows, ["CODE"], 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # the keys once, and (variable, key) then key for each of the three blocks
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning") <= 7
