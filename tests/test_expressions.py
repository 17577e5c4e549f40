"""Hand-made cases for the scalar rules."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import expressions as X
from cohortlens.operators import encode, rows
from cohortlens.plans import course, students, term


def values(spark, kind, items, expr):
    df = spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_semester_index(spark):
    diffs = [-10, -8, -3, 0, 3, 4, 7, 8, 9, 10, 13, 17, 18, 20]
    expected = [-1, -1, 0, 1, 1, 1, 1, 2, 2, 3, 3, 3, 4, 5]
    assert values(spark, "int", diffs, X.semester_index("x")) == expected


def test_time_to_degree(spark):
    diffs = [0, 3, 4, 7, 8, 9, 10, 17, 18, 20, 28, 37, 38, 40, None, -10]
    expected = [1, 1, 1, 2, 2, 2, 3, 4, 4, 5, 6, 8, 8, 9, None, -10]
    assert values(spark, "int", diffs, X.time_to_degree("x")) == expected


def test_ratio_rules(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 2)], "a int, b int")
    assert [r[0] for r in df.select(X.ratio("a", "b")).collect()] == [0.0, 0.0, 0.5]
    assert [r[0] for r in df.select(X.ratio("a", "b", "null")).collect()] == [None, None, 0.5]


def test_graduated_within_counts_null_as_graduated(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (None, 0)], "a int, b int")
    assert [r[0] for r in df.select(X.graduated_within(["a", "b"])).collect()] == [0, 1, 1]


def test_plan_text_of_null(spark):
    assert values(spark, "string", [None, "MATHPR0000"], X.plan_subject("x")) == ["nan", "MATH"]


def test_one_hot_of_null_and_odd_labels(spark):
    df = spark.createDataFrame([(None,), ("it's",), ("$6,000",)], "x string")
    encoding = [("x", "P", ["it's", "$6,000"])]
    got = {tuple(r) for r in encode.one_hot(df, encoding).collect()}
    assert got == {(0, 0), (1, 0), (0, 1)}
    assert encode.export_names(encoding) == {"p_it_s": "P_it's", "p_6_000": "P_$6,000"}


def test_categories_have_no_cap(spark):
    df = spark.range(5000).selectExpr("id % 2500 AS x").unionAll(spark.sql("SELECT NULL AS x"))
    assert encode.categories(df, "x").count() == 2500


def test_complete_rows_drop_nan_and_infinity(spark):
    df = spark.createDataFrame(
        [(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double"
    )
    assert [r[0] for r in rows.complete_rows(df).collect()] == [1.0]


def enrolled(spark, items):
    return spark.createDataFrame(
        items,
        "cohort int, emplid string, term_code int, plan_cd string, grade string, units int,"
        " grade_points int, bcmp int",
    )


def test_term_with_only_withdrawals_and_null_keys(spark):
    df = enrolled(
        spark,
        [(2094, "a", 2094, "MATHBA0000", "W", 3, 0, 0), (2094, None, 2094, "MATHBA0000", "A", 3, 12, 0)],
    )
    found = term.grade_averages(
        term.cumulate(term.term_aggregate(course.course_features(df)), course.CUMULATED)
    ).collect()
    assert len(found) == 1 and found[0].units_in_gpa == 0 and found[0].term_gpa == 0.0


def test_plans_of_one_term_share_the_cumulative_sum(spark):
    df = enrolled(
        spark,
        [
            (2094, "a", 2094, "MATHBA0000", "A", 3, 12, 0),
            (2094, "a", 2094, "PHYSBA0000", "B", 1, 3, 0),
            (2094, "a", 2101, "PHYSBA0000", "B", 2, 6, 0),
        ],
    )
    grouped = term.term_aggregate(course.course_features(df))
    by_term = term.cumulate(grouped, ["units_taken"]).orderBy("term_code", "plan_cd")
    assert [r.cum_units_taken for r in by_term.collect()] == [4, 4, 6]
    by_row = term.cumulate_rows(grouped, ["units_taken"]).orderBy("term_code", "plan_cd")
    assert [r.cum_units_taken for r in by_row.collect()] == [3, 4, 6]


def test_cumulative_equals_group_sum_running_sum_and_join(spark, tables):
    from cohortlens.checks.student import terms

    grouped = terms(tables)
    pdf = grouped.toPandas()
    per_term = pdf.groupby(["emplid", "term_code"])["units_taken"].sum()
    running = per_term.groupby(level=0).cumsum().rename("expected").reset_index()
    got = term.cumulate(grouped, ["units_taken"]).toPandas()
    merged = got.merge(running, on=["emplid", "term_code"])
    assert len(merged) == len(pdf) and (merged.cum_units_taken == merged.expected).all()


def test_pre_degree_load_skips_pre_cohort_rows(spark):
    df = enrolled(
        spark,
        [
            (2094, "a", 2091, "MATHBA0000", "A", 6, 24, 0),
            (2094, "a", 2094, "MATHBA0000", "A", 15, 60, 0),
        ],
    )
    grouped = term.cumulate(term.term_aggregate(course.course_features(df)), course.CUMULATED)
    found = term.load_indexes(grouped).orderBy("term_code").collect()
    assert [r.semester_index for r in found] == [0, 1]
    assert [r.load_index for r in found] == [0.0, 21 / 15]
    assert [r.load_index_exclude for r in found] == [0.0, 1.0]
    assert found[0].load_index_only == pytest.approx(21 / 15 - 1.0)


def test_major_change_ignores_the_plan_type(spark):
    df = spark.createDataFrame(
        [
            (2094, "a", 2094, "MATHPR0000"),
            (2094, "a", 2101, "MATHBA0000"),
            (2094, "a", 2102, "PHYSBA0000"),
            (2094, "b", 2094, "PHYSBA0000"),
        ],
        "cohort int, emplid string, term_code int, plan_cd string",
    )
    found = term.major_changes(df).orderBy("emplid", "term_code").collect()
    assert [r.major_change_indicator for r in found] == [0, 0, 1, 0]
    assert [r.major_change_cnt for r in found] == [0, 0, 1, 0]


def test_family_size_99_becomes_na(spark):
    df = spark.createDataFrame(
        [("a", "F", "x", "y", "z", 99, 199, 1), ("b", "F", "x", "y", "z", 3, 4, 1)],
        "emplid string, sex string, race_eth string, min_status string, first_gen string,"
        " dep_family int, indep_family int, indep_income int",
    )
    found = {r.emplid: (r.dep_family_size, r.applicant_family_size) for r in
             students.demographics(df).collect()}
    assert found == {"a": ("NA", "NA"), "b": ("3", "4")}


def test_fused_score_prefers_the_known_test(spark):
    columns = students.TEST_COLUMNS
    base = {c: None for c in columns}
    items = [
        (False, *{**base, "sat_comp": 10}.values()),
        (False, *{**base, "sat_comp": 20}.values()),
        (False, *base.values()),
    ]
    df = spark.createDataFrame(items, "is_dev boolean, " + ", ".join(f"{c} int" for c in columns))
    fused = students.fuse_scores(df)
    filled = students.impute_means(fused, ["t_comp"]).orderBy("t_comp").collect()
    assert [r.t_comp for r in filled] == [-1.0, 0.0, 1.0]


def test_constant_column_scales_to_zero_and_train_figures_apply_to_dev(spark):
    df = spark.createDataFrame([(False, 5, 0.0), (False, 5, 2.0), (True, 5, 4.0)],
                               "is_dev boolean, c int, x double")
    assert {r.c for r in students.scale_columns(df, ["c"]).collect()} == {0.0}
    scaled = students.scale_columns(df, ["x"], fit_on="train").orderBy("x").collect()
    assert [r.x for r in scaled] == [-1.0, 1.0, 3.0]


def test_split_share(spark):
    ids = spark.range(20000).select(F.col("id").cast("string").alias("emplid"))
    share = ids.select(F.avg(X.is_dev("emplid").cast("int"))).first()[0]
    assert 0.09 < share < 0.11
