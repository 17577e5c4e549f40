"""Invariants of sampling, splitting, models and iterative recommenders."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.checks import models as C
from cohortlens.checks.student import features
from cohortlens.plans import models, ratings, recommend, sampling, students, transforms
from cohortlens.sources import readers
from cohortlens.checks import views as V


@pytest.fixture(scope="module")
def table(tables):
    return features(tables).cache()


def test_no_student_on_both_sides(table):
    sides = table.groupBy("emplid").agg(F.count_distinct("is_dev").alias("n"))
    assert sides.filter("n > 1").count() == 0


def test_chunks_are_nested(table):
    two, three = (students.chunk(table, t, V.ENCODING) for t in (2, 3))
    keys = ["emplid", "cohort", "term_code", "plan_cd", "gendr_m"]
    assert two.join(three, keys, "left_anti").count() == 0


def skewed(spark, n=120, minority=20):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(n, 2)), columns=["x", "y"])
    pdf["k"] = range(n)
    pdf["label"] = [1] * minority + [0] * (n - minority)
    return pdf, spark.createDataFrame(pdf)


def test_smote_balances_with_convex_combinations(spark):
    pdf, df = skewed(spark)
    got = sampling.smote(df, ["k"], ["x", "y"], "label").toPandas()
    assert (got.label == 1).sum() == (got.label == 0).sum() == 100
    minor = pdf[pdf.label == 1][["x", "y"]].to_numpy()
    for p in got[got.synthetic][["x", "y"]].to_numpy():
        assert (minor.min(0) - 1e-9 <= p).all() and (p <= minor.max(0) + 1e-9).all()
    again = sampling.smote(df.repartition(7), ["k"], ["x", "y"], "label").toPandas()
    order = ["row_id", "x", "y"]
    pd.testing.assert_frame_equal(
        got.sort_values(order).reset_index(drop=True), again.sort_values(order).reset_index(drop=True)
    )


def test_random_oversampling_balances(spark):
    _, df = skewed(spark)
    got = sampling.random_oversample(df, ["k"], ["x", "y"], "label").toPandas()
    assert (got.label == 1).sum() == (got.label == 0).sum() == 100
    assert len(got.drop_duplicates(["x", "y"])) == 120


def test_adasyn_adds_minority_rows_only(spark):
    _, df = skewed(spark)
    got = sampling.adasyn(df, ["k"], ["x", "y"], "label").toPandas()
    assert set(got[got.synthetic].label) == {1} and 60 < got.synthetic.sum() < 100


def test_quantile_normal_is_monotone_and_normal(spark):
    df = spark.range(2001).select((F.col("id") * F.col("id")).cast("double").alias("x"))
    got = transforms.quantile_normal(df.withColumn("raw", F.col("x")), ["x"]).orderBy("raw").toPandas()
    assert got.x.is_monotonic_increasing
    assert abs(got.x.mean()) < 0.02 and abs(got.x.iloc[1000]) < 0.01
    assert got.x.iloc[-1] == pytest.approx(5.199, abs=0.01)


def test_logistic_metrics_are_consistent(table):
    data = models.held(models.seq_data(table, 3, 4.0, C.HISTORY, encoding=V.ENCODING))
    n = models.train_part(data).count()
    model, row = models.evaluate("logistic", models.logistic(n), data, len(C.HISTORY))
    got = row.first()
    assert got.train_n == n and 0.5 <= got.train_roc_auc <= 1 and 0 <= got.dev_accuracy <= 1
    assert models.coefficients(model, C.HISTORY).count() == len(C.HISTORY)


def test_balanced_training_part_keeps_dev(table):
    plain = models.seq_data(table, 3, 4.0, C.HISTORY, encoding=V.ENCODING)
    grown = models.seq_data(table, 3, 4.0, C.HISTORY, True, encoding=V.ENCODING)
    assert plain.filter("is_dev").count() == grown.filter("is_dev").count()
    sizes = {r.label: r["count"] for r in grown.filter("not is_dev").groupBy("label").count().collect()}
    assert sizes[0] == sizes[1]


def structured(spark):
    rng = np.random.default_rng(9)
    u, i = rng.normal(0, 1.5, 60), rng.normal(0, 1.5, 40)
    rows = [
        (a, b, int(np.clip(round(5.5 + u[a] + i[b] + rng.normal(0, 0.5)), 1, 10)))
        for a in range(60) for b in range(40) if rng.random() < 0.5
    ]
    return spark.createDataFrame(rows, "user int, item int, rating int")


def test_baseline_and_co_clusters_beat_the_normal_predictor(spark):
    train, test = ratings.holdout(structured(spark))

    def error(predictions):
        return ratings.rmse(predictions).first()[0]

    normal = error(recommend.normal_predictor(train, test))
    assert error(recommend.baseline_predict(train, test)) < 0.6 * normal
    assert error(recommend.co_cluster_predict(train, test, rounds=2)) < 0.6 * normal
    assert error(recommend.als_predict(train, test)) < 0.6 * normal


def test_folds_cover_every_rating_once(spark):
    rows = structured(spark)
    train, test = ratings.folded(rows, 3)
    assert test.count() == rows.count()
    assert train.count() == 2 * rows.count()
    assert train.join(test, ["fold", "user", "item"]).count() == 0


def test_malformed_lines_are_skipped(spark, tmp_path):
    path = tmp_path / "ratings.csv"
    path.write_bytes('a;b;c\n1;"x;\xe9";5\n2;y;6;extra;field\nbad;z;7\n3;w;8\n'.encode("latin-1"))
    frame = readers.read_delimited(
        spark, str(path), readers.RATINGS_SCHEMA, ["user", "item", "rating"]
    )
    assert frame.count() == 3
    assert [tuple(r) for r in frame.collect()] == [(1, "x;é", 5), (None, "z", 7), (3, "w", 8)]
    assert [r[0] for r in frame.select("rating").collect()] == [5, 7, 8]


def test_short_lines_are_filled_up(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("a;b;c\n1;x\n2\n3;z;9\n")
    frame = readers.read_delimited(spark, str(path), readers.RATINGS_SCHEMA, ["user", "item", "rating"])
    assert [tuple(r) for r in frame.collect()] == [(1, "x", None), (2, None, None), (3, "z", 9)]


def test_an_incomplete_dev_row_makes_the_assembling_fail(table):
    columns = ["term_gpa", "gpa_hs"]
    one = table.filter("is_dev AND semester_index <= 3").orderBy("emplid", "cohort", "term_code", "plan_cd").limit(1)
    broken = table.unionByName(one.withColumn("gpa_hs", F.lit(None).cast(table.schema["gpa_hs"].dataType)))
    listed = models.incomplete_dev(broken, 3, columns, V.ENCODING)
    assert listed.filter(F.array_contains("missing", "gpa_hs")).count() >= 1
    with pytest.raises(Exception, match="null"):
        models.seq_data(broken, 3, 4.0, columns, encoding=V.ENCODING).collect()


def test_a_cluster_without_shared_folder_is_refused(monkeypatch, spark):
    from cohortlens import session

    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError):
        session.checkpoint_root(Session())


def test_semesters_are_fitted_side_by_side(spark, monkeypatch):
    both = threading.Barrier(2, timeout=60)

    def evaluate(name, estimator, data, n_features):
        # Passed only when another semester is being fitted as well.
        both.wait()
        return None, spark.createDataFrame([(0.5, 0.6)], "dev_accuracy double, train_accuracy double")

    monkeypatch.setattr(models, "seq_data", lambda rows, t, *rest: rows.filter(F.col("t") <= t))
    monkeypatch.setattr(models, "evaluate", evaluate)
    rows = spark.createDataFrame([(0, False), (1, False)], "t int, is_dev boolean")
    got = models.accuracy_by_semester(rows, [0, 1], 4.0, ["x"]).orderBy("t").collect()
    assert [(r.t, r.dev_accuracy, r.train_accuracy) for r in got] == [(0, 0.5, 0.6), (1, 0.5, 0.6)]
