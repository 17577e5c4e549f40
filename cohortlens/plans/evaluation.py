"""Evaluation of binary predictions held as rows (label, prediction or score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.expressions import ratio
from cohortlens.operators.ordered import running_totals


def threshold(score: Column | str, cut: float = 0.5) -> Column:
    return ((F.col(score) if isinstance(score, str) else score) > cut).cast("int")


def _cells(label: str, prediction: str) -> list[Column]:
    y, p = F.col(label), F.col(prediction)
    return [
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    ]


def confusion_cells(
    df: DataFrame, by: list[str] | None = None, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """tp, fp, fn, tn per ``by`` in one aggregate; empty cells are 0."""
    return df.groupBy(*(by or [])).agg(*_cells(label, prediction))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Long confusion matrix (label, prediction, n) with all four cells."""
    cells = confusion_cells(df, label=label, prediction=prediction)
    rows = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    structs = [
        F.struct(F.lit(y).alias("label"), F.lit(p).alias("prediction"), F.col(c).alias("n"))
        for y, p, c in rows
    ]
    return cells.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def accuracy(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return confusion_cells(df, by).select(
        *(by or []),
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"),
        ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias(
            "accuracy"
        ),
    )


def precision_recall_f1(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion_cells(df, by).select(
        *(by or []),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def predictive_values(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return confusion_cells(df, by).select(
        *(by or []),
        ratio("tp", F.col("tp") + F.col("fp")).alias("ppv"),
        ratio("tn", F.col("tn") + F.col("fn")).alias("npv"),
    )


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted averages."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def entry(name: str, hit: Column, wrong: Column, missed: Column):
        return F.struct(
            F.lit(name).alias("class"),
            ratio(hit, hit + wrong).alias("precision"),
            ratio(hit, hit + missed).alias("recall"),
            ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"),
        )

    classes = confusion_cells(df).select(entry("0", tn, fn, fp).alias("a"), entry("1", tp, fp, fn).alias("b"))
    a, b = "a", "b"
    both = F.col("a.support") + F.col("b.support")

    def average(name: str, wa: Column, wb: Column):
        total = wa + wb
        return F.struct(
            F.lit(name).alias("class"),
            *[
                ratio(F.col(f"{a}.{m}") * wa + F.col(f"{b}.{m}") * wb, total).alias(m)
                for m in ("precision", "recall", "f1")
            ],
            both.alias("support"),
        )

    rows = F.array(
        F.col("a"),
        F.col("b"),
        average("macro avg", F.lit(1), F.lit(1)),
        average("weighted avg", F.col("a.support"), F.col("b.support")),
    )
    return classes.select(F.explode(rows).alias("r")).select("r.*")


def roc_auc(df: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half.

    Rows are counted per score, and negatives below each score come from bucketed running totals, so
    no task sorts all scores.
    """
    by = by or []
    counted = df.groupBy(*by, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    ranked = running_totals(counted, "_score", ["neg"], by)
    wins = F.sum(F.col("pos").cast("double") * (2 * F.col("neg_before") + F.col("neg")))
    return ranked.groupBy(*by).agg(
        F.try_divide(
            wins, 2.0 * F.sum("pos").cast("double") * F.sum("neg").cast("double")
        ).alias("roc_auc")
    )


def roc_on_labels(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same area with the 0/1 prediction used as score: mean of both recalls."""
    return confusion_cells(df, by).select(
        *(by or []),
        (
            (ratio("tp", F.col("tp") + F.col("fn")) + ratio("tn", F.col("tn") + F.col("fp"))) / 2
        ).alias("roc_on_labels"),
    )


def baseline_lift(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Base rate, majority-class accuracy, all-zero accuracy, and lift over predicting 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    positive = ratio(tp + fn, n)
    return confusion_cells(df, by).select(
        *(by or []),
        positive.alias("base_rate"),
        F.greatest(positive, 1 - positive).alias("majority_accuracy"),
        ratio(tn + fp, n).alias("zero_accuracy"),
        ratio(tp + tn, n).alias("accuracy"),
        (ratio(tp + tn, n) - (1 - positive)).alias("lift"),
    )


def accuracy_matrix(df: DataFrame, step: str = "t", split: str = "is_dev") -> DataFrame:
    """Dev and train accuracy over all rows up to each step, with the dev gain over the step before.

    Rows are counted once per step; the nested totals are running sums over the few steps.
    """
    hit, dev = F.col("label") == F.col("prediction"), F.col(split)
    counted = df.groupBy(step).agg(
        F.count_if(dev).alias("dev_n"),
        F.count_if(dev & hit).alias("dev_hits"),
        F.count_if(~dev).alias("train_n"),
        F.count_if(~dev & hit).alias("train_hits"),
    )
    so_far = (
        Window.partitionBy(F.lit(0))
        .orderBy(step)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = counted.select(
        step,
        *[
            ratio(F.sum(f"{side}_hits").over(so_far), F.sum(f"{side}_n").over(so_far)).alias(
                f"{side}_accuracy"
            )
            for side in ("dev", "train")
        ],
    )
    return with_gain(rows, step)


def with_gain(rows: DataFrame, step: str = "t", by: list[str] | None = None) -> DataFrame:
    """One metric row per step; the window runs over steps, never over data rows."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(step)
    return rows.withColumn(
        "dev_gain", F.col("dev_accuracy") - F.lag("dev_accuracy").over(order)
    )
