"""Evaluation of extractors and classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skilldemand.functions.numbers import f_score, round_exact, safe_ratio


def _overlaps(
    gold: DataFrame, pred: DataFrame, key: str | list[str], items: str, carry: list[str] | None = None
) -> DataFrame:
    """True and false positives and false negatives per row; a missing prediction is empty."""
    empty = F.array().cast("array<string>")
    keys = [key] if isinstance(key, str) else key
    both = gold.select(*keys, *(carry or []), F.array_distinct(items).alias("_gold")).join(
        pred.select(*keys, F.array_distinct(items).alias("_pred")), keys, "left"
    )
    found = F.coalesce("_pred", empty)
    hits = F.size(F.array_intersect("_gold", found))
    return both.select(
        *keys,
        *(carry or []),
        hits.alias("tp"),
        (F.size(found) - hits).alias("fp"),
        (F.size("_gold") - hits).alias("fn"),
    )


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision = safe_ratio(tp, tp + fp)
    recall = safe_ratio(tp, tp + fn)
    return precision, recall, f_score(precision, recall)


def _rounded(columns: dict[str, Column], digits: int = 3) -> list[Column]:
    return [round_exact(value, digits).alias(name) for name, value in columns.items()]


def prf_macro(gold: DataFrame, pred: DataFrame, key: str = "id", items: str = "skills") -> DataFrame:
    """Precision, recall and F1 of item sets: per row, then the mean over rows."""
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    scored = _overlaps(gold, pred, key, items).select(p.alias("p"), r.alias("r"), f.alias("f"))
    return scored.agg(
        *_rounded({"precision": F.avg("p"), "recall": F.avg("r"), "f1": F.avg("f")})
    )


def prf_micro(gold: DataFrame, pred: DataFrame, key: str = "id", items: str = "skills") -> DataFrame:
    """Precision, recall and F1 of item sets over the pooled counts."""
    pooled = _overlaps(gold, pred, key, items).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return pooled.select(*_rounded({"precision": p, "recall": r, "f1": f}))


def ab_compare(
    gold: DataFrame, preds: dict[str, DataFrame], key: str = "id", items: str = "skills"
) -> DataFrame:
    """Macro and micro scores of each extractor, the winner by macro F1 and its margin."""
    names = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("extractor")) for i, name in enumerate(preds)]
    tagged = [pred.select(key, items).withColumn("position", F.lit(i)) for i, pred in enumerate(preds.values())]
    wanted = gold.select(key, items, F.explode(F.array(*names)).alias("_x")).select(key, items, "_x.*")
    counted = _overlaps(wanted, reduce(DataFrame.unionByName, tagged), [key, "position"], items, ["extractor"])
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    scored = counted.select("*", p.alias("p"), r.alias("r"), f.alias("f"))
    pooled = scored.groupBy("position", "extractor").agg(
        *_rounded({"precision": F.avg("p"), "recall": F.avg("r"), "f1": F.avg("f")}),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
    )
    micro = _rounded({"micro_precision": p, "micro_recall": r, "micro_f1": f})
    # one row per extractor from here on
    everyone = Window.partitionBy()
    best = F.max_by("extractor", F.struct("f1", -F.col("position"))).over(everyone)
    return pooled.select(
        "extractor",
        "precision",
        "recall",
        "f1",
        *micro,
        (F.col("extractor") == best).alias("is_winner"),
        round_exact(F.max("f1").over(everyone) - F.min("f1").over(everyone), 3).alias("f1_margin"),
    )


def accuracy(labelled: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Share of rows whose prediction equals the label."""
    return labelled.agg(F.avg((F.col(gold) == F.col(pred)).cast("int")).alias("accuracy"))


def confusion(
    labelled: DataFrame, classes: list[str], gold: str = "gold", pred: str = "pred"
) -> DataFrame:
    """Rows by label, columns by prediction, for a fixed class list."""
    counted = labelled.groupBy(F.col(gold).alias("gold")).agg(
        *[F.count_if(F.col(pred) == c).alias(c) for c in classes]
    )
    rows = labelled.sparkSession.createDataFrame(list(enumerate(classes)), "ord int, gold string")
    return (
        rows.join(counted, "gold", "left").fillna(0, classes).orderBy("ord").select("gold", *classes)
    )


def _class_counts(labelled: DataFrame, classes: list[str], gold: str, pred: str, by: list[str]) -> DataFrame:
    """Counts per class from one pass over the rows, one row per class."""
    is_gold, is_pred = (lambda c: F.col(gold) == c), (lambda c: F.col(pred) == c)
    sums = [
        F.struct(
            F.lit(c).alias("class"),
            F.lit(i).alias("ord"),
            F.count_if(is_gold(c) & is_pred(c)).alias("tp"),
            F.count_if(~is_gold(c) & is_pred(c)).alias("fp"),
            F.count_if(is_gold(c) & ~is_pred(c)).alias("fn"),
        )
        for i, c in enumerate(classes)
    ]
    wide = labelled.groupBy(*by).agg(
        F.array(*sums).alias("per_class"),
        F.count("*").alias("n"),
        F.count_if(F.col(gold) == F.col(pred)).alias("correct"),
    )
    return wide.select(*by, "n", "correct", F.explode("per_class").alias("c")).select(
        *by, "n", "correct", "c.*"
    )


def _with_prf(counts: DataFrame) -> DataFrame:
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    scores = {"precision": p, "recall": r, "f1": f}
    return counts.withColumns(
        {name: round_exact(value, 3) for name, value in scores.items()}
        | {"support": F.col("tp") + F.col("fn")}
    )


def prf_per_class(
    labelled: DataFrame, classes: list[str], gold: str = "gold", pred: str = "pred"
) -> DataFrame:
    """Precision, recall and F1 of each class."""
    scored = _with_prf(_class_counts(labelled, classes, gold, pred, []))
    return scored.orderBy("ord").select("class", "precision", "recall", "f1", "support")


def _weighted() -> Column:
    return round_exact(F.sum(F.col("f1") * F.col("support") / F.col("n")), 3).alias("weighted_f1")


def weighted_f1(
    labelled: DataFrame, classes: list[str], gold: str = "gold", pred: str = "pred"
) -> DataFrame:
    """Mean of the rounded F1 of the classes, weighted by their rows."""
    return _with_prf(_class_counts(labelled, classes, gold, pred, [])).agg(_weighted())


def compare_models(
    gold: DataFrame, preds: dict[str, DataFrame], classes: list[str], key: str = "id"
) -> DataFrame:
    """Accuracy, weighted F1 and per-class scores of each model, in one job for all models."""
    tagged = [p.select(key, "pred").withColumn("model", F.lit(name)) for name, p in preds.items()]
    labelled = gold.select(key, "gold").join(reduce(DataFrame.unionByName, tagged), key)
    scored = _with_prf(_class_counts(labelled, classes, "gold", "pred", ["model"]))

    def of_class(c: str, score: str) -> Column:
        return F.max(F.when(F.col("class") == c, F.col(score))).alias(f"{c}_{score}")

    return scored.groupBy("model").agg(
        F.max(F.col("correct") / F.col("n")).alias("accuracy"),
        _weighted(),
        *[of_class(c, score) for c in classes for score in ("precision", "recall", "f1")],
    )
