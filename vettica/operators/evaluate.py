"""Measuring a classifier: labelled examples, balance, confusion, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vettica.functions.languages import rule_language
from vettica.functions.text import strip
from vettica.operators.verify import UNCERTAIN

EVALUATED_LANGUAGES = ("c", "cpp")
COMBINED = "combined"


def _pair_columns(pairs: DataFrame) -> DataFrame:
    lang = rule_language(F.col("file_name"))
    before, after = F.col("func_src_before"), F.col("func_src_after")
    return pairs.withColumns(
        {
            "lang": F.when(lang.isin(*EVALUATED_LANGUAGES), lang),
            "degenerate": (strip(before) == "") | (strip(after) == "") | (before == after),
        }
    )


def eval_examples(pairs: DataFrame) -> DataFrame:
    """Two examples per usable pair: the code before (1) and after (0)."""

    def example(code: str, label: int) -> Column:
        return F.struct(F.col(code).alias("code"), F.lit(label).alias("label"))

    usable = _pair_columns(pairs).filter(F.col("lang").isNotNull() & ~F.col("degenerate"))
    return usable.select(
        F.inline(F.array(example("func_src_before", 1), example("func_src_after", 0))),
        "lang",
        "vul_type",
        "func_name",
    )


def eval_stats(pairs: DataFrame) -> DataFrame:
    """What was read and what was left out, language first."""
    known = F.col("lang").isNotNull()
    return _pair_columns(pairs).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~known).alias("skipped_language"),
        F.count_if(known & F.col("degenerate")).alias("skipped_degenerate"),
        (F.count_if(known & ~F.col("degenerate")) * 2).alias("examples"),
    )


def balance_per_language(examples: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keep as many examples of each label as the rarer label has, per language.

    The kept rows are those with the smallest md5 of the ``key`` columns, which
    should name a row.  Languages and labels are few, so a language and label
    can hold most of the table: rows are not ranked within it.  A count per
    md5 prefix finds the prefix in which the last kept row lies; rows below it
    stay, and only the rows of that one prefix are ranked.
    """
    hashed = examples.withColumn(
        "_order", F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in key]))
    ).withColumn("_prefix", F.substring("_order", 1, 4))
    group = ["lang", "label"]
    per_prefix = hashed.groupBy(*group, "_prefix").agg(F.count(F.lit(1)).alias("n"))
    # at most 65,536 prefixes per group from here on
    running = W.partitionBy(*group).orderBy("_prefix")
    lang = W.partitionBy("lang")
    cut = (
        per_prefix.withColumn("through", F.sum("n").over(running))
        .withColumn("total", F.sum("n").over(W.partitionBy(*group)))
        # a label that is missing altogether leaves nothing to balance with
        .withColumn("target", F.when(F.min("label").over(lang) != F.max("label").over(lang), F.min("total").over(lang)))
        .withColumn("before", F.col("through") - F.col("n"))
        .filter((F.col("before") < F.col("target")) & (F.col("target") <= F.col("through")))
        .select(*group, F.col("_prefix").alias("_cut"), (F.col("target") - F.col("before")).alias("_take"))
    )
    # one row per language and label; rows above the cut go before anything else
    placed = hashed.join(cut, group).filter(F.col("_prefix") <= F.col("_cut"))
    below = placed.filter(F.col("_prefix") < F.col("_cut"))
    edge = placed.filter(F.col("_prefix") == F.col("_cut"))
    # copies of a row are counted, not ranked one by one
    columns = examples.columns
    ordered = W.partitionBy(*group).orderBy("_order", *[c for c in columns if c not in group])
    kept = (
        edge.groupBy(*columns, "_order", "_take")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_before", F.sum("_copies").over(ordered) - F.col("_copies"))
        .filter(F.col("_before") < F.col("_take"))
        .withColumn("_keep", F.least("_copies", F.col("_take") - F.col("_before")).cast("int"))
        .select(*columns, F.explode(F.sequence(F.lit(1), F.col("_keep"))).alias("_copy"))
    )
    return below.select(*columns).unionByName(kept.select(*columns))


def _confusion() -> list[Column]:
    y, pred = F.col("y"), F.col("pred")
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (pred == 1)).alias("tp"),
        F.count_if((y == 0) & (pred == 1)).alias("fp"),
        F.count_if((y == 0) & (pred == 0)).alias("tn"),
        F.count_if((y == 1) & (pred == 0)).alias("fn"),
    ]


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("lang").agg(*_confusion())


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / F.nullif(bottom, F.lit(0))).otherwise(F.lit(0.0))


def classifier_metrics(confusion: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1; 0.0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = F.col("n").cast("double")
    with_ratios = confusion.withColumns(
        {
            "accuracy": _ratio(tp + tn, n),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return with_ratios.withColumn("f1", _ratio(F.lit(2.0) * p * r, p + r))


def metrics_rollup(predictions: DataFrame) -> DataFrame:
    """Metrics per language, and of the pooled counts as ``combined``.

    Uncertain rows count like all others; how many there are is a column.
    """
    counts = (
        predictions.rollup("lang")
        .agg(
            F.grouping("lang").alias("pooled"),
            *_confusion(),
            F.count_if(F.col("status") == UNCERTAIN).alias("uncertain"),
        )
        .withColumn("lang", F.when(F.col("pooled") == 1, COMBINED).otherwise(F.col("lang")))
        .drop("pooled")
    )
    return classifier_metrics(counts)


def uncertain_counts(predictions: DataFrame) -> DataFrame:
    return metrics_rollup(predictions).select("lang", "n", "uncertain")


def class_counts(examples: DataFrame) -> DataFrame:
    """Examples per language with either label."""
    return examples.groupBy("lang").agg(
        F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative"),
        F.count(F.lit(1)).alias("total"),
    )
