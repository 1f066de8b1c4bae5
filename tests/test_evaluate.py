import hashlib
import random

import pytest

from vettica.operators import evaluate

# published counts of a two-language evaluation, with their metrics
COUNTS = {"c": (283, 285, 77, 79), "cpp": (55, 54, 2, 1)}
METRICS = {
    "c": (724, 0.4972, 0.4982, 0.7818, 0.6086),
    "cpp": (112, 0.5089, 0.5046, 0.9821, 0.6667),
    "combined": (836, 0.4988, 0.4993, 0.8086, 0.6174),
}


def test_published_metrics(spark):
    rows = []
    for lang, (tp, fp, tn, fn) in COUNTS.items():
        for count, y, pred in ((tp, 1, 1), (fp, 0, 1), (tn, 0, 0), (fn, 1, 0)):
            rows += [(lang, y, pred, "OK")] * count
    rows[0] = ("c", 1, 1, "UNCERTAIN_NEEDS_REVIEW")
    predictions = spark.createDataFrame(rows, "lang string, y int, pred int, status string")
    found = {r.lang: r for r in evaluate.metrics_rollup(predictions).collect()}
    assert set(found) == set(METRICS)
    for lang, (n, *ratios) in METRICS.items():
        row = found[lang]
        assert row.n == n == row.tp + row.fp + row.tn + row.fn
        assert [round(row[c], 4) for c in ("accuracy", "precision", "recall", "f1")] == ratios
    assert (found["c"].uncertain, found["cpp"].uncertain, found["combined"].uncertain) == (1, 0, 1)


def test_metrics_without_positives(spark):
    predictions = spark.createDataFrame([("c", 0, 0, "OK")], "lang string, y int, pred int, status string")
    (row,) = evaluate.classifier_metrics(evaluate.confusion_matrix(predictions)).collect()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, 0.0, 0.0, 0.0)


def test_examples_and_stats(spark):
    pairs = spark.createDataFrame(
        [
            ("f", "old", "new", "a/x.c", "v"),
            ("g", "old", "new", "x.hpp", "v"),
            ("h", "same", "same", "x.c", "v"),
            ("i", " \t ", "new", "x.c", "v"),
            ("j", "old", "", "x.cc", "v"),
            ("k", "same", "same", "x.py", "v"),
            ("l", "old", "new", "x.java", "v"),
            ("m", "old", "new", "dir.c/x", "v"),
        ],
        "func_name string, func_src_before string, func_src_after string, file_name string,"
        " vul_type string",
    )
    rows = evaluate.eval_examples(pairs).collect()
    assert sorted((r.func_name, r.code, r.label, r.lang) for r in rows) == [
        ("f", "new", 0, "c"),
        ("f", "old", 1, "c"),
        ("g", "new", 0, "cpp"),
        ("g", "old", 1, "cpp"),
    ]
    (stats,) = evaluate.eval_stats(pairs).collect()
    assert tuple(stats) == (8, 3, 3, 4)


@pytest.mark.parametrize("copies", [1, 400])
def test_balance_is_exact(spark, copies):
    """The kept rows are the ones a full sort would keep, also among copies."""
    pick = random.Random(copies)
    rows = [(f"r{i}", pick.choice(["c", "cpp"]), int(pick.random() < 0.2)) for i in range(900)]
    rows += [("hot", "c", 0)] * copies + [("alone", "java", 1)]
    examples = spark.createDataFrame(rows, "id string, lang string, label int").repartition(7)
    expected = []
    for lang in ("c", "cpp", "java"):
        groups = [
            sorted((r for r in rows if r[1:] == (lang, label)), key=lambda r: hashlib.md5(r[0].encode()).hexdigest())
            for label in (0, 1)
        ]
        target = min(map(len, groups))
        expected += groups[0][:target] + groups[1][:target]
    found = evaluate.balance_per_language(examples, ["id"]).collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    counts = {r.lang: (r.positive, r.negative) for r in evaluate.class_counts(
        evaluate.balance_per_language(examples, ["id"])).collect()}
    assert all(a == b for a, b in counts.values()) and set(counts) == {"c", "cpp"}


def test_balance_cuts_through_copies(spark):
    rows = [("only", "c", 0)] * 50 + [(f"r{i}", "c", 1) for i in range(7)]
    examples = spark.createDataFrame(rows, "id string, lang string, label int").repartition(5)
    found = evaluate.balance_per_language(examples, ["id"]).collect()
    assert sum(r.label == 0 for r in found) == sum(r.label == 1 for r in found) == 7
