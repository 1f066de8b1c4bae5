"""SARIF 2.1.0 reports.

Findings are stored once, in report order, by ``store_findings``; rules, results and
the frame of a report read that table and never the scan again.  A document of any
size is a set of text lines, so nothing is gathered into one row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Format version and schema address.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = (
    "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/"
    "sarif-schema-2.1.0.json"
)
TOOL_NAME = "vettica"

ORDER = ("layer", "path", "start_line", "start_column", "rule_order")


def store_findings(findings: DataFrame, folder: str) -> DataFrame:
    """The findings written to ``folder`` in report order and read again, with a
    bigint ``seq`` that rises in that order and is different for every row.

    A range sort reads its input twice, first for the bounds.  So that the scan and its
    model run once, findings are landed as they come in ``folder`` with ``.landed`` added,
    which is no longer needed afterwards, and sorted from there.  The sort also settles
    the order of findings at one position."""
    spark = findings.sparkSession
    landing = folder.rstrip("/") + ".landed"
    findings.write.mode("errorifexists").parquet(landing)
    landed = spark.read.schema(findings.schema).parquet(landing)
    ordered = landed.orderBy(*ORDER).withColumn("seq", F.monotonically_increasing_id())
    ordered.write.mode("errorifexists").parquet(folder)
    return spark.read.schema(ordered.schema).parquet(folder)


def sarif_rules(stored: DataFrame) -> DataFrame:
    """One row per rule of stored findings with where it is first seen, in that order."""
    first = stored.groupBy("rule_id").agg(F.min("seq").alias("seq"))
    return stored.join(first, ["rule_id", "seq"]).orderBy("seq").select("rule_id", *ORDER)


def _rule() -> Column:
    return F.struct(
        F.col("rule_id").alias("id"),
        F.struct(F.col("rule_id").alias("text")).alias("shortDescription"),
    )


def _result() -> Column:
    extra = F.col("properties")
    return F.struct(
        F.col("rule_id").alias("ruleId"),
        F.col("severity").alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct(F.col("path").alias("uri")).alias("artifactLocation"),
                    F.struct(
                        F.col("start_line").alias("startLine"),
                        F.col("start_column").alias("startColumn"),
                    ).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
        F.struct(
            F.col("confidence").alias("confidence"),
            *[
                extra[name].alias(name)
                for name in (
                    "cwe", "ml_verified", "status", "label", "low_confidence_category", "note",
                )
            ],
        ).alias("properties"),
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """Each finding as the JSON of one SARIF result; absent values are left
    out."""
    return findings.select(*ORDER, F.to_json(_result()).alias("result"))


def sarif_lines(stored: DataFrame, tool: str = TOOL_NAME) -> DataFrame:
    """One document over all stored findings as text lines (section, at, line), to be
    read in the order of (section, at)."""
    first = stored.select(F.min("seq")).scalar()
    frame = stored.agg(F.min("seq").alias("first"))
    return _lines(stored, frame, F.col("at") == first, [], tool)


def sarif_run_lines(stored: DataFrame, tool: str = TOOL_NAME) -> DataFrame:
    """A document for each ``run_id`` of stored findings as text lines (run_id,
    section, at, line), however large the run; null is a run of its own."""
    runs = stored.groupBy("run_id").agg(F.min("seq").alias("first"))
    # seq is different for every row, so this join has no hot key
    marked = stored.join(runs.select(F.col("first").alias("seq"), F.lit(True).alias("_opens")), "seq", "left")
    return _lines(marked, runs, F.coalesce("_opens", F.lit(False)), ["run_id"], tool)


def _lines(stored: DataFrame, documents: DataFrame, opens: Column, by: list[str], tool: str) -> DataFrame:
    """The lines of the documents named by ``by``; ``opens`` marks the lowest ``seq``
    of a document, whose result, like its rule, has no comma before it."""
    name = json.dumps(tool, ensure_ascii=False)
    frame = [
        (0, f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":'
            f'[{{"tool":{{"driver":{{"name":{name},"rules":['),
        (2, ']}},"results":['),
        (4, "]}]}"),
    ]
    parts = F.array(*[F.struct(F.lit(n).alias("section"), F.lit(t).alias("line")) for n, t in frame])
    outer = documents.select(*by, F.inline(parts)).withColumn("at", F.lit(None).cast("bigint"))
    comma = F.when(opens, "").otherwise(",")
    marked = stored.withColumnRenamed("seq", "at").withColumn("_comma", comma)
    results = marked.select(
        *by, F.lit(3).alias("section"), "at", F.concat("_comma", F.to_json(_result())).alias("line")
    )
    # the rule of the first finding is the first rule; only it can miss the comma
    rules = (
        marked.groupBy(*by, "rule_id")
        .agg(F.min("at").alias("at"), F.min(F.length("_comma")).alias("_commas"))
        .select(
            *by,
            F.lit(1).alias("section"),
            "at",
            F.concat(F.when(F.col("_commas") == 0, "").otherwise(","), F.to_json(_rule())).alias("line"),
        )
    )
    return outer.unionByName(rules).unionByName(results)


def write_report(stored: DataFrame, folder: str, tool: str = TOOL_NAME) -> None:
    """One report over all stored findings.  The text files of the folder, in the
    order of their names, are the document."""
    lines = sarif_lines(stored, tool).orderBy("section", "at")
    lines.select("line").write.mode("errorifexists").text(folder)


def write_run_reports(stored: DataFrame, folder: str, tool: str = TOOL_NAME) -> None:
    """A report for each run under ``run_id=.../``, each as by :func:`write_report`."""
    lines = sarif_run_lines(stored, tool).orderBy("run_id", "section", "at")
    lines.select("run_id", "line").write.mode("errorifexists").partitionBy("run_id").text(folder)


def with_run(findings: DataFrame, run_id: Column) -> DataFrame:
    """Name the run each finding belongs to, such as a repository."""
    return findings.withColumn("run_id", run_id)
