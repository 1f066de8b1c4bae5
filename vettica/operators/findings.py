"""Triage: which candidates become findings, at which severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettica.functions.languages import display_language
from vettica.functions.text import fixed3
from vettica.operators.secrets import secret_findings
from vettica.operators.verify import UNCERTAIN

# Weakness codes whose scores are known to run too high, and the
# sink that is exempt although it shares two of them.
LOW_CONFIDENCE_CWES = (
    "CWE-120", "CWE-787", "CWE-125", "CWE-119", "CWE-416", "CWE-476", "CWE-134",
)
EXEMPT_SINKS = ("delete",)

# Explanations attached to findings.
UNSUPPORTED_NOTE = (
    "Found by rules alone: no scorer supports the language of this file, so false"
    " positives were not filtered out and the finding needs closer manual review."
)
LOW_CONFIDENCE_NOTE = (
    "Scores for buffer, memory and format calls in C and C++ are known to be too high"
    " on safe code: review by hand and do not rely on the score."
)

PROPERTIES = (
    "struct<cwe:array<string>,ml_verified:boolean,status:string,label:int,"
    "low_confidence_category:boolean,note:string>"
)


def is_low_confidence() -> Column:
    """Whether a scored candidate belongs to a class that is only a warning."""
    codes = F.array(*[F.lit(code) for code in LOW_CONFIDENCE_CWES])
    return (
        F.col("ml_verified")
        & ~F.col("sink_name").isin(*EXEMPT_SINKS)
        & F.arrays_overlap(F.coalesce("cwe", F.array().cast("array<string>")), codes)
    )


def finding_message() -> Column:
    # The wording of the three messages.
    name = F.concat(F.lit("Candidate sink '"), "sink_name", F.lit("'"))
    tags = F.when(
        F.size("cwe") > 0, F.concat(F.lit(" ["), F.array_join("cwe", ", "), F.lit("]"))
    ).otherwise("")
    score = fixed3(F.col("confidence"))
    return (
        F.when(
            ~F.col("ml_verified"),
            F.concat(
                name,
                tags,
                F.lit(
                    " detected by Layer 2, NOT YET verified by Layer 3 (ML) because this"
                    " language is outside the model's supported scope."
                ),
            ),
        )
        .when(
            F.col("status") == UNCERTAIN,
            F.concat(
                name,
                tags,
                F.lit(" — the model isn't confident enough to conclude (confidence="),
                score,
                F.lit(" falls within the uncertain zone), needs manual review."),
            ),
        )
        .otherwise(
            F.concat(
                name,
                tags,
                F.lit(" — the model confirms it is VULNERABLE (confidence="),
                score,
                F.lit(")."),
            )
        )
    )


def decide_findings(verified: DataFrame) -> DataFrame:
    """Keep what is reported and say how severe it is before any override.

    Unsupported: a warning.  Uncertain: a warning.  Label 1: an error.  Label 0
    outside the review zone: no finding.
    """
    decided = verified.withColumn(
        "severity",
        F.when(~F.col("ml_verified"), "warning")
        .when(F.col("status") == UNCERTAIN, "warning")
        .when(F.col("label") == 1, "error"),
    )
    return decided.filter(F.col("severity").isNotNull())


def low_confidence_override(decided: DataFrame) -> DataFrame:
    """Force the known over-scored classes down to a warning."""
    low = is_low_confidence()
    return decided.withColumns(
        {
            "severity": F.when(low, "warning").otherwise(F.col("severity")),
            "low_confidence_category": F.when(low, True),
            "note": F.when(low, LOW_CONFIDENCE_NOTE).when(
                ~F.col("ml_verified"), UNSUPPORTED_NOTE
            ),
        }
    )


def sink_findings(verified: DataFrame) -> DataFrame:
    """Report rows for verified candidates."""
    scored = F.col("ml_verified")
    return low_confidence_override(decide_findings(verified)).select(
        F.concat(F.lit("sink/"), "sink_name").alias("rule_id"),
        finding_message().alias("message"),
        "path",
        F.col("line").alias("start_line"),
        F.col("column").alias("start_column"),
        "severity",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.struct(
            F.when(F.size("cwe") > 0, F.col("cwe")).alias("cwe"),
            F.col("ml_verified"),
            F.when(scored, F.col("status")).alias("status"),
            F.col("label"),
            F.col("low_confidence_category"),
            F.col("note"),
        ).alias("properties"),
        F.col("rule_no").alias("rule_order"),
    )


def all_findings(secret_hits: DataFrame, verified: DataFrame) -> DataFrame:
    """Secret findings (layer 1) and sink findings (layer 2), duplicates kept.

    Report order is (layer, path, start_line, start_column, rule_order).
    """
    secrets = secret_findings(secret_hits).withColumn("properties", F.lit(None).cast(PROPERTIES))
    return (
        secrets.withColumn("layer", F.lit(1))
        .unionByName(sink_findings(verified).withColumn("layer", F.lit(2)))
        .select(
            "layer", "path", "start_line", "start_column", "rule_order", "rule_id",
            "message", "severity", "confidence", "properties",
        )
    )


def _warning(count: Column, languages: Column) -> Column:
    # Fixed value: the wording of the warning.
    return F.when(
        count > 0,
        F.concat(
            F.lit("⚠️  "),
            count.cast("string"),
            F.lit(" candidate(s) from language(s) "),
            F.array_join(F.array_sort(languages), ", "),
            F.lit(
                " not yet AI-verified (Layer 1+2 only) — confidence is much lower than"
                " C/C++/Java, needs closer manual review."
            ),
        ),
    )


def _by_language(verified: DataFrame) -> DataFrame:
    """Candidates and sink findings per unsupported display language; the
    supported ones share one row without a language."""
    reported = (
        ~F.col("ml_verified") | (F.col("status") == UNCERTAIN) | (F.col("label") == 1)
    )
    return verified.groupBy(
        F.when(~F.col("ml_verified"), display_language(F.col("path"))).alias("language")
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(reported).alias("reported"))


def unsupported_warning(verified: DataFrame) -> DataFrame:
    """One row: how many candidates no scorer saw and in which languages, or
    null when there are none."""
    unseen = F.sum(F.when(F.col("language").isNotNull(), F.col("n")))
    return _by_language(verified).agg(
        _warning(unseen, F.collect_set("language")).alias("warning")
    )


def scan_summary(secret_hits: DataFrame, verified: DataFrame) -> DataFrame:
    """One row: candidates, findings, secrets and the warning, from one pass
    over each input."""
    sinks = _by_language(verified).withColumn("secrets", F.lit(0).cast("bigint"))
    secrets = secret_hits.agg(F.count(F.lit(1)).alias("secrets")).select(
        F.lit(None).cast("string").alias("language"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("reported"),
        "secrets",
    )
    unseen = F.sum(F.when(F.col("language").isNotNull(), F.col("n")))
    return sinks.unionByName(secrets).agg(
        F.sum("n").alias("candidate_count"),
        (F.sum("reported") + F.sum("secrets")).alias("finding_count"),
        F.sum("secrets").alias("secret_count"),
        _warning(unseen, F.collect_set("language")).alias("warning"),
    )
