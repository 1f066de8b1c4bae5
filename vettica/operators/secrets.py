"""Secret scanning: one row per file, line and rule, first match on the line.

All steps are narrow.  A cheap whole-text test drops the files no rule can match
before any line is produced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettica.functions.secret_rules import SECRET_RULES, SecretRule, any_of
from vettica.functions.text import DEFAULT_VISIBLE_PREFIX, lines_of, redact


def split_lines(corpus: DataFrame) -> DataFrame:
    """(path, line, text) of every line, numbered from 1."""
    return corpus.select(
        "path", F.posexplode(lines_of(F.col("text"))).alias("position", "text")
    ).select("path", (F.col("position") + 1).alias("line"), "text")


def _matches(text: Column, rules: tuple[SecretRule, ...]) -> Column:
    hits = [
        F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(order).alias("rule_order"),
            F.regexp_extract(text, rule.pattern, 0).alias("matched_text"),
        )
        for order, rule in enumerate(rules, start=1)
    ]
    return F.filter(F.array(*hits), lambda hit: hit["matched_text"] != "")


def _may_match(text: Column, rules: tuple[SecretRule, ...]) -> Column:
    """A cheap test that holds for every text some rule matches."""
    test = F.lit(False)
    for literal in sorted({rule.literal for rule in rules if rule.literal}):
        test = test | text.contains(literal)
    patterns = {rule.clue or rule.pattern for rule in rules if not rule.literal}
    for pattern in sorted(patterns):
        test = test | text.rlike(pattern)
    return test


def scan_secrets(
    corpus: DataFrame, rules: tuple[SecretRule, ...] = SECRET_RULES
) -> DataFrame:
    """(path, line, rule_id, rule_order, matched_text) of a (path, text) corpus.

    ``matched_text`` is the raw value: pass the result through
    :func:`redacted` before showing or storing it.
    """
    text = F.col("text")
    files = corpus.select("path", "text").filter(_may_match(text, rules))
    return (
        split_lines(files)
        .filter(_may_match(text, rules) & text.rlike(any_of(rules)))
        .select("path", "line", F.inline(_matches(F.col("text"), rules)))
    )


def redacted(hits: DataFrame, visible: int = DEFAULT_VISIBLE_PREFIX) -> DataFrame:
    """The same hits with the value masked and its length kept."""
    return hits.select(
        "path",
        "line",
        "rule_id",
        "rule_order",
        redact(F.col("matched_text"), visible).alias("redacted_text"),
        F.length("matched_text").alias("matched_length"),
    )


def secret_findings(hits: DataFrame) -> DataFrame:
    """Report rows for secret hits: always an error, always certain."""
    masked = redacted(hits)
    return masked.select(
        F.concat(F.lit("secret/"), "rule_id").alias("rule_id"),
        F.concat(
            F.lit("Hardcoded secret detected (rule: "),
            F.col("rule_id"),
            F.lit("): "),
            F.col("redacted_text"),
        ).alias("message"),
        "path",
        F.col("line").alias("start_line"),
        F.lit(1).alias("start_column"),
        F.lit("error").alias("severity"),
        F.lit(1.0).alias("confidence"),
        "rule_order",
    )
