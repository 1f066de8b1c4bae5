"""Sink candidates: dangerous calls with their enclosing function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettica.functions.languages import rule_language
from vettica.functions.sink_rules import (
    SINK_RULES,
    SinkRule,
    join_rules,
    matching_rules,
    name_filter,
    text_filter,
)
from vettica.functions.text import bytes_as_chars, chars_as_text, strip
from vettica.operators.code_scan import LANGUAGES, extent, scan_code


def with_language(corpus: DataFrame) -> DataFrame:
    """Files some rule language applies to, with that language."""
    return corpus.withColumn("lang", rule_language(F.col("path"))).filter(
        F.col("lang").isNotNull()
    )


def _scanned(corpus: DataFrame, rules: tuple[SinkRule, ...] | None) -> DataFrame:
    """(path, code, lang, scan): each file with its functions and calls.

    Files that hold no name any rule of their language asks for are dropped by
    a plain search of their text before they are cut up.
    """
    files = with_language(corpus.select("path", "text"))
    names, langs = None, LANGUAGES
    if rules is not None:
        names = {lang: name_filter(rules, lang) for lang in LANGUAGES}
        names = {lang: pattern for lang, pattern in names.items() if pattern}
        langs = tuple(names)
        if not names:
            raise ValueError("no rule is for a language that can be scanned")
        can_hit = F.lit(False)
        for lang in langs:
            pattern = text_filter(rules, lang)
            can_hit = can_hit | ((F.col("lang") == lang) & F.col("text").rlike(pattern))
        files = files.filter(can_hit)
    return files.select("path", "lang", bytes_as_chars(F.col("text")).alias("code")).select(
        "path", "lang", "code", scan_code(names, langs).alias("scan")
    )


def _units(scanned: DataFrame) -> DataFrame:
    """One row per function that holds calls, and one per call outside.

    The text of a function is cut out once, before its calls are unfolded.
    """
    lines = F.split(F.col("code"), "\n", -1)
    kept = F.filter(F.col("scan.units"), lambda unit: F.size(unit["calls"]) > 0)
    return scanned.select("path", "lang", lines.alias("lines"), kept.alias("units"), "scan.loose").select(
        "path",
        "lang",
        F.inline(
            F.concat(
                F.transform(
                    "units",
                    lambda unit: F.struct(
                        unit["start_line"].alias("function_line"),
                        unit["end_line"].alias("function_end_line"),
                        extent(F.col("lines"), unit).alias("snippet"),
                        unit["calls"].alias("calls"),
                    ),
                ),
                F.transform(
                    "loose",
                    lambda call: F.struct(
                        F.lit(None).cast("int").alias("function_line"),
                        F.lit(None).cast("int").alias("function_end_line"),
                        F.element_at(F.col("lines"), call["line"]).alias("snippet"),
                        F.array(call).alias("calls"),
                    ),
                ),
            )
        ),
    ).select(
        "path",
        "lang",
        "function_line",
        "function_end_line",
        F.when(F.col("function_line").isNull(), strip(chars_as_text(F.col("snippet"))))
        .otherwise(chars_as_text(F.col("snippet")))
        .alias("snippet"),
        "calls",
    )


def call_sites(corpus: DataFrame) -> DataFrame:
    """Every call: where, which name, which form and which receiver."""
    scan = F.col("scan")
    calls = F.concat(
        F.flatten(F.transform(scan["units"], lambda unit: unit["calls"])), scan["loose"]
    )
    return _scanned(corpus, None).select("path", "lang", F.inline(calls)).select(
        "path",
        "lang",
        "line",
        F.col("start_column").alias("column"),
        chars_as_text(F.col("name")).alias("name"),
        "form",
        chars_as_text(F.col("target")).alias("target"),
    )


def function_spans(corpus: DataFrame) -> DataFrame:
    """Extent of every function, method and constructor; lines and byte
    columns start at 1, the end column is that of the last byte."""
    # the outer form keeps Spark from testing the size of the array, that is
    # from scanning every file once more, in a filter below
    return (
        _scanned(corpus, None)
        .select("path", "lang", F.inline_outer("scan.units"))
        .filter(F.col("start_line").isNotNull())
        .select(
            "path",
            "lang",
            "start_line",
            (F.col("start_column") + 1).alias("start_column"),
            "end_line",
            "end_column",
        )
    )


def sink_candidates(
    corpus: DataFrame, rules: tuple[SinkRule, ...] | DataFrame = SINK_RULES
) -> DataFrame:
    """One row per call and rule it satisfies, with the text of the innermost
    function around it, or the stripped line where there is none.

    Rules as a tuple are part of the plan and drop texts without any wanted name
    early; rules as a table (see ``rules_table``) are joined, any number of them."""
    call = F.col("call")
    listed = isinstance(rules, tuple)
    calls = _units(_scanned(corpus, rules if listed else None)).select(
        "path", "lang", "function_line", "function_end_line", "snippet",
        F.explode("calls").alias("call"),
    )
    if listed:
        hits: Column = matching_rules(
            rules, F.col("lang"), call["form"], call["name"], call["target"], call["args"]
        )
        met = calls.select("*", F.inline(hits))
    else:
        met = join_rules(calls, rules)
    return (
        met
        .select(
            candidate_id(call["line"], call["start_column"]).alias("candidate_id"),
            "path",
            "lang",
            call["line"].alias("line"),
            call["start_column"].alias("column"),
            chars_as_text(call["name"]).alias("sink_name"),
            "snippet",
            "cwe",
            "rule_no",
            "function_line",
            "function_end_line",
        )
    )


def candidate_id(line: Column, column: Column) -> Column:
    """Key of a candidate: a path, a position and a rule name it."""
    return F.concat_ws(
        ":", F.col("path"), line.cast("string"), column.cast("string"),
        F.col("rule_no").cast("string"),
    )


def candidates_by_rule(candidates: DataFrame) -> DataFrame:
    """How many candidates each language, sink and weakness list has."""
    return candidates.groupBy(
        "lang", "sink_name", F.array_join("cwe", ",").alias("cwe")
    ).agg(F.count(F.lit(1)).alias("candidates"))


def weakness_counts(candidates: DataFrame) -> DataFrame:
    """How many candidates carry each weakness code."""
    return (
        candidates.select("lang", F.explode("cwe").alias("cwe"))
        .groupBy("lang", "cwe")
        .agg(F.count(F.lit(1)).alias("candidates"))
    )
