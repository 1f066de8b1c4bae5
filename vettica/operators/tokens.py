"""Files as tables of tokens.

Tokens are cut and placed inside the row of their file, so a token table of any
corpus is one map stage.  The pieces together are the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettica.functions.text import bytes_as_chars, chars_as_text
from vettica.operators.code_scan import (
    BRACE_COMMENTS,
    CHARACTER,
    DOUBLE_QUOTED,
    LONG_QUOTED,
    NAME,
    SINGLE_QUOTED,
)
from vettica.operators.sinks import with_language

_REST = rf"[A-Za-z_$\x80-\xFF]{NAME}*|::|->|[^\S\n]+|\n|[\s\S]"
TOKENS = {
    "c": rf"{BRACE_COMMENTS}|{DOUBLE_QUOTED}|{CHARACTER}|{_REST}",
    "cpp": rf"{BRACE_COMMENTS}|{DOUBLE_QUOTED}|{CHARACTER}|{_REST}",
    "java": rf"{BRACE_COMMENTS}|{DOUBLE_QUOTED}|{CHARACTER}|{_REST}",
    "python": rf"#[^\n]*|{LONG_QUOTED}|{DOUBLE_QUOTED}|{SINGLE_QUOTED}|{_REST}",
}
BLOCK = 256

_PLACED = "array<struct<token:string,line:int,column:int>>"


def _place(tokens: Column, line: Column, column: Column) -> Column:
    """Fold tokens into (line, column after them, the placed tokens)."""
    start = F.struct(
        line.cast("int").alias("line"),
        column.cast("int").alias("column"),
        F.array().cast(_PLACED).alias("placed"),
    )

    def step(s: Column, token: Column) -> Column:
        breaks = F.length(token) - F.length(F.replace(token, F.lit("\n"), F.lit("")))
        return F.struct(
            (s["line"] + breaks).alias("line"),
            F.when(breaks == 0, s["column"] + F.length(token))
            .otherwise(F.length(F.substring_index(token, "\n", -1)))
            .alias("column"),
            F.concat(
                s["placed"],
                F.array(
                    F.struct(
                        token.alias("token"), s["line"].alias("line"), s["column"].alias("column")
                    )
                ),
            ).alias("placed"),
        )

    return F.aggregate(tokens, start, step)


def _placed(tokens: Column) -> Column:
    """Every token with its place.  Blocks keep the arrays that grow short, so
    the work stays linear in the size of the file."""
    starts = F.when(
        F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens), F.lit(BLOCK))
    ).otherwise(F.array().cast("array<int>"))
    start = F.struct(
        F.lit(1).alias("line"),
        F.lit(0).alias("column"),
        F.array().cast(f"array<{_PLACED}>").alias("blocks"),
    )

    def step(s: Column, at: Column) -> Column:
        block = _place(F.slice(tokens, at, F.lit(BLOCK)), s["line"], s["column"])
        return F.transform(
            F.array(block),
            lambda b: F.struct(
                b["line"].alias("line"),
                b["column"].alias("column"),
                F.concat(s["blocks"], F.array(b["placed"])).alias("blocks"),
            ),
        )[0]

    return F.aggregate(starts, start, step, lambda s: F.flatten(s["blocks"]))


def _kind(token: Column, lang: Column) -> Column:
    first = F.substring(token, 1, 1)
    comment = F.when(lang == "python", first == "#").otherwise(
        F.substring(token, 1, 2).isin("//", "/*")
    )
    return (
        F.when(comment, "comment")
        .when(first.isin('"', "'") & (F.length(token) > 1), "string")
        .when(token.rlike(r"^\s+$"), "space")
        .when(token.rlike(r"^[A-Za-z_$\x80-\xFF]"), "name")
        .otherwise("symbol")
    )


def code_tokens(corpus: DataFrame) -> DataFrame:
    """(path, lang, token_no, token, kind, line, column) of every token; lines
    and byte columns start at 1."""
    code = bytes_as_chars(F.col("text"))
    cut = None
    for lang, pattern in TOKENS.items():
        found = F.regexp_extract_all(code, F.lit(pattern), F.lit(0))
        is_lang = F.col("lang") == lang
        cut = F.when(is_lang, found) if cut is None else cut.when(is_lang, found)
    files = with_language(corpus.select("path", "text")).select("path", "lang", cut.alias("tokens"))
    return (
        files.select("path", "lang", F.posexplode(_placed(F.col("tokens"))).alias("at", "t"))
        .select(
            "path",
            "lang",
            (F.col("at") + 1).alias("token_no"),
            chars_as_text(F.col("t.token")).alias("token"),
            _kind(F.col("t.token"), F.col("lang")).alias("kind"),
            F.col("t.line").alias("line"),
            (F.col("t.column") + 1).alias("column"),
        )
    )
