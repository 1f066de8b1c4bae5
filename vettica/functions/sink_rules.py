"""The rules that name dangerous calls, as data."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SinkRule(NamedTuple):
    """One rule.  ``form`` is the shape of the call (see ``call_sites``);
    ``name``, ``target`` and ``args`` are patterns searched in the called name,
    the receiver or scope, and the start of the argument list; empty patterns
    match everything."""

    lang: str
    rule_no: int
    form: str
    name: str
    target: str = ""
    args: str = ""
    cwe: tuple[str, ...] = ()

    def text_pattern(self) -> str:
        """A cheap pattern found in every text that can hold a hit; empty, so
        found in any text, where the name pattern is not a plain list."""
        wrapper = re.match(r"\(\^\|_\)\(([\w|\[\]?]+)\)", self.name)
        if wrapper and self.name == component(wrapper[1]):
            return f"(?i:{wrapper[1]})"
        exact = re.fullmatch(r"\^\(?([\w|]+)\)?\$", self.name)
        return f"(?:{exact[1]})" if exact else ""


# Function names per group, and the weakness codes of each group.
BUFFER = "strcpy|strcat|sprintf|vsprintf|gets|scanf|stpcpy|wcscpy|wcscat"
MEMORY = "memcpy|memmove|memset|alloca|strncpy|strncat|realloc|free"
FORMAT = "printf|fprintf|snprintf|syslog|vfprintf"
COMMAND = "system|popen|exec|execl|execlp|execle|execv|execvp|execve"
WINDOWS_COMMAND = "ShellExecute[AW]?|CreateProcess[AW]?"
ALLOCATION = "malloc|calloc"

BUFFER_CWE = ("CWE-120", "CWE-787", "CWE-125")
MEMORY_CWE = ("CWE-119", "CWE-416", "CWE-476")
FORMAT_CWE = ("CWE-134",)
COMMAND_CWE = ("CWE-78", "CWE-88")
ALLOCATION_CWE = ("CWE-190", "CWE-789")
DELETE_CWE = ("CWE-416", "CWE-476")


def component(words: str) -> str:
    """Fixed value: a word as a snake_case part or as a capitalised hump."""
    return (
        f"(^|_)({words})($|_)"
        f"|(^|[a-z0-9_])(?=[A-Z])(?i:{words})($|[A-Z]|[^a-zA-Z0-9])"
    )


ONE_NAME = r"^(?!(?:this|super)$)[\w$\x80-\xFF]+$"
ONE_SCOPE = r"^[^:]*$"
ANY_COMMAND = f"{COMMAND}|{WINDOWS_COMMAND}"

# The 27 rules.
SINK_RULES = (
    SinkRule("c", 1, "call", component(BUFFER), cwe=BUFFER_CWE),
    SinkRule("c", 2, "call", component(MEMORY), cwe=MEMORY_CWE),
    SinkRule("c", 3, "call", component(FORMAT), cwe=FORMAT_CWE),
    SinkRule("c", 4, "call", component(ANY_COMMAND), cwe=COMMAND_CWE),
    SinkRule("c", 5, "call", component(ALLOCATION), cwe=ALLOCATION_CWE),
    SinkRule("cpp", 1, "call", component(BUFFER), cwe=BUFFER_CWE),
    SinkRule("cpp", 2, "scoped", component(BUFFER), ONE_SCOPE, cwe=BUFFER_CWE),
    SinkRule("cpp", 3, "call", component(MEMORY), cwe=MEMORY_CWE),
    SinkRule("cpp", 4, "scoped", component(MEMORY), ONE_SCOPE, cwe=MEMORY_CWE),
    SinkRule("cpp", 5, "keyword", "^delete$", cwe=DELETE_CWE),
    SinkRule("cpp", 6, "call", component(FORMAT), cwe=FORMAT_CWE),
    SinkRule("cpp", 7, "scoped", component(FORMAT), ONE_SCOPE, cwe=FORMAT_CWE),
    SinkRule("cpp", 8, "call", component(ANY_COMMAND), cwe=COMMAND_CWE),
    SinkRule("cpp", 9, "scoped", component(COMMAND), ONE_SCOPE, cwe=COMMAND_CWE),
    SinkRule("cpp", 10, "call", component(ALLOCATION), cwe=ALLOCATION_CWE),
    SinkRule("java", 1, "member", "^exec$", r"^Runtime\.getRuntime\(\)$"),
    SinkRule("java", 2, "member", "^start$", r"^new ProcessBuilder\(\)$"),
    SinkRule("java", 3, "method", "^(execute|executeQuery|executeUpdate)$"),
    SinkRule("java", 4, "member", "^readObject$", ONE_NAME),
    SinkRule("java", 5, "new", "^XMLDecoder$", "^$"),
    SinkRule(
        "java",
        6,
        "member",
        "^getInstance$",
        "^MessageDigest$",
        r'(^|,)\s*"(MD5|SHA1|SHA-1)"\s*(,|$)',
    ),
    SinkRule("python", 1, "member", "^(system|popen)$", "^os$"),
    SinkRule(
        "python", 2, "member", "^(call|run|Popen|check_output|check_call)$", "^subprocess$"
    ),
    SinkRule("python", 3, "call", "^(eval|exec)$"),
    SinkRule("python", 4, "member", "^(loads|load)$", "^pickle$"),
    SinkRule("python", 5, "member", "^load$", "^yaml$"),
    SinkRule("python", 6, "member", "^execute$", r"^[\w\x80-\xFF]+$"),
)

RULES_SCHEMA = (
    "lang string, rule_no int, form string, name string, target string, args string,"
    " cwe array<string>"
)


def rules_table(spark: SparkSession, rules: tuple[SinkRule, ...] = SINK_RULES) -> DataFrame:
    """The rules as a table, one row per rule."""
    return spark.createDataFrame([(*rule[:6], list(rule.cwe)) for rule in rules], RULES_SCHEMA)


def join_rules(calls: DataFrame, table: DataFrame) -> DataFrame:
    """Calls (``lang`` and a struct ``call``) with ``rule_no`` and ``cwe`` of each rule
    of a table that they satisfy.

    Joined by language and form, with the patterns as the rest of the condition;
    nothing passes through the driver, and Spark broadcasts the table only below its
    own limit.  Null patterns match everything, as empty ones do.
    """
    shapes = F.when(F.col("form") == "method", F.array(F.lit("call"), F.lit("member"))).otherwise(F.array("form"))
    rules = table.select(
        "lang",
        F.explode(shapes).alias("_form"),
        *[F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("name", "target", "args")],
        "rule_no",
        F.coalesce("cwe", F.array().cast("array<string>")).alias("cwe"),
    )
    call = F.col("call")
    hits = [F.rlike(call[c], F.col(f"_{c}")) for c in ("name", "target", "args")]
    met = calls.withColumn("_form", call["form"]).join(rules, ["lang", "_form"])
    return met.filter(hits[0] & hits[1] & hits[2]).drop("_form", "_name", "_target", "_args")


def name_filter(rules: tuple[SinkRule, ...], lang: str) -> str:
    """One pattern that matches every name some rule of the language matches."""
    names = sorted({rule.name for rule in rules if rule.lang == lang})
    return "|".join(f"(?:{name})" for name in names)


def text_filter(rules: tuple[SinkRule, ...], lang: str) -> str:
    """One pattern found in every text some rule of the language can hit."""
    return "|".join(sorted({rule.text_pattern() for rule in rules if rule.lang == lang}))


def matching_rules(
    rules: tuple[SinkRule, ...],
    lang: Column,
    form: Column,
    name: Column,
    target: Column,
    args: Column,
) -> Column:
    """Array of (rule_no, cwe) of every rule that a call satisfies."""

    def test(rule: SinkRule) -> Column:
        shapes = ("call", "member") if rule.form == "method" else (rule.form,)
        hit = (lang == rule.lang) & form.isin(*shapes) & name.rlike(rule.name)
        if rule.target:
            hit = hit & target.rlike(rule.target)
        if rule.args:
            hit = hit & args.rlike(rule.args)
        return hit

    def tag(rule: SinkRule) -> Column:
        codes = F.array(*[F.lit(code) for code in rule.cwe]).cast("array<string>")
        return F.struct(F.lit(rule.rule_no).alias("rule_no"), codes.alias("cwe"))

    if not rules:
        return F.array().cast("array<struct<rule_no:int,cwe:array<string>>>")
    return F.array_compact(F.array(*[F.when(test(rule), tag(rule)) for rule in rules]))
