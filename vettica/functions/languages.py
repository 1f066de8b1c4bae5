"""Which language a path belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vettica.functions.text import strip

# File extension -> language of its sink rules.
RULE_LANGUAGES = {
    ".py": "python",
    ".java": "java",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
}

# Languages a scorer can be asked about, and their spellings.
SCORED_LANGUAGES = ("c", "cpp", "java")
LANGUAGE_ALIASES = {"c++": "cpp", "cxx": "cpp", "cc": "cpp"}

# Names shown to people.
DISPLAY_NAMES = {"python": "Python", "java": "Java", "c": "C", "cpp": "C++"}

SUFFIX = r"^(?:.*/)?[^/]+?(\.[^./]+)$"


def _lookup(key: Column, mapping: dict[str, str]) -> Column:
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def suffix_of(path: Column) -> Column:
    """Last dot of the file name and what follows; empty where there is none."""
    return F.regexp_extract(path, SUFFIX, 1)


def rule_language(path: Column) -> Column:
    """Language whose sink rules apply; null where none do."""
    return _lookup(suffix_of(path), RULE_LANGUAGES)


def model_language(path: Column) -> Column:
    """Language to score under; empty where no scorer supports it."""
    scored = {ext: lang for ext, lang in RULE_LANGUAGES.items() if lang in SCORED_LANGUAGES}
    return F.coalesce(_lookup(suffix_of(path), scored), F.lit(""))


def normalize_language(name: Column) -> Column:
    cleaned = F.lower(strip(name))
    return F.coalesce(_lookup(cleaned, LANGUAGE_ALIASES), cleaned)


def display_language(path: Column) -> Column:
    bare = F.regexp_replace(suffix_of(path), r"^\.+", "")
    return F.coalesce(
        _lookup(rule_language(path), DISPLAY_NAMES),
        F.when(bare == "", F.lit("unknown")).otherwise(bare),
    )
