"""The secret patterns, as data."""

from __future__ import annotations

from typing import NamedTuple


class SecretRule(NamedTuple):
    """One rule.  ``literal`` or ``clue`` may name something plain that every
    text with a match holds, which is looked for before the pattern itself."""

    rule_id: str
    pattern: str
    literal: str = ""
    clue: str = ""


# a separator and an opening quote
ASSIGNED = r"""[:=](?U:\s*)['"]"""


# Rule names and patterns.  ``(?iU)`` makes Java fold case and
# read \s the Unicode way.
SECRET_RULES = (
    SecretRule("aws-access-key-id", r"AKIA[0-9A-Z]{16}", literal="AKIA"),
    SecretRule(
        "generic-api-key",
        r"""(?iU)api[_-]?key['"]?\s*[:=]\s*['"][A-Za-z0-9_\-]{16,}['"]""",
        clue=ASSIGNED,
    ),
    SecretRule(
        "private-key-header",
        r"-----BEGIN (RSA|EC|OPENSSH|DSA) PRIVATE KEY-----",
        literal=" PRIVATE KEY-----",
    ),
    SecretRule("slack-token", r"xox[baprs]-[0-9A-Za-z-]{10,}", literal="xox"),
    SecretRule(
        "generic-secret-assignment",
        r"""(?iU)(secret|password|token)['"]?\s*[:=]\s*['"][^'"]{8,}['"]""",
        clue=ASSIGNED,
    ),
)


def any_of(rules: tuple[SecretRule, ...] = SECRET_RULES) -> str:
    """One pattern that matches wherever any of the rules does."""
    return "|".join(f"(?:{rule.pattern})" for rule in rules)
