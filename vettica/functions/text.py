"""Column expressions over text: lines, decoding, redaction, fixed decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line ends of Python's str.splitlines.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"

# Well-formed UTF-8 byte sequences (Unicode 15, table 3-7), each
# byte written as the Latin-1 character of the same value.
WELL_FORMED_UTF8 = (
    r"[\x00-\x7F]+"
    r"|[\xC2-\xDF][\x80-\xBF]"
    r"|\xE0[\xA0-\xBF][\x80-\xBF]"
    r"|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}"
    r"|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}"
    r"|[\xF1-\xF3][\x80-\xBF]{3}"
    r"|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)

# What Python's str.strip removes.  The look-behind keeps long
# blank stretches inside a text from being searched again at each character.
STRIP_EDGES = r"(?U)^[\s\x1C-\x1F]++|(?<![\s\x1C-\x1F])[\s\x1C-\x1F]++$"

DEFAULT_VISIBLE_PREFIX = 4


def lines_of(text: Column) -> Column:
    """Array of the lines of a text, without an empty last line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(
        parts
    )


def decode_utf8(content: Column) -> Column:
    """UTF-8 bytes as text; bytes that form no character are dropped."""
    direct = content.cast("string")
    kept = F.array_join(
        F.regexp_extract_all(
            F.decode(content, "ISO-8859-1"), F.lit(WELL_FORMED_UTF8), F.lit(0)
        ),
        "",
    )
    return F.when(F.is_valid_utf8(direct), direct).otherwise(
        F.encode(kept, "ISO-8859-1").cast("string")
    )


def bytes_as_chars(text: Column) -> Column:
    """The UTF-8 bytes of a text as one character each, so that lengths,
    substrings and columns count bytes."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(
        F.decode(text.cast("binary"), "ISO-8859-1")
    )


def chars_as_text(code: Column) -> Column:
    """Back from :func:`bytes_as_chars`; cut characters are dropped."""
    return F.when(F.octet_length(code) == F.length(code), code).otherwise(
        decode_utf8(F.encode(code, "ISO-8859-1"))
    )


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP_EDGES, "")


def redact(secret: Column, visible: int = DEFAULT_VISIBLE_PREFIX) -> Column:
    """First ``visible`` characters and how many more there are; a value that
    is not longer than that becomes stars only."""
    size = F.length(secret)
    return F.when(size <= visible, F.repeat(F.lit("*"), size)).otherwise(
        F.concat(
            F.substring(secret, 1, visible),
            F.lit("****("),
            (size - visible).cast("string"),
            F.lit(" more chars)"),
        )
    )


def fixed3(value: Column) -> Column:
    """A score in [0, 1] with three decimals, rounding its exact binary value
    half to even (``format_string`` rounds the shortest decimal instead).

    The value is taken apart into 26 and 38 binary places, which is exact, and
    multiplied by 1000 in whole numbers.
    """
    places = F.lit(float(2**26))
    high = F.floor(value * places)
    low = F.floor((value * places - high) * F.lit(float(2**38)))
    tail = low * 1000
    upper = high * 1000 + F.shiftright(tail, 38)
    rest = upper.bitwiseAND(F.lit(2**26 - 1).cast("bigint"))
    sticky = tail.bitwiseAND(F.lit(2**38 - 1)) > 0
    whole = F.shiftright(upper, 26)
    up = (rest > 2**25) | ((rest == 2**25) & (sticky | (F.pmod(whole, F.lit(2)) == 1)))
    thousandths = whole + F.when(up, 1).otherwise(0)
    return F.concat(
        F.floor(thousandths / 1000).cast("string"),
        F.lit("."),
        F.lpad(F.pmod(thousandths, F.lit(1000)).cast("string"), 3, "0"),
    )
