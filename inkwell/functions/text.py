"""Typesetting of mixed Chinese and English text as Column expressions: scripts, spacing, escaping, small string helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as Chinese, the thin space, the soft hyphen, the escapes.
CHINESE = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBE0), (0x2F800, 0x2FA1F)]
THIN_SPACE = " "
SOFT_HYPHEN = "­"
ESCAPES = [("&", "&#38;"), ('"', "&#34;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;")]

#: The same ranges inside a regular expression's brackets, for Java and RE2 alike.
CHINESE_CLASS = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CHINESE)


def script_of(char: str) -> str:
    """N, E, C or U of one character."""
    c = ord(char)
    if 48 <= c <= 57:
        return "N"
    if 65 <= c <= 90 or 97 <= c <= 122:
        return "E"
    return "C" if any(a <= c <= b for a, b in CHINESE) else "U"


def script(char: Column) -> Column:
    """N (digit), E (ASCII letter), C (Chinese) or U of the first character; U of an empty string."""
    return F.when(char.rlike("^[0-9]"), "N").when(char.rlike("^[A-Za-z]"), "E").when(char.rlike(f"^[{CHINESE_CLASS}]"), "C").otherwise("U")


def first_script(text: Column) -> Column:
    return script(F.left(text, F.lit(1)))


def last_script(text: Column) -> Column:
    return script(F.right(text, F.lit(1)))


def space(text: Column) -> Column:
    """A thin space between Chinese and ASCII letters or digits; capture groups, as lookbehind fails beyond the BMP."""
    to_western = F.regexp_replace(text, f"([{CHINESE_CLASS}])([A-Za-z0-9])", f"$1{THIN_SPACE}$2")
    return F.regexp_replace(to_western, f"([A-Za-z0-9])([{CHINESE_CLASS}])", f"$1{THIN_SPACE}$2")


def escape_html(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters, and what stands between them, in order."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))


def trim_end(text: Column) -> Column:
    """Without Unicode white space at the end."""
    return F.regexp_replace(text, "[\\s\\p{Z}]+$", "")


def first_word(info: Column) -> Column:
    return F.split_part(info, F.lit(" "), F.lit(1))


def date_part(stamp: Column) -> Column:
    return F.substring(stamp, 1, 10)


def size_label(chars: Column) -> Column:
    """Characters in units of 1024, two decimals, ties to even."""
    return F.format_string("%.2f", F.bround(chars / F.lit(1024.0), 2))


def path_join(*parts: Column) -> Column:
    """The non-empty parts joined by a slash."""
    return F.concat_ws("/", *[F.when(p != "", p) for p in parts])
