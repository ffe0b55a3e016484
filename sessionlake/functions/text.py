"""Text functions as Column expressions; Python only where byte boundaries or 64-bit wrap-around need it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Accented Greek letters and final sigma, and what they fold to.
GREEK_FROM = "άέήίόύώΐΰϊϋς"
GREEK_TO = "αεηιουωιυιυσ"
#: Words that a keyword query drops.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does",
    "did", "it", "in", "on", "of", "to", "for", "and", "or", "not", "what", "how", "when", "where",
    "why", "which", "who", "this", "that", "with",
]
#: Punctuation that separates query words, beside white space.
QUERY_SEPARATORS = "?,.!:;\"'()"
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fold(c: Column) -> Column:
    """Lower case with Greek accents and the final sigma removed."""
    return F.translate(F.lower(c), GREEK_FROM, GREEK_TO)


def fold_str(s: str) -> str:
    return s.lower().translate(str.maketrans(GREEK_FROM, GREEK_TO))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalize_text(c: Column) -> Column:
    """ASCII letters and digits in lower case, all else a single space."""
    return F.trim(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", " "))


#: The characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def nonblank_lines(c: Column) -> Column:
    """Lines without the white space around them; empty ones go."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), lambda x: F.btrim(x, F.lit(WHITE_SPACE))), lambda x: x != ""), "\n")


def truncate_chars(c: Column, n: int, mark: str = "...[truncated]") -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def text_lines(c: Column) -> Column:
    """Lines without their ends; what follows the last line end is a line only if it is not empty."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n"))


def head_tail_lines(c: Column, head: int, tail: int) -> Column:
    """First and last lines with the number of lines left out; short texts stay whole."""
    lines = text_lines(c)
    n = F.size(lines)
    cut = F.array_join(
        F.concat(
            F.slice(lines, 1, head),
            F.array(F.concat(F.lit("... ("), (n - head - tail).cast("string"), F.lit(" lines omitted) ..."))),
            F.slice(lines, n - tail + 1, F.lit(tail)),
        ),
        "\n",
    )
    return F.when(n <= head + tail, c).otherwise(cut)


def head_tail_chars(c: Column, head: int = 1200, tail: int = 1800, mark: str = "\n[...snip...]\n") -> Column:
    return F.when(F.char_length(c) <= head + tail, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(mark), F.right(c, F.lit(tail))))


def html_to_text(c: Column) -> Column:
    """Breaks and closing blocks become lines, tags go, six entities are decoded, blank lines go."""
    broken = F.regexp_replace(c, r"<br\s*/?>|</p>|</div>", "\n")
    bare = F.replace(F.regexp_replace(broken, r"<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return nonblank_lines(bare)


def sanitize_guid(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")


def last_path_part(c: Column) -> Column:
    """The last non-empty part of a path with either slash."""
    return F.element_at(F.filter(F.split(c, r"[/\\]+"), lambda x: x != ""), -1)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def json_escaped(needle: str) -> str:
    """The needle as it stands inside a JSON string."""
    return json.dumps(needle, ensure_ascii=False)[1:-1]


def rounded(x: Column, digits: int = 6) -> Column:
    """A double to so many decimals; what rounds to zero keeps its sign, which Spark's round drops."""
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)


def one_decimal(c: Column, unit: int) -> Column:
    """c / unit with one decimal, c not negative. Halves go by the double's own value and, if that is one, to even: Java goes by its shortest decimal."""
    rest = c % (unit // 10)
    tenths = ((c - rest) / (unit // 10)).cast("long")
    quotient = c / unit
    part = quotient - F.floor(quotient)
    half = 2 * (tenths % 10) + 1  # twentieths; each difference below is exact
    side = (part * 16 - half) + part * 4
    up = (rest > unit // 20) | ((rest == unit // 20) & ((side > 0) | ((side == 0) & (tenths % 2 == 1))))
    n = tenths + F.when(up, 1).otherwise(0)
    return F.concat(((n - n % 10) / 10).cast("long").cast("string"), F.lit("."), (n % 10).cast("string"))


def human_size(c: Column, largest: str = "GB") -> Column:
    """Decimal size: bytes, whole kilobytes, then one decimal of megabytes and gigabytes; `largest` is the last unit, GB or MB."""
    in_mb = F.lit(True) if largest == "MB" else c < 1_000_000_000
    return (
        F.when(c < 1000, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1_000_000, F.concat(F.round(c / 1000).cast("long").cast("string"), F.lit(" KB")))
        .when(in_mb, F.concat(one_decimal(c, 1_000_000), F.lit(" MB")))
        .when(c.isNotNull(), F.concat(one_decimal(c, 1_000_000_000), F.lit(" GB")))
    )


def estimated_tokens(c: Column) -> Column:
    """A quarter of the UTF-8 bytes."""
    return F.floor(F.octet_length(c) / 4)


def fill_percent(n_bytes: Column, capacity: int = 600_000) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), n_bytes / capacity * 100.0))


def fnv1a(s: str) -> int:
    h = FNV_OFFSET
    for b in s.encode():
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(StringType())
def fnv1a_hex(s: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes in 16 hexadecimal digits."""
    return s.map(lambda x: None if x is None else f"{fnv1a(x):016x}")


def cap_bytes(c: Column, limit: int) -> Column:
    """At most `limit` bytes, cut before a character that would cross the limit."""

    @F.pandas_udf(StringType())
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.encode()[:limit].decode(errors="ignore"))

    return cut(c)


def natural_key(c: Column, width: int = 20) -> Column:
    """A sort key without regard to case and accents (a collation), in which runs of digits order as numbers do."""
    runs = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), 0)
    padded = F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.ltrim(x, F.lit("0")), width, "0")).otherwise(x))
    return F.collate(F.array_join(padded, ""), "UNICODE_CI_AI")
