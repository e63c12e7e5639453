"""Text clean-up used by the field rules (C1-C16, C21-C24), all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four separator controls U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"

# Parts that carry no content.
NOISE = [".", "&nbsp;", " "]
NOISE_NL = [".", "Details", "See details"]


def strip(x: Column) -> Column:
    """Trim Unicode white space, no-break space included."""
    return F.regexp_replace(x, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def collapse(x: Column) -> Column:
    """Every run of white space becomes one blank; ends are trimmed."""
    return F.btrim(F.regexp_replace(x, rf"(?U){SPACE}+", " "))


def drop_trailing_dot(x: Column) -> Column:
    """C3"""
    return F.when(x.endswith("."), F.left(x, F.length(x) - 1)).otherwise(x)


def drop_trailing_dots(x: Column) -> Column:
    """C4"""
    return F.rtrim(x, F.lit("."))


def close_dots(x: Column) -> Column:
    """No blank before a dot."""
    return F.replace(x, F.lit(" ."), F.lit("."))


def before_marker(x: Column, marker: str) -> Column:
    """Text before the first marker; whole text when absent."""
    return strip(F.substring_index(x, marker, 1))


def after_last_marker(x: Column, marker: str) -> Column:
    """Text after the last marker; whole text when absent."""
    return strip(F.substring_index(x, marker, -1))


def after_colon(x: Column) -> Column:
    """Text after the first colon-blank; whole text when there is none."""
    at = F.instr(x, ": ")
    return F.when(at > 0, F.substr(x, at + 2)).otherwise(x)


def remove_prefixed(x: Column, prefix: str) -> Column:
    """Null unless the text starts with ``prefix``; then all its copies go."""
    return F.when(x.startswith(prefix), F.replace(x, F.lit(prefix), F.lit("")))


def first_sentence(x: Column) -> Column:
    """Text up to the first dot, with a dot always put back."""
    return F.concat(F.substring_index(x, ".", 1), F.lit("."))


def first_percent(x: Column) -> Column:
    """C11: 'n%' for the first digits followed by a percent sign, else null."""
    digits = F.regexp_extract(x, r"(?U)(\d+)%", 1)
    return F.when(digits != "", F.concat(digits, F.lit("%")))


def join_pair(a: Column, b: Column) -> Column:
    """C12"""
    return F.concat_ws(" ", a, b)


def join_parts(parts: Column) -> Column:
    """Blank-joined parts, trimmed; '' for an empty list."""
    return strip(F.array_join(parts, " "))


def is_noise(x: Column, tokens: list[str] = NOISE) -> Column:
    """C14"""
    return x.isin(tokens)


def drop_noise(parts: Column, tokens: list[str] = NOISE) -> Column:
    """C14 over a list; empty parts go as well."""
    return F.filter(parts, lambda p: (p != "") & ~is_noise(p, tokens))


def contains_any(x: Column, phrases: list[str]) -> Column:
    """C15"""
    test = F.lit(False)
    for phrase in phrases:
        test = test | F.contains(x, F.lit(phrase))
    return test


def icontains(x: Column, phrase: str) -> Column:
    """C16"""
    return F.contains(F.lower(x), F.lit(phrase.lower()))


def slug(x: Column) -> Column:
    """C21"""
    return F.replace(x, F.lit(" "), F.lit("_"))


def folder_name(x: Column) -> Column:
    """A slug that tells all terms apart, as a folder is replaced whole."""
    return slug(F.replace(F.replace(x, F.lit("%"), F.lit("%25")), F.lit("_"), F.lit("%5F")))


def iso_time(ts: Column) -> Column:
    """ISO timestamp text; fractional seconds only when there are any."""
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.date_format(ts, "SSSSSS") == "000000", F.lit(""))
        .otherwise(F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))))


def compact_time(ts: Column) -> Column:
    """The stamp used in quarantine names."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def first_filled(*candidates: Column) -> Column:
    """First candidate that is neither null nor blank."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])
