"""Text and path functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation: fixed value.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Named entities and their characters: fixed values.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: The tokeniser's pattern: contractions, runs of letters, single digits, runs of anything else.
TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def has_part(text: Column, part: Column) -> Column:
    """Case-insensitive substring."""
    return F.contains(F.lower(text), F.lower(part))


def unescaped(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def cleaned(text: Column) -> Column:
    """Entities resolved twice, then trimmed."""
    return F.trim(unescaped(unescaped(text)))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lowered(text: Column) -> Column:
    return F.lower(collapsed(text))


def canonical(text: Column, keep: str | None = None) -> Column:
    """Underscores to spaces, punctuation deleted (but for the exact string keep), lower case, white space collapsed."""
    bare = lambda t: F.translate(t, PUNCTUATION, "")
    text = F.replace(text, F.lit("_"), F.lit(" "))
    if keep:
        import re

        text = F.array_join(F.transform(F.split(text, re.escape(keep)), bare), keep)
    else:
        text = bare(text)
    return lowered(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(collapsed(cleaned(text))), F.lit(TOKEN), F.lit(0))


def context(ids: Column, start: int, end: int, length: int) -> Column:
    """Start and end ids around ids, zero-padded; too many are cut and the last is the end id."""
    whole = F.concat(F.array(F.lit(start)), ids, F.array(F.lit(end)))
    cut = F.concat(F.slice(whole, 1, length - 1), F.array(F.lit(end)))
    return F.when(F.size(whole) > length, cut).otherwise(F.slice(F.concat(whole, F.array_repeat(F.lit(0), length)), 1, length))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def frame_number(path: Column) -> Column:
    """The number in a frame's file name, for numeric order; null if none."""
    return F.regexp_extract(basename(path), r"(\d+)\.[^.]+$", 1).try_cast("bigint")
