"""JVM-side string expressions (no Python UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from storylens.constants import (
    ASCII_PUNCTUATION,
    NEWLINE_MARKERS,
    PROMPT_DELIMITER,
    TAG_PATTERN,
    WORD_LIMIT,
)

WS = r"\s+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def whitespace_words(col) -> Column:
    """Whitespace split with empty pieces removed (Python's ``str.split()``)."""
    return F.array_remove(F.split(_c(col), WS), F.lit(""))


def strip_ws(col) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace (not only spaces)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def strip_tags(col) -> Column:
    """Remove ``[ WP ]``/``( EU )``-style tags (brackets need not match), then strip."""
    return strip_ws(F.regexp_replace(_c(col), TAG_PATTERN, ""))


def combine_prompt_story(prompt, story) -> Column:
    """``prompt <endprompt> story``."""
    return F.concat(_c(prompt), F.lit(PROMPT_DELIMITER), _c(story))


def truncate_words(col, limit: int = WORD_LIMIT) -> Column:
    """More than `limit` whitespace words -> first `limit` joined by one space;
    otherwise the text is returned unchanged (original whitespace kept)."""
    words = whitespace_words(col)
    return F.when(F.size(words) > limit, F.array_join(F.slice(words, 1, limit), " ")).otherwise(_c(col))


def normalise_newlines(col) -> Column:
    """Both newline markers become a line break."""
    out = _c(col)
    for marker in NEWLINE_MARKERS:
        out = F.replace(out, F.lit(marker), F.lit("\n"))
    return out


def strip_ascii_punctuation(col) -> Column:
    """Remove the 32 ASCII punctuation marks (E06); ``translate`` makes a string of every character."""
    return F.regexp_replace(_c(col), f"[{re.escape(ASCII_PUNCTUATION)}]+", "")


def story_id(p_ind, s_ind) -> Column:
    """Composite id ``p-s``."""
    return F.concat_ws("-", _c(p_ind).cast("string"), _c(s_ind).cast("string"))


def mean_std_cell(mean, std) -> Column:
    """``mean (std)`` with two decimals; null when either is missing."""
    return F.when(_c(mean).isNotNull() & _c(std).isNotNull(), F.format_string("%.2f (%.2f)", _c(mean), _c(std)))
