"""Text measures used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a longest match of this; white space is the ASCII white space of Java's and RE2's \s.
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"


def token_count(text: Column, pattern: str = TOKEN) -> Column:
    """Number of tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def trimmed_lower(x: Column) -> Column:
    return F.lower(F.trim(x))


def base_key(key: Column, marker: str = "__reward_pool__") -> Column:
    """The part before the marker, or the whole key."""
    return F.substring_index(key, marker, 1)
