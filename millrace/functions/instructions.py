"""Text rules for edit instructions: cleaning, classes, slots, tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for no value.
NULL_WORDS = ("none", "null", "n/a", "nan", "unknown", "-")
#: A first sign of each class, in the order in which classes are tried.
CLASS_SIGNS = (
    ("removal", r"\b(remove|erase|delete|take away)\b"),
    ("replacement", r"\b(replace|swap|exchange)\b"),
    ("addition", r"\b(add|insert|place|put)\b"),
    ("color", r"\b(recolou?r|paint|colou?r|make .* (red|blue|green|amber|coral|charcoal))\b"),
    ("material", r"\b(turn .* into|made of|material)\b"),
    ("move", r"\b(move|shift|relocate)\b"),
    ("style", r"\b(redraw|style|as (linocut|sketch|watercolou?r))\b"),
)
STOP_WORDS = ("a", "an", "the", "of", "in", "on", "at", "to", "with", "and", "or", "is", "it")


def clean(text: Column, most: int = 220) -> Column:
    """White space collapsed, cut to ``most`` characters; null for blank text and words for nothing."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    return F.when((flat != "") & ~F.lower(flat).isin(list(NULL_WORDS)), F.substring(flat, 1, most))


def instruction_class(text: Column, otherwise: str = "other") -> Column:
    lowered = F.lower(text)
    return F.coalesce(*[F.when(lowered.rlike(sign), F.lit(name)) for name, sign in CLASS_SIGNS], F.lit(otherwise))


def replacement_target(text: Column) -> Column:
    """What is to be put in place, by the first pattern that matches."""
    patterns = (r"(?i)\bwith (?:an? |the )?([\w -]+)", r"(?i)\binto (?:an? |the )?([\w -]+)", r"(?i)\bas (?:an? |the )?([\w -]+)")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def content_terms(text: Column) -> Column:
    """Words without stop words, a plural s taken off words longer than three letters."""
    kept = F.filter(words(text), lambda w: ~w.isin(list(STOP_WORDS)))
    return F.transform(kept, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w))


def without_article(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"(?i)^(a|an|the)\s+", "")


def without_tail(text: Column) -> Column:
    """Place phrases and closing marks at the end taken off, one after another."""
    out = F.trim(text)
    for tail in (r"[.!?]+$", r"(?i)\s+(please|completely|entirely)$", r"(?i)\s+from the (image|scene|picture)$", r"(?i)\s+(next to|under|behind|in|on|at|by) the [\w ]+$"):
        out = F.regexp_replace(out, tail, "")
    return F.trim(out)


def with_article(noun: Column) -> Column:
    return F.concat(F.when(F.lower(F.substring(noun, 1, 1)).isin("a", "e", "i", "o", "u"), "an ").otherwise("a "), noun)


def safe_key(text: Column, most: int = 160) -> Column:
    """Other characters to underscores, dots and underscores at the ends taken off, cut to ``most``."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", ""), 1, most)


def any_of(text: Column, marks: Sequence[str]) -> Column:
    """Whether any mark occurs anywhere, inside words too."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.greatest(*[lowered.contains(m) for m in marks]) if len(marks) > 1 else lowered.contains(marks[0])


def shares_term(a: Column, b: Column) -> Column:
    return F.arrays_overlap(content_terms(a), content_terms(b))


def object_text(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is no such span."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), F.substring(text, first, last - first + 1))


def unfenced(text: Column) -> Column:
    """The text without a code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*|\s*```$", ""))


def only_label(text: Column, labels: Sequence[str]) -> Column:
    """The one label that occurs as a word; null for none or several."""
    hits = F.array_compact(F.array(*[F.when(F.lower(text).rlike(rf"\b{w}\b"), F.lit(w)) for w in labels]))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))
