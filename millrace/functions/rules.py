"""Ordered text rules: the first that holds gives the value.

A rule table is data: patterns and values in the order in which they are
tried.  The functions below turn it into one expression, so that a rule set
of any length is a single ``case`` in generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words and phrases of the instruction rules
COLOR_WORDS = ("black", "blue", "brown", "gray", "green", "grey", "orange", "pink", "purple", "red", "white", "yellow")
FILL_WORDS = ("change", "make", "the", "a", "an", "to", "into", "with", "one")
OBJECT_HINTS = tuple(
    """airplane animal apple bag basket bat bear bed bench bird bottle bowl box building bus cabinet cake car cat chair clock cup dog door flower food frisbee fungus hat horse knife
    lamp laptop mug mushroom phone pizza plant plate sauce refrigerator shelf shirt sign sink sunflower table toilet train truck tv umbrella vase window""".split()
)
GLOBAL_FAMILIES = ("exposure", "contrast", "color", "tone")
TYPE_TERMS = (
    ("object_replacement", ("replace ", "change the object", "turn the", "make the person into")),
    ("object_removal", ("remove ", "delete ", "erase ")),
    ("object_addition", ("add ", "insert ", "place a new")),
    ("spatial_move", ("move ", "relocate ", "to the left", "to the right", "higher", "lower")),
    ("color_change", ("color", "colour", "red", "blue", "green", "yellow", "black", "white")),
    ("material_change", ("metal", "wood", "glass", "plastic", "denim", "leather")),
)
FAMILY_TYPES = (("style", "style_transfer"), ("background", "background_change"))
FAILED_REMOVAL = (
    r"\bstill\s+(?:clearly\s+)?(?:visible|present|there)\b",
    r"\bremains?\s+(?:clearly\s+)?(?:visible|present|there)?\b",
    r"\bremaining\s+(?:object|part|remnant|piece|portion)\b",
    r"\bnot\s+(?:removed|absent|erased|deleted|fully removed|completely removed)\b",
    r"\bfailed\s+to\s+(?:remove|erase|delete)\b",
    r"\bcontinues?\s+to\s+(?:be\s+)?(?:visible|appear)\b",
)
GENERIC_MARKERS = ("no other", "not other", "any other", "any object that changes", "changes the overall", "overall layout", "other objects", "other background", "unrelated objects", "extra objects", "additional objects")
NEGATIONS = ("no ", "not ", "without ", "absent", "missing")
NEGATABLE_TYPES = ("object_addition", "attribute_change", "color_change", "material_change", "style_transfer", "background_change")
#: How an instruction names what is put in place, in the order tried.
TARGETS = (
    r"\breplace\b.+?\bwith\b\s+(.+)$",
    r"\b(?:turn|change|convert|transform)\b.+?\binto\b\s+(.+)$",
    r"\bchange\b.+?\bto\s+(.+)$",
    r"\b(?:add|insert|place|put)\b\s+(.+?)(?:\s+\bin\b|\s+\bon\b|\s+\bat\b|$)",
    r"^(.+?)\s+\binstead of\b",
)
#: Signs in an instruction with its white space collapsed and a space at either end.
SIGNS = {
    "removes": r" (remove|delete|erase|get rid of) ",
    "adds": r" (add|insert|place|put) ",
    "replaces": r" replace | instead of ",
    "instead": r" instead of ",
    "turns_into": r"\b(turn|change|convert|transform)\b.+\binto\b|\bchange\b.+\bto (?:a|an|the)\b",
    "removes_then_adds": r" (remove|delete|erase|get rid of) .*\b(remove|delete|erase|get rid of)?\b.*\b(add|insert|place|put)\b",
    "replaces_with": r"\breplace\b.+\bwith\b",
    "on_background": r"background",
    "on_scenery": r" (background|sky|cloud|clouds) ",
}


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.array_contains(F.array(*[F.contains(lowered, F.lit(t)) for t in terms]), True)


def target_text(flat: Column) -> Column:
    """What a collapsed instruction puts in place; all of it if no pattern matches."""
    return F.coalesce(*[F.when(flat.rlike(p), F.regexp_extract(flat, p, 1)) for p in TARGETS], flat)


def names_object(flat: Column) -> Column:
    """Whether that names an object: a known noun, or two words besides colours; not a colour alone."""
    tokens = F.array_distinct(F.regexp_extract_all(target_text(flat), F.lit("[a-z]+"), F.lit(0)))
    words = lambda *lists: F.array(*[F.lit(w) for one in lists for w in one])
    only_fill = F.size(F.array_except(tokens, words(COLOR_WORDS, FILL_WORDS))) == 0
    known = F.arrays_overlap(tokens, words(OBJECT_HINTS)) | (F.size(F.array_except(tokens, words(COLOR_WORDS))) >= 2)
    return (F.size(tokens) > 0) & ~F.arrays_overlap(tokens, words(("color", "colour"))) & ~only_fill & known


#: (condition over SIGNS and "named", class, reason), in order; lenient and strict rule sets.
LENIENT = (
    ("replaces or turns_into or removes_then_adds or replaces_with", "object_replacement", "classified_replacement"),
    ("removes", "object_removal", "classified_removal"),
    ("adds", "object_addition", "classified_addition"),
    ("true", None, "not_object_instruction"),
)
STRICT = (
    ("removes and adds", None, "multi_operation_remove_add"),
    ("(replaces or turns_into or replaces_with) and not (replaces_with or turns_into or instead or removes_then_adds)", None, "ambiguous_replacement_marker"),
    ("(replaces or turns_into or replaces_with) and on_background", None, "background_replacement"),
    ("(replaces or turns_into or replaces_with) and not named", None, "replacement_without_object_hint"),
    ("replaces or turns_into or replaces_with", "object_replacement", "classified_replacement"),
    ("removes and on_scenery", None, "nonobject_removal"),
    *LENIENT[1:],
)


def classified(signs: Column, rules: Sequence[tuple[str, str | None, str]]) -> Column:
    """class and reason by the first rule that holds; ``signs`` is a struct of booleans."""

    def holds(condition: str) -> Column:
        words = condition.replace("(", " ( ").replace(")", " ) ").split()
        return F.expr(" ".join(w if w in ("and", "or", "not", "true", "(", ")") else f"__signs.{w}" for w in words))

    out = None
    for condition, name, reason in rules:
        value = F.struct(F.lit(name).cast("string").alias("class"), F.lit(reason).alias("reason"))
        out = F.when(holds(condition), value) if out is None else out.when(holds(condition), value)
    return out


def edit_type_of(instruction: Column, family: Column) -> Column:
    """The edit type that an instruction's wording and family point to."""
    kind = F.lower(F.coalesce(family, F.lit("")))
    out = F.when(kind.isin(*GLOBAL_FAMILIES), "global_adjustment")
    for name, terms in TYPE_TERMS:
        out = out.when(contains_any(instruction, terms), name)
    for own, name in FAMILY_TYPES:
        out = out.when(kind == own, name)
    return out.otherwise("local_enhancement")


def item_key(text: Column, most: int = 160) -> Column:
    """A text as a file name: other characters to underscores, dots and underscores at the ends off, ``item`` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", F.lit("item")).otherwise(F.substring(clean, 1, most))


def chosen_label(text: Column, labels: Sequence[str]) -> Column:
    """The ``choice`` of a JSON answer, fenced or within other text, if it is a label; else the only label that the text mentions."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?i:json)?", ""), r"```$", ""))
    span = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    parsed = F.coalesce(F.try_parse_json(clean), F.try_parse_json(F.nullif(span, F.lit(""))))
    choice = F.trim(F.try_variant_get(parsed, "$.choice", "string"))
    lowered = F.lower(clean)
    hits = F.filter(F.array(*[F.when(lowered.rlike(rf"\b{label}\b"), F.lit(label)) for label in labels]), lambda x: x.isNotNull())
    return F.when(choice.isin(*labels), choice).when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def listed_rounds(text: Column) -> Column:
    """``1-3, 7`` as sorted distinct numbers."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    ends = lambda x: (F.split_part(x, F.lit("-"), F.lit(1)).cast("int"), F.split_part(x, F.lit("-"), F.lit(2)).try_cast("int"))

    def numbers(x: Column) -> Column:
        first, last = ends(x)
        return F.when(~x.contains("-"), F.array(first)).when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def fraction_of(text: Column, name: str) -> Column:
    """The fraction of one name in ``a=0.5, b = 0.2``; 0 for one that isn't there."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: F.trim(F.split_part(x, F.lit("="), F.lit(1))) == name)
    return F.coalesce(F.trim(F.split_part(F.element_at(F.nullif(parts, F.array().cast("array<string>")), -1), F.lit("="), F.lit(2))).cast("double"), F.lit(0.0))


def canonical(fields: Sequence[tuple[str, Column]]) -> Column:
    """JSON of the fields that aren't null, names sorted, a space after colon and comma."""
    plain = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    entries = F.array(*[F.concat(F.lit(f'"{name}": "'), plain(value), F.lit('"')) for name, value in sorted(fields, key=lambda f: f[0])])
    return F.concat(F.lit("{"), F.array_join(F.array_compact(entries), ", "), F.lit("}"))
