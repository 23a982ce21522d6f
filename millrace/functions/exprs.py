"""Scalar building blocks: numbers, reasons, lookups, coercions.  All return columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.ordered import is_finite


def finite(x: Column) -> Column:
    """The value, or null for null, NaN and the infinities."""
    return F.when(is_finite(x), x)


def finite_or(x: Column, default: float | None) -> Column:
    return F.coalesce(finite(x), F.lit(default).cast("double"))


def parsed_number(x: Column, default: float | None = None) -> Column:
    """Text, number or flag to a finite double; anything else gives the default."""
    return finite_or(x.try_cast("double"), default)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` within low .. high; null and NaN stay null."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def or_else(*values: Column) -> Column:
    """The first value that is neither null nor zero; the last one otherwise."""
    return F.coalesce(*[F.nullif(v, F.lit(0)) for v in values[:-1]], values[-1])


def even_round(x: Column, digits: int = 0) -> Column:
    """Half to even."""
    return F.bround(x, digits)


def sigmoid(x: Column) -> Column:
    """Stable on both sides of zero."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def bell(x: Column, centre: float, width: float) -> Column:
    """1 at the centre, falling as a Gaussian."""
    return F.exp(-F.pow(x - centre, 2) / (2.0 * width * width))


def trapezoid(x: Column, low: Column | float, high: Column | float) -> Column:
    """1 within low .. high, falling to 0 in proportion to the distance below and above."""
    low, high = (c if isinstance(c, Column) else F.lit(c) for c in (low, high))
    under = F.try_divide(x, low)
    over = 1.0 - F.try_divide(x - high, F.greatest(1.0 - high, F.lit(1e-6)))
    return clamp(F.when(x < low, under).when(x > high, over).when(x.isNotNull(), F.lit(1.0)))


def scale_judge(score: Column) -> Column:
    """Judge scores given out of 100, 10, 5 or 1, brought to 0 .. 1."""
    return clamp(F.when(score > 10, score / 100.0).when(score > 5, score / 10.0).when(score > 1, (score - 1.0) / 4.0).otherwise(score))


def gmean(values: Sequence[Column], low: float = 1e-6, empty: float = 0.0) -> Column:
    """Geometric mean of the finite values, each held to low .. 1; ``empty`` if there is none."""
    logs = F.array_compact(F.array(*[F.ln(clamp(finite(v), low, 1.0)) for v in values]))
    return F.when(F.size(logs) == 0, F.lit(empty)).otherwise(F.exp(F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / F.size(logs)))


def weighted_mean(pairs: Sequence[tuple[Column, float]], default: float | None = None) -> Column:
    """Mean of the finite values by positive weight; missing ones give their weight to the rest."""
    used = [(v, w) for v, w in pairs if w > 0]
    total = sum((F.when(is_finite(v), F.lit(float(w))).otherwise(0.0) for v, w in used), F.lit(0.0))
    value = sum((F.when(is_finite(v), v * float(w)).otherwise(0.0) for v, w in used), F.lit(0.0))
    return F.coalesce(F.try_divide(value, total), F.lit(default).cast("double"))


def blend(a: Column, wa: float, b: Column, wb: float) -> Column:
    """Weighted geometric mean of two values."""
    low = F.lit(1e-6)
    return F.exp((wa * F.ln(F.greatest(a, low)) + wb * F.ln(F.greatest(b, low))) / (wa + wb))


def row_spread(values: Sequence[Column]) -> Column:
    """Population deviation of the finite values of a row; 0 for one or none."""
    own = F.array_compact(F.array(*[finite(v) for v in values]))
    mean = total(own) / F.size(own)
    return F.when(F.size(own) <= 1, F.lit(0.0)).otherwise(F.sqrt(F.get(F.transform(F.array(mean), lambda m: total(F.transform(own, lambda x: (x - m) * (x - m)))), F.lit(0)) / F.size(own)))


# lookups in containers


def named_finite(containers: Sequence[Column], names: Sequence[str], default: float | None = None) -> Column:
    """The first finite value, name by name over all containers; passes over non-finite ones."""
    return F.coalesce(*[finite(c[n]) for n in names for c in containers], F.lit(default).cast("double"))


def named_present(container: Column, names: Sequence[str], default: float | None = None) -> Column:
    """The value of the first name present; the default if that value isn't finite."""
    out = F.lit(default).cast("double")
    for n in reversed(names):
        out = F.when(F.map_contains_key(container, F.lit(n)), finite_or(container[n], default)).otherwise(out)
    return out


def filled(text: Column) -> Column:
    """The trimmed text, or null if blank."""
    return F.nullif(F.trim(text), F.lit(""))


def looked_up(key: Column, table: Mapping[str, str], otherwise: Column) -> Column:
    """The table's entry for the key; a table of people's making, held as a literal."""
    if not table:
        return otherwise
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key], otherwise)


# reasons


def reasons(tests: Sequence[tuple[str, Column]]) -> Column:
    """Names of the tests that hold, in their order; a null test doesn't hold."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def first_reason(tests: Sequence[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """Name of the first test that holds."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in tests], F.lit(otherwise).cast("string"))


def sorted_reasons(earlier: Column, tests: Sequence[tuple[str, Column]]) -> Column:
    """Earlier reasons and those that hold now, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(earlier, F.array().cast("array<string>")), reasons(tests))))


def gate_passes(value: Column, least: float, applies: Column | None = None) -> Column:
    """True if the gate doesn't apply, wasn't run (null or -1) or reaches its threshold."""
    ran = F.when(value.isNull() | F.isnan(value) | (value == -1.0), F.lit(True)).otherwise(value >= least)
    return ran if applies is None else F.when(~applies, F.lit(True)).otherwise(ran)


def role_matches(role: Column, patterns: Sequence[str]) -> Column:
    """A pattern matches itself, roles that go on with a colon, and with a final * any continuation."""
    tests = [role.startswith(p[:-1]) if p.endswith("*") else (role == p) | role.startswith(p + ":") for p in patterns]
    return F.coalesce(F.greatest(*tests) if len(tests) > 1 else tests[0], F.lit(False)) if tests else F.lit(False)


def allowed(value: Column, allow: Sequence[str], deny: Sequence[str]) -> Column:
    """In the allow list (an empty one allows all) and not in the deny list."""
    ok = value.isin(list(allow)) if allow else F.lit(True)
    return ok & ~value.isin(list(deny)) if deny else ok


# coercions

YES = ("1", "true", "yes", "y", "on")


def as_flag(text: Column) -> Column:
    return F.when(text.isNotNull(), F.lower(F.trim(text)).isin(list(YES)))


def text_list(text: Column, separator: str = ",") -> Column:
    """Trimmed non-blank parts."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def number_map(text: Column, pair: str = ",", mark: str = ":", above: float = 0.0) -> Column:
    """``a:1,b:2`` to a map; entries that aren't finite numbers above the bound are left out."""
    entries = F.transform(text_list(text, pair), lambda e: F.split(e, mark, 2))
    typed = F.transform(entries, lambda e: F.struct(F.trim(F.get(e, F.lit(0))).alias("key"), finite(F.get(e, F.lit(1)).try_cast("double")).alias("value")))
    return F.map_from_entries(F.filter(typed, lambda e: e["value"] > above))


# vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def bits_differing(a: Column, b: Column) -> Column:
    """Hamming distance of two bit strings; null if their lengths differ."""
    count = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), count)


def hex_bits_differing(a: Column, b: Column) -> Column:
    """Hamming distance of two hex strings; null for unequal lengths or other characters."""
    digits = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.bit_count(F.conv(x, 16, 10).cast("int").bitwiseXOR(F.conv(y, 16, 10).cast("int"))))
    valid = a.rlike("^[0-9a-fA-F]+$") & b.rlike("^[0-9a-fA-F]+$") & (F.length(a) == F.length(b))
    return F.when(valid, F.aggregate(digits, F.lit(0), lambda s, x: s + x))
