"""Measures of images and latents held as arrays: rows of pixels, masks and vectors.

All are expressions over arrays, so they stay in the JVM; a picture is a flat
array in row order.  Null arrays give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.exprs import clamp, cosine, dot, sigmoid, total


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it in its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def mean(a: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(total(a), F.size(a))


def spread(a: Column) -> Column:
    """Population deviation in two passes."""
    return let(a, lambda x: let(mean(x), lambda m: F.sqrt(mean(F.transform(x, lambda y: (y.cast("double") - m) * (y.cast("double") - m))))))


def share(mask: Column) -> Column:
    """Share of true entries."""
    return mean(F.transform(mask, lambda x: x.cast("double")))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))


def mean_error(a: Column, b: Column) -> Column:
    return mean(difference(a, b))


def change_mask(a: Column, b: Column, above: float) -> Column:
    return F.transform(difference(a, b), lambda x: x > above)


def changed_share(a: Column, b: Column, above: float) -> Column:
    return share(change_mask(a, b, above))


def box_mask(size: int, width: int, left: int, top: int, right: int, bottom: int) -> Column:
    """True inside the box; right and bottom are outside it."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.pmod(i, F.lit(width)) >= left) & (F.pmod(i, F.lit(width)) < right) & (F.floor(i / width) >= top) & (F.floor(i / width) < bottom))


def dilated(mask: Column, width: int, reach: int = 1) -> Column:
    """True where a true entry lies within ``reach`` in both directions."""
    steps = [(dx, dy) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)]

    def near(m: Column, i: Column) -> Column:
        out = F.lit(False)
        for dx, dy in steps:
            x, j = F.pmod(i, F.lit(width)) + dx, i + dx + dy * width
            out = out | ((x >= 0) & (x < width) & (j >= 0) & F.coalesce(F.get(m, j), F.lit(False)))
        return out

    return let(mask, lambda m: F.transform(m, lambda _, i: near(m, i)))


def box_share(mask: Column, width: int) -> Column:
    """Area of the smallest box around the true entries, as a share of all; 0 for none."""

    def area(at: Column) -> Column:
        xs, ys = F.transform(at, lambda i: F.pmod(i, F.lit(width))), F.transform(at, lambda i: F.floor(i / width))
        return (F.array_max(xs) - F.array_min(xs) + 1) * (F.array_max(ys) - F.array_min(ys) + 1)

    trues = lambda m: F.array_compact(F.transform(m, lambda t, i: F.when(t, i)))
    return let(mask, lambda m: let(trues(m), lambda at: F.when(F.size(at) > 0, area(at) / F.size(m)).otherwise(F.lit(0.0))))


def steps_across(a: Column, width: int) -> Column:
    """Absolute steps from each pixel to the one on its right; 0 at the end of a line."""
    return let(a, lambda v: F.transform(v, lambda x, i: F.when(F.pmod(i + 1, F.lit(width)) == 0, F.lit(0.0)).otherwise(F.abs(F.get(v, i + 1).cast("double") - x.cast("double")))))


def edges_kept(a: Column, b: Column, width: int) -> Column:
    """Share of the edges of ``a`` that ``b`` has too, by strength; 1 for a picture without edges."""
    kept = lambda ea: F.aggregate(F.zip_with(ea, steps_across(b, width), lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)
    return let(steps_across(a, width), lambda ea: F.coalesce(F.try_divide(kept(ea), F.nullif(total(ea), F.lit(0.0))), F.lit(1.0)))


def within(values: Column, mask: Column, inside: bool = True) -> Column:
    """The values where the mask is true (or false)."""
    paired = F.arrays_zip(values.alias("v"), mask.alias("m"))
    return F.transform(F.filter(paired, lambda p: p["m"] if inside else ~p["m"]), lambda p: p["v"])


def signal_to_noise(a: Column, b: Column, peak: float, most: float = 60.0) -> Column:
    """Peak signal-to-noise ratio in decibels, at most ``most``."""
    error = mean(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return F.when(error <= 0, F.lit(most)).otherwise(F.least(F.lit(most), 10.0 * F.log10(peak * peak / error)))


def relative_change(a: Column, b: Column) -> Column:
    """Per entry the change relative to the mean size of ``a``."""
    size = F.greatest(mean(F.transform(a, lambda x: F.abs(x.cast("double")))), F.lit(1e-6))
    return let(size, lambda base: F.transform(difference(a, b), lambda x: x / base))


def standing_out(delta: Column, k: float) -> Column:
    """Entries above the mean by more than ``k`` deviations."""
    return let(delta, lambda d: let(mean(d) + k * spread(d), lambda limit: F.transform(d, lambda x: x > limit)))


# scores from similarities


def cosine01(a: Column, b: Column) -> Column:
    return clamp((1.0 + cosine(a, b)) / 2.0)


def gain(edited: Column, original: Column, text: Column) -> Column:
    """How much closer to the text the edit came."""
    return cosine(edited, text) - cosine(original, text)


def preserved(a: Column, b: Column, temperature: float) -> Column:
    return F.exp(-(1.0 - cosine01(a, b)) / temperature)


def specificity(own: Column, rivals: Column, sharpness: float = 8.0) -> Column:
    """Own gain against the best rival's; missing rivals are passed over."""
    best = F.coalesce(F.array_max(rivals), F.lit(0.0))
    return sigmoid((own - best) * sharpness)


def required_and_absent(required: Column, forbidden: Column) -> Column:
    """Geometric mean of required similarities and of what forbidden ones leave; 1 for empty lists."""
    logs = F.concat(F.transform(required, lambda x: F.ln(clamp(x, 1e-6, 1.0))), F.transform(forbidden, lambda x: F.ln(clamp(1.0 - x, 1e-6, 1.0))))
    return F.when(F.size(logs) == 0, F.lit(1.0)).otherwise(F.exp(total(logs) / F.size(logs)))


def conflict_scale(g: Column, h: Column) -> Column:
    """By how much to scale a step against another that it agrees with; 1 where they don't."""
    product = dot(g, h)
    return F.when(product > 0, clamp(dot(g, g) / (product + 1e-12))).otherwise(F.lit(1.0))


def region_measures(change: Column, mask: Column, above: float, most: float = 60.0) -> dict[str, Column]:
    """Fourteen measures of an array of absolute changes inside and outside a mask.

    A change above ``above`` counts as changed.  An empty inside has change 0;
    an empty outside is measured on the whole.  Nothing changed is precise (1).
    """
    nothing = F.lit(0.0)
    inside, rest = within(change, mask), within(change, mask, False)
    outside = F.when(F.size(rest) > 0, rest).otherwise(change)
    n = F.size(change)
    count = lambda a: F.size(F.filter(a, lambda x: x > above))
    error = lambda a: F.coalesce(mean(F.transform(a, lambda x: x * x)), nothing)
    loudness = lambda a: F.when(error(a) <= 1e-12, F.lit(most)).otherwise(F.least(F.lit(most), -10.0 * F.log10(error(a))))
    hit, missed = count(inside), count(rest)
    return {
        "target_area": F.try_divide(F.size(inside), n), "outside_area": F.try_divide(F.size(rest), n), "changed": F.try_divide(count(change), n),
        "target_change": F.coalesce(mean(inside), nothing), "outside_change": F.coalesce(mean(outside), nothing),
        "target_changed": F.coalesce(F.try_divide(hit, F.size(inside)), nothing), "outside_changed": F.coalesce(F.try_divide(count(outside), F.size(outside)), nothing),
        "target_pixels": F.try_divide(hit, n), "outside_pixels": F.try_divide(missed, n), "precision": F.coalesce(F.try_divide(hit, hit + missed), F.lit(1.0)),
        "target_mse": error(inside), "outside_mse": error(outside), "target_psnr": loudness(inside), "outside_psnr": loudness(outside),
    }
