"""Array and image kernel queries (IMG) on the vectors of ``embeddings``.

A vector of 64 stands for an 8 x 8 picture or for four vectors of 16: the
edited picture, the original, a text and a distractor.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import kernels as K
from millrace.functions.exprs import clamp, cosine, sigmoid, weighted_mean
from millrace.plans.base import Registry, columns_query

R = Registry()
QUERIES, SQL = R.QUERIES, R.SQL

V = lambda: K.doubles(F.col("embedding"))
BACK = lambda: F.reverse(V())
PART = lambda i: F.slice(V(), 16 * i + 1, 16)
r5 = lambda x: F.round(x, 5)

_V, _B = "embedding::double[]", "list_reverse(embedding::double[])"
_P = [f"embedding[{16 * i + 1}:{16 * i + 16}]::double[]" for i in range(4)]
_DIFF = f"list_transform(list_zip({_V}, {_B}), lambda z: abs(z[1] - z[2]))"
_MASK = f"list_transform({_DIFF}, lambda x: x > 0.1)"
_COS = lambda a, b: f"list_cosine_similarity({_P[a]}, {_P[b]})"
_C01 = lambda a, b: f"least(greatest((1 + {_COS(a, b)}) / 2, 0.0), 1.0)"


def add(name: str, **columns) -> None:
    columns_query(R, name, "embeddings", {c: ((lambda m=m: r5(m())), f"round({s}, 5)") for c, (m, s) in columns.items()})


def _mean(x: str) -> str:
    return f"list_avg({x})"


_STD = f"list_stddev_pop({_V})"
add(
    "img_1_stats", mean=(lambda: K.mean(V()), _mean(_V)), std=(lambda: K.spread(V()), _STD), low=(lambda: F.array_min(V()), f"list_min({_V})"), high=(lambda: F.array_max(V()), f"list_max({_V})"),
    positive=(lambda: K.share(F.transform(V(), lambda x: x > 0)), f"list_avg(list_transform({_V}, lambda x: (x > 0)::int))"), rough=(lambda: K.mean(K.steps_across(V(), 8)), "list_avg(list_transform(range(0, 64), lambda i: case when (i + 1) % 8 = 0 then 0.0 else abs(embedding[i + 2]::double - embedding[i + 1]::double) end))"),
)
add("img_2_pair_stats", before=(lambda: K.mean(F.slice(V(), 1, 32)), "list_avg(embedding[1:32]::double[])"), after=(lambda: K.mean(F.slice(V(), 33, 32)), "list_avg(embedding[33:64]::double[])"))
add("img_3_difference", mean=(lambda: K.mean_error(V(), BACK()), ""), changed=(lambda: K.changed_share(V(), BACK(), 0.1), ""), box=(lambda: K.box_share(K.change_mask(V(), BACK(), 0.1), 8), ""))
SQL["img_3_difference"] = f"""with d as (select vec_id, {_DIFF} as d from embeddings), marks as (select vec_id, d, list_filter(list_transform(range(0, 64), lambda i: case when d[i + 1] > 0.1 then i end), lambda i: i is not null) as p from d)
  select vec_id, round(list_avg(d), 5) as mean, round(len(p) / 64.0::double, 5) as changed, round(case when len(p) > 0 then (list_max(list_transform(p, lambda i: i % 8)) - list_min(list_transform(p, lambda i: i % 8)) + 1) * (list_max(list_transform(p, lambda i: i // 8)) - list_min(list_transform(p, lambda i: i // 8)) + 1) / 64.0 else 0.0 end::double, 5) as box from marks"""
_L = "list_transform(range(1, 22), lambda i: 0.2126 * embedding[i]::double + 0.7152 * embedding[i + 21]::double + 0.0722 * embedding[i + 42]::double)"
LUM = lambda: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: 0.2126 * F.get(V(), i) + 0.7152 * F.get(V(), i + 21) + 0.0722 * F.get(V(), i + 42))
add("img_4_luminance", mean=(lambda: K.mean(LUM()), _mean(_L)), std=(lambda: K.spread(LUM()), f"list_stddev_pop({_L})"), warmth=(lambda: K.mean(F.slice(V(), 1, 21)) - K.mean(F.slice(V(), 43, 21)), "list_avg(embedding[1:21]::double[]) - list_avg(embedding[43:63]::double[])"))
add("img_5_tail", share=(lambda: K.share(F.transform(K.difference(V(), BACK()), lambda x: x > 0.25)), f"list_avg(list_transform({_DIFF}, lambda x: (x > 0.25)::int))"))
add("img_6_edges", kept=(lambda: K.edges_kept(V(), BACK(), 8), ""))
_E = "list_transform(range(0, 64), lambda i: case when (i + 1) % 8 = 0 then 0.0 else abs({0}[i + 2] - {0}[i + 1]) end)"
SQL["img_6_edges"] = f"with v as (select vec_id, {_V} as v, {_B} as b from embeddings), e as (select vec_id, {_E.format('v')} as x, {_E.format('b')} as y from v) select vec_id, round(coalesce(list_sum(list_transform(list_zip(x, y), lambda z: least(z[1], z[2]))) / nullif(list_sum(x), 0), 1.0), 5) as kept from e"
add("img_7_mean_error", error=(lambda: K.mean_error(PART(0), PART(1)), f"list_avg(list_transform(list_zip({_P[0]}, {_P[1]}), lambda z: abs(z[1] - z[2])))"))
BOX = lambda: K.box_mask(64, 8, 2, 1, 6, 5)
_INSIDE = "list_transform(list_filter(range(0, 64), lambda i: (i % 8 >= 2 and i % 8 < 6 and i // 8 >= 1 and i // 8 < 5)), lambda i: ({d})[i + 1])"
_OUTSIDE = "list_transform(list_filter(range(0, 64), lambda i: not (i % 8 >= 2 and i % 8 < 6 and i // 8 >= 1 and i // 8 < 5)), lambda i: ({d})[i + 1])"
add("img_8_box", share=(lambda: K.share(BOX()), "16 / 64.0::double"), inside=(lambda: K.mean(K.within(V(), BOX())), _mean(_INSIDE.format(d=_V))))
columns_query(R, "img_9_dilation", "embeddings", {"n": (lambda: F.size(F.filter(K.dilated(F.transform(V(), lambda x: x > 0.2), 8), lambda x: x)), "")})
SQL["img_9_dilation"] = """with p as (select vec_id, unnest(range(0, 64)) as i, unnest(embedding) > 0.2 as m from embeddings), o as (select unnest([-1, 0, 1]) as d)
  select v.vec_id, count(distinct case when p.i % 8 + x.d between 0 and 7 and p.i // 8 + y.d between 0 and 7 then p.i + x.d + 8 * y.d end)::int as n from embeddings v left join p on p.vec_id = v.vec_id and p.m cross join o x cross join o y group by v.vec_id"""
columns_query(R, "img_10_diff_mask", "embeddings", {"n": (lambda: F.size(F.filter(K.change_mask(V(), BACK(), 0.1), lambda x: x)), f"len(list_filter({_MASK}, lambda x: x))::int")})
_SQ = f"list_avg(list_transform(list_zip({_V}, {_B}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_PSNR = f"case when {_SQ} <= 0 then 60.0 else least(60.0, 10 * log10(1.0 / {_SQ})) end"
_IND = f"list_filter({_DIFF}, lambda x: x > 0.1)"
_OUTD = f"list_filter({_DIFF}, lambda x: not x > 0.1)"
add("img_12_diff_region", inside=(lambda: K.mean(K.within(K.difference(V(), BACK()), K.change_mask(V(), BACK(), 0.1))), _mean(_IND)), outside=(lambda: K.mean(K.within(K.difference(V(), BACK()), K.change_mask(V(), BACK(), 0.1), False)), _mean(_OUTD)))
DELTA = lambda: K.relative_change(V(), BACK())
_OUT = lambda inside: K.let(DELTA(), lambda d: K.mean(K.within(d, K.standing_out(d, 1.0), inside)))
add("img_13_locality", share=(lambda: K.share(K.standing_out(DELTA(), 1.0)), ""), inside=(lambda: _OUT(True), ""), outside=(lambda: _OUT(False), ""))
SQL["img_13_locality"] = f"""with d as (select vec_id, unnest({_DIFF}) as x, greatest(list_avg(list_transform({_V}, lambda y: abs(y))), 1e-6) as base from embeddings), r as (select vec_id, x / base as x, avg(x / base) over w + stddev_pop(x / base) over w as lim from d window w as (partition by vec_id))
  select vec_id, round(avg((x > lim)::int), 5) as share, round(avg(x) filter (x > lim), 5) as inside, round(avg(x) filter (not x > lim), 5) as outside from r group by vec_id"""
_GAIN = f"({_COS(0, 2)} - {_COS(1, 2)})"
_RIVAL = f"({_COS(0, 3)} - {_COS(1, 3)})"
GAIN = lambda: K.gain(PART(0), PART(1), PART(2))
RIVAL = lambda: K.gain(PART(0), PART(1), PART(3))
_SIG = lambda x: f"(1 / (1 + exp(-({x}))))"
add("img_14_taxonomy", score=(lambda: sigmoid(4.0 * GAIN()) - 0.5 * clamp(RIVAL()), f"{_SIG(f'4 * {_GAIN}')} - 0.5 * least(greatest({_RIVAL}, 0.0), 1.0)"))
add("img_15_specificity", score=(lambda: K.specificity(GAIN(), F.array(RIVAL())), _SIG(f"8 * ({_GAIN} - {_RIVAL})")))
add("img_16_semantic", score=(lambda: K.preserved(PART(0), PART(1), 0.25), f"exp(-(1 - {_C01(0, 1)}) / 0.25)"))
_G = lambda xs: "exp((" + " + ".join(f"ln(least(greatest({x}, 1e-6), 1.0))" for x in xs) + f") / {len(xs)})"
add("img_17_rubric", score=(lambda: K.required_and_absent(F.array(K.cosine01(PART(0), PART(2)), K.cosine01(PART(0), PART(1))), F.array(K.cosine01(PART(0), PART(3)))), _G([_C01(0, 2), _C01(0, 1), f"1 - {_C01(0, 3)}"])))
add("img_18_required", score=(lambda: K.required_and_absent(F.array(K.cosine01(PART(0), PART(2)), K.cosine01(PART(1), PART(2))), F.array().cast("array<double>")), _G([_C01(0, 2), _C01(1, 2)])))
add("img_19_absent", score=(lambda: K.required_and_absent(F.array().cast("array<double>"), F.array(K.cosine01(PART(0), PART(3)), K.cosine01(PART(1), PART(3)))), _G([f"1 - {_C01(0, 3)}", f"1 - {_C01(1, 3)}"])))
add("img_20_proxy", overall=(lambda: K.cosine01(PART(0), PART(2)), _C01(0, 2)), local=(lambda: K.mean_error(F.slice(V(), 1, 4), F.slice(V(), 17, 4)), "list_avg(list_transform(list_zip(embedding[1:4]::double[], embedding[17:20]::double[]), lambda z: abs(z[1] - z[2])))"))
add("img_21_blend", score=(lambda: weighted_mean([(K.cosine01(PART(0), PART(2)), 0.5), (K.cosine01(PART(0), PART(1)), 0.3), (K.cosine01(PART(1), PART(3)), 0.2)]), f"({_C01(0, 2)} * 0.5 + {_C01(0, 1)} * 0.3 + {_C01(1, 3)} * 0.2) / 1.0"))
add("img_23_gain", gain=(GAIN, _GAIN))
add("img_24_support", support=(lambda: K.cosine01(PART(0), PART(2)), _C01(0, 2)))
add("img_25_feature", score=(lambda: K.preserved(PART(2), PART(3), 0.5), f"exp(-(1 - {_C01(2, 3)}) / 0.5)"))
add("img_26_margin", margin=(lambda: GAIN() - F.array_max(F.array(RIVAL(), F.lit(0.0))), f"{_GAIN} - greatest({_RIVAL}, 0.0)"))
add("img_27_counterfactual", margin=(lambda: cosine(PART(0), PART(2)) - F.array_max(F.array(cosine(PART(0), PART(3)), F.lit(None).cast("double"), cosine(PART(0), PART(1)))), f"{_COS(0, 2)} - greatest({_COS(0, 3)}, {_COS(0, 1)})"))
add("img_28_best_detection", best=(lambda: F.coalesce(F.array_max(F.filter(V(), lambda x: x > 0.1)), F.lit(0.0)), f"coalesce(list_max(list_filter({_V}, lambda x: x > 0.1)), 0.0)"))
_DOT = lambda a, b: f"list_dot_product({_P[a]}, {_P[b]})"
add("img_29_conflict", scale=(lambda: K.conflict_scale(PART(0), PART(1)), f"case when {_DOT(0, 1)} > 0 then least(greatest({_DOT(0, 0)} / ({_DOT(0, 1)} + 1e-12), 0.0), 1.0) else 1.0 end"))
