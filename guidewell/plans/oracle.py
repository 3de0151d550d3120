"""The same queries as SQL that DuckDB runs, built from shared common table expressions."""

from __future__ import annotations

import math

MOST = repr(math.log1p(1e4))

CELLS = """
cells as (select o_orderkey as row_id, cast(o_orderkey as varchar) as obs_index, o_orderpriority as priority,
  case when o_orderpriority = '5-LOW' then 'control' when o_orderstatus = 'F' then o_orderpriority
       when o_orderstatus = 'O' then o_orderpriority || '+O' else 'O' end as combo, c_mktsegment as segment
  from orders left join customer on o_custkey = c_custkey),
genes as (select cast(row_number() over (order by p_brand) - 1 as integer) as gene_id, p_brand as gene_name, cast(right(p_brand, 1) as integer) % 2 = 0 as hv from (select distinct p_brand from part)),
expr as (select l_orderkey as row_id, gene_id, sum(l_quantity) as x from lineitem join part on l_partkey = p_partkey join genes on p_brand = gene_name group by 1, 2),
lib as (select row_id, sum(x) as total from expr group by 1),
y as (select row_id, gene_id, x * (10000.0::double / total) as z, ln(1 + x * (10000.0::double / total)) as y from expr join lib using (row_id))"""

SINGLE = """,
pert as (select perturbation, cast(row_number() over (order by first) as integer) as p_idx from (select priority as perturbation, min(row_id) as first from cells where priority <> '5-LOW' group by 1)),
member as (select row_id, segment, coalesce(p_idx, 0) as p_idx from cells left join pert on priority = perturbation)"""

MULTI = """,
token as (select row_id, segment, unnest(string_split(combo, '+')) as token, generate_subscripts(string_split(combo, '+'), 1) as pos from cells where combo <> 'control'),
pert as (select perturbation, cast(row_number() over (order by row_id, pos) as integer) as p_idx from (select token as perturbation, min(row_id) as row_id, arg_min(pos, row_id * 10 + pos) as pos from token group by 1)),
guide as (select row_id, segment, p_idx from token join pert on token = perturbation),
member as (select row_id, segment, p_idx from guide union all select row_id, segment, 0 from cells where combo = 'control')"""

TESTS = """,
cnt as (select p_idx, count(*) as n from member group by 1),
sums as (select p_idx, gene_id, sum(y) as s, sum(y * y) as q, sum(z) as lin from y join member using (row_id) group by 1, 2),
full_grid as (select c.p_idx, g.gene_id, n, coalesce(s, 0) as s, coalesce(q, 0) as q, coalesce(lin, 0) as lin from cnt c cross join genes g left join sums u on u.p_idx = c.p_idx and u.gene_id = g.gene_id),
mom as (select p_idx, gene_id, n, s / n as mean, case when n > 1 then greatest(q / n - (s / n) * (s / n), 0) * n / (n - 1) else 0 end as var, lin / n as linear_mean from full_grid),
tests as (select a.p_idx, a.gene_id,
  case when sqrt(a.var / a.n + b.var / b.n) > 0 then (a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n) when a.mean <> b.mean then sign(a.mean - b.mean) * 'inf'::double else 0 end as t,
  log2((a.linear_mean + 1) / (b.linear_mean + 1)) as logfc from mom a join mom b on b.p_idx = 0 and b.gene_id = a.gene_id where a.p_idx > 0),
passing as (select * from tests where abs(logfc) > 0.05),
top as (select * from (select *, row_number() over (partition by p_idx order by abs(t) desc, gene_id) as rank from passing) where rank <= 5)"""

UNION = """,
uni as (select gene_id from top group by 1)"""
HVG = """,
uni as (select gene_id from genes where hv)"""
PLAIN = """,
v as (select row_id, gene_id, y from y join uni using (gene_id))"""
CLIP_OF = f"""
hist as (select gene_id, cast(least(greatest(floor(y / {MOST}::double * 2048), 0), 2047) as integer) as bin, count(*) as n from y where y > 0 group by 1, 2),
total as (select count(*) as n_cells, (count(*) - 1) * 0.95::double as spot from cells),
cum as (select gene_id, bin, n_cells - sum(n) over (partition by gene_id) as zeros, sum(n) over (partition by gene_id order by bin) as cum, spot from hist, total),
ranked as (select gene_id, spot,
  coalesce(max(case when floor(spot) < zeros then 0 end), min(case when cum >= floor(spot) - zeros + 1 then (bin + 1) * ({MOST}::double / 2048) end)) as a,
  coalesce(max(case when ceil(spot) < zeros then 0 end), min(case when cum >= ceil(spot) - zeros + 1 then (bin + 1) * ({MOST}::double / 2048) end)) as b from cum group by 1, 2),
clips as (select g.gene_id, coalesce(a + (b - a) * (spot - floor(spot)), 0) as clip from genes g left join ranked r on r.gene_id = g.gene_id)"""
CLIPPED = "," + CLIP_OF + """,
v as (select row_id, gene_id, least(y, clip) as y from y join uni using (gene_id) join clips using (gene_id))"""

RIDGE = """,
own as (select p_idx, gene_id, sum(y) as s from v join member using (row_id) group by 1, 2),
g as (select c.p_idx, u.gene_id, n, coalesce(s, 0) as s from cnt c cross join uni u left join own o on o.p_idx = c.p_idx and o.gene_id = u.gene_id),
zero as (select gene_id, (sum(s) - sum(case when p_idx > 0 then n / (n + 0.01::double) * s else 0 end)) / (sum(n) + 0.01::double - sum(case when p_idx > 0 then n / (n + 0.01::double) * n else 0 end)) as b0 from g group by 1),
beta as (select p_idx, gene_id, (s - n * b0) / (n + 0.01::double) as b from g join zero using (gene_id) where p_idx > 0 union all select 0, gene_id, b0 from zero),
base as (select a.p_idx, sum(a.b * z.b) as base from beta a join beta z on z.p_idx = 0 and z.gene_id = a.gene_id where a.p_idx > 0 group by 1)"""
BACKGROUND_OF = """,
cc as (select segment, count(*) as n_control from member where p_idx = 0 group by 1),
bg as (select segment, u.gene_id, coalesce(s, 0) / n_control as b from cc cross join uni u left join (select segment, gene_id, sum(y) as s from v join member using (row_id) where p_idx = 0 group by 1, 2) x using (segment, gene_id))"""
BACKGROUND = BACKGROUND_OF + """,
own as (select p_idx, gene_id, sum(y) as s from v join member using (row_id) group by 1, 2),
ex as (select p_idx, gene_id, sum(n * b) as e from (select p_idx, segment, count(*) as n from member where p_idx > 0 group by 1, 2) join bg using (segment) group by 1, 2),
beta as (select c.p_idx, u.gene_id, (coalesce(s, 0) - coalesce(e, 0)) / (n + 0.01::double) as b from cnt c cross join uni u left join own o on o.p_idx = c.p_idx and o.gene_id = u.gene_id left join ex x on x.p_idx = c.p_idx and x.gene_id = u.gene_id where c.p_idx > 0
  union all select 0, gene_id, 0 from uni),
base as (select p_idx, segment, sum(a.b * bg.b) as base from beta a join bg using (gene_id) where p_idx > 0 group by 1, 2)"""


def _score(on: str, scaled: bool = True) -> str:
    return f""",
norm as (select p_idx, sum(b * b) as norm from beta where p_idx > 0 group by 1),
dots as (select row_id, p_idx, sum(y * b) as dot from v join member using (row_id) join beta using (p_idx, gene_id) where p_idx > 0 group by 1, 2),
raw as (select m.row_id, m.p_idx, least(greatest((coalesce(dot, 0) - base) / norm, 0), 3) / 3 as w from member m join norm using (p_idx) join base using ({on}) left join dots using (row_id, p_idx) where norm > 0),
peak as (select p_idx, max(w) as top from raw group by 1),
scores as (select row_id, p_idx, {'case when top::float > 0 then (w::float / top::float)::float else 0::float end' if scaled else 'w::float'} as score from raw join peak using (p_idx))"""


M = CELLS + MULTI + TESTS + UNION + PLAIN
ALL = 6  # the intercept and five perturbations
CO = """,
together as (select a.p_idx as i, b.p_idx as j, count(*) as n from guide a join guide b using (row_id) group by 1, 2),
place as (select unnest(range(6)) as i),
n_of as (select i, j, n from together union all select 0, i, n from together where i = j union all select i, 0, n from together where i = j union all select 0, 0, count(*) from cells),
g0 as materialized (select a.i, b.i as j, coalesce(n, 0)::double + case when a.i = b.i then 0.01::double else 0 end as v from place a cross join place b left join n_of on n_of.i = a.i and n_of.j = b.i where {within}),
own as (select p_idx as i, gene_id, sum(y) as s from v join (select row_id, p_idx from guide union all select row_id, 0 from cells) using (row_id) group by 1, 2)"""


def _eliminated(first: int) -> str:
    """Gauss-Jordan steps over g0 (i, j, v) and r0 (i, gene_id, s); r6 holds the solution."""
    out = ""
    for k in range(ALL):
        if k < first:
            out += f""",
g{k + 1} as materialized (from g{k}), r{k + 1} as materialized (from r{k})"""
            continue
        out += f""",
g{k + 1} as materialized (select a.i, a.j, case when a.i = {k} then a.v / p.v else a.v - b.v * c.v / p.v end as v from g{k} a join g{k} p on p.i = {k} and p.j = {k} join g{k} b on b.i = a.i and b.j = {k} join g{k} c on c.i = {k} and c.j = a.j),
r{k + 1} as materialized (select a.i, a.gene_id, case when a.i = {k} then a.s / p.v else a.s - b.v * c.s / p.v end as s from r{k} a join g{k} p on p.i = {k} and p.j = {k} join g{k} b on b.i = a.i and b.j = {k} join r{k} c on c.i = {k} and c.gene_id = a.gene_id)"""
    return out


MULTI_BETA = CO.format(within="true") + """,
r0 as materialized (select i, gene_id, coalesce(s, 0) as s from place cross join uni left join own using (i, gene_id))""" + _eliminated(0) + """,
beta as materialized (select i as p_idx, gene_id, s as b from r6),
base as (select a.p_idx, sum(a.b * z.b) as base from beta a join beta z on z.p_idx = 0 and z.gene_id = a.gene_id where a.p_idx > 0 group by 1)"""
MULTI_BACKGROUND = BACKGROUND_OF + CO.format(within="a.i > 0 and b.i > 0") + """,
ex as (select p_idx as i, gene_id, sum(n * b) as e from (select p_idx, segment, count(*) as n from member where p_idx > 0 group by 1, 2) join bg using (segment) group by 1, 2),
r0 as materialized (select i, gene_id, coalesce(s, 0) - coalesce(e, 0) as s from place cross join uni left join own using (i, gene_id) left join ex using (i, gene_id) where i > 0)""" + _eliminated(1) + """,
beta as materialized (select i as p_idx, gene_id, s as b from r6 union all select 0, gene_id, 0 from uni),
base as (select p_idx, segment, sum(a.b * bg.b) as base from beta a join bg using (gene_id) where p_idx > 0 group by 1, 2)"""


def _multi_score(on: str) -> str:
    """One perturbation in closed form; two by the nine ways to free them or hold them at 0 or 3, the best within bounds, the first of equals."""
    ways = "[{w: 0, a: (r1 * g22 - r2 * g12) / det, b: (r2 * g11 - r1 * g12) / det}, {w: 1, a: r1 / g11, b: 0}, {w: 2, a: (r1 - 3 * g12) / g11, b: 3}, {w: 3, a: 0, b: r2 / g22}, {w: 4, a: 0, b: 0}, {w: 5, a: 0, b: 3}, {w: 6, a: 3, b: (r2 - 3 * g12) / g22}, {w: 7, a: 3, b: 0}, {w: 8, a: 3, b: 3}]"
    return f""",
norm as (select p_idx, sum(b * b) as norm from beta where p_idx > 0 group by 1),
cross_of as (select x.p_idx as p1, y.p_idx as p2, sum(x.b * y.b) as g12 from beta x join beta y using (gene_id) where x.p_idx between 1 and y.p_idx - 1 group by 1, 2),
dots as (select row_id, p_idx, sum(y * b) as dot from v join guide using (row_id) join beta using (p_idx, gene_id) group by 1, 2),
right_of as materialized (select m.row_id, m.p_idx, coalesce(dot, 0) - base as r, norm, count(*) over (partition by m.row_id) as k from guide m join norm using (p_idx) join base using ({on}) left join dots using (row_id, p_idx)),
one as (select row_id, p_idx, (case when norm > 0 then least(greatest(r / norm, 0), 3) / 3 else 0 end)::float as s from right_of where k = 1),
two as (select x.row_id, x.p_idx as p1, y.p_idx as p2, x.norm as g11, y.norm as g22, g12, x.r as r1, y.r as r2, x.norm * y.norm - g12 * g12 as det from right_of x join right_of y on y.row_id = x.row_id and x.p_idx < y.p_idx join cross_of on p1 = x.p_idx and p2 = y.p_idx where x.k = 2),
way as (select row_id, p1, p2, g11, g12, g22, r1, r2, unnest({ways}, recursive := true) from two),
inside as (select row_id, p1, p2, w, least(greatest(a, 0), 3) as a, least(greatest(b, 0), 3) as b, g11, g12, g22, r1, r2 from way where a between -1e-9 and 3 + 1e-9 and b between -1e-9 and 3 + 1e-9),
best as (select row_id, p1, p2, a, b from inside qualify row_number() over (partition by row_id order by 0.5 * (g11 * a * a + 2 * g12 * a * b + g22 * b * b) - r1 * a - r2 * b, w) = 1),
raw as (from one union all select row_id, p1, (a / 3)::float from best union all select row_id, p2, (b / 3)::float from best),
peak as (select p_idx, max(s) as top from raw group by 1),
scores as (select row_id, p_idx, case when top > 0 then (s / top)::float else 0::float end as score from raw join peak using (p_idx))"""


S = CELLS + SINGLE
T = S + TESTS
U = T + UNION
OUT = " select row_id, p_idx, round(score::double, 6) as score from scores"
BETA = " select p_idx, gene_id, round(b, 6) as b from beta"
LABELS = " select row_id, {label} as label, {control} as is_control, true as is_model, {active} as active from cells"

ORACLE_SQL = {
    "scan_cells": f"with {CELLS} select row_id, obs_index, priority, combo, segment from cells",
    "scan_expr": f"with {CELLS} select row_id, gene_id, round(x, 6) as x from expr",
    "scan_layer": f"with {CELLS} select gene_id, round(sum(x) * 2, 6) as x from expr group by 1",
    "labels_single": f"with {S} select c.row_id, priority as label, priority = '5-LOW' as is_control, true as is_model, case when p_idx = 0 then '' else p_idx::varchar end as active from cells c join member m using (row_id)",
    "labels_multi": f"with {CELLS + MULTI} select c.row_id, combo as label, combo = 'control' as is_control, true as is_model, coalesce(string_agg(p_idx::varchar, ',' order by p_idx), '') as active from cells c left join guide g using (row_id) group by 1, 2",
    "ordered_perturbations": f"with {CELLS + MULTI} select p_idx, perturbation from pert",
    "guides": f"with {CELLS + MULTI} select row_id, p_idx from guide",
    "active_set_groups": f"with {CELLS + MULTI}, a as (select row_id, string_agg(p_idx::varchar, ',' order by p_idx) as active from guide group by 1) select active, count(*) as n_cells from a group by 1",
    "guide_multiplicity": f"with {CELLS + MULTI}, k as (select c.row_id, count(p_idx) as k from cells c left join guide using (row_id) group by 1) select min(k) as least, max(k) as most, round(avg(k), 6) as mean, count(*) filter (k = 0) as zero_count, count(*) filter (k = 1) as single_count, count(*) filter (k > 1) as multi_count from k",
    "cluster_codes": f"with {CELLS} select segment as cluster, row_number() over (order by min(row_id)) - 1 as code from cells group by 1",
    "resolve_labels": f"with {CELLS} select row_number() over (order by min(row_id)) - 1 as position, priority as label from cells where priority not in ('5-LOW', '1-URGENT') group by 2",
    "library_size": f"with {CELLS} select row_id, round(total, 6) as total from lib",
    "normalize": f"with {CELLS} select row_id, gene_id, round(z, 6) as z from y",
    "log_normalize": f"with {CELLS} select row_id, gene_id, round(y, 6) as y from y",
    "group_moments": f"with {T} select p_idx, gene_id, n, round(mean, 6) as mean, round(var, 6) as var from mom join sums using (p_idx, gene_id)",
    "group_moments_multi": f"with {CELLS + MULTI + TESTS} select p_idx, gene_id, n, round(mean, 6) as mean, round(var, 6) as var from mom join sums using (p_idx, gene_id)",
    "linear_means": f"with {T} select p_idx, gene_id, round(linear_mean, 6) as linear_mean from mom join sums using (p_idx, gene_id)",
    "welch_t": f"with {T} select p_idx, gene_id, round(t, 6) as t from tests",
    "log2fc": f"with {T} select p_idx, gene_id, round(logfc, 6) as logfc from tests",
    "topk_abs": f"with {T} select p_idx, cast(rank as integer) as rank, gene_id from top",
    "topk_signed": f"with {T} select p_idx, cast(rank as integer) as rank, gene_id from (select *, row_number() over (partition by p_idx order by t desc, gene_id) as rank from tests) where rank <= 5",
    "union_targets": f"with {T} select cast(row_number() over (order by first) - 1 as integer) as position, gene_id from (select gene_id, min(p_idx * 1000 + rank) as first from top group by 1)",
    "hvg_targets": f"with {S} select p_idx, cast(row_number() over (partition by p_idx order by gene_id) as integer) as rank, gene_id from pert cross join genes where hv",
    "beta_single": f"with {U + PLAIN + RIDGE}{BETA}",
    "beta_norms": f"with {U + PLAIN + RIDGE} select p_idx, round(sum(b * b), 6) as norm from beta where p_idx > 0 group by 1",
    "ps_score_single": f"with {U + PLAIN + RIDGE + _score('p_idx')}{OUT}",
    "ps_score_unscaled": f"with {U + PLAIN + RIDGE + _score('p_idx', False)}{OUT}",
    "ps_score_hvg": f"with {T + HVG + PLAIN + RIDGE + _score('p_idx')}{OUT}",
    "cluster_background": f"with {U + PLAIN + BACKGROUND_OF} select segment as cluster, gene_id, round(b, 6) as b from bg",
    "beta_background": f"with {U + PLAIN + BACKGROUND}{BETA}",
    "ps_score_background": f"with {U + PLAIN + BACKGROUND + _score('p_idx, segment')}{OUT}",
    "clip_histogram": f"with {CELLS},{CLIP_OF} select gene_id, bin, n from hist",
    "clip_values": f"with {CELLS},{CLIP_OF} select gene_id, round(clip, 6) as clip from clips",
    "exact_quantiles": f"with {CELLS} select gene_id, round(quantile_cont(coalesce(y.y, 0), 0.95), 6) as clip from cells cross join genes left join y using (row_id, gene_id) group by 1",
    "ps_score_clipped": f"with {U + CLIPPED + RIDGE + _score('p_idx')}{OUT}",
    "cooccurrence": f"with {CELLS + MULTI} select a.p_idx as p1, b.p_idx as p2, count(*) as n from guide a join guide b using (row_id) group by 1, 2",
    "xty": f"with {CELLS + MULTI} select p_idx, gene_id, round(sum(y), 6) as s from y join (select row_id, p_idx from guide union all select row_id, 0 from cells) using (row_id) group by 1, 2",
    "beta_multilabel": f"with {M + MULTI_BETA}{BETA}",
    "ps_score_multilabel": f"with {M + MULTI_BETA + _multi_score('p_idx')}{OUT}",
    "ps_score_multilabel_background": f"with {M + MULTI_BACKGROUND + _multi_score('p_idx, segment')}{OUT}",
    "effect_grams": f"""with {M + MULTI_BETA}, sets as (select distinct active from (select row_id, list_sort(list(p_idx)) as active from guide group by 1) where len(active) > 1),
      pairs as (select active, unnest(active) as p1 from sets), every as (select active, p1, unnest(active) as p2 from pairs)
      select array_to_string(active, ',') as active, p1, p2, round(sum(x.b * y.b), 6) as g from every join beta x on x.p_idx = p1 join beta y on y.p_idx = p2 and y.gene_id = x.gene_id group by 1, 2, 3""",
    "target_metadata": f"with {U + PLAIN + RIDGE} select perturbation, n as cell_count, (select count(*) from top where top.p_idx = pert.p_idx) as selected_gene_count, (select count(*) from passing where passing.p_idx = pert.p_idx) as passing_gene_count, round((select sum(b * b) from beta where beta.p_idx = pert.p_idx), 6) as beta_norm_sq from pert join cnt using (p_idx)",
    "dense_summary": """with e as (select generate_subscripts(embedding, 1) - 1 as gene_id, unnest(embedding)::double as y from embeddings), s as (select gene_id, count(*) as n, sum(y) as s, sum(y * y) as q from e group by 1)
      select cast(gene_id as integer) as gene_id, n, round(s / n, 6) as mean, round(case when n > 1 then greatest(q / n - (s / n) * (s / n), 0) * n / (n - 1) else 0 end, 6) as var from s""",
    "welch_of_dense_rows": """with e as (select label, generate_subscripts(embedding, 1) - 1 as gene_id, unnest(embedding)::double as y from embeddings where label in (0, 1)),
      s as (select label, gene_id, count(*) as n, avg(y) as m, greatest(sum(y * y) / count(*) - avg(y) * avg(y), 0) * count(*) / (count(*) - 1) as v from e group by 1, 2)
      select cast(a.gene_id as integer) as gene_id, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) as t from s a join s b on a.gene_id = b.gene_id where a.label = 1 and b.label = 0""",
    "exact_clip": f"""with {CELLS}, q as (select gene_id, quantile_cont(coalesce(y.y, 0), 0.95) as clip from cells cross join genes left join y using (row_id, gene_id) group by 1)
      select row_id, gene_id, round(least(y, clip), 6) as y from y join q using (gene_id) where least(y, clip) <> 0""",
}
# two of the perturbations only: cells of the others are neither controls nor scored
_TWO = U.replace("where priority <> '5-LOW' group by 1)", "where priority in ('2-HIGH', '3-MEDIUM') group by 1)").replace("cast(row_number() over (order by first) as integer)", "case perturbation when '2-HIGH' then 1 else 2 end", 1).replace("coalesce(p_idx, 0) as p_idx from cells left join pert on priority = perturbation", "coalesce(p_idx, 0) as p_idx from cells left join pert on priority = perturbation where priority in ('2-HIGH', '3-MEDIUM', '5-LOW')", 1)
ORACLE_SQL["long_table"] = f"""with {_TWO + PLAIN + RIDGE + _score('p_idx')}
  select obs_index, round(score::double, 6) as ps_score, perturbation from scores join pert using (p_idx) join cells using (row_id)
  union all select obs_index, 0.0, '5-LOW' from cells where priority = '5-LOW'
  union all select obs_index, null, null from cells where priority not in ('2-HIGH', '3-MEDIUM', '5-LOW')"""
