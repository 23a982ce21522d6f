"""SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_POOL = """pool as (
  select pool_id, batch, source_id, edit_type, total_score from (
    select *, row_number() over (partition by pool_id order by scored_at desc nulls last) rn from pool_candidates) where rn = 1
), typed as (
  select p.*, n.edit_type as known_type from pool p left join edit_type_names n on n.alias = lower(trim(p.edit_type))
)"""

_SAMPLE = f"""with {_POOL}, records as (
  select key, batch, edit_families, edit_families_text from (
    select *, row_number() over (partition by key order by ingested_at desc nulls last) rn from source_records) where rn = 1
), listed as (
  select key, batch, case when len(edit_families) > 0 then edit_families
    when starts_with(trim(edit_families_text), '[') then try_cast(json_extract_string(try_cast(edit_families_text as json), '$[*]') as varchar[])
    else regexp_split_to_array(edit_families_text, '[,;|/]') end as entries from records
), items as (
  select 'edit_type' as axis, batch, known_type as category from typed
  union all
  select 'family', batch, list_filter(list_transform(entries, lambda e: lower(trim(e))), lambda e: e in ('object', 'color', 'background', 'style', 'local', 'exposure', 'tone', 'contrast'))[1] from listed
), sizes as (
  select axis, batch, count(*) as n, count(*) * 20 // 100 as sample_size from items group by all
), have as (
  select axis, batch, category, count(*) as available from items where category is not null group by all
), grid as (
  select s.axis, s.batch, t.category, t.target_pct, t.min_keep, s.n, s.sample_size, coalesce(h.available, 0) as available,
    greatest(t.min_keep, (s.sample_size * t.target_pct + 99) // 100) as required
  from sizes s join sample_targets t on t.axis = s.axis
  left join have h on h.axis = s.axis and h.batch is not distinct from s.batch and h.category = t.category
)"""

_RANKED = f"""with {_POOL}, scored as (
  select t.pool_id, t.source_id, t.known_type as edit_type, t.total_score, k.keep_pct from typed t join keep_targets k on k.edit_type = t.known_type
  where isfinite(t.total_score)
), counted as (
  select *, count(*) over (partition by source_id, edit_type) as n, row_number() over (partition by source_id, edit_type order by total_score desc) as place from scored
), cutoffs as (
  select source_id, edit_type, any_value(n) as n, any_value((n * keep_pct + 99) // 100) as target_kept,
    max(case when place = (n * keep_pct + 99) // 100 then total_score end) as cutoff from counted group by source_id, edit_type
)"""

_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+'))"

_SHARES = f"""with sized as (
  select snapshot, replace(lower(trim(source)), '-', '_') as source, {_TOKENS} as n from documents
), totals as (select snapshot, sum(n)::bigint as total from sized group by snapshot
), by_source as (select snapshot, source, sum(n)::bigint as tokens from sized group by snapshot, source
)"""

_KEYS = """rec as (
  select key, author, page, entities from (select *, row_number() over (partition by key order by ingested_at desc nulls last) rn from source_records where key is not null) where rn = 1
), keys as (select key from rec union select record_key from candidate_log where record_key is not null
), marks as (
  select key, 'b:' as kind, split_part(key, '__reward_pool__', 1) as v from keys
  union all select key, 'a:', regexp_replace(lower(trim(author)), '^@', '') from rec
  union all select key, 'p:', regexp_replace(regexp_replace(lower(trim(page)), '[?#].*$', ''), '/$', '') from rec
  union all select key, 'e:', lower(trim(unnest(entities))) from rec
), ties as (
  select distinct key, kind || v as v from marks where v is not null and (kind = 'b:' or (v <> '' and v not in (select filler from placeholder_values)))
)"""

_ROOTS = f"""with recursive {_KEYS}, cc(key, root) using key (key) as (
      select key, key as root from keys
      union
      select b.key, min(a.root) from cc a join ties ta on ta.key = a.key join ties tb on tb.v = ta.v join recurring.cc b on b.key = tb.key where a.root < b.root group by b.key
    )"""

SQL: dict[str, str] = {
    "p2_components": f"""{_ROOTS} select key, root as root_key, case when key in (select key from rec) then 1 else 2 end as generation from cc""",
    "p2_found": f"""{_ROOTS} select root as root_key, key from cc where root <> key""",
    "p1_report": f"""{_SAMPLE}, placed as (
      select *, row_number() over (partition by axis, batch order by target_pct desc, category) as place from grid
    ), numbered as (select axis, batch, category, place, target_pct, min_keep, sample_size, unnest(range(1, available + 1)) as r from placed
    ), seated as (
      select axis, batch, category, row_number() over (partition by axis, batch order by r > min_keep, (r - 0.5::double) / target_pct::double, place) <= sample_size as taken from numbered
    ), seats as (select axis, batch, category, count(*) filter (where taken) as seats from seated group by all)
    select g.axis, g.batch, g.category, g.target_pct::double as target_pct, g.min_keep, g.n, g.sample_size, g.available, g.required, coalesce(s.seats, 0) as seats,
      g.available < g.required as is_short, coalesce(s.seats, 0) < g.required as seats_short
    from grid g left join seats s on s.axis = g.axis and s.batch is not distinct from g.batch and s.category = g.category""",
    "p1_found": f"{_SAMPLE} select batch, axis, category from grid where available < required",
    "p4_found": f"{_RANKED} select s.pool_id from scored s join cutoffs c on c.source_id is not distinct from s.source_id and c.edit_type = s.edit_type where s.total_score >= c.cutoff",
    "p4_cutoffs": f"""{_RANKED} select c.source_id, c.edit_type, c.n, c.target_kept, c.cutoff, count(s.pool_id) as kept
      from cutoffs c left join scored s on c.source_id is not distinct from s.source_id and c.edit_type = s.edit_type and s.total_score >= c.cutoff
      group by all""",
    "p5_found": """with valid as (
      select group_id, candidate_index, record_key, coalesce(evaluator.total_score, solver.total_score) as score from (
        select *, row_number() over (partition by group_id, candidate_index order by logged_at desc nulls last) rn from candidate_log where trim(group_id) <> '') where rn = 1
    ), scored as (
      select group_id, candidate_index::bigint as item_no, split_part(record_key, '__reward_pool__', 1) as base, record_key, score from valid where isfinite(score)
    ), placed as (
      select 'group' as axis, group_id as axis_key, group_id, item_no, row_number() over (partition by group_id order by score desc, item_no) as place from scored
      union all
      select 'record', base, group_id, item_no, row_number() over (partition by base order by score desc, group_id, item_no) from scored where record_key is not null
      union all
      select 'live', current_group_id, current_group_id, snapshot_no, row_number() over (partition by current_group_id order by health_score desc, snapshot_no)
      from (select distinct current_group_id, snapshot_no, health_score from round_metrics where current_group_id is not null and isfinite(health_score))
    ) select axis, axis_key, group_id, item_no from placed where place <= 3""",
    "p6_found": f"select l.limit_name, d.doc_id from documents d join size_limits l on l.used_for = 'pack' and {_TOKENS} > l.capacity",
    "p7_found": f"""{_SHARES} select m.mix, t.snapshot, m.source from totals t cross join mix_targets m
      left join by_source b on b.snapshot is not distinct from t.snapshot and b.source = m.source
      where coalesce(b.tokens, 0) * m.max_repeat * 100 < m.weight_pct * t.total""",
    "p7_targets": f"""{_SHARES} select m.mix, t.snapshot, m.source, m.weight_pct::double as weight_pct, m.max_repeat, t.total as total_tokens, coalesce(b.tokens, 0) as source_tokens,
      round(m.weight_pct * t.total / 100.0, 3) as target_tokens, coalesce(b.tokens, 0) * m.max_repeat * 100 < m.weight_pct * t.total as is_short
      from totals t cross join mix_targets m left join by_source b on b.snapshot is not distinct from t.snapshot and b.source = m.source""",
    "p8_found": f"""with lines as (
      select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents where {_TOKENS} > 384
    ), marked as (
      select doc_id, line_no, line, regexp_full_match(line, '[ \\t\\r]*') as blank from lines
    ), starts as (
      select *, case when not blank and coalesce(lag(blank) over (partition by doc_id order by line_no), true) then 1 else 0 end as begins from marked
    ), numbered as (
      select *, sum(begins) over (partition by doc_id order by line_no) - 1 as block_no from starts
    ), blocks as (
      select doc_id, block_no, sum({_TOKENS.replace("text", "line")}) as n from numbered where not blank group by all
    ), large as (select doc_id, block_no::int as block_no from blocks where n > 384
    ) select doc_id, block_no from large union all select distinct doc_id, -1 from lines where doc_id not in (select doc_id from large)""",
}
