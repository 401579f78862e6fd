"""SQL for DuckDB that gives the rows of each registered query."""

from __future__ import annotations

from planmatch.functions.text import LOOKALIKES, PENALTY, UNKNOWN, UNKNOWN_PREFIXES, lookalike_name
from planmatch.plans import fixtures as fx
from planmatch.plans.queries import PREVIEW

TILE = "page_number, tile_index"


def norm(c: str) -> str:
    """Upper case as Java has it: one letter in it becomes two."""
    return rf"regexp_replace(upper(replace({c}, 'ß', 'SS')), '\s', '', 'g')"


def shape(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\p{{L}}', 'A', 'g'), '\p{{Nd}}', '9', 'g')"


def unknown(c: str) -> str:
    cases = " ".join(f"when starts_with({c}, '{p}') then substr({c}, {len(p) + 1})" for p in UNKNOWN_PREFIXES)
    body = f"ltrim(case {cases} else {c} end, '-#:.,/')"
    return f"case when {body} in ({', '.join(repr(u) for u in UNKNOWN)}) then {body} end"


def listed(c: str) -> str:
    return f"array_to_string({c}, ',')"


KNOWN, SEPARATED, FLUSH = r"^(?:P-|P#|PP#|POLE-?NO:?|POLE#?:?)(.+)$", r"^[A-Z]{1,4}[\-#:.,/]+([A-Z0-9]+)$", r"^([A-Z]{1,2})([0-9][A-Z0-9]*)$"
LETTERS = r"letters as (select list(distinct left(pole_id_normalized, 1)) l from fx_catalog where regexp_matches(left(pole_id_normalized, 1), '\p{L}'))"
EXPLICIT = "regexp_matches({}, '^(?:P#|PP-|POLE(?:#|:|NO\\.?|NUMBER))')"
#: Every distinct text and context is spelled and resolved once, under a number, and joined back to the readings.
SPELLED = (
    f"""{LETTERS},
rd as materialized (select *, {EXPLICIT.format(norm("label_text"))} or {EXPLICIT.format(norm("raw_text"))} as explicit_pole_context, {norm("raw_text")} as norm from fx_readings),
r0 as materialized (select row_number() over (order by norm, explicit_pole_context) as tid, * from (select distinct norm, explicit_pole_context from rd)),
r1 as (select r0.*, {unknown("norm")} as unknown, translate(norm, '-#:.,/', '') as joined,
    case when starts_with(norm, 'PP-') then substr(norm, 4) when regexp_matches(norm, '{KNOWN}') then ltrim(regexp_extract(norm, '{KNOWN}', 1), '-#:.,/')
         when regexp_matches(norm, '{SEPARATED}') and regexp_matches(regexp_extract(norm, '{SEPARATED}', 1), '[0-9]') then regexp_extract(norm, '{SEPARATED}', 1)
         when regexp_matches(norm, '{FLUSH}') and not list_has_any(string_split(regexp_extract(norm, '{FLUSH}', 1), ''), l) then regexp_extract(norm, '{FLUSH}', 2) end as pbody,
    case when starts_with(norm, 'PP-') then 'removed_ocr_plan_prefix' when regexp_matches(norm, '{KNOWN}') then 'removed_pole_number_prefix'
         when regexp_matches(norm, '{SEPARATED}') and regexp_matches(regexp_extract(norm, '{SEPARATED}', 1), '[0-9]') then 'removed_generic_plan_prefix'
         when regexp_matches(norm, '{FLUSH}') and not list_has_any(string_split(regexp_extract(norm, '{FLUSH}', 1), ''), l) then 'removed_unspaced_plan_prefix' end as pname from r0, letters),
r2 as (select *, pbody is null and explicit_pole_context and regexp_matches(norm, '^[0-9]') as context, {unknown("pbody")} as body_unknown from r1),
r as materialized (select *, case when context then norm else pbody end as body, coalesce(pname, 'model_confirmed_explicit_pole_context') as name from r2),
pen(name, cost) as (values {", ".join(f"('{k}', {v})" for k, v in PENALTY.items())}),
look(digit, letter, cost, step, o) as (values {", ".join(f"('{a}', '{b}', {c}, '{lookalike_name(a, b)}', {i})" for i, (a, b, c) in enumerate(LOOKALIKES, 1))}),
base as (select tid, context, 0 as o, body as text, cost as penalty, [name] as steps from r join pen using (name) where body is not null and body_unknown is null and norm <> '' and unknown is null and body <> ''
    union all select tid, context, o, look.letter || substr(body, 2), pen.cost + look.cost, [name, step] from r join pen using (name) join look on left(body, 1) = look.digit, letters
        where body is not null and body_unknown is null and norm <> '' and unknown is null and list_contains(l, look.letter)),
more as (select tid, o, case when ends_with(text, 'F') then left(text, len(text) - 1) else text || 'F' end as text, penalty + 1500 as penalty,
    list_append(steps, case when ends_with(text, 'F') then 'removed_terminal_f' else 'added_terminal_f' end) as steps from base where not context),
v as materialized (select tid, 0 as phase, 0 as o, norm as text, 0 as penalty, []::varchar[] as steps from r where norm <> '' and unknown is null
    union all select tid, 1, 0, joined, 0, ['removed_identifier_separators'] from r where norm <> '' and unknown is null and joined <> norm and joined <> ''
    union all select tid, 2, o, text, penalty, steps from base union all select tid, 3, o, text, penalty, steps from more where text <> '')"""
)
NEIGHBOURS = r"""nid as (select distinct pole_id_normalized as pole_id, regexp_extract(pole_id_normalized, '^([A-Z]+)([0-9]+)(F?)$', 1) as l, regexp_extract(pole_id_normalized, '^([A-Z]+)([0-9]+)(F?)$', 2) as d
    from fx_catalog where regexp_matches(pole_id_normalized, '^[A-Z]+[0-9]+F?$')),
nk as (select pole_id, concat_ws('|', l, len(d), i, left(d, i - 1), substr(d, i + 1)) as k from (select *, unnest(range(1, len(d) + 1)) as i from nid)),
nb as (select a.pole_id, list_sort(list(distinct b.pole_id)) as neighbours from nk a join nk b using (k) where a.pole_id <> b.pole_id group by 1)"""
RESOLVED = f"""{SPELLED}, {NEIGHBOURS},
ids as (select pole_id_normalized as pole_id, count(*) as match_count, list_sort(list(distinct source_id)) as source_ids, coalesce(any_value(nb.neighbours), []) as neighbours
    from fx_catalog left join nb on nb.pole_id = pole_id_normalized group by 1),
h0 as (select v.*, ids.*, min(phase) over (partition by tid) as best from v join ids on v.text = ids.pole_id),
h as (select tid, phase, list(penalty order by penalty, pole_id) as penalties, list(pole_id order by penalty, pole_id) as found, arg_min(steps, (penalty, pole_id)) as steps, arg_min(match_count, (penalty, pole_id)) as n,
    arg_min(source_ids, (penalty, pole_id)) as own_sources, arg_min(neighbours, (penalty, pole_id)) as own_near, list_sort(list_distinct(flatten(list(source_ids)))) as all_sources, list_sort(list_distinct(flatten(list(neighbours)))) as all_near
    from h0 where phase = best group by tid, phase),
shapes as (select distinct {shape("pole_id_normalized")} as s from fx_catalog where pole_id_normalized <> ''),
texts as (select tid, list(text order by phase, o) filter (phase = 2) as t2, list(text order by phase, o) filter (phase >= 2) as t23 from v group by tid),
j as (select r.*, h.phase, h.penalties, h.found, h.steps, h.n, h.own_sources, h.own_near, h.all_sources, h.all_near, s is not null as known, coalesce(t2, []) as t2, coalesce(t23, []) as t23,
    h.phase >= 2 and len(found) > 1 and penalties[2] - penalties[1] < 500 as ambiguous
    from r left join h using (tid) left join shapes on s = {shape("norm")} left join texts using (tid)),
k as (select *, case when norm = '' then 'ignored' when unknown is not null then 'unknown_by_design' when phase = 0 then 'reference_exact' when phase = 1 then 'reference_resolved' when body_unknown is not null then 'unknown_by_design'
        when body is null and not known then 'ignored' when ambiguous then 'reference_ambiguous' when phase >= 2 then 'reference_resolved' else 'not_found' end as status,
    case when norm = '' then 'ignored_empty_text' when unknown is not null then 'drafter_marked_pole_unknown' when phase = 0 then 'catalog_exact' when phase = 1 then 'catalog_exact_after_separator_removal'
        when body_unknown is not null then 'drafter_marked_pole_unknown' when body is null and not known then 'ignored_non_pole_text' when body is null then 'catalog_exact_not_found'
        when ambiguous then 'catalog_constrained_ambiguous' when phase >= 2 then 'catalog_constrained_normalization' else 'catalog_constrained_not_found' end as resolution_method,
    case when phase = 0 then norm when phase = 1 then joined else body end as own from j),
rt as materialized (select norm, explicit_pole_context, norm as raw_normalized_text, status, resolution_method, found, penalties,
    case when status in ('reference_exact', 'reference_resolved') then found[1] end as resolved_pole_id,
    case when status in ('reference_exact', 'reference_resolved') then steps else [] end as transformations,
    case when norm = '' then [] when unknown is not null then [unknown] when phase = 0 then [norm] when phase = 1 then [norm, joined] when body_unknown is not null then [body] when body is null then [norm] when phase = 2 then t2 else t23 end as candidate_variants,
    case when status in ('reference_exact', 'reference_resolved') then n when status = 'reference_ambiguous' then len(found) else 0 end as match_count,
    case when status in ('reference_exact', 'reference_resolved') then own_sources when status = 'reference_ambiguous' then all_sources else [] end as matched_source_ids,
    case when status like 'reference%' then (10000 - penalties[1]) / 10000.0 else 0.0 end::double as resolution_confidence,
    case when status in ('reference_exact', 'reference_resolved') then ends_with(own, 'F') = ends_with(found[1], 'F') end as f_suffix_agrees,
    case when status in ('reference_exact', 'reference_resolved') then own_near when status = 'reference_ambiguous' then all_near else [] end as near,
    coalesce(list_has_any(steps, ['added_terminal_f', 'removed_terminal_f']), false) as toggled from k),
res as materialized (select {TILE}, pos, raw_text, label_text, model_confidence, model_reports_complete, model_reports_edge_clipped, rt.* exclude (norm) from rd join rt using (norm, explicit_pole_context))"""
CANDIDATES = f"""{RESOLVED},
cand as (select * from (select *, coalesce(resolved_pole_id, raw_normalized_text) as normalized_text, case when status in ('reference_exact', 'reference_resolved') then 'reference_exact' else status end as catalog_match_status,
    row_number() over (partition by {TILE}, coalesce(resolved_pole_id, raw_normalized_text) order by pos) as n
    from res where len(raw_normalized_text) between 1 and 32 and regexp_matches(raw_normalized_text, '[\\p{{L}}\\p{{N}}]') and status <> 'ignored') where n = 1)"""
JUDGED = f"""{CANDIDATES},
ex as (select distinct page_number, normalized_text from cand where catalog_match_status = 'reference_exact'),
pre as (select a.page_number, a.normalized_text, count(*) as longer from ex a join ex b on a.page_number = b.page_number and len(b.normalized_text) > len(a.normalized_text) and starts_with(b.normalized_text, a.normalized_text) group by 1, 2),
jud as (select *, case when len(review_reasons) = 0 then 'accepted' else 'review' end as acceptance_status from (select cand.*, list_filter([
    case when catalog_match_status = 'reference_ambiguous' then 'catalog_ambiguous' when catalog_match_status = 'unknown_by_design' then 'drafter_marked_pole_unknown' when catalog_match_status <> 'reference_exact' then 'catalog_not_found' end,
    case when not model_reports_complete then 'model_did_not_confirm_complete_id' end, case when model_reports_edge_clipped then 'model_reported_tile_edge_clipping' end, case when model_confidence < 0.8 then 'below_minimum_confidence' end,
    case when catalog_match_status = 'reference_exact' and longer >= 2 then 'prefix_of_multiple_longer_ids_on_page' when catalog_match_status = 'reference_exact' and longer = 1 then 'prefix_of_longer_id_on_page' end], lambda x: x is not null) as review_reasons
    from cand left join pre using (page_number, normalized_text)))"""
COORDINATES = """coord as (select pole_id_normalized as pole_id, case when count(distinct (x, y)) = 1 then any_value(p).x end as x, case when count(distinct (x, y)) = 1 then any_value(p).y end as y from (select *, {'x': x, 'y': y} as p from fx_catalog) group by 1)"""
POLES = f"""{JUDGED}, {COORDINATES},
nat as (select distinct page_number, {norm("raw_text")} as pole_id from fx_readings where page_number % 3 = 0 and {norm("raw_text")} in (select pole_id_normalized from fx_catalog)),
obs as (select pole_id, page_number, false as visual, 1.0::double as confidence from nat union all select normalized_text, page_number, true, resolution_confidence from jud where acceptance_status = 'accepted'),
poles as (select pole_id, array_to_string(list_filter([case when bool_or(not visual) then 'native_text' end, case when bool_or(visual) then 'visual' end], lambda x: x is not null), ',') as discovery_sources,
    {listed("list_sort(list(distinct page_number))")} as pages, max(confidence) as confidence from obs group by 1)"""
REQUESTS = "req as (select doc_id, (doc_id * 37) % 50 as submitted_at from (select distinct o_custkey % 50 as doc_id from orders)), num as (select doc_id, 1337 + row_number() over (order by submitted_at, doc_id) as number from req)"
PERMIT_POLES = f"""{JUDGED}, {COORDINATES}, {REQUESTS},
pp as (select * from (select (page_number - 1)::bigint as doc_id, normalized_text as pole_id, max(resolution_confidence) as confidence from jud where catalog_match_status = 'reference_exact' and acceptance_status = 'accepted' group by 1, 2)
    join coord using (pole_id) where doc_id % 10 <> 3),
placed as (select *, case when ends_with(pole_id, 'F') then 'Foreign' else 'City' end as pole_owner from pp where x is not null and y is not null)"""
R = f"{fx.DUCK_CATALOG}, {fx.DUCK_READINGS}"

# A hull is walked from its lowest point by the least turn; the sum of two convex shapes has the sum of their perimeters, and an area of theirs and of each side of one times how far
# the other reaches across it.
SIZES = f"""with recursive {R}, {PERMIT_POLES},
    way as (select cos(2 * pi() * k / 64) * 50 as ox, sin(2 * pi() * k / 64) * 50 as oy from (select unnest(range(64)) as k)),
    pt as (select distinct doc_id, x, y from placed where x is not null and y is not null),
    start as (select doc_id, arg_min(x, (y, x)) as sx, min(y) as sy from pt group by 1),
    walk as (select doc_id, sx, sy, sx as px, sy as py, sx as x, sy as y, 0::double as turn, 0 as step from start
        union all select doc_id, sx, sy, px, py, n.x, n.y, n.turn, step from (
            select w.doc_id, w.sx, w.sy, w.x as px, w.y as py, w.step + 1 as step,
                arg_min({{'x': p.x, 'y': p.y, 'turn': round(a.turn, 12)}}, (round(a.turn, 12), -sqrt((p.x - w.x) ** 2 + (p.y - w.y) ** 2))) as n
            from walk w join pt p on p.doc_id = w.doc_id and (p.x <> w.x or p.y <> w.y), lateral (select atan2(p.y - w.y, p.x - w.x) as t) b, lateral (select case when t < -1e-12 then t + 2 * pi() else t end as turn) a
            where (w.step = 0 or w.x <> w.sx or w.y <> w.sy) and a.turn >= w.turn - 1e-11 group by all)),
    side as (select doc_id, step, px - sx as ax, py - sy as ay, x - sx as bx, y - sy as by_ from walk where step > 0),
    reach as (select doc_id, step, max((by_ - ay) * ox - (bx - ax) * oy) as r from side, way group by 1, 2),
    own as (select doc_id, sum((ax * by_ - bx * ay) / 2 + r) as area, sum(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2)) as perimeter from side join reach using (doc_id, step) group by 1)
    select doc_id, round(coalesce(area, 0) + 64 * 1250 * sin(2 * pi() / 64), 2) as area, round(coalesce(perimeter, 0) + 64 * 100 * sin(pi() / 64), 2) as perimeter from start left join own using (doc_id)"""

BARE = """regexp_replace(regexp_replace(upper(replace({}, 'ß', 'SS')), '^[ \\t\\r\\n.,;:!?()\\[\\]{{}}<>"''`]+|[ \\t\\r\\n.,;:!?()\\[\\]{{}}<>"''`]+$', '', 'g'), '\\s', '', 'g')"""


def evaluated(rows: str) -> str:
    """Rows of ``rows`` (raw_text and more) that are ids or have an id's shape, letters and digits."""
    return f"""ev0 as (select *, {BARE.format("raw_text")} as normalized_text from {rows}), tshapes as (select distinct {shape("id")} as s from fx_tcat),
ev as (select ev0.*, case when fx_tcat.id is not null then 'reference_exact' else 'reference_pattern' end as match_status, case when fx_tcat.id is not null then 1 else 0 end as match_count, case when fx_tcat.id is not null then 'B' || fx_tcat.id else '' end as matched_source_ids
    from ev0 left join fx_tcat on fx_tcat.id = normalized_text left join tshapes on s = {shape("normalized_text")}
    where normalized_text <> '' and (fx_tcat.id is not null or (s is not null and regexp_matches(normalized_text, '\\p{{L}}') and regexp_matches(normalized_text, '\\p{{Nd}}'))))"""


PAIRS = """pr as (select page_number, page_index, line_number, word_number, text || ' ' || t2 as raw_text, x0, y0, bx1 as x1, by1 as y1 from (select *, lead(text) over w as t2, lead(word_number) over w as n2, lead(x1) over w as bx1, lead(y1) over w as by1
    from fx_words window w as (partition by page_index, line_number order by word_number)) where n2 = word_number + 1)"""
NATIVE = f"""{fx.DUCK_WORDS}, {fx.DUCK_TEXT_CATALOG}, {PAIRS},
nb0 as (select page_number, page_index, line_number, word_number, text as raw_text, x0, y0, x1, y1, 0 as pass from fx_words union all select *, 1 from pr), {evaluated("nb0")},
nc as (select * from (select *, row_number() over (partition by page_index, x0, y0, x1, y1, normalized_text, match_status order by pass, line_number, word_number) as n from ev) where n = 1)"""
SUMMARY = f"""{NATIVE}, ps as (select d.doc_id + 1 as page_number, d.doc_id as page_index, coalesce(w.n, 0) as native_word_count, coalesce(c.n, 0) as candidate_count, coalesce(c.e, 0) as exact_match_count, coalesce(c.p, 0) as pattern_match_count
    from documents d left join (select page_number, count(*) n from fx_words group by 1) w on w.page_number = d.doc_id + 1
    left join (select page_number, count(*) n, count(*) filter (match_status = 'reference_exact') e, count(*) filter (match_status = 'reference_pattern') p from nc group by 1) c on c.page_number = d.doc_id + 1)"""
CLASS = "case when embedded_word_count > 0 and image_count > 0 then 'mixed' when embedded_word_count > 0 then 'embedded_text' when image_count > 0 and largest_image_coverage >= 0.75 then 'likely_scanned' when image_count > 0 then 'image_only' else 'vector_or_empty' end"
ROUTED = f"""{fx.DUCK_PAGES}, pv as (select doc_id, page_number, page_number % 11 = 0 as failed, page_number % 11 <> 0 and page_number % 5 = 0 as contains_pole_drawing, page_number % 11 <> 0 and page_number % 13 = 0 as contains_facility_ids,
    case when page_number % 11 = 0 then 0.0 when page_number % 3 = 0 then 0.95 else 0.5 end::double as confidence, case when page_number % 11 = 0 then '' else 'page ' || page_number end as reason from fx_pages),
rt as (select *, failed or contains_pole_drawing or contains_facility_ids or confidence < 0.9 as relevant_for_tiles from pv)"""
assert PREVIEW  # its cases are what ``pv`` states


def starts(length: str) -> str:
    """Tile starts of one side: 576 points long, 489.6 apart."""
    steps = f"ceil(({length} - 576.0) / 489.6)::int"
    regular = f"list_transform(range(0, greatest({steps} - 1, 0) + 1), lambda q: q * 489.6::double)"
    return f"case when {length} <= 576.0 then [0.0::double] else case when {length} - 576.0 - list_max({regular}) > 0.01 then list_append({regular}, {length} - 576.0) else {regular} end end"


PARSED = """with {r}, {p} select page_number, tile_index, ((pos - 1) // 50)::bigint as reply, ((pos - 1) % 50 + 1)::int as pos, raw_text, label_text, 'unknown' as context_type, round(round(model_confidence * 100) / 100, 4) as model_confidence,
    case when pos % 5 = 0 then false else model_reports_complete end as model_reports_complete, model_reports_edge_clipped, {e} as explicit_pole_context from fx_readings""".format(
    r=fx.DUCK_CATALOG, p=fx.DUCK_READINGS, e=f"{EXPLICIT.format(norm('label_text'))} or {EXPLICIT.format(norm('raw_text'))}"
)
STATE = f"""{fx.DUCK_JOBS}, born as (select job_id, min(seq) as born from fx_jobs where event = 'queued' group by 1),
st as (select job_id, arg_max(event, seq) filter (event <> 'progress') as status, arg_max('event ' || event_id, seq) filter (event = 'progress') as detail, arg_max('event ' || event_id, seq) filter (event = 'failed') as error, max(seq) as last_seq
    from fx_jobs join born using (job_id) where seq >= born group by 1)"""

SQL: dict[str, str] = {
    "catalog_load": f"with {fx.DUCK_CATALOG} select * from fx_catalog",
    "catalog_summary": f"""with {fx.DUCK_CATALOG}, i as (select pole_id_normalized, count(*) n, count(*) filter (x is not null and y is not null) p from fx_catalog group by 1), s as (select source_id, count(*) n from fx_catalog group by 1)
        select sum(n)::bigint as record_count, count(*) as unique_id_count, count(*) filter (n > 1) as duplicate_id_count, sum(p)::bigint as with_coordinates_count, (select count(*) from s where n > 1) as duplicate_source_id_count from i""",
    "catalog_shapes_top20": f"with {fx.DUCK_CATALOG} select {shape('pole_id_normalized')} as shape, count(distinct pole_id_normalized) as id_count from fx_catalog group by 1 order by 2 desc, 1 limit 20",
    "catalog_leading_letters": f"with {fx.DUCK_CATALOG} select distinct left(pole_id_normalized, 1) as letter from fx_catalog",
    "catalog_coordinates": f"with {fx.DUCK_CATALOG}, {COORDINATES} select * from coord",
    "catalog_neighbourhood": f"with {fx.DUCK_CATALOG}, {NEIGHBOURS} select nid.pole_id, coalesce(len(neighbours), 0)::int as neighbour_count, coalesce({listed('neighbours[1:12]')}, '') as first_neighbours from nid left join nb using (pole_id)",
    "catalog_records": f"""with {fx.DUCK_CATALOG}, m as (select *, case when source_id like 'T%' then 'T' else 'S' end as system from fx_catalog), n as (select pole_id_normalized, count(*) as match_count from m group by 1),
        u as (select pole_id_normalized, system, x, y, min(pole_id_raw) as pole_id_raw from m group by all)
        select pole_id_normalized as pole_id, match_count, (row_number() over (partition by pole_id_normalized order by system, x nulls first, y nulls first) - 1)::int as place, system as source_id, pole_id_raw, x, y from u join n using (pole_id_normalized)""",
    "catalog_by_source": f"""with {fx.DUCK_CATALOG} select substr(source_id, 2) as source_id, (row_number() over (partition by substr(source_id, 2) order by pole_id_normalized, pole_id_raw, x nulls first, y nulls first) - 1)::int as place,
        pole_id_normalized, pole_id_raw, x, y from fx_catalog""",
    "catalog_duplicates": f"with {fx.DUCK_CATALOG} select pole_id_normalized, count(*) as n from fx_catalog group by 1 having count(*) > 1",
    "exact_match": f"with {R} select {TILE}, pos, raw_text, source_id, x, y from fx_readings join fx_catalog on pole_id_normalized = {norm('raw_text')}",
    "exact_match_outer": f"""with {R}, g as (select pole_id_normalized, count(*) n, {listed('list_sort(list(distinct source_id))')} s from fx_catalog group by 1)
        select {TILE}, pos, {norm('raw_text')} as candidate_normalized, case when n is null then 'not_found' else 'reference_exact' end as match_status, coalesce(n, 0) as match_count, s as source_ids from fx_readings left join g on pole_id_normalized = {norm('raw_text')}""",
    "native_words": f"with {fx.DUCK_WORDS} select page_number, line_number::int as line_number, word_number::int as word_number, {norm('text')} as normalized_text, x0, y0, x1, y1 from fx_words where {norm('text')} <> ''",
    "native_single_tokens": f"with {fx.DUCK_WORDS}, {fx.DUCK_TEXT_CATALOG}, w1 as (select *, text as raw_text from fx_words), {evaluated('w1')} select page_number, line_number::int as line_number, word_number::int as word_number, normalized_text, match_status, match_count from ev",
    "native_adjacent_pairs": f"with {fx.DUCK_WORDS}, {PAIRS} select page_number, line_number::int as line_number, word_number::int as word_number, raw_text, x0, y0, x1, y1 from pr",
    "native_candidates": f"with {NATIVE} select page_number, raw_text, normalized_text, match_status, match_count, matched_source_ids, x0, y0, x1, y1 from nc",
    "native_page_summary": f"with {SUMMARY} select * from ps",
    "native_totals": f"""with {SUMMARY} select (select count(*) from ps) as page_count, (select sum(native_word_count)::bigint from ps) as native_word_count, count(*) filter (match_status = 'reference_exact') as exact_match_occurrence_count,
        count(*) filter (match_status = 'reference_pattern') as pattern_candidate_count, coalesce({listed("list_sort(list(distinct normalized_text) filter (match_status = 'reference_exact'))")}, '') as exact_unique_pole_ids,
        coalesce((select {listed('list_sort(list(page_number))')} from ps where native_word_count = 0), '') as pages_without_native_text from nc""",
    "page_classify": f"with {fx.DUCK_PAGES} select doc_id, page_number, embedded_word_count > 0 as has_embedded_text, image_count > 0 as has_images, embedded_word_count = 0 and largest_image_coverage >= 0.75 as likely_scanned_page, {CLASS} as content_type from fx_pages",
    "image_coverage": f"with {fx.DUCK_PAGES} select doc_id, page_number, case when image_count = 0 then 0.0 else round(least(least(image_count, 2) * largest_image_coverage, 1.0), 4) end::double as coverage from fx_pages",
    "page_select": f"""with {fx.DUCK_PAGES}, p as (select *, {CLASS} as content_type, page_number % 7 <> 0 as has from fx_pages),
        q as (select doc_id, page_number, content_type, list_filter([case when has and embedded_word_count = 0 then 'no_native_text' end, case when embedded_word_count = 0 and largest_image_coverage >= 0.75 then 'likely_scanned_page' end,
            case when content_type <> 'embedded_text' then 'content_type:' || content_type end, case when has and page_number % 2 > 0 then 'native_pattern_candidate' end,
            case when content_type = 'embedded_text' and (not has or page_number % 3 = 0) then 'embedded_text_without_exact_match' end], lambda x: x is not null) as r from p)
        select doc_id, page_number, content_type, {listed('r')} as reasons from q where len(r) > 0""",
    "preview_route": f"with {ROUTED} select doc_id, page_number, contains_pole_drawing, contains_facility_ids, confidence, reason, failed, relevant_for_tiles from rt",
    "skipped_pages": f"with {ROUTED} select doc_id, page_number from rt where not relevant_for_tiles",
    "tile_grid": f"""with {fx.DUCK_PAGES}, a as (select doc_id, page_number, width_points, height_points, {starts('height_points')} as ys, {starts('width_points')} as xs from fx_pages),
        b as (select *, unnest(range(len(ys))) as r from a), c as (select *, unnest(range(len(xs))) as c from b)
        select doc_id, page_number, (r * len(xs) + c + 1)::int as tile_index, (r + 1)::int as tile_row, (c + 1)::int as tile_column, round(xs[c + 1], 3) as x0, round(ys[r + 1], 3) as y0,
            round(least(xs[c + 1] + 576.0, width_points), 3) as x1, round(least(ys[r + 1] + 576.0, height_points), 3) as y1 from c""",
    "reply_parse": PARSED,
    "reply_salvage": PARSED,
    "explicit_pole_label": f"with {R} select {TILE}, pos, raw_text, label_text, {EXPLICIT.format(norm('label_text'))} or {EXPLICIT.format(norm('raw_text'))} as explicit_pole_context from fx_readings",
    "prefix_removal": f"with {R}, {SPELLED} select {TILE}, pos, norm, {shape('norm')} as shape, unknown as unknown_body, joined, pbody as body, pname as transformation from rd join r using (norm, explicit_pole_context)",
    "variants": f"with {R}, {SPELLED} select {TILE}, pos, phase::int as phase, text, penalty::int as penalty, {listed('steps')} as steps from rd join r0 using (norm, explicit_pole_context) join v using (tid)",
    "resolve": f"""with {R}, {RESOLVED} select {TILE}, pos, raw_normalized_text, status, resolution_method, resolved_pole_id, {listed('transformations')} as transformations, {listed('candidate_variants')} as candidate_variants, match_count::bigint as match_count,
        {listed('matched_source_ids')} as matched_source_ids, resolution_confidence, f_suffix_agrees, len(near) as id_neighborhood_count, {listed('near[1:12]')} as id_neighborhood_ids,
        case when status in ('reference_exact', 'reference_resolved') then len(near) > 0 or toggled else status = 'reference_ambiguous' end as requires_spatial_confirmation from res""",
    "resolve_status_counts": f"with {R}, {RESOLVED} select status, resolution_method, count(*) as readings from res group by 1, 2",
    "ambiguous_readings": f"with {R}, {RESOLVED} select {TILE}, pos, raw_text, {listed('list_transform(range(1, len(found) + 1), lambda i: found[i] || chr(58) || (10000 - penalties[i]))')} as ranked from res where status = 'reference_ambiguous'",
    "tile_dedupe": f"with {R}, {CANDIDATES} select {TILE}, pos, normalized_text, catalog_match_status, match_count::bigint as catalog_match_count from cand",
    "evidence_rules": f"with {R}, {JUDGED} select {TILE}, pos, normalized_text, {listed('review_reasons')} as review_reasons, acceptance_status from jud",
    "visual_dedupe": f"""with {R}, {JUDGED} select normalized_text as pole_id, {listed('list_sort(list(distinct page_number))')} as pages, count(*) as tile_observation_count, round(max(model_confidence), 4) as maximum_model_confidence, max(match_count)::bigint as catalog_match_count,
        {listed('list_sort(list_distinct(flatten(list(matched_source_ids))))')} as matched_source_ids from jud where catalog_match_status = 'reference_exact' and acceptance_status = 'accepted' group by 1""",
    "visual_totals": f"""with {R}, {JUDGED} select count(*) as candidate_observation_count, count(*) filter (catalog_match_status = 'reference_exact') as exact_candidate_observation_count,
        count(*) filter (catalog_match_status = 'reference_exact' and acceptance_status = 'accepted') as accepted_candidate_observation_count, count(*) filter (acceptance_status = 'review') as review_candidate_observation_count,
        count(distinct normalized_text) filter (catalog_match_status = 'reference_exact' and acceptance_status = 'accepted') as exact_unique_id_count,
        (select count(*) from res where status = 'ignored' and len(raw_normalized_text) between 1 and 32 and regexp_matches(raw_normalized_text, '[\\p{{L}}\\p{{N}}]')) as ignored_candidate_observation_count from jud""",
    "unmatched_ids": f"with {R}, {JUDGED} select distinct normalized_text from jud where catalog_match_status <> 'reference_exact' and normalized_text <> ''",
    "review_queue": f"with {R}, {JUDGED} select page_number, reason, count(*) as observations from (select page_number, unnest(review_reasons) as reason from jud) group by 1, 2",
    "merge_poles": f"with {R}, {POLES} select * from poles",
    "accepted_with_coordinates": f"with {R}, {POLES} select pole_id, x, y, confidence from poles left join coord using (pole_id)",
    "accepted_poles_by_page": f"""with {R}, {JUDGED}, {COORDINATES} select page_number as page, normalized_text as pole_id, any_value(x) as x, any_value(y) as y, count(*) as tile_observation_count, round(max(model_confidence), 4) as maximum_model_confidence
        from jud join coord on pole_id = normalized_text where catalog_match_status = 'reference_exact' and acceptance_status = 'accepted' group by 1, 2""",
    "discovery_status": f"""with {R}, {POLES}, t as (select (select count(*) from poles) as accepted_pole_count, count(*) filter (acceptance_status = 'review') as review_candidate_count from jud)
        select case when review_candidate_count > 0 then 'needs_review' when accepted_pole_count > 0 then 'completed' else 'no_poles_found' end as status, * from t""",
    "permit_numbers": f"with {REQUESTS} select doc_id, number, number || '-2026' as permit_number from num",
    "permit_rows": f"""with {R}, {PERMIT_POLES} select num.doc_id, number || '-2026' as permit_number, count(*) filter (pole_owner = 'City') as totalcitypolecount, count(*) filter (pole_owner = 'Foreign') as foreignpolecount, 'Needs Review' as polereviewstatus
        from num left join placed using (doc_id) group by 1, 2""",
    "pole_rows": f"with {R}, {PERMIT_POLES} select doc_id, number || '-2026' as permit_number, '{{' || regexp_replace(upper(md5('permit ' || number || '-2026')), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '}}' as permit_globalid, pole_id, pole_owner, confidence, case when confidence >= 0.85 then 'Approved' else 'Needs Review' end as status, x, y, 3734::int as wkid from placed join num using (doc_id)",
    "work_area_bbox": f"with {R}, {PERMIT_POLES} select doc_id, round(min(x) - 50, 4) as min_x, round(max(x) + 50, 4) as max_x, round(min(y) - 50, 4) as min_y, round(max(y) + 50, 4) as max_y from placed group by 1",
    "work_area_size": f"""{SIZES}""",
    "field_resolution": f"""with {R}, {PERMIT_POLES} select number || '-2026' as "Permit_Number", pole_id as "POLE_ID", pole_owner as "Pole_Owner", confidence as "Confidence", case when confidence >= 0.85 then 'Approved' else 'Needs Review' end as "STATUS", x as "X", y as "Y"
        from placed join num using (doc_id)""",
    "message_text": """select 'user' || user_id || '@example.com' as to_address, case when event_type = 'view' then 'New message on permit ' || event_id || ' -2026' else 'New message on your request' end as subject,
        'Reviewer ' || event_type || ' wrote:' || chr(10) || chr(10) || props as content from events where event_type <> 'click'""",
    "pdf_validate": """with f as (select event_id, event_id || case when event_id % 7 = 0 then '.txt' when event_id % 2 = 0 then '.PDF' else '.pdf' end as name from events)
        select event_id, case when event_id % 7 = 0 then 'the file must have a .pdf extension: ' || name when event_id % 5 = 0 then 'the PDF is empty: ' || name when event_id % 11 = 0 then 'the PDF is 600.00 MB; at most 500 MB are allowed'
            when event_id % 3 = 0 then 'no valid PDF header: ' || name end as error from f""",
    "job_state": f"with {STATE} select * from st",
    "job_view": f"with {STATE} select job_id, status, case when status = 'failed' then error end as error, case when status in ('queued', 'processing') then detail end as detail from st",
    "progress_running_count": f"with {R}, {CANDIDATES} select {TILE}, candidate_count, sum(candidate_count) over (order by {TILE} rows unbounded preceding)::bigint as found_so_far from (select {TILE}, count(*) as candidate_count from cand group by {TILE})",
}
