"""DuckDB SQL for the queries of the dependency graph.

Edges of the generated graphs come from their key relations, not from their texts.
"""

from __future__ import annotations

from . import fixtures
from .queries import TARGET


def values(rows, columns: str) -> str:
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"


MODULES = r"""
m as (select p_partkey as k, case when p_partkey = 5 then 'src/main' when p_partkey = 6 then 'src/server'
        else 'src/' || lower(p_type) || '/p' || p_partkey || case p_partkey % 10 when 0 then '.service' when 1 then '.component' when 2 then '.routes' when 3 then '.util' when 4 then '.spec' else '' end end as base from part),
mods as (select k, base, base || '.ts' as path, case when k in (5, 6) then './' else '../' end as up from m),
rel as (select a.k, i, b.k as t, a.path as source, b.path as target, a.up || substr(b.base, 5) as raw, case when i = 2 then 'type_only' else 'runtime' end as nature
        from mods a join range(1, 5) r(i) on i <= a.k % 4 or i = 4 and a.k % 8 = 7 join mods b on b.k = 50 * (a.k // 50) + ((a.k % 50) * 3 + 17 * case i when 4 then 2 else i end + 1) % 50),
edges as (select source, target, case when bool_or(nature = 'runtime') then 'runtime' else 'type_only' end as import_nature from rel group by 1, 2),
fans as (select path, (select count(*) from edges e where e.target = path) as fan_in, (select count(*) from edges e where e.source = path) as fan_out from mods)
"""
META = r"""
meta as (select path, case when contains(path, '.service.') then 'Service' when contains(path, '.component.') then 'Component' when contains(path, '.routes.') then 'Module' when contains(path, 'util') then 'Helper' else 'Other' end as node_type,
         k in (5, 6) as is_entrypoint, case k when 5 then 'browser_bootstrap' when 6 then 'server_http' else 'none' end as entrypoint_kind,
         cast(case k when 5 then 0.95 when 6 then 0.9 else 0 end as double) as entrypoint_confidence, contains(path, '.spec.') as is_test from mods)
"""
SHOWN = r"""
shown as (select path, split_part(path, '/', -1) as label, case when path like '%service.ts' then 'Service' when path like '%component.ts' then 'Component' when regexp_matches(path, '(module|routes?|config)(\.|/)') then 'Module' else 'Other' end as type from mods)
"""
W = f"with {MODULES}"
SMALL = f"""
s as (select k, 'src/' || folder || name || '.ts' as path, '../' || folder || name as raw from (select cast(n_nationkey as bigint) as k, 'z' || n_regionkey || '/' as folder,
        case n_nationkey when 8 then 'main' when 24 then 'server' else 'n' || n_nationkey || case n_nationkey % 5 when 0 then '.service' when 1 then '.component' when 2 then '.module' when 4 then '.util' else '' end end as name from nation)),
e as (select a.path as source, b.path as target, a.k as sk, b.k as tk, b.raw, i, case (a.k + b.k) % 3 when 0 then 'called' when 1 then 'typed' else 'instantiated' end as kind
      from s a join {values([(i, *r) for i, r in enumerate(fixtures.SMALL_RULES)], "i, m, c, x, y").replace(" v(", " r(")} on a.k % m = c join s b on b.k = (x * a.k + y) % 25 where a.k <> b.k),
f as (select s.*, case when contains(path, '.service.') then 'Service' when contains(path, '.component.') then 'Component' when contains(path, '.module.') then 'Module' when contains(path, '.util.') then 'Helper' else 'Other' end as node_type from s),
small_text as (select s.path, coalesce((select string_agg('import {{ N' || tk || ' }} from ' || chr(39) || e.raw || chr(39) || ';' || chr(10), '' order by i) || string_agg(case kind when 'called' then 'N' || tk || '();' when 'typed' then 'let v: N' || tk || ';' else 'new N' || tk || '();' end || chr(10), '' order by i) from e where e.source = s.path), '')
        || case when k % 2 = 0 then 'export interface N' || k || ' {{ id: number }}' else 'export class N' || k || ' {{}}' end || chr(10) as content from s)
"""
UP = "up(seed, path) as (select source, target from e union select up.seed, e.target from up join e on e.source = up.path)"
BOUNDS = W + r""", files as (select path from mods union all select * from (values ('src/medium/index.ts'), ('src/large/index.ts'), ('src/large/public-api.ts')) b(path)),
bounds as (select path, case when array_length(string_split(path, '/')) > 2 then 'src/' || split_part(path, '/', 2) else 'src' end as boundary from files),
named as (select path, boundary, case boundary when 'src/medium' then 'src/medium/index.ts' when 'src/large' then 'src/large/public-api.ts' end as barrel from bounds)
"""
DIFF = W + """, stamped as (select k, path from mods),
diff as (select path, case when k % 7 = 0 then 'added' when k % 11 = 0 then 'deleted' when k % 13 = 0 and k > -1 then 'changed' else 'reused' end as status from stamped where not (k % 7 = 0 and k % 11 = 0))
"""
#: Walks over ever greater files than their first, which are cycles where an edge leads back.
WALKS = """w(first, last, walk) as (select source, target, [source, target] from e where source < target union all
    select w.first, e.target, list_append(w.walk, e.target) from w join e on e.source = w.last where e.target > w.first and not list_contains(w.walk, e.target)),
cyc as (select row_number() over () as id, walk from w join e on e.source = w.last and e.target = w.first)
"""


def cuts(which: str) -> str:
    """cut: of each cycle that the condition takes, its cheapest edge."""
    return f"""picked as (select * from cyc where {which}),
steps as (select id, walk[i] as source, walk[i % len(walk) + 1] as target from picked, range(1, 20) r(i) where i <= len(walk)),
layers as (select path, node_type, case node_type when 'Helper' then 0 when 'Other' then 2 when 'Service' then 3 when 'Component' then 4 else 5 end as layer from f),
priced as (select id, e.*, case when kind = 'typed' and tk % 2 = 0 then 'type_only_import' when a.layer < b.layer then 'architectural_inversion' else 'extract_shared' end as strategy
           from steps join e using (source, target) join layers a on a.path = source join layers b on b.path = target),
chosen as (select *, case strategy when 'type_only_import' then 10 when 'architectural_inversion' then 35 else 60 end as cut_cost from priced),
cut as (select source, target, tk, strategy, cast(cut_cost as bigint) as cut_cost, count(*) as cycles_eliminated from (select *, row_number() over (partition by id order by cut_cost, source, target) as place from chosen) where place = 1 group by all)
"""


#: Properties of the types of the generated modules: own ones, of S with those of the module before, and of all three types.
SHAPES = """
own as (select k, path, unnest(['id', 'size' || k % 7, 'owner', 'owner.name', 'owner.tag' || k % 3, 'load']) as p from mods),
lent as (select k, path, p from own union select a.k, a.path, b.p from mods a join own b on b.k = a.k - 1 where a.k % 5 <> 0),
props as (select path, 'S' || k as type_name, p from lent union select path, t || k, p from (select k, path, p from lent union all select k, path, 'note' from mods) cross join (values ('A'), ('P')) n(t)),
shapes as (select path, type_name, string_agg(p, ',' order by p) as props from props group by all)
"""
MISSED = "list_transform(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx'], lambda x: regexp_replace(path, '[^/]*$', '') || 'missing' || k || x)"
SAID = "concat_ws(chr(31), {})"


def oracle_sql() -> dict[str, str]:
    target = f"(select path from s where k = {TARGET})"
    lists = lambda sql: f"(select coalesce(string_agg(path, ',' order by path), '') from ({sql}) where path <> {target})"
    up, down = f"select distinct path from up where seed = {target}", f"select distinct seed as path from up where path = {target}"
    recursive, small = W.replace("with", "with recursive", 1), f"with recursive {SMALL}, {UP}, {WALKS}"
    return {
        "import_occurrences": W + """, every as (select source as path, i as o, raw, nature from rel union all select path, 5, '@vendor/kit', 'runtime' from mods where k % 3 = 0 union all select path, 6, './missing' || k, 'runtime' from mods where k % 5 = 0)
            select path, row_number() over (partition by path order by o) - 1 as pos, raw as raw_import, nature as import_nature from every""",
        "href_occurrences": """select page_id, cast(generate_subscripts(h, 1) - 1 as bigint) as pos, unnest(h) as href from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as h from pages)""",
        "resolved_edges": W + "select source, target from edges",
        "edge_natures": W + "select source, target, import_nature from edges",
        "unresolved_imports": W + "select path as importer, './missing' || k as raw_import, cast(9 as bigint) as n_attempted, regexp_replace(path, '[^/]*$', '') || 'missing' || k || '.ts' as second_attempt from mods where k % 5 = 0",
        "external_imports": W + "select path as importer, '@vendor/kit' as raw_import from mods where k % 3 = 0",
        "edge_resolution": W + "select source, target, raw as raw_import, 'resolved_with_assumption' as status, 'extension_match' as method, cast(0.95 as double) as confidence from rel",
        "resolved_import_lists": W + "select path, coalesce(string_agg(target, ',' order by i), '') as targets from mods left join rel on source = path group by path",
        "fan_in_out": W + "select path, fan_in, fan_out from fans",
        "node_metadata": f"{W}, {META} select path, node_type, is_entrypoint, entrypoint_kind, entrypoint_confidence, is_test from meta",
        "http_node_types": f"{W}, {SHOWN} select substr(path, 5) as id, substr(path, 5) as path, label, type from shown",
        "node_badges": f"{W}, {SHOWN} select case type when 'Service' then 'bg-emerald-600 text-white' when 'Component' then 'bg-sky-600 text-white' when 'Module' then 'bg-purple-600 text-white' else 'bg-slate-600 text-white' end as badge, count(*) as n from shown group by 1",
        "node_labels": W + "select path, 'T' || k as label from mods",
        "alias_resolution": W + """, asked as (select *, case k % 4 when 0 then '@mod/' || substr(base, 5) when 1 then '@mod/x/../' || substr(base, 5) when 2 then '@mod/large/gone' || k else case when k % 8 = 3 then '@boot' else '@bootstrap' end end as raw_import from mods)
            select path, raw_import, case when k % 4 < 2 or k % 8 = 3 then 'resolved' when k % 4 = 2 then 'unresolved' else 'external' end as kind, case when k % 4 < 2 then path when k % 8 = 3 then 'src/main.ts' end as target,
            cast(case when k % 4 < 3 then 9 when k % 8 = 3 then 1 else 0 end as bigint) as n_attempted, case when k % 4 = 2 then 'alias_candidate_not_found' end as reason from asked""",
        "boundaries": BOUNDS + "select path, boundary, barrel from named",
        "boundary_lists": BOUNDS + "select boundary, barrel, count(*) as n_files, min(path) as first_file from named group by 1, 2",
        "graph_summary": f"""{W}, {META} select count(*) as files, count_if(is_entrypoint) as entrypoints, count_if(is_test) as tests, (select count_if(fan_in = 0) from fans) as unreferenced, (select max(fan_in) from fans) as max_fan_in, (select max(fan_out) from fans) as max_fan_out,
            (select count(*) from edges) as edges, (select count_if(import_nature = 'runtime') from edges) as runtime_edges, (select count_if(import_nature = 'type_only') from edges) as type_only_edges, (select count(*) from rel) as resolved_imports, (select count_if(k % 5 = 0) from mods) as unresolved_imports,
            (select count_if(k % 3 = 0) from mods) as external_imports, (select count(distinct split_part(path, '/', 1)) from mods) as boundaries, 3 * count(*) as type_shapes, cast(0 as bigint) as alias_rules from meta""",
        "diagnostics": W + "select (select count_if(k % 5 = 0) from mods) as unresolved_imports, (select count_if(k % 3 = 0) from mods) as external_imports, cast(0 as bigint) as skipped_files, cast(0 as bigint) as ambiguous_resolutions, (select count_if(fan_in = 0) from fans) as unreferenced_files",
        "node_stats": f"{W}, {SHOWN} select count(*) as total, " + ", ".join(f"count_if(type = '{t}') as {t.lower()}" for t in ("Service", "Component", "Module", "Helper", "Other")) + ", (select count(*) from edges) as edges from shown",
        "default_node": f"{W}, {SHOWN} select path as id, path, label, type from shown where path = 'src/server.ts' union all select path, path, label, type from shown where path = (select min(path) from shown)",
        "filtered_nodes": f"{W}, {SHOWN} select path as id, path, label, type from shown where type = 'Service' and path ilike '%large/p1%'",
        "neighbours": W + "select 'imports' as direction, target as path from edges where source = 'src/main.ts' union select 'imported_by', source from edges where target = 'src/main.ts'",
        "impact_upstream": recursive + ", up(seed, path) as (select source, target from edges join mods on path = source where k % 7 = 0 union select up.seed, e.target from up join edges e on e.source = up.path) select seed, path from up",
        "impact_downstream": W.replace("with", "with recursive", 1) + ", d(path) as (select source from edges where target = 'src/main.ts' union select source from edges join d on target = d.path) select path from d where path <> 'src/main.ts'",
        "trade_closure": """with recursive q as (select c_nationkey as source, s_nationkey as target, sum(l_quantity) as q from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2),
            e as (select cast(source as varchar) as source, cast(target as varchar) as target from (select *, row_number() over (partition by source order by q desc, target) as p from q) where p <= 2), """ + UP + " select seed, path from up",
        "impact_record": f"""{small}, {cuts(f'list_contains(walk, {target})')} select {target} as target, true as exists, {lists(up)} as upstream, {lists(down)} as downstream,
            {lists(f"select target as path from e where source = {target}")} as direct_upstream, {lists(f"select source as path from e where target = {target}")} as direct_downstream,
            (select string_agg(source || ' -> ' || kind || '(N' || tk || ')', ',' order by source) from e where target = {target}) as semantic_usages,
            (select coalesce(max(seed), '') from up where seed = {target} and path = seed) as circular_references, {lists(f"select path from ({down}) where path like '%/main.ts' or path like '%/server.ts'")} as affected_entrypoints, false as target_is_entrypoint, false as target_is_test,
            (select count(*) from e where target = {target}) as target_fan_in, (select count(*) from e where source = {target}) as target_fan_out, 'medium' as change_risk_level, 'high_fan_in' as change_risk_reasons,
            (select count(*) from ({up}) where path <> {target}) as upstream_count, (select count(*) from ({down}) where path <> {target}) as downstream_count,
            (select count(*) from picked) as total_cycles, (select count(*) from cut) as total_cuts_required, true as all_cycles_resolvable, (select string_agg(source || ' ' || target || ' ' || strategy, ',' order by cut_cost, source, target) from cut) as cuts""",
        "impact_from_root": f"{small} select path, node_type, (select count(*) from e where e.target = f.path) as fan_in, path as target, {lists(down)} as downstream from f where k = {TARGET}",
        "outline": f"{W}, {SHAPES} select type_name, props from shapes where path = 'src/main.ts'",
        "cycle_members": recursive + ", e as (select source, target from edges), " + UP + " select path from up where seed = path",
        "cycle_components": small + "select a.seed as path, max(a.path) as component from up a join up b on a.path = b.seed and b.path = a.seed group by 1",
        "simple_cycles": small + "select array_to_string(walk, ' > ') as cycle, true as complete from cyc",
        "cycle_guard": small + """, asked as (select sk * 25 + tk as op_seq, target as source, source as target, case when sk % 2 = 0 then 'inferential' else 'related' end as kind from e union all select 1000 + k, path, 'src/new.ts', 'inferential' from s where k in (0, 9, 21, 23))
            select *, kind = 'related' or not exists (select 1 from up where seed = asked.target and up.path = asked.source) as accepted from asked""",
        "cut_advice": f"""{small}, {cuts('true')} select source, target, strategy, cut_cost, case strategy when 'type_only_import' then 'trivial' when 'architectural_inversion' then 'low' else 'medium' end as effort, cycles_eliminated, 'N' || tk as symbols,
            case strategy when 'type_only_import' then regexp_replace(target, '[.]ts$', '.types.ts') else regexp_replace(target, '[^/]*$', '') || split_part(split_part(target, '/', -1), '.', 1) || '.shared.ts' end as suggested_leaf, cast(case strategy when 'architectural_inversion' then 2 else 1 end as bigint) as n_steps from cut""",
        "orphans": f"{W}, {META} select path as file, 'potential_orphan' as type, 'low' as severity, fan_in, fan_out from fans join meta using (path) where fan_in = 0 and not is_entrypoint and not is_test",
        "entrypoints": f"{W}, {META} select path as file, 'info' as severity, entrypoint_kind, entrypoint_confidence as confidence, fan_in, fan_out from fans join meta using (path) where is_entrypoint",
        "findings_summary": f"{W}, {META} select 'orphan' as analyzer, 'low' as severity, count(*) as n_findings from fans join meta using (path) where fan_in = 0 and not is_entrypoint and not is_test union all select 'entrypoint', 'info', count(*) from meta where is_entrypoint",
        "semantic_usages": W + """select source, target, 'T' || t as symbol, case when i = 2 or k % 3 = 2 then 'typed' when k % 3 = 0 then 'called' else 'instantiated' end || '(T' || t || ')' as usage from rel where i < 3""",
        "usage_lines": small + "select target, source || ' -> ' || kind || '(N' || tk || ')' as line from e",
        "analyzer_envelope": f"{W}, {META} select (select count(*) from fans join meta using (path) where fan_in = 0 and not is_entrypoint and not is_test) + (select count_if(is_entrypoint) from meta) as total_findings, cast(2 as bigint) as analyzers_run, cast(0 as bigint) as analyzers_failed, '' as errors",
        "type_shapes": f"{W}, {SHAPES} select path, type_name, props from shapes",
        "united_shapes": f"{W}, {SHAPES} select t || k as type_name, string_agg(p, ',' order by p) as props from (select 'S' as t, k, p from own union all select t, k, p from (select k, p from own union all select k, 'note' from mods) cross join (values ('A'), ('P')) n(t)) group by 1",
        "tree_manifest": small + "select path, strlen(content) as size, true as stamped from small_text",
        "tree_sources": small + "select path, length(content) as n_chars from small_text",
        "tree_aliases": "select cast(o as bigint) as ord, pattern, target, pattern <> '@main' as wildcard from " + values([(0, "@z/z0/", "src/z0"), (1, "@main", "src/z2/main.ts"), (2, "@z/", "src")], "o, pattern, target"),
        "snapshot_edges": small + "select source, target, 'runtime' as import_nature from e",
        "graph_document": small + "select '1.0.0' as schema_version, true as stamped, (select count(*) from s) as vertices, (select count(*) from e) as edges, (select count(distinct split_part(path, '/', 1)) from s) as boundaries, (select count_if(k % 2 = 0) from s) as type_shapes, (select count(*) from e) as summary_edges",
        "topology_document": small + "select source, target, case when source like '%service.ts' then 'Service' when source like '%component.ts' then 'Component' when source like '%.module.ts' then 'Module' else 'Other' end as source_type from e",
        "manifest_diff": DIFF + "select path, status from diff",
        "cache_status": DIFF + """select 'auto' as mode, 'partial' as status, count_if(status <> 'deleted') as files_discovered, count_if(status = 'reused') as files_reused, count_if(status in ('added', 'changed')) as files_read,
            count_if(status = 'added') as files_added, count_if(status = 'changed') as files_changed, count_if(status = 'deleted') as files_deleted, count_if(status = 'reused') / count_if(status <> 'deleted') as hit_ratio from diff""",
        "graph_signature": f"""{W}, {META}, {SHAPES}, said as (select {SAID.format("'node', path, node_type, is_entrypoint, entrypoint_kind, cast(round(entrypoint_confidence * 100) as int), is_test, fan_in, fan_out")} as r from meta join fans using (path)
            union all select {SAID.format("'edge', source, target, import_nature")} from edges union all select {SAID.format(f"'unresolved', path, './missing' || k, array_to_string({MISSED}, ','), ''")} from mods where k % 5 = 0
            union all select {SAID.format("'external', path, '@vendor/kit'")} from mods where k % 3 = 0 union all select {SAID.format("'boundary', path, 'src', ''")} from mods union all select {SAID.format("'shape', path, type_name, props")} from shapes),
            hashed as (select sha256(r) as d from said)
            select 'sha256:' || sha256(concat_ws(':', count(*), sum(cast('0x' || substr(d, 1, 15) as bigint)), sum(cast('0x' || substr(d, 16, 15) as bigint)))) as signature from hashed""",
    }
