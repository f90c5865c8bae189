"""The SQL that each query is held against, written apart from the DataFrame code."""

from __future__ import annotations

BASE = {
    "occ": "SELECT 'nation_' || s_nationkey AS bc, p_brand AS func, count(*)::BIGINT AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "pkg": """SELECT r_name AS name, r_regionkey % 2 = 0 AS fetched, CASE r_regionkey % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'nobc' ELSE 'notbuilt' END AS build_result, list(n_name ORDER BY n_nationkey) AS libs
      FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name, r_regionkey""",
    "ce": """SELECT 'p' || l_orderkey || '_' || l_linenumber AS edge_id, 'order_' || l_orderkey AS caller, 'part_' || l_partkey AS callee FROM lineitem
      UNION ALL SELECT 'o' || o_orderkey, 'customer_' || o_custkey, 'order_' || o_orderkey FROM orders
      UNION ALL SELECT 'c' || c_custkey, 'nation_' || c_nationkey, 'customer_' || c_custkey FROM customer
      UNION ALL SELECT 'n' || n_nationkey, 'region_' || n_regionkey, 'nation_' || n_nationkey FROM nation""",
    "ev": """SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id, week) - 1 AS last FROM
      (SELECT event_id, user_id, ts, event_type AS kind, (props->>'k')::INTEGER AS k, floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 7)::BIGINT AS week FROM events)""",
    "op": """SELECT *, min(CASE WHEN kind = 'purchase' THEN idx END) OVER (PARTITION BY user_id, week) AS t,
      CASE WHEN kind = 'purchase' THEN 'Call' WHEN idx = last THEN 'Ret' WHEN k % 11 = 0 AND kind <> 'signup' THEN 'Store' WHEN kind = 'signup' THEN 'Call' WHEN kind = 'error' THEN 'CondBr'
      WHEN kind = 'click' THEN 'ICmp' WHEN k % 13 = 0 THEN 'GEP' WHEN k % 17 = 0 THEN 'Bin' ELSE 'Load' END AS op FROM ev""",
    "ti": """SELECT 'purchase' AS target, 'pkg' || user_id % 3 AS bc, user_id::BIGINT AS slice_id, week AS trace_id, idx::INTEGER AS idx, coalesce(idx = t, false) AS is_target,
      'src/u' || user_id || '.c:' || k || ':' || idx AS loc, op, CASE WHEN op = 'Call' THEN CASE kind WHEN 'purchase' THEN 'purchase' ELSE 'f' || k % 7 END END AS func,
      CASE WHEN op = 'Call' THEN ['{"Sym":' || k % 10 || '}'] END AS args, CASE WHEN op = 'ICmp' THEN CASE k % 2 WHEN 0 THEN 'EQ' ELSE 'NE' END END AS pred,
      CASE WHEN op IN ('ICmp', 'Bin', 'Ret') THEN '{"Sym":' || k % 10 || '}' END AS op0,
      CASE WHEN op = 'ICmp' AND k % 4 = 0 THEN '{"Int":0}' WHEN op IN ('ICmp', 'Bin') THEN '{"Sym":' || k % 7 || '}' END AS op1,
      CASE WHEN op = 'CondBr' THEN '{"ICmp":' || k % 3 || '}' END AS cond, CASE WHEN op = 'CondBr' THEN CASE k % 2 WHEN 0 THEN 'Then' ELSE 'Else' END END AS br,
      op = 'CondBr' AND k % 5 = 0 AS beg_loop, op = 'Load' AND k % 9 = 0 AS end_loop,
      CASE WHEN op IN ('Store', 'Load', 'GEP') THEN '{"Sym":' || k % 10 || '}' END AS mem, CASE WHEN op = 'Store' THEN '{"Sym":' || k % 5 || '}' END AS val,
      CASE WHEN op = 'ICmp' THEN '{"ICmp":' || k % 3 || '}' WHEN op IN ('Call', 'GEP', 'Bin', 'Load') THEN '{"Sym":' || k % 5 || '}' END AS res, k FROM op""",
    "tg": "SELECT target, bc, slice_id, trace_id, idx AS t, res AS r, args AS targs FROM ti WHERE is_target",
    "tt": "SELECT ti.*, t, r, targs, max(idx) OVER (PARTITION BY target, bc, slice_id, trace_id) AS last_idx FROM ti JOIN tg USING (target, bc, slice_id, trace_id)",
    "vec": "SELECT vec_id AS dp_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings",
    "lab": "SELECT doc_id, list_filter([CASE WHEN quality = 0 THEN 'retval-alarm' END, CASE WHEN toxic = 1 THEN 'argrel-alarm' END], lambda l: l IS NOT NULL) AS labels FROM labels",
}
NEEDS = {"op": ["ev"], "ti": ["ev", "op"], "tg": ["ev", "op", "ti"], "tt": ["ev", "op", "ti", "tg"]}
KEY = "target, bc, slice_id, trace_id"


def sql(uses: str, body: str, **more: str) -> str:
    names = list(dict.fromkeys(x for u in uses.split() for x in [*NEEDS.get(u, []), u]))
    parts = [f"{n} AS ({BASE[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return (f"WITH RECURSIVE {', '.join(parts)}\n" if parts else "") + body


def any_(c: str) -> str:
    return f"coalesce(bool_or({c}), false)"


def number(c: str) -> str:
    return f"CASE WHEN {c} = '\"Null\"' THEN 0 ELSE try_cast(nullif(regexp_extract({c}, '^\\{{\"Int\":(-?[0-9]+)\\}}$', 1), '') AS BIGINT) END"


O: dict[str, str] = {}

O["packages_status"] = sql("pkg", "SELECT name, CASE WHEN fetched THEN 'fetched' ELSE 'not fetched' END AS fetch, CASE build_result WHEN 'success' THEN 'built' ELSE build_result END AS build FROM pkg")
O["packages_bc_files"] = sql("pkg", "SELECT name, (i - 1)::INTEGER AS pos, name || '/source/' || libs[i] || '.bc' AS bc FROM (SELECT name, libs, unnest(range(1, len(libs) + 1)) AS i FROM pkg)")
O["packages_build_kind"] = "SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'dpkg' WHEN n_nationkey % 3 = 0 THEN 'config' WHEN n_nationkey % 3 = 1 THEN 'makeonly' ELSE 'unknown' END AS build_type FROM nation"
O["packages_library_names"] = """WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS parts FROM pages), q AS (SELECT page_id, array_to_string(parts[1:greatest(len(parts) - 2, 0)], '_') AS name FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) AS n FROM q) SELECT page_id, name, CASE n WHEN 1 THEN name ELSE name || '_dedup' || (n - 1) END AS lib FROM r"""
O["packages_upsert"] = "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 20 THEN n_name END AS name, CASE WHEN n_nationkey >= 10 THEN 'new' ELSE 'old' END AS state FROM nation"
O["occ_top"] = sql("occ", "SELECT func, sum(n)::BIGINT AS n FROM occ GROUP BY func HAVING sum(n) >= 100 ORDER BY n DESC, func LIMIT 20")
O["occ_page"] = sql("occ", "SELECT func, sum(n)::BIGINT AS n FROM occ GROUP BY func ORDER BY n DESC, func LIMIT 50 OFFSET 5")
TOTAL = "SELECT bc, n FROM hit UNION ALL SELECT 'Total', coalesce(sum(n), 0)::BIGINT FROM hit"
O["occ_function_total"] = sql("occ", TOTAL, hit="SELECT bc, sum(n)::BIGINT AS n FROM occ WHERE func = 'Brand#11' GROUP BY bc")
O["occ_regex_total"] = sql("occ", TOTAL, hit="SELECT bc, sum(n)::BIGINT AS n FROM occ WHERE regexp_matches(func, '^Brand#[12][0-9]') GROUP BY bc")
O["occ_of_package"] = sql("occ", "SELECT * FROM occ WHERE bc IN (SELECT 'nation_' || n_nationkey FROM nation WHERE n_regionkey = 1)")
O["occ_intersection"] = sql("occ", "SELECT func, bc, n FROM occ WHERE bc IN ('nation_1', 'nation_2', 'nation_3') QUALIFY count(*) OVER (PARTITION BY func) = 3")
O["occ_call_sites"] = sql("ce", "SELECT f AS func, count(callee)::BIGINT AS n FROM (SELECT caller AS f FROM ce UNION SELECT callee FROM ce) LEFT JOIN ce ON callee = f GROUP BY f")
O["occ_entries_depth1"] = sql("ce", "SELECT callee, sum(coalesce(up, 1))::BIGINT AS n FROM ce LEFT JOIN (SELECT callee AS caller, count(DISTINCT caller) AS up FROM ce GROUP BY callee) USING (caller) GROUP BY callee")
O["bc_substring_lookup"] = sql("occ", "SELECT part, min(bc) AS bc FROM occ JOIN (VALUES ('_1'), ('_2'), ('zzz')) AS w(part) ON contains(bc, part) GROUP BY part")
O["count_slices"] = sql("ti", "SELECT target, bc, count(DISTINCT slice_id)::BIGINT AS n_slices, count(DISTINCT (slice_id, trace_id))::BIGINT AS n_traces FROM ti GROUP BY target, bc")
O["count_traces"] = sql("tg", "SELECT target, bc, slice_id, count(*)::BIGINT AS n_traces FROM tg GROUP BY ALL")
O["one_per_slice"] = sql("ti", "SELECT target, bc, slice_id, min(trace_id) AS trace_id FROM ti GROUP BY ALL")

O["filter_target_regex"] = "SELECT p_partkey, p_brand || '.' || p_type AS name FROM part WHERE regexp_matches(p_brand, '#[1-3]') AND NOT regexp_matches(p_brand, '2$')"
O["filter_names"] = """WITH e AS (SELECT event_id, ['llvm.dbg.value', '__asan_load', 'printk_once', 'kmalloc', 'a asm b', '%5', '(x)'][event_id % 7 + 1] AS name FROM events)
SELECT event_id, name, NOT contains(name, 'llvm.') AS plain, regexp_matches(name, 'dbg|eh|lifetime') AS dummy, starts_with(name, '__') AND length(name) > 2 OR starts_with(name, 'llvm.') AS legacy,
regexp_matches(name, '__asan|__sanitizer|__kasan|printk') AS sanitizer, left(name, 1) NOT IN ('(', '%') AND NOT contains(name, ' asm ') AS causal, CASE WHEN starts_with(name, 'llvm.') THEN split_part(name, '.', 2) ELSE split_part(name, '.', 1) END AS simple FROM e"""
O["filter_size_guard"] = "SELECT o_custkey, n > 0 AND blocks // nullif(n, 0) < 15 IS TRUE AS kept FROM (SELECT o_custkey, sum(length(o_orderpriority)) AS blocks, count_if(o_orderstatus = 'O') AS n FROM orders GROUP BY o_custkey)".replace("n > 0 AND blocks // nullif(n, 0) < 15 IS TRUE", "coalesce(blocks::BIGINT // nullif(n::BIGINT, 0) < 15, false)")
SHAPE = f"SELECT {KEY}, max(t)::INTEGER AS target_idx, count(*)::BIGINT AS n_instrs, count_if(idx < t)::BIGINT AS n_before, count_if(idx > t)::BIGINT AS n_after FROM tt GROUP BY ALL"
O["trace_shape"] = sql("tt", SHAPE)
O["filter_datapoints"] = sql("tt", "SELECT * FROM sh WHERE bc IN ('pkg0', 'pkg1') AND n_before >= 3 AND slice_id % 5 = 0", sh=SHAPE)
O["filter_min_frequency"] = sql("ce", "SELECT * FROM ce WHERE callee IN (SELECT callee FROM ce GROUP BY callee HAVING count(*) >= 4)")
O["filter_applicable"] = """WITH p AS (SELECT p_partkey, p_size % 4 AS n, p_size % 3 = 0 AS void FROM part) SELECT p_partkey, 'ret' AS extractor FROM p WHERE NOT void UNION ALL SELECT p_partkey, 'ret.check' FROM p WHERE NOT void
UNION ALL SELECT p_partkey, 'arg.' || i || '.' || x FROM p, (VALUES (0), (1), (2), (3), (4), (5), (6)) a(i), (VALUES ('pre'), ('post')) b(x) WHERE n > i"""
O["filter_has_context"] = sql("tt", f"""SELECT {KEY}, coalesce(bool_or(idx < t AND list_contains(targs, res)), false) OR coalesce(bool_or(idx > t AND (coalesce(list_contains(args, r), false) OR coalesce(op0 = r, false) OR coalesce(op1 = r, false) OR coalesce(mem = r, false) OR coalesce(val = r, false))), false) AS has_context FROM tt GROUP BY ALL""")
O["func_signature"] = """WITH p AS (SELECT p_partkey, p_brand, string_split(lower(p_type), ' ') AS kinds, CASE p_size % 3 WHEN 0 THEN 'void' WHEN 1 THEN '*' ELSE 'int' END AS ret FROM part)
SELECT p_partkey, ret || ' ' || p_brand || '(' || array_to_string(kinds, ', ') || ')' AS signature, ret = '*' OR list_contains(kinds, '*') AS pointer FROM p"""
O["location_split"] = sql("ti", f"SELECT {KEY}, idx, split_part(loc, ':', 1) AS path, split_part(loc, ':', 2)::INTEGER AS line, split_part(loc, ':', 3)::INTEGER AS col, split_part(loc, ':', 1) AS context FROM ti")
O["value_functions"] = """WITH t(i, zero, number, inner_, n, kind, code) AS (VALUES (0, true, 0, NULL, 1, 'Const', 1), (1, true, 0, NULL, 1, 'Const', -1), (2, false, -7, NULL, 1, 'Const', 0), (3, false, NULL, NULL, 1, 'Other', 0),
(4, false, NULL, '{"Sym":1}', 2, 'Alloc', 0), (5, false, NULL, NULL, 1, 'Glob', 0), (6, false, NULL, NULL, 1, 'Alloc', 0))
SELECT event_id, zero, number::BIGINT AS number, inner_ AS inner, n::INTEGER AS n_candidates, kind, code::INTEGER AS code FROM events JOIN t ON i = event_id % 7"""

O["label_add"] = sql("lab", "SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS label FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN list_append(labels, 'seen') ELSE labels END AS l FROM lab)")
O["label_erase"] = sql("lab", "SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS label FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN list_filter(labels, lambda x: x <> 'argrel-alarm') ELSE labels END AS l FROM lab)")
O["label_match"] = sql("lab", "SELECT doc_id, len(labels) > 0 AS any, len(list_filter(labels, lambda x: contains(x, 'ret'))) > 0 AS ret FROM lab")
O["alarms_of"] = sql("lab", "SELECT doc_id, alarm FROM (SELECT doc_id, unnest(labels) AS alarm FROM lab) WHERE contains(alarm, 'alarm')")
O["label_id_sets"] = sql("tg", f"SELECT DISTINCT {KEY} FROM tg")

O["feat_control_flow"] = sql("tt", f"SELECT {KEY}, bool_or(beg_loop) AS has_loop, coalesce(sum(CASE WHEN idx < t THEN beg_loop::INT - end_loop::INT END) > 0, false) AS target_in_a_loop, bool_or(op = 'CondBr' AND idx > t) AS has_cond_br_after_target FROM tt GROUP BY ALL")
O["feat_ret"] = sql("tt", f"""SELECT {KEY}, {any_("idx > t AND (op = 'Call' AND list_contains(args, r) OR op IN ('Bin', 'ICmp') AND (op0 = r OR op1 = r))")} AS used, {any_("idx > t AND op = 'Call' AND list_contains(args, r)")} AS used_in_call,
{any_("idx > t AND op = 'Bin' AND (op0 = r OR op1 = r)")} AS used_in_bin, {any_("idx > t AND op = 'Store' AND val = r AND mem <> r")} AS stored,
{any_("idx > t AND (op IN ('Load', 'Store', 'GEP') AND mem = r OR op = 'Load' AND child OR op = 'Store' AND child AND val <> r)")} AS derefed,
{any_("idx > t AND op = 'Ret' AND idx = last_idx AND op0 = r")} AS returned, {any_("idx > t AND op = 'Ret' AND idx = last_idx AND op0 <> r AND kept")} AS indir_returned FROM x GROUP BY ALL""",
    x=f"""SELECT a.*, EXISTS (FROM tt b WHERE b.target = a.target AND b.bc = a.bc AND b.slice_id = a.slice_id AND b.trace_id = a.trace_id AND b.idx > b.t AND b.idx < a.idx AND b.op = 'GEP' AND b.mem = b.r AND b.res = a.mem) AS child,
EXISTS (FROM tt b WHERE b.target = a.target AND b.bc = a.bc AND b.slice_id = a.slice_id AND b.trace_id = a.trace_id AND b.idx > b.t AND b.idx < a.idx AND b.op = 'Store' AND b.val = b.r AND b.mem <> b.r AND b.mem = a.op0) AS kept FROM tt a""")  # fmt: skip
#: For each branch after the target the latest comparison of the result before it, and what it decides.
BRANCH = """SELECT b.target, b.bc, b.slice_id, b.trace_id, b.idx, b.br, b.cond, arg_max(i.res, i.idx) AS ires, arg_max(i.pred, i.idx) AS ipred, arg_max(coalesce({n0}, {n1}, -999), i.idx) AS num
FROM tt b JOIN tt i USING (target, bc, slice_id, trace_id) WHERE b.op = 'CondBr' AND b.idx > b.t AND i.op = 'ICmp' AND i.idx > i.t AND i.idx < b.idx AND (i.op0 = i.r OR i.op1 = i.r) GROUP BY ALL""".format(n0=number("i.op0"), n1=number("i.op1"))
RETCHK = f"""SELECT k.target, k.bc, k.slice_id, k.trace_id, coalesce(c.checked, false) AS checked, coalesce(d.z, false) AS br_eq_zero, coalesce(NOT d.z, false) AS br_neq_zero, coalesce(d.zero, false) AS compared_with_zero, coalesce(d.nc, false) AS compared_with_non_const FROM tg k
LEFT JOIN (SELECT {KEY}, bool_or(idx > t AND op = 'ICmp' AND (op0 = r OR op1 = r)) AS checked FROM tt GROUP BY ALL) c USING (target, bc, slice_id, trace_id)
LEFT JOIN (SELECT {KEY}, arg_max(CASE WHEN num = 0 THEN (ipred = 'EQ') = (br = 'Then') END, CASE WHEN num = 0 THEN idx END) AS z, bool_or(num = 0) AS zero, bool_or(num = -999) AS nc FROM br WHERE cond = ires GROUP BY ALL) d USING (target, bc, slice_id, trace_id)"""
O["feat_ret_check"] = sql("tt", "SELECT *, bool_or(checked) OVER (PARTITION BY target, bc, slice_id) AS slice_checked FROM rc", br=BRANCH, rc=RETCHK)
PRE = f"""SELECT {KEY}, {any_("hit")} AS checked, {any_("hit AND other = '{\"Int\":0}'")} AS compared_with_zero, {any_("hit AND other = '{\"Int\":0}' AND y")} AS arg_check_is_zero, {any_("hit AND other = '{\"Int\":0}' AND n")} AS arg_check_not_zero,
false AS is_arg, false AS is_constant, false AS is_global, false AS is_alloca FROM (SELECT a.*, op = 'ICmp' AND idx < t AND (op0 = targs[1] OR op1 = targs[1]) AS hit, CASE WHEN op0 = targs[1] THEN op1 ELSE op0 END AS other,
EXISTS (FROM tt b WHERE b.target = a.target AND b.bc = a.bc AND b.slice_id = a.slice_id AND b.trace_id = a.trace_id AND b.op = 'CondBr' AND b.idx BETWEEN a.idx + 1 AND a.idx + 5 AND b.cond = a.res AND (a.pred = 'EQ') = (b.br = 'Then')) AS y,
EXISTS (FROM tt b WHERE b.target = a.target AND b.bc = a.bc AND b.slice_id = a.slice_id AND b.trace_id = a.trace_id AND b.op = 'CondBr' AND b.idx BETWEEN a.idx + 1 AND a.idx + 5 AND b.cond = a.res AND (a.pred = 'EQ') <> (b.br = 'Then')) AS n FROM tt a) GROUP BY ALL"""
O["feat_arg_pre_0"] = sql("tt", PRE)
O["feat_arg_post_0"] = sql("tt", f"""SELECT {KEY}, {any_("idx > t AND (op = 'Call' AND list_contains(args, targs[1]) OR op IN ('ICmp', 'Bin') AND (op0 = targs[1] OR op1 = targs[1]) OR op IN ('Store', 'Load') AND mem = targs[1] OR child AND (op = 'Load' OR op = 'Store' AND val <> targs[1]))")} AS used,
{any_("idx > t AND op = 'Call' AND list_contains(args, targs[1])")} AS used_in_call, {any_("idx > t AND op = 'Bin' AND (op0 = targs[1] OR op1 = targs[1])")} AS used_in_bin, {any_("idx > t AND op = 'ICmp' AND (op0 = targs[1] OR op1 = targs[1])")} AS used_in_check,
{any_("idx > t AND (op IN ('Store', 'Load') AND mem = targs[1] OR child AND (op = 'Load' OR op = 'Store' AND val <> targs[1]))")} AS derefed, {any_("idx > t AND op = 'Ret' AND idx = last_idx AND op0 = targs[1]")} AS returned, {any_("idx > t AND op = 'Ret' AND idx = last_idx AND op0 <> targs[1] AND kept")} AS indir_returned FROM x GROUP BY ALL""",
    x="""SELECT a.*, EXISTS (FROM tt b WHERE b.target = a.target AND b.bc = a.bc AND b.slice_id = a.slice_id AND b.trace_id = a.trace_id AND b.idx > b.t AND b.idx < a.idx AND b.op = 'GEP' AND b.mem = b.targs[1] AND b.res = a.mem) AS child,
EXISTS (FROM tt b WHERE b.target = a.target AND b.bc = a.bc AND b.slice_id = a.slice_id AND b.trace_id = a.trace_id AND b.idx > b.t AND b.idx < a.idx AND b.op = 'Store' AND b.val = b.targs[1] AND b.mem <> b.targs[1] AND b.mem = a.op0) AS kept FROM tt a""")  # fmt: skip
DICT = "SELECT target, func, sum(c / n) AS weight FROM (SELECT target, bc, slice_id, func, count(DISTINCT trace_id) AS c FROM tt WHERE op = 'Call' GROUP BY ALL) JOIN (SELECT target, bc, slice_id, count(DISTINCT trace_id) AS n FROM tt GROUP BY ALL) USING (target, bc, slice_id) GROUP BY target, func"
O["causality_dictionary"] = sql("tt", "SELECT target, func, round(weight, 6) AS weight FROM di", di=DICT)
TOP = "SELECT target, func, row_number() OVER (PARTITION BY target ORDER BY round(weight, 9) DESC, func)::INTEGER AS rank FROM di QUALIFY rank <= 5"
O["causality_topk"] = sql("tt", "SELECT * FROM wd", di=DICT, wd=TOP)


def _causality(after: bool) -> dict[str, str]:
    side, far = ("c.idx > c.t", "idx") if after else ("c.idx < c.t", "-idx")
    shared = "list_contains(c.args, c.r)" if after else "list_contains(c.targs, c.res)"
    return {
        "di": DICT, "wd": TOP,
        "ca": f"SELECT c.*, coalesce({shared}, false) AS sret, list_has_any(c.args, c.targs) AS sarg FROM tt c JOIN wd USING (target, func) WHERE c.op = 'Call' AND {side}",
        "hit": "SELECT c.target, c.bc, c.slice_id, c.trace_id, c.idx AS cidx, i.idx, i.res, i.pred, coalesce(" + number("i.op0") + ", " + number("i.op1") + ", -999) AS num FROM ca c JOIN tt i USING (target, bc, slice_id, trace_id) WHERE i.op = 'ICmp' AND i.idx > c.idx AND (i.op0 = c.res OR i.op1 = c.res)",
        "brs": "SELECT h.target, h.bc, h.slice_id, h.trace_id, cidx, b.idx, b.br, b.cond, arg_max(h.res, h.idx) AS ires, arg_max(h.pred, h.idx) AS ipred, arg_max(num, h.idx) AS num FROM hit h JOIN tt b USING (target, bc, slice_id, trace_id) WHERE b.op = 'CondBr' AND b.idx > h.idx GROUP BY ALL",
        "dec": f"SELECT {KEY}, cidx, arg_max((ipred = 'EQ') = (br = 'Then'), idx) AS z FROM brs WHERE cond = ires AND num = 0 GROUP BY ALL",
        "each": f"SELECT c.*, EXISTS (FROM hit h WHERE h.target = c.target AND h.bc = c.bc AND h.slice_id = c.slice_id AND h.trace_id = c.trace_id AND h.cidx = c.idx) AS checked, z FROM ca c LEFT JOIN dec d ON d.target = c.target AND d.bc = c.bc AND d.slice_id = c.slice_id AND d.trace_id = c.trace_id AND d.cidx = c.idx",
        "ag": f"SELECT {KEY}, func, true AS invoked, count(*) > 1 AS more, bool_or(sret) AS sret, bool_or(sarg) AS sarg, arg_max(checked, {far}) AS checked, arg_max(coalesce(z, false), {far}) AS z, arg_max(coalesce(NOT z, false), {far}) AS nz FROM each GROUP BY ALL",
        "un": f"SELECT k.target, k.bc, k.slice_id, k.trace_id, wd.func, coalesce(invoked, false) AS invoked, coalesce(more, false) AS invoked_more_than_once, coalesce(sret, false) AS share_return, coalesce(sarg, false) AS share_argument, coalesce(checked, false) AS checked, coalesce(z, false) AS is_zero, coalesce(nz, false) AS not_zero FROM tg k JOIN wd USING (target) LEFT JOIN ag a ON a.target = k.target AND a.bc = k.bc AND a.slice_id = k.slice_id AND a.trace_id = k.trace_id AND a.func = wd.func",
    }


O["feat_before"] = sql("tt", "SELECT * FROM un", **_causality(False))
O["feat_after"] = sql("tt", "SELECT * FROM un", **_causality(True))
O["unify_features"] = sql("tt", f"SELECT k.target, k.bc, k.slice_id, k.trace_id, wd.func, EXISTS (FROM ti WHERE ti.target = k.target AND ti.bc = k.bc AND ti.slice_id = k.slice_id AND ti.trace_id = k.trace_id AND ti.func = wd.func) AS invoked FROM tg k JOIN wd USING (target)", di=DICT, wd=TOP)
VECTOR = """SELECT row_number() OVER (ORDER BY bc, target, slice_id, trace_id) - 1 AS dp_id, [c.has_loop, c.target_in_a_loop, c.has_cond_br_after_target, r.stored, r.derefed, r.returned, r.indir_returned, p.checked, p.compared_with_zero, p.arg_check_is_zero, p.arg_check_not_zero, p.is_arg, p.is_constant] AS v
FROM cf c JOIN rt r USING (target, bc, slice_id, trace_id) JOIN pr p USING (target, bc, slice_id, trace_id)"""
_strip = lambda q: "(" + q.replace("WITH RECURSIVE", "WITH") + ")"
_cf, _rt, _pr = (f"SELECT * FROM {_strip(O[n])}" for n in ("feat_control_flow", "feat_ret", "feat_arg_pre_0"))
O["encode_vector"] = sql("", "SELECT dp_id::BIGINT AS dp_id, (i - 1)::INTEGER AS position, v[i]::INTEGER AS value FROM (SELECT dp_id, v, unnest(range(1, 14)) AS i FROM ve)", cf=_cf, rt=_rt, pr=_pr, ve=VECTOR)
O["encode_masked"] = sql("", "SELECT dp_id::BIGINT AS dp_id, ((i - 1) // 2)::INTEGER AS position, v[i]::INTEGER AS value FROM (SELECT dp_id, v, unnest(range(1, 14, 2)) AS i FROM ve)", cf=_cf, rt=_rt, pr=_pr, ve=VECTOR)

FIRST = "SELECT {key}, coalesce(arg_min('Checked(EQ,' || n || ')', pos), 'NoCheck') AS result FROM (SELECT *, CASE WHEN op = 'ICmp' AND {side} THEN CASE WHEN op0 = {x} THEN {n1} WHEN op1 = {x} THEN {n0} END END AS n, CASE WHEN n IS NOT NULL THEN {pos} END AS pos FROM tt) GROUP BY ALL"
RETVAL = FIRST.format(key=KEY, side="idx > t", x="r", n0=number("op0"), n1=number("op1"), pos="idx")
O["checker_argval_0"] = sql("tt", FIRST.format(key=KEY, side="idx < t", x="targs[1]", n0=number("op0"), n1=number("op1"), pos="-idx"))
STATS = "SELECT target, result, count(*)::BIGINT AS n, sum(count(*)) OVER (PARTITION BY target)::BIGINT AS total FROM rv GROUP BY target, result"
O["checker_stats"] = sql("tt", "SELECT * FROM st", rv=RETVAL, st=STATS)
O["checker_scores"] = sql("tt", f"SELECT {KEY}, result, round(1 - n / total, 6) AS score FROM rv JOIN st USING (target, result)", rv=RETVAL, st=STATS)
O["checker_bugs"] = sql("tt", f"SELECT {KEY}, result, round(1 - n / total, 6) AS score FROM rv JOIN st USING (target, result) WHERE result <> 'NoCheck' AND 1 - n / total > 0.9", rv=RETVAL, st=STATS)
O["checker_causality"] = sql("tt", f"SELECT {KEY}, func, CASE WHEN invoked THEN 'Causing ' || func ELSE 'None' END AS result FROM un", **_causality(True))
BRANCHES = f"""SELECT i.target, i.bc, i.slice_id, i.trace_id, i.idx, CASE WHEN NOT (i.op0 = i.r OR i.op1 = i.r) THEN 'CheckedOtherVar' WHEN coalesce({number("i.op0")}, {number("i.op1")}) IS NULL THEN 'CheckedAgainstVar'
ELSE 'Checked(' || i.pred || ',' || coalesce({number("i.op0")}, {number("i.op1")}) || ',' || coalesce(min_by(b.br, b.idx), '-') || ',' || CASE WHEN min(b.idx) = i.idx + 1 THEN 'now' ELSE 'later' END || ')' END AS result
FROM tt i LEFT JOIN tt b ON b.target = i.target AND b.bc = i.bc AND b.slice_id = i.slice_id AND b.trace_id = i.trace_id AND b.op = 'CondBr' AND b.cond = i.res AND b.idx BETWEEN i.idx + 1 AND i.idx + 5 WHERE i.op = 'ICmp' AND i.idx > i.t GROUP BY i.target, i.bc, i.slice_id, i.trace_id, i.idx, i.op0, i.op1, i.r, i.pred"""
O["checker_branches"] = sql("tt", BRANCHES)
O["fopen_rule"] = sql("tt", f"""SELECT {KEY}, CASE WHEN first IN ('Checked(EQ,0,Then,now)', 'Checked(NE,0,Else,now)') AND NOT closed AND NOT wrote OR first IN ('Checked(EQ,0,Else,now)', 'Checked(NE,0,Then,now)') AND closed THEN 'Ok' ELSE 'Alarm' END AS verdict
FROM (SELECT {KEY}, {any_("idx > t AND func = 'f1'")} AS closed, {any_("idx > t AND func = 'f2'")} AS wrote FROM tt GROUP BY ALL) LEFT JOIN (SELECT {KEY}, min_by(result, idx) AS first FROM cb GROUP BY ALL) USING ({KEY})""", cb=BRANCHES)
O["filter_opens_file"] = "SELECT event_id, event_id % 5 IN (0, 1) AS opens FROM events"
O["count_all_groupings"] = sql("ti", "SELECT target, bc, count(DISTINCT (bc, slice_id))::BIGINT AS n_slices, count(DISTINCT (bc, slice_id, trace_id))::BIGINT AS n_traces FROM ti WHERE contains(bc, 'kg') GROUP BY CUBE (target, bc)")
O["function_types"] = "SELECT p_brand AS func, p_type AS type FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_type) = 1"
O["input_kinds"] = """SELECT n_nationkey::BIGINT AS id, n_name || ['.json', '.bc', '', '/src'][n_nationkey % 4 + 1] AS name, ['list', 'bitcode', 'debian', 'folder'][n_nationkey % 4 + 1] AS kind,
CASE WHEN n_nationkey % 3 = 0 THEN 'nolibs' WHEN n_regionkey % 2 = 0 THEN 'nobc' ELSE 'success' END AS state FROM nation"""
O["feature_fields"] = "SELECT event_id, (props->>'k')::BIGINT AS k, true AS has_none, false AS has_arg, true AS in_group, true AS not_in_group FROM events"
O["legacy_metadata"] = sql("ti", """SELECT target, count(*)::BIGINT AS explored, count_if(nth > 1)::BIGINT AS duplicated, count_if(NOT hit)::BIGINT AS rejected, sum(n)::BIGINT AS nodes, sum(n - 1)::BIGINT AS edges, round(avg(n), 6) AS avg_nodes, round(avg(n - 1), 6) AS avg_edges
FROM (SELECT *, row_number() OVER (PARTITION BY target, bc, slice_id, seq ORDER BY trace_id) AS nth FROM pt) GROUP BY target""", pt=f"SELECT {KEY}, bool_or(is_target) AS hit, count(*) AS n, string_agg(op, '>' ORDER BY idx) AS seq FROM ti GROUP BY ALL")
O["batch_counts"] = sql("ti", "SELECT bc AS target, count(DISTINCT slice_id)::BIGINT AS n FROM ti GROUP BY bc UNION ALL SELECT NULL, count(DISTINCT (bc, slice_id)) FROM ti")
O["spec_match"] = sql("tt", f"SELECT {KEY}, NOT (checked OR br_eq_zero) AS is_alarm FROM rc", br=BRANCH, rc=RETCHK)
O["arg_relation"] = sql("ti", f"SELECT DISTINCT a.target, a.bc, a.slice_id, a.trace_id, a.i, b.i AS j FROM ar a JOIN ar b USING (target, bc, slice_id, trace_id, s) WHERE a.i <> b.i",
    ar=f"SELECT {KEY}, 0::INTEGER AS i, 's' || k % 10 AS s FROM ti WHERE is_target UNION ALL SELECT {KEY}, 1, 's' || k % 5 FROM ti WHERE is_target UNION ALL SELECT {KEY}, 2, 's' || k % 3 FROM ti WHERE is_target UNION ALL SELECT {KEY}, 2, 'c' || k % 4 FROM ti WHERE is_target")

O["icmp_branch_asof"] = sql("ti", f"SELECT b.target, b.bc, b.slice_id, b.trace_id, b.idx, i.idx AS icmp_idx, b.br FROM (SELECT * FROM ti WHERE op = 'CondBr') b ASOF JOIN (SELECT * FROM ti WHERE op = 'ICmp') i ON b.target = i.target AND b.bc = i.bc AND b.slice_id = i.slice_id AND b.trace_id = i.trace_id AND b.cond = i.res AND b.idx > i.idx")
O["reaching_def"] = sql("ti", f"SELECT b.target, b.bc, b.slice_id, b.trace_id, b.idx, b.mem, i.idx AS def_idx FROM (SELECT * FROM ti WHERE op = 'Load') b ASOF JOIN (SELECT * FROM ti WHERE op = 'Store') i ON b.target = i.target AND b.bc = i.bc AND b.slice_id = i.slice_id AND b.trace_id = i.trace_id AND b.mem = i.mem AND b.idx > i.idx")
O["global_use_chain"] = sql("ti", f"SELECT {KEY}, mem AS place, idx, prev_idx FROM (SELECT *, lag(idx) OVER (PARTITION BY {KEY}, mem ORDER BY idx) AS prev_idx FROM ti WHERE mem IS NOT NULL) WHERE prev_idx IS NOT NULL")
O["syntactic_use"] = sql("ti", f"SELECT {KEY}, b.idx, b.cond AS operand, i.idx AS def_idx FROM ti b JOIN ti i USING (target, bc, slice_id, trace_id) WHERE b.op = 'CondBr' AND i.op = 'ICmp' AND b.cond = i.res")
O["control_edges"] = sql("ti", f"SELECT {KEY}, (idx - 1)::INTEGER AS src, idx AS dst FROM ti WHERE idx > 0")
O["dugraph_reduce"] = sql("ti", f"SELECT {KEY}, id FROM n2 UNION SELECT {KEY}, idx::BIGINT FROM ti WHERE op = 'CondBr'",
    rd=f"SELECT b.target, b.bc, b.slice_id, b.trace_id, b.idx AS x, max(i.idx) AS y FROM ti b JOIN ti i USING (target, bc, slice_id, trace_id) WHERE b.op = 'Load' AND i.op = 'Store' AND b.mem = i.mem AND i.idx < b.idx GROUP BY ALL UNION SELECT {KEY}, idx, lag(idx) OVER (PARTITION BY {KEY}, coalesce(mem, args[1]) ORDER BY idx) FROM ti WHERE coalesce(mem, args[1]) IS NOT NULL",
    du=f"SELECT {KEY}, x, y FROM rd WHERE y IS NOT NULL UNION SELECT {KEY}, y, x FROM rd WHERE y IS NOT NULL", n2=f"SELECT {KEY}, idx::BIGINT AS id FROM ti WHERE is_target UNION SELECT {KEY}, y::BIGINT FROM n2 JOIN du USING (target, bc, slice_id, trace_id) WHERE x = id")
O["dugraph_relinked"] = sql("ti", f"SELECT * FROM (SELECT {KEY}, idx AS src, lead(idx) OVER (PARTITION BY {KEY} ORDER BY idx) AS dst FROM ti WHERE op IN ('Call', 'CondBr')) WHERE dst IS NOT NULL")
O["block_trace_dedupe"] = sql("ti", "SELECT target, bc, slice_id, seq, min(trace_id) AS trace_id, count(*)::BIGINT AS n_same FROM sq GROUP BY target, bc, slice_id, seq", sq=f"SELECT {KEY}, string_agg(op, '>' ORDER BY idx) AS seq FROM (SELECT *, lag(op) OVER (PARTITION BY {KEY} ORDER BY idx) AS was FROM ti) WHERE was IS DISTINCT FROM op GROUP BY ALL")
O["whole_slice_band"] = sql("ti", "SELECT c.dp_id AS chosen, p.dp_id FROM pt c JOIN pt p USING (bc, slice_id) WHERE c.dp_id IN (SELECT min(dp_id) FROM pt GROUP BY bc, slice_id) AND p.dp_id BETWEEN c.dp_id - 50 AND c.dp_id + 49", pt=f"SELECT row_number() OVER (ORDER BY bc, target, slice_id, trace_id) - 1 AS dp_id, bc, slice_id FROM (SELECT DISTINCT {KEY} FROM ti)")
O["exec_metadata"] = sql("ti", "SELECT target, bc, count(*)::BIGINT AS explored, count_if(NOT hit)::BIGINT AS no_target, count_if(hit AND f = 'Ret')::BIGINT AS proper, count_if(hit AND f <> 'Ret')::BIGINT AS cut, sum(n)::BIGINT AS nodes FROM pt GROUP BY target, bc", pt=f"SELECT {KEY}, bool_or(is_target) AS hit, arg_max(op, idx) AS f, count(*) AS n FROM ti GROUP BY ALL")
O["capped_traces"] = sql("ti", f"SELECT {KEY} FROM (SELECT DISTINCT {KEY} FROM ti) QUALIFY row_number() OVER (PARTITION BY target, bc, slice_id ORDER BY trace_id) <= 3")
O["batch_offsets"] = sql("ti", "SELECT target, slice_id, ((row_number() OVER (ORDER BY target, slice_id) - 1) // 7)::BIGINT AS batch FROM (SELECT DISTINCT bc AS target, slice_id FROM ti)")

O["target_edges"] = sql("ce", "SELECT * FROM ce WHERE regexp_matches(callee, '^part_[0-9]$')")
UP = "SELECT DISTINCT callee AS f, caller AS up FROM ce"
O["entries_bounded"] = sql("ce", "SELECT DISTINCT target, f AS entry FROM walk WHERE d = 2", up=UP, walk="SELECT callee AS target, caller AS f, 0 AS d FROM ce WHERE regexp_matches(callee, '^part_([0-9]|1[0-9]|20)$') UNION SELECT target, coalesce(u.up, w.f), d + 1 FROM walk w LEFT JOIN up u ON u.f = w.f WHERE d < 2")
O["slices_of_edges"] = sql("ce", "SELECT target, edge_id, caller, entry, (row_number() OVER (PARTITION BY target ORDER BY edge_id, entry) - 1)::INTEGER AS slice_id FROM (SELECT DISTINCT callee AS target, edge_id, caller, coalesce(u.up, caller) AS entry FROM ce LEFT JOIN up u ON u.f = caller WHERE regexp_matches(callee, '^part_([0-9]|1[0-9]|20)$'))", up=UP)
ENT = "SELECT DISTINCT c.callee AS target, coalesce(u.up, c.caller) AS entry FROM ce c LEFT JOIN up u ON u.f = c.caller WHERE regexp_matches(c.callee, '^part_([0-9]|1[0-9]|20)$')"
MEMBERS = "SELECT target, entry, entry AS func, 0 AS d FROM en UNION SELECT m.target, m.entry, c.callee, d + 1 FROM mem m JOIN ce c ON c.caller = m.func WHERE d < 2 AND c.callee <> m.target"
O["slice_functions"] = sql("ce", "SELECT DISTINCT target, entry, func FROM mem", up=UP, en=ENT, mem=MEMBERS)
O["slice_reduce"] = sql("ce", "SELECT DISTINCT m.target, m.entry, m.func FROM mem m SEMI JOIN good g ON g.target = m.target AND g.entry = m.entry AND g.func = m.func", up=UP, en=ENT, mem=MEMBERS, good="SELECT target, entry, func, 0 AS h FROM mem WHERE suffix(func, '7') UNION SELECT g.target, g.entry, c.caller, h + 1 FROM good g JOIN ce c ON c.callee = g.func WHERE h < 2")
O["slice_reduce_structs"] = sql("ce", "SELECT DISTINCT m.target, m.entry, m.func FROM mem m SEMI JOIN good g ON g.target = m.target AND g.entry = m.entry AND g.func = m.func", up=UP, en=ENT, mem=MEMBERS, good="SELECT target, entry, func, 0 AS h FROM mem WHERE regexp_extract(func, '([0-9]+)$', 1)::BIGINT % 7 = regexp_extract(target, '([0-9]+)$', 1)::BIGINT % 7 UNION SELECT g.target, g.entry, c.caller, h + 1 FROM good g JOIN ce c ON c.callee = g.func WHERE h < 2")
O["simple_paths"] = sql("ce", "SELECT split_part(path, '>', 1) AS start, node AS stop, path FROM pa WHERE node IN ('part_1', 'part_2', 'part_3')", st="SELECT DISTINCT caller, callee FROM ce", pa="SELECT DISTINCT caller AS node, caller AS path, 0 AS d FROM ce WHERE starts_with(caller, 'nation') UNION ALL SELECT callee, path || '>' || callee, d + 1 FROM pa JOIN st ON caller = node WHERE d < 3")
O["function_traces"] = sql("ce", "SELECT DISTINCT u.up AS start, c.caller AS stop, u.up || '>' || c.caller AS path FROM ce c JOIN up u ON u.f = c.caller WHERE regexp_matches(c.callee, '^part_([0-9]|1[0-9]|20)$')", up=UP)
O["cartesian_choices"] = "SELECT 'k' AS key, a.n_name || '|' || b.n_name || '|' || c.n_name AS choice FROM nation a, nation b, nation c WHERE a.n_regionkey = 0 AND b.n_regionkey = 1 AND c.n_regionkey = 2"
O["merged_clusters"] = "WITH c AS (SELECT n_nationkey, n_regionkey, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS m FROM nation) SELECT n_nationkey::BIGINT AS node, m::BIGINT AS cluster FROM c UNION SELECT n_regionkey + 100, m FROM c"
O["dot_export"] = sql("ti", """SELECT idx || ' [label="' || op || '"' || CASE WHEN is_target THEN ', style=filled, fillcolor=blue, fontcolor=white' ELSE '' END || '];' AS line FROM ti WHERE slice_id = 1 AND trace_id = 0 UNION ALL SELECT idx - 1 || ' -> ' || idx || ' [color=black];' FROM ti WHERE slice_id = 1 AND trace_id = 0 AND idx > 0""")

D2 = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) ** 2))"
LABELED = f"SELECT dp_id, x, label = 0 AS is_alarm FROM vec WHERE label IN (0, 1)"
KDE = f"SELECT a.dp_id, coalesce(avg(CASE WHEN is_alarm THEN k END), 0) AS pos, coalesce(avg(CASE WHEN NOT is_alarm THEN k END), 0) AS neg FROM (SELECT a.dp_id, is_alarm, exp(-{D2} / 2) / sqrt(2 * pi()) AS k FROM vec a, la b) a GROUP BY a.dp_id"
O["kde_score"] = sql("vec", "SELECT dp_id, round(pos, 6) + 0.0::DOUBLE AS positive, round(neg, 6) + 0.0::DOUBLE AS negative, round(pos - neg, 6) + 0.0::DOUBLE AS score FROM kd", la=LABELED, kd=KDE)
O["kde_log_score"] = sql("vec", "SELECT dp_id, round(ln(greatest(pos, 1e-300)) - ln(greatest(neg, 1e-300)), 6) + 0.0::DOUBLE AS score FROM kd", la=LABELED, kd=KDE)
O["kde_alarms"] = sql("vec", "SELECT dp_id FROM kd ORDER BY round(pos - neg, 6) DESC, dp_id LIMIT 25", la=LABELED, kd=KDE)
O["feedback_state_scores"] = O["kde_score"]
O["feedback_stream_scores"] = sql("vec", "SELECT dp_id, round(pos - neg, 6) + 0.0::DOUBLE AS score FROM kd", la=LABELED, kd=KDE)
O["pairwise_mean_distance"] = sql("vec", f"SELECT round(avg(sqrt({D2})), 6) AS mean_distance, count(*)::BIGINT AS n_pairs FROM vec a JOIN vec b ON a.dp_id < b.dp_id")
O["rbf_kernel"] = sql("vec", f"SELECT a.dp_id AS i, b.dp_id AS j, round(exp(-{D2} / 2), 6) AS k FROM vec a, vec b WHERE a.dp_id IN (SELECT min(dp_id) FROM vec GROUP BY label)")
O["linear_kernel"] = sql("vec", "SELECT a.dp_id AS i, b.dp_id AS j, round(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])), 6) + 0.0::DOUBLE AS k FROM vec a, vec b WHERE a.dp_id IN (SELECT min(dp_id) FROM vec GROUP BY label)")
O["nearest_neighbour"] = sql("vec", f"SELECT dp_id, other, round(sqrt(d), 6) AS distance FROM (SELECT b.dp_id, a.dp_id AS other, {D2} AS d FROM vec a, vec b WHERE a.dp_id <> b.dp_id) QUALIFY row_number() OVER (PARTITION BY dp_id ORDER BY d, other) = 1")
O["cluster_entropy"] = sql("vec", "SELECT round(-sum(n / t * ln(n / t)), 6) AS entropy FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM vec GROUP BY label)")
O["unlabeled_pool"] = sql("vec", f"SELECT dp_id, label FROM vec WHERE NOT (label IN (0, 1))")
O["mark_first_bug"] = sql("ti", f"SELECT DISTINCT {KEY} FROM ti WHERE contains(bc, 'kg1') AND slice_id = 4")
CURVE = "SELECT 0::INTEGER AS attempt, 0::BIGINT AS tp, 1::BIGINT AS fp UNION ALL SELECT row_number() OVER (ORDER BY doc_id)::INTEGER, sum((toxic = 1)::INT) OVER (ORDER BY doc_id)::BIGINT, (1 + sum((toxic <> 1)::INT) OVER (ORDER BY doc_id))::BIGINT FROM labels"
O["auc_curve"] = sql("", "SELECT * FROM cu", cu=CURVE)
O["auc_value"] = sql("", "SELECT round(CASE WHEN max(tp) * max(fp) > 0 THEN sum(CASE WHEN fp > was THEN tp ELSE 0 END) / (max(tp) * max(fp)) ELSE 0 END, 6)::DOUBLE AS auc, max(tp) AS tp, max(fp) AS fp FROM (SELECT *, coalesce(lag(fp) OVER (ORDER BY attempt), 0) AS was FROM cu)", cu=CURVE)
O["confusion"] = "SELECT count_if(quality = 0 AND toxic = 1)::BIGINT AS tp, count_if(quality <> 0 AND toxic <> 1)::BIGINT AS tn, count_if(quality = 0 AND toxic <> 1)::BIGINT AS fp, count_if(quality <> 0 AND toxic = 1)::BIGINT AS fn FROM labels"
O["accuracy"] = "SELECT round(avg(((quality = 0) = (toxic = 1))::INT), 6) AS accuracy FROM labels"
O["alarms_brief"] = sql("tt", "SELECT bc, slice_id, count(*)::BIGINT AS num_traces, round(avg((n_before - n_after)::DOUBLE), 6) + 0.0::DOUBLE AS score_avg FROM sh GROUP BY bc, slice_id", sh=SHAPE)
O["feedback_steps"] = "SELECT user_id, count(*)::BIGINT AS n_labeled, round(avg(gap) / 1e6, 3) AS mean_seconds FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) GROUP BY user_id"

FEW = {"fl": "SELECT dp_id, x, label = 0 AS pos FROM vec WHERE label IN (0, 1)"}
NORM = "64 * ln(0.4::DOUBLE * sqrt(2 * pi()))"
LK = f"(-{D2} / (2 * 0.4::DOUBLE ** 2) - {NORM})"
FEW["uk"] = f"SELECT a.dp_id AS u, b.dp_id AS j, b.pos, {LK} AS lk FROM vec a, fl b"
FEW["ll"] = f"SELECT a.dp_id AS i, b.dp_id AS j, a.pos AS ipos, b.pos AS jpos, {LK} AS lk FROM fl a, fl b"
FEW["cn"] = f"SELECT count_if(pos)::DOUBLE AS n, count_if(NOT pos)::DOUBLE AS m, -{NORM} AS own FROM fl"
O["kde_leave_in"] = sql("vec", """SELECT s.u AS dp_id, round(0.3 * ((ln_ + own) / (m + 1) - w / n) + 0.7 * (ln_ / m - (lp + own) / (n + 1)), 5) + 0.0::DOUBLE AS score FROM su s JOIN wu USING (u), cn""",
    **FEW, su="SELECT u, sum(CASE WHEN NOT pos THEN lk END) AS ln_, sum(CASE WHEN pos THEN lk END) AS lp FROM uk GROUP BY u",
    sx="SELECT i, sum(exp(lk)) AS s FROM ll WHERE ipos AND jpos GROUP BY i", wu="SELECT u, sum(ln((s + exp(lk)) / (n + 1))) AS w FROM uk JOIN sx ON i = j, cn WHERE pos GROUP BY u")
O["kde_leave_one_out"] = sql("vec", """SELECT u AS dp_id, round(0.3 * ((x1 + pu / n) / (n + 1) - z1) + 0.7 * -((SELECT sum(b) FROM nz) / n + pu / n) / (m + 1), 9) + 0.0::DOUBLE AS score FROM pa JOIN px USING (u) JOIN pz USING (u), cn""",
    **FEW, pa="SELECT u, sum(exp(lk)) AS pu FROM uk WHERE pos GROUP BY u", ao="SELECT i, sum(exp(lk)) AS a FROM ll WHERE ipos AND jpos AND i <> j GROUP BY i", px="SELECT u, sum((a + exp(lk)) / n) AS x1 FROM uk JOIN ao ON i = j, cn WHERE pos GROUP BY u",
    nz="SELECT i, sum(exp(lk)) AS b FROM ll WHERE NOT ipos AND jpos GROUP BY i", pz="SELECT u, avg((b + exp(lk)) / (n + 1)) AS z1 FROM uk JOIN nz ON i = j, cn WHERE NOT pos GROUP BY u")
O["kde_bandwidths"] = sql("vec", "SELECT h AS bandwidth, round(sum(ln(greatest(k, 1e-300)) - 64 * ln(h * sqrt(2 * pi()))), 3) AS fitness FROM kk GROUP BY h",
    kk=f"SELECT h, a.dp_id, avg(exp(-{D2} / (2 * h * h))) AS k FROM vec a JOIN vec b ON a.dp_id % 5 <> b.dp_id % 5, (VALUES (0.3::DOUBLE), (0.4), (1.0), (3.0)) g(h) GROUP BY h, a.dp_id")
SAME = "b.target = a.target AND b.bc = a.bc AND b.slice_id = a.slice_id AND b.trace_id = a.trace_id AND b.idx > b.t AND b.idx < a.idx"
O["legacy_context_columns"] = sql("tt", f"""SELECT {KEY}, {any_("oc")} AS has_other_retval_check, {any_("fo")} AS used_in_logical_formula, arg_min(CASE WHEN tk THEN br END, CASE WHEN tk THEN idx END) AS check_branch_taken, {any_("idx > t AND beg_loop")} AS has_loop_after FROM x GROUP BY ALL""",
    x=f"""SELECT a.*, a.idx > a.t AND a.op = 'ICmp' AND NOT coalesce(a.op0 = a.r OR a.op1 = a.r, false) AND EXISTS (FROM tt b WHERE {SAME} AND b.op = 'Call' AND b.res IN (a.op0, a.op1)) AS oc,
a.idx > a.t AND a.op = 'Bin' AND EXISTS (FROM tt b WHERE {SAME} AND b.op = 'ICmp' AND (b.op0 = b.r OR b.op1 = b.r) AND b.res IN (a.op0, a.op1)) AS fo, a.idx > a.t AND a.op = 'CondBr' AND EXISTS (FROM tt b WHERE {SAME} AND b.op = 'ICmp' AND (b.op0 = b.r OR b.op1 = b.r) AND b.res = a.cond) AS tk FROM tt a""")  # fmt: skip
O["legacy_dictionary"] = sql("tt", "SELECT target, func, round(sum(11 + CASE WHEN list_has_any(args, targs) THEN 2 ELSE 0 END + CASE WHEN list_contains(args, r) THEN 2 ELSE 0 END) / (SELECT count(*) FROM tg), 6) AS weight FROM tt WHERE op = 'Call' AND NOT is_target GROUP BY target, func")
O["legacy_result_table"] = sql("tt", "SELECT count(*)::BIGINT AS \"Count\", result AS \"Result\" FROM rv GROUP BY result", rv=RETVAL)
O["legacy_duplicates"] = sql("ti", "SELECT slice_id AS slice, trace_id, row_number() OVER (PARTITION BY slice_id, v ORDER BY trace_id) > 1 AS is_duplicate FROM (SELECT slice_id, trace_id, list_sort(list(DISTINCT op)) AS v FROM ti GROUP BY ALL)")
O["phi_values"] = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN event_type END AS value FROM events"


# Extractors and checkers in one pass: the SQL of the single ones, on targets with three arguments.

_three = lambda q: q.replace("args AS targs FROM ti WHERE is_target", """list_concat(args, ['{"Sym":' || k % 7 || '}', '{"Sym":' || k % 3 || '}']) AS targs FROM ti WHERE is_target""")
_PARTS = [("ret", O["feat_ret"]), ("ret_check", O["feat_ret_check"]), ("control_flow", O["feat_control_flow"])]
_PARTS += [(f"arg_{i}_{w}", O[f"feat_arg_{w}_0"].replace("targs[1]", f"targs[{i + 1}]")) for i in range(3) for w in ("pre", "post")]
_PARTS += [("before", O["feat_before"]), ("after", O["feat_after"])]
O["extract_all"] = "\nUNION ALL\n".join(
    f"SELECT {KEY}, '{n}' AS extractor, {'func' if n in ('before', 'after') else 'NULL::VARCHAR'} AS func, feature, value FROM (UNPIVOT {_strip(_three(q))} ON COLUMNS(* EXCLUDE ({KEY}{', func' if n in ('before', 'after') else ''})) INTO NAME feature VALUE value)" for n, q in _PARTS
)
_symbols = lambda i: f"CASE WHEN len(targs) >= {i} THEN regexp_extract_all(targs[{i}], '\"Sym\":\\d+') END"


def _all_checkers(pointers: list[int], arguments: int) -> str:
    parts = [f"SELECT {KEY}, 'retval' AS checker, result FROM ({RETVAL})"]
    parts += [f"SELECT {KEY}, 'argval-{i}', result FROM ({FIRST.format(key=KEY, side='idx < t', x=f'targs[{i + 1}]', n0=number('op0'), n1=number('op1'), pos='-idx')})" for i in pointers if i < arguments]
    relations = " UNION ALL ".join(f"SELECT {KEY}, 'Relation({i},{j})' AS result FROM tg WHERE targs[{i + 1}] = targs[{j + 1}]" for i in range(3) for j in range(3) if i != j)
    parts += [f"SELECT {KEY}, 'argrel', coalesce(result, 'NoRelation') FROM tg LEFT JOIN ({relations}) USING ({KEY})"]
    parts += [f"SELECT {KEY}, 'causality', coalesce('Causing(' || func || ')', 'None') FROM tg LEFT JOIN (SELECT DISTINCT {KEY}, func FROM tt WHERE op = 'Call' AND idx > t) USING ({KEY})"]
    return " UNION ALL ".join(parts)


_SCORED = "SELECT *, count(*) OVER (PARTITION BY checker, target, result) AS n, count(*) OVER (PARTITION BY checker, target) AS total FROM al"
O["checker_all"] = _three(sql("tt", f"SELECT checker, target, result, bc, slice_id, trace_id, n, total, round(1 - n / total, 6) AS score FROM ({_SCORED})", al=_all_checkers([0, 2], 4)))
O["checker_flagged"] = _three(sql("tt", f"SELECT {KEY}, checker, result FROM ({_SCORED}) WHERE 1 - n / total > 0.2 AND result IN ('NoCheck', 'NoRelation', 'None')", al=_all_checkers([0, 1, 2], 3)))

# Walks.

_same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in KEY.split(", "))
USES = f"SELECT DISTINCT {KEY}, idx, unnest(list_concat([op0, op1, cond, mem, val], coalesce(args, []))) AS u FROM ti"
FLOW = f"""SELECT {KEY}, src, dst FROM (SELECT u.target, u.bc, u.slice_id, u.trace_id, max(g.idx) AS src, u.idx AS dst FROM us u JOIN ti g ON {_same("u", "g")} AND g.res = u.u AND g.idx < u.idx WHERE u.u IS NOT NULL GROUP BY ALL, u.u)
UNION SELECT l.target, l.bc, l.slice_id, l.trace_id, max(s.idx), l.idx FROM ti l JOIN ti s ON {_same("l", "s")} AND l.mem = s.mem AND s.idx < l.idx AND s.op = 'Store' WHERE l.op = 'Load' GROUP BY ALL"""
FLOW = FLOW.replace("GROUP BY ALL, u.u)", "GROUP BY u.target, u.bc, u.slice_id, u.trace_id, u.idx, u.u)")
O["def_use_edges"] = sql("ti", "SELECT * FROM fl", us=USES, fl=FLOW)


def _dictionary(forward: bool) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    struct = lambda c: f"({c} IN ('purchase', 'f1', 'f4'))"
    return sql(
        "tt", f"""SELECT c.target, c.func, round(sum(1 + CASE WHEN c.func = c.target THEN 10 ELSE 0 END + CASE WHEN list_has_any(c.args, c.targs) THEN 2 ELSE 0 END + CASE WHEN coalesce(list_contains(c.args, c.r), false) OR coalesce(list_contains(c.targs, c.res), false) THEN 2 ELSE 0 END
        + CASE WHEN {struct("c.func")} = {struct("c.target")} THEN 1 ELSE 0 END) / (SELECT count(*) FROM tg), 6) AS weight FROM tt c WHERE c.op = 'Call' AND c.idx <> c.t AND EXISTS (FROM wk WHERE {_same("wk", "c")} AND wk.id = c.idx) GROUP BY c.target, c.func""",
        us=USES, fl=FLOW, wk=f"SELECT {KEY}, t AS id FROM tg UNION SELECT w.target, w.bc, w.slice_id, w.trace_id, f.{b} FROM wk w JOIN fl f ON {_same('w', 'f')} AND f.{a} = w.id",
    )


O["dictionary_after"], O["dictionary_before"] = _dictionary(True), _dictionary(False)
KEPT = {
    "us": USES, "fl": FLOW, "ow": "SELECT * FROM tt",
    "up": f"SELECT {KEY}, idx AS id FROM ow WHERE idx = t OR op = 'CondBr' UNION SELECT w.target, w.bc, w.slice_id, w.trace_id, f.src FROM up w JOIN fl f ON {_same('w', 'f')} AND f.dst = w.id",
    "kp": f"(SELECT * FROM up UNION SELECT {KEY}, idx FROM ow WHERE func = 'f3') UNION SELECT w.target, w.bc, w.slice_id, w.trace_id, f.dst FROM kp w JOIN fl f ON {_same('w', 'f')} AND f.src = w.id",
}
O["dugraph_kept"] = sql("tt", "SELECT * FROM kp", **KEPT)
O["dugraph_spliced"] = sql("tt", f"SELECT * FROM (SELECT {KEY}, id AS src, lead(id) OVER (PARTITION BY {KEY} ORDER BY id) AS dst FROM kp) WHERE dst IS NOT NULL", **KEPT)
O["block_paths"] = """SELECT func, stop, path FROM (SELECT DISTINCT 'region' || lpad(n_regionkey::VARCHAR, 8, '0') AS func, 'part' || lpad(l_partkey::VARCHAR, 8, '0') AS stop,
'region' || lpad(n_regionkey::VARCHAR, 8, '0') || '>nation' || lpad(n_nationkey::VARCHAR, 8, '0') || '>customer' || lpad(c_custkey::VARCHAR, 8, '0') || '>order' || lpad(o_orderkey::VARCHAR, 8, '0') || '>part' || lpad(l_partkey::VARCHAR, 8, '0') AS path
FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey) QUALIFY row_number() OVER (PARTITION BY func, stop ORDER BY path) <= 2"""
O["choices_page"] = """WITH RECURSIVE o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS i, list(l_linenumber::VARCHAR ORDER BY l_linenumber::VARCHAR) AS opts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey),
c AS (SELECT o_custkey, 0 AS i, r AS number, r::HUGEINT AS rest, '' AS choice FROM (SELECT DISTINCT o_custkey FROM o), range(1000, 1005) t(r)
  UNION ALL SELECT c.o_custkey, c.i + 1, number, rest // len(opts), opts[(rest % len(opts))::BIGINT + 1] || choice FROM c JOIN o ON o.o_custkey = c.o_custkey AND o.i = c.i + 1)
SELECT o_custkey, number, choice FROM c JOIN (SELECT o_custkey, max(i) AS i FROM o GROUP BY o_custkey) USING (o_custkey, i) WHERE rest = 0"""
O["mdc_entropy"] = sql("vec", "SELECT round(-sum(n / t * ln(n / t)), 6) AS entropy, count(*) AS n_clusters, sum(n)::BIGINT AS n_points FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT a, min(b) AS c FROM cl GROUP BY a) GROUP BY c)",
    nn=f"SELECT dp_id AS a, other AS b FROM (SELECT b.dp_id, a.dp_id AS other, {D2} AS d FROM vec a, vec b WHERE a.dp_id <> b.dp_id) QUALIFY row_number() OVER (PARTITION BY dp_id ORDER BY d, other) = 1",
    lk="SELECT a, b FROM nn UNION SELECT b, a FROM nn", cl="SELECT dp_id AS a, dp_id AS b FROM vec UNION SELECT c.a, l.b FROM cl c JOIN lk l ON l.a = c.b")
O["mask_fitness"] = sql("", """SELECT mask::INTEGER AS mask, round(-sum(n / t * ln(n / t)), 6) AS entropy FROM (SELECT mask, count(*) AS n, sum(count(*)) OVER (PARTITION BY mask) AS t
FROM (SELECT mask, list_filter(v, lambda x, i: i <> mask + 1) AS k FROM ve, range(13) r(mask)) GROUP BY mask, k) GROUP BY mask""", cf=_cf, rt=_rt, pr=_pr, ve=VECTOR)
O["outcome_counters"] = sql("ti", f"""SELECT target, bc, {", ".join(f"count_if(outcome = '{o}')::BIGINT AS {o}" for o in ("proper", "duplicate", "no_target", "exceeding_length", "unreachable", "unfinished"))}, count(*)::BIGINT AS explored FROM
(SELECT *, CASE WHEN NOT hit THEN 'no_target' WHEN n > 12 THEN 'exceeding_length' WHEN row_number() OVER (PARTITION BY target, bc, slice_id, seq ORDER BY trace_id) > 1 THEN 'duplicate' WHEN final = 'Ret' THEN 'proper' ELSE 'unfinished' END AS outcome
FROM (SELECT {KEY}, bool_or(is_target) AS hit, count(*) AS n, arg_max(op, idx) AS final, list((op, func) ORDER BY idx) AS seq FROM ti GROUP BY ALL)) GROUP BY target, bc""")
O["alarms_of_points"] = sql("ti", f"""SELECT dp_id, target, bc, slice_id, trace_id, (n_after - n_before)::DOUBLE AS score FROM (SELECT {KEY}, row_number() OVER (ORDER BY bc, target, slice_id, trace_id) - 1 AS dp_id FROM (SELECT DISTINCT {KEY} FROM ti))
JOIN ({_strip(sql("tt", SHAPE))[1:-1]}) USING ({KEY}) WHERE n_before > n_after""")
ORACLES = O
