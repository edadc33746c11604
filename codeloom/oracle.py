"""SQL twins of the registered queries, for DuckDB over the same tables. Written apart from the Spark plans."""

from __future__ import annotations

# Common table expressions, by name, in the order in which they may build on one another.
CTE = {
    "file": r"""SELECT id, path, name, language, repository, "commit", last_updated FROM source_files
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_updated DESC) = 1""",
    "src": r"""SELECT DISTINCT f.id AS file_id, f.path, f.repository, r.content FROM file f
        JOIN files_raw r ON f.path = r.path AND f.repository = r.repository AND f."commit" = r."commit" """,
    "func": r"""SELECT d.id, d.name, d.file_id, d.class_id, coalesce(d.repository, f.repository) AS repository, d.start_line, d.end_line, d.is_method
        FROM (SELECT DISTINCT id, name, file_id, class_id, repository, start_line, end_line, is_method FROM function_defs) d LEFT JOIN file f ON f.id = d.file_id""",
    "cls": "SELECT DISTINCT id, name, file_id, repository, start_line, end_line, parents FROM class_defs",
    "chunk": "SELECT DISTINCT * FROM chunks",
    "owner": r"""SELECT file_id, line, arg_min(id, (end_line - start_line, id)) AS fn FROM (SELECT file_id, id, start_line, end_line, unnest(range(start_line, end_line + 1)) AS line FROM func WHERE start_line > 0 AND end_line >= start_line) GROUP BY ALL""",
    "hit": r"""SELECT file_id, repository, i AS line, unnest(regexp_extract_all(regexp_replace(CASE WHEN py THEN regexp_replace(l, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|#.*$', '', 'g')
        ELSE regexp_replace(l, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|`(?:[^`\\]|\\.)*`|//.*$|/\*.*?\*/|^\s*(?:/?\*.*)$', '', 'g') END,
        '\b(?:def|class|function)\b\s*\*?\s*[A-Za-z_$][A-Za-z0-9_$]*\s*\(', '(', 'g'), '(\.?[A-Za-z_][A-Za-z0-9_]*)(?:<[A-Za-z0-9_, .?]*>)?\(', 1)) AS h FROM (
        SELECT file_id, repository, py, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (
        SELECT file_id, repository, ends_with(lower(path), '.py') AS py, CASE WHEN ends_with(lower(path), '.py') THEN array_to_string(list_transform(string_split_regex(n, '"{3}|''{3}'),
        lambda x, k: CASE WHEN k % 2 = 0 THEN regexp_replace(x, '[^\n]', '', 'g') ELSE x END), '""') ELSE n END AS t FROM (
        SELECT *, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS n FROM src WHERE content IS NOT NULL AND regexp_matches(lower(path), '\.(py|js|jsx|ts|tsx|java)$'))))
        WHERE contains(l, '(')""",
    "site": r"""SELECT md5(s.file_id || ':' || call_name || ':' || s.line) AS id, call_name, dotted AS is_attribute_call, s.file_id AS caller_file_id, o.fn AS caller_function_id, s.repository, s.line AS start_line FROM (
        SELECT file_id, repository, ltrim(h, '.') AS call_name, line, bool_or(starts_with(h, '.')) AS dotted FROM hit
        WHERE ltrim(h, '.') NOT IN ('if','for','while','switch','catch','return','function','def','class','and','or','not','in','elif','assert','lambda',
        'await','super','synchronized','with','except','print') GROUP BY ALL) s LEFT JOIN owner o ON o.file_id = s.file_id AND o.line = s.line
        WHERE NOT EXISTS (SELECT 1 FROM func d WHERE d.start_line > 0 AND d.end_line >= d.start_line AND d.file_id = s.file_id AND d.name = s.call_name AND d.start_line = s.line)""",
    "imp": "SELECT n.file_id, f.repository, target AS module_name, bool_or(import_name IS NOT NULL) AS is_from_import, start_line FROM ({statements}) n JOIN file f ON f.id = n.file_id GROUP BY ALL",
    "res": r"""SELECT s.id AS src, d.id AS dst, CASE WHEN s.caller_file_id = d.file_id THEN 1.0 ELSE 0.7 END::DOUBLE AS score FROM site s
        JOIN func d ON s.repository = d.repository AND s.call_name = d.name QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY score DESC, d.id) = 1""",
    "call": r"""SELECT s.caller_function_id AS caller, r.dst AS callee, max(r.score) AS score, count(*) AS sites FROM res r JOIN site s ON s.id = r.src GROUP BY ALL""",
    "inh": r"""SELECT DISTINCT c.id AS src, p.id AS dst FROM (SELECT id, unnest(parents) AS parent FROM cls) c JOIN cls p ON p.name = c.parent WHERE c.id <> p.id""",
    "cont": r"""SELECT file_id AS src, id AS dst, 'file_function' AS kind FROM func UNION ALL SELECT file_id, id, 'file_class' FROM cls
        UNION ALL SELECT class_id, id, 'class_function' FROM func WHERE class_id IS NOT NULL""",
    "hits": r"""SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v
        WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) <= 10""",
    "more": r"""SELECT q.vec_id - 1 AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v
        WHERE q.vec_id % 20 = 1 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) <= 5""",
    "meta": r"""SELECT vec_id AS id, 'src/f' || (vec_id % 50) || '.py' AS file_path, CASE label % 4 WHEN 0 THEN 'Function' WHEN 1 THEN 'Class' WHEN 2 THEN 'Method' ELSE 'Module' END AS entity_type,
        'e' || vec_id AS entity_id, vec_id * 10 AS start_line, vec_id * 10 + vec_id % 7 AS end_line FROM embeddings""",
    "both": r"""SELECT query_id, id, score, false AS expanded FROM hits UNION ALL SELECT m.query_id, m.id, m.score, true FROM more m
        WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = m.query_id AND h.id = m.id)""",
    "rer": r"""SELECT b.query_id, b.id, b.expanded, m.entity_type, m.start_line, m.end_line, m.file_path, m.entity_id,
        round(least(b.score * CASE WHEN lower(m.entity_type) IN ('function','class') THEN 1.05 ELSE 1.0 END::DOUBLE * CASE WHEN m.end_line - m.start_line < 3 THEN 0.95 ELSE 1.0 END::DOUBLE
        * CASE WHEN b.expanded THEN 0.98 ELSE 1.0 END::DOUBLE, 1.0), 12) AS score FROM both_ b JOIN meta m ON m.id = b.id""",
    "gr": r"""SELECT q.vec_id AS query_id, m.file_path, m.start_line, m.end_line, m.entity_id, m.entity_type, CASE WHEN m.id % 2 = 0 THEN 'definition' ELSE 'usage' END AS search_type
        FROM embeddings q JOIN meta m ON m.id IN (q.vec_id, q.vec_id + 1) WHERE q.vec_id % 20 = 0""",
    "fus": r"""SELECT query_id, file_path, start_line, end_line, v.score, g.search_type, coalesce(nullif(v.entity_id, ''), g.entity_id) AS entity_id,
        coalesce(nullif(v.entity_type, ''), g.entity_type) AS entity_type, CASE WHEN v.entity_id IS NOT NULL AND g.entity_id IS NOT NULL THEN 'both' WHEN v.entity_id IS NOT NULL THEN 'vector' ELSE 'graph' END AS source
        FROM rer v FULL JOIN gr g USING (query_id, file_path, start_line, end_line)""",
    "rnk": r"""SELECT *, round(least(coalesce(score, CASE WHEN source = 'graph' THEN 0.7 ELSE 0.0 END::DOUBLE) * CASE WHEN source = 'both' THEN 1.2 ELSE 1.0 END::DOUBLE
        * CASE WHEN lower(entity_type) IN ('function','class','method') THEN 1.1 ELSE 1.0 END::DOUBLE * CASE WHEN search_type = 'definition' THEN 1.1 ELSE 1.0 END::DOUBLE, 1.0), 12) AS rank_score FROM fus""",
    "dead": "SELECT id, name FROM func WHERE id NOT IN (SELECT callee FROM call) AND name NOT IN ('main', '__main__', '__init__') AND NOT starts_with(name, 'test_') AND NOT starts_with(name, 'Test')",
    "gone": "SELECT id FROM source_files GROUP BY id HAVING min(repository) LIKE 'stale-%'",
    # classes, functions and call sites as the order tables stand for them: a binary tree, and names that many share
    "tree": "SELECT c_custkey AS src, (c_custkey - 1) // 2 AS dst FROM customer WHERE c_custkey > 0",
    "pf": "SELECT s_suppkey AS file_id, n_name AS repository FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    "pd": "SELECT p_partkey AS id, p_name AS name, f.file_id, f.repository FROM part CROSS JOIN (SELECT count(*) AS n FROM supplier) k JOIN pf f ON f.file_id = p_partkey % k.n",
    "ps": "SELECT DISTINCT l_suppkey AS caller_file_id, p_name AS call_name, l_linenumber AS start_line, f.repository FROM lineitem JOIN part ON p_partkey = l_partkey JOIN pf f ON f.file_id = l_suppkey",
    "pr": """SELECT caller_file_id, call_name, start_line, d.id AS dst, CASE WHEN s.caller_file_id = d.file_id THEN 1.0 ELSE 0.7 END::DOUBLE AS score FROM ps s
        JOIN pd d ON d.repository = s.repository AND d.name = s.call_name QUALIFY row_number() OVER (PARTITION BY caller_file_id, call_name, start_line ORDER BY score DESC, d.id) = 1""",
    "ev": r"""SELECT event_id, ts, user_id, event_type, value, CASE event_type WHEN 'view' THEN 'FILE_PROCESSED' WHEN 'click' THEN 'ENTITY_CREATED' WHEN 'purchase' THEN 'RELATIONSHIP_CREATED'
        WHEN 'signup' THEN 'STAGE_STARTED' WHEN 'error' THEN 'ERROR' ELSE 'CUSTOM' END AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
}
CTE["both_"] = CTE.pop("both")
ORDER = ["file", "src", "func", "cls", "chunk", "owner", "hit", "site", "imp", "res", "call", "inh", "cont", "hits", "more", "meta", "both_", "rer", "gr", "fus", "rnk", "dead", "gone", "tree", "pf", "pd", "ps", "pr", "ev"]


def sql(body: str, recursive: str = "") -> str:
    """A query with the table expressions that it and they mention."""
    import re

    from codeloom.oracle_lookups import statements

    CTE["imp"] = CTE["imp"].replace("{statements}", statements())
    need, text = set(), body + recursive
    while True:
        more = {n for n in ORDER if n not in need and re.search(rf"\b{n}\b", text)}
        if not more:
            break
        need |= more
        text += " ".join(CTE[n] for n in more)
    parts = [f"{n} AS ({CTE[n]})" for n in ORDER if n in need] + ([recursive] if recursive else [])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " " if parts else "") + body


LANG = "CASE regexp_extract(lower(path), '(\\.[^./]+)$', 1) {} END"


def _case(table: dict[str, str]) -> str:
    return LANG.format(" ".join(f"WHEN '{e}' THEN '{v}'" for e, v in table.items()))


def _split(kind: str) -> str:
    from codeloom.operators.chunking import STARTS, STOPS

    def test(table: dict[str, str]) -> str:
        return f"CASE WHEN family = '.py' THEN regexp_matches(l, '{table['.py']}') ELSE regexp_matches(l, '{table['.js']}') END"

    lines = "string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
    return sql(
        f"""SELECT file_id, a AS start_line, b AS end_line, md5(array_to_string(list_slice(ls, a, b), chr(10))) AS hash FROM (
        SELECT file_id, ls, i AS a, coalesce(lead(i) OVER (PARTITION BY file_id ORDER BY i) - 1, len(ls)) AS b, {test(STARTS[kind])} AS begins FROM (
        SELECT file_id, family, ls, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
        SELECT file_id, {lines} AS ls, CASE WHEN ends_with(lower(path), '.py') THEN '.py' WHEN ends_with(lower(path), '.js') OR ends_with(lower(path), '.ts') THEN '.js' END AS family FROM src)
        WHERE family IS NOT NULL AND ls IS NOT NULL) WHERE {test(STOPS[kind])} OR {test(STARTS[kind])}) WHERE begins"""
    )


def queries() -> dict[str, str]:
    from codeloom.functions import text as t

    lines = "string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
    words = lambda name, table: "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({name}), '{p}')" for p in ps) + f" THEN '{k}' END" for k, ps in table.items()) + "], lambda x: x IS NOT NULL)"
    from codeloom.operators.search import INTENTS, MENTIONS

    intent = words("text", INTENTS)
    metric = lambda expr, order: f"SELECT q.vec_id AS query_id, v.vec_id AS id, round({expr}, 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score {order}, v.vec_id) <= 10"
    d = "::DOUBLE[]"
    return {
        "files_current": sql("SELECT id, path, repository, language FROM file"),
        "indexable_files": sql(
            "SELECT file_id FROM src WHERE regexp_extract(lower(path), '(\\.[^./]+)$', 1) NOT IN ("
            + ", ".join(f"'{e}'" for e in t.IGNORED_EXTENSIONS)
            + ") AND NOT list_has_any(string_split(path, '/'), ["
            + ", ".join(f"'{e}'" for e in t.IGNORED_FOLDERS)
            + "]) AND coalesce(strlen(content), 0) <= 1048576"
        ),
        "parse_gate": sql(
            "SELECT coalesce(CASE WHEN coalesce(content, '') = '' THEN 'no content' WHEN length(content) > 1048576 THEN 'too long' END, 'parse') AS outcome, count(*) AS n FROM src GROUP BY 1"
        ),
        "snapshot_diff": sql(
            """SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'A' WHEN n.id IS NULL THEN 'D' ELSE 'M' END AS change_type
            FROM (SELECT s.id, arg_min(s."commit", s.last_updated) AS h FROM source_files s JOIN file f ON f.id = s.id WHERE s.last_updated < f.last_updated GROUP BY s.id) o
            FULL JOIN (SELECT id, "commit" AS h FROM file) n ON o.id = n.id WHERE o.h IS DISTINCT FROM n.h"""
        ),
        "language_by_ext": sql(
            f"SELECT id, {_case(t.PARSER)} AS parser, coalesce({_case(t.CHUNKER)}, 'unknown') AS chunker, coalesce({_case(t.CHUNK_TOOL)}, 'unknown') AS tool, {_case(t.EXTRACTOR)} AS extractor FROM file"
        ),
        "language_by_content": sql(
            r"""SELECT chunk_id, CASE WHEN content IS NULL THEN NULL WHEN regexp_matches(content, '^\s*<\?php') THEN 'php'
            WHEN contains(content, 'function') AND contains(content, '{') AND contains(content, '}') AND contains(content, ';') THEN 'javascript'
            WHEN contains(content, 'def ') AND contains(content, ':') AND contains(content, 'import ') THEN 'python'
            WHEN contains(content, 'class ') AND contains(content, '{') AND contains(content, 'public') AND contains(content, ';') THEN 'java'
            WHEN contains(content, 'package ') AND contains(content, 'import') AND contains(content, 'func ') THEN 'go' ELSE 'unknown' END AS language FROM chunk"""
        ),
        "url_normalise": sql(
            r"""SELECT DISTINCT repository_url, regexp_replace(regexp_replace(repository_url, '/+$', ''), '\.git$', '') AS url,
            regexp_replace(regexp_extract(regexp_replace(regexp_replace(repository_url, '/+$', ''), '\.git$', ''), '([^/]*)$', 1), '[^A-Za-z0-9_-]', '_', 'g') AS name FROM source_files"""
        ),
        "content_hash": sql("SELECT md5(content) AS hash, count(*) AS files, count(DISTINCT repository) AS repositories FROM src WHERE content IS NOT NULL GROUP BY 1"),
        "binary_files": sql(
            "SELECT file_id, regexp_extract(lower(path), '(\\.[^./]+)$', 1) IN ("
            + ", ".join(f"'{e}'" for e in t.BINARY_EXTENSIONS)
            + r") OR coalesce(regexp_matches(substr(content, 1, 1024), '[^\x07-\x0a\x0c\x0d\x1b\x20-\x7e]'), false) AS is_binary FROM src"
        ),
        "line_tokens": sql(
            f"""SELECT file_id, sum(greatest(1, len(regexp_extract_all(l, '\\S+')) + length(regexp_replace(l, '[^().,;]', '', 'g'))))::BIGINT AS tokens
            FROM (SELECT file_id, unnest({lines}) AS l FROM src WHERE content IS NOT NULL) GROUP BY 1"""
        ),
        "entity_chunks": sql(
            f"""SELECT e.id AS entity_id, md5(array_to_string(list_slice(ls, e.start_line, e.end_line), chr(10))) AS hash FROM
            (SELECT id, file_id, start_line, end_line FROM func UNION ALL SELECT id, file_id, start_line, end_line FROM cls) e
            JOIN (SELECT file_id, {lines} AS ls FROM src WHERE content IS NOT NULL) s USING (file_id) WHERE e.start_line > 0 AND e.end_line >= e.start_line AND e.end_line <= len(ls)"""
        ),
        "header_chunks": sql(
            f"""SELECT file_id, end_line, md5(content) AS hash FROM (SELECT s.file_id, f - 1 AS end_line, array_to_string(list_slice(ls, 1, f - 1), chr(10)) AS content FROM
            (SELECT file_id, {lines} AS ls FROM src) s JOIN (SELECT file_id, min(start_line) AS f FROM (SELECT file_id, start_line FROM func UNION ALL SELECT file_id, start_line FROM cls)
            WHERE start_line > 0 GROUP BY 1) USING (file_id) WHERE f > 1) WHERE regexp_matches(content, '\\S')"""
        ),
        "split_functions": _split("function"),
        "split_classes": _split("class"),
        "graph_report": sql(
            """SELECT 'nodes' AS section, 'file' AS key, count(*)::DOUBLE AS value FROM file UNION ALL SELECT 'nodes', 'class', count(*) FROM cls UNION ALL SELECT 'nodes', 'function', count(*) FROM func
            UNION ALL SELECT 'nodes', 'call_site', count(*) FROM site UNION ALL SELECT 'nodes', 'import_site', count(*) FROM imp UNION ALL SELECT 'edges', 'contains', count(*) FROM cont
            UNION ALL SELECT 'edges', 'inherits_from', count(*) FROM inh UNION ALL SELECT 'edges', 'resolves_to', count(*) FROM res UNION ALL SELECT 'edges', 'calls', count(*) FROM call
            UNION ALL SELECT 'dead', 'functions', count(*) FROM dead
            UNION ALL SELECT 'dead', 'classes', count(*) FROM cls WHERE NOT starts_with(name, 'Test') AND NOT ends_with(name, 'Test') AND NOT ends_with(name, 'TestCase')
            AND id NOT IN (SELECT dst FROM inh) AND id NOT IN (SELECT class_id FROM call JOIN func f ON f.id = callee WHERE class_id IS NOT NULL)
            UNION ALL SELECT 'resolution', 'total', count(*) FROM site UNION ALL SELECT 'resolution', 'resolved', count(*) FROM res
            UNION ALL SELECT 'resolution', 'pct', round((SELECT count(*) FROM res) * 100.0::DOUBLE / (SELECT count(*) FROM site), 6)
            UNION ALL SELECT 'callers', 'nodes', count(*) FROM func UNION ALL SELECT 'callers', 'avg_degree', round((SELECT count(*) FROM call)::DOUBLE / (SELECT count(*) FROM func), 6)
            UNION ALL SELECT 'callers', 'max_degree', coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM call GROUP BY callee)
            UNION ALL SELECT 'methods', 'nodes', count(*) FROM cls UNION ALL SELECT 'methods', 'avg_degree', round((SELECT count(*) FROM func WHERE class_id IN (SELECT id FROM cls))::DOUBLE / (SELECT count(*) FROM cls), 6)
            UNION ALL SELECT 'methods', 'max_degree', coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM func WHERE class_id IN (SELECT id FROM cls) GROUP BY class_id)
            UNION ALL SELECT 'languages', coalesce(language, 'none'), count(*) FROM file GROUP BY ALL"""
        ),
        "format_for_embedding": sql(
            """SELECT chunk_id, md5('LANGUAGE: ' || coalesce(language, 'unknown') || chr(10) || 'FILE: ' || coalesce(file_path, '') || chr(10) || 'TYPE: ' ||
            CASE WHEN content_type IN ('class', 'function', 'header') THEN content_type ELSE 'code' END || chr(10) ||
            coalesce(CASE WHEN content_type = 'class' AND cn <> '' THEN 'CLASS: ' || cn || chr(10) WHEN content_type = 'function' AND fn <> '' THEN 'FUNCTION: ' || fn || chr(10) END, '') || chr(10) || coalesce(content, '')) AS hash
            FROM (SELECT *, trim(split_part(split_part(split_part(list_filter(string_split(content, chr(10)), lambda x: contains(x, 'class ') AND contains(x, ':'))[1], 'class ', 2), '(', 1), ':', 1)) AS cn,
            trim(split_part(CASE WHEN contains(fl, 'def ') THEN split_part(fl, 'def ', 2) ELSE split_part(fl, 'function ', 2) END, '(', 1)) AS fn FROM
            (SELECT *, list_filter(string_split(content, chr(10)), lambda x: (contains(x, 'def ') OR contains(x, 'function ')) AND contains(x, '('))[1] AS fl FROM chunk))"""
        ),
        "call_sites": sql("SELECT id, call_name, is_attribute_call, caller_file_id, caller_function_id, repository, start_line FROM site"),
        "import_sites": sql("SELECT file_id, repository, module_name, is_from_import, start_line FROM imp"),
        "contains_edges": sql("SELECT src, dst, kind FROM cont"),
        "inherits_edges": sql("SELECT src, dst FROM inh"),
        "parents_named": sql("SELECT parent, count(*) AS children, count(DISTINCT repository) AS repositories FROM (SELECT id, repository, unnest(parents) AS parent FROM cls) GROUP BY 1"),
        "resolve_calls": sql("SELECT src, dst, score FROM res"),
        "resolve_calls_naive": sql("SELECT src, dst, score FROM res"),
        "resolve_ladder": sql(
            r"""SELECT s.id AS src, coalesce(min(d.id) FILTER (d.file_id = s.caller_file_id), min(d.id) FILTER (pd.folder = ps.folder),
            min(d.id) FILTER (EXISTS (SELECT 1 FROM imp i WHERE i.file_id = s.caller_file_id AND regexp_extract(i.module_name, '([A-Za-z0-9_-]+)(?:\.js|\.ts)?$', 1) = pd.stem AND pd.stem <> '')), min(d.id)) AS dst,
            CASE WHEN bool_or(d.file_id = s.caller_file_id) THEN 1.0 WHEN bool_or(pd.folder = ps.folder) THEN 0.9
            WHEN bool_or(EXISTS (SELECT 1 FROM imp i WHERE i.file_id = s.caller_file_id AND regexp_extract(i.module_name, '([A-Za-z0-9_-]+)(?:\.js|\.ts)?$', 1) = pd.stem AND pd.stem <> '')) THEN 0.8 ELSE 0.5 END::DOUBLE AS score
            FROM site s JOIN func d ON d.repository = s.repository AND d.name = s.call_name
            JOIN (SELECT id, regexp_replace(path, '/?[^/]*$', '') AS folder, regexp_extract(path, '([^/]*?)(?:\.[^./]*)?$', 1) AS stem FROM file) pd ON pd.id = d.file_id
            JOIN (SELECT id, regexp_replace(path, '/?[^/]*$', '') AS folder FROM file) ps ON ps.id = s.caller_file_id GROUP BY s.id"""
        ),
        "resolve_qualified": sql(
            """SELECT s.id AS src, coalesce(min(d.id) FILTER (s.is_attribute_call AND d.class_id IN (SELECT id FROM cls)), min(d.id)) AS dst,
            CASE WHEN bool_or(s.is_attribute_call AND d.class_id IN (SELECT id FROM cls)) THEN 1.0 ELSE 0.8 END::DOUBLE AS score
            FROM site s JOIN func d ON d.repository = s.repository AND d.name = s.call_name GROUP BY s.id"""
        ),
        "resolve_new": sql("SELECT r.src, r.dst, r.score FROM res r JOIN site s ON s.id = r.src JOIN file f ON f.id = s.caller_file_id WHERE NOT f.last_updated < TIMESTAMP '2025-07-01'"),
        "calls": sql("SELECT caller, callee, score, sites FROM call"),
        "node_counts": sql(
            """SELECT 'File' AS label, count(*) AS n FROM file UNION ALL SELECT 'Class', count(*) FROM cls UNION ALL SELECT 'Function', count(*) FROM func
            UNION ALL SELECT 'CallSite', count(*) FROM site UNION ALL SELECT 'ImportSite', count(*) FROM imp"""
        ),
        "rel_counts": sql(
            """SELECT 'CONTAINS' AS rel_type, count(*) AS n FROM cont UNION ALL SELECT 'RESOLVES_TO', count(*) FROM res UNION ALL SELECT 'CALLS', count(*) FROM call
            UNION ALL SELECT 'INHERITS_FROM', count(*) FROM inh UNION ALL SELECT 'IMPORTS', count(*) FROM imp"""
        ),
        "repo_stats": sql("SELECT repository, count(*) AS files FROM file GROUP BY 1"),
        "function_stats": sql("SELECT count(*) AS nodes, round(avg(coalesce(n, 0)), 6) AS avg_degree, coalesce(max(n), 0) AS max_degree FROM func LEFT JOIN (SELECT callee, count(*) AS n FROM call GROUP BY 1) ON callee = id"),
        "class_stats": sql("SELECT count(*) AS nodes, round(avg(coalesce(n, 0)), 6) AS avg_degree, coalesce(max(n), 0) AS max_degree FROM cls LEFT JOIN (SELECT class_id, count(*) AS n FROM func GROUP BY 1) m ON m.class_id = id"),
        "call_resolution_stats": sql("SELECT count(*) AS total, count(r.src) AS resolved, round(count(r.src) * 100.0::DOUBLE / count(*), 6) AS pct FROM site LEFT JOIN res r ON r.src = id"),
        "import_resolution_stats": sql(
            r"""SELECT count(*) AS total, count(s.stem) AS resolved, round(count(s.stem) * 100.0::DOUBLE / count(*), 6) AS pct FROM imp i
            LEFT JOIN (SELECT DISTINCT repository, regexp_extract(path, '([^/]*?)(?:\.[^./]*)?$', 1) AS stem FROM file) s
            ON s.repository = i.repository AND s.stem = regexp_extract(i.module_name, '([A-Za-z0-9_-]+)(?:\.js|\.ts)?$', 1)"""
        ),
        "top_called": sql("SELECT f.id, f.name, count(*) AS callers FROM call JOIN func f ON f.id = callee GROUP BY ALL ORDER BY callers DESC, f.id LIMIT 10"),
        "top_files": sql("SELECT file_id, count(*) AS functions FROM func GROUP BY 1 ORDER BY functions DESC, file_id LIMIT 10"),
        "most_called_names": sql("SELECT call_name, count(*) AS sites, count(DISTINCT caller_file_id) AS files FROM site GROUP BY 1"),
        "dead_functions": sql(
            "SELECT f.id, f.name, f.file_id, p.path, p.language FROM func f LEFT JOIN file p ON p.id = f.file_id WHERE f.id NOT IN (SELECT callee FROM call) AND f.name NOT IN ('main', '__main__', '__init__') AND NOT starts_with(f.name, 'test_') AND NOT starts_with(f.name, 'Test')"
        ),
        "dead_functions_filtered": sql(
            "SELECT id, name FROM func f WHERE id NOT IN (SELECT callee FROM call) AND name NOT IN ('main', '__main__', '__init__') AND NOT starts_with(name, 'test_') AND NOT starts_with(name, 'Test') AND NOT regexp_full_match(name, '_.*') AND NOT regexp_full_match(name, 'emit.*')"
        ),
        "dead_classes": sql(
            """SELECT id, name FROM cls WHERE NOT starts_with(name, 'Test') AND NOT ends_with(name, 'Test') AND NOT ends_with(name, 'TestCase')
            AND id NOT IN (SELECT dst FROM inh) AND id NOT IN (SELECT class_id FROM call JOIN func f ON f.id = callee WHERE class_id IS NOT NULL)"""
        ),
        "dead_samples": sql(
            """SELECT (SELECT count(*) FROM dead) AS n, (SELECT list(s ORDER BY s) FROM (SELECT name || ':' || id AS s FROM dead ORDER BY name, id LIMIT 10)) AS samples""",
        ),
        "language_breakdown": sql("SELECT language, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM file), 6) AS pct FROM file GROUP BY 1"),
        "calls_per_function": sql("SELECT f.id, count(s.id) AS calls FROM func f LEFT JOIN site s ON s.caller_function_id = f.id GROUP BY 1"),
        "param_histogram": sql("SELECT least(coalesce(len(params), 0), 5) AS bucket, count(*) AS n FROM (SELECT DISTINCT * FROM function_defs) GROUP BY 1"),
        "callers_of": sql("SELECT c.callee, f.name AS callee_name, c.caller, g.name AS caller_name, g.file_id AS caller_file, c.score FROM call c JOIN func f ON f.id = c.callee JOIN func g ON g.id = c.caller"),
        "calls_both_ways": sql("SELECT f.id, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees FROM func f LEFT JOIN (SELECT callee, count(*) AS n FROM call GROUP BY 1) i ON i.callee = f.id LEFT JOIN (SELECT caller, count(*) AS n FROM call GROUP BY 1) o ON o.caller = f.id"),
        "cross_file_strength": sql("SELECT a.file_id AS src_file, b.file_id AS dst_file, count(*) AS strength FROM call JOIN func a ON a.id = caller JOIN func b ON b.id = callee WHERE a.file_id <> b.file_id GROUP BY ALL"),
        "dependants_of_file": sql("SELECT b.file_id AS id, count(DISTINCT a.file_id) AS dependants FROM call JOIN func a ON a.id = caller JOIN func b ON b.id = callee WHERE a.file_id <> b.file_id GROUP BY 1"),
        "import_strength": sql("SELECT repository, module_name, count(DISTINCT file_id) AS files, count(*) AS imports FROM imp GROUP BY ALL"),
        "package_imports": sql("SELECT split_part(module_name, '.', 1) AS package, count(DISTINCT file_id) AS files FROM imp GROUP BY 1"),
        "class_closure": sql("SELECT src, dst, min(depth) AS depth FROM walk GROUP BY ALL", "walk AS (SELECT src, dst, 1 AS depth FROM tree UNION ALL SELECT w.src, i.dst, w.depth + 1 FROM walk w JOIN tree i ON i.src = w.dst)"),
        "hierarchy_1_3": sql("SELECT src, dst, min(depth) AS depth FROM walk GROUP BY ALL", "walk AS (SELECT src, dst, 1 AS depth FROM tree UNION ALL SELECT w.src, i.dst, w.depth + 1 FROM walk w JOIN tree i ON i.src = w.dst WHERE w.depth < 3)"),
        "resolve_projected": sql("SELECT caller_file_id, call_name, start_line, dst, score FROM pr"),
        "dead_projected": sql("SELECT d.id, d.name, d.file_id, d.repository FROM pd d WHERE d.id NOT IN (SELECT dst FROM pr)"),
        "calls_projected": sql("SELECT s.caller_file_id AS src_file, d.file_id AS dst_file, count(*) AS strength FROM pr s JOIN pd d ON d.id = s.dst WHERE s.caller_file_id <> d.file_id GROUP BY ALL"),
        "containment_closure": sql("SELECT src, dst, min(depth) AS depth FROM walk GROUP BY ALL", "walk AS (SELECT src, dst, 1 AS depth FROM cont WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT w.src, i.dst, w.depth + 1 FROM walk w JOIN cont i ON i.src = w.dst WHERE w.depth < 4)"),
        "file_delete_cascade": sql(
            """SELECT DISTINCT id FROM (SELECT id FROM gone UNION ALL SELECT dst FROM cont JOIN gone ON id = src UNION ALL
            SELECT c2.dst FROM cont c1 JOIN gone ON id = c1.src JOIN cont c2 ON c2.src = c1.dst)"""
        ),
        "class_methods": sql("SELECT c.id, c.name, count(f.id) AS methods, string_agg(f.name, ',' ORDER BY f.name, f.id) AS names FROM cls c LEFT JOIN func f ON f.class_id = c.id GROUP BY ALL"),
        "definitions": sql("SELECT f.name, f.id, p.path, f.start_line, f.end_line, c.name AS class_name FROM func f JOIN file p ON p.id = f.file_id LEFT JOIN cls c ON c.id = f.class_id"),
        "usages": sql("SELECT s.call_name, s.caller_function_id, p.path, s.start_line FROM site s JOIN file p ON p.id = s.caller_file_id WHERE s.call_name IN (SELECT name FROM func)"),
        "inheritance_relations": sql(
            """SELECT c.id, p.name AS related, 'child' AS relationship_type FROM inh JOIN cls c ON c.id = src JOIN cls p ON p.id = dst
            UNION ALL SELECT p.id, c.name, 'parent' FROM inh JOIN cls c ON c.id = src JOIN cls p ON p.id = dst"""
        ),
        "general_lookup": sql("SELECT label, name, id FROM (SELECT 'Function' AS label, name, id FROM func UNION ALL SELECT 'Class', name, id FROM cls) WHERE name IN (SELECT name FROM func GROUP BY name HAVING count(*) > 1)"),
        "upsert_files": sql('SELECT id, "commit", last_updated FROM file'),
        "upsert_edges": sql("SELECT caller AS src, callee AS dst, 'CALLS' AS rel_type FROM call WHERE caller IN (SELECT id FROM func) AND callee IN (SELECT id FROM func)"),
        "clear_repository": sql("SELECT repository, count(*) AS n FROM file WHERE repository <> 'atlas-mono' GROUP BY 1"),
        "delete_vectors": sql("SELECT count(*) AS n FROM chunk_vectors WHERE NOT coalesce(language = 'python' AND start_line > 20, false)"),
        "vector_topk_cosine": metric(f"list_cosine_similarity(q.embedding{d}, v.embedding{d})", "DESC"),
        "vector_topk_ip": metric(f"list_inner_product(q.embedding{d}, v.embedding{d})", "DESC"),
        "vector_topk_l2": metric(f"list_distance(q.embedding{d}, v.embedding{d})", "ASC"),
        "vector_filtered": f"SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding{d}, v.embedding{d}), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND (v.label IN (1, 2, 3) AND (v.vec_id >= 50 OR v.label = 2)) QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) <= 10",
        "vector_threshold": sql("SELECT query_id, id, score FROM hits WHERE score >= 0.2"),
        "vector_counts": "SELECT language, entity_type, count(*) AS n FROM (SELECT DISTINCT id, language, entity_type FROM chunk_vectors) GROUP BY ALL",
        "vector_filter_counts": """SELECT 'eq' AS test, count(*) AS n FROM chunk_vectors WHERE language = 'python' UNION ALL SELECT 'ne', count(*) FROM chunk_vectors WHERE language <> 'python'
            UNION ALL SELECT 'in', count(*) FROM chunk_vectors WHERE language IN ('java', 'typescript') UNION ALL SELECT 'range', count(*) FROM chunk_vectors WHERE start_line >= 10 AND start_line < 40
            UNION ALL SELECT 'and_or', count(*) FROM chunk_vectors WHERE entity_type = 'function' AND (language = 'python' OR language = 'java') AND end_line > 30 UNION ALL SELECT 'none', count(*) FROM chunk_vectors""",
        "merge_expanded": sql("SELECT query_id, id, score, expanded FROM both_"),
        "rerank": sql("SELECT query_id, id, score, expanded FROM rer"),
        "fuse_results": sql("SELECT query_id, file_path, start_line, end_line, score, search_type, entity_id, entity_type, source FROM fus"),
        "rank_results": sql("SELECT query_id, file_path, start_line, end_line, rank_score, source FROM rnk"),
        "select_snippets": sql(
            """SELECT query_id, entity_id, rank_score, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, entity_id) AS pos FROM (
            SELECT * FROM rnk QUALIFY row_number() OVER (PARTITION BY query_id, entity_id ORDER BY rank_score DESC, file_path, start_line, end_line) = 1)) WHERE pos <= 3"""
        ),
        "result_type_counts": sql(
            """SELECT 'entity_type' AS dimension, entity_type AS value, count(*) AS n FROM rnk WHERE entity_type <> '' GROUP BY ALL UNION ALL SELECT 'search_type', search_type, count(*) FROM rnk WHERE search_type <> '' GROUP BY ALL
            UNION ALL SELECT 'source', source, count(*) FROM rnk WHERE source <> '' GROUP BY ALL"""
        ),
        "answers": sql(
            """SELECT query_id, 'Found ' || count(*) || ' results in ' || count(DISTINCT file_path) || ' files; best is `' || arg_max(entity_id, (rank_score, entity_id)) || '`' AS answer FROM rnk GROUP BY 1"""
        ),
        "intent_flags": f"""SELECT doc_id, array_to_string(i, ',') AS intents, list_contains(i, 'execution') AS requires_code_execution,
            list_contains(i, 'definition') OR list_contains(i, 'usage') OR list_contains(i, 'inheritance') AS requires_structural_search FROM (
            SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len({intent}) > 0 THEN {intent} ELSE ['information'] END AS i FROM documents)""",
        "language_mentions": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string({words('text', MENTIONS)}, ',') END AS languages FROM documents",
        "query_expansion": """SELECT doc_id, CASE WHEN text IS NOT NULL THEN md5(array_to_string(list_slice(CASE WHEN len(s) < 3 THEN list_concat(s, ['code that ' || text, 'implementation of ' || text, 'function for ' || text]) ELSE s END, 1, 3), '|')) END AS hash FROM (
            SELECT doc_id, text, list_filter([CASE WHEN contains(lower(text), 'how') THEN replace(lower(text), 'how', 'what is the way') END, CASE WHEN contains(lower(text), 'where') THEN replace(lower(text), 'where', 'in which location') END,
            CASE WHEN contains(lower(text), 'find') THEN replace(lower(text), 'find', 'locate') END], lambda x: x IS NOT NULL) AS s FROM documents)""",
        "entity_words": r"""SELECT doc_id, coalesce(len(list_distinct(l)), 0) AS n, l[1] AS first FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[().]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
            lambda w: (regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]')) OR contains(w, '_')) AS l FROM documents)""",
        "event_stats": sql(
            """SELECT count(*) FILTER (kind = 'FILE_PROCESSED') AS file_count, sum(CASE WHEN kind = 'ENTITY_CREATED' THEN coalesce(k, 1) ELSE 0 END)::BIGINT AS entity_count,
            sum(CASE WHEN kind = 'RELATIONSHIP_CREATED' THEN coalesce(k, 1) ELSE 0 END)::BIGINT AS relationship_count, count(*) FILTER (kind = 'ERROR') AS error_count, count(*) FILTER (kind = 'WARNING') AS warning_count,
            strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
            round(count(*) FILTER (kind = 'FILE_PROCESSED') / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS files_per_second FROM ev"""
        ),
        "event_rates": sql("SELECT kind, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY ALL"),
        "stage_durations": sql(
            """SELECT event_id, source, round((epoch_us(ts) - epoch_us(started)) / 1e6, 6) AS seconds FROM (SELECT event_id, user_id AS source, ts, kind,
            last_value(CASE WHEN kind = 'STAGE_STARTED' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS started FROM ev
            WHERE kind IN ('STAGE_STARTED', 'RELATIONSHIP_CREATED')) WHERE kind = 'RELATIONSHIP_CREATED' AND started IS NOT NULL"""
        ),
        "event_tumbling": sql("SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY ALL"),
        "event_stream_tumbling": sql("SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY ALL"),
        "event_sliding": sql(
            """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
            SELECT *, unnest([time_bucket(INTERVAL '3 hours', ts), time_bucket(INTERVAL '3 hours', ts) - INTERVAL '3 hours']) AS w FROM ev) GROUP BY ALL"""
        ),
        "event_sessions": sql(
            """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM ev)) GROUP BY user_id, s"""
        ),
        "recent_files": sql("SELECT id, path FROM file ORDER BY last_updated DESC, id LIMIT 10"),
        "id_rules": sql("SELECT id = md5(repository || ':' || path) AS \"right\", count(*) AS n FROM file GROUP BY 1"),
        "stream_files": sql('SELECT id, "commit" FROM file'),
    }
