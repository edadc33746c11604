"""SQL twins of the queries of lookups.py, and of chunk windows and line counts, for DuckDB."""

from __future__ import annotations


LINES = "string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
FAMILY = r"CASE WHEN regexp_matches(lower(path), '\.py$') THEN 'python' WHEN regexp_matches(lower(path), '\.(js|ts|jsx|tsx)$') THEN 'script' WHEN regexp_matches(lower(path), '\.java$') THEN 'java' END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _names() -> str:
    """Imported names."""
    return f"SELECT DISTINCT file_id, module_name, import_name, alias, level FROM ({statements()})"


def statements() -> str:
    """Names of import statements with their lines, statement form by statement form."""
    from codeloom.sources import imports as i

    def all_(pattern: str, group: int = 0) -> str:
        return f"unnest(regexp_extract_all(content, {_quoted(pattern)}, {group}))"

    blank = r"regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^\s+', ''), '\s+$', '')"
    items = lambda e: f"unnest(list_transform(string_split(regexp_replace({e}, '#[^\\n]*|[(){{}}]', ' ', 'g'), ','), lambda x: {blank}))"
    name = r"coalesce(nullif(regexp_extract(item, '^(.*?)\s+as\s+', 1), ''), item)"
    alias = r"nullif(regexp_extract(item, '\s+as\s+(\S+)$', 1), '')"
    src = f"(SELECT file_id, {FAMILY} AS family, content FROM src WHERE content IS NOT NULL)"
    line = "1 + length(regexp_replace(left(content, strpos(content, s) + length(s) - length(ltrim(s, ' ')) - 1), '[^\\n]', '', 'g')) AS start_line"
    frm = f"(SELECT file_id, {line}, regexp_extract(s, 'from[ \\t]+([.\\w]+)', 1) AS module, {items(chr(114) + 'egexp_extract(s, ' + _quoted('[ \\t]import[ \\t]+([\\s\\S]*)$') + ', 1)')} AS item FROM (SELECT file_id, content, {all_(i.PY_FROM)} AS s FROM {src} WHERE family = 'python'))"
    plain = f"(SELECT file_id, {line}, {items('regexp_extract(s, ' + _quoted('import[ \\t]+([\\s\\S]*)$') + ', 1)')} AS item FROM (SELECT file_id, content, {all_(i.PY_PLAIN)} AS s FROM {src} WHERE family = 'python'))"
    clause = "regexp_replace(regexp_extract(s, " + _quoted(r"""^\s*(?:import|export)\b\s*(?:type\b)?([\s\S]*?)\bfrom[ \t]*['"]""") + r", 1), '\*\s+as\s+', '* as ', 'g')"
    js = f"(SELECT file_id, {line}, regexp_extract(s, {_quoted(chr(91) + chr(39) + chr(34) + '](' + chr(91) + '^' + chr(39) + chr(34) + ']+)[' + chr(39) + chr(34) + ']$')}, 1) AS module, {items(clause)} AS item FROM (SELECT file_id, content, {all_(i.JS_FROM)} AS s FROM {src} WHERE family = 'script'))"
    bare = f"(SELECT file_id, {line}, regexp_extract(s, {_quoted(chr(91) + chr(39) + chr(34) + '](' + chr(91) + '^' + chr(39) + chr(34) + ']+)[' + chr(39) + chr(34) + ']')}, 1) AS module FROM (SELECT file_id, content, unnest(list_concat(regexp_extract_all(content, {_quoted(i.JS_BARE)}, 0), regexp_extract_all(content, {_quoted(i.JS_REQUIRE)}, 0))) AS s FROM {src} WHERE family = 'script'))"
    java = f"(SELECT file_id, {line}, regexp_extract(s, {_quoted(i.JAVA)}, 1) AS item FROM (SELECT file_id, content, {all_(i.JAVA)} AS s FROM {src} WHERE family = 'java'))"
    return f"""SELECT DISTINCT * FROM (
        SELECT file_id, start_line, ltrim(module, '.') AS module_name, {name} AS import_name, {alias} AS alias, length(module) - length(ltrim(module, '.')) AS level, ltrim(module, '.') AS target FROM {frm} WHERE item <> ''
        UNION ALL SELECT file_id, start_line, {name}, NULL, {alias}, 0, {name} FROM {plain} WHERE item <> ''
        UNION ALL SELECT file_id, start_line, module, {name}, {alias}, 0, module FROM {js} WHERE item <> ''
        UNION ALL SELECT file_id, start_line, module, NULL, NULL, 0, module FROM {bare}
        UNION ALL SELECT file_id, start_line, regexp_replace(item, '\\.?[^.]*$', ''), regexp_extract(item, '([^.]*)$', 1), NULL, 0, item FROM {java})"""


def _declared() -> str:
    from codeloom.sources import imports as i

    pairs = ", ".join(
        f"{{'kind': '{kind}', 'name': CASE WHEN family = '{language}' THEN regexp_extract(line, {_quoted(pattern)}, 1) END}}" for language, kinds in i.DECLARED.items() for kind, pattern in kinds.items()
    )
    words = ", ".join(f"'{w}'" for w in i.STATEMENTS)
    return f"""SELECT file_id, d.kind AS kind, d.name AS name, start_line FROM (SELECT file_id, i AS start_line, unnest([{pairs}]) AS d FROM (
        SELECT file_id, family, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT file_id, {FAMILY} AS family, {LINES} AS ls FROM src WHERE content IS NOT NULL) WHERE family IS NOT NULL))
        WHERE d.name <> '' AND d.name NOT IN ({words})"""


#: Windows of the files of `todo` (file_id, ls): where one ends decides where the next begins.
WINDOWS = r"""sized AS (SELECT file_id, ls, list_transform(ls, lambda l: greatest(1, len(regexp_extract_all(l, '[^ \t\n\r\f\v\x1c-\x1f\x{85}\x{a0}]+')) + length(regexp_replace(l, '[^().,;]', '', 'g')))) AS k FROM todo),
    held AS (SELECT file_id, ls, list_transform(range(1, len(k) + 1), lambda n: list_sum(list_slice(k, 1, n))) AS cum FROM sized),
    win AS (SELECT file_id, cum, 0 AS a, coalesce(list_position(list_transform(cum, lambda x: x >= 1024), true), len(cum)) AS b FROM held WHERE len(cum) > 0
        UNION ALL SELECT file_id, cum, greatest(a + 1, b - 10), coalesce(list_position(list_transform(cum, lambda x: x - cum[greatest(a + 1, b - 10)] >= 1024), true), len(cum)) FROM win WHERE {more})"""
ON, ALL = "b < len(cum)", "greatest(a + 1, b - 10) < len(cum)"


def _windows(more: str) -> str:
    from codeloom.oracle import sql

    todo = "todo AS (SELECT file_id, string_split(content, chr(10)) AS ls FROM src WHERE content <> '')"
    return sql(
        "SELECT w.file_id, a + 1 AS start_line, b AS end_line, md5(array_to_string(list_slice(ls, a + 1, b), chr(10))) AS hash FROM win w JOIN held USING (file_id)", todo + ", " + WINDOWS.replace("{more}", more)
    )


def queries() -> dict[str, str]:
    from codeloom.oracle import _split, sql

    imp = _names()
    classes = "(SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey > 0 THEN s_suppkey // 2 END AS parent_id FROM supplier)"
    up = f"(SELECT c.id AS src, p.id AS dst FROM {classes} c JOIN {classes} p ON p.id = c.parent_id AND p.id <> c.id)"
    q = lambda n, k: _split(k).replace(", md5(array_to_string(list_slice(ls, a, b), chr(10))) AS hash", f", '{n}' AS kind")
    # class and function spans each by their own query
    spans = f"spans AS (SELECT * FROM ({q('class', 'class')}) UNION ALL SELECT * FROM ({q('function', 'function')}))"
    from codeloom.operators.search import INTENTS, MENTIONS

    words = lambda table: "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{p}')" for p in ps) + f" THEN '{k}' END" for k, ps in table.items()) + "], lambda x: x IS NOT NULL)"
    definition = "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in INTENTS["definition"]) + ")"
    tokens = r"string_split(trim(regexp_replace(regexp_replace(text, '[().]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"
    said = r"string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')"
    kind = f"CASE WHEN list_contains({said}, 'function') OR list_contains({said}, 'method') THEN CASE WHEN contains(text, '(') OR contains(text, ')') THEN 'functions' END WHEN list_contains({said}, 'class') THEN 'classes' END"
    looks = f"list_filter({tokens}, lambda w: regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]') OR contains(w, '_'))"
    once = "list_filter(x, lambda w, i: list_position(x, w) = i)"
    must = ", ".join(f"'{c}=' || coalesce({c}::VARCHAR, '')" for c in ("file_path", "language", "entity_type", "entity_id", "start_line", "end_line", "chunk_id"))
    may = ", ".join(f"CASE WHEN {c} <> '' THEN '{c}=' || {c} END" for c in ("repository", "branch", "commit_id"))
    loc_ext = r"regexp_extract(lower(path), '(\.[^./]+)$', 1)"
    slash = "('.java','.js','.jsx','.ts','.tsx','.c','.cpp','.h','.hpp','.cs','.php','.go','.swift','.kt','.rs')"
    loc = sql(
        "SELECT * FROM counted",
        f"""todo AS (SELECT file_id, {loc_ext} IN {slash} AS sl, {loc_ext} = '.rb' AS rb, list_transform(string_split(regexp_replace({LINES.replace('string_split(', '', 1).rsplit(', chr(10))', 1)[0]}, '\\n$', ''), chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS ls FROM src WHERE content <> ''),
        marks AS (SELECT file_id, ls, CASE WHEN sl THEN '//' ELSE '#' END AS m, CASE WHEN sl THEN '/*' WHEN rb THEN '=begin' ELSE chr(34) || chr(34) || chr(34) END AS o, CASE WHEN sl THEN '*/' WHEN rb THEN '=end' ELSE chr(34) || chr(34) || chr(34) END AS c FROM todo),
        step AS (SELECT file_id, ls, m, o, c, 0 AS i, false AS inside, 0 AS comment, 0 AS blank FROM marks
            UNION ALL SELECT file_id, ls, m, o, c, i + 1,
                CASE WHEN ls[i + 1] = '' THEN inside WHEN inside OR (NOT starts_with(ls[i + 1], m) AND contains(ls[i + 1], o)) THEN NOT contains(ls[i + 1], c) ELSE false END,
                comment + CASE WHEN ls[i + 1] <> '' AND (inside OR starts_with(ls[i + 1], m) OR contains(ls[i + 1], o)) THEN 1 ELSE 0 END, blank + CASE WHEN ls[i + 1] = '' THEN 1 ELSE 0 END FROM step WHERE i < len(ls)),
        counted AS (SELECT file_id, len(ls) - comment - blank AS code, comment, blank, len(ls) AS total FROM step WHERE i = len(ls) UNION ALL SELECT file_id, 0, 0, 0, 0 FROM src WHERE content = '')""",
    )
    return {
        "loc_counts": loc,
        "chunk_windows": _windows(ON),
        "chunk_windows_compat": _windows(ALL),
        "import_names": sql(imp),
        "files_importing": sql(f"SELECT DISTINCT split_part(module_name, '.', 1) AS package, file_id, path FROM ({imp}) n JOIN file f ON f.id = n.file_id WHERE level = 0 AND split_part(module_name, '.', 1) <> ''"),
        "declarations": sql(_declared()),
        "declaration_counts": sql(f"SELECT kind, count(*) AS n FROM ({_declared()}) GROUP BY ALL"),
        "instantiations": sql(
            rf"""SELECT m.file_id, class_name, start_line, EXISTS (SELECT 1 FROM cls c JOIN file g ON g.id = c.file_id WHERE c.name = class_name AND g.repository = f.repository) AS known FROM (
            SELECT file_id, i AS start_line, unnest(regexp_extract_all(line, '\bnew\s+([A-Za-z_][\w.]*)\s*(?:<[^<>()]*>)?\s*\(', 1)) AS class_name FROM (
            SELECT file_id, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) AS i FROM src WHERE content IS NOT NULL)) m JOIN file f ON f.id = m.file_id"""
        ),
        "class_definitions": sql(
            "SELECT c.id, c.name, f.path, c.start_line, parent, (SELECT min(p.id) FROM cls p WHERE p.name = parent) AS parent_id FROM (SELECT *, unnest(CASE WHEN parents IS NULL OR len(parents) = 0 THEN [NULL] ELSE parents END) AS parent FROM cls) c JOIN file f ON f.id = c.file_id"
        ),
        "inherits_projected": f"SELECT src, dst FROM {up}",
        "inheritance_projected": f"SELECT src AS id, dst AS related, 'child' AS relationship_type FROM {up} UNION ALL SELECT dst, src, 'parent' FROM {up}",
        "inheritance_paths": f"WITH RECURSIVE e AS {up}, w AS (SELECT src, dst, 1::BIGINT AS length, [src, dst] AS p FROM e UNION ALL SELECT w.src, e.dst, length + 1, list_append(p, e.dst) FROM w JOIN e ON e.src = w.dst WHERE length < 3 AND NOT list_contains(p, e.dst)) SELECT src, dst, length, array_to_string(p, '/') AS path FROM w",
        "general_words": sql(
            r"""SELECT doc_id, label, n.name, n.nodes, n.id FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z][A-Za-z0-9_]{2,}')) AS name FROM documents WHERE doc_id % 20 = 0) w JOIN (
            SELECT label, name, count(*) AS nodes, min(id) AS id FROM (SELECT 'Function' AS label, name, id FROM func UNION ALL SELECT 'Class', name, id FROM cls) GROUP BY ALL) n ON n.name = w.name"""
        ),
        "name_links": sql("SELECT s.file_id, s.call_name, count(*) AS functions, min(d.id) AS first FROM (SELECT DISTINCT caller_file_id AS file_id, call_name FROM site) s JOIN func d ON d.name = s.call_name GROUP BY ALL"),
        "resolve_imports": sql(
            rf"""SELECT a.file_id, a.fqn, (SELECT min(d.id) FROM func d JOIN file g ON g.id = d.file_id WHERE g.repository = a.repository AND regexp_extract(g.path, '([^/]*?)(?:\.[^./]*)?$', 1) || '.' || d.name = a.fqn) AS dst FROM (
            SELECT DISTINCT n.file_id, f.repository, regexp_extract(module_name, '([A-Za-z0-9_-]+)(?:\.js|\.ts)?$', 1) || '.' || import_name AS fqn FROM ({imp}) n JOIN file f ON f.id = n.file_id WHERE import_name IS NOT NULL) a"""
        ),
        "query_entities": f"SELECT doc_id, kind, CASE WHEN kind IS NOT NULL THEN array_to_string({once}, ',') END AS names FROM (SELECT doc_id, {kind} AS kind, {looks} AS x FROM documents)",
        "query_filters": f"SELECT doc_id, coalesce(array_to_string({words(MENTIONS)}, ','), '') AS languages, CASE WHEN {definition} THEN 'function,class,method,module' ELSE '' END AS entity_types FROM (SELECT doc_id, text FROM documents)",
        "answers_by_kind": sql(
            """SELECT query_id, kind, results, entities, files, CASE WHEN results = 0 THEN 'Nothing in the index answers this.'
            WHEN kind = 'definition' THEN '`' || best || '` is defined in one of ' || files || ' files: ' || listed || '.'
            WHEN kind = 'usage' THEN '`' || best || '` is used ' || results || ' times in ' || files || ' files: ' || listed || '.'
            WHEN kind = 'inheritance' THEN '`' || best || '` has ' || results || ' relatives in ' || files || ' files: ' || listed || '.'
            WHEN kind = 'explanation' THEN 'Read `' || best || '` first, then the other ' || (results - 1) || ' of ' || listed || '.'
            ELSE results || ' results in ' || files || ' files: ' || listed || '.' END AS answer FROM (SELECT *, entities AS listed FROM (
            SELECT query_id, kind, count(*) AS results, count(DISTINCT file_path) AS files, max(CASE WHEN r = 1 THEN entity_id END) AS best,
            (SELECT string_agg(n || ' ' || t, ', ' ORDER BY n DESC, t) FROM (SELECT lower(entity_type) AS t, count(*) AS n FROM told k WHERE k.query_id = told.query_id AND r <= 5 GROUP BY 1)) AS entities
            FROM told GROUP BY query_id, kind))""",
            """kinds AS (SELECT query_id, file_path, start_line, end_line, entity_id, entity_type, search_type, rank_score, ['definition', 'usage', 'inheritance', 'explanation', 'general'][(query_id // 20) % 5 + 1] AS kind FROM rnk),
            told AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, file_path, start_line, end_line, entity_id) AS r FROM kinds k
            WHERE kind IN ('explanation', 'general') OR search_type IS NOT DISTINCT FROM kind OR NOT EXISTS (SELECT 1 FROM kinds o WHERE o.query_id = k.query_id AND o.search_type = o.kind))""",
        ),
        "chunk_files": sql(
            "SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start_line, kind, end_line) - 1 AS pos, kind, start_line, end_line FROM (SELECT * FROM spans UNION ALL SELECT file_id, a + 1, b, 'code_segment' FROM win)",
            f"{spans}, todo AS (SELECT file_id, string_split(content, chr(10)) AS ls FROM src WHERE content <> '' AND file_id NOT IN (SELECT file_id FROM spans)), " + WINDOWS.replace("{more}", ON),
        ),
        "chunk_dispatch": sql(
            f"""SELECT file_id, 'window' AS kind, a + 1 AS start_line, b AS end_line FROM win
            UNION ALL SELECT w.file_id, 'entity', e.start_line, e.end_line FROM whole w JOIN ent e USING (file_id) WHERE e.start_line > 0 AND e.end_line >= e.start_line AND e.end_line <= len(w.ls)
            UNION ALL SELECT file_id, 'header', 1, first - 1 FROM (SELECT w.file_id, any_value(w.ls) AS ls, min(e.start_line) AS first FROM whole w JOIN ent e USING (file_id) WHERE e.start_line > 0 GROUP BY 1)
            WHERE first > 1 AND regexp_matches(array_to_string(list_slice(ls, 1, first - 1), chr(10)), '\\S')""",
            f"""ent AS (SELECT file_id, start_line, end_line FROM func UNION ALL SELECT file_id, start_line, end_line FROM cls),
            whole AS (SELECT file_id, {LINES} AS ls FROM src WHERE content <> '' AND regexp_matches(lower(path), '\\.(py|js|java)$') AND file_id IN (SELECT file_id FROM ent WHERE start_line > 0)),
            todo AS (SELECT file_id, string_split(content, chr(10)) AS ls FROM src WHERE content <> '' AND file_id NOT IN (SELECT file_id FROM whole)), """ + WINDOWS.replace("{more}", ON),
        ),
        "metadata_rows": f"SELECT DISTINCT id, indexed_at, md5(array_to_string(list_sort(list_filter(list_concat([{must}, {may}], coalesce(list_transform(map_entries(extra), lambda e: e.key || '=' || coalesce(e.value, '')), [])), lambda x: x IS NOT NULL)), '|')) AS hash FROM chunk_vectors",
        "extension_breakdown": sql(
            r"SELECT extension, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM file), 6) AS pct FROM (SELECT regexp_extract(lower(path), '(\.[^./]+)$', 1) AS extension, count(*) AS n FROM file GROUP BY 1) ORDER BY n DESC, extension LIMIT 5"
        ),
        "repositories_like": sql("SELECT repository, count(*) AS n FROM file WHERE repository LIKE '%mono%' OR repository LIKE '%stale%' GROUP BY 1"),
        "class_methods_calling": sql("SELECT d.class_id, s.call_name, count(DISTINCT s.caller_function_id) AS methods FROM site s JOIN func d ON d.id = s.caller_function_id WHERE d.class_id IS NOT NULL GROUP BY ALL"),
        "classes_named_like": sql("SELECT c.name AS class_name, d.name, d.id, d.start_line, d.end_line FROM func d JOIN cls c ON c.id = d.class_id WHERE lower(c.name) LIKE '%base%' OR lower(c.name) LIKE '%er%'"),
        "dead_with_parent": sql(
            "SELECT d.id, d.name, CASE WHEN c.name IS NOT NULL THEN 'Class' WHEN f.path IS NOT NULL THEN 'File' END AS parent_type, coalesce(c.name, f.path) AS parent FROM func d LEFT JOIN cls c ON c.id = d.class_id LEFT JOIN file f ON f.id = d.file_id WHERE d.id NOT IN (SELECT callee FROM call) AND NOT starts_with(d.name, '_')"
        ),
        "class_rows": sql("SELECT c.id, c.name, c.parent, d.name AS method FROM (SELECT id, name, unnest(CASE WHEN parents IS NULL OR len(parents) = 0 THEN [NULL] ELSE parents END) AS parent FROM cls) c LEFT JOIN func d ON d.class_id = c.id"),
        "entities_in_order": sql("SELECT id, file_id, start_line, row_number() OVER (PARTITION BY file_id ORDER BY start_line, end_line, id) AS position FROM (SELECT id, file_id, start_line, end_line FROM func UNION ALL SELECT id, file_id, start_line, end_line FROM cls) WHERE start_line > 0"),
        "failed_files": "WITH r AS (SELECT DISTINCT file_id, file_path, error FROM ast_data WHERE error IS NOT NULL) SELECT file_id, file_path, (SELECT count(*) FROM r) AS failed FROM r ORDER BY file_path, file_id, error LIMIT 10",
        "placeholder_content": sql("SELECT v.id, v.chunk_id, length(c.content) AS length, c.content_type FROM (SELECT DISTINCT id, chunk_id FROM chunk_vectors) v LEFT JOIN chunk c ON c.chunk_id = v.chunk_id"),
        "event_data": sql(
            """SELECT event_id, kind, CASE kind WHEN 'FILE_PROCESSED' THEN 'file processed' WHEN 'ENTITY_CREATED' THEN 'entity created' WHEN 'RELATIONSHIP_CREATED' THEN 'relationship created'
            WHEN 'STAGE_STARTED' THEN 'stage started' WHEN 'ERROR' THEN 'error' ELSE 'custom event' END AS message, concat_ws(';', 'k=' || k, 'source=' || user_id, 'type=' || event_type) AS data FROM ev"""
        ),
        "commit_history": """SELECT repository_url, "commit", files, row_number() OVER w AS position, lag("commit") OVER w AS before FROM (SELECT repository_url, "commit", min(last_updated) AS t, count(DISTINCT id) AS files FROM source_files GROUP BY ALL)
            WINDOW w AS (PARTITION BY repository_url ORDER BY t, "commit")""",
        "incremental_states": sql('SELECT id, "commit" FROM file'),
        "changed_since_commit": """SELECT id, CASE WHEN bool_or(old) THEN 'M' ELSE 'A' END AS change_type FROM (SELECT id, "commit" IS NOT DISTINCT FROM first_value("commit") OVER (PARTITION BY repository_url ORDER BY last_updated, "commit") AS old FROM source_files)
            GROUP BY id HAVING bool_or(NOT old)""",
        "vector_near": sql("SELECT query_id, id, score FROM hits WHERE score >= 0.9"),
        "upsert_known_edges": sql("SELECT caller AS src, callee AS dst, t AS rel_type FROM (SELECT caller, callee, unnest(CASE WHEN right(caller, 1) IN ('0','2','4','6','8') THEN ['CALLS', 'RELATED_TO'] ELSE ['RELATED_TO'] END) AS t FROM call WHERE caller IS NOT NULL)"),
    }
