"""Plain SQL with the same meaning as each query, for an independent engine to run on the same tables."""

from __future__ import annotations

from tessera.plans.rendered import BAD_BYTES


def _tokens(table: str, key: str, text: str) -> str:
    return rf"""
    tok AS (
      SELECT {key} AS k,
             list_transform(list_filter(regexp_split_to_array({text}, '[ \t\n\r]+'), lambda x: x <> ''),
                            lambda x: CASE WHEN regexp_full_match(x, '[0-9]+(\.[0-9]+)?') THEN '0' ELSE x END) AS t
      FROM {table})"""


_SKETCH = """
    sk AS (
      SELECT k, len(t) AS n_tokens,
             list_sort(list_distinct(list_sort(list_transform(range(1, len(t) - 3),
               lambda i: md5(array_to_string(t[i:i+4], ' '))))[1:50])) AS fp
      FROM tok WHERE len(t) >= 25),
    post AS (SELECT k, len(fp) AS n, unnest(fp) AS h FROM sk)"""

_BEST = """
    gated AS (
      SELECT a.k AS a, b.k AS b, count(*) / (a.n + b.n - count(*)) AS j
      FROM post a JOIN post b ON a.h = b.h AND a.k < b.k
      GROUP BY a.k, b.k, a.n, b.n
      HAVING count(*) / (a.n + b.n - count(*)) >= 0.3),
    both_ways AS (SELECT a AS k, b AS other, j FROM gated UNION ALL SELECT b, a, j FROM gated),
    best AS (
      SELECT k, other, j FROM (
        SELECT *, row_number() OVER (PARTITION BY k ORDER BY j DESC, other) AS r FROM both_ways) WHERE r = 1)"""

_LINES = r"length(text) - length(replace(text, chr(10), '')) + 1"
_DOC_PATH = "'/' || lang || '/' || source || '/' || doc_id"
_URL_PATH = r"rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', ''), '/')"
_WORDS = "(?i)(^|[^\\p{L}\\p{N}_])(the|que|der|los)($|[^\\p{L}\\p{N}_])"
_MARKED = f"len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '{_WORDS}')))"

_LEAVES = rf"""
    leaves AS (
      SELECT doc_id, lang, source, {_LINES} AS lines,
             len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) AS expressions,
             length(text) - length(replace(text, '.', '')) AS statements,
             {_MARKED} AS todo_comments
      FROM documents)"""

_ANCESTORS = """
    parts AS (SELECT path, string_split(ltrim(path, '/'), '/') AS p FROM paths),
    anc AS (
      SELECT path, i + 1 AS depth, CASE WHEN i = 0 THEN '/' ELSE '/' || array_to_string(p[1:i], '/') END AS ancestor
      FROM (SELECT path, p, unnest(range(0, len(p))) AS i FROM parts))"""

_PARENT = "CASE WHEN regexp_replace({0}, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace({0}, '/[^/]*$', '') END"

_CONV_NODES = """
    methods AS (
      SELECT '/chats/conv' || conv_id AS path, 'method' AS nodetype, 'turn' || turn AS name, 'conv' || conv_id AS owner,
             '/chats/conv' || conv_id || '#' || (turn + 2) AS node_id
      FROM conversations),
    classes AS (
      SELECT DISTINCT path, 'class' AS nodetype, owner AS name, NULL AS owner, path || '#1' AS node_id FROM methods)"""

_CODE = """
    src AS (
      SELECT doc_id AS id, '/' || lang || '/' || source || '/doc_' || doc_id || '.py' AS path,
             string_split(text, chr(10)) AS ls FROM documents),
    cnt AS (
      SELECT id, path, len(ls) AS l, len(list_filter(ls, lambda s: length(s) % 2 = 0)) AS e,
             len(list_filter(ls, lambda s: contains(s, ','))) AS c, len(list_filter(ls, lambda s: length(s) > 40)) AS g,
             '    def m(self, a: int, b):' || chr(10) || array_to_string(list_transform(ls, lambda s:
               '        v' || md5(s)[1:8] || ' = 1' || chr(10)
               || CASE WHEN length(s) % 2 = 0 THEN '        if x: pass' || chr(10) ELSE '' END
               || CASE WHEN contains(s, ',') THEN '        # TODO' || chr(10) ELSE '' END), '')
               || '        return x' || chr(10) AS method_source,
             'def f' || id || '(p, q: int = 0) -> int:' || chr(10) || array_to_string(list_transform(
               list_filter(ls, lambda s: length(s) > 40), lambda s: '    p = p and v' || md5(s)[1:8] || chr(10)), '')
               || '    return p' || chr(10) AS function_source
      FROM src),
    fn AS (
      SELECT id, path, 'method' AS nodetype, 'm' AS name, 'C' || id AS class_name, 'C' || id || '.m' AS qualname,
             3 AS lineno, 2 + l + e + c AS lines, 2 + l + e AS statements, 2 + 2 * l + e AS expressions,
             0 AS expression_statements, 1 + e AS cyclomatic_complexity, 3 AS parameters, 0.333 AS type_coverage,
             c AS todo_comments, 28 + 22 * l + 19 * e + 15 * c + 17 AS source_chars, md5(method_source) AS source_md5
      FROM cnt
      UNION ALL
      SELECT id, path, 'function', 'f' || id, NULL, 'f' || id, 3 + (2 + l + e + c) + 1, 2 + g, 2 + g, 4 + 4 * g, 0, 1 + g, 2,
             0.667, 0, length('def f' || id || '(p, q: int = 0) -> int:') + 1 + 24 * g + 13, md5(function_source)
      FROM cnt)"""

_CODE_TOKENS = """
    tok AS (
      SELECT {'path': path, 'lineno': 3} AS k,
             ['def', 'm', '(', 'self', ',', 'a', ':', 'int', ',', 'b', ')', ':'] ||
             flatten(list_transform(ls, lambda s: ['v' || md5(s)[1:8], '=', '0'] ||
               CASE WHEN length(s) % 2 = 0 THEN ['if', 'x', ':', 'pass'] ELSE [] END)) || ['return', 'x', ''] AS t
      FROM src
      UNION ALL
      SELECT {'path': fn.path, 'lineno': fn.lineno},
             ['def', fn.name, '(', 'p', ',', 'q', ':', 'int', '=', '0', ')', '->', 'int', ':'] ||
             flatten(list_transform(list_filter(ls, lambda s: length(s) > 40), lambda s: ['p', '=', 'p', 'and', 'v' || md5(s)[1:8]]))
             || ['return', 'p', ''] AS t
      FROM fn JOIN src USING (id) WHERE nodetype = 'function')"""

_STATS = """min({0}) AS min, max({0}) AS max, round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.5), 6) AS median,
      round(quantile_cont({0}, 0.9), 6) AS p90"""

_DOC_TOKENS = _tokens("documents", "doc_id", "text")


def _generic(source: str, metrics: tuple[str, ...], label: str = "{0}") -> str:
    return " UNION ALL ".join(
        f"SELECT '{label.format(m).replace('_', ' ') if label != '{0}' else m}' AS metric, min({m})::DOUBLE AS min, "
        f"max({m})::DOUBLE AS max, round(avg({m}), 6) AS mean, round(quantile_cont({m}::DOUBLE, 0.5), 6) AS median, "
        f"round(quantile_cont({m}::DOUBLE, 0.9), 6) AS p90, round(sum({m}::DOUBLE), 6) AS total FROM {source}"
        for m in metrics
    )


def _long(source: str, key: str, metrics: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{m}' AS metric, {m}::DOUBLE AS value FROM {source}" for m in metrics)


_CODE_METRICS = (
    "lines", "statements", "expressions", "expression_statements", "cyclomatic_complexity", "parameters",
    "type_coverage", "todo_comments",
)

_NO_METRICS = ", ".join("NULL" for _ in _CODE_METRICS)

_CODE_NODES = f"""
    paths AS (SELECT path FROM cnt), {_ANCESTORS},
    folders AS (SELECT DISTINCT ancestor AS node_id FROM anc),
    nodes AS (
      SELECT node_id, CASE WHEN node_id = '/' THEN NULL ELSE {_PARENT.format("node_id")} END AS parent_id,
             'directory' AS nodetype, CASE WHEN node_id = '/' THEN '/' ELSE regexp_extract(node_id, '[^/]*$') END AS name,
             '' AS qualname, NULL::INTEGER AS lineno, NULL::INTEGER AS end_lineno, '' AS docstring, md5('') AS source_md5,
             {", ".join(f"NULL AS {m}" for m in _CODE_METRICS)} FROM folders
      UNION ALL
      SELECT path, {_PARENT.format("path")}, 'file', regexp_extract(path, '[^/]*$'), '', NULL, NULL, '', md5(''),
             {_NO_METRICS} FROM cnt
      UNION ALL
      SELECT path || '#1', path, 'class', 'C' || id, '', 1, 4 + l + e + c, 'Document ' || id || '.', md5(''),
             {_NO_METRICS} FROM cnt
      UNION ALL
      SELECT path || '#' || lineno, CASE WHEN nodetype = 'method' THEN path || '#1' ELSE path END, nodetype, name, qualname,
             lineno, lineno + lines - 1, '', source_md5, {", ".join(_CODE_METRICS)} FROM fn)"""

ORACLES = {
    "unit_lines_tokens": f"""
    WITH {_DOC_TOKENS}
    SELECT doc_id, {_DOC_PATH} AS path, doc_id::VARCHAR AS name, '/' || lang || '/' || source AS parent, {_LINES} AS lines,
           len(t) AS n_tokens
    FROM documents JOIN tok ON doc_id = k""",
    "marker_counts": f"SELECT doc_id, {_MARKED} AS todo_comments FROM documents",
    "line_slice": "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS source FROM documents",
    "qualified_names": f"""
    WITH {_CONV_NODES}
    SELECT node_id, owner || '.' || name AS qualname, owner || '.' || name AS reported, owner || '.' || name AS display_name
    FROM methods
    UNION ALL SELECT node_id, '', name, name FROM classes""",
    "shingle_sketch": f"""
    WITH {_DOC_TOKENS}, {_SKETCH}
    SELECT k AS doc_id, n_tokens, len(fp) AS n, array_to_string(fp, ',') AS fp FROM sk""",
    "neardup_pairs": f"""
    WITH {_DOC_TOKENS}, {_SKETCH},
    reps AS (SELECT min(k) AS k, fp FROM sk GROUP BY fp),
    rp AS (SELECT k, len(fp) AS n, unnest(fp) AS h FROM reps)
    SELECT a.k AS a, b.k AS b, a.n AS n_a, b.n AS n_b, count(*) AS inter, a.n + b.n - count(*) AS uni,
           round(count(*) / (a.n + b.n - count(*)), 6) AS jaccard
    FROM rp a JOIN rp b ON a.h = b.h AND a.k < b.k
    GROUP BY a.k, b.k, a.n, b.n
    HAVING count(*) / (a.n + b.n - count(*)) >= 0.3""",
    "neardup_groups": f"""
    WITH {_DOC_TOKENS}, {_SKETCH},
    named AS (SELECT k, min(k) OVER (PARTITION BY fp) AS g, count(*) OVER (PARTITION BY fp) AS size FROM sk),
    gated AS (
      SELECT a.k AS a, b.k AS b, count(*) AS inter, a.n + b.n - count(*) AS uni
      FROM post a JOIN post b ON a.h = b.h AND a.k < b.k
      GROUP BY a.k, b.k, a.n, b.n
      HAVING count(*) / (a.n + b.n - count(*)) >= 0.3),
    pairs AS (
      SELECT CASE WHEN x.g <= y.g THEN x.g ELSE y.g END AS a, CASE WHEN x.g <= y.g THEN y.g ELSE x.g END AS b,
             CASE WHEN x.g <= y.g THEN x.size ELSE y.size END AS size_a,
             CASE WHEN x.g <= y.g THEN y.size ELSE x.size END AS size_b, inter, uni
      FROM gated JOIN named x ON x.k = gated.a JOIN named y ON y.k = gated.b)
    SELECT a, b, size_a, size_b, inter, uni, round(inter / uni, 6) AS jaccard, count(*) AS pairs
    FROM pairs GROUP BY a, b, size_a, size_b, inter, uni""",
    "neardup_links": f"""
    WITH {_DOC_TOKENS}, {_SKETCH}, {_BEST},
    n AS (SELECT k, count(*) AS n_links FROM both_ways GROUP BY k)
    SELECT sk.k AS doc_id, min(sk.k) OVER (PARTITION BY fp) AS group_id, count(*) OVER (PARTITION BY fp) AS size,
           coalesce(n_links, 0) AS n_links
    FROM sk LEFT JOIN n ON sk.k = n.k""",
    "neardup_partners": f"""
    WITH {_DOC_TOKENS}, {_SKETCH}, {_BEST}
    SELECT k AS doc_id, other AS other_id, round(j, 6) AS jaccard FROM both_ways WHERE k % 50 = 0""",
    "neardup_best": f"""
    WITH {_DOC_TOKENS}, {_SKETCH}, {_BEST}
    SELECT k AS doc_id, round(j, 6) AS score, other AS other_id, other::VARCHAR AS other, {_LINES} AS lines_other
    FROM best JOIN documents ON doc_id = other""",
    "neardup_pages": f"""
    WITH {_tokens("pages", "page_id", "html")}, {_SKETCH}, {_BEST}
    SELECT k AS page_id, round(j, 6) AS score, other AS other_id FROM best""",
    "neardup_merged": f"""
    WITH corpus AS (
      SELECT {{'kind': 'benchmark', 'id': item_id}} AS k, text FROM benchmark
      UNION ALL SELECT {{'kind': 'document', 'id': doc_id}}, text FROM documents),
    {_tokens("corpus", "k", "text")}, {_SKETCH}, {_BEST}
    SELECT k.kind, k.id, round(j, 6) AS score, other.kind AS other_kind, other.id AS other_id FROM best""",
    "neardup_extended": f"""
    WITH long AS (
      SELECT doc_id, text FROM documents
      WHERE text IS NOT NULL AND len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) >= 25),
    same AS (
      SELECT doc_id, length(text) AS n, count(*) OVER (PARTITION BY text) AS copies, min(doc_id) OVER (PARTITION BY text) AS least,
             lead(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS next FROM long),
    found AS (
      SELECT doc_id, CASE WHEN copies > 1 THEN 1.0 ELSE round_even(2.0::DOUBLE * n / (2 * n + 1), 3) END AS score,
             CASE WHEN copies = 1 THEN NULL WHEN doc_id = least THEN next ELSE least END AS copy
      FROM same)
    SELECT 2 * doc_id AS unit_id, score, CASE WHEN copy IS NULL THEN 2 * doc_id + 1 ELSE 2 * copy END AS other_id FROM found
    UNION ALL
    SELECT 2 * doc_id + 1, score, CASE WHEN copy IS NULL THEN 2 * doc_id ELSE 2 * copy + 1 END FROM found""",
    "scan_dedup_ignore": f"""
    SELECT DISTINCT {_URL_PATH} AS path FROM pages
    WHERE {_URL_PATH} NOT IN ('/blog.tionsh.example.net/es/533', '/spam-farm.example.org', '/www.cheap-pills.example.com/en')
      AND NOT starts_with({_URL_PATH}, '/spam-farm.example.org/')
      AND NOT starts_with({_URL_PATH}, '/www.cheap-pills.example.com/en/')""",
    "path_ancestors": f"""
    WITH paths AS (SELECT DISTINCT {_URL_PATH} AS path FROM pages), {_ANCESTORS}
    SELECT path, ancestor, depth FROM anc""",
    "dir_nodes": f"""
    WITH paths AS (SELECT DISTINCT {_URL_PATH} AS path FROM pages), {_ANCESTORS},
    d AS (SELECT DISTINCT ancestor AS node_id, depth FROM anc)
    SELECT node_id, CASE WHEN node_id = '/' THEN 'root' ELSE {_PARENT.format("node_id")} END AS parent_id, depth,
           CASE WHEN node_id = '/' THEN '/' ELSE regexp_extract(node_id, '[^/]*$') END AS name, node_id AS path
    FROM d
    UNION ALL SELECT 'root', NULL, 0, 'root', '/'""",
    "node_predicates": f"""
    WITH paths AS (SELECT DISTINCT {_URL_PATH} AS path FROM pages), {_ANCESTORS},
    d AS (SELECT DISTINCT ancestor AS node_id FROM anc),
    kids AS (
      SELECT CASE WHEN node_id = '/' THEN 'root' ELSE {_PARENT.format("node_id")} END AS parent_id, false AS is_file FROM d
      UNION ALL SELECT {_PARENT.format("path")}, true FROM paths),
    facts AS (SELECT parent_id, count(*) AS n, bool_or(is_file) AS f FROM kids GROUP BY parent_id)
    SELECT node_id, coalesce(n, 0) AS n_children, coalesce(f, false) AS has_files
    FROM (SELECT node_id FROM d UNION ALL SELECT 'root') LEFT JOIN facts ON parent_id = node_id""",
    "prune_root": f"""
    WITH paths AS (SELECT '/data/corpus' || {_DOC_PATH} AS path FROM documents), {_ANCESTORS},
    d AS (SELECT DISTINCT ancestor AS node_id, depth FROM anc WHERE depth >= 3)
    SELECT node_id, CASE WHEN node_id <> '/data/corpus' THEN {_PARENT.format("node_id")} END AS parent_id, depth,
           regexp_extract(node_id, '[^/]*$') AS name, 'directory' AS nodetype FROM d
    UNION ALL
    SELECT path, {_PARENT.format("path")}, len(string_split(path, '/')), regexp_extract(path, '[^/]*$'), 'file' FROM paths""",
    "subtree_nodes": f"""
    WITH d AS (SELECT DISTINCT '/data/corpus/en/' || source AS node_id FROM documents WHERE lang = 'en')
    SELECT node_id, 'directory' AS nodetype FROM d
    UNION ALL SELECT '/data/corpus/en', 'directory'
    UNION ALL SELECT '/data/corpus' || {_DOC_PATH}, 'file' FROM documents WHERE lang = 'en'""",
    "subtree_weight": f"""
    WITH w AS (SELECT lang, source, log10({_LINES} + 1) AS x FROM documents)
    SELECT '/' AS node_id, round(sum(x), 6) AS weight FROM w
    UNION ALL SELECT '/' || lang, round(sum(x), 6) FROM w GROUP BY lang
    UNION ALL SELECT '/' || lang || '/' || source, round(sum(x), 6) FROM w GROUP BY lang, source""",
    "sibling_rank": f"""
    WITH w AS (
      SELECT {_DOC_PATH} AS node_id, '/' || lang || '/' || source AS parent_id, {_LINES} AS lines FROM documents)
    SELECT node_id, parent_id, round(log10(lines + 1), 6) AS weight,
           row_number() OVER (PARTITION BY parent_id ORDER BY lines DESC, node_id) AS rank
    FROM w""",
    "leaf_units": f"WITH {_CONV_NODES} SELECT node_id, nodetype, name FROM methods",
    "node_counts": """
    SELECT count(DISTINCT conv_id) AS files, count(DISTINCT conv_id) AS classes, count(*) AS functions FROM conversations""",
    "summary_expressions": f"""
    WITH {_LEAVES} SELECT sum(expressions)::BIGINT AS total, round(avg(expressions), 6) AS mean FROM leaves""",
    "summary_lines": f"""
    WITH {_LEAVES}, s AS (SELECT {_STATS.format("lines")} FROM leaves)
    SELECT *, round(mean, 1) AS mean_shown, floor(median + 0.5) AS median_shown FROM s""",
    "summary_generic": f"WITH {_LEAVES} {_generic('leaves', ('statements', 'lines'))}",
    "summary_lineitem": " UNION ALL ".join(
        f"""SELECT l_returnflag, '{m}' AS metric, min({m}) AS min, max({m}) AS max, round(avg({m}), 4) AS mean,
        round(quantile_cont({m}, 0.5), 4) AS median, round(quantile_cont({m}, 0.9), 4) AS p90, round(sum({m}), 4) AS total
        FROM lineitem GROUP BY l_returnflag"""
        for m in ("l_quantity", "l_discount", "l_tax")
    ),
    "quantiles_lineitem": " UNION ALL ".join(
        f"""SELECT l_returnflag, {q}::DOUBLE AS q, count(l_extendedprice) AS n,
        round(quantile_cont(l_extendedprice, {q}), 4) AS quantile FROM lineitem GROUP BY l_returnflag"""
        for q in (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)
    ),
    "summary_events": f"""
    SELECT event_type, count(value) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean,
           round(sum(value), 6) AS total, round(quantile_cont(value, 0.5), 6) AS median,
           round(quantile_cont(value, 0.9), 6) AS p90
    FROM events WHERE value IS NOT NULL GROUP BY event_type""",
    "summary_dup_weighted": f"""
    WITH {_DOC_TOKENS}, {_SKETCH}, {_BEST},
    scored AS (SELECT {_LINES} AS n, coalesce(round_even(j, 3), 0) AS x FROM documents LEFT JOIN best ON doc_id = k)
    SELECT round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.9), 6) AS p90,
           round(sum(n * x), 6) AS duplicated_lines, round(sum(n * x) / sum(n), 6) AS share
    FROM scored""",
    "summary_ratio": """
    SELECT lang, count(quality) AS n, round(avg(quality), 6) AS mean, round(quantile_cont(quality, 0.5), 6) AS median,
           round(quantile_cont(quality, 0.9), 6) AS p90, count(*) FILTER (quality = 1) AS full,
           round(count(*) FILTER (quality = 1) / count(quality), 6) AS full_share
    FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang""",
    "summary_markers": f"""
    WITH {_LEAVES}
    SELECT sum(todo_comments)::BIGINT AS total, count(*) FILTER (todo_comments > 0) AS marked,
           round(count(*) FILTER (todo_comments > 0) / count(*), 6) AS marked_share, max(todo_comments) AS max
    FROM leaves""",
    "group_summary": f"WITH {_LEAVES} SELECT lang, source, {_STATS.format('lines')} FROM leaves GROUP BY lang, source",
    "metric_unpivot": f"WITH {_LEAVES} {_long('leaves', 'doc_id', ('lines', 'expressions', 'statements', 'todo_comments'))}",
    "metric_selected": f"""
    WITH {_LEAVES} SELECT doc_id, 'todo_comments' AS metric, todo_comments::DOUBLE AS value FROM leaves""",
    "metric_scaled": f"""
    WITH {_LEAVES}
    SELECT doc_id, lines,
           round((lines - (SELECT min(lines) FROM leaves)) / (SELECT max(lines) - min(lines) FROM leaves), 6) AS scaled
    FROM leaves""",
    "unit_details": f"""
    WITH {_DOC_TOKENS}, {_SKETCH}, {_BEST}, {_LEAVES}
    SELECT doc_id, 'lines' AS label, lines::DOUBLE AS value, NULL AS other FROM leaves
    UNION ALL SELECT doc_id, 'todo comments', todo_comments::DOUBLE, NULL FROM leaves
    UNION ALL SELECT doc_id, 'duplication', round_even(j, 3), other::VARCHAR FROM leaves LEFT JOIN best ON k = doc_id""",
    "topk_units": f"WITH {_LEAVES} SELECT doc_id, lines FROM leaves ORDER BY lines DESC, doc_id LIMIT 20",
    "code_units": f"""
    WITH {_CODE}
    SELECT path, nodetype, name, class_name, qualname, lineno, lineno + lines - 1 AS end_lineno, '' AS docstring,
           source_chars, source_md5 FROM fn
    UNION ALL
    SELECT path, 'class', 'C' || id, NULL, '', 1, 2 + 2 + l + e + c, 'Document ' || id || '.', 0, md5('') FROM cnt""",
    "code_files": f"""
    WITH {_CODE} SELECT path, {_PARENT.format("path")} AS parent_id, regexp_extract(path, '[^/]*$') AS name,
           'file' AS nodetype FROM cnt""",
    "code_metrics": f"WITH {_CODE} SELECT path, qualname, {', '.join(_CODE_METRICS)} FROM fn",
    "code_histogram": f"""
    WITH {_CODE}
    SELECT 'FunctionDef' AS node_type, 2 * count(*) AS n FROM cnt
    UNION ALL SELECT 'Return', 2 * count(*) FROM cnt
    UNION ALL SELECT 'Assign', sum(l + g)::BIGINT FROM cnt
    UNION ALL SELECT 'If', sum(e)::BIGINT FROM cnt
    UNION ALL SELECT 'Pass', sum(e)::BIGINT FROM cnt
    UNION ALL SELECT 'BoolOp', sum(g)::BIGINT FROM cnt
    UNION ALL SELECT 'And', sum(g)::BIGINT FROM cnt
    UNION ALL SELECT 'arguments', 2 * count(*) FROM cnt
    UNION ALL SELECT 'arg', 5 * count(*) FROM cnt
    UNION ALL SELECT 'Constant', sum(l + 1)::BIGINT FROM cnt
    UNION ALL SELECT 'Name', sum(5 + l + e + 3 * g)::BIGINT FROM cnt
    UNION ALL SELECT 'Store', sum(l + g)::BIGINT FROM cnt
    UNION ALL SELECT 'Load', sum(5 + e + 2 * g)::BIGINT FROM cnt""",
    "bad_files": f"""
    WITH {_CODE}
    SELECT path, CASE WHEN id % 7 = 0 THEN 'parse' ELSE 'encode' END AS stage FROM cnt WHERE id % 7 IN (0, 1)""",
    "text_ratio": """
    SELECT doc_id, round(2.0 * n / (2 * n + 1), 6)::DOUBLE AS ratio
    FROM (SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS n FROM documents)""",
    "code_type_coverage": f"""
    WITH {_CODE}, v AS (SELECT type_coverage::DOUBLE AS x FROM fn)
    SELECT count(*) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median,
           round(quantile_cont(x, 0.9), 6) AS p90, count(*) FILTER (x = 1) AS full, 0.0::DOUBLE AS full_share FROM v""",
    "code_summary": f"WITH {_CODE} {_generic('fn', _CODE_METRICS)}",
    "code_weights": f"""
    WITH {_CODE}, {_CODE_NODES},
    leaf AS (SELECT path, path || '#' || lineno AS node_id, nodetype, log10(lines + 1) AS x FROM fn),
    w AS (
      SELECT node_id, x FROM leaf
      UNION ALL SELECT path || '#1', x FROM leaf WHERE nodetype = 'method'
      UNION ALL SELECT path, x FROM leaf
      UNION ALL SELECT ancestor, x FROM leaf JOIN anc USING (path))
    SELECT n.node_id, n.parent_id, round(sum(x), 6) AS weight FROM nodes n JOIN w USING (node_id) GROUP BY 1, 2""",
    "code_neardup": f"""
    WITH {_CODE}, {_CODE_TOKENS}, {_SKETCH}, {_BEST}
    SELECT k.path AS path, k.lineno AS lineno, round(j, 6) AS score, other.path AS other_path,
           other.lineno AS other_lineno FROM best""",
    "report_roundtrip": f"WITH {_CODE}, {_CODE_NODES} SELECT * FROM nodes",
}

# Files as ``rendered_rows`` places them; what the scan finds of them; their text as decoding leaves it.
_TREE = f"""
tree AS (
  SELECT doc_id, coalesce(text, '') AS text,
    CASE WHEN doc_id % 11 = 4 THEN 'src/skip' WHEN doc_id % 13 = 5 THEN 'more' ELSE 'src/a' || doc_id % 4 || '/b' || doc_id % 7 END AS folder,
    CASE doc_id % 5 WHEN 1 THEN '_' WHEN 2 THEN '.' ELSE '' END || 'f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.py' END AS name,
    doc_id % 23 = 6 AS dangling, doc_id % 19 = 3 AND NOT doc_id % 23 = 6 AS linked,
    CASE doc_id % 17 {" ".join(f"WHEN {k} THEN {len(raw) // 2}" for k, (raw, _) in enumerate(BAD_BYTES))} ELSE 0 END AS bad,
    CASE doc_id % 17 {" ".join(f"WHEN {k} THEN {n}" for k, (_, n) in enumerate(BAD_BYTES))} ELSE 0 END AS replaced
  FROM documents),
found AS (
  SELECT *, folder || '/' || name AS path FROM tree
  WHERE folder NOT IN ('src/skip', 'src/a2/b0')
    AND (linked OR name LIKE '%.py' AND (folder LIKE 'src/%' OR name = '_f31.py')))
"""

ORACLES["scan_files"] = f"""
WITH {_TREE}
SELECT path, CAST(strlen(text) + bad + CASE WHEN doc_id % 4 = 1 THEN length(text) - length(replace(text, chr(10), '')) ELSE 0 END AS BIGINT) AS size,
  CAST(length(text) + replaced AS INTEGER) AS chars, md5(text || repeat(chr(65533), replaced)) AS content_md5
FROM found
"""

ORACLES["scan_plan"] = f"WITH {_TREE} SELECT path FROM found"

ORACLES["scan_errors"] = f"""
WITH {_TREE}
SELECT 'none' AS path, 'input' AS kind, CAST(1 AS BIGINT) AS n
UNION ALL SELECT 'src/away', 'ignore', 1
UNION ALL SELECT 'gone.py', 'file', 1 FROM (SELECT 1 FROM tree WHERE dangling LIMIT 1)
"""
