"""SQL of the queries that SQL can express."""

from __future__ import annotations

from tessera.llm.divergence import COMMON_SHARE, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_BLANK}'), lambda x: x <> '')"


def _ascii_lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


ORACLES = {}

ORACLES["op3_line_dedup"] = rf"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, {_ascii_lower("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id
"""

ORACLES["op4_minhash_dedup"] = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_words(_ascii_lower("coalesce(text, '')"))} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_reduce(w, lambda x, y: x || ' ' || y)]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
posts AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM posts a JOIN posts b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(node, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT node AS doc_id, min(r) AS component_id FROM reach GROUP BY node) USING (doc_id)
"""

ORACLES["op5_embedding_dedup"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.93),
reach(node, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT node, min(r) AS component_id FROM reach GROUP BY node) c ON c.node = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id
"""

_CLASSES = (r"\p{Ll}+", r"\p{Lu}+", _BLANK, r"""[.,;:!?''"()-]+""", r"\p{N}+", r"[#*$%&|<>]+")
_COLUMNS = [f"c{i}" for i in range(len(_CLASSES) + 1)]
_STEPS = ",\n".join(
    f"s{i + 1} AS (SELECT * REPLACE (regexp_replace(rest, '{p}', '', 'g') AS rest), "
    f"length(rest) - length(regexp_replace(rest, '{p}', '', 'g')) AS c{i} FROM s{i})"
    for i, p in enumerate(_CLASSES)
)


def _term(p: str, q: str) -> str:
    half = f"(({p}) + ({q})) / 2"
    return " + ".join(f"CASE WHEN ({x}) > 0 THEN ({x}) * log2(({x}) / ({half})) ELSE 0 END" for x in (p, q))


_REF = ", ".join(f"CASE WHEN sum(chars) > 0 THEN sum({c}) / sum(chars) ELSE 0 END AS q{c}" for c in _COLUMNS)
_CLASS_JS = " + ".join(_term(f"{c} / chars", f"q{c}") for c in _COLUMNS)

ORACLES["op6_quality_rules"] = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, {_words("coalesce(text, '')")} AS w,
         {_words(_ascii_lower("coalesce(text, '')"))} AS lw,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
         unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS x FROM base WHERE len(w) >= 3),
twice AS (SELECT doc_id, x FROM windows GROUP BY doc_id, x HAVING count(*) > 1),
covered AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM windows JOIN twice USING (doc_id, x)),
repeated AS (SELECT doc_id, count(DISTINCT i) AS n FROM covered GROUP BY doc_id),
s0 AS (SELECT doc_id, lang, text AS rest, length(text) AS chars FROM base),
{_STEPS},
counted AS (SELECT *, length(rest) AS c{len(_CLASSES)} FROM s{len(_CLASSES)}),
refs AS (SELECT lang, {_REF} FROM counted GROUP BY lang),
class_js AS (
  SELECT doc_id, CASE WHEN chars >= 200 THEN sqrt(greatest(0, ({_CLASS_JS}) / 2)) END AS class_distance
  FROM counted JOIN refs USING (lang)),
tokens AS (SELECT doc_id, lang, unnest(lw) AS word FROM base),
totals AS (SELECT lang, count(*) AS total FROM tokens GROUP BY lang),
common AS (
  SELECT lang, word, count(*) / any_value(total) AS q FROM tokens JOIN totals USING (lang)
  GROUP BY lang, word HAVING count(*) / any_value(total) >= {COMMON_SHARE}),
outside AS (SELECT lang, greatest(0, 1 - coalesce(sum(q), 0)) AS others FROM totals LEFT JOIN common USING (lang) GROUP BY lang),
shares AS (
  SELECT doc_id, t.lang, any_value(q) AS q, count(*) / any_value(len(w)) AS p
  FROM tokens t JOIN common c ON c.lang = t.lang AND c.word = t.word JOIN base USING (doc_id) GROUP BY doc_id, t.lang, t.word),
near AS (SELECT doc_id, sum(p) AS ps, sum(q) AS qs, sum({_term("p", "q")}) AS js FROM shares GROUP BY doc_id),
word_js AS (
  SELECT doc_id, CASE WHEN len(w) >= 50 THEN sqrt(greatest(0, (coalesce(js, 0) + greatest(0, 1 - others - coalesce(qs, 0))
    + {_term("greatest(0, 1 - coalesce(ps, 0))", "others")}) / 2)) END AS word_distance
  FROM base LEFT JOIN near USING (doc_id) LEFT JOIN outside ON outside.lang = base.lang),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    class_distance, word_distance
  FROM base LEFT JOIN repeated r USING (doc_id) JOIN class_js USING (doc_id) JOIN word_js USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND NOT coalesce(class_distance > {MAX_CLASS_DISTANCE}, false) AND NOT coalesce(word_distance > {MAX_WORD_DISTANCE}, false) AS kept
FROM measured
"""

ORACLES["op9_mix_sources"] = rf"""
WITH drawn AS (
  SELECT doc_id, source, CAST(len({_words("coalesce(text, '')")}) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / coalesce(greatest(0.1::DOUBLE, 1 - 10::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>!', ''))) / greatest(length(text), 1)), 1) AS rank_key
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM drawn GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END::DOUBLE AS weight FROM sources),
ordered AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source) AS k FROM weighted),
rates AS (
  SELECT k, cap / weight AS most, ((SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM ordered),
chosen AS (SELECT rate FROM rates WHERE rate <= most ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, least(cap, weight * rate) AS target FROM ordered, chosen),
placed AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY d.source ORDER BY rank_key, doc_id ROWS UNBOUNDED PRECEDING) AS reached
  FROM drawn d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST((whole + CASE WHEN size > 0 AND reached - size / 2 < target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""

_REVISIT = "payload_bytes >= 1000 AND page_id <> newest"

ORACLES["op10_warc_archive"] = f"""
WITH records AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
newest AS (SELECT payload_digest, max(page_id) AS newest FROM records GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN {_REVISIT} THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN {_REVISIT} THEN newest END AS refers_to
FROM records JOIN newest USING (payload_digest)
"""

_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(text: str, by: str) -> str:
    return f"list_filter(string_split_regex({_ascii_lower(f'coalesce({text}, {chr(39) * 2})')}, '{by}'), lambda x: x <> '')"


ORACLES["op11_benchmark_decontamination"] = rf"""
WITH docs AS (SELECT doc_id, {_split("text", _NO_WORD)} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_split("text", _NO_WORD)} AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[s:s + 9], ' ') AS x FROM starts),
widths AS (SELECT DISTINCT m FROM windows),
places AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM docs, widths WHERE len(w) >= m),
hits AS (
  SELECT doc_id, s, p.m, item FROM (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS x FROM places) p
  JOIN windows ON windows.m = p.m AND windows.x = p.x),
found AS (
  SELECT doc_id, CAST(count(DISTINCT item) AS BIGINT) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS listed FROM hits GROUP BY doc_id),
words AS (SELECT doc_id, CAST(count(DISTINCT i) AS BIGINT) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN found USING (doc_id) LEFT JOIN words USING (doc_id)
"""

_CRC_STEP = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(ord(c) AS BIGINT))), "
    f"lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda x, i: {_CRC_STEP})))"
)
_NAME = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"


def _state(cost: str, audit: str, text: str) -> str:
    return f"struct_pack(c := {cost}, e := {audit}, t := {text})"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _insert(k: str, role: str) -> str:
    return _state(f"{k}.c + 3", f"{k}.e || 'I'", f"list_append({k}.t, '{role}:')")


def _inserted(name: str, source: str, more: str = "") -> str:
    """States 2 and 3 (after a user, after an assistant row) also by one insert from the others."""
    two = _least(f"{source}.s2", *[_insert(f"{source}.s{k}", "user") for k in (0, 1, 3)])
    three = _least(f"{source}.s3", _insert(f"{source}.s2", "assistant"))
    return f"SELECT {more} {source}.s0 AS s0, {source}.s1 AS s1, {two} AS s2, {three} AS s3"


def _moved(to: int) -> str:
    ways = [_state(f"s{to}.c + 4", f"s{to}.e || 'D'", f"s{to}.t")]
    for k, speaker in {0: (), 1: ((0, "s"),), 2: ((0, "u"), (1, "u"), (3, "u")), 3: ((2, "a"),)}[to]:
        ways.append(_state(f"CASE WHEN go OR i <> '{speaker}' THEN 1000000000 ELSE s{k}.c + cut END", f"s{k}.e || 'K'", f"list_append(s{k}.t, role || ':' || text)"))
        if speaker != "s":
            whose = {"u": "user", "a": "assistant"}[speaker]
            ways.append(_state(f"CASE WHEN go THEN 1000000000 ELSE s{k}.c + 3 + cut END", f"s{k}.e || 'R'", f"list_append(s{k}.t, '{whose}:' || text)"))
    return _least(*ways)


_NEVER = _state("CAST(1000000000 AS BIGINT)", "''", "CAST([] AS VARCHAR[])")

ORACLES["op12_conversation_repair"] = rf"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format(_NAME)} % 20 AS d FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN d = 0 THEN 0 WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded),
placed AS (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS i, row_number() OVER seq AS pos,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged
  WINDOW seq AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text))),
flagged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, bare = '' AS blank, bare = '' OR again AS go, CASE WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS cut,
    coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i NOT IN ('su', 'ua', 'au'), false) AS bad
  FROM placed),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {_state("CAST(0 AS BIGINT)", "''", "CAST([] AS VARCHAR[])")} AS s0, {_NEVER} AS s1, {_NEVER} AS s2, {_NEVER} AS s3
  FROM (SELECT DISTINCT conv_id FROM damaged)
  UNION ALL
  SELECT w.conv_id, f.pos, {_moved(0)}, {_moved(1)}, {_moved(2)}, {_moved(3)}
  FROM ({_inserted("w", "v", "v.conv_id, v.pos,")} FROM ({_inserted("v", "u", "u.conv_id, u.pos,")} FROM walk u) v) w
  JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1),
ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
closed AS (
  SELECT conv_id, {_least("s0", "s3")} AS s
  FROM ({_inserted("w", "v", "v.conv_id,")} FROM ({_inserted("v", "u", "u.conv_id,")} FROM ends u) v)),
counted AS (
  SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (NOT go AND cut > 0) AS truncated,
    count(*) FILTER (bad) AS illegal
  FROM flagged GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(s.c, 0) AS BIGINT) AS cost, coalesce(s.e, '') AS audit,
  sha256(coalesce(array_to_string(s.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN closed c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLES["op13_ranked_search"] = rf"""
WITH docs AS (SELECT doc_id, {_split("text", _NO_TERM)} AS w FROM documents),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM docs) GROUP BY ALL),
items AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_split("text", _NO_TERM)}) AS term FROM benchmark) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM tf JOIN (SELECT DISTINCT term FROM items) USING (term), totals GROUP BY term),
gains AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS gain
  FROM tf JOIN weights USING (term), totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * gain) AS BIGINT) AS score FROM items JOIN gains USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""
