"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .queries import URL_LISTED, URL_RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = r"""
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(n)
), piece AS (
  SELECT *,
    '### ' || regexp_replace(role, '(\\|:|### |</turn>)', '\\\1', 'g') || ': '
      || regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g') || '</turn>' || chr(10) AS formatted
  FROM log
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM piece GROUP BY conv_id
"""

OP4 = rf"""
WITH words AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), wins AS (
  SELECT doc_id, p, array_to_string(w[p : p + 34], ' ') AS seq
  FROM words, unnest(range(1, len(w) - 33)) t(p) WHERE len(w) >= 35
), again AS (
  SELECT doc_id, p FROM wins WHERE seq IN (SELECT seq FROM wins GROUP BY seq HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, p + k AS at FROM again, range(35) r(k)
), each AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM words
), kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.at) AS text, count(*) AS n
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.at = g.at WHERE g.at IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""

OP5 = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
    CAST('0x' || substr(md5(encode(coalesce(CAST(doc_id AS VARCHAR), '')) || '\x00'::BLOB || encode(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
  FROM docs GROUP BY source
), fill AS (
  SELECT *, 3 * source_size AS most,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER prior, 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER prior, 0) AS share
  FROM sums
  WINDOW prior AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), open AS (
  SELECT CAST(rest AS BIGINT) AS rest, CAST(share AS BIGINT) AS share FROM fill
  WHERE most * share > rest * w ORDER BY 3 * source_size / w, source NULLS LAST LIMIT 1
), aims AS (
  SELECT source, source_size, CASE WHEN fill.most * fill.share > fill.rest * w
    THEN CAST((SELECT rest FROM open) * w AS DOUBLE) / (SELECT share FROM open) ELSE CAST(most AS DOUBLE) END AS target
  FROM fill
), plan AS (
  SELECT *, least(3, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END) AS repeats FROM aims
), runs AS (
  SELECT d.*, source_size, target, repeats, target - repeats * source_size AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS tie
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(size * least(3, repeats
    + CASE WHEN upto <= budget OR (upto - tie <= budget AND upto - budget < budget - (upto - tie)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM runs
"""

_LIST = ", ".join([f"('{h}', '{p}', '{v}', 1)" for h, p, v in URL_RULES] + [f"('{h}', '{p}', 'block', 0)" for h, p in URL_LISTED])

OP6 = rf"""
WITH entries(e_host, e_path, e_verdict, is_rule) AS (VALUES {_LIST}), parsed AS (
  SELECT row_number() OVER () AS row_id, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), forms AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS c_host,
    CASE WHEN path = '' THEN '/' ELSE path END AS c_path
  FROM parsed
), fits AS (
  SELECT p.row_id, e.*, row_number() OVER (PARTITION BY p.row_id ORDER BY is_rule DESC, length(e_host || e_path) DESC, e_verdict = 'block' DESC) AS rn
  FROM forms p JOIN entries e ON CASE WHEN is_rule = 1
    THEN (host = e_host OR ends_with(host, '.' || e_host)) AND starts_with(path, e_path)
    ELSE (c_host = e_host OR ends_with(c_host, '.' || e_host)) AND starts_with(c_path, e_path) END
)
SELECT page_id, host, path, CASE WHEN is_rule = 1 THEN e_host || e_path END AS rule, coalesce(e_verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON p.row_id = f.row_id AND rn = 1
"""


# Of 13 aligned tokens with two substitutions four neighbours agree, so equal runs of four find
# all candidates (the items of the test tables have 13 tokens at least).
OP8 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS t FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS a FROM benchmark WHERE item_id IS NOT NULL
), runs AS (
  SELECT row_id, p, t[p] || ' ' || t[p + 1] || ' ' || t[p + 2] || ' ' || t[p + 3] AS run
  FROM docs, unnest(range(1, len(t) - 2)) r(p) WHERE len(t) >= 4
), item_runs AS (
  SELECT item_id, q, a[q] || ' ' || a[q + 1] || ' ' || a[q + 2] || ' ' || a[q + 3] AS run
  FROM items, unnest(range(1, len(a) - 2)) r(q) WHERE len(a) >= 4
), lines AS (
  SELECT DISTINCT row_id, item_id, p - q AS shift FROM runs JOIN item_runs USING (run)
), wins AS (
  SELECT row_id, item_id, shift, q, list_sum([CASE WHEN t[shift + q + k] = a[q + k] THEN 1 ELSE 0 END FOR k IN range(13)]) AS n
  FROM lines JOIN docs USING (row_id) JOIN items USING (item_id), unnest(range(1, len(a) - 11)) w(q)
  WHERE shift + q >= 1 AND shift + q + 12 <= len(t)
), good AS (
  SELECT row_id, item_id, shift, q, shift + q AS p FROM wins WHERE n >= 11
), steps AS (
  SELECT row_id, item_id, p, CASE WHEN p <= max(p) OVER (PARTITION BY row_id, item_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 12 THEN 0 ELSE 1 END AS new
  FROM (SELECT DISTINCT row_id, item_id, p FROM good)
), parts AS (
  SELECT row_id, item_id, p, sum(new) OVER (PARTITION BY row_id, item_id ORDER BY p) AS part FROM steps
), spans AS (
  SELECT row_id, item_id, part, min(p) AS lo, max(p) + 12 AS hi FROM parts GROUP BY ALL
), same AS (
  SELECT DISTINCT row_id, item_id, p + k AS at FROM good JOIN docs USING (row_id) JOIN items USING (item_id), unnest(range(13)) r(k) WHERE t[p + k] = a[q + k]
)
SELECT doc_id, item_id, lo - 1 AS start, hi - lo + 1 AS n_tokens, count(*) AS matches
FROM spans JOIN same s USING (row_id, item_id) JOIN docs USING (row_id) WHERE s.at BETWEEN lo AND hi
GROUP BY row_id, doc_id, item_id, lo, hi
"""


_KINDS = (
    ("assign", "((?i)password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    # whole keys and tokens; headers alone and cut keys, which SQL can't follow, don't occur in the test tables
    ("pem", "(?s)-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----.*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----", 0, 1),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    ("ghtoken", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, row_id, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {g}) AS g, string_split_regex(t, '{p}') AS parts, {least} AS least FROM docs"
    for rank, (kind, p, g, least) in enumerate(_KINDS)
)
OP9 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents
), found AS ({_FOUND}), hits AS (
  SELECT row_id, rank, kind, length(m[k]) AS len, length(g[k]) >= least AS enough,
    CAST(list_sum([length(x) FOR x IN parts[1 : k]]) + coalesce(list_sum([length(x) FOR x IN m[1 : k - 1]]), 0) AS BIGINT) AS lo
  FROM found, unnest(range(1, len(m) + 1)) r(k)
), kept AS (
  SELECT row_id, rank, kind, lo, kind || ':' || lo || ':' || (lo + len) AS span FROM hits WHERE enough
), per AS (
  SELECT row_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
    string_agg(span, ',' ORDER BY lo, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY lo, rank) AS spans
  FROM kept GROUP BY row_id
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (row_id)
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an SQL text of code points below 256: each byte, then eight shifts (-1)."""
    shifts = "-1, -1, -1, -1, -1, -1, -1, -1"
    of = f"CASE WHEN ord(x) < 128 THEN [ord(x), {shifts}] ELSE [192 + (ord(x) >> 6), {shifts}, 128 + (ord(x) & 63), {shifts}] END"
    ops = f"list_concat([4294967295], CAST(flatten(list_transform(string_split({text}, ''), lambda x: {of})) AS BIGINT[]))"
    return f"xor(list_reduce({ops}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_LEVEL = """
  UNION ALL
  SELECT {key} level + 1, pos // 2, (many + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE many > 1 GROUP BY {key} level, pos // 2, many
"""
OP11 = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf,
    CASE WHEN {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} END AS claim
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS many FROM docs
), up AS (
  SELECT lang, 0 AS level, pos, many, leaf AS node FROM leaves {_LEVEL.format(key="lang,", name="up")}
), groups AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS many FROM up WHERE many = 1
), top AS (
  SELECT 0 AS level, pos, many, subroot AS node FROM groups {_LEVEL.format(key="", name="top")}
), steps AS (
  SELECT d.row_id, o.level, (d.pos >> o.level) & 1 AS side, s.node AS sibling
  FROM leaves d JOIN up o ON d.lang IS NOT DISTINCT FROM o.lang AND o.pos = d.pos >> o.level AND o.many > 1
    LEFT JOIN up s ON d.lang IS NOT DISTINCT FROM s.lang AND s.level = o.level AND s.pos = xor(o.pos, 1)
  UNION ALL
  SELECT d.row_id, 1000 + o.level, (g.pos >> o.level) & 1, s.node
  FROM leaves d JOIN groups g ON d.lang IS NOT DISTINCT FROM g.lang JOIN top o ON o.pos = g.pos >> o.level AND o.many > 1
    LEFT JOIN top s ON s.level = o.level AND s.pos = xor(o.pos, 1)
), path AS (
  SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY level) AS n, side, coalesce(sibling, '') AS sibling FROM steps
), folds AS (
  SELECT row_id, 0 AS n, coalesce(claim, leaf) AS node FROM docs
  UNION ALL
  SELECT row_id, p.n, sha256(CASE WHEN side = 0 THEN node || sibling ELSE sibling || node END) FROM folds f JOIN path p USING (row_id) WHERE p.n = f.n + 1
)
SELECT doc_id, leaf, subroot, r.node AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM docs d JOIN groups g ON d.lang IS NOT DISTINCT FROM g.lang JOIN (SELECT node FROM top WHERE many = 1) r ON true
  LEFT JOIN (SELECT row_id, string_agg(sibling, '' ORDER BY n) AS proof FROM path GROUP BY row_id) p USING (row_id)
  JOIN (SELECT row_id, max_by(node, n) AS node FROM folds GROUP BY row_id) f USING (row_id)
"""


OP12 = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\xC0-\xFF]{{7,}}')) AS run FROM documents
  ) GROUP BY ALL
), hashed AS (
  SELECT run, c, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(c) >= 2
), holes AS (
  SELECT word, n, left(word, k - 1) AS a, substr(word, k + 1) AS b FROM words, unnest(range(1, length(word) + 1)) r(k)
), shorter AS (
  SELECT DISTINCT h.word, h.n, w.word AS near, w.n AS near_n FROM holes h JOIN words w ON h.a || h.b = w.word
), near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT * FROM shorter UNION ALL SELECT near, near_n, word, n FROM shorter
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most, min(near) FILTER (near_n = top) AS form
  FROM (SELECT *, max(near_n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN form END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS here, 0 AS k FROM forms
  UNION ALL
  SELECT w.word, f.form, k + 1 FROM walk w JOIN forms f ON w.here = f.word WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, max_by(here, k) AS root FROM walk GROUP BY word) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": OP3, "op4_substring": OP4, "op5_mixing": OP5, "op6_urls": OP6, "op8_decontam": OP8, "op9_secrets": OP9, "op11_merkle": OP11, "op12_spelling": OP12}
