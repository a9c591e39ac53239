"""SQL for another engine that says what the profile and drift queries give, from the tables alone."""

from __future__ import annotations

from .profile import CLASS_BITS, LETTER_BITS, OWN_SHARE, OWN_SIGNS, RUN_BITS, SIGN_BITS

NOTE_BREAKS = r"(v = '' OR regexp_matches(v, '^[\s\p{Z}\x{85}\v]|[\s\p{Z}\x{85}\v]$') OR regexp_matches(replace(v, chr(10), ''), '\p{Cc}') OR contains(v, chr(65533)))"
NAME_BREAKS = r"NOT regexp_full_match(v, '\p{L}[\p{L}''.-]*( \p{L}[\p{L}''.-]*)*')"
#: Columns of both tables with the declared pattern, the range, and whether they are numbers.
COLUMNS = (
    ("shop_orders", "note", NOTE_BREAKS, None, False), ("shop_orders", "amount", None, "(x < 0.01 OR x > 20000)", True), ("shop_orders", "id", None, None, True),
    ("shop_orders", "placed_at", None, None, False), ("shop_orders", "loaded_at", None, None, False), ("shop_orders", "deleted_at", None, None, False),
    ("headers", "name", NAME_BREAKS, None, False), ("headers", "id", None, None, True), ("headers", "note", NOTE_BREAKS, None, False),
)

_CELLS = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, load_no, CAST({c} AS VARCHAR) AS v, {f'CAST({c} AS DOUBLE)' if number else f'CAST(length(CAST({c} AS VARCHAR)) AS DOUBLE)'} AS x FROM {t}" for t, c, _, _, number in COLUMNS
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MASKED = f"translate(v, '{_UPPER}{_LOWER}0123456789', '{'A' * 26}{'a' * 26}{'9' * 10}')"
_SHAPED = r"regexp_replace(" + _MASKED + r", '[^\P{L}A-Za-z]', 'L', 'g')"
_RUNS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(e1, 'A{2,}', 'B', 'g'), 'a{2,}', 'b', 'g'), 'L{2,}', 'M', 'g'), '9{2,}', '8', 'g')"
_WORDS = "regexp_replace(regexp_replace(e1, '[AaL]+', 'w', 'g'), '9+', '8', 'g')"


def _count(e: str, signs: str) -> str:
    return f"(length({e}) - length(translate({e}, '{signs}', '')))"


_B1 = " + ".join(f"{_count('e1', c)} * {bits}" for c, bits in CLASS_BITS.items())
_B2 = f"{_B1} + {_count('e2', 'BbM8')} * {RUN_BITS}"
_B3 = f"{_count('e1', '9')} * {CLASS_BITS['9']} + {_count('e1', 'AaL')} * {LETTER_BITS} + {_count('e3', 'w8')} * {RUN_BITS}"
_B4 = "1000 + length(e1) * CAST(floor(log2(CASE WHEN contains(e4, 'w') THEN 56 ELSE 0 END + CASE WHEN contains(e4, '8') THEN 10 ELSE 0 END + length(e4) + 1) * 100 + 0.000001) AS BIGINT)"
_OTHER = r"[^\P{L}A-Za-z]"


def _token(classes: dict[str, str]) -> str:
    cases = " ".join(f"WHEN s = '{k}' THEN '{v}'" for k, v in classes.items())
    return f"CASE {cases} WHEN regexp_matches(s, '^[\\x00-\\x7f]$') THEN chr(92) || s ELSE s END"


_LOW = _token({"A": "[A-Z]", "a": "[a-z]", "L": _OTHER, "9": "[0-9]", "B": "[A-Z]{2,}", "b": "[a-z]{2,}", "M": _OTHER + "{2,}", "8": "[0-9]{2,}"})
_MID = _token({"w": r"\p{L}+", "8": "[0-9]+"})
_SET = _token({"w": r"\p{L}", "8": "0-9"})
_LETTERS = "string_split(e, '')"


def _joined(token: str) -> str:
    return f"array_to_string([{token} FOR s IN {_LETTERS}], '')"


_REGEX = f"CASE WHEN e = '' THEN '' WHEN lvl < 3 THEN {_joined(_LOW)} WHEN lvl = 3 THEN {_joined(_MID)} ELSE '[' || {_joined(_SET)} || ']+' END"
_BREAKS = "CASE " + " ".join(f"WHEN t = '{t}' AND c = '{c}' THEN {b}" for t, c, b, _, _ in COLUMNS if b) + " ELSE false END"
_PATTERNED = "(" + " OR ".join(f"t = '{t}' AND c = '{c}'" for t, c, b, _, _ in COLUMNS if b) + ")"
_RANGED = "(" + " OR ".join(f"t = '{t}' AND c = '{c}'" for t, c, _, o, _ in COLUMNS if o) + ")"
_NUMBERS = "(" + " OR ".join(f"t = '{t}' AND c = '{c}'" for t, c, _, _, n in COLUMNS if n) + ")"
_OUTSIDE = "CASE " + " ".join(f"WHEN t = '{t}' AND c = '{c}' THEN {o}" for t, c, _, o, _ in COLUMNS if o) + " ELSE false END"

EXPRESSIONS = f"""
WITH cells AS ({_CELLS}),
vals AS (SELECT DISTINCT t, c, v FROM cells WHERE v IS NOT NULL),
s1 AS (SELECT t, c, {_SHAPED} AS e1, count(*) AS n FROM vals GROUP BY 1, 2, 3),
s2 AS (SELECT *, {_RUNS} AS e2, {_WORDS} AS e3 FROM s1),
s3 AS (SELECT *, CASE WHEN e3 = '' THEN '' ELSE array_to_string(list_sort(list_distinct(string_split(e3, ''))), '') END AS e4 FROM s2),
tree AS (SELECT *, length(e1) * {SIGN_BITS} + n * ({_B1}) AS best, n * ({_B2}) AS s2, n * ({_B3}) AS s3, n * ({_B4}) AS s4 FROM s3),
n2 AS (SELECT *, length(e2) * {SIGN_BITS} + s2 < parts AS taken, least(length(e2) * {SIGN_BITS} + s2, parts) AS best FROM
  (SELECT t, c, e2, e3, e4, sum(n) AS n, sum(best) AS parts, sum(s2) AS s2, sum(s3) AS s3, sum(s4) AS s4 FROM tree GROUP BY 1, 2, 3, 4, 5)),
n3 AS (SELECT *, length(e3) * {SIGN_BITS} + s3 < parts AS taken, least(length(e3) * {SIGN_BITS} + s3, parts) AS best FROM
  (SELECT t, c, e3, e4, sum(n) AS n, sum(best) AS parts, sum(s3) AS s3, sum(s4) AS s4 FROM n2 GROUP BY 1, 2, 3, 4)),
n4 AS (SELECT *, length(e4) * {SIGN_BITS} + s4 < parts AS taken FROM (SELECT t, c, e4, sum(n) AS n, sum(best) AS parts, sum(s4) AS s4 FROM n3 GROUP BY 1, 2, 3)),
nodes AS (
  SELECT t, c, 1 AS lvl, e1 AS e, e2, e3, e4, n FROM tree UNION ALL SELECT t, c, 2, e2, NULL, e3, e4, n FROM n2 WHERE taken
  UNION ALL SELECT t, c, 3, e3, NULL, NULL, e4, n FROM n3 WHERE taken UNION ALL SELECT t, c, 4, e4, NULL, NULL, NULL, n FROM n4 WHERE taken),
big AS (SELECT nodes.* FROM nodes JOIN (SELECT t, c, count(*) AS m FROM vals GROUP BY 1, 2) USING (t, c) WHERE n >= {OWN_SHARE} * m AND length(e) <= {OWN_SIGNS}),
own AS (SELECT t, c, lvl, e, n, {_REGEX} AS regex, row_number() OVER (PARTITION BY t, c ORDER BY lvl, n DESC, e) - 1 AS k FROM big b
  WHERE NOT EXISTS (SELECT 1 FROM n2 w WHERE w.taken AND b.lvl < 2 AND (w.t, w.c, w.e2) = (b.t, b.c, b.e2))
    AND NOT EXISTS (SELECT 1 FROM n3 w WHERE w.taken AND b.lvl < 3 AND (w.t, w.c, w.e3) = (b.t, b.c, b.e3))
    AND NOT EXISTS (SELECT 1 FROM n4 w WHERE w.taken AND b.lvl < 4 AND (w.t, w.c, w.e4) = (b.t, b.c, b.e4))),
placed AS (SELECT vals.t, vals.c, v, min(k) AS k FROM vals LEFT JOIN own ON own.t = vals.t AND own.c = vals.c AND regexp_full_match(v, regex) GROUP BY 1, 2, 3),
counted AS (SELECT cells.t, cells.c, load_no, k, count(*) AS n_rows FROM cells JOIN placed USING (t, c, v) GROUP BY 1, 2, 3, 4),
shares AS (SELECT n.t AS table_name, n.c AS column_name, load_no, regex AS expression, n_rows, n_rows / CAST(sum(n_rows) OVER (PARTITION BY n.t, n.c, load_no) AS DOUBLE) AS share
  FROM counted n LEFT JOIN own ON own.t = n.t AND own.c = n.c AND own.k = n.k)
"""

P1_EXPRESSIONS = EXPRESSIONS + "SELECT * FROM shares"
P1_COVERAGE = (
    EXPRESSIONS
    + """, grid AS (SELECT l.table_name, l.column_name, l.load_no, e.expression FROM (SELECT DISTINCT table_name, column_name, load_no FROM shares) l
  JOIN (SELECT DISTINCT table_name, column_name, expression FROM shares) e ON l.table_name = e.table_name AND l.column_name = e.column_name),
filled AS (SELECT g.*, coalesce(s.share, 0.0) AS share FROM grid g LEFT JOIN shares s ON s.table_name = g.table_name AND s.column_name = g.column_name
  AND s.load_no IS NOT DISTINCT FROM g.load_no AND s.expression IS NOT DISTINCT FROM g.expression)
SELECT * FROM (SELECT *, quantile_cont(share, 0.5) OVER (PARTITION BY table_name, column_name, expression) AS median FROM filled) WHERE abs(share - median) > 0.1"""
)
P1_PROFILE = (
    EXPRESSIONS
    + f""", signs AS (SELECT t, c, k, unnest(string_split(e, '')) AS s FROM own WHERE lvl = 4 AND e <> ''),
texts AS (SELECT t, c, k, s AS v FROM signs UNION ALL SELECT a.t, a.c, a.k, a.s || b.s FROM signs a JOIN signs b ON a.t = b.t AND a.c = b.c AND a.k = b.k
  UNION ALL SELECT t, c, k, '' FROM own WHERE lvl = 4 AND e = '' UNION ALL SELECT t, c, k, e FROM own WHERE lvl < 4),
said AS (SELECT t, c, k, bool_or({_BREAKS}) AS breaks FROM texts GROUP BY 1, 2, 3),
bulk AS (SELECT own.t, own.c, own.k, lvl < 4 OR NOT breaks AS sure FROM own JOIN said USING (t, c, k)),
checked AS (SELECT n.t, n.c, load_no, CAST(coalesce(sum(n_rows) FILTER (WHERE NOT coalesce(sure, false)), 0) AS BIGINT) AS n_checked, CAST(coalesce(sum(n_rows) FILTER (WHERE n.k IS NOT NULL), 0) AS BIGINT) AS n_covered
  FROM counted n LEFT JOIN bulk ON bulk.t = n.t AND bulk.c = n.c AND bulk.k = n.k GROUP BY 1, 2, 3),
plain AS (SELECT t, c, load_no, count(*) AS n_rows, count(v) AS n_values, count(DISTINCT v) AS n_distinct, min(x) FILTER (WHERE v IS NOT NULL) AS lo, max(x) FILTER (WHERE v IS NOT NULL) AS hi,
  min(v) AS least_text, max(v) AS greatest_text, count(*) FILTER (WHERE v IS NOT NULL AND {_BREAKS}) AS n_break, count(*) FILTER (WHERE v IS NOT NULL AND {_OUTSIDE}) AS n_outside,
  list_sort(list(x) FILTER (WHERE v IS NOT NULL)) AS xs FROM cells GROUP BY 1, 2, 3)
SELECT t AS table_name, c AS column_name, load_no, n_rows, n_values, n_distinct, CASE WHEN {_NUMBERS} THEN lo END AS least_number, CASE WHEN {_NUMBERS} THEN hi END AS greatest_number, least_text, greatest_text,
  CAST(n_rows - n_values AS DOUBLE) / n_rows AS null_share, CASE WHEN n_values > 0 THEN CAST(n_distinct AS DOUBLE) / n_values END AS distinct_share,
  CASE WHEN n_values > 0 AND {_PATTERNED} THEN CAST(n_break AS DOUBLE) / n_values END AS pattern_share, CASE WHEN n_values > 0 AND {_RANGED} THEN CAST(n_outside AS DOUBLE) / n_values END AS range_share,
  CASE WHEN n_values > 0 THEN CAST(n_covered AS DOUBLE) / n_values END AS coverage, CASE WHEN {_PATTERNED} THEN coalesce(n_checked, 0) END AS n_checked,
  CASE WHEN n_values > 0 THEN (xs[(n_values + 1) // 2] + xs[n_values // 2 + 1]) / 2 END AS level
FROM plain LEFT JOIN checked USING (t, c, load_no)
"""
)

#: Fixed values, of the test tables: the names that each field of a manifest is given there.
NAMES = {
    "schema_version": ("schema_ver", "Schema_Version", "manifest_version", "schemaVersion"), "input_key": ("input_path", "source_key", "inputKey"), "output_key": ("outputKey", "output_path", "target_key"),
    "input_size": ("input_bytes", "inputSize", "size_of_input"), "input_e_tag": ("inputETag", "input_etag", "input-e-tag"), "output_e_tag": ("outputETag", "output_etag"),
    "input_last_modified": ("last_modified", "inputLastModified", "input_modified"), "row_count": ("rowCount", "n_rows", "Row_Count", "rows"), "input_version": ("inputVersion", "input_ver"),
    "output_version": ("outputVersion", "output_ver"), "run_id": ("runId", "publishing_run", "run"), "content_digest": ("contentDigest", "Content_Digest", "digest", "content-digest", "content_hash"),
    "digest_scheme": ("Digest_Scheme", "digest_algorithm", "digestScheme", "scheme"),
}
_ALIASES = ", ".join(f"('{name}', '{one}')" for one, names in NAMES.items() for name in (one, *names))
P4_FOUND = f"""
WITH lines AS (SELECT file_no, stream, written_at, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END AS body FROM manifest_lines),
keys AS (SELECT file_no, body, unnest(json_keys(body)) AS name FROM lines WHERE body IS NOT NULL),
kinds AS (SELECT file_no, name, CASE json_type(json_extract(body, '$."' || name || '"'))
    WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'whole' WHEN 'UBIGINT' THEN 'whole' WHEN 'HUGEINT' THEN 'whole' WHEN 'DOUBLE' THEN 'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS kind FROM keys),
fields AS (SELECT file_no, coalesce(one, kinds.name) AS one, kinds.name, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM kinds LEFT JOIN (VALUES {_ALIASES}) a(name, one) ON a.name = kinds.name GROUP BY 1, 2, 3),
files AS (SELECT file_no, lag(file_no) OVER (PARTITION BY stream ORDER BY written_at NULLS FIRST, file_no) AS before FROM (SELECT file_no, min(stream) AS stream, min(written_at) AS written_at FROM lines GROUP BY 1)),
pairs AS (SELECT file_no, before FROM files WHERE before IS NOT NULL),
matched AS (SELECT coalesce(n.file_no, t.file_no) AS file_no, n.name AS new, t.name AS old, n.kinds AS now_kinds, t.kinds AS then_kinds
  FROM (SELECT p.file_no, f.* EXCLUDE (file_no) FROM pairs p JOIN fields f ON f.file_no = p.file_no) n
  FULL JOIN (SELECT p.file_no, f.* EXCLUDE (file_no) FROM pairs p JOIN fields f ON f.file_no = p.before) t ON t.file_no = n.file_no AND t.one = n.one)
SELECT file_no, 'added' AS change, new AS field FROM matched WHERE old IS NULL UNION ALL SELECT file_no, 'removed', old FROM matched WHERE new IS NULL
UNION ALL SELECT file_no, 'renamed', new FROM matched WHERE new <> old UNION ALL SELECT file_no, 'retyped', new FROM matched WHERE now_kinds <> then_kinds
"""
_KIND = "CASE json_type({0}) WHEN 'VARCHAR' THEN 0 WHEN 'BIGINT' THEN 1 WHEN 'UBIGINT' THEN 1 WHEN 'HUGEINT' THEN 1 WHEN 'DOUBLE' THEN 2 WHEN 'BOOLEAN' THEN 3 WHEN 'ARRAY' THEN 4 WHEN 'OBJECT' THEN 5 END"
_VALUES = f"""
WITH lines AS (SELECT row_number() OVER () AS row_no, file_no, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END AS body FROM manifest_lines),
keys AS (SELECT row_no, file_no, body, unnest(json_keys(body)) AS name FROM lines WHERE body IS NOT NULL),
top AS (SELECT row_no, file_no, keys.name, coalesce(one, keys.name) AS one, json_extract(body, '$."' || keys.name || '"') AS j FROM keys LEFT JOIN (VALUES {_ALIASES}) a(name, one) ON a.name = keys.name)
"""
#: The table's values are nested one level deep.
P4_ALTERNATIVES = (
    _VALUES
    + f""", inside AS (SELECT file_no, name, one, j, unnest(json_keys(j)) AS k FROM top WHERE json_type(j) = 'OBJECT'),
items AS (SELECT file_no, name, one, unnest(json_extract(j, '$[*]')) AS j FROM top WHERE json_type(j) = 'ARRAY'),
paths AS (SELECT file_no, name, one AS field, {_KIND.format("j")} AS kind FROM top UNION ALL SELECT file_no, name, one || '.' || k, {_KIND.format("json_extract(j, '$.' || k)")} FROM inside
  UNION ALL SELECT file_no, name, one || '[]', {_KIND.format("j")} FROM items)
SELECT field, list_sort(list(DISTINCT name)) AS names, [['string', 'whole', 'decimal', 'boolean', 'array', 'object'][k + 1] FOR k IN coalesce(list_sort(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL)), [])] AS types,
  count(*) AS n_lines, min(file_no) AS first_file FROM paths GROUP BY field"""
)
P4_TABLE_COUNTS = _VALUES + "SELECT one AS field, count(DISTINCT row_no) AS n_lines FROM top WHERE json_type(j) <> 'NULL' GROUP BY one"
ORACLES = {"p1_profile": P1_PROFILE, "p1_expressions": P1_EXPRESSIONS, "p1_coverage": P1_COVERAGE, "p4_found": P4_FOUND, "p4_alternatives": P4_ALTERNATIVES, "p4_table_counts": P4_TABLE_COUNTS}
