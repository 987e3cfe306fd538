"""DuckDB SQL twins of the queries that SQL can express."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UP}', '{_LOW}'), '{pattern}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SOLID = r"[^\x20\x09-\x0D]+"

_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words('text', _ALNUM)} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i + 1 : i + size], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(len(w) - least(10, len(w)) + 1)) AS i
        FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i + 1 : i + size], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(greatest(len(w) - size + 1, 0))) AS i FROM d CROSS JOIN sizes)
),
hits AS (SELECT doc_id, item_id, dw.size AS size, i FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
),
hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(hi.n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words hw ON d.doc_id = hw.doc_id LEFT JOIN hit_items hi ON d.doc_id = hi.doc_id
"""

_NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _SOLID)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 75 * (na.n + nb.n - c)
),
reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least_of ON d.doc_id = least_of.a
"""


def _escaped(text: str) -> str:
    return (
        f"regexp_replace(replace({text}, '\\', '\\\\'), "
        r"'(<)(\||/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"
    )


_CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS turns,
         length('<|turn|>') + length(replace({_escaped('role')}, chr(10), '\\' || chr(10))) + 1
           + length({_escaped('text')}) + length('<|end|>') + 1 AS chars
  FROM c
),
f AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM r),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS whole,
         coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(upto) FILTER (WHERE role = 'assistant' OR k = turns) AS formatted_chars
  FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_SPREAD = f"""
WITH l AS (
  SELECT doc_id, source, place, trim(lines[place + 1], {_BLANK}) AS line, lines[place + 1] AS raw
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines,
               unnest(range(len(string_split(text, chr(10))))) AS place
        FROM documents WHERE text IS NOT NULL)
),
long_enough AS (SELECT * FROM l WHERE len(regexp_split_to_array(line, '[ \\t\\r\\f\\v]+')) >= 4),
often AS (
  SELECT line, min((doc_id, place)) AS first FROM long_enough
  GROUP BY line HAVING count(DISTINCT coalesce('s' || source, '')) >= 8
),
marked AS (
  SELECT l.doc_id, l.place, l.raw,
         o.line IS NOT NULL AND (l.doc_id, l.place) <> o.first
           AND len(regexp_split_to_array(l.line, '[ \\t\\r\\f\\v]+')) >= 4 AS gone
  FROM l LEFT JOIN often o ON l.line = o.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
UNION ALL
SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""

_REPEATS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SOLID}') AS w FROM documents),
v AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 49, 0))) AS i FROM d)
),
least_of AS (SELECT win, min(doc_id) AS least_doc FROM v GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM v JOIN least_of ON v.win = least_of.win WHERE doc_id > least_doc
),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w
         ELSE list_transform(list_filter(range(len(w)), lambda p : NOT list_contains(ps, p)), lambda p : w[p + 1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id
"""

_FILL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
  FROM documents
),
g AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d
),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR h3 % 100 >= 50 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
              THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM g
),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
         array_to_string(u[b + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""

ORACLES: dict[str, str] = {
    "op2_suffix_decontamination": _CONTAMINATION,
    "op3_chosen_path": _NEAR,
    "op7_prefix_targets": _CHAT,
    "op8_site_spread": _SPREAD,
    "op12_relative_parsing": _REPEATS,
    "op13_piece_table": _FILL,
}
