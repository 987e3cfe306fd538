"""Plain SQL with the same meaning as each registered query, over the same whole tables."""

from __future__ import annotations

import math

import numpy as np


# --- shared parts -----------------------------------------------------------


def _bits(grid: str, unsigned: bool = True) -> str:
    """64 neighbour comparisons of a 72-cell list, most significant bit first."""
    i = "(k // 8) * 9 + k % 8"
    return (
        f"list_sum(list_transform(range(64), lambda k: CASE WHEN {grid}[{i} + 1] < {grid}[{i} + 2]"
        f" THEN (1::UBIGINT << (63 - k)::UBIGINT) ELSE 0::UBIGINT END))::UBIGINT"
    )


def _hex(phash: str) -> str:
    return f"lower(lpad(to_hex({phash}), 16, '0'))"


def _hashed(name: str, source: str, key: str) -> str:
    """CTEs that turn ``source(key, text)`` into ``name(key, gray, pixel_sha256, phash)``."""
    return f"""
{name}_tok AS (SELECT {key}, unnest(string_split(text, ' ')) AS t FROM {source}),
{name}_cell AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 72 AS c, count(*) AS n
    FROM {name}_tok WHERE t <> '' GROUP BY ALL),
{name}_full AS (SELECT s.{key}, r.c, coalesce(x.n, 0) AS v
    FROM {source} s CROSS JOIN range(72) r(c) LEFT JOIN {name}_cell x ON x.{key} = s.{key} AND x.c = r.c),
{name}_raw AS (SELECT {key}, list(v ORDER BY c) AS counts FROM {name}_full GROUP BY {key}),
{name}_grid AS (SELECT {key}, counts, CASE WHEN list_max(counts) > 255
    THEN list_transform(counts, lambda v: v * 255 // list_max(counts)) ELSE counts END AS gray FROM {name}_raw),
{name} AS (SELECT {key}, gray, sha256(trim(regexp_replace(text, ' +', ' ', 'g'), ' ')) AS pixel_sha256,
    {_bits('gray')} AS phash FROM {name}_grid JOIN {source} USING ({key}))"""


_DOC_PATH = "printf('%s/%08d', source, doc_id)"
_REC = f"""{_hashed('fp', 'documents', 'doc_id')},
rec AS (SELECT doc_id, {_DOC_PATH} AS path, strlen(d.text)::BIGINT AS bytes, d.n_chars::INTEGER AS width,
    1 AS height, 'txt' AS format, sha256(d.text) AS sha256, f.pixel_sha256, f.phash, f.gray
    FROM documents d JOIN fp f USING (doc_id))"""
_TWO = f"""{_hashed('fp', 'documents', 'doc_id')},
base AS (SELECT doc_id, {_DOC_PATH} AS p, d.text, d.n_chars, d.lang, f.pixel_sha256, f.phash
    FROM documents d JOIN fp f USING (doc_id)),
rec AS (SELECT p AS path, strlen(text)::BIGINT AS bytes, n_chars::INTEGER AS width, 1 AS height,
        'txt' AS format, sha256(text) AS sha256, pixel_sha256, phash FROM base
    UNION ALL SELECT 'spaced/' || p, strlen(replace(text, ' ', '  '))::BIGINT, n_chars::INTEGER, 1, 'txt',
        sha256(replace(text, ' ', '  ')), pixel_sha256, phash FROM base WHERE lang = 'en')"""
_PRUNED = """pruned AS (SELECT * REPLACE (CASE WHEN count(*) OVER (PARTITION BY phash) >= 2
    THEN pixel_sha256 END AS pixel_sha256) FROM rec)"""


def _grouped(source: str, key: str, name: str = "g", auto: bool = True) -> str:
    """CTEs ``name_m`` (members with keeper) and ``name`` (groups with ids)."""
    return f"""
{name}_k AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n_members, row_number() OVER (PARTITION BY {key}
    ORDER BY width::BIGINT * height DESC, bytes DESC, path) AS pick FROM {source} WHERE {key} IS NOT NULL),
{name}_d AS (SELECT * FROM {name}_k WHERE n_members >= 2),
{name} AS (SELECT {key}, (row_number() OVER (ORDER BY min(path)) - 1)::BIGINT AS group_id,
    max(CASE WHEN pick = 1 THEN path END) AS keeper, count(*)::BIGINT AS n_members,
    sum(CASE WHEN pick > 1 THEN bytes ELSE 0 END)::BIGINT AS reclaimable_bytes,
    {str(auto).lower()} AS auto_deletable FROM {name}_d GROUP BY {key}),
{name}_m AS (SELECT g.group_id, d.path, d.bytes, g.keeper, d.path = g.keeper AS is_keeper
    FROM {name}_d d JOIN {name} g ON g.{key} = d.{key})"""


def _components(source: str, threshold: int) -> str:
    """CTE ``comp(phash, label)``: closure of the graph of similar fingerprints."""
    return f"""
node AS (SELECT DISTINCT phash FROM {source}),
edge AS (SELECT a.phash AS a, b.phash AS b FROM node a JOIN node b
    ON a.phash <> b.phash AND bit_count(xor(a.phash, b.phash)) <= {threshold}),
reach(a, b) AS (SELECT phash, phash FROM node
    UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
comp AS (SELECT a AS phash, min(b) AS label FROM reach GROUP BY a),
labelled AS (SELECT s.*, c.label FROM {source} s JOIN comp c ON c.phash = s.phash),
wide AS (SELECT x.label, max(bit_count(xor(x.phash, y.phash)))::INTEGER AS max_hamming
    FROM comp x JOIN comp y ON x.label = y.label GROUP BY x.label)"""


_OUT = "group_id, keeper, n_members, reclaimable_bytes, auto_deletable"
_EQUAL_GROUPS = f"SELECT {_OUT}, NULL::INTEGER AS max_hamming FROM g"
_NEAR_GROUPS = f"SELECT {_OUT}, max_hamming FROM g JOIN wide USING (label)"
_MEMBERS = "SELECT group_id, path, bytes, is_keeper FROM g_m"


def _near(threshold: int, source: str = "rec") -> str:
    return f"{_components(source, threshold)}, {_grouped('labelled', 'label', auto=False)}"


def _pairs(threshold: int) -> str:
    return f"""WITH {_REC}, node AS (SELECT phash, count(*) AS n FROM rec GROUP BY phash)
SELECT {_hex('a.phash')} AS phash_a, {_hex('b.phash')} AS phash_b,
    bit_count(xor(a.phash, b.phash))::INTEGER AS distance, a.n::BIGINT AS records_a, b.n::BIGINT AS records_b
FROM node a JOIN node b ON a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= {threshold}"""


def _stats(source: str, groups: str, strictness: str) -> str:
    return f"""SELECT (SELECT count(*) FROM {source})::BIGINT AS scanned, 0::BIGINT AS skipped, count(*)::BIGINT AS groups,
    coalesce(sum(n_members - 1), 0)::BIGINT AS duplicates, coalesce(sum(reclaimable_bytes), 0)::BIGINT AS reclaimable_bytes,
    coalesce(sum(reclaimable_bytes) FILTER (WHERE auto_deletable), 0)::BIGINT AS reclaimable_auto,
    '{strictness}' AS strictness FROM {groups}"""


_FIND = """m AS (SELECT r.*, bit_count(xor(r.phash, q.phash))::INTEGER AS hamming,
    CASE WHEN r.sha256 = q.sha256 THEN 'exact' WHEN r.pixel_sha256 = q.pixel_sha256 THEN 'pixel'
         WHEN bit_count(xor(r.phash, q.phash)) <= {t} THEN 'perceptual' END AS tier, {cols}
    FROM rec r CROSS JOIN {query} q)"""
_ONE = "one AS (SELECT * FROM rec ORDER BY path LIMIT 1)"
_RANK = "CASE tier WHEN 'exact' THEN 0 WHEN 'pixel' THEN 1 ELSE 2 END"
_MATCH = "path, bytes, width, height, format, tier, hamming"


def _find_top(threshold: int, top: int) -> str:
    return f"""WITH {_TWO}, {_ONE}, {_FIND.format(t=threshold, query='one', cols='1 AS x')},
top AS (SELECT * FROM m WHERE tier IS NOT NULL ORDER BY {_RANK}, hamming, path LIMIT {top})"""


# --- rasters -----------------------------------------------------------------


def _taps(size: int, target: int) -> list[tuple[int, list[str]]]:
    """Triangle filter weights in single precision, as SQL literals."""
    f32 = np.float32
    ratio = f32(size) / f32(target)
    reach = max(ratio, f32(1))
    out = []
    for cell in range(target):
        mid = (f32(cell) + f32(0.5)) * ratio
        lo = max(math.floor(mid - reach), 0)
        hi = min(math.ceil(mid + reach), size)
        raw = [max(f32(0), f32(1) - abs((f32(i) - (mid - f32(0.5))) / reach)) for i in range(lo, hi)]
        total = f32(0)
        for w in raw:
            total = f32(total + w)
        out.append((lo, [f"{float(f32(w / total))!r}::FLOAT" for w in raw]))
    return out


def _dot(terms: list[tuple[str, str]]) -> str:
    text = "0::FLOAT"
    for value, weight in terms:
        text = f"({text} + {value} * {weight})"
    return text


def _grid(values: str, w: int, h: int) -> tuple[str, str]:
    """SQL lists for the vertical pass (8 rows of w) and then the full 9x8 grid of a gray raster."""
    tall = []
    for lo, weights in _taps(h, 8):
        for x in range(w):
            tall.append(_dot([(f"{values}[{(lo + k) * w + x + 1}]::FLOAT", wt) for k, wt in enumerate(weights)]))
    cells = []
    for y in range(8):
        for lo, weights in _taps(w, 9):
            total = _dot([(f"tall[{y * w + lo + k + 1}]", wt) for k, wt in enumerate(weights)])
            cells.append(f"floor(least(greatest({total}, 0::FLOAT), 255::FLOAT) + 0.5::FLOAT)::INTEGER")
    return f"[{', '.join(tall)}]", f"[{', '.join(cells)}]"


_2_50, _2_60 = "1125899906842624::DOUBLE", "1152921504606846976::DOUBLE"
_A = f"(e::DOUBLE * {_2_50})"
_B = f"(({_A} - floor({_A})) * {_2_60})"
_C = f"(({_B} - floor({_B})) * {_2_60})"
_VEC = f"""vec AS (SELECT vec_id, label, list_transform(embedding, lambda e:
    least(greatest(floor((e::DOUBLE + 1) * 127.5::DOUBLE), 0), 255)::INTEGER) AS v,
    sha256(array_to_string(list_transform(embedding, lambda e: floor({_A})::BIGINT || ':' || floor({_B})::BIGINT || ':'
        || floor({_C})::BIGINT), ',')) AS own FROM embeddings)"""


def _rgba_hex(values: str) -> str:
    return f"list_aggregate(list_transform({values}, lambda x: printf('%02x%02x%02xff', x, x, x)), 'string_agg', '')"


def _shaped() -> str:
    tall8, grid8 = _grid("v", 8, 8)
    tall16, grid16 = _grid("v", 16, 4)
    return f"""{_VEC},
t8 AS (SELECT *, 8 AS width, 8 AS height, {tall8} AS tall FROM vec WHERE label < 5),
t16 AS (SELECT *, 16 AS width, 4 AS height, {tall16} AS tall FROM vec WHERE label >= 5),
cells AS (SELECT vec_id, width, height, v, own, {grid8} AS grid FROM t8
    UNION ALL SELECT vec_id, width, height, v, own, {grid16} FROM t16),
img AS (SELECT vec_id, width, height, v, own AS sha256,
    sha256(unhex({_rgba_hex('v')})) AS pixel_sha256, {_bits('grid')} AS phash FROM cells)"""


_ZIP = "range(1, 65)"


def _compare() -> str:
    mean = lambda e: f"list_sum(list_transform({_ZIP}, lambda i: ({e})::DOUBLE)) / 64::DOUBLE"
    return f"""WITH {_shaped()},
p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.sha256 = b.sha256 AS sha_equal,
        a.width = b.width AND a.height = b.height AS dims_equal, a.pixel_sha256 = b.pixel_sha256 AS same_pixels,
        a.v AS x, b.v AS y, bit_count(xor(a.phash, b.phash))::INTEGER AS hamming
    FROM img a JOIN img b ON b.vec_id = a.vec_id + 1),
q AS (SELECT *, {mean('x[i]')} AS mx, {mean('y[i]')} AS my, {mean('x[i] * x[i]')} AS xx,
        {mean('y[i] * y[i]')} AS yy, {mean('x[i] * y[i]')} AS xy,
        {mean('(x[i] - y[i]) * (x[i] - y[i])')} AS mse,
        {mean('CASE WHEN abs(x[i] - y[i]) > 20 THEN 1 ELSE 0 END')} AS ratio FROM p),
s AS (SELECT *, least(greatest((2 * mx * my + 6.5025::DOUBLE) * (2 * (xy - mx * my) + 58.5225::DOUBLE)
        / ((mx * mx + my * my + 6.5025::DOUBLE) * ((xx - mx * mx) + (yy - my * my) + 58.5225::DOUBLE)), 0), 1) AS score,
        CASE WHEN mse = 0 THEN 100::DOUBLE ELSE least(10 * log10(65025::DOUBLE / mse), 100) END AS db FROM q)
SELECT a, b, sha_equal, dims_equal, dims_equal AS comparable,
    CASE WHEN dims_equal THEN same_pixels END AS pixel_equal,
    CASE WHEN dims_equal THEN round(ratio, 6) END AS pixel_diff_ratio,
    CASE WHEN dims_equal THEN round(db, 6) END AS psnr,
    CASE WHEN dims_equal THEN round(score, 6) END AS ssim, hamming,
    CASE WHEN sha_equal THEN 'identical' WHEN dims_equal AND same_pixels THEN 'same_pixels'
        WHEN NOT dims_equal THEN 'incomparable' WHEN score >= 0.995 THEN 'near_identical'
        WHEN score >= 0.9 THEN 'similar' ELSE 'different' END AS verdict FROM s"""


def _mosaics() -> str:
    mean = lambda e: f"list_avg(list_transform(spot, lambda i: ({e})::DOUBLE))"
    return f"""WITH {_VEC}, pic AS (SELECT vec_id // 4 AS tile, flatten(list(v ORDER BY vec_id)) AS v FROM vec GROUP BY ALL),
p AS (SELECT a.tile AS a, b.tile AS b, a.v AS x, b.v AS y, len(a.v) = len(b.v) AS same, len(a.v) // 16 AS h,
        CASE WHEN len(a.v) < 128 THEN len(a.v) // 16 ELSE 8 END AS wh, CASE WHEN len(a.v) < 128 THEN 16 ELSE 8 END AS ww
    FROM pic a JOIN pic b ON b.tile = a.tile + 1),
down AS (SELECT *, unnest(range(h - wh + 1)) AS oy FROM p WHERE same),
win AS (SELECT *, unnest(range(16 - ww + 1)) AS ox FROM down),
pos AS (SELECT a, b, x, y, list_transform(range(wh * ww), lambda i: (oy + i // ww) * 16 + ox + i % ww + 1) AS spot FROM win),
q AS (SELECT a, b, {mean('x[i]')} AS mx, {mean('y[i]')} AS my, {mean('x[i] * x[i]')} AS xx, {mean('y[i] * y[i]')} AS yy,
        {mean('x[i] * y[i]')} AS xy FROM pos),
s AS (SELECT a, b, least(greatest(avg((2 * mx * my + 6.5025::DOUBLE) * (2 * (xy - mx * my) + 58.5225::DOUBLE)
        / ((mx * mx + my * my + 6.5025::DOUBLE) * ((xx - mx * mx) + (yy - my * my) + 58.5225::DOUBLE))), 0), 1) AS ssim FROM q GROUP BY a, b),
whole AS (SELECT a, b, same, x, y, range(1, len(x) + 1) AS spot FROM p),
t AS (SELECT a, b, same, {mean('(x[i] - y[i]) * (x[i] - y[i])')} AS mse,
        {mean('CASE WHEN abs(x[i] - y[i]) > 20 THEN 1 ELSE 0 END')} AS ratio FROM whole)
SELECT a::BIGINT AS a, b::BIGINT AS b, same AS comparable, CASE WHEN same THEN round(ratio, 6) END AS pixel_diff_ratio,
    CASE WHEN same THEN round(CASE WHEN mse = 0 THEN 100::DOUBLE ELSE least(10 * log10(65025::DOUBLE / mse), 100) END, 6) END AS psnr,
    CASE WHEN same THEN round(ssim, 6) END AS ssim FROM t LEFT JOIN s USING (a, b)"""


def _flatten() -> str:
    chan = lambda k: (
        f"CASE WHEN v[i * 4 + 4] = 255 THEN v[i * 4 + {k}] ELSE "
        f"(v[i * 4 + {k}] * v[i * 4 + 4] + 255 * (255 - v[i * 4 + 4]) + 127) // 255 END"
    )
    return f"""WITH {_VEC}, px AS (SELECT vec_id, list_transform(range(16), lambda i: {chan(1)}) AS r,
    list_transform(range(16), lambda i: {chan(2)}) AS g, list_transform(range(16), lambda i: {chan(3)}) AS b FROM vec)
SELECT vec_id, sha256(unhex(list_aggregate(list_transform(range(1, 17),
        lambda i: printf('%02x%02x%02xff', r[i], g[i], b[i])), 'string_agg', ''))) AS flat_sha256,
    sha256(unhex(list_aggregate(list_transform(range(1, 17), lambda i: printf('%02x',
        floor(0.299::DOUBLE * r[i] + 0.587::DOUBLE * g[i] + 0.114::DOUBLE * b[i] + 0.5::DOUBLE)::INTEGER)),
        'string_agg', ''))) AS gray_sha256 FROM px"""


_HIGHLIGHT = f"""WITH {_VEC}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.v AS x, b.v AS y
    FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1)
SELECT a, b, sha256(unhex(list_aggregate(list_transform({_ZIP}, lambda i: CASE WHEN abs(x[i] - y[i]) > 20 THEN 'ff00ffff'
        ELSE printf('%02x%02x%02xff', (2 * x[i] + 767) // 5, (2 * x[i] + 767) // 5, (2 * x[i] + 767) // 5) END),
        'string_agg', ''))) AS highlight_sha256,
    list_sum(list_transform({_ZIP}, lambda i: CASE WHEN abs(x[i] - y[i]) > 20 THEN 1 ELSE 0 END))::INTEGER AS magenta
FROM p"""

# --- index life cycle ---------------------------------------------------------

_EDITED = f"""(SELECT {_DOC_PATH} AS path, CASE WHEN doc_id % 5 = 2 THEN text || ' (edited)' ELSE text END AS text,
    (doc_id % 5 = 2)::BIGINT AS edits, (doc_id % 7 = 0)::BIGINT AS fails FROM documents)"""
_LISTING = f"""listing AS (SELECT {_DOC_PATH} AS path, strlen(text)::BIGINT AS size, doc_id * 1000000 AS mtime_ns
    FROM documents)"""
_INDEX = f"""{_REC}, {_LISTING},
entry AS (SELECT path, bytes AS size, doc_id * 1000000 - 1 AS mtime_ns, 'dhash-1' AS hash_algo, sha256, phash, 1 AS indexed_at
        FROM rec JOIN labels USING (doc_id)
    UNION ALL SELECT path, bytes, doc_id * 1000000 + toxic, CASE WHEN quality = 1 THEN 'dhash-1' ELSE 'dhash-0' END,
        sha256, phash, 2 FROM rec JOIN labels USING (doc_id)
    UNION ALL SELECT url, strlen(html)::BIGINT, 0, 'dhash-1', sha256(html), NULL, 1 FROM pages),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) AS rn FROM entry)
    WHERE rn = 1),
hit AS (SELECT n.* FROM newest n JOIN listing l ON l.path = n.path AND l.size = n.size AND l.mtime_ns = n.mtime_ns
    WHERE n.hash_algo = 'dhash-1')"""
_PAGES = f"""{_hashed('pf', 'page_text', 'page_id')},
prow AS (SELECT regexp_replace(url, '^https?://', '') AS path, strlen(html)::BIGINT AS bytes, length(html)::INTEGER AS width,
    'html' AS format, sha256(html) AS sha256, pixel_sha256, phash
    FROM pages JOIN pf USING (page_id) WHERE html IS NOT NULL)"""
_PAGES = f"page_text AS (SELECT page_id, html AS text FROM pages), {_PAGES}"
_SCALED = """scaled AS (SELECT printf('vector/%06d', vec_id) AS path, list_transform(embedding, lambda e: e::DOUBLE * 2.5::DOUBLE) AS v
    FROM embeddings),
shown AS (SELECT *, len(list_filter(v, lambda x: abs(x) > 1)) = 0 AS inside FROM scaled)"""
_SKIPPED = f"""{_SCALED}, skip AS (SELECT path, 'entries outside [-1, 1]' AS reason FROM shown WHERE NOT inside
    UNION ALL SELECT regexp_replace(url, '^https?://', ''), 'no text' FROM pages WHERE html IS NULL)"""


def _sizes(n: str) -> str:
    out = f"CASE WHEN {n} < 1024 THEN {n} || ' B'"
    for p, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        size = 1024**p
        tenth = f"(({n}::HUGEINT * 10 + {size // 2}) // {size})"
        text = (
            f"(CASE WHEN {n} < {10 * size} THEN ({tenth} // 10) || '.' || ({tenth} % 10)"
            f" ELSE (({n}::HUGEINT + {size // 2}) // {size})::VARCHAR END) || ' {unit}'"
        )
        out += f" ELSE {text} END" if unit == "TB" else f" WHEN {n} < {size * 1024} THEN {text}"
    return out


_SAFE = "NOT ('/' || {0} || '/' LIKE '%//%' OR '/' || {0} || '/' LIKE '%/./%' OR '/' || {0} || '/' LIKE '%/../%')"


def _report(strictness: str, threshold: str, groups: str, images: bool) -> str:
    pad = "lpad(group_id::VARCHAR, 20, '0')"
    parts = [
        f"""SELECT 'head' AS section, '' AS sort_key, to_json({{'kind': 'scan', 'section': 'head', 'schemaVersion': 1,
    'producer': {{'app': 'twinsift', 'appVersion': '1', 'decoder': 'spark-image', 'hashAlgo': 'dhash-1'}},
    'root': 'documents', 'strictness': '{strictness}', 'threshold': {threshold}}})::VARCHAR AS json""",
        """SELECT 'stats', '', to_json({'kind': 'scan', 'section': 'stats', 'scanned': (SELECT count(*) FROM rec),
    'skipped': (SELECT count(*) FROM skip), 'groups': count(*), 'duplicates': sum(n_members - 1)::BIGINT,
    'reclaimableBytes': sum(reclaimable_bytes)::BIGINT})::VARCHAR FROM g""",
        f"""SELECT 'group', {pad}, to_json({{'kind': 'scan', 'section': 'group', 'id': group_id, 'strictness': '{strictness}',
    'memberCount': n_members, 'keeper': keeper, 'reclaimableBytes': reclaimable_bytes,
    'autoDeletable': auto_deletable, 'maxHamming': max_hamming}})::VARCHAR FROM ({groups})""",
        f"""SELECT 'member', {pad} || ' ' || path, to_json({{'kind': 'scan', 'section': 'member', 'id': group_id,
    'path': path}})::VARCHAR FROM g_m""",
        """SELECT 'skipped', path, to_json({'kind': 'scan', 'section': 'skipped', 'path': path,
    'reason': reason})::VARCHAR FROM skip""",
    ]
    if images:
        parts.append(
            f"""SELECT 'image', path, to_json({{'kind': 'scan', 'section': 'image', 'path': path, 'bytes': bytes,
    'width': width, 'height': height, 'format': format, 'sha256': sha256, 'pixelSha256': pixel_sha256,
    'phash': {_hex('phash')}}})::VARCHAR FROM rec"""
        )
    return "\nUNION ALL ".join(parts)


_HEAD = """'schemaVersion': 1, 'producer': {'app': 'twinsift', 'appVersion': '1', 'decoder': 'spark-image',
    'hashAlgo': 'dhash-1'}, 'root': 'documents'"""
_IMAGE = f"""'path': path, 'bytes': bytes, 'width': width, 'height': height, 'format': format, 'sha256': sha256,
    'pixelSha256': pixel_sha256, 'phash': {_hex('phash')}"""


def _line(kind: str, section: str, key: str, body: str, source: str) -> str:
    return f"""SELECT '{section}' AS section, {key} AS sort_key,
    to_json({{'kind': '{kind}', 'section': '{section}', {body}}})::VARCHAR AS json {source}"""


def _find_report() -> str:
    counts = """'scanned': (SELECT count(*) FROM rec), 'skipped': (SELECT count(*) FROM skip),
    'matched': (SELECT count(*) FROM top)"""
    match = """'path': path, 'bytes': bytes, 'width': width, 'height': height, 'format': format, 'tier': tier,
    'hammingDistance': hamming"""
    parts = [
        _line("find", "head", "''", f"{_HEAD}, 'threshold': 24", ""),
        _line("find", "query", "''", _IMAGE, "FROM one"),
        _line("find", "stats", "''", counts, ""),
        _line("find", "match", f"({_RANK}) || ' ' || lpad(hamming::VARCHAR, 2, '0') || ' ' || path", match, "FROM top"),
        _line("find", "skipped", "path", "'path': path, 'reason': reason", "FROM skip"),
    ]
    return f"{_find_top(24, 25)}, {_SKIPPED} " + " UNION ALL ".join(parts)


def _clean_report() -> str:
    counts = """'scanned': (SELECT count(*) FROM rec), 'groups': (SELECT count(*) FROM g), 
    'planned': count(*) FILTER (WHERE starts_with(path, 'src0/')), 'rejected': count(*) FILTER (WHERE NOT starts_with(path, 'src0/')),
    'reclaimableBytes': coalesce(sum(bytes) FILTER (WHERE starts_with(path, 'src0/')), 0)::BIGINT"""
    target = "'path': path, 'groupId': group_id, 'bytes': bytes, 'keeper': keeper"
    key = "lpad(group_id::VARCHAR, 20, '0') || ' ' || path"
    parts = [
        _line("clean", "head", "''", f"{_HEAD}, 'strictness': 'pixel', 'dryRun': true", ""),
        _line("clean", "stats", "''", counts, "FROM g_m WHERE NOT is_keeper"),
        _line("clean", "planned", key, target, "FROM g_m WHERE NOT is_keeper AND starts_with(path, 'src0/')"),
        _line("clean", "rejected", key, target, "FROM g_m WHERE NOT is_keeper AND NOT starts_with(path, 'src0/')"),
    ]
    return f"WITH {_TWO}, {_PRUNED}, {_grouped('pruned', 'pixel_sha256')} " + " UNION ALL ".join(parts)


ORACLES: dict[str, str] = {
    "find_document": _find_report(),
    "clean_document": _clean_report(),
    "sha256_content": "SELECT doc_id, sha256(text) AS sha256, strlen(text)::INTEGER AS bytes FROM documents",
    "text_fingerprint": f"""WITH {_REC} SELECT path, bytes, width, height, sha256, pixel_sha256,
        {_hex('phash')} AS phash FROM rec""",
    "gray_grid_hash": f"""WITH {_REC} SELECT path, list_sum(gray)::INTEGER AS total, {_hex('phash')} AS phash FROM rec""",
    "phash_codec": f"""WITH {_REC}, o AS (SELECT *, substr(sha256, 1, 10 + width % 12) AS other FROM rec)
        SELECT path, {_hex('phash')} AS hex, {_hex('phash')} AS round_trip,
        length(other) > 16 AS other_is_invalid, bit_count(phash)::INTEGER AS ones, CASE WHEN length(other) <= 16
        THEN bit_count(xor(phash, ('0x' || other)::UBIGINT)) END::INTEGER AS distance FROM o""",
    "pixel_prune": f"WITH {_TWO}, {_PRUNED} SELECT path, pixel_sha256, {_hex('phash')} AS phash FROM pruned",
    "exact_groups": f"WITH {_REC}, {_grouped('rec', 'sha256')} {_EQUAL_GROUPS}",
    "exact_display": f"""WITH {_REC}, {_grouped('rec', 'sha256')} SELECT row_number() OVER (ORDER BY group_id, NOT is_keeper, path) - 1
        AS place, group_id, path, is_keeper FROM g_m""",
    "exact_members": f"WITH {_REC}, {_grouped('rec', 'sha256')} {_MEMBERS}",
    "conversation_groups": f"""WITH RECURSIVE turn AS (SELECT printf('%s/%d/%d', role, conv_id, turn) AS path, text
            FROM conversations), {_hashed('tf', 'turn', 'path')},
        rec AS (SELECT path, strlen(text)::BIGINT AS bytes, length(text)::INTEGER AS width, 1 AS height, phash
            FROM turn JOIN tf USING (path)), {_near(12)} {_NEAR_GROUPS}""",
    "pixel_groups": f"WITH {_TWO}, {_PRUNED}, {_grouped('pruned', 'pixel_sha256')} {_EQUAL_GROUPS}",
    "pixel_members": f"WITH {_TWO}, {_PRUNED}, {_grouped('pruned', 'pixel_sha256')} {_MEMBERS}",
    "perceptual_groups_t4": f"WITH RECURSIVE {_REC}, {_near(4)} {_NEAR_GROUPS}",
    "perceptual_members_t4": f"WITH RECURSIVE {_REC}, {_near(4)} {_MEMBERS}",
    "perceptual_groups": f"WITH RECURSIVE {_REC}, {_near(10)} {_NEAR_GROUPS}",
    "hamming_pairs_t4": _pairs(4),
    "hamming_pairs_t10": _pairs(10),
    "keepers": f"WITH {_REC}, {_grouped('rec', 'sha256')} SELECT group_id, path, bytes FROM g_m WHERE is_keeper",
    "scan_stats": f"""WITH RECURSIVE {_REC}, {_PRUNED}, {_grouped('rec', 'sha256', 'ge')},
        {_grouped('pruned', 'pixel_sha256', 'gp')}, {_near(4)}
        {_stats('rec', 'ge', 'exact')} UNION ALL {_stats('rec', 'gp', 'pixel')}
        UNION ALL {_stats('rec', 'g', 'perceptual')}""",
    "deletion_plan": f"""WITH {_TWO}, {_PRUNED}, {_grouped('pruned', 'pixel_sha256')}
        SELECT path, group_id, bytes, keeper FROM g_m WHERE NOT is_keeper""",
    "deletion_plan_lookup": f"""WITH {_TWO}, {_grouped('rec', 'pixel_sha256')}
        SELECT path, group_id, CASE WHEN starts_with(path, 'spaced/') THEN 0 ELSE bytes END::BIGINT AS bytes, keeper
        FROM g_m WHERE NOT is_keeper""",
    "retained_set": f"""WITH {_TWO}, {_PRUNED}, {_grouped('pruned', 'pixel_sha256')}
        SELECT path, bytes, sha256, {_hex('phash')} AS phash FROM rec
        WHERE path NOT IN (SELECT path FROM g_m WHERE NOT is_keeper)""",
    "clean_stats": f"""WITH {_TWO}, {_PRUNED}, {_grouped('pruned', 'pixel_sha256')}
        SELECT (SELECT count(*) FROM rec)::BIGINT AS scanned, (SELECT count(*) FROM g)::BIGINT AS groups,
        count(*) FILTER (WHERE starts_with(path, 'src0/'))::BIGINT AS planned,
        coalesce(sum(bytes) FILTER (WHERE starts_with(path, 'src0/')), 0)::BIGINT AS reclaimable_bytes,
        count(*) FILTER (WHERE NOT starts_with(path, 'src0/'))::BIGINT AS rejected
        FROM g_m WHERE NOT is_keeper""",
    "reconcile_groups": f"""WITH RECURSIVE {_REC}, {_grouped('rec', 'sha256', 'ge')},
        rest AS (SELECT * FROM rec WHERE path NOT IN (SELECT path FROM ge_m WHERE NOT is_keeper)),
        {_near(4, 'rest')} {_NEAR_GROUPS}""",
    "find_similar": f"""WITH {_TWO}, {_ONE}, {_FIND.format(t=16, query='one', cols='q.path AS self')}
        SELECT {_MATCH} FROM m WHERE tier IS NOT NULL AND NOT (tier = 'exact' AND path = self)""",
    "find_top": f"{_find_top(24, 25)} SELECT {_MATCH} FROM top",
    "find_stats": f"""{_find_top(24, 25)} SELECT (SELECT count(*) FROM rec)::BIGINT AS scanned, 0::BIGINT AS skipped,
        count(*)::BIGINT AS matched FROM top""",
    "find_topn_batch": f"""WITH {_REC}, {_hashed('bf', 'benchmark', 'item_id')},
        query AS (SELECT b.item_id, sha256(b.text) AS sha256, f.pixel_sha256, f.phash FROM benchmark b JOIN bf f USING (item_id)),
        {_FIND.format(t=10, query='query', cols='q.item_id AS query_id')},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_RANK}, hamming, path)::INTEGER AS rank
            FROM m WHERE tier IS NOT NULL)
        SELECT query_id, rank, {_MATCH} FROM ranked WHERE rank <= 3""",
    "find_neighbours": f"""WITH {_REC}, {_FIND.format(t=6, query='rec', cols='q.path AS query_id')},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_RANK}, hamming, path)::INTEGER AS rank
            FROM m WHERE tier IS NOT NULL AND NOT (tier = 'exact' AND path = query_id))
        SELECT query_id, rank, {_MATCH} FROM ranked WHERE rank <= 2""",
    "flatten_and_gray": _flatten(),
    "raster_fingerprint": f"""WITH {_shaped()} SELECT vec_id, width, height, 64::BIGINT AS bytes, sha256, pixel_sha256,
        {_hex('phash')} AS phash FROM img""",
    "compare_vectors": _compare(),
    "compare_mosaics": _mosaics(),
    "highlight_vectors": _HIGHLIGHT,
    "latest_index": f"""WITH {_INDEX} SELECT path, size, mtime_ns::BIGINT AS mtime_ns, hash_algo, sha256,
        indexed_at::BIGINT AS indexed_at FROM newest""",
    "incremental_hits": f"WITH {_INDEX} SELECT path, size AS bytes, sha256, {_hex('phash')} AS phash FROM hit",
    "incremental_misses": f"WITH {_INDEX} SELECT * FROM listing WHERE path NOT IN (SELECT path FROM hit)",
    "orphan_entries": f"""WITH {_INDEX} SELECT path, size, sha256 FROM newest
        WHERE path NOT IN (SELECT path FROM listing)""",
    "index_after_gc": f"""WITH {_INDEX} SELECT path, size, mtime_ns::BIGINT AS mtime_ns, hash_algo FROM newest
        WHERE path IN (SELECT path FROM listing)""",
    "text_balance": """SELECT source, count(*) AS inputs, count(text) AS records, count(*) - count(text) AS skipped
        FROM documents GROUP BY source""",
    "skipped_items": f"WITH {_SKIPPED} SELECT path, reason FROM skip",
    "indexed_vectors": f"""WITH {_SCALED}, b AS (SELECT path, list_transform(v, lambda x:
            least(greatest(floor((x + 1) * 127.5::DOUBLE), 0), 255)::INTEGER) AS v FROM shown WHERE inside)
        SELECT path, 64::BIGINT AS bytes, 8 AS width, 8 AS height, 'vector' AS format,
        sha256(unhex({_rgba_hex('v')})) AS pixel_sha256 FROM b""",
    "indexed_pages": f"""WITH {_PAGES} SELECT path, bytes, width, format, sha256,
        CASE WHEN count(*) OVER (PARTITION BY phash) >= 2 THEN pixel_sha256 END AS pixel_sha256,
        {_hex('phash')} AS phash FROM prow""",
    "stream_index": f"""WITH {_REC} SELECT path, bytes, width, height, format, sha256, pixel_sha256,
        {_hex('phash')} AS phash FROM rec""",
    "refreshed_index": f"""SELECT path, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256, 1 + edits AS entries FROM {_EDITED}""",
    "stream_changes": f"""SELECT path, strlen(text)::BIGINT AS size, sha256(text) AS sha256, 1 + edits + fails AS offers,
        fails * (1 + edits) AS failures FROM {_EDITED}""",
    "unique_names": """SELECT doc_id, source || '.txt' AS name, CASE WHEN n = 1 THEN source || '.txt'
        ELSE source || ' (' || n || ').txt' END AS path
        FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)""",
    "taken_names": """WITH named AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 3 THEN doc_id % 47 + 2 END AS k FROM documents),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY doc_id) AS n FROM named),
        numbers AS (SELECT source, unnest(generate_series(1, count(*) + 48)) AS k FROM documents GROUP BY source),
        free AS (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY k) AS n
            FROM numbers ANTI JOIN (SELECT source, k FROM named WHERE k IS NOT NULL) USING (source, k))
        SELECT doc_id, source || ' (' || k || ').txt' AS name,
            source || ' (' || k || CASE WHEN n = 1 THEN ').txt' ELSE ') (' || n || ').txt' END AS path FROM ranked WHERE k IS NOT NULL
        UNION ALL SELECT doc_id, source || '.txt', source || CASE WHEN f.k = 1 THEN '.txt' ELSE ' (' || f.k || ').txt' END
        FROM ranked r JOIN free f USING (source, n) WHERE r.k IS NULL""",
    "page_formats": """SELECT page_id, ext, CASE ext WHEN 'jpg' THEN 'jpeg' WHEN 'tif' THEN 'tiff' ELSE ext END AS format,
        ext IN ('html', 'htm') AS listed
        FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([^./]+)$', 1)) AS ext FROM pages)""",
    "page_paths": f"""SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 8) ELSE url END AS path,
        {_SAFE.format('url')} AS url_is_safe, {_SAFE.format("regexp_replace(url, '^https?://', '')")} AS path_is_safe,
        {_SAFE.format("regexp_replace(regexp_replace(url, '^https?://', ''), '/(en|de)/', '/../', 'g')")} AS parent_is_safe FROM pages""",
    "readable_sizes": f"""WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
        p AS (SELECT o_orderkey, cents, cents * o_orderkey * 1000 AS big FROM o)
        SELECT o_orderkey, {_sizes('o_orderkey')} AS small, {_sizes('cents')} AS medium, {_sizes('big')} AS large FROM p""",
    "event_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events",
    "scan_document": f"""WITH {_REC}, {_SKIPPED}, {_grouped('rec', 'sha256')}
        {_report('exact', 'NULL', _EQUAL_GROUPS, True)}""",
    "scan_summary": f"""WITH RECURSIVE {_REC}, {_SKIPPED}, {_near(4)}
        {_report('perceptual', '4', _NEAR_GROUPS, False)}""",
}
