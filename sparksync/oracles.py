"""SQL counterparts of the registered queries, in DuckDB's dialect.

They are written on their own, from the meaning of each operator, and run on
the whole shared tables.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

SRC = """src AS (
  SELECT doc_id, source||'/'||lang||'/'||doc_id||'.txt' AS path, 'file' AS kind,
    CAST(octet_length(encode(text)) AS BIGINT) AS size,
    CAST(CASE doc_id % 8 WHEN 0 THEN 493 WHEN 1 THEN 2541 ELSE 420 END AS INT) AS mode,
    1700000000 + doc_id*60 AS mtime_sec, CAST(doc_id % 1000 AS INT) AS mtime_nsec,
    sha256(text) AS hash, text AS content
  FROM documents)"""

DST = """dst AS (
  SELECT doc_id, path, 'file' AS kind, CAST(octet_length(encode(content)) AS BIGINT) AS size,
    CAST(mode AS INT) AS mode, mtime_sec, CAST(mtime_nsec AS INT) AS mtime_nsec,
    sha256(content) AS hash, content
  FROM (
    SELECT doc_id, source||'/'||lang||'/'||doc_id||'.txt' AS path,
      CASE doc_id % 10 WHEN 1 THEN concat(substr(text,1,100),'EDIT',substr(text,101))
                       WHEN 6 THEN concat(substr(text,2),substr(text,1,1)) ELSE text END AS content,
      CASE WHEN doc_id % 10 = 5 THEN 384 WHEN doc_id % 8 = 0 THEN 493 WHEN doc_id % 8 = 1 THEN 2541 ELSE 420 END AS mode,
      1700000000 + doc_id*60 + CASE doc_id % 10 WHEN 2 THEN -1 WHEN 3 THEN 3600 ELSE 0 END AS mtime_sec,
      doc_id % 1000 + CASE doc_id % 10 WHEN 4 THEN 1 ELSE 0 END AS mtime_nsec
    FROM documents WHERE doc_id % 10 <> 0
    UNION ALL
    SELECT doc_id, 'stale/'||lang||'/'||doc_id||'.txt', text, 420, 1600000000, 0
    FROM documents WHERE doc_id % 25 = 0))"""

LINKS = """lnk AS (
  SELECT page_id, 'site'||(page_id % 20)||'/p'||page_id AS path,
    CASE page_id % 5
      WHEN 0 THEN 'p'||((page_id // 80) * 80 + (page_id + 20) % 80)
      WHEN 1 THEN '../site'||((page_id+1) % 20)||'/p'||(page_id+1)
      WHEN 2 THEN '/ext/'||page_id
      WHEN 3 THEN './p'||page_id
      ELSE '../../outside' END AS link_target
  FROM pages)"""

# The whole link tree: every link with the absolute place it names, written out by hand.
LINK_TREE = """pg AS (SELECT page_id AS p, page_id // 50 AS b, page_id // 30 AS c FROM pages),
lt AS (
  SELECT path, link_target, CASE WHEN page_id % 5 = 3 THEN 'p'||page_id ELSE link_target END AS rewritten,
    CASE page_id % 5
      WHEN 0 THEN '/root/site'||(page_id % 20)||'/p'||((page_id // 80) * 80 + (page_id + 20) % 80)
      WHEN 1 THEN '/root/site'||((page_id+1) % 20)||'/p'||(page_id+1)
      WHEN 2 THEN link_target
      WHEN 3 THEN '/root/'||path
      ELSE '/outside' END AS named
  FROM lnk
  UNION ALL
  SELECT 'chain/c'||p, t, t, n FROM (SELECT p,
    CASE WHEN p % 30 > 0 THEN 'c'||(p-1) WHEN c % 4 = 0 THEN '../data/b'||b||'/f'||p WHEN c % 4 = 1 THEN '/ext/'||(p+7)
      WHEN c % 4 = 2 THEN '../data/b'||b ELSE '../data/none'||p END AS t,
    CASE WHEN p % 30 > 0 THEN '/root/chain/c'||(p-1) WHEN c % 4 = 0 THEN '/root/data/b'||b||'/f'||p WHEN c % 4 = 1 THEN '/ext/'||(p+7)
      WHEN c % 4 = 2 THEN '/root/data/b'||b ELSE '/root/data/none'||p END AS n FROM pg)
  UNION ALL
  SELECT 'via/v'||p, '../chain/c'||(c*30)||'/f'||p, '../chain/c'||(c*30)||'/f'||p, '/root/chain/c'||(c*30)||'/f'||p FROM pg WHERE p % 3 = 0
  UNION ALL
  SELECT 'hub'||b||'/h'||p, t, t, '/root/'||substr(t, 4)
  FROM (SELECT *, CASE WHEN p % 20 = 0 THEN '../data/b'||b ELSE '../back'||b END AS t FROM pg WHERE p % 10 = 0)
  UNION ALL
  SELECT 'back'||b||'/up', '../hub'||b, '../hub'||b, '/root/hub'||b FROM pg WHERE p % 50 = 0),
xt AS (
  SELECT '/ext/'||page_id AS place, CASE WHEN page_id % 3 = 1 THEN 'file' ELSE 'dir' END AS kind FROM pages WHERE page_id % 5 = 2 AND page_id % 3 <> 0),
allinks AS (
  SELECT '/root/'||path AS place, named FROM lt
  UNION ALL SELECT place||'/again', place FROM xt WHERE kind = 'dir'),
reals AS (
  SELECT '/root/data/b'||b||'/f'||p AS place, 'file' AS kind FROM pg WHERE p % 3 = 0
  UNION ALL SELECT place, kind FROM xt
  UNION ALL SELECT place||'/x', 'file' FROM xt WHERE kind = 'dir'),
kinds AS (
  SELECT * FROM reals
  UNION SELECT '/root', 'dir'
  UNION SELECT array_to_string(parts[1:i], '/'), 'dir'
  FROM (SELECT parts, unnest(range(2, len(parts))) AS i FROM (
    SELECT string_split(place, '/') AS parts FROM reals UNION ALL SELECT string_split(place, '/') FROM allinks))),
walk AS (
  SELECT place, named AS cur, 1 AS hops FROM allinks
  UNION ALL
  SELECT w.place, l.named || substr(w.cur, length(l.place) + 1), w.hops + 1
  FROM walk w JOIN allinks l ON w.cur = l.place OR starts_with(w.cur, l.place||'/') WHERE w.hops <= 40),
fin AS (
  SELECT w.place, w.final, k.kind AS target_kind
  FROM (SELECT place, CASE WHEN max(hops) <= 40 THEN arg_max(cur, hops) END AS final FROM walk GROUP BY place) w
  LEFT JOIN kinds k ON k.place = w.final),
cls AS (
  SELECT lt.*, f.final, f.target_kind,
    CASE WHEN starts_with(coalesce(f.final, lt.named), '/root/') THEN 'internal'
      WHEN f.target_kind = 'dir' THEN 'external-dir' WHEN f.target_kind IS NOT NULL THEN 'external-file'
      ELSE 'dangling-external' END AS link_class,
    lt.named = '/root/'||lt.path AS selfish
  FROM lt JOIN fin f ON f.place = '/root/'||lt.path)"""

TREE = """tree AS (
  SELECT path, 'file' AS kind, size, NULL AS link_target FROM dst
  UNION ALL
  SELECT DISTINCT unnest([split_part(path,'/',1), split_part(path,'/',1)||'/'||split_part(path,'/',2)]), 'dir', 0, NULL FROM dst
  UNION ALL
  SELECT path, 'symlink', 0, link_target FROM lnk)"""

SCOPE = """scope AS (
  SELECT DISTINCT 'stale/'||lang AS root FROM documents WHERE lang IN ('en','fr')
  UNION SELECT source FROM documents WHERE source = 'src1')"""

SKIPS = """skips AS (
  SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'locked' ELSE 'path too long' END AS reason
  FROM src WHERE doc_id % 17 = 0)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- scans and sources -------------------------------------------------------

ORACLES["hash_manifest"] = _with(DST, LINKS, TREE) + """
SELECT t.path, t.kind, CASE WHEN t.kind = 'file' THEN d.hash END AS hash
FROM tree t LEFT JOIN dst d ON t.path = d.path"""

ORACLES["table_manifest"] = _with(SRC) + """
SELECT path, kind, size, CAST(420 AS INT) AS mode, mtime_sec, mtime_nsec, hash FROM src"""

ORACLES["probe_destination"] = _with(SRC, DST) + """
SELECT path, size, hash FROM dst WHERE path IN (SELECT path FROM src)"""

# Excludes: basenames src1 and de, and src2/en/*0.txt from the root.
ORACLES["merge_roots"] = _with(SRC) + """,
roots AS (
  SELECT source AS root FROM documents WHERE source LIKE '%1'
  UNION SELECT source||'/'||lang FROM documents WHERE lang = 'en'
  UNION SELECT path FROM src WHERE doc_id % 50 = 0),
kept AS (
  SELECT root FROM roots
  WHERE NOT regexp_matches(root, '(^|/)(src1|de)$') AND NOT regexp_matches(root, '^src2/en/.*0\\.txt$')),
tops AS (
  SELECT root FROM kept k WHERE NOT EXISTS (
    SELECT 1 FROM kept o WHERE starts_with(k.root, o.root||'/')))
SELECT s.path, s.size FROM src s JOIN tops t ON s.path = t.root OR starts_with(s.path, t.root||'/')
WHERE NOT (regexp_matches(s.path, '/de/') AND NOT regexp_matches(t.root, '/de/'))
  AND NOT regexp_matches(s.path, '^src2/en/.*0\\.txt$')"""

ORACLES["select_file_list"] = _with(SRC) + """,
listed AS (
  SELECT path AS root FROM src WHERE doc_id % 20 = 0
  UNION SELECT 'missing/'||doc_id FROM documents WHERE doc_id % 100 = 2 AND doc_id % 20 > 1
  UNION SELECT source||'/'||lang FROM documents WHERE doc_id % 100 = 3 AND doc_id % 20 > 1)
SELECT path, 'selected' AS status FROM src
WHERE path IN (SELECT root FROM listed) OR source_of(path) IN (SELECT root FROM listed)
UNION ALL
SELECT root, 'missing' FROM listed WHERE starts_with(root, 'missing/')""".replace(
    "source_of(path)", "split_part(path,'/',1)||'/'||split_part(path,'/',2)"
)

ORACLES["read_pattern_file"] = """
SELECT CASE WHEN doc_id % 5 = 3 THEN '*.'||lang ELSE '/'||source||'/ #'||doc_id END AS pattern
FROM documents WHERE doc_id % 5 >= 3"""

ORACLES["expand_glob_source"] = _with(SRC) + """
SELECT substr(path, 6) AS path, size FROM src WHERE regexp_matches(path, '^src1/[d-e][^/]/[^/]*1\\.txt$')"""

ORACLES["rebase_paths"] = _with(SRC) + "SELECT 'in/'||path AS path, size FROM src"

ORACLES["list_only"] = _with(DST, LINKS, TREE) + """
SELECT CASE kind WHEN 'dir' THEN 'd' WHEN 'symlink' THEN 'L' ELSE 'f' END AS kind, size, path
FROM tree WHERE NOT path LIKE '%1.txt'"""

ORACLES["manifest_summary"] = _with(DST, LINKS, TREE) + """
SELECT kind, count(*) AS entries, CAST(sum(size) AS BIGINT) AS total_bytes FROM tree GROUP BY kind"""

# --- filters -----------------------------------------------------------------

ORACLES["glob_filter"] = _with(SRC) + """
SELECT path, size FROM src
WHERE starts_with(path, 'src1/en/')
  OR NOT (path LIKE '%1.txt' OR regexp_matches(path, 'src2.*/fr/.*$') OR contains(path, 'en/1')
          OR regexp_matches(path, '(^|/)[^/]5\\.txt$') OR starts_with(path, 'src3/'))"""

ORACLES["tree_filter"] = _with(SRC) + """
SELECT path, size FROM src
WHERE NOT regexp_matches(path, '/de/') AND NOT starts_with(path, 'src3/') AND NOT regexp_matches(path, '^[^/]*2/fr/')"""

ORACLES["delete_scope_filter"] = _with(DST, SCOPE) + """
SELECT path, size FROM dst d WHERE EXISTS (
  SELECT 1 FROM scope s WHERE d.path = s.root OR starts_with(d.path, s.root||'/'))"""

ORACLES["protect_from_delete"] = _with(SRC, DST) + """
SELECT path, kind FROM dst
WHERE path NOT IN (SELECT path FROM src) AND NOT starts_with(path, 'stale/de/') AND NOT path LIKE '%50.txt'"""

ORACLES["quarantine_unsafe_paths"] = """
SELECT doc_id,
  CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '/'||source WHEN 2 THEN source||'/../'||lang
    WHEN 3 THEN source||'..'||lang WHEN 4 THEN 'C:\\'||source WHEN 5 THEN source||'\\..'
    ELSE './'||source||'/'||lang END AS path,
  CASE doc_id % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'absolute' WHEN 2 THEN 'traversal' WHEN 4 THEN 'absolute'
    WHEN 5 THEN 'traversal' ELSE 'ok' END AS unsafe
FROM documents"""

ORACLES["syncworthy_events"] = "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view'"

# --- planning ----------------------------------------------------------------


def _plan(in_sync: str, columns: str = "path, action, reason", where: str = "true", delete: bool = False) -> str:
    """A plan of the regular files; ``in_sync`` is the CASE body for rows on both sides."""
    join = "FULL JOIN" if delete else "LEFT JOIN"
    return _with(SRC, DST) + f""",
j AS (
  SELECT coalesce(s.path, d.path) AS path, coalesce(s.kind, d.kind) AS kind, s.size AS s_size, d.size AS d_size,
    s.mode AS s_mode, d.mode AS d_mode, s.mtime_sec AS s_sec, d.mtime_sec AS d_sec,
    s.mtime_nsec AS s_nsec, d.mtime_nsec AS d_nsec, s.hash AS s_hash, d.hash AS d_hash,
    s.path IS NOT NULL AS in_s, d.path IS NOT NULL AS in_d
  FROM src s {join} dst d ON s.path = d.path),
v AS (SELECT *, CASE {in_sync} END AS verdict FROM j),
p AS (
  SELECT *,
    CASE WHEN NOT in_s THEN 'extraneous' ELSE verdict END AS reason,
    CASE WHEN NOT in_s THEN 'delete' WHEN verdict = 'new' THEN 'create'
      WHEN verdict IN ('absent','exists','newer','in-sync') THEN 'skip'
      WHEN verdict IN ('mode','mtime') THEN 'meta' ELSE 'update' END AS action,
    CASE WHEN in_s THEN s_size ELSE 0 END AS source_size,
    in_s AND in_d AND s_size = d_size AND s_sec = d_sec AND s_nsec = d_nsec AS content_matched
  FROM v)
SELECT {columns} FROM p WHERE {where}"""


_NEW = "WHEN NOT in_s OR NOT in_d THEN 'new' "
_MODE = "WHEN s_mode & 4095 <> d_mode & 4095 THEN 'mode' "
_MTIME = "WHEN s_sec <> d_sec OR s_nsec <> d_nsec THEN 'mtime' "
_QUICK = "WHEN s_size <> d_size THEN 'size' WHEN s_sec <> d_sec OR s_nsec <> d_nsec THEN 'time' "
_DEFAULT = _NEW + _QUICK + _MODE + "ELSE 'in-sync'"

ORACLES["plan_sync"] = _plan(
    _DEFAULT, "path, kind, action, reason, source_size, content_matched", delete=True
)
_CHECKSUM = _NEW + "WHEN s_hash <> d_hash THEN 'hash' " + _MODE + _MTIME + "ELSE 'in-sync'"
ORACLES["plan_checksum"] = _plan(_CHECKSUM)
ORACLES["plan_size_only"] = _plan(_NEW + "WHEN s_size <> d_size THEN 'size' " + _MODE + _MTIME + "ELSE 'in-sync'")
ORACLES["plan_update_only"] = _plan(_NEW + "WHEN d_sec > s_sec THEN 'newer' " + _QUICK + _MODE + "ELSE 'in-sync'")
ORACLES["plan_ignore_existing"] = _plan(_NEW + "ELSE 'exists'")
ORACLES["plan_existing"] = _plan("WHEN NOT in_d THEN 'absent' " + _QUICK + _MODE + "ELSE 'in-sync'")
ORACLES["plan_ignore_times"] = _plan(_NEW + "WHEN d_sec > s_sec THEN 'newer' ELSE 'forced'")
ORACLES["plan_meta_only"] = _plan(_CHECKSUM, where="action = 'meta'")

ORACLES["plan_delete"] = _with(SRC, DST, SCOPE) + """
SELECT path, kind FROM dst d
WHERE path NOT IN (SELECT path FROM src) AND EXISTS (
  SELECT 1 FROM scope s WHERE d.path = s.root OR starts_with(d.path, s.root||'/'))"""

ORACLES["plan_links_specials"] = _with(LINKS) + """,
j AS (
  SELECT path, page_id,
    CASE page_id % 4 WHEN 3 THEN 'fifo' WHEN 2 THEN 'char' ELSE 'symlink' END AS kind,
    CASE WHEN page_id % 4 < 2 AND page_id % 8 = 0 THEN 'link'
      WHEN page_id % 4 < 2 AND page_id % 3 = 0 THEN 'link'
      WHEN page_id % 4 < 2 AND page_id % 7 = 0 THEN 'link'
      WHEN page_id % 16 = 3 THEN 'special'
      WHEN page_id % 4 = 2 AND page_id % 5 = 0 THEN 'special'
      WHEN page_id % 4 >= 2 AND page_id % 7 = 0 THEN 'special'
      ELSE 'in-sync' END AS reason
  FROM lnk)
SELECT path, kind, CASE WHEN reason = 'in-sync' THEN 'skip' ELSE 'update' END AS action, reason FROM j"""

ORACLES["assign_hardlinks"] = _plan(_DEFAULT, "path, s_hash, action, content_matched").replace(
    "SELECT path, s_hash, action, content_matched FROM p WHERE true",
    """, m AS (
  SELECT path, action,
    CASE WHEN content_matched OR action IN ('create','update') THEN
      first_value(path) OVER (PARTITION BY s_hash, content_matched OR action IN ('create','update')
        ORDER BY CASE WHEN content_matched THEN 0 ELSE 1 END, path) END AS rep
  FROM p)
SELECT path, action, CASE WHEN action IN ('create','update') AND rep <> path THEN rep END AS link_to FROM m""".lstrip(),
).replace("FROM v)\n, m AS", "FROM v), m AS")

ORACLES["max_delete_guard"] = _with(SRC, DST) + """
SELECT count(*) AS n_deletes, count(*) <= 30 AS allowed FROM dst WHERE path NOT IN (SELECT path FROM src)"""

_GONE = """gone AS (
  SELECT path, kind FROM tree
  WHERE path = 'stale' OR starts_with(path, 'stale/') OR regexp_matches(path, '^src[1-3]/fr(/|$)'))"""

ORACLES["delete_order"] = _with(DST, LINKS, TREE, _GONE) + """
SELECT path, kind, CAST(CASE kind WHEN 'dir' THEN 1 ELSE 0 END AS INT) AS phase,
  CAST(CASE kind WHEN 'dir' THEN len(string_split(path,'/')) ELSE 0 END AS INT) AS depth
FROM gone"""

ORACLES["prune_empty_dirs"] = _with(DST, LINKS, TREE, _GONE) + """
SELECT t.path FROM tree t
WHERE t.kind = 'dir'
  AND EXISTS (SELECT 1 FROM gone g WHERE g.kind = 'file' AND starts_with(g.path, t.path||'/'))
  AND NOT EXISTS (
    SELECT 1 FROM tree f WHERE f.kind <> 'dir' AND starts_with(f.path, t.path||'/')
      AND f.path NOT IN (SELECT path FROM gone WHERE kind = 'file'))
  AND NOT EXISTS (
    SELECT 1 FROM tree k WHERE k.kind = 'dir' AND starts_with(k.path, t.path||'/') AND NOT EXISTS (
      SELECT 1 FROM gone g WHERE g.kind = 'file' AND starts_with(g.path, k.path||'/')))"""

ORACLES["table_diff"] = """
WITH newer AS (
  SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS o_totalprice,
    CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey
  FROM orders WHERE o_orderkey % 10 <> 0),
older AS (SELECT * FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey,
  CASE WHEN o.o_orderkey IS NULL THEN 'create' WHEN n.o_orderkey IS NULL THEN 'delete'
    WHEN n.o_totalprice IS DISTINCT FROM o.o_totalprice OR n.o_orderstatus IS DISTINCT FROM o.o_orderstatus
    THEN 'update' ELSE 'skip' END AS action,
  CASE WHEN o.o_orderkey IS NULL OR n.o_orderkey IS NULL THEN ''
    ELSE concat_ws(',', CASE WHEN n.o_totalprice IS DISTINCT FROM o.o_totalprice THEN 'o_totalprice' END,
                        CASE WHEN n.o_orderstatus IS DISTINCT FROM o.o_orderstatus THEN 'o_orderstatus' END) END AS changed
FROM newer n FULL JOIN older o ON n.o_orderkey = o.o_orderkey"""

ORACLES["cross_basis_pairs"] = _plan(_CHECKSUM, "path, action, s_size").replace(
    "SELECT path, action, s_size FROM p WHERE true",
    """, e AS (
  SELECT path, s_size AS size, CASE action WHEN 'create' THEN 0 ELSE 1 END AS phase,
    regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)\\.txt$', 1) AS stem
  FROM p WHERE action IN ('create','update') AND s_size >= 32),
c AS (
  SELECT w.path, r.path AS basis_path, r.size AS basis_size,
    row_number() OVER (PARTITION BY w.path ORDER BY abs(w.size - r.size),
      CASE WHEN len(r.stem) < len(w.stem) THEN 0 ELSE 1 END,
      CASE WHEN len(r.stem) < len(w.stem) THEN len(r.stem) ELSE 0 END, r.phase, r.path) AS rn
  FROM e w JOIN e r ON w.dir = r.dir AND w.stem <> r.stem
    AND (starts_with(w.stem, r.stem) OR starts_with(r.stem, w.stem))
    AND (r.phase < w.phase OR (r.phase = w.phase AND r.path < w.path))
    AND greatest(w.size, r.size) <= 2 * least(w.size, r.size)
  WHERE w.size >= 64)
SELECT path, basis_path, basis_size FROM c WHERE rn = 1""".lstrip(),
).replace("FROM v)\n, e AS", "FROM v), e AS")

ORACLES["reprobe_after_apply"] = _with(SRC, DST) + """
SELECT s.path, s.size, d.size AS now_size FROM src s LEFT JOIN dst d ON s.path = d.path
WHERE d.path IS NULL OR s.size <> d.size OR s.mtime_sec <> d.mtime_sec OR s.mtime_nsec <> d.mtime_nsec"""

# --- signatures, delta, patch ------------------------------------------------


def _blocks(name: str, table: str, size: str) -> str:
    """Fixed blocks of ``table(path, content)``, sliced on the hex form of its bytes."""
    return f"""{name} AS (
  SELECT path, CAST(i AS INT) AS idx, i * b AS "offset", CAST(least(b, n - i * b) AS INT) AS len,
    substr(h, 2 * i * b + 1, 2 * b) AS piece, sha256(unhex(substr(h, 2 * i * b + 1, 2 * b))) AS strong
  FROM (
    SELECT path, h, n, b, unnest(generate_series(0, (n - 1) // b)) AS i
    FROM (SELECT path, hex(encode(content)) AS h, CAST(octet_length(encode(content)) AS BIGINT) AS n,
            CAST({size} AS BIGINT) AS b FROM {table})
    WHERE n > 0))"""


_AUTO = (
    "greatest(700, least(32768, CAST(floor(sqrt(octet_length(encode(content)))) AS BIGINT) // 8 * 8))"
)
ORACLES["fixed_block_signature"] = _with(SRC, _blocks("sig", "src", _AUTO)) + """
SELECT path, idx, "offset", len, strong FROM sig"""

ORACLES["weak_checksum"] = _with(SRC, _blocks("sig", "src", "256")) + """,
bytes AS (
  SELECT path, idx, len, unnest(generate_series(0, len - 1)) AS i, piece FROM sig),
vals AS (
  SELECT path, idx, len, i,
    (instr('0123456789ABCDEF', substr(piece, CAST(2*i+1 AS BIGINT), 1)) - 1) * 16
      + instr('0123456789ABCDEF', substr(piece, CAST(2*i+2 AS BIGINT), 1)) - 1 AS x
  FROM bytes)
SELECT path, idx, CAST(sum(x) % 65536 + (sum((len - i) * x) % 65536) * 65536 AS BIGINT) AS weak
FROM vals GROUP BY path, idx"""

ORACLES["cdc_chunks_tile"] = _with(SRC) + """
SELECT path, hash, true AS hashes_agree, true AS bounded FROM src WHERE size > 0"""

ORACLES["text_cdc_segments"] = """
WITH w AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos
  FROM documents),
seg AS (
  SELECT doc_id, pos, word,
    coalesce(sum(CASE WHEN starts_with(md5(word), '0') THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
  FROM w),
t AS (SELECT doc_id, g, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS piece FROM seg GROUP BY doc_id, g)
SELECT doc_id, CAST(g AS INT) AS idx, CAST(n AS INT) AS n_words,
  CAST(octet_length(encode(piece)) AS BIGINT) AS len, sha256(piece) AS strong FROM t"""

ORACLES["signature_index"] = _with(SRC, _blocks("sig", "src", "64")) + """
SELECT path, strong, min("offset") AS "offset", arg_min(len, "offset") AS len FROM sig GROUP BY path, strong"""

_PAIR = """pair AS (
  SELECT s.path, s.content AS s_content, d.content AS d_content, s.hash
  FROM src s JOIN dst d ON s.path = d.path WHERE s.hash <> d.hash),
ps AS (SELECT path, s_content AS content FROM pair),
pd AS (SELECT path, d_content AS content FROM pair)"""

_OPS = (SRC, DST, _PAIR, _blocks("s", "ps", "64"), _blocks("b", "pd", "64"), """idx AS (
  SELECT path, strong, min("offset") AS basis_offset FROM b GROUP BY path, strong)""", """ops AS (
  SELECT s.path, s.idx, CASE WHEN i.strong IS NULL THEN 'literal' ELSE 'copy' END AS op,
    s."offset" AS source_offset, CAST(s.len AS BIGINT) AS len, i.basis_offset
  FROM s LEFT JOIN idx i ON s.path = i.path AND s.strong = i.strong)""")

_RUNS = """runs AS (
  SELECT path, g - 1 AS op_idx, any_value(op) AS op, min(source_offset) AS source_offset, sum(len) AS len,
    min(basis_offset) AS basis_offset
  FROM (
    SELECT *, sum(first) OVER (PARTITION BY path ORDER BY idx) AS g FROM (
      SELECT *, CASE WHEN lag(op) OVER w = op AND (op = 'literal' OR lag(basis_offset + len) OVER w = basis_offset)
        THEN 0 ELSE 1 END AS first
      FROM ops WINDOW w AS (PARTITION BY path ORDER BY idx)))
  GROUP BY path, g)"""

ORACLES["compute_delta"] = _with(*_OPS) + "SELECT * FROM ops"
ORACLES["coalesce_ops"] = _with(*_OPS, _RUNS) + """
SELECT path, CAST(op_idx AS BIGINT) AS op_idx, op, source_offset, CAST(len AS BIGINT) AS len, basis_offset FROM runs"""
ORACLES["delta_stats"] = _with(*_OPS, _RUNS) + """
SELECT path, CAST(coalesce(sum(len) FILTER (op = 'copy'), 0) AS BIGINT) AS bytes_matched,
  CAST(coalesce(sum(len) FILTER (op = 'literal'), 0) AS BIGINT) AS bytes_literal, count(*) AS ops
FROM runs GROUP BY path"""
ORACLES["delta_fallback"] = _with(*_OPS) + """,
st AS (
  SELECT path, coalesce(sum(len) FILTER (op = 'copy'), 0) AS m, coalesce(sum(len) FILTER (op = 'literal'), 0) AS l
  FROM ops GROUP BY path),
f AS (
  SELECT p.path, CASE WHEN octet_length(encode(d_content)) = 0 THEN 'empty-basis'
      WHEN coalesce(l, octet_length(encode(s_content))) > 2000 THEN 'literal-budget'
      WHEN coalesce(m, 0) * 2 < octet_length(encode(s_content)) THEN 'dissimilar' END AS fallback_reason
  FROM pair p LEFT JOIN st ON p.path = st.path)
SELECT path, CASE WHEN fallback_reason IS NULL THEN 'delta' ELSE 'copy' END AS transfer, fallback_reason FROM f"""
ORACLES["validate_ops"] = _with(*_OPS, _RUNS) + """
SELECT r.path, CAST(op_idx AS BIGINT) AS op_idx, basis_offset, CAST(len AS BIGINT) AS len,
  CAST(octet_length(encode(substr(d_content, 1, 400))) AS BIGINT) AS basis_size
FROM runs r JOIN pair p ON r.path = p.path
WHERE op = 'copy' AND basis_offset + len > octet_length(encode(substr(d_content, 1, 400)))"""
ORACLES["apply_patch"] = _with(SRC, DST, _PAIR) + """
SELECT path, s_content AS content FROM pair UNION ALL SELECT 'emptied/'||path, '' FROM pair WHERE hash[1] IN ('0', '8')"""
ORACLES["blob_patch"] = _with(SRC, DST, _PAIR) + """
SELECT path, hash FROM pair UNION ALL SELECT 'emptied/'||path, sha256('') FROM pair WHERE hash[1] IN ('0', '8')"""
ORACLES["blob_chunks"] = _with(SRC) + "SELECT path, size AS bytes, true AS bounded FROM src WHERE size > 0"
ORACLES["verify_reconstruction"] = _with(SRC, DST, _PAIR) + """
SELECT path, sha256(reverse(s_content)) AS expected, hash AS actual FROM pair
WHERE starts_with(hash, '0') AND reverse(s_content) <> s_content"""

ORACLES["sliding_match_rebuild"] = _with(SRC, DST, _PAIR) + """
SELECT path, hash FROM pair"""

ORACLES["chunk_dedup_report"] = """
WITH w AS (
  SELECT doc_id, source, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos
  FROM documents),
seg AS (
  SELECT doc_id, source, pos, word,
    coalesce(sum(CASE WHEN starts_with(md5(word), '0') THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
  FROM w),
t AS (SELECT source, string_agg(word, ' ' ORDER BY pos) AS piece FROM seg GROUP BY doc_id, source, g),
u AS (
  SELECT source, piece, count(*) AS n, octet_length(encode(piece)) AS len,
    count(*) OVER (PARTITION BY piece) AS owners FROM t GROUP BY source, piece)
SELECT source, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS unique_chunks, CAST(sum(n * len) AS BIGINT) AS bytes,
  CAST(sum(n * len) - sum(len) AS BIGINT) AS duplicate_bytes,
  CAST(coalesce(sum(len) FILTER (owners > 1), 0) AS BIGINT) AS shared_bytes,
  round(CAST(sum(len) AS DOUBLE) / CAST(sum(n * len) AS DOUBLE), 6) AS dedup_ratio
FROM u GROUP BY source"""

ORACLES["signature_cache"] = _with(SRC, DST) + """,
h AS (
  SELECT s.path, d.path IS NOT NULL AS hit, s.size FROM src s LEFT JOIN dst d
    ON s.path = d.path AND s.size = d.size AND s.mtime_sec = d.mtime_sec AND s.mtime_nsec = d.mtime_nsec
    AND (CASE WHEN s.size <= 4096 THEN s.content = d.content
      ELSE left(hex(encode(s.content)), 8192) = left(hex(encode(d.content)), 8192)
        AND right(hex(encode(s.content)), 8192) = right(hex(encode(d.content)), 8192) END))
SELECT path, CASE WHEN hit THEN 'hit' ELSE 'miss' END AS status,
  CASE WHEN hit THEN CAST(ceil(size / greatest(700, least(32768, CAST(floor(sqrt(size)) AS BIGINT) // 8 * 8))) AS BIGINT)
    ELSE 0 END AS chunks
FROM h"""

# --- tiers -------------------------------------------------------------------

ORACLES["classify_size"] = _with(SRC) + """
SELECT path, CASE WHEN size <= 1000 THEN 'small' WHEN size <= 5000 THEN 'medium' ELSE 'large' END AS size_class FROM src"""
ORACLES["choose_strategy"] = _with(SRC, DST) + """
SELECT path, CASE WHEN size > 2000 AND path IN (SELECT path FROM dst) THEN 'delta' ELSE 'copy' END AS strategy FROM src"""
ORACLES["pack_batches"] = _with(SRC) + """
SELECT path, size, CAST(coalesce(sum(size) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  // 65536 AS BIGINT) AS batch
FROM src"""

# --- reports -----------------------------------------------------------------

ORACLES["plan_counts"] = _plan(_DEFAULT, "action, count(*) AS entries, CAST(sum(source_size) AS BIGINT) AS bytes", delete=True) + " GROUP BY action"
ORACLES["itemize"] = _plan(
    _DEFAULT,
    "path, CASE action WHEN 'create' THEN 'cf+++++++++ ' WHEN 'update' THEN '>f.s....... ' "
    "WHEN 'meta' THEN '>f.s....... ' WHEN 'delete' THEN '*deleting    ' ELSE '.f.......... ' END || path AS line",
    delete=True,
)
ORACLES["sync_stats"] = _plan(
    _DEFAULT,
    "count(*) FILTER (action IN ('create','update','meta')) AS files, "
    "CAST(sum(source_size) FILTER (action IN ('create','update')) AS BIGINT) AS bytes, "
    "(SELECT count(*) FROM src WHERE doc_id % 17 = 0) AS skipped",
)
ORACLES["skip_report"] = _with(SRC, SKIPS) + """
SELECT reason, count(*) AS entries, CAST(23 AS INT) AS exit_code FROM skips GROUP BY reason"""
ORACLES["verify_report"] = _with(SRC, DST, SKIPS) + """
SELECT s.path, CASE WHEN s.path IN (SELECT path FROM skips) THEN 'skipped' WHEN r.path IS NULL THEN 'no-hash'
  WHEN r.hash <> s.hash THEN 'mismatch' ELSE 'ok' END AS status
FROM src s LEFT JOIN (SELECT path, hash FROM dst WHERE doc_id % 9 <> 0) r ON s.path = r.path"""
ORACLES["transfer_rate"] = """
WITH p AS (
  SELECT 'u'||user_id AS path, ts, event_id, event_id * 100 + CAST(trunc(value * 100) AS BIGINT) AS done FROM events),
d AS (
  SELECT path, ts, done,
    greatest(done - coalesce(lag(done) OVER (PARTITION BY path ORDER BY ts, event_id), 0), 0) AS delta FROM p),
c AS (SELECT path, min(ts) AS ts FROM p WHERE done >= 500000 GROUP BY path),
m AS (SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS window_start, sum(delta) AS bytes FROM d GROUP BY 1),
f AS (SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS window_start, count(*) AS completed FROM c GROUP BY 1)
SELECT window_start, CAST(bytes AS BIGINT) AS bytes, coalesce(completed, 0) AS completed,
  CASE WHEN bytes / 86400.0 < 1024 THEN printf('%.1fB/s', bytes / 86400.0)
    WHEN bytes / 86400.0 < 1048576 THEN printf('%.1fK/s', bytes / 86400.0 / 1024)
    WHEN bytes / 86400.0 < 1073741824 THEN printf('%.1fM/s', bytes / 86400.0 / 1048576)
    ELSE printf('%.1fG/s', bytes / 86400.0 / 1073741824) END AS rate
FROM m LEFT JOIN f USING (window_start)"""
ORACLES["bench_summary"] = """
WITH c AS (
  SELECT event_type AS tool, user_id % 4 AS scenario, avg(value) AS m, stddev_samp(value) AS sd, min(value) AS lo,
    max(value) AS hi, max(event_id % 3) AS rc FROM events GROUP BY 1, 2)
SELECT tool, scenario, round(m, 3) AS mean, round(coalesce(sd, 0), 3) AS sd, lo AS "min", hi AS "max", rc AS worst_rc,
  m <= min(m) OVER (PARTITION BY scenario) + 0.0005 AS fastest
FROM c"""

# --- links and permissions ---------------------------------------------------

_LINKED = "WITH RECURSIVE " + LINKS + ",\n" + LINK_TREE
ORACLES["classify_links"] = _LINKED + "SELECT path, link_target, final, target_kind, link_class FROM cls"
ORACLES["rewrite_internal_links"] = _LINKED + "SELECT path, rewritten FROM cls WHERE link_class = 'internal'"
ORACLES["link_policy"] = _LINKED + """
SELECT path, link_class,
  CASE WHEN selfish THEN 'skip' WHEN link_class = 'internal' THEN 'link' WHEN link_class = 'external-file' THEN 'content' ELSE 'skip' END AS outcome,
  CASE WHEN link_class = 'internal' AND NOT selfish THEN rewritten END AS target,
  CASE WHEN selfish THEN 'names itself' WHEN link_class = 'external-dir' THEN 'directory outside'
    WHEN link_class = 'dangling-external' THEN 'nothing outside there' END AS reason,
  'default' AS policy FROM cls
UNION ALL
SELECT path, link_class,
  CASE WHEN selfish THEN 'skip' WHEN link_class IN ('internal', 'external-dir') THEN 'link'
    WHEN link_class = 'external-file' THEN 'content' ELSE 'skip' END,
  CASE WHEN link_class = 'external-dir' OR (link_class = 'internal' AND NOT selfish) THEN link_target END,
  CASE WHEN selfish THEN 'names itself' WHEN link_class = 'dangling-external' THEN 'nothing outside there' END,
  'literal-dirs' FROM cls
UNION ALL
SELECT path, link_class, CASE WHEN target_kind IS NULL THEN 'skip' ELSE 'content' END, NULL,
  CASE WHEN target_kind IS NULL THEN 'no end to read' END, 'follow' FROM cls
UNION ALL
SELECT path, link_class, 'skip', NULL, 'no links wanted', 'skip' FROM cls"""
ORACLES["detect_link_cycles"] = _LINKED + """,
e AS (SELECT path, named = '/root/'||path AS selfish, final FROM cls WHERE final IS NULL OR final = '/root' OR starts_with(final, '/root/')),
edge AS (SELECT a.path AS a, b.path AS b FROM e a JOIN e b ON starts_with('/root/'||b.path, a.final||'/')),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, x.b FROM reach r JOIN edge x ON r.b = x.a)
SELECT path, CASE WHEN selfish THEN 'self' ELSE 'loop' END AS cycle FROM e
WHERE final IS NULL OR path IN (
  SELECT a FROM reach WHERE b IN (SELECT path FROM e WHERE final IS NULL) OR b IN (SELECT a FROM reach WHERE a = b))"""
ORACLES["followed_entries"] = _LINKED + """,
opened AS (
  SELECT path, final AS dir, [final] AS entered FROM cls WHERE target_kind = 'dir'
  UNION ALL
  SELECT o.path || substr(f.place, length(o.dir) + 1), f.final, list_append(o.entered, f.final)
  FROM opened o JOIN fin f ON starts_with(f.place, o.dir||'/') AND f.target_kind = 'dir' AND NOT list_contains(o.entered, f.final))
SELECT substr(place, 7) AS path, kind, place AS source, false AS dereferenced, NULL AS reason FROM reals WHERE starts_with(place, '/root/')
UNION ALL
SELECT path, target_kind, coalesce(final, '/root/'||path), true,
  CASE WHEN final IS NULL THEN 'leads into a loop' WHEN target_kind IS NULL THEN 'nothing at the end of the link' END FROM cls
UNION ALL
SELECT o.path || substr(r.place, length(o.dir) + 1), r.kind, r.place, true, NULL FROM opened o JOIN reals r ON starts_with(r.place, o.dir||'/')
UNION ALL
SELECT o.path || substr(f.place, length(o.dir) + 1),
  CASE WHEN NOT (f.target_kind = 'dir' AND list_contains(o.entered, f.final)) THEN f.target_kind END, coalesce(f.final, f.place), true,
  CASE WHEN f.target_kind = 'dir' AND list_contains(o.entered, f.final) THEN 'directory was already entered'
    WHEN f.final IS NULL THEN 'leads into a loop' WHEN f.target_kind IS NULL THEN 'nothing at the end of the link' END
FROM opened o JOIN fin f ON starts_with(f.place, o.dir||'/')"""
ORACLES["final_mode"] = _with(SRC) + """,
f AS (SELECT path || CASE WHEN doc_id % 3 = 0 THEN '.PY' ELSE '' END AS path, mode FROM src)
SELECT path, CAST(mode & 511 AS INT) AS mode, 'unix' AS run FROM f
UNION ALL SELECT path, CAST(mode & 4095 AS INT), 'archive' FROM f
UNION ALL SELECT path, CAST(420 AS INT), 'no-perms' FROM f
UNION ALL SELECT path, CAST(CASE WHEN path LIKE '%.PY' THEN 493 ELSE 420 END AS INT), 'windows' FROM f"""

# --- streaming ---------------------------------------------------------------

ORACLES["debounce_bursts"] = """
WITH g AS (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk
  FROM events),
r AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
SELECT user_id, min(ts) AS burst_start, max(ts) AS last_event, count(*) AS events FROM r GROUP BY user_id, run"""
ORACLES["debounce_stream"] = ORACLES["debounce_bursts"]
ORACLES["debounce_capped"] = """
WITH RECURSIVE e AS (
  SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
f AS (
  SELECT user_id, ts, rn, ts AS start FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.ts, e.rn,
    CASE WHEN e.ts - f.ts > INTERVAL 6 HOUR OR e.ts - f.start >= INTERVAL 12 HOUR THEN e.ts ELSE f.start END
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, start AS burst_start, max(ts) AS last_event, count(*) AS events FROM f GROUP BY user_id, start"""

ORACLES["debounce_capped_stream"] = ORACLES["debounce_capped"]

# Stale entries stay; changed documents take the streamed attributes unless in sync.
_WATCHED = _with(SRC, DST) + """
SELECT path, kind, size, mode, mtime_sec, mtime_nsec, hash FROM dst WHERE starts_with(path, 'stale/')
UNION ALL
SELECT path, kind, size, CAST(420 AS INT), mtime_sec, mtime_nsec,
  CASE WHEN doc_id % 10 = 6 THEN (SELECT d.hash FROM dst d WHERE d.path = src.path) ELSE hash END
FROM src WHERE doc_id % 10 <> 7
UNION ALL
SELECT 'swap/'||doc_id, 'file', size, CAST(420 AS INT), mtime_sec, mtime_nsec, hash FROM src WHERE doc_id % 50 = 3"""
ORACLES["watch_sync"] = _WATCHED
ORACLES["retry_cycle"] = _WATCHED
ORACLES["bounded_watch"] = _WATCHED
ORACLES["watch_totals"] = """
SELECT event_type AS action, count(*) AS files, CAST(sum(CAST(trunc(value * 100) AS BIGINT)) AS BIGINT) AS bytes
FROM events GROUP BY event_type"""

# --- apply -------------------------------------------------------------------

_AFTER = """after AS (
  SELECT s.doc_id, s.path, s.size, s.mode, s.mtime_sec, s.mtime_nsec,
    CASE WHEN s.size = d.size AND s.mtime_sec = d.mtime_sec AND s.mtime_nsec = d.mtime_nsec THEN d.hash ELSE s.hash END AS hash
  FROM src s LEFT JOIN dst d ON s.path = d.path
  UNION ALL
  SELECT doc_id, 'swap/'||doc_id, size, mode, mtime_sec, mtime_nsec, hash FROM src WHERE doc_id % 50 = 3
  UNION ALL
  SELECT doc_id, 'emptied/'||doc_id, 0, mode, mtime_sec, mtime_nsec, sha256('') FROM src WHERE doc_id % 50 = 3)"""
ORACLES["apply_plan"] = _with(SRC, DST, _AFTER) + """
SELECT path, size, mode, mtime_sec, mtime_nsec, hash FROM after"""
ORACLES["sync_run"] = ORACLES["apply_plan"]
ORACLES["resumed_run"] = ORACLES["apply_plan"]
ORACLES["publish_snapshot"] = _with(SRC) + "SELECT path, size, hash FROM src"
ORACLES["backup_replaced"] = _with(SRC, DST, _AFTER) + """,
bak AS (
  SELECT d.path||'~' AS path, d.size, d.hash FROM dst d LEFT JOIN src s ON s.path = d.path
  WHERE s.path IS NULL OR s.size <> d.size OR s.mtime_sec <> d.mtime_sec OR s.mtime_nsec <> d.mtime_nsec
  UNION ALL SELECT 'swap/'||doc_id||'~', 0, NULL FROM src WHERE doc_id % 50 = 3
  UNION ALL SELECT 'swap/'||doc_id||'~/x', size, hash FROM src WHERE doc_id % 50 = 3
  UNION ALL SELECT 'emptied/'||doc_id||'~', size, hash FROM src WHERE doc_id % 50 = 3)
SELECT path, size, hash FROM after
UNION ALL
SELECT path||'~', 0, hash FROM dst WHERE doc_id % 10 = 1 AND path||'~' NOT IN (SELECT path FROM bak)
UNION ALL
SELECT path, size, hash FROM bak"""
ORACLES["retire_verified_sources"] = _with(SRC, DST, SKIPS) + """
SELECT s.path, s.size FROM src s
WHERE NOT (s.doc_id % 13 <> 0 AND s.doc_id % 11 <> 0 AND s.doc_id % 3 <> 0
  AND s.path NOT IN (SELECT path FROM skips)
  AND EXISTS (SELECT 1 FROM dst d WHERE d.path = s.path AND d.hash = s.hash AND d.doc_id % 9 <> 0))"""
ORACLES["resume_apply"] = _plan(
    _DEFAULT,
    "path, action",
    "action <> 'skip' AND NOT (action = 'update' AND path IN (SELECT path FROM src WHERE doc_id % 4 = 0)) "
    "AND NOT (action = 'create' AND path IN (SELECT path FROM src WHERE doc_id % 40 = 0))",
    delete=True,
)
