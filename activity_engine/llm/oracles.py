"""SQL for the corpus queries that SQL can express, each by direct comparison."""

from __future__ import annotations

from .common import LOWER, UPPER
from .url_filters import DAMPING, LINK, PERCENT, ROUNDS, RULES, UNIT

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def _shingles(name: str, source: str, key: str, k: str) -> str:
    """Distinct runs of k words of each text; of all words where there are fewer."""
    return f"""{name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i + {k} - 1], ' ') AS g, len(w) AS n_words FROM (
  SELECT {key}, {_WORDS.format(_LOW)} AS w FROM {source}) t, LATERAL (SELECT unnest(range(1, greatest(len(w) - {k} + 2, 2))) AS i) r WHERE len(w) > 0)"""


OP1 = f"""WITH RECURSIVE {_shingles("s", "documents", "doc_id", "2")},
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
 edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
 reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.y, reach.r FROM reach JOIN edges e ON e.x = reach.doc_id WHERE reach.r < e.y)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
 JOIN (SELECT doc_id, min(r) AS root FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id"""

OP3 = f"""WITH {_shingles("d", "documents", "doc_id", "5")}, {_shingles("i", "benchmark", "item_id", "5")},
 q AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
 SELECT d.doc_id, i.item_id, q.n AS n_shingles, count(*) AS n_shared FROM d JOIN i ON d.g = i.g JOIN q ON q.item_id = i.item_id
 GROUP BY d.doc_id, i.item_id, q.n HAVING 100 * count(*) >= 80 * q.n"""

OP5 = f"""WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
 p AS (SELECT doc_id, w[i] AS word, i, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END AS g FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) r),
 f AS (SELECT g, min(doc_id) AS first FROM p WHERE g IS NOT NULL GROUP BY g),
 c AS (SELECT p.*, CASE WHEN f.first < p.doc_id THEN 1 ELSE 0 END AS copy FROM p LEFT JOIN f USING (g)),
 x AS (SELECT *, max(copy) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM c),
 k AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM x GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)"""

OP7 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
 SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(p.h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM p JOIN m USING (h)"""

OP8 = r"""WITH RECURSIVE l AS (SELECT doc_id, i, s[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) t, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) r),
 solid AS (SELECT *, md5(line) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
 gone AS (SELECT doc_id, i, CASE WHEN row_number() OVER (PARTITION BY line ORDER BY doc_id, k) > 1 THEN 1 ELSE 0 END AS gone FROM solid),
 runs AS (SELECT doc_id, k, 1 AS d, m AS h, count(*) OVER (PARTITION BY m) AS n FROM solid UNION ALL
  SELECT r.doc_id, r.k, r.d + 1, md5(r.h || s.m), count(*) OVER (PARTITION BY md5(r.h || s.m)) FROM runs r JOIN solid s ON s.doc_id = r.doc_id AND s.k = r.k + r.d WHERE r.n > 1),
 longest AS (SELECT doc_id, max(d) AS d FROM runs WHERE n > 1 GROUP BY doc_id)
 SELECT l.doc_id, count(g.i) AS n_lines, CAST(coalesce(sum(g.gone), 0) AS BIGINT) AS n_removed, CAST(coalesce(max(x.d), 0) AS BIGINT) AS longest_run,
 sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE coalesce(g.gone, 0) = 0), '')) AS kept_sha256
 FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i LEFT JOIN longest x ON x.doc_id = l.doc_id GROUP BY l.doc_id"""

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _crc32(text: str) -> str:
    """The checksum of a short text, bit by bit."""
    byte = f"xor(c, CAST(unicode(substr({text}, CAST(j AS INT), 1)) AS BIGINT))"
    step = "list_reduce(list_prepend({0}, range(1, 9)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, range(1, length({text}) + 1)), lambda c, j: {step.format(byte)}))"


OP11 = f"""WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS t FROM documents),
 e AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {_crc32("t")} % 3 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf("text")} END AS now FROM d),
 l AS (SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS n FROM e),
 up AS (SELECT 0 AS level, tree, n, pos, leaf AS h FROM l UNION ALL
  SELECT level + 1, tree, (n + 7) // 8, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, tree, n, pos // 8),
 sub AS (SELECT tree, h FROM up WHERE n = 1),
 over AS (SELECT 0 AS level, (SELECT count(*) FROM sub) AS n, tree AS pos, h FROM sub UNION ALL
  SELECT level + 1, (n + 7) // 8, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY level, n, pos // 8),
 nodes AS (SELECT tree, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY ALL UNION ALL SELECT -1, level, pos // 8, list(h ORDER BY pos) FROM over WHERE n > 1 GROUP BY ALL),
 climb AS (SELECT tree AS home, pos AS home_pos, doc_id, leaf, tree, 0 AS level, n, pos, now AS folded, '' AS proof FROM l UNION ALL
  SELECT c.home, c.home_pos, c.doc_id, c.leaf, CASE WHEN c.n > 1 THEN c.tree ELSE -1 END, CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END,
   CASE WHEN c.n > 1 THEN (c.n + 7) // 8 ELSE (SELECT count(*) FROM sub) END, CASE WHEN c.n > 1 THEN c.pos // 8 ELSE c.tree END,
   CASE WHEN c.n > 1 THEN sha256(array_to_string(x.hs[1:c.pos % 8], '') || c.folded || array_to_string(x.hs[c.pos % 8 + 2:], '')) ELSE c.folded END,
   CASE WHEN c.n > 1 THEN c.proof || array_to_string(x.hs[1:c.pos % 8], '') || array_to_string(x.hs[c.pos % 8 + 2:], '') ELSE c.proof END
  FROM climb c LEFT JOIN nodes x ON x.tree = c.tree AND x.level = c.level AND x.run = c.pos // 8 WHERE c.n > 1 OR c.tree >= 0)
 SELECT c.doc_id, c.leaf, s.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.h AS verified
 FROM climb c JOIN sub s ON s.tree = c.home, (SELECT h FROM over WHERE n = 1) r WHERE c.tree = -1 AND c.n = 1"""

_REST = "regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1)"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_REFS = "list_distinct(list_transform(regexp_extract_all(html, '{}', 1), lambda x: translate(x, '{}', '{}')))".format(LINK.replace("'", "''"), UPPER, LOWER)

OP12 = f"""WITH RECURSIVE p AS (SELECT page_id, html, translate(regexp_extract({_REST}, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
 r(verdict, host, path) AS (VALUES {_RULES}),
 f AS (SELECT p.page_id, max({{'n': length(r.host || r.path), 'm': length(r.host), 'b': r.verdict = 'block', 'rule': r.host || r.path}}) AS x
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id),
 e AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, unnest({_REFS}) AS dst FROM p) t WHERE src <> '' AND src <> dst GROUP BY ALL),
 w AS (SELECT 0 AS kind, src AS host_at, dst AS host_to, n, sum(n) OVER (PARTITION BY src) AS total FROM e UNION ALL SELECT 1, dst, src, n, sum(n) OVER (PARTITION BY dst) FROM e),
 m AS (SELECT 0 AS k, CASE WHEN x.b THEN 1 ELSE 0 END AS kind, host AS host_at, CAST(count(*) * {UNIT} AS BIGINT) AS mass FROM p JOIN f USING (page_id) WHERE host <> '' GROUP BY ALL UNION ALL
  SELECT m.k + 1, m.kind, w.host_to, CAST(sum(CAST(m.mass AS HUGEINT) * {DAMPING} * w.n // (100 * w.total)) AS BIGINT) FROM m JOIN w ON w.kind = m.kind AND w.host_at = m.host_at WHERE m.k < {ROUNDS} AND m.mass > 0 GROUP BY m.k, m.kind, w.host_to),
 s AS (SELECT host_at, CAST(sum(CASE WHEN kind = 0 THEN mass ELSE 0 END) AS BIGINT) AS trust, CAST(sum(mass * kind) AS BIGINT) AS distrust FROM m GROUP BY host_at)
 SELECT p.page_id, p.host, p.path, x.rule AS rule, CASE WHEN x IS NOT NULL THEN CASE WHEN x.b THEN 'block' ELSE 'allow' END
  WHEN coalesce(distrust, 0) * {100 - PERCENT} > coalesce(trust, 0) * {PERCENT} THEN 'block' ELSE 'allow' END AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
 FROM p LEFT JOIN f ON f.page_id = p.page_id LEFT JOIN s ON s.host_at = p.host"""

OP13 = f"""WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("t")} % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS t FROM o)),
 b AS (SELECT c.conv_id, place AS k, role, text FROM c JOIN o ON o.conv_id = c.base AND place < h UNION ALL SELECT c.conv_id, place + 10, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND place >= h),
 t AS (SELECT c.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY k) FILTER (WHERE k IS NOT NULL), []) AS turns FROM c LEFT JOIN b ON b.conv_id = c.conv_id GROUP BY c.conv_id),
 m AS (SELECT conv_id, d, d = len(turns) AS last, CASE WHEN d = 0 THEN 0 ELSE length(turns[d].t) END AS n_chars,
  md5(CAST(list_transform(turns[1:d], lambda x: md5(x.r) || md5(x.t)) AS VARCHAR)) AS node FROM t, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d) r),
 n AS (SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, min(n_chars) AS n_chars, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends FROM m GROUP BY d, node),
 up AS (SELECT DISTINCT x.node AS above, y.d, y.node FROM m x JOIN m y ON x.conv_id = y.conv_id AND x.d <= y.d),
 k AS (SELECT u.above, count(*) AS n_children FROM up u JOIN n ON n.node = u.above AND u.d = n.d + 1 GROUP BY u.above),
 s AS (SELECT u.above, count(*) FILTER (WHERE k.above IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.n_chars) AS BIGINT) AS saved FROM up u JOIN n ON n.node = u.node LEFT JOIN k ON k.above = u.node GROUP BY u.above)
 SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved AS saved_tokens, sha256(n.ends) AS ends_sha256
 FROM n JOIN s ON s.above = n.node LEFT JOIN k ON k.above = n.node LEFT JOIN (SELECT u.node, n.conv_id FROM up u JOIN n ON n.node = u.above AND u.d = n.d + 1) a ON a.node = n.node"""

SQL = {
    "op1_minhash_near_dedup": OP1, "op3_decontamination": OP3, "op5_substring_dedup": OP5, "op7_warc": OP7, "op8_line_dedup": OP8,
    "op11_merkle_manifest": OP11, "op12_url_filters": OP12, "op13_conversation_trie": OP13,
}
