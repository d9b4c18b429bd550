"""DuckDB SQL for the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, {_SPACES}), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS sh
      FROM d, range(1, greatest(len(w) - 4, 1) + 1) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP8 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, list_slice(w, i, i + least(10, len(w)) - 1) AS win
       FROM b, range(1, greatest(len(w) - 9, 1) + 1) AS r(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS win
       FROM d, ks, range(1, len(w) - k + 2) AS r(i) WHERE len(w) >= k),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, range(i, i + k) AS r(p) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
      FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP9 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
      FROM d, range(1, len(w) - 48) AS r(i) WHERE len(w) >= 50),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
g AS (SELECT DISTINCT doc_id, p FROM x JOIN f USING (h), range(i, i + 50) AS r(p) WHERE doc_id > first),
k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
t AS (SELECT k.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY k.p) FILTER (WHERE g.p IS NULL) AS kept
      FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP11 = f"""
WITH RECURSIVE
enc AS (SELECT doc_id, source, lang, n_chars, text, translate(text, '{_UPPER}', '{_LOWER}') AS low FROM documents),
f AS (SELECT doc_id, source,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
          || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
          || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS own, coalesce(strlen(low) || ':' || low, '-') AS other FROM enc),
-- CRC-32 of the decimal text, bit by bit.
bits AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS t, 0 AS pos, CAST(4294967295 AS BIGINT) AS c FROM documents
         UNION ALL
         SELECT doc_id, t, pos + 1,
                list_reduce(list_concat([xor(c, CAST(ascii(substr(t, pos + 1, 1)) AS BIGINT))], CAST([0,0,0,0,0,0,0,0] AS BIGINT[])),
                            lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)
         FROM bits WHERE pos < length(t)),
hit AS (SELECT doc_id FROM bits WHERE pos = length(t) AND xor(c, 4294967295) % 5 = 0),
leaf AS (SELECT doc_id, source, sha256(head || own) AS leaf, sha256(head || other) AS other,
                row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r,
                count(*) OVER (PARTITION BY source) AS n FROM f),
up AS (SELECT 0 AS l, source, r AS i, n, leaf AS h FROM leaf
       UNION ALL
       SELECT l + 1, source, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i))
       FROM up WHERE n > 1 GROUP BY l, source, i // 16, n),
top AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n
        FROM up WHERE n = 1),
high AS (SELECT 0 AS l, r AS i, n, subroot AS h FROM top
         UNION ALL
         SELECT l + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY l, i // 16, n),
-- The runs of 16: each node's siblings to the left and to the right.
step AS (SELECT l, source, i, coalesce(string_agg(h, '') OVER a, '') AS lf, coalesce(string_agg(h, '') OVER b, '') AS rt
         FROM up WHERE n > 1
         WINDOW a AS (PARTITION BY l, source, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                b AS (PARTITION BY l, source, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
high_step AS (SELECT l, i, coalesce(string_agg(h, '') OVER a, '') AS lf, coalesce(string_agg(h, '') OVER b, '') AS rt
         FROM high WHERE n > 1
         WINDOW a AS (PARTITION BY l, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                b AS (PARTITION BY l, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
steps AS (SELECT leaf.source, leaf.r, step.l AS l, lf, rt FROM leaf JOIN step
            ON step.source IS NOT DISTINCT FROM leaf.source AND step.i = leaf.r >> CAST(4 * step.l AS INTEGER)
          UNION ALL
          SELECT leaf.source, leaf.r, 1000 + s.l, lf, rt FROM leaf JOIN top ON top.source IS NOT DISTINCT FROM leaf.source
            JOIN high_step s ON s.i = top.r >> CAST(4 * s.l AS INTEGER)),
path AS (SELECT source, r, list(lf || '|' || rt ORDER BY l) AS p, string_agg(lf || rt, '' ORDER BY l) AS siblings
         FROM steps GROUP BY source, r),
done AS (SELECT leaf.doc_id, leaf.leaf, top.subroot, (SELECT h FROM high WHERE n = 1) AS root,
                sha256(coalesce(siblings, '')) AS proof_sha256,
                list_reduce(list_concat([CASE WHEN leaf.doc_id IN (SELECT doc_id FROM hit) THEN leaf.other ELSE leaf.leaf END],
                                        coalesce(p, CAST([] AS VARCHAR[]))),
                            lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
         FROM leaf JOIN top ON top.source IS NOT DISTINCT FROM leaf.source
              LEFT JOIN path ON path.source IS NOT DISTINCT FROM leaf.source AND path.r = leaf.r)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
"""

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM o JOIN v USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
gv AS (SELECT lang, count(*) AS v FROM v GROUP BY lang),
gn AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c,
             1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 1)) // (coalesce(gn.n, 0) + gv.v) AS p
      FROM g JOIN v USING (lang) JOIN gv USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c USING (lang, source, term)),
lc AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term),
ln AS (SELECT lang, sum(c) AS n FROM lc GROUP BY lang),
lp AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (lc.c + 1)) // (ln.n + gv.v) AS q FROM lc JOIN ln USING (lang) JOIN gv USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
over AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN lp USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
      UNION ALL
      SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM over)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

OP13 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS x FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(x, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest
      FROM h),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM l
"""

ORACLES = {
    "op1_line_dedup": OP1,
    "op2_near_dedup": OP2,
    "op8_decontaminate": OP8,
    "op9_substring_dedup": OP9,
    "op11_merkle_manifest": OP11,
    "op12_source_divergence": OP12,
    "op13_warc": OP13,
}
