"""SQL of those corpus queries that SQL can express, over the same tables."""

from __future__ import annotations

from wakeline.llm.centroids import CLUSTERS, SEED, WIDTH
from wakeline.llm.centroids import ROUNDS as TURNS
from wakeline.llm.decontaminate import SLOP
from wakeline.llm.resampling import BUCKETS, LEAST_WORDS, PERCENT
from wakeline.llm.resampling import SEED as DRAW
from wakeline.llm.sharding import ROUNDS
from wakeline.llm.url_graph import DAMPING, MOST_ROUNDS, RULES, THRESHOLD, TOLERANCE

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TEXT = LOWER.format("coalesce(text, '')")

# Sets of shingles, pairs by what they share, then everything that links reach.
OP4 = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i + 1:i + 5], ' ') AS s FROM d, unnest(range(greatest(len(w) - 4, 1))) u(i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id FROM d LEFT JOIN n USING (rid) JOIN r ON r.a = d.rid JOIN d o ON o.rid = r.b GROUP BY d.rid, d.doc_id"""

# The permutation walks in steps: `k` counts the rounds of one pass, and a pass that ends at or above the count starts again.
WRAP = "((({x})::UHUGEINT * {m}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _mix(x: str) -> str:
    """The mixing function as nested one-row subqueries; without them each level would be written out twice."""
    first = WRAP.format(x="xor(x, x >> 30)", m="13787848793156543929")
    second = WRAP.format(x="xor(y, y >> 27)", m="10723151780598845931")
    return f"(SELECT xor(z, z >> 31) FROM (SELECT {second} AS z FROM (SELECT {first} AS y FROM (SELECT ({x})::UBIGINT AS x))))"


# The table of the checksum's steps, and a checksum by it.
CRC_TABLE = "t AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b))"
CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def op5(shards: int = 8, seed: int = 7) -> str:
    return f"""WITH RECURSIVE {CRC_TABLE},
h AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, [('0x' || x)::BIGINT for x in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS bytes FROM documents),
c AS (SELECT doc_id, size, {CRC.format(bytes="bytes")} AS text_crc32 FROM h, t),
d AS (SELECT *, row_number() OVER (ORDER BY doc_id, text_crc32, size) - 1 AS row_no FROM c),
g AS (SELECT n, half, ((1::UBIGINT << half) - 1)::UBIGINT AS mask FROM (SELECT n, greatest(1, (ceil(log2(greatest(n, 2)))::INT + 1) // 2)::UBIGINT AS half FROM (SELECT count(*)::UBIGINT AS n FROM d))),
k AS (SELECT i AS k, {_mix(f"i + 1 + {seed * ROUNDS}")} AS key FROM range({ROUNDS}) r(i)),
f AS (SELECT row_no, 0::BIGINT AS k, row_no::UBIGINT >> half AS l, row_no::UBIGINT & mask AS r FROM d, g
 UNION ALL SELECT row_no, CASE WHEN k + 1 < {ROUNDS} OR (y::UBIGINT << half | q) < n THEN k + 1 ELSE 0 END, y, q FROM (
  SELECT f.row_no, f.k, f.r AS y, xor(f.l, {_mix("xor(f.r, k.key)")} & g.mask) AS q, g.n, g.half FROM f JOIN k ON k.k = f.k CROSS JOIN g WHERE f.k < {ROUNDS})),
e AS (SELECT row_no, (l << half | r)::BIGINT AS place FROM f, g WHERE k = {ROUNDS})
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {shards})::INT AS shard, place // {shards} AS slot, NULL::INT AS grown_shard FROM d JOIN e USING (row_no)"""


def op7() -> str:
    rules = ", ".join(f"('{what}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for what, rule in RULES)
    host = r"coalesce(" + LOWER.format(r"regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1)") + ", '')"
    link = r"(?i)<a\s[^>]*?href\s*=\s*[\"'']?((?:[a-z][a-z0-9+.-]*:)?//[^\"''\s>]+)"

    def rounds(name: str, seed: str, source: str, to: str, edges: str) -> str:
        return f"""{name} AS (SELECT 0 AS i, host, {seed} AS seed, {1 - DAMPING} * {seed} AS score FROM seeds UNION ALL
 SELECT s.i + 1, s.host, s.seed, {1 - DAMPING} * s.seed + {DAMPING} * coalesce(sum(p.score * e.share), 0) FROM {name} s LEFT JOIN {edges} e ON e.{to} = s.host LEFT JOIN {name} p ON p.host = e.{source} WHERE s.i < {MOST_ROUNDS} GROUP BY s.i, s.host, s.seed),
{name}n AS (SELECT coalesce(min(i), {MOST_ROUNDS}) AS n FROM (SELECT i, max(abs(score - before)) AS moved FROM (SELECT i, score, lag(score) OVER (PARTITION BY host ORDER BY i) AS before FROM {name}) WHERE i > 0 GROUP BY i) WHERE moved <= {TOLERANCE})"""

    return f"""WITH RECURSIVE u AS (SELECT row_number() OVER () AS rid, page_id, html, {host.format("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(what, rule, rhost, rpath) AS (VALUES {rules}),
k AS (SELECT rid, rule, what FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, rule DESC) = 1),
known AS (SELECT u.*, rule, what FROM u LEFT JOIN k USING (rid)),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS t FROM known WHERE host <> ''),
edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {host.format("CASE WHEN starts_with(t, '//') THEN 'http:' || t ELSE t END")} AS dst FROM links) WHERE dst <> '' AND dst <> src GROUP BY src, dst),
seeds AS (SELECT host, (blocked = 0 AND allowed * 2 > n)::INT::DOUBLE AS trust, (allowed = 0 AND blocked * 2 > n)::INT::DOUBLE AS distrust FROM (
 SELECT host, sum(n) AS n, sum(a) AS allowed, sum(b) AS blocked FROM (SELECT host, 1 AS n, coalesce(what = 'allow', false)::INT AS a, coalesce(what = 'block', false)::INT AS b FROM known UNION ALL SELECT src, 0, 0, 0 FROM edges UNION ALL SELECT dst, 0, 0, 0 FROM edges) GROUP BY host)),
go AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges),
doubted AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges WHERE src NOT IN (SELECT host FROM seeds WHERE trust > 0)),
{rounds("tr", "trust", "src", "dst", "go")}, {rounds("di", "distrust", "dst", "src", "doubted")}
SELECT page_id, host, path, rule, coalesce(what, CASE WHEN seeds.distrust > 0 OR (seeds.trust = 0 AND di.score > {THRESHOLD} AND di.score > tr.score) THEN 'block' ELSE 'allow' END) AS verdict, tr.score AS trust, di.score AS distrust
FROM known JOIN seeds USING (host) JOIN tr USING (host) JOIN di USING (host) WHERE tr.i = (SELECT n FROM trn) AND di.i = (SELECT n FROM din)"""


# Every byte and the 100-byte string that starts there; of equal strings the first stays, by document and place.
OP9 = """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT rid, i, b[i + 1:i + 1] AS byte, CASE WHEN i + 100 <= octet_length(b) THEN md5(hex(b[i + 1:i + 100])) END AS s FROM d, unnest(range(octet_length(b))) u(i)),
r AS (SELECT rid, i, byte, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY rid, i) > 1 AS again FROM p),
c AS (SELECT rid, i, byte, coalesce(max(CASE WHEN again THEN i END) OVER (PARTITION BY rid ORDER BY i) > i - 100, false) AS gone FROM r),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS opens FROM c),
a AS (SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(hex(byte), '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY rid)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (rid)"""

# Windows of the items against the runs of words of every document.
OP10 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k + 1:k + 10], ' ') AS s FROM i, unnest(range(greatest(len(w) - 9, 1))) u(k) WHERE len(w) > 0),
o AS (SELECT rid, p, z.n, array_to_string(w[p + 1:p + z.n], ' ') AS s FROM d, (SELECT DISTINCT n FROM v) z, unnest(range(len(w))) u(p) WHERE p + z.n <= len(w)),
h AS (SELECT rid, p, o.n, item_id FROM o JOIN v ON v.s = o.s AND v.n = o.n),
c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM h)) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM h) GROUP BY rid),
q AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS p FROM d), f AS (SELECT word, count(*) AS n FROM q GROUP BY word),
l AS (SELECT s, any_value(n) AS n, arg_min(word, freq) AS word, list_distinct(string_split(s, ' ')) AS words FROM (SELECT v.s, v.n, word, coalesce(f.n, 0) AS freq FROM (SELECT DISTINCT s, n, unnest(string_split(s, ' ')) AS word FROM v) v LEFT JOIN f USING (word)) GROUP BY s),
e AS (SELECT DISTINCT rid, l.s FROM q JOIN l USING (word) JOIN d USING (rid) WHERE len(list_filter(range(greatest(p - l.n - {SLOP - 1}, 0), p + 1), lambda i: list_has_all(d.w[i + 1:i + l.n + {SLOP}], l.words))) > 0),
k AS (SELECT rid, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM e JOIN v USING (s)) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near_items, sha256(coalesce(near, '')) AS near_items_sha256 FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid) LEFT JOIN k USING (rid)"""

VECTORS = """{name} AS (SELECT row_number() OVER () AS rid, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)"""

OP11 = f"""WITH {VECTORS.format(name="r")},
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, coalesce(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]), 0)::BIGINT AS score FROM r q JOIN r c ON len(q.v) = len(c.v) AND q.rid <> c.rid WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 10"""


def op12() -> str:
    words = rf"regexp_extract_all({TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    u = f"(('0x' || substr(sha256('{DRAW}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE"
    return f"""WITH {CRC_TABLE}, d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents), b AS (SELECT {words} AS w FROM benchmark),
x AS (SELECT rid, unnest(w) AS word FROM d), y AS (SELECT unnest(w) AS word FROM b),
z AS (SELECT word, {CRC.format(bytes="[('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(word)), '..')]")} % {BUCKETS} AS bucket FROM (SELECT word FROM x UNION SELECT word FROM y), t),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM x JOIN z USING (word) GROUP BY bucket), g AS (SELECT bucket, count(*)::DOUBLE AS t FROM y JOIN z USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM g) + {BUCKETS}))))::BIGINT AS gain FROM (SELECT DISTINCT bucket FROM z) LEFT JOIN s USING (bucket) LEFT JOIN g USING (bucket)),
w AS (SELECT rid, sum(gain)::BIGINT AS weight FROM x JOIN z USING (word) JOIN gain USING (bucket) GROUP BY rid),
a AS (SELECT rid, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln({u})))::BIGINT AS score FROM d LEFT JOIN w USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM a WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM a LEFT JOIN r USING (rid)"""


def op13() -> str:
    """Every round written out: each vector's nearest centroid, then the floors of the means."""
    out = f"""WITH {VECTORS.format(name="every")}, r AS MATERIALIZED (SELECT rid, vec_id, v FROM every WHERE len(v) = {WIDTH}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM r ORDER BY h, v LIMIT {CLUSTERS}))"""
    for i in range(TURNS + 1):
        out += f""",
a{i} AS MATERIALIZED (SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT rid, cluster, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, c)])::BIGINT AS d FROM r CROSS JOIN c{i}) GROUP BY rid)"""
        if i < TURNS:
            out += f""",
m{i} AS (SELECT cluster, list(m ORDER BY k) AS m FROM (SELECT cluster, k, sum(x)::BIGINT // count(*) - (sum(x)::BIGINT % count(*) < 0)::BIGINT AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range({WIDTH})) AS k FROM r JOIN a{i} USING (rid)) GROUP BY cluster, k) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))"""
    return f"""{out}
SELECT vec_id, cluster::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM r JOIN a{TURNS} USING (rid) JOIN c{TURNS} USING (cluster)"""


SQL = {"op4_ngram_jaccard_join": OP4, "op5_feistel_sharding": op5(), "op7_url_graph": op7(), "op9_suffix_array_dedup": OP9, "op10_decontamination": OP10, "op11_uniform_threshold_top_k": OP11, "op12_importance_resampling": op12(), "op13_hamerly_clustering": op13()}
