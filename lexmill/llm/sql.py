"""DuckDB SQL for the results of those operators that SQL can express."""

from __future__ import annotations

from lexmill.llm.secrets import RULES as SECRETS
from lexmill.llm.sharding import PRIME, ROUND_KEYS
from lexmill.llm.url_rules import RULES as URL_RULES

WORD = "[^\\x20\\x09-\\x0D]+"


def sharding(shards: int, seed: int) -> str:
    x = "x"
    source = "SELECT * FROM {0}"
    for i, (m, a) in enumerate(ROUND_KEYS):
        left, right = ("l", "r") if i % 2 == 0 else ("r", "l")
        k = f"((({x} % {right}) * {m} + {a + seed % 1000003}) % {PRIME})"
        source = f"SELECT * REPLACE (({x} % {right}) * {left} + ({x} // {right} + ({k} * {k}) % {PRIME} * 16807 % {PRIME} % {left}) % {left} AS x) FROM ({source})"
    byte = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)"
    bit = "x"
    for _ in range(8):
        bit = f"list_transform({bit}, lambda v: xor(v >> 1, 3988292384 * (v & 1)))"
    bit = bit.replace("list_transform(x,", "list_transform(list_transform(range(256), lambda v: v::BIGINT),", 1)
    return f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT {bit} AS t),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({byte}, lambda b: b::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, crc),
n AS (SELECT count(*) AS n, greatest(2, CASE WHEN count(*) > 1 THEN length(bin(count(*) - 1)) ELSE 0 END) AS bits FROM d),
s AS (SELECT d.*, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x, n, 1::BIGINT << (bits // 2) AS l, 1::BIGINT << (bits - bits // 2) AS r FROM d, n),
w AS ({source.format("s")} UNION ALL SELECT * FROM ({source.format("w WHERE x >= n")}))
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, CAST(x // {shards} AS BIGINT) AS slot, NULL::INTEGER AS grown_shard
FROM w WHERE x < n"""


def secrets() -> str:
    kinds = []
    for i, r in enumerate(SECRETS):
        pattern = r.pattern.replace("((?i)", "(?i)(").replace("'", "''")
        kinds.append(
            f"SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m, "
            f"regexp_extract_all(text, '{pattern}', {r.group}) AS g FROM d WHERE regexp_matches(text, '{pattern}')"
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in SECRETS)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in SECRETS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS ({" UNION ALL ".join(kinds)}),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
s AS (SELECT doc_id, ord, kind, length(m[i]) AS len, length(g[i]) AS part, least,
  CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM u),
a AS (SELECT doc_id, {counts}, string_agg(kind || ':' || start || ':' || (start + len), ',' ORDER BY start, ord) AS spans FROM s WHERE part >= least GROUP BY doc_id)
SELECT d.doc_id, {zeros}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


def jaccard(width: int, num: int, den: int) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM w WHERE len(w) >= {width})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND {width - 1})),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)),
o AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS lab FROM documents UNION SELECT o.b, r.lab FROM r JOIN o ON o.a = r.node WHERE r.lab < o.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.lab AS component_id FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT node, min(lab) AS lab FROM r GROUP BY node) l ON l.node = d.doc_id"""


def url_rules(min_support: float, min_confidence: float, default: str) -> str:
    rule = "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in sorted(URL_RULES, key=lambda r: -len(r.text))
    ) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in URL_RULES) + " END"
    shape = "^(?s:.*?)://([^/?#]*)([^?#]*)"
    return f"""WITH h AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '{shape}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '{shape}', 2), '') AS path FROM pages),
p AS (SELECT *, {rule} AS rule FROM h), q AS (SELECT *, {verdict} AS listed, row_number() OVER () AS k,
  list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN 'p:#' ELSE 'p:' || x END),
    CASE WHEN regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1) <> '' THEN ['x:' || regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)] ELSE [] END,
    list_transform(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), ''), '&'), lambda x: x <> ''), lambda x: 'q:' || regexp_extract(x, '^([^=]*)', 1)))) AS tokens FROM p),
t AS (SELECT k, listed, unnest(tokens) AS t FROM q WHERE listed IS NOT NULL),
s AS (SELECT k, listed, [t] AS a FROM t UNION ALL SELECT x.k, x.listed, [x.t, y.t] FROM t x JOIN t y ON x.k = y.k AND x.t < y.t
  UNION ALL SELECT x.k, x.listed, [x.t, y.t, z.t] FROM t x JOIN t y ON x.k = y.k AND x.t < y.t JOIN t z ON z.k = y.k AND y.t < z.t),
c AS (SELECT a, count(*) AS n FROM s GROUP BY a), cl AS (SELECT a, listed, count(*) AS n FROM s GROUP BY a, listed), tot AS (SELECT count(*) AS n FROM q WHERE listed IS NOT NULL),
r AS (SELECT cl.a, cl.listed AS mined, cl.n::DOUBLE / c.n AS confidence, cl.n::DOUBLE / tot.n AS support FROM cl JOIN c USING (a), tot
  WHERE cl.n >= ceil({min_support}::DOUBLE * tot.n) AND cl.n::DOUBLE / c.n >= {min_confidence}),
g AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.mined = r.mined AND o.confidence >= r.confidence AND len(o.a) < len(r.a) AND list_has_all(r.a, o.a))),
m AS (SELECT q.k, array_to_string(g.a, ' ') AS mined_rule, g.mined, row_number() OVER (PARTITION BY q.k ORDER BY confidence DESC, support DESC, len(g.a), array_to_string(g.a, ' ') DESC, g.mined DESC) AS z
  FROM q, g WHERE q.listed IS NULL AND list_has_all(q.tokens, g.a))
SELECT page_id, host, path, rule, coalesce(listed, m.mined, '{default}') AS verdict, m.mined_rule FROM q LEFT JOIN m ON m.k = q.k AND m.z = 1"""


def mixing(domains: tuple[str, ...], weights: dict, permille: int, epochs: int, seed: int) -> str:
    levels = ("domain", "lang", "source")

    def weight(x: str) -> str:
        known = weights.get(x) or {}
        return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in known.items()) + " ELSE 1 END" if known else "1"

    out = f"""WITH d AS (SELECT doc_id, CASE WHEN regexp_extract(source, '([0-9]{{1,6}})$', 1) <> '' THEN ['{"', '".join(domains)}'][CAST(regexp_extract(source, '([0-9]{{1,6}})$', 1) AS BIGINT) % {len(domains)} + 1]
  ELSE 'other' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS tokens FROM documents),
lf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS total FROM d GROUP BY ALL),
cp AS (SELECT *, {", ".join(f"{weight(x)} AS w_{x}" for x in levels)}, total * {epochs} AS cap FROM lf WHERE total > 0),
b0 AS (SELECT least((SELECT CAST(sum(total) AS BIGINT) * {permille} // 1000 FROM lf), (SELECT CAST(sum(cap) AS BIGINT) FROM cp)) AS budget)"""
    for i, x in enumerate(levels):
        path, parents = ", ".join(levels[: i + 1]), ", ".join(levels[:i])
        by = f"PARTITION BY {parents} " if parents else ""
        before = f"OVER ({by}ORDER BY cap / w, {x} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        join = f"JOIN b{i} USING ({parents})" if parents else f"CROSS JOIN b{i}"
        out += f""",
n{i} AS (SELECT {path}, CAST(sum(cap) AS BIGINT) AS cap, max(w_{x}) AS w FROM cp GROUP BY ALL),
f{i} AS (SELECT n{i}.*, budget, budget - coalesce(sum(cap) {before}, 0) AS lft, sum(w) OVER ({by}) - coalesce(sum(w) {before}, 0) AS lw FROM n{i} {join}),
g{i} AS (SELECT *, cap * lw <= lft * w AS ful FROM f{i}),
h{i} AS (SELECT *, budget - sum(CASE WHEN ful THEN cap ELSE 0 END) OVER ({by}) AS rest, sum(CASE WHEN ful THEN 0 ELSE w END) OVER ({by}) AS restw FROM g{i}),
b{i + 1} AS (SELECT {path}, CAST(CASE WHEN ful THEN cap ELSE rest * w // restw END AS BIGINT) AS budget FROM h{i})"""
    at = ", ".join(levels)
    return f"""{out},
pl AS (SELECT {at}, budget // total AS epochs, budget % total AS part FROM lf JOIN b3 USING ({at})),
k AS (SELECT d.*, epochs, part, md5('{seed}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM d JOIN pl USING ({at})),
ks AS (SELECT {at}, digest, max(part) AS part, sum(tokens) AS t, count(*) AS c FROM k GROUP BY ALL),
u AS (SELECT *, sum(t) OVER (PARTITION BY {at} ORDER BY digest) AS upto FROM ks),
y AS (SELECT {at}, digest, CASE WHEN upto <= part THEN 1 ELSE 0 END AS ins, CASE WHEN upto > part AND upto - t < part AND c = 1 THEN part - upto + t END AS cut FROM u),
z AS (SELECT k.*, ins, cut, unnest(range(0, epochs + CASE WHEN ins = 1 OR cut IS NOT NULL THEN 1 ELSE 0 END)) AS epoch FROM k JOIN y USING ({at}, digest))
SELECT doc_id, {at}, tokens, CAST(epoch AS INTEGER) AS epoch, CAST(CASE WHEN epoch = epochs AND cut IS NOT NULL THEN cut ELSE tokens END AS BIGINT) AS taken FROM z"""


def lloyd(dims: int, scale: int, k: int, rounds: int) -> str:
    square = f"CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT)"
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS j, x FROM v QUALIFY j < {k})"""
    for i in range(rounds + 1):
        out += f""",
a{i} AS MATERIALIZED (SELECT r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min({{'d': {square}, 'j': c.j}}) AS m FROM v, c{i} c GROUP BY r)"""
        if i < rounds:
            out += f""",
s{i} AS (SELECT m.j AS j, d.i AS i, CAST(sum(x[d.i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {dims + 1}) d(i) GROUP BY m.j, d.i),
u{i} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{i} GROUP BY j),
c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(u.x, c.x) AS x FROM c{i} c LEFT JOIN u{i} u ON u.j = c.j)"""
    return f"""{out}
SELECT vec_id, m.j AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.j = a.m.j"""


def manifest(columns: tuple[str, ...], tampered: int, levels: int = 20, top_levels: int = 4) -> str:
    """Trees of up to 2**levels leaves a group and 2**top_levels groups."""
    byte = "list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)"
    bit = "list_transform(range(256), lambda v: v::BIGINT)"
    for _ in range(8):
        bit = f"list_transform({bit}, lambda v: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({byte}, lambda b: b::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

    def leaf(more: int) -> str:
        values = [f"CAST({c} AS VARCHAR)" if c != "n_chars" or not more else f"CAST(n_chars + {more} AS VARCHAR)" for c in columns]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"

    def climb(name: str, n: int) -> str:
        return "".join(
            f""",
{name}{k + 1} AS MATERIALIZED (SELECT g, i // 2 AS i, CASE WHEN max(c) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h, (max(c) + 1) // 2 AS c FROM {name}{k} GROUP BY g, i // 2)"""
            for k in range(n)
        )

    def walk(name: str, way: str, n: int) -> str:
        return "".join(
            f""",
{way}{k + 1} AS MATERIALIZED (SELECT w.* REPLACE (w.i // 2 AS i, (w.c + 1) // 2 AS c, w.p || coalesce(s.h, '') AS p,
  CASE WHEN w.c > 1 THEN sha256(CASE WHEN w.i % 2 = 1 THEN s.h || w.f ELSE w.f || coalesce(s.h, '') END) ELSE w.f END AS f)
  FROM {way}{k} w LEFT JOIN {name}{k} s ON s.g = w.g AND s.i = xor(w.i, 1))"""
            for k in range(n)
        )

    return f"""WITH crc AS MATERIALIZED (SELECT {bit} AS t),
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf(0)} AS leaf, CASE WHEN {crc} % {tampered} = 0 THEN {leaf(1)} END AS changed FROM documents, crc),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS c FROM d),
n0 AS (SELECT g, i, leaf AS h, c FROM l){climb("n", levels)},
m0 AS MATERIALIZED (SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS c FROM n{levels}){climb("m", top_levels)},
w0 AS (SELECT doc_id, leaf, g, i, c, '' AS p, coalesce(changed, leaf) AS f FROM l){walk("n", "w", levels)},
v0 AS (SELECT w.* REPLACE (m.g AS g, m.i AS i, m.c AS c), m.h AS subroot FROM w{levels} w JOIN m0 m ON m.lang = w.g){walk("m", "v", top_levels)}
SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified FROM v{top_levels}, m{top_levels}"""
