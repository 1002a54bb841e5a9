"""DuckDB SQL that gives the catalogue's results by other means."""

from __future__ import annotations

from lexmill.dims import AGENT_PHRASES, AGENT_TAXONOMY, ERA_RANGES, ERAS, OCR_PAIRS, STRATEGIES, YEARS
from lexmill.plans.bindings import CUES, LEXICON, OTHER_TERMS


def q(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def case(column: str, pairs: dict, other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in pairs.items()) + f" ELSE {other} END"


ERA_OF = {y: e for e, years in ERAS.items() for y in years}
ERA_ORD = {e: i for i, e in enumerate(ERAS)}
TERMS = q(LEXICON.languages)

CHUNKS = f"""
chunks AS (
  SELECT doc_id AS chunk_id, source AS doc_title, lang AS jurisdiction, text,
         list_extract([{", ".join(map(str, YEARS))}], CAST(CAST(substr(source, 4) AS INTEGER) % {len(YEARS)} + 1 AS BIGINT)) AS doc_year
  FROM documents),
c AS (SELECT *, {case("doc_year", ERA_OF, "'unknown'")} AS era FROM chunks)"""

FRAMES = f"""{CHUNKS},
w AS (SELECT chunk_id, doc_title, doc_year, jurisdiction, era, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM c),
u AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w),
n AS (
  SELECT chunk_id, doc_title, doc_year, jurisdiction, era, CAST(i - 1 AS INTEGER) AS token_idx, w[i] AS target_term, lower(w[i]) AS target_lemma,
         CASE WHEN i > 1 THEN lower(w[i - 1]) END AS prev, CASE WHEN i < len(w) THEN lower(w[i + 1]) END AS next
  FROM u WHERE lower(w[i]) IN ({TERMS})),
r AS (
  SELECT *, {case("target_lemma", LEXICON.languages)} AS language,
         CASE WHEN next IN ({q(LEXICON.after_agent)}) THEN 'agent' WHEN prev IN ({q(LEXICON.before_patient)}) THEN 'patient'
              WHEN prev IN ({q(LEXICON.before_oblique)}) THEN 'oblique' WHEN next IN ({TERMS}) THEN 'modifier' ELSE 'other' END AS syntactic_role
  FROM n),
f AS (
  SELECT *, CASE syntactic_role WHEN 'agent' THEN 'nsubj' WHEN 'patient' THEN 'pobj' WHEN 'oblique' THEN 'obl' WHEN 'modifier' THEN 'compound' ELSE 'dep' END AS dep_relation,
         coalesce(next, '') AS head, CASE WHEN next IN ({q(LEXICON.after_agent)}) THEN 'AUX' WHEN length(next) > 3 THEN 'NOUN' ELSE 'ADP' END AS head_pos,
         CASE WHEN length(prev) > 3 THEN 'amod' ELSE 'det' END AS child_dep, CASE WHEN length(prev) > 3 THEN 'ADJ' ELSE 'DET' END AS child_pos,
         CASE WHEN length(prev) > 3 THEN prev END AS modifier, CASE WHEN syntactic_role IN ('agent', 'patient') THEN next END AS verb
  FROM r)"""


#: Words and pairs of words, not across stop words, of chunks with a labelled vector; ranked by class.
TOPIC_TERMS = f"""{CHUNKS},
lb AS (SELECT chunk_id, CAST(label AS BIGINT) AS topic_id, text FROM c JOIN embeddings ON vec_id = chunk_id WHERE label <> 0),
lw AS (SELECT chunk_id, topic_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z]+'), lambda w: CASE WHEN w NOT IN ('the', 'of', 'and', 'in', 'to', 'a') THEN w END) AS w FROM lb),
lu AS (SELECT chunk_id, topic_id, w, unnest(range(1, len(w) + 1)) AS i FROM lw),
tt AS (SELECT chunk_id, topic_id, w[i] AS term FROM lu WHERE w[i] IS NOT NULL UNION ALL SELECT chunk_id, topic_id, w[i] || ' ' || w[i + 1] FROM lu WHERE w[i] IS NOT NULL AND i < len(w) AND w[i + 1] IS NOT NULL),
td AS (SELECT topic_id, chunk_id, term, count(*) AS n FROM tt GROUP BY ALL), tk AS (SELECT topic_id, term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM td GROUP BY ALL),
ts AS (SELECT *, sum(tf) OVER (PARTITION BY term) AS ft, sum(df) OVER (PARTITION BY term) AS docs FROM tk), ta AS (SELECT sum(tf)::DOUBLE / count(DISTINCT topic_id) AS a FROM tk),
tx AS (SELECT topic_id, term, tf, round(tf * ln(1 + a / ft::DOUBLE), 6) AS score FROM ts, ta WHERE docs >= 2),
tr AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, term) AS rank FROM tx)"""


def hits(words) -> str:
    return f"len(list_filter(w, lambda x: x IN ({q(words)})))"


by_language: dict[str, list[str]] = {}
for _term, _language in LEXICON.languages.items():
    by_language.setdefault(_language, []).append(_term)

CLASSIFIED = f"""{CHUNKS},
lw AS (SELECT chunk_id, doc_title, doc_year, era, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM c),
lx AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {hits(t)} > 0 THEN '{l}' END" for l, t in sorted(by_language.items()))}], lambda x: x IS NOT NULL) AS langs,
  list_filter([{", ".join(f"CASE WHEN {hits(t)} > 0 THEN 'topos_of_{n}' END" for n, t in sorted(CUES.topoi.items()))}], lambda x: x IS NOT NULL) AS found
  FROM lw),
ls AS ({" UNION ALL ".join(f"SELECT *, '{s}' AS strategy, {hits(t)} AS cues, list_sort(list_distinct(list_filter(w, lambda x: x IN ({q(t)})))) AS devices FROM lx" for s, t in CUES.strategies.items())}),
cl AS (
  SELECT chunk_id, doc_title, doc_year, era, strategy, cues >= {CUES.least} AS present, devices, langs,
         CASE WHEN cues >= {CUES.least} THEN least(1.0::DOUBLE, cues / {2 * CUES.least}.0::DOUBLE) ELSE 0.0 END AS confidence,
         CASE WHEN strategy = 'argumentation' THEN found ELSE [] END AS topoi
  FROM ls)"""

ASSIGNED = f"""
a AS (SELECT vec_id AS chunk_id, list_extract([{", ".join(map(str, YEARS))}], CAST(vec_id % {len(YEARS)} + 1 AS BIGINT)) AS doc_year,
             CASE WHEN label = 0 THEN -1 ELSE CAST(label AS INTEGER) END AS topic_id,
             CAST(round(embedding[1]::DOUBLE * 100) AS BIGINT) AS x, CAST(round(embedding[2]::DOUBLE * 100) AS BIGINT) AS y FROM embeddings),
tf AS (SELECT doc_year, topic_id, count(*) AS frequency FROM a WHERE topic_id <> -1 GROUP BY ALL)"""


def edges(least: int) -> str:
    return f"""{FRAMES},
er AS (
  SELECT era, target_lemma AS src, head AS dst, dep_relation AS rel FROM f
  UNION ALL SELECT era, prev, target_lemma, child_dep FROM f WHERE prev IS NOT NULL
  UNION ALL SELECT era, modifier, target_lemma, 'amod' FROM f WHERE modifier IS NOT NULL),
ec AS (SELECT era, src, dst, rel, count(*) AS n FROM er WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL HAVING count(*) >= {least}),
e AS (SELECT era, src, dst, CAST(sum(n) AS BIGINT) AS weight, string_agg(rel, '|' ORDER BY rel) AS relations FROM ec GROUP BY ALL),
dg AS (
  SELECT era, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) + sum(o) AS BIGINT) AS total_degree
  FROM (SELECT era, src AS node, weight AS o, 0 AS i FROM e UNION ALL SELECT era, dst, 0, weight FROM e) GROUP BY ALL)"""


def ratio(a: str, b: str, empty: str = "NULL::DOUBLE") -> str:
    return f"CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE {empty} END"


INF = "'Infinity'::DOUBLE"
COUNTS = ", ".join(f"CAST(coalesce(sum(CASE WHEN language = '{x}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS {x.lower()}_mentions" for x in ("English", "Gaelic", "Scots"))
RATIOS = (
    ratio("gaelic_mentions + scots_mentions", "english_mentions", INF) + " AS markedness_ratio, "
    + ratio("gaelic_mentions + scots_mentions", "english_mentions + gaelic_mentions + scots_mentions") + " AS english_invisibility_index"
)
ROLES = ("agent", "patient", "modifier", "oblique", "other")
AGENCY = ratio("count(*) FILTER (syntactic_role = 'agent')", "count(*) FILTER (syntactic_role IN ('agent', 'patient'))", "0.0")
TOPOI = f"""{CLASSIFIED},
p AS (SELECT * FROM cl WHERE strategy = 'argumentation' AND present)"""


def topos_by(key: str) -> str:
    return f"""tc AS (SELECT {key}, topos, count(*) AS n FROM (SELECT {key}, unnest(topoi) AS topos FROM p) GROUP BY ALL),
tn AS (SELECT {key}, count(*) AS argumentation_chunks FROM p GROUP BY ALL),
tt AS (SELECT {key}, topos, n, argumentation_chunks, {ratio("n", "argumentation_chunks")} AS proportion FROM tc JOIN tn USING ({key}))"""


def top(source: str, by: str, value: str, most: int, columns: str) -> str:
    return f"SELECT {columns}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, {value}) AS rank FROM {source}) WHERE rank <= {most}"


def most_of(name: str, value: str, alias: str) -> str:
    return f"""{name} AS (SELECT era, target_language, string_agg({value} || ':' || n, '|' ORDER BY n DESC, {value}) AS {alias} FROM
  (SELECT *, row_number() OVER (PARTITION BY era, target_language ORDER BY n DESC, {value}) AS r FROM
    (SELECT era, target_language, {value}, count(*) AS n FROM k WHERE {value} <> '' GROUP BY ALL)) WHERE r <= 10 GROUP BY ALL)"""


def listed_sql(name: str, column: str, alias: str, most: int, where: str) -> str:
    return f"""{name} AS (SELECT doc_title, strategy, string_agg(v || ':' || n, '|' ORDER BY n DESC, v) AS {alias} FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_title, strategy ORDER BY n DESC, v) AS r FROM
    (SELECT doc_title, strategy, v, count(*) AS n FROM (SELECT doc_title, strategy, unnest({column}) AS v FROM on_ {where}) GROUP BY ALL)) WHERE r <= {most} GROUP BY ALL)"""


def back(level: str, key: str) -> str:
    passive, less = "voice = 'passive'", "voice = 'passive' AND agent_category = 'AGENTLESS'"
    return f"""SELECT '{level}' AS level, {key} AS name, count(*) FILTER ({passive}) AS passive_count, count(*) FILTER ({less}) AS agentless_count,
  count(*) FILTER ({passive} AND agent_category <> 'AGENTLESS') AS by_phrase_count, count(*) FILTER (voice = 'active') AS active_count,
  {ratio(f"count(*) FILTER ({less})", f"count(*) FILTER ({passive})", "0.0")} AS agentless_ratio,
  {ratio(f"count(*) FILTER ({passive})", "count(*) FILTER (voice IN ('passive', 'active'))", "0.0")} AS passive_rate
  FROM t GROUP BY {key}"""


def category_sql() -> str:
    phrase = " OR ".join(f"contains(name, '{p}')" for p in AGENT_PHRASES)
    known = "CASE " + " ".join(f"WHEN x IN ({q(ws)}) THEN '{c}'" for c, ws in AGENT_TAXONOMY.items()) + " END"
    inside = " ".join(f"WHEN {' OR '.join(f'''contains(name, '{w}')''' for w in ws)} THEN '{c}'" for c, ws in AGENT_TAXONOMY.items())
    named = f"list_filter(list_transform(list_reverse(string_split(name, ' ')), lambda x: {known}), lambda x: x IS NOT NULL)[1]"
    return f"CASE WHEN {phrase} THEN 'INSTITUTIONAL' WHEN {named} IS NOT NULL THEN {named} {inside} ELSE 'OTHER' END"


TRIPLES = f"""{CHUNKS},
sw AS (SELECT chunk_id, doc_title, era, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM c),
su AS (SELECT chunk_id, doc_title, era, w, unnest(range(0, len(w) // 5)) AS sent_id FROM sw),
sg AS (SELECT chunk_id, doc_title, era, sent_id, w[sent_id * 5 + 1 : sent_id * 5 + 5] AS s FROM su),
sv AS (SELECT *, length(s[3]) % 2 = 0 AS p, length(s[4]) % 2 = 0 AS named, length(s[1]) % 4 <> 1 AS subject, length(s[3]) <> 3 AS verbal, array_to_string(s, ' ') AS sentence FROM sg),
sx AS (SELECT *, 0 AS token_idx, s[1] AS target_term, 'nsubjpass' AS dep_relation FROM sv WHERE p UNION ALL SELECT *, 4, s[5], CASE WHEN p THEN 'pobj' ELSE 'dobj' END FROM sv),
sy AS (SELECT *, lower(target_term) AS target_lemma, CASE WHEN verbal THEN lower(s[3]) END AS verb,
  CASE WHEN p AND named THEN s[5] WHEN NOT p AND subject AND verbal THEN s[1] END AS agent_text,
  CASE WHEN p THEN 'passive' WHEN subject AND verbal THEN 'active' ELSE 'unknown' END AS voice, CASE WHEN p THEN named END AS by_phrase
  FROM sx WHERE lower(target_term) IN ({q([*LEXICON.languages, *OTHER_TERMS])})),
sz AS (SELECT *, {case("target_lemma", LEXICON.languages)} AS language, lower(agent_text) AS name FROM sy),
t AS (SELECT *, CASE WHEN verb IS NULL THEN 'NO_VERB' WHEN voice = 'unknown' THEN 'UNRESOLVED' WHEN agent_text IS NULL THEN 'AGENTLESS' ELSE {category_sql()} END AS agent_category FROM sz)"""


def emerging(order: list[str], once: bool) -> str:
    later = f"""later AS (SELECT era, src, dst, weight FROM e WHERE era IN ({q(order[1:])})
  AND NOT EXISTS (SELECT 1 FROM e x WHERE x.era = {q(order[:1])} AND x.src = e.src AND x.dst = e.dst))"""
    if not once:
        return f"WITH {edges(1)}, {later} SELECT * FROM later"
    place = case("era", {e: i for i, e in enumerate(order)})
    return f"""WITH {edges(1)}, {later} SELECT era, src, dst, weight FROM
  (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY {place}) AS k FROM later) WHERE k = 1"""


def components_sql(rounds: int) -> str:
    """Least labels over `rounds` steps; every edge touches a target term, so no two nodes of a component are farther apart than 2 steps a term."""
    steps = "".join(
        f""",
l{k} AS MATERIALIZED (SELECT era, node, min(lab) AS lab FROM (SELECT * FROM l{k - 1}
  UNION ALL SELECT bo.era, bo.y, l{k - 1}.lab FROM bo JOIN l{k - 1} ON l{k - 1}.era = bo.era AND l{k - 1}.node = bo.x) GROUP BY ALL)"""
        for k in range(1, rounds + 1)
    )
    return f"""WITH {edges(1)}, bo AS MATERIALIZED (SELECT era, src AS x, dst AS y FROM e UNION SELECT era, dst, src FROM e),
l0 AS MATERIALIZED (SELECT era, x AS node, min(x) AS lab FROM bo GROUP BY ALL){steps}
SELECT era, node, lab AS component FROM l{rounds}"""


def pagerank_sql(steps: int, then: str = "") -> str:
    out = """WITH e AS (SELECT c_mktsegment AS era, n_name AS src, 'p' || substr(o_orderpriority, 1, 1) AS dst, count(*) AS weight
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
nd AS (SELECT DISTINCT era, node FROM (SELECT era, src AS node FROM e UNION ALL SELECT era, dst FROM e)),
sz AS (SELECT era, count(*) AS size FROM nd GROUP BY era),
ow AS (SELECT era, src AS node, sum(weight) AS o FROM e GROUP BY ALL),
b AS (SELECT nd.era, nd.node, size, o FROM nd JOIN sz USING (era) LEFT JOIN ow USING (era, node)),
r0 AS (SELECT *, 1.0::DOUBLE / size AS rank FROM b)"""
    for k in range(1, steps + 1):
        p = f"r{k - 1}"
        out += f""",
r{k} AS MATERIALIZED (SELECT b.era, b.node, b.size, b.o, 0.15::DOUBLE / b.size + 0.85::DOUBLE * (coalesce(g.got, 0) + l.lost / b.size) AS rank FROM b
  JOIN (SELECT era, sum(CASE WHEN o IS NULL THEN rank ELSE 0 END) AS lost FROM {p} GROUP BY era) l USING (era)
  LEFT JOIN (SELECT e.era, e.dst AS node, sum(x.rank * e.weight / x.o) AS got FROM e JOIN {p} x ON x.era = e.era AND x.node = e.src GROUP BY ALL) g USING (era, node))"""
    ranks = f"SELECT era, node, round(rank, 5) AS pagerank FROM r{steps}"
    return f"{out}, pr AS ({ranks}) {then}" if then else f"{out} {ranks}"


LINES = """l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, x[i] AS line FROM
  (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)))"""
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql() -> dict[str, str]:
    out = {
        "markedness_by_doc": f"WITH {FRAMES}, m AS (SELECT doc_title, {COUNTS} FROM f GROUP BY ALL) SELECT *, {RATIOS} FROM m",
        "markedness_rollup": f"""WITH {FRAMES}, m AS (
  SELECT 'document' AS level, doc_title AS name, {COUNTS} FROM f GROUP BY doc_title
  UNION ALL SELECT 'era', v.era, {COUNTS} FROM (VALUES {", ".join(f"('{e}')" for e in ERAS)}) v(era) LEFT JOIN f ON f.era = v.era GROUP BY v.era
  UNION ALL SELECT 'total', 'all', {COUNTS} FROM f) SELECT *, {RATIOS} FROM m""",
        "strategy_targeting": f"WITH {CLASSIFIED} SELECT strategy, language, doc_year, count(*) AS n FROM (SELECT strategy, doc_year, unnest(langs) AS language FROM cl WHERE present) GROUP BY ALL",
        "targeting_asymmetry": f"""WITH {CLASSIFIED}, x AS (SELECT strategy, unnest(langs) AS language FROM cl WHERE present),
y AS (SELECT strategy, count(*) FILTER (language = 'English') AS english, count(*) AS total FROM x GROUP BY ALL)
SELECT strategy, english, total, total - english AS minority, {ratio("english", "total", "0.0")} AS english_share,
  {ratio("total - english", "total", "0.0")} AS minority_share, {ratio("total - english", "english", INF)} AS asymmetry FROM y""",
        "protection_density": f"""WITH {FRAMES}, {CLASSIFIED.replace(CHUNKS, "").lstrip(", ")},
nm AS (SELECT DISTINCT doc_title, chunk_id, language FROM f),
pr AS (SELECT DISTINCT chunk_id, language FROM (SELECT chunk_id, unnest(langs) AS language FROM cl WHERE strategy = 'predication' AND present)),
tot AS (SELECT doc_title, count(DISTINCT chunk_id) AS total_chunks FROM cl GROUP BY ALL),
g AS (SELECT doc_title, v.language FROM (SELECT DISTINCT doc_title FROM nm), (VALUES ('English'), ('Gaelic'), ('Scots')) v(language)),
k AS (SELECT nm.doc_title, nm.language, count(pr.chunk_id) AS n_both, count(*) - count(pr.chunk_id) AS n_only FROM nm LEFT JOIN pr USING (chunk_id, language) GROUP BY ALL)
SELECT g.doc_title, g.language, coalesce(n_both, 0) AS n_both, coalesce(n_only, 0) AS n_only, total_chunks, {ratio("coalesce(n_both, 0)", "total_chunks", "0.0")} AS density
FROM g LEFT JOIN k USING (doc_title, language) LEFT JOIN tot USING (doc_title)""",
        "predicate_inventory_top": f"""WITH {FRAMES}, v AS (SELECT target_term, doc_year, 'verb' AS kind, verb AS value FROM f WHERE verb IS NOT NULL
  UNION ALL SELECT target_term, doc_year, 'modifier', modifier FROM f WHERE modifier IS NOT NULL),
k AS (SELECT *, count(*) AS n FROM v GROUP BY ALL) {top("k", "target_term, doc_year, kind", "value", 10, "target_term, doc_year, kind, value, n")}""",
        "agency_summary": f"""WITH {FRAMES}, g AS (SELECT target_term, doc_year, {AGENCY} AS agency_ratio, count(*) AS total_occurrences FROM f GROUP BY ALL),
v AS (SELECT target_term, doc_year, verb, row_number() OVER (PARTITION BY target_term, doc_year ORDER BY count(*) DESC, verb) AS k FROM f WHERE verb IS NOT NULL GROUP BY target_term, doc_year, verb),
m AS (SELECT target_term, doc_year, modifier, row_number() OVER (PARTITION BY target_term, doc_year ORDER BY count(*) DESC, modifier) AS k FROM f WHERE modifier IS NOT NULL GROUP BY target_term, doc_year, modifier)
SELECT g.*, v.verb AS top_verb, m.modifier AS top_modifier FROM g
LEFT JOIN v ON v.target_term = g.target_term AND v.doc_year = g.doc_year AND v.k = 1 LEFT JOIN m ON m.target_term = g.target_term AND m.doc_year = g.doc_year AND m.k = 1""",
        "agency_weighted_era": f"""WITH {FRAMES}, g AS (
  SELECT language AS target_language, CASE {" ".join(f"WHEN doc_year BETWEEN {lo} AND {hi} THEN '{e}'" for e, (lo, hi) in ERA_RANGES.items())} ELSE 'Unknown' END AS era_range,
    target_term, {AGENCY} AS a, count(*) AS k FROM f GROUP BY ALL)
SELECT target_language, era_range, CAST(sum(k) AS BIGINT) AS n, round(sum(a * k) / sum(k), 6) AS agency_ratio FROM g GROUP BY ALL""",
        "agency_weighted_year": f"""WITH {FRAMES}, g AS (SELECT language AS target_language, doc_year, target_term, {AGENCY} AS a, count(*) AS k FROM f GROUP BY ALL)
SELECT target_language, doc_year, CAST(sum(k) AS BIGINT) AS n, round(sum(a * k) / sum(k), 6) AS agency_ratio FROM g GROUP BY ALL""",
        "strategy_profiles": f"""WITH {CLASSIFIED} SELECT doc_title, doc_year, strategy, count(*) FILTER (present) AS present_count, count(*) AS total_chunks,
  {ratio("count(*) FILTER (present)", "count(*)", "0.0")} AS prevalence,
  {ratio("coalesce(sum(CAST(round(confidence * 1000000) AS BIGINT)) FILTER (present), 0)", "count(*) FILTER (present) * 1000000", "0.0")} AS avg_confidence FROM cl GROUP BY ALL""",
        "strategy_summary": f"""WITH {CLASSIFIED}, g AS (SELECT doc_title, doc_year, strategy, count(*) FILTER (present) AS present_count, count(*) AS total_chunks,
  {ratio("count(*) FILTER (present)", "count(*)", "0.0")} AS prevalence,
  {ratio("coalesce(sum(CAST(round(confidence * 1000000) AS BIGINT)) FILTER (present), 0)", "count(*) FILTER (present) * 1000000", "0.0")} AS avg_confidence FROM cl GROUP BY ALL),
d AS (SELECT doc_title, doc_year, strategy, x, row_number() OVER (PARTITION BY doc_title, doc_year, strategy ORDER BY count(*) DESC, x) AS k FROM (SELECT *, unnest(devices) AS x FROM cl WHERE present) GROUP BY doc_title, doc_year, strategy, x),
l AS (SELECT doc_title, doc_year, strategy, x, row_number() OVER (PARTITION BY doc_title, doc_year, strategy ORDER BY count(*) DESC, x) AS k FROM (SELECT *, unnest(langs) AS x FROM cl WHERE present) GROUP BY doc_title, doc_year, strategy, x)
SELECT g.*, d.x AS top_device, l.x AS primary_target_language FROM g
LEFT JOIN d ON (d.doc_title, d.doc_year, d.strategy, d.k) = (g.doc_title, g.doc_year, g.strategy, 1) LEFT JOIN l ON (l.doc_title, l.doc_year, l.strategy, l.k) = (g.doc_title, g.doc_year, g.strategy, 1)""",
        "device_ranks": f"""WITH {CLASSIFIED}, k AS (SELECT doc_title, doc_year, strategy, device, count(*) AS n FROM (SELECT doc_title, doc_year, strategy, unnest(devices) AS device FROM cl WHERE present) GROUP BY ALL)
{top("k", "doc_title, doc_year, strategy", "device", 5, "doc_title, doc_year, strategy, device, n")}""",
        "topos_trajectory": f"""WITH {TOPOI}, {topos_by("doc_year")}
SELECT tt.*, first_value(topos) OVER (PARTITION BY doc_year ORDER BY n DESC, topos) AS dominant FROM tt""",
        "turning_points": f"""WITH {TOPOI}, {topos_by("doc_year")},
ld AS (SELECT doc_year, topos AS dominant, n AS dn FROM (SELECT *, row_number() OVER (PARTITION BY doc_year ORDER BY n DESC, topos) AS k FROM tt) WHERE k = 1),
pv AS (SELECT *, lag(dominant) OVER (ORDER BY doc_year) AS previous_dominant FROM ld),
nw AS (SELECT doc_year, string_agg(topos, ',' ORDER BY topos) AS new_topoi FROM (SELECT topos, min(doc_year) AS doc_year FROM tt GROUP BY topos) GROUP BY doc_year),
j AS (SELECT pv.*, new_topoi, o.n AS old, previous_dominant IS NOT NULL AND previous_dominant <> dominant AS changed FROM pv LEFT JOIN nw USING (doc_year)
  LEFT JOIN tt o ON o.doc_year = pv.doc_year AND o.topos = pv.previous_dominant)
SELECT doc_year, dominant, previous_dominant, new_topoi, CASE WHEN changed AND new_topoi IS NOT NULL THEN 'dominant_change_and_new_topoi' WHEN changed THEN 'dominant_topos_change' ELSE 'new_topoi_emergence' END AS turning_point,
  CASE WHEN old IS NOT NULL THEN CAST(dn - old AS DOUBLE) / greatest(dn, old, 1) END AS magnitude FROM j WHERE changed OR new_topoi IS NOT NULL""",
        "identity_timeline": f"""WITH {TOPOI}, {topos_by("era")},
x AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY n DESC, topos) AS k, sum(n) OVER (PARTITION BY era) AS total FROM tt),
y AS (SELECT era, max(topos) FILTER (k = 1) AS dominant_topos, max(topos) FILTER (k = 2) AS secondary_topos, CAST(sum(n) AS BIGINT) AS total_topoi_instances,
  round(-sum((n::DOUBLE / total) * log2(n::DOUBLE / total)), 6) AS frame_diversity, coalesce(sum(n) FILTER (topos = 'topos_of_law'), 0) AS law,
  coalesce(sum(n) FILTER (topos IN ('topos_of_culture', 'topos_of_history', 'topos_of_heritage')), 0) AS cu FROM x GROUP BY era),
z AS (SELECT era, {ratio("count(*) FILTER (present)", "count(*)", "0.0")} AS argumentation_prevalence FROM cl WHERE strategy = 'argumentation' GROUP BY era)
SELECT era, dominant_topos, secondary_topos, {ratio("law", "(law + cu)")} AS law_vs_culture_ratio, frame_diversity, argumentation_prevalence, total_topoi_instances FROM y JOIN z USING (era)""",
        "topos_language_matrix": f"""WITH {TOPOI}, x AS (SELECT unnest(topoi) AS topos, langs FROM p), y AS (SELECT topos, unnest(langs) AS language FROM x)
SELECT topos, language, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY topos) AS BIGINT) AS total FROM y GROUP BY topos, language""",
        "role_classification": f"WITH {FRAMES} SELECT doc_title, syntactic_role, dep_relation, count(*) AS n FROM f GROUP BY ALL",
        "agent_taxonomy": f"""WITH x AS (SELECT lower(p_name) AS name FROM part UNION SELECT lower(n_name) || ' council' FROM nation UNION SELECT lower(c_mktsegment) FROM customer)
SELECT name, {category_sql()} AS category FROM x""",
        "power_triangle": f"""WITH {TRIPLES}, k AS (SELECT era, language AS target_language, agent_category, count(*) AS n FROM t WHERE language IS NOT NULL AND agent_category <> 'NO_VERB' GROUP BY ALL)
SELECT *, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY era, target_language) AS DOUBLE) AS proportion FROM k""",
        "agent_backgrounding": f"WITH {TRIPLES} {back('document', 'doc_title')} UNION ALL {back('era', 'era')} HAVING era <> 'unknown'",
        "flow_counts": f"""WITH {TRIPLES}, k AS (SELECT * FROM t WHERE language IS NOT NULL AND verb IS NOT NULL),
v AS (SELECT verb FROM k GROUP BY verb ORDER BY count(*) DESC, verb LIMIT 10), x AS (SELECT * FROM k WHERE verb IN (SELECT verb FROM v)),
g AS (SELECT agent_category FROM x GROUP BY ALL HAVING count(*) >= 3 ORDER BY count(*) DESC, agent_category LIMIT 6)
SELECT 'agent_verb' AS stage, agent_category AS source, verb AS target, count(*) AS n FROM x WHERE agent_category IN (SELECT agent_category FROM g) GROUP BY ALL
UNION ALL SELECT 'verb_language', verb, language, count(*) FROM x GROUP BY ALL""",
        "strategy_classification": f"""WITH {CHUNKS}, p AS (SELECT chunk_id, doc_title, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM c),
k AS (SELECT DISTINCT doc_title, t FROM p WHERE chunk_id % 3 = 0),
x AS (SELECT p.chunk_id, p.n, k.t IS NOT NULL AS cached FROM p LEFT JOIN k ON p.t = k.t AND p.doc_title IS NOT DISTINCT FROM k.doc_title),
y AS (SELECT *, NOT cached AND n % 4 = 3 AS error, NOT cached AND n % 4 = 2 AS repaired FROM x)
SELECT chunk_id, s.strategy, NOT cached AND NOT error AND n % 8 < 4 AS present, CASE WHEN cached THEN 0.25 WHEN error THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence, error, repaired,
  CASE WHEN cached OR error THEN 0 WHEN repaired THEN 1 ELSE 2 END AS quotes, CASE WHEN cached OR error OR repaired THEN 0 ELSE 1 END AS languages,
  CASE WHEN cached THEN 'cached' WHEN error THEN 'reply can''t be parsed' WHEN repaired THEN 'Cut-off reply; fields read one by one.' ELSE 'n' END AS notes
FROM y, (VALUES {", ".join(f"('{x}')" for x in STRATEGIES)}) AS s(strategy)""",
        "svo_triples": f"""WITH {TRIPLES} SELECT target_lemma, language AS target_language, dep_relation, verb AS governing_verb, agent_text, agent_category, voice, by_phrase,
  count(*) AS n, min(md5(sentence)) AS first_md5 FROM t GROUP BY ALL""",
        "power_profiles": f"""WITH {TRIPLES}, k AS (SELECT *, language AS target_language FROM t WHERE language IS NOT NULL AND agent_category <> 'NO_VERB'),
g AS (SELECT era, target_language, count(*) AS total, count(*) FILTER (voice = 'passive') AS passive_count, count(*) FILTER (voice = 'passive' AND agent_category = 'AGENTLESS') AS agentless_count
  FROM k GROUP BY ALL),
{most_of("ag", "agent_text", "top_agents")}, {most_of("vb", "verb", "top_verbs")},
r AS (SELECT g.*, {ratio("agentless_count", "passive_count", "0.0")} AS agentless_ratio, top_agents, top_verbs FROM g LEFT JOIN ag USING (era, target_language) LEFT JOIN vb USING (era, target_language))
SELECT era, target_language, total, passive_count, agentless_count, agentless_ratio, top_agents, top_verbs FROM r
UNION ALL SELECT era, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (VALUES {", ".join(f"('{e}')" for e in ERAS)}) v(era) WHERE era NOT IN (SELECT era FROM r)""",
        "pos_stopwords": f"""WITH {FRAMES}, v AS (SELECT head AS lemma, head_pos AS pos FROM f WHERE head <> '' UNION ALL SELECT prev, child_pos FROM f WHERE prev IS NOT NULL
  UNION ALL SELECT modifier, 'ADJ' FROM f WHERE modifier IS NOT NULL), k AS (SELECT lemma, pos, count(*) AS n FROM v GROUP BY ALL)
SELECT lemma, pos, n FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, pos) AS r FROM k) WHERE r = 1 AND pos NOT IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN')""",
        "top_frames": f"""WITH {FRAMES}, x AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, target_term, head, syntactic_role ORDER BY token_idx) AS k FROM f),
y AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY {case("syntactic_role", {r: i for i, r in enumerate(ROLES)})}, token_idx) AS rank FROM x WHERE k = 1)
SELECT chunk_id, CAST(rank AS INTEGER) AS rank, token_idx, target_term, syntactic_role FROM y WHERE rank <= 15""",
        "topic_frequency": f"WITH {ASSIGNED} SELECT * FROM tf",
        "topic_trajectories": f"""WITH {ASSIGNED} SELECT topic_id, min(doc_year) AS first_year, max(doc_year) AS last_year, count(DISTINCT doc_year) AS n_periods, CAST(sum(frequency) AS BIGINT) AS total,
  arg_max(doc_year, frequency * 10000 - doc_year) AS peak_year, min(doc_year) >= 1992 AS emerging, count(DISTINCT doc_year) >= 3 AS persistent,
  max(doc_year) <= 1998 AND min(doc_year) <= 1872 AS declining FROM tf GROUP BY topic_id""",
        "topic_pivot": f"WITH {ASSIGNED} SELECT doc_year, {', '.join(f'CAST(coalesce(sum(frequency) FILTER (topic_id = {k}), 0) AS BIGINT) AS topic_id_{k}' for k in range(1, 10))} FROM tf GROUP BY doc_year",
        "topic_ctfidf": f"""WITH {CHUNKS}, t AS (SELECT jurisdiction AS topic_id, chunk_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z]+')) AS term FROM c),
d AS (SELECT topic_id, chunk_id, term, count(*) AS n FROM t GROUP BY ALL), k AS (SELECT topic_id, term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM d GROUP BY ALL),
s AS (SELECT *, sum(tf) OVER (PARTITION BY term) AS ft, sum(df) OVER (PARTITION BY term) AS docs FROM k), a AS (SELECT sum(tf)::DOUBLE / count(DISTINCT topic_id) AS a FROM k),
x AS (SELECT topic_id, term, tf, round(tf * ln(1 + a / ft::DOUBLE), 6) AS score FROM s, a WHERE docs >= 2)
SELECT topic_id, term, tf, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, term) AS rank FROM x) WHERE rank <= 10""",
        "topic_terms": f"""WITH {TOPIC_TERMS} SELECT topic_id, term, tf, CAST(rank AS INTEGER) AS rank FROM tr WHERE rank <= 10""",
        "topic_terms_reranked": f"""WITH {TOPIC_TERMS}, ct AS (SELECT topic_id, term FROM tr WHERE rank <= 30),
e AS (SELECT l.chunk_id, l.topic_id, i, CAST(round(CAST(v.embedding[i] AS DOUBLE) * 1000000) AS BIGINT) AS x FROM lb l JOIN embeddings v ON v.vec_id = l.chunk_id, range(1, 65) r(i)),
cm AS (SELECT topic_id, i, sum(x)::DOUBLE / count(*) AS c FROM e GROUP BY ALL),
tm AS (SELECT h.term, e.i, sum(e.x)::DOUBLE / count(*) AS t FROM (SELECT DISTINCT chunk_id, term FROM tt WHERE term IN (SELECT term FROM ct)) h JOIN e USING (chunk_id) GROUP BY ALL),
sc AS (SELECT topic_id, term, coalesce(round(sum(t * c) / (sqrt(sum(t * t)) * sqrt(sum(c * c))), 6), 0) AS similarity FROM ct JOIN tm USING (term) JOIN cm USING (topic_id, i) GROUP BY topic_id, term)
SELECT topic_id, term, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY similarity DESC, term) AS rank FROM sc) WHERE rank <= 10""",
        "centroids": f"WITH {ASSIGNED} SELECT doc_year, topic_id, sum(x)::DOUBLE / count(*) AS x, sum(y)::DOUBLE / count(*) AS y, count(*) AS n FROM a WHERE topic_id <> -1 GROUP BY doc_year, topic_id HAVING count(*) >= 2",
        "embedding_norm": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings",
        "strategy_pivot": f"""WITH {CLASSIFIED}, g AS (SELECT doc_title, doc_year, strategy, {ratio("count(*) FILTER (present)", "count(*)", "0.0")} AS prevalence FROM cl GROUP BY ALL)
SELECT doc_year, {", ".join(f"coalesce(arg_min(prevalence, doc_title) FILTER (strategy = '{s}'), 0.0) AS {s}" for s in STRATEGIES)} FROM g GROUP BY doc_year""",
        "edge_weights": f"WITH {edges(1)} SELECT era, src, dst, weight, relations FROM e",
        "weighted_degree": f"WITH {edges(1)} SELECT * FROM dg",
        "graph_density": f"""WITH {edges(1)} SELECT era, nodes, edges, {ratio("edges", "(nodes * (nodes - 1))", "0.0")} AS density FROM
  (SELECT era, count(*) AS nodes FROM dg GROUP BY era) JOIN (SELECT era, count(*) AS edges FROM e GROUP BY era) USING (era)""",
        "emerging_edges": emerging(sorted(ERAS), False),
        "emerging_edges_chronological": emerging(list(ERAS), True),
        "centrality_fill": f"""WITH {edges(1)} SELECT n.node, v.era, coalesce(dg.total_degree, 0) AS total_degree FROM (SELECT DISTINCT node FROM dg) n
CROSS JOIN (VALUES {", ".join(f"('{e}')" for e in ERAS)}) v(era) LEFT JOIN dg ON dg.node = n.node AND dg.era = v.era""",
        "bridge_nodes": f"""WITH e AS (SELECT l_returnflag AS era, 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL),
dg AS (SELECT era, node, CAST(sum(w) AS BIGINT) AS total_degree FROM (SELECT era, src AS node, weight AS w FROM e UNION ALL SELECT era, dst, weight FROM e) GROUP BY ALL), tp AS (SELECT era, node FROM (SELECT *, row_number() OVER (PARTITION BY era ORDER BY total_degree DESC, node) AS k FROM dg) WHERE k <= 15),
bo AS (SELECT era, src AS x, dst AS y FROM e UNION SELECT era, dst, src FROM e),
nr AS (SELECT bo.* FROM bo JOIN tp ON tp.era = bo.era AND tp.node = bo.x WHERE NOT EXISTS (SELECT 1 FROM tp z WHERE z.era = bo.era AND z.node = bo.y)),
pa AS (SELECT l.era, l.x AS a, r.x AS b, l.y FROM nr l JOIN nr r ON l.era = r.era AND l.y = r.y AND l.x < r.x
  WHERE NOT EXISTS (SELECT 1 FROM bo WHERE bo.era = l.era AND bo.x = l.x AND bo.y = r.x))
SELECT era, a, b, bridge, score FROM (SELECT pa.era, a, b, pa.y AS bridge, total_degree AS score, row_number() OVER (PARTITION BY pa.era, a, b ORDER BY total_degree DESC, pa.y) AS k
  FROM pa JOIN dg ON dg.era = pa.era AND dg.node = pa.y) WHERE k = 1""",
        "connected_components": components_sql(8),
        "pagerank_k": pagerank_sql(10),
        "clean_lines": f"""WITH {LINES}, b AS (SELECT * FROM l WHERE NOT regexp_matches(line, '^(The\\s|Copyright)')),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM b), s AS (SELECT * FROM p WHERE k > 1),
t AS (SELECT *, k - 2 AS place, count(*) OVER (PARTITION BY doc_id) AS n, trim(line, {BLANKS}) AS tl FROM s),
h AS (SELECT *, coalesce(min(CASE WHEN regexp_matches(tl, '^[A-Z][a-z]+\\.\\s*$') AND place > greatest(n - 40, 0) THEN place END) OVER (PARTITION BY doc_id), n) AS cut FROM t),
z AS (SELECT *, max(CASE WHEN tl <> '' AND place < cut THEN place END) OVER (PARTITION BY doc_id) AS last FROM h)
SELECT doc_id, count(*) AS lines, min(line_no) AS first_line, max(line_no) AS last_line, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5 FROM z WHERE cut >= n OR place <= coalesce(last, -1) GROUP BY doc_id""",
        "blank_collapse": f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '([.]) ', '\\1' || chr(10) || chr(10) || chr(10), 'g'), '[ \\t\\r\\f\\v]+(\\n)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {BLANKS})) AS text_md5 FROM documents""",
        "ocr_fix": "SELECT doc_id, md5(" + "replace(" * len(OCR_PAIRS) + "replace(text, 'that', 'tbat')" + "".join(f", '{a}', '{b}')" for a, b in OCR_PAIRS.items()) + ") AS text_md5 FROM documents",
        "hyphen_rejoin": """SELECT doc_id, length(t) AS n, md5(t) AS text_md5 FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '(th)([a-z])', '\\1-' || chr(10) || '\\2', 'g'), '-\\n([a-z])', '\\1', 'g') AS t FROM documents)""",
        "sections": f"""WITH {LINES}, s AS (SELECT *, trim(line, {BLANKS}) AS t FROM l),
h AS (SELECT *, regexp_matches(t, '^[A-Z][a-z]{{1,3}}\\s') AS hit, trim(regexp_extract(t, '^[A-Z][a-z]{{1,3}}\\s'), {BLANKS}) AS mark FROM s),
o AS (SELECT *, hit OR (t <> '' AND coalesce(max(CASE WHEN hit OR t <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0) AS op,
  lead(t) OVER (PARTITION BY doc_id ORDER BY line_no) AS nx FROM h),
q AS (SELECT *, CAST(sum(CASE WHEN op THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS section_seq,
  CASE WHEN hit THEN coalesce(nullif(trim(substr(t, length(mark) + 1), {BLANKS}), ''), nullif(nx, ''), mark) ELSE 'Preamble' END AS ti FROM o)
SELECT doc_id, section_seq, max(CASE WHEN op THEN CASE WHEN hit THEN mark ELSE 'preamble' END END) AS section_id, max(CASE WHEN op THEN substr(ti, 1, 100) END) AS section_title,
  min(line_no) AS start_line, max(line_no) AS end_line, md5(trim(string_agg(line, chr(10) ORDER BY line_no), {BLANKS})) AS text_md5 FROM q WHERE section_seq > 0 GROUP BY ALL
UNION ALL SELECT doc_id, 1, 'full', 'Full Document', 0, max(line_no), md5('') FROM s GROUP BY doc_id HAVING max(length(t)) = 0""",
        "corpus_summary": f"""WITH {CHUNKS}, x AS (SELECT doc_title, len(regexp_extract_all(text, '[A-Za-z]+')) AS k FROM c)
SELECT doc_title, count(*) AS chunks, CAST(sum(k) AS BIGINT) AS tokens, {ratio("sum(k)", "count(*)", "0.0")} AS avg_tokens FROM x GROUP BY doc_title""",
        "prompt_hash": f"WITH {CHUNKS} SELECT chunk_id, sha256('[' || doc_title || '] ' || text) AS prompt_sha FROM c",
        "prompt_cache_antijoin": f"""WITH {CHUNKS}, p AS (SELECT chunk_id, sha256(text) AS prompt_sha FROM c)
SELECT prompt_sha, count(*) AS rows, min(chunk_id) AS first_chunk FROM p WHERE prompt_sha NOT IN (SELECT prompt_sha FROM p WHERE chunk_id % 3 = 0) GROUP BY prompt_sha""",
        "chunk_strategy_cross": f"WITH {CHUNKS} SELECT doc_title, strategy, count(*) AS n FROM c CROSS JOIN (VALUES {', '.join(f'({s!r})' for s in STRATEGIES)}) v(strategy) GROUP BY ALL",
        "distinct_map_join": f"WITH {FRAMES} SELECT head AS sentence, upper(head) AS mapped, count(*) AS n FROM f WHERE syntactic_role = 'patient' GROUP BY ALL",
        "json_props": """SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS top FROM
  (SELECT event_type, TRY_CAST(regexp_extract(props, '"k":\\s*(-?[0-9]+)', 1) AS INTEGER) AS k FROM events) GROUP BY event_type""",
        "event_turning_points": """WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL),
l AS (SELECT day, event_type AS dominant, n FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) AS k FROM d) WHERE k = 1),
p AS (SELECT *, lag(dominant) OVER (ORDER BY day) AS previous FROM l)
SELECT CAST(day AS VARCHAR) AS day, dominant, previous, n FROM p WHERE previous IS NULL OR previous <> dominant""",
        "flagged_sentences": f"""WITH {TRIPLES}, x AS (SELECT doc_title, sentence, lower(sentence) AS low, row_number() OVER (PARTITION BY doc_title ORDER BY chunk_id, sent_id, token_idx) AS k
  FROM t WHERE voice = 'passive' AND agent_category = 'AGENTLESS' AND (contains(lower(sentence), 'and') OR contains(lower(sentence), 'in')))
SELECT doc_title, CAST(k AS INTEGER) AS rank, substr(sentence, 1, 200) AS sentence,
  array_to_string(list_filter([CASE WHEN contains(low, 'and') THEN 'and' END, CASE WHEN contains(low, 'in') THEN 'in' END], lambda z: z IS NOT NULL), ',') AS terms FROM x WHERE k <= 5""",
        "terms_in_context": """SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(n, 'and') THEN 'and' END, CASE WHEN contains(n, 'ore') THEN 'ore' END,
  CASE WHEN contains(n, 'then') THEN 'then' END, CASE WHEN contains(n, 'thin') THEN 'thin' END], lambda x: x IS NOT NULL), ',') AS terms FROM (SELECT doc_id, lower(text) AS n FROM documents)""",
        "topos_ranks": f"""WITH {CLASSIFIED}, k AS (SELECT doc_title, doc_year, strategy, topos, count(*) AS n FROM (SELECT doc_title, doc_year, strategy, unnest(topoi) AS topos FROM cl WHERE present) GROUP BY ALL)
{top("k", "doc_title, doc_year, strategy", "topos", 5, "doc_title, doc_year, strategy, topos, n")}""",
        "role_histogram": f"WITH {FRAMES} SELECT syntactic_role AS value, count(*) AS n FROM f GROUP BY ALL",
        "topic_summary": f"""WITH {ASSIGNED}, x AS (SELECT topic_id, min(doc_year) AS a, max(doc_year) AS z, count(DISTINCT doc_year) AS k FROM tf GROUP BY topic_id)
SELECT count(*) AS topics, count(*) FILTER (a >= 1992) AS emerging, count(*) FILTER (k >= 3) AS persistent, count(*) FILTER (z <= 1998 AND a <= 1872) AS declining FROM x""",
        "targeting_rollup": f"WITH {CLASSIFIED} SELECT strategy, language, doc_year, count(*) AS n FROM (SELECT strategy, doc_year, unnest(langs) AS language FROM cl WHERE present) GROUP BY ROLLUP (strategy, language, doc_year)",
        "first_titles": f"WITH {CHUNKS} SELECT doc_year, min(chunk_id) AS chunk_id, arg_min(doc_title, chunk_id) AS doc_title FROM c GROUP BY doc_year",
        "diverging": f"""WITH {CLASSIFIED}, x AS (SELECT strategy, unnest(langs) AS language FROM cl WHERE present),
y AS (SELECT strategy, count(*) FILTER (language = 'English') AS e, count(*) FILTER (language <> 'English') AS m FROM x GROUP BY ALL)
SELECT strategy, -e AS english, m AS minority, {ratio("m", "e", INF)} AS ratio FROM y""",
        "streamgraph": f"""WITH {TOPOI}, {topos_by("doc_year")} SELECT y.doc_year, v.topos, coalesce(tt.proportion, 0.0) AS proportion FROM (SELECT DISTINCT doc_year FROM tt) y
CROSS JOIN (VALUES {", ".join(f"('topos_of_{t}')" for t in CUES.topoi)}) v(topos) LEFT JOIN tt ON tt.doc_year = y.doc_year AND tt.topos = v.topos""",
        "centrality_shift": f"""WITH {edges(1)}, g AS (SELECT n.node, v.era, v.o, coalesce(dg.total_degree, 0) AS total_degree FROM (SELECT DISTINCT node FROM dg) n
CROSS JOIN (VALUES {", ".join(f"('{e}', {i})" for e, i in ERA_ORD.items())}) v(era, o) LEFT JOIN dg ON dg.node = n.node AND dg.era = v.era)
SELECT node, era, total_degree, total_degree - coalesce(lag(total_degree) OVER (PARTITION BY node ORDER BY o), 0) AS shift FROM g""",
        "virtual_edges": """WITH p AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT r_name, least(min(n_name), r_name) AS comp, count(*) + 1 AS size, CASE WHEN count(*) > 1 THEN r_name ELSE greatest(min(n_name), r_name) END AS hub FROM p GROUP BY r_name),
m AS (SELECT * FROM x ORDER BY size DESC, comp LIMIT 1)
SELECT 'all' AS era, m.hub AS src, x.hub AS dst, 'virtual' AS kind FROM x, m WHERE x.comp <> m.comp""",
        "topos_levels": f"""WITH {TOPOI}, sz AS (SELECT doc_year, era, count(DISTINCT chunk_id) AS total_chunks, count(*) FILTER (strategy = 'argumentation' AND present) AS args FROM cl GROUP BY ALL),
i AS (SELECT doc_year, era, unnest(topoi) AS topos FROM p),
ln AS (SELECT DISTINCT 'year' AS level, coalesce(CAST(doc_year AS VARCHAR), 'unknown') AS name FROM i UNION ALL SELECT 'total', 'all'
  UNION ALL SELECT 'era', era FROM (VALUES {", ".join(f"('{e}')" for e in ERAS)}) v(era)),
k AS (SELECT ln.level, ln.name, topos, count(*) AS n FROM ln JOIN i ON ln.level = 'total' OR ln.level = 'era' AND ln.name = era OR ln.level = 'year' AND ln.name = coalesce(CAST(doc_year AS VARCHAR), 'unknown') GROUP BY ALL),
g AS (SELECT ln.level, ln.name, CAST(coalesce(sum(total_chunks), 0) AS BIGINT) AS total_chunks, CAST(coalesce(sum(args), 0) AS BIGINT) AS argumentation_present FROM ln
  LEFT JOIN sz ON ln.level = 'total' OR ln.level = 'era' AND ln.name = era OR ln.level = 'year' AND ln.name = coalesce(CAST(doc_year AS VARCHAR), 'unknown') GROUP BY ALL),
d AS (SELECT *, first_value(topos) OVER (PARTITION BY level, name ORDER BY n DESC, topos) AS dominant, CAST(sum(n) OVER (PARTITION BY level, name) AS BIGINT) AS total_instances FROM k)
SELECT g.*, topos, n, dominant, coalesce(total_instances, 0) AS total_instances, {ratio("n", "argumentation_present")} AS proportion FROM g LEFT JOIN d USING (level, name)""",
        "identity_evidence": f"""WITH {TOPOI}, {topos_by("era")}, ld AS (SELECT era, topos, CAST(row_number() OVER (PARTITION BY era ORDER BY n DESC, topos) AS INTEGER) AS frame FROM tt),
x AS (SELECT p.era, p.chunk_id, c.text, unnest(p.topoi) AS topos FROM p JOIN c USING (chunk_id) WHERE length(c.text) > 0),
y AS (SELECT x.*, frame, CAST(row_number() OVER (PARTITION BY era, topos ORDER BY chunk_id) AS INTEGER) AS place FROM x JOIN ld USING (era, topos) WHERE frame <= 2)
SELECT era, frame, topos, place, chunk_id, md5(substr(text, 1, 200)) AS quote_md5 FROM y WHERE place <= 2""",
        "titled_profiles": f"""WITH {CLASSIFIED}, on_ AS (SELECT * FROM cl WHERE present),
g AS (SELECT doc_title, strategy, count(*) FILTER (present) AS present_count, count(*) AS total_chunks, {ratio("count(*) FILTER (present)", "count(*)", "0.0")} AS prevalence,
  {ratio("coalesce(sum(CAST(round(confidence * 1000000) AS BIGINT)) FILTER (present), 0)", "(count(*) FILTER (present) * 1000000)", "0.0")} AS avg_confidence FROM cl GROUP BY ALL),
{", ".join(listed_sql(*x) for x in (("dv", "devices", "top_devices", 5, ""), ("lg", "langs", "languages", 99, ""), ("tp", "topoi", "top_topoi", 5, "WHERE strategy = 'argumentation'")))},
inf AS (SELECT doc_title, arg_min(doc_year, chunk_id) AS doc_year, arg_min(jurisdiction, chunk_id) AS jurisdiction, count(*) AS num_chunks FROM c GROUP BY doc_title)
SELECT g.*, top_devices, languages, top_topoi, doc_year, jurisdiction, num_chunks FROM g LEFT JOIN dv USING (doc_title, strategy) LEFT JOIN lg USING (doc_title, strategy)
  LEFT JOIN tp USING (doc_title, strategy) LEFT JOIN inf USING (doc_title)""",
        "last_years": f"WITH {CHUNKS} SELECT doc_title, max(chunk_id) AS chunk_id, arg_max(doc_year, chunk_id) AS doc_year, arg_max(era, chunk_id) AS era FROM c GROUP BY doc_title",
        "centrality_table": pagerank_sql(10, """, dg AS (SELECT era, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS total_degree
  FROM (SELECT era, src AS node, 0 AS i, weight AS o FROM e UNION ALL SELECT era, dst, weight, 0 FROM e) GROUP BY ALL)
SELECT era, node, in_degree, out_degree, total_degree, pagerank, CAST(row_number() OVER (PARTITION BY era ORDER BY pagerank DESC, node) AS INTEGER) AS place FROM dg JOIN pr USING (era, node)"""),
        "pagerank_shift": pagerank_sql(10, """, x AS (SELECT n.node, v.era, coalesce(pr.pagerank, 0.0) AS pagerank FROM (SELECT DISTINCT node FROM pr) n
  CROSS JOIN (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) v(era) LEFT JOIN pr ON pr.node = n.node AND pr.era = v.era)
SELECT node, era, pagerank, round(pagerank - coalesce(lag(pagerank) OVER (PARTITION BY node ORDER BY era), 0), 5) AS shift FROM x"""),
        "prompt_texts": f"""WITH {FRAMES}, x AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, target_term, head, syntactic_role ORDER BY token_idx) AS k FROM f),
y AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY {case("syntactic_role", {r: i for i, r in enumerate(ROLES)})}, token_idx) AS rank FROM x WHERE k = 1),
z AS (SELECT chunk_id, string_agg('- "' || target_term || '" as ' || upper(syntactic_role) || '(dep: ' || dep_relation || coalesce(', verb: ' || verb, '') || ')'
  || coalesce(' [modifiers: ' || modifier || ']', ''), chr(10) ORDER BY rank) AS frames FROM y WHERE rank <= 15 GROUP BY chunk_id)
SELECT chunk_id, sha256(concat_ws(chr(10) || chr(10), 'Document: ' || doc_title || ' (' || doc_year || ')', 'Dependency frames:' || chr(10) || frames, 'Which strategies occur?',
  'Text:' || chr(10) || text, 'Reply with JSON.')) AS prompt_sha, CAST(length(frames) AS INTEGER) AS frames_chars FROM c LEFT JOIN z USING (chunk_id)""",
        "tolerant_json_repair": f"""WITH {CHUNKS}, r AS (SELECT chunk_id, chunk_id % 4 AS k, length(substr(regexp_replace(text, '[^a-z ]', '', 'g'), 1, 30)) AS q FROM c),
x AS (SELECT *, k < 3 AND q IS NOT NULL AS parsed FROM r)
SELECT chunk_id, parsed, CASE WHEN parsed THEN true END AS present, CASE WHEN parsed THEN 0.8::DOUBLE END AS confidence, parsed AND k = 2 AS repaired,
  CASE WHEN NOT parsed THEN NULL WHEN k = 2 THEN CASE WHEN q > 5 THEN 1 ELSE 0 END ELSE 2 END AS quotes FROM x""",
        "boundary_sections": f"""WITH {LINES}, f AS (SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '^[A-Z][a-z]{{0,5}}[.]')),
k AS (SELECT doc_id, unnest(list_reduce(list([line_no] ORDER BY line_no), lambda a, x: CASE WHEN x[1] - a[-1] >= 3 THEN list_concat(a, x) ELSE a END)) AS line_no FROM f GROUP BY doc_id),
m AS (SELECT l.*, k.line_no IS NOT NULL AS opens FROM l LEFT JOIN k USING (doc_id, line_no)),
s AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS section_seq FROM m)
SELECT doc_id, section_seq, max(CASE WHEN opens THEN substr(line, 1, 20) END) AS section_id, min(line_no) AS start_line, max(line_no) AS end_line FROM s WHERE section_seq > 0 GROUP BY ALL""",
        "topic_heatmap": f"""WITH {ASSIGNED} SELECT topic_id, doc_year, frequency, CASE topic_id WHEN 1 THEN 'law, act' WHEN 2 THEN 'tongue' ELSE 'Topic ' || topic_id END AS label FROM tf""",
    }
    densities = ", ".join(f"coalesce(max(density) FILTER (language = '{x}'), 0.0) AS {x.lower()}_density" for x in ("English", "Gaelic", "Scots"))
    out["markedness_density"] = f"""SELECT m.*, english_density, gaelic_density, scots_density FROM ({out["markedness_by_doc"]}) m
LEFT JOIN (SELECT doc_title, {densities} FROM ({out["protection_density"]}) GROUP BY doc_title) d USING (doc_title)"""

    def part(name: str, label: str, source: str, columns: list[str]) -> str:
        return " UNION ALL ".join(f"SELECT '{name}' AS part, {label} AS name, '{c}' AS measure, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns)

    stop = out["pos_stopwords"].replace("'ADV', 'PROPN')", "'ADV', 'PROPN', 'ADP', 'DET')")
    out["plot_network"] = f"""WITH {edges(1)}, st AS ({stop}), kn AS (SELECT * FROM dg WHERE NOT regexp_matches(node, '^\\W*$') AND node NOT IN (SELECT lemma FROM st)),
tp AS (SELECT era, node FROM (SELECT *, row_number() OVER (PARTITION BY era ORDER BY total_degree DESC, node) AS k FROM kn) WHERE k <= 15),
bo AS (SELECT era, src AS x, dst AS y FROM e UNION SELECT era, dst, src FROM e),
nr AS (SELECT bo.* FROM bo JOIN tp ON tp.era = bo.era AND tp.node = bo.x WHERE NOT EXISTS (SELECT 1 FROM tp z WHERE z.era = bo.era AND z.node = bo.y)),
pa AS (SELECT l.era, l.x AS a, r.x AS b, l.y FROM nr l JOIN nr r ON l.era = r.era AND l.y = r.y AND l.x < r.x
  WHERE NOT EXISTS (SELECT 1 FROM bo WHERE bo.era = l.era AND bo.x = l.x AND bo.y = r.x)),
br AS (SELECT era, a, b, bridge FROM (SELECT pa.era, a, b, pa.y AS bridge, row_number() OVER (PARTITION BY pa.era, a, b ORDER BY total_degree DESC, pa.y) AS k
  FROM pa JOIN kn ON kn.era = pa.era AND kn.node = pa.y) WHERE k = 1)
SELECT e.era, src, dst, weight, 'relation' AS kind FROM e JOIN tp a ON a.era = e.era AND a.node = src JOIN tp b ON b.era = e.era AND b.node = dst
UNION ALL SELECT DISTINCT era, src, dst, CAST(0 AS BIGINT), 'bridge' FROM (SELECT era, a AS src, bridge AS dst FROM br UNION ALL SELECT era, b, bridge FROM br)"""
    low = ("english", "gaelic", "scots")
    counts = ", ".join(f"count(*) FILTER (language = '{x.capitalize()}') AS {x}_count" for x in low)
    share = ratio("english_count", "(english_count + gaelic_count + scots_count)", "0.0")
    out["markedness_profile"] = f"""WITH tt AS ({out["markedness_rollup"]}), ta AS ({out["targeting_asymmetry"]}), de AS (SELECT doc_title, {densities} FROM ({out["protection_density"]}) GROUP BY doc_title),
pd AS (SELECT *, {share} AS english_share FROM (SELECT {counts} FROM (WITH {CLASSIFIED} SELECT unnest(langs) AS language FROM cl WHERE present AND strategy = 'predication')))
{part("total", "'all'", "tt WHERE level = 'total'", [*[f"{x}_mentions" for x in low], "markedness_ratio", "english_invisibility_index"])}
UNION ALL {part("predication", "'all'", "pd", [*[f"{x}_count" for x in low], "english_share"])}
UNION ALL {part("targeting", "strategy", "ta", ["english_share", "minority_share", "asymmetry"])}
UNION ALL {part("density", "doc_title", "de", [f"{x}_density" for x in low])}"""
    return out
