"""The training-data operators against brute force, on the smallest tables and on odd rows."""

import collections
import hashlib
import html
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from lexmill.llm import chunkstore, mixing, multiset, packing, partenum, queries, secrets, sharding, toxicity, url_rules, wrapper

SQL = queries.oracle_sql()
#: Extra columns whose names the operators use themselves.
CLASHES = "row int, size int, blob string, found string, digest string, epoch int, part int, media string, bucket int, host string, tokens int, sid int, label string"
NO_DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def odd_rows():
    long = " ".join(f"w{i}" for i in range(30000))
    texts = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "One  two"), (None, "one two"), (5, long), (6, long + " w"), (7, " \t\n"), (8, "é\u00a0x password=abcdef1")]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "src1", len(t or ""), *[0 if c.endswith("int") else "x" for c in CLASHES.split(", ")]) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), NO_DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], NO_DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert compare.differences(queries.queries()[name](spark, sf_dir), compare.connection(sf_dir), SQL[name]) == ""


# ---- media chunks


def payload(text):
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def check_media(rows, texts):
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(i) for i, _ in texts)
    want = collections.Counter()
    for i, t in texts:
        p = payload(t)
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert len({(r["payload_sha256"], r["media_sha256"], r["media_bytes"], r["feature"]) for r in rows}) == len({r["payload_sha256"] for r in rows})


def test_media_round_trip(spark, docs):
    check_media(chunkstore.media_columns(spark, docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_media_odd_rows(spark, odd, none, monkeypatch):
    texts = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    check_media(chunkstore.media_columns(spark, odd).collect(), texts)
    monkeypatch.setattr(chunkstore, "HOT", 2)  # every shared digest is salted
    many = odd.unionByName(odd.where("doc_id = 5").withColumn("text", F.concat("text", F.lit(" tail one"))))
    many = many.unionByName(many.withColumn("text", F.concat("text", F.lit(" tail two"))))
    check_media(chunkstore.media_columns(spark, many).collect(), [tuple(r) for r in many.select("doc_id", "text").collect()])
    assert chunkstore.media_columns(spark, none).count() == 0


def test_an_edit_moves_few_cuts():
    data = np.random.default_rng(0).integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    pieces = lambda d: {d[a:b] for a, b in zip([0, *chunkstore.cuts(d)], chunkstore.cuts(d), strict=False)}
    before, after = pieces(data), pieces(data[:90_000] + b"new words" + data[90_000:])
    assert len(before & after) >= len(before) - 4
    assert b"".join(data[a:b] for a, b in zip([0, *chunkstore.cuts(data)], chunkstore.cuts(data), strict=False)) == data


# ---- url rules

URLS = [None, "", "no scheme", "http://A.Net/es/x?y=1#z", "https://www.example.com/en/1", "http://xcom/", "ftp://a.b.com", "x://y://com/"]


def test_urls_odd_rows(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(0, None, "h", "r"), (None, URLS[3], "h", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = {(r["page_id"], r["host"], r["path"]): (r["rule"], r["verdict"]) for r in url_rules.judge(spark, pages).collect()}
    assert got[3, "a.net", "/es/x"] == ("net/es/", "block") and got[4, "www.example.com", "/en/1"] == ("www.example.com/en/", "allow")
    assert got[0, "", ""] == (None, "allow") and got[5, "xcom", "/"][0] is None and got[6, "a.b.com", ""][0] is None
    assert got[7, "y:", "//com/"][0] is None and len(got) == 9
    assert url_rules.judge(spark, pages.limit(0)).count() == 0


# ---- shards


def test_place_is_a_permutation():
    for n in (1, 2, 5, 100, 257):
        slots = {sharding.place(r, n, 8, 3) for r in range(n)}
        sizes = collections.Counter(s for s, _ in slots)
        assert len(slots) == n and all({k for s, k in slots if s == x} == set(range(c)) for x, c in sizes.items())
        assert max(sizes.values()) - min(list(sizes.values()) + [0] * (n < 8)) <= 1


def test_shards_odd_rows(spark, odd, none):
    rows = sharding.shard(odd, 8, 3).collect()
    assert len(rows) == 10 and len({(r["shard"], r["slot"]) for r in rows}) == 10
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]))
    assert sorted((r["shard"], r["slot"]) for r in order) == sorted(sharding.place(i, 10, 8, 3) for i in range(10))
    assert sharding.shard(none).count() == 0


# ---- n-gram join


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_components(rows, width, num, den):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return collections.Counter((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))


def found_components(spark, df, *args):
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.components(spark, df, *args).collect())


@pytest.mark.parametrize("args", [(4, 85, 100), (5, 80, 100), (3, 50, 100)])
def test_join_same_as_brute_force(spark, docs, args):
    assert found_components(spark, docs, *args) == brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()], *args)


def test_join_deals_hot_signatures_to_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(partenum, "HOT", 1)
    assert found_components(spark, docs, 4, 85, 100) == brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()], 4, 85, 100)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: i % 60], f"x{i}", *words[i % 60 + 1 :]])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_components(spark, df, 4, 85, 100) == brute_components(rows, 4, 85, 100)


def test_join_finds_links_only_by_other_members(spark):
    """A long chain of edits: neighbours are similar, the ends are not."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words[i * 3] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_components(spark, df, 4, 85, 100) == brute_components(rows, 4, 85, 100)


def test_join_odd_rows(spark, odd, none):
    got = found_components(spark, odd, 4, 85, 100)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert got == brute_components(rows, 4, 85, 100)
    assert partenum.components(spark, none).count() == 0
    kept = partenum.keep_one(spark, odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [1, 2, 3, 3, None, 5, 7, 8]))


def test_signatures_meet_for_all_similar_sets():
    rng = np.random.default_rng(1)
    for n in (1, 3, 7, 20, 60, 200, 900):
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for _ in range(20):
            drop = rng.integers(0, max(1, int(0.081 * n)) + 1)
            other = np.unique(np.r_[base[drop:], rng.integers(0, 2**63, rng.integers(0, drop + 1)).astype(np.uint64)])
            same = len(np.intersect1d(base, other))
            if 100 * same < 85 * (len(base) + len(other) - same):
                continue
            sig, owner = partenum.signatures(np.r_[base, other], np.array([0, len(base), len(base) + len(other)]), 85, 100)
            assert set(sig[owner == 0]) & set(sig[owner == 1])


# ---- mixing


def test_mix_odd_rows(spark, odd, none):
    got = mixing.mix(spark, odd, F.lit("d"), budget_permille=1000).collect()
    assert sum(r["taken"] for r in got) in range(60000, 60020)
    assert mixing.mix(spark, none, F.lit("d")).count() == 0
    kept = mixing.mix_documents(spark, odd, F.lit("d"), budget_permille=1000, max_epochs=1)
    assert kept.columns == odd.columns and kept.count() == 10
    assert mixing.mix_documents(spark, none, F.lit("d")).count() == 0


def test_shortages_go_to_siblings_before_ancestors(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [(i, "a", "x", text(10)) for i in range(2)] + [(10 + i, "a", "y", text(10)) for i in range(20)] + [(40 + i, "b", "x", text(10)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    got = mixing.mix(spark, df, levels=("lang", "source"), budget_permille=500, max_epochs=1).groupBy("lang", "source").sum("taken").collect()
    # the budget of 310 gives each language 155; a/x has 20, so a/y gets the rest of a's
    assert {(r[0], r[1]): r[2] for r in got} == {("a", "x"): 20, ("a", "y"): 135, ("b", "x"): 155}


def test_epochs_repeat_and_are_whole(spark):
    df = spark.createDataFrame([(i, "a", "x", "w w w") for i in range(5)] + [(9, "b", "y", " ".join("w" * 45))], "doc_id long, lang string, source string, text string")
    got = mixing.mix(spark, df, levels=("lang",), weights={"lang": {"a": 3}}, budget_permille=1000, max_epochs=3).collect()
    counts = collections.Counter(r["doc_id"] for r in got if r["lang"] == "a")
    assert set(counts.values()) == {3} and sum(r["taken"] for r in got) == 60


# ---- fingerprints


def check_fingerprints(rows, texts):
    order = sorted(((i, t or "") for i, t in texts), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        changed = multiset.edited(t, order[(k + 1) % len(order)][1])
        mark, other = multiset.fingerprints([t, changed])
        want[i, len(t), hashlib.sha256(changed.encode()).hexdigest(), mark, other] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in rows) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_fingerprints(spark, docs, odd, none):
    rows = multiset.document_fingerprints(spark, docs).collect()
    check_fingerprints(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.95
    check_fingerprints(multiset.neighbours(odd, 3).mapInArrow(multiset.walk, multiset.OUT_SQL).collect(), [tuple(r) for r in odd.select("doc_id", "text").collect()])
    check_fingerprints(multiset.document_fingerprints(spark, odd).collect(), [tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert multiset.document_fingerprints(spark, none).count() == 0


def test_fingerprints_are_homomorphic():
    lines = ["the first line here", "a", "the second line is longer", "a"]
    whole = multiset.fingerprints(["\n".join(lines)])[0]
    assert multiset.fingerprints(["\n".join(reversed(lines))])[0] == whole
    part = multiset.fingerprints(["\n".join(lines[:3])])[0]
    assert part != whole and multiset.insert(part, "a") == whole and multiset.delete(whole, "a") == part


# ---- toxicity


def test_toxicity_learns_words_and_pairs(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(3000):
        words = [f"w{k}" for k in rng.integers(0, 200, 30)]
        kind = i % 6
        words += {0: ["idiot"], 1: ["group", "vile"], 2: ["group"], 3: ["vile"]}.get(kind, [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind in (0, 1))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score(spark, docs, toxicity.learn(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    held = [(r["predicted"], dict(labels)[r["doc_id"]]) for r in got if r["held_out"]]
    assert {r["doc_id"] for r in got if r["held_out"]} == {i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([a == b for a, b in held]) > 0.97


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1), (99, 0)], "doc_id long, toxic int")
    model = toxicity.learn(spark, odd, labels)
    rows = toxicity.score(spark, odd, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(spark, none, toxicity.learn(spark, none, labels.limit(0))).count() == 0
    assert toxicity.keep_clean(spark, odd, toxicity.Model(0.0, np.zeros(0, np.int64))).count() == 10


# ---- wrappers


def plain_article(page):
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    text = re.sub(r"</?(?:p|h1)>", "\1", (m[1] if m else "").replace("<br>", " "))
    blocks = re.sub(r"<[^>]+>", "", text).split("\1")
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark, pages).collect()}
    assert got == {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b <i>c</i>d<div class='sidebar'>no</div><p>e", "a\nb cd\ne"),
        ("<body><div id=comments><p>no</div><h2>t</h2><ul><li>x<li>y</ul><script>if (a<b) '</p>'</script>", "t\nx\ny"),
        ("<main><form>no</form>yes<!-- no --></main>outside", "yes"),
        ("<div>open <b>never closed", "open never closed"),
        ("<p>1 < 2 &lt; 3<table><tr><td>a<td>b</table>", "1 < 2 < 3\na\nb"),
    ],
)
def test_markup(page, text):
    assert wrapper.main_text(page) == text


def test_constant_texts_are_template(spark):
    page = lambda i: f"<div><p>Follow us everywhere</p><section><p>story {i}</p><p>more {i}</p></section><p>All rights reserved</p></div>"
    rows = [(i, f"http://a.b/{i}", page(i), "x") for i in range(30)] + [(99, None, None, "x"), (30, "http://a.b/1", page(1), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark, pages).collect()}
    assert got[5] == "story 5\nmore 5" and got[99] == "" and got[30] == got[1]
    assert wrapper.extract(spark, pages.limit(0)).count() == 0


def test_tree_matching():
    a, b = (wrapper.fold(wrapper.parse(x).root) for x in ("<div><p>1</p><ul><li>x</ul><p>2</p></div>", "<div><p>1</p><p>2</p></div>"))
    assert wrapper.match(a, a) == 6 and wrapper.match(a, b) == 3


# ---- secrets


def brute_spans(text):
    text, out = text or "", []
    for order, (kind, pattern, group, least) in enumerate(
        [
            ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20),
            ("hex", r"[0-9a-f]+", 0, 24),
        ]
    ):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(out))


SECRETS = [
    "password: token: abcdefgh", "TOKEN=secret=abcdefgh é api-key", "xx AKIA" + "A1" * 9 + " AKIAB AKIA" + "0" * 16, "é𝒳 apikey='" + "ab12" * 8 + "'", "password=abc passwd = \"abcdef\"",
]


def test_secrets(spark, docs, odd, none):
    rows = [(i, t) for i, t in enumerate(SECRETS)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), docs, odd):
        got = collections.Counter((r["doc_id"], r["spans"], r["base_sha256"], r["n_assign"] + r["n_access"] + r["n_hex"]) for r in secrets.report(spark, df).collect())
        want = [(i, brute_spans(t)) for i, t in ((r["doc_id"], r["text"]) for r in df.collect())]
        assert got == collections.Counter((i, s, hashlib.sha256(s.encode()).hexdigest(), len([x for x in s.split(",") if x])) for i, s in want)
    assert secrets.report(spark, none).count() == 0


def test_ledger_scans_only_what_is_new(spark):
    first = spark.createDataFrame([(1, SECRETS[0]), (2, SECRETS[1])], "doc_id long, text string")
    ledger = secrets.update_ledger(spark, first)
    more = first.unionByName(spark.createDataFrame([(3, SECRETS[2]), (4, SECRETS[2])], "doc_id long, text string"))
    assert secrets.scan_unseen(first, secrets.RULES, ledger).count() == 0
    assert secrets.scan_unseen(more, secrets.RULES, ledger).count() == 3
    newer = (*secrets.RULES[:2], secrets.Rule("hex", "[0-9a-f]{8,}", 0, 8, version=2))
    assert {tuple(r) for r in secrets.scan_unseen(first, newer, ledger).groupBy("rule").count().collect()} == {("hex@2", 2)}
    assert secrets.report(spark, more, ledger=ledger).count() == 4


def test_redaction(spark, odd, none):
    df = spark.createDataFrame([(0, SECRETS[3], 5, "x")], "doc_id long, text string, n_chars long, clean string")
    row = secrets.redact(spark, df).first()
    assert row["text"] == "é𝒳 [SECRET]'" and row["n_chars"] == len(row["text"]) and row["clean"] == "x"
    got = secrets.redact(spark, odd)
    assert got.columns == odd.columns and got.count() == 10 and got.where("text like '%abcdef1%'").count() == 0
    assert secrets.redact(spark, none).count() == 0


# ---- packing


def check_packing(rows, tokens, capacities):
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["copy"], sum(x["n_tokens"] for x in rows if (x["doc_id"], x["copy"]) == (r["doc_id"], r["copy"]))].append(r)
    bins = collections.defaultdict(list)
    for r in rows:
        if r["n_tokens"]:
            bins[r["sequence_id"]].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["sequence_offset"])
        used = sum(r["n_tokens"] for r in held)
        assert [r["sequence_offset"] for r in held] == list(np.cumsum([0, *(r["n_tokens"] for r in held)])[:-1])
        assert used == held[0]["sequence_tokens"] and held[0]["sequence_capacity"] == min(c for c in capacities if c >= used)
    assert sum(r["n_tokens"] for r in rows) == sum(tokens)


def test_packing(spark, docs, odd, none):
    rows = packing.pack(docs, block_rows=64).collect()
    tokens = [len((r["text"] or "").split()) for r in docs.collect()]
    check_packing(rows, tokens, packing.CAPACITIES)
    bins = {r["sequence_id"]: (r["sequence_tokens"], r["sequence_capacity"]) for r in rows if r["n_tokens"]}
    assert packing.fill_rate(*map(np.array, zip(*bins.values(), strict=True))) > 0.97
    odd_rows = packing.pack(odd).collect()
    check_packing(odd_rows, [0, 0, 2, 2, 2, 2, 30000, 30001, 0, 2], packing.CAPACITIES)
    assert len({(r["doc_id"], r["copy"], r["n_tokens"], r["piece"]) for r in odd_rows}) == len(odd_rows)
    assert packing.pack(none).count() == 0


def test_best_fit_takes_the_tightest_room():
    """With one capacity, bins of equal room hold equally much, so contents are comparable."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = sorted(rng.integers(1, 65, 80).tolist(), reverse=True)
        room: list[int] = []
        for n in lengths:
            fits = [b for b in range(len(room)) if room[b] >= n]
            if not fits:
                room.append(64)
                fits = [len(room) - 1]
            room[min(fits, key=room.__getitem__)] -= n
        assert sorted(packing.best_fit(lengths, (64,), 64)[2]) == sorted(64 - r for r in room)


def test_joint_lengths_cost_no_more_than_any_ceiling():
    rng = np.random.default_rng(3)
    for _ in range(10):
        lengths = sorted(rng.integers(1, 65, 50).tolist(), reverse=True)
        final = packing.pack_block(lengths, (16, 32, 64))[3]
        for ceiling in (16, 32, 64):
            used = packing.best_fit(lengths, (16, 32, 64), ceiling)[2]
            assert sum(map(packing.cost, final)) <= sum(packing.cost(next(c for c in (16, 32, 64) if c >= u)) for u in used)


# ---- pipeline


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    at = docs
    for name, stage in pipeline.STAGES:
        before = [tuple(r) for r in at.select("doc_id", "text").collect()]
        at = stage(spark, at, sf_dir)
        if name == "packing":
            check_packing(at.collect(), [len(t.split()) for _, t in before], packing.CAPACITIES)
            break
        assert at.columns == docs.columns
        after = [tuple(r) for r in at.select("doc_id", "text").collect()]
        if name == "toxicity":
            gone = {i for i, _ in before} - {i for i, _ in after}
            # with so few labels the model errs now and then
            assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * len(before)
        if name == "near_duplicates":
            want = {c for _, n, c in brute_components(before, 5, 80, 100)}
            assert {i for i, _ in after} == want
        if name == "secrets":
            assert len(after) == len(before) and not any(brute_spans(t) for _, t in after)
        if name == "mixing":
            assert set(after) <= set(before)
    assert pipeline.run(spark, sf_dir).count() > 0


def test_results_hold_plain_values(spark, odd):
    """Every result can be written as JSON."""
    for df in (sharding.shard(odd), packing.pack(odd), partenum.components(spark, odd)):
        assert all(json.loads(x) for x in df.toJSON().collect())
