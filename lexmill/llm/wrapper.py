"""Main text of web pages by wrapper induction.

Pages are parsed into trees of elements; runs of like siblings (list items,
paragraphs) are folded into one repeating node. Trees of pages of one host are
aligned pairwise by simple tree matching, which finds the largest order-preserving
mapping of equal elements. The wrapper of a host is what its alignments say:

- A slot, a place in the folded tree, whose texts were the same on both pages in more
  than half of its alignments is template and goes; inside article and main elements
  one alignment more must agree, so that two near copies don't blank each other.
- In a slot that varies, a text that more than half of the host's alignments (and one
  more) found on both pages is template too, but not inside article and main.
- The content region is looked for below the deepest element that holds all of the
  host's text: it is the child with at least DOMINANT of the text that varies, if there
  is one. Varying text outside it (menus, adverts, comments that carry no telling name)
  goes as well.

What varies inside the region is content. Tags and names only break ties: an element
whose tag or class says that it is a menu, header, footer, sidebar, notice, advert,
form or comment is none, even where it varies, and counts for nothing in the choice of
the region; text in article and main elements counts as inside the region; and where
nothing was aligned (a host of one page, an element that no other page has), text
outside article and main elements goes if the page has any.

Pages of a host are aligned along chains of about CHAIN pages, each with the one before
it; a host has as many chains as its pages need, so no host's pages must meet in one task.

Blocks (paragraphs, headings, items and the like) are joined by one newline; white
space in a block becomes one space; character references are decoded. Nulls: a null
page is empty and has no text; a null URL has the empty host. Repeated pages of a
host would vote their own content into the template, so equal pages are not
aligned. Broken markup never fails: unknown constructs are text, open elements end
with the page. Very long and very deep pages are parsed whole, without recursion, and the
mapping is the largest whatever their size: time grows with the product of two lists of
children, memory only with their lengths (rows of the table between kept ones are made twice).
Empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import materialize, prepare
from lexmill.llm.url_rules import host_of

DOMINANT = 0.8
CHAIN = 512

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of the same group ends, up to the element that holds the group.
ENDS = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)
}
SCOPE = frozenset("ul ol dl table tbody div section article aside nav main body html header footer form blockquote td th select".split())
AWAY = frozenset("nav header footer aside form button select menu dialog head label".split())
AWAY_NAME = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|sidebar|side|footer|header|masthead|comments?|comment\w+|replies|reply|"
    r"disqus|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|widget|login|signup|search|toolbar)(?:$|[-_ ])",
    re.I,
)
TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|!\[CDATA\[(.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z))", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


@dataclass
class Node:
    key: str
    away: bool
    main: bool
    children: list["Node"] = field(default_factory=list)
    #: Numbers of the blocks whose text starts in this element.
    blocks: list[int] = field(default_factory=list)
    #: Checksum of the keys from the root: the element's slot in the folded tree.
    path: int = 0
    #: Whether it lies in the content region that parse() was given.
    inside: bool = False


@dataclass
class Page:
    root: Node
    #: text, whether it is away from the content, whether it lies in an article, and the node it belongs to
    blocks: list[tuple[str, bool, bool, Node]]


def parse(html: str, region: int | None = None) -> Page:
    root = Node("#", False, False, inside=region == 0)
    names: Counter = Counter()  # of the open elements
    stack: list[tuple[str, Node]] = [("#", root)]
    blocks: list[tuple[str, bool, bool, Node]] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                node = owner[0]
                node.blocks.append(len(blocks))
                blocks.append((text, node.away, node.main, node))

    def close(k: int) -> None:
        for n, _ in stack[k:]:
            names[n] -= 1
        del stack[k:], owners[k:]
        owner[0] = owners[-1]

    owner = [root]  # the innermost block element, to which text belongs
    owners = [root]
    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = m[4]
        if name is None:
            if m[2] is not None:
                parts.append(m[2])
            continue
        name = name.lower()
        if m[3]:  # an end tag ends the innermost open element of that name
            for k in range(len(stack) - 1, 0, -1) if names[name] else ():
                if stack[k][0] == name:
                    if any(s[0] in BLOCK for s in stack[k:]):
                        flush()
                    close(k)
                    break
                if stack[k][0] in SCOPE and name not in SCOPE:
                    break
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW:
            ends = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = ends.end() if ends else (end if name in ("script", "style") else at)
            continue
        if name in ENDS:
            for k in range(len(stack) - 1, 0, -1) if any(names[n] for n in ENDS[name]) else ():
                if stack[k][0] in ENDS[name]:
                    flush()
                    close(k)
                    break
                if stack[k][0] in SCOPE and not (name in ("tr",) and stack[k][0] in ("td", "th")):
                    break
        elif name in BLOCK:  # a block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1) if names["p"] else ():
                if stack[k][0] == "p":
                    flush()
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        block = name in BLOCK
        if block:
            flush()
        if name in VOID:
            continue
        parent = stack[-1][1]
        attributes = m[5]
        label = ""
        if attributes:
            found = {a.lower(): b or c or d for a, b, c, d in NAMED.findall(attributes)}
            label = " ".join(found[x] for x in ("class", "id", "role") if x in found)
        away = parent.away or name in AWAY or bool(label and AWAY_NAME.search(label)) or bool(attributes and HIDDEN.search(attributes))
        if name in ("html", "body"):
            away = False
        # a header of an article is part of it unless it is named otherwise
        node = Node(f"{name}.{label}" if label else name, away, parent.main or name in ("article", "main"))
        node.path = crc32(f"/{node.key}".encode(), parent.path)
        node.inside = parent.inside or node.path == region
        if attributes.endswith("/") and not block:
            continue
        parent.children.append(node)
        stack.append((name, node))
        names[name] += 1
        owners.append(node if block else owners[-1])
        owner[0] = owners[-1]
    flush()
    return Page(root, blocks)


@dataclass
class Tree:
    """A folded tree: runs of siblings of one key are one node."""

    key: str
    children: list["Tree"]
    blocks: list[int]
    shape: int = 0


def fold(node: Node) -> Tree:
    root = Tree(node.key, [], list(node.blocks))
    order, todo = [root], [(root, [node])]
    while todo:
        tree, nodes = todo.pop()
        run: list[Node] = []
        runs = []
        for child in (c for n in nodes for c in n.children):
            if not run or run[-1].key != child.key:
                runs.append(run := [])
            run.append(child)
        for run in runs:
            child = Tree(run[0].key, [], [b for n in run for b in n.blocks])
            tree.children.append(child)
            order.append(child)
            todo.append((child, run))
    for tree in reversed(order):  # children come after their parents
        tree.shape = hash((tree.key, tuple(c.shape for c in tree.children)))
    return root


Plan = dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]


def ends_alike(x: list[Tree], y: list[Tree]) -> tuple[int, int]:
    """How many first and last children have equal shapes; the largest mapping may map those to each other."""
    most = min(len(x), len(y))
    first = next((i for i in range(most) if x[i].shape != y[i].shape), most)
    return first, next((i for i in range(most - first) if x[-1 - i].shape != y[-1 - i].shape), most - first)


def largest(u: list[int], v: list[int], plan: Plan) -> list[tuple[int, int]]:
    """The places that the largest mapping of two lists of shapes pairs, last ones first; every isqrt(len(u))-th row of its table is kept."""
    if not (u and v):
        return []
    kinds: dict[int, int] = {}
    kind = np.array([kinds.setdefault(t, len(kinds)) for t in v])
    known: dict[int, np.ndarray] = {}

    def gain(s: int) -> np.ndarray:
        if s not in known:
            known[s] = np.array([plan.get((s, t), (0,))[0] for t in kinds])
        return known[s][kind]

    def after(row: np.ndarray, s: int) -> np.ndarray:
        new = row.copy()
        np.maximum(row[1:], row[:-1] + gain(s), out=new[1:])
        return np.maximum.accumulate(new)

    step, row = isqrt(len(u)), np.zeros(len(v) + 1, np.int64)
    kept = []
    for i, s in enumerate(u):
        if i % step == 0:
            kept.append(row)
        row = after(row, s)
    out, j = [], len(v)
    for start in range((len(u) - 1) // step * step, -1, -step):
        rows = [kept[start // step]]
        for s in u[start : start + step]:
            rows.append(after(rows[-1], s))
        i = len(rows) - 1
        while i and j:
            got = plan.get((u[start + i - 1], v[j - 1]), (0,))[0]
            if got and rows[i][j] == rows[i - 1][j - 1] + got:
                i, j = i - 1, j - 1
                out.append((start + i, j))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out


def match(a: Tree, b: Tree, plan: Plan | None = None) -> int:
    """Simple tree matching: nodes in the largest mapping that keeps order and ancestry.

    plan keeps, by two shapes, the size of the mapping below two roots and which of their children it pairs.
    """
    if a.key != b.key:
        return 0
    plan = {} if plan is None else plan
    todo = [(a, b, False)]
    while todo:
        p, q, ready = todo.pop()
        if (p.shape, q.shape) in plan:
            continue
        x, y = p.children, q.children
        first, last = ends_alike(x, y)
        pairs = [(i, i) for i in range(first)] + [(len(x) - i, len(y) - i) for i in range(last, 0, -1)]
        u, v = x[first : len(x) - last], y[first : len(y) - last]
        if not ready:
            below = [(x[i], y[j]) for i, j in pairs]
            below += [(s, t) for s in {s.shape: s for s in u}.values() for t in {t.shape: t for t in v}.values() if s.key == t.key]
            wanted = [(s, t, False) for s, t in below if (s.shape, t.shape) not in plan]
            if wanted:
                todo.append((p, q, True))
                todo += wanted
                continue
        middle = [(first + i, first + j) for i, j in largest([s.shape for s in u], [t.shape for t in v], plan)]
        pairs = sorted(pairs + middle)
        plan[p.shape, q.shape] = 1 + sum(plan[x[i].shape, y[j].shape][0] for i, j in pairs), pairs
    return plan[a.shape, b.shape][0]


def aligned(a: Tree, b: Tree, plan: Plan) -> Iterator[tuple[list[int], list[int]]]:
    """Blocks of mapped nodes."""
    if not match(a, b, plan):
        return
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        yield p.blocks, q.blocks
        todo += [(p.children[i], q.children[j]) for i, j in plan[p.shape, q.shape][1]]


#: Stands for every element; no element has it for a key.
ANYWHERE = "*"


def digest(node_key: str, text: str) -> bytes:
    return blake2b(f"{node_key}\0{text}".encode(), digest_size=16).digest()


def slot(path: int) -> bytes:
    """The digest of a slot; no text gives it."""
    return blake2b(f"{path}".encode(), digest_size=16, person=b"slot").digest()


#: Rows of a host: alignments (kind a), texts (t, n: alignments that found the text on both pages), slots (s, n: alignments, same: those
#: with equal texts, main: whether in an article), paths (p, n: characters of text, same: those that vary, inner: of these, those of elements below).
VOTES = pa.schema(
    [
        ("host", pa.string()),
        ("kind", pa.string()),
        ("key", pa.binary()),
        ("parent", pa.binary()),
        ("depth", pa.int32()),
        ("main", pa.bool_()),
        ("n", pa.int64()),
        ("same", pa.int64()),
        ("inner", pa.int64()),
    ]
)
VOTES_SQL = "host string, kind string, key binary, parent binary, depth int, main boolean, n long, same long, inner long"
#: Rows that a task holds before it gives them out.
ROWS_HELD = 50_000


def masses(page: Page, varying: set[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(path, parent's path, depth, characters, varying characters, varying characters below) of the elements that hold text.

    varying: numbers of the blocks that vary. Text of elements away from the content counts as text only.
    """
    order = [(page.root, 0, 0)]
    for node, depth, _ in order:  # grows while it is read
        order += [(c, depth + 1, node.path) for c in node.children]
    held: dict[int, list[int]] = {}
    total: dict[int, tuple[int, int]] = {}
    for node, depth, parent in reversed(order):
        own = sum(len(page.blocks[k][0]) for k in node.blocks)
        moves = sum(len(page.blocks[k][0]) for k in node.blocks if k in varying)
        below = [total.pop(id(c)) for c in node.children]
        inner = sum(x[1] for x in below)
        total[id(node)] = sums = own + sum(x[0] for x in below), moves + inner
        if sums[0]:
            row = held.setdefault(node.path, [parent, depth, 0, 0, 0])
            row[2], row[3], row[4] = row[2] + sums[0], row[3] + sums[1], row[4] + inner
    for path, row in held.items():
        yield path, *row


def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's alignments say; rows are sorted by host and chain."""
    host = chain = prior = prior_html = None
    plan: Plan = {}
    votes: dict[tuple, list[int]] = {}

    def add(kind: str, key: bytes, n: int, same: int = 0, inner: int = 0, parent: bytes = b"", depth: int = 0, main: bool = False) -> None:
        row = votes.setdefault((host, kind, key, parent, depth, main), [0, 0, 0])
        row[0], row[1], row[2] = row[0] + n, row[1] + same, row[2] + inner

    for batch in batches:
        for name, link, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if html == prior_html and name == host:
                continue
            page = parse(html)
            tree = fold(page.root)
            if name == host and link == chain:
                add("a", b"", 1)
                found: set[bytes] = set()
                slots: dict[tuple[int, bool], bool] = {}
                varying: set[int] = set()
                for left, right in aligned(prior[1], tree, plan):
                    if not (left and right):
                        continue
                    texts = {prior[0].blocks[k][0] for k in left}
                    alike = texts == {page.blocks[k][0] for k in right}
                    for k in right:
                        text, away, main, node = page.blocks[k]
                        if away:
                            continue
                        slots[node.path, main] = slots.get((node.path, main), True) and alike
                        if not alike:
                            varying.add(k)
                        if text in texts and not main:
                            found |= {digest(node.key, text), digest(ANYWHERE, text)}
                for d in found:
                    add("t", d, 1)
                for (path, main), alike in slots.items():
                    add("s", slot(path), 1, int(alike), main=main)
                for path, parent, depth, n, moves, inner in masses(page, varying):
                    add("p", slot(path), n, moves, inner, slot(parent), depth)
            host, chain, prior, prior_html = name, link, (page, tree), html
            if len(plan) > 20000:
                plan.clear()
            if len(votes) > ROWS_HELD:
                yield counted(votes)
                votes.clear()
    yield counted(votes)


def counted(votes: dict[tuple, list[int]]) -> pa.RecordBatch:
    rows = [(*k, *v) for k, v in votes.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(VOTES)], schema=VOTES)


def induce(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(host, texts, slots, region): digests of constant texts and slots, and the region's, null if none dominates; hosts without alignments are absent."""
    prepare(spark)
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    sizes = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / CHAIN).cast("int").alias("chains")).where("chains > 1")
    rows = rows.join(materialize(spark, sizes, "wrapper-chains"), "host", "left")
    rows = rows.withColumn("chain", F.pmod(F.xxhash64("html"), F.coalesce("chains", F.lit(1))).cast("int"))
    dealt = rows.select("host", "chain", "html").repartition("host", "chain").sortWithinPartitions("host", "chain", F.xxhash64("html"))
    votes = dealt.mapInArrow(vote, VOTES_SQL).groupBy("host", "kind", "key", "parent", "depth", "main")
    votes = materialize(spark, votes.agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum("inner").alias("inner")), "wrapper-votes")

    kind = lambda k: votes.where(F.col("kind") == k)
    hosts = kind("a").select("host", F.col("n").alias("of"))
    texts = kind("t").join(hosts, "host").where(2 * F.col("n") > F.col("of") + 1).groupBy("host").agg(F.collect_set("key").alias("texts"))
    slots = kind("s").where(2 * F.col("same") > F.col("n") + F.col("main").cast("int")).groupBy("host").agg(F.collect_set("key").alias("slots"))
    paths = kind("p")
    whole = paths.where("depth = 0").groupBy("host").agg(F.sum("n").alias("all_text"), F.sum("same").alias("all_varying"))
    # the deepest element that holds all text, and its child that holds most of what varies, in elements of its own
    trunk = paths.join(whole, "host").where("n = all_text").groupBy("host", "all_varying").agg(F.max_by("key", "depth").alias("parent"))
    share = (F.col("same") >= DOMINANT * F.col("all_varying")) & (2 * F.col("inner") >= F.col("same")) & (F.col("same") > 0) & (F.col("depth") > 0)
    region = paths.join(trunk, ["host", "parent"]).where(share).groupBy("host").agg(F.max_by("key", "same").alias("region"))
    out = hosts.select("host").join(texts, "host", "left").join(slots, "host", "left").join(region, "host", "left")
    return materialize(spark, out, "wrappers")


@dataclass(frozen=True)
class Wrapper:
    texts: frozenset[bytes] = frozenset()
    slots: frozenset[bytes] = frozenset()
    region: bytes | None = None


def main_text(html: str, wrapper: Wrapper | None = None) -> str:
    """The text of one page; without a wrapper tags alone decide."""
    page = parse(html)
    if wrapper is not None and wrapper.region is not None:
        path = next((p for p in paths_of(page) if slot(p) == wrapper.region), None)
        # a page without the host's region is read as if there were none
        if path is not None:
            page = parse(html, path)
    regional = any(node.inside for *_, node in page.blocks)
    articled = any(main and not away for _, away, main, _ in page.blocks)
    out = []
    for text, away, main, node in page.blocks:
        if away:
            continue
        if wrapper is None:
            if articled and not main:
                continue
        elif main:
            # an article's own constant lines stay, such as a byline; only what the host repeats outside articles too is template
            if slot(node.path) in wrapper.slots and digest(ANYWHERE, text) in wrapper.texts:
                continue
        elif slot(node.path) in wrapper.slots or digest(node.key, text) in wrapper.texts:
            continue
        elif regional and not (node.inside or main):
            continue
        out.append(text)
    return "\n".join(out)


def paths_of(page: Page) -> list[int]:
    """Paths of the elements that hold a block's element, the outermost first."""
    out: dict[int, None] = {}
    todo = [page.root]
    for node in todo:  # grows while it is read
        out[node.path] = None
        todo += node.children
    return list(out)


def reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, Wrapper | None] = {}
        texts = []
        for i, (host, html) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if host not in known:
                of, lists, slots, region = (batch.column(k)[i].as_py() for k in range(4, 8))
                known[host] = Wrapper(frozenset(lists or ()), frozenset(slots or ()), region) if of else None
            texts.append(main_text(html, known[host]))
        counts = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], names=["page_id", "url", "text", "n_chars"])


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    wrappers = induce(spark, pages).withColumn("known", F.lit(True))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    joined = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "host", "known", "texts", "slots", "region")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(reader, f"page_id {kind}, url string, text string, n_chars long")
