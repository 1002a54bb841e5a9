"""Cases in which the operators once did less than the whole job."""

import pytest
from test_operators import NO_DOCS, brute_components, found_components, odd_rows

from lexmill.llm import partenum, wrapper


def texts(spark, pages):
    rows = [(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)]
    return [r["text"] for r in wrapper.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_small_hosts_have_wrappers(spark):
    page = lambda i: f"<div><p>Home and more</p></div><section><p>story {i}</p><p>more {i}</p></section><span>All rights reserved</span>"
    for n in (2, 3, 9):
        assert texts(spark, [("a.b", page(i)) for i in range(n)]) == [f"story {i}\nmore {i}" for i in range(n)]
    # one page gives nothing to compare with
    assert texts(spark, [("a.b", page(0))]) == ["Home and more\nstory 0\nmore 0\nAll rights reserved"]


def test_shared_paragraphs_of_near_copies_stay(spark):
    page = lambda i: f"<section><p>the same story</p><p>told twice</p><p>with an end {i}</p></section>"
    assert texts(spark, [("a.b", page(i)) for i in range(2)]) == [f"the same story\ntold twice\nwith an end {i}" for i in range(2)]
    page = lambda i: f"<article><h1>title</h1><p>end {i}</p></article>"
    assert texts(spark, [("a.b", page(i)) for i in range(2)]) == [f"title\nend {i}" for i in range(2)]


def test_varying_slots_outside_an_article_are_content(spark):
    page = lambda i: f"<div><p>lead {i}</p></div><div id=x><p>constant</p></div><nav>menu {i}</nav><article><p>story {i}</p></article>"
    assert texts(spark, [("a.b", page(i)) for i in range(3)]) == [f"lead {i}\nstory {i}" for i in range(3)]
    assert texts(spark, [("a.b", page(0))]) == ["story 0"]


def test_doubled_members_do_not_hide_a_group(spark):
    rows = [(1, 10, 0), (1, 10, 0), (1, 11, 1), (2, 12, 2), (2, 12, 2), (2, 11, 1), (3, 11, 1), (3, 12, 2), (3, 12, 2), (4, 10, 0), (4, 13, 0)]
    placed = spark.createDataFrame(rows, "sig long, sid long, label long")
    # 2 and 3 have the same members, 4 has one label
    assert sorted(r[0] for r in partenum.split_groups(placed).collect()) == [1, 2]


def test_copies_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(partenum, "HOT", 1)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: i % 20], f"x{i % 40}", *words[i % 20 + 1 :]])) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found_components(spark, df, 4, 85, 100) == brute_components(rows, 4, 85, 100)


def test_one_row_of_each_group_stays(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kept = lambda df: corpus_pipeline.drop_near_duplicates(spark, df, "")
    odd = spark.createDataFrame(odd_rows(), NO_DOCS).repartition(3)
    got = kept(odd)
    assert got.columns == odd.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 2, 3, 5, 7, 8]
    rows = [(1, "one two three"), (9, "one two three"), (9, "quite another text"), (None, "a text without id"), (None, "a text without id"), (None, "one two three")]
    got = kept(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "one two three"), (9, "quite another text"), (None, "a text without id")]))


def plain_host(i, n=40):
    """A page whose tags and names tell nothing: menu, notice, advert, story, remarks and imprint are all div and p."""
    story = "".join(f"<p>{' '.join(f'w{i * 31 + k * 7 + j}' for j in range(n))}</p>" for k in range(4))
    return (
        f"<body><div><p>Start</p><p>About us</p><p>topic {i}</p></div><div><b>We moved house</b></div><div class=x7><p>buy thing {i}</p></div>"
        f"<div class=x2><h2>title {i}</h2>{story}</div><div class=x9><p>nice one {i}</p></div><div class=x4>All rights reserved</div></body>"
    )


def story_of(i, n=40):
    return "\n".join([f"title {i}", *(" ".join(f"w{i * 31 + k * 7 + j}" for j in range(n)) for k in range(4))])


def test_the_wrapper_decides_where_tags_tell_nothing(spark):
    for n in (2, 5, 30):
        assert texts(spark, [("a.b", plain_host(i)) for i in range(n)]) == [story_of(i) for i in range(n)]
    assert wrapper.main_text(plain_host(0)) != story_of(0) and wrapper.main_text(plain_host(0), wrapper.Wrapper()) != story_of(0)


def test_blocks_that_recur_in_articles_stay(spark):
    page = lambda i: f"<div><p>Home</p></div><article><p>story {i}</p><p>As we said before.</p><p>end {i}</p></article><div><p>Imprint</p></div>"
    assert texts(spark, [("a.b", page(i)) for i in range(12)]) == [f"story {i}\nAs we said before.\nend {i}" for i in range(12)]


def test_hosts_of_several_chains(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "CHAIN", 4)
    assert texts(spark, [("a.b", plain_host(i)) for i in range(30)]) == [story_of(i) for i in range(30)]


def test_very_deep_and_very_long_pages(spark):
    deep = [("<div>" * 100_000 + f"<p>x {i}</p>") for i in range(2)]
    assert texts(spark, [("a.b", p) for p in deep]) == ["x 0", "x 1"]
    long = ["".join(f"<h2>t{k} {i}</h2><p>some text of paragraph {k} on page {i}</p>" for k in range(60_000)) for i in range(2)]
    assert [t.count("\n") for t in texts(spark, [("a.b", p) for p in long])] == [119_999, 119_999]
    assert wrapper.main_text("<b>" * 50_000 + "</i>" * 50_000 + "x") == "x"
    assert wrapper.main_text("<p>" + "x " * 25_000_000 + "</p>") == " ".join(["x"] * 25_000_000)


def test_constant_lines_of_an_article_stay(spark):
    import random

    rng = random.Random(2)
    story = lambda: " ".join(rng.choice(["river", "stone", "board", "light", "paper", "north"]) + str(rng.randrange(99)) for _ in range(30))
    pages, want = [], {}
    for i in range(12):
        body = story()
        html = f"<body><div>Our site</div><article><h1>t{i}</h1><p class=byline>By our staff</p><p>{body}</p><p>Read more tomorrow</p></article><p>Read more tomorrow</p></body>"
        pages.append((i, f"http://news.example/{i}", html))
        want[i] = f"t{i}\nBy our staff\n{body}"
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    # the byline stands in articles alone; the last line is repeated below them, so it is the host's
    assert {i: t.split("\nRead more")[0] for i, t in got.items()} == want
