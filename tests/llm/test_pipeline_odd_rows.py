"""The five stages in a row on odd tables."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row int, score double, found string, predicted int, part int, blob string"
MORE = (1, 0.5, "f", 1, 2, "b")


def stages_of(spark, tmp_path, docs, labels):
    """What every stage keeps, by name."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = {"documents": at}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, at, str(tmp_path))
        path = str(tmp_path / f"after-{name}")
        made.write.parquet(path)
        out[name] = at = spark.read.schema(made.schema).parquet(path)
    return out


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    body = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"{body} tail{i} {'vile idiot ' * 3 if i % 3 == 0 else ''}", "en", "src1") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "src2"), (None, None, "en", "src2"), (None, "a b c d e f g", "fr", None), (102, "a b c d e f g", "fr", None)]
    rows += [(103, "secret=abcdef123 " + "x y z " * 70000, "de", "src3"), (104, " \t\n", "de", "src3"), (104, "one two three four five six", "de", "src3")]
    docs = spark.createDataFrame([(i, t, g, s, len(t or ""), *MORE) for i, t, g, s in rows], DOCS).repartition(4)
    # near copies by forties, all of one group: only toxic ones and one clean one differ in the end
    got = stages_of(spark, tmp_path, docs, labels_of(spark, [(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (100, None, None)]))
    columns = [(c, t) for c, t in got["documents"].dtypes]
    for name in ("toxicity", "near_duplicates", "secrets", "mixing"):
        assert [(c, t) for c, t in got[name].dtypes] == columns, name
    texts = lambda name: collections.Counter(r["text"] for r in got[name].select("text").collect())
    clean = texts("toxicity")
    assert not any("idiot" in (t or "") for t in clean) and sum(clean.values()) == len(rows) - 20
    kept = texts("near_duplicates")
    assert set(kept) <= set(clean) and sum(kept.values()) < sum(clean.values()) and kept["a b c d e f g"] == 1
    assert kept[None] + kept[""] + kept[" \t\n"] == 4  # without words nothing is a copy
    redacted = texts("secrets")
    assert sum(redacted.values()) == sum(kept.values()) and not any("abcdef123" in (t or "") for t in redacted)
    mixed = got["mixing"].select("doc_id", "text").distinct()
    assert mixed.join(got["secrets"].select("doc_id", "text"), ["doc_id", "text"], "left_anti").where("text is not null and doc_id is not null").count() == 0
    packed = got["packing"].agg(F.sum("n_tokens")).first()[0] or 0
    assert packed == sum(len((r["text"] or "").split()) for r in got["mixing"].collect())


@pytest.mark.parametrize("labelled", [False, True])
def test_an_empty_table_goes_through_all_stages(spark, tmp_path, labelled):
    labels = labels_of(spark, [(1, 1, 1), (2, 1, 0)] if labelled else [])
    got = stages_of(spark, tmp_path, spark.createDataFrame([], DOCS), labels)
    assert all(df.count() == 0 for df in got.values())
