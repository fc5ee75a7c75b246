"""The stages against their operators' definitions, on small tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontamination, quality_classifier
from lodestone.llm.common import Scratch, read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, scratch, out = read_table(spark, SF, "documents"), Scratch(spark, "test"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = scratch.keep(stage(spark, docs, SF), name)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "leaks", "mixture", "shards"]
    assert all(stages[n].columns == stages["input"].columns for n in ("quality", "near_duplicates", "leaks", "mixture"))


def test_stages(spark, stages):
    ids = {n: sorted(r.doc_id for r in df.select("doc_id").collect()) for n, df in stages.items()}
    weights = quality_classifier.fit_on_training_fold(stages["input"], read_table(spark, SF, "labels"))
    good = quality_classifier.score(stages["input"], weights).where(F.col("score") >= 0.7)
    assert ids["quality"] == sorted(r.doc_id for r in good.collect())

    def grams(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    before = {r.doc_id: grams(r.text) for r in stages["quality"].collect()}
    left, parent = sorted(before), {i: i for i in before}
    root = lambda i: i if parent[i] == i else root(parent[i])
    for a in left:
        for b in left:
            if b < a and (both := len(before[a] & before[b])) and 100 * both >= 80 * len(before[a] | before[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert ids["near_duplicates"] == sorted({root(i) for i in left})
    hit = {r.doc_id for r in decontamination.contaminated(stages["near_duplicates"], read_table(spark, SF, "benchmark")).collect()}
    assert ids["leaks"] == [i for i in ids["near_duplicates"] if i not in hit]
    assert ids["leaks"] == ids["mixture"] == ids["shards"]


def test_run(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages["shards"].collect()))


def test_mixture_reaches_the_shards(spark):
    """A source with a third of the rows: the first shards have it at its target weight, and without the stage they don't."""
    names = ["hot"] * 6000 + [f"s{i % 10}" for i in range(12_000)]
    rows = spark.createDataFrame([(i, f"text {i}", "en", s) for i, s in enumerate(names)], "doc_id long, text string, lang string, source string")
    scratch, docs = Scratch(spark, "hot"), rows.repartition(4)
    mixed = scratch.keep(corpus_pipeline.mixture(spark, scratch.keep(docs, "docs"), SF), "mixed")
    of = lambda df: corpus_pipeline.shards(spark, df, SF).join(rows, "doc_id").toPandas()
    with_, without = of(mixed), of(scratch.keep(docs, "plain"))
    assert sorted(with_.doc_id) == sorted(without.doc_id) == list(range(len(names)))
    weight = 6000**0.7 / (6000**0.7 + 10 * 1200**0.7)
    first = lambda df: (df[df.shard < 4].source == "hot").mean()
    assert abs(first(with_) - weight) < 0.02 and abs(first(without) - 1 / 3) < 0.04
    counts = with_.groupby("shard").slot.agg(["size", "max"])
    assert len(counts) == 16 and counts["size"].max() - counts["size"].min() <= 1 and (counts["max"] + 1 == counts["size"]).all()


def test_edges(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns named like the stages' own, and an empty table."""
    long = " ".join(f"w{i * 7919 % 5000}" for i in range(40_000))
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, long, "en", None), (None, "some words", None, "s"), (5, "a b", "en", "s"), (5, "a b", "en", "s"), (6, "a b c d e f g", None, "t")]
    schema = "doc_id long, text string, lang string, source string, _gone int, _hit int, _row int, _text string, score double, shard int, slot long"
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x", 0.5, 4, 5) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns, name
        assert sorted({str(r.doc_id) for r in left.collect()}) == ["1", "2", "3", "5", "6", "None"], name
    scratch = Scratch(spark, "edges")
    assert corpus_pipeline.quality(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.shards(spark, scratch.keep(docs, "docs"), SF).count() == len(rows)
    none = scratch.keep(docs.limit(0), "none")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
