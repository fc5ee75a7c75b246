import pytest
from pyspark.sql import functions as F

from lodestone.operators import documents
from lodestone.operators.collection import Collection, from_rows
from lodestone.operators.filters import compile_filter, variant_resolver
from lodestone.plans import dsl
from lodestone.types import CollectionConfig, FilterError

CONTEXTS = ['{"a":5}', '{"a":5.0}', '{"a":"5"}', '{"a":null}', '{"a":true}', '{"a":[5]}', '{"a":{"b":1}}', "{}", None]
CASES = [  # filter, matching rows as the cli and as the viewer; None: an error
    ({"a": 5}, {0, 1}, {0, 1}),
    ({"a": "5"}, {2}, {2}),
    ({"a": None}, {3}, {3}),
    ({"a": True}, {4}, {4}),
    ({"a": [5]}, set(), set()),
    ({"a": {"b": 1}}, set(range(9)), set()),
    ({"a": {}}, set(range(9)), set()),
    ({"a": {"$ne": 5}}, set(range(2, 9)), set(range(2, 9))),
    ({"a": {"$gt": 4}}, {0, 1}, {0, 1}),
    ({"a": {"$lte": "5"}}, set(), set()),
    ({"a": {"$gte": 5, "$lt": 6}}, {0, 1}, {0, 1}),
    ({"a": {"$in": [5, None]}}, {0, 1, 3}, {0, 1, 3}),
    ({"a": {"$nin": [5]}}, set(range(2, 9)), set(range(2, 9))),
    ({"a": {"$nin": 5}}, set(), set()),
    ({"a": {"$regex": "^5"}}, {2}, {2}),
    ({"a": {"$regex": "("}}, None, set()),
    ({"a": {"$exists": True}}, set(range(7)), set(range(7))),
    ({"a": {"$exists": False}}, {7, 8}, {7, 8}),
    ({"a.0": 5}, {5}, {5}),
    ({"a.length": 1}, {5}, {5}),
    ({"a.b": {"$eq": 1}}, {6}, {6}),
    ({"a": {"$what": 1}}, set(range(9)), None),
    ({"$and": []}, set(range(9)), set(range(9))),
    ({"$or": []}, set(), set()),
    ({"$or": [{"a": 5}, {"a": "5"}]}, {0, 1, 2}, {0, 1, 2}),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CONTEXTS)], "seq long, c string")
    return df.select("seq", F.parse_json("c").alias("context")).cache()


@pytest.mark.parametrize("dialect", ["cli", "viewer"])
def test_operators(spark, rows, dialect):
    columns, expected = [], []
    for n, (spec, cli, viewer) in enumerate(CASES):
        want = cli if dialect == "cli" else viewer
        if dialect == "viewer":
            spec = {k if k.startswith("$") else f"context.{k}": ([{f"context.{a}": b for a, b in x.items()} for x in v] if k.startswith("$") else v) for k, v in spec.items()}
        if want is None:
            with pytest.raises(FilterError):
                compile_filter(spec, variant_resolver(dialect=dialect), dialect)
        else:
            columns.append(compile_filter(spec, variant_resolver(dialect=dialect), dialect).alias(f"c{n}"))
            expected.append((n, want))
    found = rows.select("seq", *columns).collect()
    for n, want in expected:
        assert {r.seq for r in found if r[f"c{n}"]} == want, CASES[n]
        assert all(r[f"c{n}"] is not None for r in found)


def test_bad_filters():
    for bad in ("{", "[1]", '{"$and": 1}'):
        with pytest.raises(FilterError):
            compile_filter(bad, variant_resolver())


def test_sort_orders(spark):
    texts = ['{"x":10}', '{"x":9}', "{}", '{"x":null}', '{"x":"b"}', '{"x":"A"}', '{"x":"a"}']
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, c string").select("seq", F.parse_json("c").alias("context"))
    order = lambda way, dialect: [r.seq for r in documents.find(df, None, {"x": way} if dialect == "cli" else {"context.x": way}, dialect=dialect).collect()]
    assert order(1, "cli") == [2, 3, 1, 0, 6, 5, 4]
    assert order(-1, "cli")[-2:] == [2, 3]
    assert order(1, "viewer")[-1] == 2 and order(-1, "viewer")[-1] == 2
    assert [r.seq for r in documents.find(df, None, None, 2, 3).collect()] == [2, 3, 4]


def test_distinct(spark, rows):
    cli = [r.value for r in documents.distinct(rows, "a", "cli").collect()]
    assert cli == sorted(set(cli)) and "5" in cli
    viewer = {(r.kind, r.value) for r in documents.distinct(rows, "context.a").collect()}
    assert ("STRING", '"5"') in viewer and ("VOID", "null") in viewer and ("BOOLEAN", "true") in viewer


def test_language(spark):
    assert dsl.parse("db.find({a: 1, 'b': [true, null,],}).skip(2).limit(3).limit(4) junk") == dsl.Plan("find", [{"a": 1, "b": [True, None]}], None, 2, 4)
    for bad in ("find()", "db.drop()", "db.find({a 1})", "db.find().rank()"):
        with pytest.raises(FilterError):
            dsl.parse(bad)
    df = spark.createDataFrame([("x", [1.0, 0.0], '{"t":1}'), ("y", [0.0, 1.0], '{"t":2}')], "id string, embedding array<double>, c string")
    c = Collection(from_rows(df, "id", context="c"), CollectionConfig(2))
    assert [r.id for r in dsl.run(c, 'db.find({context.t: {$gt: 1}})').collect()] == ["y"]
    assert dsl.run(c, "db.count()").first()[0] == 2
    assert dsl.run(c, 'db.count({id: "x"})').first()[0] == 1
    assert dsl.run(c, "db.stats()").first().entry_count == 2
    assert dsl.run(c, 'db.delete("x")').df.count() == 1
    assert [r.id for r in dsl.run(c, "db.query([0, 1]).topK(1)").collect()] == ["y"]


@pytest.mark.parametrize("dialect", ["cli", "viewer"])
@pytest.mark.parametrize("way", [1, -1])
def test_places(spark, tmp_path, monkeypatch, dialect, way):
    """The places of all rows in sort's order, from ranges of a few rows; equal keys keep their order."""
    monkeypatch.setattr(documents, "RANGE_ROWS", 10)
    texts = ['{"x":10}', '{"x":9}', "{}", '{"x":null}', '{"x":"b"}', '{"x":"A"}', '{"x":"a"}'] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, c string").select("seq", (F.col("seq") * 3).alias("n"), F.parse_json("c").alias("context"))
    found = documents.places(df, {"x": way}, "n", str(tmp_path / "p"), dialect)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.schema.simpleString() == "struct<n:bigint,place:bigint>"
    want = [r.n for r in documents.sort(df, {"x": way}, dialect).collect()]
    assert sorted((r.place, r.n) for r in found.collect()) == list(enumerate(want, 1))
    assert spark.read.parquet(str(tmp_path / "p")).select(F.shiftright("_at", 33)).distinct().count() > 10
    assert documents.places(df.where("seq < 0"), {"x": way}, "n", str(tmp_path / "e"), dialect).collect() == []
