import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import changelog, retrieval
from lodestone.operators.collection import Collection, from_rows
from lodestone.sources import binary, crypto, formats
from lodestone.streaming import changes
from lodestone.types import CollectionConfig, FormatError, InvalidConfig


def collection(spark, rows, **settings):
    df = spark.createDataFrame(rows, "id string, embedding array<double>, context string, seq long")
    return Collection(from_rows(df, "id", context="context", seq="seq"), CollectionConfig(2, **settings))


def test_upsert_and_delete(spark):
    c = collection(spark, [("a", [1.0, 0.0], '{"v":1}', 0), ("b", [0.0, 1.0], None, 1)])
    more = collection(spark, [("b", [1.0, 1.0], '{"v":2}', 0), ("c", [1.0, 2.0], None, 1), ("c", [2.0, 2.0], None, 2)]).df
    got = {r.id: (r.seq, r.embedding) for r in c.add_many(more).df.collect()}
    assert got["a"] == (0, [1, 0]) and got["b"] == (1, [1, 1]) and got["c"][1] == [2, 2] and got["c"][0] > 1
    ids = spark.createDataFrame([(0, "a"), (0, "zz")], "id_type int, id string")
    assert {r.id for r in c.delete(ids).df.collect()} == {"b"}
    assert {r._key: r.found for r in c.found(ids).collect()} == {"a": True, "zz": False}
    with pytest.raises(InvalidConfig, match="index 1"):
        c.add_many(collection(spark, [("x", [1.0, 2.0], None, 0), ("y", [1.0], None, 1)]).df)


def test_string_and_integer_ids_differ(spark):
    n = from_rows(spark.createDataFrame([(5, [1.0, 0.0])], "id long, embedding array<double>"), "id")
    c = collection(spark, [("5", [0.0, 1.0], None, 0)]).add_many(n)
    assert c.df.count() == 2 and c.get(5).first().embedding == [1, 0] and c.get("5").first().embedding == [0, 1]
    assert [r.id_type for r in c.query([1.0, 1.0]).collect()] == [0, 1]


def test_replay(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id_key string, x int")
    log = spark.createDataFrame([("a", 9, 0, "put"), ("a", None, 1, "delete"), ("c", 3, 2, "put"), ("c", 4, 3, "put")], "id_key string, x int, pos long, op string")
    assert {(r.id_key, r.x) for r in changelog.replay(base, log).collect()} == {("b", 2), ("c", 4)}


@pytest.mark.parametrize("quantization", ["F32", "INT8", "BIT"])
def test_snapshot_round_trip(spark, tmp_path, quantization):
    c = collection(spark, [("a", [1.0, -1.0], '{"v":1}', 0), ("é", [-2.0, 3.0], None, 1)], quantization=quantization)
    data = formats.snapshot_bytes(c.df, c.config)
    formats.write_bytes(spark, binary.brotli(data), str(tmp_path / "x.bin"))
    rows = binary.read_snapshots(spark, str(tmp_path / "x.bin")).orderBy("seq").select("id", "embedding", F.to_json("context").alias("c")).collect()
    assert [r.id for r in rows] == ["a", "é"] and rows[0].c == '{"v":1}' and rows[1].c is None
    assert rows[0].embedding == [1, -1]
    assert binary.snapshot_header(data)["entry_count"] == 2


def test_snapshot_errors():
    good = binary.encode_snapshot([], CollectionConfig(2, embedder_id="m"))
    assert binary.snapshot_header(good)["embedder_id"] == "m"
    for bad in (b"", b"XXXX" + good[4:], good[:4] + b"\x09" + good[5:], good[:-1]):
        with pytest.raises(FormatError):
            binary.snapshot_header(bad)


def test_log_keeps_the_valid_prefix(spark, tmp_path):
    config = CollectionConfig(2)
    ops = [{"op": "put", "id_type": 0, "id": "a", "data": [1, 2], "context": '{"x":1}'}, {"op": "delete", "id_type": 1, "id": "7"}]
    data = binary.encode_log(ops, config)
    rows, cut = binary.decode_log(data, config)
    assert [r["op"] for r in rows] == ["put", "delete"] and not cut
    assert [len(binary.decode_log(d, config)[0]) for d in (data[:-1], data[:-5] + b"\x00" + data[-4:], data[:12])] == [1, 1, 0]
    assert binary.decode_log(data, CollectionConfig(3)) == ([], True) and binary.decode_log(b"", config) == ([], False)
    (tmp_path / "log").write_bytes(data)
    found = binary.read_logs(spark, str(tmp_path / "log"), config).orderBy("pos").collect()
    assert [(r.id_key, r.op) for r in found] == [("a", "put"), ("__bigint__:7", "delete")]


def test_encryption(spark, tmp_path):
    old, new = crypto.KeySource(key=b"k" * 32), crypto.KeySource(password="p", iterations=1000, previous=(crypto.KeySource(key=b"k" * 32),))
    blob = crypto.encrypt(spark, b"data", old)
    assert len(blob) == 110 + 4 and crypto.decrypt(spark, blob, old) == b"data" and crypto.decrypt(spark, blob, new) == b"data"
    again = crypto.rekey(spark, blob, old, new)
    assert again[82:] == blob[82:] and crypto.decrypt(spark, again, new) == b"data"
    assert crypto.decrypt(spark, crypto.encrypt_v1(spark, b"x", old), old) == b"x"
    with pytest.raises(InvalidConfig):
        crypto.decrypt(spark, again, old)
    with pytest.raises(FormatError):
        crypto.decrypt(spark, b"\x01\x00", old)
    (tmp_path / "a").write_bytes(blob)
    assert formats.migrate(spark, str(tmp_path / "a"), str(tmp_path / "b"), old, new) == "rekeyed"
    with pytest.raises(FormatError):
        formats.migrate(spark, str(tmp_path / "a"), str(tmp_path / "b"), old, new)


def test_import_export(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id":"a","text":"x","context":{"k":1}}\n\n{"id":"b","embedding":[1,2]}\n')
    rows = formats.read_entries(spark, str(tmp_path / "in.jsonl"))
    assert rows.count() == 2
    formats.export(rows.select("id", "context"), str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id":"a"}\n')
    with pytest.raises(FormatError):
        formats.read_entries(spark, str(tmp_path / "bad.jsonl"))
    assert spark.range(1).select(formats.parse_vector(F.lit("1, 2.5")).alias("a"), formats.parse_vector(F.lit("1,x")).alias("b")).first()[:] == ([1.0, 2.5], None)


def test_streaming_changes(spark, tmp_path):
    schema = "id_key string, x int, pos long, op string"
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    spark.createDataFrame([("a", 1, 0, "put"), ("b", 2, 1, "put"), ("a", 3, 2, "put")], schema).write.json(src)
    run = lambda: changes.apply_changes(spark.readStream.schema(schema).json(src), root, str(tmp_path / "ck")).awaitTermination()
    run()
    assert {(r.id_key, r.x) for r in changes.current(spark, root).collect()} == {("a", 3), ("b", 2)}
    spark.createDataFrame([("a", None, 3, "delete")], schema).write.mode("append").json(src)
    run()
    assert {(r.id_key, r.x) for r in changes.current(spark, root).collect()} == {("b", 2)}
    assert len([d for d in os.listdir(root) if d.startswith("v")]) == 2


def test_chunks(spark):
    text = "\n\n".join(["a" * 90, "b" * 200, "c" * 300, " ", "d" * 20])
    pages = spark.createDataFrame([("f", 1, text), ("f", 2, "tail"), ("f", 3, None)], "file string, page int, text string")
    rows = retrieval.chunks(pages).orderBy("chunk").collect()
    assert [(r.id, len(r.text)) for r in rows] == [("f:p1:c0", 292), ("f:p1:c1", 322), ("f:p2:c2", 4)]


def test_questions_and_citations(spark):
    ok = retrieval.valid_question(F.lit("what does the long report say about the new rules of access"), F.lit("other words stand here"), ("according",))
    row = spark.range(1).select(retrieval.citations(F.lit("x [2] y [1][2]")).alias("c"), ok.alias("ok"), retrieval.valid_question(F.lit("too short"), F.lit("x")).alias("short")).first()
    assert row.c == [2, 1] and row.ok and not row.short
