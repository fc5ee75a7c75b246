"""Storage drivers: merge on read, encryption, checkpoints, data sources and migration."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators.collection import Collection, from_rows
from lodestone.sources import binary, crypto, datasource, drivers, formats
from lodestone.types import CollectionConfig, DimensionMismatch, FormatError

OPS = [
    {"op": "put", "id_type": 0, "id": "c", "data": [5.0, 5.0], "context": '{"v":3}'},
    {"op": "delete", "id_type": 0, "id": "a"},
    {"op": "put", "id_type": 0, "id": "b", "data": [7.0, 1.0], "context": None},
    {"op": "put", "id_type": 1, "id": "9", "data": [1.0, 2.0], "context": '{"v":9}'},
]
KEY = crypto.KeySource(key=b"k" * 32)


def collection(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], '{"v":1}', 0), ("b", [0.0, 1.0], None, 1)], "id string, embedding array<double>, context string, seq long")
    return Collection(from_rows(df, "id", context="context", seq="seq"), CollectionConfig(2))


def state(c):
    return [(r.id_type, r.id, r.embedding, r.c) for r in c.df.orderBy("seq").select("id_type", "id", "embedding", F.to_json("context").alias("c")).collect()]


def damage(path, data):
    """Writes a file behind the store's back, without the checksum that it keeps beside."""
    path.write_bytes(data)
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)


MERGED = [(0, "b", [7, 1], None), (0, "c", [5, 5], '{"v":3}'), (1, "9", [1, 2], '{"v":9}')]


@pytest.mark.parametrize("key", [None, KEY, crypto.KeySource(password="p", iterations=1000)])
def test_merge_on_read(spark, tmp_path, key):
    d = drivers.FileDriver(spark, str(tmp_path), log=True)
    d = d.with_encryption(key) if key else d
    assert d.read("x") is None and not d.exists("x") and not d.delete("x")
    with pytest.raises(FormatError, match="write it first"):
        d.append("x", OPS)
    d.write("x", collection(spark))
    assert d.append("x", OPS[:1]) == 1 and d.append("x", OPS[1:]) == 4 and d.append("x", []) == 4
    assert state(d.read("x")) == MERGED
    raw = (tmp_path / "x.vcr.log").read_bytes()
    assert (b'{"v":3}' in raw) == (key is None)
    damage(tmp_path / "x.vcr.log", raw[:-3])  # a cut record: the valid prefix counts, and is said to be one
    assert state(d.read("x")) == MERGED[:2] and d.changes("x").where("truncated").count() == 1
    d.checkpoint("x")
    assert not (tmp_path / "x.vcr.log").exists() and state(d.read("x")) == MERGED[:2]
    with pytest.raises(DimensionMismatch):
        d.read("x", CollectionConfig(3))
    assert d.exists("x") and d.delete("x") and not d.exists("x")
    d.destroy()
    assert not tmp_path.exists()


def test_flush_and_locks(spark, tmp_path):
    d = drivers.FileDriver(spark, str(tmp_path), log=True, acquire=0.5)
    assert d.flush("x", collection(spark), OPS[:1]) == "full" and d.flush("x", collection(spark), OPS[:1]) == "append" and d.flush("x", collection(spark)) == "full"
    assert not (tmp_path / "x.vcr.log").exists() and len(state(d.read("x"))) == 2
    with d.lock("x"), pytest.raises(FormatError, match="locked"):
        d.write("x", collection(spark))
    (tmp_path / "x.vcr.lock").write_text("left behind")
    drivers.FileDriver(spark, str(tmp_path), stale=-1).write("x", collection(spark))
    m = drivers.MemoryDriver()
    m.write("x", collection(spark))
    assert m.exists("x") and state(m.read("x"))[0][1] == "a" and m.delete("x") and not m.delete("x")
    n = drivers.NullDriver()
    n.write("x", collection(spark))
    assert n.read("x") is None


def test_wrong_key(spark, tmp_path):
    d = drivers.FileDriver(spark, str(tmp_path), KEY)
    d.write("x", collection(spark))
    with pytest.raises(Exception, match="no key opens"):
        binary.read_snapshots(spark, str(tmp_path / "x.vcr"), key=crypto.KeySource(key=b"z" * 32)).collect()
    with pytest.raises(FormatError, match="encrypted"):
        drivers.FileDriver(spark, str(tmp_path)).read("x")
    again = crypto.KeySource(key=b"z" * 32, previous=(KEY,))
    assert binary.read_snapshots(spark, str(tmp_path / "x.vcr"), key=again).count() == 2


def test_data_sources(spark, tmp_path):
    d = drivers.FileDriver(spark, str(tmp_path), log=True)
    d.write("x", collection(spark))
    d.append("x", OPS)
    for source in (datasource.SnapshotSource, datasource.LogSource):
        spark.dataSource.register(source)
    rows = spark.read.format("vcr").load(str(tmp_path / "*.vcr")).orderBy("seq").collect()
    assert [(r.id, r.embedding) for r in rows] == [("a", [1, 0]), ("b", [0, 1])]
    log = spark.read.format("vcrlog").option("dimensions", 2).load(str(tmp_path / "x.vcr.log")).orderBy("pos").collect()
    assert [(r.op, r.id_key, r.sequence) for r in log] == [("put", "c", 0), ("delete", "a", 1), ("put", "b", 2), ("put", "__bigint__:9", 3)]
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda: spark.readStream.format("vcrlog").option("dimensions", 2).load(str(tmp_path / "x.vcr.log")).writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out).awaitTermination()
    run()
    d.append("x", OPS[:1])
    run()
    assert [r.pos for r in spark.read.parquet(out).orderBy("pos").collect()] == [0, 1, 2, 3, 4]


def test_migration_takes_the_log(spark, tmp_path):
    d = drivers.FileDriver(spark, str(tmp_path), log=True)
    d.write("x", collection(spark))
    d.append("x", OPS)
    source, target = str(tmp_path / "x.vcr"), str(tmp_path / "y.vcr")
    assert formats.migrate(spark, source, target, None, KEY) == "merged"
    assert state(drivers.FileDriver(spark, str(tmp_path), KEY).read("y")) == MERGED
    raw = (tmp_path / "x.vcr.log").read_bytes()
    damage(tmp_path / "x.vcr.log", raw[:-1])
    with pytest.raises(FormatError, match="damaged"):
        formats.migrate(spark, source, str(tmp_path / "z.vcr"))
    (tmp_path / "x.vcr.lock").write_text("")
    with pytest.raises(FormatError, match="locked"):
        formats.migrate(spark, source, str(tmp_path / "z.vcr"))


def test_viewer_rows(spark, tmp_path):
    config = CollectionConfig(4, "BIT", "hamming")
    rows = [{"id_type": 1, "id": "12", "data": [0b10100000], "min": None, "max": None, "context": None}]
    (tmp_path / "b.vcr").write_bytes(binary.encode_snapshot(rows, config))
    r = binary.read_snapshots(spark, str(tmp_path / "b.vcr"), viewer=True).first()
    assert r.id == "bigint:12" and r.embedding == [1, 0, 1, 0]
    assert binary.unframed(struct.pack("<I", 2) + b"ab" + b"\x01") == ([b"ab"], True)


@pytest.mark.parametrize("key", [None, KEY])
def test_reads_take_heads_only(spark, tmp_path, monkeypatch, key):
    """Neither an append nor a read brings whole files to the driver, which they did for the settings in their heads."""
    d = drivers.FileDriver(spark, str(tmp_path), key, log=True)
    d.write("x", collection(spark))
    d.append("x", OPS[:1])
    monkeypatch.setattr(formats, "read_bytes", lambda *a: pytest.fail("a whole file was read"))
    assert d.config("x") == CollectionConfig(2)
    assert d.append("x", OPS[1:]) == 4 and state(d.read("x")) == MERGED


@pytest.mark.parametrize("codec", ["F32", "INT8", "BIT"])
def test_snapshot_parts(spark, monkeypatch, codec):
    """Entries encoded by the tasks are those encoded one by one, in order, however they are cut."""
    rows = [(f"é{i}", [float(i), -1.5, i / 7], None if i % 3 else f'{{"v":{i}}}', 100 - i) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, context string, seq long").repartition(5)
    config = CollectionConfig(3, codec, embedder_id="m")
    c = Collection(from_rows(df, "id", context="context", seq="seq"), config)
    coded = c.df.orderBy("seq").select("id_type", "id", V.encode(F.col("embedding"), codec, 3).alias("q"), F.to_json("context").alias("context")).collect()
    want = binary.encode_snapshot([{"id_type": r.id_type, "id": r.id, "context": r.context, **r.q.asDict()} for r in coded], config)
    monkeypatch.setattr(formats, "PIECE", 100)
    parts = list(formats.snapshot_parts(c.df, config))
    assert len(parts) > 5 and b"".join(parts) == want == formats.snapshot_bytes(c.df, config)
    assert b"".join(formats.snapshot_parts(c.df.limit(0), config)) == binary.encode_snapshot([], config)
    for file in (want, binary.brotli(want), binary.brotli(iter(parts))):
        assert binary.head_of(file) == binary.snapshot_header(want)


def test_head_of_a_cut_file():
    """The head of a large packed file is read from its first bytes."""
    config = CollectionConfig(64, embedder_id="m" * 60_000)
    entries = [{"id_type": 0, "id": str(i), "data": v, "context": None} for i, v in enumerate(np.random.default_rng(1).normal(size=(900, 64)))]
    whole = binary.encode_snapshot(entries, config)
    packed = binary.brotli(whole)
    assert len(packed) > binary.HEAD_BYTES
    assert binary.head_of(packed[: binary.HEAD_BYTES]) == binary.head_of(whole[: binary.HEAD_BYTES]) == binary.snapshot_header(whole)
    with pytest.raises(FormatError, match="brotli"):
        binary.head_of(b"no snapshot at all")
