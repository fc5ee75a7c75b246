"""Import of JSON and JSON Lines, export to json, jsonl, csv and text tables, and snapshot files."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import changelog
from ..types import CollectionConfig, FormatError
from . import binary, crypto


#: Bytes of entries that a task packs together, and that are handed to a store at once.
PIECE = 4 << 20


def read_entries(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    """id, text, embedding, context (VARIANT) of a file of entries; a malformed line is an error."""
    schema = "id string, text string, embedding array<double>, context variant"
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if kind == "jsonl":
        # line numbers count the lines with something on them; a file is read in order by one task only where a line is bad
        lines = spark.read.text(path).where(F.trim("value") != "")
        if not lines.where(F.try_parse_json("value").isNull()).isEmpty():
            numbered = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("n", "value"))
            first = numbered.where(F.try_parse_json("value").isNull()).agg(F.min("n")).first()[0]
            raise FormatError(f"Invalid JSON on line {first + 1}")
    rows = reader.option("multiLine", kind == "json").json(path)
    bad = rows.where(F.col("text").isNull() & F.col("embedding").isNull()).limit(1).collect()
    if bad:
        raise FormatError(f"entry {bad[0].id!r} has neither text nor embedding")
    if rows.isEmpty():
        raise FormatError("no entries")
    return rows


def parse_vector(text) -> F.Column:
    """"0.1,0.2" as an array; a part that is no number makes it null."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def flat(df: DataFrame, keys: list[str], context: str = "context") -> DataFrame:
    """One text column `context.k` for each key, in place of the context."""
    return df.select("*", *(F.try_variant_get(context, "$" + "".join("[" + json.dumps(x, ensure_ascii=False) + "]" for x in k.split(".")), "string").alias(f"context.{k}") for k in keys)).drop(context)


def context_keys(df: DataFrame, context: str = "context") -> list[str]:
    """The dotted paths of all contexts' leaves, sorted: the columns of a table. Objects are opened, arrays are leaves."""
    spark, out = df.sparkSession, set()
    level = df.where(F.col(context).isNotNull()).select(F.lit("").alias("path"), F.col(context).alias("v"))
    while True:
        inner = level.where(F.schema_of_variant("v").startswith("OBJECT"))
        level = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.concat_ws(".", F.nullif("path", F.lit("")), "key").alias("path"), F.col("value").alias("v"))
        found = level.groupBy("path").agg(F.bool_or(~F.schema_of_variant("v").startswith("OBJECT")).alias("leaf"), F.bool_or(F.schema_of_variant("v").startswith("OBJECT")).alias("open")).collect()
        out |= {r.path for r in found if r.leaf}
        if not any(r.open for r in found):
            return sorted(out)


def export(df: DataFrame, path: str, kind: str = "jsonl", embedding: bool = False) -> None:
    """Writes rows as committed part files. Contexts are JSON; csv writes arrays and contexts as JSON text."""
    rows = df if embedding else df.drop("embedding")
    if kind in ("json", "jsonl"):
        rows.write.mode("overwrite").json(path)
    elif kind == "csv":
        if dict(rows.dtypes).get("context") == "variant":
            rows = flat(rows, context_keys(rows))
        text = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map", "variant")) else F.col(f"`{c}`") for c, t in rows.dtypes]
        rows.select(*text).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        raise FormatError(f"unknown format {kind}")


def as_table(df: DataFrame, rows: int = 50) -> str:
    """A text table of one page; arrays show their length."""
    shown = df.select(*(F.concat(F.lit("["), F.size(c).cast("string"), F.lit(" items]")).alias(c) if t.startswith("array") else F.col(f"`{c}`").cast("string").alias(c) for c, t in df.dtypes)).limit(rows).collect()
    names = df.columns
    width = [max([len(n), *(len(str(r[i])) for r in shown)]) for i, n in enumerate(names)]
    lines = ["  ".join(n.ljust(w) for n, w in zip(names, width, strict=True)), "  ".join("-" * w for w in width)]
    return "\n".join([*lines, *("  ".join(str("" if v is None else v).ljust(w) for v, w in zip(r, width, strict=True)) for r in shown)])


def snapshot_parts(df: DataFrame, config: CollectionConfig) -> Iterator[bytes]:
    """One snapshot file of a collection, in pieces. The format is a single file, so its bytes pass the driver once, encoded and packed by the tasks."""
    coded = df.orderBy("seq").select("id_type", "id", V.encode(F.col("embedding"), config.quantization, config.dimensions).alias("q"), F.to_json("context").alias("context"))
    ends = [F.col(f"q.{c}") if config.quantization == "INT8" else F.lit(None).cast("double").alias(c) for c in ("min", "max")]
    rows = coded.select("id_type", "id", "q.data", *ends, "context")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda entries: pa.RecordBatch.from_pylist([{"n": len(entries), "size": len(raw := b"".join(entries)), "packed": pa.compress(raw, "zstd", asbytes=True)}])
        held, size = [], 0
        for batch in batches:
            for entry in binary.encode_entries(batch, config.quantization):
                held.append(entry)
                size += len(entry)
                if size >= PIECE:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    packed = list(rows.mapInArrow(pack, "n bigint, size bigint, packed binary").toLocalIterator())
    yield binary.snapshot_head(config, sum(r.n for r in packed))
    for r in packed:
        yield pa.decompress(bytes(r.packed), r.size, "zstd", asbytes=True)


def snapshot_bytes(df: DataFrame, config: CollectionConfig) -> bytes:
    return b"".join(snapshot_parts(df, config))


def write_bytes(spark: SparkSession, data: bytes | Iterable[bytes], path: str, append: bool = False) -> None:
    """Through Hadoop's file systems: a temporary name, then a rename over the target, so a reader sees the old file or the new.

    append puts the target's bytes before, copied inside the store's client.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    temp = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(temp, True)
    try:
        if append and fs.exists(target):
            old = fs.open(target)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(old, out, PIECE, False)
            finally:
                old.close()
        for part in [data] if isinstance(data, bytes) else data:
            for at in range(0, len(part), PIECE):
                out.write(bytearray(part[at : at + PIECE]))
    finally:
        out.close()
    replace(spark, path + ".tmp", path)


def replace(spark: SparkSession, temp: str, target: str) -> None:
    """Renames a file over another in one step, by the file context that every Hadoop store has."""
    jvm = spark._jvm.org.apache.hadoop.fs
    option = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = next(x for x in option.getEnumConstants() if x.name() == "OVERWRITE")
    source = jvm.Path(temp)
    source = source.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(source)
    jvm.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()).rename(source, jvm.Path(target), options)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share, or in a local one where the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise FormatError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory())


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A whole file, or None where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    row = spark.read.format("binaryFile").load(path).first()
    return bytes(row.content) if row else b""  # an empty file has no row


def read_head(spark: SparkSession, path: str, most: int) -> bytes | None:
    """The first bytes of a file, or None where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    source = fs.open(target)
    try:
        return bytes(source.readNBytes(most))
    finally:
        source.close()


def migrate(spark: SparkSession, source: str, target: str, old: crypto.KeySource | None = None, new: crypto.KeySource | None = None, force: bool = False) -> str:
    """Copies a snapshot under another key or none, verified by reading it back.

    A log beside the source is merged into the copy; a damaged log is an error unless forced, as its tail would be lost. A
    source that is locked is being written and can't be copied. An envelope without a log that stays one is only rewrapped.
    """
    blob = read_bytes(spark, source)
    if blob is None:
        raise FormatError(f"{source} doesn't exist")
    if source == target:
        raise FormatError("source and target are the same file")
    if not force and read_bytes(spark, target) is not None:
        raise FormatError(f"{target} exists")
    if read_bytes(spark, source + ".lock") is not None:
        raise FormatError(f"{source} is locked")
    if old is None and crypto.is_encrypted(blob) and blob[:4] != binary.SNAPSHOT:
        raise FormatError(f"{source} is encrypted, and no key was given")
    plain = crypto.decrypt(spark, blob, old) if old else blob
    how = "rewritten"
    if read_bytes(spark, source + ".log"):
        header = binary.snapshot_header(binary._plain(plain))
        config = CollectionConfig(header["dimensions"], header["quantization"], header["metric"], header["embedder_id"])
        dek = crypto.data_key(spark, blob, old) if old and blob[:1] == b"\x02" else None
        log = binary.log_files(spark, source + ".log", config, dek)
        if not force and not log.where("truncated").isEmpty():
            raise FormatError(f"{source}.log is damaged; its valid part is taken when forced")
        merged = changelog.merged(binary.read_snapshots(spark, source, config, old), log.where("NOT truncated"))
        plain, how = binary.brotli(snapshot_bytes(merged, config)), "merged"
        out = crypto.encrypt(spark, plain, new) if new else plain
    elif old and new and blob[:1] == b"\x02":
        out, how = crypto.rekey(spark, blob, old, new), "rekeyed"
    else:
        out = crypto.encrypt(spark, plain, new) if new else plain
    write_bytes(spark, out, target)
    again = read_bytes(spark, target)
    if (crypto.decrypt(spark, again, new) if new else again) != plain:
        raise FormatError("the copy doesn't hold the same data")
    return how
