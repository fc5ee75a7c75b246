"""The collection snapshot and change-log file formats, as bytes and as DataFrames.

Files are read by Spark's binaryFile source, so any store works, and decoded on
executors; contexts travel as JSON text and become VARIANT in the JVM.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import METRICS, QUANTIZATIONS, CollectionConfig, DimensionMismatch, FormatError
from . import crypto

SNAPSHOT, LOG = b"VCR\x01", b"WVCR"
_HEAD, _LOG_HEAD = struct.Struct("<4sBIBBIB"), struct.Struct("<4sBIBH")
ROW = "id_type tinyint, id string, data array<double>, min double, max double, context string"


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FormatError(f"the file ends inside an entry, at byte {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str):
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]


def _put_vector(codes: dict, quantization: str) -> bytes:
    if quantization == "F32":
        return np.asarray(codes["data"], "<f8").tobytes()
    if quantization == "INT8":
        return struct.pack("<dd", codes["min"], codes["max"]) + np.asarray(codes["data"], np.int8).tobytes()
    return np.asarray(codes["data"], np.uint8).tobytes()


def _get_vector(r: _Reader, quantization: str, dimensions: int) -> tuple[list[float], float | None, float | None]:
    if quantization == "F32":
        return np.frombuffer(r.take(8 * dimensions), "<f8").tolist(), None, None
    if quantization == "INT8":
        low, high = struct.unpack("<dd", r.take(16))
        return np.frombuffer(r.take(dimensions), np.int8).astype(float).tolist(), low, high
    return np.frombuffer(r.take((dimensions + 7) // 8), np.uint8).astype(float).tolist(), None, None


def _put_id(kind: int, text: str) -> bytes:
    raw = text.encode()
    return struct.pack("<BI", kind, len(raw)) + raw


def _put_context(context: str | None) -> bytes:
    raw = (context or "").encode()
    return struct.pack("<I", len(raw)) + raw


def snapshot_head(config: CollectionConfig, entries: int) -> bytes:
    meta = json.dumps({"embedderId": config.embedder_id} if config.embedder_id else {}).encode()
    if len(meta) > 65535:
        raise FormatError("metadata is over 65535 bytes")
    head = _HEAD.pack(SNAPSHOT, 2, config.dimensions, QUANTIZATIONS.index(config.quantization), METRICS.index(config.metric), entries, 0)
    return head + struct.pack("<H", len(meta)) + meta


def encode_snapshot(rows: Iterable[dict], config: CollectionConfig) -> bytes:
    """rows: id_type, id, data, min, max, context (JSON text or None), in insertion order."""
    body = [_put_id(r["id_type"], r["id"]) + _put_vector(r, config.quantization) + _put_context(r.get("context")) for r in rows]
    return snapshot_head(config, len(body)) + b"".join(body)


def encode_entries(batch: pa.RecordBatch, quantization: str) -> Iterator[bytes]:
    """The entries of a snapshot from columns id_type, id, data, min, max and context."""
    data = batch.column("data")
    if data.null_count or batch.column("id").null_count:
        raise FormatError("an entry has no id or no vector")
    codes = np.asarray(data.flatten()).astype({"F32": "<f8", "INT8": np.int8, "BIT": np.uint8}[quantization])
    raw, ends = codes.tobytes(), np.asarray(data.offsets).astype(np.int64)
    ends = ((ends - ends[0]) * codes.itemsize).tolist()
    others = (batch.column(c).to_pylist() for c in ("id_type", "id", "min", "max", "context"))
    for n, (kind, ident, low, high, context) in enumerate(zip(*others, strict=True)):
        span = struct.pack("<dd", low, high) if quantization == "INT8" else b""
        yield _put_id(kind, ident) + span + raw[ends[n] : ends[n + 1]] + _put_context(context)


def snapshot_header(data: bytes) -> dict:
    """Settings, version and entry count; needs only the head of the file."""
    if len(data) < _HEAD.size:
        raise FormatError(f"a snapshot has {_HEAD.size} bytes at least, this has {len(data)}")
    magic, version, dimensions, quantization, metric, count, _ = _HEAD.unpack_from(data)
    if magic != SNAPSHOT:
        raise FormatError("bad magic")
    if version not in (1, 2):
        raise FormatError(f"unsupported version {version}")
    if quantization > 2 or metric > 3:
        raise FormatError("unknown quantization or metric")
    found = {"version": version, "dimensions": dimensions, "quantization": QUANTIZATIONS[quantization], "metric": METRICS[metric], "entry_count": count, "embedder_id": None, "body": _HEAD.size}
    if version == 2:
        r = _Reader(data, _HEAD.size)
        size = r.number("<H")
        try:
            found["embedder_id"] = json.loads(r.take(size)).get("embedderId")
        except (ValueError, AttributeError):
            raise FormatError("metadata is no JSON object") from None
        found["body"] = r.at
    return found


def check_header(header: dict, config: CollectionConfig) -> None:
    if header["dimensions"] != config.dimensions:
        raise DimensionMismatch(config.dimensions, header["dimensions"])
    if header["quantization"] != config.quantization:
        raise FormatError(f"quantization is {header['quantization']}, not {config.quantization}")


def decode_snapshot(data: bytes) -> Iterator[dict]:
    h = snapshot_header(data)
    r = _Reader(data, h["body"])
    for seq in range(h["entry_count"]):
        kind = r.number("<B")
        text = r.take(r.number("<I")).decode()
        codes, low, high = _get_vector(r, h["quantization"], h["dimensions"])
        context = r.take(r.number("<I")).decode() or None
        yield {"id_type": kind, "id": text, "data": codes, "min": low, "max": high, "context": context, "seq": seq}


def encode_log(ops: Iterable[dict], config: CollectionConfig, first: int = 0, header: bool = True) -> bytes:
    """ops: op ('put' or 'delete'), id_type, id and, for puts, codes and context."""
    out = [_LOG_HEAD.pack(LOG, 1, config.dimensions, QUANTIZATIONS.index(config.quantization), 0)] if header else []
    for n, op in enumerate(ops, first):
        body = struct.pack("<IB", n, 0 if op["op"] == "put" else 1) + _put_id(op["id_type"], op["id"])
        if op["op"] == "put":
            body += _put_vector(op, config.quantization) + _put_context(op.get("context"))
        out.append(struct.pack("<I", len(body)) + body + struct.pack("<I", zlib.crc32(body)))
    return b"".join(out)


def decode_log(data: bytes, config: CollectionConfig) -> tuple[list[dict], bool]:
    """The valid prefix, and whether something after it is cut or damaged. pos, not sequence, orders the changes."""
    if len(data) < _LOG_HEAD.size:
        return [], bool(data)
    magic, version, dimensions, quantization, _ = _LOG_HEAD.unpack_from(data)
    if (magic, version, dimensions, quantization) != (LOG, 1, config.dimensions, QUANTIZATIONS.index(config.quantization)):
        return [], True
    out, at = [], _LOG_HEAD.size
    while at < len(data):
        if at + 4 > len(data):
            return out, True
        size = int.from_bytes(data[at : at + 4], "little")
        body, crc = data[at + 4 : at + 4 + size], data[at + 4 + size : at + 8 + size]
        if len(crc) < 4 or zlib.crc32(body) != int.from_bytes(crc, "little"):
            return out, True
        try:
            r = _Reader(body)
            seq, op, kind = r.number("<I"), r.number("<B"), r.number("<B")
            row = {"pos": len(out), "sequence": seq, "op": "delete" if op else "put", "id_type": kind, "id": r.take(r.number("<I")).decode(), "data": None, "min": None, "max": None, "context": None}
            if not op:
                row["data"], row["min"], row["max"] = _get_vector(r, config.quantization, config.dimensions)
                row["context"] = r.take(r.number("<I")).decode() or None
        except (FormatError, UnicodeDecodeError):
            return out, True
        out.append(row)
        at += 8 + size
    return out, False


def _plain(data: bytes) -> bytes:
    """Brotli or raw bytes."""
    if data[:4] in (SNAPSHOT, LOG):
        return data
    try:
        return pa.input_stream(pa.BufferReader(data), compression="brotli").read()
    except OSError as e:
        raise FormatError(f"neither a snapshot nor brotli: {e}") from None


#: Bytes of a file, packed or not, that hold a snapshot's head.
HEAD_BYTES = 1 << 18


def head_of(data: bytes) -> dict:
    """snapshot_header from the first HEAD_BYTES of a file, brotli or raw."""
    if data[:4] in (SNAPSHOT, LOG):
        return snapshot_header(data)
    try:
        plain = pa.input_stream(pa.BufferReader(data), compression="brotli")
        head = plain.read(_HEAD.size)
        if len(head) == _HEAD.size and head[4] == 2:
            head += plain.read(2)
            head += plain.read(int.from_bytes(head[_HEAD.size :], "little"))
    except OSError as e:
        raise FormatError(f"neither a snapshot nor brotli: {e}") from None
    return snapshot_header(head)


def brotli(data: bytes | Iterable[bytes]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "brotli") as out:
        for part in [data] if isinstance(data, bytes) else data:
            out.write(part)
    return sink.getvalue().to_pybytes()


def _files(spark: SparkSession, path: str, key: crypto.KeySource | None) -> DataFrame:
    """path and content of the files at a path, decrypted in the JVM where they are encrypted; a file that no key opens is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if key is None:
        return files
    plain = F.when(F.length("content") == 0, F.col("content")).otherwise(crypto.opened(F.col("content"), key))
    return files.select("path", F.coalesce(plain, F.raise_error(F.concat(F.lit("no key opens "), "path"))).alias("content"))


def read_snapshots(spark: SparkSession, path: str, config: CollectionConfig | None = None, key: crypto.KeySource | None = None, viewer: bool = False) -> DataFrame:
    """path, seq, id_type, id, id_big, embedding (decoded), context of every entry of the files at a path.

    With a config, files of other dimensions or codes are an error. viewer decodes bits as 1 and 0 and writes integer ids as bigint:n.
    """
    zero, mark = (0.0, "bigint:") if viewer else (-1.0, "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame.path, frame.content, strict=True):
                h = snapshot_header(plain := _plain(bytes(data)))
                if config is not None:
                    check_header(h, config)
                batch = []
                for row in decode_snapshot(plain):
                    batch.append((name, row["seq"], row["id_type"], row["id"], _decoded(row, h["quantization"], h["dimensions"], zero), row["context"]))
                    if len(batch) == 2000:
                        yield pd.DataFrame(batch, columns=["path", "seq", "id_type", "id", "embedding", "context"])
                        batch = []
                yield pd.DataFrame(batch, columns=["path", "seq", "id_type", "id", "embedding", "context"])

    rows = _files(spark, path, key).mapInPandas(run, "path string, seq bigint, id_type tinyint, id string, embedding array<double>, context string")
    shown = F.when(F.col("id_type") == 1, F.concat(F.lit(mark), F.col("id"))).otherwise(F.col("id")).alias("id")
    return rows.select("path", "seq", "id_type", shown, F.when(F.col("id_type") == 1, F.col("id").cast("decimal(38,0)")).alias("id_big"), "embedding", F.parse_json("context").alias("context"))


def _decoded(row: dict, quantization: str, dimensions: int, zero: float = -1.0) -> list[float]:
    if quantization == "F32":
        return row["data"]
    if quantization == "INT8":
        low, span = row["min"], row["max"] - row["min"]
        return [low if span == 0 else (c + 128) / 255 * span + low for c in row["data"]]
    return np.where(np.unpackbits(np.array(row["data"], np.uint8))[:dimensions], 1.0, zero).tolist()


def unframed(data: bytes) -> tuple[list[bytes], bool]:
    """The sealed records of an encrypted log, each after its length, and whether the last is cut."""
    out, at = [], 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        if at + 4 + size > len(data):
            return out, True
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at < len(data)


def framed(records: Iterable[bytes]) -> bytes:
    return b"".join(struct.pack("<I", len(r)) + r for r in records)


def _log_rows(name: str, data: bytes, cut: bool, config: CollectionConfig) -> pd.DataFrame:
    """The changes of one file; where something after them is cut or damaged, a last row without a change says so."""
    rows, damaged = decode_log(data, config)
    out = [(name, r["pos"], r["sequence"], r["op"], f"__bigint__:{r['id']}" if r["id_type"] else r["id"], r["id_type"], r["id"], None if r["data"] is None else _decoded(r, config.quantization, config.dimensions), r["context"], False) for r in rows]
    if damaged or cut:
        out.append((name, len(rows), None, None, None, None, None, None, None, True))
    return pd.DataFrame(out, columns=_LOG_COLUMNS)


_LOG_COLUMNS = ["path", "pos", "sequence", "op", "id_key", "id_type", "id", "embedding", "context", "truncated"]
LOG_ROW = "path string, pos bigint, sequence bigint, op string, id_key string, id_type tinyint, id string, embedding array<double>, context string, truncated boolean"


def log_files(spark: SparkSession, path: str, config: CollectionConfig, dek: bytes | None = None) -> DataFrame:
    """LOG_ROW of the log files at a path, whose records are sealed where a data key is given."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data, cut in zip(frame.path, frame.content, frame.cut, strict=True):
                yield _log_rows(name, _plain(bytes(data)) if data else b"", bool(cut), config)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if dek is None:
        return files.withColumn("cut", F.lit(False)).mapInPandas(run, LOG_ROW)

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame.path, frame.content, strict=True):
                found, cut = unframed(bytes(data))
                yield pd.DataFrame({"path": name, "n": list(range(len(found) + 1)), "blob": [*found, None], "cut": cut})

    # the marker row keeps a file without records; a record that the key doesn't open ends the valid prefix
    sealed = files.mapInPandas(records, "path string, n int, blob binary, cut boolean")
    plain = crypto.opened(F.col("blob"), crypto.KeySource(key=dek))
    parts = sealed.withColumn("plain", plain).groupBy("path").agg(F.max("cut").alias("cut"), F.min(F.when(F.col("blob").isNotNull() & F.col("plain").isNull(), F.col("n"))).alias("bad"), F.array_sort(F.collect_list(F.when(F.col("plain").isNotNull(), F.struct("n", "plain")))).alias("parts"))
    good = F.filter("parts", lambda x: F.col("bad").isNull() | (x["n"] < F.col("bad")))
    whole = F.aggregate(good, F.lit(b""), lambda s, x: F.concat(s, x["plain"]))
    return parts.select("path", whole.alias("content"), (F.col("cut") | F.col("bad").isNotNull()).alias("cut")).mapInPandas(run, LOG_ROW)


def read_logs(spark: SparkSession, path: str, config: CollectionConfig, dek: bytes | None = None) -> DataFrame:
    """path, pos, sequence, op, id_key, id_type, id, embedding, context of the valid prefixes of log files."""
    return log_files(spark, path, config, dek).where("NOT truncated").drop("truncated")
