"""Encryption of snapshot and log bytes: direct (v1) and envelope (v2), by Spark's AES-GCM functions.

v1: 1, mode, salt 16, iv 12, tag 16, data. v2: 2, mode, key version u32, salt 16,
then iv, tag and bytes of the wrapped data key, then iv, tag and data. The
wrapped key is bound to the first six bytes.
"""

from __future__ import annotations

import hashlib
import os
import struct
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..types import FormatError, InvalidConfig

ITERATIONS = 100_000


@dataclass(frozen=True)
class KeySource:
    """A 32-byte key or a password; previous sources are tried in order when reading."""

    key: bytes | None = None
    password: str | None = None
    iterations: int = ITERATIONS
    version: int = 0
    previous: tuple[KeySource, ...] = field(default=())

    def __post_init__(self):
        if (self.key is None) == (self.password is None):
            raise InvalidConfig("give a key or a password")
        if self.key is not None and len(self.key) != 32:
            raise InvalidConfig("a key has 32 bytes")

    @property
    def mode(self) -> int:
        return 0 if self.key is not None else 1

    def derive(self, salt: bytes) -> bytes:
        return self.key if self.key is not None else hashlib.pbkdf2_hmac("sha256", self.password.encode(), salt, self.iterations, 32)


def _seal(spark: SparkSession, data: bytes, key: bytes, aad: bytes = b"") -> tuple[bytes, bytes, bytes]:
    """iv, tag, data."""
    iv = os.urandom(12)
    out = bytes(spark.range(1).select(F.aes_encrypt(F.lit(data), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(iv), F.lit(aad))).first()[0])
    return iv, out[-16:], out[12:-16]


def _open(spark: SparkSession, iv: bytes, tag: bytes, data: bytes, key: bytes, aad: bytes = b"") -> bytes | None:
    out = spark.range(1).select(F.try_aes_decrypt(F.lit(iv + data + tag), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))).first()[0]
    return None if out is None else bytes(out)


def _derived(salt: Column, source: KeySource) -> Column:
    """The key of each salt: a literal, or derived from the password on executors."""
    if source.key is not None:
        return F.lit(source.key)
    return F.pandas_udf(lambda s: pd.Series([source.derive(bytes(x)) for x in s]), "binary")(salt)


def opened(blob: Column, source: KeySource) -> Column:
    """The plain bytes of a column of encrypted files, opened where they lie; null where no key opens one. Plain files stay as they are."""
    part = lambda at, n=None: F.substring(blob, at + 1, n if n else 1 << 30)
    gcm = lambda sealed, key, aad=F.lit(b""): F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad)
    sealed = lambda iv, tag, data: F.concat(iv, data, tag)
    keys = (source, *source.previous)
    wrapped = sealed(part(22, 12), part(34, 16), part(50, 32))
    dek = F.coalesce(*(gcm(wrapped, _derived(part(6, 16), s), part(0, 6)) for s in keys))
    v2 = gcm(sealed(part(82, 12), part(94, 16), part(110)), dek)
    v1 = F.coalesce(*(gcm(sealed(part(18, 12), part(30, 16), part(46)), _derived(part(2, 16), s)) for s in keys))
    kind = F.hex(part(0, 1))
    return F.when(kind == "02", v2).when(kind == "01", v1).otherwise(blob)


def sealed_records(spark: SparkSession, records: list[bytes], dek: bytes) -> list[bytes]:
    """Records of a log, each encrypted by the data key as a version 1 blob, in one job."""
    rows = spark.createDataFrame([(n, bytearray(r), bytearray(os.urandom(16)), bytearray(os.urandom(12))) for n, r in enumerate(records)], "n int, data binary, salt binary, iv binary")
    out = F.aes_encrypt("data", F.lit(dek), F.lit("GCM"), F.lit("DEFAULT"), "iv", F.lit(b""))
    tag, body = F.substring(out, F.length(out) - 15, F.lit(16)), F.substring(out, F.lit(13), F.length(out) - 28)
    made = rows.select("n", F.concat(F.lit(b"\x01\x00"), "salt", "iv", tag, body).alias("blob")).orderBy("n").collect()
    return [bytes(r.blob) for r in made]


def opened_head(spark: SparkSession, path: str, head: bytes, source: KeySource, most: int) -> bytes:
    """The first plain bytes of an encrypted file that begins with head. It is opened on an executor, as only a whole file can be."""
    if head[:1] == b"\x02":
        data_key(spark, head, source)  # says what is wrong with an envelope or a key
    elif head[:1] != b"\x01" or len(head) < 46:
        raise FormatError("not encrypted, or cut short")
    row = spark.read.format("binaryFile").load(path).select(F.substring(opened(F.col("content"), source), 1, most).alias("head")).first()
    if row is None or row["head"] is None:
        raise InvalidConfig("no key opens this file")
    return bytes(row["head"])


def encrypt_v1(spark: SparkSession, data: bytes, source: KeySource) -> bytes:
    salt = os.urandom(16)
    iv, tag, body = _seal(spark, data, source.derive(salt))
    return bytes([1, source.mode]) + salt + iv + tag + body


def encrypt(spark: SparkSession, data: bytes, source: KeySource, data_key: bytes | None = None) -> bytes:
    head, salt, dek = struct.pack("<BBI", 2, source.mode, source.version), os.urandom(16), data_key or os.urandom(32)
    wrapped = _seal(spark, dek, source.derive(salt), head)
    return head + salt + b"".join(wrapped) + b"".join(_seal(spark, data, dek))


def data_key(spark: SparkSession, blob: bytes, source: KeySource) -> bytes:
    if len(blob) < 110 or blob[0] != 2:
        raise FormatError("no envelope")
    for s in (source, *source.previous):
        if (dek := _open(spark, blob[22:34], blob[34:50], blob[50:82], s.derive(blob[6:22]), blob[:6])) is not None:
            return dek
    raise InvalidConfig("no key opens this file")


def decrypt(spark: SparkSession, blob: bytes, source: KeySource) -> bytes:
    if blob[:1] == b"\x02":
        out = _open(spark, blob[82:94], blob[94:110], blob[110:], data_key(spark, blob, source))
    elif blob[:1] == b"\x01" and len(blob) >= 46:
        out = next((x for s in (source, *source.previous) if (x := _open(spark, blob[18:30], blob[30:46], blob[46:], s.derive(blob[2:18]))) is not None), None)
    else:
        raise FormatError("not encrypted, or cut short")
    if out is None:
        raise InvalidConfig("no key opens this file")
    return out


def rekey(spark: SparkSession, blob: bytes, old: KeySource, new: KeySource) -> bytes:
    """A new wrap of the same data key; the data bytes stay as they are."""
    dek, head, salt = data_key(spark, blob, old), struct.pack("<BBI", 2, new.mode, new.version), os.urandom(16)
    return head + salt + b"".join(_seal(spark, dek, new.derive(salt), head)) + blob[82:]


def is_encrypted(blob: bytes) -> bool:
    return len(blob) >= 46 and blob[0] in (1, 2) and blob[1] in (0, 1)
