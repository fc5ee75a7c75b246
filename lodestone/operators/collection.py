"""Collections: immutable handles on DataFrames of (id_type, id, id_big, seq, embedding, context)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..types import CollectionConfig, InvalidConfig
from . import knn

#: id_type 0: string, 1: integer (up to 38 digits); strings sort before integers.
SCHEMA = "id_type tinyint, id string, id_big decimal(38,0), seq bigint, embedding array<double>, context variant"
ORDER = ("id_type", "id_big", "id")
#: Rows of a batch whose keys are broadcast.
BROADCAST_ROWS = 500_000


def id_key(kind: Column, text: Column) -> Column:
    """One text for each id; "5" and 5 differ."""
    return F.when(kind == 1, F.concat(F.lit("__bigint__:"), text)).otherwise(text)


def from_rows(df: DataFrame, ident: str, embedding: str = "embedding", context: str | None = None, seq: str | None = None) -> DataFrame:
    """A collection from columns. Integer ids stay integers; context is a struct, map, JSON text or VARIANT column."""
    kind = df.schema[ident].dataType
    number = isinstance(kind, T.IntegralType | T.DecimalType)
    if context is None:
        ctx = F.parse_json(F.lit(None).cast("string"))
    elif isinstance(df.schema[context].dataType, T.StringType):
        ctx = F.parse_json(context)
    elif isinstance(df.schema[context].dataType, T.StructType | T.MapType):
        ctx = F.to_variant_object(F.col(context))
    else:
        ctx = F.col(context)
    return df.select(
        F.lit(1 if number else 0).cast("tinyint").alias("id_type"),
        F.col(ident).cast("string").alias("id"),
        (F.col(ident).cast("decimal(38,0)") if number else F.lit(None).cast("decimal(38,0)")).alias("id_big"),
        (F.col(seq).cast("bigint") if seq else F.monotonically_increasing_id()).alias("seq"),
        V.doubles(F.col(embedding)).alias("embedding"),
        ctx.alias("context"),
    )


@dataclass(frozen=True)
class Collection:
    df: DataFrame
    config: CollectionConfig

    def _with(self, df: DataFrame) -> Collection:
        return replace(self, df=df)

    def _keyed(self, df: DataFrame | None = None) -> DataFrame:
        return (self.df if df is None else df).withColumn("_key", id_key(F.col("id_type"), F.col("id")))

    def check(self, entries: DataFrame) -> None:
        """Raises for the first entries without an id or with a bad vector; nothing is added then."""
        bad = entries.where(F.col("id").isNull() | ~V.valid(F.col("embedding"), self.config.dimensions)).select("seq", "id", F.size("embedding").alias("n")).orderBy("seq").limit(1).collect()
        if bad:
            what = "has no id" if bad[0].id is None else f"has {bad[0].n} values, some not finite or not {self.config.dimensions} in number"
            raise InvalidConfig(f"Entry at index {bad[0].seq}: {what}")

    def add_many(self, entries: DataFrame) -> Collection:
        """Upsert: whole rows replace those of the same id, which keep their place; the last of a batch wins."""
        self.check(entries)
        last = self._keyed(entries).groupBy("_key").agg(F.max_by(F.struct(*self.df.columns), "seq").alias("_new"), F.min("seq").alias("_first"))
        keys = last.select("_key")
        keys = F.broadcast(keys) if entries.count() <= BROADCAST_ROWS else keys  # with a small batch the collection's vectors don't move
        was = self._keyed().select("_key", F.col("seq").alias("_was")).join(keys, "_key", "left_semi")
        top = self.df.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("_next"))
        placed = last.join(was, "_key", "left").crossJoin(F.broadcast(top))  # one row
        seq = F.coalesce("_was", F.col("_next") + F.col("_first")).alias("seq")
        new = placed.select(*(seq if c == "seq" else F.col("_new")[c].alias(c) for c in self.df.columns))
        return self._with(self._keyed().join(keys, "_key", "left_anti").select(*self.df.columns).unionByName(new))

    add = add_many

    def delete(self, ids: DataFrame) -> Collection:
        """Drops the ids in columns id_type and id."""
        gone = self._keyed(ids).select("_key").distinct()
        return self._with(self._keyed().join(gone, "_key", "left_anti").drop("_key"))

    def found(self, ids: DataFrame) -> DataFrame:
        """_key and found of each asked id."""
        have = self._keyed().select("_key", F.lit(True).alias("found"))
        return self._keyed(ids).select("_key").distinct().join(have, "_key", "left").select("_key", F.coalesce("found", F.lit(False)).alias("found"))

    def delete_document(self, name: str) -> Collection:
        return self._with(self.df.where(~((F.col("id") == name) | F.col("id").startswith(name + ":"))))

    def get(self, ident: str | int) -> DataFrame:
        text = f"__bigint__:{ident}" if isinstance(ident, int) else ident
        coded = V.encode(F.col("embedding"), self.config.quantization, self.config.dimensions)
        return self._keyed().where(F.col("_key") == text).drop("_key").withColumn("embedding", V.decode(coded, self.config.quantization, self.config.dimensions))

    def stats(self) -> DataFrame:
        c = self.config
        return self.df.agg(F.count("*").alias("entry_count")).select("entry_count", F.lit(c.dimensions).alias("dimensions"), F.lit(c.quantization).alias("quantization"), F.lit(c.metric).alias("metric"), F.lit("brute-force").alias("index_status"))

    def query(self, vector: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
        """rank, ids, score and context of the k nearest."""
        return knn.nearest(self.df.drop("seq"), vector, self.config, k, where, ORDER)

    def query_by_text(self, text: str, embedder, k: int = 10, where: Column | None = None) -> DataFrame:
        self.config.check_embedder(embedder.model, embedder.dimensions)
        return self.query(embedder.embed_many([text])[0], k, where)

    def add_with_text(self, rows: DataFrame, embedder) -> Collection:
        """rows: a collection with a text column in place of the vectors."""
        self.config.check_embedder(embedder.model, embedder.dimensions)
        return self.add_many(rows.withColumn("embedding", embedder.column("text")).select(*self.df.columns))
