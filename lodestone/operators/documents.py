"""find, count, distinct and field paths over document contexts, with both orders of nulls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import VariantField, variant_path

#: Rows of a range that one task sorts when all rows are placed.
RANGE_ROWS = 250_000


def _sort_keys(value: Column, ascending: bool, dialect: str, kind: str) -> list[tuple[Column, Callable]]:
    """What a path sorts by, and which way. Numbers by value, the rest by text. cli: null and missing first ascending, last descending; viewer: missing last either way."""
    if kind == "variant":
        field = VariantField(value)
        missing = value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False)) if dialect == "cli" else value.isNull()
        number, text = field.number(), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
        # null and missing tie and keep their order
        number, text = F.when(~missing, number), F.when(~missing, text)
    else:
        missing = value.isNull()
        number, text = (F.lit(None).cast("double"), value) if kind == "string" else (value, F.lit(None).cast("string"))
    text = F.collate(text, "UNICODE")
    if ascending:
        return [(missing, F.desc if dialect == "cli" else F.asc), (number, F.asc_nulls_last), (text, F.asc)]
    return [(missing, F.asc), (number, F.desc_nulls_first), (text, F.desc)]


def sort(df: DataFrame, keys: dict[str, int], dialect: str = "cli", context: str = "context", seq: str = "seq") -> DataFrame:
    """A stable sort by one or more paths, 1 up and -1 down; a viewer's 0 leaves the order."""
    return df.orderBy(*sort_columns(df, keys, dialect, context), seq)


def sort_columns(df: DataFrame, keys: dict[str, int], dialect: str = "cli", context: str = "context") -> list[Column]:
    """What sort orders by, before the order of insertion."""
    return [way(c) for c, way in _sort_pairs(df, keys, dialect, context)]


def _sort_pairs(df: DataFrame, keys: dict[str, int], dialect: str, context: str) -> list[tuple[Column, Callable]]:
    order, kinds = [], {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for path, way in keys.items():
        if dialect == "viewer" and way == 0:
            continue
        name = path.removeprefix("context.")
        if kinds.get(context) == "variant" and name not in kinds:
            order += _sort_keys(variant_path(F.col(context), name), way > 0, dialect, "variant")
        elif name in kinds:
            order += _sort_keys(F.col(name), way > 0, dialect, kinds[name])
    return order


def places(df: DataFrame, keys: dict[str, int], ident: str, folder: str, dialect: str = "cli", context: str = "context", seq: str = "seq") -> DataFrame:
    """ident and place, each row's rank from 1 in sort's order, with no more than about RANGE_ROWS rows sorted in a task.

    Rows are ranged over tasks by the sort's keys and seq, sorted there and written to folder, as ranges
    drawn again would differ; the ranges' counts give each one's first place.
    """
    pairs = _sort_pairs(df, keys, dialect, context)
    keyed = df.select(F.col(ident).alias("_id"), F.col(seq).alias("_seq"), *(c.alias(f"_key{n}") for n, (c, _) in enumerate(pairs)))
    order = [*(way(f"_key{n}") for n, (_, way) in enumerate(pairs)), F.asc("_seq")]
    ranged = keyed.repartitionByRange(max(1, -(-df.count() // RANGE_ROWS)), *order).sortWithinPartitions(*order)
    own = ranged.select(F.col("_id").alias(ident), F.monotonically_increasing_id().alias("_at"))  # the range above 33 bits of the row's number in it
    own.write.mode("overwrite").parquet(folder)
    own = df.sparkSession.read.schema(own.schema).parquet(folder).withColumn("_range", F.shiftright("_at", 33).cast("int"))
    first, total = [], 0
    for r in own.groupBy("_range").count().orderBy("_range").collect():  # a row a range
        first.append((r["_range"], total + 1))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(first, "_range int, _first long")
    return own.join(F.broadcast(starts), "_range").select(ident, (F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def find(df: DataFrame, where: Column | None = None, keys: dict[str, int] | None = None, skip: int = 0, limit: int = 50, dialect: str = "cli", seq: str = "seq") -> DataFrame:
    """Matching rows, sorted, one page of them; without keys in insertion order."""
    rows = df if where is None else df.where(where)
    rows = sort(rows, keys, dialect, seq=seq) if keys else rows.orderBy(seq)
    return rows.offset(skip).limit(limit) if skip else rows.limit(limit)


def page(df: DataFrame, where: Column | None = None, keys: dict[str, int] | None = None, skip: int = 0, limit: int = 50, dialect: str = "cli", seq: str = "seq") -> tuple[DataFrame, str | None]:
    """The rows of find, and "Showing a-b of n" where more rows match than the page reaches."""
    total = count(df, where).first()[0]
    note = f"Showing {skip + 1}-{min(total, skip + limit)} of {total}" if total > skip + limit else None
    return find(df, where, keys, skip, limit, dialect, seq), note


def count(df: DataFrame, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.where(where)).agg(F.count("*").alias("count"))


def distinct(df: DataFrame, path: str, dialect: str = "viewer", context: str = "context") -> DataFrame:
    """value (JSON text in the viewer, plain text in the cli): different values that exist, by text.

    The viewer keeps 1 and "1" apart and keeps null; objects and arrays never merge there.
    """
    value = variant_path(F.col(context), path.removeprefix("context."))
    rows = df.select(value.alias("v")).where(F.col("v").isNotNull())
    kind = F.schema_of_variant("v")
    text = F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v"))
    if dialect == "cli":
        return rows.select(text.alias("value")).distinct().orderBy("value")
    tagged = rows.select(F.regexp_extract(kind, "^[A-Z]+", 0).alias("kind"), F.to_json("v").alias("value"), text.alias("text"))
    own = tagged.where(F.col("kind").isin("ARRAY", "OBJECT"))
    number = F.when(F.col("kind").isin("DECIMAL", "DOUBLE", "FLOAT", "BIGINT"), F.lit("NUMBER")).otherwise(F.col("kind"))
    plain = tagged.where(~F.col("kind").isin("ARRAY", "OBJECT")).withColumn("kind", number).distinct()
    return plain.unionByName(own).orderBy("text", "kind").select("kind", "value")


def field_paths(df: DataFrame, sample: int = 100, context: str = "context", seq: str = "seq") -> DataFrame:
    """path: the dotted paths of the first contexts, from `context.` on, as an editor offers them; sample is the feature's size."""
    spark, name = df.sparkSession, "context"
    first = [r.c for r in df.where(F.col(context).isNotNull()).orderBy(seq).limit(sample).select(F.to_json(context).alias("c")).collect()]
    level = spark.createDataFrame([(c,) for c in first], "c string").select(F.lit(name).alias("path"), F.parse_json("c").alias("v"))
    out = spark.createDataFrame([], "path string")
    while True:
        inner = level.where(F.schema_of_variant("v").startswith("OBJECT"))
        level = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.concat_ws(".", "path", "key").alias("path"), F.col("value").alias("v"))
        if level.isEmpty():
            return out.distinct().orderBy("path")
        out = out.unionAll(level.select("path"))
