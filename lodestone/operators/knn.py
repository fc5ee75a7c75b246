"""Exact nearest neighbours: one query as a literal, many queries in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..types import CollectionConfig

#: Query vectors of a block: what one pass over the collection ships, at 8 bytes a dimension.
QUERY_BLOCK = 4096
#: Queries and rows that a task scores at once, at 8 bytes a pair in each of about five arrays.
QUERY_TILE, ROW_TILE = 256, 1024


def top_limit(k: int, total: int | None = None) -> int:
    """A negative k drops the last |k| results, which needs the total."""
    return k if k >= 0 else max(0, (total or 0) + k)


def nearest(df: DataFrame, vector: list[float], config: CollectionConfig, k: int = 10, where: Column | None = None, ties: tuple[str, ...] = ("id",), embedding: str = "embedding") -> DataFrame:
    """rank, the ties' columns, score and the other columns but the vector, of the k best.

    The filter runs before scoring and reaches the scan; the sort is a bounded
    top-k in every task. Ties in score go by the given columns, ascending. The
    query is encoded once and joins the plan as a literal.
    """
    if where is not None:
        df = df.where(where)
    if k < 0:
        k = top_limit(k, df.count())
    query = F.array(*(F.lit(x) for x in V.encode_query(vector, config.quantization, config.dimensions)))
    codes = V.doubles(F.col(embedding)) if config.quantization == "F32" else V.encode(F.col(embedding), config.quantization, config.dimensions)["data"]
    coded = df.withColumn("_codes", codes)
    score = V.similarity(F.col("_codes"), query, config.metric, config.dimensions)
    best = coded.withColumn("score", score).drop("_codes", embedding).orderBy(F.desc("score"), *ties).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *ties)).cast("bigint"))


def _scores(q: np.ndarray, x: np.ndarray, metric: str, dimensions: int) -> np.ndarray:
    if metric == "hamming":
        bits = lambda a: np.unpackbits(a.astype(np.uint8), axis=1)[:, :dimensions].astype(np.float32)
        a, b = bits(q), bits(x)
        return (a @ b.T + (1 - a) @ (1 - b).T).astype(np.float64) / dimensions
    inner = q @ x.T
    if metric == "dot":
        return inner
    if metric == "cosine":
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
        if size.min(initial=1) > 0:
            return np.divide(inner, size, out=inner)
        return np.divide(inner, size, out=np.zeros_like(inner), where=size > 0)
    gap = (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * inner
    return 1 / (1 + np.sqrt(np.maximum(gap, 0)))


def _encode_all(x: np.ndarray, quantization: str) -> np.ndarray:
    if quantization == "INT8":
        low, high = x.min(1, keepdims=True), x.max(1, keepdims=True)
        span = np.where(high == low, 1, high - low)
        return np.where(high == low, 0, np.floor((x - low) / span * 255 + 0.5) - 128)
    return np.packbits(x >= 0, axis=1).astype(np.float64) if quantization == "BIT" else x


class _Best:
    """The k best rows of each query, by score and then id, over rows that come in any number and order.

    With digits, scores that agree to so many decimals tie: a product's last bits depend on where a row lies in its tile.
    """

    def __init__(self, queries: np.ndarray, k: int, config: CollectionConfig, digits: int | None = None):
        self.queries, self.k, self.config, self.seen, self.digits = queries, k, config, 0, digits
        self.score, self.id = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)

    def _key(self, score: np.ndarray) -> np.ndarray:
        """What is compared."""
        return score if self.digits is None else np.round(score, self.digits)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Scores rows tile by tile, so memory depends on neither their number nor that of the queries."""
        for r in range(0, len(ids) if self.k > 0 else 0, ROW_TILE):
            own, x = ids[r : r + ROW_TILE], _encode_all(vectors[r : r + ROW_TILE], self.config.quantization)
            for q in range(0, len(self.queries), QUERY_TILE):
                self._offer(q, _scores(self.queries[q : q + QUERY_TILE], x, self.config.metric, self.config.dimensions), own)
            self.seen += len(own)

    def _offer(self, first: int, s: np.ndarray, ids: np.ndarray) -> None:
        worst, last = self.score[first : first + len(s), -1], self.id[first : first + len(s), -1]
        bound = worst
        if self.seen < self.k < s.shape[1]:
            bound = np.fmax(worst, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
        bound = bound if self.digits is None else bound - 10.0**-self.digits
        q, r = np.nonzero(~(s < bound[:, None]))  # a score that is no number counts as the lowest
        found, own = np.fmax(s[q, r], -np.inf), ids[r]
        key, least = self._key(found), self._key(worst)[q]
        better = (key > least) | ((key == least) & (own < last[q]))
        q, found, own = q[better] + first, found[better], own[better]
        if not len(q):
            return
        met = np.unique(q)
        who, score, ident = np.concatenate([np.repeat(met, self.k), q]), np.concatenate([self.score[met].ravel(), found]), np.concatenate([self.id[met].ravel(), own])
        order = np.lexsort((ident, -self._key(score), who))
        starts = np.searchsorted(who[order], met)
        top = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.score[met], self.id[met] = score[top].reshape(-1, self.k), ident[top].reshape(-1, self.k)

    def columns(self, names: np.ndarray) -> list[np.ndarray]:
        """query_id, id, score and what the scores are compared by, of all that were kept."""
        n = min(max(self.k, 0), self.seen)
        score = self.score[:, :n].ravel()
        return [np.repeat(names, n), self.id[:, :n].ravel(), score, self._key(score)]


def nearest_join(queries: DataFrame, df: DataFrame, config: CollectionConfig, k: int, query_id: str = "query_id", row_id: str = "id", embedding: str = "embedding", digits: int | None = None) -> DataFrame:
    """query_id, id, score, rank: the k nearest rows of every query; ids are longs. Scores that agree to digits decimals go by id.

    Queries are taken in blocks of fixed size, each shipped once; every task keeps
    its k best a query over tiles of rows by matrix product, so a row never
    meets a query as a joined row. The merge ranks k rows a task and query.
    """
    total = queries.count()
    blocks, out = max(1, -(-total // QUERY_BLOCK)), None
    rows = df.select(F.col(row_id).cast("long").alias("id"), V.doubles(F.col(embedding)).alias("v")).where(V.valid(F.col(embedding), config.dimensions))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b).select(F.col(query_id).cast("long").alias("q"), V.doubles(F.col(embedding)).alias("v")).orderBy("q").toPandas()
        if not len(part):
            continue
        ids, q = part.q.to_numpy(), _encode_all(np.stack(part.v.to_list()), config.quantization)
        shipped = df.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids, q = shipped.value
            best = _Best(q, k, config, digits)
            for batch in batches:
                best.add(np.asarray(batch.column("id")), np.asarray(batch.column("v").flatten()).reshape(-1, config.dimensions))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.columns(ids)], names=["query_id", "id", "score", "key"])

        found = rows.mapInArrow(run, "query_id long, id long, score double, key double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return df.sparkSession.createDataFrame([], "query_id long, id long, score double, rank long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("key"), "id")
    return out.withColumn("rank", F.row_number().over(ranked).cast("bigint")).where(F.col("rank") <= k).drop("key")
