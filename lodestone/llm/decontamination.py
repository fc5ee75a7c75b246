"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

Items are partitioned by the size of their shingle sequence. For each partition
the documents' shingle sequence is covered by half-overlapping windows of
between two and four times the item size, whose minima come from one hierarchy
of block minima, so an item keeps a Jaccard similarity near 0.2 with what holds
it however long the document is. A window that shares a minimum with an item
makes (document, item) a candidate; the document's whole shingle set decides.
Over 64 hashes a true pair is missed with a chance of about one in a million,
also where its shingles are scattered. Items of up to 4 shingles, and items that
repeat more than a sixteenth of theirs, whose windows would be too wide for their
distinct shingles, are looked up shingle by shingle, which is exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, broadcast_if_small, read_table
from .hashing import shingles, word_hashes

WORDS = 5
HASHES = 64
SMALLEST_BLOCK = 8
#: Shingles hashed at once by a task, and what one pass over the documents ships of the items.
CHUNK = 1 << 17
ITEM_ROWS, ITEM_BYTES = 50_000, 64 << 20
_rng = np.random.Generator(np.random.PCG64(97))
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def _values(members: np.ndarray, h: int) -> np.ndarray:
    return ((members >> np.uint64(32)) * _A[h] + _B[h]) >> np.uint64(32)


class ItemIndex:
    """Items by the words of their shingles (5, or all they have) and by size class, with their minima."""

    def __init__(self, ids: list[int], texts: list[bytes | None]):
        self.ids, self.sets, self.by_width = [], [], defaultdict(dict)
        classes = defaultdict(list)
        for item, words in zip(ids, word_hashes(texts), strict=True):
            if len(words):
                sequence = shingles(words, WORDS)
                members = np.unique(sequence)
                size = len(sequence)
                level = -1 if len(members) <= 4 or 16 * len(members) < 15 * size else max(0, int(np.ceil(np.log2(size / SMALLEST_BLOCK))))
                classes[min(WORDS, len(words)), level].append(len(self.ids))
                self.ids.append(item)
                self.sets.append(members)
        for (width, level), of in classes.items():
            if level < 0:
                keys = [(x, i) for i in of for x in self.sets[i]]
                table = [self._sorted(keys)]
            else:
                table = [self._sorted([(_values(self.sets[i], h).min(), i) for i in of]) for h in range(HASHES)]
            self.by_width[width][level] = table

    @staticmethod
    def _sorted(keys: list) -> tuple[np.ndarray, np.ndarray]:
        keys.sort()
        return np.array([k for k, _ in keys], np.uint64), np.array([i for _, i in keys], np.int64)


def _matches(table: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in values and items of every equality."""
    keys, items = table
    low = np.searchsorted(keys, values)
    at = np.flatnonzero((low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] == values))
    low = low[at]
    count = np.searchsorted(keys, values[at], "right") - low
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(at, count), items[np.repeat(low, count) + offset]


def candidates(index: ItemIndex, levels: dict, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Distinct (document, item) rows of a chunk: flat holds the documents' shingles one after another."""
    n, found = len(flat), []

    def note(first: np.ndarray, last: np.ndarray, items: np.ndarray) -> None:
        lo, hi = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, np.minimum(last, n - 1), "right") - 1
        for step in range(int((hi - lo).max(initial=-1)) + 1):  # a window may touch several documents
            ok = lo + step <= hi
            found.append(np.stack([(lo + step)[ok], items[ok]], axis=1))

    if -1 in levels:
        at, items = _matches(levels[-1][0], flat)
        note(at, at, items)
    if (top := max(levels)) >= 0:
        cuts = np.arange(0, n, SMALLEST_BLOCK)
        for h in range(HASHES):
            block = np.minimum.reduceat(_values(flat, h), cuts)
            for level in range(top + 1):
                if level:
                    if len(block) % 2:
                        block = np.append(block, np.iinfo(np.uint64).max)
                    block = np.minimum(block[::2], block[1::2])
                if level in levels:
                    window = np.minimum(block[:-1], block[1:]) if len(block) > 1 else block
                    at, items = _matches(levels[level][h], window)
                    if len(at):
                        width = SMALLEST_BLOCK << level
                        note(at * width, (at + 2) * width - 1, items)
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _scan(index: ItemIndex, texts: list[bytes | None]) -> Iterator[tuple[int, int, int]]:
    """(row, item, shingles found) of each pair whose containment is 0.8 or more."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[tuple[int, int, int]]:
        for width, levels in index.by_width.items():
            sequences = [shingles(w, width) if len(w) >= width else w[:0] for _, w in held]
            lengths = np.array([len(s) for s in sequences])
            starts = np.cumsum(lengths) - lengths
            flat = np.concatenate(sequences)
            if not len(flat):
                continue
            some = np.flatnonzero(lengths)  # documents without a shingle take no place
            last, members = -1, flat
            for doc, item in candidates(index, levels, flat, starts[some]):
                doc = some[doc]
                if doc != last:
                    last, members = doc, np.unique(sequences[doc])
                wanted = index.sets[item]
                low = np.minimum(np.searchsorted(members, wanted), len(members) - 1)
                hits = int((members[low] == wanted).sum())
                if 100 * hits >= 80 * len(wanted):
                    yield held[doc][0], int(item), hits

    for row, words in enumerate(word_hashes(texts)):
        held.append((row, words))
        size += len(words)
        if size >= CHUNK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def item_blocks(items: DataFrame) -> Iterator[ItemIndex]:
    """Indexes over blocks of items of bounded rows and bytes; items without an id or a word are skipped."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("_text")).where("item_id IS NOT NULL AND _text IS NOT NULL")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEM_ROWS), -(-size // ITEM_BYTES))
    for b in range(blocks if n else 0):
        found = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "_text").collect()
        index = ItemIndex([r.item_id for r in found], [bytes(r._text) for r in found])
        if index.ids:
            yield index


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, hits, size: the pairs of which the document holds 0.8 or more of the item's shingles.

    Words are folded A-Z and split at white space; a shingle is five words, or an
    item's whole sequence where it has fewer. Null or blank texts and null ids
    match nothing. Equal rows give equal pairs once.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text")).where("doc_id IS NOT NULL AND _text IS NOT NULL")
    schema, out = "doc_id long, item_id long, hits long, size long", None
    for index in item_blocks(items):
        shipped = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                hits = [(ids[row], index.ids[item], n, len(index.sets[item])) for row, item, n in _scan(index, batch.column("_text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*hits, strict=True) if hits else [()] * 4)], ["doc_id", "item_id", "hits", "size"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out.distinct()


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item; columns as they were, whatever their names. A doc_id with an item goes with all its rows."""
    hit = Scratch(docs.sparkSession, "leaks").keep(contaminated(docs, items).select(F.col("doc_id").alias("_hit")).distinct(), "hits")
    packed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    left = packed.join(broadcast_if_small(hit), F.col("_id") == F.col("_hit"), "left_anti")
    return left.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (comma-joined, ascending) and max_containment of every document."""
    docs = read_table(spark, sf_dir, "documents")
    hits = Scratch(spark, "leaks").keep(contaminated(docs, read_table(spark, sf_dir, "benchmark")), "hits")
    by_doc = hits.groupBy(F.col("doc_id").alias("_id")).agg(
        F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ",").alias("_items"), F.max(F.col("hits") / F.col("size")).alias("_most")
    )
    return docs.select("doc_id").join(broadcast_if_small(by_doc), F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id",
        F.col("_n").isNotNull().alias("contaminated"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("_items", F.lit("")).alias("item_ids"),
        F.coalesce("_most", F.lit(0.0)).alias("max_containment"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents
), i AS (
  SELECT item_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM benchmark
), iw AS (SELECT id, ws, CAST(least(5, len(ws)) AS INTEGER) AS k FROM i WHERE len(ws) > 0
), ig AS (SELECT DISTINCT id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' '))) AS g FROM iw
), n AS (SELECT id, count(*) AS size FROM ig GROUP BY id
), ks AS (SELECT DISTINCT k FROM iw
), dg AS (SELECT DISTINCT d.id, ks.k, unnest(list_transform(range(1, len(ws) - ks.k + 2), lambda j: array_to_string(ws[j:j + ks.k - 1], ' '))) AS g FROM d, ks WHERE len(ws) >= ks.k
), hit AS (
  SELECT dg.id AS doc_id, ig.id AS item_id, count(*) AS hits, any_value(n.size) AS size
  FROM dg JOIN ig ON dg.k = ig.k AND dg.g = ig.g JOIN n ON n.id = ig.id
  GROUP BY dg.id, ig.id HAVING 100 * count(*) >= 80 * any_value(n.size)
), per AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(hits::DOUBLE / size) AS most FROM hit GROUP BY doc_id
)
SELECT documents.doc_id, per.n IS NOT NULL AS contaminated, CAST(coalesce(per.n, 0) AS BIGINT) AS n_items,
  coalesce(per.items, '') AS item_ids, coalesce(per.most, 0.0::DOUBLE) AS max_containment
FROM documents LEFT JOIN per ON per.doc_id = documents.doc_id
"""
