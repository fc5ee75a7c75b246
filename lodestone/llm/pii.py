"""Personal data: patterns for protected values, and terms that disclose them by corpus co-occurrence.

E-mail, IP, card and phone values are found by pattern in whole texts, and documents
are counted: n(e) hold a value, n(t) a term, n(e,t) both, of N. A term t discloses a value e
when log2(n(e,t) N / (n(e) n(t))) reaches DISCLOSURE of log2(N / n(e)), the
value's information content; a value of a single document counts like any other.
Disclosing terms become spans of kind `term` wherever they stand: sanitising
replaces protected values by their kind, generalises terms to [TERM] and removes
those that disclose completely.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, broadcast_if_small, read_table
from .hashing import shingles, word_hashes

KINDS = ("email", "ip", "card", "phone", "term")
#: Share of a value's information.
DISCLOSURE = 0.9
#: Disclosing terms that are broadcast, of 9 bytes each, beyond which they are joined; terms that a task holds before it merges their counts.
TERM_BLOCK, MERGE = 2_000_000, 1 << 20

_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match takes the whole of its first run of digits, so none starts inside one
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the protected values by start, then kind as listed; code points, end exclusive."""
    found: list[tuple[str, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _hash(texts: list[bytes]) -> np.ndarray:
    return np.array([h[0] if len(h) else 0 for h in (shingles(w, max(1, len(w))) for w in word_hashes(texts))], np.uint64).view(np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of all parts with their summed counts."""
    terms, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    return terms, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def occurrences(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: term and n, documents of a task that hold the term; values and terms, all that a document with values holds.

    All are hashes. Words that touch a value are no terms of their document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, longs = ["term", "n", "values", "terms"], pa.list_(pa.int64())
        parts, size = [], 0

        def counts() -> pa.RecordBatch:
            term, n = _merged(parts)
            return pa.RecordBatch.from_arrays([pa.array(term), pa.array(n), pa.nulls(len(term), longs), pa.nulls(len(term), longs)], names)

        for batch in batches:
            texts, values, terms = batch.column("text").to_pylist(), [], []
            for text, words in zip(texts, word_hashes([t.encode() for t in texts]), strict=True):
                own = term_hashes(words)
                spans = base_spans(text) if "@" in text or _DIGIT.search(text) else []
                if spans:
                    starts = np.array([m.start() for m in _WORD.finditer(text)])
                    hidden = {i for _, s, e in spans for i in range(int(np.searchsorted(starts, s, "right")) - 1, int(np.searchsorted(starts, e)))}
                    own = np.delete(own, sorted(hidden))
                own = np.unique(own)
                if spans:
                    found = sorted({f"{kind}:{text[s:e].lower().replace(' ', '')}".encode() for kind, s, e in spans})
                    values.append(_hash(found).tolist())
                    terms.append(own.tolist())
                if len(own):
                    parts.append((own, np.ones(len(own), np.int64)))
                    size += len(own)
                if size > MERGE:
                    parts = [_merged(parts)]
                    size = len(parts[0][0])
                    if 2 * size > MERGE:
                        yield counts()
                        parts, size = [], 0
            if values:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(values), pa.int64())] * 2, pa.array(values, longs), pa.array(terms, longs)], names)
        if parts:
            yield counts()

    return docs.select("text").where("text IS NOT NULL").mapInArrow(run, "term long, n long, values array<long>, terms array<long>")


def term_hashes(words: np.ndarray) -> np.ndarray:
    """The hashes by which words are terms."""
    return shingles(words, 1).view(np.int64)


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """term (its hash) and whether it discloses completely; statistics cover all documents.

    With d for disclosure, a term passes where log2 n(e,t) - (1 - d) log2 n(e) reaches log2 n(t) - (1 - d) log2 N
    for some value e: the left side is brought to its greatest per term before terms meet their counts.
    """
    scratch = Scratch(docs.sparkSession, "disclosure")
    rows, total = scratch.keep(occurrences(docs), "occurrences"), docs.count()
    held = rows.where("values IS NOT NULL").select(F.xxhash64("values", "terms").alias("_doc"), "values", "terms")
    named = held.select("_doc", F.explode("values").alias("_v"))
    by_value = named.groupBy("_v").agg(F.count("*").alias("n_e"), F.sum(F.col("_doc").cast("decimal(20,0)")).alias("_docs"))
    values = scratch.keep(by_value.where(F.col("n_e") < total), "values")
    # a value of one document has n(e,t) = n(e) = 1 with all terms there
    lone = named.join(broadcast_if_small(values.where("n_e > 1").select("_v")), "_v", "left_anti").select("_doc").distinct()
    alone = held.join(broadcast_if_small(lone), "_doc", "left_semi").where(F.lit(total > 1)).select(F.explode("terms").alias("term"), F.lit(1).cast("long").alias("n_e"), F.lit(1).cast("long").alias("n_et"))
    # values of the very same documents have the same terms: one of them stands for all
    several = values.where("n_e > 1").groupBy("n_e", "_docs").agg(F.min("_v").alias("_v")).select("_v", "n_e")
    each = held.select(F.explode("values").alias("_v"), "terms").join(broadcast_if_small(several), "_v").select("_v", "n_e", F.explode("terms").alias("term"))
    shared = each.groupBy("_v", "n_e", "term").agg(F.count("*").alias("n_et")).select("term", "n_e", "n_et")
    rest = 1 - disclosure
    best = alone.unionByName(shared).groupBy("term").agg(F.max(F.log2("n_et") - rest * F.log2("n_e")).alias("_gain"), F.max("n_et").alias("_most"))
    counts = rows.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n_t"))
    told = best.join(counts, "term").where(F.col("_gain") >= F.log2("n_t") - rest * F.log2(F.lit(float(total))) - 1e-9)
    return scratch.keep(told.select("term", (F.col("_most") >= F.col("n_t")).cast("byte").alias("complete")).where(F.lit(total > 0)), "told")


def with_terms(docs: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, text and the disclosing terms of each text with whether they are complete, by joins; for terms too many to broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, words in zip(batch.column("_name").to_pylist(), word_hashes(batch.column("_text").to_pylist()), strict=True):
                own = np.unique(term_hashes(words))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.binary()), pa.array(own)], ["_name", "term"])

    named = docs.withColumn("_name", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    words = named.where("text IS NOT NULL").select("_name", F.col("text").cast("binary").alias("_text")).mapInArrow(run, "_name binary, term long").distinct()
    held = words.join(told, "term").groupBy("_name").agg(F.array_sort(F.collect_list(F.struct("term", "complete"))).alias("_held"))  # no more than a text's words
    held = Scratch(docs.sparkSession, "disclosure").keep(held, "held")
    return named.join(held, "_name", "left").select("doc_id", "text", F.col("_held.term").alias("terms"), F.col("_held.complete").alias("complete"))


def _term_spans(text: str, base: list[tuple[str, int, int]], hashes: np.ndarray, terms: np.ndarray, complete: np.ndarray) -> list[tuple[str, int, int, bool]]:
    low = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    hit = np.flatnonzero(terms[low] == hashes)
    if not len(hit):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    free = lambda s, e: all(e <= b or s >= f for _, b, f in base)
    return [("term", *words[i], bool(complete[low[i]])) for i in hit.tolist() if free(*words[i])]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term and sanitised for every row of docs.

    spans is kind:start:end, comma-joined by start, then kind; sanitised is the text
    with values and terms replaced. A null text counts as empty and its
    sanitised text is null; repeated rows are repeated.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    told = disclosing_terms(docs)
    kept, n, shipped = docs.select("doc_id", "text"), told.count(), None
    if n > TERM_BLOCK:
        kept = with_terms(kept, told)
    elif n:
        table = told.toArrow()  # TERM_BLOCK rows at most
        terms, complete = table.column("term").to_numpy(), table.column("complete").to_numpy()
        order = np.argsort(terms)
        shipped = spark.sparkContext.broadcast((terms[order], complete[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shipped.value if shipped else None
        for batch in batches:
            rows, texts = [], batch.column("text").to_pylist()
            own = zip(batch.column("terms").to_pylist(), batch.column("complete").to_pylist(), strict=True) if "terms" in batch.schema.names else iter([told] * len(texts))
            hashes = word_hashes([t.encode() if t else None for t in texts]) if n else iter([np.zeros(0, np.uint64)] * len(texts))
            for raw, words, known in zip(texts, hashes, own, strict=True):
                text = raw or ""
                base = base_spans(text) if "@" in text or _DIGIT.search(text) else []
                terms = _term_spans(text, base, term_hashes(words), np.asarray(known[0], np.int64), np.asarray(known[1])) if known and known[0] is not None and len(known[0]) and len(words) else []
                count = [sum(k == kind for k, *_ in base) for kind in KINDS[:4]]
                line = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                every = sorted([*base, *(t[:3] for t in terms)], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                gone = {t[1] for t in terms if t[3]}
                out, at = [], 0
                for kind, s, e in every:
                    if s >= at:
                        out += [text[at:s], "" if s in gone else f"[{kind.upper()}]"]
                    at = max(at, e)
                clean = "".join([*out, text[at:]]) if raw is not None else None
                rows.append((*count, hashlib.sha256(line(base).encode()).hexdigest(), line(every), len(terms), clean))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.string())
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term", "sanitised"]
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long, sanitised string")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every whole document."""
    return find(read_table(spark, sf_dir, "documents")).drop("sanitised")
