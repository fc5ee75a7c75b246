"""WARC archives written and read by Spark's own text source, with boundary-chain verification.

Writing: a row is a record, the line separator is the blank lines that end a
record, so the committed files are plain WARC/1.1 archives. Reading: the text source,
split at the version line, hands every task the chunks of its byte range; a
chunk may start at a record or inside a payload that quotes the version line.
Tasks emit, for each chunk, its length and the length its header claims; prefix sums give byte
offsets, and offset plus claimed length is the candidate's successor. Pointer jumping from offset 0 of each file keeps the
reachable candidates, which are the records; the others are payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, read_table

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: Copies of a payload are met in so many parts, however many there are.
SALT = 16
DATE = "2024-01-01T00:00:00Z"


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, refers_to: the page of the largest id with an equal payload where that is another page.

    The payload is the html's bytes, empty for null. Rows that share a page_id
    are records of their own. Null page_ids are written as an empty id, and never
    refer or are referred to.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    names = rows.where(F.length("payload") >= least).where("page_id IS NOT NULL").select("page_id", F.sha2("payload", 256).alias("digest"))
    names = Scratch(pages.sparkSession, "digests").keep(names, "names")  # 32 bytes a page; payloads don't move
    first = names.groupBy("digest").agg(F.max("page_id").alias("_refers"), F.count("*").alias("_copies")).where("_copies > 1")
    spread = first.select(F.col("digest").alias("_digest"), "_refers", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    salted = names.withColumn("_part", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    moved = salted.join(spread, (F.col("digest") == F.col("_digest")) & (F.col("_part") == F.col("_salt"))).where("page_id <> _refers")
    moved = Scratch(pages.sparkSession, "revisits").keep(moved.select(F.col("page_id").alias("_page"), F.col("digest").alias("_same"), "_refers").distinct(), "moved")
    same = F.sha2("payload", 256) == F.col("_same")  # a page_id may repeat with another payload
    matched = rows.join(broadcast_if_small(moved), (F.col("page_id") == F.col("_page")) & (F.length("payload") >= least) & same, "left")
    return matched.select("page_id", "url", "payload", F.col("_refers").alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes a response or revisit record for each page; a task commits one archive."""
    rows = records(pages, least).withColumn("_sha", F.sha1("payload"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " "))).otherwise(F.lit("")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.length(body).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head.cast("binary"), body).cast("string").alias("value")).write.mode("overwrite").option("lineSep", END).text(path)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """The text between version lines, its bytes as they are, with the file and range it came from."""
    return spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def chunks(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """file, offset, next, and the record fields of every candidate: a chunk between two version lines."""
    raw = _raw(spark, path).withColumn("at", F.monotonically_increasing_id())  # rises with the position inside a task's range
    content = F.col("value").cast("binary")
    # the header ends at the first blank line; instr counts characters, so the bytes are counted on the text up to it
    gap = F.instr("value", "\r\n\r\n")
    header = F.when(gap > 0, F.substring(F.col("value"), F.lit(1), gap - 1)).otherwise(F.lit(""))
    raw = raw.withColumns({"size": F.octet_length("value").cast("long"), "_header": header})
    field = lambda name: F.nullif(F.regexp_extract("_header", rf"(?im)^{name}:[ \t]*(.*?)\r?$", 1), F.lit(""))
    head_size = F.octet_length("_header").cast("long") + 4
    claimed = F.expr("try_cast(_claim AS BIGINT)")
    rows = raw.withColumns({"_claim": F.when(gap > 0, field("Content-Length")), "head_size": head_size}).withColumn("claimed", F.when(claimed >= 0, claimed))
    body = F.substring(content, F.col("head_size").cast("int") + 1, F.greatest(F.col("claimed"), F.lit(0)).cast("int"))
    whole = F.col("claimed").isNotNull() & (F.col("size") >= F.col("head_size") + F.col("claimed"))
    rows = rows.select(
        "file", "block", "at", "size", "head_size", "claimed",
        field("WARC-Type").alias("record_type"),
        F.regexp_extract(F.coalesce(field("WARC-Record-ID"), F.lit("")), r"<urn:page:(-?\d+)>", 1).alias("page_id"),
        F.regexp_extract(F.coalesce(field("WARC-Refers-To"), F.lit("")), r"<urn:page:(-?\d+)>", 1).alias("refers_to"),
        F.regexp_extract(F.coalesce(field("WARC-Payload-Digest"), F.lit("")), r"sha1:(\w+)", 1).alias("stated_digest"),
        F.when(whole, F.sha1(body)).alias("payload_digest"),
        F.sha1(content).alias("name"),
    )
    rows = scratch.keep(rows, "chunks")
    # offsets: every chunk is followed by one version line; a range starts where the ranges before it end
    per = rows.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("_bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = per.select(F.col("file").alias("_f"), F.col("block").alias("_b"), (F.sum("_bytes").over(before) - F.col("_bytes")).alias("_start"))
    run = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(broadcast_if_small(start), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    # the chunk's text begins after its version line, which begins at offset
    placed = placed.withColumn("offset", F.col("_start") + F.sum(F.col("size") + len(MAGIC)).over(run) - F.col("size") - 2 * len(MAGIC))
    placed = placed.withColumn("next", F.col("offset") + len(MAGIC) + F.col("head_size") + F.col("claimed") + len(END))
    return scratch.keep(placed.where("offset >= 0").drop("_f", "_b", "_start", "at"), "candidates")


def reachable(candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """file and offset of the candidates on the chain from each file's start, by pointer jumping.

    In round r the known records are those fewer than 2^r steps from the start and
    each pointer spans 2^r steps; joining both doubles them, so rounds are logarithmic
    in the records of a file.
    """
    jump = candidates.where("next IS NOT NULL").select("file", "offset", "next")
    known = candidates.where("offset = 0").select("file", "offset")
    jump, known, turn, n = scratch.keep(jump, "jump-0"), scratch.keep(known, "known-0"), 0, -1
    while True:
        turn += 1
        step = jump.select(F.col("file").alias("_f"), F.col("offset").alias("_o"), F.col("next").alias("_n"))
        ahead = known.join(step, (F.col("file") == F.col("_f")) & (F.col("offset") == F.col("_o"))).select("file", F.col("_n").alias("offset"))
        known_next = scratch.keep(known.unionAll(ahead).distinct(), f"known-{turn}")
        m = known_next.count()
        if m == n:
            break
        n = m
        jump_next = scratch.keep(jump.join(step, (F.col("file") == F.col("_f")) & (F.col("next") == F.col("_o"))).select("file", "offset", F.col("_n").alias("next")), f"jump-{turn}")
        scratch.drop(f"known-{turn - 1}")
        scratch.drop(f"jump-{turn - 1}")
        known, jump = known_next, jump_next
    return known_next


def unreached(found: DataFrame, on_chain: DataFrame) -> DataFrame:
    """file, offset, to: per file the bytes after a chain that ends before the file does; no rows where every chain is whole.

    found are the candidates of chunks, on_chain what reachable returns of them. A chain ends early at a record
    without a length, or whose length leads to no candidate; what follows can't be told from payload.
    """
    real = found.join(on_chain.select(F.col("file").alias("_f"), F.col("offset").alias("_o")), (F.col("file") == F.col("_f")) & (F.col("offset") == F.col("_o")), "left_semi")
    reached = real.groupBy("file").agg(F.max_by("next", "offset").alias("_next"), F.max("offset").alias("_last"))
    ends = found.groupBy(F.col("file").alias("_f")).agg(F.max(F.col("offset") + len(MAGIC) + F.col("size")).alias("_end"))
    joined = ends.join(reached, F.col("_f") == F.col("file"), "left")
    at = F.coalesce(F.when(F.col("_next") <= F.col("_end"), F.col("_next")), F.col("_last"), F.lit(0).cast("long"))
    return joined.where("_next IS NULL OR _next <> _end").select(F.col("_f").alias("file"), at.alias("offset"), F.col("_end").alias("to"))


class BrokenChain(ValueError):
    """Archives with bytes that no chain from a file's start reaches."""


def read_warc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """file, offset, page_id, record_type, refers_to, payload_bytes, payload_digest of every record of the archives.

    payload_bytes and payload_digest are those of the stored payload. A payload that
    quotes the version line arrives in several chunks, which are put together again.
    An absent field is null. An archive whose chain ends before the file does, by a wrong or missing length or a
    cut, is an error; unless strict, its records up to there are read. Empty archives have no records.
    """
    scratch = Scratch(spark, "warc")
    found = chunks(spark, path, scratch)
    chain = reachable(found, scratch)
    if strict and (broken := unreached(found, chain).limit(3).collect()):
        raise BrokenChain("; ".join(f"{b.file}: bytes {b.offset} to {b.to} follow from no record" for b in broken))
    on_chain = chain.select(F.col("file").alias("_f"), F.col("offset").alias("_o"))
    rows = found.join(on_chain, (F.col("file") == F.col("_f")) & (F.col("offset") == F.col("_o")), "left").withColumn("real", F.col("_o").isNotNull()).drop("_f", "_o")
    rows = scratch.keep(rows.where("claimed IS NOT NULL OR NOT real"), "verified")
    fields = ["file", "offset", "page_id", "record_type", "refers_to", "stated_digest", "claimed"]
    out = rows.where("real AND payload_digest IS NOT NULL").select(*fields, "payload_digest")
    if not rows.where("real AND payload_digest IS NULL").isEmpty():
        # a payload that quotes the version line: its record and the chunks up to the next record, read again and joined
        upto = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        owned = rows.withColumn("_record", F.max(F.when(F.col("real"), F.col("offset"))).over(upto))
        cut = rows.where("real AND payload_digest IS NULL").select(F.col("file").alias("_f"), F.col("offset").alias("_o"))
        owned = scratch.keep(owned.join(cut, (F.col("file") == F.col("_f")) & (F.col("_record") == F.col("_o"))).drop("_f", "_o"), "owned")
        asked = owned.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.col("name").alias("_name")).distinct()
        again = _raw(spark, path).withColumn("_sha", F.sha1(F.col("value").cast("binary")))
        again = again.join(broadcast_if_small(asked), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")) & (F.col("_sha") == F.col("_name")), "left_semi")
        again = again.groupBy(F.col("file").alias("_f"), F.col("_sha").alias("_name")).agg(F.first("value").alias("value"))
        parts = owned.join(again, (F.col("file") == F.col("_f")) & (F.col("name") == F.col("_name")))
        whole = parts.groupBy("file", F.col("_record").alias("offset")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC).cast("binary").alias("_all"),
            *(F.max(F.when(F.col("real"), F.col(c))).alias(c) for c in [*fields[2:], "head_size"]),
        )
        whole = whole.withColumn("payload_digest", F.sha1(F.substring("_all", F.col("head_size").cast("int") + 1, F.col("claimed").cast("int"))))
        out = out.unionByName(whole.select(*fields, "payload_digest"))
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    return out.select("file", "offset", number("page_id").alias("page_id"), "record_type", number("refers_to").alias("refers_to"), F.col("claimed").alias("payload_bytes"), "payload_digest", "stated_digest")


def resolved(found: DataFrame) -> DataFrame:
    """The records with bytes and digest of the full payload: a revisit's are those of the response that it names."""
    moved = found.where("record_type = 'revisit'")
    asked = moved.select(F.col("refers_to").alias("_asked")).distinct()
    named = found.where("record_type = 'response'").join(broadcast_if_small(asked), F.col("page_id") == F.col("_asked"), "left_semi")
    named = named.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    joined = moved.join(broadcast_if_small(named), (F.col("refers_to") == F.col("_id")) & (F.col("stated_digest") == F.col("_digest")), "left")
    full = joined.withColumn("payload_bytes", F.col("_bytes")).withColumn("payload_digest", F.col("stated_digest")).select(*found.columns)
    return found.where("coalesce(record_type, '') <> 'revisit'").unionByName(full)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the archives written."""
    path = Scratch(spark, "archives").path("warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    found = Scratch(spark, "records").keep(read_warc(spark, path), "found")
    return resolved(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""
