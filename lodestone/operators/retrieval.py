"""Chunking, retrieval metrics, citations and registry joins."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a pattern's \\s means to the formats' writers: Unicode spaces and the byte order mark.
SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def chunk_text(text: Column, most: int = 500, least: int = 100) -> Column:
    """Paragraphs joined into chunks: a chunk is closed before it passes `most` characters once it has `least`."""
    paragraphs = F.filter(F.transform(F.split(text, rf"\n{SPACE}*\n"), lambda p: F.regexp_replace(p, rf"^{SPACE}+|{SPACE}+$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        full = (F.length(s["open"]) + F.length(p) > most) & (F.length(s["open"]) >= least)
        joined = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        return F.struct(F.when(full, F.array_append(s["done"], s["open"])).otherwise(s["done"]).alias("done"), F.when(full, p).otherwise(joined).alias("open"))

    return F.aggregate(paragraphs, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def chunks(pages: DataFrame, file: str = "file", page: str = "page", text: str = "text") -> DataFrame:
    """file, page, chunk (numbered through the document), id, text and preview."""
    parts = pages.select(F.col(file).alias("file"), F.col(page).alias("page"), F.posexplode(chunk_text(F.col(text))).alias("_at", "text"))
    order = Window.partitionBy("file").orderBy("page", "_at")
    numbered = parts.withColumn("chunk", F.row_number().over(order) - 1).drop("_at")
    name = F.concat(F.col("file").cast("string"), F.lit(":p"), F.col("page").cast("string"), F.lit(":c"), F.col("chunk").cast("string"))
    return numbered.select("file", "page", F.col("chunk").cast("bigint").alias("chunk"), name.alias("id"), "text", F.substring("text", 1, 200).alias("preview"))


def document_totals(chunked: DataFrame) -> DataFrame:
    """file, pages and chunks of every document that has a chunk."""
    return chunked.groupBy("file").agg(F.max("page").cast("bigint").alias("pages"), F.count("*").alias("chunks"))


def rank_of_expected(queries: DataFrame, results: DataFrame) -> DataFrame:
    """query_id and rank (1 first, null where absent) of each query's expected_id in the results."""
    r = results.select(F.col("query_id").alias("_q"), F.col("id").alias("_id"), "rank")
    return queries.join(r, (F.col("query_id") == F.col("_q")) & (F.col("expected_id") == F.col("_id")), "left").select("query_id", "rank")


def retrieval_quality(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """recall_at_k for each k and the mean reciprocal rank, in one pass."""
    hits = [F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")).alias(f"recall_at_{k}") for k in ks]
    return ranks.agg(*hits, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The mean share of the first k results that two runs have in common."""
    top = lambda df, name: df.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("id").alias(name))
    both = top(a, "a").join(top(b, "b"), "query_id")
    return both.agg(F.avg(F.size(F.array_intersect("a", "b")) / F.lit(float(k))).alias("agreement"))


def _at_rank(counts: DataFrame, rank: int, parts: int = 200) -> DataFrame:
    """value: the one at a rank from 0 among values with counts n, from range partitions and their sums."""
    ranged = counts.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id())
    upto = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy("part").agg(F.min("value").alias("first"), F.max("value").alias("last"), F.sum("n").alias("n"))  # a row a partition
    place = sums.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") > rank).orderBy("first").limit(1).collect()
    if not place or rank < 0:
        return counts.select("value").limit(0).agg(F.min("value").alias("value"))
    low, before = place[0].first, place[0].upto - place[0].n
    inside = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the values of one partition
    rest = counts.where(F.col("value").between(F.lit(low), F.lit(place[0].last))).withColumn("upto", F.sum("n").over(inside) + before)
    return rest.where(F.col("upto") > rank).agg(F.min("value").alias("value"))


def percentile(df: DataFrame, column: str, p: float, rule: str = "floor") -> DataFrame:
    """floor: the value at floor(p n); nearest: at ceil(p n) - 1. From counts of values, so no list of them is built."""
    if rule == "nearest":
        return df.agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias("value"))
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return _at_rank(counts, min(total - 1, int(p * total)))


def summary(df: DataFrame, column: str) -> DataFrame:
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")
    return df.agg(F.avg(column).alias("avg"), F.min(column).alias("min"), F.max(column).alias("max"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


def trigram_overlap(query: Column, source: Column) -> Column:
    """The share of a query's word trigrams that its source has; 0 without any."""
    def grams(text: Column) -> Column:
        w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
        at = F.when(F.size(w) >= 3, F.sequence(F.lit(1), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, 3), " ")))

    q = grams(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, grams(source))) / F.size(q))


def valid_question(question: Column, source: Column, starts: tuple[str, ...] = (), least: int = 10, most: int = 30, overlap: float = 0.5) -> Column:
    """A generated question of 10 to 30 words that doesn't copy its source or begin with a barred phrase."""
    n = F.size(F.filter(F.split(question, r"\s+"), lambda x: x != ""))
    ok = n.between(least, most) & (trigram_overlap(question, source) <= overlap)
    for s in starts:
        ok = ok & ~F.lower(question).startswith(s.lower())
    return F.coalesce(ok, F.lit(False))


def citations(answer: Column) -> Column:
    """The numbers in [n] marks, once each, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int")))


def pending(registry: DataFrame, indexed: DataFrame, key: str = "file") -> DataFrame:
    """Registered documents of which no chunk is indexed."""
    have = indexed.select(F.substring_index("id", ":", 1).alias(key)).distinct()
    return registry.join(have, key, "left_anti")


def fingerprint(df: DataFrame, ident: str = "id") -> DataFrame:
    """SHA-256 of all ids in order of their text, joined by newlines: a range sort streamed through one hash, a partition at a time."""
    digest, first = hashlib.sha256(), True
    for row in df.select(F.col(ident).cast("string").alias("id")).where("id IS NOT NULL").orderBy("id").toLocalIterator():
        digest.update(row.id.encode() if first else b"\n" + row.id.encode())
        first = False
    return df.sparkSession.createDataFrame([(digest.hexdigest(),)], "fingerprint string")


def tree_fingerprint(df: DataFrame, ident: str = "id") -> DataFrame:
    """A digest of the set of ids without a sort: SHA-256 of the counts and sums of their hashes."""
    name = F.sha2(F.col(ident).cast("string"), 256)
    part = lambda at: F.sum(F.conv(F.substring(name, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.sha2(F.concat_ws("\n", F.count(ident).cast("string"), *(part(at) for at in (1, 16, 31, 46))), 256).alias("fingerprint"))


def shaped_hits(results: DataFrame) -> DataFrame:
    """Search results with defaults for what a context lacks."""
    get = lambda path, kind, default: F.coalesce(F.try_variant_get("context", path, kind), F.lit(default))
    return results.select("rank", "id", "score", get("$.pageNumber", "int", 0).alias("page"), get("$.sourceFile", "string", "unknown").alias("source"), get("$.fullText", "string", "").alias("text"))


def rounded_score(score: Column) -> Column:
    """Four decimals, halves up toward positive infinity."""
    return F.floor(score * 10000 + 0.5) / 10000


#: What an answerer is told; sources are numbered from 1.
INSTRUCTIONS = "Answer from the numbered sources alone, cite them as [n], and say so where they hold no answer."


def prompt(question: str, hits: list) -> str:
    """The user's prompt: the sources in rank order, then the question."""
    sources = "\n\n".join(f"[{n}] {h.source}, page {h.page}\n{h.text}" for n, h in enumerate(hits, 1))
    return f"Sources:\n{sources}\n\nQuestion: {question}"


def ask(question: str, results: DataFrame, answer, k: int = 5) -> dict:
    """answer(instructions, prompt) -> text, over the k best hits; the citations are those that the text names, if they exist."""
    hits = shaped_hits(results).where(F.col("rank") <= k).orderBy("rank").collect()
    text = answer(INSTRUCTIONS, prompt(question, hits)) if hits else "No sources were found."
    named = results.sparkSession.range(1).select(citations(F.lit(text)).alias("c")).first().c
    return {"answer": text, "citations": [{"index": n, "page": hits[n - 1].page, "source": hits[n - 1].source, "preview": hits[n - 1].text[:200]} for n in sorted(named) if 0 < n <= len(hits)]}


def questions(chunked: DataFrame, generate, model: str, cache: str | None = None, prompt_version: int = 1, retries: int = 3, overlap: float = 0.5, starts: tuple[str, ...] = ()) -> DataFrame:
    """query_id, expected_id, text (null where no try was valid) for every chunk.

    generate(text, turn) is called on executors, retries + 1 times at most, until its question is valid. With a
    cache folder the questions are kept under the corpus fingerprint, model and prompt version, and reused while these hold.
    """
    spark = chunked.sparkSession
    where = f"{cache}/{model}-{prompt_version}-{fingerprint(chunked).first()[0]}" if cache else None
    if where:
        path = spark._jvm.org.apache.hadoop.fs.Path(where + "/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.parquet(where)
    tries = F.udf(lambda text: [generate(text, turn) for turn in range(retries + 1)], "array<string>")
    made = chunked.select("id", "text", tries("text").alias("tries"))
    first = F.get(F.filter("tries", lambda q: valid_question(q, F.col("text"), starts, overlap=overlap)), 0)
    out = made.select(F.concat(F.lit("q-"), F.col("id")).alias("query_id"), F.col("id").alias("expected_id"), first.alias("text"))
    if where:
        out.write.mode("overwrite").parquet(where)
        return spark.read.parquet(where)
    return out


def register(registry: DataFrame, chunked: DataFrame) -> DataFrame:
    """The registry with the documents of new chunks: file, pages, chunks and when they were ingested, as an ISO timestamp."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    new = document_totals(chunked).withColumn("ingested_at", now)
    return registry.join(new.select("file"), "file", "left_anti").unionByName(new)
