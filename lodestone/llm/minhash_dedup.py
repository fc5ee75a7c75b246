"""MinHash near-duplicate classes: universal hash minima, banding, signature check, full-set check, star components.

Equal shingle sets are one node. Nodes that share a band meet in a bucket, whose
leader is compared with every other member: a bucket of true copies costs one row a
member. Where a leader L leaves several components, an exact bound rules pairs out
unseen: with U for L and what many of its group hold, c = |x & U| and m the number of x's shingles
beside U that other components hold, linked sets x and y have 9 (c + m) >= 4 (|x| + |y|) and meet
under one of their rarest such shingles, or have none in common and 9 c >= 4 (|x| + |y|).
Under those keys a growing share of members leads in rounds, and meets only
members of other components within these sizes. So no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, broadcast_if_small, read_table
from .components import connected_components, merged_components
from .hashing import fingerprint, mix, shingles, word_hashes

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8^6)^42, about 3 in a million.
BANDS, ROWS = 42, 6
HASHES = BANDS * ROWS
#: Signatures keep a byte of each minimum. At 0.8 the expected agreement less 5.5 deviations of its binomial.
_S = 0.8 + 0.2 / 256
MIN_AGREE = int(HASHES * _S - 5.5 * (HASHES * _S * (1 - _S)) ** 0.5)
#: Buckets of up to SMALL members test all their pairs; of what a leader can't rule out, FIRST members lead at first, then GROWTH times more.
SMALL, FIRST, GROWTH = 4, 16, 16
#: Rows of one bucket or hub that meet in one task.
SPREAD = 10_000
_rng = np.random.Generator(np.random.PCG64(71))
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def minima(members: np.ndarray) -> np.ndarray:
    """For each universal hash (a x + b) >> 32 its least value over a set that isn't empty."""
    keys = members >> np.uint64(32)
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(keys), 2048):
        np.minimum(best, ((keys[None, at : at + 2048] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(axis=1), out=best)
    return best


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(31) + rows[:, j])
    return key.view(np.int64)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of the set of k-word shingles), f1 and f2 (the set's name), bands and sig; of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, bands, offsets, sigs = [], [], [], [], [0], []
            for words in word_hashes(batch.column("_text").to_pylist()):
                members = np.unique(shingles(words, k))
                name = fingerprint(members)
                n.append(len(members))
                f1.append(name[0])
                f2.append(name[1])
                if len(members):
                    signature = minima(members)
                    bands.append(band_keys(signature))
                    sigs.append((signature & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    sigs.append(b"")
                offsets.append(offsets[-1] + (BANDS if len(members) else 0))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "f1", "f2", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bands array<long>, sig binary")


def _agreeing(pairs: DataFrame, least: int = MIN_AGREE) -> DataFrame:
    """Signature verification: the pairs whose minima agree often enough, for the threshold unless told otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return pairs.mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, k: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= 80 * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = (word_hashes(batch.column(c).to_pylist()) for c in ("ta", "tb"))
            for x, y in zip(left, right, strict=True):
                x, y = np.unique(shingles(x, k)), np.unique(shingles(y, k))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _with_hubs(pairs: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    """pairs with column of table's row rep = a; a hub of many pairs meets them in several tasks."""
    if pairs.count() <= SPREAD:
        return pairs.join(table.select(F.col("rep").alias("_hub"), F.col(column).alias(name)), F.col("a") == F.col("_hub")).drop("_hub")
    hot = pairs.groupBy("a").agg(F.count("*").alias("_n")).where(F.col("_n") > SPREAD).select(F.col("a").alias("_h"), F.expr(f"_n DIV {SPREAD} + 1").alias("_parts"))
    hot = broadcast_if_small(hot)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = pairs.join(hot, F.col("a") == F.col("_h"), "left").withColumn("_part", F.pmod(F.xxhash64("b"), parts)).drop("_h", "_parts")
    hubs = table.join(hot, F.col("rep") == F.col("_h"), "left").select(F.col("rep").alias("_hub"), F.col(column).alias(name), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_share"))
    return dealt.join(hubs, (F.col("a") == F.col("_hub")) & (F.col("_part") == F.col("_share"))).drop("_hub", "_share", "_part")


def _both(pairs: DataFrame, table: DataFrame, column: str, hub: str, spoke: str) -> DataFrame:
    of = table.select(F.col("rep").alias("_spoke"), F.col(column).alias(spoke))
    return _with_hubs(pairs, table, column, hub).join(of, F.col("b") == F.col("_spoke")).drop("_spoke")


def _outside(groups: DataFrame, k: int) -> DataFrame:
    """For each pair (a, b) of texts: b's size n, its overlap c with a, and its shingles that a lacks; fa and fb name the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            left, right = (word_hashes(batch.column(c).to_pylist()) for c in ("ta", "tb"))
            for x, y in zip(left, right, strict=True):
                x, y = np.unique(shingles(x, k)), np.unique(shingles(y, k))
                out = np.setdiff1d(y, x, assume_unique=True).view(np.int64)
                rows.append((fingerprint(x)[0], fingerprint(y)[0], len(y), len(y) - len(out), out))
            fa, fb, n, c, out = zip(*rows, strict=True) if rows else [()] * 5
            lists = pa.array([o.tolist() for o in out], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("a", "b", "ca", "cb")), *(pa.array(list(v), pa.int64()) for v in (fa, fb, n, c)), lists], names)

    names = ["a", "b", "ca", "cb", "fa", "fb", "n", "c", "out"]
    return groups.select("a", "b", "ca", "cb", "ta", "tb").mapInArrow(run, ", ".join(f"{x} long" for x in names[:-1]) + ", out array<long>")


def _refined(outs: DataFrame, heads: DataFrame) -> DataFrame:
    """key, rep, n, most, loose, size: buckets in which every link between components meets that the reference doesn't rule out.

    The reference is the leader and what over an eighth of its group holds beside; c counts x's shingles in it. A
    link of x has at least r = ceil(0.8 n) - c common shingles outside, so two linked sets share one of x's all
    but r - 1 rarest among those that several components hold, or have none in common and meet by c alone.
    most bounds x's overlap with other components; loose members are not in the leader's.
    """
    own, sums = ("a", "fa", "b", "fb"), ("ca", "cb", "n", "c")
    each = outs.select(*own, *sums, F.explode("out").alias("g"))
    held = each.groupBy("a", "fa", "g").agg(F.count("*").alias("size"), F.min("cb").alias("lo"), F.max("cb").alias("hi")).where("lo <> hi")
    held = held.join(broadcast_if_small(heads.select("_head", F.col("size").alias("_all"))), F.col("a") == F.col("_head"))
    held = held.select(F.col("a").alias("_a"), F.col("fa").alias("_fa"), F.col("g").alias("_g"), "size", (F.col("size") > F.greatest(F.lit(FIRST), F.col("_all") / 8)).alias("usual"))
    met = each.join(held, (F.col("a") == F.col("_a")) & (F.col("fa") == F.col("_fa")) & (F.col("g") == F.col("_g"))).select(*own, *sums, "g", "size", "usual")
    met = met.unionAll(outs.select(*own, *sums, F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(False)))
    of = met.groupBy(*own).agg(
        *(F.max(x).alias(x) for x in ("ca", "cb", "n")), (F.max("c") + F.sum(F.col("usual").cast("long"))).alias("c"), F.array_sort(F.collect_list(F.when(F.col("g").isNotNull() & ~F.col("usual"), F.struct("size", "g")))).alias("held")
    )
    of = of.withColumns({"r": F.greatest(F.lit(1), F.ceil(F.col("n") * 4 / 5) - F.col("c")).cast("int"), "loose": F.col("cb") != F.col("ca")})
    rarest = of.where("size(held) >= r").select("*", F.explode(F.slice("held", F.lit(1), F.size("held") - F.col("r") + 1)).alias("h"))
    shared = rarest.select(F.xxhash64("a", "fa", F.col("h")["g"]).alias("key"), F.col("b").alias("rep"), "n", (F.col("c") + F.size("held")).alias("most"), "loose", F.col("h")["size"].alias("size"))
    core = of.where("5 * c >= 4 * n").join(broadcast_if_small(heads.select("_head", "size")), F.col("a") == F.col("_head"))
    return shared.unionAll(core.select(F.xxhash64("a", "fa"), "b", "n", "c", "loose", "size")).distinct()


def _possible(refined: DataFrame, comp: DataFrame, low: float, width: float) -> DataFrame:
    """Pairs (a, b) of a round: loose members drawn as leaders, with members of other components where 9 most >= 4 (n + n') for both."""
    now = refined.join(comp, F.col("rep") == F.col("_u"), "left").withColumn("comp", F.coalesce("_v", "rep")).drop("_u", "_v")
    at = lambda n: F.floor(F.log(n) / F.lit(float(np.log(1.1))))
    draw = F.pmod(F.xxhash64("key", "rep", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("size")
    x = now.where(F.col("loose") & (draw >= low) & (draw < low + width))
    x = x.withColumn("bin", F.explode(F.sequence(at(F.ceil(F.col("n") * 4 / 5)), at(F.floor((F.col("most") * 9 - F.col("n") * 4) / 4)))))
    x = x.select(*(F.col(c).alias(f"_{c}") for c in ("key", "rep", "n", "most", "comp", "bin")))
    fit = F.least("most", "_most") * 9 >= (F.col("n") + F.col("_n")) * 4
    met = now.withColumn("bin", at(F.col("n"))).join(x, (F.col("key") == F.col("_key")) & (F.col("bin") == F.col("_bin")) & (F.col("comp") != F.col("_comp")) & fit)
    return met.select(F.least("rep", "_rep").alias("a"), F.greatest("rep", "_rep").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (columns doc_id and text are read).

    Rows that share a doc_id are one document. Null and blank texts have an empty
    set and are linked with nothing; a null doc_id has a null component_id and
    is linked with nothing. Other columns, whatever their names, are ignored.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.keep(sketches(docs, k), "sketches")
    live = rows.where("n > 0 AND doc_id IS NOT NULL")
    sets = scratch.keep(
        live.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "sets"
    )
    member = sets.select("rep", "n", F.explode("bands").alias("key"))
    sizes = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("key", "_key")
    buckets = scratch.keep(member.join(sizes, F.col("key") == F.col("_key")).select("key", "rep", "n", "size"), "buckets")
    # the member that meets most others leads, in all its buckets
    rank = scratch.keep(buckets.groupBy("rep").agg(F.sum("size").alias("met")), "ranks")
    nodes = broadcast_if_small(rank.select(F.col("rep").alias("_rep")))
    signs = scratch.keep(sets.join(nodes, F.col("rep") == F.col("_rep"), "left_semi").select("rep", "sig"), "signatures")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    texts = scratch.keep(texts.join(nodes, F.col("rep") == F.col("_rep"), "left_semi"), "texts")

    # a document that holds several sets ties them together
    of_set = ["f1", "f2", "n"]
    several = live.groupBy("doc_id").agg(F.min(F.struct(*of_set)).alias("lo"), F.max(F.struct(*of_set)).alias("hi")).where("lo <> hi")
    tied = live.join(several.select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id"), "left_semi")
    tied = tied.join(sets.select(*(F.col(c).alias(f"_{c}") for c in of_set), "rep"), (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")) & (F.col("n") == F.col("_n")))
    links = connected_components(tied.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), scratch, "ties")

    def tested(pairs: DataFrame, turn: int) -> DataFrame:
        """The components after the links among pairs, a table of (a, b)."""
        likely = scratch.keep(_agreeing(_both(pairs, signs, "sig", "sa", "sb")).distinct(), f"likely-{turn}")
        found = scratch.keep(_linked(_both(likely, texts, "text", "ta", "tb"), k).distinct(), f"links-{turn}")
        joined = merged_components(links, found, scratch, f"components-{turn}")
        scratch.drop(f"likely-{turn}")
        scratch.drop(f"links-{turn}")
        return joined

    def component() -> DataFrame:
        return links.select(F.col("u").alias("_u"), F.col("v").alias("_v"))

    # first all pairs of small buckets, and the leader of a larger one with each member
    some = buckets.where(F.col("size") <= SMALL)
    other = some.select(F.col("key").alias("_key"), F.col("rep").alias("_rep"), F.col("n").alias("_n"))
    few = some.join(other, (F.col("key") == F.col("_key")) & (F.col("rep") < F.col("_rep"))).select(F.col("rep").alias("a"), F.col("_rep").alias("b"), "n", "_n")
    many = buckets.where(F.col("size") > SMALL).withColumn("_parts", F.expr(f"size DIV {SPREAD} + 1"))
    ranked = many.join(broadcast_if_small(rank.select(F.col("rep").alias("_r"), "met")), F.col("rep") == F.col("_r"))
    leads = ranked.groupBy("key", "_parts").agg(F.max(F.struct("met", "rep", "n")).alias("lead"))
    leads = leads.select(F.col("key").alias("_key"), F.col("lead")["rep"].alias("a"), F.col("lead")["n"].alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_share"))
    led = many.withColumn("_part", F.pmod(F.xxhash64("rep"), F.col("_parts"))).join(leads, (F.col("key") == F.col("_key")) & (F.col("_part") == F.col("_share")) & (F.col("rep") != F.col("a")))
    led = scratch.keep(led.select("a", F.col("rep").alias("b"), "n", "_n").distinct(), "led")
    alike = F.least("n", "_n") * 100 >= F.greatest("n", "_n") * 80
    pairs = scratch.keep(few.where(alike).select("a", "b").unionAll(led.where(alike).select("a", "b")).distinct(), "pairs-0")
    links = tested(pairs, 0)

    # groups whose leader leaves several components: what the leader can't rule out meets again. A leader that another
    # one leads and resembles passes its group on to that one, the highest there is, so a cluster has one reference.
    leader = broadcast_if_small(led.select(F.col("a").alias("_lead")).distinct())
    known = scratch.keep(led.select("a", "b").distinct().join(leader, F.col("b") == F.col("_lead"), "left_semi"), "led-leaders")
    close = _agreeing(_both(known, signs, "sig", "sa", "sb"), HASHES // 2)
    above = close.join(rank, F.col("a") == F.col("rep")).groupBy("b").agg(F.max(F.struct("met", "rep")).alias("top")).select(F.col("b").alias("_led"), F.col("top")["rep"].alias("_top"))
    groups = led.join(broadcast_if_small(scratch.keep(above, "above")), F.col("a") == F.col("_led"), "left").select(F.coalesce("_top", "a").alias("a"), "b").where("a <> b").distinct()
    groups = groups.join(component(), F.col("b") == F.col("_u"), "left").withColumn("cb", F.coalesce("_v", "b")).drop("_u", "_v")
    groups = scratch.keep(groups, "groups")
    heads = groups.groupBy("a").agg(F.min("cb").alias("lo"), F.max("cb").alias("hi"), F.count("*").alias("size"))
    heads = heads.join(component(), F.col("a") == F.col("_u"), "left").withColumn("ca", F.coalesce("_v", "a"))
    heads = scratch.keep(heads.where("size > 1 AND (lo <> ca OR hi <> ca)").select(F.col("a").alias("_head"), "ca", "size"), "heads")
    opened = groups.join(broadcast_if_small(heads.select("_head", "ca")), F.col("a") == F.col("_head")).drop("_head")
    opened = scratch.keep(opened, "opened")
    outs = scratch.keep(_outside(_both(opened, texts, "text", "ta", "tb"), k), "outside")
    refined = scratch.keep(_refined(outs, heads), "refined")
    scratch.drop("outside")
    largest = refined.agg(F.max("size")).first()[0] or 0

    done, low, width, turn = pairs, 0.0, float(FIRST), 1
    while low < largest:
        new = _possible(refined, component(), low, width).distinct()
        seen = done.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
        pairs = scratch.keep(new.join(seen, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti"), f"pairs-{turn}")
        if not pairs.isEmpty():
            links, done = tested(pairs, turn), done.unionAll(pairs)
        low, width, turn = low + width, width * GROWTH, turn + 1

    for table in ("buckets", "ranks", "signatures", "texts", "led", "led-leaders", "above", "opened", "groups", "heads", "refined", *(f"pairs-{t}" for t in range(turn))):
        scratch.drop(table)
    copies = sets.where("copies > 1").select(*(F.col(c).alias(f"_{c}") for c in of_set), F.col("rep").alias("_rep"))
    same = (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")) & (F.col("n") == F.col("_n"))
    named = rows.select("doc_id", *of_set).join(broadcast_if_small(copies), same & F.col("doc_id").isNotNull(), "left")
    named = named.withColumn("rep", F.coalesce("_rep", "doc_id"))
    return named.join(broadcast_if_small(component()), F.col("rep") == F.col("_u"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_v", "rep")).alias("component_id")
    )


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of docs less all but one document of each class of near-duplicates; columns as they were.

    The document of the least doc_id stays, each of its different texts once, from the row of the least hash.
    Rows without a doc_id stay. Other columns may have any names.
    """
    found = near_duplicates(docs, k)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    packed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    left = packed.join(broadcast_if_small(gone), F.col("_id") == F.col("_gone"), "left_anti")
    again = packed.where("_id IS NOT NULL").groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_id").alias("_again"))
    if not again.isEmpty():
        twice = left.join(again, F.col("_id") == F.col("_again"), "left_semi")
        once = twice.groupBy("_id", F.col("_row")["text"].alias("_text")).agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
        left = left.join(again, F.col("_id") == F.col("_again"), "left_anti").unionAll(once.select("_id", "_row"))
    return left.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, on two-word shingles."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"), k=2)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), sym AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e
), r AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION
  SELECT sym.v, r.c FROM r JOIN sym ON r.doc_id = sym.u
), c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""
