"""The registered queries: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.embedders import HashEmbedder
from ..operators import changelog, documents, knn, retrieval
from ..operators.collection import Collection, from_rows
from ..operators.filters import column_resolver, compile_filter, variant_resolver
from ..sources.crypto import KeySource
from ..sources.drivers import FileDriver
from ..sources.formats import is_folder, scratch_folder
from ..streaming import changes
from ..types import CollectionConfig
from . import dsl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIMENSIONS = 64


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One row: the query of the searches below."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding]


# nearest neighbours

_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_INT8 = "list_transform({v}, lambda x: CASE WHEN list_max({v}) = list_min({v}) THEN 0 ELSE floor((x - list_min({v})) / (list_max({v}) - list_min({v})) * 255 + 0.5) - 128 END)"
_BYTES = "list_transform(range(0, 8), lambda b: list_sum(list_transform(range(0, 8), lambda i: CASE WHEN {v}[b * 8 + i + 1] >= 0 THEN (128 >> i)::INTEGER ELSE 0 END))::DOUBLE)"
_SCORES = {
    "cosine": "CASE WHEN sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) = 0 THEN 0 ELSE list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END",
    "dot": "list_dot_product(a, b)",
    "euclidean": "1 / (1 + list_distance(a, b))",
    "hamming": "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a[i] >= 0) = (b[i] >= 0) THEN 1 ELSE 0 END)) / 64.0",
}


def _knn_sql(metric: str, codec: str, where: str = "", k: int = 10) -> str:
    code = {"F32": "{v}", "INT8": f"({_INT8})::DOUBLE[]", "BIT": "{v}" if metric == "hamming" else f"({_BYTES})::DOUBLE[]"}[codec]
    return f"""
    WITH {_Q}, c AS (SELECT vec_id, {code.format(v='v')} AS a, {code.format(v='q')} AS b FROM e, q {where}),
    s AS (SELECT vec_id, {_SCORES[metric]} AS score FROM c)
    SELECT vec_id, round(score, 6)::DOUBLE AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s ORDER BY score DESC, vec_id LIMIT {k}"""


def _knn(metric: str, codec: str, where=None, k: int = 10):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "embeddings")
        found = knn.nearest(df, vector(spark, sf_dir), CollectionConfig(DIMENSIONS, codec, metric), k, None if where is None else where(), ("vec_id",))
        return found.select("vec_id", F.round("score", 6).alias("score"), "rank")

    return run


for _metric, _codec in (("cosine", "F32"), ("dot", "F32"), ("euclidean", "F32"), ("cosine", "INT8"), ("dot", "INT8"), ("euclidean", "INT8"), ("hamming", "BIT"), ("cosine", "BIT"), ("dot", "BIT"), ("euclidean", "BIT")):
    query(f"knn_{_metric}_{_codec.lower()}", _knn_sql(_metric, _codec))(_knn(_metric, _codec))
query("knn_filtered", _knn_sql("cosine", "F32", "WHERE label = 3"))(_knn("cosine", "F32", lambda: F.col("label") == 3))
query("knn_topk_zero", _knn_sql("cosine", "F32", k=0))(_knn("cosine", "F32", k=0))


@query("knn_tiebreak", "SELECT vec_id, 0.0::DOUBLE AS score, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings ORDER BY vec_id LIMIT 10")
def knn_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant vectors all have INT8 codes 0, so every score ties at 0 and ids decide."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.array_repeat(F.lit(5.0), DIMENSIONS).alias("embedding"))
    return knn.nearest(df, [5.0] * DIMENSIONS, CollectionConfig(DIMENSIONS, "INT8"), 10, None, ("vec_id",)).select("vec_id", "score", "rank")


@query("collection_query", _knn_sql("cosine", "F32", "WHERE label IN (1, 2)").replace("vec_id, round", "vec_id::VARCHAR AS id, round"))
def collection_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = embedded(spark, sf_dir)
    where = compile_filter({"label": {"$in": [1, 2]}}, variant_resolver())
    return c.query(vector(spark, sf_dir), 10, where).select("id", F.round("score", 6).alias("score"), "rank")


def embedded(spark: SparkSession, sf_dir: str) -> Collection:
    rows = table(spark, sf_dir, "embeddings").withColumn("context", F.struct("label"))
    return Collection(from_rows(rows, "vec_id", context="context", seq="vec_id"), CollectionConfig(DIMENSIONS))


_JOIN = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, CASE WHEN {m} THEN list_dot_product(q.c, r.c) / (sqrt(list_dot_product(q.c, q.c)) * sqrt(list_dot_product(r.c, r.c))) ELSE 0 END AS score
      FROM (SELECT vec_id, {c} AS c FROM e WHERE vec_id % 20 = 0) q, (SELECT vec_id, {c} AS c FROM e) r),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)"""
_CODES = f"({_INT8.format(v='v')})::DOUBLE[]"


def _joined(spark: SparkSession, sf_dir: str, codec: str = "F32", k: int = 5) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    queries = df.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    return knn.nearest_join(queries, df, CollectionConfig(DIMENSIONS, codec), k, row_id="vec_id", digits=9)


@query("knn_join_top5", _JOIN.format(m="true", c="v") + " SELECT query_id, id, round(score, 6)::DOUBLE AS score, rank FROM t WHERE rank <= 5")
def knn_join_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all rows."""
    return _joined(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("retrieval_quality", _JOIN.format(m="true", c="v") + """, x AS (SELECT q.vec_id AS query_id, t.rank FROM embeddings q LEFT JOIN t ON t.query_id = q.vec_id AND t.rank <= 5 AND t.id = q.vec_id + 1 WHERE q.vec_id % 20 = 0)
    SELECT avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END)::DOUBLE AS recall_at_1, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END)::DOUBLE AS recall_at_5, avg(coalesce(1.0 / rank, 0))::DOUBLE AS mrr FROM x""")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("expected_id"))
    return retrieval.retrieval_quality(retrieval.rank_of_expected(queries, _joined(spark, sf_dir)), (1, 5))


@query("topk_agreement", _JOIN.format(m="true", c="v") + f""", b AS (SELECT query_id, list(id) AS ids FROM t WHERE rank <= 5 GROUP BY query_id),
    s2 AS (SELECT q.vec_id AS query_id, r.vec_id AS id, CASE WHEN sqrt(list_dot_product(q.c, q.c)) * sqrt(list_dot_product(r.c, r.c)) = 0 THEN 0 ELSE list_dot_product(q.c, r.c) / (sqrt(list_dot_product(q.c, q.c)) * sqrt(list_dot_product(r.c, r.c))) END AS score
      FROM (SELECT vec_id, {_CODES} AS c FROM e WHERE vec_id % 20 = 0) q, (SELECT vec_id, {_CODES} AS c FROM e) r),
    t2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s2), b2 AS (SELECT query_id, list(id) AS ids FROM t2 WHERE rank <= 5 GROUP BY query_id)
    SELECT round(avg(len(list_intersect(b.ids, b2.ids)) / 5.0), 6)::DOUBLE AS agreement FROM b JOIN b2 USING (query_id)""")
def topk_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.agreement(_joined(spark, sf_dir), _joined(spark, sf_dir, "INT8"), 5).withColumn("agreement", F.round("agreement", 6))


# codecs


@query("int8_roundtrip", f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT vec_id, v, {_CODES} AS c FROM e)
    SELECT vec_id, list_sum(c)::BIGINT AS code_sum, round(list_sum(list_transform(c, lambda x: (x + 128) / 255.0 * (list_max(v) - list_min(v)) + list_min(v))), 6)::DOUBLE AS value_sum FROM c""")
def int8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "embeddings").select("vec_id", V.int8_encode(F.col("embedding")).alias("q"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return q.select("vec_id", total(F.col("q.data")).cast("bigint").alias("code_sum"), F.round(total(V.int8_decode(F.col("q"))), 6).alias("value_sum"))


@query("bit_codes", f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT vec_id, array_to_string(({_BYTES.format(v='v')})::INTEGER[], ',') AS bytes, list_sum(list_transform(v, lambda x: CASE WHEN x >= 0 THEN 1 ELSE -1 END))::DOUBLE AS sign_sum FROM e""")
def bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "embeddings").select("vec_id", V.bit_encode(F.col("embedding"), DIMENSIONS).alias("q"))
    signs = F.aggregate(V.bit_decode(F.col("q"), DIMENSIONS), F.lit(0.0), lambda s, x: s + x)
    return q.select("vec_id", F.array_join(F.transform(F.col("q.data"), lambda x: x.cast("string")), ",").alias("bytes"), signs.alias("sign_sum"))


@query("l2_normalize", "WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7)) AS v FROM embeddings) SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6)::DOUBLE AS before, CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS after FROM e")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7)).alias("v"))
    return v.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("before"), F.round(V.norm(V.l2_normalize(F.col("v"))), 6).alias("after"))


@query("validate_vectors", "SELECT count(*) FILTER (WHERE vec_id % 5 NOT IN (1, 2, 3)) AS good, count(*) FILTER (WHERE vec_id % 5 IN (1, 2, 3)) AS bad FROM embeddings")
def validate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five vectors in turn one is cut short, one has a NaN and one is missing."""
    v, turn = F.col("embedding").cast("array<double>"), F.col("vec_id") % 5
    spoilt = F.when(turn == 1, F.slice(v, 1, DIMENSIONS - 1)).when(turn == 2, F.transform(v, lambda x, i: F.when(i == 7, F.lit(float("nan"))).otherwise(x))).when(turn != 3, v)
    ok = V.valid(F.col("embedding"), DIMENSIONS)
    return table(spark, sf_dir, "embeddings").withColumn("embedding", spoilt).agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


# document filters, over contexts {event_type, value, user, props: {k}, odd?} made of events


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    odd = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_id").alias("odd"))))
    text = F.to_json(F.struct("event_type", "value", F.col("user_id").alias("user"), F.from_json("props", "k bigint").alias("props")))
    whole = F.when(odd.isNull(), text).otherwise(F.concat(F.expr("substring(text, 1, length(text) - 1)"), F.lit(","), F.substring("odd", 2, 1000)))
    return rows.withColumns({"text": text, "odd": odd}).select("event_id", F.col("event_id").alias("seq"), F.parse_json(whole).alias("context"))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
FILTERS = {
    "eq": ({"event_type": "click"}, "event_type = 'click'"),
    "eq_type": ({"event_type": 5}, "false"),
    "ne": ({"event_type": {"$ne": "click"}}, "event_type <> 'click'"),
    "ne_missing": ({"odd": {"$ne": 3}}, "event_id <> 3"),
    "range": ({"value": {"$gt": 10, "$lte": 40.5}}, "value > 10 AND value <= 40.5"),
    "nested": ({"context.props.k": {"$gte": 50}}, f"{_K} >= 50"),
    "in": ({"user": {"$in": [1, 2, 3, "4"]}}, "user_id IN (1, 2, 3)"),
    "nin": ({"odd": {"$nin": [0, 3]}}, "event_id NOT IN (0, 3)"),
    "regex": ({"event_type": {"$regex": "^P"}}, "regexp_matches(event_type, '^P', 'i')"),
    "exists": ({"odd": {"$exists": True}}, "event_id % 3 = 0"),
    "not_exists": ({"odd": {"$exists": False}}, "event_id % 3 <> 0"),
    "and_or": ({"$or": [{"event_type": "click"}, {"$and": [{"value": {"$lt": 5}}, {"user": {"$gte": 10}}]}]}, "event_type = 'click' OR (value < 5 AND user_id >= 10)"),
    "empty": ({}, "true"),
    "id_missing": ({"id": 1}, "false"),
}


def _filtered(spec: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return events(spark, sf_dir).where(compile_filter(spec, variant_resolver())).select("event_id")

    return run


for _name, (_spec, _sql) in FILTERS.items():
    query(f"filter_{_name}", f"SELECT event_id FROM events WHERE {_sql}")(_filtered(_spec))


@query("filter_columns", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 1000 AND c_nationkey <> 7")
def filter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same language over plain columns: its comparisons are pushed into the scan."""
    df = table(spark, sf_dir, "customer")
    spec = {"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}, "c_acctbal": {"$gt": 1000}, "c_nationkey": {"$ne": 7}}
    return df.where(compile_filter(spec, column_resolver(df.schema))).select("c_custkey", "c_name")


# find, count, distinct, stats


@query("find_sort_page", "SELECT event_id FROM events WHERE event_type = 'click' ORDER BY value DESC, event_id LIMIT 20 OFFSET 10")
def find_sort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = compile_filter({"event_type": "click"}, variant_resolver())
    return documents.find(events(spark, sf_dir), where, {"context.value": -1}, 10, 20).select("event_id")


@query("find_sort_missing", "SELECT event_id FROM events ORDER BY (event_id % 3 = 0), CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END, event_id LIMIT 50")
def find_sort_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values come first in the cli's ascending order."""
    return documents.find(events(spark, sf_dir), None, {"odd": 1}).select("event_id")


@query("find_sort_missing_viewer", "SELECT event_id FROM events ORDER BY (event_id % 3 <> 0), CASE WHEN event_id % 3 = 0 THEN -event_id ELSE 0 END, event_id LIMIT 50")
def find_sort_missing_viewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.find(events(spark, sf_dir), None, {"context.odd": -1}, dialect="viewer").select("event_id")


@query("find_default_page", "SELECT event_id FROM events ORDER BY event_id LIMIT 50")
def find_default_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.find(events(spark, sf_dir)).select("event_id")


@query("count_filter", f"SELECT count(*) AS count FROM events WHERE {_K} < 30")
def count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.count(events(spark, sf_dir), compile_filter({"props.k": {"$lt": 30}}, variant_resolver()))


@query("distinct_values", "SELECT DISTINCT event_type AS value FROM events ORDER BY 1")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.distinct(events(spark, sf_dir), "event_type", "cli")


@query("distinct_numbers", f"SELECT DISTINCT 'NUMBER' AS kind, CAST({_K} AS VARCHAR) AS value FROM events")
def distinct_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.distinct(events(spark, sf_dir), "context.props.k")


@query("collection_stats", "SELECT count(*) AS entry_count, 64 AS dimensions, 'F32' AS quantization, 'cosine' AS metric, 'brute-force' AS index_status FROM embeddings")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).stats()


@query("field_paths", "SELECT 'context.' || unnest(['event_type', 'odd', 'props', 'props.k', 'user', 'value']) AS path")
def field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.field_paths(events(spark, sf_dir))


@query("dsl_find", "SELECT vec_id::VARCHAR AS id FROM embeddings WHERE label >= 4 AND label <> 6 ORDER BY label DESC, vec_id LIMIT 25 OFFSET 5")
def dsl_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "db.find({ context.label: { $gte: 4 }, 'context.label': {$gte: 4, $ne: 6,} }).sort({context.label: -1}).skip(5).limit(25)"
    return dsl.run(embedded(spark, sf_dir), text).select("id")


@query("dsl_count", "SELECT count(*) AS count FROM embeddings WHERE label = 2 OR vec_id = 7")
def dsl_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.run(embedded(spark, sf_dir), 'db.count({$or: [{context.label: 2}, {id: {$in: ["bigint:7"]}}]})')


@query("find_sort_mixed", """WITH m AS (SELECT event_id, event_id % 6 AS t, value FROM events), k AS (SELECT event_id, t < 2 AS missing, CASE WHEN t = 2 THEN value WHEN t = 3 THEN -value END AS n, CASE WHEN t = 4 THEN 'b' WHEN t = 5 THEN 'a' END AS s FROM m)
    SELECT event_id, row_number() OVER (ORDER BY missing, n DESC NULLS FIRST, s DESC NULLS LAST, event_id) AS place FROM k""")
def find_sort_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, null, numbers and texts in one path, downwards: texts, numbers, then null and missing in their order."""
    t = F.col("event_id") % 6
    x = F.when(t == 0, F.lit("{}")).when(t == 1, F.lit('{"x":null}')).when(t == 2, F.to_json(F.struct(F.col("value").alias("x")))).when(t == 3, F.to_json(F.struct((-F.col("value")).alias("x")))).when(t == 4, F.lit('{"x":"b"}')).otherwise(F.lit('{"x":"a"}'))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("seq"), F.parse_json(x).alias("context"))
    return documents.places(rows, {"x": -1}, "event_id", scratch_folder(spark, "places"))


# keyed changes


@query("get_by_id", "SELECT vec_id::VARCHAR AS id, label FROM embeddings WHERE vec_id = 42")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).get(42).select("id", F.variant_get("context", "$.label", "int").alias("label"))


@query("upsert_lww", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
    SELECT user_id, event_id, value FROM l WHERE r = 1 AND event_type <> 'error'
    UNION ALL SELECT c_custkey, -1, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def upsert_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log keyed by user over a base of customers: errors delete, other events put; the last one of a user counts."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("put")).alias("op"), F.col("event_id").alias("pos"))
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), F.col("c_acctbal").alias("value"))
    return changelog.replay(base, log, "user_id")


@query("upsert_collection", "SELECT vec_id::VARCHAR AS id, vec_id AS seq, CASE WHEN vec_id % 10 = 0 THEN 99 ELSE label END AS label FROM embeddings UNION ALL SELECT (vec_id + 1000000)::VARCHAR, (SELECT max(vec_id) + 1 FROM embeddings) + vec_id, 99 FROM embeddings WHERE vec_id % 100 = 0")
def upsert_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaced rows keep their place, new ones follow."""
    c = embedded(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings")
    old = rows.where("vec_id % 10 = 0").select("vec_id", "embedding", F.col("vec_id").alias("at"))
    new = rows.where("vec_id % 100 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), "embedding", F.col("vec_id").alias("at"))
    batch = old.unionByName(new).withColumn("context", F.struct(F.lit(99).alias("label")))
    return c.add_many(from_rows(batch, "vec_id", context="context", seq="at")).df.select("id", "seq", F.variant_get("context", "$.label", "int").alias("label"))


@query("delete_anti", "SELECT vec_id::VARCHAR AS id FROM embeddings WHERE vec_id % 4 <> 0")
def delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "embeddings").where("vec_id % 4 = 0").select(F.lit(1).alias("id_type"), F.col("vec_id").cast("string").alias("id"))
    return embedded(spark, sf_dir).delete(gone).df.select("id")


@query("delete_report", "SELECT '__bigint__:' || x AS _key, x IN (SELECT vec_id FROM embeddings) AS found FROM (SELECT unnest([1, 5, 99999999]) AS x) ORDER BY 1")
def delete_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).found(spark.createDataFrame([(1, "1"), (1, "5"), (1, "99999999")], "id_type int, id string"))


@query("delete_document", "SELECT conv_id || ':' || turn AS id FROM conversations WHERE conv_id <> 3")
def delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops all chunks of one document; turns of a conversation stand for chunks."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.array(F.lit(1.0)).alias("embedding"))
    return Collection(from_rows(rows, "id"), CollectionConfig(1)).delete_document("3").df.select("id")


@query("collection_merge_on_read", """SELECT vec_id::VARCHAR AS id, vec_id AS seq, CASE WHEN vec_id % 10 = 0 THEN 99 ELSE label END AS label, CASE WHEN vec_id % 10 = 0 THEN 1.0 ELSE round(embedding[1]::DOUBLE, 6) END::DOUBLE AS first FROM embeddings WHERE vec_id % 7 <> 3
    UNION ALL SELECT 'new-' || vec_id, (SELECT max(vec_id) + 1 FROM embeddings) + vec_id, 7, 1.0 FROM embeddings WHERE vec_id % 100 = 0""")
def collection_merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot file with a change log beside it, read back as one collection: puts, new rows, and deletes that come last."""
    c, folder = embedded(spark, sf_dir), scratch_folder(spark, "merge")
    driver = FileDriver(spark, folder, log=True)
    driver.write("c", c)
    rows = c.df.select("id", F.col("id_big").cast("bigint").alias("n")).where("pmod(n, 10) = 0 OR pmod(n, 7) = 3").orderBy("n").toLocalIterator()
    ops, put = [], {"op": "put", "data": [1.0] * DIMENSIONS}
    for r in rows:
        ops += [put | {"id_type": 1, "id": r.id, "context": '{"label":99}'}] if r.n % 10 == 0 else []
        ops += [{"op": "delete", "id_type": 1, "id": r.id}] if r.n % 7 == 3 else []
    driver.append("c", ops)
    found = driver.read("c").df
    more = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.concat(F.lit("new-"), F.col("vec_id").cast("string")).alias("id"), F.col("vec_id").alias("at"), F.array_repeat(F.lit(1.0), DIMENSIONS).alias("embedding"), F.struct(F.lit(7).alias("label")).alias("context"))
    merged = Collection(found, c.config).add_many(from_rows(more, "id", context="context", seq="at"))
    return merged.df.select("id", "seq", F.variant_get("context", "$.label", "int").alias("label"), F.round(F.get("embedding", 0), 6).alias("first"))


@query("snapshot_round_trip", f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT vec_id, label, v, {_CODES} AS c FROM e)
    SELECT vec_id::VARCHAR AS id, vec_id AS seq, label, round(list_sum(list_transform(c, lambda x: (x + 128) / 255.0 * (list_max(v) - list_min(v)) + list_min(v))), 6)::DOUBLE AS total FROM c""")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An INT8 collection written as an encrypted snapshot file and read back."""
    c = Collection(embedded(spark, sf_dir).df, CollectionConfig(DIMENSIONS, "INT8"))
    driver = FileDriver(spark, scratch_folder(spark, "snapshot"), KeySource(key=b"a key of this query, 32 bytes...."[:32]))
    driver.write("c", c)
    back = driver.read("c", c.config).df
    return back.select("id", "seq", F.variant_get("context", "$.label", "int").alias("label"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("registry_pending", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def registry_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a registry of which no chunk is indexed: here nations without a supplier of means."""
    nations = table(spark, sf_dir, "nation").withColumn("file", F.col("n_nationkey").cast("string"))
    indexed = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat_ws(":", F.col("s_nationkey").cast("string"), F.lit("p1"), F.col("s_suppkey").cast("string")).alias("id"))
    return retrieval.pending(nations, indexed).select("n_nationkey")


# text


@query("text_search")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashing embedder over whole documents, and a text query with a filter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", HashEmbedder().column("text").alias("embedding"), F.struct("lang", "source").alias("context"))
    c = Collection(from_rows(docs, "doc_id", context="context", seq="doc_id"), CollectionConfig(64))
    return c.query_by_text("the entire of the", HashEmbedder(), 10, compile_filter({"lang": "en"}, variant_resolver())).select("id", F.round("score", 6).alias("score"), "rank")


@query("chunk_documents", r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, ps, 0::BIGINT AS i, 0::BIGINT AS chunk, 0::BIGINT AS size, false AS closed, 0::BIGINT AS done FROM p
      UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN full_ THEN chunk + 1 ELSE chunk END, CASE WHEN full_ OR size = 0 THEN n ELSE size + 2 + n END, full_, size FROM
        (SELECT *, len(ps[i + 1]) AS n, size + len(ps[i + 1]) > 500 AND size >= 100 AS full_ FROM s WHERE i < len(ps)))
    SELECT doc_id AS file, chunk, doc_id || ':p1:c' || chunk AS id, max(size)::BIGINT AS size FROM s WHERE i > 0 GROUP BY doc_id, chunk""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for paragraphs; a document is one page."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.lit(1).alias("page"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return retrieval.chunks(pages).select("file", "chunk", "id", F.length("text").cast("bigint").alias("size"))


@query("document_stats", """WITH w AS (SELECT doc_id AS file, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS paragraphs FROM documents)
    SELECT file, paragraphs FROM w""")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.size(lines).cast("bigint").alias("paragraphs"))


_GRAMS = "list_distinct(list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]))"
_WORDS = "list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda x: x <> '')"


@query("trigram_overlap", f"""WITH p AS (SELECT a.item_id, {_WORDS.format(t='a.text')} AS q, {_WORDS.format(t='b.text')} AS s FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id - a.item_id % 2),
    g AS (SELECT item_id, {_GRAMS.format(w='q')} AS q, {_GRAMS.format(w='s')} AS s FROM p)
    SELECT item_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, s)) / len(q) END, 6)::DOUBLE AS overlap FROM g""")
def trigram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item against the even item before it."""
    b = table(spark, sf_dir, "benchmark")
    other = b.select(F.col("item_id").alias("other"), F.col("text").alias("source"))
    pairs = b.join(other, F.col("other") == F.col("item_id") - F.col("item_id") % 2)
    return pairs.select("item_id", F.round(retrieval.trigram_overlap(F.col("text"), F.col("source")), 6).alias("overlap"))


@query("citation_extract", """WITH a AS (SELECT conv_id, turn, text || ' [' || turn || '] and [' || conv_id || '] [' || turn || ']' AS t FROM conversations)
    SELECT conv_id, turn, array_to_string(CASE WHEN turn = conv_id THEN [turn] ELSE [turn, conv_id] END, ',') AS cited FROM a""")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = lambda c: F.concat(F.lit("["), F.col(c).cast("string"), F.lit("]"))
    answers = table(spark, sf_dir, "conversations").withColumn("answer", F.concat("text", F.lit(" "), mark("turn"), F.lit(" and "), mark("conv_id"), F.lit(" "), mark("turn")))
    return answers.select("conv_id", "turn", F.array_join(F.transform(retrieval.citations(F.col("answer")), lambda x: x.cast("string")), ",").alias("cited"))


@query("percentile_floor", "WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT value FROM s WHERE i = least(n - 1, floor(0.95 * n)::BIGINT)")
def percentile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.percentile(table(spark, sf_dir, "events"), "value", 0.95)


@query("percentile_nearest", "SELECT quantile_disc(value, 0.95) AS value FROM events")
def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.percentile(table(spark, sf_dir, "events"), "value", 0.95, "nearest")


@query("latency_summary", "SELECT round(avg(value), 6)::DOUBLE AS avg, min(value) AS min, max(value) AS max, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.summary(table(spark, sf_dir, "events"), "value").withColumn("avg", F.round("avg", 6))


@query("score_rounding", "SELECT event_id, floor((value - 50) / 1000 * 10000 + 0.5) / 10000 AS score FROM events")
def score_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", retrieval.rounded_score((F.col("value") - 50) / 1000).alias("score"))


@query("corpus_fingerprint", "SELECT sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS fingerprint FROM documents")
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fingerprint(table(spark, sf_dir, "documents"), "doc_id")


@query("running_counts", "SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of events through watermarked daily windows, run until it has read all, as its sink holds it."""
    out = scratch_folder(spark, "windows")
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path if is_folder(spark, path) else f"{sf_dir}/events.parque[t]")
    epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    stream = stream.withColumn("ts", F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {epoch}, ts)")))  # the clock time as UTC
    changes.windows_to_table(changes.running_counts(stream, "ts", "1 day", "3650 days", "event_type"), out + "/table", out + "/checkpoint").awaitTermination()
    return changes.window_totals(spark, out + "/table", "event_type").select("event_type", F.expr(f"timestampadd(MICROSECOND, unix_micros(window.start), {epoch})").alias("start"), "n", F.round("total", 4).alias("total"))


@query("streamed_changes", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
    SELECT user_id, event_id, value FROM l WHERE r = 1 AND event_type <> 'error'""")
def streamed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of upsert_lww as a stream, merged into a stored collection batch by batch."""
    out, path = scratch_folder(spark, "changes"), f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if is_folder(spark, path) else f"{sf_dir}/events.parque[t]")
    log = stream.select("user_id", "event_id", "value", F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("put")).alias("op"), F.col("event_id").alias("pos"))
    changes.apply_changes(log, out + "/collection", out + "/checkpoint", "user_id").awaitTermination()
    return changes.current(spark, out + "/collection").select("user_id", "event_id", "value")


@query("insertion_order", "SELECT vec_id::VARCHAR AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings")
def insertion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embedded(spark, sf_dir).df
    label = F.variant_get("context", "$.label", "int")
    return df.select("id", F.row_number().over(Window.partitionBy(label).orderBy("seq")).cast("bigint").alias("place"))
