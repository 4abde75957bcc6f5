"""Queries of sample preparation and evaluation (B)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket
from ..functions.indexing import global_index
from ..operators import evaluation as E
from ..operators import features as P
from . import fixtures as X
from .registry import Tables, query

KEY = "l_orderkey, l_linenumber"
KEYS = ("l_orderkey", "l_linenumber")
FLOATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def samples(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("label", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))


@query(f"SELECT {KEY}, (l_returnflag = 'R')::INT AS label, l_quantity + l_discount AS feature_sum FROM lineitem")
def B1_split_label(t: Tables) -> DataFrame:
    rows = samples(t).select(*KEYS, "label", *FLOATS)
    found = P.split_label(rows, "label")
    return found.select(*(F.col(f"features.{c}") for c in KEYS), "label", (F.col("features.l_quantity") + F.col("features.l_discount")).alias("feature_sum"))


@query("SELECT r AS repeat_no, o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders, (SELECT unnest(range(3))::INT AS r) GROUP BY 1, 2")
def B2_repeat(t: Tables) -> DataFrame:
    return P.repeat(t.orders, 3).groupBy("repeat_no", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


_SHUFFLED = f"s AS (SELECT o_orderkey, row_number() OVER (ORDER BY {X.HASH.format("'11:' || o_orderkey")}, o_orderkey) - 1 AS pos FROM orders)"


@query(f"WITH {_SHUFFLED} SELECT o_orderkey, pos FROM s")
def B3_shuffle(t: Tables) -> DataFrame:
    return P.shuffle(t.orders.select("o_orderkey"), 11, "o_orderkey")


SPAN, BUFFER = 4096, 500


@query(f"""
WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders),
s AS (SELECT o_orderkey, place // {SPAN} AS stream, place % {SPAN} AS step, {X.HASH.format(f"'11:' || (place // {SPAN}) || ':' || (place % {SPAN})")} AS h FROM a),
w AS (SELECT *, CASE WHEN step < {BUFFER} THEN step ELSE h % {BUFFER} END AS slot FROM s),
n AS (SELECT *, lead(step) OVER (PARTITION BY stream, slot ORDER BY step) AS next, count(*) OVER (PARTITION BY stream) AS n FROM w)
SELECT o_orderkey, stream::BIGINT AS stream,
       CASE WHEN next IS NULL THEN greatest(n - {BUFFER}, 0) + row_number() OVER (PARTITION BY stream, next IS NULL ORDER BY h, step) - 1 ELSE next - {BUFFER} END::BIGINT AS pos
FROM n""")
def B3_buffered_shuffle(t: Tables) -> DataFrame:
    """Orders in spans of their positions, each behind a buffer."""
    placed = global_index(t.orders.select("o_orderkey"), [F.col("o_orderkey")], "at")
    rows = placed.select("o_orderkey", F.floor(F.col("at") / SPAN).alias("stream"), (F.col("at") % SPAN).alias("step"))
    return P.buffered_shuffle(rows, 11, "stream", "step", BUFFER).select("o_orderkey", "stream", "pos")


@query(f"WITH {_SHUFFLED} SELECT o_orderkey, (pos // 2048)::BIGINT AS batch_no, (pos % 2048)::BIGINT AS batch_pos FROM s")
def B4_batch(t: Tables) -> DataFrame:
    return P.batch(P.shuffle(t.orders.select("o_orderkey"), 11, "o_orderkey"), 2048).select("o_orderkey", "batch_no", "batch_pos")


@query(f"SELECT {KEY}, (l_returnflag = 'R')::INT AS label, unnest(range(4))::INT AS dim, round(unnest([l_quantity, l_extendedprice, l_discount, l_tax]), 6) AS v FROM lineitem")
def B5_stack_features(t: Tables) -> DataFrame:
    return X.cells(P.stack_features(samples(t), list(FLOATS), "label"), *KEYS, "label", value="features")


@query(f"SELECT {KEY}, l_tax::FLOAT::DOUBLE AS x FROM lineitem")
def B6_numeric_column(t: Tables) -> DataFrame:
    return t.lineitem.select(*KEYS, P.numeric_column(F.col("l_tax"))[0].cast("double").alias("x"))


@query(f"SELECT p_partkey, {X.HASH.format('p_brand')} % 1000 AS brand_bucket, {X.HASH.format('p_type')} % 10000 AS type_bucket FROM part")
def B7_hash_bucket(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", hash_bucket(F.col("p_brand"), 1000).alias("brand_bucket"), hash_bucket(F.col("p_type")).alias("type_bucket"))


@query(f"""
WITH {X.EMB_SQL}, ids AS (SELECT DISTINCT l_partkey AS key FROM lineitem)
SELECT key, unnest(range(64))::INT AS dim, round(unnest(coalesce(value::DOUBLE[], list_transform(range(64), lambda x: 0.5::DOUBLE))), 6) AS v FROM ids LEFT JOIN emb USING (key)""")
def B8_embedding_lookup(t: Tables) -> DataFrame:
    ids = t.lineitem.select(F.col("l_partkey").alias("key")).distinct()
    return X.cells(P.embedding_lookup(ids, X.embedding(t), X.DIM, 0.5), "key")


@query(f"""
WITH c AS (SELECT l_orderkey AS row_id, l_quantity AS w, unnest(range(64))::INT AS dim, unnest(coalesce(embedding::DOUBLE[], list_transform(range(64), lambda x: 0::DOUBLE))) AS v
           FROM lineitem LEFT JOIN embeddings ON vec_id = l_partkey % 600)
SELECT row_id, string_agg(v, ',' ORDER BY dim) AS value
FROM (SELECT row_id, dim, round((sum(w * v) / sum(w) + {X.NUDGE}::DOUBLE) * 100000)::BIGINT AS v FROM c GROUP BY 1, 2) GROUP BY 1""")
def B9_embedding_lookup_sparse(t: Tables) -> DataFrame:
    found = P.embedding_lookup_sparse(X.bags(t), X.embedding(t), X.DIM)
    return found.select("row_id", F.array_join(F.transform("value", lambda x: F.round((x + X.NUDGE) * 100_000).cast("long").cast("string")), ",").alias("value"))


@query("""
WITH v AS (SELECT p_partkey, list_concat([p_size::DOUBLE, p_retailprice], coalesce(embedding::DOUBLE[], list_transform(range(64), lambda x: 0::DOUBLE))) AS input
           FROM part LEFT JOIN embeddings ON vec_id = p_partkey)
SELECT p_partkey, len(input) AS width, round(list_sum(input), 4) AS total FROM v""")
def B10_input_layer(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_partkey").alias("key"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("numbers"))
    found = P.input_layer(P.embedding_lookup(rows, X.embedding(t), X.DIM), ["numbers", "value"])
    return found.select("p_partkey", F.size("input").cast("long").alias("width"), F.round(P.linear_term(F.col("input")), 4).alias("total"))


_PAIRS = """p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _pairs(t: Tables) -> DataFrame:
    following = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return t.embeddings.select("vec_id", F.col("embedding").alias("x")).join(following, "vec_id")


@query(f"""WITH {_PAIRS}, c AS (SELECT vec_id, unnest(range(64))::INT AS dim, unnest(x) AS x, unnest(y) AS y FROM p)
SELECT vec_id, dim, round(0.5 * ((x + y) * (x + y) - x * x - y * y) + {X.NUDGE}::DOUBLE, 5) + 0::DOUBLE AS v FROM c""")
def B11_fm_second_order(t: Tables) -> DataFrame:
    found = _pairs(t).select("vec_id", P.fm_second_order([F.col("x"), F.col("y")]).alias("value"))
    return X.cells(found, "vec_id", digits=5)


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def B12_linear_term(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(P.linear_term(F.col("embedding")), 4).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 30)")
def B13_counter_filter(t: Tables) -> DataFrame:
    return P.counter_filter(t.lineitem.select(*KEYS, "l_partkey"), 30, "l_partkey").select(*KEYS, "l_partkey")


_BLOOM = f"""
WITH n AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1),
z AS (SELECT ceil(-count(*) * ln(0.01::DOUBLE) / (ln(2::DOUBLE) * ln(2::DOUBLE)))::BIGINT AS m FROM n),
s AS (SELECT DISTINCT id, n, {X.HASH.format("i || ':' || id")} % m AS pos FROM n, z, range(7) AS r(i)),
c AS (SELECT pos, sum(n) AS cell FROM s GROUP BY 1)
SELECT id, min(cell)::BIGINT AS estimate FROM s JOIN c USING (pos) GROUP BY id HAVING min(cell) >= 32"""


@query(_BLOOM)
def B14_bloom_counter_filter(t: Tables) -> DataFrame:
    return P.bloom_counter_filter(t.lineitem.select(F.col("l_partkey").alias("id")), 32)


@query(_BLOOM)
def B14_merged_counters(t: Tables) -> DataFrame:
    """The same from the counters of four batches, merged."""
    ids = t.lineitem.select("l_linenumber", F.col("l_partkey").alias("id"))
    m, k = P.bloom_sizes(ids.select("id").distinct().count(), 0.01)
    cells = None
    for i in range(4):
        batch = P.batch_cells(ids.where(f"l_linenumber % 4 = {i}"), m, k)
        cells = batch if cells is None else P.merged_cells(cells, batch)
    return P.estimated(ids, cells, m, k, 32)


@query(f"WITH {X.EMB_SQL} SELECT key, version, freq FROM emb WHERE 6000 - version <= 4000")
def B15_evict_by_step(t: Tables) -> DataFrame:
    return P.evict_by_step(X.embedding(t), 6000).select("key", "version", "freq")


@query(f"WITH {X.EMB_SQL}, n AS (SELECT key, version, sqrt(list_sum(list_transform(value::DOUBLE[], lambda x: x * x))) AS norm FROM emb) SELECT key, version, round(norm, 5) AS norm FROM n WHERE norm >= 1.0")
def B16_evict_by_l2(t: Tables) -> DataFrame:
    return P.evict_by_l2(X.embedding(t)).select("key", "version", F.round(P.l2_norm(F.col("value")), 5).alias("norm"))


@query("""SELECT s_suppkey, 4 AS fixed, greatest(1, least(16, s_suppkey * 50, floor(s_suppkey * 50 * (s_nationkey + 1) * 4 / 4096)::BIGINT)) AS parts FROM supplier""")
def B17_partitions(t: Tables) -> DataFrame:
    rows, width = F.col("s_suppkey") * 50, (F.col("s_nationkey") + 1) * 4
    return t.supplier.select("s_suppkey", P.partitions_fixed(4).alias("fixed"), P.partitions_min_max(rows, width, 16, 4096).alias("parts"))


@query(f"WITH {X.SCORES_SQL} SELECT round(avg((round(prob) = label)::INT::DOUBLE), 6) AS accuracy FROM scores")
def B18_accuracy(t: Tables) -> DataFrame:
    return E.accuracy(X.scores(t), "label", "prob").select(F.round("accuracy", 6).alias("accuracy"))


@query(f"""
WITH {X.SCORES_SQL}, c AS (SELECT least(floor(prob * 1000), 999) AS cell, label FROM scores)
SELECT round(sum(CASE WHEN p.cell > n.cell THEN 1 WHEN p.cell = n.cell THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS auc
FROM (SELECT cell FROM c WHERE label = 1) p, (SELECT cell FROM c WHERE label = 0) n""")
def B19_auc(t: Tables) -> DataFrame:
    return E.auc(X.scores(t), "label", "prob").select(F.round(F.col("auc").cast("double"), 6).alias("auc"))


@query(f"WITH {X.SCORES_SQL} SELECT round(avg((label - prob) * (label - prob)), 6) AS mse FROM scores")
def B20_mse(t: Tables) -> DataFrame:
    return E.mse(X.scores(t), "label", "prob").select(F.round("mse", 6).alias("mse"))


@query("""
WITH x AS (SELECT unnest(['l_discount', 'l_tax']) AS "column", unnest([l_discount, l_tax]) AS x FROM lineitem),
b AS (SELECT "column", least(greatest(floor((x - 0) / (0.1::DOUBLE - 0) * 10), 0), 9)::BIGINT AS bin, x FROM x)
SELECT "column", bin, count(*) AS n, round(avg(sum((x = 0)::INT)::DOUBLE) OVER w * count(*) OVER w / sum(count(*)) OVER w, 6) AS zero_fraction
FROM b GROUP BY "column", bin WINDOW w AS (PARTITION BY "column")""")
def B21_activation_summary(t: Tables) -> DataFrame:
    return E.activation_summary(t.lineitem, ["l_discount", "l_tax"], 10, 0.0, 0.1).withColumn("zero_fraction", F.round("zero_fraction", 6))
