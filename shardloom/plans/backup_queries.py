"""Queries of checkpoint copies (E) and scalar functions (F)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import backup as B
from ..sources.versions import Versions, upsert_newest
from . import fixtures as X
from .registry import Tables, query

REPLICAS = 2
_PLACES = f"""shards AS (SELECT DISTINCT o_custkey % 8 AS shard FROM orders), places AS (SELECT shard, i::INT AS copy, (shard + i + 1) % 8 AS holder FROM shards, range({REPLICAS}) r(i))"""


def _prefix(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.concat(F.lit("model.ckpt-"), F.col("o_orderkey").cast("string")).alias("prefix"), (F.col("o_custkey") % 8).alias("shard"))


def places(t: Tables) -> DataFrame:
    return B.replica_placement(X.shards(t), REPLICAS)


@query("SELECT o_orderkey, o_orderkey || ':' || lpad((o_custkey % 8)::VARCHAR, 5, '0') || '-00008' AS key FROM orders")
def E1_ckpt_key(t: Tables) -> DataFrame:
    return _prefix(t).select("o_orderkey", B.ckpt_key(F.col("prefix"), F.col("shard"), F.lit(8)).alias("key"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey END AS step, CASE WHEN o_orderkey % 10 > 0 THEN (o_custkey % 8)::INT END AS shard, CASE WHEN o_orderkey % 10 > 0 THEN 8 END AS num_shards, (o_custkey % 8)::INT AS own_shard FROM orders""")
def E2_parse_ckpt_key(t: Tables) -> DataFrame:
    key = B.ckpt_key(F.col("prefix"), F.col("shard"), F.lit(8))
    rows = _prefix(t).select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("x"), key)).otherwise(key).alias("key"), F.substring_index(key, ":", -1).alias("tail"))
    return rows.select("o_orderkey", B.parse_ckpt_key(F.col("key")).alias("k"), B.parse_shard_key(F.col("tail")).alias("s")).select("o_orderkey", "k.step", "k.shard", "k.num_shards", F.col("s.shard").alias("own_shard"))


@query("""SELECT o_orderkey, p || '.index' AS index_file, p || '.index-' || s || '-of-00008' AS shard_index_file, p || '.data-' || s || '-of-00008' AS data_file, 'model.ckpt' AS base
FROM (SELECT o_orderkey, 'model.ckpt-' || o_orderkey AS p, lpad((o_custkey % 8)::VARCHAR, 5, '0') AS s FROM orders)""")
def E3_ckpt_filenames(t: Tables) -> DataFrame:
    return _prefix(t).select("o_orderkey", B.ckpt_filenames(F.col("prefix"), F.col("shard"), F.lit(8)).alias("f")).select("o_orderkey", "f.*")


@query(f"WITH {_PLACES} SELECT shard, copy, holder FROM places")
def E4_replica_placement(t: Tables) -> DataFrame:
    return places(t)


@query(f"WITH {X.WRITES_SQL} SELECT holder, shard, step, n_bytes FROM cache")
def E5_latest_cache(t: Tables) -> DataFrame:
    return B.latest_cache(X.ckpt_writes(t))


@query(f"WITH {X.WRITES_SQL} SELECT holder, shard, step, n_bytes FROM cache")
def E5_latest_cache_upserts(t: Tables) -> DataFrame:
    """The same as a table in versions, into which the writes come in four batches, out of order."""
    store = Versions(t.spark, t.scratch("cache"))
    for i in (2, 0, 3, 1):
        upsert_newest(store, X.ckpt_writes(t).where(f"step % 4 = {i}"), ("holder", "shard"), ("arrival", "step"), 4)
    return store.read(store.live()).select("holder", "shard", "step", "n_bytes")


def _wanted(t: Tables) -> DataFrame:
    """The last version in each holder's cache, and some that aren't there."""
    return t.orders.select((F.col("o_custkey") % 8).alias("shard"), (F.col("o_orderkey") % 1000).alias("step")).distinct()


_WANTED = "wanted AS (SELECT DISTINCT o_custkey % 8 AS shard, o_orderkey % 1000 AS step FROM orders)"


@query(f"WITH {X.WRITES_SQL}, {_WANTED} SELECT w.shard AS holder, w.shard, w.step, c.step IS NOT NULL AS found FROM wanted w LEFT JOIN cache c ON c.holder = w.shard AND c.shard = w.shard AND c.step = w.step")
def E6_cache_lookup(t: Tables) -> DataFrame:
    return B.cache_lookup(B.latest_cache(X.ckpt_writes(t)), _wanted(t).withColumn("holder", F.col("shard"))).select("holder", "shard", "step", "found")


@query(f"""WITH {X.WRITES_SQL}, {_WANTED}, {_PLACES},
o AS (SELECT shard, step, -1 AS rank, shard AS holder FROM wanted UNION ALL SELECT shard, step, copy, holder FROM wanted JOIN places USING (shard)),
h AS (SELECT shard, step, min(rank) AS rank, arg_min(holder, rank) AS holder FROM o JOIN cache USING (holder, shard, step) GROUP BY 1, 2)
SELECT shard, step, CASE WHEN rank IS NULL THEN 'file' WHEN rank < 0 THEN 'local' ELSE 'replica ' || (rank + 1) END AS source, holder FROM wanted LEFT JOIN h USING (shard, step)""")
def E7_resolve_restore(t: Tables) -> DataFrame:
    return B.resolve_restore(_wanted(t), B.latest_cache(X.ckpt_writes(t)), places(t))


@query(f"WITH {X.WRITES_SQL}, {_PLACES} SELECT shard AS source, p.holder, count(*) AS n_sends, sum(n_bytes)::BIGINT AS n_bytes FROM writes JOIN places p USING (shard) GROUP BY 1, 2")
def E8_backup_plan(t: Tables) -> DataFrame:
    return B.backup_plan(X.ckpt_writes(t), places(t))


@query(f"""WITH {X.WRITES_SQL}, l AS (SELECT shard, count(*) AS n FROM cache WHERE holder NOT IN (2, 3) GROUP BY 1)
SELECT shard, coalesce(n, 0) AS copies_left, n IS NOT NULL AS recoverable FROM (SELECT DISTINCT o_custkey % 8 AS shard FROM orders) LEFT JOIN l USING (shard)""")
def E9_recoverable(t: Tables) -> DataFrame:
    failed = X.shards(t).where("shard in (2, 3)").select(F.col("shard").alias("holder"))
    return B.recoverable(B.latest_cache(X.ckpt_writes(t)), X.shards(t), failed)


@query("""WITH r AS (SELECT user_id AS buffer, ts, (event_type = 'purchase')::INT AS is_take, event_id AS id FROM events WHERE event_type IN ('view', 'purchase')),
n AS (SELECT *, coalesce(sum(is_take) OVER (PARTITION BY buffer ORDER BY ts, is_take, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM r),
g AS (SELECT buffer, nth, max(id) FILTER (is_take = 1) AS take_id, arg_max(id, (ts, id)) FILTER (is_take = 0) AS put_id, count(*) FILTER (is_take = 0) AS puts FROM n GROUP BY 1, 2)
SELECT buffer, take_id, put_id, greatest(puts - 1, 0) AS overwritten FROM g WHERE take_id IS NOT NULL""")
def E10_conflate(t: Tables) -> DataFrame:
    puts = t.events.where("event_type = 'view'").select(F.col("user_id").alias("buffer"), "ts", F.col("event_id").alias("put_id"))
    takes = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("buffer"), "ts", F.col("event_id").alias("take_id"))
    return B.conflate(puts, takes)


@query(f"WITH {X.WRITES_SQL} SELECT holder, shard, step, arrival FROM writes QUALIFY row_number() OVER (PARTITION BY holder, shard ORDER BY arrival DESC, step DESC) > 1")
def E11_superseded_files(t: Tables) -> DataFrame:
    return B.superseded_files(X.ckpt_writes(t))


def _blobs(t: Tables) -> DataFrame:
    return t.pages.select(F.col("page_id").alias("id"), F.col("html").cast("binary").alias("blob"))


@query("SELECT page_id AS id, (greatest(ceil(strlen(html) / 512), 1))::BIGINT AS chunks, strlen(html) AS n_bytes FROM pages")
def E12_chunk_blobs(t: Tables) -> DataFrame:
    return B.chunk_blobs(_blobs(t), 512).groupBy("id").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("chunk")).alias("n_bytes"))


@query("SELECT page_id AS id, strlen(html) AS n_bytes, md5(html) AS blob_md5 FROM pages")
def E12_assemble_blobs(t: Tables) -> DataFrame:
    found = B.assemble_blobs(B.chunk_blobs(_blobs(t), 512))
    return found.select("id", F.octet_length("blob").cast("long").alias("n_bytes"), F.md5("blob").alias("blob_md5"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::BIGINT * 1073741824 WHEN 1 THEN p_size::BIGINT * 1048576 ELSE -1 END::BIGINT AS n_bytes FROM part")
def F1_parse_memory(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(F.lit("Gi"), F.lit("Mi"), F.lit("G"), F.lit("Gib")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", C.parse_memory(F.concat(F.col("p_size").cast("string"), unit)).alias("n_bytes"))


@query("""SELECT p_partkey, p_type GLOB '*E*' AS a, p_brand GLOB 'Brand#[1-3]?' AS b, p_brand GLOB '*[!12]' AS c, p_name GLOB 'a.*' AS d FROM part""")
def F2_glob_to_regex(t: Tables) -> DataFrame:
    tests = {"a": ("p_type", "*E*"), "b": ("p_brand", "Brand#[1-3]?"), "c": ("p_brand", "*[!12]"), "d": ("p_name", "a.*")}
    return t.part.select("p_partkey", *(F.regexp_like(col, C.glob_to_regex(F.lit(glob))).alias(name) for name, (col, glob) in tests.items()))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def F3_iso_utc(t: Tables) -> DataFrame:
    return t.events.select("event_id", C.iso_utc(F.col("ts")).alias("iso"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS sec FROM events")
def F4_epoch_seconds(t: Tables) -> DataFrame:
    return t.events.select("event_id", C.epoch_seconds(F.col("ts")).alias("sec"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS local FROM events")
def F5_utc_to_local(t: Tables) -> DataFrame:
    return t.events.select("event_id", C.utc_to_local(F.col("ts"), "Asia/Shanghai").alias("local"))


@query("""SELECT o_orderkey, to_base64(('{"config_name":"' || o_orderpriority || '","slice_index":' || o_custkey || '}')::BLOB) AS state, o_custkey AS slice_index FROM orders""")
def F6_base64_state(t: Tables) -> DataFrame:
    state = C.base64_state(F.col("o_orderpriority").alias("config_name"), F.col("o_custkey").alias("slice_index"))
    rows = t.orders.select("o_orderkey", state.alias("state"))
    return rows.select("o_orderkey", "state", C.unbase64_state(F.col("state"), "config_name string, slice_index long")["slice_index"].alias("slice_index"))
