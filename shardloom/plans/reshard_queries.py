"""Queries of embedding and dense tables (C)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import capacity, gradients
from ..operators import features as P
from ..operators import reshard as R
from ..sources.versions import Versions
from . import fixtures as X
from .registry import Tables, query


@query("SELECT vec_id, (vec_id % 5)::INT AS shard FROM embeddings")
def C1_shard_mod(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", R.shard_mod(F.col("vec_id"), 5).alias("shard"))


@query("WITH n AS (SELECT max(o_orderkey) + 1 AS n FROM orders) SELECT o_orderkey, greatest(o_orderkey // (n // 7 + 1), (o_orderkey - n % 7) // (n // 7))::INT AS shard FROM orders, n")
def C2_shard_div(t: Tables) -> DataFrame:
    num_ids = (t.orders.agg(F.max("o_orderkey")).first()[0] or 0) + 1
    return t.orders.select("o_orderkey", R.shard_div(F.col("o_orderkey"), num_ids, 7).alias("shard"))


@query(f"WITH {X.EMB_SQL} SELECT key, part, (key % 5)::INT AS to_part, version, freq, round(list_sum(value::DOUBLE[]), 4) AS total FROM emb WHERE part <> key % 5")
def C3_reshard_export(t: Tables) -> DataFrame:
    return R.reshard_export(X.embedding(t), 5).select("key", "part", "to_part", "version", "freq", F.round(P.linear_term(F.col("value")), 4).alias("total"))


@query(f"WITH {X.EMB_SQL} SELECT key, (key % 5)::INT AS part, version, freq FROM emb")
def C4_reshard_import(t: Tables) -> DataFrame:
    table = X.embedding(t)
    moved = R.reshard_export(table, 5)
    return R.reshard_import(R.reshard_import(table, moved), moved).select("key", "part", "version", "freq")


@query(f"WITH {X.EMB_SQL} SELECT key, (key % 5)::INT AS part, unnest(range(64))::INT AS dim, round(unnest(value)::DOUBLE, 6) AS v FROM emb")
def C5_reshard(t: Tables) -> DataFrame:
    return X.cells(R.reshard(X.embedding(t), 5), "key", "part")


@query(f"""
WITH {X.EMB_SQL}, m AS (SELECT key, part, (key % 5)::INT AS to_part FROM emb WHERE part <> key % 5)
SELECT s.slot, key, to_part FROM m, (VALUES ('primary'), ('adagrad'), ('momentum')) s(slot) WHERE slot <> 'momentum' OR key % 2 = 0""")
def C6_reshard_with_slots(t: Tables) -> DataFrame:
    table = X.embedding(t)
    slots = {"adagrad": table.select("var", "key", F.col("value").alias("acc")), "momentum": table.where("key % 2 = 0").select("var", "key", "value")}
    moved = R.reshard_with_slots(table, slots, 5)
    if moved[-1][0] != "primary":
        raise AssertionError("the primary moves last")
    parts = [df.select(F.lit(name).alias("slot"), "key", "to_part") for name, df in moved]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""
WITH {X.EMB_SQL}, s AS (SELECT key, (key % 5)::INT AS part, 'primary' AS name FROM emb UNION ALL SELECT key, (key % 5)::INT, 'adagrad' FROM emb UNION ALL SELECT key, (key % 5)::INT, 'momentum' FROM emb WHERE key % 2 = 0)
SELECT name, part, count(*) AS n, min(key) AS least, max(key) AS most, sum(key)::BIGINT AS total FROM s GROUP BY 1, 2""")
def C6_reshard_stored(t: Tables) -> DataFrame:
    """Tables on disk, from three shards to five, slots and primary in one commit."""
    table = X.embedding(t)
    store = Versions(t.spark, t.scratch("stored"))
    slots = {"adagrad": table.select("var", "key", "part", F.col("value").alias("acc")), "momentum": table.where("key % 2 = 0").select("var", "key", "part", "value")}
    R.store_tables(store, table, slots)
    R.reshard_stored(store, 5)
    found = [R.stored_table(store, x).select(F.lit(x).alias("name"), "key", "part") for x in ("primary", *slots)]
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    return rows.groupBy("name", "part").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"), F.sum("key").alias("total"))


@query(f"WITH {X.EMB_SQL} SELECT part, (key % 5)::INT AS to_part, count(*) AS n_rows, sum(len(value) * 4 + 24)::BIGINT AS n_bytes FROM emb WHERE part <> key % 5 GROUP BY 1, 2")
def C7_reshard_plan(t: Tables) -> DataFrame:
    return R.reshard_plan(X.embedding(t), 5)


@query(f"WITH {X.EMB_SQL} SELECT (key % 5)::INT AS part, count(*) AS n_rows FROM emb GROUP BY 1")
def C8_shard_sizes(t: Tables) -> DataFrame:
    return R.shard_sizes(X.embedding(t), 5)


_DENSE = """n AS (SELECT count(*) AS n FROM part),
sizes AS (SELECT p, n // 7 + (p < n % 7)::INT AS len, coalesce(sum(n // 7 + (p < n % 7)::INT) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM n, range(7) r(p)),
d AS (SELECT p_partkey AS row_id, p AS part, off AS part_offset, len::BIGINT AS part_length, p_partkey - off AS local_row, p_retailprice AS price FROM part JOIN sizes ON p_partkey >= off AND p_partkey < off + len)"""


def _split(t: Tables) -> DataFrame:
    return R.dense_split(X.dense(t), t.part.count(), 7)


@query(f"WITH {_DENSE} SELECT row_id, part, part_offset, part_length, local_row FROM d")
def C9_dense_split(t: Tables) -> DataFrame:
    return _split(t).select("row_id", "part", "part_offset", "part_length", "local_row")


@query("SELECT p_partkey AS row_id, p_retailprice AS price FROM part")
def C10_dense_gather(t: Tables) -> DataFrame:
    return R.dense_gather(_split(t).select("part", "local_row", "value")).select("row_id", F.col("value")[1].alias("price"))


@query("WITH n AS (SELECT max(c_custkey) // 4 + 1 AS n FROM customer) SELECT c_custkey, ((c_custkey % 4) * n + c_custkey // 4)::BIGINT AS row_no FROM customer, n")
def C11_dense_mod_layout(t: Tables) -> DataFrame:
    num_rows = ((t.customer.agg(F.max("c_custkey")).first()[0] or 0) // 4 + 1) * 4  # room for the largest id
    return t.customer.select("c_custkey", R.dense_mod_layout(F.col("c_custkey"), num_rows, 4).alias("row_no"))


def _bags(t: Tables) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    return t.lineitem.groupBy(F.col("l_orderkey").alias("row_id")).agg(ids.alias("ids"))


_BAGS = "b AS (SELECT l_orderkey AS row_id, l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS position FROM lineitem)"


@query(f"WITH {_BAGS} SELECT row_id, (id % 4)::INT AS part, string_agg(id, ',' ORDER BY position) AS ids, string_agg(position, ',' ORDER BY position) AS positions FROM b GROUP BY 1, 2")
def C12_dynamic_partition(t: Tables) -> DataFrame:
    return R.dynamic_partition(_bags(t), 4).select("row_id", "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"WITH {_BAGS} SELECT row_id, string_agg(id, ',' ORDER BY position) AS ids FROM b GROUP BY 1")
def C13_dynamic_stitch(t: Tables) -> DataFrame:
    return R.dynamic_stitch(R.dynamic_partition(_bags(t), 4)).select("row_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("""SELECT 'v' || p_partkey AS var, i AS part, sum(len) OVER (PARTITION BY p_partkey ORDER BY i)::BIGINT - len AS start, len AS length
FROM (SELECT p_partkey, i, (p_size * 10 // 6 + (i < p_size * 10 % 6)::INT)::BIGINT AS len FROM part, range(6) r(i))""")
def C14_part_sizes(t: Tables) -> DataFrame:
    return R.part_sizes(t.part.select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("var"), (F.col("p_size") * 10).alias("num_rows")), 6)


_MANIFEST = """c AS (SELECT 'v' || p_partkey AS var, p_partkey, p_size * 10 AS n, i, {n} AS parts, (p_size * 10 // {n} + (i < p_size * 10 % {n})::INT)::BIGINT AS len FROM part, range({n}) r(i)),
m{n} AS (SELECT var, p_partkey, i::BIGINT AS part, parts::INT AS num_parts, n || ' 16 ' || (sum(len) OVER (PARTITION BY var ORDER BY i)::BIGINT - len) || ',' || len || ':0,16' AS shape_and_slice FROM c)"""


def _vars(t: Tables) -> DataFrame:
    return t.part.select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("var"), F.array((F.col("p_size") * 10).cast("long"), F.lit(16).cast("long")).alias("dims"))


@query(f"WITH {_MANIFEST.format(n=3)} SELECT var, part, num_parts, shape_and_slice FROM m3")
def C15_shape_and_slice(t: Tables) -> DataFrame:
    return R.shape_and_slice(_vars(t), 3)


_NAMES = "n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'dnn/w' || p_partkey WHEN 1 THEN 'emb' || p_brand || '/part_' || p_size ELSE 'emb' || p_brand || '/part_' || p_size || '/Adagrad' END AS name FROM part)"


def _names(t: Tables) -> DataFrame:
    key, size, kind = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 3
    part = F.concat(F.lit("emb"), "p_brand", F.lit("/part_"), size)
    return t.part.select("p_partkey", F.when(kind == 0, F.concat(F.lit("dnn/w"), key)).when(kind == 1, part).otherwise(F.concat(part, F.lit("/Adagrad"))).alias("name"))


@query(f"""WITH {_NAMES} SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN name ELSE split_part(name, '/', 1) END AS prefix,
  CASE WHEN p_partkey % 3 > 0 THEN replace(split_part(name, '/', 2), 'part_', '')::INT END AS part, CASE WHEN p_partkey % 3 = 2 THEN 'Adagrad' END AS slot,
  CASE p_partkey % 3 WHEN 0 THEN name || '/Copy_9' WHEN 1 THEN split_part(name, '/', 1) || '/part_9' ELSE split_part(name, '/', 1) || '/part_9/Adagrad' END AS renamed FROM n""")
def C16_parse_var_name(t: Tables) -> DataFrame:
    return _names(t).select("p_partkey", R.parse_var_name(F.col("name")).alias("n"), R.rename_part(F.col("name"), F.lit(9)).alias("renamed")).select("p_partkey", "n.prefix", "n.part", "n.slot", "renamed")


_PARTS = "q AS (SELECT s_nationkey AS var, s_suppkey AS part, CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 6)::INT END AS device FROM supplier)"


def _parts(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("var"), F.col("s_suppkey").alias("part"), F.when(F.col("s_suppkey") % 3 > 0, (F.col("s_suppkey") % 6).cast("int")).alias("device"))


@query(f"""WITH {_PARTS}, m AS (SELECT var, coalesce(max(device), -1) AS top FROM q GROUP BY 1)
SELECT var, part, coalesce(device, (top + row_number() OVER (PARTITION BY var, device IS NULL ORDER BY part)) % 8)::INT AS device FROM q JOIN m USING (var)""")
def C17_place_parts(t: Tables) -> DataFrame:
    return R.place_parts(_parts(t), 8)


@query(f"WITH {_PARTS} SELECT var, part, device, resplit FROM (SELECT *, count(*) OVER (PARTITION BY var) > 4 AS resplit FROM q) WHERE device >= 4")
def C18_parts_to_move(t: Tables) -> DataFrame:
    return R.parts_to_move(_parts(t), 4)


@query("SELECT sum(p_partkey * p_size * CASE p_size % 3 WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 2 END)::BIGINT AS n_bytes, bool_or(p_partkey % 100 = 7) AS has_embedding FROM part")
def C19_model_size(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(F.lit("float"), F.lit("int64"), F.lit("half")), (F.col("p_size") % 3 + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 100 == 7, F.concat("p_brand", F.lit("-keys"))).otherwise(F.col("p_brand"))
    return capacity.model_size(t.part.select(name.alias("name"), F.array(F.col("p_partkey"), F.col("p_size").cast("long")).alias("shape"), kind.alias("dtype")))


@query("SELECT s_suppkey, CASE WHEN s_nationkey > 0 THEN ceil(s_suppkey * 1000000 / 0.6::DOUBLE / (s_nationkey * 10000))::BIGINT ELSE 3 END AS servers FROM supplier")
def C20_required_servers(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", capacity.required_servers(F.col("s_suppkey") * 1_000_000, F.col("s_nationkey") * 10_000, F.lit(3)).alias("servers"))


def _grads(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_partkey") % 500).alias("key"), F.array("l_tax", "l_discount", F.col("l_quantity") / 100).alias("grad"))


_GRADS = "g AS (SELECT l_partkey % 500 AS key, dim, sum(g) AS g FROM (SELECT l_partkey, unnest(range(3))::INT AS dim, unnest([l_tax, l_discount, l_quantity / 100]) AS g FROM lineitem) GROUP BY 1, 2)"


@query(f"WITH {_GRADS} SELECT key, dim, round(g + {X.NUDGE}::DOUBLE, 5) + 0::DOUBLE AS v FROM g")
def C21_combine_gradients(t: Tables) -> DataFrame:
    return X.cells(gradients.combine_gradients(_grads(t), 3), "key", value="grad", digits=5)


@query(f"""WITH {_GRADS}, e AS (SELECT vec_id AS key, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
w AS (SELECT key, d AS dim, g * ((d + 1) / 64::DOUBLE) AS g FROM g JOIN (SELECT unnest(range(64)) AS d) ON d % 3 = dim),
s AS (SELECT key, dim, x, 0.1::DOUBLE + coalesce(g * g, 0) AS acc, g FROM e LEFT JOIN w USING (key, dim))
SELECT key, dim, round(CASE WHEN g IS NULL THEN x ELSE x - 0.1::DOUBLE * g / sqrt(acc) END + {X.NUDGE}::DOUBLE, 5) + 0::DOUBLE AS v FROM s""")
def C22_apply_adagrad(t: Tables) -> DataFrame:
    """Gradients as wide as the table, for the keys that have one; keys without keep their vectors."""
    table = X.embedding(t).select("key", "value")
    slot = table.select("key", F.array_repeat(F.lit(0.1), X.DIM).alias("acc"))
    wide = F.transform(F.sequence(F.lit(0), F.lit(X.DIM - 1)), lambda i: F.get("grad", i % 3) * ((i + 1) / F.lit(float(X.DIM))))
    grads = gradients.combine_gradients(_grads(t), 3).withColumn("grad", wide)
    return X.cells(gradients.apply_adagrad(table, slot, grads, 0.1), "key", digits=5)


@query(f"""WITH {_MANIFEST.format(n=3)}, {_MANIFEST.format(n=5).replace("c AS", "c5 AS").replace("FROM c)", "FROM c5)")}
SELECT var, part, num_parts, shape_and_slice FROM m5 WHERE p_partkey % 4 > 0
UNION ALL SELECT var, part, CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 7 END, shape_and_slice FROM m3 WHERE p_partkey % 4 = 0""")
def C23_resplit_manifest(t: Tables) -> DataFrame:
    key = F.substring("var", 2, 20).cast("long")
    parts = F.when(key % 8 == 0, 1).when(key % 4 == 0, 7).otherwise(3)
    return R.resplit_manifest(R.shape_and_slice(_vars(t), 3).withColumn("num_parts", parts), 3, 5)
