"""The registered queries and, for each, SQL that gives the same rows.

The event table stands for an operation log: key user_id, order (ts, event_id),
tombstone event_type = 'error'; segments are runs of 100 event ids; event_id % 3 names
one of three sources in precedence order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keylode.functions import keys
from keylode.operators import log, scan
from keylode.plans.latest import latest, merged, refreshed, replayed
from keylode.runtime import ship
from keylode.streaming.latest import stream_latest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """The events as log rows."""
    return _read(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
        (F.col("event_type") == "error").alias("tombstone"),
        F.floor(F.col("event_id") / 100).cast("int").alias("seg"),
        F.col("event_id").alias("seq"),
    )


_LOG = """
with l as (
    select cast(user_id as varchar) as key, props as value, event_type = 'error' as tombstone, cast(event_id // 100 as int) as seg, event_id as seq,
        21 + octet_length(encode(cast(user_id as varchar))) + octet_length(encode(props)) as size
    from events
),
d as (select *, seq = max(seq) over (partition by key) as last from l)
"""


@query("""
select user_id, event_id, event_type, value from (
    select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events
) where rn = 1 and event_type <> 'error'
""")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return latest(rows, "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"], F.col("event_type") == "error")


def _source(spark: SparkSession, sf: str, *which: int) -> list[DataFrame]:
    rows = _read(spark, sf, "events").select("user_id", (F.col("event_id") % 3).cast("int").alias("file_idx"), F.col("event_id").alias("src_off"), "value")
    return [rows.where(F.col("file_idx") == i) for i in which]


_MERGED = """
select user_id, file_idx, src_off, value from (
    select user_id, cast(event_id % 3 as int) as file_idx, event_id as src_off, value,
        row_number() over (partition by user_id order by event_id % 3 desc, event_id desc) as rn from events
) where rn = 1
"""


@query(_MERGED)
def precedence_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merged(_source(spark, sf, 0, 1, 2), "user_id", ["file_idx", "src_off"])


@query(_MERGED)
def incremental_refresh(spark: SparkSession, sf: str) -> DataFrame:
    existing = merged(_source(spark, sf, 0, 1), "user_id", ["file_idx", "src_off"])
    return refreshed(existing, _source(spark, sf, 2)[0], "user_id", ["file_idx", "src_off"])


@query("""
select user_id, event_id, value from (
    select *, row_number() over (partition by user_id order by event_id desc) as rn from events
) where rn = 1 and event_type <> 'error'
""")
def snapshot_tail_replay(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    dead = F.col("event_type") == "error"
    checkpoint = latest(rows.where("event_id < 3000"), "user_id", ["event_id"], tombstone=dead)
    return replayed(checkpoint, rows.where("event_id >= 3000"), "user_id", ["event_id"], dead).drop("event_type")


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 42")
def point_get(spark: SparkSession, sf: str) -> DataFrame:
    return scan.get(_read(spark, sf, "orders"), "o_orderkey", 42).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49)")
def multi_get(spark: SparkSession, sf: str) -> DataFrame:
    probes = _read(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return scan.multi_get(_read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), probes, "o_orderkey")


@query("select k as o_orderkey, k in (select o_orderkey from orders) as found from (select unnest([1, 42, -5, 1000000007]::bigint[]) as k)")
def has_flags(spark: SparkSession, sf: str) -> DataFrame:
    probes = spark.createDataFrame([(1,), (42,), (-5,), (1000000007,)], "o_orderkey long")
    return scan.has(_read(spark, sf, "orders"), probes, "o_orderkey").select("o_orderkey", "found")


@query("select o_orderkey * 2 as o_orderkey from orders where o_orderkey * 2 not in (select o_orderkey from orders)")
def absent_keys(spark: SparkSession, sf: str) -> DataFrame:
    orders = _read(spark, sf, "orders")
    return scan.absent(orders, orders.select((F.col("o_orderkey") * 2).alias("o_orderkey")), "o_orderkey")


@query("select c_custkey, c_name from customer where c_custkey not in (select s_suppkey from supplier)")
def session_hidden_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return scan.hidden(_read(spark, sf, "customer").select("c_custkey", "c_name"), gone, "c_custkey")


@query("select c_name, row_number() over (order by c_name desc) as pos from customer where starts_with(c_name, 'Customer#00000001')")
def prefix_sorted_desc(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan.scan(_read(spark, sf, "customer").select("c_name"), "c_name", "Customer#00000001")
    return scan.positions(rows, "c_name", reverse=True)


@query("select event_id, props, row_number() over (order by event_id) as pos from events where contains(props, '\"k\": 1')")
def filter_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan.filter_all(_read(spark, sf, "events").select("event_id", "props"), F.col("props").contains('"k": 1'))
    return scan.positions(rows, "event_id")


@query("select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) as pos from orders order by o_orderkey limit 10")
def sorted_first_n(spark: SparkSession, sf: str) -> DataFrame:
    first = _read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)
    return first.withColumn("pos", F.row_number().over(Window.orderBy("o_orderkey")).cast("long"))


@query("select c_custkey, pos from (select c_custkey, row_number() over (order by c_custkey) as pos from customer) where (pos - 1) % 64 = 0")
def sparse_sample(spark: SparkSession, sf: str) -> DataFrame:
    return scan.sparse_sample(_read(spark, sf, "customer").select("c_custkey"), "c_custkey", 64)


@query("""
with k as (select c_custkey as key from customer where c_custkey % 64 = 0)
select c_custkey, (select max(key) from k where key <= c_custkey) as floor from customer
""")
def sparse_floor(spark: SparkSession, sf: str) -> DataFrame:
    customer = _read(spark, sf, "customer").select("c_custkey")
    return scan.floor_keys(customer, customer.where("c_custkey % 64 = 0").withColumnRenamed("c_custkey", "key"), "c_custkey", "key")


@query("""
select chunk, count(*) as entries, min(o_orderkey) as first_key, max(o_orderkey) as last_key
from (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 1000 as chunk from orders) group by 1
""")
def run_chunks(spark: SparkSession, sf: str) -> DataFrame:
    placed = scan.positions(_read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    chunk = F.floor((F.col("pos") - 1) / 1000).alias("chunk")
    return placed.groupBy(chunk).agg(F.count("*").alias("entries"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query(_LOG + """
select seg, count(*) as records, cast(sum(size) as bigint) as bytes, cast(coalesce(sum(size) filter (where not last or tombstone), 0) as bigint) as dead_bytes
from d group by 1
""")
def segment_dead_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return log.segment_stats(_log(spark, sf))


_CHOSEN = """
, s as (
    select seg, count(*) as records, cast(sum(size) as bigint) as bytes, cast(coalesce(sum(size) filter (where not last or tombstone), 0) as bigint) as dead_bytes
    from d group by 1
),
c as (select * from s where seg < (select max(seg) from l) and cast(dead_bytes as double) / cast(bytes as double) >= 0.5)
"""


@query(_LOG + _CHOSEN + "select * from c")
def compaction_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return log.compaction_candidates(_log(spark, sf))


@query(_LOG + _CHOSEN + "select key, value, tombstone, seg, seq from d where last or seg not in (select seg from c)")
def compacted_log(spark: SparkSession, sf: str) -> DataFrame:
    return log.compacted(_log(spark, sf))


@query("""
with b as (select event_id // 100 as seg, min(event_id) as bad from events where event_id % 997 = 0 group by 1)
select cast(event_id // 100 as int) as seg, count(*) as records, max(event_id) as last_seq
from events left join b on event_id // 100 = seg where bad is null or event_id < bad group by 1
""")
def torn_segment_truncation(spark: SparkSession, sf: str) -> DataFrame:
    whole = log.intact(_log(spark, sf), F.col("seq") % 997 == 0)
    return whole.groupBy("seg").agg(F.count("*").alias("records"), F.max("seq").alias("last_seq"))


@query("""
with r as (select c_custkey as pos, c_nationkey as size from customer where c_custkey % 7 <> 0),
n as (select c_custkey as pos, c_nationkey + case when c_custkey % 11 = 0 then 1 else 0 end as size from customer where c_custkey % 5 <> 0)
select coalesce(r.pos, n.pos) as pos, case when r.pos is null then 'added' when n.pos is null then 'removed' when r.size <> n.size then 'changed' else 'same' end as change
from r full join n on r.pos = n.pos
""")
def source_change_class(spark: SparkSession, sf: str) -> DataFrame:
    customer = _read(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_nationkey").alias("size"))
    recorded = customer.where("pos % 7 <> 0").withColumnRenamed("size", "was")
    current = customer.where("pos % 5 <> 0").withColumn("size", F.col("size") + F.when(F.col("pos") % 11 == 0, 1).otherwise(0))
    change = F.when(F.col("was").isNull(), "added").when(F.col("size").isNull(), "removed").when(F.col("was") != F.col("size"), "changed").otherwise("same")
    return recorded.join(current, "pos", "full_outer").select("pos", change.alias("change"))


@query("select cast(c_custkey as varchar) as key, c_name as name, c_acctbal as balance from customer")
def bucket_typed_scan(spark: SparkSession, sf: str) -> DataFrame:
    customer, supplier = _read(spark, sf, "customer"), _read(spark, sf, "supplier")
    record = lambda prefix, k, n, b: (F.concat(F.lit(prefix), F.col(k).cast("string")).alias("key"), F.to_json(F.struct(F.col(n).alias("name"), F.col(b).alias("balance"))).alias("value"))
    store = customer.select(*record("users:", "c_custkey", "c_name", "c_acctbal")).union(supplier.select(*record("suppliers:", "s_suppkey", "s_name", "s_acctbal")))
    codec = keys.JsonCodec(T.StructType().add("name", "string").add("balance", "double"))
    rows = scan.scan(store, "key", "users:").select(F.substring("key", len("users:") + 1, 2**31 - 1).alias("key"), codec.decode(F.col("value")).alias("value"))
    return rows.select("key", "value.name", "value.balance")


@query("""
select key, count(*) as buckets from (
    select 'n' || n_nationkey as key from nation union all select 'n1' || r_regionkey from region
) group by 1 having count(*) > 1
""")
def bucket_collision(spark: SparkSession, sf: str) -> DataFrame:
    a = _read(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"))
    b = _read(spark, sf, "region").select(F.concat(F.lit("n1"), F.col("r_regionkey").cast("string")).alias("key"))
    return a.union(b).groupBy("key").agg(F.count("*").alias("buckets")).where("buckets > 1")


@query("select c_custkey, '{\"id\":\"' || c_name || '\",\"value\":' || c_custkey || '}' as line from customer")
def line_codec_build(spark: SparkSession, sf: str) -> DataFrame:
    line = keys.JsonLineCodec().build(F.col("c_name"), F.col("c_custkey")).alias("line")
    return _read(spark, sf, "customer").select("c_custkey", line)


@query("select count(distinct c_custkey) as n, cast(greatest(ceil(-count(distinct c_custkey) * ln(0.01) / (ln(2) * ln(2))), 8) as bigint) as bits from customer")
def bloom_sizing(spark: SparkSession, sf: str) -> DataFrame:
    return log.bloom_sizing(_read(spark, sf, "customer"), "c_custkey", 0.01)


@query(_LOG + "select count(*) as live from d where last and not tombstone")
def live_key_count(spark: SparkSession, sf: str) -> DataFrame:
    return latest(_log(spark, sf), "key", ["seq"], [], F.col("tombstone")).agg(F.count("*").alias("live"))


@query(_LOG + """
select count(*) filter (where last and not tombstone) as keys, count(distinct seg) as segments,
    cast(coalesce(sum(size) filter (where not last or tombstone), 0) as bigint) as dead_bytes from d
""")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return log.store_stats(_log(spark, sf))


#: Ways to write a line, by c_custkey % 8; %s is the name.
_LINES = ('{"id":"%s"}', '{"v":1,"id":"%s"}', '{"id":42,"v":"%s"}', '{"id":"%s"', '{"outer":{"id":"%s"}}', '{"id":"%s","id":"later"}', '{"id":"%s"} trailing', '{"id": "%s", "value": {"b": 1.50,  "a":2}}')


def _written(spark: SparkSession, sf: str) -> DataFrame:
    ways = F.array(*map(F.lit, _LINES))
    return _read(spark, sf, "customer").select("c_custkey", F.replace(F.get(ways, (F.col("c_custkey") % 8).cast("int")), F.lit("%s"), F.col("c_name")).alias("line"))


@query("select c_custkey, c_name as id from customer where c_custkey % 8 in (0, 1, 5, 7)")
def json_key_extract(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    found = _written(spark, sf).withColumn("id", keys.json_string_key("id")("line").cast("string"))
    return found.where("id is not null").select("c_custkey", "id")


@query("""
select c_custkey, case c_custkey % 8 when 2 then '42' when 5 then '"later"' else '"' || c_name || '"' end as id,
    case c_custkey % 8 when 7 then '{"b": 1.50,  "a":2}' end as value
from customer where c_custkey % 8 in (0, 1, 2, 5, 7)
""")
def json_raw_value(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    rows = _written(spark, sf)
    return rows.select("c_custkey", keys.json_raw_field("id")("line").alias("id"), keys.json_raw_field("value")("line").alias("value")).where("id is not null")


#: Records whose value changed after its checksum was stored cut their segment.
@query("""
with b as (select event_id // 100 as seg, min(event_id) as bad from events where event_id % 499 = 0 group by 1)
select cast(event_id // 100 as int) as seg, count(*) as records, max(event_id) as last_seq
from events left join b on event_id // 100 = seg where bad is null or event_id < bad group by 1
""")
def crc_integrity(spark: SparkSession, sf: str) -> DataFrame:
    stored = _log(spark, sf).withColumn("ts_ns", F.col("seq")).withColumn("crc", log.record_crc())
    damaged = stored.withColumn("value", F.when(F.col("seq") % 499 == 0, F.concat("value", F.lit(" "))).otherwise(F.col("value")))
    whole = log.intact(damaged, ~log.sound())
    return whole.groupBy("seg").agg(F.count("*").alias("records"), F.max("seq").alias("last_seq"))


@query("""
select user_id, event_id, value from (
    select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events
) where rn = 1
""")
def stream_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    import tempfile
    import uuid

    path = f"{sf}/events.parquet"
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
    shared = shared or "file://" + tempfile.mkdtemp(prefix="keylode-")
    out = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    # a pattern, as a stream of a path that is one file isn't accepted
    last = stream_latest(spark, spark.read.parquet(path).schema, f"{path[:-1]}[{path[-1]}]", "user_id", ["ts", "event_id"], ["event_id", "value"], out)
    return spark.read.parquet(last)
