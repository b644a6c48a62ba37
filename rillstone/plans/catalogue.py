"""All registered queries of the core library and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstone.functions import aggregates as A
from rillstone.functions.scalar import haversine_km
from rillstone.operators import matrices, tables
from rillstone.operators.cep import Nfa, match, state
from rillstone.operators.flow import Flow

QUERIES = {}
ORACLE_SQL = {}

ORDERED = "WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events) "


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str, *columns: str) -> Flow:
    """In the order (ts, event_id), with the columns a query needs and no more."""
    keep = list(dict.fromkeys(["event_id", "ts", *columns]))
    return Flow.of(_read(spark, d, "events").select(*keep), ["ts", "event_id"], "ts")


def _by_user(spark: SparkSession, d: str, *columns: str) -> Flow:
    """Events with the order of their user's own stream; users are independent, so nothing is ordered globally."""
    keep = list(dict.fromkeys(["event_id", "ts", "user_id", *columns]))
    return Flow.of(_read(spark, d, "events").select(*keep), ["ts", "event_id"], "ts", part="user_id")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity > 45")
def where_map_lineitem(spark, d):
    return Flow(_read(spark, d, "lineitem")).where("l_quantity > 45").map("l_orderkey", "l_linenumber", revenue="l_extendedprice * (1 - l_discount)").df


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def extract_events_props_json(spark, d):
    return Flow(_read(spark, d, "events").select("event_id", F.col("props").alias("value"))).extract_json("k long").df


@query("SELECT event_id, event_type AS kind, user_id AS uid, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, CAST(NULL AS BIGINT) AS missing FROM events")
def extract_text_fields(spark, d):
    line = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"), F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("value").cast("string")))
    return Flow(_read(spark, d, "events").select(line.alias("value"))).extract("event_id long, kind string, uid long, v double, missing long", "|").df


@query(ORDERED + "SELECT event_id, round(sum(value) OVER (ORDER BY seq ROWS 9 PRECEDING), 3) AS s FROM e")
def sliding_row_sum(spark, d):
    return _events(spark, d, "value").sliding_window("row", 10).aggregate(A.sum_("value", "s")).df.select("event_id", F.round("s", 3).alias("s"))


@query(ORDERED + "SELECT seq, min(value) OVER w AS lo, max(value) OVER w AS hi, first_value(value) OVER w AS oldest, last_value(value) OVER w AS newest FROM e WINDOW w AS (ORDER BY seq ROWS 9 PRECEDING)")
def sliding_row_minmax(spark, d):
    f = _events(spark, d, "value").sliding_window("row", 10).aggregate(A.min_("value", "lo"), A.max_("value", "hi"), A.least_recent("value", "oldest"), A.most_recent("value", "newest"))
    return f.df.select(F.col("_seq").alias("seq"), "lo", "hi", "oldest", "newest")


@query(ORDERED + "SELECT seq, round(quantile_cont(value, 0.5) OVER (ORDER BY seq ROWS 9 PRECEDING), 6) AS med FROM e")
def sliding_row_median(spark, d):
    return _events(spark, d, "value").sliding_window("row", 10).aggregate(A.median("value", "med")).df.select(F.col("_seq").alias("seq"), F.round("med", 6).alias("med"))


@query(ORDERED + "SELECT seq, count(DISTINCT user_id) OVER (ORDER BY seq ROWS 9 PRECEDING) AS n FROM e")
def sliding_row_dcount(spark, d):
    return _events(spark, d, "user_id").sliding_window("row", 10).aggregate(A.dcount("user_id", "n")).df.select(F.col("_seq").alias("seq"), "n")


@query("SELECT user_id, ts, round(avg(value) OVER w, 6) AS a, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW)")
def sliding_range_avg_by_user(spark, d):
    f = _by_user(spark, d, "value").sliding_window("range", 86400).aggregate(A.avg("value", "a"), A.count(name="n"))
    return f.df.select("user_id", "ts", F.round("a", 6).alias("a"), "n")


@query(ORDERED + "SELECT seq, event_type, count(*) OVER (PARTITION BY event_type ORDER BY seq RANGE BETWEEN 99 PRECEDING AND CURRENT ROW) AS n FROM e")
def sliding_row_global_by_key(spark, d):
    f = _events(spark, d, "event_type").key_by("event_type").sliding_window("row", 100).group_by(A.count(name="n"))
    return f.df.select(F.col("_seq").alias("seq"), "event_type", "n")


@query(ORDERED + "SELECT seq, user_id, round(sum(value) OVER w, 3) AS s, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seq)")
def running_group_sum(spark, d):
    f = _events(spark, d, "user_id", "value").key_by("user_id").group_by(A.sum_("value", "s"), A.count(name="n"))
    return f.df.select(F.col("_seq").alias("seq"), "user_id", F.round("s", 3).alias("s"), "n")


@query("SELECT l_returnflag, sum(l_linenumber) AS s, count(*) AS n, round(avg(l_quantity), 6) AS a, CAST(sum(l_linenumber) // count(*) AS BIGINT) AS ia, count(DISTINCT l_suppkey) AS dc, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, median(l_quantity) AS med FROM lineitem GROUP BY l_returnflag")
def group_final_all_aggs(spark, d):
    f = Flow(_read(spark, d, "lineitem")).key_by("l_returnflag")
    f = f.group_by(A.sum_("l_linenumber", "s"), A.count(name="n"), A.avg("l_quantity", "a"), A.int_avg("l_linenumber", "ia"), A.dcount("l_suppkey", "dc"), A.min_("l_extendedprice", "lo"), A.max_("l_extendedprice", "hi"), A.median("l_quantity", "med"), emit="final")
    return f.df.withColumn("a", F.round("a", 6))


@query("SELECT user_id, arg_min(value, (ts, event_id)) AS oldest, arg_max(value, (ts, event_id)) AS newest FROM events GROUP BY user_id")
def group_most_and_least_recent(spark, d):
    df = _read(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return df.groupBy("user_id").agg(A.least_recent("value", "oldest").total("o"), A.most_recent("value", "newest").total("o"))


@query(ORDERED + ", r AS (SELECT seq, count(*) OVER (ORDER BY seq) AS n, max(value) OVER (ORDER BY seq) AS hi FROM e) SELECT seq, n, hi FROM r WHERE n % 50 = 0")
def trigger_every_n(spark, d):
    f = _events(spark, d, "value").aggregate(A.count(name="n"), A.max_("value", "hi"), every=50)
    return f.df.select(F.col("_seq").alias("seq"), "n", "hi")


@query(ORDERED + "SELECT seq, seq // 100 AS win, count(*) OVER w AS n, max(value) OVER w AS hi FROM e WINDOW w AS (PARTITION BY seq // 100 ORDER BY seq)")
def tumbling_row_agg(spark, d):
    f = _events(spark, d, "value").tumbling_window("row", 100).aggregate(A.count(name="n"), A.max_("value", "hi"))
    return f.df.select(F.col("_seq").alias("seq"), F.col("_win").alias("win"), "n", "hi")


@query("SELECT epoch_us(ts) // 86400000000 AS win, count(*) AS n, max(value) AS hi FROM events GROUP BY 1")
def tumbling_epoch_agg(spark, d):
    f = Flow(_read(spark, d, "events"), ts="ts").tumbling_window("range", 86400, align="epoch").aggregate(A.count(name="n"), A.max_("value", "hi"), emit="final")
    return f.df.withColumnRenamed("_win", "win")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
t AS (SELECT event_id, user_id, ts, r, ts AS opened, 0 AS win FROM e WHERE r = 1
  UNION ALL SELECT e.event_id, e.user_id, e.ts, e.r, CASE WHEN t.opened <= e.ts - INTERVAL 1 DAY THEN e.ts ELSE t.opened END, CASE WHEN t.opened <= e.ts - INTERVAL 1 DAY THEN t.win + 1 ELSE t.win END FROM t JOIN e ON e.user_id = t.user_id AND e.r = t.r + 1)
SELECT user_id, CAST(win AS BIGINT) AS win, count(*) AS n FROM t GROUP BY user_id, win""")
def tumbling_anchored_agg(spark, d):
    f = _by_user(spark, d).tumbling_window("range", 86400).aggregate(A.count(name="n"), emit="final")
    return f.df.select("user_id", F.col("_win").alias("win"), "n")


@query(ORDERED + ", g AS (SELECT seq, value, lead(seq, 10) OVER (ORDER BY seq) AS gone FROM e) SELECT seq, value, seq AS at, false AS outdated FROM g UNION ALL SELECT seq, value, gone, true FROM g WHERE gone IS NOT NULL")
def changelog_sliding_row(spark, d):
    f = _events(spark, d, "value").sliding_window("row", 10).changelog()
    return f.df.select(F.col("_seq").alias("seq"), "value", F.col("_at").alias("at"), F.col("_outdated").alias("outdated"))


CHANGES = ", g AS (SELECT seq, event_id, event_type, value, lead(seq, 50) OVER (ORDER BY seq) AS gone FROM e), c AS (SELECT seq, event_id, event_type, value, seq AS at, 1 AS sg FROM g UNION ALL SELECT seq, event_id, event_type, value, gone, -1 FROM g WHERE gone IS NOT NULL) "
AFTER = "SELECT c.at, sg < 0 AS outdated, CAST(sum(sg) OVER w AS BIGINT) AS n, CASE WHEN sum(sg) OVER w > 0 THEN round(sum(sg * value) OVER w, 3) END AS s, CASE WHEN sum(sg) OVER w > 0 THEN CAST(sum(sg * event_id) OVER w // sum(sg) OVER w AS BIGINT) END AS a FROM c WINDOW w AS "


def _after(f: Flow) -> DataFrame:
    return f.aggregate_changes(A.count(name="n"), A.sum_("value", "s"), A.int_avg("event_id", "a")).df.select(F.col("_at").alias("at"), F.col("_outdated").alias("outdated"), F.col("n").cast("long"), F.round("s", 3).alias("s"), "a")


@query(ORDERED + CHANGES + AFTER + "(PARTITION BY event_type ORDER BY c.at, sg, seq ROWS UNBOUNDED PRECEDING)")
def changelog_group_aggregates(spark, d):
    """A group's aggregates after each row that comes into the window of all groups, or goes."""
    return _after(_events(spark, d, "value", "event_type").key_by("event_type").sliding_window("row", 50).changelog())


@query(ORDERED + CHANGES + AFTER + "(ORDER BY c.at, sg, seq ROWS UNBOUNDED PRECEDING)")
def changelog_aggregates(spark, d):
    return _after(_events(spark, d, "value").sliding_window("row", 50).changelog())


@query("SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20")
def join_theta_orders_customer(spark, d):
    left = Flow(_read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), key="o_custkey")
    right = Flow(_read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), key="c_custkey")
    return left.join(right, "l_o_totalprice > r_c_acctbal * 20").df.select(F.col("l_o_orderkey").alias("o_orderkey"), F.col("r_c_custkey").alias("c_custkey"), F.col("r_c_name").alias("c_name"))


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def scale_join_lineitem_supplier(spark, d):
    left = Flow(_read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), key="l_suppkey")
    right = Flow(_read(spark, d, "supplier").select("s_suppkey", "s_name"), key="s_suppkey")
    return left.scale_join(right).df.select(F.col("l_l_orderkey").alias("l_orderkey"), F.col("l_l_linenumber").alias("l_linenumber"), F.col("r_s_name").alias("s_name"))


@query(ORDERED + """, a AS (SELECT seq, user_id, event_id, lead(seq, 100) OVER (ORDER BY seq) AS gone FROM e WHERE event_type = 'click'),
b AS (SELECT seq, user_id, event_id, lead(seq, 100) OVER (ORDER BY seq) AS gone FROM e WHERE event_type = 'purchase')
SELECT a.event_id AS a_id, b.event_id AS b_id FROM a JOIN b ON a.user_id = b.user_id AND (b.gone IS NULL OR a.seq < b.gone) AND (a.gone IS NULL OR b.seq < a.gone)""")
def windowed_join_events(spark, d):
    """Eviction is by rows of the own side, on one arrival order of both."""
    e = _events(spark, d, "user_id", "event_type")
    side = lambda t: e.where(F.col("event_type") == t).key_by("user_id").sliding_window("row", 100)
    return side("click").join(side("purchase")).df.select(F.col("l_event_id").alias("a_id"), F.col("r_event_id").alias("b_id"))


WINDOWED = ORDERED + """, a AS (SELECT seq, user_id, event_id, lead(seq, 100) OVER (ORDER BY seq) AS gone FROM e WHERE event_type = 'click'), b AS (SELECT seq, user_id, event_id FROM e WHERE event_type = 'purchase'),
p AS (SELECT a.event_id AS a_id, b.event_id AS b_id, greatest(a.seq, b.seq) AS moment, a.gone FROM a JOIN b ON a.user_id = b.user_id AND (a.gone IS NULL OR b.seq < a.gone)) """


@query(WINDOWED + "SELECT a_id, b_id, moment, false AS outdated FROM p UNION ALL SELECT a_id, b_id, gone, true FROM p WHERE gone IS NOT NULL")
def windowed_join_changes(spark, d):
    """A window on one side only; a pair is retracted when its windowed row leaves."""
    e = _events(spark, d, "user_id", "event_type")
    left = e.where("event_type = 'click'").key_by("user_id").sliding_window("row", 100)
    out = left.join(e.where("event_type = 'purchase'").key_by("user_id"), changes=True).df
    return out.select(F.col("l_event_id").alias("a_id"), F.col("r_event_id").alias("b_id"), F.col("_at").alias("moment"), F.col("_outdated").alias("outdated"))


@query(ORDERED + "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 3) AS s FROM e WHERE event_type = 'click' WINDOW w AS (ORDER BY seq ROWS 2 PRECEDING)")
def where_then_row_window(spark, d):
    f = _events(spark, d, "value", "event_type").where("event_type = 'click'").sliding_window("row", 3).aggregate(A.count(name="n"), A.sum_("value", "s"))
    return f.df.select("event_id", "n", F.round("s", 3).alias("s"))


@query(ORDERED + ", c AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS r, count(*) OVER () AS c FROM e WHERE event_type = 'click') SELECT r // 7 AS batch, count(*) AS n, sum(event_id) AS ids FROM c WHERE r < c // 7 * 7 GROUP BY 1")
def where_then_batch(spark, d):
    f = _events(spark, d, "event_type").where("event_type = 'click'").batch(7)
    return f.df.select(F.col("_seq").alias("batch"), F.size("batch").cast("long").alias("n"), F.aggregate("batch", F.lit(0).cast("long"), lambda a, x: a + x["event_id"]).alias("ids"))


@query(ORDERED + ", c AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS r FROM e WHERE value > 50) SELECT event_id, r // 25 AS win, count(*) OVER (PARTITION BY r // 25 ORDER BY r) AS n FROM c")
def where_then_tumbling_rows(spark, d):
    f = _events(spark, d, "value").where("value > 50").tumbling_window("row", 25).aggregate(A.count(name="n"))
    return f.df.select("event_id", F.col("_win").alias("win"), "n")


@query(ORDERED + ", u AS (SELECT event_id, value, seq * 2 AS o FROM e WHERE event_type = 'click' UNION ALL SELECT event_id, value, seq * 2 + 1 FROM e WHERE value > 50) SELECT event_id, o % 2 AS side, count(*) OVER w AS n, max(value) OVER w AS hi FROM u WINDOW w AS (ORDER BY o ROWS 4 PRECEDING)")
def union_then_row_window(spark, d):
    e = _events(spark, d, "value", "event_type")
    f = e.where("event_type = 'click'").union(e.where("value > 50")).sliding_window("row", 5).aggregate(A.count(name="n"), A.max_("value", "hi"))
    return f.df.select("event_id", (F.col("_seq") % 2).alias("side"), "n", "hi")


TIES = "WITH e AS (SELECT event_id, user_id, value, epoch_us(date_trunc('day', ts)) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) "


@query(TIES + "SELECT a.event_id, count(*) AS n, round(sum(b.value), 3) AS s FROM e a JOIN e b ON a.user_id = b.user_id AND b.r <= a.r AND b.us > a.us - 172800000000 GROUP BY a.event_id")
def range_window_ties(spark, d):
    """Of rows with one time only those that came first are in the window."""
    f = _by_user(spark, d, "value").transform(lambda x: x.withColumn("ts", F.date_trunc("day", "ts")))
    f = f.sliding_window("range", 172800).aggregate(A.count(name="n"), A.sum_("value", "s"))
    return f.df.select("event_id", "n", F.round("s", 3).alias("s"))


@query(ORDERED + "SELECT event_id, count(*) OVER w AS n, min(value) OVER w AS lo FROM e WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW)")
def sliding_range_global(spark, d):
    """Without a key: blocks of time, each with what its first windows reach into."""
    return _events(spark, d, "value").sliding_window("range", 3600).aggregate(A.count(name="n"), A.min_("value", "lo")).df.select("event_id", "n", "lo")


@query(ORDERED + "SELECT event_id, CAST(floor(sum(event_id) OVER w / count(*) OVER w) AS BIGINT) AS ia, round(avg(value) OVER w, 6) AS a, min(value) OVER w AS lo, max(value) OVER w AS hi, first_value(value) OVER w AS oldest, value AS newest, value AS id FROM e WINDOW w AS (ORDER BY seq)")
def running_totals_global(spark, d):
    """Blocks, with the totals of the blocks ahead."""
    f = _events(spark, d, "value").aggregate(A.int_avg("event_id", "ia"), A.avg("value", "a"), A.global_min("value", "lo"), A.global_max("value", "hi"), A.least_recent("value", "oldest"), A.most_recent("value", "newest"), A.identity("value", "id"))
    return f.df.select("event_id", "ia", F.round("a", 6).alias("a"), "lo", "hi", "oldest", "newest", "id")


@query("SELECT event_id, event_type, value, epoch_us(ts) AS us FROM events")
def serialize_roundtrip(spark, d):
    f = Flow(_read(spark, d, "events").select("event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))).serialize()
    return f.deserialize("event_id long, event_type string, value double, us long").df


@query(ORDERED + "SELECT event_id, round(list_max(list(value) OVER w) - list_min(list(value) OVER w), 6) AS spread FROM e WINDOW w AS (ORDER BY seq ROWS 4 PRECEDING)")
def window_function_spread(spark, d):
    f = _events(spark, d, "value").sliding_window("row", 5).fold("spread", "value", lambda x: F.array_max(x) - F.array_min(x))
    return f.df.select("event_id", F.round("spread", 6).alias("spread"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
t AS (SELECT user_id, event_id, r, us AS last, true AS hit FROM e WHERE r = 1
  UNION ALL SELECT e.user_id, e.event_id, e.r, CASE WHEN e.us - t.last >= 86400000000 THEN e.us ELSE t.last END, e.us - t.last >= 86400000000 FROM t JOIN e ON e.user_id = t.user_id AND e.r = t.r + 1)
SELECT event_id, r AS n FROM t WHERE hit""")
def trigger_by_timestamp(spark, d):
    return _by_user(spark, d).aggregate(A.count(name="n"), seconds=86400).df.select("event_id", "n")


@query("SELECT event_type, round(sum(value * value), 3) AS squares, count(*) AS n FROM events GROUP BY event_type")
def custom_aggregate(spark, d):
    f = Flow(_read(spark, d, "events")).key_by("event_type").group_by(A.custom(lambda x: F.sum(x * x), "value", "squares"), A.count(name="n"), emit="final")
    return f.df.withColumn("squares", F.round("squares", 3))


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_custkey % 4 < 3")
def partitioned_join(spark, d):
    """Both sides partitioned alike; partition 3 is outside and dropped."""
    left = Flow(_read(spark, d, "orders").select("o_orderkey", "o_custkey"), key="o_custkey").partition_by("o_custkey % 4", 3)
    right = Flow(_read(spark, d, "customer").select("c_custkey"), key="c_custkey").partition_by("c_custkey % 4", 3)
    return left.join(right).merge().df.select(F.col("l_o_orderkey").alias("o_orderkey"), F.col("r_c_custkey").alias("c_custkey"))


@query("SELECT event_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value FROM events WHERE value > 50")
def union_streams(spark, d):
    from rillstone.sources.context import Context

    c, e = Context(spark), Flow(_read(spark, d, "events").select("event_id", "value", "event_type"))
    e.where("event_type = 'click'").map("event_id", "value").to_stream(c, "all")
    e.where("value > 50").map("event_id", "value").to_stream(c, "all")
    return c.from_stream("all").df


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 2 = 0")
def partition_merge_filter(spark, d):
    return Flow(_read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")).partition_by("l_orderkey % 3", 3).where("l_orderkey % 2 = 0").merge().df


@query("SELECT event_id % 3 AS p, count(*) AS n, max(value) AS hi FROM events GROUP BY 1")
def partitioned_aggregate(spark, d):
    f = Flow(_read(spark, d, "events").select("event_id", "value")).partition_by("event_id % 3", 3).aggregate(A.count(name="n"), A.max_("value", "hi"), emit="final")
    return f.df.withColumnRenamed("_part", "p")


TRIPLES = "SELECT event_id AS s, 'type' AS p, event_type AS o, 0 AS k FROM events UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR), 1 FROM events UNION ALL SELECT event_id, 'x', event_type, 2 FROM events WHERE event_id % 5 = 0"


@query(f"WITH t AS ({TRIPLES}) SELECT s, max(CASE WHEN p = 'type' THEN o END) AS type, max(CASE WHEN p = 'user' THEN o END) AS \"user\" FROM t GROUP BY s")
def tuplify_events(spark, d):
    e = _read(spark, d, "events")
    t = e.select(F.col("event_id").alias("s"), F.explode(F.array(F.struct(F.lit("type").alias("p"), F.col("event_type").alias("o"), F.lit(0).alias("_seq")), F.struct(F.lit("user").alias("p"), F.col("user_id").cast("string").alias("o"), F.lit(1).alias("_seq")), F.struct(F.lit("x").alias("p"), F.col("event_type").alias("o"), F.lit(2).alias("_seq")))).alias("x")).select("s", "x.*")
    return Flow(t).tuplify(["type", "user"]).df.select("s", "type", "user")


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
t AS (SELECT *, ts AS opened, 0 AS win FROM e WHERE r = 1
  UNION ALL SELECT e.*, CASE WHEN t.opened <= e.ts - INTERVAL 1 DAY THEN e.ts ELSE t.opened END, CASE WHEN t.opened <= e.ts - INTERVAL 1 DAY THEN t.win + 1 ELSE t.win END FROM t JOIN e ON e.user_id = t.user_id AND e.event_type = t.event_type AND e.r = t.r + 1)
SELECT user_id, event_type, arg_max(value, r) FILTER (WHERE event_id % 2 = 0) AS even, arg_max(value, r) FILTER (WHERE event_id % 2 = 1) AS odd FROM t GROUP BY user_id, event_type, win""")
def tuplify_by_windows(spark, d):
    """Within a user's stream, a kind of event is a subject; its row takes a day from its first event on."""
    f = _by_user(spark, d, "event_type", "value").map("user_id", "event_type", "ts", "value", "if(event_id % 2 = 0, 'even', 'odd') AS p")
    return f.tuplify(["even", "odd"], "window", "event_type", "p", "value", seconds=86400).df.select("user_id", "event_type", "even", "odd")


@query(ORDERED + "SELECT seq, event_id, value FROM e WHERE seq < (SELECT count(*) // 10 * 10 FROM e)")
def batch_unbatch_roundtrip(spark, d):
    return _events(spark, d, "value").batch(10).unbatch().df.select(F.col("_seq").alias("seq"), "event_id", "value")


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error'")
def keyed_table_upsert(spark, d):
    log = _read(spark, d, "events").select("user_id", "value", "event_type", F.struct("ts", "event_id").alias("_seq"), (F.col("event_type") == "error").alias("_outdated"))
    return tables.last_writes(log, "user_id").select("user_id", "value", "event_type")


@query(ORDERED + ", l AS (SELECT user_id, arg_max(value, seq) AS value FROM e GROUP BY 1) SELECT c_custkey AS k, coalesce(l.value, c_acctbal) AS v FROM customer LEFT JOIN l ON user_id = c_custkey UNION ALL SELECT user_id, value FROM l WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def table_insert(spark, d):
    """Of inserts with one key the last wins."""
    t = tables.KeyedTable(_read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), "k")
    t.insert(_events(spark, d, "user_id", "value").df.select(F.col("user_id").alias("k"), F.col("value").alias("v"), "_seq"))
    return t.select()


@query("SELECT c_custkey, c_acctbal + 1000000 AS c_acctbal, 'Update' AS op FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, c_acctbal, 'Delete' FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT c_custkey, 1.0, 'Update' FROM customer WHERE c_custkey = 1")
def table_changes(spark, d):
    """The change feed: updates as they are after, deletes as they were."""
    t = tables.KeyedTable(_read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    t.delete_where(F.col("c_acctbal") > 9000)
    t.update_where(F.col("c_acctbal") < 0, c_acctbal=F.col("c_acctbal") + 1000000)
    t.insert(spark.createDataFrame([(1, 1.0)], "c_custkey long, c_acctbal double"))
    return t.changes().select("c_custkey", "c_acctbal", F.when(F.col("_op") == "Insert", "Update").otherwise(F.col("_op")).alias("op"))


@query("SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 7.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey <> 6 UNION ALL SELECT -1, 0.5")
def table_update_or_delete(spark, d):
    t = tables.KeyedTable(_read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    t.update_or_delete_by_key(5, F.lit(True), {"c_acctbal": F.lit(7.0)})
    t.update_or_delete_by_key(6, F.col("c_acctbal") > 1e9, {"c_acctbal": F.lit(1.0)})
    t.update_or_delete_by_key(-1, F.lit(True), {}, spark.createDataFrame([(-1, 0.5)], "c_custkey long, c_acctbal double"))
    return t.select()


@query(ORDERED + ", l AS (SELECT user_id, arg_max(value, seq) AS value, arg_max(event_type, seq) AS t FROM e GROUP BY 1) SELECT user_id AS k, value AS v FROM l WHERE t <> 'error'")
def flow_to_table(spark, d):
    """A flow folded into a table: rows are inserted, outdated ones delete their key."""
    t = tables.KeyedTable(spark.createDataFrame([], "k long, v double"), "k")
    rows = _events(spark, d, "user_id", "value", "event_type").df.select(F.col("user_id").alias("k"), F.col("value").alias("v"), "_seq", (F.col("event_type") == "error").alias("_outdated"))
    Flow(rows, key="k").to_table(t)
    return t.select()


@query(ORDERED + "SELECT user_id AS k, round(sum(value), 4) AS v, count(*) AS n FROM e GROUP BY 1 HAVING count(*) <> 5")
def flow_update_table(spark, d):
    """Records updated in order by functions; here sums, and whoever comes to five rows in all is deleted by the fifth."""
    t = tables.KeyedTable(spark.createDataFrame([], "k long, v double, n long"), "k")
    last = _by_user(spark, d, "value").df.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    rows = last.select(F.col("user_id").alias("k"), F.col("value").alias("v"), "c", "_seq")
    add = lambda row, old: None if old["n"] == 4 and row["c"] == 5 else {"k": row["k"], "v": old["v"] + row["v"], "n": old["n"] + 1}
    Flow(rows, key="k").update_table(t, add, lambda row: {"k": row["k"], "v": row["v"], "n": 1})
    return t.select().withColumn("v", F.round("v", 4))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS v FROM customer WHERE c_custkey <> 9")
def transactions(spark, d):
    """One transaction commits an update and a delete, one is aborted, one sees what it began with, one conflicts and is turned down."""
    t = tables.TxTable(_read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), "k")
    a, b, c = t.begin(), t.begin(), t.begin()
    t.write(a, t.read_own(a).filter("k % 3 = 0").withColumn("v", F.col("v") + 10))
    t.delete(a, F.col("k") == 9)
    t.write(b, t.read_own(b).withColumn("v", F.lit(0.0)))
    t.abort(b)
    t.write(c, t.read_own(c).filter("k = 9").withColumn("v", F.lit(1.0)))
    assert t.commit(a) and not t.commit(c)
    return t.read()


@query("SELECT c_custkey AS key, c_acctbal AS a_v, c_acctbal * 2 AS b_v FROM customer ORDER BY c_custkey")
def consistent_reads(spark, d):
    """Two states that commit together are read as of one commit, whatever came later."""
    from rillstone.sources.context import Context

    c, base = Context(spark), _read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    clock = tables.Clock()
    a, b = (c.add_table(n, tables.TxTable(base.limit(0), "k", clock)) for n in "ab")
    tx = a.begin()
    a.write(tx, base)
    b.write(tx, base.withColumn("v", F.col("v") * 2))
    at = tables.commit_together([a, b], tx)
    late = a.begin()
    a.write(late, base.withColumn("v", F.lit(-1.0)))
    a.commit(late)
    n = base.count()
    return c.from_tx_tables(["a", "b"], n, at).select("key", "a_v", "b_v")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT (c_mktsegment = 'BUILDING')")
def table_update_delete(spark, d):
    t = tables.KeyedTable(_read(spark, d, "customer"), "c_custkey")
    t.delete_where(F.col("c_mktsegment") == "BUILDING")
    t.update_where(F.col("c_acctbal") < 0, c_acctbal=F.lit(0.0))
    return t.select().select("c_custkey", "c_acctbal")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_id <= 500 GROUP BY user_id")
def mvcc_snapshot(spark, d):
    log = _read(spark, d, "events").select("user_id", "value", F.col("event_id").alias("_tx"))
    return tables.snapshot(tables.versions(log, "user_id"), 500).select("user_id", "value")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey > 10 AND c_acctbal >= 1000")
def sql_on_table(spark, d):
    from rillstone.sources.context import Context

    c = Context(spark)
    c.create_table("customers", _read(spark, d, "customer"), "c_custkey")
    return c.sql("select c_custkey, c_name, c_acctbal from customers where c_custkey > 10 and c_acctbal >= 1000")


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
m AS (SELECT user_id, 0::BIGINT AS r, 0 AS st, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT m.user_id, e.r, CASE WHEN m.st IN (0, 3) AND e.event_type = 'signup' THEN 1 WHEN m.st = 1 AND e.event_type = 'purchase' THEN 2 WHEN m.st = 2 AND e.event_type = 'error' THEN 3 WHEN m.st = 3 THEN 0 ELSE m.st END,
   CASE WHEN m.st IN (0, 3) AND e.event_type = 'signup' THEN e.event_id ELSE m.a END, CASE WHEN m.st = 1 AND e.event_type = 'purchase' THEN e.event_id ELSE m.b END, CASE WHEN m.st = 2 AND e.event_type = 'error' THEN e.event_id ELSE m.c END
  FROM m JOIN e ON e.user_id = m.user_id AND e.r = m.r + 1)
SELECT user_id, a, b, c FROM m WHERE st = 3""")
def cep_seq_first_match(spark, d):
    p = state(lambda e: e["event_type"] == "signup") >> state(lambda e: e["event_type"] == "purchase") >> state(lambda e: e["event_type"] == "error")
    out = match(_by_user(spark, d, "event_type").df, p, ["user_id"], output="combined")
    return out.select("user_id", *[F.col("events")[i]["event_id"].alias(n) for i, n in enumerate("abc")])


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT user_id, r, event_id FROM e WHERE event_type = 'signup'),
m AS (SELECT s.user_id, s.r, s.event_id AS a, min(p.r) AS pr FROM s JOIN e p ON p.user_id = s.user_id AND p.r > s.r AND p.event_type = 'purchase' GROUP BY ALL),
k AS (SELECT m.*, p.event_id AS b FROM m JOIN e p ON p.user_id = m.user_id AND p.r = m.pr
  WHERE p.event_id - m.a <= 2000 AND NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = m.user_id AND x.r > m.r AND x.r < m.pr AND x.event_id - m.a > 2000)),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pr, r) - 1 AS i FROM k)
SELECT user_id, a AS event_id, i AS _match, CAST(0 AS BIGINT) AS _pos FROM n UNION ALL SELECT user_id, b, i, 1 FROM n""")
def cep_next_match(spark, d):
    p = (state(lambda e: e["event_type"] == "signup") >> state(lambda e: e["event_type"] == "purchase")).within("event_id", 2000)
    return match(_by_user(spark, d, "event_type").df, p, ["user_id"], "next").select("user_id", "event_id", "_match", "_pos")


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT user_id, min(r) AS r FROM e WHERE event_type = 'signup' GROUP BY 1),
t AS (SELECT e.user_id, e.event_id, e.r FROM e JOIN s ON e.user_id = s.user_id AND e.r > s.r AND e.event_type = 'purchase'),
k AS (SELECT e.user_id, e.event_id, e.r FROM e JOIN s ON e.user_id = s.user_id AND e.r = s.r WHERE s.user_id IN (SELECT user_id FROM t)),
a AS (SELECT * FROM k UNION ALL SELECT * FROM t) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY r) - 1 AS pos FROM a""")
def cep_trailing_loop(spark, d):
    """A loop at the end takes what comes until the rows of the partition end."""
    p = state(lambda e: e["event_type"] == "signup") >> state(lambda e: e["event_type"] == "purchase").plus()
    return match(_by_user(spark, d, "event_type").df, p, ["user_id"]).select("user_id", "event_id", F.col("_pos").alias("pos"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT *, lead(r) OVER (PARTITION BY user_id ORDER BY r) AS next_r FROM e WHERE event_type IN ('signup', 'error'))
SELECT s.user_id, s.event_id FROM s WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM s x WHERE x.user_id = s.user_id AND x.event_type = 'error' AND x.r > s.r)
AND NOT EXISTS (SELECT 1 FROM s y WHERE y.user_id = s.user_id AND y.event_type = 'signup' AND y.r < s.r AND NOT EXISTS (SELECT 1 FROM s z WHERE z.user_id = s.user_id AND z.event_type = 'error' AND z.r > y.r))""")
def cep_trailing_negation(spark, d):
    """A signup without an error behind it."""
    p = state(lambda e: e["event_type"] == "signup") >> ~state(lambda e: e["event_type"] == "error")
    return match(_by_user(spark, d, "event_type").df, p, ["user_id"]).select("user_id", "event_id")


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY r) AS t2, lead(event_id) OVER (PARTITION BY user_id ORDER BY r) AS id2 FROM e)
SELECT user_id, event_id AS a, id2 AS b FROM s WHERE (event_type = 'signup' AND t2 = 'purchase') OR (event_type = 'purchase' AND t2 = 'error')""")
def cep_contiguous_alternatives(spark, d):
    """Alternatives of sequences, of events that follow each other directly; any event may open a run."""
    is_ = lambda t: state(lambda e: e["event_type"] == t)
    p = (is_("signup") >> is_("purchase")) | (is_("purchase") >> is_("error"))
    out = match(_by_user(spark, d, "event_type").df, p, ["user_id"], "contiguous", "combined")
    return out.select("user_id", *[F.col("events")[i]["event_id"].alias(n) for i, n in enumerate("ab")])


@query(ORACLE_SQL["cep_seq_first_match"])
def cep_automaton(spark, d):
    """The same matches by an explicit automaton."""
    is_ = lambda t: lambda e, run: e["event_type"] == t
    nfa = Nfa(0, (3,), ((0, is_("signup"), 1), (1, is_("purchase"), 2), (2, is_("error"), 3)))
    out = match(_by_user(spark, d, "event_type").df, nfa, ["user_id"], output="combined")
    return out.select("user_id", *[F.col("events")[i]["event_id"].alias(n) for i, n in enumerate("abc")])


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS balance FROM events")
def stateful_balance(spark, d):
    f = lambda row, total: ({"user_id": row["user_id"], "event_id": row["event_id"], "balance": total + row["value"]}, total + row["value"])
    out = _by_user(spark, d, "value").stateful_map(f, float, "user_id long, event_id long, balance double")
    return out.df.withColumn("balance", F.round("balance", 4))


NATION_EDGES = "SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst, 1.0 + n_regionkey AS w FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 7 + 3) % 25, 2.5 FROM nation"


def _edges(spark, d) -> DataFrame:
    n = _read(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(k.alias("src"), ((k + 1) % 25).alias("dst"), (1.0 + F.col("n_regionkey")).alias("w")).unionByName(n.select(k.alias("src"), ((k * 7 + 3) % 25).alias("dst"), F.lit(2.5).alias("w")))


@query(f"""WITH RECURSIVE edges AS ({NATION_EDGES}), p AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS dist, 0 AS n UNION SELECT edges.dst::BIGINT, p.dist + edges.w, p.n + 1 FROM p JOIN edges ON p.node = edges.src WHERE p.n < 9 AND p.dist < 15)
SELECT node, min(dist) AS dist FROM p GROUP BY node""")
def graph_shortest_path(spark, d):
    return matrices.shortest_paths(_edges(spark, d), 0)


@query(f"""WITH RECURSIVE x AS ({NATION_EDGES}), u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(w) AS w FROM x WHERE src <> dst GROUP BY 1, 2),
e AS (SELECT *, row_number() OVER (ORDER BY w, a, b) AS r FROM u),
p AS (SELECT e.r, e.a AS home, e.a AS node FROM e UNION SELECT p.r, p.home, CASE WHEN e.a = p.node THEN e.b ELSE e.a END FROM p JOIN e ON e.r < p.r AND (e.a = p.node OR e.b = p.node))
SELECT a, b, CAST(w AS DOUBLE) AS w FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.r = e.r AND p.node = e.b)""")
def graph_spanning_tree(spark, d):
    """An edge is of the tree unless lesser ones (by weight, then ends) join its ends already."""
    return matrices.spanning_tree(_edges(spark, d))


@query(f"WITH x AS (SELECT DISTINCT src, dst FROM ({NATION_EDGES})) SELECT n.n_nationkey AS node, (SELECT count(*) FROM x WHERE src = n.n_nationkey) AS n_out, (SELECT count(*) FROM x WHERE dst = n.n_nationkey) AS n_in FROM nation n WHERE n.n_nationkey <> 3")
def graph_edit_degrees(spark, d):
    """Parallel edges are one cell of the matrix; clearing a vertex and adding its edges again changes nothing."""
    g = matrices.Graph(_edges(spark, d).groupBy("src", "dst").agg(F.min("w").alias("w")), 25)
    three = g.edges.filter("src = 3 or dst = 3")
    g = g.clear_vertex(3).add_edges(three)
    return g.vertices().join(g.out_degree(), "node", "left").join(g.in_degree(), "node", "left").filter("node <> 3").select("node", F.coalesce("out_degree", F.lit(0)).alias("n_out"), F.coalesce("in_degree", F.lit(0)).alias("n_in"))


MATRIX = "SELECT l_suppkey % 10 AS i, l_linenumber AS j, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2"


@query(f"WITH m AS ({MATRIX}), r AS (SELECT CASE WHEN i > 4 THEN i - 1 ELSE i END AS i, j, v FROM m WHERE i <> 4), c AS (SELECT i, CASE WHEN j >= 2 THEN j + 1 ELSE j END AS j, v FROM r) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CASE WHEN i = 0 AND j = 1 THEN -1.0 ELSE v END AS v FROM c WHERE i < 8 AND j < 7")
def matrix_edit(spark, d):
    """A row removed, a column inserted, a cell set, then cut to 8 x 7."""
    cells = _read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.max("l_quantity").alias("v"))
    return matrices.resize(matrices.set_cell(matrices.insert_col(matrices.remove_row(cells, 4), 2), 0, 1, -1.0), 8, 7)


@query(ORDERED + ", k AS (SELECT user_id % 10 AS i, event_id % 7 AS j, arg_max(value, seq) AS v, arg_max(event_type, seq) AS t FROM e GROUP BY 1, 2) SELECT i, j, v FROM k WHERE t <> 'error'")
def matrix_from_log(spark, d):
    """Inserts set cells, outdated rows take them away; the last change of a cell counts."""
    log = _events(spark, d, "user_id", "value", "event_type").df.select((F.col("user_id") % 10).alias("i"), (F.col("event_id") % 7).alias("j"), F.col("value").alias("v"), "_seq", (F.col("event_type") == "error").alias("_outdated"))
    return matrices.to_matrix(log)


@query("SELECT l_suppkey % 10 AS i, l_linenumber AS j, max(l_quantity) AS v FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2")
def matrix_slice_merge(spark, d):
    cells = _read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("i"), F.col("l_linenumber").alias("j")).agg(F.max("l_quantity").alias("v")).withColumn("id", F.lit(0))
    parts = matrices.matrix_slice(cells, {0: F.col("j") <= 2, 1: F.col("j").between(3, 4)})
    return matrices.matrix_merge(parts, 2).drop("id")


@query("""WITH c AS (SELECT c_custkey, (c_custkey % 180 - 90)::DOUBLE AS lat, (c_custkey * 7 % 360 - 180)::DOUBLE AS lon FROM customer), n AS (SELECT n_nationkey, (n_nationkey * 7 % 180 - 90)::DOUBLE AS lat, (n_nationkey * 13 % 360 - 180)::DOUBLE AS lon FROM nation),
x AS (SELECT c_custkey, n_nationkey, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(n.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(n.lat)) * pow(sin(radians(n.lon - c.lon) / 2), 2)))) AS km FROM c, n)
SELECT c_custkey, round(min(km), 6) AS km FROM x GROUP BY c_custkey""")
def haversine_nearest(spark, d):
    """Landmarks are a stated set of 25 points, folded into an array; each point meets all of them without a join of rows."""
    n = _read(spark, d, "nation").select((F.col("n_nationkey") * 7 % 180 - 90).cast("double").alias("lat"), (F.col("n_nationkey") * 13 % 360 - 180).cast("double").alias("lon"))
    points = n.agg(F.collect_list(F.struct("lat", "lon")).alias("points"))
    c = _read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 180 - 90).cast("double").alias("la"), (F.col("c_custkey") * 7 % 360 - 180).cast("double").alias("lo"), F.lit(1).alias("one"))
    both = c.join(F.broadcast(points.withColumn("one", F.lit(1))), "one")
    return both.select("c_custkey", F.round(F.array_min(F.transform("points", lambda p: haversine_km(F.col("la"), F.col("lo"), p["lat"], p["lon"]))), 6).alias("km"))


LR = "SELECT user_id AS vid, (epoch_us(ts), event_id) AS time, epoch_us(ts) // 86400000000 AS m, user_id % 3 AS seg, event_type AS pos, value AS speed FROM events"


@query(f"WITH p AS ({LR}), v AS (SELECT seg, m, vid, CAST(avg(speed) AS DECIMAL(28, 9)) AS s FROM p GROUP BY 1, 2, 3), a AS (SELECT seg, m, sum(s) AS s, count(*) AS n FROM v GROUP BY 1, 2) SELECT seg, m, CAST(sum(s) OVER w AS DOUBLE) / sum(n) OVER w AS lav FROM a WINDOW w AS (PARTITION BY seg ORDER BY m RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)")
def linear_road_lav(spark, d):
    from rillstone.plans.usecases import average_speed

    return average_speed(_positions(spark, d)).select("seg", "m", "lav")


STOPS = """st AS (SELECT *, min((seg, pos)) OVER w = max((seg, pos)) OVER w AND count(*) OVER w = 4 AS stopped FROM p WINDOW w AS (PARTITION BY vid ORDER BY time ROWS 3 PRECEDING)),
acc AS (SELECT DISTINCT seg, m FROM (SELECT seg, pos, m FROM st WHERE stopped GROUP BY ALL HAVING count(DISTINCT vid) >= 2))"""


@query(f"WITH p AS ({LR}), {STOPS} SELECT seg, m FROM acc")
def linear_road_accidents(spark, d):
    from rillstone.plans.usecases import accidents

    return accidents(_positions(spark, d))


@query(f"WITH p AS ({LR}), {STOPS}, v AS (SELECT seg, m, vid, CAST(avg(speed) AS DECIMAL(28, 9)) AS s FROM p GROUP BY 1, 2, 3), a AS (SELECT seg, m, sum(s) AS s, count(*) AS n FROM v GROUP BY 1, 2), l AS (SELECT seg, m, n, CAST(sum(s) OVER w AS DOUBLE) / sum(n) OVER w AS lav FROM a WINDOW w AS (PARTITION BY seg ORDER BY m RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT seg, m, CASE WHEN lav < 60 AND n > 20 AND NOT EXISTS (SELECT 1 FROM acc WHERE acc.seg BETWEEN l.seg AND l.seg + 4 AND acc.m = l.m - 1) THEN 2.0 * pow(n - 20, 2) ELSE 0.0 END AS toll FROM l")
def linear_road_tolls(spark, d):
    from rillstone.plans.usecases import accidents, tolls

    p = _positions(spark, d)
    return tolls(p, speed_below=60, cars_above=20, accident=accidents(p)).select("seg", "m", "toll")


def _positions(spark, d) -> DataFrame:
    return _read(spark, d, "events").select(F.col("user_id").alias("vid"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("m"), (F.col("user_id") % 3).alias("seg"), F.col("value").alias("speed"), F.struct("ts", "event_id").alias("time"), F.col("event_type").alias("pos"))


WALKS = "WITH e AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS items FROM events GROUP BY 1), p AS (SELECT DISTINCT user_id, items[i : i + n - 1] AS pattern FROM e, range(1, 301) a(i), range(1, 301) b(n) WHERE i + n - 1 <= len(items)) "


@query(WALKS + "SELECT array_to_string(pattern, '>') AS pattern, count(*) AS support FROM p GROUP BY ALL HAVING count(*) >= 2")
def frequent_walks(spark, d):
    """Contiguous runs of event types, of any length, that at least two users share."""
    from rillstone.plans.usecases import frequent_patterns

    e = _read(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    walks = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("items"))
    return frequent_patterns(walks).select(F.array_join("pattern", ">").alias("pattern"), "support")


@query()
def value_anomalies(spark, d):
    from rillstone.plans.usecases import user_transitions

    return user_transitions(_by_user(spark, d, "value").df)
