"""Queries over the event stream and the star tables: time order, statistics, set operations, and relational conformance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.operators import ordered as O
from rangeloom.operators import voxels as V
from rangeloom.sources.tables import SQL_EVENTS, event_stream, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


V_ = f"WITH {SQL_EVENTS}"
DAY = 86_400_000_000
HOUR = 3_600_000_000


@query(f'{V_} SELECT "user", CAST(floor(us / {float(DAY)}) AS BIGINT) AS frame, count(*) AS n, min(us) AS first, max(us) AS last FROM ev GROUP BY 1, 2')
def frame_tumbling(s: SparkSession, d: str) -> DataFrame:
    return O.frames(event_stream(s, d), DAY, ["user"])


@query(f'{V_} SELECT id, us, "user" FROM ev WHERE (SELECT max(us) FROM ev) - us <= {5 * DAY}')
def persistence_window(s: SparkSession, d: str) -> DataFrame:
    return O.persistence(event_stream(s, d).select("id", "us", "user"), 5 * DAY)


@query(f"{V_} SELECT type, round(quantile_cont(value, 0.02), 6) AS p02, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.98), 6) AS p98 FROM ev GROUP BY type")
def scalar_percentiles(s: SparkSession, d: str) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6).alias(f"p{round(q * 100):02d}")
    return event_stream(s, d).groupBy("type").agg(p(0.02), p(0.5), p(0.98))


@query(f"""{V_}, g AS (SELECT "user", us - lag(us) OVER (PARTITION BY "user" ORDER BY us, id) - {HOUR} AS gap FROM ev)
SELECT "user", count(*) AS packets, CAST(sum(CASE WHEN gap > {HOUR // 2} AND gap < {3 * DAY} THEN CAST(floor((gap + {HOUR / 2}) / {float(HOUR)}) AS BIGINT) ELSE 0 END) AS BIGINT) AS lost FROM g GROUP BY 1""")
def loss_estimate(s: SparkSession, d: str) -> DataFrame:
    return O.losses(event_stream(s, d), "user", HOUR, 3 * DAY)


@query(f"""{V_}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY "user" ORDER BY us, id) > {DAY} THEN 1 ELSE 0 END AS new FROM ev),
t AS (SELECT *, CAST(sum(new) OVER (PARTITION BY "user" ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
SELECT "user", session, count(*) AS n, min(us) AS start, max(us) AS "end" FROM t GROUP BY 1, 2""")
def gap_sessions(s: SparkSession, d: str) -> DataFrame:
    return O.gap_sessions(event_stream(s, d), "user", DAY)


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, round(o_totalprice - before, 4) AS step, round(after - 2 * o_totalprice + before, 4) AS bend, coalesce(abs(o_totalprice - before) < 50000 AND abs(after - o_totalprice) < 50000, false) AS plausible FROM o""")
def lag_steps(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(s, d, "orders").withColumns({"before": F.lag("o_totalprice").over(w), "after": F.lead("o_totalprice").over(w)})
    step, nxt = F.col("o_totalprice") - F.col("before"), F.col("after") - F.col("o_totalprice")
    return o.select("o_orderkey", F.round(step, 4).alias("step"), F.round(F.col("after") - 2 * F.col("o_totalprice") + F.col("before"), 4).alias("bend"), F.coalesce((F.abs(step) < 50000) & (F.abs(nxt) < 50000), F.lit(False)).alias("plausible"))


@query(f"""{V_}, b AS (SELECT *, (us - min(us) OVER (PARTITION BY "user")) / 1e6 AS t FROM ev), s AS (SELECT id, "user", count(*) OVER w AS n, sum(t) OVER w AS st, sum(value) OVER w AS sv, sum(t*t) OVER w AS stt, sum(t*value) OVER w AS stv
FROM b WINDOW w AS (PARTITION BY "user" ORDER BY us RANGE BETWEEN {10 * DAY} PRECEDING AND CURRENT ROW)) SELECT id, "user", n, round(CASE WHEN n < 2 OR stt - st*st/n <= 1e-9 THEN 0.0 ELSE (stv - st*sv/n)/(stt - st*st/n) END, 6) AS slope FROM s""")
def velocity_slope(s: SparkSession, d: str) -> DataFrame:
    return O.velocity(event_stream(s, d), "user", 10 * DAY).select("id", "user", "n", F.round("slope", 6).alias("slope"))


@query("""WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS place FROM lineitem) SELECT * FROM r WHERE place <= 3""")
def rank_cap(s: SparkSession, d: str) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return O.rank_cap(table(s, d, "lineitem"), "l_partkey", order, 3).select("l_partkey", "l_orderkey", "l_linenumber", "place")


@query("""WITH b AS (SELECT CAST(floor(l_quantity / 10.0) AS BIGINT) AS bin, l_extendedprice AS v FROM lineitem), m AS (SELECT bin, count(*) AS n, quantile_cont(v, 0.5) AS med FROM b GROUP BY bin HAVING count(*) >= 100)
SELECT bin, any_value(n) AS n, round(any_value(med), 4) AS median, round(1.4826 * quantile_cont(abs(v - med), 0.5), 4) AS mad FROM b JOIN m USING (bin) GROUP BY bin""")
def robust_mad(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "lineitem").select(F.floor(F.col("l_quantity") / 10.0).alias("bin"), F.col("l_extendedprice").alias("v"))
    m = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.lit(0.5)).alias("med")).where("n >= 100")
    return b.join(F.broadcast(m), "bin").groupBy("bin", "n", "med").agg((1.4826 * F.percentile(F.abs(F.col("v") - F.col("med")), F.lit(0.5))).alias("mad")).select("bin", "n", F.round("med", 4).alias("median"), F.round("mad", 4).alias("mad"))


@query("""SELECT CAST(floor(l_discount * 100 / 2.0 + 1e-9) AS BIGINT) AS bin, count(*) AS n, round(avg(l_tax), 6) AS bias, round(stddev_pop(l_tax), 6) AS spread FROM lineitem GROUP BY 1 HAVING count(*) >= 500""")
def binned_bias(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "lineitem").groupBy(F.floor(F.col("l_discount") * 100 / 2.0 + 1e-9).alias("bin"))
    return b.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_tax"), 6).alias("bias"), F.round(F.stddev_pop("l_tax"), 6).alias("spread")).where("n >= 500")


HITS = f"""c AS (SELECT "user", count(*) FILTER (WHERE type IN ('click', 'view')) AS n, count(*) FILTER (WHERE type NOT IN ('click', 'view')) AS miss, max(us) AS last FROM ev GROUP BY 1)"""


@query(f"""{V_}, {HITS} SELECT "user", n, miss, miss >= 3 AND miss > 1.5 * n AS transient, miss >= 3 AND miss > 1.5 * n AND (SELECT max(us) FROM ev) - last >= {DAY // 10} AS ghost FROM c""")
def transient_ghost(s: SparkSession, d: str) -> DataFrame:
    e = event_stream(s, d)
    hit = F.col("type").isin("click", "view")
    c = e.groupBy("user").agg(F.count_if(hit).alias("n"), F.count_if(~hit).alias("miss"), F.max("us").alias("last"))
    c = c.crossJoin(F.broadcast(e.agg(F.max("us").alias("now"))))
    n, miss = F.col("n"), F.col("miss")
    return c.select("user", "n", "miss", V.transient(miss, n, 3, 1.5).alias("transient"), V.ghost(miss, n, F.col("last"), F.col("now"), 3, 1.5, DAY // 10).alias("ghost"))


@query(f"""{V_}, k AS (SELECT o_custkey AS "user", epoch_us(o_orderdate) AS key, max(o_totalprice) AS price FROM orders GROUP BY 1, 2) SELECT e.id, e."user", k.key, k.price FROM ev e ASOF LEFT JOIN k ON e."user" = k."user" AND e.us >= k.key""")
def asof_pose(s: SparkSession, d: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', o_orderdate)")
    keys = table(s, d, "orders").groupBy(F.col("o_custkey").alias("user"), us.alias("key")).agg(F.max("o_totalprice").alias("price"))
    return O.as_of(event_stream(s, d).select("id", "us", "user"), keys, "user", "us", "key").select("id", "user", "key", "price")


@query(f"""{V_} SELECT id, us, type FROM ev WHERE type = 'click' UNION ALL SELECT id, us, type FROM ev WHERE type <> 'click' AND value > 50""")
def union_batches(s: SparkSession, d: str) -> DataFrame:
    e = event_stream(s, d).select("id", "us", "type", "value")
    return e.where("type = 'click'").unionByName(e.where("type <> 'click' AND value > 50")).drop("value")


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(s, d, "supplier").select("s_nationkey")).distinct()


@query(f"""{V_} SELECT "user", count(*) AS packets, count(DISTINCT type) AS types, round(sum(value), 4) AS bytes, arg_max(type, id) AS last_type FROM ev GROUP BY 1""")
def decode_stats(s: SparkSession, d: str) -> DataFrame:
    return event_stream(s, d).groupBy("user").agg(F.count(F.lit(1)).alias("packets"), F.count_distinct("type").alias("types"), F.round(F.sum("value"), 4).alias("bytes"), F.max_by("type", "id").alias("last_type"))


@query(f"""WITH RECURSIVE {SQL_EVENTS}, o AS (SELECT id, us, "user", value, row_number() OVER (PARTITION BY "user" ORDER BY us, id) AS place FROM ev),
k AS (SELECT id, "user", value AS kept, place, true AS key FROM o WHERE place = 1 UNION ALL SELECT o.id, o."user", CASE WHEN abs(o.value - k.kept) >= 20 THEN o.value ELSE k.kept END, o.place, abs(o.value - k.kept) >= 20 FROM k JOIN o ON o."user" = k."user" AND o.place = k.place + 1)
SELECT id, "user" FROM k WHERE key""")
def keyframes(s: SparkSession, d: str) -> DataFrame:
    """Rows at least 20 from the last kept one of their user: a fold, as what is kept depends on what was kept."""
    return O.kept_far(event_stream(s, d).select("user", "us", "id", "value"), "user", ["us", "id"], "value", 20.0).select("id", "user")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    li = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02'"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@query("""SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())""")
def grouping_sets(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def anti_customers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_customers(s: SparkSession, d: str) -> DataFrame:
    big = table(s, d, "orders").where("o_totalprice > 200000")
    return table(s, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(nc, 0) AS customers, coalesce(ns, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def full_join(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    u = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(u, "nation", "full").fillna(0, ["customers", "suppliers"])


@query("SELECT c_nationkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(s: SparkSession, d: str) -> DataFrame:
    c, u, n = table(s, d, "customer").where("c_acctbal > 0").select("c_nationkey"), table(s, d, "supplier").select("s_nationkey"), table(s, d, "nation").where("n_regionkey = 0").select("n_nationkey")
    return c.intersect(u).subtract(n)


@query("""SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS quarter, round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate)""")
def window_ranks(s: SparkSession, d: str) -> DataFrame:
    w, p = Window.partitionBy("o_orderpriority").orderBy("o_orderdate"), Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")
    return table(s, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(p).cast("long").alias("quarter"), F.round(F.sum("o_totalprice").over(p.rowsBetween(-2, 0)), 2).alias("last3"))


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def json_props(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT p_partkey, upper(p_brand) AS brand, length(p_name) AS name_length, split_part(p_type, ' ', 1) AS kind, replace(p_name, ' ', '_') AS slug FROM part WHERE p_size BETWEEN 10 AND 30""")
def string_functions(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").where(F.col("p_size").between(10, 30))
    return p.select("p_partkey", F.upper("p_brand").alias("brand"), F.char_length("p_name").cast("long").alias("name_length"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("slug"))


@query("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def calendar_totals(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""{V_}, w AS (SELECT type, unnest([CAST(floor(us / {float(DAY)}) AS BIGINT), CAST(floor(us / {float(DAY)}) AS BIGINT) - 1]) AS hop, value FROM ev) SELECT type, hop, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def hopping_windows(s: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.col("us") / float(DAY))
    return event_stream(s, d).select("type", F.explode(F.array(day, day - 1)).alias("hop"), "value").groupBy("type", "hop").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, max(turn) AS last_turn FROM conversations GROUP BY role""")
def conversation_roles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"), F.max("turn").alias("last_turn"))
