"""Queries over what is shown and kept: visibility, subsets, latest rows, frame weights, splines, fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions import calibration
from rangeloom.operators import ordered as O
from rangeloom.operators import visible as S
from rangeloom.sources.tables import SQL_EMBEDDED, SQL_EVENTS, SQL_ITEMS, event_stream, points_embedded, points_items, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {SQL_EMBEDDED}, c AS (SELECT *, id % 7 AS neighbours, z < 0 AS ground, label % 3 = 0 AS moving FROM emb)
SELECT id, CAST(CASE WHEN neighbours < 2 OR ground OR moving THEN 0 ELSE 255 END AS BIGINT) AS alpha, CAST(CASE WHEN NOT moving THEN 0 ELSE 255 END AS BIGINT) AS only_moving FROM c""")
def visibility_rules(s: SparkSession, d: str) -> DataFrame:
    p = points_embedded(s, d).select("id", (F.col("id") % 7).alias("neighbours"), (F.col("z") < 0).alias("ground"), (F.col("label") % 3 == 0).alias("moving"))
    return p.select("id", S.alpha(True, 2, True, True, False).cast("long").alias("alpha"), S.alpha(False, 0, False, False, True).cast("long").alias("only_moving"))


@query(f"WITH {SQL_EMBEDDED} SELECT id, x, y, z FROM emb ORDER BY (id * 7919) % 10007, id LIMIT 50")
def draw_subset(s: SparkSession, d: str) -> DataFrame:
    return S.draw_subset(points_embedded(s, d), F.struct(F.col("id") * 7919 % 10007, F.col("id")), 50).select("id", "x", "y", "z")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def pose_latest(s: SparkSession, d: str) -> DataFrame:
    return S.latest(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"""WITH {SQL_ITEMS}, f AS (SELECT day, avg(CASE WHEN z < 1500 THEN 1.0 ELSE 0.0 END) AS fit FROM li GROUP BY 1), w AS (SELECT li.day, CAST(CASE WHEN fit < 0.3 THEN 0.0 WHEN refl < 60 THEN 0.2 ELSE 1.0 END AS DOUBLE) AS weight FROM li JOIN f ON f.day = li.day)
SELECT day, count(*) AS n, round(sum(weight), 6) AS weight FROM w GROUP BY 1""")
def frame_weight_mask(s: SparkSession, d: str) -> DataFrame:
    p = points_items(s, d).withColumn("hit", F.col("refl") >= 60)
    return S.weighted_frames(p, "day", F.col("z") < 1500, 0.3, 0.2).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


DAY = 86_400_000_000


@query(f"""WITH {SQL_EVENTS}, k AS (SELECT CAST(floor(us / {float(DAY)}) AS BIGINT) AS frame, CAST(min(id) AS BIGINT) AS pose FROM ev GROUP BY 1), m AS (SELECT max(us) AS now FROM ev)
SELECT e.id, k.frame, k.pose FROM ev e JOIN m ON e.us > m.now - {7 * DAY} JOIN k ON k.frame = CAST(floor(e.us / {float(DAY)}) AS BIGINT) WHERE k.frame % 2 = 0""")
def frame_window(s: SparkSession, d: str) -> DataFrame:
    e = event_stream(s, d)
    known = e.groupBy(F.floor(F.col("us") / float(DAY)).alias("frame")).agg(F.min("id").alias("pose")).where("frame % 2 = 0")
    return S.frame_window(e.select("id", "us"), known, DAY, 7 * DAY).select("id", "frame", "pose")


@query("""WITH r AS (SELECT l_orderkey AS id, l_shipdate AS t, l_linenumber AS ret, CAST(floor(l_quantity * 200) AS BIGINT) AS x, CAST(l_returnflag <> 'N' AS BOOLEAN) AS valid, CAST(l_suppkey % 2 AS BIGINT) AS tag, l_extendedprice AS p FROM lineitem)
SELECT id, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx FROM r WHERE valid AND tag = 0 AND x > 300 GROUP BY id""")
def firing_returns(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("t"), F.struct((F.col("l_returnflag") != "N").alias("valid"), F.floor(F.col("l_quantity") * 200).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), (F.col("l_suppkey") % 2).alias("tag")).alias("r"))
    firings = r.groupBy("id", "t").agg(F.collect_list("r").alias("returns"))
    return S.returns(firings, 300).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"))


@query(f"""WITH {SQL_EVENTS}, k AS (SELECT unnest(range(0, 6)) AS k), v AS (SELECT k, CAST((k * k * 7) % 11 AS DOUBLE) AS a FROM k), e AS (SELECT id, (id % 500) / 100.0 AS t FROM ev),
u AS (SELECT id, least(greatest(CAST(floor(t) AS BIGINT), 0), 4) AS k0, t - least(greatest(CAST(floor(t) AS BIGINT), 0), 4) AS u FROM e),
w AS (SELECT id, k0, unnest([-1, 0, 1, 2]) AS o, unnest([(1-u)*(1-u)*(1-u)/6, (3*u*u*u-6*u*u+4)/6, (-3*u*u*u+3*u*u+3*u+1)/6, u*u*u/6]) AS w FROM u)
SELECT w.id, round(sum(w * a), 6) AS s FROM w JOIN v ON v.k = least(greatest(k0 + o, 0), 5) GROUP BY w.id""")
def spline_join(s: SparkSession, d: str) -> DataFrame:
    knots = s.range(6).select(F.col("id").alias("k"), (F.col("id") * F.col("id") * 7 % 11).cast("double").alias("a"))
    rows = event_stream(s, d).select("id", (F.col("id") % 500 / 100.0).alias("t"))
    return calibration.spline_at(rows, knots, "t", 1.0, ["a"]).select("id", F.round("s_a", 6).alias("s"))


@query(f"""WITH {SQL_EMBEDDED}, c AS (SELECT CAST(floor(x/500.0) AS BIGINT) AS i, CAST(floor(y/500.0) AS BIGINT) AS j, CAST(floor(z/500.0) AS BIGINT) AS k, CAST(count(*) AS DOUBLE) AS n FROM emb GROUP BY 1, 2, 3),
b AS (SELECT id, CAST(floor((x-250)/500.0) AS BIGINT) AS bi, CAST(floor((y-250)/500.0) AS BIGINT) AS bj, CAST(floor((z-250)/500.0) AS BIGINT) AS bk, (x-250)/500.0 AS fx, (y-250)/500.0 AS fy, (z-250)/500.0 AS fz FROM emb),
o AS (SELECT unnest([0, 1]) AS o), w AS (SELECT id, bi + a.o AS i, bj + b2.o AS j, bk + c2.o AS k, (CASE a.o WHEN 1 THEN fx - bi ELSE 1 - fx + bi END) * (CASE b2.o WHEN 1 THEN fy - bj ELSE 1 - fy + bj END) * (CASE c2.o WHEN 1 THEN fz - bk ELSE 1 - fz + bk END) AS w FROM b, o a, o b2, o c2)
SELECT w.id, round(sum(w.w * coalesce(c.n, -1.0)), 6) AS n FROM w LEFT JOIN c ON c.i = w.i AND c.j = w.j AND c.k = w.k GROUP BY w.id""")
def trilinear_sample(s: SparkSession, d: str) -> DataFrame:
    p = points_embedded(s, d)
    cells = p.groupBy(*[F.floor(F.col(c) / 500.0).alias(n) for c, n in zip("xyz", "ijk")]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return calibration.trilinear(p, cells, 500.0, "n", -1.0).select("id", F.round("n", 6).alias("n"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS c, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
f AS (SELECT c, p, n, 0.1 * v AS e FROM o WHERE p = 1 UNION ALL SELECT o.c, o.p, o.n, 0.9 * f.e + 0.1 * o.v FROM f JOIN o ON o.c = f.c AND o.p = f.p + 1) SELECT c AS customer, round(e, 4) AS ema FROM f WHERE p = n""")
def ema_values(s: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice")))
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.transform(rows, lambda r: r["o_totalprice"]).alias("v"))
    return o.select("customer", F.round(O.ema(F.col("v"), 0.1), 4).alias("ema"))


@query(f"""WITH {SQL_EVENTS}, g AS (SELECT id, us, "user", value < 40 AS poor FROM ev), h AS (SELECT *, sum(CASE WHEN poor THEN 0 ELSE 1 END) OVER (PARTITION BY "user" ORDER BY us, id) AS grp FROM g)
SELECT id, "user", CAST(sum(CASE WHEN poor THEN 1 ELSE 0 END) OVER (PARTITION BY "user", grp ORDER BY us, id) AS BIGINT) AS poor_run FROM h""")
def poor_runs(s: SparkSession, d: str) -> DataFrame:
    return S.consecutive_poor(event_stream(s, d), "user", ["us", "id"], F.col("value") < 40).select("id", "user", F.col("poor_run").cast("long").alias("poor_run"))


@query(f"WITH {SQL_EMBEDDED} SELECT label, round(sqrt(avg(CAST(x * x + y * y + z * z AS DOUBLE))), 6) AS rms FROM emb GROUP BY label")
def rms_errors(s: SparkSession, d: str) -> DataFrame:
    e = (F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).cast("double")
    return points_embedded(s, d).groupBy("label").agg(F.round(F.sqrt(F.avg(e)), 6).alias("rms"))
