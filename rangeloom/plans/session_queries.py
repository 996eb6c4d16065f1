"""Queries over devices, sessions and grids: what is read, kept, begun anew, and told; each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.functions import device as D
from rangeloom.functions import points as P
from rangeloom.operators import ordered as O
from rangeloom.operators import retention as R
from rangeloom.sources.tables import SQL_EMBEDDED, SQL_EVENTS, SQL_ITEMS, event_stream, points_embedded, points_items, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
DAY = 86_400_000_000


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 9 AS code, '3.3.0.' || (s_suppkey % 8) AS firmware FROM supplier)
SELECT s_suppkey, code IN (0, 1, 2, 3, 6, 7) AS known, CAST(CASE WHEN code IN (2, 3, 7) THEN 4167 ELSE 10000 END AS BIGINT) AS firing_ns, CAST(code = 1 AND firmware IN ('3.3.0.1', '3.3.0.6') AS BIGINT) AS profile FROM s""")
def device_types(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 9).alias("code"), F.concat(F.lit("3.3.0."), (F.col("s_suppkey") % 8).cast("string")).alias("firmware"))
    return t.select("s_suppkey", D.known_device(F.col("code")).alias("known"), D.firing_ns(F.col("code")).alias("firing_ns"), D.record_profile(F.col("code"), F.col("firmware")).alias("profile"))


_IP = "[10, 127, 192, 169, 0][1 + c_custkey % 5] || '.' || [0, 254, 168][1 + c_custkey % 3] || '.' || (c_custkey % 4) || '.' || (c_custkey % 300)"


@query(f"""WITH t AS (SELECT c_custkey, {_IP} AS text FROM customer), v AS (SELECT *, string_split(text, '.') AS p FROM t), n AS (SELECT c_custkey, text,
CASE WHEN CAST(p[4] AS BIGINT) < 256 THEN ((CAST(p[1] AS BIGINT) * 256 + CAST(p[2] AS BIGINT)) * 256 + CAST(p[3] AS BIGINT)) * 256 + CAST(p[4] AS BIGINT) END AS a FROM v)
SELECT c_custkey, a AS address, a <> 0 AND a >> 24 <> 127 AND a >> 16 <> 43518 AS reachable, a >> 16 = (192 << 8) + 168 AS local,
CASE WHEN a IS NOT NULL THEN (a >> 24) || '.' || ((a >> 16) & 255) || '.' || ((a >> 8) & 255) || '.' || CASE WHEN a & 255 = 50 THEN 51 ELSE 50 END END AS host FROM n""")
def addresses(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int")).cast("string")
    text = F.concat_ws(".", pick((10, 127, 192, 169, 0), k % 5), pick((0, 254, 168), k % 3), (k % 4).cast("string"), (k % 300).cast("string"))
    t = table(s, d, "customer").select("c_custkey", D.ipv4(text).alias("address"))
    a = F.col("address")
    host = F.when(a.isNotNull(), D.ipv4_text(D.host_beside(a)))
    return t.select("c_custkey", "address", D.reachable(a).alias("reachable"), D.same_subnet(a, F.lit((192 << 24) + (168 << 16)), F.lit(16)).alias("local"), host.alias("host"))


@query(f"WITH {SQL_ITEMS} SELECT \"order\", line FROM li WHERE tag = 0 AND ((1 << CAST(ret AS INTEGER)) & 2) <> 0 AND x*x + y*y + z*z <= 64000000")
def registration_filter(s: SparkSession, d: str) -> DataFrame:
    """Clean returns of the masked kinds inside the range that registration takes; the return number is not folded."""
    mask = F.pow(F.lit(2.0), F.col("ret")).cast("long")
    return points_items(s, d).where((F.col("tag") == 0) & (mask.bitwiseAND(F.lit(2).cast("long")) != 0) & (P.range2() <= 8000**2)).select("order", "line")


@query(f"""WITH {SQL_EVENTS}, f AS (SELECT "user", min(us) AS t0 FROM ev GROUP BY 1) SELECT e.id, e."user" FROM ev e JOIN f ON e."user" = f."user" WHERE e.us < f.t0 + {3 * DAY}""")
def head_by_time(s: SparkSession, d: str) -> DataFrame:
    e = event_stream(s, d)
    return e.join(e.groupBy("user").agg(F.min("us").alias("t0")), "user").where(F.col("us") < F.col("t0") + 3 * DAY).select("id", "user")


@query(f"WITH {SQL_ITEMS} SELECT \"order\", line, x, y, z FROM li WHERE x*x + y*y + z*z > 250000 AND x*x + y*y + z*z < 49000000")
def fit_range(s: SparkSession, d: str) -> DataFrame:
    return points_items(s, d).where((P.range2() > 500**2) & (P.range2() < 7000**2)).select("order", "line", "x", "y", "z")


_DIMS, _SIZE, _ORIGIN = (9, 8, 7), 500, (-2000, -2000, -1500)
_CELL = ", ".join(f"CAST(floor(({c} - ({o})) / {float(_SIZE)}) AS BIGINT) AS {n}" for c, o, n in zip("xyz", _ORIGIN, "ijk"))
_FLAT = f"CASE WHEN i >= 0 AND j >= 0 AND k >= 0 AND i < {_DIMS[0]} AND j < {_DIMS[1]} AND k < {_DIMS[2]} THEN (k * {_DIMS[1]} + j) * {_DIMS[0]} + i ELSE -1 END"


def _dense(s: SparkSession, d: str) -> DataFrame:
    p = points_embedded(s, d)
    cell = [F.floor((F.col(c) - o) / float(_SIZE)) for c, o in zip("xyz", _ORIGIN)]
    return p.select("id", "label", D.flat_cell(cell, _DIMS).alias("flat"))


@query(f"WITH {SQL_EMBEDDED}, c AS (SELECT id, {_CELL} FROM emb) SELECT id, {_FLAT} AS flat FROM c")
def dense_cells(s: SparkSession, d: str) -> DataFrame:
    return _dense(s, d).select("id", "flat")


@query(f"""WITH {SQL_EMBEDDED}, c AS (SELECT id, label, {_CELL} FROM emb), f AS (SELECT label, {_FLAT} AS flat FROM c), g AS (SELECT flat, max(label % 4) AS code FROM f WHERE flat >= 0 GROUP BY 1)
SELECT flat, {_ORIGIN[0]} + (flat % {_DIMS[0]} + 0.5) * {_SIZE} AS x, {_ORIGIN[1]} + (flat // {_DIMS[0]} % {_DIMS[1]} + 0.5) * {_SIZE} AS y, {_ORIGIN[2]} + (flat // {_DIMS[0] * _DIMS[1]} + 0.5) * {_SIZE} AS z FROM g WHERE code = 3""".replace("+ 0.5)", "+ CAST(0.5 AS DOUBLE))"))
def centres_by_code(s: SparkSession, d: str) -> DataFrame:
    coded = _dense(s, d).where("flat >= 0").groupBy("flat").agg(F.max(F.col("label") % 4).alias("code")).where("code = 3")
    return coded.select("flat", *[c.alias(n) for c, n in zip(D.flat_centre(F.col("flat"), _DIMS, _ORIGIN, float(_SIZE)), "xyz")])


@query(f"""WITH {SQL_EVENTS} SELECT id, us, row_number() OVER (ORDER BY us, id) - 1 AS place FROM ev""")
def total_order(s: SparkSession, d: str) -> DataFrame:
    return R.places(event_stream(s, d).select("id", "us"), "us", "id")


@query(f"""WITH {SQL_EVENTS} SELECT id, us, "user" FROM ev ORDER BY us DESC, id DESC LIMIT 700""")
def ring_retention(s: SparkSession, d: str) -> DataFrame:
    return R.ring(event_stream(s, d).select("id", "us", "user"), ["us", "id"], 700)


@query(f"""WITH {SQL_EVENTS}, n AS (SELECT *, max(us) OVER (PARTITION BY "user") AS newest FROM ev), r AS (SELECT id, "user", row_number() OVER (PARTITION BY "user" ORDER BY us DESC, id DESC) - 1 AS age FROM n WHERE newest - us <= {9 * DAY})
SELECT * FROM r WHERE age < 6""")
def recent_history(s: SparkSession, d: str) -> DataFrame:
    return R.history(event_stream(s, d).select("id", "us", "user"), "user", "us", ["us", "id"], 6, 9 * DAY).select("id", "user", "age")


@query(f"""WITH {SQL_EVENTS}, c AS (SELECT id, "user", us % {5 * DAY} AS t FROM ev), l AS (SELECT *, lag(t) OVER (PARTITION BY "user" ORDER BY id) AS last FROM c), f AS (SELECT *, coalesce(t < last - {DAY // 2}, false) AS fell FROM l)
SELECT id, "user", CAST(sum(CAST(fell AS BIGINT)) OVER w AS BIGINT) AS epoch, CAST(t + sum(CASE WHEN fell THEN last - t ELSE 0 END) OVER w AS BIGINT) AS rebased FROM f WINDOW w AS (PARTITION BY "user" ORDER BY id ROWS UNBOUNDED PRECEDING)""")
def clock_epochs(s: SparkSession, d: str) -> DataFrame:
    e = event_stream(s, d).select("id", "user", (F.col("us") % (5 * DAY)).alias("t"))
    return R.epochs(e, "user", "id", "t", DAY // 2).select("id", "user", "epoch", "rebased")


@query(f"""WITH {SQL_EVENTS}, r AS (SELECT id, "user", id % 3 AS generation FROM ev), c AS (SELECT "user", max(generation) AS now FROM r GROUP BY 1), m AS (SELECT r.*, now FROM r JOIN c ON r."user" = c."user"),
n AS (SELECT "user", count(*) FILTER (WHERE generation < now) AS dropped FROM m GROUP BY 1) SELECT m.id, m."user", n.dropped FROM m JOIN n ON m."user" = n."user" WHERE generation = now""")
def current_generation(s: SparkSession, d: str) -> DataFrame:
    r = event_stream(s, d).select("id", "user", (F.col("id") % 3).alias("generation"))
    return R.of_generation(r, r.groupBy("user").agg(F.max("generation").alias("generation")), "user").select("id", "user", "dropped")


@query(f"""WITH {SQL_EVENTS}, n AS (SELECT max(us) AS now FROM ev), l AS (SELECT "user", max(us) AS last FROM ev GROUP BY 1), m AS (SELECT "user", last, CAST(floor((now - last) / {float(DAY)}) AS BIGINT) AS missed FROM l, n)
SELECT "user", last, missed, missed < 3 AS connected FROM m""")
def liveness(s: SparkSession, d: str) -> DataFrame:
    e = event_stream(s, d)
    return R.liveness(e, "user", "us", e.agg(F.max("us")).scalar(), DAY, 3)


@query(f"""WITH {SQL_EVENTS}, m AS (SELECT id, CASE id % 6 WHEN 0 THEN '{{"cmd": "reset", "budget": ' || id || '}}' WHEN 1 THEN '{{"budget": ' || (id * 1000) || '}}' WHEN 2 THEN '{{"cmd": 7}}' WHEN 3 THEN '[1, 2]' WHEN 4 THEN 'no json {{' ELSE '{{"cmd": "color", "budget": "all"}}' END AS text FROM ev),
j AS (SELECT id, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS v FROM m), o AS (SELECT id, coalesce(json_type(v) = 'OBJECT', false) AS object, v FROM j)
SELECT id, object, CASE WHEN object AND json_type(v, '$.cmd') = 'VARCHAR' THEN v ->> '$.cmd' END AS cmd,
CASE WHEN object AND json_type(v, '$.budget') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN least(greatest(CAST(v ->> '$.budget' AS BIGINT), 20000), 1000000) END AS budget FROM o""")
def commands(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id").cast("string")
    text = (
        F.when(F.col("id") % 6 == 0, F.concat(F.lit('{"cmd": "reset", "budget": '), i, F.lit("}"))).when(F.col("id") % 6 == 1, F.concat(F.lit('{"budget": '), (F.col("id") * 1000).cast("string"), F.lit("}")))
        .when(F.col("id") % 6 == 2, '{"cmd": 7}').when(F.col("id") % 6 == 3, "[1, 2]").when(F.col("id") % 6 == 4, "no json {").otherwise('{"cmd": "color", "budget": "all"}')
    )
    said = event_stream(s, d).select("id", text.alias("text"))
    return said.select("id", *[c.alias(n) for c, n in zip(R.commands(F.col("text")), ("object", "cmd", "budget"))])


def _channel(own: float, k: str) -> str:
    h = f"(({k} * CAST({D.HUE_STEP} AS DOUBLE) + CAST({D.HUE_START} AS DOUBLE)) - floor({k} * CAST({D.HUE_STEP} AS DOUBLE) + CAST({D.HUE_START} AS DOUBLE))) * 6.0"
    away = f"least(abs({h} - {own}), 6.0 - abs({h} - {own}))"
    return f"round(1.0 - CAST({D.SATURATION} AS DOUBLE) * least(greatest({away} - 1.0, 0.0), 1.0), 6)"


_PALETTE = [f"CAST([{', '.join(str(c[i]) for c in D.PALETTE)}][1 + least(id % 9, 6)] AS DOUBLE)" for i in range(3)]


@query(f"""WITH {SQL_EMBEDDED} SELECT id, {', '.join(f'{p} AS p{c}' for p, c in zip(_PALETTE, 'rgb'))}, {', '.join(f'{_channel(own, "id")} AS h{c}' for own, c in zip((0.0, 2.0, 4.0), 'rgb'))} FROM emb""")
def class_colors(s: SparkSession, d: str) -> DataFrame:
    p, h = D.palette(F.col("id") % 9), D.hue(F.col("id"))
    return points_embedded(s, d).select("id", *[c.alias(f"p{n}") for c, n in zip(p, "rgb")], *[F.round(c, 6).alias(f"h{n}") for c, n in zip(h, "rgb")])


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[5] AS DOUBLE) AS b, CAST(embedding[6] AS DOUBLE) AS c FROM embeddings),
u AS (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM e), w AS (SELECT id, a, b, c, y / n AS vx, -x / n AS vy, 1.0 / (1.0 + z / n) AS k FROM u)
SELECT id, round(a + vy * c + k * (vx * (vx * a + vy * b) - (vx*vx + vy*vy) * a), 6) AS x, round(b - vx * c + k * (vy * (vx * a + vy * b) - (vx*vx + vy*vy) * b), 6) AS y, round(c + vx * b - vy * a - k * (vx*vx + vy*vy) * c, 6) AS z FROM w""")
def turned_up(s: SparkSession, d: str) -> DataFrame:
    """Numbers four to six of each vector, turned by the rotation that takes its first three onto the vertical."""
    get = lambda k: F.get("embedding", F.lit(k)).cast("double")
    out = D.turn_onto([get(3), get(4), get(5)], [get(0), get(1), get(2)], (0.0, 0.0, 1.0))
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), *[F.round(c, 6).alias(n) for c, n in zip(out, "xyz")])


@query("""WITH f AS (SELECT o_custkey AS scan, o_orderkey AS start, o_totalprice / 500000.0 AS fit, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS plain FROM orders),
b AS (SELECT scan, start, fit FROM f QUALIFY row_number() OVER (PARTITION BY scan ORDER BY fit DESC, start) = 1), p AS (SELECT scan, start, fit FROM f WHERE plain)
SELECT p.scan, CASE WHEN b.fit > p.fit + 0.2 THEN b.start ELSE p.start END AS start, round(CASE WHEN b.fit > p.fit + 0.2 THEN b.fit ELSE p.fit END, 6) AS fit FROM p JOIN b ON b.scan = p.scan""")
def best_start(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    fits = table(s, d, "orders").select(F.col("o_custkey").alias("scan"), F.col("o_orderkey").alias("start"), (F.col("o_totalprice") / 500000.0).alias("fit"), (F.col("o_orderkey") == F.min("o_orderkey").over(w)).alias("plain"))
    return R.best_start(fits, "scan", "plain", "fit", "start", 0.2).select("scan", "start", F.round("fit", 6).alias("fit"))


@query(f"""WITH {SQL_EMBEDDED}, a AS (SELECT CAST(floor(z / 100.0) AS BIGINT) AS bin, count(*) AS n FROM emb WHERE label % 2 = 0 GROUP BY 1), b AS (SELECT CAST(floor(x / 100.0) AS BIGINT) AS bin, count(*) AS n FROM emb WHERE label % 2 = 1 GROUP BY 1)
SELECT b.bin - a.bin AS shift, CAST(sum(a.n * b.n) AS BIGINT) AS score FROM a JOIN b ON b.bin - a.bin BETWEEN -15 AND 15 GROUP BY 1""")
def height_shifts(s: SparkSession, d: str) -> DataFrame:
    """How well one height profile lies on another at each shift; peaks far enough apart are taken from it by `retention.apart`."""
    p = points_embedded(s, d)
    profile = lambda rows, c: rows.groupBy(F.floor(F.col(c) / 100.0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return R.shift_scores(profile(p.where("label % 2 = 0"), "z"), profile(p.where("label % 2 = 1"), "x"), "bin", "n", 15).select(F.col("shift").cast("long").alias("shift"), "score")


@query(f"""WITH {SQL_EMBEDDED}, c AS (SELECT DISTINCT CAST(floor(x / 400.0) AS BIGINT) AS i, CAST(floor(y / 400.0) AS BIGINT) AS j, CAST(floor(z / 400.0) AS BIGINT) AS k, label % 5 = 0 AS hit FROM emb), a AS (SELECT DISTINCT i, j, k FROM c), o AS (SELECT DISTINCT i, j, k FROM c WHERE hit)
SELECT a.i, a.j, a.k, min((a.i-o.i)*(a.i-o.i) + (a.j-o.j)*(a.j-o.j) + (a.k-o.k)*(a.k-o.k)) AS d2 FROM a LEFT JOIN o ON abs(a.i-o.i) <= 3 AND abs(a.j-o.j) <= 3 AND abs(a.k-o.k) <= 3 GROUP BY ALL""")
def distance_field(s: SparkSession, d: str) -> DataFrame:
    c = points_embedded(s, d).select(*[F.floor(F.col(x) / 400.0).alias(n) for x, n in zip("xyz", "ijk")], "label")
    return R.distances_to(c.select("i", "j", "k").distinct(), c.where("label % 5 = 0"), 3)


@query("""WITH v AS (SELECT p_partkey AS id, p_size AS n, p_retailprice / 1000000.0 AS smallest, p_partkey % 3 AS tight, p_size * p_size / 10000.0 AS d2 FROM part), w AS (SELECT id, n >= 5 AND tight <= 1 AND smallest < 0.09 / 12 AS known, smallest, pow(1 + d2 / 0.01, -2) AS r FROM v)
SELECT id, round(r * CASE WHEN known THEN 1 / (smallest + 0.0001) ELSE 0.05 / (0.0625 + 0.0001) END, 6) AS strict, round(r * CASE WHEN known THEN 0.05 / (smallest + 0.0001) ELSE 0.05 / (0.0625 + 0.0001) END, 6) AS loose FROM w""".replace("0.0001", "CAST(0.0001 AS DOUBLE)").replace("1000000.0", "CAST(1000000.0 AS DOUBLE)"))
def voxel_weights(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    got = D.voxel_weight(F.col("p_size"), F.col("p_retailprice") / 1000000.0, F.col("p_partkey") % 3, 0.5, 0.01, F.col("p_size") * F.col("p_size") / 10000.0, 0.1)
    return p.select(F.col("p_partkey").alias("id"), *[F.round(c, 6).alias(n) for c, n in zip(got, ("strict", "loose"))])


@query(f"""WITH {SQL_EVENTS}, l AS (SELECT id, us, value, lag(us) OVER w AS t0, lag(value) OVER w AS v0 FROM ev WINDOW w AS (PARTITION BY "user" ORDER BY us, id))
SELECT id, round(abs(value - v0) / ((us - t0) / 3600000000.0), 6) AS speed, round(value + (value - v0), 6) AS predicted, abs(value - v0) <= 1.0 + 0.5 * (us - t0) / 3600000000.0 AND abs(value) <= 20.0 + 10.0 * (us - t0) / 3600000000.0 AS near FROM l WHERE us > t0""")
def prediction(s: SparkSession, d: str) -> DataFrame:
    """Speed since the row before, the place a step on, and whether a pose found now may be the one before: hours as seconds."""
    w = Window.partitionBy("user").orderBy("us", "id")
    e = event_stream(s, d).withColumns({"t0": F.lag("us").over(w), "v0": F.lag("value").over(w)}).where("us > t0")
    step, since = F.col("value") - F.col("v0"), (F.col("us") - F.col("t0")) / 3600000000.0
    return e.select("id", F.round(F.abs(step) / since, 6).alias("speed"), F.round(F.col("value") + step, 6).alias("predicted"), R.near_last_good(F.abs(step), F.abs("value"), since).alias("near"))


@query(f"""WITH {SQL_EVENTS}, k AS (SELECT o_custkey AS "user", epoch_us(o_orderdate) AS key, max(o_totalprice) AS price FROM orders GROUP BY 1, 2), b AS (SELECT e.id, e."user", e.us, k.key, k.price FROM ev e ASOF LEFT JOIN k ON e."user" = k."user" AND e.us >= k.key),
f AS (SELECT e.id, k.key AS key2, k.price AS price2 FROM ev e ASOF LEFT JOIN k ON e."user" = k."user" AND e.us <= k.key)
SELECT b.id, b."user", round(CASE WHEN key IS NULL THEN price2 WHEN key2 IS NULL OR key2 = key THEN price ELSE price + (us - key) / CAST(key2 - key AS DOUBLE) * (price2 - price) END, 4) AS price FROM b JOIN f ON b.id = f.id""")
def pose_between(s: SparkSession, d: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', o_orderdate)")
    keys = table(s, d, "orders").groupBy(F.col("o_custkey").alias("user"), us.alias("key")).agg(F.max("o_totalprice").alias("price"))
    return R.between(event_stream(s, d).select("id", "us", "user"), keys, "user", "us", "key", "price").select("id", "user", F.round("price", 4).alias("price"))


_SLOPE = """CASE WHEN n < 2 OR ttt <= 1e-9 THEN 0.0 ELSE ttv / ttt END"""


@query(f"""WITH {SQL_EVENTS}, b AS (SELECT *, (us - min(us) OVER (PARTITION BY "user")) / 1e6 AS t FROM ev), s AS (SELECT id, count(*) OVER w AS n, sum(t) OVER w AS st, sum(value) OVER w AS sv, sum(t*t) OVER w AS stt, sum(t*value) OVER w AS stv, sum(value*value) OVER w AS svv
FROM b WINDOW w AS (PARTITION BY "user" ORDER BY us RANGE BETWEEN {10 * DAY} PRECEDING AND CURRENT ROW)), c AS (SELECT id, n, stt - st*st/n AS ttt, stv - st*sv/n AS ttv, svv - sv*sv/n AS tvv FROM s), v AS (SELECT *, {_SLOPE} AS slope FROM c),
e AS (SELECT *, CASE WHEN n < 3 OR ttt <= 1e-9 THEN 0.0 ELSE sqrt(greatest(tvv - slope * ttv, 0.0) / greatest(n - 2, 1) / ttt) END AS error FROM v) SELECT id, n, round(error, 6) AS error, abs(slope) >= 2 * error AS moving FROM e""")
def velocity_gate(s: SparkSession, d: str) -> DataFrame:
    """The standard error of each windowed slope, and whether it is significant."""
    return O.velocity(event_stream(s, d), "user", 10 * DAY).select("id", "n", F.round("error", 6).alias("error"), "moving")
