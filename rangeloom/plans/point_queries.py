"""Queries over the point views: filters, voxels, neighbours, clusters, ground; each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions import points as P
from rangeloom.operators import clusters as C
from rangeloom.operators import neighbours as N
from rangeloom.operators import voxels as V
from rangeloom.sources.tables import SQL_EMBEDDED, SQL_ITEMS, points_embedded, points_items, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


E_, L_ = f"WITH {SQL_EMBEDDED}", f"WITH {SQL_ITEMS}"
FILTER = "x*x + y*y + z*z BETWEEN 1000000 AND 100000000 AND refl >= 30 AND (7 >> CAST(tag % 4 AS INTEGER)) & 1 = 1 AND (3 >> CAST(ret % 4 AS INTEGER)) & 1 = 1"
FILTER2 = FILTER.replace("(7 >>", "(3 >>")


def _filtered(s: SparkSession, d: str) -> DataFrame:
    return points_items(s, d).where(P.raw_filter(1000, 10000, 30, 3, 3))


def key_sql(size: int, x: str = "x", y: str = "y", z: str = "z") -> str:
    part = lambda v: f"(CAST(floor({v} / {float(size)}) AS BIGINT) + 1048576)"
    return f"(({part(x)} << 42) | ({part(y)} << 21) | {part(z)})"


def cell_sql(key: str) -> list[str]:
    return [f"((({key}) >> {s}) & 2097151) - 1048576" for s in (42, 21, 0)]


@query(f"""{L_}, a AS (SELECT "order", line, refl | (tag << 8) | (ret << 16) | (CAST(1 AS BIGINT) << 24) AS attr FROM li)
SELECT "order", line, attr, attr & 255 AS refl, (attr >> 8) & 255 AS tag, (attr >> 16) & 255 AS ret, (attr >> 24) & 255 AS dev FROM a""")
def attr_unpack(s: SparkSession, d: str) -> DataFrame:
    packed = points_items(s, d).select("order", "line", P.pack_attr(F.col("refl"), F.col("tag"), F.col("ret"), F.lit(1).cast("long")).alias("attr"))
    return packed.select("*", *[c.alias(n) for n, c in P.unpack_attr(F.col("attr")).items()])


@query(f"{L_} SELECT * FROM li WHERE {FILTER2}")
def point_filter(s: SparkSession, d: str) -> DataFrame:
    return _filtered(s, d)


@query(f"{L_} SELECT * FROM li WHERE tag = 0 AND x*x + y*y + z*z > 90000")
def clean_returns(s: SparkSession, d: str) -> DataFrame:
    return points_items(s, d).where((F.col("tag") == 0) & (P.range2() > 300**2))


@query(f"{E_} SELECT * FROM emb WHERE x BETWEEN -1000 AND 1500 AND y BETWEEN -500 AND 2000 AND z BETWEEN -1500 AND 1500")
def crop_box(s: SparkSession, d: str) -> DataFrame:
    return points_embedded(s, d).where(P.crop((-1000, -500, -1500), (1500, 2000, 1500)))


@query(f"""{L_} SELECT {key_sql(500)} AS key, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(z) AS BIGINT) AS sz, CAST(sum(refl) AS BIGINT) AS srefl,
min(day) AS first, max(day) AS last FROM li WHERE {FILTER2} GROUP BY 1 HAVING count(*) >= 3""")
def voxel_aggregate(s: SparkSession, d: str) -> DataFrame:
    return V.aggregate(_filtered(s, d), 500, "day").where("n >= 3")


@query(f"""{L_}, p AS (SELECT *, {key_sql(500)} AS key, row_number() OVER (PARTITION BY {key_sql(500)} ORDER BY day, "order", line, x, y, z, refl, tag, ret) AS place FROM li)
SELECT key, count(*) AS n, CAST(sum(x) FILTER (WHERE place <= 8) AS BIGINT) AS sx, CAST(sum(y) FILTER (WHERE place <= 8) AS BIGINT) AS sy, CAST(sum(z) FILTER (WHERE place <= 8) AS BIGINT) AS sz,
CAST(sum(refl) FILTER (WHERE place <= 8) AS BIGINT) AS srefl, min(day) AS first, max(day) AS last FROM p GROUP BY key""")
def voxel_cap(s: SparkSession, d: str) -> DataFrame:
    return V.aggregate(points_items(s, d), 500, "day", 8, ["day", "order", "line", "x", "y", "z", "refl", "tag", "ret"])


@query(f"""{L_}, v AS (SELECT {key_sql(500)} AS key, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(refl) AS sr, min(day) AS first, max(day) AS last FROM li GROUP BY 1)
SELECT key, n, round(CAST(sx AS DOUBLE) / n, 6) AS x, round(CAST(sy AS DOUBLE) / n, 6) AS y, round(CAST(sz AS DOUBLE) / n, 6) AS z, least(CAST(floor(CAST(sr AS DOUBLE) / n + 0.5) AS BIGINT), 255) AS refl, first, last
FROM v WHERE n >= 4 AND last >= 1500""")
def map_visible(s: SparkSession, d: str) -> DataFrame:
    out = V.visible(V.aggregate(points_items(s, d), 500, "day"), 4, 1500)
    return out.withColumns({c: F.round(c, 6) for c in "xyz"})


@query(f"{E_} SELECT {key_sql(500)} AS key, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM emb GROUP BY 1")
def voxel_downsample(s: SparkSession, d: str) -> DataFrame:
    return V.downsample(points_embedded(s, d), 500).withColumns({c: F.round(c, 6) for c in "xyz"})


@query(f"{E_}, p AS (SELECT {key_sql(500)} AS key, *, row_number() OVER (PARTITION BY {key_sql(500)} ORDER BY id) AS place FROM emb) SELECT key, id, x, y, z, label FROM p WHERE place = 1")
def first_per_voxel(s: SparkSession, d: str) -> DataFrame:
    return V.first_per_voxel(points_embedded(s, d), 500, "id")


@query(f"""{E_}, r AS (SELECT {key_sql(500)} AS key, 2*x - (2*CAST(floor(x/500.0) AS BIGINT)+1)*500 AS a, 2*y - (2*CAST(floor(y/500.0) AS BIGINT)+1)*500 AS b, 2*z - (2*CAST(floor(z/500.0) AS BIGINT)+1)*500 AS c FROM emb)
SELECT key, count(*) AS n, CAST(sum(a) AS BIGINT) AS sx, CAST(sum(b) AS BIGINT) AS sy, CAST(sum(c) AS BIGINT) AS sz, CAST(sum(a*a) AS BIGINT) AS sxx, CAST(sum(a*b) AS BIGINT) AS sxy, CAST(sum(a*c) AS BIGINT) AS sxz,
CAST(sum(b*b) AS BIGINT) AS syy, CAST(sum(b*c) AS BIGINT) AS syz, CAST(sum(c*c) AS BIGINT) AS szz FROM r GROUP BY key""")
def voxel_moments(s: SparkSession, d: str) -> DataFrame:
    return V.moments(points_embedded(s, d), 500)


@query(f"{E_} SELECT id, {key_sql(250)} AS key, {', '.join(f'{c} AS {n}' for c, n in zip(cell_sql(key_sql(250)), 'ijk'))} FROM emb")
def voxel_key_unpack(s: SparkSession, d: str) -> DataFrame:
    v = V.with_voxel(points_embedded(s, d), 250).select("id", "key")
    return v.select("*", *[c.alias(n) for c, n in zip(P.voxel_cells(F.col("key")), "ijk")])


POSES = """poses AS (SELECT CAST(n_nationkey AS BIGINT) AS frame, CAST(n_regionkey AS BIGINT) AS turn, CAST(n_nationkey * 100 AS BIGINT) AS tx, CAST(n_regionkey * 50 AS BIGINT) AS ty FROM nation)"""


@query(f"""{L_}, {POSES} SELECT "order", line, frame, CASE turn % 4 WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END + tx AS wx, CASE turn % 4 WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END + ty AS wy, z AS wz
FROM li JOIN poses ON li.day % 40 = poses.frame""")
def pose_join(s: SparkSession, d: str) -> DataFrame:
    turn = (F.col("n_regionkey") % 4).cast("int")
    c, n = F.get(F.array(*map(F.lit, (1, 0, -1, 0))), turn), F.get(F.array(*map(F.lit, (0, 1, 0, -1))), turn)
    zero, one = F.lit(0), F.lit(1)
    m = F.transform(F.array(c, -n, zero, F.col("n_nationkey") * 100, n, c, zero, F.col("n_regionkey") * 50, zero, zero, one, zero), lambda v: v.cast("long"))
    poses = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("frame"), m.alias("m"))
    # Poses are one row a frame; Spark sends them to the points if they are small.
    points = points_items(s, d).withColumn("frame", F.col("day") % 40)
    w = P.transform(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    return points.join(poses, "frame").select("order", "line", "frame", *[a.alias(b) for a, b in zip(w, ("wx", "wy", "wz"))])


_S = "((id % 100) / 100.0 - 0.5)"


@query(f"""{E_}, t AS (SELECT id, x, y, z, {_S} AS s, 0.01*label*{_S} AS a FROM emb)
SELECT id, round(x * cos(a) - y * sin(a) + 12.5 * s, 6) AS x, round(x * sin(a) + y * cos(a) - 7.0 * s, 6) AS y, round(z + 3.0 * s, 6) AS z FROM t""")
def deskew_points(s: SparkSession, d: str) -> DataFrame:
    p = points_embedded(s, d).withColumn("s", F.col("id") % 100 / 100.0 - 0.5)
    moved = P.deskew([F.col(c).cast("double") for c in "xyz"], [F.lit(12.5), F.lit(-7.0), F.lit(3.0)], [F.lit(0.0), F.lit(0.0), 0.01 * F.col("label")], F.col("s"))
    return p.select("id", *[F.round(v, 6).alias(c) for v, c in zip(moved, "xyz")])


@query(f"""{L_} SELECT "order", line, refl AS intensity, z AS height, round(sqrt(CAST(x*x + y*y + z*z AS DOUBLE)), 6) AS range, 2600 - day AS age,
CASE WHEN day % 5 = 0 THEN CAST(refl AS DOUBLE) WHEN day % 5 = 1 THEN CAST(z AS DOUBLE) WHEN day % 5 = 2 THEN round(sqrt(CAST(x*x + y*y + z*z AS DOUBLE)), 6) WHEN day % 5 = 3 THEN CAST(2600 - day AS DOUBLE) ELSE 0.0 END AS scalar FROM li""")
def scalar_modes(s: SparkSession, d: str) -> DataFrame:
    mode, dist = F.col("day") % 5, F.round(F.sqrt(P.range2().cast("double")), 6)
    scalar = F.when(mode == 0, F.col("refl").cast("double")).when(mode == 1, F.col("z").cast("double")).when(mode == 2, dist).when(mode == 3, (2600 - F.col("day")).cast("double")).otherwise(F.lit(0.0))
    return points_items(s, d).select("order", "line", F.col("refl").alias("intensity"), F.col("z").alias("height"), dist.alias("range"), (2600 - F.col("day")).alias("age"), scalar.alias("scalar"))


def _poly_sql(c: tuple) -> str:
    out = str(c[5])
    for a in c[4::-1]:
        out = f"(({out}) * t + {a})"
    return f"CAST(floor(least(greatest({out}, 0.0), 1.0) * 255 + 0.5) AS BIGINT)"


@query(f"""{L_}, u AS (SELECT "order", line, CAST(refl AS DOUBLE) / 255.0 AS t FROM li), c AS (SELECT "order", line, {_poly_sql(tuple(f'CAST({x} AS DOUBLE)' for x in P.TURBO[0]))} AS r, {_poly_sql(tuple(f'CAST({x} AS DOUBLE)' for x in P.TURBO[1]))} AS g,
{_poly_sql(tuple(f'CAST({x} AS DOUBLE)' for x in P.TURBO[2]))} AS b FROM u) SELECT "order", line, r, g, b, r | (g << 8) | (b << 16) | (CAST(255 AS BIGINT) << 24) AS rgba FROM c""")
def turbo_color(s: SparkSession, d: str) -> DataFrame:
    r, g, b = P.turbo(F.col("refl").cast("double"), 0.0, 255.0)
    out = points_items(s, d).select("order", "line", r.alias("r"), g.alias("g"), b.alias("b"))
    return out.withColumn("rgba", P.pack_rgba(F.col("r"), F.col("g"), F.col("b")))


NEAREST = """nn AS (SELECT a.id, b.id AS other, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM emb a JOIN emb b ON a.label >= 5 AND b.label < 5
AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 2250000), best AS (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, other) = 1)"""


@query(f"{E_}, {NEAREST} SELECT id, other, d2 FROM best")
def nearest_neighbor(s: SparkSession, d: str) -> DataFrame:
    p = points_embedded(s, d)
    return N.nearest(p.where("label >= 5"), p.where("label < 5"), "id", 1500).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), "d2")


@query(f"""{E_}, {NEAREST} SELECT e.id, round(coalesce(sqrt(CAST(d2 AS DOUBLE)), 1000000.0), 6) AS distance, CASE WHEN coalesce(d2, 1000000000000) < 90000 THEN 'match' WHEN coalesce(d2, 1000000000000) < 360000 THEN 'near' ELSE 'new' END AS band
FROM emb e LEFT JOIN best USING (id) WHERE e.label >= 5""")
def change_bands(s: SparkSession, d: str) -> DataFrame:
    p = points_embedded(s, d)
    out = N.distances(p.where("label >= 5"), p.where("label < 5"), "id", 1500, 1e6)
    band = F.when(F.col("distance") < 300, "match").when(F.col("distance") < 600, "near").otherwise("new")
    return out.select("id", F.round("distance", 6).alias("distance"), band.alias("band"))


@query(f"""{E_} SELECT label, count(*) AS n, count(*) FILTER (WHERE d2 < 90000) AS within_300, count(*) FILTER (WHERE d2 < 250000) AS within_500, count(*) FILTER (WHERE d2 < 1000000) AS within_1000
FROM (SELECT e.id, e.label, coalesce(min((e.x-b.x)*(e.x-b.x)+(e.y-b.y)*(e.y-b.y)+(e.z-b.z)*(e.z-b.z)), 1000000000000) AS d2 FROM emb e LEFT JOIN emb b ON b.label < 5 WHERE e.label >= 5 GROUP BY 1, 2) GROUP BY label""")
def fit_fractions(s: SparkSession, d: str) -> DataFrame:
    p = points_embedded(s, d)
    out = N.distances(p.where("label >= 5"), p.where("label < 5"), "id", 1500, 1e6)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("distance") < r).alias(f"within_{r}") for r in (300, 500, 1000)])


@query(f"""{L_}, n AS (SELECT *, row_number() OVER (ORDER BY "order", line, x, y, z, refl, tag, ret, day) AS place FROM li) SELECT "order", line, x, y, z FROM n WHERE (place - 1) % 7 = 0""")
def strided_sample(s: SparkSession, d: str) -> DataFrame:
    from rangeloom.operators.ordered import prefix_offsets

    # Equal rows are one with a count, so places are known without one sorted task.
    cols = ["order", "line", "x", "y", "z", "refl", "tag", "ret", "day"]
    rows = points_items(s, d).groupBy(*cols).agg(F.count(F.lit(1)).alias("c")).withColumn("sort", F.struct(*cols))
    placed = prefix_offsets(rows, "sort", "c").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    return placed.where((F.col("offset") + F.col("at")) % 7 == 0).select("order", "line", "x", "y", "z")


VOX = f"vox AS (SELECT {key_sql(500)} AS key, CAST(floor(x/500.0) AS BIGINT) AS i, CAST(floor(y/500.0) AS BIGINT) AS j, CAST(floor(z/500.0) AS BIGINT) AS k, count(*) AS n FROM emb GROUP BY 1, 2, 3, 4)"


def _vox(s: SparkSession, d: str) -> DataFrame:
    return V.with_voxel(points_embedded(s, d), 500).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"{E_}, {VOX} SELECT key, n FROM vox a WHERE EXISTS (SELECT 1 FROM vox b WHERE b.n >= 3 AND abs(a.i-b.i)+abs(a.j-b.j)+abs(a.k-b.k) <= 1)")
def neighbor6_semi(s: SparkSession, d: str) -> DataFrame:
    return N.settled_near(_vox(s, d), F.col("n") >= 3)


@query(f"{E_}, {VOX} SELECT a.key, count(*) AS occupied, CAST(sum(b.n) AS BIGINT) AS weight, count(*) < 4 AS sparse FROM vox a JOIN vox b ON abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1 GROUP BY a.key")
def neighbor27_count(s: SparkSession, d: str) -> DataFrame:
    return N.occupied_neighbours(_vox(s, d)).withColumn("sparse", F.col("occupied") < 4)


@query(f"{E_} SELECT a.id AS a, b.id AS b, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2 FROM emb a JOIN emb b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 250000")
def radius_join(s: SparkSession, d: str) -> DataFrame:
    p = points_embedded(s, d)
    return N.radius_join(p, p, 500).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "d2")


@query(f"{E_} SELECT a.id, count(*) AS n FROM emb a JOIN emb b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 1000000 GROUP BY 1")
def neighbor_count(s: SparkSession, d: str) -> DataFrame:
    p = points_embedded(s, d)
    return N.radius_join(p, p, 1000).groupBy(F.col("a.id").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{E_}, c AS (SELECT {key_sql(300)} AS key, count(*) AS w, round(avg(x)) AS x, round(avg(y)) AS y, round(avg(z)) AS z FROM emb GROUP BY 1)
SELECT a.key, CAST(sum(b.w) AS BIGINT) AS n, count(*) AS voxels FROM c a JOIN c b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 810000 GROUP BY 1""")
def neighborhood_voxels(s: SparkSession, d: str) -> DataFrame:
    c = V.downsample(points_embedded(s, d), 300).select(F.col("key").alias("id"), F.col("n").alias("w"), *[F.round(v).alias(v) for v in "xyz"])
    near = N.radius_join(c, c, 900)
    return near.groupBy(F.col("a.id").alias("key")).agg(F.sum("b.w").alias("n"), F.count(F.lit(1)).alias("voxels"))


def _eig_sql(src: str, by: str) -> str:
    return f"""s AS (SELECT {by}, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(x*x) AS qxx, avg(x*y) AS qxy, avg(x*z) AS qxz, avg(y*y) AS qyy, avg(y*z) AS qyz, avg(z*z) AS qzz FROM {src} GROUP BY {by}),
c AS (SELECT {by}, n, qxx-mx*mx AS xx, qxy-mx*my AS xy, qxz-mx*mz AS xz, qyy-my*my AS yy, qyz-my*mz AS yz, qzz-mz*mz AS zz FROM s)"""


@query(f"""{E_}, {_eig_sql('emb', 'label')} SELECT label, n, round(xx + yy + zz, 3) AS trace FROM c""")
def covariance_trace(s: SparkSession, d: str) -> DataFrame:
    return V.covariance(points_embedded(s, d), ["label"]).select("label", "n", F.round(F.col("e1") + F.col("e2") + F.col("e3"), 3).alias("trace"))


@query(f"""{E_}, {_eig_sql('emb', 'label')}, q AS (SELECT *, (xx+yy+zz)/3 AS m, sqrt(((xx-(xx+yy+zz)/3)**2 + (yy-(xx+yy+zz)/3)**2 + (zz-(xx+yy+zz)/3)**2 + 2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM c),
h AS (SELECT *, acos(least(greatest((((xx-m)/p)*(((yy-m)/p)*((zz-m)/p) - (yz/p)*(yz/p)) - (xy/p)*((xy/p)*((zz-m)/p) - (xz/p)*(yz/p)) + (xz/p)*((xy/p)*(yz/p) - (xz/p)*((yy-m)/p)))/2, -1.0), 1.0))/3 AS phi FROM q),
e AS (SELECT label, n, m + 2*p*cos(phi) AS e1, m + 2*p*cos(phi + 2*pi()/3) AS e3, m FROM h)
SELECT label, n, round(e1, 2) AS e1, round(3*m - e1 - e3, 2) AS e2, round(e3, 2) AS e3, round(e3/(3*m), 5) AS curvature, round((3*m - e1 - 2*e3)/e1, 5) AS planarity FROM e""")
def covariance_eigen(s: SparkSession, d: str) -> DataFrame:
    out = V.covariance(points_embedded(s, d), ["label"])
    return out.select("label", "n", *[F.round(c, 2).alias(c) for c in ("e1", "e2", "e3")], *[F.round(c, 5).alias(c) for c in ("curvature", "planarity")])


GROUND = f"""p AS (SELECT *, CAST(floor(x/500.0) AS BIGINT) AS cx, CAST(floor(y/500.0) AS BIGINT) AS cy FROM li), f AS (SELECT cx, cy, min(z) AS floor_z FROM p GROUP BY 1, 2),
sup AS (SELECT p.cx, p.cy, f.floor_z FROM p JOIN f USING (cx, cy) GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE z - floor_z < 150) >= 3),
best AS (SELECT f.cx, f.cy, s.floor_z + 300 * greatest(abs(s.cx - f.cx), abs(s.cy - f.cy)) AS cost, s.floor_z FROM f JOIN sup s ON abs(s.cx - f.cx) <= 2 AND abs(s.cy - f.cy) <= 2
QUALIFY row_number() OVER (PARTITION BY f.cx, f.cy ORDER BY s.floor_z + 300 * greatest(abs(s.cx - f.cx), abs(s.cy - f.cy)), s.cy - f.cy, s.cx - f.cx) = 1),
g AS (SELECT p.*, coalesce(z - cost < 200, false) AS ground, CASE WHEN cost IS NULL THEN 0 WHEN z - cost < 200 THEN z - cost ELSE z - floor_z END AS height FROM p LEFT JOIN best USING (cx, cy))"""


@query(f"""{L_}, {GROUND} SELECT "order", line, x, y, z, ground FROM g""")
def ground_label(s: SparkSession, d: str) -> DataFrame:
    return C.ground(points_items(s, d), 500, 150, 3, 200, 300).select("order", "line", "x", "y", "z", "ground")


@query(f"""{L_}, {GROUND} SELECT ground, count(*) AS n, CAST(sum(height) AS BIGINT) AS total, CAST(max(height) AS BIGINT) AS highest FROM g GROUP BY ground""")
def height_above_ground(s: SparkSession, d: str) -> DataFrame:
    g = C.ground(points_items(s, d), 500, 150, 3, 200, 300)
    return g.groupBy("ground").agg(F.count(F.lit(1)).alias("n"), F.sum("height").alias("total"), F.max("height").alias("highest"))


COMP = f"""WITH RECURSIVE {SQL_EMBEDDED}, edges AS (SELECT a.id AS a, b.id AS b FROM emb a JOIN emb b ON a.id <> b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 250000),
reach AS (SELECT id, id AS label FROM emb UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.id AND r.label < e.b), comp AS (SELECT id, min(label) AS label FROM reach GROUP BY id)"""


@query(f"{COMP} SELECT id, label FROM comp")
def components(s: SparkSession, d: str) -> DataFrame:
    return C.point_components(points_embedded(s, d), 500)


def _clusters(s: SparkSession, d: str) -> DataFrame:
    p = points_embedded(s, d).drop("label")
    return C.statistics(p.join(C.point_components(p, 500), "id"))


STATS = """st AS (SELECT c.label, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(z) AS BIGINT) AS sz, min(x) AS lo_x, min(y) AS lo_y, min(z) AS lo_z, max(x) AS hi_x, max(y) AS hi_y, max(z) AS hi_z
FROM comp c JOIN emb USING (id) GROUP BY c.label)"""


@query(f"{COMP}, {STATS} SELECT * FROM st")
def cluster_stats(s: SparkSession, d: str) -> DataFrame:
    return _clusters(s, d)


@query(f"{COMP}, {STATS} SELECT label, n, row_number() OVER (ORDER BY label) - 1 AS cluster FROM st WHERE n >= 2")
def cluster_having(s: SparkSession, d: str) -> DataFrame:
    return C.dense_ids(_clusters(s, d), 2).select("label", "n", "cluster")


@query(f"{E_}, {VOX} SELECT key, n FROM vox a WHERE NOT EXISTS (SELECT 1 FROM vox b WHERE abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1 AND b.n > a.n)")
def local_maxima(s: SparkSession, d: str) -> DataFrame:
    return N.local_maxima(_vox(s, d)).select("key", "n")


@query(f"{E_}, {VOX} SELECT key, n, CAST(coalesce(sum(n) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM vox")
def prefix_offsets(s: SparkSession, d: str) -> DataFrame:
    from rangeloom.operators import ordered

    return ordered.prefix_offsets(_vox(s, d), "key", "n").select("key", "n", "offset")


@query(f"{L_} SELECT CAST(floor(z / 200.0) AS BIGINT) AS bin, count(*) AS n FROM li GROUP BY 1")
def height_histogram(s: SparkSession, d: str) -> DataFrame:
    return points_items(s, d).groupBy(P.cell("z", 200).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


CODES = ("unobserved", "free", "surface", "added", "removed", "transient", "uncertain", "unscanned")
CHANGE = f"""a AS (SELECT {key_sql(800)} AS key, count(*) AS was FROM emb WHERE label < 5 GROUP BY 1), b AS (SELECT {key_sql(800)} AS key, count(*) AS now FROM emb WHERE label >= 5 GROUP BY 1),
m AS (SELECT coalesce(a.key, b.key) AS key, coalesce(was, 0) AS was, coalesce(now, 0) AS now FROM a FULL JOIN b ON a.key = b.key),
k AS (SELECT key, was, now, CASE WHEN was + now < 2 THEN 'unobserved' WHEN was >= 2 AND now = 0 THEN 'removed' WHEN was = 0 AND now >= 2 THEN 'added' WHEN was >= 1 AND now >= 1 THEN 'surface' ELSE 'uncertain' END AS code FROM m)"""


def _changes(s: SparkSession, d: str) -> DataFrame:
    v = V.with_voxel(points_embedded(s, d), 800)
    side = lambda c, n: v.where(c).groupBy("key").agg(F.count(F.lit(1)).alias(n))
    m = side("label < 5", "was").join(side("label >= 5", "now"), "key", "full").fillna(0, ["was", "now"])
    code = F.when(F.expr("was + now < 2"), "unobserved").when(F.expr("was >= 2 AND now = 0"), "removed").when(F.expr("was = 0 AND now >= 2"), "added").when(F.expr("was >= 1 AND now >= 1"), "surface").otherwise("uncertain")
    return m.withColumn("code", code)


@query(f"{E_}, {CHANGE} SELECT key, was, now, code FROM k")
def change_classes(s: SparkSession, d: str) -> DataFrame:
    return _changes(s, d).select("key", "was", "now", "code")


@query(f"""{E_}, {CHANGE}, names AS (SELECT unnest({list(CODES)}) AS code) SELECT names.code, count(k.key) AS n FROM names LEFT JOIN k USING (code) GROUP BY 1""")
def class_counts(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame([(c,) for c in CODES], "code string")
    counts = _changes(s, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"{E_}, {CHANGE} SELECT key, now FROM b WHERE key NOT IN (SELECT key FROM a)")
def unmatched_anti(s: SparkSession, d: str) -> DataFrame:
    m = _changes(s, d)
    return m.where("now > 0").join(m.where("was > 0").select("key"), "key", "left_anti").select("key", "now")


@query(f"""{E_}, {CHANGE}, bad AS (SELECT (key >> 42) AS i, (key >> 21) & 2097151 AS j, key & 2097151 AS l FROM k WHERE code IN ('added', 'uncertain')),
p AS (SELECT id, {key_sql(800)} AS key FROM emb) SELECT id, EXISTS (SELECT 1 FROM bad WHERE abs(i - (p.key >> 42)) <= 1 AND abs(j - ((p.key >> 21) & 2097151)) <= 1 AND abs(l - (p.key & 2097151)) <= 1) AS masked FROM p""")
def change_mask(s: SparkSession, d: str) -> DataFrame:
    bad = _changes(s, d).where("code IN ('added', 'uncertain')").select("key")
    spread = N.neighbour_keys(bad, N.offsets()).select(F.col("near").alias("key")).distinct().withColumn("hit", F.lit(True))
    return V.with_voxel(points_embedded(s, d), 800).join(spread, "key", "left").select("id", F.coalesce("hit", F.lit(False)).alias("masked"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"


@query(f"""SELECT vec_id, score FROM (SELECT b.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings b, (SELECT embedding FROM embeddings WHERE vec_id = 0) a) ORDER BY score DESC, vec_id LIMIT 20""")
def topk_scores(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    probe = e.where("vec_id = 0").limit(1).select(F.col("embedding").alias("q"))
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return e.crossJoin(F.broadcast(probe)).select("vec_id", F.round(dot, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query(f"""{E_} SELECT id, round(sqrt(CAST(greatest(-1000 - x, x - 500, 0)**2 + greatest(-800 - y, y - 900, 0)**2 + greatest(0 - z, z - 1200, 0)**2 AS DOUBLE)), 6) AS distance FROM emb""")
def box_distance(s: SparkSession, d: str) -> DataFrame:
    return points_embedded(s, d).select("id", F.round(P.box_distance((-1000, -800, 0), (500, 900, 1200)), 6).alias("distance"))
