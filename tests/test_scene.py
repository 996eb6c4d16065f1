"""Operators on analytic scenes: rays, carving, registration, tracking; batch and stream agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.functions import points as P
from rangeloom.operators import rays, registration, tracking
from rangeloom.operators import voxels as V
from rangeloom.sources import simulated
from rangeloom.streaming import live


def test_ray_cells_are_the_cells_on_the_way():
    rng = np.random.default_rng(4)
    for _ in range(50):
        o, d = rng.uniform(-2, 2, 3), rng.normal(size=3)
        d /= np.linalg.norm(d)
        got = rays.cells_on_ray(o, d, 3.0, 0.25)
        t = np.linspace(0, 3.0, 60_001)[:-1]
        seen = np.floor((o + t[:, None] * d) / 0.25).astype(int)
        assert {tuple(c) for c in seen} <= {tuple(c) for c in got}
        assert (np.abs(np.diff(got, axis=0)).sum(1) == 1).all()


def test_carving_frees_a_removed_box(spark):
    scan = simulated.scan(spark, 20_000).withColumns({f"o{c}": F.lit(0.0) for c in "xyz"}).cache()
    on = lambda c, *at: sum((F.abs(F.col(c) - v) < 1e-6).cast("int") for v in at) > 0
    scan = scan.withColumn("incidence", F.when(on("y", -4.0, 4.5), F.abs("dy")).when(on("z", -1.3, 2.6), F.abs("dz")).otherwise(F.abs("dx")))
    box = spark.createDataFrame([(k, 3.0 + 0.05 * (k % 4), 0.05 * (k // 4 - 4), 0.0) for k in range(32)], "id long, x double, y double, z double")
    cells = box.select(*[F.floor(F.col(c) / 0.2).alias(n) for c, n in zip("xyz", "ijk")], "x", "y", "z").groupBy("i", "j", "k").agg(*[F.avg(c).alias(c) for c in "xyz"])
    wall = scan.where("range > 10").select(*[F.floor(F.col(c) / 0.2).alias(n) for c, n in zip("xyz", "ijk")], "x", "y", "z").groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "xyz"])
    freed = rays.carve(scan, cells, 0.2)
    assert freed.where("miss >= 4").count() >= cells.count() // 2
    gone = rays.carve(scan, wall.drop("n"), 0.2).join(wall, ["i", "j", "k"]).where(V.transient(F.col("miss"), F.col("n"), 4, 1.0))
    assert gone.count() < 0.03 * wall.count()
    seen = rays.visibility(scan.where("id < 500"), 0.5)
    assert seen.agg(F.sum("hits")).first()[0] == 500


def test_registration_recovers_a_shift(spark):
    base = simulated.scan(spark, 6_000, noise=0.005)
    mm = base.select("id", *[F.rint(F.col(c) * 1000).cast("long").alias(c) for c in "xyz"])
    face = F.when(F.abs(F.col("y") - 4500) < 30, F.array(*map(F.lit, (0.0, 1.0, 0.0)))).when(F.abs(F.col("y") + 4000) < 30, F.array(*map(F.lit, (0.0, 1.0, 0.0)))).when((F.abs(F.col("z") + 1300) < 30) | (F.abs(F.col("z") - 2600) < 30), F.array(*map(F.lit, (0.0, 0.0, 1.0)))).when(F.abs(F.col("x") - 14000) < 30, F.array(*map(F.lit, (1.0, 0.0, 0.0))))
    surface = mm.withColumn("n", face).where("n IS NOT NULL").select("id", "x", "y", "z", *[F.get("n", F.lit(k)).alias(f"n{c}") for k, c in enumerate("xyz")]).cache()
    true = np.eye(4)
    true[:3, :3], true[:3, 3] = registration.exponential(np.array([0, 0, 0.005])), [30, -20, 15]
    back = np.linalg.inv(true)
    m = back[:3].ravel().tolist()
    scan = surface.select("id", *[F.rint(m[4 * r] * F.col("x") + m[4 * r + 1] * F.col("y") + m[4 * r + 2] * F.col("z") + m[4 * r + 3]).cast("long").alias("xyz"[r]) for r in range(3)]).where("id % 4 = 0")
    pose, n = registration.icp(scan, surface, np.eye(4), 400, rounds=8)
    away, turn = registration.pose_difference(pose, true)
    assert n > 200 and away < 15 and turn < 0.15
    hyps = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0), (1, 30.0, -20.0, 15.0, 0.005), (2, 300.0, 0.0, 0.0, 0.2)], "hyp int, x double, y double, z double, yaw double")
    scores = {r.hyp: r.score for r in registration.soft_scores(hyps, scan.where("id % 40 = 0"), surface, 200).collect()}
    assert max(scores, key=scores.get) == 1


def test_small_solvers():
    q = registration.slerp(np.array([0, 0, 0, 1.0]), np.array([0, 0, np.sin(0.5), np.cos(0.5)]), 0.5)
    assert q == pytest.approx([0, 0, np.sin(0.25), np.cos(0.25)])
    rows = [(5.0, np.zeros(3), 0.0), (4.0, np.array([0.05, 0, 0]), 0.0), (3.0, np.array([1.0, 0, 0]), 0.0), (0.0, np.array([9.0, 0, 0]), 0.0)]
    assert registration.suppressed(rows, 0.1, 0.1, 5) == [0, 2]
    h, g = np.diag([1e4, 1e4, 1.0, 1e4, 1e4, 1e4]), np.ones(6)
    step, held = registration.held_step(h, g, 3000)
    assert held == 1 and step[2] == 0
    w = [float(x) for x in (1 / 6, 4 / 6, 1 / 6, 0)]
    assert w == pytest.approx(w)


def clusters(spark):
    rows = []
    for k in range(30):
        t = round(0.1 * k, 6)
        rows += [("s", t, 0, 1.0 + 0.15 * k, 0.0, 0.0, 0.5), ("s", t, 1, 5.0, 3.0, 0.0, 0.5)]
        if k < 10:
            rows.append(("s", t, 2, -4.0, 0.0, 0.0, 0.5))
    return rows, "sensor string, t double, cluster long, x double, y double, z double, extent double"


def test_tracker_batch_is_stream(spark, tmp_path):
    rows, schema = clusters(spark)
    df = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in tracking.track(df).collect())
    last = [r for r in got if r[1] == max(x[1] for x in got)]
    assert len({r[3] for r in got if r[2] == 0}) == 1 and all(r[7] for r in last)
    assert next(r for r in last if r[2] == 0)[4] == pytest.approx(1.5, rel=0.05) and next(r for r in last if r[2] == 1)[4] == 0
    for part in range(3):
        df.where((F.col("t") >= part - 1e-9) & (F.col("t") < part + 1 - 1e-9)).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live.track(stream).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(spark.table("tracked").collect()) == len(got)


def test_stream_voxels_are_batch_voxels(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") * 37 % 1000).alias("x"), (F.col("id") * 91 % 700).alias("y"), (F.col("id") * 13 % 300).alias("z"), F.col("id").alias("t"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.voxel_map(stream, 250, "t").writeStream.format("memory").queryName("voxels").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = V.aggregate(df.withColumn("refl", F.lit(0)), 250, "t").select("key", "n", "sx", "sy", "sz", "first", "last")
    assert sorted(map(tuple, spark.table("voxels").collect())) == sorted(map(tuple, want.collect()))


def test_stream_frames_and_sessions(spark, tmp_path):
    df = spark.range(500).select(F.timestamp_millis(F.col("id") * 10 + F.when(F.col("id") >= 250, 60_000).otherwise(0)).alias("ts"), F.lit(1).alias("user"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("frames", live.frames(read(), "ts")), ("spans", live.sessions(read(), "ts", "user"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r.n for r in spark.table("frames").collect()} == {10}
    assert spark.table("spans").count() >= 1


def test_point_expressions(spark):
    one = spark.range(1)
    m = P.mount_matrix(0, 0, 90, 1, 2, 3)
    got = one.select(*P.transform(F.array(*map(F.lit, m)), F.lit(1.0), F.lit(0.0), F.lit(0.0))).first()
    assert list(got) == pytest.approx([1, 3, 3])
    assert sum(one.select(*P.spline_weights(F.lit(0.3))).first()) == pytest.approx(1)
    e = one.select(*P.eigenvalues(*[F.lit(v) for v in (2.0, 0.5, 0.1, 3.0, 0.2, 1.0)])).first()
    assert list(e) == pytest.approx(np.linalg.eigvalsh([[2, 0.5, 0.1], [0.5, 3, 0.2], [0.1, 0.2, 1]])[::-1])
    with pytest.raises(Exception, match="outside"):
        one.select(P.voxel_key(F.lit(1 << 20), F.lit(0), F.lit(0))).collect()
    assert one.select(P.softplus(F.lit(0.0)), P.geman_mcclure(F.lit(4.0), 2.0)).first()[:] == pytest.approx((np.log(2), 2.0))
