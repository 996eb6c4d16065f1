"""Solvers against what the simulated scenes were made with."""

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from rangeloom.operators import priormap, solvers
from rangeloom.plans import fold_queries
from rangeloom.sources import simulated

LO, HI = (-2.0, -4.0, -1.3), (14.0, 4.5, 2.6)


def test_pattern_rates(spark):
    got = sorted(r.hz for r in fold_queries.pattern_rates(spark, DATA).collect())
    assert got == pytest.approx([-77.78, 121.64], abs=0.05)


def test_occupancy_knows_walls_from_air(spark):
    f = fold_queries.occupancy_field(spark, DATA)
    assert f.where("hits >= 3").agg(F.avg("occupied")).first()[0] > 0.6
    assert f.where("hits = 0 AND passes >= 5").agg(F.max("occupied")).first()[0] < 0.2


def test_normals_and_levels_of_a_room(spark):
    tls = simulated.stations(spark, [(1.0, 0.5, 0.2), (8.5, -1.5, 0.2)], 180, 60, LO, HI)
    mm = tls.select(*[F.rint(F.col(c) * 1000).cast("long").alias(c) for c in "xyz"])
    surface = priormap.build(mm, 150, 500).cache()
    floor = surface.where("z < -1290 AND x BETWEEN 0 AND 9 * 1000 AND y BETWEEN -2000 AND 3000 AND planarity > 0.5")
    assert floor.count() > 100 and floor.agg(F.avg(F.abs("nz"))).first()[0] > 0.95
    near = [r.level for r in priormap.levels(surface, 20, 50).collect()]
    assert any(abs(v + 1300) < 40 for v in near)


def test_every_fold_query_has_rows(spark):
    for name in ("ray_cells", "visibility_counts", "tracker", "clock_fold", "prior_normals"):
        assert fold_queries.QUERIES[name](spark, DATA).count() > 0


def test_interpolation_uniqueness_and_adam():
    q = lambda a: [0.0, 0.0, np.sin(a / 2), np.cos(a / 2)]
    poses = np.array([[0, 0, 0, *q(0)], [2, 0, 0, *q(1.0)], [2, 4, 0, *q(2.0)]])
    got = solvers.interpolate(np.array([0.0, 1.0, 2.0]), poses, np.array([-1.0, 0.5, 1.25, 9.0]))
    assert got[:, 0].tolist() == [0, 1, 2, 2] and got[2, 1] == 1 and got[1, 5] == pytest.approx(np.sin(0.25))
    a, b = solvers.pose_of(0, 0, 0, 0), solvers.pose_of(5000, 0, 0, 0)
    assert solvers.is_unique([(a, [0, 0, 0.9]), (b, [0, 0, 0.3])]) and not solvers.is_unique([(a, [0, 0, 0.9]), (b, [0, 0, 0.85])]) and not solvers.is_unique([(a, [0, 0, 0.2])])
    x = solvers.adam(lambda v: 2 * (v - np.array([3.0, -1.0])), np.zeros(2), 400, 0.1, 0.001)
    assert x == pytest.approx([3, -1], abs=0.02)


def test_localisation_finds_the_start(spark):
    scan = simulated.scan(spark, 3000)
    mm = scan.select("id", *[F.rint(F.col(c) * 1000).cast("long").alias(c) for c in "xyz"])
    n = lambda *v: F.array(*map(F.lit, v))
    face = F.when((F.abs(F.col("y") - 4500) < 30) | (F.abs(F.col("y") + 4000) < 30), n(0.0, 1.0, 0.0)).when((F.abs(F.col("z") + 1300) < 30) | (F.abs(F.col("z") - 2600) < 30), n(0.0, 0.0, 1.0)).when(F.abs(F.col("x") - 14000) < 30, n(1.0, 0.0, 0.0))
    surface = mm.withColumn("n", face).where("n IS NOT NULL").select("id", "x", "y", "z", *[F.get("n", F.lit(k)).alias(f"n{c}") for k, c in enumerate("xyz")]).cache()
    found = solvers.localise(surface.select("id", "x", "y", "z").where("id % 20 = 0"), surface, [(0, 0, 0, 0.5), (60, -40, 20, 0.01), (900, 500, 0, 0.0)], 300, keep=1, rounds=3)
    away, turn = solvers.G.pose_difference(found[0][0], np.eye(4))
    assert away < 40 and turn < 0.5 and found[0][1][-1] > 0.9
