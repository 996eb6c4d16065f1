"""Ordered folds, calibration and lines of sight."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.functions import calibration
from rangeloom.operators import folds, visible
from rangeloom.operators.registration import exponential


def test_late_points_join_the_open_frame(spark):
    t = [0.01, 0.05, 0.12, 0.09, 0.31, 0.15, 0.25, 9.0, 9.01, 8.0]
    got = folds.assign_frames(spark.createDataFrame([("s", k, v) for k, v in enumerate(t)], "source string, seq long, t double"), 0.1).orderBy("seq").collect()
    assert [r.frame for r in got] == [0, 0, 1, 1, 3, None, 3, 90, 90, None]


def test_smoothing_resets_on_a_jump():
    out = folds.smoothed(np.array([[1.0, 0, 0, 0, 0, 0], [1.0, 0, 0, 0, 0, 0], [2.0, 0, 0, 0, 0, 0], [1.0, 0, 0, 0, 0, 0]]))
    assert out[:, 0] == pytest.approx([0.15, 0.2775, 0, 0.15])


def test_huber_ignores_outliers():
    x = np.linspace(0, 10, 200)
    y = 0.5 * x + 1
    y[::20] += 50
    assert folds.huber_line(x, y, 0.02, 50) == pytest.approx((0.5, 1), abs=0.05)


def test_correction_is_rate_limited():
    goal = np.eye(4)
    goal[:3, :3], goal[:3, 3] = exponential(np.array([0, 0, np.radians(5)])), [1, 0, 0]
    now, reached, steps = np.eye(4), False, 0
    while not reached and steps < 200:
        now, reached = folds.step_toward(now, goal, np.zeros(3), 0.5)
        steps += 1
    assert np.allclose(now, goal, atol=1e-6) and steps in (40, 41)


def test_session_is_lost_after_three_poor_fits():
    s = folds.Session()
    seen = [s.step(k, f) for k, f in (("found", 0.2), ("found", 0.8), ("track", 0.1), ("track", 0.9), ("track", 0.1), ("track", 0.2), ("track", 0.1), ("reset", 0))]
    assert seen == ["searching", *["tracking"] * 5, "lost", "searching"]


def test_calibration_and_sight(spark):
    p = [F.lit(v) for v in (4.0, 1.0, 0.5)]
    same = spark.range(1).select(*calibration.calibrated(p, F.lit(0), (F.lit(0.1), F.lit(0.2)), [], (0.0, 0.0, 0.0))).first()
    assert list(same) == pytest.approx([4, 1, 0.5])
    far = spark.range(1).select(*calibration.calibrated(p, F.lit(7), (F.lit(0.0), F.lit(0.0)), [(1, 1, 0.01, 0.0)], (0.0, 0.0, 0.5))).first()
    assert np.linalg.norm(list(far)) == pytest.approx(np.linalg.norm([4, 1, 0.5]) + 0.5) and np.arctan2(far[1], far[0]) == pytest.approx(np.arctan2(1, 4) + 0.01)
    cells = spark.createDataFrame([(1, 4.05, 0.05, 0.05), (2, 0.05, 4.05, 0.05)], "id long, x double, y double, z double")
    stations = spark.createDataFrame([(0, 0.05, 0.05, 0.05)], "station int, x double, y double, z double")
    wall = spark.createDataFrame([(20, 0, 0)], "i long, j long, k long")
    assert [r.id for r in visible.seen_from(cells, stations, wall, 0.1).collect()] == [2]


def test_sql_functions(spark):
    from conftest import DATA

    from rangeloom.plans import sql_views

    sql_views.register(spark, DATA)
    got = spark.sql("SELECT * FROM ray_cells(0.1, 0.1, 0.1, 1.0, 0.0, 0.0, 2.5, 1.0)").collect()
    assert [(r.step, r.i, r.j, r.k) for r in got] == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 2, 0, 0)]
    assert spark.sql("SELECT refl_of(a), tag_of(a), return_of(a) FROM (SELECT 7 | (3 << 8) | (1 << 16) AS a)").first()[:] == (7, 3, 1)
