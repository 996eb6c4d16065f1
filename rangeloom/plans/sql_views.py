"""The point views and functions for plain SQL: `register` once, then `spark.sql`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from rangeloom.operators.rays import cells_on_ray
from rangeloom.plans.point_queries import key_sql
from rangeloom.sources import tables

FUNCTIONS = (
    "voxel_key(i BIGINT, j BIGINT, k BIGINT) RETURNS BIGINT RETURN shiftleft(i + 1048576, 42) | shiftleft(j + 1048576, 21) | (k + 1048576)",
    "cell_of(v DOUBLE, size DOUBLE) RETURNS BIGINT RETURN CAST(floor(v / size) AS BIGINT)",
    "refl_of(attr BIGINT) RETURNS BIGINT RETURN attr & 255",
    "tag_of(attr BIGINT) RETURNS BIGINT RETURN shiftright(attr, 8) & 255",
    "return_of(attr BIGINT) RETURNS BIGINT RETURN shiftright(attr, 16) & 255",
)


@udtf(returnType="step int, i long, j long, k long")
class RayCells:
    """ray_cells(ox, oy, oz, dx, dy, dz, range, size): the cells that a ray crosses, in order."""

    def eval(self, ox: float, oy: float, oz: float, dx: float, dy: float, dz: float, reach: float, size: float):  # noqa: ANN201
        for step, c in enumerate(cells_on_ray(np.array([ox, oy, oz], float), np.array([dx, dy, dz], float), float(reach), float(size)).tolist()):
            yield step, *c


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views points_embedded, points_items and event_stream beside the tables, scalar functions, and ray_cells as a table function."""
    for name in "region nation customer supplier part orders lineitem events embeddings".split():
        tables.table(spark, sf_dir, name).createOrReplaceTempView(name)
    for f in (tables.points_embedded, tables.points_items, tables.event_stream):
        f(spark, sf_dir).createOrReplaceTempView(f.__name__)
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
    spark.udtf.register("ray_cells", RayCells)


def sql_voxels(s: SparkSession, d: str) -> DataFrame:
    register(s, d)
    return s.sql("SELECT voxel_key(cell_of(x, 500), cell_of(y, 500), cell_of(z, 500)) AS key, count(*) AS n, sum(x) AS sx FROM points_embedded GROUP BY ALL HAVING n >= 2")


QUERIES = {"sql_voxels": sql_voxels}
SQL = {"sql_voxels": f"WITH {tables.SQL_EMBEDDED} SELECT {key_sql(500)} AS key, count(*) AS n, CAST(sum(x) AS BIGINT) AS sx FROM emb GROUP BY 1 HAVING count(*) >= 2"}
