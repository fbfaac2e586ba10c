from pyspark.sql import functions as F

from keelson.functions.vectors import rounded
from keelson.operators import fusion as U
from keelson.plans import views as V
from keelson.plans.registry import query

VOXEL, TRUNCATION = 0.05, 0.15
#: Every point of a scan is seen from one of five places above it, by its label.
RAYS = "rays AS (SELECT scan_id, 0.5::DOUBLE * (label % 5) AS ox, 0.3::DOUBLE AS oy, 6.0::DOUBLE AS oz, x, y, z FROM points)"
FUSED = f"""WITH {RAYS}, lengths AS (SELECT *, sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz)) AS far, row_number() OVER () AS ray FROM rays),
  lines AS (SELECT scan_id, ray, ox, oy, oz, far, (x - ox) / far AS dx, (y - oy) / far AS dy, (z - oz) / far AS dz FROM lengths WHERE far > 0),
  met AS (SELECT DISTINCT scan_id, ray, ox, oy, oz, far, dx, dy, dz, CAST(floor((ox + (far + k * 0.025::DOUBLE) * dx) / 0.05::DOUBLE) AS BIGINT) AS ix, CAST(floor((oy + (far + k * 0.025::DOUBLE) * dy) / 0.05::DOUBLE) AS BIGINT) AS iy,
    CAST(floor((oz + (far + k * 0.025::DOUBLE) * dz) / 0.05::DOUBLE) AS BIGINT) AS iz FROM lines, range(-6, 7) t(k)),
  signed AS (SELECT scan_id, ix, iy, iz, (far - (0 + ((ix + 0.5::DOUBLE) * 0.05::DOUBLE - ox) * dx + ((iy + 0.5::DOUBLE) * 0.05::DOUBLE - oy) * dy + ((iz + 0.5::DOUBLE) * 0.05::DOUBLE - oz) * dz)) / 0.15::DOUBLE AS s FROM met),
  voxels AS MATERIALIZED (SELECT scan_id, ix, iy, iz, round(avg(least(s, 1.0::DOUBLE)), 9) AS tsdf, count(*) AS weight FROM signed WHERE round(s, 9) >= -1 GROUP BY ALL)"""


def _rays(spark, d):
    return V.points(spark, d).select("scan_id", (F.lit(0.5) * (F.col("label") % 5)).alias("ox"), F.lit(0.3).alias("oy"), F.lit(6.0).alias("oz"), "x", "y", "z")


@query("agg_fused_voxels", V.sql("points", FUSED + " SELECT scan_id, ix, iy, iz, tsdf + 0.0 AS tsdf, weight FROM voxels"))
def fused(spark, d):
    """EXT-18: the grid of truncated distances of each scan."""
    return U.fused_voxels(_rays(spark, d), ["scan_id"], VOXEL, TRUNCATION).withColumn("tsdf", F.col("tsdf") + F.lit(0.0))


@query(
    "join_fused_surface",
    V.sql(
        "points",
        FUSED
        + """, edges AS (SELECT a.scan_id, 0 AS axis, a.ix, a.iy, a.iz, a.tsdf AS a, b.tsdf AS b FROM voxels a JOIN voxels b ON b.scan_id = a.scan_id AND b.ix = a.ix + 1 AND b.iy = a.iy AND b.iz = a.iz WHERE (a.tsdf > 0) <> (b.tsdf > 0)
    UNION ALL SELECT a.scan_id, 1, a.ix, a.iy, a.iz, a.tsdf, b.tsdf FROM voxels a JOIN voxels b ON b.scan_id = a.scan_id AND b.ix = a.ix AND b.iy = a.iy + 1 AND b.iz = a.iz WHERE (a.tsdf > 0) <> (b.tsdf > 0)
    UNION ALL SELECT a.scan_id, 2, a.ix, a.iy, a.iz, a.tsdf, b.tsdf FROM voxels a JOIN voxels b ON b.scan_id = a.scan_id AND b.ix = a.ix AND b.iy = a.iy AND b.iz = a.iz + 1 WHERE (a.tsdf > 0) <> (b.tsdf > 0)),
  shares AS (SELECT *, a / (a - b) * 0.05::DOUBLE AS s FROM edges)
SELECT scan_id, CAST(axis AS INT) AS axis, ix, iy, iz, round((ix + 0.5::DOUBLE) * 0.05::DOUBLE + CASE WHEN axis = 0 THEN s ELSE 0 END, 6) + 0.0 AS x, round((iy + 0.5::DOUBLE) * 0.05::DOUBLE + CASE WHEN axis = 1 THEN s ELSE 0 END, 6) + 0.0 AS y,
  round((iz + 0.5::DOUBLE) * 0.05::DOUBLE + CASE WHEN axis = 2 THEN s ELSE 0 END, 6) + 0.0 AS z FROM shares""",
    ),
)
def surface(spark, d):
    """EXT-18: points of the fused surface of each scan."""
    s = U.fused_surface(_rays(spark, d), ["scan_id"], VOXEL, TRUNCATION)
    return s.select("scan_id", "axis", "ix", "iy", "iz", *[(rounded(c) + F.lit(0.0)).alias(c) for c in "xyz"])
