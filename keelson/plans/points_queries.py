from pyspark.sql import functions as F

from keelson.functions.vectors import rounded
from keelson.operators import points as P
from keelson.operators import surfaces as S
from keelson.plans import views as V
from keelson.plans.registry import query

CENTRES = "centres AS (SELECT scan_id, label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points GROUP BY ALL)"
R = lambda *cols: ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


@query("scan_segments", V.sql("points", "SELECT scan_id, label, count(*) AS n, min(row_id) AS first_row FROM points WHERE label <> 0 GROUP BY ALL HAVING count(*) >= 50"))
def segments(spark, d):
    """SRC-01, SRC-12."""
    return P.segments(V.points(spark, d)).groupBy("scan_id", "label").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


@query("scan_exact_dedup", V.sql("points", "SELECT scan_id, count(*) AS positions, sum(n) AS rows, count(*) FILTER (WHERE k > 1) AS conflicts, sum(l) AS labels FROM (SELECT scan_id, count(*) AS n, count(DISTINCT label) AS k, arg_min(label, row_id) AS l FROM points GROUP BY scan_id, x, y, z) GROUP BY scan_id"))
def dedup(spark, d):
    """SRC-13."""
    return P.exact_dedup(V.points(spark, d)).groupBy("scan_id").agg(F.count("*").alias("positions"), F.sum("rows").alias("rows"), F.count_if("conflict").alias("conflicts"), F.sum("label").alias("labels"))


@query("agg_object_statistics", V.sql("points", f"WITH s AS (SELECT scan_id, label, count(*) AS n, count(DISTINCT (round_even(x * 1000, 0), round_even(y * 1000, 0), round_even(z * 1000, 0))) AS distinct_mm, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) AS extent FROM points GROUP BY ALL) SELECT scan_id, label, n, distinct_mm, {R('cx', 'cy', 'cz', 'extent')} FROM s"))
def objects(spark, d):
    """AGG-04, AGG-05, AGG-07, AGG-08."""
    return P.object_statistics(V.points(spark, d)).select("scan_id", "label", "n", "distinct_mm", *[rounded(c).alias(c) for c in ("cx", "cy", "cz", "extent")])


@query("agg_voxel_membership", V.sql("points", f"WITH s AS (SELECT scan_id, CAST(floor(x / 0.1) AS BIGINT) AS ix, CAST(floor(y / 0.1) AS BIGINT) AS iy, CAST(floor(z / 0.1) AS BIGINT) AS iz, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM points GROUP BY ALL) SELECT scan_id, ix, iy, iz, n, first_row, last_row, {R('x', 'y', 'z')} FROM s".replace("avg(x) AS x", "avg(points.x) AS x").replace("floor(x", "floor(points.x").replace("floor(y", "floor(points.y").replace("floor(z", "floor(points.z").replace("avg(y) AS y", "avg(points.y) AS y").replace("avg(z) AS z", "avg(points.z) AS z").replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4")))
def voxels(spark, d):
    """AGG-06."""
    v = P.voxel_aggregate(V.points(spark, d), 0.1)
    return v.select("scan_id", "ix", "iy", "iz", "n", F.element_at("rows", 1).alias("first_row"), F.element_at("rows", -1).alias("last_row"), *[rounded(c).alias(c) for c in "xyz"])


@query("agg_voxel_downsample", V.sql("points", "WITH o AS (SELECT scan_id, min(x) - 0.1 AS ox, min(y) - 0.1 AS oy, min(z) - 0.1 AS oz FROM points GROUP BY scan_id), s AS (SELECT scan_id, floor((x - ox) / 0.2) AS i, floor((y - oy) / 0.2) AS j, floor((z - oz) / 0.2) AS k, avg(x) AS mx, count(*) AS n FROM points JOIN o USING (scan_id) GROUP BY 1, 2, 3, 4) SELECT scan_id, count(*) AS cells, max(n) AS most, round(sum(mx), 4) AS mean_x FROM s GROUP BY scan_id"))
def downsample(spark, d):
    """CMP-29."""
    return P.voxel_downsample(V.points(spark, d), 0.2).groupBy("scan_id").agg(F.count("*").alias("cells"), F.max("n").alias("most"), rounded(F.sum("x"), 4).alias("mean_x"))


@query("join_voxel_iou", V.sql("points", """WITH c AS (SELECT DISTINCT scan_id, label, floor(x / 0.25) AS i, floor(y / 0.25) AS j, floor(z / 0.25) AS k FROM points), p AS (SELECT DISTINCT scan_id, label AS a, label + 10 AS b FROM points), n AS (SELECT scan_id, label, count(*) AS n FROM c GROUP BY ALL),
   m AS (SELECT x.scan_id, x.label AS a, y.label AS b, count(*) AS k FROM c x JOIN c y ON x.scan_id = y.scan_id AND y.label = x.label + 10 AND x.i = y.i AND x.j = y.j AND x.k = y.k GROUP BY ALL)
   SELECT p.scan_id, p.a, p.b, round(coalesce(m.k, 0) / (na.n + coalesce(nb.n, 0) - coalesce(m.k, 0)), 6) AS iou FROM p LEFT JOIN m USING (scan_id, a, b) JOIN n na ON na.scan_id = p.scan_id AND na.label = p.a LEFT JOIN n nb ON nb.scan_id = p.scan_id AND nb.label = p.b"""))
def iou(spark, d):
    """JOI-33."""
    p = V.points(spark, d)
    return P.voxel_iou(p, p.select("scan_id", F.col("label").alias("a"), (F.col("label") + 10).alias("b")).distinct(), 0.25).withColumn("iou", rounded("iou"))


#: Even rows against odd ones.
NN = """nn AS (SELECT s.scan_id, s.row_id AS s, min(sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2)) AS d FROM points s JOIN points t ON s.scan_id = t.scan_id AND t.label % 2 = 0 AND abs(s.x - t.x) <= 0.1 AND abs(s.y - t.y) <= 0.1 AND abs(s.z - t.z) <= 0.1
     AND sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2) <= 0.1 WHERE s.label % 2 = 1 GROUP BY ALL), bb AS (SELECT s.scan_id, s.row_id AS s, min(sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2)) AS d FROM points s JOIN points t ON s.scan_id = t.scan_id AND t.label % 2 = 1 AND abs(s.x - t.x) <= 0.1 AND abs(s.y - t.y) <= 0.1 AND abs(s.z - t.z) <= 0.1
     AND sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2 + (s.z - t.z) ** 2) <= 0.1 WHERE s.label % 2 = 0 GROUP BY ALL)"""


def _sides(spark, d):
    p = V.points(spark, d)
    shift = p.where("label % 2 = 1").withColumn("y", F.col("y") - 0.2)
    return shift, p.where("label % 2 = 0")


NN = NN.replace("points s JOIN points t ON s.scan_id = t.scan_id AND t.label % 2 = 0", "(SELECT * REPLACE (y - 0.2 AS y) FROM points WHERE label % 2 = 1) s JOIN points t ON s.scan_id = t.scan_id AND t.label % 2 = 0").replace("points s JOIN points t ON s.scan_id = t.scan_id AND t.label % 2 = 1", "points s JOIN (SELECT * REPLACE (y - 0.2 AS y) FROM points WHERE label % 2 = 1) t ON s.scan_id = t.scan_id")


@query("join_nearest_within", V.sql("points", f"WITH {NN} SELECT p.scan_id, p.row_id AS s, round(nn.d, 6) AS d FROM points p LEFT JOIN nn ON nn.scan_id = p.scan_id AND nn.s = p.row_id WHERE p.label % 2 = 1"))
def nearest(spark, d):
    """JOI-13, radius-bounded."""
    s, t = _sides(spark, d)
    return P.nearest_within(s, t, 0.1).withColumn("d", rounded("d"))


@query("agg_surface_metrics", V.sql("points", f"""WITH {NN}, f AS (SELECT p.scan_id, p.row_id AS s, nn.d FROM points p LEFT JOIN nn ON nn.s = p.row_id AND nn.scan_id = p.scan_id WHERE p.label % 2 = 1), b AS (SELECT p.scan_id, p.row_id AS s, bb.d FROM points p LEFT JOIN bb ON bb.s = p.row_id AND bb.scan_id = p.scan_id WHERE p.label % 2 = 0),
   fk AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY d NULLS LAST, s) AS k, greatest(floor(count(d) OVER (PARTITION BY scan_id) * 0.9), 1) AS keep FROM f), bk AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY d NULLS LAST, s) AS k, greatest(floor(count(d) OVER (PARTITION BY scan_id) * 0.9), 1) AS keep FROM b),
   fm AS (SELECT scan_id, avg(CASE WHEN d < 0.05 THEN 1.0 ELSE 0.0 END) AS forward_overlap, avg(d) FILTER (WHERE k <= keep) AS forward_trimmed, median(d) AS forward_median, quantile_cont(d, 0.9) AS forward_p90, sqrt(avg(d * d)) AS forward_rmse FROM fk GROUP BY scan_id),
   bm AS (SELECT scan_id, avg(CASE WHEN d < 0.05 THEN 1.0 ELSE 0.0 END) AS backward_overlap, avg(d) FILTER (WHERE k <= keep) AS backward_trimmed, median(d) AS backward_median, quantile_cont(d, 0.9) AS backward_p90, sqrt(avg(d * d)) AS backward_rmse FROM bk GROUP BY scan_id),
   m AS (SELECT *, least(forward_overlap, backward_overlap) AS least_overlap, CASE WHEN forward_overlap + backward_overlap > 0 THEN 2 * forward_overlap * backward_overlap / (forward_overlap + backward_overlap) ELSE 0 END AS f_score FROM fm JOIN bm USING (scan_id))
   SELECT scan_id, {R('forward_overlap', 'forward_trimmed', 'forward_median', 'forward_p90', 'forward_rmse', 'backward_overlap', 'backward_trimmed', 'backward_median', 'backward_p90', 'backward_rmse', 'least_overlap', 'f_score')} FROM m"""))
def surface(spark, d):
    """AGG-31 to AGG-35."""
    s, t = _sides(spark, d)
    out = P.surface_metrics(P.nearest_within(s, t, 0.1), P.nearest_within(t, s, 0.1), 0.05)
    return out.select("scan_id", *[rounded(c).alias(c) for c in out.columns[1:]])


@query("join_overlap_ratio", V.sql("points", "WITH s AS (SELECT DISTINCT scan_id, round_even(x / 0.01, 0) AS i, round_even(y / 0.01, 0) AS j, round_even(z / 0.01, 0) AS k FROM points WHERE label % 2 = 0), t AS (SELECT DISTINCT scan_id, round_even(x / 0.01, 0) AS i, round_even(y / 0.01, 0) AS j, round_even(z / 0.01, 0) AS k, 1 AS hit FROM points WHERE label % 2 = 1) SELECT scan_id, count(*) AS n, round_even(avg(coalesce(hit, 0)), 4) AS overlap FROM s LEFT JOIN t USING (scan_id, i, j, k) GROUP BY scan_id"))
def overlap(spark, d):
    """JOI-15, JOI-16, SET-05."""
    p = V.points(spark, d)
    return P.overlap_ratio(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 0.01)


@query("join_grid_membership", V.sql("points", "WITH r AS (SELECT scan_id, round_even(x / 0.02, 0) AS i, round_even(y / 0.02, 0) AS j, round_even(z / 0.02, 0) AS k, count(*) AS n, min(row_id) AS raw FROM points WHERE label % 2 = 0 GROUP BY ALL) SELECT p.scan_id, p.row_id AS picked, CASE WHEN n = 1 THEN raw END AS raw_row, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'one' END AS status FROM points p LEFT JOIN r ON r.scan_id = p.scan_id AND i = round_even(x / 0.02, 0) AND j = round_even(y / 0.02, 0) AND k = round_even(z / 0.02, 0) WHERE label % 2 = 1"))
def grid(spark, d):
    """JOI-31."""
    p = V.points(spark, d)
    return P.grid_membership(p.where("label % 2 = 1"), p.where("label % 2 = 0"), 0.02)


@query("join_box_neighbours", V.sql("points", "WITH b AS (SELECT scan_id, label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM points GROUP BY ALL) SELECT a.scan_id, a.label, b.label AS neighbour FROM b a JOIN b ON a.scan_id = b.scan_id AND a.label <> b.label WHERE a.x0 - 0.05 <= b.x1 AND b.x0 <= a.x1 + 0.05 AND a.y0 - 0.05 <= b.y1 AND b.y0 <= a.y1 + 0.05 AND a.z0 - 0.05 <= b.z1 AND b.z0 <= a.z1 + 0.05"))
def boxes(spark, d):
    """JOI-20."""
    return P.box_neighbours(V.points(spark, d), 0.05)


@query("join_nearest_objects", V.sql("points", f"WITH {CENTRES}, n AS (SELECT a.scan_id, a.label AS a, b.label AS b, row_number() OVER (PARTITION BY a.scan_id, a.label ORDER BY round((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2, 9), b.label) AS k FROM centres a JOIN centres b ON a.scan_id = b.scan_id AND a.label <> b.label) SELECT DISTINCT scan_id, least(a, b) AS low, greatest(a, b) AS high FROM n WHERE k <= 4"))
def neighbours(spark, d):
    """JOI-21, CMP-27."""
    return P.nearest_objects(P.object_statistics(V.points(spark, d)))


@query("agg_layer_conflict", V.sql("points", "WITH c AS (SELECT DISTINCT scan_id, floor(x / 0.03) AS i, floor(z / 0.03) AS k, floor(y / 0.02) AS l FROM points), b AS (SELECT DISTINCT a.scan_id, a.i, a.k FROM c a JOIN c b ON a.scan_id = b.scan_id AND a.i = b.i AND a.k = b.k AND b.l - a.l BETWEEN 2 AND 6) SELECT scan_id, count(*) AS columns, round(count(b.i) / count(*), 6) AS conflict FROM (SELECT DISTINCT scan_id, i, k FROM c) x LEFT JOIN b USING (scan_id, i, k) GROUP BY scan_id"))
def layers(spark, d):
    """AGG-36, AGG-37."""
    return P.layer_conflict(V.points(spark, d)).withColumn("conflict", rounded("conflict"))


@query("window_linspace_decimation", V.sql("points", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY scan_id, label ORDER BY row_id) - 1 AS nth, count(*) OVER (PARTITION BY scan_id, label) AS n FROM points), g AS (SELECT DISTINCT scan_id, label, n FROM x), i AS (SELECT scan_id, label, CASE WHEN n <= 30 THEN i ELSE CAST(floor(i * (n - 1) / 29) AS BIGINT) END AS nth FROM g, range(0, 1000000) r(i) WHERE i < least(n, 30)) SELECT x.scan_id, x.label, x.row_id FROM x JOIN (SELECT DISTINCT * FROM i) USING (scan_id, label, nth)".replace("range(0, 1000000)", "range(0, 30)")))
def linspace(spark, d):
    """WIN-18."""
    return P.decimate(V.points(spark, d), 30).select("scan_id", "label", "row_id")


@query("fun_normalised_cloud", V.sql("points", "WITH c AS (SELECT scan_id, label, row_id, x - avg(x) OVER w AS a, y - avg(y) OVER w AS b, z - avg(z) OVER w AS c FROM points WINDOW w AS (PARTITION BY scan_id, label)), r AS (SELECT *, max(sqrt(a * a + b * b + c * c)) OVER (PARTITION BY scan_id, label) AS m FROM c) SELECT scan_id, label, row_id, round(CASE WHEN m > 0 THEN a / m ELSE 0 END, 6) + 0.0 AS x, round(CASE WHEN m > 0 THEN b / m ELSE 0 END, 6) + 0.0 AS y, round(CASE WHEN m > 0 THEN c / m ELSE 0 END, 6) + 0.0 AS z FROM r"))
def normalised(spark, d):
    """FUN-18."""
    return P.normalised_cloud(V.points(spark, d)).select("scan_id", "label", "row_id", *[rounded(c).alias(c) for c in "xyz"])


@query("filter_below_ceiling", V.sql("points", "SELECT p.scan_id, p.row_id FROM points p JOIN (SELECT scan_id, max(z) AS top FROM points GROUP BY scan_id) USING (scan_id) WHERE z < top - 1"))
def ceiling(spark, d):
    """CMP-26."""
    return P.below_ceiling(V.points(spark, d)).select("scan_id", "row_id")


@query("fun_visibility", V.sql("points", "SELECT scan_id, row_id, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM (SELECT *, floor(x / z * 500 + 320) AS u, floor(y / z * 500 + 240) AS v FROM points WHERE z > 0) WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480"))
def visibility(spark, d):
    """FUN-17."""
    return P.visible(V.points(spark, d), 500, 500, 320, 240, 640, 480).select("scan_id", "row_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))


@query("fun_depth_unprojection", "SELECT frame_id, round((u - 80) * depth / 120, 6) + 0.0 AS x, round((v - 60) * depth / 120, 6) + 0.0 AS y, round(depth, 6) AS z FROM (SELECT l_orderkey AS frame_id, l_partkey % 160 AS u, l_suppkey % 120 AS v, l_quantity * 0.11 AS depth FROM lineitem) WHERE u % 4 = 0 AND v % 4 = 0 AND depth BETWEEN 0.3 AND 4.5")
def depth(spark, d):
    """FUN-16."""
    px = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), (F.col("l_partkey") % 160).alias("u"), (F.col("l_suppkey") % 120).alias("v"), F.expr("l_quantity * 0.11D").alias("depth_m"))
    return P.unproject(px, 120, 120, 80, 60).select("frame_id", *[rounded(c).alias(c) for c in "xyz"])


@query("agg_spatial_support")
def support(spark, d):
    """AGG-09."""
    out = P.spatial_support(P.object_statistics(V.points(spark, d)))
    return out.select("scan_id", "n", rounded("s1").alias("s1"), rounded("s2").alias("s2"))


@query("points_normals")
def point_normals(spark, d):
    """EXT-19: the surface directions of all points of a scan."""
    n = S.normals(V.points(spark, d), ["scan_id"])
    return n.select("scan_id", "row_id", *[(rounded(c, 4) + F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")])


@query("points_histograms")
def point_histograms(spark, d):
    """EXT-19: 33 numbers a point."""
    h = S.histograms(S.normals(V.points(spark, d), ["scan_id"]), ["scan_id"], 0.24)
    return h.select("scan_id", "row_id", F.transform("v", lambda x: F.round(x, 3) + F.lit(0.0)).alias("v"))
