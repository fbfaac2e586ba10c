from pyspark.sql import functions as F

from keelson.functions import se3
from keelson.functions.vectors import rounded
from keelson.operators import consensus as C
from keelson.plans import views as V
from keelson.plans.registry import query

KEYS = ["pair_id", "direction"]
#: Distances of members a < b of a group; rotations are about one axis.
DIST = """dist AS (SELECT a.pair_id, a.direction, a.replicate AS a, b.replicate AS b, abs(a.yaw - b.yaw) AS dr, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dt FROM workers a JOIN workers b USING (pair_id, direction) WHERE a.replicate < b.replicate)"""


def cliques(deg, m):
    """Maximal cliques by enumeration of five-bit masks."""
    return f"""{DIST}, masks AS (SELECT w.pair_id, w.direction, i AS mask, sum(CASE WHEN i & (1 << replicate) > 0 THEN 1 ELSE 0 END) AS size FROM workers w, range(1, 32) r(i) GROUP BY ALL HAVING size = bit_count(i::INT)),
   ok AS (SELECT * FROM masks m WHERE NOT EXISTS (SELECT 1 FROM dist d WHERE d.pair_id = m.pair_id AND d.direction = m.direction AND (mask >> a) & 1 = 1 AND (mask >> b) & 1 = 1 AND (dr > {deg} OR dt > {m}))),
   maximal AS (SELECT * FROM ok m WHERE NOT EXISTS (SELECT 1 FROM ok o WHERE o.pair_id = m.pair_id AND o.direction = m.direction AND o.mask <> m.mask AND o.mask & m.mask = m.mask))"""


@query("cluster_maximal_cliques", V.sql("workers", f"WITH {cliques(2.0003, 0.10003)} SELECT pair_id, direction, CAST(mask AS INT) AS mask, CAST(size AS INT) AS size FROM maximal"))
def maximal(spark, d):
    """CLU-01."""
    return C.maximal_cliques(V.workers(spark, d), KEYS, 2.0003, 0.10003)


VERDICT = """s AS (SELECT pair_id, direction, max(size) AS size, count(*) FILTER (WHERE size = top) AS ties, count(*) FILTER (WHERE size >= {rival}) AS rivals, min(mask) FILTER (WHERE size = top) AS mask FROM (SELECT *, max(size) OVER (PARTITION BY pair_id, direction) AS top FROM maximal) GROUP BY ALL),
  cost AS (SELECT s.pair_id, s.direction, w.replicate, w.signature, coalesce(sum(dr / {deg} + dt / {m}), 0) AS cost FROM s JOIN workers w ON w.pair_id = s.pair_id AND w.direction = s.direction AND (s.mask >> w.replicate) & 1 = 1
     LEFT JOIN dist d ON d.pair_id = s.pair_id AND d.direction = s.direction AND (d.a = w.replicate AND (s.mask >> d.b) & 1 = 1 OR d.b = w.replicate AND (s.mask >> d.a) & 1 = 1) GROUP BY ALL),
  med AS (SELECT pair_id, direction, arg_min(replicate, (round(cost, 9), signature, replicate)) AS medoid, arg_min(signature, (round(cost, 9), signature, replicate)) AS signature FROM cost GROUP BY ALL),
  v AS (SELECT s.*, medoid, signature, list_filter([CASE WHEN size < {quorum} THEN 'quorum_not_met' END, CASE WHEN ties > 1 THEN 'largest_not_unique' END, CASE WHEN rivals > 1 THEN 'rival_cluster' END], lambda r: r IS NOT NULL) AS reasons FROM s JOIN med USING (pair_id, direction))
  SELECT pair_id, direction, CAST(size AS INT) AS size, len(reasons) = 0 AS usable, reasons, CASE WHEN len(reasons) = 0 THEN medoid END AS medoid, CASE WHEN len(reasons) = 0 THEN signature END AS signature FROM v"""


@query("cluster_direction_medoid", V.sql("workers", f"WITH {cliques(5.0003, 0.10003)}, {VERDICT.format(rival=99, deg=5.0003, m=0.10003, quorum=3)}"))
def direction(spark, d):
    """CLU-02: every finite transform clusters; no rival rule."""
    return C.direction_cluster(V.workers(spark, d), KEYS, 5.0003, 0.10003, 3)


@query("cluster_unique_quorum", V.sql("workers", f"WITH {cliques(5.0003, 0.15003)}, {VERDICT.format(rival=3, deg=5.0003, m=0.15003, quorum=3)}"))
def unique_quorum(spark, d):
    """CLU-04: no other clique may reach the quorum (here of 3: groups of four near records are rare)."""
    return C.direction_cluster(V.workers(spark, d), KEYS, 5.0003, 0.15003, 3, rival=3)


@query("cluster_accepted_consensus", V.sql("workers", f"WITH {cliques(5.0003, 0.15003)}, {VERDICT.format(rival=2, deg=5.0003, m=0.15003, quorum=2)}").replace("AS nth FROM orders)", "AS nth FROM orders) WHERE (o_orderstatus <> 'P' OR o_orderkey % 3 > 0)"))
def accepted(spark, d):
    """CLU-03, CLU-05: accepted runs only, and no other clique of two."""
    return C.direction_cluster(V.workers(spark, d).where("accepted"), KEYS, 5.0003, 0.15003, 2, rival=2)


@query("cluster_cross_solver", V.sql("workers", f"WITH {cliques(2.0003, 0.10003)}, n AS (SELECT m.pair_id, m.direction, mask, count(DISTINCT solver) AS solvers FROM maximal m JOIN workers w ON w.pair_id = m.pair_id AND w.direction = m.direction AND (mask >> replicate) & 1 = 1 GROUP BY ALL) SELECT pair_id, direction, count(*) AS cliques, count(*) FILTER (WHERE solvers >= 2) AS mixed, count(*) FILTER (WHERE solvers >= 2) = 1 AS usable FROM n GROUP BY ALL"))
def solver(spark, d):
    """CLU-06."""
    return C.cross_solver(V.workers(spark, d), KEYS, 2.0003, 0.10003)


@query("agg_transform_dispersion", V.sql("workers", f"WITH {DIST} SELECT pair_id, direction, round(max(dr), 4) AS dr, round(max(dt), 6) AS dt, round(greatest(max(dr) / 5, max(dt) / 0.2), 4) AS dispersion FROM dist GROUP BY ALL"))
def dispersion(spark, d):
    """AGG-40, SE3-04."""
    x = C.dispersion(V.workers(spark, d), KEYS)
    return x.select(*KEYS, rounded("dr", 4).alias("dr"), rounded("dt").alias("dt"), rounded("dispersion", 4).alias("dispersion"))


@query("cluster_safe_candidates", V.sql("workers", """WITH e AS (SELECT pair_id, direction, signature % 3 AS candidate, yaw, x, y FROM workers), p AS (SELECT a.pair_id, a.candidate AS a, b.candidate AS b, max(abs(a.yaw - b.yaw)) AS dr, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS dt FROM e a JOIN e b ON a.pair_id = b.pair_id AND a.candidate <> b.candidate GROUP BY ALL),
   w AS (SELECT pair_id, a, max(greatest(dr / 3.0003, dt / 0.15003)) AS worst, bool_and(dr <= 3.0003 AND dt <= 0.15003) AS ok FROM p GROUP BY ALL), s AS (SELECT pair_id, bool_and(ok) AS ok, arg_min(a, (round(worst, 6), a)) AS best FROM w GROUP BY ALL)
   SELECT pair_id, n, coalesce(ok, true) AS accepted, coalesce(best, only_) AS medoid FROM (SELECT pair_id, count(DISTINCT candidate) AS n, min(candidate) AS only_ FROM e GROUP BY ALL) LEFT JOIN s USING (pair_id)"""))
def safe(spark, d):
    """CLU-15, CLU-16."""
    e = V.workers(spark, d).withColumn("candidate", F.col("signature") % 3)
    return C.all_compatible(e, "pair_id", "candidate", 3.0003, 0.15003)


#: Forward against inverted reverse records; the inverse of (yaw, x, y) in closed form.
FR = """fr AS (SELECT f.pair_id, f.signature AS f, r.signature AS r, round(abs(f.yaw + r.yaw), 6) AS dr, round(sqrt((f.x + cos(radians(r.yaw)) * r.x + sin(radians(r.yaw)) * r.y) ** 2 + (f.y - sin(radians(r.yaw)) * r.x + cos(radians(r.yaw)) * r.y) ** 2), 9) AS dt FROM workers f JOIN workers r ON f.pair_id = r.pair_id AND f.direction = 'forward' AND r.direction = 'reverse')"""


def _matches(spark, d, cap=8):
    w = V.workers(spark, d)
    return C.forward_reverse(w.where("direction = 'forward'"), w.where("direction = 'reverse'"), "pair_id", 4.0003, 0.20003, cap)


@query("join_forward_reverse", V.sql("workers", f"WITH {FR}, m AS (SELECT *, count(*) OVER (PARTITION BY pair_id, f) > 1 OR count(*) OVER (PARTITION BY pair_id, r) > 1 AS ambiguous FROM fr WHERE dr <= 4.0003 AND dt <= 0.20003), o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(greatest(dr / 4.0003, dt / 0.20003), 9), dr, dt, f, r) AS position FROM m) SELECT pair_id, f, r, round(dr, 4) AS dr, round(dt, 6) AS dt, ambiguous, position FROM o WHERE position <= 8"))
def pairing(spark, d):
    """JOI-24, JOI-25, AGG-50, SE3-03."""
    return _matches(spark, d).withColumn("dr", rounded("dr", 4)).withColumn("dt", rounded("dt")).withColumn("position", F.col("position").cast("long"))


@query("udf_direction_agreement")
def agreement(spark, d):
    """JOI-26, JOI-27."""
    return C.direction_agreement(_matches(spark, d, None), "pair_id")


@query("fun_bidirectional_discrepancy", V.sql("workers", "SELECT f.pair_id, f.replicate, round(abs(f.yaw + r.yaw), 4) AS deg, round(sqrt((f.x + cos(radians(f.yaw)) * r.x - sin(radians(f.yaw)) * r.y) ** 2 + (f.y + sin(radians(f.yaw)) * r.x + cos(radians(f.yaw)) * r.y) ** 2), 6) AS m FROM workers f JOIN workers r ON f.pair_id = r.pair_id AND f.replicate = r.replicate AND f.direction = 'forward' AND r.direction = 'reverse'"))
def discrepancy(spark, d):
    """SE3-06."""
    w = V.workers(spark, d)
    x = w.where("direction = 'forward'").select("pair_id", "replicate", F.col("transform").alias("f")).join(w.where("direction = 'reverse'").select("pair_id", "replicate", F.col("transform").alias("r")), ["pair_id", "replicate"])
    deg, m = se3.discrepancy("f", "r")
    return x.select("pair_id", "replicate", rounded(deg, 4).alias("deg"), rounded(m).alias("m"))


@query("fun_registration_error", V.sql("workers", "SELECT signature, round(yaw, 4) AS rre, round(sqrt(x * x + y * y), 6) AS rte, 0.0::DOUBLE AS ex, 0.0::DOUBLE AS ey, round(yaw, 4) AS ez, yaw <= 5 AND sqrt(x * x + y * y) <= 0.2 AS strict, yaw <= 10 AND sqrt(x * x + y * y) <= 0.3 AS relaxed, yaw > 20 OR sqrt(x * x + y * y) > 0.5 AS catastrophic FROM workers"))
def error(spark, d):
    """SE3-08, SEM-12, CMP-04."""
    one = F.array(*[F.lit(v) for v in se3.IDENTITY])
    w = V.workers(spark, d).withColumn("rre", F.round(se3.rotation_distance("transform", one), 6)).withColumn("rte", F.round(se3.translation_distance("transform", one), 9))
    ex, ey, ez = se3.euler_deg("transform")
    strict, relaxed, catastrophic = se3.grade(F.col("rre"), F.col("rte"))
    return w.select("signature", rounded("rre", 4).alias("rre"), rounded(se3.translation_distance("transform", one)).alias("rte"), rounded(ex, 4).alias("ex"), rounded(ey, 4).alias("ey"), rounded(ez, 4).alias("ez"), strict.alias("strict"), relaxed.alias("relaxed"), catastrophic.alias("catastrophic"))


@query("fun_rule_violations", V.sql("workers", "WITH x AS (SELECT f.signature, f.overlap, f.rmse, r.signature IS NULL AS lacks, abs(f.yaw + r.yaw) AS deg, sqrt((f.x + cos(radians(f.yaw)) * r.x - sin(radians(f.yaw)) * r.y) ** 2 + (f.y + sin(radians(f.yaw)) * r.x + cos(radians(f.yaw)) * r.y) ** 2) AS m FROM workers f LEFT JOIN workers r ON f.pair_id = r.pair_id AND f.replicate = r.replicate AND r.direction = 'reverse' WHERE f.direction = 'forward') SELECT signature, CASE WHEN lacks THEN ['B:reverse_missing'] ELSE list_filter([CASE WHEN overlap < 0.25 THEN 'A:overlap' END, CASE WHEN rmse > 0.08 THEN 'A:rmse' END, CASE WHEN round(deg, 6) > 5 THEN 'B:rotation' END, CASE WHEN round(m, 9) > 0.2 THEN 'B:translation' END, CASE WHEN overlap < 0.45 THEN 'C:overlap' END], lambda c: c IS NOT NULL) END AS reasons FROM x"))
def rules(spark, d):
    """FUN-05, FUN-06, FUN-07."""
    w = V.workers(spark, d)
    x = w.where("direction = 'forward'").join(w.where("direction = 'reverse'").select("pair_id", "replicate", F.col("transform").alias("r")), ["pair_id", "replicate"], "left")
    deg, m = se3.discrepancy("transform", "r")
    return x.select("signature", C.rule_violations(F.col("overlap"), F.col("rmse"), F.round(deg, 6), F.round(m, 9)).alias("reasons"))


@query("fun_trace_gate", V.sql("workers", "WITH t AS (SELECT pair_id, direction, replicate, rmse, yaw, x, lag(rmse) OVER w AS before, row_number() OVER (PARTITION BY pair_id, direction ORDER BY replicate DESC) AS back FROM workers WINDOW w AS (PARTITION BY pair_id, direction ORDER BY replicate)) SELECT pair_id, direction, bool_and(rmse <= coalesce(before, 1) + 0.03 + 1e-12) AND bool_and(yaw <= 2.5 AND x <= 0.15) FILTER (WHERE back = 1) AS passed FROM t GROUP BY ALL"))
def trace(spark, d):
    """FUN-11."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS).orderBy("replicate")
    x = V.workers(spark, d).withColumn("before", F.coalesce(F.lag("rmse").over(w), F.lit(1.0)) + 0.03)
    t = x.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("replicate", F.col("before").alias("rmse_before"), F.col("rmse").alias("rmse_after"), F.col("yaw").alias("deg"), F.col("x").alias("m")))).alias("trace"))
    return t.select(*KEYS, C.trace_gate(F.col("trace"), 2.5, 0.15).alias("passed"))


SAFE = "s AS (SELECT pair_id, count(*) AS n, count(*) FILTER (WHERE yaw < 1 AND accepted) AS safe, min(signature) FILTER (WHERE yaw < 1 AND accepted) AS signature FROM workers GROUP BY pair_id), v AS (SELECT pair_id, n, safe, CASE WHEN pair_id % 19 = 0 THEN 'vetoed' WHEN safe = 0 THEN 'none_safe' WHEN safe > 1 THEN 'ambiguous' ELSE 'accepted' END AS verdict, signature FROM s)"


def _unique(spark, d):
    w = V.workers(spark, d)
    return C.unique_safe(w.select("pair_id", "signature", ((F.col("yaw") < 1) & F.col("accepted")).alias("safe")), "pair_id", w.where("pair_id % 19 = 0"))


@query("decide_unique_safe", V.sql("workers", f"WITH {SAFE} SELECT pair_id, n, safe, verdict, CASE WHEN verdict = 'accepted' THEN signature END AS signature FROM v"))
def unique(spark, d):
    """CLU-17, CLU-18, SEM-15."""
    return _unique(spark, d)


@query("decide_fixed_gate", V.sql("workers", f"WITH {SAFE} SELECT pair_id // 4 AS grp, count(*) AS rows, count(*) FILTER (WHERE pair_id % 4 > 0 AND verdict = 'accepted') AS accepted, count(*) FILTER (WHERE pair_id % 4 = 0 AND verdict = 'vetoed') AS vetoed, count(*) = 4 AND count(*) FILTER (WHERE pair_id % 4 > 0 AND verdict = 'accepted') = 3 AND count(*) FILTER (WHERE pair_id % 4 = 0 AND verdict = 'vetoed') = 1 AS passed FROM v GROUP BY 1"))
def gate(spark, d):
    """CLU-21 to CLU-24, SEM-16."""
    u = _unique(spark, d).select(F.expr("pair_id div 4").alias("grp"), ((F.col("pair_id") + 3) % 4).alias("position"), "verdict")
    control = u.withColumn("arm", F.lit("control")).withColumn("verdict", F.lit("accepted"))
    return C.fixed_gate(u.withColumn("arm", F.lit("primary")).unionByName(control), "grp")
