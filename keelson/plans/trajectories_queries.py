from pyspark.sql import functions as F

from keelson.functions import se3
from keelson.functions.vectors import rounded
from keelson.operators import trajectories as T
from keelson.plans import views as V
from keelson.plans.registry import query


def _poses(spark, d):
    return V.poses(spark, d).withColumn("t", se3.yaw_transform("yaw", "x", "y"))


def _reference(spark, d):
    return V.poses(spark, d).where("true_yaw IS NOT NULL").select("sequence_id", "ordinal", "frame_id", "timestamp_us", se3.yaw_transform("true_yaw", "true_x", "true_y").alias("t"))


#: The smaller angle between two directions.
ANGLE = "degrees(acos(greatest(-1, least(1, cos(radians({})))))))".replace(")))))))", "))))))")


@query("validate_manifest", V.sql("poses", "WITH x AS (SELECT *, lag(timestamp_us) OVER (PARTITION BY sequence_id ORDER BY frame_id) AS before, count(*) OVER (PARTITION BY sequence_id, CAST(frame_id // 3 AS BIGINT)) AS same FROM poses) SELECT sequence_id, rule, count(*) AS rows FROM (SELECT sequence_id, unnest(list_filter([CASE WHEN event_type = 'signup' THEN 'dataset' END, CASE WHEN same > 1 THEN 'frame_id_repeated' END, CASE WHEN timestamp_us < before THEN 'time_goes_back' END, CASE WHEN x <= 1 THEN 'focal_length' END], lambda r: r IS NOT NULL)) AS rule FROM x) GROUP BY ALL"))
def manifest(spark, d):
    """VAL-01, STR-03: with ids and columns that break every rule somewhere."""
    p = V.poses(spark, d).select("sequence_id", F.col("frame_id").alias("ordinal"), F.floor(F.col("frame_id") / 3).alias("frame_id"), "timestamp_us", F.col("event_type").alias("dataset"), F.greatest(F.col("x") - 1, F.lit(0.0)).alias("fx"))
    return T.manifest_violations(p, ("view", "click", "error", "purchase"))


@query("join_frame_pose_bind", V.sql("poses", "SELECT sequence_id, frame_id, ordinal, CASE WHEN event_type = 'click' THEN 'missing_frame' WHEN event_type = 'view' THEN 'time_mismatch' ELSE 'bound' END AS status FROM poses"))
def bind(spark, d):
    """JOI-01."""
    p = V.poses(spark, d)
    frames = p.where("event_type <> 'click'").withColumn("timestamp_us", F.col("timestamp_us") + F.when(F.col("event_type") == "view", 1).otherwise(0))
    return T.bind(frames, p.select("sequence_id", "frame_id", "ordinal", "timestamp_us")).select("sequence_id", "frame_id", "ordinal", "status")


@query("guard_uncovered_frames", V.sql("poses", "SELECT sequence_id, count(*) AS missing, list(frame_id ORDER BY frame_id)[1:10] AS first_missing FROM poses WHERE event_type = 'error' GROUP BY sequence_id"))
def missing(spark, d):
    """CMP-23."""
    p = V.poses(spark, d)
    return T.uncovered(p, p.where("event_type <> 'error'"))


@query("window_relative_pose", V.sql("poses", f"WITH x AS (SELECT *, lag(yaw) OVER w AS a, lag(x) OVER w AS px, lag(y) OVER w AS py FROM poses WINDOW w AS (PARTITION BY sequence_id ORDER BY ordinal)) SELECT sequence_id, ordinal, round({ANGLE.format('yaw - a')}, 4) + 0.0 AS angle, round(cos(radians(a)) * (x - px) + sin(radians(a)) * (y - py), 6) + 0.0 AS dx, round(-sin(radians(a)) * (x - px) + cos(radians(a)) * (y - py), 6) + 0.0 AS dy FROM x WHERE a IS NOT NULL"))
def steps(spark, d):
    """WIN-06, SE3-02, SE3-03."""
    s = T.relative_steps(_poses(spark, d))
    one = F.array(*[F.lit(v) for v in se3.IDENTITY])
    return s.select("sequence_id", "ordinal", rounded(se3.rotation_distance("step", one), 4).alias("angle"), rounded(se3.at("step", 0, 3)).alias("dx"), rounded(se3.at("step", 1, 3)).alias("dy"))


@query("window_odometry_edges", V.sql("poses", "WITH x AS (SELECT *, lead(yaw) OVER w AS b, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM poses WINDOW w AS (PARTITION BY sequence_id ORDER BY ordinal)) SELECT sequence_id, ordinal AS source, ordinal + 1 AS target, 1.0::DOUBLE AS weight, round(sqrt((qx - x) ** 2 + (qy - y) ** 2), 6) AS length FROM x WHERE b IS NOT NULL"))
def odometry(spark, d):
    """WIN-08."""
    s = T.relative_steps(_poses(spark, d), forward=True)
    return s.select("sequence_id", F.col("ordinal").alias("source"), (F.col("ordinal") + 1).alias("target"), F.lit(1.0).alias("weight"), rounded(F.sqrt(se3.at("step", 0, 3) * se3.at("step", 0, 3) + se3.at("step", 1, 3) * se3.at("step", 1, 3))).alias("length"))


@query("window_anchor_ordinals", V.sql("poses", "SELECT sequence_id, ordinal FROM (SELECT *, max(ordinal) OVER (PARTITION BY sequence_id) AS last FROM poses) WHERE ordinal % 10 = 0 OR ordinal = last"))
def anchor(spark, d):
    """WIN-07."""
    return T.anchors(V.poses(spark, d), 10).select("sequence_id", "ordinal")


LOOPS = "anchors_ AS (SELECT * FROM (SELECT *, max(ordinal) OVER (PARTITION BY sequence_id) AS last FROM poses) WHERE ordinal % 3 = 0 OR ordinal = last), loops AS (SELECT sequence_id, source, target, distance, row_number() OVER (PARTITION BY sequence_id ORDER BY distance, source - target, source, target) AS position FROM (SELECT a.sequence_id, a.ordinal AS source, b.ordinal AS target, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9) AS distance FROM anchors_ a JOIN anchors_ b ON a.sequence_id = b.sequence_id AND b.ordinal >= a.ordinal + 12) WHERE distance <= 1.25)"


def _loops(spark, d):
    return T.loop_pairs(T.anchors(_poses(spark, d), 3), 12, 1.25)


@query("join_loop_pairs", V.sql("poses", f"WITH {LOOPS} SELECT sequence_id, source, target, round(distance, 6) AS distance, position FROM loops WHERE position <= 36"))
def loops(spark, d):
    """JOI-08."""
    return _loops(spark, d).withColumn("distance", rounded("distance")).withColumn("position", F.col("position").cast("long"))


@query("window_best_edge", V.sql("poses", f"WITH {LOOPS}, e AS (SELECT sequence_id, source - source % 9 AS source, target - target % 9 AS target, round(2 - distance, 3) AS weight, position AS pos FROM loops WHERE position <= 36) SELECT sequence_id, source, target, pos, CASE WHEN row_number() OVER (PARTITION BY sequence_id, least(source, target), greatest(source, target) ORDER BY weight DESC, pos % 3 DESC, pos) > 1 THEN 'duplicate_pair' END AS reason FROM e"))
def best(spark, d):
    """WIN-10."""
    e = _loops(spark, d).select("sequence_id", (F.col("source") - F.col("source") % 9).alias("source"), (F.col("target") - F.col("target") % 9).alias("target"), F.round(2 - F.col("distance"), 3).alias("weight"), (F.col("position") % 3).alias("provenance"), F.col("position").cast("long").alias("pos"))
    return T.best_edges(e).select("sequence_id", "source", "target", "pos", "reason")


#: Edges in order, one after the other; the state is the list of ends taken so far.
CAPPED = f"""WITH RECURSIVE {LOOPS}, w AS (SELECT sequence_id, source, target, round(2 - distance, 3) AS weight FROM loops WHERE position <= 36), e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY weight DESC, least(source, target), greatest(source, target)) AS k FROM w),
   t AS (SELECT sequence_id, CAST(0 AS BIGINT) AS k, NULL::BIGINT AS source, NULL::BIGINT AS target, NULL::DOUBLE AS weight, CAST([] AS BIGINT[]) AS used, false AS accepted FROM (SELECT DISTINCT sequence_id FROM e) UNION ALL
     SELECT sequence_id, k, source, target, weight, CASE WHEN ok THEN list_concat(used, CAST([source, target] AS BIGINT[])) ELSE used END, ok FROM (SELECT e.sequence_id, e.k, e.source, e.target, e.weight, t.used, len(list_filter(t.used, lambda x: x = e.source)) < 3 AND len(list_filter(t.used, lambda x: x = e.target)) < 3 AS ok FROM t JOIN e ON e.sequence_id = t.sequence_id AND e.k = t.k + 1))
   SELECT sequence_id, source, target, weight, accepted FROM t WHERE k > 0"""


@query("udf_degree_capped_edges", V.sql("poses", CAPPED))
def capped(spark, d):
    """WIN-11."""
    e = _loops(spark, d).select("sequence_id", F.col("source").cast("int").alias("source"), F.col("target").cast("int").alias("target"), rounded(2 - F.col("distance"), 3).alias("weight"), F.lit("p").alias("provenance"))
    return T.degree_capped(e, 3)


@query("fun_loop_weight", V.sql("poses", f"WITH {LOOPS}, n AS (SELECT sequence_id, count(*) AS n FROM poses GROUP BY sequence_id) SELECT sequence_id, source, target, round(CASE WHEN (target - source) / n > 0.5 THEN least(least(greatest((1.25 - distance) / 0.35, 0.7), 1.5), 1.0) ELSE least(greatest((1.25 - distance) / 0.35, 0.7), 1.5) END, 6) AS weight FROM loops JOIN n USING (sequence_id) WHERE position <= 36"))
def weight(spark, d):
    """FUN-09."""
    n = V.poses(spark, d).groupBy("sequence_id").agg(F.count("*").alias("n"))
    return _loops(spark, d).join(n, "sequence_id").select("sequence_id", "source", "target", rounded(T.loop_weight(1.25 - F.col("distance"), (F.col("target") - F.col("source")) / F.col("n"))).alias("weight"))


@query("window_anchor_interpolation", V.sql("poses", """WITH a AS (SELECT sequence_id, ordinal, true_yaw - yaw AS yaw, true_x - x AS x, true_y - y AS y FROM poses WHERE ordinal % 10 = 0 AND true_yaw IS NOT NULL),
   b AS (SELECT p.sequence_id, p.ordinal, max(a.ordinal) FILTER (WHERE a.ordinal <= p.ordinal) AS lo, min(a.ordinal) FILTER (WHERE a.ordinal >= p.ordinal) AS hi FROM poses p LEFT JOIN a USING (sequence_id) GROUP BY ALL), c AS (SELECT sequence_id, ordinal, coalesce(lo, hi) AS lo, coalesce(hi, lo) AS hi FROM b),
   f AS (SELECT c.*, CASE WHEN hi > lo THEN (c.ordinal - lo) / (hi - lo) ELSE 0 END AS t FROM c) SELECT f.sequence_id, f.ordinal, round(l.yaw + t * (h.yaw - l.yaw), 6) + 0.0 AS yaw, round(l.x + t * (h.x - l.x), 6) + 0.0 AS x, round(l.y + t * (h.y - l.y), 6) + 0.0 AS y
   FROM f LEFT JOIN a l ON l.sequence_id = f.sequence_id AND l.ordinal = lo LEFT JOIN a h ON h.sequence_id = f.sequence_id AND h.ordinal = hi"""))
def interpolation(spark, d):
    """WIN-09."""
    p = V.poses(spark, d)
    c = p.where("ordinal % 10 = 0 AND true_yaw IS NOT NULL").select("sequence_id", "ordinal", *[(F.col(f"true_{k}") - F.col(k)).alias(k) for k in ("yaw", "x", "y")])
    return T.interpolated(p, c).select("sequence_id", "ordinal", *[rounded(k).alias(k) for k in ("yaw", "x", "y")])


@query("agg_trajectory_metrics", V.sql("poses", f"""WITH e AS (SELECT sequence_id, CASE WHEN true_yaw IS NOT NULL THEN {ANGLE.format('yaw - true_yaw')} END AS rre, CASE WHEN true_yaw IS NOT NULL THEN sqrt((x - true_x) ** 2 + (y - true_y) ** 2) END AS rte FROM poses)
   SELECT sequence_id, count(rre) AS rre_count, count(rre) > 0 AS rre_available, round(median(rre), 4) AS rre_median, round(avg(rre), 4) AS rre_mean, round(sqrt(avg(rre * rre)), 4) AS rre_rmse, round(quantile_cont(rre, 0.95), 4) AS rre_p95, round(max(rre), 4) AS rre_max,
     count(rte) AS rte_count, count(rte) > 0 AS rte_available, round(median(rte), 6) AS rte_median, round(avg(rte), 6) AS rte_mean, round(sqrt(avg(rte * rte)), 6) AS rte_rmse, round(quantile_cont(rte, 0.95), 6) AS rte_p95, round(max(rte), 6) AS rte_max FROM e GROUP BY sequence_id"""))
def metrics(spark, d):
    """AGG-11, SE3-04."""
    e = T.trajectory_errors(_poses(spark, d), _reference(spark, d))
    out = T.describe(e, "sequence_id", "rre", "rre_").join(T.describe(e, "sequence_id", "rte", "rte_"), "sequence_id")
    plain = ("sequence_id", "rre_count", "rre_available", "rte_count", "rte_available")
    return out.select(*plain, *[rounded(c, 4 if c.startswith("rre") else 6).alias(c) for c in out.columns if c not in plain])


@query("fun_rebased_reference", V.sql("poses", "WITH f AS (SELECT *, first_value(true_yaw) OVER w AS a, first_value(true_x) OVER w AS px, first_value(true_y) OVER w AS py FROM poses WHERE true_yaw IS NOT NULL WINDOW w AS (PARTITION BY sequence_id ORDER BY ordinal)) SELECT sequence_id, ordinal, round(cos(radians(a)) * (true_x - px) + sin(radians(a)) * (true_y - py), 6) + 0.0 AS x, round(-sin(radians(a)) * (true_x - px) + cos(radians(a)) * (true_y - py), 6) + 0.0 AS y FROM f"))
def rebased(spark, d):
    """CMP-21, CMP-22, SE3-01."""
    return T.rebased(_reference(spark, d)).select("sequence_id", "ordinal", rounded(se3.at("t", 0, 3)).alias("x"), rounded(se3.at("t", 1, 3)).alias("y"))


@query("join_catastrophic_edges", V.sql("poses", f"""WITH {LOOPS}, r AS (SELECT l.sequence_id, l.source, l.target, {ANGLE.format('(q.yaw - p.yaw) - (q.true_yaw - p.true_yaw)')} AS rre,
     sqrt(((cos(radians(p.yaw)) * (q.x - p.x) + sin(radians(p.yaw)) * (q.y - p.y)) - (cos(radians(p.true_yaw)) * (q.true_x - p.true_x) + sin(radians(p.true_yaw)) * (q.true_y - p.true_y))) ** 2 + ((-sin(radians(p.yaw)) * (q.x - p.x) + cos(radians(p.yaw)) * (q.y - p.y)) - (-sin(radians(p.true_yaw)) * (q.true_x - p.true_x) + cos(radians(p.true_yaw)) * (q.true_y - p.true_y))) ** 2) AS rte, p.true_yaw IS NULL OR q.true_yaw IS NULL AS lacks
     FROM loops l JOIN poses p ON p.sequence_id = l.sequence_id AND p.ordinal = source JOIN poses q ON q.sequence_id = l.sequence_id AND q.ordinal = target WHERE position <= 36)
   SELECT sequence_id, source, target, CASE WHEN NOT lacks THEN round(rre, 4) END AS rre, CASE WHEN NOT lacks THEN round(rte, 6) END AS rte, CASE WHEN lacks THEN 'unevaluable' WHEN rre > 20 OR rte > 0.5 THEN 'catastrophic' ELSE 'safe' END AS outcome FROM r"""))
def catastrophic(spark, d):
    """JOI-22, SEM-12."""
    p = _poses(spark, d)
    end = lambda e: p.select("sequence_id", F.col("ordinal").alias(e), F.col("t").alias(f"{e}_t"))
    e = _loops(spark, d).join(end("source"), ["sequence_id", "source"]).join(end("target"), ["sequence_id", "target"])
    e = e.select("sequence_id", "source", "target", se3.compose(se3.inverse("source_t"), "target_t").alias("t"))
    return T.edge_outcomes(e, _reference(spark, d)).withColumn("rre", rounded("rre", 4)).withColumn("rte", rounded("rte"))


@query("join_submap_members", V.sql("poses", "SELECT a.sequence_id, a.ordinal AS anchor, b.ordinal, round(cos(radians(a.yaw)) * (b.x - a.x) + sin(radians(a.yaw)) * (b.y - a.y), 6) + 0.0 AS dx FROM (SELECT * FROM (SELECT *, max(ordinal) OVER (PARTITION BY sequence_id) AS last FROM poses) WHERE ordinal % 15 = 0 OR ordinal = last) a JOIN poses b ON a.sequence_id = b.sequence_id AND abs(b.ordinal - a.ordinal) <= 20 AND (b.ordinal - a.ordinal) % 4 = 0"))
def submaps(spark, d):
    """AGG-47."""
    p = _poses(spark, d)
    return T.submap_members(p, T.anchors(p, 15)).select("sequence_id", "anchor", "ordinal", rounded(se3.at("into_anchor", 0, 3)).alias("dx"))


@query("agg_replay_latency", V.sql("poses", "SELECT sequence_id, count(*) AS frames, count(*) FILTER (WHERE event_type <> 'error') AS tracked, round(median(x) FILTER (WHERE event_type <> 'error'), 6) AS median_latency, round(quantile_cont(x, 0.95) FILTER (WHERE event_type <> 'error'), 6) AS p95_latency FROM poses GROUP BY sequence_id"))
def replay(spark, d):
    """STR-01."""
    r = V.poses(spark, d).select("sequence_id", (F.col("event_type") != "error").alias("tracked"), F.col("x").alias("latency"))
    return T.replay_summary(r).withColumn("median_latency", rounded("median_latency")).withColumn("p95_latency", rounded("p95_latency"))


ANSWERS = """WITH asked AS (SELECT sequence_id, ordinal AS frame, timestamp_us AS t, frame_id, event_type FROM poses),
  answers AS (SELECT sequence_id, frame + CASE WHEN frame_id % 50 = 7 THEN 1000000 ELSE 0 END AS frame, t + frame_id % 997 * 100 AS t, event_type <> 'error' AS tracked FROM asked WHERE frame_id % 20 <> 3),
  both_ AS (SELECT coalesce(a.sequence_id, b.sequence_id) AS sequence_id, coalesce(a.frame, b.frame) AS frame, a.t AS asked, b.t - a.t AS wait, b.tracked FROM asked a FULL JOIN answers b ON a.sequence_id = b.sequence_id AND a.frame = b.frame)
SELECT sequence_id, CAST(frame AS BIGINT) AS frame, CASE WHEN asked IS NULL THEN 'unasked' WHEN wait IS NULL OR wait > 90000 THEN 'timeout' WHEN tracked THEN 'tracked' ELSE 'lost' END AS status, CAST(CASE WHEN asked IS NOT NULL AND wait <= 90000 THEN wait END AS BIGINT) AS latency_us FROM both_"""


@query("join_replay_outcomes", V.sql("poses", ANSWERS))
def outcomes(spark, d):
    """STR-01: frames that are asked for, and made-up answers: some late, some missing, some to frames never asked for."""
    p = V.poses(spark, d).withColumn("frame", F.col("ordinal").cast("long"))
    asked = p.select("sequence_id", "frame", F.lit("request").alias("kind"), F.col("timestamp_us").alias("at_us"), F.lit(None).cast("boolean").alias("tracked"))
    frame = F.col("frame") + F.when(F.col("frame_id") % 50 == 7, 1000000).otherwise(0)
    answers = p.where("frame_id % 20 <> 3").select("sequence_id", frame.alias("frame"), F.lit("answer").alias("kind"), (F.col("timestamp_us") + F.col("frame_id") % 997 * 100).alias("at_us"), (F.col("event_type") != "error").alias("tracked"))
    return T.replay_outcomes(asked.unionByName(answers), 90_000)


@query("window_running_meter", V.sql("poses", "SELECT sequence_id, ordinal, round(sum(x) OVER w, 6) AS sum, round(avg(x) OVER w, 6) AS mean, round(stddev_pop(x) OVER w, 6) AS std FROM poses WINDOW w AS (PARTITION BY sequence_id ORDER BY ordinal ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"))
def meter(spark, d):
    """AGG-45."""
    return T.running(V.poses(spark, d), "x", 10).select("sequence_id", "ordinal", *[rounded(c).alias(c) for c in ("sum", "mean", "std")])


@query("udf_accumulated_subscans")
def subscans(spark, d):
    """STR-02: a frame sees a few of 60 points."""
    p = V.poses(spark, d).select("sequence_id", "ordinal", F.expr("transform(sequence(0, 4), i -> (frame_id * 7 + i * 11) % 60)").alias("points"))
    return T.accumulated_subscans(p, 30)


@query("scan_framed_manifest", V.sql("poses", "SELECT sequence_id, frame_id, 1000000 + (row_number() OVER (PARTITION BY sequence_id ORDER BY frame_id) - 1) * 33333 AS timestamp_us FROM poses"))
def framed(spark, d):
    """SRC-06: made-up timestamps by order of the frame ids."""
    from keelson.sources.frames import framed_manifest

    return framed_manifest(V.poses(spark, d)).select("sequence_id", "frame_id", "timestamp_us")


@query("scan_admitted_journal", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AND event_type = 'click'")
def journal(spark, d):
    """SRC-08, FUN-20: admission by fields of a JSON column."""
    from keelson.sources.frames import admitted

    e = V.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("storage_status", F.when(F.col("event_type") == "click", "complete")).withColumn("admitted_to_fusion", F.col("k") >= 50)
    return admitted(e).select("event_id", "k")
