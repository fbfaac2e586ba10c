from pyspark.sql import Window
from pyspark.sql import functions as F

from keelson.functions.vectors import rounded
from keelson.operators import correspondences as C
from keelson.operators import geometry as G
from keelson.operators import matching as M
from keelson.operators import trajectories as T
from keelson.plans import views as V
from keelson.plans.correspondences_queries import corr
from keelson.plans.registry import query
from keelson.plans.trajectories_queries import _poses


def _best(spark, d):
    """A pair's best correspondences: all of them, as a pair has fewer than 1,000."""
    return C.best_correspondences(corr(spark, d), 1000).drop("rank", "too_few")


def _flat(df, digits=6):
    return df.withColumn("transform", F.transform("transform", lambda x: F.round(x, digits) + F.lit(0.0)))


@query("udf_rigid_fit")
def fit(spark, d):
    """EXT-01."""
    return _flat(G.fitted(_best(spark, d), "pair_id")).withColumn("rmse", rounded("rmse"))


@query("udf_consensus_fit")
def consensus(spark, d):
    """EXT-04, EXT-06."""
    return _flat(G.consensus_fit(_best(spark, d), "pair_id")).withColumn("median", rounded("median"))


@query("udf_sampled_fit")
def sampled(spark, d):
    """EXT-05."""
    return _flat(G.sampled_fit(_best(spark, d), "pair_id", "run"))


@query("udf_registration")
def registration(spark, d):
    """EXT-02, EXT-03, EXT-20: odd labels' points of a scan against the label before, shifted by half a bin."""
    p = V.points(spark, d).withColumn("side", (F.col("label") % 2 == 1).cast("int")).withColumn("key", F.col("scan_id") * 100 + F.floor(F.col("label") / 2))
    p = p.withColumn("y", F.col("y") - F.when(F.col("side") == 1, 0.23).otherwise(0.0))
    return _flat(G.registered(p.select("key", "side", "row_id", "x", "y", "z"), "key")).select("key", "transform", F.size("trace").alias("rounds"))


@query("udf_greedy_cliques")
def cliques(spark, d):
    """CLU-11, EXT-07."""
    return G.compatible_cliques(_best(spark, d), "pair_id", 0.0203, 0.5)


@query("udf_suppressed_sets")
def sets(spark, d):
    """SET-02: a pair's candidate lists by rank."""
    m = M.ranks(M.similarities(V.nodes(spark, d))).where("rank <= 10").groupBy("pair_id", "a").agg(F.collect_set("b").alias("members"))
    return G.suppressed(m.select("pair_id", F.col("a").alias("rank"), "members"), "pair_id", 0.3)


@query("udf_farthest_points")
def farthest(spark, d):
    """EXT-10."""
    return G.farthest_points(V.points(spark, d), ["scan_id", "label"])


@query("udf_shape_descriptors")
def shapes(spark, d):
    """AGG-10, FUN-04 (its descriptors)."""
    return G.shape_descriptors(V.points(spark, d), ["scan_id", "label"]).withColumn("v", F.transform("v", lambda x: F.round(x, 6) + F.lit(0.0)))


@query("udf_dominant_planes")
def planes(spark, d):
    """AGG-38; the points of an object are a group."""
    p = V.points(spark, d).withColumn("key", F.col("scan_id") * 1000 + F.col("label"))
    out = G.dominant_planes(p.select("key", "x", "y", "z"), "key")
    return out.select("key", "place", "points", rounded("height").alias("height"), rounded("tilt", 4).alias("tilt"), rounded("thickness").alias("thickness"))


@query("udf_beam_hypotheses")
def beam(spark, d):
    """CLU-12."""
    return G.compatible_beams(C.best_correspondences(corr(spark, d), 1000), "pair_id", 0.0203, 0.5)


@query("udf_disjoint_modes")
def modes(spark, d):
    """CLU-10."""
    return G.modes(V.workers(spark, d).select("pair_id", "direction", "replicate", "transform"), ["pair_id", "direction"])


@query("udf_pose_graph")
def graph(spark, d):
    """EXT-09: odometry between a sequence's anchors, and its loops between them made sparse (WIN-10, WIN-11: one a pair, two an anchor),
    measured by the true poses where both are known, by FUN-09's weights."""
    anchors = T.anchors(_poses(spark, d), 5).select("sequence_id", "ordinal", "yaw", "x", "y", "t")
    true = lambda c: V.poses(spark, d).where("true_yaw IS NOT NULL").select("sequence_id", F.col("ordinal").alias(c), *[F.col(f"true_{k}").alias(f"{c}_{k}") for k in ("yaw", "x", "y")])

    def seen(e):
        """The second end of an edge as its first sees it."""
        a, dx, dy = F.radians("i_yaw"), F.col("j_x") - F.col("i_x"), F.col("j_y") - F.col("i_y")
        return e.select("sequence_id", "i", "j", (F.col("j_yaw") - F.col("i_yaw")).alias("yaw"), (F.cos(a) * dx + F.sin(a) * dy).alias("x"), (F.cos(a) * dy - F.sin(a) * dx).alias("y"), "weight")

    loops = T.loop_pairs(anchors, 12, 1.25).where("source <> target").join(true("source"), ["sequence_id", "source"]).join(true("target"), ["sequence_id", "target"])
    loops = loops.withColumns({"weight": T.loop_weight(1.25 - F.col("distance"), F.lit(0.0)), "provenance": F.lit("true"), "pos": F.col("position")})
    ends = [f"{e}_{k}" for e in ("source", "target") for k in ("yaw", "x", "y")]
    loops = T.degree_capped(T.best_edges(loops).where("reason IS NULL"), 2, ends).where("accepted")
    loops = loops.withColumnsRenamed({"source": "i", "target": "j"} | {c: c.replace("source", "i").replace("target", "j") for c in ends})
    w = Window.partitionBy("sequence_id").orderBy("ordinal")
    odometry = anchors.select("sequence_id", F.col("ordinal").alias("i"), F.lead("ordinal").over(w).alias("j"), *[c for k in ("yaw", "x", "y") for c in (F.col(k).alias(f"i_{k}"), F.lead(k).over(w).alias(f"j_{k}"))], F.lit(1.0).alias("weight")).where("j IS NOT NULL")
    out = G.optimised_poses(anchors, seen(odometry).unionByName(seen(loops)), "sequence_id")
    return out.select("sequence_id", "ordinal", *[rounded(c, 4).alias(c) for c in ("yaw", "x", "y")])
