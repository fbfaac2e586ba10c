from pyspark.sql import functions as F

from keelson.functions import se3
from keelson.functions.vectors import rounded
from keelson.operators import experiments as E
from keelson.plans import views as V
from keelson.plans.registry import query

OUT = """o AS (SELECT *, status = 'completed' AS structured, coalesce(rre <= 5 AND rte <= 0.2, false) AS strict, coalesce(rre <= 10 AND rte <= 0.3, false) AS relaxed, coalesce(rre > 20 OR rte > 0.5, false) AS catastrophic,
  accepted AND coalesce(rre <= 5 AND rte <= 0.2, false) AS accepted_correct, accepted AND NOT coalesce(rre <= 5 AND rte <= 0.2, false) AS accepted_error FROM runs)"""
COUNTS = """count(*) AS requested, count(*) FILTER (WHERE structured) AS structured, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE strict) AS strict, count(*) FILTER (WHERE relaxed) AS relaxed, count(*) FILTER (WHERE catastrophic) AS catastrophic,
  count(*) FILTER (WHERE accepted_correct) AS accepted_correct, count(*) FILTER (WHERE accepted_error) AS accepted_error, round(median(rre), 4) AS median_rre, round(median(rte), 4) AS median_rte, round(avg(coverage), 6) AS mean_coverage, count(*) FILTER (WHERE NOT structured) AS failed,
  count(*) FILTER (WHERE structured) - count(*) FILTER (WHERE accepted) AS rejected, round(count(*) FILTER (WHERE accepted_correct) / nullif(count(*) FILTER (WHERE accepted), 0), 6) AS precision, round(count(*) FILTER (WHERE strict) / count(*), 6) AS recall"""


def _out(spark, d):
    return E.outcomes(V.runs(spark, d))


def _rounded(df):
    digits = {"median_rre": 4, "median_rte": 4, "mean_coverage": 6, "precision": 6, "recall": 6}
    return df.select(*[rounded(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


@query("agg_outcome_counts", V.sql("runs", f"WITH {OUT} SELECT dataset, split, arm, {COUNTS} FROM o GROUP BY ALL"))
def counts(spark, d):
    """AGG-14, AGG-20, AGG-43, CMP-02."""
    return _rounded(E.confusion(_out(spark, d), "dataset", "split", "arm"))


@query("validate_outcome_consistency", V.sql("runs", f"WITH {OUT}, x AS (SELECT repeat, list_filter([CASE WHEN strict AND NOT relaxed THEN 'strict_not_relaxed' END, CASE WHEN NOT structured AND (strict OR accepted) THEN 'outcome_without_result' END, CASE WHEN catastrophic AND relaxed THEN 'catastrophic_but_relaxed' END], lambda r: r IS NOT NULL) AS broken FROM (SELECT * REPLACE (relaxed AND repeat % 40 > 0 AS relaxed, accepted OR repeat % 50 = 0 AS accepted) FROM o)) SELECT * FROM x WHERE len(broken) > 0").replace("accepted_correct, accepted AND NOT", "accepted_correct, accepted AND NOT"))
def consistency(spark, d):
    """VAL-09: on rows with planted contradictions."""
    o = _out(spark, d).withColumn("relaxed", F.col("relaxed") & (F.col("repeat") % 40 > 0)).withColumn("accepted", F.col("accepted") | (F.col("repeat") % 50 == 0)).withColumn("accepted_correct", F.col("accepted") & F.col("strict"))
    return E.violations(o).select("repeat", "broken")


@query("agg_rule_replay", V.sql("runs", f"WITH {OUT}, r AS (SELECT o.* EXCLUDE (accepted, accepted_correct, accepted_error), rule, structured AND CASE rule WHEN 'coverage' THEN coverage >= 0.5 WHEN 'rotation' THEN rre <= 5 ELSE coverage >= 0.5 AND rre <= 5 END AS accepted FROM o CROSS JOIN (VALUES ('coverage'), ('rotation'), ('both')) v(rule)), a AS (SELECT *, accepted AND strict AS accepted_correct, accepted AND NOT strict AS accepted_error FROM r) SELECT rule, {COUNTS} FROM a GROUP BY rule"))
def rule_replay(spark, d):
    """AGG-13."""
    rules = {"coverage": F.col("coverage") >= 0.5, "rotation": F.col("rre") <= 5, "both": (F.col("coverage") >= 0.5) & (F.col("rre") <= 5)}
    return _rounded(E.replay(_out(spark, d), rules))


@query("agg_ablation_cube", V.sql("runs", f"WITH {OUT} SELECT combo, split, count(*) AS requested, count(*) FILTER (WHERE structured) AS structured, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE accepted_correct) AS accepted_correct, round(median(rre), 4) AS median_rre FROM o GROUP BY CUBE (combo, split)"))
def ablation(spark, d):
    """AGG-22."""
    return E.ablation(_out(spark, d)).withColumn("median_rre", rounded("median_rre", 4))


PAIRED = f"""WITH {OUT}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, arm ORDER BY repeat DESC) AS n FROM o) WHERE n = 1), p AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(b.accepted_correct, false) AND NOT coalesce(a.accepted_correct, false) AS rescue, coalesce(a.accepted_correct, false) AND NOT coalesce(b.accepted_correct, false) AS destruction,
  coalesce(b.accepted_error, false) AND NOT coalesce(a.accepted_error, false) AS wrong_in, coalesce(a.accepted_error, false) AND NOT coalesce(b.accepted_error, false) AS wrong_out, a.repeat IS DISTINCT FROM b.repeat AS changed, b.rre - a.rre AS rre_delta FROM (SELECT * FROM l WHERE arm = 'baseline') a FULL JOIN (SELECT * FROM l WHERE arm = 'candidate') b ON a.pair_id = b.pair_id)"""


@query("compare_paired_policies", V.sql("runs", f"{PAIRED} SELECT * REPLACE (round(rre_delta, 4) + 0.0 AS rre_delta) FROM p"))
def policies(spark, d):
    """CMP-01, CMP-12."""
    return E.paired(_out(spark, d)).withColumn("rre_delta", rounded("rre_delta", 4))


@query("agg_primary_cost", V.sql("runs", f"WITH {OUT} SELECT dataset, arm, round(avg(CASE WHEN structured AND rre IS NOT NULL THEN rre / 5 + rte / 0.2 ELSE 100 END), 6) AS cost, count(*) FILTER (WHERE catastrophic) AS catastrophic, round(count(*) FILTER (WHERE strict) / count(*), 6) AS recall FROM o GROUP BY ALL"))
def cost(spark, d):
    """AGG-21."""
    return E.primary_cost(_out(spark, d)).withColumn("cost", rounded("cost")).withColumn("recall", rounded("recall"))


@query("agg_repeat_flips", V.sql("runs", f"WITH {OUT} SELECT pair_id, arm, count(*) AS repeats, count(DISTINCT strict) > 1 AS flips, count(*) FILTER (WHERE accepted_error) AS accepted_errors, CASE WHEN bool_and(accepted) THEN 'all' WHEN bool_or(accepted) THEN 'mixed' ELSE 'none' END AS repeatability FROM o GROUP BY ALL"))
def flips(spark, d):
    """CMP-05, AGG-44."""
    return E.flips(_out(spark, d))


@query("agg_sign_stability", V.sql("runs", f"{PAIRED} SELECT pair_id % 25 AS grp, count(rre_delta) AS n, round(median(rre_delta), 4) + 0.0 AS median, count(DISTINCT CASE WHEN abs(rre_delta) > 12 THEN sign(rre_delta) END) <= 1 AS stable FROM p GROUP BY 1"))
def stability(spark, d):
    """AGG-18, AGG-19."""
    p = E.paired(_out(spark, d)).withColumn("grp", F.col("pair_id") % 25)
    return E.sign_stability(p, "grp", "rre_delta", 12).withColumn("median", rounded("median", 4))


@query("compare_two_runs", V.sql("runs", "SELECT * FROM (SELECT repeat, CASE WHEN repeat % 31 = 0 THEN 'only_second' WHEN repeat % 37 = 0 THEN 'only_first' WHEN repeat % 11 = 0 AND status <> 'failed' THEN 'status' WHEN repeat % 13 = 0 AND NOT accepted THEN 'verdict' WHEN repeat % 7 = 0 AND rre IS NOT NULL THEN 'error' END AS difference, CASE WHEN repeat % 31 > 0 AND repeat % 37 > 0 AND rre IS NOT NULL THEN CASE WHEN repeat % 7 = 0 THEN 0.25 ELSE 0 END END AS moved FROM runs WHERE repeat % 31 > 0 OR repeat % 37 > 0) WHERE difference IS NOT NULL").replace("CASE WHEN repeat % 7 = 0 THEN 0.25 ELSE 0 END END", "CASE WHEN repeat % 7 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END END"))
def two_runs(spark, d):
    """CMP-03."""
    r = V.runs(spark, d)
    b = r.where("repeat % 37 > 0").withColumn("status", F.when(F.col("repeat") % 11 == 0, "failed").otherwise(F.col("status"))).withColumn("accepted", F.col("accepted") | (F.col("repeat") % 13 == 0)).withColumn("rre", F.col("rre") + F.when(F.col("repeat") % 7 == 0, 0.25).otherwise(0.0))
    return E.determinism(r.where("repeat % 31 > 0"), b, ["repeat"]).withColumn("moved", rounded("moved", 4))


@query("agg_failure_histogram", V.sql("runs", f"WITH {OUT} SELECT arm || ':' || reason AS failure, count(*) AS n FROM (SELECT arm, unnest(list_filter([CASE WHEN NOT structured THEN 'no_result' END, CASE WHEN catastrophic THEN 'catastrophic' END, CASE WHEN coverage < 0.1 THEN 'coverage' END], lambda r: r IS NOT NULL)) AS reason FROM o) GROUP BY 1"))
def histogram(spark, d):
    """AGG-42."""
    o = _out(spark, d).withColumn("reasons", F.array_compact(F.array(F.when(~F.col("structured"), F.lit("no_result")), F.when(F.col("catastrophic"), F.lit("catastrophic")), F.when(F.col("coverage") < 0.1, F.lit("coverage"))))).withColumn("stage", F.col("arm"))
    return E.failure_histogram(o)


@query("window_leaderboard", V.sql("runs", "WITH r AS (SELECT *, row_number() OVER w AS place, rank() OVER (PARTITION BY dataset ORDER BY accepted DESC, coverage DESC NULLS LAST) AS rank FROM runs WINDOW w AS (PARTITION BY dataset ORDER BY accepted DESC, coverage DESC NULLS LAST, repeat)) SELECT dataset, repeat, place, count(*) OVER (PARTITION BY dataset, rank) > 1 AS tied FROM r QUALIFY place <= 5"))
def board(spark, d):
    """WIN-14, CMP-11; a top-k report."""
    x = E.leaderboard(V.runs(spark, d), "dataset", [F.col("accepted").desc(), F.col("coverage").desc_nulls_last(), F.col("repeat")], 5)
    return x.select("dataset", "repeat", F.col("place").cast("long").alias("place"), "tied")


@query("window_ordinal_share", V.sql("runs", "SELECT repeat, round(r / greatest(max(r) OVER (PARTITION BY pair_id), 1), 6) AS share FROM (SELECT pair_id, repeat, dense_rank() OVER (PARTITION BY pair_id ORDER BY coverage) - 1 AS r FROM runs WHERE coverage IS NOT NULL)"))
def shares(spark, d):
    """WIN-12."""
    return E.ordinal_share(V.runs(spark, d).where("coverage IS NOT NULL"), "pair_id", "coverage").select("repeat", rounded("share").alias("share"))


@query("window_stratified_selection", V.sql("runs", """WITH s AS (SELECT pair_id, max(rre) - min(rre) AS dispersion, 0.5003 - avg(coverage) AS margin FROM runs GROUP BY pair_id HAVING count(rre) > 0), a AS (SELECT pair_id, 'dispersed' AS role FROM s ORDER BY dispersion DESC, pair_id LIMIT 6),
   b AS (SELECT pair_id, 'near_boundary' AS role FROM s WHERE pair_id NOT IN (SELECT pair_id FROM a) ORDER BY round(abs(margin), 9), pair_id LIMIT 4), c AS (SELECT pair_id, 'high_margin' AS role FROM s WHERE pair_id NOT IN (SELECT pair_id FROM a UNION SELECT pair_id FROM b) ORDER BY round(margin, 9) DESC, pair_id LIMIT 3) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""))
def strata(spark, d):
    """WIN-13; a selection of fixed size is the feature."""
    s = V.runs(spark, d).groupBy("pair_id").agg((F.max("rre") - F.min("rre")).alias("dispersion"), F.round(0.5003 - F.avg("coverage"), 9).alias("margin"), F.count("rre").alias("n")).where("n > 0")
    return E.strata(s, {"dispersed": 6, "near_boundary": 4, "high_margin": 3})


#: The resamples' draws in SQL: the same two rounds of 32-bit arithmetic as the operator's.
BOOT = """m AS (SELECT dataset, pair_id, avg(rre) FILTER (WHERE arm = 'baseline') AS b, avg(rre) FILTER (WHERE arm = 'candidate') AS c FROM runs WHERE coverage IS NOT NULL GROUP BY ALL),
   k AS (SELECT dataset, b, c, CAST('0x' || substr(md5(CAST(pair_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM m WHERE b IS NOT NULL AND c IS NOT NULL),
   x0 AS (SELECT dataset, b, c, rep, xor(h, (rep * 2654435769) % 4294967296) AS x FROM k, range(10000) t(rep)), x1 AS (SELECT * REPLACE ((x * 1664525 + 1013904223) % 4294967296 AS x) FROM x0), x2 AS (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM x1),
   x3 AS (SELECT * REPLACE ((x * 22695477 + 1) % 4294967296 AS x) FROM x2), x4 AS (SELECT * REPLACE (xor(x, x >> 15) AS x) FROM x3),
   p AS (SELECT dataset, rep, sum(w * c) AS sc, sum(w * b) AS sb FROM (SELECT dataset, rep, b, c, CASE WHEN x < 1580030168 THEN 0 WHEN x < 3160060337 THEN 1 WHEN x < 3950075421 THEN 2 WHEN x < 4213413783 THEN 3 WHEN x < 4279248373 THEN 4 WHEN x < 4292415291 THEN 5 WHEN x < 4294609777 THEN 6 ELSE 7 END AS w FROM x4) GROUP BY ALL),
   g AS (SELECT dataset, quantile_cont(1 - sc / sb, 0.025) AS low, quantile_cont(1 - sc / sb, 0.975) AS high FROM p WHERE sb <> 0 GROUP BY dataset)"""


@query("agg_paired_bootstrap", V.sql("runs", f"WITH {BOOT} SELECT dataset, count(*) AS n, round(1 - avg(c) / avg(b), 6) AS improvement, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, 1 - avg(c) / avg(b) >= 0.10 AND any_value(low) > 0 AS passed FROM k JOIN g USING (dataset) GROUP BY dataset"))
def bootstrap(spark, d):
    """AGG-12."""
    r = V.runs(spark, d).where("coverage IS NOT NULL").groupBy("dataset", "pair_id").agg(F.avg(F.when(F.col("arm") == "baseline", F.col("rre"))).alias("base"), F.avg(F.when(F.col("arm") == "candidate", F.col("rre"))).alias("cand"))
    out = E.paired_bootstrap(r, "base", "cand", "dataset", "pair_id")
    return out.select("dataset", "n", *[rounded(c).alias(c) for c in ("improvement", "low", "high")], "passed")


@query("decide_acceptance_gate", V.sql("runs", f"WITH {OUT}, s AS (SELECT dataset, count(*) FILTER (WHERE catastrophic) / count(*) AS bad, avg(coverage) AS coverage, median(rre) AS rre, count(*) FILTER (WHERE accepted_correct) / nullif(count(*) FILTER (WHERE accepted), 0) AS precision FROM o GROUP BY dataset), f AS (SELECT dataset, list_sort(list_filter([CASE WHEN NOT bad <= 0.2503 THEN 'catastrophic' END, CASE WHEN NOT coverage >= 0.5003 THEN 'coverage' END, CASE WHEN NOT rre <= 12.003 THEN 'median_rre' END, CASE WHEN precision IS NULL OR NOT precision >= 0.0503 THEN 'precision' END], lambda r: r IS NOT NULL)) AS failed_checks FROM s) SELECT *, len(failed_checks) = 0 AS passed FROM f"))
def acceptance(spark, d):
    """CLU-27, CLU-28, CMP-08, CMP-09, CMP-10."""
    s = E.confusion(_out(spark, d), "dataset")
    return E.gate(s, {"catastrophic": F.col("catastrophic") / F.col("requested") <= 0.2503, "coverage": F.col("mean_coverage") >= 0.5003, "median_rre": F.col("median_rre") <= 12.003, "precision": F.col("precision") >= 0.0503}).select("dataset", "failed_checks", "passed")


@query("join_three_way_cycles", V.sql("workers", """WITH e AS (SELECT pair_id * 2 + replicate // 3 AS grp, replicate % 3 AS i, (replicate + 1) % 3 AS j, yaw, x, y FROM workers WHERE direction = 'forward'), n AS (SELECT grp, i FROM e UNION SELECT grp, j FROM e), t AS (SELECT grp FROM n GROUP BY grp HAVING count(*) = 3)
   SELECT grp, 0 AS a, 1 AS b, 2 AS c, p.grp IS NOT NULL AND q.grp IS NOT NULL AND r.grp IS NOT NULL AS available, round(abs(p.yaw + q.yaw + r.yaw), 4) AS dr FROM t LEFT JOIN (SELECT * FROM e WHERE i = 0) p USING (grp) LEFT JOIN (SELECT * FROM e WHERE i = 1) q USING (grp) LEFT JOIN (SELECT * FROM e WHERE i = 2) r USING (grp)"""))
def cycles(spark, d):
    """JOI-23, CMP-20."""
    e = V.workers(spark, d).where("direction = 'forward'").select(F.expr("pair_id * 2 + replicate div 3").alias("grp"), (F.col("replicate") % 3).alias("i"), ((F.col("replicate") + 1) % 3).alias("j"), F.col("transform").alias("t"))
    return E.three_way_cycles(e).select("grp", "a", "b", "c", "available", rounded("dr", 4).alias("dr"))
