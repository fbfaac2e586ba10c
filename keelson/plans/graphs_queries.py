from pyspark.sql import functions as F

from keelson.functions.vectors import rounded
from keelson.operators import graphs as G
from keelson.plans import views as V
from keelson.plans.registry import query

#: Objects of a scan: those that at least 10 relations start from.
OBJ = "objects AS (SELECT scan_id, sub AS object_id FROM relations GROUP BY scan_id, sub HAVING count(*) >= 10)"
VOCAB = "vocab AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS slot FROM (SELECT DISTINCT name FROM relations WHERE name NOT LIKE 'R/%'))"


def _objects(rel):
    return rel.groupBy("scan_id", F.col("sub").alias("object_id")).agg(F.count("*").alias("n")).where("n >= 10").drop("n")


def _vocabulary(rel):
    """The distinct names (a handful) in order."""
    from pyspark.sql import Window

    names = rel.where("name NOT LIKE 'R/%'").select("name").distinct()
    return names.withColumn("slot", F.row_number().over(Window.orderBy("name")) - 1)


@query("scan_surviving_triples", V.sql("relations", f"WITH {OBJ} SELECT scan_id, sub, obj, name, pos FROM relations SEMI JOIN (SELECT scan_id, object_id AS sub FROM objects) USING (scan_id, sub) SEMI JOIN (SELECT scan_id, object_id AS obj FROM objects) USING (scan_id, obj)"))
def triples(spark, d):
    """SRC-02."""
    r = V.relations(spark, d)
    return G.surviving_triples(r, _objects(r))


@query("scan_predicted_triples", V.sql("relations points", "WITH k AS (SELECT scan_id, label FROM points WHERE label <> 0 GROUP BY ALL HAVING count(*) >= 50) SELECT r.scan_id, r.sub, r.obj, r.name, r.pos FROM (SELECT scan_id, sub % 97 AS sub, obj, name, pos FROM relations) r JOIN k a ON a.scan_id = r.scan_id AND a.label = r.sub JOIN k b ON b.scan_id = r.scan_id AND b.label = r.obj WHERE name NOT LIKE 'R/%'"))
def predicted(spark, d):
    """SRC-03: a scan's relations as the arrays of a predicted graph."""
    r = V.relations(spark, d).groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sub", "obj", "name"))).alias("x"))
    edges = F.transform("x", lambda e: F.struct((e["sub"] % 97).alias("sub"), e["obj"].alias("obj"), e["pos"].alias("pos")))
    names = F.transform("x", lambda e: F.when(e["name"].startswith("R/"), "none").otherwise(e["name"]))
    return G.predicted_triples(r.select("scan_id", edges.alias("edges"), names.alias("names")), V.points(spark, d))


@query("join_explicit_edges", V.sql("relations", "SELECT scan_id, sub, obj, pos, row_number() OVER (PARTITION BY scan_id ORDER BY pos, sub, obj) - 1 AS edge FROM (SELECT scan_id, sub, obj, min(pos) AS pos FROM relations GROUP BY ALL)"))
def edges(spark, d):
    """JOI-05."""
    return G.explicit_edges(V.relations(spark, d)).withColumn("edge", F.col("edge").cast("long"))


@query("join_edge_completion", V.sql("relations", f"WITH {OBJ}, p AS (SELECT DISTINCT scan_id, sub, obj FROM relations) SELECT scan_id, sub, count(*) FILTER (WHERE kind = 'explicit') AS explicit, count(*) FILTER (WHERE kind = 'none') AS filled FROM (SELECT *, 'explicit' AS kind FROM p UNION ALL SELECT *, 'none' FROM (SELECT a.scan_id, a.object_id AS sub, b.object_id AS obj FROM objects a JOIN objects b ON a.scan_id = b.scan_id AND a.object_id <> b.object_id EXCEPT SELECT * FROM p)) GROUP BY ALL"))
def completion(spark, d):
    """JOI-04."""
    r = V.relations(spark, d)
    return G.completed_edges(r, _objects(r)).groupBy("scan_id", "sub").agg(F.count_if(F.col("kind") == "explicit").alias("explicit"), F.count_if(F.col("kind") == "none").alias("filled"))


@query("agg_relation_bag", V.sql("relations", f"""WITH {VOCAB}, n AS (SELECT scan_id, sub, slot, count(*) AS n FROM relations JOIN vocab USING (name) GROUP BY ALL), k AS (SELECT DISTINCT scan_id, sub FROM n)
   SELECT scan_id, sub, list(coalesce(n.n, 0) ORDER BY v.slot) AS bag FROM k CROSS JOIN vocab v LEFT JOIN n USING (scan_id, sub, slot) GROUP BY scan_id, sub"""))
def bag(spark, d):
    """AGG-01, AGG-02, FUN-12."""
    r = V.relations(spark, d)
    return G.bag_of_words(r, _vocabulary(r))


@query("agg_root_object", V.sql("relations", f"""WITH {OBJ}, c AS (SELECT scan_id, o, count(*) AS n FROM (SELECT scan_id, sub AS o FROM relations UNION ALL SELECT scan_id, obj FROM relations) GROUP BY ALL), t AS (SELECT scan_id, o FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, o) AS k FROM c) WHERE k = 1)
   SELECT f.scan_id, coalesce(t.o, f.first) AS root FROM (SELECT scan_id, min(object_id) AS first FROM objects GROUP BY scan_id) f LEFT JOIN (SELECT t.* FROM t JOIN objects x ON x.scan_id = t.scan_id AND x.object_id = t.o) t USING (scan_id)"""))
def root(spark, d):
    """AGG-03."""
    r = V.relations(spark, d)
    return G.roots(r, _objects(r))


@query("join_global_id_anchors", "WITH x AS (SELECT l_returnflag = 'A' AS src, l_linenumber AS pair_id, l_suppkey AS object_id, l_partkey AS global_id, (l_orderkey * 8 + l_linenumber) * 1000 + l_suppkey AS pos FROM lineitem), s AS (SELECT pair_id, global_id, arg_max(object_id, pos) AS s FROM x WHERE src GROUP BY ALL), r AS (SELECT pair_id, global_id, arg_max(object_id, pos) AS r FROM x WHERE NOT src GROUP BY ALL) SELECT * FROM s JOIN r USING (pair_id, global_id)")
def global_ids(spark, d):
    """JOI-02."""
    x = V.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("pair_id"), F.col("l_suppkey").alias("object_id"), F.col("l_partkey").alias("global_id"), F.expr("(l_orderkey * 8 + l_linenumber) * 1000 + l_suppkey").alias("pos"), "l_returnflag")
    return G.anchors_by_global_id(x.where("l_returnflag = 'A'"), x.where("l_returnflag <> 'A'"))


@query("join_pair_merge", V.sql("nodes", """WITH x AS (SELECT pair_id, side, node, row_number() OVER (PARTITION BY pair_id, side ORDER BY node) - 1 AS local_idx, count(*) FILTER (WHERE side = 0) OVER (PARTITION BY pair_id) AS a, count(*) FILTER (WHERE side = 1) OVER (PARTITION BY pair_id) AS b FROM nodes)
   SELECT pair_id, side, node, local_idx, CASE side WHEN 1 THEN local_idx + a ELSE local_idx END AS pair_idx, CASE side WHEN 0 THEN local_idx + b ELSE local_idx END AS swapped_idx FROM x"""))
def merged(spark, d):
    """JOI-03, SET-04."""
    return G.merge_pair(V.nodes(spark, d)).withColumn("local_idx", F.col("local_idx").cast("long"))


@query("validate_graph_contract", V.sql("relations", f"""WITH {OBJ}, {VOCAB}, i AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY object_id) - 1 AS idx FROM objects), w AS (SELECT count(*) AS width FROM vocab),
   e AS (SELECT scan_id, max(greatest(sub, obj)) AS top FROM relations GROUP BY scan_id), n AS (SELECT scan_id, count(*) AS n, max(object_id) AS far FROM i GROUP BY scan_id),
   b AS (SELECT DISTINCT scan_id, sub FROM relations JOIN vocab USING (name)), g AS (SELECT i.scan_id, bool_or(b.sub IS NULL) AS lacks FROM i LEFT JOIN b ON b.scan_id = i.scan_id AND b.sub = i.object_id GROUP BY i.scan_id)
   SELECT n.scan_id, list_filter([CASE WHEN e.top >= n.n THEN 'edge_out_of_range' END, CASE WHEN lacks THEN 'bag_width' END, CASE WHEN far > 100 THEN 'extent' END], lambda x: x IS NOT NULL) AS errors FROM n JOIN e USING (scan_id) JOIN g USING (scan_id)"""))
def contract(spark, d):
    """VAL-03, VAL-04: edges by raw ids on purpose, so that the rule has something to find."""
    r = V.relations(spark, d)
    obj = G.dense_index(_objects(r))
    voc = _vocabulary(r)
    bags = G.bag_of_words(r, voc).withColumnRenamed("sub", "object_id")
    n = obj.join(bags, ["scan_id", "object_id"], "left").withColumn("bag", F.coalesce("bag", F.array().cast("array<long>"))).withColumn("size_m", F.col("object_id").cast("double"))
    return G.contract_errors(n, r.select("scan_id", F.col("sub").alias("src_idx"), F.col("obj").alias("dst_idx")), 10)


@query("join_adjacency_jaccard", V.sql("relations", """WITH e AS (SELECT DISTINCT scan_id, o, p FROM (SELECT scan_id, sub AS o, obj AS p FROM relations UNION ALL SELECT scan_id, obj, sub FROM relations) WHERE o <> p), s AS (SELECT scan_id, o, list(p) AS near FROM e GROUP BY ALL), q AS (SELECT DISTINCT scan_id, sub AS a, obj AS b FROM relations)
   SELECT q.scan_id, a, b, round(CASE WHEN len(list_distinct(list_concat(coalesce(x.near, []), coalesce(y.near, [])))) = 0 THEN 0 ELSE len(list_intersect(coalesce(x.near, []), coalesce(y.near, []))) / len(list_distinct(list_concat(coalesce(x.near, []), coalesce(y.near, [])))) END, 6) AS jaccard
   FROM q LEFT JOIN s x ON x.scan_id = q.scan_id AND x.o = a LEFT JOIN s y ON y.scan_id = q.scan_id AND y.o = b"""))
def jaccard(spark, d):
    """SET-03, CMP-18."""
    r = V.relations(spark, d)
    return G.adjacency_jaccard(r, r.select("scan_id", F.col("sub").alias("a"), F.col("obj").alias("b")).distinct()).withColumn("jaccard", rounded("jaccard"))


@query("validate_rank_permutation", V.sql("nodes", "SELECT pair_id, side, len(list_distinct(list(node))) = count(*) AND max(i) = count(*) - 1 AS good FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY node) - 1 AS i FROM nodes) GROUP BY ALL"))
def permutation(spark, d):
    """VAL-05: of local indices gathered in arrival order, whatever it is."""
    n = G.merge_pair(V.nodes(spark, d)).groupBy("pair_id", "side").agg(F.collect_list("local_idx").alias("ranking"))
    return n.select("pair_id", "side", G.is_permutation("ranking").alias("good"))


@query("filter_split_anchors", V.sql("nodes anchors", "SELECT pair_id, s, r FROM anchors WHERE s % 3 <> 0 AND r % 3 <> 0"))
def split(spark, d):
    """CMP-25, JOI-18."""
    return G.split_anchors(V.anchors(spark, d), V.nodes(spark, d).where("node % 3 <> 0")).select("pair_id", "s", "r")


@query("sample_graph_perturbation", V.sql("relations", "SELECT DISTINCT scan_id, sub FROM relations WHERE CAST('0x' || substr(md5('11:' || scan_id || ':' || sub), 1, 8) AS BIGINT) % 1000 >= 250"))
def perturbation(spark, d):
    """CMP-24."""
    return G.perturb(V.relations(spark, d).select("scan_id", "sub").distinct(), ["scan_id", "sub"], 0.25, 11)


#: Labels of the perturbed edges.
NAMES = ["A/1-URGENT", "A/2-HIGH", "N/1-URGENT", "N/2-HIGH", "R/1-URGENT", "R/2-HIGH"]


@query("sample_relabelled_edges", V.sql("relations", f"WITH h AS (SELECT *, md5('7:' || scan_id || ':' || pos || ':' || sub) AS h, list_filter({NAMES}, lambda n: n <> name) AS others FROM relations), c AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 1000 < 300 AS changed FROM h) SELECT scan_id, sub, obj, pos, changed, CASE WHEN changed THEN others[1 + CAST('0x' || substr(h, 9, 8) AS BIGINT) % len(others)] ELSE name END AS name FROM c"))
def relabelled(spark, d):
    """CMP-24: edges with another label."""
    return G.relabelled(V.relations(spark, d), ["scan_id", "pos", "sub"], "name", NAMES, 0.3, 7)


@query("window_hash_subset", "SELECT c_custkey FROM customer ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 8")
def subset(spark, d):
    """WIN-15, JOI-17: a sample is the feature."""
    return G.hash_ordered_subset(V.table(spark, d, "customer"), "c_custkey", 8)
