"""Scene-graph builders: edges, bags of words, contracts.

Relations: ``scan_id, sub, obj, name, pos``; objects: ``scan_id, object_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def surviving_triples(relations: DataFrame, objects: DataFrame) -> DataFrame:
    """SRC-02: triples whose both ends are objects of the scan; triples stay as often as they occur."""
    s, o = objects.select("scan_id", F.col("object_id").alias("sub")), objects.select("scan_id", F.col("object_id").alias("obj"))
    return relations.join(s, ["scan_id", "sub"], "left_semi").join(o, ["scan_id", "obj"], "left_semi").select("scan_id", "sub", "obj", "name", "pos")


def predicted_triples(graphs: DataFrame, points: DataFrame, least: int = 50) -> DataFrame:
    """SRC-03: a predicted graph's labelled edges (``scan_id, edges`` array of (sub, obj, pos), ``names`` array in the same
    order) without those named none and those with an end that is no segment (label 0, or fewer than ``least`` points).
    Pairs stay as often as they occur; edges beyond the shorter of the arrays have no name and go too."""
    ids = points.where("label <> 0").groupBy("scan_id", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    e = graphs.select("scan_id", F.explode(F.arrays_zip("edges", "names")).alias("e")).select("scan_id", "e.edges.*", F.col("e.names").alias("name")).where("name <> 'none'")
    for end in ("sub", "obj"):
        e = e.join(ids.select("scan_id", F.col("label").alias(end)), ["scan_id", end], "left_semi")
    return e.select("scan_id", "sub", "obj", "name", "pos")


def explicit_edges(relations: DataFrame) -> DataFrame:
    """JOI-05, SRC-02: distinct (sub, obj) in the order of their first occurrence."""
    first = relations.groupBy("scan_id", "sub", "obj").agg(F.min("pos").alias("pos"))
    return first.withColumn("edge", F.row_number().over(Window.partitionBy("scan_id").orderBy("pos", "sub", "obj")) - 1)


def dense_index(objects: DataFrame) -> DataFrame:
    """AGG-04, SRC-16: object ids to 0, 1, 2... by id."""
    return objects.withColumn("idx", F.dense_rank().over(Window.partitionBy("scan_id").orderBy("object_id")) - 1)


def completed_edges(relations: DataFrame, objects: DataFrame, fill: str = "none") -> DataFrame:
    """JOI-04: the explicit pairs, and ``fill`` for every other ordered pair of different objects of a scan.

    The result has the square of a scan's objects by definition; scans are the unit of distribution.
    """
    pairs = relations.select("scan_id", "sub", "obj").distinct()
    a, b = objects.select("scan_id", F.col("object_id").alias("sub")), objects.select("scan_id", F.col("object_id").alias("obj"))
    rest = a.join(b, "scan_id").where("sub <> obj").join(pairs, ["scan_id", "sub", "obj"], "left_anti")
    return pairs.withColumn("kind", F.lit("explicit")).unionByName(rest.withColumn("kind", F.lit(fill)))


def bag_of_words(triples: DataFrame, vocabulary: DataFrame, key: str = "sub") -> DataFrame:
    """AGG-01, AGG-02, FUN-12: ``scan_id, key, bag`` - counts by position of ``vocabulary`` (``name, slot``);
    names outside it are ignored. The vocabulary is a fixed word list; its size is read, not assumed."""
    width = vocabulary.agg(F.coalesce(F.max("slot") + 1, F.lit(0)).alias("width"))
    n = triples.join(vocabulary, "name").groupBy("scan_id", key, "slot").agg(F.count("*").alias("n"))
    bags = n.groupBy("scan_id", key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"))
    return bags.join(F.broadcast(width)).select("scan_id", key, F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("bag"))


def roots(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """AGG-03: a scan's most frequent edge end (ties: smallest id); without edges, or if that is no object, the first object."""
    ends = edges.select("scan_id", F.explode(F.array("sub", "obj")).alias("object_id"), F.lit(1).alias("end"))
    marks = ends.union(objects.select("scan_id", "object_id", F.lit(0)))
    seen = marks.groupBy("scan_id", "object_id").agg(F.sum("end").alias("n"), (F.min("end") == 0).alias("is_object"))
    top = F.min(F.when(F.col("n") > 0, F.struct(-F.col("n"), F.col("object_id").alias("object_id"), "is_object")))
    first = F.min(F.when(F.col("is_object"), F.col("object_id")))
    scans = seen.groupBy("scan_id").agg(top.alias("top"), first.alias("first"), F.max("is_object").alias("known")).where("known")
    return scans.select("scan_id", F.coalesce(F.when(F.col("top.is_object") & F.col("scan_id").isNotNull(), F.col("top.object_id")), F.col("first")).alias("root"))


def anchors_by_global_id(source: DataFrame, reference: DataFrame) -> DataFrame:
    """JOI-02: objects of two scans with one global id; of a repeated global id the last position counts.
    Inputs: ``pair_id, object_id, global_id, pos``."""
    last = lambda df, name: df.groupBy("pair_id", "global_id").agg(F.max_by("object_id", "pos").alias(name))
    return last(source, "s").join(last(reference, "r"), ["pair_id", "global_id"])


def merge_pair(nodes: DataFrame) -> DataFrame:
    """JOI-03, SET-04: source nodes, then reference nodes with indices shifted by the source's count; and
    the other way round for the swapped pair. ``pair_id, side, node`` -> both indices."""
    local = F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("node")) - 1
    counts = nodes.groupBy("pair_id").agg(F.count_if(F.col("side") == 0).alias("sources"), F.count_if(F.col("side") == 1).alias("references"))
    return nodes.select("pair_id", "side", "node", local.alias("local_idx")).join(counts, "pair_id").select("pair_id", "side", "node", "local_idx", (F.col("local_idx") + F.col("side") * F.col("sources")).alias("pair_idx"), (F.col("local_idx") + (1 - F.col("side")) * F.col("references")).alias("swapped_idx"))


def contract_errors(nodes: DataFrame, edges: DataFrame, width: int, extent: float = 100.0) -> DataFrame:
    """VAL-03, VAL-04: ``scan_id, errors`` - every violated rule of a graph, in order.

    ``nodes``: ``scan_id, object_id, idx, bag, size_m``; ``edges``: ``scan_id, src_idx, dst_idx``."""
    n = nodes.groupBy("scan_id").agg(F.count("*").alias("n"), F.count_distinct("object_id").alias("ids"), F.min("idx").alias("low"), F.max("idx").alias("high"), F.max(F.abs(F.size("bag") - width)).alias("off"), F.max("size_m").alias("far"))
    e = edges.groupBy("scan_id").agg(F.min(F.least("src_idx", "dst_idx")).alias("e_low"), F.max(F.greatest("src_idx", "dst_idx")).alias("e_high"))
    x = n.join(e, "scan_id", "left")
    checks = [(F.col("ids") != F.col("n"), "object_ids_not_unique"), ((F.col("low") != 0) | (F.col("high") != F.col("n") - 1), "index_not_dense"), (F.coalesce((F.col("e_low") < 0) | (F.col("e_high") >= F.col("n")), F.lit(False)), "edge_out_of_range"), (F.col("off") != 0, "bag_width"), (F.col("far") > extent, "extent")]
    return x.select("scan_id", F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks])).alias("errors"))


def is_permutation(ranking: str | Column) -> Column:
    """VAL-05: the array has each of 0..n-1 once."""
    r = F.col(ranking) if isinstance(ranking, str) else ranking
    return F.when(F.size(r) == 0, True).otherwise(F.array_sort(r) == F.sequence(F.lit(0), F.size(r) - 1))


def adjacency_jaccard(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """SET-03, CMP-18: Jaccard of the undirected neighbour sets of two objects of a scan; 0 if both are empty.
    ``pairs``: ``scan_id, a, b``."""
    both = edges.select("scan_id", F.col("sub").alias("o"), F.col("obj").alias("p")).union(edges.select("scan_id", F.col("obj"), F.col("sub"))).where("o <> p")
    sets = both.groupBy("scan_id", "o").agg(F.collect_set("p").alias("near"))
    none = F.array().cast("array<long>")
    x = pairs.join(sets.select("scan_id", F.col("o").alias("a"), F.col("near").alias("near_a")), ["scan_id", "a"], "left").join(sets.select("scan_id", F.col("o").alias("b"), F.col("near").alias("near_b")), ["scan_id", "b"], "left")
    x = x.withColumn("near_a", F.coalesce("near_a", none)).withColumn("near_b", F.coalesce("near_b", none))
    union = F.size(F.array_union("near_a", "near_b"))
    return x.select("scan_id", "a", "b", F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect("near_a", "near_b")) / union).alias("jaccard"))


def split_anchors(anchors: DataFrame, processed: DataFrame) -> DataFrame:
    """CMP-25, JOI-18: anchors both of whose ends were processed (``pair_id, node``)."""
    return anchors.join(processed.select("pair_id", F.col("node").alias("s")), ["pair_id", "s"], "left_semi").join(processed.select("pair_id", F.col("node").alias("r")), ["pair_id", "r"], "left_semi")


def perturb(items: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    """CMP-24: drops about ``share`` of the rows, by a hash of the key (any engine can repeat it)."""
    text = F.concat_ws(":", F.lit(str(seed)), *keys)
    return items.where(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 1000 >= int(share * 1000))


def relabelled(items: DataFrame, keys: list[str], column: str, vocabulary: list[str], share: float, seed: int) -> DataFrame:
    """CMP-24: about ``share`` of the rows, by a hash of the key, get another label than they have, drawn from the
    vocabulary by the same hash; labels that the vocabulary lacks may become any of it. ``changed`` marks them.
    A vocabulary of one label changes only others; a null label stays."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))
    draw = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    others = F.array_remove(F.array(*[F.lit(v) for v in sorted(set(vocabulary))]), F.col(column))
    hit = (draw(1) % 1000 < int(share * 1000)) & F.coalesce(F.size(others) > 0, F.lit(False)) & F.col(column).isNotNull()
    return items.withColumn("changed", hit).withColumn(column, F.when(hit, F.get(others, (draw(9) % F.size(others)).cast("int"))).otherwise(F.col(column)))


def hash_ordered_subset(groups: DataFrame, key: str, n: int) -> DataFrame:
    """WIN-15, JOI-17: the first ``n`` groups by the SHA-256 of their key; each task keeps n."""
    h = F.sha2(F.col(key).cast("string"), 256)
    return groups.select(key).distinct().orderBy(h, key).limit(n)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
