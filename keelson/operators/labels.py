"""Object-pair labels and their audits, detection metrics, sampling, and gates over geometry summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators import grouped
from keelson.sources.durable import drop_durable, durable


def _shared_cells(points: DataFrame, cell: float, emit, schema: str, block: int = 4_000_000) -> DataFrame:
    """``emit`` of the objects of every scan and the next that share a cell: it gets columns ``group`` (in order), ``a``, ``b``, ``common`` and the
    objects' numbers of cells ``na``, ``nb``, and how many groups there are. A point is shuffled to its two pairs, many pairs are a batch; pairs of
    objects are never rows of a shuffle. A pair's counts are a product of two tables of cells, made in stretches of ``block`` numbers."""
    cells = [F.floor(F.col(k) / cell).cast("long").alias(f"i{k}") for k in "xyz"]
    p = points.select("scan_id", "label", *cells).where("label IS NOT NULL AND ix IS NOT NULL AND iy IS NOT NULL AND iz IS NOT NULL AND scan_id IS NOT NULL")
    p = p.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1)))).select((F.col("scan_id") - F.col("s")).alias("pair_id"), "s", "label", "ix", "iy", "iz")

    def solve(rows, at):
        side, label = rows.column("s").to_numpy(), rows.column("label").to_numpy()
        found = []
        for g, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if side[low] == side[high - 1]:
                continue  # a scan without the next one
            place = np.zeros(high - low, np.int64)
            for c in ("ix", "iy", "iz"):
                kinds, of = np.unique(rows.column(c).slice(low, high - low).to_numpy(), return_inverse=True)
                _, place = np.unique(place * len(kinds) + of, return_inverse=True)
            half = int(np.searchsorted(side[low:high], 1))
            sides = []
            for part in (slice(0, half), slice(half, high - low)):
                names, of = np.unique(label[low:high][part], return_inverse=True)
                code = np.unique(place[part] * len(names) + of)
                sides.append((names, code // len(names), code % len(names)))
            (a, ca, la), (b, cb, lb) = sides
            common, width = np.zeros((len(a), len(b))), max(1, block // (len(a) + len(b)))
            for first in range(0, int(place.max()) + 1, width):
                tables = []
                for names, c, of in sides:
                    mine = slice(*np.searchsorted(c, [first, first + width]))
                    t = np.zeros((min(width, int(place.max()) + 1 - first), len(names)), np.float32)
                    t[c[mine] - first, of[mine]] = 1
                    tables.append(t)
                common += tables[0].T @ tables[1]  # a stretch has fewer cells than single precision can count
            x, y = np.nonzero(common)
            found.append((np.full(len(x), g), a[x], b[y], common[x, y].astype(np.int64), np.bincount(la)[x], np.bincount(lb)[y]))
        empty = np.zeros(0, np.int64)
        columns = [np.concatenate(c) for c in zip(*found)] if found else [empty] * 6
        return emit(dict(zip(("group", "a", "b", "common", "na", "nb"), columns)), len(at) - 1)

    return grouped.whole_groups(p, ["pair_id"], ["s"], solve, schema)


def _objects(points: DataFrame) -> str:
    return dict(points.dtypes)["label"]


def pair_statistics(points: DataFrame, cell: float) -> DataFrame:
    """JOI-34, JOI-35: for objects a of a scan and b of the next that share a cell: the share of either's cells in
    common, the smaller share, and the ratio of their sizes. Only pairs that meet are made."""

    def emit(c, n):
        na, nb = c.pop("na"), c.pop("nb")
        return c | {"cover_a": c["common"] / na, "cover_b": c["common"] / nb, "size_ratio": np.minimum(na, nb) / np.maximum(na, nb)}

    kind = _objects(points)
    return _shared_cells(points, cell, emit, f"a {kind}, b {kind}, common long, cover_a double, cover_b double, size_ratio double")


def classified(stats: DataFrame, high: float = 0.5, low: float = 0.1, ratio: float = 0.5) -> DataFrame:
    """FUN-08: positive if the smaller cover reaches ``high`` and the sizes agree, negative under ``low``, otherwise
    ambiguous; a negative whose larger cover reaches ``high`` is hard."""
    small, large = F.least("cover_a", "cover_b"), F.greatest("cover_a", "cover_b")
    label = F.when((small >= high) & (F.col("size_ratio") >= ratio), "positive").when(small < low, "negative").otherwise("ambiguous")
    return stats.withColumn("label", label).withColumn("hard", (label == "negative") & (large >= high))


def label_audit(labelled: DataFrame) -> DataFrame:
    """AGG-23: per pair the labels' counts, positives that are one to one, objects with several positives on either side."""
    p = F.when(F.col("label") == "positive", 1)
    x = labelled.withColumn("of_a", F.count(p).over(Window.partitionBy("pair_id", "a"))).withColumn("of_b", F.count(p).over(Window.partitionBy("pair_id", "b")))
    kind = lambda k: F.count_if(F.col("label") == k).alias(k)
    pos = F.col("label") == "positive"
    return x.groupBy("pair_id").agg(kind("positive"), kind("negative"), kind("ambiguous"), F.count_if("hard").alias("hard"), F.count_if(pos & (F.col("of_a") == 1) & (F.col("of_b") == 1)).alias("one_to_one"), F.count_distinct(F.when(pos & (F.col("of_a") > 1), F.col("a"))).alias("split"), F.count_distinct(F.when(pos & (F.col("of_b") > 1), F.col("b"))).alias("merged"))


def pair_audit(points: DataFrame, cell: float, high: float = 0.5, low: float = 0.1, ratio: float = 0.5) -> DataFrame:
    """AGG-23: :func:`label_audit` of the :func:`classified` :func:`pair_statistics`, counted where a pair's cells are: a pair is one row."""

    def emit(c, n):
        g, x, y = c["group"], c["common"] / c["na"], c["common"] / c["nb"]
        small, large = np.minimum(x, y), np.maximum(x, y)
        positive = (small >= high) & (np.minimum(c["na"], c["nb"]) / np.maximum(c["na"], c["nb"]) >= ratio)
        negative = ~positive & (small < low)
        count = lambda on: np.bincount(g[on], minlength=n)
        of, many = [], []
        for side in ("a", "b"):
            # how many positives each object has
            names, kind = np.unique(c[side], return_inverse=True)
            objects, at, times = np.unique((g * max(1, len(names)) + kind)[positive], return_inverse=True, return_counts=True)
            of.append(times[at])
            many.append(np.bincount(objects[times > 1] // max(1, len(names)), minlength=n))
        found = np.flatnonzero(count(np.ones(len(g), bool)))
        one = np.bincount(g[positive][(of[0] == 1) & (of[1] == 1)], minlength=n)
        out = {"positive": count(positive), "negative": count(negative), "ambiguous": count(~positive & ~negative), "hard": count(negative & (large >= high)), "one_to_one": one, "split": many[0], "merged": many[1]}
        return {"group": found} | {k: v[found] for k, v in out.items()}

    return _shared_cells(points, cell, emit, "positive long, negative long, ambiguous long, hard long, one_to_one long, split long, merged long")


def detection(rows: DataFrame, key: str, score: Column, truth: Column, threshold: float) -> DataFrame:
    """AGG-29: precision, recall (four digits) and the F1 of those; 0 where a base is empty."""
    says = score >= threshold
    x = rows.groupBy(key).agg(F.count_if(says & truth).alias("tp"), F.count_if(says & ~truth).alias("fp"), F.count_if(~says & truth).alias("fn"))
    r = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    x = x.withColumn("precision", r(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", r(F.col("tp"), F.col("tp") + F.col("fn")))
    return x.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def margins(rows: DataFrame, key: str, bounds: dict[str, tuple[float, bool]]) -> DataFrame:
    """AGG-41: per row and measure the signed distance from its bound in units of the bound (positive: inside).
    ``bounds``: measure -> (bound, a larger value is better); a null measure has a null margin."""
    entries = [F.struct(F.lit(name).alias("measure"), (F.col(name) / bound - 1 if larger else 1 - F.col(name) / bound).alias("margin")) for name, (bound, larger) in bounds.items()]
    return rows.select(key, F.explode(F.array(*entries)).alias("m")).select(key, "m.measure", "m.margin")


def kernel(descriptors: DataFrame) -> DataFrame:
    """FUN-04: exp(-mean squared difference / 2) of standardised descriptors (``key, node, v``) of the nodes of a key,
    a < b. Population deviation by position; a constant position counts as 0."""
    flat = descriptors.select("key", "node", F.posexplode("v").alias("at", "x"))
    w = Window.partitionBy("key", "at")
    sd = F.stddev_pop("x").over(w)
    z = flat.select("key", "node", "at", F.when(sd > 1e-12, (F.col("x") - F.avg("x").over(w)) / sd).otherwise(0.0).alias("z"))
    v = z.groupBy("key", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "z"))), lambda p: p["z"]).alias("z"))
    a, b = v.select("key", F.col("node").alias("a"), F.col("z").alias("za")), v.select("key", F.col("node").alias("b"), F.col("z").alias("zb"))
    d = F.aggregate(F.zip_with("za", "zb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, p: s + p) / F.size("za")
    return a.join(b, "key").where("a < b").select("key", "a", "b", F.exp(-d / 2).alias("similarity"))


def geometry_gate(pairs: DataFrame) -> DataFrame:
    """FUN-10: a candidate summary against its baseline: safe if it keeps 85 % of the points and 80 % of the extent and
    the conflict grows by at most 5 %; improved if moreover the conflict falls by 10 %. Ratios are rounded to nine digits first: at a
    bound, the order in which a sum was added up would decide."""
    ratio = lambda c: F.round(F.col(f"cand_{c}") / F.greatest(F.col(f"base_{c}"), F.lit(1e-12)), 9)
    x = pairs.withColumn("points_ratio", ratio("points")).withColumn("extent_ratio", ratio("extent")).withColumn("conflict_ratio", ratio("conflict"))
    safe = (F.col("points_ratio") >= 0.85) & (F.col("extent_ratio") >= 0.80) & (F.col("conflict_ratio") <= 1.05)
    return x.withColumn("safe", F.coalesce(safe, F.lit(False))).withColumn("improved", F.col("safe") & (F.col("conflict_ratio") <= 0.90))


def hash_order(rows: DataFrame, key: str, item: str, context: str) -> DataFrame:
    """FUN-14, CMP-28: a repeatable permutation of a key's items, by the MD5 of context, key and item."""
    h = F.md5(F.concat_ws(":", F.lit(context), F.col(key).cast("string"), F.col(item).cast("string")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(h, item)) - 1)


def resampled(rows: DataFrame, key: str, item: str, n: int, context: str) -> DataFrame:
    """CMP-28: ``n`` items of each key: without replacement if there are so many, else the permutation again and again."""
    p = hash_order(rows, key, item, context)
    size = F.count("*").over(Window.partitionBy(key))
    times = F.floor((F.lit(n) - 1 - F.col("place")) / F.col("size"))
    x = p.withColumn("size", size).where(F.col("place") < n).withColumn("time", F.explode(F.sequence(F.lit(0), F.when(F.col("size") >= n, 0).otherwise(times).cast("int"))))
    return x.select(key, item, (F.col("place") + F.col("time") * F.col("size")).alias("place"))


def prefix_children(children: DataFrame, separator: str = "_") -> DataFrame:
    """JOI-19: ids "scan_k" by scan: the sorted list of each scan's children; ids without a separator are left out."""
    x = children.where(F.col("id").contains(separator))
    return x.groupBy(F.substring_index("id", separator, 1).alias("scan")).agg(F.array_sort(F.collect_list("id")).alias("children"))


def merged_sets(members: DataFrame) -> DataFrame:
    """SET-06: sets (``set_id, item``) that share an item, directly or over others, get one group: the smallest set id.
    Labels pass from sets to items and back, and each set then takes its group's own label, so a chain shrinks to less than
    half in a round; until they stay. The state is one stored row a set."""
    m = members.select("set_id", "item").distinct()
    now = durable(m.select("set_id").distinct().withColumn("grp", F.col("set_id")), "groups")
    while True:
        low = m.join(now, "set_id").groupBy("item").agg(F.min("grp").alias("low"))
        met = durable(m.join(low, "item").groupBy("set_id").agg(F.min("low").alias("grp")), "groups")
        new = durable(met.join(met.select(F.col("set_id").alias("grp"), F.col("grp").alias("up")), "grp").select("set_id", F.col("up").alias("grp")), "groups")
        settled = new.join(now.withColumnRenamed("grp", "old"), "set_id").where("grp <> old").isEmpty()
        drop_durable(now)
        drop_durable(met)
        now = new
        if settled:
            return now
