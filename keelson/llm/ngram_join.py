"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each document becomes its set of hashed word n-grams; equal sets are one *class*, and everything
   after that works on one representative of a class.
2. MinHash bands propose candidates. A bucket is a star (member, smallest member), never a clique;
   the stars' connected components are the areas within which candidates can lie.
3. An area is dealt out in blocks: its members fall into blocks of about ``BLOCK`` by hash, and every
   pair of blocks is one small unit of work, so a large area spreads over many tasks.
4. In a unit, the pairs that share a band are compared MinHash value by value, in steps. After each
   step a pair is dropped if the posterior probability that its similarity reaches the threshold,
   given the matches so far and a uniform prior, is below ``TOLERANCE``. What is left is verified on
   the whole sets.
5. Only sums and spanning links leave a unit: for each member its number of links, and its links to
   the smallest linked member it reaches there. So a group of n mutually similar texts costs n rows
   a unit and not n^2, and still every pair of different texts has been looked at.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import components, durable, join_hot, keep_told, marked, words_text
from keelson.llm.lexicon import released, slices
from keelson.llm.tokens import Cached, contract_words

NGRAM = 5
#: The threshold as a fraction, so that the exact test is one of whole numbers.
THRESHOLD = (4, 5)
BANDS, ROWS = 40, 6  # a pair at the threshold shares no band with probability 5e-6
STEP = 16
TOLERANCE = 1e-9
BLOCK = 256
#: Columns of the incidence matrices that are multiplied at a time.
WIDE = 4096

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """A text's distinct n-grams as a sorted array of 64-bit hashes."""

    def __init__(self, n: int):
        self.n = n
        self.words = Cached(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))

    def __call__(self, text: str) -> np.ndarray:
        words = contract_words(text)
        if not words:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(w))  # a shorter text is one n-gram of all its words
        h = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * _MULTIPLIER + w[i : len(w) - n + 1 + i]
        return np.unique(_mix(h))


@lru_cache(maxsize=2)
def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 31, count, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]


def minhash(grams: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """``count`` MinHash values of a set that isn't empty."""
    a, b = _family(count)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        out = np.minimum(out, (a * x[None, i : i + 512] + b).min(axis=1))
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(documents, bands) 64-bit keys."""
    rows = signatures.reshape(len(signatures), bands, -1).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(rows.shape[2]):
        h = _mix(h * _MULTIPLIER + rows[:, :, i])
    return h


@lru_cache(maxsize=8)
def least_matches(count: int, step: int, threshold: tuple[int, int], tolerance: float) -> dict[int, int]:
    """After n compared values, the fewest matches with which P(similarity >= threshold | matches) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    t = threshold[0] / threshold[1]
    out = {}
    for n in range(step, count + 1, step):
        tail = 0.0
        for m in range(n + 1):  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def _overlaps(sets_a, sets_b, i, j) -> np.ndarray:
    """Sizes of the intersections of pairs (i, j): pair by pair, or by matrix products if they are many."""
    if len(i) <= 2 * (len(sets_a) + len(sets_b)):
        return np.array([np.intersect1d(sets_a[x], sets_b[y], assume_unique=True).size for x, y in zip(i.tolist(), j.tolist())], np.int64)
    every = np.unique(np.concatenate(sets_a + sets_b))
    at_a, at_b = [np.searchsorted(every, s) for s in sets_a], [np.searchsorted(every, s) for s in sets_b]
    total = np.zeros((len(sets_a), len(sets_b)))
    for low in range(0, len(every), WIDE):

        def dense(at):
            out = np.zeros((len(at), WIDE), np.float32)
            for k, p in enumerate(at):
                lo, hi = np.searchsorted(p, (low, low + WIDE))
                out[k, p[lo:hi] - low] = 1
            return out

        total += dense(at_a) @ dense(at_b).T
    return np.rint(total[i, j]).astype(np.int64)


def similar_pairs(a: list, b: list | None, threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of members ``(signature, set)`` at or above the threshold; within ``a`` if ``b`` is None."""
    own = b is None
    b = a if own else b
    sa, sb = np.stack([x[0] for x in a]), np.stack([x[0] for x in b])
    ka, kb = band_keys(sa), band_keys(sb)
    meet = np.zeros((len(a), len(b)), bool)
    for k in range(ka.shape[1]):
        meet |= ka[:, k, None] == kb[None, :, k]
    if own:
        meet &= np.tri(len(a), len(b), -1, dtype=bool).T
    i, j = np.nonzero(meet)
    matches = np.zeros(len(i), np.int64)
    for n, least in least_matches(sa.shape[1], STEP, threshold, tolerance).items():
        if not len(i):
            break
        matches += (sa[i, n - STEP : n] == sb[j, n - STEP : n]).sum(axis=1)
        on = matches >= least
        i, j, matches = i[on], j[on], matches[on]
    if not len(i):
        return i, j
    both = _overlaps([x[1] for x in a], [x[1] for x in b], i, j)
    size_a, size_b = np.array([len(x[1]) for x in a]), np.array([len(x[1]) for x in b])
    on = both * threshold[1] >= (size_a[i] + size_b[j] - both) * threshold[0]
    return i[on], j[on]


def _unit(low: int, high: int, members: dict[int, list], threshold, tolerance):
    """Rows (class, links, root) of one unit: members by block, as (class, copies, signature, set)."""
    own = low == high
    a, b = members.get(low, []), None if own else members.get(high, [])
    if not a or b == []:
        return
    i, j = similar_pairs([m[2:] for m in a], None if own else [m[2:] for m in b], threshold, tolerance)
    if not len(i):
        return
    every = a if own else a + b
    j = j if own else j + len(a)
    copies = np.array([m[1] for m in every], np.int64)
    links = np.zeros(len(every), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    order = np.argsort(np.array([m[0] for m in every], dtype=object), kind="stable")
    label = np.empty(len(every), np.int64)
    label[order] = np.arange(len(every))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            break
    for k in np.flatnonzero(links):
        yield every[k][0], int(links[k]), every[order[label[k]]][0]


def _near_rows(docs: DataFrame, text: str, doc_id: str, ngram: int = NGRAM, threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """:func:`near_groups` with ``text_hash`` and ``stays``: whether the row's id and text are the first of its group."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words_text(text).alias("text"), F.xxhash64(words_text(text)).alias("text_hash"))
    flat = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("set_id", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def sets(it):
        shingles = Shingler(ngram)
        for batch in slices(it):
            grams = [shingles(x) for x in batch.column(1).to_pylist()]
            full = [g for g in grams if len(g)]
            keys = iter(band_keys(np.stack([minhash(g) for g in full])).view(np.int64) if full else ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in grams], pa.binary()), pa.array([next(keys) if len(g) else None for g in grams], pa.list_(pa.int64()))], schema=flat)

    table = durable(rows.mapInArrow(released(sets), "doc_id long, text_hash long, set_id binary, keys array<long>"), "sets")
    classes = table.where("set_id IS NOT NULL").groupBy("set_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("lead"))
    # copies have the same keys: one row for each (key, class)
    buckets = table.where("set_id IS NOT NULL").select("set_id", F.explode("keys").alias("key")).distinct()
    heads = durable(buckets.groupBy("key").agg(F.min("set_id").alias("head"), F.count("*").alias("n")).where("n > 1"), "heads")
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a large group of near copies meets in its buckets: joins by bucket, area and root keep such rows where they are
    stars = join_hot(buckets, heads, ["key"], "n", max(total, 1)).where("set_id <> head").select("set_id", "head")
    areas = durable(components(stars, "set_id", "head").select(F.col("node").alias("set_id"), F.col("root").alias("area")), "areas")
    blocks = areas.groupBy("area").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"), F.count("*").alias("n"))
    dealt = join_hot(areas, blocks, ["area"], "n", areas.count()).join(classes.drop("lead"), "set_id").withColumn("mine", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = durable(dealt, "dealt")

    # second reading: the sets of the classes' first documents only, picked by a bitmap while scanning
    picked = marked(rows, F.xxhash64("doc_id"), dealt.select("first"), F.xxhash64("first"), "_marked").where("_marked").select("doc_id", "text")
    full = pa.schema([("doc_id", pa.int64()), ("set_id", pa.binary()), ("grams", pa.binary()), ("values", pa.binary())])

    def contents(it):
        shingles = Shingler(ngram)
        for batch in slices(it):
            grams = [shingles(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in grams], pa.binary()), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array([minhash(g).tobytes() if len(g) else b"" for g in grams], pa.binary())], schema=full)

    have = picked.mapInArrow(released(contents), "doc_id long, set_id binary, grams binary, values binary")
    mine, other = F.col("mine"), F.col("other")
    units = (
        have.join(dealt.withColumnsRenamed({"first": "_first", "set_id": "_set"}), (F.col("set_id") == F.col("_set")) & F.col("doc_id").eqNullSafe(F.col("_first")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("area", F.least(mine, other).alias("low"), F.greatest(mine, other).alias("high"), "mine", "set_id", "copies", "grams", "values")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(parts, "area", "low", "high").sortWithinPartitions("area", "low", "high")
    linked = pa.schema([("set_id", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def work(it):
        def close(unit, members):
            for side in members:  # repeated rows bring a class twice
                members[side] = list({m[0]: m for m in members[side]}.values())
            if sum(map(len, members.values())) > 1:
                yield from _unit(*unit[1:], members, threshold, tolerance)

        def found():
            now, members = None, {}
            for batch in it:
                area, low, high, mine, set_id, copies, grams, values = (c.to_pylist() for c in batch.columns)
                for k in range(batch.num_rows):
                    unit = (area[k], low[k], high[k])
                    if unit != now:
                        yield from close(now, members)
                        now, members = unit, {}
                    members.setdefault(mine[k], []).append((set_id[k], copies[k], np.frombuffer(values[k], np.uint32), np.frombuffer(grams[k], np.uint64)))
            yield from close(now, members)

        held = []
        for row in found():
            held.append(row)
            if len(held) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), linked.types)], schema=linked)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), linked.types)], schema=linked)

    links = durable(units.mapInArrow(released(work), "set_id binary, links long, root binary"), "links")
    groups = components(links, "set_id", "root")
    counts = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    of_set = classes.join(counts, "set_id", "left").join(groups.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    class_ids = of_set.groupBy("root").agg(F.min("first").alias("class_id"), F.min("lead").alias("lead"), F.count("*").alias("n")).where("n > 1")
    n_sets = class_ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    of_set = join_hot(of_set.withColumnsRenamed({"lead": "own", "first": "mine"}), class_ids, ["root"], "n", max(n_sets, 1), "left")
    of_set = of_set.select("set_id", "copies", F.when(F.col("lead").isNull(), F.col("mine")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("lead", "own").alias("lead"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("same_set"))
    of_set = durable(of_set, "classes")
    alone = table.where("set_id IS NULL").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("same_set"), F.lit(None).cast("boolean").alias("stays"))
    member = table.where("set_id IS NOT NULL").select("doc_id", "text_hash", "set_id")
    stays = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash"))
    # copies of one text may be a third of all rows
    return join_hot(member, of_set, ["set_id"], "copies", member.count()).select("doc_id", "text_hash", "class_id", "n_links", "same_set", stays.alias("stays")).union(alone)


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ngram: int = NGRAM, threshold: tuple[int, int] = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, class_id, n_links, same_set``.

    ``class_id`` is the smallest ``doc_id`` of the connected component of links (Jaccard similarity of
    the sets of word n-grams at least ``threshold``); ``n_links`` counts the other rows that the row is
    linked to, copies included; ``same_set`` those among them with an equal set. Words are what lies
    between the contract's white space. A text with fewer words than ``ngram`` is one n-gram of all
    its words; a null or empty text has none, is linked to nothing and is a class of its own. Null ids
    rank after all others. Repeated rows are copies. Other columns are left out.
    """
    return _near_rows(docs, text, doc_id, ngram, threshold, tolerance, block).select("doc_id", "class_id", "n_links", "same_set")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` less its near copies, with all columns: of each group one row, with the smallest ``doc_id`` (and of rows with
    that id, the smallest hash of the text).

    A row is told by its id and text, so rows that share an id but not a text are judged apart; of repeated rows one stays.
    Rows without a word are no copies of anything and all stay.
    """
    told = _near_rows(docs, text, doc_id).where("stays IS NOT NULL").groupBy("doc_id", F.col("text_hash").alias("digest")).agg(F.count("*").alias("n"), F.max("stays").alias("stays"))
    return keep_told(docs, told.where("NOT stays OR n > 1"), F.col(doc_id), F.xxhash64(words_text(text)))
