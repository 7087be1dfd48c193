"""Near-duplicate groups by an LSH forest of MinHash signatures.

A document's set holds its distinct shingles of five words. Documents with equal sets form a class; one signature per
class goes into the forest. Each tree sorts the classes by its own order of signature values. Candidates are neighbours
in a tree by longest common prefix: the depth starts at ``DEPTH`` values and is raised, region by region, until runs of
an equal prefix hold at most ``RUN`` classes, whose pairs are all candidates; nearest neighbours of a region at the base
depth are candidates too. Every candidate pair is then decided on the full sets, unless the two are connected by confirmed
links already: first each class's pair most often met, then what is left between different components.

Those candidates are not all of a region of more than ``RUN`` classes (or one that partitions may have cut), so its classes
are joined exactly in the end: shingles are ordered by how often they occur, rare ones first, and two sets that reach the
similarity share one of the first n - ceil(0.75 n) + 1 of either. Pairs of different components that do, and whose sizes
and places leave room for the similarity, are decided on the full sets.

With 20 trees a pair of similarity s shares a prefix of three in one tree or more with probability 1 - (1 - s^3)^20:
0.99998 at s = 0.75. Two that do meet, whatever the size of the region.

Nothing is grouped by a hot key: trees are range-partitioned by their whole sort key, classes and components use partial
aggregation, joins are ones that adaptive execution may split, and rows of the few classes that are large (at most
``HOT_CLASSES`` can be) find their component by a broadcast. Sets of documents without candidates are not moved (a bit
filter keeps them back; it may let others pass, never loses one).

Defined cases: a null or blank text has no shingles and is linked with nothing; with fewer than five words the whole
sequence is one shingle; rows that repeat a doc_id are one node and give a row each; a null doc_id is linked with
nothing and kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.common import IdFilter, Words, binaries, cut, raw, rolling, shared_folder, slices, splitmix
from keystrata.llm.graph import components

SHINGLE = 5
TREES = 20
DEPTH = 3
LEVELS = 8
RUN = 8
NEAREST = 2
#: Similarity as a fraction of whole numbers: link where 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 75, 100
#: Shingles are put in order by counts of so many hash ranges (any order serves; rare shingles first makes few pairs).
ORDER_BITS = 22
PARTITION_ROWS = 200_000
#: A class is large where it has this many rows, and more than one in ``HOT_CLASSES`` of all.
LARGE_CLASS, HOT_CLASSES = 10_000, 5_000
#: Components of more members have hubs; how many, and how often they are tried at most. A class is compared with them
#: that met the component this often over all trees (one with a link does so but for a chance of some 0.0005).
LARGE, HUBS, HUB_ROUNDS, MEETINGS = 16, 32, 4, 3

_PERMUTATIONS = splitmix(np.arange(TREES * DEPTH, dtype=np.uint64), 21) | np.uint64(1)
_LEVELS = np.array([[(t * DEPTH + j if j < DEPTH else (t + 7 * (j - DEPTH + 1)) * DEPTH + j) % (TREES * DEPTH) for j in range(LEVELS)] for t in range(TREES)])


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct shingle hashes, sorted within a text, and n+1 bounds."""
    hashes = words.hashes()
    windows = rolling(hashes, k)
    out, bounds = [], [0]
    first = words.first.tolist()
    for a, b in zip(first, first[1:]):
        if b - a >= k:
            s = np.sort(windows[a : b - k + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            s = rolling(hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            s = windows[:0]
        out.append(s)
        bounds.append(bounds[-1] + len(s))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(bounds)


def sketches(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (two sums that tell sets apart), signature (32-bit values) of every row."""

    def work(batches):
        for batch in slices(batches):
            sets, bounds = shingle_sets(Words(batch.column("text"), lower=True))
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            signature = np.zeros((len(n), len(_PERMUTATIONS)), ">u4")
            sums = np.zeros((2, len(n)), np.uint64)
            if len(full):
                at = bounds[:-1][full]
                with np.errstate(over="ignore"):
                    for i, a in enumerate(_PERMUTATIONS):
                        signature[full, i] = np.minimum.reduceat(sets * a, at) >> np.uint64(32)
                    for i in range(2):
                        sums[i, full] = np.add.reduceat(splitmix(sets, 31 + i), at)
            flat = signature.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), binaries(flat, np.arange(len(n) + 1) * signature.shape[1])],
                ["doc_id", "n_shingles", "s1", "s2", "signature"],
            )

    return docs.select(docs[id_column], docs[text_column].alias("text")).mapInArrow(work, "doc_id long, n_shingles long, s1 long, s2 long, signature binary")


def neighbours(keys: np.ndarray, trees: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidate positions (i, j) of rows sorted by (tree, key): runs of an adaptive depth, and nearest neighbours."""
    n = len(keys)
    depth = np.full(n, LEVELS)
    size = np.zeros(n, np.int64)
    todo = np.ones(n, bool)
    differs = np.ones((n, LEVELS + 1), bool)
    differs[1:, 0] = trees[1:] != trees[:-1]
    for j in range(LEVELS):
        differs[1:, j + 1] = differs[1:, j] | (keys[1:, j] != keys[:-1, j])
    for d in range(DEPTH, LEVELS + 1):
        run = np.cumsum(differs[:, d]) - 1
        count = np.bincount(run)[run]
        fits = todo & ((count <= RUN) | (d == LEVELS))
        depth[fits], size[fits] = d, count[fits]
        todo &= ~fits
    runs = np.cumsum(differs, axis=0)
    out = []
    for w in range(1, min(RUN, n)):
        i = np.arange(n - w)
        same = runs[i, depth[:-w]] == runs[i + w, depth[:-w]]
        same &= (size[:-w] <= RUN) | (w <= NEAREST + 1)
        if w <= NEAREST:
            same |= runs[:-w, DEPTH] == runs[w:, DEPTH]
        i = i[same]
        out.append((i, i + w))
    return out


def crowded(keys: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """Whether a row's region at the base depth has more than ``RUN`` rows, or may go on in another partition."""
    new = np.concatenate([[False], (trees[1:] != trees[:-1]) | (keys[1:, :DEPTH] != keys[:-1, :DEPTH]).any(axis=1)])
    run = np.cumsum(new)
    return (np.bincount(run)[run] > RUN) | (run == 0) | (run == run[-1])


def candidates(classes: DataFrame, partitions: int) -> DataFrame:
    """(a, b, trees): pairs of class ids, a < b, that are neighbours in so many trees; and (a, a) of each crowded class."""

    def plant(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                n = batch.num_rows
                signature = np.frombuffer(raw(batch.column("signature"))[0], ">u4").reshape(n, -1)
                keys = signature[:, _LEVELS.ravel()].ravel()
                ids = np.repeat(np.asarray(batch.column("rep")), TREES)
                size = np.repeat(np.asarray(batch.column("n_shingles")), TREES)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), binaries(keys, np.arange(n * TREES + 1) * LEVELS), pa.array(ids), pa.array(size)], ["tree", "key", "id", "n"])

    def harvest(batches):
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        ids, size = np.asarray(t.column("id").chunk(0)), np.asarray(t.column("n").chunk(0))
        keys = np.frombuffer(raw(t.column("key").chunk(0))[0], ">u4").reshape(len(ids), LEVELS)
        trees = np.asarray(t.column("tree").chunk(0))
        crowd = pa.array(np.unique(ids[crowded(keys, trees)]))
        yield pa.RecordBatch.from_arrays([crowd, crowd], ["a", "b"])
        for i, j in neighbours(keys, trees):
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            keep = (a != b) & (DENOMINATOR * small >= NUMERATOR * large)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    planted = classes.select("rep", "n_shingles", "signature").mapInArrow(plant, "tree int, key binary, id long, n long")
    order = planted.repartitionByRange(partitions, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    return order.mapInArrow(harvest, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("trees"))


def full_sets(docs: DataFrame, ids: DataFrame, many: int, id_column: str, text_column: str) -> DataFrame:
    """(id, shingles) of the documents whose id passes a bit filter of ``ids`` (``many`` at most); a few others may pass."""
    wanted = IdFilter(ids, many)

    def work(batches):
        for whole in batches:
            for batch in slices([whole.filter(pa.array(wanted.passes(whole.column("at"))))]):
                sets, bounds = shingle_sets(Words(batch.column("text"), lower=True))
                yield pa.RecordBatch.from_arrays([batch.column("id"), binaries(sets, bounds)], ["id", "shingles"])

    picked = docs.filter(docs[id_column].isNotNull()).select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    return picked.withColumn("at", wanted.place("id")).mapInArrow(work, "id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity, as edges (u, v)."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))

    def work(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(DENOMINATOR * shared >= NUMERATOR * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["u", "v"])

    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(work, "u long, v long")


def _order(sets: DataFrame) -> np.ndarray:
    """How often shingles of each hash range occur; of fixed size."""

    def work(batches):
        for batch in batches:
            flat = np.frombuffer(raw(batch.column("shingles"))[0], np.uint64)
            bins, n = np.unique(flat >> np.uint64(64 - ORDER_BITS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int64)), pa.array(n)], ["bin", "n"])

    counts = np.zeros(1 << ORDER_BITS, np.int32)
    found = sets.select("shingles").mapInArrow(work, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).filter("n > 1")
    for batch in found.toArrow().to_batches():
        counts[np.asarray(batch.column("bin"))] = np.minimum(np.asarray(batch.column("n")), (1 << 31) - 1)
    return counts


def _exact_pairs(crowd: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of crowded classes of different components that may reach the similarity; none that does is missing."""
    of = crowd.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    own = sets.join(of, "id").select("id", "component", "shingles")
    shared = crowd.sparkSession.sparkContext.broadcast(_order(own))

    def work(batches):
        counts = shared.value
        for whole in batches:
            for batch in slices([whole], "shingles"):
                first, size = [], []
                for x in batch.column("shingles"):
                    x = np.frombuffer(x.as_buffer(), np.uint64)
                    n = len(x)
                    first.append(x[np.lexsort((x, counts[x >> np.uint64(64 - ORDER_BITS)]))][: n - -(-NUMERATOR * n // DENOMINATOR) + 1])
                    size.append(n)
                many = np.array([len(x) for x in first])
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                cols = [np.concatenate(first).view(np.int64), *(np.repeat(np.asarray(batch.column(c)), many) for c in ("id", "component")), np.repeat(np.array(size), many), place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shingle", "id", "component", "n", "place"])

    kinds = "shingle long, id long, component long, n long, place long"
    rows = cut(own.mapInArrow(work, kinds))
    apart = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("shingle")
    rows = cut(rows.join(apart, "shingle", "left_semi"))
    x, y = rows.alias("x"), rows.alias("y")
    # What follows the first shared shingle in both must hold the intersection that the sizes ask for.
    room = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (F.col("x.n") + F.col("y.n"))
    sizes = DENOMINATOR * F.least("x.n", "y.n") >= NUMERATOR * F.greatest("x.n", "y.n")
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") < F.col("y.component")) & sizes & room)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _with_components(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b, trees) of different components ca, cb (a class without links is its own)."""
    of_a = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(of_a, "a", "left").join(of_b, "b", "left")
    return both.select("a", "b", "trees", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).filter("ca <> cb")


def _hubs(found: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(component, node): of each large component the members whose signatures agree most with its commonest values."""
    large = found.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).select("component")
    members = found.join(large, "component", "left_semi").join(classes.select(F.col("rep").alias("node"), "signature"), "node").select("component", "node", "signature")
    members = cut(members, most)

    def values(batches):
        for batch in batches:
            n = len(_PERMUTATIONS)
            flat = np.frombuffer(raw(batch.column("signature"))[0], ">u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("component")), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows)), pa.array(flat)], ["component", "place", "value"])

    counts = members.select("component", "signature").mapInArrow(values, "component long, place int, value long").groupBy("component", "place", "value").agg(F.count("*").alias("n"))
    common = counts.groupBy("component", "place").agg(F.max(F.struct("n", "value"))["value"].alias("value"))
    common = common.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("common"))

    def agreement(batches):
        for batch in batches:
            own = np.frombuffer(raw(batch.column("signature"))[0], ">u4").reshape(batch.num_rows, -1)
            wanted = np.array(batch.column("common").to_pylist(), np.int64).reshape(own.shape)
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("node"), pa.array((own == wanted).sum(axis=1))], ["component", "node", "agreement"])

    rated = members.join(common, "component").select("component", "node", "signature", "common").mapInArrow(agreement, "component long, node long, agreement long")
    order = Window.partitionBy("component").orderBy(F.desc("agreement"), "node")
    return rated.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= HUBS).select("component", "node")


def _hub_pairs(apart: DataFrame, hubs: DataFrame) -> DataFrame:
    """The pairs (a, b) of each class that met a large component from outside, and that component's hubs."""
    met = apart.select(F.col("a").alias("x"), F.col("cb").alias("component"), "trees").unionByName(apart.select(F.col("b").alias("x"), F.col("ca").alias("component"), "trees"))
    met = met.groupBy("x", "component").agg(F.sum("trees").alias("trees")).filter(F.col("trees") >= MEETINGS).select("x", "component").join(hubs, "component")
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    shared_folder(docs.sparkSession)
    rows = cut(sketches(docs, id_column, text_column))
    linked = rows.filter("n_shingles > 0 and doc_id is not null")
    keys = ["s1", "s2", "n_shingles"]
    reps = linked.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"))
    same = [F.col(f"r.{k}") == F.col(f"c.{k}") for k in keys]
    classes = cut(linked.alias("r").join(reps.alias("c"), [*same, F.col("r.doc_id") == F.col("c.rep")]).select("c.rep", "r.s1", "r.s2", "r.n_shingles", "r.signature"))
    many = classes.count()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), many * TREES // PARTITION_ROWS + 1)
    met = cut(candidates(classes, parts))
    crowd, pairs = met.filter("a = b").select(F.col("a").alias("id")), met.filter("a <> b")
    most = met.count()
    sets = cut(full_sets(docs, met.select(F.explode(F.array("a", "b")).alias("id")), 2 * most, id_column, text_column))
    # A repeated doc_id may bring other texts along, or equal sets under one id: all count for the node.
    shared = classes.groupBy("s1", "s2", "n_shingles").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u <> v").select("u", "v")
    best = Window.partitionBy("b").orderBy(F.desc("trees"), "a")
    ranked = pairs.withColumn("place", F.row_number().over(best))
    # Pairs of classes, and what follows from them, are about as many as candidates at most.
    edges = cut(confirmed(ranked.filter("place = 1"), sets).unionByName(shared), most)
    found = cut(components(edges, most=most), most)
    more = cut(confirmed(_with_components(ranked.filter("place > 1"), found), sets), most)
    for turn in range(HUB_ROUNDS + 1):
        grown = more.limit(1).count() > 0
        if grown:
            edges = cut(edges.unionByName(more), most)
            found = cut(components(edges, most=most), most)
        if turn == HUB_ROUNDS or turn and not grown:
            break
        more = cut(confirmed(_hub_pairs(_with_components(pairs, found), _hubs(found, classes, most)), sets), most)
    more = cut(confirmed(_exact_pairs(crowd, found, sets), sets), most)
    if more.limit(1).count() > 0:
        found = cut(components(edges.unionByName(more), most=most), most)
    labels = reps.join(found, reps["rep"] == found["node"], "left").select(*keys, "members", F.coalesce("component", "rep").alias("component_id"))
    large = F.col("members") > max(LARGE_CLASS, rows.count() // HOT_CLASSES)
    hot = F.broadcast(labels.filter(large).drop("members"))
    few = linked.select("doc_id", *keys)
    out = few.join(hot, keys).unionByName(few.join(hot, keys, "left_anti").join(labels.filter(~large).drop("members"), keys)).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
