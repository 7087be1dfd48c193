"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots. Slot j has the point frac(j * golden ratio), taken on a lattice of 2**31 points in exact
integers; cumulative target shares map the point to a source, and slots are ranked within their source. Each source's
documents stand in an order shuffled by a hash, one after another, twice over (two epochs), and are cut into blocks of
equal word counts; the slot of rank r takes block r. Every prefix of the mix is thus near the target shares, and no
document is taken more than twice.

Targets share ``share`` times all words by the weights, in code point order of the sources (null last); a target stops at
two times its source's size and what it leaves is shared among the others by weight (water filling, from prefix sums
over the sources sorted by size/weight).

No group holds a source: running sums are by (source, bucket of the shuffle hash) and ranks by (source, chunk of slots),
with prefix sums over buckets and chunks; the only one-partition step has one row for each source.

Defined cases: a null text has size 0; a document of size 0 takes 0; null is a source of its own; rows that repeat a
doc_id are rows of their own; an empty table gives no rows; all sizes 0 gives targets 0; other columns, whatever their
names, are ignored (``materialise`` keeps them).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.common import Words, cut, slices

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BLOCK_WORDS = 64
#: 2**31 times the golden ratio's fractional part, made odd: j * STEP mod 2**31 visits every lattice point.
LATTICE = 1 << 31
STEP = int(LATTICE * (math.sqrt(5) - 1) / 2) | 1
CELLS = 4096
SALTS = 64


def word_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents without their text, and ``size``: the words of it."""
    keep = [c for c in docs.columns if c not in (text_column, "size")]
    names = [text_column, *keep]

    def work(batches):
        for batch in slices(batches, text_column):
            size = pa.array(Words(batch.column(text_column)).counts.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), size], [*keep, "size"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*names).mapInArrow(work, f"{kinds}, size long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: source, code (its place in order), source_size, target, low, high (its lattice interval)."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("code", F.row_number().over(one) - 1)
    s = s.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod("code", F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("cap", F.lit(float(EPOCHS)) * F.col("source_size")).withColumn("wanted", F.lit(float(share)) * F.sum("source_size").over(whole))
    # Sources fill up in order of cap/weight. Before the first unfilled one, prefix sums give the level of all others.
    fill = Window.orderBy(F.col("cap") / F.col("w"), "code")
    s = s.withColumn("cap_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("w_from", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("wanted") - F.col("cap_before")) / F.col("w_from"))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "code", "level"))).over(whole)["level"])
    s = s.withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")))
    total = F.sum("target").over(whole)
    upto = F.sum("target").over(one.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("high", F.when(total > 0, F.round(upto / total * F.lit(float(LATTICE)))).otherwise(0).cast("long"))
    s = s.withColumn("low", F.coalesce(F.lag("high").over(one), F.lit(0)))
    return s.select("source", "code", "source_size", "target", "low", "high")


def schedule(spark, sources: DataFrame, slots: int) -> DataFrame:
    """code, rank (from 0) of every slot: its source, and its place among that source's slots."""
    chunk = max(256, math.isqrt(slots))
    point = F.pmod(F.pmod("id", F.lit(LATTICE)) * F.lit(STEP), F.lit(LATTICE))
    width = LATTICE // CELLS
    s = spark.range(slots).withColumn("point", point).withColumn("cell", F.floor(F.col("point") / width).cast("int"))
    reach = F.sequence(F.floor(F.col("low") / width).cast("int"), F.floor((F.col("high") - 1) / width).cast("int"))
    owners = sources.filter("high > low").select("code", "low", "high", F.explode(reach).alias("cell"))
    s = s.join(owners, "cell").filter("point >= low and point < high").select("id", "code", F.floor(F.col("id") / chunk).alias("chunk"))
    s = s.withColumn("at", F.row_number().over(Window.partitionBy("code", "chunk").orderBy("id")) - 1)
    counts = s.groupBy("code", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("code").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("code", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    return s.join(counts, ["code", "chunk"]).select("id", "code", (F.col("at") + F.col("before")).alias("rank"))


def placed(sizes: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """The documents with their source's code and their place ``start`` in its shuffled stream; (code, bucket, at) is a row's key."""
    buckets = max(64, rows // 1000)
    salted = sources.select("source", "code", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    shuffled = F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.shiftrightunsigned("text_hash", 4))
    d = sizes.withColumn("h", shuffled).withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))
    d = d.alias("d").join(salted.alias("s"), F.col("d.salt").eqNullSafe(F.col("s.salt")) & F.col("d.source").eqNullSafe(F.col("s.source")))
    d = d.select("d.doc_id", "d.size", "d.h", "d.text_hash", "s.code", "s.source_size", "s.target")
    d = d.withColumn("bucket", F.pmod(F.shiftright("h", 8), F.lit(buckets)).cast("int"))
    order = Window.partitionBy("code", "bucket").orderBy("h", "doc_id", "size", "text_hash")
    d = d.withColumn("at", F.row_number().over(order)).withColumn("within", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    totals = d.groupBy("code", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("code").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("code", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    return d.join(totals, ["code", "bucket"]).withColumn("start", F.col("within") + F.col("before"))


def _taken(docs: DataFrame, weights, share: float, block: int) -> DataFrame:
    """The pieces of the documents that the schedule's blocks hold: a row's key and columns, epoch, from, length (null: none taken)."""
    spark = docs.sparkSession
    sizes = cut(word_counts(docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash"))))
    rows, words = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    sources = cut(targets(sizes, weights, share))
    slots = schedule(spark, sources, math.ceil(words * share / block))
    d = placed(sizes, sources, rows)
    pieces = None
    for epoch in range(EPOCHS):
        begin = F.col("start") + F.lit(epoch) * F.col("source_size")
        blocks = F.when(F.col("size") > 0, F.sequence(F.floor(begin / block), F.floor((begin + F.col("size") - 1) / block)))
        p = d.select("*", F.lit(epoch).alias("epoch"), begin.alias("begin"), F.explode_outer(blocks).alias("rank"))
        pieces = p if pieces is None else pieces.unionByName(p)
    low = F.greatest(F.col("begin"), F.col("rank") * block)
    length = F.least(F.col("begin") + F.col("size"), (F.col("rank") + 1) * block) - low
    pieces = pieces.withColumn("length", length).withColumn("from", low - F.col("begin"))
    joined = pieces.join(slots.select("code", "rank", F.lit(True).alias("hit")), ["code", "rank"], "left")
    return joined.withColumn("length", F.when(F.col("hit"), F.col("length"))).withColumn("from", F.when(F.col("hit"), F.col("from")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    pieces = _taken(docs, weights, share, block)
    taken = pieces.groupBy("code", "bucket", "at", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("taken"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def materialise(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: a row for each epoch in which a document is taken, with the words taken of it (all: the text as it is).

    A source's blocks are taken from the first on, so what is taken of a document in an epoch is a run of its words.
    ``n_chars``, where there is one, counts the new text. Documents of no words are not in the mix; rows that share doc_id and
    text (null ones too) take the run of the first of them.
    """
    pieces = _taken(docs, weights, share, block).filter("length > 0")
    runs = pieces.groupBy("doc_id", "text_hash", "code", "bucket", "at", "epoch", "size").agg(F.min("from").alias("_mix_start"), F.sum("length").alias("_mix_words"))
    place = F.row_number().over(Window.partitionBy("doc_id", "text_hash", "epoch").orderBy("code", "bucket", "at"))
    runs = runs.withColumn("place", place).filter("place = 1")
    runs = runs.select(F.col("doc_id").alias("_mix_id"), F.col("text_hash").alias("_mix_text"), "_mix_start", "_mix_words", (F.col("_mix_words") == F.col("size")).alias("_mix_whole"))
    names = docs.columns
    joined = docs.join(runs, docs["doc_id"].eqNullSafe(runs["_mix_id"]) & (F.xxhash64(docs["text"]) == runs["_mix_text"])).select(*(docs[c] for c in names), "_mix_start", "_mix_words", "_mix_whole")

    def work(batches):
        for batch in slices(batches):
            texts = []
            for text, start, n, whole in zip(*(batch.column(c).to_pylist() for c in ("text", "_mix_start", "_mix_words", "_mix_whole"))):
                texts.append(text if whole else b" ".join((text or "").encode().split()[start : start + n]).decode())
            cols = {c: batch.column(c) for c in names} | {"text": pa.array(texts, batch.column("text").type)}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(x or "") for x in texts], pa.int64()).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return joined.mapInArrow(work, docs.schema)
