"""Near-duplicate records with small edits (problem 4).

A MinHash LSH forest over the windows of folded texts. Each of ``TREES`` trees
labels a text with up to ``DEPTH`` minima; texts whose labels share a prefix in a tree
are candidates. The postings of all trees are sorted by prefix and walked once: a
node of the trie is a run of equal prefixes. A pair of similarity s is found at
depth d with probability 1 - (1 - s^d)^TREES. Prefixes are shortened from
``DEPTH`` on until that reaches the target recall for a pair at the threshold, whatever
the other pairs are, so the walk starts there. The recall over all pairs is estimated
too, as the pairs found stand for the sum of the inverse probabilities; where it
falls short, prefixes are shortened further. Every candidate is verified exactly.

Candidates whose sketches of one bit a bin disagree far more than those of a pair at the
threshold would (six standard deviations) are left out before their texts are shipped.

Texts with equal letters are one representative, so copies cost nothing. A run of
more than ``BLOCK`` texts is never held: it leaves the walk in blocks, whose pairs of
blocks are spread over tasks; texts with many candidates are copied to several
tasks. Defined cases: texts without a window (null, blank, very short) have no partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.components import update_components
from textquarry.llm.windows import attached, hot_ends, labels, near, sketches, text_classes
from textquarry.storage import Scratch, spread

TREES, DEPTH = 128, 8
#: Prefixes are shortened until a pair at the threshold is found with this probability.
RECALL = 0.9999
#: At this depth a pair at the threshold is missed once in 10^13; shortening ends.
LEAST_DEPTH = 3
SIMILARITY = 0.6
#: Bits of the sketch that candidates are compared by (a multiple of 64), and the standard deviations allowed.
BITS, DEVIATIONS = 320, 6
#: Texts of a run that the walk holds at a time.
BLOCK = 512
#: Texts sketched at a time.
CHUNK = 500


def found_probability(similarity: Column, depth: int, trees: int = TREES) -> Column:
    """Chance that a pair shares a prefix of ``depth`` in at least one tree."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(depth)), F.lit(trees))


def sure(least: float, depth: int, trees: int = TREES) -> float:
    """Chance that a pair at the threshold shares a prefix of ``depth`` in at least one tree."""
    return 1 - (1 - least**depth) ** trees


def signed(reps: DataFrame, depth: int, trees: int = TREES) -> DataFrame:
    """``rep``, ``labels`` (a code of each tree and its first ``depth`` minima), ``bits`` (one of each of ``BITS`` minima)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                sketch = sketches(part.column(1).to_pylist(), max(trees * depth, BITS))
                codes = labels(sketch[:, : trees * depth], trees, depth)
                bits = np.packbits((sketch[:, :BITS] & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                lists = [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(np.ascontiguousarray(x).ravel())) for x in (codes, bits)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *lists], names=["rep", "labels", "bits"])

    return spread(reps.select("rep", "letters")).mapInArrow(run, "rep long, labels array<long>, bits array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings (``bucket``, ``rep``) to the pairs of each run, or to blocks of a long run."""
    names = ["x", "y", "bucket", "block", "reps"]
    held, at, blocks = np.zeros(0, np.int64), None, 0

    def pairs(b: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = 0
        index = np.arange(len(b))
        while len(index):
            step += 1
            index = index[index + step < len(b)]
            index = index[b[index] == b[index + step]]
            if len(index):
                i, j = r[index], r[index + step]
                none = pa.nulls(len(i), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), none, none, pa.nulls(len(i), pa.list_(pa.int64()))], names=names)

    def block(bucket: int, number: int, r: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array([bucket], pa.int64()), pa.array([number], pa.int64()), pa.array([r], pa.list_(pa.int64()))], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        b, r = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        if at is not None and b[0] != at:
            if blocks:
                yield block(at, blocks, held)
            else:
                yield from pairs(np.full(len(held), at), held)
            held, blocks = held[:0], 0
        b, r = np.concatenate([np.full(len(held), b[0]), b]), np.concatenate([held, r])
        edges = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
        long = np.diff(edges) > BLOCK
        long[0] |= blocks > 0
        whole = np.repeat(~long, np.diff(edges))
        whole[edges[-2] :] = False
        yield from pairs(b[whole], r[whole])
        for k in np.flatnonzero(long[:-1]):
            for number, start in enumerate(range(edges[k], edges[k + 1], BLOCK), blocks if k == 0 else 0):
                yield block(b[start], number, r[start : min(start + BLOCK, edges[k + 1])])
        at, held = b[-1], r[edges[-2] :]
        blocks = blocks if len(edges) == 2 else 0
        while len(held) > BLOCK:
            yield block(at, blocks, held[:BLOCK])
            held, blocks = held[BLOCK:], blocks + 1
    if at is not None:
        if blocks:
            yield block(at, blocks, held)
        else:
            yield from pairs(np.full(len(held), at), held)


def trie_pairs(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """``x`` < ``y``: the distinct pairs that stand in one run of the sorted postings (``bucket``, ``rep``)."""
    walked = postings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_runs, "x long, y long, bucket long, block long, reps array<long>")
    walked = scratch.save(walked, "runs")
    blocks = walked.filter("bucket IS NOT NULL").select("bucket", "block", "reps")
    met = blocks.join(blocks.select("bucket", F.col("block").alias("other"), F.col("reps").alias("others")), "bucket").filter("block <= other")
    met = met.repartition("bucket", "block", "other").select(F.explode("reps").alias("i"), "others").select("i", F.explode("others").alias("j")).filter("i <> j")
    met = met.select(F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"))
    return walked.filter("bucket IS NULL").select("x", "y").union(met).distinct()


def likely(pairs: DataFrame, table: DataFrame, least: float, ends: dict[str, DataFrame | None]) -> DataFrame:
    """The pairs whose bits agree as often as those of a pair at the threshold may, ``DEVIATIONS`` standard deviations allowed."""
    same = (1 + least) / 2
    floor = BITS * same - DEVIATIONS * (BITS * same * (1 - same)) ** 0.5
    wide = pairs
    for end in ("x", "y"):
        wide = attached(wide, end, table.select("rep", F.col("bits").alias(f"bits_{end}")), ends[end])
    differ = sum((F.bit_count(F.get("bits_x", F.lit(i)).bitwiseXOR(F.get("bits_y", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return wide.filter(BITS - differ >= floor).select("x", "y")


def near_pairs(reps: DataFrame, scratch: Scratch, least: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, list[dict]]:
    """(pairs, log): ``x`` < ``y``, ``similarity`` of the representatives that are near.

    ``log`` has for each step the depth, the pairs so far, the estimated recall over all pairs (null if
    none is found) and ``sure``, the chance of a pair at the threshold. The first step is the depth
    where that chance reaches ``recall``: no longer prefix can be the last.
    """
    found: list[DataFrame] = []
    tried: list[DataFrame] = []
    log: list[dict] = []
    depth = next((d for d in range(DEPTH, LEAST_DEPTH, -1) if sure(least, d) >= recall), LEAST_DEPTH)
    while True:
        table = scratch.save(signed(reps, depth), f"signed{depth}")
        fresh = trie_pairs(table.select(F.explode("labels").alias("bucket"), "rep"), scratch)
        for old in tried:
            fresh = fresh.join(old, ["x", "y"], "left_anti")
        fresh = scratch.save(fresh, f"pairs{depth}")
        tried.append(fresh)
        ends = {end: hot_ends(fresh, end, scratch) for end in ("x", "y")}
        found.append(scratch.save(near(likely(fresh, table, least, ends), reps, least, scratch, ends), f"near{depth}"))
        scratch.drop(table)
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.unionByName(more)
        got = pairs.agg(F.count("*").alias("n"), F.sum(1 / found_probability(F.col("similarity"), depth)).alias("all")).first()
        estimate = got["n"] / got["all"] if got["n"] else None
        log.append({"depth": depth, "pairs": got["n"], "recall": estimate, "sure": sure(least, depth)})
        if depth <= LEAST_DEPTH or sure(least, depth) >= recall and (estimate is None or estimate >= recall):
            return pairs, log
        depth -= 1


def near_duplicates(rows: DataFrame, key: str, text: str, least: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(members, pairs, log): ``members`` has ``key`` and its class ``rep``; ``pairs`` join near classes."""
    scratch = Scratch(rows.sparkSession, "forest")
    members, reps = text_classes(rows.select(key, F.col(text).alias("_text")), key, "_text", scratch)
    pairs, log = near_pairs(reps, scratch, least, recall)
    pairs = scratch.save(pairs, "near")
    scratch.finish(members, pairs)
    return members, pairs, log


def row_pairs(members: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``{key}_a`` < ``{key}_b``: all pairs of rows of one class or of near classes.

    The view for moderate classes: n copies of a text are n (n - 1) / 2 rows. ``row_groups`` has a row per text.
    """
    x = members.select(F.col("rep").alias("x"), F.col(key).alias("i"))
    y = members.select(F.col("rep").alias("y"), F.col(key).alias("j"))
    across = pairs.select("x", "y").join(x, "x").join(y, "y")
    within = x.join(y, x["x"] == y["y"]).filter("i < j")
    return across.select(F.least("i", "j").alias(f"{key}_a"), F.greatest("i", "j").alias(f"{key}_b")).union(within.select("i", "j"))


def row_groups(members: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``key``, ``class_id`` (smallest key of the closed group), ``links`` (rows that are near, itself not counted).

    One row per text with a window; groups are closed by the component table.
    """
    spark = members.sparkSession
    scratch = Scratch(spark, "row-groups")
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    name = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")  # noqa: E731  sorts as the number for keys from 0 on
    table = update_components(spark, pairs.select(name("x").alias("a"), name("y").alias("b")), scratch=scratch)
    both = pairs.select(F.col("x").alias("rep"), F.col("y").alias("other")).union(pairs.select("y", "x"))
    near = both.join(sizes.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("n").alias("near"))
    reps = sizes.join(near, "rep", "left").withColumn("key", name("rep")).join(table, "key", "left")
    reps = reps.select("rep", F.coalesce(F.col("root").cast("long"), F.col("rep")).alias("class_id"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    out = scratch.save(members.join(reps, "rep").select(key, "class_id", "links"), "groups")
    scratch.finish(out)
    return out
