"""Character windows of folded texts: letters, sketches of minima, exact similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.normalize import fold_letters
from textquarry.storage import spread

#: Length of the windows that define the similarity of two texts.
WINDOW = 5


@F.pandas_udf(T.StringType())
def _letters_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.astype(object).where(texts.notna(), None).map(fold_letters)


def letters(text: Column) -> Column:
    """The folded, lower-cased text reduced to a-z and 0-9; '' for null."""
    return _letters_udf(text)


def window_codes(text: str, k: int = WINDOW) -> np.ndarray:
    """A code for each distinct window of k characters (k <= 8), sorted; empty for shorter texts."""
    raw = np.frombuffer(text.encode("ascii"), np.uint8).astype(np.uint64)
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    for i in range(k):
        code = (code << np.uint64(8)) | raw[i : i + n]
    return np.unique(code)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit codes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Rounds in which every window falls into one bin; bins still empty after them take their least window directly.
ROUNDS = 16
_VALUE = np.uint64((1 << 40) - 1)
_GOLDEN = 0x9E3779B97F4A7C15


def sketches(texts: list[str], bins: int) -> np.ndarray:
    """MinHash sketches of the windows of texts of letters (len(texts) x bins).

    Fast similarity sketching: in each round every window is hashed to one bin, and a bin keeps
    the least value of the first round that reached it. Two texts agree in a bin with probability of
    their similarity, as with one hash function per bin, at a few rounds in place of
    ``bins`` functions. Every text must have a window.
    """
    raw = np.frombuffer("".join(texts).encode("ascii"), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(raw) - WINDOW + 1]
    inside = np.arange(len(owner)) + WINDOW <= np.cumsum(sizes)[owner]
    code = np.zeros(len(owner), np.uint64)
    for i in range(WINDOW):
        code = (code << np.uint64(8)) | raw[i : i + len(owner)]
    x, own = mix64(code[inside]), owner[inside]
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    flat = np.full(len(texts) * bins, empty)
    table = flat.reshape(len(texts), bins)
    for turn in range(ROUNDS):
        h = mix64(x ^ np.uint64(((turn + 1) * _GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        np.minimum.at(flat, own * bins + ((h >> np.uint64(40)) % np.uint64(bins)).astype(np.int64), h & _VALUE | np.uint64(turn << 40))
        unfilled = (table == empty).any(axis=1)
        keep = unfilled[own]
        x, own = x[keep], own[keep]
        if not len(x):
            return table
    starts = np.searchsorted(own, np.arange(len(texts) + 1))
    for i in np.flatnonzero(unfilled):
        mine, gaps = x[starts[i] : starts[i + 1]], np.flatnonzero(table[i] == empty)
        salt = mix64((gaps + ROUNDS + 1).astype(np.uint64) * np.uint64(_GOLDEN))
        table[i, gaps] = (mix64(mine[:, None] ^ salt) & _VALUE).min(axis=0) | np.uint64(ROUNDS << 40)
    return table


def labels(sketch: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """A code of each tree and its ``depth`` minima (len(sketch) x trees)."""
    parts = sketch.reshape(len(sketch), trees, depth)
    code = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(depth):
        code = mix64(code * np.uint64(_GOLDEN) + parts[:, :, k])
    return code.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Common windows over all windows of two sorted distinct arrays; 0 where there is none."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def verified(pairs: DataFrame, least: float, a: str = "letters_a", b: str = "letters_b") -> DataFrame:
    """``pairs`` with their exact ``similarity`` where it is at least ``least``; the texts are dropped."""
    keep = [c for c in pairs.columns if c not in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, codes = None, None  # the pairs of a text often follow one another
        for batch in batches:
            left, right = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()
            found = np.zeros(len(left))
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                if x != last:
                    last, codes = x, window_codes(x)
                # no pair of such sizes can reach the threshold
                n, m = len(codes), max(1, len(y) - WINDOW + 1)
                found[i] = similarity(codes, window_codes(y)) if m >= least * n else 0.0
            hit = np.flatnonzero(found >= least)
            if len(hit):
                rows = batch.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in range(len(keep))], pa.array(found[hit])], names=[*keep, "similarity"])

    schema = T.StructType([*[pairs.schema[c] for c in keep], T.StructField("similarity", T.DoubleType())])
    return pairs.select(*keep, a, b).mapInArrow(run, schema)


def text_classes(rows: DataFrame, key: str, text: str, scratch, flags: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(members, representatives) of the classes of texts with equal letters; rows without a key are left out.

    ``members``: all other columns of ``rows`` and ``rep``, the smallest key of the
    class. ``representatives``: ``rep``, ``letters``; with ``flags`` also these, true where they are for any
    row of the class, and ``pos``, a number of the text. Texts without a window are in
    no class. Classes meet by a digest with partial minima, so a text that is a
    third of all rows stays spread.
    """
    slim = spread(rows.filter(F.col(key).isNotNull())).withColumn("letters", letters(F.col(text))).drop(text).filter(F.length("letters") >= WINDOW)
    slim = scratch.save(slim.withColumn("digest", F.md5("letters")), "letters")
    heads = scratch.save(slim.groupBy("digest").agg(F.min(key).alias("rep"), *[F.max(c).alias(c) for c in flags]), "heads")
    members = scratch.save(slim.drop("letters").join(heads.select("digest", "rep"), "digest").drop("digest"), "members")
    reps = slim.select(F.col(key).alias("rep"), "letters").join(heads.select("rep", *flags), "rep")
    reps = scratch.save(reps.withColumn("pos", F.monotonically_increasing_id()) if flags else reps, "reps")
    for done in (slim, heads):
        scratch.drop(done)
    return members, reps


#: A text with more partners than this is copied to several tasks, each with a part of the partners.
HOT_PARTNERS = 5_000


def hot_ends(pairs: DataFrame, end: str, scratch) -> DataFrame | None:
    """``end`` and ``_copies`` of texts with more than ``HOT_PARTNERS`` partners; None where there are none."""
    many = pairs.groupBy(end).agg(F.count("*").alias("n")).filter(F.col("n") > HOT_PARTNERS)
    many = scratch.save(many.select(end, F.ceil(F.col("n") / HOT_PARTNERS).cast("int").alias("_copies")), "hot")
    return None if many.isEmpty() else many


def attached(pairs: DataFrame, end: str, reps: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``pairs`` with the columns of ``reps`` (whose first column is the text's key) for one end.

    Pairs of a hot text are salted by their other end and meet copies of it, so no task gets them all.
    """
    key = reps.columns[0]
    if hot is None:
        return pairs.join(reps.withColumnRenamed(key, end), end)
    other = next(c for c in ("x", "y") if c != end)
    salted = pairs.join(hot, end, "left").withColumn("_salt", F.coalesce(F.pmod(F.hash(other), "_copies"), F.lit(0))).drop("_copies")
    copies = reps.withColumnRenamed(key, end).join(hot, end, "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return salted.join(copies, [end, "_salt"]).drop("_salt")


def near(pairs: DataFrame, reps: DataFrame, least: float, scratch, ends: dict[str, DataFrame | None] | None = None, flags: dict[str, str] | None = None) -> DataFrame:
    """``x``, ``y``, ``similarity`` of the pairs of texts (``rep``, ``letters``) that are near, exactly.

    ``flags``: a column of ``reps`` for each end that holds for all its texts, so that no others are shuffled.
    """
    ends = ends or {end: hot_ends(pairs, end, scratch) for end in ("x", "y")}
    wide = pairs.select("x", "y")
    for end, name in (("y", "letters_b"), ("x", "letters_a")):
        mine = reps.filter(flags[end]) if flags else reps
        wide = attached(wide, end, mine.select("rep", F.col("letters").alias(name)), ends[end])
    return verified(wide.select("x", "y", "letters_a", "letters_b"), least)
