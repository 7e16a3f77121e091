"""The 62 features of a document, in blocks.

Documents are placed by their key once; every later grouping and window starts
with the key, so that Spark finds the rows already clustered and adds no
exchange. Blocks are independent: a query that needs one computes one. Sums over
n-grams and words are grouped counts, never pairs of rows.

Guards: texts under 20 characters or 10 words have zeros everywhere; features
0-7 need a language model and are 0 unless a scorer gives them; 14 is always 0.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry import tables
from textquarry.functions.tokens import naive_sentences, ngrams, syllables, word_count, words

KEY = "doc_id"
EDGES = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"
PUNCTUATION = r"""[!-/:-@\[-`{-~]"""
LEAST_CHARS, LEAST_WORDS = 20, 10


def placed(rows: DataFrame) -> DataFrame:
    """Rows hashed by key into as many partitions as shuffles have, at least one a core.

    A given number is kept by adaptive execution, which would otherwise merge the
    small texts into one task before they are taken apart into many words.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), KEY)


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``t`` (trimmed), ``w`` (words), ``s`` (sentences) of documents that pass the guards, placed by key."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), EDGES, "")
    # the partition id (0 or more) keeps each filter above its column, which would otherwise be computed again below it and for every use
    above = F.least(F.spark_partition_id(), F.lit(0))
    rows = placed(docs.select(KEY, text)).select(KEY, t.alias("t")).filter(F.length("t") >= F.lit(LEAST_CHARS) + above)
    return rows.select(KEY, "t", words(F.col("t")).alias("w"), naive_sentences(F.col("t")).alias("s")).filter(F.size("w") >= F.lit(LEAST_WORDS) + above)


def _zero(c: Column) -> Column:
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def _entropy_bits(n: str = "c") -> Column:
    """Entropy of a group of counts: log2(N) - sum(c log2 c) / N."""
    total = F.sum(n)
    return F.log2(total) - F.sum(F.col(n) * F.log2(n)) / total


def _bits(items) -> tuple[float, int]:
    """Entropy in bits and number of distinct items."""
    counts = np.fromiter(Counter(items).values(), float)
    total = counts.sum()
    return (math.log2(total) - float((counts * np.log2(counts)).sum()) / total if total else 0.0), len(counts)


ENTROPIES = ("chars", "words", "bi", "tri", "punct", "sent", "len")


def entropy_block(rows: DataFrame) -> DataFrame:
    """8-17: entropies of characters, words, n-grams, punctuation, sentence and word lengths.

    Counts of one document stay in its row: an Arrow function over the tokens, without exploded characters or a shuffle.
    """
    chars = F.regexp_replace(F.lower("t"), r"[^\p{L}\p{N} \t\n\r\f\x0B]", "")
    marks = F.regexp_replace("t", PUNCTUATION.replace("[", "[^", 1), "")
    lengths = F.transform("s", lambda x: F.least(F.floor(word_count(x) / 5), F.lit(10)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[list[float]] = []
            for c, w, p, s in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                found = [_bits(x) for x in (c, w, zip(w, w[1:]), zip(w, w[1:], w[2:]), p, s, (min(len(x), 15) for x in w))]
                out.append([*(max(h, 0.0) for h, _ in found), float(found[1][1])])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in zip(*out, strict=True))], names=[KEY, *ENTROPIES, "v"])

    schema = T.StructType([rows.schema[KEY], *(T.StructField(k, T.DoubleType()) for k in (*ENTROPIES, "v"))])
    wide = rows.select(KEY, chars.alias("c"), "w", marks.alias("p"), lengths.alias("l")).mapInArrow(run, schema)
    return wide.select(
        KEY, F.col("chars").alias("f08"), F.col("words").alias("f09"), F.col("bi").alias("f10"), F.col("tri").alias("f11"),
        F.when(F.col("words") > 0, F.greatest(F.lit(0.0), F.col("bi") - F.col("words"))).otherwise(0.0).alias("f12"),
        _zero(F.col("words") / F.log2(F.col("v") + 1)).alias("f13"), F.lit(0.0).alias("f14"), F.col("punct").alias("f15"), F.col("sent").alias("f16"), F.col("len").alias("f17"),
    )


def _burst(mean: Column, sd: Column, n: Column) -> Column:
    return F.when((n >= 2) & (sd + mean > 0), (sd - mean) / (sd + mean)).otherwise(0.0)


def interval_block(rows: DataFrame) -> DataFrame:
    """18-23: burstiness and autocorrelation of intervals between equal words and between marks."""
    at = rows.select(KEY, F.posexplode("w").alias("pos", "word"))
    same = Window.partitionBy(KEY, "word").orderBy("pos")
    gaps = at.withColumn("gap", F.col("pos") - F.lag("pos").over(same)).withColumn("first", F.min("pos").over(Window.partitionBy(KEY, "word"))).filter("gap IS NOT NULL")
    nxt = F.lead("gap").over(Window.partitionBy(KEY).orderBy("first", "pos"))
    paired = gaps.withColumn("next", nxt).withColumn("x", F.when(F.col("next").isNotNull(), F.col("gap")))
    word = paired.groupBy(KEY).agg(
        F.count("*").alias("n"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("sd"), F.var_pop("gap").alias("var"),
        F.covar_pop("x", "next").alias("cov"), F.stddev_pop("x").alias("sx"), F.stddev_pop("next").alias("sy"),
    )
    marks = rows.select(KEY, F.posexplode(F.split("t", "")).alias("pos", "c")).filter(F.col("c").isin(*".,!?;:"))
    steps = marks.withColumn("gap", F.col("pos") - F.lag("pos").over(Window.partitionBy(KEY).orderBy("pos"))).filter("gap IS NOT NULL")
    mark = steps.groupBy(KEY).agg(F.count("*").alias("pn"), F.avg("gap").alias("pm"), F.stddev_pop("gap").alias("psd"))
    lengths = F.transform("s", lambda x: word_count(x).cast("double"))
    n = F.size("s")
    total, squares = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x), F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x * x)
    mean = F.try_divide(total, n)
    cv = F.when((n > 1) & (mean > 0), F.sqrt(F.greatest(F.lit(0.0), squares / n - mean * mean)) / mean)
    return rows.select(KEY, cv.alias("cv")).join(word, KEY, "left").join(mark, KEY, "left").select(
        KEY, _zero(_burst(F.col("m"), F.col("sd"), F.col("n"))).alias("f18"), _zero(F.col("cv")).alias("f19"), _zero(_burst(F.col("pm"), F.col("psd"), F.col("pn"))).alias("f20"),
        _zero(F.when((F.col("n") > 2), F.try_divide("cov", F.col("sx") * F.col("sy")))).alias("f21"),
        _zero(F.when(F.col("m") > 0, F.col("var") / F.col("m"))).alias("f22"), _zero(F.col("sd") / (F.col("m") + 1)).alias("f23"),
    )


def _sized(items: Column, n: int) -> Column:
    """The n-grams of an array with their size."""
    return F.transform(ngrams(items, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))


def repetition_block(rows: DataFrame) -> DataFrame:
    """24-31, 33: overlap of each sentence's n-grams with the others', shares of distinct and repeated n-grams, repeated sentences.

    "The others" are the document's total less the sentence's own count: one window, no comparison of sentences.
    """
    tokens = rows.select(KEY, F.posexplode("s").alias("sent", "x")).select(KEY, "sent", words(F.col("x")).alias("sw"))
    grams = F.concat(*[_sized(F.col("sw"), n) for n in (2, 3, 4)])
    own = tokens.select(KEY, "sent", F.explode(grams).alias("x")).groupBy(KEY, "sent", "x.n", "x.g").agg(F.count("*").alias("c"))
    shared = own.withColumn("others", F.sum("c").over(Window.partitionBy(KEY, "n", "g")) - F.col("c"))
    per_sent = shared.groupBy(KEY, "n", "sent").agg((F.sum(F.least("c", "others")) / F.sum("c")).alias("share"))
    overlap = per_sent.groupBy(KEY).agg(*[F.when(F.count_if(F.col("n") == n) >= 2, F.avg(F.when(F.col("n") == n, F.col("share")))).alias(f"o{n}") for n in (2, 3, 4)])
    both = F.concat(*[_sized(F.col("w"), n) for n in (2, 3)])
    types = rows.select(KEY, F.explode(both).alias("x")).groupBy(KEY, "x.n", "x.g").agg(F.count("*").alias("c"))
    is2, is3 = F.col("n") == 2, F.col("n") == 3
    spread = types.groupBy(KEY).agg(
        (F.count_if(is2) / F.sum(F.when(is2, F.col("c")))).alias("d2"), (F.count_if(is3) / F.sum(F.when(is3, F.col("c")))).alias("d3"),
        (F.count_if(is2 & (F.col("c") > 1)) / F.count_if(is2)).alias("r2"), (F.count_if(is3 & (F.col("c") > 1)) / F.count_if(is3)).alias("r3"),
        (F.max(F.when(is2, F.col("c"))) / F.sum(F.when(is2, F.col("c")))).alias("top"),
    )
    joined = F.transform("s", lambda x: F.array_join(words(x), " "))
    repeated = F.try_divide(F.size("s") - F.size(F.array_distinct(joined)), F.size("s"))
    return rows.select(KEY, repeated.alias("rep")).join(overlap, KEY, "left").join(spread, KEY, "left").select(
        KEY, *[_zero(F.col(c)).alias(f) for c, f in (("o2", "f24"), ("o3", "f25"), ("o4", "f26"), ("d2", "f27"), ("d3", "f28"), ("r2", "f29"), ("r3", "f30"), ("top", "f31"), ("rep", "f33"))]
    )


@F.pandas_udf(T.DoubleType())
def _compression(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        yield pd.Series([len(zlib.compress(r, 9)) / len(r) for r in raw], dtype="float64")


def compression_block(rows: DataFrame) -> DataFrame:
    """32: deflate ratio, the one feature without a built-in expression (Arrow UDF)."""
    return rows.select(KEY, _compression("t").alias("f32"))


def lexical_block(rows: DataFrame) -> DataFrame:
    """34-41: Zipf deviation, Yule's K, hapax shares, Heaps slope, type-token ratios, content words."""
    types = rows.select(KEY, F.posexplode("w").alias("pos", "word")).groupBy(KEY, "word").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("c")))
    per = types.withColumn("rank", rank).groupBy(KEY).agg(
        F.regr_slope(F.log(F.col("c") + 1), F.log("rank")).alias("slope"), F.count("*").alias("v"), F.sum("c").alias("m1"), F.sum(F.col("c") * F.col("c")).alias("m2"),
        F.count_if(F.col("c") == 1).alias("hapax"), F.count_if(F.col("c") == 2).alias("dis"),
    )
    # types seen within the first 100, 200, ... tokens, from the first positions of the types
    firsts = types.groupBy(KEY).agg(F.collect_list("first").alias("firsts"), F.sum("c").alias("n"))
    steps = firsts.filter("n >= 300").select(KEY, "firsts", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 100).cast("int"))).alias("h"))
    seen = F.size(F.filter("firsts", lambda p: p < F.col("h") * 100))
    heaps = steps.groupBy(KEY).agg(F.regr_slope(F.log(seen), F.log(F.col("h") * 100)).alias("heaps"))
    n = F.size("w")
    starts = F.sequence(F.lit(0), F.greatest(n - 50, F.lit(0)), F.lit(25))
    shares = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice("w", i + 1, 50))) / F.lit(50.0))
    mattr = F.when(n >= 50, F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.size(shares))
    listed = F.array(*[F.lit(x) for x in tables.FUNCTION_WORDS])
    content = F.size(F.filter("w", lambda x: ~F.array_contains(listed, x))) / n
    return rows.select(KEY, mattr.alias("mattr"), content.alias("content")).join(per, KEY).join(heaps, KEY, "left").select(
        KEY, _zero(F.when(F.col("v") > 1, F.abs(F.col("slope") + 1))).alias("f34"),
        F.when(F.col("m1") != F.col("m2"), F.lit(10000.0) * (F.col("m2") - F.col("m1")) / (F.col("m1") * F.col("m1"))).otherwise(0.0).alias("f35"),
        (F.col("hapax") / F.col("m1")).alias("f36"), (F.col("dis") / F.col("m1")).alias("f37"), F.coalesce("heaps", F.lit(0.5)).alias("f38"),
        (F.col("v") / F.col("m1")).alias("f39"), F.coalesce("mattr", F.col("v") / F.col("m1")).alias("f40"), F.col("content").alias("f41"),
    )


def coherence_block(rows: DataFrame) -> DataFrame:
    """42-47: cosines of sentences up to four apart, their variance and drift, sentence entropy.

    A word stands at most once per sentence, so the next four rows of a word hold
    every sentence within four: a window takes the place of a range join.
    """
    many = rows.filter(F.size("s") >= 2)
    tokens = many.select(KEY, F.posexplode("s").alias("i", "x")).select(KEY, "i", F.explode(words(F.col("x"))).alias("word")).groupBy(KEY, "i", "word").agg(F.count("*").alias("c"))
    sentence = Window.partitionBy(KEY, "i")
    unit = tokens.withColumn("u", F.col("c") / F.sqrt(F.sum(F.col("c") * F.col("c")).over(sentence)))
    along = Window.partitionBy(KEY, "word").orderBy("i")
    ahead = F.array(*[F.struct(F.lead("i", d).over(along).alias("j"), F.lead("u", d).over(along).alias("v")) for d in (1, 2, 3, 4)])
    dots = unit.withColumn("ahead", ahead).select(KEY, "i", "u", F.explode("ahead").alias("a")).filter((F.col("a.j") - F.col("i")) <= 4).groupBy(KEY, "i", "a.j").agg(F.sum(F.col("u") * F.col("a.v")).alias("cos"))
    size = many.select(KEY, F.size("s").alias("n"))
    next_to = F.col("j") == F.col("i") + 1
    early = F.col("i") < F.floor((F.col("n") - 1) / 2)
    sums = dots.join(size, KEY).groupBy(KEY).agg(
        F.sum(F.when(next_to, F.col("cos"))).alias("s1"), F.sum(F.when(next_to, F.col("cos") * F.col("cos"))).alias("s2"),
        F.sum(F.when(next_to & early, F.col("cos"))).alias("head"), F.sum("cos").alias("near"),
    )
    bits = tokens.groupBy(KEY, "i").agg(_entropy_bits().alias("h")).groupBy(KEY).agg(F.sum("h").alias("h"))
    all_ = size.join(sums, KEY, "left").join(bits, KEY, "left").na.fill(0.0, ["s1", "s2", "head", "near", "h"])
    m = F.col("n") - 1
    mean = F.col("s1") / m
    var = F.when(m > 1, F.greatest(F.lit(0.0), F.col("s2") / m - mean * mean)).otherwise(0.0)
    mid = F.floor(m / 2)
    drift = F.when(m > 2, F.abs(F.try_divide("head", mid) - (F.col("s1") - F.col("head")) / (m - mid))).otherwise(0.0)
    near = reduce(lambda a, d: a + F.greatest(F.col("n") - d, F.lit(0)), (1, 2, 3, 4), F.lit(0))
    out = all_.select(KEY, mean.alias("f42"), var.alias("f43"), drift.alias("f44"), (F.col("near") / near).alias("f45"), (F.col("h") / F.col("n")).alias("f46"), (1 / (1 + var)).alias("f47"))
    return rows.select(KEY).join(out, KEY, "left").na.fill(0.0)


def readability_block(rows: DataFrame) -> DataFrame:
    """48-53: Flesch, Flesch-Kincaid, ARI, Coleman-Liau, SMOG and a Dale-Chall-like score with words of three syllables."""
    syl = F.transform("w", lambda x: syllables(x))
    per = rows.filter(F.size("s") > 0).select(
        KEY, F.size("w").cast("double").alias("w"), F.size("s").cast("double").alias("s"), F.aggregate(syl, F.lit(0), lambda a, x: a + x).cast("double").alias("y"),
        F.length(F.array_join("w", "")).cast("double").alias("c"), F.size(F.filter(syl, lambda x: x >= 3)).cast("double").alias("x"),
    )
    w, s, y, c, x = (F.col(k) for k in "wsycx")
    # --- Fixed values: coefficients of the published formulas
    out = per.select(
        KEY, (F.lit(206.835) - F.lit(1.015) * w / s - F.lit(84.6) * y / w).alias("f48"), (F.lit(0.39) * w / s + F.lit(11.8) * y / w - F.lit(15.59)).alias("f49"),
        (F.lit(4.71) * c / w + F.lit(0.5) * w / s - F.lit(21.43)).alias("f50"), (F.lit(0.0588) * (c / w * 100) - F.lit(0.296) * (s / w * 100) - F.lit(15.8)).alias("f51"),
        (F.lit(1.0430) * F.sqrt(x * (30 / s)) + F.lit(3.1291)).alias("f52"),
        (F.lit(15.79) * x / w + F.lit(0.0496) * w / s + F.when(x / w > 0.05, F.lit(3.6365)).otherwise(F.lit(0.0))).alias("f53"),
    )
    return rows.select(KEY).join(out, KEY, "left").na.fill(0.0)


def style_block(rows: DataFrame) -> DataFrame:
    """54-61: shares of word classes, word and sentence lengths, punctuation and capitals."""

    def share(listed: list[str]) -> Column:
        known = F.array(*[F.lit(x) for x in listed])
        return F.size(F.filter("w", lambda x: F.array_contains(known, x))) / F.size("w")

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace("t", pattern, ""))

    lengths = F.transform("s", lambda x: word_count(x).cast("double"))
    n = F.size("s")
    total, squares = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x), F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x * x)
    mean = F.coalesce(F.try_divide(total, n), F.lit(0.0))
    var = F.when(n > 1, F.greatest(F.lit(0.0), squares / n - mean * mean)).otherwise(0.0)
    return rows.select(
        KEY, share(tables.FUNCTION_WORDS).alias("f54"), share(tables.PRONOUNS).alias("f55"), share(tables.CONJUNCTIONS).alias("f56"),
        (F.length(F.array_join("w", "")) / F.size("w")).alias("f57"), mean.alias("f58"), var.alias("f59"),
        (1 - left(PUNCTUATION) / F.length("t")).alias("f60"), F.coalesce(F.try_divide(left(r"[^\p{Lu}]"), left(r"[^\p{L}]")), F.lit(0.0)).alias("f61"),
    )


BLOCKS = (entropy_block, interval_block, repetition_block, compression_block, lexical_block, coherence_block, readability_block, style_block)
NAMES = [f"f{i:02d}" for i in range(62)]


def all_features(docs: DataFrame, text: str = "text", perplexity: DataFrame | None = None) -> DataFrame:
    """``doc_id`` and f00-f61 of every document; zeros where the guards fail.

    ``perplexity`` may give f00-f07 (``doc_id`` and the columns). The base is
    written once to the shared folder and read by all blocks.
    """
    from textquarry.storage import Scratch

    rows = placed(Scratch(docs.sparkSession, "features").save(base(docs, text), "base"))
    out = placed(docs.select(KEY))
    for block in BLOCKS:
        out = out.join(block(rows), KEY, "left")
    if perplexity is not None:
        out = out.join(perplexity, KEY, "left")
    known = set(out.columns)
    return out.select(KEY, *[(_zero(F.col(n)) if n in known else F.lit(0.0)).alias(n) for n in NAMES])


def feature_array(features: DataFrame) -> DataFrame:
    """``doc_id`` and the 62 values as an array of float, the layout of a feature cache."""
    return features.select(KEY, F.array(*[F.col(n).cast("float") for n in NAMES]).alias("features"))
