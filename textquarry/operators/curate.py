"""Curation: gates, deduplication, quotas, leakage anti-joins, lineage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry import tables
from textquarry.functions.tokens import white_words, word_count

#: Below this, a length in words or characters fails the generation gate.
MIN_WORDS, MIN_CHARS = 100, 500
#: Parts in which a group is ranked before it is ranked as a whole.
SALTS = 64


def mostly_english(text: Column) -> Column:
    """No Arabic, Cyrillic, Devanagari or Han character among the first 400, and over 85 % of them ASCII (P6); false for null."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 400)
    foreign = head.rlike(r"[\x{0600}-\x{06FF}\x{0400}-\x{04FF}\x{0900}-\x{097F}\x{4E00}-\x{9FFF}]")
    ascii_share = F.length(F.regexp_replace(head, r"[^\x00-\x7F]", "")) / F.greatest(F.length(head), F.lit(1))
    return ~foreign & (ascii_share > 0.85)


def long_enough(text: Column, least: int = 30) -> Column:
    """At least ``least`` words between white space (P5)."""
    return word_count(text) >= least


def generation_gate(text: Column) -> Column:
    """struct(ok, reason) of a generated text, the first failing rule in order."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")
    n = F.size(white_words(t))
    dots = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    reason = (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(n < MIN_WORDS, F.concat(F.lit("short_"), n.cast("string"), F.lit("w")))
        .when(F.length(t) < MIN_CHARS, F.concat(F.lit("short_"), F.length(t).cast("string"), F.lit("c")))
        .when(F.substring(t, 1, 300).rlike(tables.REFUSAL_PATTERN), "refusal")
        .when((dots < 3) & ~F.contains(t, F.lit("\n")), "no_structure")
        .otherwise("ok")
    )
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"))


def sensitive_title(title: Column) -> Column:
    """Whether a title holds one of the excluded words, any case."""
    return F.exists(F.array(*[F.lit(w) for w in tables.SENSITIVE_TITLE_WORDS]), lambda w: F.contains(F.lower(title), w))


def first_seen(rows: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (W1, W2); null is a key.

    Rows meet by a digest of the key, and the window keeps one row per key and
    task before the shuffle (window group limit), so a key of a third of all
    rows costs one row per task.
    """
    w = Window.partitionBy(F.md5(F.coalesce(key, F.lit("\u0000")))).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def prefix(text: Column, n: int = 200) -> Column:
    """The first n characters, the key of prefix deduplication."""
    return F.substring(text, 1, n)


def quota(rows: DataFrame, group: str, order: Sequence[Column], total: int, shares: dict[str, float]) -> DataFrame:
    """At most floor(total x share) rows of each listed group, in order.

    A group is ranked in ``SALTS`` parts first, each cut to the greatest quota, so that what meets in one task is
    bounded by the quota and not by the number of tasks; every cut happens before its shuffle, too (window group limit).
    """
    cap = F.coalesce(*[F.when(F.col(group) == g, F.floor(F.lit(total * s))) for g, s in shares.items()], F.lit(0))
    w = Window.partitionBy(group).orderBy(*order)
    most = int(total * max(shares.values(), default=0.0))
    parted = rows.filter(F.col(group).isin(*shares)).withColumn("_part", F.pmod(F.hash(*order), F.lit(SALTS)))
    part = Window.partitionBy(group, "_part").orderBy(*order)
    parted = parted.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= most)
    return parted.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).filter(F.col("_rank") <= cap).drop("_rank", "_part")


def all_keys(parts: Sequence[Column], tables: Sequence[DataFrame]) -> DataFrame:
    """``key``: the distinct keys of several tables (U2), as digests; null keys are left out."""
    found = [t.select(F.md5(p).alias("key")).filter("key IS NOT NULL") for p, t in zip(parts, tables, strict=True)]
    return reduce(lambda a, b: a.unionByName(b), found).distinct()


def is_human(model: Column) -> Column:
    """Whether a row's model is the human one (P2); null stays null."""
    return model == "human"


def name_matches(rows: DataFrame, name: str, patterns: Sequence[str]) -> DataFrame:
    """``rows`` with each ``pattern`` that the name contains, any case (J7): the short list travels as a literal, no join."""
    listed = F.array(*[F.lit(p) for p in patterns])
    return rows.withColumn("pattern", F.explode(F.filter(listed, lambda p: F.contains(F.lower(name), F.lower(p)))))


def looked_up(key: Column, values: dict[str, object], default: object = None) -> Column:
    """The value of a small fixed map for a key, else the default (J6); a null key has the default."""
    if not values:
        return F.lit(default)
    found = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(found, key), F.lit(default))


def without_leaks(rows: DataFrame, others: DataFrame, key: Column, other_key: Column) -> DataFrame:
    """Rows whose key is in none of ``others`` (J2, J3, U3); rows with a null key stay."""
    keys = others.select(F.md5(other_key).alias("_key")).filter("_key IS NOT NULL").distinct()
    return rows.withColumn("_key", F.md5(key)).join(keys, "_key", "left_anti").drop("_key")


def recover_lineage(rows: DataFrame, build: DataFrame, row_key: Column, build_key: Column, lineage: str, seq: Sequence[Column], row_id: Column) -> DataFrame:
    """``rows`` with ``lineage_id``: that of the last build row with an equal key, else an id of its own.

    The build side is reduced to one row per key before the join.
    """
    last = build.select(F.md5(build_key).alias("_key"), F.struct(*seq, F.col(lineage).alias("_id")).alias("_v")).filter("_key IS NOT NULL").groupBy("_key").agg(F.max("_v")["_id"].alias("_lineage"))
    joined = rows.withColumn("_key", F.md5(row_key)).join(last, "_key", "left")
    return joined.withColumn("matched", F.col("_lineage").isNotNull()).withColumn("lineage_id", F.coalesce("_lineage", F.concat(F.lit("_um_"), row_id.cast("string")))).drop("_key", "_lineage")


def variants_per_group(rows: DataFrame, lineage: str = "lineage_id") -> DataFrame:
    """Matched rows, lineages and their ratio, unmatched ids left out."""
    real = rows.filter(~F.col(lineage).startswith("_um_"))
    return real.agg(F.count("*").alias("n_rows"), F.count_distinct(lineage).alias("n_groups"), F.round(F.count("*") / F.greatest(F.count_distinct(lineage), F.lit(1)), 6).alias("ratio"))


def usable_prompt(title: Column, human: Column, least: int = 50) -> Column:
    """A title that is neither blank nor sensitive, with a human text of ``least`` words (P9, P10); false for null."""
    named = F.length(F.trim(F.coalesce(title, F.lit("")))) > 0
    return F.coalesce(named & ~sensitive_title(title) & (word_count(human) >= least), F.lit(False))


def not_yet_done(prompts: DataFrame, done: DataFrame, title: str = "title") -> DataFrame:
    """Prompts whose title no stored record has: how an interrupted run goes on."""
    return without_leaks(prompts, done, F.col(title), F.col(title))
