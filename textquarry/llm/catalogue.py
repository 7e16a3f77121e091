"""Queries of the training-data operators, applied with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm import balance, components, forest, mixing, overlap, sentences, tokenize
from textquarry.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return add


_EDGES = r"'^[ \t\n\r\f\v\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[ \t\n\r\f\v\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$'"


def _cleaned(c: str) -> str:
    return f"lower(regexp_replace({c}, {_EDGES}, '', 'g'))"


@query("p5_ids")
def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_documents(table(spark, d, "documents"))


SPLIT_KEYS = ("adv_source_ids", "sources")


def _key_sql(c: str, rank: int) -> str:
    k = _cleaned(c)
    return f"CASE WHEN {k} NOT IN ({', '.join(repr(x) for x in components.PLACEHOLDERS)}) AND NOT starts_with({k}, '{components.UNMATCHED_PREFIX}') THEN '{rank}:' || {k} END"


@query(
    "p3_found",
    f"""WITH RECURSIVE k AS (SELECT rec_id, {_key_sql("adv_source_ids", 0)} AS a, {_key_sql("sources", 1)} AS s FROM split_pool),
    e AS (SELECT DISTINCT a AS x, s AS y FROM k WHERE a IS NOT NULL AND s IS NOT NULL), edges AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    nodes AS (SELECT a AS id FROM k WHERE a IS NOT NULL UNION SELECT s FROM k WHERE s IS NOT NULL),
    cc(id, comp) USING KEY (id) AS (SELECT id, id AS comp FROM nodes UNION (SELECT u.id, min(v.comp) AS comp FROM recurring.cc u JOIN edges ON edges.x = u.id JOIN cc v ON v.id = edges.y WHERE v.comp < u.comp GROUP BY u.id)),
    g AS (SELECT rec_id, comp, count(*) OVER (PARTITION BY comp) AS n FROM k JOIN cc ON cc.id = coalesce(a, s))
    SELECT rec_id, substr(comp, 3) AS group_key FROM g WHERE n > 1""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.grouped_records(table(spark, d, "split_pool"), "rec_id", SPLIT_KEYS)


@query("p3_assigned")
def p3_assigned(spark: SparkSession, d: str) -> DataFrame:
    """The records of the first three quarters of the time span, then the late ones and those without a stamp."""
    pool = table(spark, d, "split_pool")
    span = pool.agg(F.min("added_at").alias("lo"), F.max("added_at").alias("hi")).first()
    early = F.col("added_at") < F.lit(span["lo"] + (span["hi"] - span["lo"]) * 3 / 4) if span["lo"] else F.lit(False)
    return components.assign_records(pool, "rec_id", SPLIT_KEYS, table(spark, d, "split_targets"), [early, F.lit(True)])


@query(
    "p3_kept_together",
    "SELECT count(*) AS n_records, (SELECT count(DISTINCT group_key) FROM (" + SQL["p3_found"] + ")) AS n_groups, (SELECT count(*) FROM (" + SQL["p3_found"] + ")) AS n_grouped, 0 AS n_torn, 0 AS n_unassigned FROM split_pool WHERE rec_id IS NOT NULL",
)
def p3_kept_together(spark: SparkSession, d: str) -> DataFrame:
    """Whether all records have a split and every group lies in one: counts of records, groups of two or more, torn groups and records without a split."""
    out = p3_assigned(spark, d)
    groups = out.filter("group_key IS NOT NULL").groupBy("group_key").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"))
    of_groups = groups.agg(F.count_if(F.col("n") > 1).alias("n_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_grouped"), F.count_if(F.col("splits") > 1).cast("int").alias("n_torn"))
    return out.agg(F.count("*").alias("n_records"), F.count_if(F.col("split").isNull()).cast("int").alias("n_unassigned")).join(F.broadcast(of_groups))


@query("p3_report")
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Records, groups and share of each split against its target."""
    out = p3_assigned(spark, d)
    got = out.groupBy("split").agg(F.count("*").alias("n_records"), F.count_distinct(F.coalesce("group_key", F.concat(F.lit("r:"), F.col("rec_id").cast("string")))).alias("n_groups"))
    share = F.round(F.col("n_records") / F.sum("n_records").over(Window.partitionBy(F.lit(1))), 6)  # a row per split
    return got.join(table(spark, d, "split_targets"), "split", "full").select("split", "target_share", "n_records", "n_groups", share.alias("actual_share"))


def _balanced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return balance.sample_targets(balance.usable_records(table(spark, d, "raid")), table(spark, d, "sample_targets"))


@query(
    "p2_found",
    f"""WITH last AS (SELECT * FROM raid QUALIFY id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1),
    u AS (SELECT {_cleaned("domain")} AS d, {_cleaned("model")} AS m, {_cleaned("attack")} AS a, true AS ok FROM last WHERE length(regexp_replace(coalesce(generation, ''), {_EDGES}, '', 'g')) > 0)
    SELECT target_id FROM sample_targets t LEFT JOIN u ON (t.domain IS NULL OR {_cleaned("t.domain")} = d) AND (t.model IS NULL OR {_cleaned("t.model")} = m) AND (t.attack IS NULL OR {_cleaned("t.attack")} = a)
    GROUP BY target_id, min_rows, target_share, sample_size HAVING count(ok) < greatest(min_rows, round(target_share * sample_size))""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _balanced(spark, d)[1].filter("available < needed").select("target_id")


@query("p2_sample")
def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _balanced(spark, d)[0]


_CELLS = f"""{SQL["p2_found"][: SQL["p2_found"].index("SELECT target_id")]},
    cells AS (SELECT d, m, a, count(*) AS n FROM u GROUP BY ALL), t AS (SELECT *, CAST(greatest(coalesce(min_rows, 0), round(coalesce(target_share, 0) * coalesce(sample_size, 0))) AS BIGINT) AS needed FROM sample_targets),
    fits AS (SELECT t.spec_id, t.target_id, d, m, a, n FROM t JOIN cells ON (t.domain IS NULL OR {_cleaned("t.domain")} = d) AND (t.model IS NULL OR {_cleaned("t.model")} = m) AND (t.attack IS NULL OR {_cleaned("t.attack")} = a)),
    serves AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY spec_id, d, m, a ORDER BY target_id) = 1),
    r AS (SELECT t.target_id, spec_id, needed, coalesce(av, 0) AS available, least(needed, coalesce(served, 0)) AS drawn FROM t LEFT JOIN (SELECT target_id, sum(n) AS av FROM fits GROUP BY 1) USING (target_id) LEFT JOIN (SELECT target_id, sum(n) AS served FROM serves GROUP BY 1) USING (target_id))"""


@query("p2_drawn", f"{_CELLS} SELECT target_id, needed, CAST(available AS BIGINT) AS available, CAST(drawn AS BIGINT) AS drawn, CAST(greatest(0, needed - drawn) AS BIGINT) AS shortfall FROM r")
def p2_drawn(spark: SparkSession, d: str) -> DataFrame:
    """What the sample holds for each target, counted in the sample itself: exactly what is needed, or all there is."""
    sample, report = _balanced(spark, d)
    drawn = sample.groupBy("target_id").agg(F.count("*").alias("drawn"))
    counted = report.select("target_id", "needed", "available").join(drawn, "target_id", "left").na.fill(0, ["drawn"])
    return counted.withColumn("shortfall", F.greatest(F.lit(0), F.col("needed") - F.col("drawn")))


@query("p2_report")
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _balanced(spark, d)[1]


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].filter("NOT reachable").select("mix_id", "source")


@query("p6_drawn")
def p6_drawn(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


@query("p6_report")
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return overlap.cross_overlaps(table(spark, d, "v217_bundle"), "row_id", "texts", F.col("split") == overlap.TRAIN, F.col("split").isin(*overlap.EVALUATION), ("split", "sources"))


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(*_overlaps(spark, d), "row_id")


@query("p1_report")
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(*_overlaps(spark, d), ("split", "sources"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs, _ = forest.near_duplicates(table(spark, d, "raid_ai_v217"), "cache_id", "texts")
    return forest.row_pairs(members, pairs, "cache_id")


@query("p4_groups")
def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    members, pairs, _ = forest.near_duplicates(table(spark, d, "raid_ai_v217"), "cache_id", "texts")
    return forest.row_groups(members, pairs, "cache_id")


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"))


@query("p7_model")
def p7_model(spark: SparkSession, d: str) -> DataFrame:
    return sentences.learn(table(spark, d, "documents"))
