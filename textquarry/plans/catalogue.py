"""The catalogue of core queries: name to plan, and name to the same query as SQL.

Every query runs over its whole tables. Values are rounded to six digits on both
sides. Queries whose operator SQL cannot express carry no SQL and are tested
against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import normalize, scoring, tokens
from textquarry.operators import curate, evaluate, explain, features, split, stats
from textquarry.operators.score import linear
from textquarry.plans import sql as q
from textquarry.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under ``name``, with its SQL where SQL can express it."""

    def add(plan):
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return add


def r6(c) -> F.Column:
    """Rounded to six digits, without negative zeros."""
    return F.round(c, 6) + F.lit(0.0)


def n64(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# ---- text ------------------------------------------------------------------------
@query(
    "q01_language_totals",
    f"""SELECT lang, count(*) AS n_docs, count(*) FILTER (w >= 30) AS kept, round(avg(w), 6) AS mean_words
    FROM (SELECT lang, len({q.white_words("coalesce(text, '')")}) AS w FROM documents) GROUP BY lang""",
)
def q01(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", tokens.word_count(F.col("text")).alias("w"))
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(F.col("w") >= 30).alias("kept"), F.round(F.avg("w"), 6).alias("mean_words"))


@query("q02_folded_text")
def q02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalize.fold(F.col("text")).alias("folded"))


@query("q02_table_folded_text", f"SELECT doc_id, {q.folded('text')} AS folded FROM documents")
def q02t(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalize.fold_native(F.col("text")).alias("folded"))


@query("q02_compat_text")
def q02c(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalize.fold_compat(F.col("text")).alias("folded"))


@query("q02_escaped_text", "SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def q02e(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalize.escape_markup(F.col("text")).alias("escaped"))


@query("q03_collapse_rate")
def q03(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", F.md5("text").alias("raw"), F.md5(normalize.fold(F.col("text"))).alias("folded"))
    return docs.groupBy("lang").agg(F.count("raw").alias("n"), F.count_distinct("raw").alias("n_raw"), F.count_distinct("folded").alias("n_folded"))


@query("q03_table_collapse_rate", f"SELECT lang, count(text) AS n, count(DISTINCT text) AS n_raw, count(DISTINCT {q.folded('text')}) AS n_folded FROM documents GROUP BY lang")
def q03t(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", F.md5("text").alias("raw"), F.md5(normalize.fold_native(F.col("text"))).alias("folded"))
    return docs.groupBy("lang").agg(F.count("raw").alias("n"), F.count_distinct("raw").alias("n_raw"), F.count_distinct("folded").alias("n_folded"))


@query("q04_beyond_ascii", r"SELECT c, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS c FROM documents) GROUP BY c")
def q04(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]"), F.lit(0))
    return table(spark, d, "documents").select(F.explode(found).alias("c")).groupBy("c").agg(F.count("*").alias("n"))


@query(
    "q04_fold_gains",
    rf"""SELECT doc_id, raw, first, second, raw - first AS fixed_first, raw - second AS fixed_second, first - second AS gain FROM (
    SELECT doc_id, {", ".join(rf"coalesce(length(regexp_replace({x}, '[\x00-\x7F]', '', 'g')), 0) AS {n}" for x, n in (("text", "raw"), (q.first_folded("text"), "first"), (q.folded("text"), "second")))} FROM documents)""",
)
def q04g(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    kinds = (("raw", t), ("first", normalize.fold_first(t)), ("second", normalize.fold_native(t)))
    out = table(spark, d, "documents").select("doc_id", *[n64(normalize.beyond_ascii(x)).alias(n) for n, x in kinds])
    return out.withColumns({"fixed_first": F.col("raw") - F.col("first"), "fixed_second": F.col("raw") - F.col("second"), "gain": F.col("first") - F.col("second")})


# ---- curation --------------------------------------------------------------------
@query(
    "q05_english",
    r"""SELECT doc_id, NOT regexp_matches(h, '[\x{0600}-\x{06FF}\x{0400}-\x{04FF}\x{0900}-\x{097F}\x{4E00}-\x{9FFF}]')
    AND length(regexp_replace(h, '[^\x00-\x7F]', '', 'g')) / greatest(length(h), 1) > 0.85 AS english FROM (SELECT doc_id, substr(coalesce(text, ''), 1, 400) AS h FROM documents)""",
)
def q05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", curate.mostly_english(F.col("text")).alias("english"))


@query("q06_generation_gate", f"SELECT article_id, reason = 'ok' AS ok, reason FROM (SELECT article_id, {q.GATE} AS reason FROM ({q.GATED}))")
def q06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generated_articles").select("article_id", curate.generation_gate(F.col("machine_text")).alias("g")).select("article_id", "g.ok", "g.reason")


@query(
    "q06_sensitive_titles",
    "SELECT article_id, title, " + " OR ".join(f"contains(lower(title), '{w}')" for w in q.tables.SENSITIVE_TITLE_WORDS) + r" AS sensitive FROM generated_articles",
)
def q06s(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generated_articles").select("article_id", "title", curate.sensitive_title(F.col("title")).alias("sensitive"))


_HEAD = "array_to_string(list_slice(w, 1, 600), ' ')"
_STOP = f"(CASE WHEN contains({_HEAD}, '.') THEN length({_HEAD}) - strpos(reverse({_HEAD}), '.') + 1 ELSE 0 END)"


@query(
    "q06_cleaned_generation",
    rf"""WITH t AS (SELECT article_id, regexp_replace(machine_text, '(?i)^(sure[!,]?\s+here[^.]*\.\s*|here is[^.]*\.\s*)', '') AS t FROM generated_articles), w AS (SELECT article_id, t, {q.white_words("coalesce(t, '')")} AS w FROM t)
    SELECT article_id, trim(CASE WHEN len(w) > 600 THEN CASE WHEN {_STOP} - 1 > length({_HEAD}) * 0.7 THEN substr({_HEAD}, 1, {_STOP}) ELSE {_HEAD} END ELSE t END) AS cleaned FROM w""",
)
def q06c(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generated_articles").select("article_id", tokens.without_preamble(F.col("machine_text")).alias("cleaned"))


@query("q07_prefix_dedup", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY doc_id) = 1")
def q07(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", curate.prefix(F.col("text")).alias("p"))
    return curate.first_seen(docs, F.col("p"), [F.col("doc_id")]).select("doc_id", "source")


@query("q08_exact_dedup", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def q08(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("h"))
    return curate.first_seen(docs, F.col("h"), [F.col("doc_id")]).select("doc_id", "lang")


_SHARES = dict(zip(("news", "wiki", "reddit", "books"), q.tables.FILLER_DOMAIN_WEIGHTS, strict=True))


@query(
    "q09_domain_quota",
    f"""SELECT doc_id, domain FROM (SELECT doc_id, domain, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS k FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY doc_id) = 1))
    WHERE k <= CASE domain {" ".join(f"WHEN '{k}' THEN floor(200000 * {v})" for k, v in _SHARES.items())} ELSE 0 END""",
)
def q09(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "domain", curate.prefix(F.col("text")).alias("p"))
    return curate.quota(curate.first_seen(docs, F.col("p"), [F.col("doc_id")]), "domain", [F.col("doc_id")], 200_000, _SHARES).select("doc_id", "domain")


@query(
    "q10_leakage_antijoin",
    "SELECT row_id, split FROM v217_bundle b WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM v217_bundle o WHERE o.split IN ('val', 'test', 'test_ood') AND substr(o.texts, 1, 250) = substr(b.texts, 1, 250))",
)
def q10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "v217_bundle").select("row_id", "split", curate.prefix(F.col("texts"), 250).alias("p"))
    return curate.without_leaks(rows.filter("split = 'train'"), rows.filter("split IN ('val', 'test', 'test_ood')"), F.col("p"), F.col("p")).select("row_id", "split")


_LINEAGE = """WITH last AS (SELECT generation AS g, adv_source_id AS a FROM raid WHERE generation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY generation ORDER BY loaded_at DESC NULLS LAST, id DESC NULLS LAST, adv_source_id DESC NULLS LAST) = 1),
    joined AS (SELECT c.cache_id, last.a IS NOT NULL AS matched, coalesce(last.a, '_um_' || c.cache_id) AS lineage_id FROM raid_ai_v217 c LEFT JOIN last ON c.texts = last.g)"""


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    cache, raid = table(spark, d, "raid_ai_v217"), table(spark, d, "raid")
    return curate.recover_lineage(cache, raid, F.col("texts"), F.col("generation"), "adv_source_id", [F.col("loaded_at"), F.col("id")], F.col("cache_id")).select("cache_id", "matched", "lineage_id")


@query("q11_lineage", _LINEAGE + " SELECT * FROM joined")
def q11(spark: SparkSession, d: str) -> DataFrame:
    return _lineage(spark, d)


@query("q11_variants", _LINEAGE + " SELECT count(*) AS n_rows, count(DISTINCT lineage_id) AS n_groups, round(count(*) / greatest(count(DISTINCT lineage_id), 1), 6) AS ratio FROM joined WHERE lineage_id NOT LIKE '\\_um\\_%' ESCAPE '\\'")
def q11v(spark: SparkSession, d: str) -> DataFrame:
    return curate.variants_per_group(_lineage(spark, d))


# ---- splits and samples ------------------------------------------------------------
@query(
    "q12_grouped_split",
    """WITH g AS (SELECT DISTINCT adv_source_ids AS a FROM split_pool), r AS (SELECT a, row_number() OVER (ORDER BY md5(CASE WHEN a IS NULL THEN '42' ELSE '42|' || a END), a) AS k, count(*) OVER () AS n FROM g)
    SELECT rec_id, CASE WHEN k <= floor(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM split_pool JOIN r ON adv_source_ids IS NOT DISTINCT FROM a""",
)
def q12(spark: SparkSession, d: str) -> DataFrame:
    return split.grouped_split(table(spark, d, "split_pool").select("rec_id", "adv_source_ids"), "adv_source_ids").select("rec_id", "split")


@query(
    "q13_stratified_split",
    """SELECT rec_id, CASE WHEN row_number() OVER (PARTITION BY domains, generators ORDER BY md5('42|' || rec_id), rec_id) <= floor(count(*) OVER (PARTITION BY domains, generators) * 0.1) THEN 'val' ELSE 'train' END AS split FROM split_pool""",
)
def q13(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_split(table(spark, d, "split_pool").select("rec_id", "domains", "generators"), "rec_id", ["domains", "generators"]).select("rec_id", "split")


@query(
    "q14_equal_allocation",
    """WITH c AS (SELECT greatest(1, 500 // count(*)) AS per FROM (SELECT DISTINCT domains, generators, attacks FROM split_pool))
    SELECT rec_id FROM (SELECT rec_id, row_number() OVER (PARTITION BY domains, generators, attacks ORDER BY md5('42|' || rec_id), rec_id) AS k FROM split_pool), c WHERE k <= per""",
)
def q14(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "split_pool").select("rec_id", "domains", "generators", "attacks")
    return split.equal_allocation(rows, "rec_id", ["domains", "generators", "attacks"], 500).select("rec_id")


@query("q14_per_class_sample", "SELECT doc_id, label FROM documents QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42|' || doc_id), doc_id) <= 12000")
def q14c(spark: SparkSession, d: str) -> DataFrame:
    return split.per_cell(table(spark, d, "documents").select("doc_id", "label"), "doc_id", ["label"], 12_000).select("doc_id", "label")


@query("q14_fraction_sample", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY label, domain ORDER BY md5('42|' || doc_id), doc_id) <= round(count(*) OVER (PARTITION BY label, domain) * 0.25)")
def q14f(spark: SparkSession, d: str) -> DataFrame:
    return split.fraction_per_cell(table(spark, d, "documents").select("doc_id", "label", "domain"), "doc_id", ["label", "domain"], 0.25).select("doc_id")


@query("q14_capped_sample", "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 64")
def q14x(spark: SparkSession, d: str) -> DataFrame:
    return split.capped(table(spark, d, "documents").select("doc_id"), "doc_id", 64)


@query(
    "q15_composition",
    """SELECT CASE WHEN g = 1 THEN 'TOTAL' ELSE s END AS source, n, human, machine, round(n / max(CASE WHEN g = 1 THEN n END) OVER (), 6) AS share FROM (
    SELECT coalesce(source, '-') AS s, grouping(coalesce(source, '-')) AS g, count(*) AS n, count(*) FILTER (label = 0) AS human, count(*) FILTER (label = 1) AS machine FROM documents GROUP BY ROLLUP (coalesce(source, '-')))""",
)
def q15(spark: SparkSession, d: str) -> DataFrame:
    return stats.composition(table(spark, d, "documents").select("source", "label"), "source", "label")


@query(
    "q16_quota_plan",
    """SELECT h AS fixed_human, m AS fixed_machine, greatest(0, 5000 - h) AS need_human, greatest(0, 5000 - m) AS need_machine, greatest(0, h - m) AS balance
    FROM (SELECT count(*) FILTER (labels = 0) AS h, count(*) FILTER (labels = 1) AS m FROM split_pool)""",
)
def q16(spark: SparkSession, d: str) -> DataFrame:
    return split.quota_plan(table(spark, d, "split_pool"), F.col("labels"), 5000)


# ---- tokens and features ------------------------------------------------------------
@query(
    "q17_token_counts",
    f"SELECT doc_id, len({q.words('x')}) AS n_tokens, len({q.sentences('x')}) AS n_sentences, len({q.white_words('x')}) AS n_words FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)",
)
def q17(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", n64(F.size(tokens.words(t))).alias("n_tokens"), n64(F.size(tokens.naive_sentences(t))).alias("n_sentences"), n64(tokens.word_count(t)).alias("n_words"))


def _rounded(df: DataFrame, above: float = 0.0) -> DataFrame:
    """Features to six digits; ``above`` lifts shares of small numbers off exact ties."""
    return df.select("doc_id", *[r6(F.col(c) + above).alias(c) for c in df.columns if c != "doc_id"])


def _features(block):
    return lambda spark, d: _rounded(block(features.base(table(spark, d, "documents"))))


def _h(x: str) -> str:
    return f"coalesce(list_aggregate({x}, 'entropy'), 0)"


query(
    "q18_entropy",
    rf"""WITH {q.BASE}, e AS (SELECT doc_id, {_h(r"list_filter(string_split(lower(t), ''), lambda c: regexp_matches(c, '[\p{L}\p{N} \t\n\r\f\v]'))")} AS f08, {_h("w")} AS f09, {_h(q.grams("w", 2))} AS f10, {_h(q.grams("w", 3))} AS f11, list_unique(w) AS v,
    {_h(f"regexp_extract_all(t, '{q.PUNCT}')")} AS f15, {_h(f"list_transform(s, lambda x: least(len({q.white_words('x')}) // 5, 10))")} AS f16, {_h("list_transform(w, lambda x: least(length(x), 15))")} AS f17 FROM base)
    SELECT doc_id, round(f08, 6) AS f08, round(f09, 6) AS f09, round(f10, 6) AS f10, round(f11, 6) AS f11, round(CASE WHEN f09 > 0 THEN greatest(0, f10 - f09) ELSE 0 END, 6) AS f12,
    round(f09 / log2(v + 1), 6) AS f13, CAST(0 AS DOUBLE) AS f14, round(f15, 6) AS f15, round(f16, 6) AS f16, round(f17, 6) AS f17 FROM e""",
)(_features(features.entropy_block))

query(
    "q19_lexical",
    f"""WITH {q.BASE}, pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM base), types AS (SELECT doc_id, word, count(*) AS c, min(p) AS first FROM pos GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC) AS r FROM types),
    per AS (SELECT doc_id, regr_slope(ln(c + 1), ln(r)) AS slope, count(*) AS v, sum(c)::DOUBLE AS m1, sum(c * c)::DOUBLE AS m2, count(*) FILTER (c = 1) AS hapax, count(*) FILTER (c = 2) AS dis FROM ranked GROUP BY doc_id),
    grid AS (SELECT doc_id, h, count(*) AS seen FROM (SELECT doc_id, unnest(range(1, len(w) // 100 + 1)) AS h FROM base WHERE len(w) >= 300) g JOIN types USING (doc_id) WHERE first < h * 100 GROUP BY ALL),
    heaps AS (SELECT doc_id, regr_slope(ln(seen), ln(h * 100)) AS heaps FROM grid GROUP BY doc_id),
    lists AS (SELECT doc_id, CASE WHEN len(w) >= 50 THEN list_avg(list_transform(range(1, len(w) - 50 + 2, 25), lambda i: len(list_distinct(list_slice(w, i, i + 49))) / 50)) END AS mattr,
        len(list_filter(w, lambda x: NOT list_contains({q.listed(q.tables.FUNCTION_WORDS)}, x))) / len(w) AS content FROM base)
    SELECT doc_id, round(CASE WHEN v > 1 THEN abs(slope + 1) ELSE 0 END, 6) AS f34, round(CASE WHEN m1 <> m2 THEN 10000 * (m2 - m1) / (m1 * m1) ELSE 0 END, 6) AS f35, round(hapax / m1, 6) AS f36, round(dis / m1, 6) AS f37,
    round(coalesce(heaps, 0.5), 6) AS f38, round(v / m1, 6) AS f39, round(coalesce(mattr, v / m1), 6) AS f40, round(content, 6) AS f41 FROM per JOIN lists USING (doc_id) LEFT JOIN heaps USING (doc_id)""",
)(_features(features.lexical_block))

query(
    "q20_intervals",
    f"""WITH {q.BASE}, pos AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM base),
    g0 AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id, word ORDER BY p) AS gap, min(p) OVER (PARTITION BY doc_id, word) AS first FROM pos),
    g1 AS (SELECT *, lead(gap) OVER (PARTITION BY doc_id ORDER BY first, p) AS nxt FROM g0 WHERE gap IS NOT NULL),
    wordy AS (SELECT doc_id, count(*) AS n, avg(gap) AS m, stddev_pop(gap) AS sd, var_pop(gap) AS var, covar_pop(gap, nxt) AS cov, stddev_pop(gap) FILTER (nxt IS NOT NULL) AS sx, stddev_pop(nxt) AS sy FROM g1 GROUP BY doc_id),
    chars AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS p FROM base),
    steps AS (SELECT doc_id, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM chars WHERE c IN ('.', ',', '!', '?', ';', ':')),
    mark AS (SELECT doc_id, count(*) AS pn, avg(gap) AS pm, stddev_pop(gap) AS psd FROM steps WHERE gap IS NOT NULL GROUP BY doc_id),
    lens AS (SELECT doc_id, list_transform(s, lambda x: len({q.white_words("x")})) AS l FROM base),
    cv AS (SELECT doc_id, CASE WHEN len(l) > 1 AND list_avg(l) > 0 THEN list_stddev_pop(l) / list_avg(l) END AS cv FROM lens)
    SELECT doc_id, round(coalesce(CASE WHEN n >= 2 AND sd + m > 0 THEN (sd - m) / (sd + m) END, 0), 6) + 0 AS f18, round(coalesce(cv, 0), 6) AS f19, round(coalesce(CASE WHEN pn >= 2 AND psd + pm > 0 THEN (psd - pm) / (psd + pm) END, 0), 6) + 0 AS f20,
    round(coalesce(CASE WHEN n > 2 AND sx * sy > 0 THEN cov / (sx * sy) END, 0), 6) + 0 AS f21, round(coalesce(CASE WHEN m > 0 THEN var / m END, 0), 6) AS f22, round(coalesce(sd / (m + 1), 0), 6) AS f23
    FROM cv LEFT JOIN wordy USING (doc_id) LEFT JOIN mark USING (doc_id)""",
)(_features(features.interval_block))


def _overlap_sql(n: int) -> str:
    return f"""g{n} AS (SELECT doc_id, i, unnest({q.grams("sw", n)}) AS g FROM sent), c{n} AS (SELECT doc_id, i, g, count(*) AS c FROM g{n} GROUP BY ALL), t{n} AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, g) - c AS o FROM c{n}),
    o{n} AS (SELECT doc_id, CASE WHEN count(*) >= 2 THEN avg(share) END AS o{n} FROM (SELECT doc_id, i, sum(least(c, o)) / sum(c) AS share FROM t{n} GROUP BY ALL) GROUP BY doc_id)"""


query(
    "q21_repetition",
    f"""WITH {q.BASE}, sent AS (SELECT doc_id, i, {q.words("x")} AS sw FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM base)), {_overlap_sql(2)}, {_overlap_sql(3)}, {_overlap_sql(4)},
    b2 AS (SELECT doc_id, count(*) / sum(c) AS d2, count(*) FILTER (c > 1) / count(*) AS r2, max(c) / sum(c) AS top FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest({q.grams("w", 2)}) AS g FROM base) GROUP BY ALL) GROUP BY doc_id),
    b3 AS (SELECT doc_id, count(*) / sum(c) AS d3, count(*) FILTER (c > 1) / count(*) AS r3 FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest({q.grams("w", 3)}) AS g FROM base) GROUP BY ALL) GROUP BY doc_id),
    rep AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN (len(s) - len(list_distinct(list_transform(s, lambda x: array_to_string({q.words("x")}, ' '))))) / len(s) END AS rep FROM base)
    SELECT doc_id, {", ".join(f"round(coalesce({c}, 0) + 1e-9, 6) AS {f}" for c, f in (("o2", "f24"), ("o3", "f25"), ("o4", "f26"), ("d2", "f27"), ("d3", "f28"), ("r2", "f29"), ("r3", "f30"), ("top", "f31"), ("rep", "f33")))}
    FROM rep LEFT JOIN o2 USING (doc_id) LEFT JOIN o3 USING (doc_id) LEFT JOIN o4 USING (doc_id) LEFT JOIN b2 USING (doc_id) LEFT JOIN b3 USING (doc_id)""",
)(lambda spark, d: _rounded(features.repetition_block(features.base(table(spark, d, "documents"))), 1e-9))

query(
    "q22_coherence",
    f"""WITH {q.BASE}, sent AS (SELECT doc_id, i, {q.words("x")} AS sw FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS i FROM base WHERE len(s) >= 2)),
    c AS (SELECT doc_id, i, word, count(*) AS c FROM (SELECT doc_id, i, unnest(sw) AS word FROM sent) GROUP BY ALL), u AS (SELECT doc_id, i, word, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id, i)) AS u FROM c),
    dots AS (SELECT a.doc_id, a.i, b.i AS j, sum(a.u * b.u) AS cos FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND b.i <= a.i + 4 GROUP BY ALL),
    size AS (SELECT doc_id, len(s) AS n, (len(s) - 1) AS m, (len(s) - 1) // 2 AS mid FROM base WHERE len(s) >= 2),
    sums AS (SELECT doc_id, sum(cos) FILTER (j = i + 1) AS s1, sum(cos * cos) FILTER (j = i + 1) AS s2, sum(cos) FILTER (j = i + 1 AND i < mid) AS head, sum(cos) AS near FROM dots JOIN size USING (doc_id) GROUP BY doc_id),
    bits AS (SELECT doc_id, sum(h) AS h FROM (SELECT doc_id, {_h("sw")} AS h FROM sent) GROUP BY doc_id),
    z AS (SELECT doc_id, n, m, mid, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2, coalesce(head, 0) AS head, coalesce(near, 0) AS near, coalesce(h, 0) AS h FROM size LEFT JOIN sums USING (doc_id) LEFT JOIN bits USING (doc_id)),
    v AS (SELECT *, CASE WHEN m > 1 THEN greatest(0, s2 / m - (s1 / m) * (s1 / m)) ELSE 0 END AS var FROM z),
    f AS (SELECT doc_id, s1 / m AS f42, var AS f43, CASE WHEN m > 2 THEN abs(head / mid - (s1 - head) / (m - mid)) ELSE 0 END AS f44, near / (greatest(n - 1, 0) + greatest(n - 2, 0) + greatest(n - 3, 0) + greatest(n - 4, 0)) AS f45, h / n AS f46, 1 / (1 + var) AS f47 FROM v)
    SELECT doc_id, {", ".join(f"round(coalesce(f{k}, 0), 6) AS f{k}" for k in range(42, 48))} FROM base LEFT JOIN f USING (doc_id)""",
)(_features(features.coherence_block))

_SYL = "CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN suffix(x, 'e') THEN 1 ELSE 0 END) END"
query(
    "q23_readability",
    f"""WITH {q.BASE}, y AS (SELECT doc_id, len(w)::DOUBLE AS w, len(s)::DOUBLE AS s, list_transform(w, lambda x: {_SYL}) AS syl, length(array_to_string(w, ''))::DOUBLE AS c FROM base),
    k AS (SELECT *, list_sum(syl)::DOUBLE AS y, len(list_filter(syl, lambda v: v >= 3))::DOUBLE AS x FROM y WHERE s > 0),
    f AS (SELECT doc_id, 206.835::DOUBLE - 1.015::DOUBLE * w / s - 84.6::DOUBLE * y / w AS f48, 0.39::DOUBLE * w / s + 11.8::DOUBLE * y / w - 15.59::DOUBLE AS f49, 4.71::DOUBLE * c / w + 0.5::DOUBLE * w / s - 21.43::DOUBLE AS f50,
    0.0588::DOUBLE * (c / w * 100) - 0.296::DOUBLE * (s / w * 100) - 15.8::DOUBLE AS f51, 1.0430::DOUBLE * sqrt(x * (30 / s)) + 3.1291::DOUBLE AS f52, 15.79::DOUBLE * x / w + 0.0496::DOUBLE * w / s + CASE WHEN x / w > 0.05 THEN 3.6365 ELSE 0 END::DOUBLE AS f53 FROM k)
    SELECT doc_id, {", ".join(f"round(coalesce(f{k}, 0) + 1e-9, 6) + 0 AS f{k}" for k in range(48, 54))} FROM base LEFT JOIN f USING (doc_id)""",
)(lambda spark, d: _rounded(features.readability_block(features.base(table(spark, d, "documents"))), 1e-9))


def _share_sql(values) -> str:
    return f"len(list_filter(w, lambda x: list_contains({q.listed(values)}, x))) / len(w)"


query(
    "q24_style",
    rf"""WITH {q.BASE}, l AS (SELECT *, list_transform(s, lambda x: len({q.white_words("x")})) AS l FROM base)
    SELECT doc_id, round({_share_sql(q.tables.FUNCTION_WORDS)}, 6) AS f54, round({_share_sql(q.tables.PRONOUNS)}, 6) AS f55, round({_share_sql(q.tables.CONJUNCTIONS)}, 6) AS f56, round(length(array_to_string(w, '')) / len(w), 6) AS f57,
    round(coalesce(list_avg(l), 0), 6) AS f58, round(CASE WHEN len(l) > 1 THEN list_var_pop(l) ELSE 0 END, 6) AS f59, round(1 - length(regexp_replace(t, '{q.PUNCT}', '', 'g')) / length(t), 6) AS f60,
    round(coalesce(length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace(t, '[^\p{{L}}]', '', 'g')), 0), 0), 6) AS f61 FROM l""",
)(_features(features.style_block))

query("q25_compression")(_features(features.compression_block))


@query("q25_all_features")
def q25(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(features.all_features(table(spark, d, "documents")))


_LONG = "long AS (SELECT cache_id, idx, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0 ELSE v::DOUBLE END AS value FROM (SELECT cache_id, unnest(features) AS v, generate_subscripts(features, 1) - 1 AS idx FROM raid_ai_v217))"


@query(
    "q26_robust_scale",
    f"""WITH {_LONG}, c AS (SELECT idx, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS e FROM long GROUP BY idx)
    SELECT CAST(idx AS BIGINT) AS idx, round(b, 6) + 0 AS center, round(CASE WHEN e = a THEN 1 ELSE e - a END, 6) AS scale FROM c""",
)
def q26(spark: SparkSession, d: str) -> DataFrame:
    fitted = stats.robust_scale(stats.long_features(table(spark, d, "raid_ai_v217"), "cache_id"))
    return fitted.select(n64("idx").alias("idx"), r6(F.col("center")).alias("center"), r6(F.col("scale")).alias("scale"))


@query(
    "q26_scaled_mean",
    f"""WITH {_LONG}, c AS (SELECT idx, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS e FROM long GROUP BY idx)
    SELECT CAST(idx AS BIGINT) AS idx, round(avg((value - b) / CASE WHEN e = a THEN 1 ELSE e - a END) + 1e-9, 6) + 0 AS mean_scaled FROM long JOIN c USING (idx) GROUP BY idx""",
)
def q26m(spark: SparkSession, d: str) -> DataFrame:
    values = stats.long_features(table(spark, d, "raid_ai_v217"), "cache_id")
    return stats.apply_scale(values, stats.robust_scale(values)).groupBy(n64("idx").alias("idx")).agg(r6(F.avg("scaled") + 1e-9).alias("mean_scaled"))


_DOC_LONG = "SELECT label, 'chars' AS name, length(text)::DOUBLE AS value FROM documents WHERE text IS NOT NULL AND label IS NOT NULL UNION ALL SELECT label, 'words', len({w})::DOUBLE FROM documents WHERE text IS NOT NULL AND label IS NOT NULL".format(w=q.white_words("text"))


@query(
    "q27_mutual_information",
    f"""WITH v AS ({_DOC_LONG}), c AS (SELECT name, quantile_cont(value, [{", ".join(str(i / 10) for i in range(1, 10))}]) AS cuts FROM v GROUP BY name),
    b AS (SELECT name, label, len(list_filter(cuts, lambda x: x < value)) AS bin FROM v JOIN c USING (name)), j AS (SELECT name, bin, label, count(*)::DOUBLE AS n FROM b GROUP BY ALL)
    SELECT name, round(sum(t), 6) AS mi FROM (SELECT name, n / sum(n) OVER (PARTITION BY name) * ln(n * sum(n) OVER (PARTITION BY name) / (sum(n) OVER (PARTITION BY name, bin) * sum(n) OVER (PARTITION BY name, label))) AS t FROM j) GROUP BY name""",
)
def q27(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL AND label IS NOT NULL")
    pairs = F.array(F.struct(F.lit("chars").alias("name"), F.length("text").cast("double").alias("value")), F.struct(F.lit("words").alias("name"), tokens.word_count(F.col("text")).cast("double").alias("value")))
    return stats.mutual_information(docs.select("label", F.inline(pairs)), "label", ["name"]).select("name", r6(F.col("mi")).alias("mi"))


# ---- evaluation ------------------------------------------------------------------------
#: The score that plays a detector's margin: a fixed function of the text's length, with many ties.
_SCORED = "scored AS (SELECT domain, label AS y, (length(text) % 97 - 48) / 4.0::DOUBLE AS s FROM documents WHERE text IS NOT NULL)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    score = (F.length("text") % 97 - 48) / F.lit(4.0)
    return table(spark, d, "documents").filter("text IS NOT NULL").select("domain", F.col("label").alias("y"), score.alias("s"))


_AUROC = """per AS (SELECT {by} s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM scored WHERE y IS NOT NULL GROUP BY ALL),
    run AS (SELECT *, sum(n) OVER ({part} ORDER BY s) - n AS below, sum(p) OVER ({whole}) AS pa, sum(n) OVER ({whole}) AS na FROM per)"""


@query("q28_auroc", f"WITH {_SCORED}, {_AUROC.format(by='', part='', whole='')} SELECT round(sum(p * (below + n / 2)) / (max(pa) * max(na)), 6) AS auroc FROM run")
def q28(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.auroc(_scored(spark, d)).select(r6(F.col("auroc")).alias("auroc"))


@query(
    "q28_auroc_by_domain",
    f"WITH {_SCORED}, {_AUROC.format(by='domain,', part='PARTITION BY domain', whole='PARTITION BY domain')} SELECT domain, round(sum(p * (below + n / 2)) / nullif(max(pa) * max(na), 0), 6) AS auroc FROM run GROUP BY domain",
)
def q28d(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.auroc(_scored(spark, d), ["domain"]).select("domain", r6(F.col("auroc")).alias("auroc"))


_ROC = f"""{_SCORED}, per AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM scored WHERE y IS NOT NULL GROUP BY s),
    pts AS (SELECT sum(n) OVER (ORDER BY s DESC) / sum(n) OVER () AS fpr, sum(p) OVER (ORDER BY s DESC) / sum(p) OVER () AS tpr, s AS threshold FROM per UNION ALL SELECT 0, 0, 'inf'::DOUBLE)"""


@query("q29_roc_points", f"WITH {_ROC} SELECT round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, threshold FROM pts WHERE threshold < 'inf'::DOUBLE")
def q29(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.roc_points(_scored(spark, d)).filter(F.col("threshold") < float("inf")).select(r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"), "threshold")


@query("q29_tpr_interpolated", f"WITH {_ROC}, a AS (SELECT fpr, tpr FROM pts WHERE fpr <= 0.05 ORDER BY fpr DESC, tpr DESC LIMIT 1), b AS (SELECT fpr, tpr FROM pts WHERE fpr >= 0.05 ORDER BY fpr, tpr LIMIT 1) SELECT round(a.tpr + CASE WHEN b.fpr > a.fpr THEN (b.tpr - a.tpr) / (b.fpr - a.fpr) * (0.05 - a.fpr) ELSE 0 END, 6) AS tpr FROM a, b")
def q29i(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.tpr_interpolated(_scored(spark, d), 0.05).select(r6(F.col("tpr")).alias("tpr"))


@query(
    "q29_tpr_empirical",
    f"""WITH {_SCORED}, c AS (SELECT domain, quantile_cont(s, 0.95) FILTER (y = 0) AS cut, count(*) FILTER (y = 0) AS nh FROM scored WHERE y IS NOT NULL GROUP BY domain)
    SELECT domain, round(max(cut), 6) AS threshold, round(CASE WHEN max(nh) >= 21 THEN avg((s > cut)::INT) FILTER (y = 1) END, 6) AS tpr FROM scored JOIN c USING (domain) WHERE y IS NOT NULL GROUP BY domain""",
)
def q29e(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.tpr_empirical(_scored(spark, d).filter("domain IS NOT NULL"), 0.05, ["domain"])
    return out.select("domain", r6(F.col("threshold")).alias("threshold"), r6(F.col("tpr")).alias("tpr"))


def _grid_sql(grid: str) -> str:
    return f"""WITH {_SCORED}, ok AS (SELECT y, s FROM scored WHERE y IS NOT NULL), grid AS ({grid}),
    ba AS (SELECT t, (avg((s > t)::INT) FILTER (y = 1) + avg((s <= t)::INT) FILTER (y = 0)) / 2 AS ba FROM ok, grid GROUP BY t) SELECT round(t, 6) AS tau, round(ba, 6) AS ba FROM ba ORDER BY ba DESC, t LIMIT 1"""


@query("q30_fixed_grid", _grid_sql("SELECT -10::DOUBLE + i * 0.5::DOUBLE AS t FROM range(40) r(i)"))
def q30(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    return evaluate.best_threshold(scored, evaluate.fixed_grid(scored, -10.0, 10.0, 0.5)).select(r6(F.col("tau")).alias("tau"), r6(F.col("ba")).alias("ba"))


@query("q30_quantile_grid", _grid_sql("SELECT DISTINCT unnest((SELECT quantile_cont(s, list_transform(range(1500), lambda i: 0.001::DOUBLE + 0.998::DOUBLE * i / 1499)) FROM ok)) AS t"))
def q30q(spark: SparkSession, d: str) -> DataFrame:
    scored = _scored(spark, d)
    return evaluate.best_threshold(scored, evaluate.quantile_grid(scored)).select(r6(F.col("tau")).alias("tau"), r6(F.col("ba")).alias("ba"))


@query("q30_youden", f"WITH {_ROC} SELECT CASE WHEN isinf(threshold) THEN (SELECT max(s) FROM per) ELSE threshold END AS tau, round(tpr - fpr, 6) AS j FROM pts ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1")
def q30y(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.youden(_scored(spark, d)).select("tau", r6(F.col("j")).alias("j"))


@query("q30_fpr_threshold", f"WITH {_ROC} SELECT min(threshold) AS tau FROM pts WHERE fpr <= 0.05")
def q30f(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.threshold_at_fpr(_scored(spark, d), 0.05)


@query(
    "q31_metric_block",
    f"""WITH {_SCORED}, ok AS (SELECT * FROM scored WHERE y IS NOT NULL), {_AUROC.format(by="domain,", part="PARTITION BY domain", whole="PARTITION BY domain")},
    a AS (SELECT domain, sum(p * (below + n / 2)) / nullif(max(pa) * max(na), 0) AS auroc FROM run GROUP BY domain), c AS (SELECT domain, quantile_cont(s, 0.99) FILTER (y = 0) AS cut, count(*) FILTER (y = 0) AS nh FROM ok GROUP BY domain),
    t AS (SELECT ok.domain, CASE WHEN max(nh) >= 21 THEN avg((s > cut)::INT) FILTER (y = 1) END AS tpr FROM ok JOIN c ON ok.domain IS NOT DISTINCT FROM c.domain GROUP BY ok.domain),
    m AS (SELECT domain, count(*) AS n, count(*) FILTER (y = 1) AS n_machine, count(*) FILTER (y = 0) AS n_human, avg((s > 0)::INT) FILTER (y = 1) AS rm, avg((s <= 0)::INT) FILTER (y = 0) AS rh FROM ok GROUP BY domain)
    SELECT m.domain, n, n_machine, n_human, rm IS NULL OR rh IS NULL AS single_class, CASE WHEN n >= 20 THEN round(rm, 6) END AS recall_machine, CASE WHEN n >= 20 THEN round(rh, 6) END AS recall_human,
    CASE WHEN n >= 20 THEN round(coalesce((rm + rh) / 2, rm, rh), 6) END AS ba, CASE WHEN n >= 20 THEN round(auroc, 6) END AS auroc, CASE WHEN n >= 20 THEN round(tpr, 6) END AS tpr
    FROM m JOIN a ON m.domain IS NOT DISTINCT FROM a.domain JOIN t ON m.domain IS NOT DISTINCT FROM t.domain""",
)
def q31(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.metric_block(_scored(spark, d), 0.0, ["domain"], least=20)
    return out.select("domain", "n", "n_machine", "n_human", "single_class", *[r6(F.col(c)).alias(c) for c in ("recall_machine", "recall_human", "ba", "auroc", "tpr")])


@query("q31_bootstrap")
def q31b(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.bootstrap_interval(_scored(spark, d), 0.0, ["domain"])


@query(
    "q32_spearman",
    """WITH d AS (SELECT length(text)::DOUBLE AS a, n_chars::DOUBLE AS b FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL),
    r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM d) SELECT round(corr(ra, rb), 6) AS rho FROM r""",
)
def q32(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "documents").select(F.length("text").alias("a"), F.col("n_chars").alias("b"))
    return evaluate.spearman(pairs, "a", "b").select(r6(F.col("rho")).alias("rho"))


@query("q33_distribution", f"WITH {_SCORED} SELECT domain, min(s) AS low, median(s) AS mid, max(s) AS high, count(DISTINCT s) AS n_unique, round(avg((s > 0)::INT), 6) AS positive FROM scored WHERE y IS NOT NULL GROUP BY domain")
def q33(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.distribution(_scored(spark, d), ["domain"]).withColumn("positive", r6(F.col("positive")))


@query(
    "q33_bands",
    f"""SELECT doc_id, s > 0.5 AS flagged, CASE WHEN s - 0.5 > 4 THEN 'likely machine' WHEN s - 0.5 > 0 THEN 'leaning machine' WHEN s - 0.5 > -4 THEN 'leaning human' ELSE 'likely human' END AS band,
    CASE WHEN abs(s) < 4 THEN 'void' ELSE CASE WHEN s > 0 THEN 'machine' ELSE 'human' END || ' ' || CASE WHEN abs(s) >= 12 THEN 'high' WHEN abs(s) >= 8 THEN 'moderate' ELSE 'low' END END AS reading,
    CASE WHEN w < 25 THEN 'not reliable' WHEN w < 75 THEN 'caution' END AS warning, round(least(greatest((s + 20) / 40 * 100, 1), 99), 6) AS gauge, substr(text, 1, 80) AS preview
    FROM (SELECT doc_id, text, (length(text) % 97 - 48) / 4.0::DOUBLE AS s, len({q.white_words("text")}) AS w FROM documents WHERE text IS NOT NULL)""",
)
def q33b(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text", ((F.length("text") % 97 - 48) / F.lit(4.0)).alias("s"), tokens.word_count(F.col("text")).alias("w"))
    s = F.col("s")
    return rows.select("doc_id", scoring.flagged(s, 0.5).alias("flagged"), scoring.band(s, 0.5).alias("band"), scoring.reading(s).alias("reading"), scoring.length_warning(F.col("w")).alias("warning"), r6(scoring.gauge(s)).alias("gauge"), F.substring("text", 1, 80).alias("preview"))


# ---- explanation and reports ----------------------------------------------------------------
def _sentences(spark: SparkSession, d: str) -> DataFrame:
    out = explain.sentence_table(table(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", n64("idx").alias("idx"), "sentence", n64("n_words").alias("n_words"))


@query("q34_protected_sentences", f"WITH {q.SENTENCES} SELECT * FROM sents")
def q34(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d)


@query("q35_word_budget", f"WITH {q.BUDGET} SELECT * FROM kept")
def q35(spark: SparkSession, d: str) -> DataFrame:
    return explain.within_budget(_sentences(spark, d), "doc_id")


@query("q35_repeated_sentences", f"WITH {q.SENTENCES}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sentence) AS c FROM sents) SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (c > 1) AS n_repeated FROM c GROUP BY doc_id")
def q35r(spark: SparkSession, d: str) -> DataFrame:
    return explain.repeated_sentences(_sentences(spark, d), "doc_id")


def _linear():
    """A linear stand-in for a detector: words and full stops of a text."""
    return linear({"words": (tokens.word_count, 0.05), "stops": (lambda t: F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))), -0.4)}, bias=-1.0)


@query(
    "q36_leave_one_out",
    f"""WITH {q.BUDGET}, u AS (SELECT doc_id, sentence, min(idx) AS idx, any_value(n_words) AS n_words, count(*) AS times FROM kept GROUP BY doc_id, sentence), tried AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_words DESC, idx) <= 12),
    e AS (SELECT t.*, {q.linear("text")} AS doc_score, {q.linear("text")} - {q.linear("replace(text, sentence, ' ')")} AS effect, {q.linear("sentence")} AS alone FROM tried t JOIN l0 USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(effect) DESC, idx) AS rank, max(abs(effect)) OVER (PARTITION BY doc_id) < 0.05::DOUBLE * greatest(abs(doc_score), 1) AS flat FROM e)
    SELECT doc_id, idx, sentence, times, rank, flat, round(doc_score, 6) + 0 AS doc_score, round(effect, 6) + 0 AS effect, round(alone, 6) + 0 AS alone FROM r WHERE rank <= 5""",
)
def q36(spark: SparkSession, d: str) -> DataFrame:
    out = explain.leave_one_out(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", "text", _linear())
    return out.select("doc_id", n64("idx").alias("idx"), "sentence", "times", n64("rank").alias("rank"), "flat", *[r6(F.col(c)).alias(c) for c in ("doc_score", "effect", "alone")])


@query("q37_links", r"SELECT doc_id, regexp_extract(text, '(www\.[^\s]+|[A-Za-z0-9._-]+@[A-Za-z0-9.-]+)', 1) AS link, regexp_replace(source, '[^\p{L}\p{N}_.-]', '_', 'g') AS slug FROM documents WHERE text IS NOT NULL")
def q37(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tokens.first_link(F.col("text")).alias("link"), tokens.slug(F.col("source")).alias("slug"))


@query("q38_unfolded_pairs", "SELECT article_id, 0 AS label, human_text AS text, 'human' AS generator FROM generated_articles WHERE human_text IS NOT NULL UNION ALL SELECT article_id, 1, machine_text, generator_id FROM generated_articles WHERE machine_text IS NOT NULL")
def q38(spark: SparkSession, d: str) -> DataFrame:
    from textquarry.sources.readers import unfold_pairs

    return unfold_pairs(table(spark, d, "generated_articles"), "article_id", "generator_id")


@query("q39_name_match", "SELECT p_partkey, pattern FROM part, (VALUES ('goldenrod'), ('AZURE'), ('Blue')) v(pattern) WHERE contains(lower(p_name), lower(pattern))")
def q39(spark: SparkSession, d: str) -> DataFrame:
    return curate.name_matches(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["goldenrod", "AZURE", "Blue"]).select("p_partkey", "pattern")


@query("q40_leaderboard", f"WITH {_SCORED}, m AS (SELECT domain, (avg((s > 0)::INT) FILTER (y = 1) + avg((s <= 0)::INT) FILTER (y = 0)) / 2 AS ba FROM scored GROUP BY domain) SELECT domain, round(ba, 6) AS ba, rank() OVER (ORDER BY coalesce(round(ba, 6), -1) DESC) AS place FROM m")
def q40(spark: SparkSession, d: str) -> DataFrame:
    from textquarry.operators.report import placed

    metrics = evaluate.finite(_scored(spark, d)).groupBy("domain").agg(*evaluate.balanced_accuracy(F.lit(0.0)))
    both = metrics.select("domain", r6(F.when(~F.col("single_class"), F.col("ba"))).alias("ba"))
    return placed(both, "ba")


@query(
    "q41_result_upsert",
    """WITH old AS (SELECT domain, count(*) AS n, 'old' AS tag FROM documents WHERE doc_id % 2 = 0 GROUP BY domain), new AS (SELECT domain, count(*) AS n, 'new' AS tag FROM documents WHERE label = 1 GROUP BY domain)
    SELECT coalesce(new.domain, old.domain) AS domain, coalesce(new.n, old.n) AS n, coalesce(new.tag, old.tag) AS tag FROM old FULL JOIN new ON old.domain IS NOT DISTINCT FROM new.domain""",
)
def q41(spark: SparkSession, d: str) -> DataFrame:
    from textquarry.operators.report import upsert

    docs = table(spark, d, "documents")
    old = docs.filter("doc_id % 2 = 0").groupBy("domain").agg(F.count("*").alias("n")).withColumn("tag", F.lit("old"))
    new = docs.filter("label = 1").groupBy("domain").agg(F.count("*").alias("n")).withColumn("tag", F.lit("new"))
    return upsert(old, new, ["domain"])


@query(
    "q42_content_fingerprint",
    "SELECT count(*) AS n, CAST(coalesce(sum(('0x' || substr(md5(doc_id || '|' || coalesce(text, '')), 1, 12))::HUGEINT), 0) % 281474976710656 AS BIGINT) AS digest FROM documents",
)
def q42(spark: SparkSession, d: str) -> DataFrame:
    return stats.content_fingerprint(table(spark, d, "documents"), "doc_id", "text")


@query(
    "q42_ordered_fingerprint",
    """WITH b AS (SELECT doc_id // 1000 AS b, sha1(string_agg(sha1(coalesce(text, '')), '|' ORDER BY doc_id)) AS h FROM documents GROUP BY 1), c AS (SELECT b // 1000 AS c, sha1(string_agg(h, '|' ORDER BY b)) AS h FROM b GROUP BY 1)
    SELECT substr(sha1(string_agg(h, '|' ORDER BY c)), 1, 12) AS digest FROM c""",
)
def q42o(spark: SparkSession, d: str) -> DataFrame:
    return stats.ordered_fingerprint(table(spark, d, "documents"), "doc_id", "text")


@query(
    "q43_word_statistics",
    f"SELECT generator, count(*) AS n, round(avg(w), 6) AS mean_words, median(w) AS median_words, min(w) AS least, max(w) AS most, count(*) FILTER (coalesce(w <> word_count, true)) AS stale FROM (SELECT generator_id AS generator, word_count, len({q.white_words('machine_text')}) AS w FROM generated_articles WHERE machine_text IS NOT NULL) GROUP BY generator",
)
def q43(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generated_articles").filter("machine_text IS NOT NULL").select(F.col("generator_id").alias("generator"), "word_count", n64(tokens.word_count(F.col("machine_text"))).alias("w"))
    return stats.word_statistics(rows, "w", "word_count", ["generator"]).withColumn("mean_words", r6(F.col("mean_words")))


@query("q44_polarity", f"WITH {_SCORED}, {_AUROC.format(by='domain,', part='PARTITION BY domain', whole='PARTITION BY domain')}, a AS (SELECT domain, coalesce(sum(p * (below + n / 2)) / nullif(max(pa) * max(na), 0) < 0.5, false) AS flipped FROM run GROUP BY domain) SELECT a.domain, a.flipped, round(sum(CASE WHEN flipped THEN -s ELSE s END), 6) AS total FROM scored JOIN a ON scored.domain IS NOT DISTINCT FROM a.domain GROUP BY ALL")
def q44(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.polarity(_scored(spark, d), ["domain"]).groupBy("domain", "flipped").agg(r6(F.sum("s")).alias("total"))


@query("q45_score_health", "SELECT domains, count(*) AS n, count(*) FILTER (bad) AS n_bad, count(*) FILTER (bad) > 0 AS skip FROM (SELECT domains, features[1] IS NULL OR isnan(features[1]) OR isinf(features[1]) AS bad FROM raid_ai_v217) GROUP BY domains")
def q45(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.score_health(table(spark, d, "raid_ai_v217").select("domains", F.get("features", F.lit(0)).cast("double").alias("s")), ["domains"])


@query(
    "q46_assembled_split",
    "SELECT coalesce(sources, '-') AS source, coalesce(attacks, 'none') AS attack, split, count(*) AS n FROM (SELECT sources, attacks, split FROM v217_bundle UNION ALL SELECT NULL, attacks, 'train' FROM raid_ai_v217) GROUP BY ALL",
)
def q46(spark: SparkSession, d: str) -> DataFrame:
    from textquarry.sources.readers import assemble

    cache = table(spark, d, "raid_ai_v217").select("texts", "labels", "domains", "generators", "attacks", F.lit("train").alias("split"))
    bundle = table(spark, d, "v217_bundle").drop("row_id")
    return assemble([bundle, cache]).groupBy(F.col("sources").alias("source"), F.col("attacks").alias("attack"), "split").agg(F.count("*").alias("n"))


# ---- sources and sinks, written and read back ---------------------------------------------------
def _sink(kind: str):
    def plan(spark: SparkSession, d: str) -> DataFrame:
        from textquarry.sources import writers

        return writers.round_trip(spark, table(spark, d, "v217_bundle"), kind)

    return plan


query("q47_parquet_by_split", "SELECT row_id, texts, labels, sources, split FROM v217_bundle")(_sink("parquet"))
query("q47_csv_export", "SELECT row_id, texts, labels, sources, split FROM v217_bundle")(_sink("csv"))
query("q47_jsonl_export", "SELECT row_id, texts, labels, sources, split FROM v217_bundle")(_sink("json"))
