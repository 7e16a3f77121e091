"""Queries of the smaller operators: scans, sinks, look-ups, reports, scorers and chains, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import plugins, tokens
from textquarry.operators import chains, curate, evaluate, features, heads, report, score, split, stats
from textquarry.plans import sql as q
from textquarry.plans.catalogue import _SCORED, _linear, _scored, n64, r6
from textquarry.sources import readers, runs, writers
from textquarry.sources.readers import table
from textquarry.storage import Scratch
from textquarry.streaming import flows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under ``name``, with its SQL where SQL can express it."""

    def add(plan):
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return add


def _place(spark: SparkSession, name: str) -> str:
    """A folder of one query in the shared folder, removed when the application ends."""
    scratch = Scratch(spark, "query")
    scratch.save(spark.range(1), "mark")
    return f"{scratch.root}/{name}"


# ---- scans -----------------------------------------------------------------------------
@query("q50_csv_quota", "SELECT title AS text FROM generated_articles WHERE title IS NOT NULL AND title <> '' ORDER BY article_id LIMIT 100")
def q50_csv(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of one CSV file (S3)."""
    at = _place(spark, "csv")
    titles = table(spark, d, "generated_articles").filter("title IS NOT NULL AND title <> ''").select("article_id", F.col("title").alias("text"))
    writers.csv_export(titles.orderBy("article_id").coalesce(1), at)
    return readers.csv_quota(spark, at, 100)


_LINES = "SELECT title, generator_id, word_count FROM generated_articles"


def _json_lines(spark: SparkSession, d: str, bad: bool) -> str:
    at = _place(spark, "lines")
    rows = table(spark, d, "generated_articles").select(F.to_json(F.struct("title", "generator_id", "word_count")).alias("value"))
    if bad:
        rows = rows.union(spark.createDataFrame([("",), ("   ",), ("not json",), ('{"title": "cut',), ("[1, 2",)], "value string"))
    rows.write.text(at)
    return at


@query("q50_tolerant_jsonl", _LINES)
def q50_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines among blank and malformed ones."""
    return readers.jsonl_tolerant(spark, _json_lines(spark, d, True), readers.PAIRS).select("title", "generator_id", "word_count")


@query("q50_strict_jsonl", _LINES)
def q50_strict(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of which none may be malformed."""
    return readers.jsonl_strict(spark, _json_lines(spark, d, False), readers.PAIRS).select("title", "generator_id", "word_count")


@query("q50_text_lines", "SELECT title AS text FROM generated_articles WHERE length(trim(title)) > 0")
def q50_lines(spark: SparkSession, d: str) -> DataFrame:
    """Text lines without the blank ones."""
    at = _place(spark, "text")
    table(spark, d, "generated_articles").select(F.coalesce("title", F.lit(" ")).alias("value")).write.text(at)
    return readers.text_lines(spark, at)


@query("q50_file_parts", "SELECT doc_id, CASE label WHEN 0 THEN 'human' ELSE 'machine' END AS generator FROM documents WHERE label IN (0, 1)")
def q50_parts(spark: SparkSession, d: str) -> DataFrame:
    """Files whose names end in the generator."""
    at = _place(spark, "files")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    for label, name in ((0, "human"), (1, "machine")):
        table(spark, d, "documents").filter(F.col("label") == label).select("doc_id").coalesce(1).write.json(f"{at}/{name}")
        for part in files.globStatus(path(f"{at}/{name}/part-*")):
            files.rename(part.getPath(), path(f"{at}/news_{name}.jsonl"))
        files.delete(path(f"{at}/{name}"), True)
    return readers.with_file_part(spark, f"{at}/*.jsonl", readers.T.StructType().add("doc_id", "long"))


_LINK = "'https://huggingface.co/' || CASE WHEN p_size % 5 = 0 THEN 'spaces/' ELSE '' END || replace(p_brand, '#', '.') || '/' || p_type"
_FIXES = {"Brand.2/ECONOMY": "Brand.2/economy", "Brand.17/ECONOMY": "Brand.17/economy"}


@query(
    "q50_model_ids",
    f"""SELECT p_partkey, CASE raw {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FIXES.items())} ELSE raw END AS model_id, CASE WHEN raw IN ({", ".join(f"'{k}'" for k in _FIXES)}) THEN raw END AS id_corrected_from
    FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE regexp_extract({_LINK}, 'huggingface[.]co/([\\p{{L}}\\p{{N}}_.-]+/[\\p{{L}}\\p{{N}}_.-]+)', 1) END AS raw FROM part)""",
)
def q50_ids(spark: SparkSession, d: str) -> DataFrame:
    """Model ids of links, with corrections looked up."""
    link = F.concat(F.lit("https://huggingface.co/"), F.when(F.col("p_size") % 5 == 0, "spaces/").otherwise(""), F.replace("p_brand", F.lit("#"), F.lit(".")), F.lit("/"), F.col("p_type"))
    rows = table(spark, d, "part").select("p_partkey", readers.model_id(link).alias("raw"))
    return readers.corrected_ids(rows, "raw", _FIXES).select("p_partkey", "model_id", "id_corrected_from")


@query("q50_metadata_links", "SELECT * FROM (VALUES ('Alpha', 'org/fixed-1', 'a', 'https://huggingface.co/org/typo-1', 'org/typo-1'), ('b', 'lab/net', 'b', 'see huggingface.co/lab/net/tree/main', NULL)) v(name, model_id, submission, link, id_corrected_from)")
def q50_links(spark: SparkSession, d: str) -> DataFrame:
    """Metadata files of submissions: two with model links, one with a space, one without a link."""
    at = _place(spark, "meta")
    found = {"a": {"detector_name": "Alpha", "huggingface_link": " https://huggingface.co/org/typo-1 "}, "b": {"huggingface_link": "see huggingface.co/lab/net/tree/main"}, "c": {"detector_name": "C", "huggingface_link": "https://huggingface.co/spaces/x/y"}, "d": {"detector_name": "D"}}
    for name, content in found.items():
        spark.createDataFrame([(line,) for line in json.dumps(content, indent=1).split("\n")], "value string").coalesce(1).write.text(f"{at}/{name}")
    return readers.metadata_links(spark, f"{at}/*/part-*", {"org/typo-1": "org/fixed-1"})


@query(
    "q51_run_spec",
    "SELECT doc_id, coalesce(text, '') AS text, CAST(label = 1 AS INT) AS y, domain FROM documents WHERE lang IN ('en', 'de') AND NOT coalesce(attack IN ('homoglyph', 'upper_lower'), false)",
)
def q51(spark: SparkSession, d: str) -> DataFrame:
    """A set of a run specification: include and exclude lists, label value, groups."""
    spec = {"val": {"path": f"{d}/documents.parquet", "text": "TEXT", "include": {"lang": ["en", "de"]}, "exclude": {"attack": ["homoglyph", "upper_lower"]}, "groups": ["domain"], "ai_value": 1}}
    return runs.RunSpec.parse(json.dumps(spec)).val.load(spark)


@query("q51_score_cache", f"SELECT doc_id, round({q.linear('text')}, 6) AS score FROM documents WHERE text IS NOT NULL")
def q51_cache(spark: SparkSession, d: str) -> DataFrame:
    """Scores computed once, checked, stored and read again."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    at = _place(spark, "cache")
    for _ in range(2):
        out = runs.cached_scores(docs, at, "linear", lambda df: df.select("doc_id", r6(_linear()(F.col("text"))).alias("score")))
    return out


@query("q51_model_table", f"SELECT doc_id, round({q.linear('text')}, 6) AS margin FROM documents WHERE text IS NOT NULL")
def q51_model(spark: SparkSession, d: str) -> DataFrame:
    """A linear model stored as a table, read back under a strict check of its names, and applied."""
    at = _place(spark, "model")
    runs.save_model(spark, at, -1.0, {"words": 0.05, "stops": -0.4})
    bias, weights = runs.load_model(spark, at, ["words", "stops"])
    values = {"words": tokens.word_count, "stops": lambda t: F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))}
    net = score.linear({k: (values[k], w) for k, w in weights.items()}, bias)
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", r6(net(F.col("text"))).alias("margin"))


# ---- sinks -----------------------------------------------------------------------------
@query("q52_appended_stream", f"SELECT article_id, CAST(len(w) AS BIGINT) AS n_words FROM ({q.GATED}) WHERE {q.GATE} = 'ok'")
def q52(spark: SparkSession, d: str) -> DataFrame:
    """Accepted records appended to JSON lines by a stream (K5)."""
    at = _place(spark, "stream")
    schema = table(spark, d, "generated_articles").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "generated_articles.parquet").parquet(d)
    kept = flows.gated(stream.select("article_id", "machine_text"), "machine_text", curate.generation_gate).select("article_id", n64("n_words").alias("n_words"))
    flows.append_jsonl(kept, at, f"{at}-checkpoint").awaitTermination()
    return spark.read.schema("article_id long, n_words long").json(at)


@query("q53_predictions", f"SELECT CAST(doc_id AS VARCHAR) AS id, round({q.linear('text')}, 6) AS score FROM documents WHERE text IS NOT NULL")
def q53(spark: SparkSession, d: str) -> DataFrame:
    """Predictions as a JSON array, read back (K6)."""
    at = _place(spark, "predictions")
    rows = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), r6(_linear()(F.col("text"))).alias("score"))
    writers.predictions(rows, at)
    return spark.read.option("multiLine", True).schema("id string, score double").json(at)


@query("q53_run_results", "SELECT domain AS detector, CASE WHEN label = 1 THEN 'raw' ELSE 'folded' END AS variant, count(*) AS n FROM documents WHERE domain IS NOT NULL GROUP BY ALL")
def q53_runs(spark: SparkSession, d: str) -> DataFrame:
    """A result file for each detector and variant (K9)."""
    at = _place(spark, "results")
    rows = table(spark, d, "documents").filter("domain IS NOT NULL").groupBy(F.col("domain").alias("detector"), F.when(F.col("label") == 1, "raw").otherwise("folded").alias("variant")).agg(F.count("*").alias("n"))
    writers.results_by_run(rows, at)
    return spark.read.schema("n long, detector string, variant string").json(at).select("detector", "variant", "n")


@query("q53_settings", "SELECT article_id, coalesce(model, '-') AS detector, 'x@y.org' AS contact, substr(title, 1, 10) AS run FROM generated_articles")
def q53_map(spark: SparkSession, d: str) -> DataFrame:
    """Settings of a template with changes over them (K7)."""
    template = F.create_map(F.lit("detector"), F.lit("none"), F.lit("contact"), F.lit("x@y.org"))
    changes = F.create_map(F.lit("detector"), F.coalesce("model", F.lit("-")), F.lit("run"), F.substring("title", 1, 10))
    out = table(spark, d, "generated_articles").select("article_id", report.overridden(template, changes).alias("m"))
    return out.select("article_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("detector", "contact", "run")])


@query("q53_wide_report", "SELECT domain, CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS en, CAST(count(*) FILTER (lang = 'de') AS BIGINT) AS de FROM documents GROUP BY domain")
def q53_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per domain and a column per language."""
    counts = table(spark, d, "documents").groupBy("domain", "lang").agg(F.count("*").alias("n"))
    return report.wide(counts, "domain", "lang", "n", ["en", "de"]).na.fill(0, ["en", "de"])


# ---- projections, filters, look-ups --------------------------------------------------------
@query("q54_resumed_prompts", "SELECT article_id, title FROM generated_articles a WHERE NOT EXISTS (SELECT 1 FROM generated_articles b WHERE b.title = a.title AND b.word_count >= 100)")
def q54(spark: SparkSession, d: str) -> DataFrame:
    """Prompts whose title has no long record yet."""
    rows = table(spark, d, "generated_articles").select("article_id", "title", "word_count")
    return curate.not_yet_done(rows.select("article_id", "title"), rows.filter("word_count >= 100"))


@query(
    "q54_usable_prompts",
    "SELECT article_id, coalesce(length(trim(coalesce(title, ''))) > 0 AND NOT (" + " OR ".join(f"contains(lower(title), '{w}')" for w in q.tables.SENSITIVE_TITLE_WORDS) + f") AND len({q.white_words('human_text')}) >= 50, false) AS usable FROM generated_articles",
)
def q54_usable(spark: SparkSession, d: str) -> DataFrame:
    """Titles and human texts fit for a prompt."""
    return table(spark, d, "generated_articles").select("article_id", curate.usable_prompt(F.col("title"), F.col("human_text")).alias("usable"))


@query("q54_class_predicate", "SELECT domain, count(*) FILTER (model = 'human') AS human, count(*) FILTER (model <> 'human') AS machine FROM raid GROUP BY domain")
def q54_class(spark: SparkSession, d: str) -> DataFrame:
    """Human and machine rows by the model column (P2); a null model is neither."""
    rows = table(spark, d, "raid").select("domain", curate.is_human(F.col("model")).alias("human"))
    return rows.groupBy("domain").agg(F.count_if("human").alias("human"), F.count_if(~F.col("human")).alias("machine"))


def _clean_sql(i: int) -> str:
    return f"round(CASE WHEN features[{i + 1}] IS NULL OR isnan(features[{i + 1}]) OR isinf(features[{i + 1}]) THEN 0 ELSE features[{i + 1}]::DOUBLE END, 6) + 0"


@query("q54_chosen_features", f"SELECT cache_id, {_clean_sql(3)} AS a, {_clean_sql(0)} AS b, {_clean_sql(61)} AS c FROM raid_ai_v217")
def q54_chosen(spark: SparkSession, d: str) -> DataFrame:
    """Listed elements of the feature array, in the order asked for."""
    rows = table(spark, d, "raid_ai_v217").select("cache_id", stats.chosen_features(F.col("features"), [3, 0, 61]).alias("x"))
    return rows.select("cache_id", *[r6(stats.clean_number(F.get("x", F.lit(i)))).alias(n) for i, n in enumerate("abc")])


@query("q54_all_keys", "SELECT md5(substr(text, 1, 200)) AS key FROM documents WHERE text IS NOT NULL UNION SELECT md5(substr(texts, 1, 200)) FROM v217_bundle WHERE texts IS NOT NULL")
def q54_keys(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes of two tables as one set."""
    return curate.all_keys([curate.prefix(F.col("text")), curate.prefix(F.col("texts"))], [table(spark, d, "documents"), table(spark, d, "v217_bundle")])


@query("q54_overlap_flags", "SELECT row_id, sources IN ('MAGE', 'M4') AS flagged, CASE sources WHEN 'MAGE' THEN 768 WHEN 'M4' THEN 1024 ELSE 512 END AS max_length FROM (SELECT row_id, coalesce(sources, '-') AS sources FROM v217_bundle)")
def q54_flags(spark: SparkSession, d: str) -> DataFrame:
    """Look-ups in small fixed maps with a default."""
    s = F.coalesce("sources", F.lit("-"))
    return table(spark, d, "v217_bundle").select("row_id", curate.looked_up(s, {"MAGE": True, "M4": True}, False).alias("flagged"), curate.looked_up(s, {"MAGE": 768, "M4": 1024}, 512).alias("max_length"))


@query(
    "q54_label_names",
    r"""SELECT p_partkey, CASE WHEN a AND NOT h THEN 1 WHEN h AND NOT a THEN 0 END AS polarity FROM (SELECT p_partkey, regexp_matches(n, '(^|[^a-z])(ai|fake|machine|generated|gpt|chatgpt|llm|synthetic)([^a-z]|$)') AS a, regexp_matches(n, '(human|real)') AS h
    FROM (SELECT p_partkey, lower(CASE p_size % 7 WHEN 0 THEN 'ChatGPT' WHEN 1 THEN 'humanwritten' WHEN 2 THEN 'AI' WHEN 3 THEN 'not-real fake' WHEN 4 THEN 'domain' WHEN 5 THEN 'machine_text' ELSE p_name END) AS n FROM part))""",
)
def q54_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names of label classes to their polarity."""
    kind = F.col("p_size") % 7
    name = F.when(kind == 0, "ChatGPT").when(kind == 1, "humanwritten").when(kind == 2, "AI").when(kind == 3, "not-real fake").when(kind == 4, "domain").when(kind == 5, "machine_text").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", tokens.label_polarity(name).alias("polarity"))


@query("q54_text_keys", "SELECT article_id, trim(regexp_extract(coalesce(prompt, '') || ' from title ''' || coalesce(title, '') || ''' now', 'from title ''([^'']+)''', 1)) AS title, coalesce(model, '') || '|' || coalesce(source, '') || '|' || coalesce(generator_id, '') AS key FROM generated_articles")
def q54_text_keys(spark: SparkSession, d: str) -> DataFrame:
    """The quoted title of a prompt and a key of three parts."""
    prompt = F.concat(F.coalesce("prompt", F.lit("")), F.lit(" from title '"), F.coalesce("title", F.lit("")), F.lit("' now"))
    return table(spark, d, "generated_articles").select("article_id", tokens.title_in_prompt(prompt).alias("title"), tokens.composite_key(F.col("model"), F.col("source"), F.col("generator_id")).alias("key"))


@query("q54_stamps", "SELECT article_id, strftime(coalesce(try_strptime(g, '%Y-%m-%dT%H:%M:%S'), try_strptime(g, '%Y-%m-%d %H:%M:%S')), '%Y%m%d_%H%M%S') AS stamp FROM (SELECT article_id, regexp_replace(generated_at, '([.][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$', '') AS g FROM generated_articles)")
def q54_stamps(spark: SparkSession, d: str) -> DataFrame:
    """ISO stamps of two forms as stamps for file names."""
    return table(spark, d, "generated_articles").select("article_id", stats.stamp(stats.parsed_stamp(F.col("generated_at"))).alias("stamp"))


# ---- evaluation and reports ---------------------------------------------------------------------
@query(
    "q55_confusion",
    f"WITH {_SCORED} SELECT domain, count(*) FILTER (y = 0 AND s > 0.5) AS fp, count(*) FILTER (y = 1 AND s <= 0.5) AS fn FROM scored WHERE y IS NOT NULL GROUP BY domain",
)
def q55(spark: SparkSession, d: str) -> DataFrame:
    """False positives and negatives at a threshold."""
    return evaluate.finite(_scored(spark, d)).groupBy("domain").agg(*evaluate.balanced_accuracy(F.lit(0.5))).select("domain", "fp", "fn")


_BA = "ba AS (SELECT domain, coalesce((avg((s > 0)::INT) FILTER (y = 1) + avg((s <= 0)::INT) FILTER (y = 0)) / 2, avg((s > 0)::INT) FILTER (y = 1), avg((s <= 0)::INT) FILTER (y = 0)) AS ba FROM scored WHERE y IS NOT NULL GROUP BY domain)"


@query("q55_macro_average", f"WITH {_SCORED}, {_BA} SELECT round(CASE WHEN count(*) = 3 THEN avg(ba) END, 6) AS macro FROM ba WHERE domain IN ('news', 'wiki', 'books')")
def q55_macro(spark: SparkSession, d: str) -> DataFrame:
    """Mean over three named sets."""
    blocks = evaluate.finite(_scored(spark, d)).groupBy("domain").agg(*evaluate.balanced_accuracy(F.lit(0.0)))
    return evaluate.macro_average(blocks, ["news", "wiki", "books"], "domain").select(r6(F.col("macro")).alias("macro"))


_BLOCK = f"""{_SCORED}, ok AS (SELECT * FROM scored WHERE y IS NOT NULL AND domain IS NOT NULL),
    grid AS (SELECT domain, unnest(quantile_cont(s, list_transform(range(1500), lambda i: 0.001::DOUBLE + 0.998::DOUBLE * i / 1499))) AS t FROM ok GROUP BY domain),
    tried AS (SELECT domain, t, avg((s > t)::INT) FILTER (y = 1) AS rm, avg((s <= t)::INT) FILTER (y = 0) AS rh FROM ok JOIN (SELECT DISTINCT domain, t FROM grid) USING (domain) GROUP BY domain, t),
    oracle AS (SELECT domain, max((rm + rh) / 2) AS oracle_ba FROM tried GROUP BY domain),
    per AS (SELECT domain, s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM ok GROUP BY domain, s),
    pts AS (SELECT domain, sum(n) OVER (PARTITION BY domain ORDER BY s DESC) / nullif(sum(n) OVER (PARTITION BY domain), 0) AS fpr, sum(p) OVER (PARTITION BY domain ORDER BY s DESC) / nullif(sum(p) OVER (PARTITION BY domain), 0) AS tpr FROM per UNION ALL SELECT DISTINCT domain, 0, 0 FROM per)"""


def _between(x: str) -> str:
    return f"""SELECT domain, max(struct_pack(f := fpr, t := tpr)) FILTER (fpr <= {x}) AS a, min(struct_pack(f := fpr, t := tpr)) FILTER (fpr >= {x}) AS b FROM pts GROUP BY domain"""


@query(
    "q55_full_block",
    f"""WITH {_BLOCK}, {_BA}, own AS (SELECT domain, coalesce((avg((s > 2)::INT) FILTER (y = 1) + avg((s <= 2)::INT) FILTER (y = 0)) / 2, avg((s > 2)::INT) FILTER (y = 1), avg((s <= 2)::INT) FILTER (y = 0)) AS ba_native FROM ok GROUP BY domain),
    i1 AS ({_between("0.01")}), i5 AS ({_between("0.05")})
    SELECT domain, CASE WHEN oracle_ba IS NOT NULL THEN round(i1.a.t + CASE WHEN i1.b.f > i1.a.f THEN (i1.b.t - i1.a.t) / (i1.b.f - i1.a.f) * (0.01 - i1.a.f) ELSE 0 END, 6) END AS tpr_1, CASE WHEN oracle_ba IS NOT NULL THEN round(i5.a.t + CASE WHEN i5.b.f > i5.a.f THEN (i5.b.t - i5.a.t) / (i5.b.f - i5.a.f) * (0.05 - i5.a.f) ELSE 0 END, 6) END AS tpr_5,
    round(oracle_ba, 6) AS oracle_ba, round(oracle_ba - ba, 6) + 0 AS oracle_gap, CASE WHEN oracle_ba IS NOT NULL THEN round(ba_native, 6) END AS ba_native FROM oracle JOIN ba USING (domain) JOIN own USING (domain) JOIN i1 USING (domain) JOIN i5 USING (domain)""",
)
def q55_block(spark: SparkSession, d: str) -> DataFrame:
    """The rest of the metric block: interpolated TPR, oracle accuracy and gap, accuracy at the native threshold."""
    out = evaluate.metric_block(_scored(spark, d).filter("domain IS NOT NULL"), 0.0, ["domain"], native=2.0)
    return out.select("domain", *[r6(F.col(c)).alias(c) for c in ("tpr_1", "tpr_5", "oracle_ba", "oracle_gap", "ba_native")])


_TWO = """a AS (SELECT doc_id, (length(text) % 97 - 48) / 4.0::DOUBLE AS a FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, (length(text) % 89 - 44) / 4.0::DOUBLE AS b FROM documents WHERE text IS NOT NULL AND label IS NOT NULL), two AS (SELECT * FROM a JOIN b USING (doc_id))"""


def _two_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    first = docs.select("doc_id", ((F.length("text") % 97 - 48) / F.lit(4.0)).alias("score"))
    return first, docs.filter("label IS NOT NULL").select("doc_id", ((F.length("text") % 89 - 44) / F.lit(4.0)).alias("score"))


@query(
    "q55_score_agreement",
    f"""WITH {_TWO}, r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM two)
    SELECT count(*) AS n, round(avg(abs(a - b)), 6) AS mean_gap, round(max(abs(a - b)), 6) AS most_gap, count(*) FILTER ((a > 0) <> (b > 0)) AS n_turned, round(corr(ra, rb), 6) AS rho FROM r""",
)
def q55_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two runs joined by id, with their rank correlation."""
    out = evaluate.score_agreement(*_two_runs(spark, d), "doc_id")
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("mean_gap", "most_gap", "rho")], "n_turned")


@query(
    "q55_every_cell",
    f"""WITH {_SCORED}, long AS (SELECT 'raw' AS detector, domain AS set, y, s FROM scored UNION ALL SELECT 'turned', domain, y, -s FROM scored), m AS (SELECT detector, set, count(*) AS n, (avg((s > 0)::INT) FILTER (y = 1) + avg((s <= 0)::INT) FILTER (y = 0)) / 2 AS ba FROM long WHERE y IS NOT NULL GROUP BY detector, set)
    SELECT detector, set, n, round(ba, 6) AS ba FROM (SELECT unnest(['raw', 'turned', 'absent']) AS detector) CROSS JOIN (SELECT unnest(['news', 'wiki', 'none']) AS set) LEFT JOIN m USING (detector, set)""",
)
def q55_cells(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every detector on every set, null where there are no rows."""
    rows = _scored(spark, d)
    long = rows.select(F.lit("raw").alias("detector"), F.col("domain").alias("set"), "y", "s").unionByName(rows.select(F.lit("turned").alias("detector"), F.col("domain").alias("set"), "y", (-F.col("s")).alias("s")))
    metric = lambda df, by: evaluate.finite(df).groupBy(*by).agg(F.count("*").alias("n"), *evaluate.balanced_accuracy(F.lit(0.0))).select(*by, "n", r6(F.when(~F.col("single_class"), F.col("ba"))).alias("ba"))
    return evaluate.every_cell(long, ["raw", "turned", "absent"], ["news", "wiki", "none"], metric)


_TALLY = "t AS (SELECT coalesce(sources, '-') AS sources, coalesce(split, '-') AS split, count(*) AS n, count(*) FILTER (labels = 0) AS human, count(*) FILTER (labels = 1) AS machine FROM v217_bundle GROUP BY ALL)"


@query(
    "q55_tally",
    f"""WITH {_TALLY}, s AS (SELECT sum(n)::BIGINT AS n, sum(human)::BIGINT AS h, sum(machine)::BIGINT AS m FROM t)
    SELECT sources, split, n, human, machine, round(n / sn, 6) AS share, round(human / nullif(sh, 0), 6) AS human_share, round(machine / nullif(sm, 0), 6) AS machine_share FROM (SELECT * FROM t UNION ALL SELECT 'TOTAL', 'TOTAL', n, h, m FROM s), (SELECT n AS sn, h AS sh, m AS sm FROM s)""",
)
def q55_tally(spark: SparkSession, d: str) -> DataFrame:
    """Rows by source, split and label with class shares and a total, in falling order."""
    return stats.by_size(stats.tally(table(spark, d, "v217_bundle"), ["sources", "split"], "labels"))


@query(
    "q56_split_quotas",
    """WITH c AS (SELECT split_part(trim(sources), '/', 1) AS source, CASE WHEN md5('42|' || rec_id) < '1a' THEN 'val' ELSE 'train' END AS split, labels AS label FROM split_pool),
    s AS (SELECT split, count(*) FILTER (label = 0 AND source IS DISTINCT FROM 'm4_human_full') AS h, count(*) FILTER (label = 0) AS h_all, count(*) FILTER (label = 1 AND source IS DISTINCT FROM 'RAID_AI') AS m, count(*) FILTER (label = 0 AND source = 'm4_human_full') AS ph, count(*) FILTER (label = 1 AND source = 'RAID_AI') AS pm FROM c WHERE source IS NOT NULL GROUP BY split)
    SELECT split, 'm4_human_full' AS source, 0 AS label, CASE WHEN split = 'val' THEN ph ELSE greatest(0, least(ph, 500000 - h)) END AS quota FROM s UNION ALL SELECT split, 'RAID_AI', 1, CASE WHEN split = 'val' THEN greatest(0, least(pm, h_all - m)) ELSE greatest(0, least(pm, 500000 - m)) END FROM s""",
)
def q56(spark: SparkSession, d: str) -> DataFrame:
    """What the two pools of each split may give, clamped by what they have (A5)."""
    return _quotas(_pooled(spark, d))


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "split_pool")
    side = F.when(split.draw(F.col("rec_id")) < "1a", "val").otherwise("train")
    return rows.select("rec_id", F.split_part(F.trim("sources"), F.lit("/"), F.lit(1)).alias("source"), side.alias("split"), F.col("labels").alias("label")).filter("source IS NOT NULL")


def _quotas(rows: DataFrame) -> DataFrame:
    return split.split_quotas(rows.groupBy("source", "split", "label").agg(F.count("*").alias("n")), {0: 500_000, 1: 500_000}, "m4_human_full", "RAID_AI")


@query(
    "q56_cut_to_quota",
    SQL["q56_split_quotas"].replace("SELECT split_part", "SELECT rec_id, split_part", 1).replace("SELECT split, 'm4", ", q AS (SELECT split, 'm4", 1)
    + """), r AS (SELECT c.rec_id, c.source, c.split, c.label, row_number() OVER (PARTITION BY c.source, c.split, c.label ORDER BY md5('42|' || c.rec_id), c.rec_id) AS k FROM c WHERE c.source IS NOT NULL)
    SELECT rec_id, r.split FROM r LEFT JOIN q ON r.source = q.source AND r.split = q.split AND r.label = q.label WHERE q.quota IS NULL OR k <= q.quota""",
)
def q56_cut(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the quotas leave, in hash order."""
    rows = _pooled(spark, d)
    return split.cut_to_quota(rows, _quotas(rows), "rec_id").select("rec_id", "split")


@query("q57_latest", "SELECT max('runs/' || model || '/' || id) AS path FROM raid")
def q57(spark: SparkSession, d: str) -> DataFrame:
    """The greatest path of a listing."""
    return report.latest(table(spark, d, "raid").select(F.concat(F.lit("runs/"), F.col("model"), F.lit("/"), F.col("id")).alias("path")))


@query("q57_scored_in_order", f"SELECT doc_id, round({q.linear('text')}, 6) AS score FROM documents WHERE text IS NOT NULL ORDER BY doc_id")
def q57_scored(spark: SparkSession, d: str) -> DataFrame:
    """Scores in batches of like length, back in the order of the keys."""
    out = score.scored_in_order(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", "text", _linear())
    return out.withColumn("score", r6(F.col("score")))


@query("q57_top_features", "SELECT * FROM (VALUES ('f2', 0.9::DOUBLE), ('f0', 0.5::DOUBLE), ('f3', 0.5::DOUBLE)) v(name, mi)")
def q57_top(spark: SparkSession, d: str) -> DataFrame:
    """The features of greatest mutual information, ties by name (T5)."""
    ranked = spark.createDataFrame([("f4", 0.1), ("f3", 0.5), ("f2", 0.9), ("f0", 0.5), ("f9", 0.2)], "name string, mi double")
    return stats.top_features(ranked, 3)


@query(
    "q58_moments",
    f"""WITH w AS (SELECT domain, len({q.white_words('text')})::DOUBLE AS w FROM documents WHERE text IS NOT NULL), m AS (SELECT domain, count(*) AS n, avg(w) AS m, stddev_pop(w) AS sd, min(w) AS low, max(w) AS high FROM w GROUP BY domain)
    SELECT m.domain, any_value(n) AS n, round(any_value(m), 6) AS mean, round(any_value(sd), 6) AS deviation, round(coalesce(avg(pow((w - m) / nullif(sd, 0), 3)), 0), 6) + 0 AS skewness, any_value(low) AS low, any_value(high) AS high FROM w JOIN m ON w.domain IS NOT DISTINCT FROM m.domain GROUP BY m.domain""",
)
def q58(spark: SparkSession, d: str) -> DataFrame:
    """Moments of word counts with the population skewness (M5, M6)."""
    rows = table(spark, d, "documents").filter("text IS NOT NULL").select("domain", tokens.word_count(F.col("text")).cast("double").alias("w"))
    return stats.moments(rows, "w", ["domain"]).select("domain", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "deviation", "skewness", "low", "high")])


@query(
    "q58_loss_features",
    """WITH l AS (SELECT vec_id AS doc_id, unnest(embedding)::DOUBLE * unnest(embedding)::DOUBLE * 40 AS loss, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), k AS (SELECT doc_id, quantile_cont(loss, 0.25) AS a, quantile_cont(loss, 0.75) AS b, avg(loss) AS m, stddev_pop(loss) AS sd, count(*) // 2 AS mid FROM l GROUP BY doc_id)
    SELECT doc_id, round(least(exp(any_value(m)), 10000), 6) AS f00, round(any_value(m), 6) AS f01, round(least(max(loss), 50), 6) AS f02, round(any_value(sd), 6) AS f03, round(coalesce(avg(pow((loss - m) / nullif(sd, 0), 3)), 0), 6) AS f04,
    round(avg((loss < a)::INT), 6) AS f05, round(avg((loss > b)::INT), 6) AS f06, round(avg(loss) FILTER (pos >= mid) - avg(loss) FILTER (pos < mid), 6) + 0 AS f07 FROM l JOIN k USING (doc_id) GROUP BY doc_id""",
)
def q58_losses(spark: SparkSession, d: str) -> DataFrame:
    """Features 0-7 from token losses; the elements of the vectors play the losses."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("pos", "v"))
    out = stats.loss_features(rows.select("doc_id", "pos", (F.col("v").cast("double") * F.col("v").cast("double") * 40).alias("loss")))
    return out.select("doc_id", *[r6(F.col(f"f0{i}")).alias(f"f0{i}") for i in range(8)])


@query("q58_log_odds", f"WITH {_SCORED} SELECT round(s, 6) AS margin, round(1 / (1 + exp(-s)), 6) AS p, count(*) AS n FROM scored GROUP BY ALL")
def q58_odds(spark: SparkSession, d: str) -> DataFrame:
    """Margin and probability of a pair of logits (M7)."""
    rows = _scored(spark, d).select((F.col("s") / 2).alias("machine"), (-F.col("s") / 2).alias("human"))
    return rows.select(r6(score.log_odds(F.col("human"), F.col("machine"))).alias("margin"), r6(score.softmax(F.col("human"), F.col("machine"))).alias("p")).groupBy("margin", "p").agg(F.count("*").alias("n"))


# ---- scorers and chains ------------------------------------------------------------------------------
@query("q59_registered_scorer", "SELECT doc_id, round(0.25::DOUBLE * (length(t) - length(replace(t, 'e', ''))) - length(t) * 0.01::DOUBLE, 6) + 0 AS score FROM (SELECT doc_id, substr(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), 1, 1000) AS t FROM documents)")
def q59(spark: SparkSession, d: str) -> DataFrame:
    """A Python scorer found in the registry, after a preprocessing hook named by module and function (D1, D8, D9, D19, N10, UDF)."""
    name = f"letters-{uuid.uuid4().hex}"
    score.register(name, score.arrow_scorer(lambda: 0.25, lambda weight, texts: [weight * t.count("e") - len(t) * 0.01 for t in texts], max_chars=1000))
    hook = plugins.load("textquarry.functions.normalize:escape_markup")
    out = table(spark, d, "documents").select("doc_id", r6(score.REGISTRY.pop(name)(hook(F.coalesce("text", F.lit(""))))).alias("score"))
    return out


_WEIGHTS = [((i * 7) % 11 - 5) / 10 for i in range(64)]


@query(
    "q59_vector_scores",
    f"""SELECT vec_id, round(list_sum(list_transform(list_zip(e, {_WEIGHTS}::DOUBLE[]), lambda p: p[1] * p[2])) + 0.5, 6) + 0 AS logit, round(list_avg(list_sort(e, 'DESC')[1:7]), 6) + 0 AS top
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
)
def q59_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A single-logit head and the mean of the greatest tenth of an array."""
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", r6(heads.dot(e, _WEIGHTS, 0.5)).alias("logit"), r6(score.top_share_mean(e, 0.1)).alias("top"))


_CHAIN = ("f54", "f57", "f58", "f60")
_CHAIN_WEIGHTS = {"f54": 0.8, "f57": -0.5, "f58": 0.3, "f60": 0.6}
_FOLDED = q.BASE.replace("coalesce(text, '')", f"coalesce({q.folded('text')}, '')")
_CHAIN_SQL = f"""{_FOLDED}, l AS (SELECT *, list_transform(s, lambda x: len({q.white_words("x")})) AS l FROM base),
    f AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains({q.listed(q.tables.FUNCTION_WORDS)}, x))) / len(w) AS f54, length(array_to_string(w, '')) / len(w) AS f57, coalesce(list_avg(l), 0) AS f58, 1 - length(regexp_replace(t, '{q.PUNCT}', '', 'g')) / length(t) AS f60 FROM l),
    c AS (SELECT {", ".join(f"median({n}) AS m_{n}, quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25) AS w_{n}" for n in _CHAIN)} FROM f),
    z AS (SELECT doc_id, 0.1::DOUBLE + {" + ".join(f"{w}::DOUBLE * ({n} - m_{n}) / CASE WHEN w_{n} = 0 THEN 1 ELSE w_{n} END" for n, w in _CHAIN_WEIGHTS.items())} AS margin FROM f, c)"""


def _chain(spark: SparkSession, d: str) -> DataFrame:
    from textquarry.functions.normalize import fold_native

    scratch = Scratch(spark, "chain")
    table_ = scratch.save(chains.chosen_blocks(table(spark, d, "documents"), "text", [features.style_block], fold_native), "features")
    return chains.margins(table_, chains.fitted_scale(table_, _CHAIN), _CHAIN_WEIGHTS, 0.1)


@query("q60_probability_chain", f"WITH {_CHAIN_SQL} SELECT doc_id, round(margin + 1e-9, 6) + 0 AS margin, round(1 / (1 + exp(-margin)) + 1e-9, 6) AS probability, CAST(1 / (1 + exp(-margin)) > 0.5 AS INT) AS machine FROM z")
def q60(spark: SparkSession, d: str) -> DataFrame:
    """Fold, features, robust scale, choice, linear head, probability and decision in one chain."""
    out = chains.probabilities(_chain(spark, d))
    return out.select("doc_id", r6(F.col("margin") + 1e-9).alias("margin"), r6(F.col("probability") + 1e-9).alias("probability"), "machine")


@query(
    "q60_submission_spread",
    f"WITH {_CHAIN_SQL} SELECT round(min(margin), 6) AS low, round(median(margin), 6) + 0 AS mid, round(max(margin), 6) AS high, count(DISTINCT margin) AS n_unique, round(avg((margin > 0)::INT), 6) AS positive FROM z",
)
def q60_spread(spark: SparkSession, d: str) -> DataFrame:
    """The spread of a chain's margins before they are handed in."""
    scored = _chain(spark, d)
    spread, _ = chains.submission(scored, scored.select("doc_id", F.col("margin").alias("score")))
    return spread.select(*[r6(F.col(c)).alias(c) for c in ("low", "mid", "high", "positive")], "n_unique")

