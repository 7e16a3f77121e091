import json

import pytest
from pyspark.sql import functions as F

from textquarry.functions import plugins, tokens
from textquarry.operators import curate, features, score, stats
from textquarry.sources import runs


def test_plugins_and_small_functions(spark):
    assert plugins.load("textquarry.functions.tokens:word_count") is tokens.word_count
    with pytest.raises(ValueError):
        plugins.load("textquarry")
    df = spark.createDataFrame([("write it from title 'How to Sit' now", "AI-generated", "How to bomb"), (None, "Human", "How to sit"), ("", "other", None)], "p string, l string, t string")
    rows = df.select(tokens.title_in_prompt(F.col("p")).alias("a"), tokens.label_polarity(F.col("l")).alias("b"), tokens.composite_key(F.col("p"), F.col("l")).alias("c"), curate.usable_prompt(F.col("t"), F.lit("w " * 60)).alias("d")).collect()
    assert [r.a for r in rows] == ["How to Sit", None, ""] and [r.b for r in rows] == [1, 0, None] and rows[1].c == "|Human" and [r.d for r in rows] == [False, True, False]


def test_run_spec_and_score_cache(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}", "ai" if i % 2 else "hu", "n") for i in range(20)] + [(99, None, "ai", "x")], "doc_id long, body string, kind string, dom string").write.parquet(str(tmp_path / "set"))
    spec = runs.RunSpec.parse(json.dumps({"val": {"path": str(tmp_path / "set"), "text": "body", "label": "kind", "ai_value": "ai", "groups": ["dom"], "exclude": {"dom": ["x"]}, "calib_sample": 4}}))
    rows = spec.val.load(spark).collect()
    assert len(rows) == 8 and {r.y for r in rows} == {0, 1} and {r.dom for r in rows} == {"n"}
    with pytest.raises(ValueError):
        runs.EvaluationSet.parse({"path": "x", "colour": 1})
    docs = spec.val.load(spark).select("doc_id", "text")
    calls = []

    def scorer(value):
        def run(df):
            calls.append(value)
            return df.select("doc_id", F.lit(value).alias("score"))

        return run

    root = str(tmp_path / "cache")
    assert runs.cached_scores(docs, root, "m", scorer(float("nan"))).count() == 8
    assert runs.cached_scores(docs, root, "m", scorer(1.0)).count() == 8
    assert runs.cached_scores(docs, root, "m", scorer(2.0)).first().score == 1.0 and calls[1:] == [1.0]


def test_model_from_features_to_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, ("Short words go on. " if i % 2 else "Extraordinary considerations notwithstanding. ") * (10 + i % 5), i % 2) for i in range(40)], "doc_id long, text string, label int")
    wide = features.all_features(docs).join(docs.select("doc_id", "label"), "doc_id")
    intercept, weights = score.fit_linear(wide, ["f57", "f48"])
    at = str(tmp_path / "model")
    runs.save_model(spark, at, intercept, weights)
    again = runs.load_model(spark, at, ["f57", "f48"])
    assert again[0] == pytest.approx(intercept) and again[1] == pytest.approx(weights)
    with pytest.raises(ValueError):
        runs.load_model(spark, at, ["f57"])
    margin = sum((F.col(k) * v for k, v in weights.items()), F.lit(intercept))
    assert wide.filter((margin > 0).cast("int") != F.col("label")).count() == 0
    arrays = features.feature_array(features.all_features(docs))
    assert len(arrays.first().features) == 62
    picked = arrays.select(stats.chosen_features(F.col("features"), [57, 99]).alias("x")).first().x
    assert picked[0] > 0 and picked[1] is None
