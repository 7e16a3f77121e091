"""Operators of the inventory against brute force, with nulls, ties, outliers and empty tables."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.functions import tokens
from textquarry.operators import chains, curate, evaluate, heads, report, score, split, stats
from textquarry.sources import readers, writers
from textquarry.storage import Versions


def test_an_outlier_does_not_fill_one_range(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(4000)] + [1e9, -1e300]
    df = spark.createDataFrame([(v, 1) for v in values], "s double, y int")
    cuts = df.agg(stats.edges("s").alias("c")).first().c
    counts = np.bincount(np.searchsorted(cuts, values, side="left"), minlength=stats.RANGES)
    assert counts.max() < 4000 / stats.RANGES * 6
    got = {r.p: r.q for r in stats.quantiles(df, "s", [0.0, 0.25, 0.5, 0.999, 1.0]).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(values, p), rel=1e-12)
    weighted = spark.createDataFrame([(1.0, 3), (2.0, 0), (5.0, 1), (None, 9)], "s double, w int")
    assert stats.quantiles(weighted, "s", [0.5, 1.0], weight="w").orderBy("p").collect()[0].q == 1.0
    assert stats.quantiles(df.limit(0), "s", [0.5]).collect() == []


def test_place_is_a_bisection(spark):
    cuts = sorted(random.Random(1).choices(range(50), k=300))
    df = spark.createDataFrame([(cuts, v) for v in (-1, 0, 7, 25, 49, 50)], "c array<int>, v int")
    got = df.select("v", stats.place(F.col("c"), F.col("v")).alias("a"), stats.place(F.col("c"), F.col("v"), True).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(sum(c < r.v for c in cuts), sum(c <= r.v for c in cuts)) for r in got]


def test_metric_block_of_single_class_ties_and_empty_groups(spark):
    rows = [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 2.0), ("b", 1, 1.0), ("c", None, 1.0), ("c", 0, float("nan"))]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r.g: r for r in evaluate.metric_block(df, 0.5, ["g"], native=0.4, interval=True).collect()}
    assert set(got) == {"a", "b"} and got["a"].ba == 0.75 and got["a"].oracle_ba == 0.75 and got["a"].oracle_gap == 0.0 and got["a"].ba_native == 0.5
    assert got["b"].single_class and got["b"].ba == 1.0 and got["b"].oracle_ba is None and got["b"].tpr_1 is None
    edge = evaluate.bootstrap_interval(df.filter("g = 'a'"), 0.5, ["g"]).first()
    assert edge.high <= 0.5  # a score at the threshold counts as machine in the interval
    assert evaluate.metric_block(df.limit(0), 0.5, ["g"]).collect() == []


def test_paired_scores_cells_and_epochs(spark):
    a = spark.createDataFrame([(1, 1.0), (2, -1.0), (3, None)], "id int, score double")
    b = spark.createDataFrame([(1, 2.0), (2, 1.0), (9, 1.0)], "id int, score double")
    assert sorted(tuple(r) for r in evaluate.paired_scores(a, b, "id").collect()) == [(1, 1.0, 2.0), (2, -1.0, 1.0)]
    r = evaluate.score_agreement(a, b, "id").first()
    assert (r.n, r.n_turned, r.most_gap, r.rho) == (2, 1, 2.0, 1.0)
    assert evaluate.best_epoch([0.5, 0.7, 0.7, 0.6, 0.1, 0.9]) == (1, 4) and evaluate.best_epoch([]) == (0, 0) and evaluate.best_epoch([0.1, 0.2]) == (1, 1)


def test_quotas_of_pools_and_their_cut(spark):
    rows = [(i, "fill", 0, "train") for i in range(50)] + [(100 + i, "raid", 1, "train") for i in range(50)] + [(200 + i, "x", i % 2, "train") for i in range(20)]
    rows += [(300 + i, "raid", 1, "val") for i in range(30)] + [(400 + i, "x", i % 4 == 0, "val") for i in range(16)] + [(500 + i, "fill", 0, "val") for i in range(3)] + [(600, None, 1, "train")]
    df = spark.createDataFrame([(i, s, int(y), p) for i, s, y, p in rows], "id int, source string, label int, split string")
    counts = df.groupBy("source", "split", "label").agg(F.count("*").alias("n"))
    quotas = split.split_quotas(counts, {0: 30, 1: 300}, "fill", "raid")
    got = {(r.split, r.source): r.quota for r in quotas.collect()}
    assert got == {("train", "fill"): 20, ("train", "raid"): 50, ("val", "fill"): 3, ("val", "raid"): 11}
    kept = split.cut_to_quota(df, quotas, "id").groupBy("split", "source").count().collect()
    assert {(r.split, r.source): r["count"] for r in kept} == {("train", "fill"): 20, ("train", "raid"): 50, ("train", "x"): 20, ("val", "raid"): 11, ("val", "x"): 16, ("val", "fill"): 3, ("train", None): 1}


def test_hot_cells_and_quotas_equal_a_plain_ranking(spark):
    rng = random.Random(9)
    rows = [(i, "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, g string")
    got = {r.id for r in split.per_cell(df, "id", ["g"], 40).collect()}
    import hashlib

    def h(i):
        return hashlib.md5(f"42|{i}".encode()).hexdigest(), i

    want = {i for g in {g for _, g in rows} for i in sorted((i for i, x in rows if x == g), key=h)[:40]}
    assert got == want
    quota = {r.id for r in curate.quota(df, "g", [F.col("id")], 100, {"hot": 0.3, "a": 0.07, "none": 0.5}).collect()}
    assert quota == set(sorted(i for i, x in rows if x == "hot")[:30]) | set(sorted(i for i, x in rows if x == "a")[:7])
    assert split.per_cell(df.limit(0), "id", ["g"], 40).collect() == []


def test_truncation_at_the_last_full_stop(spark):
    text = "Sure, here it is. " + " ".join(f"w{i}" + ("." if i == 560 else "") for i in range(700))
    out = spark.createDataFrame([(text,), ("Here is one. Short text",), (None,)], "t string").select(tokens.without_preamble(F.col("t")).alias("x")).collect()
    assert out[0].x.endswith("w560.") and len(out[0].x.split()) == 561 and out[1].x == "Short text" and out[2].x is None


def test_label_names(spark):
    names = ["ChatGPT", "humanwritten", "LABEL_1", "AI", "Real", "human or ai", None, "domain"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(tokens.label_polarity(F.col("n")).alias("p"))
    assert [r.p for r in df.collect()] == [1, 0, None, 1, 0, None, None, None]
    rows = spark.createDataFrame([(["human", "AI"],), (["Fake", "Real"],), (["LABEL_0", "LABEL_1"],), (["ai", "gpt"],), ([],)], "l array<string>")
    assert [r.i for r in rows.select(tokens.machine_index(F.col("l")).alias("i")).collect()] == [1, 0, 1, 1, 1]


def test_loss_features_and_moments(spark):
    rng = np.random.default_rng(5)
    losses = {1: rng.gamma(2, 2, 41), 2: np.array([3.0]), 3: np.full(6, 2.0), 4: np.array([60.0, 1.0])}
    rows = [(k, i, float(v)) for k, x in losses.items() for i, v in enumerate(x)] + [(None, 0, 1.0), (5, 0, None)]
    got = {r.doc_id: r for r in stats.loss_features(spark.createDataFrame(rows, "doc_id int, pos int, loss double")).collect()}
    assert set(got) == set(losses)
    for k, x in losses.items():
        sd, mid = x.std(), len(x) // 2
        a, b = np.percentile(x, [25, 75])
        want = [min(math.exp(x.mean()), 10000), x.mean(), min(x.max(), 50), sd, ((x - x.mean()) ** 3).mean() / sd**3 if len(x) > 2 and sd > 0 else 0.0, (x < a).mean(), (x > b).mean(), x[mid:].mean() - x[:mid].mean() if mid else 0.0]
        assert [got[k][f"f0{i}"] for i in range(8)] == pytest.approx(want, abs=1e-9)


def test_heads_equal_numpy(spark):
    rng = np.random.default_rng(2)
    d, f, h = 6, 3, 5
    dense = lambda a, b: heads.Dense(rng.normal(size=(a, b)), rng.normal(size=b))
    p, gh, go, hd, out, plain_h, plain_o = dense(f, d), dense(2 * d, d), dense(d, 1), dense(2 * d, h), dense(h, 2), dense(d, h), dense(h, 2)
    x, y = rng.normal(size=(4, d)), rng.normal(size=(4, f))
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(7, None, [1.0] * f), (8, [1.0], [1.0] * f), (9, [float("nan")] * d, [1.0] * f)]
    df = spark.createDataFrame(rows, "i int, v array<double>, f array<double>")
    got = {r.i: r for r in df.select("i", heads.plain_head(plain_h, plain_o)(F.col("v")).alias("a"), heads.gated_head(p, gh, go, hd, out)(F.col("v"), F.col("f")).alias("b"), heads.dot(F.col("v"), [0.5] * d, 1.0).alias("c")).collect()}
    gelu = lambda z: np.array([[v * 0.5 * (1 + math.erf(v / 2**0.5)) for v in row] for row in z])
    a = gelu(x @ plain_h.weight + plain_h.bias) @ plain_o.weight + plain_o.bias
    shown = gelu(y @ p.weight + p.bias)
    gate = 1 / (1 + np.exp(-(np.tanh(np.hstack([x, shown]) @ gh.weight + gh.bias) @ go.weight + go.bias)))
    b = gelu(np.hstack([x, gate * shown]) @ hd.weight + hd.bias) @ out.weight + out.bias
    for i in range(4):
        assert got[i].a == pytest.approx(a[i, 1] - a[i, 0]) and got[i].b == pytest.approx(b[i, 1] - b[i, 0]) and got[i].c == pytest.approx(x[i].sum() / 2 + 1)
    assert all(got[i].a is None and got[i].b is None for i in (7, 8, 9)) and got[8].c is None
    pooled = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0]), ([], [])], "t array<array<double>>, m array<int>").select(heads.mean_pooled(F.col("t"), F.col("m")).alias("x")).collect()
    assert pooled[0].x == [2.0, 4.0] and pooled[1].x is None


def test_chain_scales_and_decides(spark):
    table = spark.createDataFrame([(i, float(i), 5.0) for i in range(5)], "doc_id long, f54 double, f57 double")
    scale = chains.fitted_scale(table, ["f54", "f57"])
    got = {r.doc_id: r for r in chains.probabilities(chains.margins(table, scale, {"f54": 2.0, "f57": 1.0})).collect()}
    assert [got[i].margin for i in range(5)] == [-2.0, -1.0, 0.0, 1.0, 2.0] and [got[i].machine for i in range(5)] == [0, 0, 0, 1, 1]
    with pytest.raises(ValueError):
        chains.margins(table, scale, {"f60": 1.0})
    spread, agreement = chains.submission(chains.margins(table, scale, {"f54": 2.0}), table.select("doc_id", F.col("f54").alias("score")))
    assert (spread.first().mid, agreement.first().rho) == pytest.approx((0.0, 1.0))
    shown = spark.createDataFrame([("a  b​\n c",)], "t string").select(chains.shown_margin(F.col("t"), F.length).alias("m")).first().m
    assert shown == 6


def test_names_links_and_small_helpers(spark):
    rows = spark.createDataFrame([("Blue ring",), ("red",), (None,)], "n string")
    assert [tuple(r) for r in curate.name_matches(rows, "n", ["BLUE", "ring", "x"]).collect()] == [("Blue ring", "BLUE"), ("Blue ring", "ring")]
    assert score.matching(["Alpha", "beta"], ["ALP"]) == ["Alpha"]
    keyed = spark.createDataFrame([("a",), ("z",), (None,)], "k string").select(curate.looked_up(F.col("k"), {"a": 1}, 9).alias("v"), curate.looked_up(F.col("k"), {}, 2).alias("w"))
    assert [tuple(r) for r in keyed.collect()] == [(1, 2), (9, 2), (9, 2)]
    assert readers.resolve(rows, ["N"]).columns == ["N"] and rows.select(readers.label_is(F.col("n"), "red").alias("y")).collect()[1].y == 1
    stamps = spark.createDataFrame([("2025-01-06T00:05:50.39",), ("2025-01-07 12:05:52",), ("2025-01-07T12:05:52Z",), ("soon",), (None,)], "t string")
    assert [r.s for r in stamps.select(stats.stamp(stats.parsed_stamp(F.col("t"))).alias("s")).collect()] == ["20250106_000550", "20250107_120552", "20250107_120552", None, None]
    assert report.latest(spark.createDataFrame([("a/1",), ("b/0",)], "path string")).first().path == "b/0"
    total = stats.tally(spark.createDataFrame([("a", 0), ("a", 1), (None, None)], "g string, y int"), ["g"], "y").collect()
    assert {r.g: (r.n, r.human, r.machine, r.human_share) for r in total} == {"a": (2, 1, 1, 1.0), "-": (1, 0, 0, 0.0), "TOTAL": (3, 1, 1, 1.0)}
    assert stats.tally(spark.createDataFrame([], "g string, y int"), ["g"], "y").collect()[0].n == 0


def test_versions_and_predictions(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    assert store.read() is None
    for k in range(4):
        store.write(spark.range(k + 1))
    assert store.numbers() == [3, 4] and store.read().count() == 4 and store.read(3).count() == 3 and store.read(1) is None
    store.write(store.read().union(spark.range(1)))
    assert store.read().count() == 5
    at = str(tmp_path / "p")
    writers.predictions(spark.createDataFrame([(1, 0.5), (2, None)], "id int, score double"), at)
    text = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("part-*")))
    assert json.loads(text) == [{"id": "1", "score": 0.5}, {"id": "2"}]
    writers.predictions(spark.createDataFrame([], "id int, score double"), at)
    assert json.loads("".join(p.read_text() for p in (tmp_path / "p").glob("part-*"))) == []
    (tmp_path / "plain.jsonl").write_text('{"title": "x"}\n')
    assert readers.with_file_part(spark, str(tmp_path / "*.jsonl"), readers.PAIRS).first().generator == "plain"


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    marks = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(marks, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return 2.0

    scorer = score.arrow_scorer(load, lambda w, texts: [w * len(t) for t in texts])
    df = spark.createDataFrame([("a" * i,) for i in range(40)], "t string").repartition(12)
    assert sum(r.s for r in df.select(scorer(F.col("t")).alias("s")).collect()) == 2.0 * sum(range(40))
    import os

    names = os.listdir(marks)
    assert len(names) == len({n.split("-")[0] for n in names})
