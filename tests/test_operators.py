import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.operators import curate, evaluate, explain, report, score, split, stats

SCORED = "g string, y int, s double"


def scored_rows(seed=1, n=400):
    rng = random.Random(seed)
    return [(rng.choice("ab"), y, round(rng.gauss(y * 1.2, 1), 1)) for y in (rng.randrange(2) for _ in range(n))]


def area(rows):
    p, n = [s for _, y, s in rows if y == 1], [s for _, y, s in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))


def ba(rows, t):
    return (np.mean([s > t for _, y, s in rows if y == 1]) + np.mean([s <= t for _, y, s in rows if y == 0])) / 2


def test_auroc_properties(spark):
    rows = scored_rows()
    df = spark.createDataFrame(rows, SCORED)
    assert evaluate.auroc(df).first().auroc == pytest.approx(area(rows))
    assert evaluate.auroc(df.withColumn("s", -F.col("s"))).first().auroc == pytest.approx(1 - area(rows))
    assert evaluate.auroc(df.withColumn("s", F.exp("s"))).first().auroc == pytest.approx(area(rows))
    by = {r.g: r.auroc for r in evaluate.auroc(df, ["g"]).collect()}
    assert by["a"] == pytest.approx(area([r for r in rows if r[0] == "a"]))


def test_degenerate_sets(spark):
    one = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), (None, 0, float("nan")), (None, None, 1.0), ("b", 0, float("inf"))], SCORED)
    assert {r.g: r.auroc for r in evaluate.auroc(one, ["g"]).collect()} == {"a": None}
    block = evaluate.metric_block(one, 1.5, ["g"], least=1).first()
    assert block.single_class and block.ba == 0.5 and block.tpr is None
    empty = spark.createDataFrame([], SCORED)
    assert evaluate.auroc(empty).first().auroc is None
    assert evaluate.metric_block(empty, 0.0, ["g"]).collect() == []
    health = {r.g: (r.n_bad, r.skip) for r in evaluate.score_health(one, ["g"]).collect()}
    assert health == {"a": (0, False), None: (1, True), "b": (1, True)}


@pytest.mark.parametrize("strict", [True, False])
def test_best_threshold_beats_the_grid(spark, strict):
    rows = scored_rows(2)
    df = spark.createDataFrame(rows, SCORED)
    grid = [-1 + 0.25 * i for i in range(16)]
    tau = evaluate.best_threshold(df, evaluate.fixed_grid(df, -1.0, 3.0, 0.25), strict=strict).first()
    values = [(np.mean([(s > t) if strict else (s >= t) for _, y, s in rows if y]) + np.mean([(s <= t) if strict else (s < t) for _, y, s in rows if not y])) / 2 for t in grid]
    assert tau.ba == pytest.approx(max(values)) and tau.tau == pytest.approx(grid[int(np.argmax(values))])


def test_tpr_and_quantile_grid_equal_numpy(spark):
    rows = scored_rows(3)
    df = spark.createDataFrame(rows, SCORED)
    cut = np.quantile([s for _, y, s in rows if y == 0], 0.95)
    got = evaluate.tpr_empirical(df, 0.05).first()
    assert got.threshold == pytest.approx(cut) and got.tpr == pytest.approx(np.mean([s > cut for _, y, s in rows if y == 1]))
    grid = np.unique(np.quantile([s for *_, s in rows], np.linspace(0.001, 0.999, 50)))
    best = evaluate.best_threshold(df, evaluate.quantile_grid(df, 50)).first()
    values = [ba(rows, t) for t in grid]
    assert best.ba == pytest.approx(max(values))
    low, high = evaluate.bootstrap_interval(df, float(best.tau)).first()
    assert low < best.ba < high and high - low < 0.2


def test_spearman_ties_and_macro(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(20), rng.randrange(20)) for _ in range(200)] + [(None, 1), (2, None)]
    got = evaluate.spearman(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first().rho

    def ranks(x):
        return [sum(v < u for v in x) + (sum(v == u for v in x) + 1) / 2 for u in x]

    full = [p for p in pairs if None not in p]
    assert got == pytest.approx(np.corrcoef(ranks([a for a, _ in full]), ranks([b for _, b in full]))[0, 1])
    sets = spark.createDataFrame([("x", 0.5), ("y", 0.7)], "set string, ba double")
    assert evaluate.macro_average(sets, ["x", "y"]).first().macro == pytest.approx(0.6)
    assert evaluate.macro_average(sets, ["x", "z"]).first().macro is None


def test_splits_are_exact_and_disjoint(spark):
    rows = [(i, f"g{i % 37}" if i % 11 else None, "c" if i % 3 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, grp string, cell string")
    out = split.grouped_split(df, "grp", 0.1).collect()
    val = {r.grp for r in out if r.split == "val"}
    assert len(out) == 500 and len(val) == int(38 * 0.1) and not val & {r.grp for r in out if r.split == "train"}
    strat = split.stratified_split(df, "id", ["cell"], 0.1).collect()
    for cell in ("c", None):
        n = sum(r.cell == cell for r in strat)
        assert sum(r.cell == cell and r.split == "val" for r in strat) == int(n * 0.1)
    assert split.capped(df, "id", 7).count() == 7 and split.equal_allocation(df, "id", ["grp"], 100).count() <= 100


def test_curation_defined_cases(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None), (4, None), (5, "")], "id int, t string")
    assert [r.id for r in curate.first_seen(df, F.col("t"), [F.col("id")]).orderBy("id").collect()] == [1, 3, 5]
    other = spark.createDataFrame([("aa",), (None,)], "t string")
    assert sorted(r.id for r in curate.without_leaks(df, other, F.col("t"), F.col("t")).collect()) == [3, 4, 5]
    build = spark.createDataFrame([("aa", "old", 1), ("aa", "new", 2), (None, "x", 3)], "g string, a string, seq int")
    got = {r.id: (r.matched, r.lineage_id) for r in curate.recover_lineage(df, build, F.col("t"), F.col("g"), "a", [F.col("seq")], F.col("id")).collect()}
    assert got == {1: (True, "new"), 2: (True, "new"), 3: (False, "_um_3"), 4: (False, "_um_4"), 5: (False, "_um_5")}
    gates = spark.createDataFrame([(None,), ("word " * 20,), ("a " * 120,), ("I cannot do it. " * 40,), ("words " * 120,), ("words one. two. three. " * 60,)], "t string")
    assert [r.g.reason for r in gates.select(curate.generation_gate(F.col("t")).alias("g")).collect()] == ["empty", "short_20w", "short_239c", "refusal", "no_structure", "ok"]


def test_leave_one_out_against_a_loop(spark):
    text = "The first sentence has exactly ten words in it, you see. Short one. The first sentence has exactly ten words in it, you see. Another quite long sentence follows here with more words than ten indeed!"
    model = score.linear({"n": (lambda t: F.length(t), 0.1)})
    out = explain.leave_one_out(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t", model).collect()
    assert {r.id for r in out} == {1} and {r.times for r in out} == {1, 2}
    for r in out:
        assert r.effect == pytest.approx(0.1 * (len(text) - len(text.replace(r.sentence, " "))))


def test_scorers_reports_and_fingerprint(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abcd")], "id int, t string")
    arrow = score.arrow_scorer(lambda: 2.0, lambda m, texts: [m * len(t) if t != "ab" else float("nan") for t in texts], higher_is_machine=False)
    assert {r.id: r.m for r in df.select("id", arrow(F.col("t")).alias("m")).collect()} == {1: None, 2: 0.0, 3: -8.0}
    old = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    new = spark.createDataFrame([(None, 9), ("b", 3)], "k string, v int")
    assert {tuple(r) for r in report.upsert(old, new, ["k"]).collect()} == {("a", 1), (None, 9), ("b", 3)}
    shuffled = df.orderBy(F.desc("id"))
    assert stats.content_fingerprint(df, "id", "t").first() == stats.content_fingerprint(shuffled, "id", "t").first()
    assert stats.ordered_fingerprint(df, "id", "t").first() == stats.ordered_fingerprint(shuffled, "id", "t").first()
    assert stats.content_fingerprint(df.limit(0), "id", "t").first().digest == 0
    values = spark.createDataFrame([(i, 0, float(i % 7)) for i in range(50)] + [(i, 1, 3.0) for i in range(50)], "id int, idx int, value double")
    fitted = {r.idx: (r.center, r.scale) for r in stats.robust_scale(values).collect()}
    assert fitted[1] == (3.0, 1.0) and fitted[0][0] == 3.0
    labelled = values.withColumn("label", (F.col("id") % 7 > 3).cast("int"))
    assert stats.mutual_information(labelled, "label").first().idx == 0


def test_quantiles_equal_numpy(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 5), float(rng.randrange(3)), 1e6])) for _ in range(500)] + [("one", 4.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.013, 0.25, 0.5, 0.977, 1.0]
    got = {(r.g, r.p): r.q for r in stats.quantiles(df, "v", probs, ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], p))
    whole = {r.p: r.q for r in stats.quantiles(df, "v", probs).collect()}
    assert whole[0.25] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.25))
    assert stats.quantiles(df.limit(0), "v", probs, ["g"]).collect() == []
