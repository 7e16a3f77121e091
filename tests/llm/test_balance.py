import random
from datetime import datetime, timedelta

import numpy as np

from textquarry.llm import balance as b

RAID = "id string, generation string, model string, domain string, attack string, loaded_at timestamp, spec_id int"
TARGETS = "target_id long, spec_id int, domain string, model string, attack string, target_share double, min_rows long, sample_size long, prob double"
T0 = datetime(2025, 1, 1)


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append((f"id{i}", rng.choice(["x", "y", None, "  ", "z"]), rng.choice([" M1", "m1", "m2", None]), rng.choice(["News", "news ", "wiki", "code", None]), rng.choice(["none", "NONE", "typo", None]), T0 + timedelta(days=i), 9))
    return out + [(i, "late", m, d, a, t + timedelta(days=9999), 9) for i, _, m, d, a, t, _ in out[: n // 10]] + [(i, g, m, d, a, t - timedelta(days=1), 9) for i, g, m, d, a, t, _ in out[n // 2 : n // 2 + 9]]


def usable(data):
    last = {}
    for r in data:
        if r[0] not in last or r[5] > last[r[0]][5]:
            last[r[0]] = r
    clean = lambda c: c if c is None else c.strip().lower()
    return [{"domain": clean(r[3]), "model": clean(r[2]), "attack": clean(r[4]), "id": r[0]} for r in last.values() if (r[1] or "").strip()]


SPECS = [
    (1, 1, "news", None, None, 0.5, 3, 100), (2, 1, "wiki", None, None, 0.3, 3, 100), (3, 1, "code", None, None, 0.2, 500, 100),
    (4, 2, None, "m1", "none", 0.7, 0, 60), (5, 2, None, "m2", "typo", 0.3, 0, 60), (6, 3, "absent", None, None, 1.0, 1, 50), (7, 4, "news", None, None, 1.0, 0, 10**6),
]


def run(spark, data, specs=SPECS):
    records = b.usable_records(spark.createDataFrame(data, RAID))
    sample, report = b.sample_targets(records, spark.createDataFrame([(*s, 0.5) for s in specs], TARGETS))
    return sample.collect(), {r.target_id: r for r in report.collect()}


def test_sample_meets_targets_exactly_and_reports_the_rest(spark):
    data = rows(900)
    sample, report = run(spark, data)
    good = usable(data)
    for tid, spec, dom, mod, att, share, least, size in SPECS:
        fit = {r["id"] for r in good if (dom is None or r["domain"] == dom) and (mod is None or r["model"] == mod) and (att is None or r["attack"] == att)}
        need = max(least, int(share * size + 0.5))
        mine = [r.id for r in sample if r.target_id == tid]
        assert len(mine) == len(set(mine)) == min(need, len(fit)) and set(mine) <= fit
        got = report[tid]
        assert (got.available, got.needed, got.drawn, got.met) == (len(fit), need, len(mine), len(fit) >= need)
        assert got.spec_id == spec and got.residual == 0


def test_other_categories_stay_balanced(spark):
    data = rows(4000, 5)
    sample, _ = run(spark, data, [(1, 1, "news", None, None, 1.0, 0, 300)])
    cat = {r["id"]: r for r in usable(data)}
    pool = [r for r in cat.values() if r["domain"] == "news"]
    for field in ("model", "attack"):
        for v in {r[field] for r in pool}:
            expected = 300 * sum(r[field] == v for r in pool) / len(pool)
            assert abs(sum(cat[r.id][field] == v for r in sample) - expected) < 4


def test_empty_tables_and_null_ids(spark):
    sample, report = run(spark, [])
    assert sample == [] and all(not r.met or r.needed == 0 for r in report.values())
    data = [(None, "t", "m1", "news", "none", T0, 1)] * 5 + [("a", "t", "m1", "news", "none", None, 1), ("a", "", "m1", "news", "none", None, 1)]
    _, report = run(spark, data, [(1, 1, "news", None, None, 1.0, 0, 4)])
    assert report[1].available in (5, 6) and report[1].drawn == 4


def test_overlapping_targets_serve_once(spark):
    data = [(f"i{k}", "t", "m1", "news", "none", T0, 1) for k in range(30)]
    sample, report = run(spark, data, [(1, 1, "news", None, None, 0.5, 0, 20), (2, 1, None, "m1", None, 0.5, 0, 20)])
    assert len({r.id for r in sample}) == len(sample) == 10
    assert report[1].met and not report[2].met and report[2].shortfall == 10


def test_cube_keeps_totals_and_probabilities():
    rng = np.random.default_rng(0)
    x = np.zeros((60, 7))
    x[np.arange(60), rng.integers(0, 4, 60)] = 1
    x[np.arange(60), 4 + rng.integers(0, 3, 60)] = 1
    p = np.full(60, 0.3)
    mean = np.zeros(60)
    for s in range(400):
        out = b.cube(p, x, landing=True, seed=s)
        assert set(np.unique(out)) <= {0.0, 1.0}
        assert np.abs(x[:, :4].T @ out - x[:, :4].T @ p).max() < 1.5
        mean += out / 400
    assert abs(mean.mean() - 0.3) < 0.02 and mean.std() < 0.05
    flown = b.cube(p, x, landing=False)
    assert np.allclose(x.T @ flown, x.T @ p) and ((flown > 0) & (flown < 1)).sum() <= 7


def test_pivot_keeps_cell_totals():
    p = np.array([0.2, 0.5, 0.9, 0.4, 0.7, 0.7, 0.1])
    cell = np.array(list("aaaabbb"))
    out = b.pivot(p, cell)
    assert abs(out[:4].sum() - 2.0) < 1e-9 and abs(out[4:].sum() - 1.5) < 1e-9
    assert ((out[:4] > 1e-9) & (out[:4] < 1 - 1e-9)).sum() == 0 and ((out[4:] > 1e-9) & (out[4:] < 1 - 1e-9)).sum() == 1


def test_flights_merge_upward_in_levels(spark, monkeypatch):
    monkeypatch.setattr(b, "FAN", 3)
    rows = [(f"i{i}", "abc"[i % 3], "xy"[i % 2], None) for i in range(900)]
    records = spark.createDataFrame(rows, "id string, domain string, model string, attack string")
    targets = spark.createDataFrame([(1, 1, "a", None, None, 0.5, 0, 101), (2, 1, "b", None, None, 0.3, 0, 101), (3, 1, "c", "x", None, 0.2, 0, 101)], "target_id long, spec_id int, domain string, model string, attack string, target_share double, min_rows long, sample_size long")
    sample, report = b.sample_targets(records, targets)
    got = {r.target_id: (r.needed, r.drawn, r.met) for r in report.collect()}
    assert got == {1: (51, 51, True), 2: (30, 30, True), 3: (20, 20, True)} and sample.count() == sample.distinct().count() == 101
