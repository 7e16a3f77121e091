import random

from pyspark.sql import functions as F

from textquarry.llm import components as c

FIELDS = ("adv_source_ids", "sources")
SCHEMA = "rec_id long, adv_source_ids string, sources string"


def clean(k):
    k = (k or "").strip().lower()
    return None if k in ("", "-", "none", "nan", "unknown") or k.startswith("_um_") else k


def brute(rows):
    """rec -> (members, group key) by repeated merging."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r, a, s in rows:
        for mark, k in (("0", clean(a)), ("1", clean(s))):
            if k is not None:
                up[root(("r", r))] = root((mark, k))
    groups = {}
    for r, a, s in rows:
        groups.setdefault(root(("r", r)), []).append((r, clean(a), clean(s)))
    out = {}
    for members in groups.values():
        if len(members) > 1:
            key = min((a for _, a, _ in members if a), default=None) or min(s for _, _, s in members if s)
            out |= {r: key for r, _, _ in members}
    return out


def found(spark, rows):
    return {r.rec_id: r.group_key for r in c.grouped_records(spark.createDataFrame(rows, SCHEMA), "rec_id", FIELDS).collect()}


def test_dirty_keys_chains_and_namespaces(spark):
    rows = [(1, " A ", "x/1"), (2, "a", None), (3, None, "X/1 "), (4, "-", "nan"), (5, "unknown", "y"), (6, "_um_3", "y"), (7, "_um_3", None), (8, "y", None), (9, "zz", "q"), (10, None, None), (11, "", "  "), (12, "\tb\n", "q")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows)[5] == "y" and 8 not in found(spark, rows)


def test_against_brute_force_with_long_chains_and_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(i, f"k{i}", f"s{i // 2}" if i % 2 else f"s{i // 2 + 1}") for i in range(60)]
    rows += [(100 + i, f"k{i:03d}" if i % 3 else "hub", f"t{rng.randrange(40)}") for i in range(120)]
    rows += [(300 + i, rng.choice([None, "-", f"z{rng.randrange(50)}"]), rng.choice([None, "", f"w{rng.randrange(50)}"])) for i in range(150)]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert found(spark, []) == {}
    df = spark.createDataFrame([(1, "a", "b", "v", "w"), (2, "a", "c", "v", "w")], SCHEMA + ", key string, root string")
    assert {r.group_key for r in c.grouped_records(df, "rec_id", FIELDS).collect()} == {"a"}


def test_update_equals_one_run(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(70)]
    make = lambda x: spark.createDataFrame(x, "a string, b string")
    once = {tuple(r) for r in c.update_components(spark, make(edges)).collect()}
    table = None
    for part in (edges[:30], edges[30:31], edges[31:]):
        table = c.update_components(spark, make(part), table)
    assert {tuple(r) for r in table.collect()} == once


def test_splits_keep_fill_and_quarantine(spark):
    rows = [(i, f"g{i // 4}", None) for i in range(400)] + [(1000, "g0", "bridge"), (1001, "g99", "bridge"), (1002, None, None)] + [(2000 + i, f"h{i}", None) for i in range(97)]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split string, target_share double")
    out = c.assign_records(df, "rec_id", FIELDS, targets, [F.col("rec_id") < 1000, F.lit(True)]).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.group_key or f"r{r.rec_id}", set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())
    early = c.assign_records(df.filter("rec_id < 1000"), "rec_id", FIELDS, targets, [F.lit(True)]).collect()
    before = {r.rec_id: r.split for r in early}
    after = {r.rec_id: r.split for r in out}
    bridged = {r.rec_id for r in out if r.group_key == "g0"}
    assert all(after[k] == v for k, v in before.items() if k not in bridged)
    if before[0] != before[399]:
        assert {after[k] for k in bridged} == {c.QUARANTINE}
    total = sum(s != c.QUARANTINE for s in after.values())
    for s, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
        assert abs(sum(v == s for v in after.values()) - share * total) <= 5


def test_splits_of_no_records_and_of_one_giant(spark):
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split string, target_share double")
    assert c.assign_records(spark.createDataFrame([], SCHEMA), "rec_id", FIELDS, targets, [F.lit(True)]).collect() == []
    giant = spark.createDataFrame([(i, "one", None) for i in range(50)], SCHEMA)
    assert {r.split for r in c.assign_records(giant, "rec_id", FIELDS, targets, [F.lit(True)]).collect()} == {"train"}


def test_store_keeps_versions(spark, tmp_path):
    store = c.ComponentStore(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.table() is None
    make = lambda x: spark.createDataFrame(x, "a string, b string")
    store.update(make([("b", "c"), ("x", "y"), ("z", "z")]))
    store.update(make([("a", "c")]))
    assert store.version() == 2 and {tuple(r) for r in store.table().collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")}
    store.update(make([]))
    assert store.version() == 3 and store.table().count() == 6


def test_a_later_store_keeps_every_split_and_quarantines_conflicts(spark, tmp_path):
    targets = spark.createDataFrame([("train", 0.6), ("val", 0.2), ("test", 0.2)], "split string, target_share double")
    make = lambda rows: c.keyed(spark.createDataFrame(rows, SCHEMA), "rec_id", FIELDS)
    first = make([(i, f"g{i // 3}", None) for i in range(300)] + [(900, None, "-")])
    c.SplitStore(spark, str(tmp_path / "s")).update(first, "rec_id", targets)
    before = {r.rec_id: (r.unit, r.split) for r in c.SplitStore(spark, str(tmp_path / "s")).splits(first, "rec_id").collect()}
    assert len(before) == 301 and {s for _, s in before.values()} == {"train", "val", "test"}
    a = next(k for k, (_, s) in before.items() if s == "train" and k < 300)
    b = next(k for k, (_, s) in before.items() if s == "val" and k < 300)
    late = [(1000, f"g{a // 3}", None), (1001, f"g{a // 3}", "join"), (1002, f"g{b // 3}", "join"), (1003, "new", None), (1004, "a smaller key", None), (1005, "a smaller key", "x"), (1006, "g50", "x")]
    store = c.SplitStore(spark, str(tmp_path / "s"))
    store.update(make(late), "rec_id", targets)
    assert store.number() == 2
    after = {r.rec_id: (r.split, r.kept) for r in store.splits(make([(i, f"g{i // 3}", None) for i in range(300)] + late), "rec_id").collect()}
    hit = {i for i in range(300) if i // 3 in (a // 3, b // 3)} | {1000, 1001, 1002}
    assert {after[i][0] for i in hit} == {c.QUARANTINE}
    assert all(after[i] == (before[i][1], True) for i in range(300) if i not in hit)
    assert after[1006] == (before[150][1], True) == after[1004] and after[1003][1] is False
    store.update(make([]), "rec_id", targets)
    assert {r.rec_id: r.split for r in store.splits(first, "rec_id").collect()} == {i: after[i][0] if i < 300 else before[i][1] for i in before}
