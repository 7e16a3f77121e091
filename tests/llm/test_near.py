import random

import numpy as np
from pyspark.sql import functions as F

from textquarry.functions.normalize import fold_letters
from textquarry.llm import forest, overlap, windows
from textquarry.storage import Scratch

WORDS = "red boat river lantern quiet table seven green over under market stone bread window paper garden music train cloud winter".split()


def text(rng, n=60):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def edited(rng, t, n):
    words = t.split()
    for _ in range(n):
        i = rng.randrange(len(words))
        words[i] = rng.choice([words[i].upper(), words[i][:-1], "", words[i] + "x", words[i].replace("e", "е")])
    return "  ".join(words)


def corpus(seed=4, bases=25, copies=6):
    rng = random.Random(seed)
    out = []
    for _ in range(bases):
        t = text(rng)
        out += [edited(rng, t, rng.randrange(0, 9)) for _ in range(copies)]
    out += [None, "", "   ", "abcd", "ab c-d!", "nan"] + [out[0]] * 5
    rng.shuffle(out)
    return out


def brute(texts, pairs):
    sets = [{s[i : i + 5] for i in range(len(s) - 4)} for s in map(fold_letters, texts)]
    out = set()
    for i, j in pairs:
        a, b = sets[i], sets[j]
        if a and b and len(a & b) / len(a | b) >= 0.6:
            out.add((min(i, j), max(i, j)))
    return out


def test_forest_pairs_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in enumerate(texts)], "cache_id long, texts string, attacks string, rep int")
    members, pairs, log = forest.near_duplicates(df, "cache_id", "texts")
    got = {tuple(r) for r in forest.row_pairs(members, pairs, "cache_id").collect()}
    want = brute(texts, [(i, j) for i in range(len(texts)) for j in range(i)])
    assert got <= want and len(got) >= 0.999 * len(want) and log[-1]["recall"] > 0.999
    groups = {r.cache_id: r for r in forest.row_groups(members, pairs, "cache_id").collect()}
    for i, r in groups.items():
        assert r.links == sum(i in p for p in got)
    assert all(groups[i].class_id == groups[j].class_id for i, j in got)
    assert len(groups) == sum(len(fold_letters(t)) >= 5 for t in texts)


def test_forest_shortens_until_recall(spark):
    rng = random.Random(8)
    base = [text(rng, 40) for _ in range(12)]
    texts = [edited(rng, t, 11) for t in base for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "cache_id long, texts string")
    members, pairs, log = forest.near_duplicates(df, "cache_id", "texts", recall=1.0)
    assert log[-1]["depth"] < forest.DEPTH and [x["pairs"] for x in log] == sorted(x["pairs"] for x in log)
    got = {tuple(r) for r in forest.row_pairs(members, pairs, "cache_id").collect()}
    assert got == brute(texts, [(i, j) for i in range(len(texts)) for j in range(i)])


def test_overlap_pairs_and_report(spark):
    rng = random.Random(1)
    texts = corpus(9)
    split = [rng.choice(["train", "train", "val", "test", "test_ood", None, "other"]) for _ in texts]
    df = spark.createDataFrame([(i, t, s, rng.choice("ab"), 1.0) for i, (t, s) in enumerate(zip(texts, split, strict=True))], "row_id long, texts string, split string, sources string, w double")
    members, links = overlap.cross_overlaps(df, "row_id", "texts", F.col("split") == "train", F.col("split").isin("val", "test", "test_ood"), ("split", "sources"))
    got = {tuple(r) for r in overlap.overlap_pairs(members, links, "row_id").collect()}
    sides = [(i, j) for i, s in enumerate(split) if s in ("val", "test", "test_ood") for j, u in enumerate(split) if u == "train"]
    want = brute(texts, sides)
    assert got <= want and len(got) >= 0.99 * len(want)
    report = overlap.overlap_report(members, links, ("split", "sources")).collect()
    assert sum(r.links for r in report) == len(got)
    hit = {p for pair in got for p in pair if split[p] != "train"}
    assert sum(r.overlapping for r in report) == len(hit)


def test_no_rows_and_one_side(spark):
    df = spark.createDataFrame([], "row_id long, texts string, split string")
    args = ("row_id", "texts", F.col("split") == "train", F.col("split") == "val")
    members, links = overlap.cross_overlaps(df, *args)
    assert overlap.overlap_pairs(members, links, "row_id").collect() == []
    one = spark.createDataFrame([(1, "same text here", "train"), (2, "same text here", "train")], "row_id long, texts string, split string")
    members, links = overlap.cross_overlaps(one, *args)
    assert overlap.overlap_pairs(members, links, "row_id").collect() == []
    members, pairs, _ = forest.near_duplicates(one, "row_id", "texts")
    assert [tuple(r) for r in forest.row_pairs(members, pairs, "row_id").collect()] == [(1, 2)]
    members, pairs, _ = forest.near_duplicates(df, "row_id", "texts")
    assert forest.row_pairs(members, pairs, "row_id").collect() == []


def test_sketches_agree_in_the_share_of_common_windows():
    rng = random.Random(2)
    for n in (9, 60, 900):
        share = []
        for _ in range(60):
            a = [rng.choice("abcdefgh") for _ in range(n)]
            b = list(a)
            b[rng.randrange(n)] = "z"
            a, b = "".join(a), "".join(b)
            sa, sb = windows.sketches([a, "filler" * 9, b], 384)[[0, 2]]
            share.append((sa == sb).mean() - windows.similarity(windows.window_codes(a), windows.window_codes(b)))
        assert abs(np.mean(share)) < 0.02 and np.abs(share).max() < 0.15
    one, many = windows.sketches(["abcdefgh"], 640), windows.sketches(["zzzzzzz", "abcdefgh", "abcdefgh" * 300], 640)
    assert (one[0] == many[1]).all()


def test_a_long_run_leaves_the_walk_in_blocks(spark):
    rng = random.Random(3)
    sizes = [1, 2, 3, 511, 512, 513, 1500, 1, 5]
    rows = [(b * 7, 10_000 * b + i) for b, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    scratch = Scratch(spark, "runs")
    df = spark.createDataFrame(rows, "bucket long, rep long").repartition(3)
    got = forest.trie_pairs(df, scratch)
    assert got.count() == sum(n * (n - 1) // 2 for n in sizes) and got.filter("x >= y OR floor(x / 10000) <> floor(y / 10000)").isEmpty()
    scratch.finish()


def test_texts_with_many_partners_are_copied(spark, monkeypatch):
    monkeypatch.setattr(windows, "HOT_PARTNERS", 7)
    scratch = Scratch(spark, "hot")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(i, 40) for i in range(1, 30)] + [(50, 51)], "x long, y long")
    reps = spark.createDataFrame([(i, f"text{i}") for i in range(52)], "rep long, letters string")
    hot = windows.hot_ends(pairs, "x", scratch)
    assert [tuple(r) for r in hot.collect()] == [(0, 6)]
    got = sorted(tuple(r) for r in windows.attached(pairs, "x", reps, hot).select("x", "y", "letters").collect())
    assert got == sorted((x, y, f"text{x}") for x, y in map(tuple, pairs.collect()))
    scratch.finish()


def test_a_third_of_all_rows_are_copies_and_near_copies(spark):
    rng = random.Random(12)
    hot = text(rng, 50)
    texts = [hot] * 40 + [edited(rng, hot, rng.randrange(1, 6)) for _ in range(40)] + [text(rng, 50) for _ in range(160)]
    rng.shuffle(texts)
    split = ["train" if i % 3 else "val" for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, split, strict=True))], "row_id long, texts string, split string")
    members, links = overlap.cross_overlaps(df, "row_id", "texts", F.col("split") == "train", F.col("split") == "val")
    got = {tuple(r) for r in overlap.overlap_pairs(members, links, "row_id").collect()}
    want = brute(texts, [(i, j) for i in range(len(texts)) for j in range(len(texts)) if split[i] == "val" and split[j] == "train"])
    assert got <= want and len(got) >= 0.99 * len(want)
    members, pairs, _ = forest.near_duplicates(df, "row_id", "texts")
    got = {tuple(r) for r in forest.row_pairs(members, pairs, "row_id").collect()}
    want = brute(texts, [(i, j) for i in range(len(texts)) for j in range(i)])
    assert got <= want and len(got) >= 0.999 * len(want)
