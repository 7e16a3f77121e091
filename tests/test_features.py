import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from textquarry import tables
from textquarry.operators import features as f

TEXTS = {
    1: "The quick boat left. The quick boat came back! Was it late, or was the river low? Nobody knew; the river was low.",
    2: "One two three four five six seven eight nine ten. " * 40 + "A very extraordinary conversation happened yesterday evening, unbelievably.",
    3: "no stops here just plain words going on and on until the very end of it all",
    4: "Short text.", 5: None, 6: "", 7: "   \n  ", 8: "1 2 3 4 5 6 7 8 9 10 11 12 13 14",
    9: "Émile saw the CAFÉ. It was red... Red? The cafe was red! The cafe was red! " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)) + ".",
}


def entropy(items):
    c = Counter(items)
    total = sum(c.values())
    return -sum(v / total * math.log2(v / total) for v in c.values()) if total else 0.0


def cosine(a, b):
    dot = sum(v * b.get(k, 0) for k, v in a.items())
    size = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return dot / size if size else 0.0


def burst(x):
    m, s = (np.mean(x), np.std(x)) if len(x) > 1 else (0, 0)
    return (s - m) / (s + m) if s + m > 0 else 0.0


def tokens(t):
    return [w for w in re.findall(r"\w+", t.lower()) if re.fullmatch("[a-z]+", w)]


def grams(x, n):
    return [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]


def expected(text):
    t = (text or "").strip()
    w = tokens(t)
    out = dict.fromkeys(f.NAMES, 0.0)
    if len(t) < 20 or len(w) < 10:
        return out
    s = [x.strip() for x in re.split("[.!?]+", t) if x.strip()]
    lengths = [len(x.split()) for x in s]
    h1, h2 = entropy(w), entropy(grams(w, 2))
    punct = [c for c in t if c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
    out |= {"f08": entropy([c for c in t.lower() if c.isalnum() or c.isspace()]), "f09": h1, "f10": h2, "f11": entropy(grams(w, 3)), "f12": max(0, h2 - h1), "f13": h1 / math.log2(len(set(w)) + 1)}
    out |= {"f15": entropy(punct), "f16": entropy([min(x // 5, 10) for x in lengths]), "f17": entropy([min(len(x), 15) for x in w])}
    where = {}
    for i, x in enumerate(w):
        where.setdefault(x, []).append(i)
    gaps = [b - a for p in where.values() for a, b in zip(p, p[1:])]
    at = [i for i, c in enumerate(t) if c in ".,!?;:"]
    out |= {"f18": burst(gaps), "f20": burst([b - a for a, b in zip(at, at[1:])])}
    if len(lengths) > 1:
        out["f19"] = np.std(lengths) / np.mean(lengths)
    if len(gaps) > 2 and np.std(gaps[:-1]) > 0 and np.std(gaps[1:]) > 0:
        out["f21"] = np.corrcoef(gaps[:-1], gaps[1:])[0, 1]
    if gaps:
        out |= {"f22": np.var(gaps) / np.mean(gaps), "f23": np.std(gaps) / (np.mean(gaps) + 1)}
    per = [tokens(x) for x in s]
    for n, name in ((2, "f24"), (3, "f25"), (4, "f26")):
        sets = [Counter(grams(x, n)) for x in per if len(x) >= n]
        whole = sum(sets, Counter())
        if len(sets) > 1:
            out[name] = np.mean([sum(min(v, whole[g] - v) for g, v in c.items()) / sum(c.values()) for c in sets])
    two, three = Counter(grams(w, 2)), Counter(grams(w, 3))
    out |= {"f27": len(two) / sum(two.values()), "f28": len(three) / sum(three.values()), "f29": np.mean([v > 1 for v in two.values()]), "f30": np.mean([v > 1 for v in three.values()]), "f31": max(two.values()) / sum(two.values())}
    out["f32"] = len(zlib.compress(t.encode(), 9)) / len(t.encode())
    if s:
        out["f33"] = (len(s) - len({" ".join(x) for x in per})) / len(s)
    c = Counter(w)
    freq = sorted(c.values(), reverse=True)
    if len(freq) > 1:
        out["f34"] = abs(np.polyfit(np.log(range(1, len(freq) + 1)), np.log(np.array(freq) + 1), 1)[0] + 1)
    m2 = sum(v * v for v in freq)
    out |= {"f35": 1e4 * (m2 - len(w)) / len(w) ** 2, "f36": freq.count(1) / len(w), "f37": freq.count(2) / len(w), "f38": 0.5, "f39": len(c) / len(w), "f40": len(c) / len(w)}
    steps = range(100, len(w) + 1, 100)
    if len(steps) > 2:
        out["f38"] = np.polyfit(np.log(steps), np.log([len(set(w[:i])) for i in steps]), 1)[0]
    if len(w) >= 50:
        out["f40"] = np.mean([len(set(w[i : i + 50])) / 50 for i in range(0, len(w) - 49, 25)])
    out["f41"] = np.mean([x not in tables.FUNCTION_WORDS for x in w])
    if len(s) >= 2:
        bags = [Counter(x) for x in per]
        near = [cosine(a, b) for a, b in zip(bags, bags[1:])]
        mid = len(near) // 2
        var = np.var(near)
        out |= {"f42": np.mean(near), "f43": var, "f47": 1 / (1 + var), "f45": np.mean([cosine(bags[i], bags[j]) for i, j in combinations(range(len(bags)), 2) if j - i < 5]), "f46": np.mean([entropy(x) for x in per])}
        if len(near) > 2:
            out["f44"] = abs(np.mean(near[:mid]) - np.mean(near[mid:]))
    syl = [1 if len(x) <= 3 else max(1, len(re.findall("[aeiouy]+", x)) - x.endswith("e")) for x in w]
    if s:
        n, k, y, ch, x3 = len(w), len(s), sum(syl), sum(map(len, w)), sum(v > 2 for v in syl)
        out |= {"f48": 206.835 - 1.015 * n / k - 84.6 * y / n, "f49": 0.39 * n / k + 11.8 * y / n - 15.59, "f50": 4.71 * ch / n + 0.5 * n / k - 21.43, "f51": 5.88 * ch / n - 29.6 * k / n - 15.8}
        out |= {"f52": 1.043 * math.sqrt(30 * x3 / k) + 3.1291, "f53": 15.79 * x3 / n + 0.0496 * n / k + (3.6365 if x3 / n > 0.05 else 0)}
    share = lambda listed: np.mean([x in listed for x in w])
    letters = [ch for ch in t if ch.isalpha()]
    out |= {"f54": share(tables.FUNCTION_WORDS), "f55": share(tables.PRONOUNS), "f56": share(tables.CONJUNCTIONS), "f57": np.mean([len(x) for x in w]), "f58": np.mean(lengths), "f59": np.var(lengths), "f60": len(punct) / len(t), "f61": sum(ch.isupper() for ch in letters) / len(letters)}
    return out


@pytest.fixture(scope="module")
def computed(spark):
    docs = spark.createDataFrame([(k, v, "x", 1) for k, v in TEXTS.items()], "doc_id long, text string, w string, c int")
    return {r.doc_id: r for r in f.all_features(docs).collect()}


def test_features_equal_plain_formulas(computed):
    assert set(computed) == set(TEXTS)
    for k, text in TEXTS.items():
        want = expected(text)
        for name in f.NAMES:
            assert computed[k][name] == pytest.approx(want[name], abs=1e-9), (k, name)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert f.all_features(docs).collect() == []


def test_blocks_add_no_exchange_after_placing(spark):
    docs = spark.createDataFrame([(1, TEXTS[1])], "doc_id long, text string")
    plan = f.entropy_block(f.base(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
