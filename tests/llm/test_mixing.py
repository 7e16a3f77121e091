import random

import numpy as np
import pandas as pd

from textquarry.llm import mixing as m
from textquarry.llm.tokenize import encoder, model_bytes

DOCS = "doc_id long, text string, lang string, source string, domain string, n_tokens string"
TARGETS = "mix_id int, source string, target_weight double, max_repeats int, budget_tokens long"


def corpus(n=600):
    rng = random.Random(2)
    out = [(i, " ".join(rng.choice(["red", "boat", "über", "12"]) for _ in range(rng.randrange(1, 60))), rng.choice(["en", "EN ", "de", None]), rng.choice(["Big", "big ", "BIG", "mid", "tiny"] + ["big"] * 9 + ["mid"] * 3), rng.choice(["a", "b", None]), "x") for i in range(n)]
    return out + [(n, None, "en", "big", "a", "x"), (n + 1, "", "en", "mid", "a", "x"), (n + 2, "lost words", "en", None, "a", "x")]


def run(spark, docs, targets):
    drawn, report = m.mix_sources(m.sized_documents(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(targets, TARGETS))
    return drawn.collect(), {(r.mix_id, r.source): r for r in report.collect()}


def test_shares_caps_and_unreachable_targets(spark):
    docs = corpus()
    enc = encoder(model_bytes())
    have = {}
    for _, text, _, source, _, _ in docs:
        if source:
            have[source.strip().lower()] = have.get(source.strip().lower(), 0) + len(enc.encode(text))
    targets = [(1, "big", 0.5, 1, 4000), (1, "mid", 0.3, 2, 4000), (1, "tiny", 0.2, 1, 4000), (2, "tiny", 0.6, 3, 9000), (2, "ghost", 0.2, 3, 9000), (2, "big", 0.2, 1, 9000)]
    drawn, report = run(spark, docs, targets)
    for mix, source, weight, cap, budget in targets:
        r = report[mix, source]
        assert r.available_tokens == have.get(source, 0)
        assert r.reachable == (cap * have.get(source, 0) >= weight * budget)
        goal = min(weight * budget, cap * have.get(source, 0))
        assert abs(r.drawn_tokens - goal) <= max(0.06 * goal, 60), (mix, source, r.drawn_tokens, goal)
        assert all(0 < x.copies <= cap for x in drawn if (x.mix_id, x.source) == (mix, source))
    assert len({(x.mix_id, x.doc_id) for x in drawn}) == len(drawn)
    assert not {x.doc_id for x in drawn} & {600, 601, 602}


def test_empty_tables(spark):
    drawn, report = run(spark, [], [(1, "big", 1.0, 2, 10), (2, "big", 0.0, 2, 10)])
    assert drawn == [] and not report[1, "big"].reachable and report[2, "big"].reachable
    assert run(spark, corpus(20), []) == ([], {})


def test_raking_meets_sources_and_marginals():
    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(s, lang, t, rng.integers(50, 500)) for s in "abc" for lang in ("en", "de") for t in "xy"], columns=["source", "lang", "topic", "tokens"])
    fit = m.rake(cells, {"a": 0.5, "b": 0.3, "c": 0.2}, 10.0, 1000.0)
    by = cells.assign(fit=fit)
    assert np.allclose(by.groupby("source").fit.sum(), [500, 300, 200])
    for margin in ("lang", "topic"):
        share = by.groupby(margin).tokens.sum() / by.tokens.sum()
        assert np.allclose(by.groupby(margin).fit.sum() / 1000, share, atol=1e-6)
    capped = m.rake(cells, {"a": 0.9, "b": 0.1}, 1.0, 1e6)
    assert (capped <= cells.tokens + 1e-6).all() and np.allclose(capped[:4], cells.tokens[:4])
    assert m.rake(cells, {}, 1.0, 5.0).sum() == 0
