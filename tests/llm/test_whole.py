"""Cases that a cut of the candidates or of the model once lost."""

import random

from pyspark.sql import functions as F
from test_near import brute, text
from test_sentences import corpus, cut

from textquarry.llm import forest, overlap, sentences

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def substituted(rng, t, n):
    out = list(t)
    for i in rng.sample(range(len(t)), n):
        out[i] = rng.choice(LETTERS)
    return "".join(out)


def letters(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def overlaps(spark, texts, split):
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, split, strict=True))], "row_id long, texts string, split string")
    members, links = overlap.cross_overlaps(df, "row_id", "texts", F.col("split") == "train", F.col("split") == "val")
    got = {tuple(r) for r in overlap.overlap_pairs(members, links, "row_id").collect()}
    return got, brute(texts, [(i, j) for i, s in enumerate(split) if s == "val" for j, u in enumerate(split) if u == "train"])


def test_overlaps_of_a_third_of_all_rows_that_are_different_variants(spark):
    rng = random.Random(21)
    base = letters(rng, 400)
    texts = [substituted(rng, base, rng.randrange(4, 11)) for _ in range(110)] + [text(rng, 50) for _ in range(220)]
    rng.shuffle(texts)
    got, want = overlaps(spark, texts, ["val" if i % 3 == 0 else "train" for i in range(len(texts))])
    assert len(want) > 1000 and got == want


def test_overlaps_of_short_texts_and_of_spread_edits(spark):
    rng = random.Random(23)
    texts = []
    for n, edits in ((20, 0), (20, 0), (40, 1), (40, 1), (80, 2), (80, 3), (150, 6), (150, 6), (300, 12)) * 4:
        base = letters(rng, n)
        other = list(base)
        for k in range(edits):
            other[(2 * k + 1) * n // (2 * edits)] = "0"
        texts += [base, "".join(other) + ("" if edits else "q")]
    got, want = overlaps(spark, texts, ["val" if i % 2 else "train" for i in range(len(texts))])
    assert len(want) >= 36 and got == want


def test_forest_reaches_the_recall_at_the_threshold_whatever_else_is_found(spark):
    rng = random.Random(22)
    base = letters(rng, 300)
    hot = [substituted(rng, base, 1) for _ in range(40)]
    cold = [letters(rng, 300) for _ in range(40)]
    for texts in (hot + cold, cold):
        df = spark.createDataFrame(list(enumerate(texts)), "cache_id long, texts string")
        _, _, log = forest.near_duplicates(df, "cache_id", "texts")
        assert 1 - (1 - forest.SIMILARITY ** log[-1]["depth"]) ** forest.TREES >= forest.RECALL


def test_reporting_words_are_a_share_of_their_occurrences(spark):
    more = [(2000 + i, '"Go on," he said. A bird saw he was near and he sang while he ran as he could when he woke if he slept. "We know," said Nordik.', "en") for i in range(30)]
    more += [(3000 + i, '"Go on," man. Now a man saw a man and a man met a man by a man near a man with a man or a man for a man.', "en") for i in range(30)]
    docs = spark.createDataFrame(corpus() + more, "doc_id long, text string, lang string")
    words = {r.word for r in sentences.learn(docs).filter("kind = 'report' AND lang = 'en'").collect()}
    assert "said" in words and not {"he", "man"} & words


def test_joined_model_looks_up_the_tail_of_a_word(spark):
    texts = [("Er sah den Haupt-Dr.Nordik und ging.", "de")]
    assert cut(spark, texts, max_rows=0) == cut(spark, texts) == [[texts[0][0]]]
