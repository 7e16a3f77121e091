import random
import unicodedata

import pytest

from textquarry import tables
from textquarry.functions import normalize as n

GOLDEN = [
    ("Hеllo wоrld", "Hello world"), ("It’s a tеst", "It's a test"), ("café résumé naïve", "cafe resume naive"), ("½ cup of ﬂour", "1/2 cup of flour"),
    ("zero​width", "zerowidth"), ("Ζero day", "Zero day"), ("türkçe ışık", "turkce isik"), ("naïve café", "naive cafe"), ("Straße München", "Strasse Munchen"),
    ("te​st hеllo", "test hello"), ("한국어", "한국어"), ("", ""), (None, None), ("a   b\n\n  c", "a b\n\n c"),
]


def plain(text):
    """The layers one after the other, over the whole text."""
    for k, v in tables.FOLDS.items():
        text = text.replace(k, v)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")
    text = "".join(c for c in unicodedata.normalize("NFC", text) if unicodedata.category(c) != "Cf")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


@pytest.mark.parametrize(("raw", "want"), GOLDEN)
def test_golden(raw, want):
    assert n.fold_text(raw) == want


def test_equals_the_layers_on_random_text():
    rng = random.Random(3)
    pool = [*range(0x20, 0x250), *range(0x300, 0x500), *range(0x900, 0x980), *range(0x1100, 0x1200), *range(0x2000, 0x2200), *range(0xAC00, 0xAD00), *range(0xFB00, 0xFB10), *range(0xFF00, 0xFFF0), 0x1F642]
    for _ in range(2000):
        text = "".join(chr(rng.choice(pool)) for _ in range(rng.randrange(30)))
        assert n.fold_text(text) == plain(text)
        assert n.fold_letters(text) == "".join(c for c in plain(text).lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def test_every_table_entry_and_attacks(spark):
    from pyspark.sql import functions as F

    for k, v in tables.FOLDS.items():
        assert n.fold_text(f"x{k}y") == f"x{v}y".replace("  ", " ")
    plain_text = "a people opera looks pale over there"
    attacked = plain_text.translate(str.maketrans("aeop", "аеор"))
    spaced = "​".join(plain_text)
    df = spark.createDataFrame([(1, attacked), (2, spaced), (3, plain_text), (4, None), (5, "")], "id int, text string")
    rows = df.select("id", n.fold(F.col("text")).alias("f"), n.fold_compat(F.col("text")).alias("c"), n.fold_first(F.col("text")).alias("o"), n.fold_native(F.col("text")).alias("t")).collect()
    got = {r.id: r for r in rows}
    assert got[1].f == got[2].f == got[3].f == got[1].o == got[2].o == got[1].t == plain_text
    assert got[2].c == plain_text and got[4].f is None and got[5].f == ""
