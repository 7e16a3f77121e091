"""Words, sentences and n-grams as Column expressions.

Patterns are written so that the JVM and DuckDB agree: no ``\\b``, explicit white
space, and Unicode classes spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry import tables

SPACE = r"[ \t\n\r\f\x0B]+"


def words(text: Column) -> Column:
    """Lower-case words of a-z that stand between non-word characters (F1); [] for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?<![\p{L}\p{N}_])[a-z]++(?![\p{L}\p{N}_])"), F.lit(0))


def naive_sentences(text: Column) -> Column:
    """Parts between runs of . ! ? that hold something but white space, trimmed (F2); [] for null."""
    edge = r"[^.!? \t\n\r\f\x0B]"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{edge}(?:[^.!?]*{edge})?"), F.lit(0))


def white_words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda x: x != "")


def word_count(text: Column) -> Column:
    """Number of words between white space (F4); 0 for null."""
    return F.size(white_words(text))


def syllables(word: Column) -> Column:
    """Vowel groups, one less for a final e, at least one; words of three letters or less have one."""
    groups = F.size(F.regexp_extract_all(word, F.lit("[aeiouy]+"), F.lit(0)))
    return F.when(F.length(word) <= 3, 1).otherwise(F.greatest(F.lit(1), groups - F.when(word.endswith("e"), 1).otherwise(0)))


def ngrams(items: Column, n: int) -> Column:
    """Joined n-grams of an array (F6); [] where it is shorter than n."""
    last = F.size(items) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(items, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def protected_sentences(text: Column) -> Column:
    """Splitter that keeps abbreviations, initials, decimals and ellipses whole (F3); [] for null."""
    dot, cut = "\u0001", "\u0002"
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    t = F.regexp_replace(t, r"(^|[^\p{L}\p{N}_])(" + "|".join(tables.SPLIT_ABBREVIATIONS) + r")\.", f"$1$2{dot}")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])([A-Z])\.", f"$1{dot}")
    t = F.regexp_replace(t, r"([0-9])\.([0-9])", f"$1{dot}$2")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])([a-zA-Z])\.([a-zA-Z])\.", f"$1{dot}$2{dot}")
    t = F.replace(t, F.lit("..."), F.lit(dot * 3))
    t = F.regexp_replace(t, r"""([.!?]+["')\]]?) +""", f"$1{cut}")
    parts = F.transform(F.split(t, cut), lambda s: F.replace(F.trim(s), F.lit(dot), F.lit(".")))
    return F.filter(parts, lambda s: s != "")


def without_preamble(text: Column, max_words: int = 600) -> Column:
    """A generated text without its chatty opening, cut to ``max_words`` at the last full stop beyond 70 %."""
    t = F.regexp_replace(text, r"(?i)^(sure[!,]?\s+here[^.]*\.\s*|here is[^.]*\.\s*)", "")
    w = white_words(t)
    head = F.array_join(F.slice(w, 1, max_words), " ")
    stop = F.length(head) - F.length(F.substring_index(head, ".", -1))
    kept = F.when(stop - 1 > F.length(head) * F.lit(0.7), F.substring(head, F.lit(1), stop)).otherwise(head)
    return F.trim(F.when(F.size(w) > max_words, kept).otherwise(t))


def without_sentence(text: Column, sentence: Column) -> Column:
    """All occurrences of a sentence replaced by a blank."""
    return F.replace(text, sentence, F.lit(" "))


def slug(text: Column) -> Column:
    """A name fit for a file: every other character becomes an underscore."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "_")


def title_in_prompt(prompt: Column) -> Column:
    """The quoted title after "from title" in a prompt (F8); '' where there is none."""
    return F.trim(F.regexp_extract(prompt, "from title '([^']+)'", 1))


def label_polarity(name: Column) -> Column:
    """1 for a label name that means machine, 0 for one that means human, else null.

    Machine names stand alone, human ones anywhere in the label; a label with both is neither.
    """
    n = F.lower(name)
    machine, human = n.rlike(tables.MACHINE_LABEL), n.rlike(tables.HUMAN_LABEL)
    return F.when(machine & ~human, 1).when(human & ~machine, 0)


def machine_index(labels: Column) -> Column:
    """Place of the one label of an array that means machine; 1 where none or several do."""
    hits = F.filter(F.transform(labels, lambda name, i: F.when(label_polarity(name) == 1, i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise(F.lit(1))


def first_link(text: Column) -> Column:
    """The first web or mail address of a text; '' where there is none."""
    return F.regexp_extract(text, r"(www\.[^\s]+|[A-Za-z0-9._-]+@[A-Za-z0-9.-]+)", 1)


def composite_key(*parts: Column) -> Column:
    """Parts joined by a bar (F13); null parts are empty, so that places stay apart."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
