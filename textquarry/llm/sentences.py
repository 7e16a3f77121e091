"""Sentence boundaries across languages and scripts (problem 7).

Three passes. The first counts short words and scripts per value of the language column;
words that one value has significantly more often than the others (log-likelihood ratio)
tell its language apart, the script most of its letters belong to is its script. The second counts, over
all documents and per language: which words open paragraphs and follow sure ends
(sentence starters), what follows each word that carries a period, and how often
words stand without one. Log-likelihood ratios turn the counts into a model: a starter opens sentences
more often than it stands inside; an abbreviation is a word whose period is followed
by something other than a starter more often than periods are in general; it
can end a sentence if starters are among what follows it; a collocation is a word with a period and
a follower that stand together more often than either would by chance, and binds where
its word is no abbreviation. Numbers are words of the same kind by their length, which learns ordinals.
No word and no language is listed by hand.

The third pass classifies each end mark with the model: marks inside a pair of
quotation marks or brackets never end a sentence, other marks by what stands
around them. Language is decided per paragraph, by its script and the learned short
words, as the language column may be null or wrong; without such words the column
decides where it names a language of that script, else the script's most frequent language,
else the script itself, which is a language of its own then.

The model is broadcast if it has at most ``MODEL_ROWS`` rows; a larger one is
joined to each document's own words, of which one function lists all that may be looked up. Defined cases: null, empty and white-space
texts have no sentences; positions count code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.normalize import fold_text
from textquarry.storage import Scratch, small_enough, spread

MODEL_ROWS = 300_000
#: A ratio above this is significant (chi-square, one degree, p = 0.001).
SIGNIFICANT = 10.83
#: Least share of sure occurrences at a sentence start for a starter.
STARTER_SHARE = 0.6
#: Least share of followers other than starters for an abbreviation, and of starters among capitals for one that can end.
ABBREVIATION_SHARE, ENDING_SHARE = 0.5, 0.35
#: Least share of a reporting word's occurrences that follow quoted speech.
REPORT_SHARE = 0.2
#: Words of a language that tell it apart, their greatest length, and the least share of all words of a language.
TELLING, TELLING_CHARS, LEAST_LANGUAGE = 40, 6, 1e-4
#: Least share of a word's periods that are followed by the other part of a collocation, and least number.
COLLOCATION_SHARE, COLLOCATION_COUNT = 0.5, 5
#: An abbreviation stands without its period at most this often for each time with it.
BARE_RATIO = 10

STRONG = "!?。！？｡।॥؟۔"
DOTS = "….．"
MARKS = STRONG + DOTS
OPEN = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "《": "》", "【": "】", '"': '"', "»": "«"}
BRACKETS = "([（【"
CLOSERS = "\"'”’“»«」』)]）》】"
RUN = re.compile(f"[{re.escape(MARKS)}]+")
EMPTY_LINE = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*")
ITEM = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?=(?:[-*•‣◦]|(\d{1,3})[.)])[^\S\r\n]+\S)")
NUMBERED = re.compile(r"\s*(\d{1,3})[.)][^\S\r\n]")
ITEM_MARK = re.compile(r"(?:[-*•‣◦]|\d{1,3}[.)])[^\S\r\n]+")
PAIRS = re.compile("[" + re.escape("".join(OPEN) + "".join(OPEN.values())) + "]")
WORD = re.compile(r"[^\W_](?:[\w'’­​-‏⁠﻿̀-ͯऀ-෿-]|[.](?=[^\W\d_])){0,80}")
FORMAT = re.compile("[­​-‏⁠﻿]")
CHAIN = re.compile(r"(?:[^\W\d_]{1,2}[.-]+)+[^\W\d_]{1,2}")
THAI = re.compile("[฀-๿]")
WORD_EDGES = ",;:—–/=" + STRONG
#: Characters before a mark that are looked at, and between a mark and the end of its pair.
LONGEST_WORD, CLOSING_RUN = 80, 12
#: Special-token strings and placeholders, which are not what follows a mark.
JUNK = re.compile(r"(?:</?[a-z|_]{1,20}>|<\|[a-z_]{1,20}\|>|\[[A-Z]{2,8}\])\s*")
#: Case in the middle of words, as attacks leave it; the end of a word before a full stop.
MIXED_CASE = re.compile("[a-z][A-Z]")
TAIL = re.compile(r"[^\W_]{2,}$")
DEVANAGARI = re.compile("[ऀ-ॿ]")
THAI_SPACE = re.compile(r"(?<=\S)\s+(?=\S)")
#: Scripts in the order in which they are looked for; kana before Han, which Japanese uses, too.
SCRIPTS = [("thai", re.compile("[\u0e00-\u0e7f]")), ("kana", re.compile("[\u3040-\u30ff]")), ("han", re.compile("[\u4e00-\u9fff]")), ("devanagari", re.compile("[\u0900-\u097f]")), ("arabic", re.compile("[\u0600-\u06ff]")), ("cyrillic", re.compile("[\u0400-\u04ff]"))]
#: Scripts without spaces or case, whose words are not counted.
UNSPACED = ("thai", "kana", "han")
LATIN = re.compile("[A-Za-z\u00c0-\u024f]")
CYRILLIC = re.compile("[\u0400-\u04ff]+")
LETTER_RUN = re.compile(r"[^\W\d_]+")


def script(block: str) -> str:
    """The script of most letters; some kana are Japanese, and half as many Latin letters make Cyrillic ones look-alikes."""
    if not block.isascii():
        latin = len(LATIN.findall(block))
        for name, letters in SCRIPTS:
            n = len(letters.findall(block))
            if n and (n > latin or name == "kana" and n > 3) and not (name == "cyrillic" and latin > n / 2):
                return name
    return "latin"


def clean_language(column: str | None) -> str:
    return (column or "").strip().lower()


class Languages:
    """The learned languages: their scripts and the words that tell them apart."""

    def __init__(self, rows) -> None:
        self.script: dict[str, str] = {}
        self.largest: dict[str, str] = {}
        self.votes: dict[str, list[str]] = {}
        for lang, what, word, *_ in rows:
            if what == "script":
                self.script[lang] = word
            elif what == "largest":
                self.largest[word] = lang
            elif what == "telling":
                self.votes.setdefault(word, []).append(lang)

    def __call__(self, block: str, column: str | None) -> tuple[str, str]:
        """(script, language) of a block: the language whose words are most frequent, ties and blocks without them by the column."""
        found = script(block)
        known = clean_language(column)
        votes: dict[str, int] = {}
        if found not in UNSPACED:
            known_words = self.votes
            for word in [w for w in LETTER_RUN.findall(block.lower()) if w in known_words]:
                for lang in known_words[word]:
                    if self.script.get(lang) == found:
                        votes[lang] = votes.get(lang, 0) + 1
        if not votes:
            trusted = known and (self.script.get(known) == found or not self.script)  # nothing learned: the column alone
            return found, known if trusted else self.largest.get(found, found)
        best = max(votes.values())
        return found, known if votes.get(known) == best else max(votes, key=lambda x: (votes[x], x))


def language_words(docs: DataFrame) -> DataFrame:
    """``lang``, ``kind`` (word, script), ``word``, ``n``: short words and letters by script per value of the column, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            scripts: Counter = Counter()
            for text, column in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lang = clean_language(column)
                if text and lang:
                    name = script(text)
                    scripts[lang, name] += len(text)
                    if name not in UNSPACED:
                        counts.setdefault(lang, Counter()).update(w for w in LETTER_RUN.findall(text.lower()) if len(w) <= TELLING_CHARS)
            rows = [(lang, "word", w, n) for lang, words in counts.items() for w, n in words.items()] + [(lang, "script", name, n) for (lang, name), n in scripts.items()]
            if rows:
                lang, kind, word, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["lang", "kind", "word", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, kind string, word string, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))


def learn_languages(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``lang``, ``kind`` (script, largest, telling), ``word``, ``ends``: at most ``TELLING`` + 2 rows for each of at most 1 / ``LEAST_LANGUAGE`` languages."""
    seen = scratch.save(language_words(docs), "language-words")
    letters = seen.filter("kind = 'script'")
    whole = letters.agg(F.sum("n").alias("whole"))
    size = letters.groupBy("lang").agg(F.sum("n").alias("size"), F.max(F.struct("n", "word"))["word"].alias("script"))
    size = scratch.save(size.join(F.broadcast(whole)).filter(F.col("size") >= LEAST_LANGUAGE * F.col("whole")).select("lang", "size", "script"), "languages")
    first = Window.partitionBy("script").orderBy(F.desc("size"), "lang")
    largest = size.withColumn("k", F.row_number().over(first)).filter("k = 1")
    words = seen.filter("kind = 'word'").join(F.broadcast(size.select("lang", "script")), "lang")
    of_lang = words.groupBy("lang").agg(F.sum("n").alias("n_all"))
    of_word = words.groupBy("script", "word").agg(F.sum("n").alias("k_all"))
    of_script = words.groupBy("script").agg(F.sum("n").alias("every"))
    tested = words.join(of_word, ["script", "word"]).join(F.broadcast(of_lang), "lang").join(F.broadcast(of_script), "script")
    k, n, k_all, every = (F.col(c) for c in ("n", "n_all", "k_all", "every"))
    more = F.when(every > n, k / n > (k_all - k) / (every - n)).otherwise(True)
    ratio = F.when(every > n, _ratio(k, n, k_all, every)).otherwise(k.cast("double"))  # the only language of its script
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("ratio"), "word"))
    telling = tested.filter(more).withColumn("ratio", ratio).filter(F.col("ratio") > SIGNIFICANT).withColumn("rank", rank).filter(F.col("rank") <= TELLING)
    no = F.lit(False).alias("ends")
    rows = size.select("lang", F.lit("script").alias("kind"), F.col("script").alias("word"), no).unionByName(largest.select("lang", F.lit("largest").alias("kind"), F.col("script").alias("word"), no))
    return scratch.save(rows.unionByName(telling.select("lang", F.lit("telling").alias("kind"), "word", no)), "telling")


@lru_cache(maxsize=100_000)
def key(word: str) -> str:
    """Folded, lower-cased form; wholly Cyrillic words keep their letters; a number becomes one of two classes, up to two digits and longer."""
    word = FORMAT.sub("", word)
    word = (word if CYRILLIC.fullmatch(word) else fold_text(word)).lower().rstrip("'-")
    return ("#2" if len(word) <= 2 else "#4") if word.isdigit() else word


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans between empty lines and before list items, trimmed."""
    first = NUMBERED.match(text)
    edges, number = [], int(first[1]) if first else 0
    for m in EMPTY_LINE.finditer(text):
        edges.append((m.start(), m.end()))
    for m in ITEM.finditer(text):
        if m[1] is None:
            edges.append((m.start(), m.end()))
        elif int(m[1]) in (1, number + 1):
            edges.append((m.start(), m.end()))
        if m[1] is not None and int(m[1]) in (1, number + 1):
            number = int(m[1])
    at = 0
    for start, end in [*sorted(edges), (len(text), len(text))]:
        if start >= at:
            a, b = at, start
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if b > a:
                yield a, b
        at = max(at, end)


def pairs(block: str) -> list[tuple[int, int]]:
    """Outermost matched pairs of quotation marks and brackets: (opening, closing)."""
    stack: list[tuple[str, int]] = []
    waiting: Counter[str] = Counter()  # closing marks that some open mark accepts
    out: list[tuple[int, int]] = []
    for m in PAIRS.finditer(block):
        c, i = m[0], m.start()
        if waiting[c]:
            while True:
                opener, opened = stack.pop()
                waiting.subtract(OPEN[opener])
                if c in OPEN[opener]:
                    break
            while out and out[-1][0] > opened:
                out.pop()
            out.append((opened, i))
        elif c in OPEN and not (c == "»" and not (i + 1 < len(block) and not block[i + 1].isspace())):
            stack.append((c, i))
            waiting.update(OPEN[c])
    return out


class Mark:
    """An end mark with what stands around it."""

    __slots__ = ("at", "end", "run", "word", "word_at", "next", "next_at", "gap", "closed", "lead", "initial")


def marks(block: str, spans: list[tuple[int, int]]) -> Iterator[Mark]:
    """End marks outside pairs, or right before the end of one."""
    k = 0
    openings = {i for i, _ in spans}
    for m in RUN.finditer(block):
        while k < len(spans) and spans[k][1] < m.start():
            k += 1
        inside = spans[k] if k < len(spans) and spans[k][0] < m.start() else None
        x = Mark()
        x.at, end, x.run, x.closed = m.start(), m.end(), m[0], None
        if inside:
            rest = block[end : inside[1]]
            if rest.strip(CLOSERS + "   "):
                continue
            end, x.closed = inside[1] + 1, inside
        while end < len(block) and (block[end] in CLOSERS and end not in openings or FORMAT.match(block[end])):
            end += 1
        x.end = end
        nxt = end
        while nxt < len(block) and block[nxt].isspace():
            nxt += 1
        x.gap, x.next_at = nxt > end, nxt
        while junk := JUNK.match(block, nxt):
            nxt = junk.end()
        lead = nxt
        while lead < len(block) and (block[lead] in OPEN or block[lead] in "¿¡'‘$€£¥§#" or FORMAT.match(block[lead])):
            lead += 1
        x.lead = block[nxt:lead]
        w = WORD.match(block, lead)
        x.next = w[0] if w else ""
        x.initial = len(x.next) == 1 and x.next.isupper() and block[lead + 1 : lead + 2] == "."
        i = m.start()
        far = max(0, i - LONGEST_WORD)
        while i > far and not block[i - 1].isspace() and block[i - 1] not in CLOSERS and block[i - 1] not in OPEN and block[i - 1] not in WORD_EDGES:
            i -= 1
        x.word, x.word_at = block[i : m.start()].strip("¿¡'"), i
        yield x


def kind(word: str) -> str:
    """'' nothing, 'd' digit, 'l' lower case, 'u' upper case, 'n' letters without case."""
    if not word:
        return ""
    c = word[0]
    return "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "n"


def _skip(block: str, at: int, chars: str) -> int:
    while at < len(block) and block[at] in chars:
        at += 1
    return at


def _last(block: str, end: int) -> str:
    """The last visible character before a position, or ''."""
    while end > 0 and block[end - 1].isspace():
        end -= 1
    return block[end - 1 : end] if end else ""


def observe(text: str, lang: str | None, counts: Counter, languages: Languages | None = None, plain: dict[str, Counter] | None = None) -> None:
    """Add a text's evidence: (language, kind, word, follower) -> count.

    Kinds: S sure start, I sure inside, P word with period and its follower,
    B word without period, R word after quoted speech that goes on. ``plain`` collects the forms of B per language, for a
    batch to fold each form once.
    """
    forms = {} if plain is None else plain
    languages = languages or Languages([])
    for a, b in blocks(text):
        block = text[a:b]
        written, tongue = languages(block, lang)
        if written in UNSPACED:
            continue
        starts = set()
        mark = ITEM_MARK.match(block)
        first = WORD.search(block, mark.end() if mark else 0)
        if first and first.start() <= (mark.end() if mark else 0) + 2:
            starts.add(first.start())
        spans = pairs(block)
        dotted = set()
        for x in marks(block, spans):
            last = x.run[-1]
            if x.gap and x.next and not x.closed and last in STRONG:
                starts.add(x.next_at + len(x.lead))
            if x.run == "." and x.gap and x.word and not x.closed:
                dotted.add(x.at)
                counts[tongue, "P", key(x.word), follower_key(x.next)] += 1
        for i, j in spans:
            last_inside = _last(block, j)
            after = WORD.match(block, _skip(block, j + 1, " ,—–"))
            if after and kind(after[0]) == "l" and block[i] not in BRACKETS and (last_inside in (",", "!", "?") or block[j + 1 : j + 2] == ","):
                counts[tongue, "R", key(after[0]), ""] += 1
        bare = []
        for w in WORD.finditer(block):
            form = w[0]
            if w.end() not in dotted:
                bare.append(form)
            c = form[0]
            if not (c.islower() or c.isdigit()):
                at = w.start()
                if at in starts:
                    counts[tongue, "S", key(form), ""] += 1
                elif at > 1 and block[at - 1] == " " and (block[at - 2].isalnum() or block[at - 2] == ","):
                    counts[tongue, "I", key(form), ""] += 1
        forms.setdefault(tongue, Counter()).update(bare)
    if plain is None:
        count_forms(forms, counts)


def count_forms(forms: dict[str, Counter], counts: Counter) -> None:
    """Add words without a period, by their folded form."""
    for tongue, found in forms.items():
        for form, n in found.items():
            counts[tongue, "B", key(form), ""] += n


def evidence(docs: DataFrame, languages: list[tuple]) -> DataFrame:
    """``lang``, ``kind``, ``word``, ``follower``, ``n`` over all documents (``text``, ``lang``)."""

    shipped = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Languages(shipped.value)
        for batch in batches:
            counts: Counter = Counter()
            plain: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    observe(text, lang, counts, known, plain)
            count_forms(plain, counts)
            if counts:
                columns = [pa.array(c, pa.string()) for c in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=["lang", "kind", "word", "follower", "n"])

    found = docs.select("text", "lang").mapInArrow(run, "lang string, kind string, word string, follower string, n long")
    return found.groupBy("lang", "kind", "word", "follower").agg(F.sum("n").alias("n"))


def _ratio(k, n, k_all, n_all):
    """Log-likelihood ratio of k in n against the rest of k_all in n_all."""

    def part(x, m, p):
        p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
        return x * F.log(p) + (m - x) * F.log(1 - p)

    rest_k, rest_n = k_all - k, F.greatest(n_all - n, F.lit(1))
    p, p1, p2 = k_all / n_all, k / n, rest_k / rest_n
    return 2 * (part(k, n, p1) + part(rest_k, rest_n, p2) - part(k, n, p) - part(rest_k, rest_n, p))


def learn(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The model: ``lang``, ``kind``, ``word``, ``ends``.

    Kinds: starter, abbreviation (``ends``: it may end a sentence), report, collocation (``word`` is the word and its
    follower with a blank between), and those of ``learn_languages``.
    """
    scratch = scratch or Scratch(docs.sparkSession, "sentences")
    languages = learn_languages(docs, scratch)
    seen = scratch.save(evidence(docs, [tuple(r) for r in languages.collect()]), "evidence")  # bounded, see there
    sure = seen.filter("kind IN ('S', 'I')").groupBy("lang", "word").agg(F.sum(F.when(F.col("kind") == "S", F.col("n")).otherwise(0)).alias("s"), F.sum("n").alias("n"))
    whole = sure.groupBy("lang").agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
    starters = sure.join(F.broadcast(whole), "lang").filter((F.col("s") / F.col("n") >= STARTER_SHARE) & (_ratio(F.col("s"), F.col("n"), F.col("s_all"), F.col("n_all")) > SIGNIFICANT / 2) & (F.col("s") / F.col("n") > F.col("s_all") / F.col("n_all")))
    starters = scratch.save(starters.select("lang", "word"), "starters")
    follow = seen.filter("kind = 'P'").join(starters.select("lang", F.col("word").alias("follower"), F.lit(1).alias("starter")), ["lang", "follower"], "left")
    capital = ~F.col("follower").isin("d", "l", "o")
    per_word = follow.groupBy("lang", "word").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("starter").isNull(), F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.when(F.col("starter") == 1, F.col("n")).otherwise(0)).alias("st"), F.sum(F.when(capital, F.col("n")).otherwise(0)).alias("cap"),
    )
    bare = seen.filter("kind = 'B'").groupBy("lang", "word").agg(F.sum("n").alias("bare"))
    every = per_word.groupBy("lang").agg(F.sum("k").alias("k_all"), F.sum("n").alias("n_all"))
    tested = per_word.join(bare, ["lang", "word"], "left").na.fill(0, ["bare"]).join(F.broadcast(every), "lang")
    short = tested.filter((F.col("k") / F.col("n") >= ABBREVIATION_SHARE) & (F.col("k") / F.col("n") > F.col("k_all") / F.col("n_all")) & (F.col("bare") <= BARE_RATIO * F.col("n")))
    short = short.filter(_ratio(F.col("k"), F.col("n"), F.col("k_all"), F.col("n_all")) > SIGNIFICANT)
    short = short.select("lang", F.lit("abbreviation").alias("kind"), "word", (F.col("st") >= ENDING_SHARE * F.greatest("cap", F.lit(1))).alias("ends"))
    after = seen.filter("kind = 'R'").select("lang", "word", F.col("n").alias("k"))
    said = after.join(bare, ["lang", "word"]).withColumn("bare", F.greatest("bare", "k"))
    spoken = after.groupBy("lang").agg(F.sum("k").alias("k_all")).join(bare.groupBy("lang").agg(F.sum("bare").alias("n_all")), "lang")
    said = said.join(F.broadcast(spoken), "lang").filter((F.col("k") / F.col("bare") >= REPORT_SHARE) & (F.col("k") / F.col("bare") > F.col("k_all") / F.col("n_all")))
    said = said.filter(_ratio(F.col("k"), F.col("bare"), F.col("k_all"), F.col("n_all")) > SIGNIFICANT).join(starters, ["lang", "word"], "left_anti")
    reports = said.select("lang", F.lit("report").alias("kind"), "word", F.lit(False).alias("ends"))
    bound = _collocations(seen, starters, short)
    return scratch.save(starters.select("lang", F.lit("starter").alias("kind"), "word", F.lit(False).alias("ends")).unionByName(short).unionByName(reports).unionByName(bound).unionByName(languages), "model")


def _collocations(seen: DataFrame, starters: DataFrame, short: DataFrame) -> DataFrame:
    """Pairs of a word with its period and the follower that the log-likelihood ratio binds; abbreviations and starters need none."""
    pairs = seen.filter("kind = 'P' AND word <> '' AND follower NOT IN ('o', 'l')").select("lang", "word", "follower", F.col("n").alias("k"))
    periods = seen.filter("kind = 'P'")
    of_word = periods.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    of_follower = periods.groupBy("lang", "follower").agg(F.sum("n").alias("k_all"))
    every = periods.groupBy("lang").agg(F.sum("n").alias("n_all"))
    tested = pairs.filter(F.col("k") >= COLLOCATION_COUNT).join(of_word, ["lang", "word"]).join(of_follower, ["lang", "follower"]).join(F.broadcast(every), "lang")
    tested = tested.filter((F.col("k") >= COLLOCATION_SHARE * F.col("n")) & (F.col("k") / F.col("n") > F.col("k_all") / F.col("n_all")))
    tested = tested.filter(_ratio(F.col("k"), F.col("n"), F.col("k_all"), F.col("n_all")) > SIGNIFICANT)
    tested = tested.join(starters.select("lang", F.col("word").alias("follower")), ["lang", "follower"], "left_anti").join(short.select("lang", "word"), ["lang", "word"], "left_anti")
    return tested.select("lang", F.lit("collocation").alias("kind"), F.concat_ws(" ", "word", "follower").alias("word"), F.lit(False).alias("ends"))


class Model:
    """Look-ups of the learned rows."""

    def __init__(self, rows) -> None:
        self.starters: set[tuple[str, str]] = set()
        self.reports: set[tuple[str, str]] = set()
        self.short: dict[tuple[str, str], bool] = {}
        self.bound: set[tuple[str, str]] = set()
        for lang, what, word, ends in rows:
            if what == "starter":
                self.starters.add((lang, word))
            elif what == "report":
                self.reports.add((lang, word))
            elif what == "collocation":
                self.bound.add((lang, word))
            elif what == "abbreviation":
                self.short[lang, word] = ends


def follower_key(word: str) -> str:
    """How the evidence names what follows a period: a word with a capital or without case itself, else its kind."""
    what = kind(word)
    return key(word) if what in ("u", "n") else what or "o"


def keys(x: Mark) -> set[str]:
    """Every word that ``_ends`` may look up for a mark."""
    word = key(x.word) if x.word else ""
    tail = TAIL.search(x.word)
    return {w for w in (word, word.rsplit(".", 1)[-1], key(tail[0]) if tail else "", key(x.next) if x.next else "", f"{word} {follower_key(x.next)}") if w}


def _ends(x: Mark, block: str, start: int, written: str, lang: str, model: Model, opened: int, noisy: bool) -> bool:
    """Whether the mark ends its sentence, which began at ``start`` (``opened``: after a list mark; ``noisy``: case says little)."""
    after = kind(x.next)
    following = block[x.end : x.end + 1]
    starter = bool(x.next) and (lang, key(x.next)) in model.starters
    if x.next_at >= len(block):
        return True
    if x.closed:
        first = x.closed[0]
        if following in ",;:" or block[x.next_at] in ",;—–":
            return False
        opens = first <= opened
        if block[first] in BRACKETS:
            return opens or after in ("u", "n", "") or x.lead != ""
        if opens:
            said = (lang, key(x.next)) in model.reports if x.next else False
            if after == "l" or said:
                return False
            return not (after == "n")
        before = _last(block, first)
        if after == "l":
            return x.run[-1] in DOTS or before in ":,："
        if after == "n":
            return before in ":,：，،" or (written in ("devanagari", "arabic") and starter)
        return True
    if x.run[-1] in STRONG:
        if x.gap:
            return True
        return x.run[-1] not in "!?" or after in ("u", "n") or x.lead != ""
    if x.run == "." and not x.gap:
        # a missing space: a whole word before, a capitalised one after, maybe quoted
        if after != "u" or any(c not in OPEN for c in x.lead):
            return False
        tail = TAIL.search(x.word)
        capitalised = len(x.next) == 1 or x.next[1:2].islower() or noisy
        return bool(tail) and capitalised and (lang, key(tail[0])) not in model.short and not CHAIN.fullmatch(x.word)
    if x.run == "." or x.run == "．":
        word = key(x.word)
        if written == "devanagari" and DEVANAGARI.match(x.word):
            return False  # the script has its own end mark
        if x.word_at <= start and x.word.isdigit() and opened > start:
            return False
        chain = bool(CHAIN.fullmatch(FORMAT.sub("", x.word)))
        initial = len(x.word) == 1 and x.word.isupper()
        known = model.short.get((lang, word))
        if known is None and not chain and "." in word:
            known = model.short.get((lang, word.rsplit(".", 1)[1]))
        if initial and known is None:
            return starter and after != "l" and not x.initial
        if known is None and not chain:
            return (lang, f"{word} {follower_key(x.next)}") not in model.bound
        if after in ("l", "d") or (after == "" and x.lead == "") or x.lead[:1] in ("(", "（"):
            return False
        ends = known if known is not None else True
        if word.startswith("#") or after == "n":
            return starter
        return ends or starter
    # an ellipsis: goes on before lower case, unless case says nothing here
    if not x.gap:
        return False
    if after == "n" or noisy and after in ("l", "u"):
        return starter
    return after not in ("l", "d")


def segment(text: str | None, lang: str | None, model: Model, languages: Languages | None = None) -> list[tuple[int, int]]:
    """Sentences of a text as (start, end) positions in code points, end exclusive."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    languages = languages or Languages([])
    for a, b in blocks(text):
        block = text[a:b]
        written, tongue = languages(block, lang)
        spans = pairs(block)
        noisy = len(MIXED_CASE.findall(block)) >= 3
        cuts = []
        start = 0
        mark = ITEM_MARK.match(block)
        opened = mark.end() if mark else 0
        for x in marks(block, spans):
            if x.at < opened or x.at < start:
                continue
            if _ends(x, block, start, written, tongue, model, max(opened, start), noisy):
                cuts.append(x.end)
                start = x.next_at
                opened = start
        if written == "thai" or THAI.search(block):
            cuts = sorted({*cuts, *_thai_cuts(block, spans)})
        at = 0
        for cut in [*cuts, len(block)]:
            i, j = at, cut
            while i < j and block[i].isspace():
                i += 1
            while j > i and block[j - 1].isspace():
                j -= 1
            if j > i:
                out.append((a + i, a + j))
            at = max(at, cut)
    return out


def _thai_cuts(block: str, spans: list[tuple[int, int]]) -> Iterator[int]:
    """Ends before spaces between Thai letters, outside pairs and not beside digits, Latin letters or the repetition mark."""

    def beside(c: str) -> bool:
        return c.isdigit() or c == "ๆ" or bool(LATIN.match(c))

    for m in THAI_SPACE.finditer(block):
        left, right = block[m.start() - 1], block[m.end()]
        if beside(left) or beside(right) or not (THAI.match(left) or THAI.match(right)):
            continue
        if any(i < m.start() <= j for i, j in spans):
            continue
        yield m.start()


def _rows(batch_ids: pa.Array, found: list[list[tuple[int, int]]], key_name: str) -> pa.RecordBatch:
    take = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
    flat = [p for x in found for p in x]
    return pa.RecordBatch.from_arrays([batch_ids.take(take), pa.array([p[0] for p in flat], pa.int32()), pa.array([p[1] for p in flat], pa.int32())], names=[key_name, "start_pos", "end_pos"])


def split_sentences(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", model: DataFrame | None = None, max_rows: int = MODEL_ROWS) -> DataFrame:
    """``doc``, ``start_pos``, ``end_pos`` of every sentence of every document.

    ``model`` is learned from the same documents unless given.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sentences")
    slim = spread(docs.select(doc, F.col(text).alias("text"), F.col(lang).alias("lang")))
    if model is None:
        model = learn(slim, scratch)
    kind_of = docs.schema[doc].dataType.simpleString()
    schema = f"{doc} {kind_of}, start_pos int, end_pos int"
    of_language = F.col("kind").isin("script", "largest", "telling")
    languages = spark.sparkContext.broadcast([tuple(r) for r in model.filter(of_language).select("lang", "kind", "word", "ends").collect()])  # bounded, see learn_languages
    learned = model.filter(~of_language).select("lang", "kind", "word", "ends")
    if small_enough(learned, max_rows):
        shipped = spark.sparkContext.broadcast([tuple(r) for r in learned.collect()])  # at most max_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, spoken = Model(shipped.value), Languages(languages.value)
            for batch in batches:
                found = [segment(t, x, known, spoken) for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield _rows(batch.column(0), found, doc)

        return slim.mapInArrow(run, schema)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spoken = Languages(languages.value)
        for batch in batches:
            counts: list[set[tuple[str, str]]] = [set() for _ in range(batch.num_rows)]
            for own, t, x in zip(counts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for a, b in blocks(t or ""):
                    block = t[a:b]
                    _, tongue = spoken(block, x)
                    for m in marks(block, pairs(block)):
                        own.update((tongue, w) for w in keys(m))
            take = pa.array([i for i, own in enumerate(counts) for _ in own], pa.int64())
            flat = [p for own in counts for p in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([p[0] for p in flat], pa.string()), pa.array([p[1] for p in flat], pa.string())], names=[doc, "lang", "word"])

    own = slim.mapInArrow(words, f"{doc} {kind_of}, lang string, word string").join(learned, ["lang", "word"])
    slices = own.groupBy(doc).agg(F.collect_list(F.struct("lang", "kind", "word", "ends")).alias("rows"))  # bounded by a text's marks

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spoken = Languages(languages.value)
        for batch in batches:
            rows = [[(r["lang"], r["kind"], r["word"], r["ends"]) for r in x or []] for x in batch.column(3).to_pylist()]
            found = [segment(t, x, Model(r), spoken) for t, x, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), rows, strict=True)]
            yield _rows(batch.column(0), found, doc)

    return slim.join(slices, doc, "left").select(doc, "text", "lang", "rows").mapInArrow(run_joined, schema)
