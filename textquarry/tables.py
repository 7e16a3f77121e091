"""Word lists and character tables that results depend on.

Tables that follow a rule (the full-width block) are built from the rule.
"""

from __future__ import annotations

# --- Fixed values: look-alike characters and their Latin reading --------------
# One "character=reading" per item; an empty reading deletes the character.
CYRILLIC_LOWER = (
    "а=a б=b в=v г=g д=d е=e ж=zh з=z и=i й=i к=k л=n м=m н=h о=o п=p р=p с=c т=t у=y ф=f х=x ц=ts ч=c ш=sh "
    "ы=y ь=' ю=yu я=ya ё=e ѕ=s і=i ј=j ћ=t һ=h"
)
CYRILLIC_UPPER = "І=I А=A Б=B В=B Д=D Е=E И=I К=K Л=L М=M Н=H О=O П=P Р=P С=C Т=T У=Y Х=X Ш=Sh"
GREEK_LOWER = (
    "ά=a έ=e ή=e ί=i α=a β=b γ=g δ=d ε=e ζ=z η=n θ=th ι=i κ=k λ=l μ=m ν=v ξ=x ο=o π=p ρ=p ς=s σ=s τ=t υ=u "
    "φ=ph χ=x ψ=ps ω=o ό=o ύ=u ώ=o ϕ=ph"
)
GREEK_UPPER = "Α=A Β=B Γ=G Δ=D Ε=E Ζ=Z Η=H Ι=I Κ=K Λ=L Μ=M Ν=N Ο=O Π=P Ρ=P Σ=S Τ=T Φ=Ph Χ=X Ω=O"
LATIN_EXTENDED = (
    "Æ=Ae Þ=Th ß=ss æ=ae ð=d þ=th İ=I ı=i ł=l Œ=Oe œ=oe ɐ=a ɑ=a ɔ=o ə=e ɛ=e ɪ=i ʁ=r ʃ=sh ʊ=u ʒ=zh ℓ=l ℃=C ℉=F Å=A"
)
FULLWIDTH_MARKS = "!(),.:;?"
# --- Fixed values: typographic characters --------------------------------------
QUOTES = "`=' ´=' «=\" »=\" ‘=' ’=' ‚=' ‛=' “=\" ”=\" „=\" ‟=\" ‹=' ›='"
DASHES = "‒=- –=- —=-- ―=-- −=- －=-"
SPACES = "\u00a0\u2002\u2003\u2009\u200a\u202f\u205f"
SYMBOLS = "·=. ×=x ÷=/ •=* …=... ≈=~ ≠=!= ≤=<= ≥=>= ¼=1/4 ½=1/2 ¾=3/4 ⅓=1/3 ⅔=2/3 �="
DEGREE = "°", " degrees"
# --- Fixed values: the smaller table of the first normaliser -------------------
FIRST_VERSION_SOURCES = "асеіорухёІАВЕКМНОРСТХ" "αεηικνορυχ" "ΑΒΕΗΙΚΜΝΟΡΤΧ"
FIRST_VERSION_WIDE = "aeiouAEIOU"


def _items(text: str) -> dict[str, str]:
    return {item[0]: item[2:] for item in text.split(" ")}


def _wide(chars: str) -> dict[str, str]:
    return {chr(ord(c) + 0xFEE0): c for c in chars}


ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOOKALIKES: dict[str, str] = {
    **_items(CYRILLIC_LOWER), **_items(CYRILLIC_UPPER), **_items(GREEK_LOWER), **_items(GREEK_UPPER),
    **_items(LATIN_EXTENDED), **_wide(ASCII_LETTERS + "0123456789" + FULLWIDTH_MARKS),
}
TYPOGRAPHY: dict[str, str] = {**_items(QUOTES), **_items(DASHES), **_items(SYMBOLS), **dict.fromkeys(SPACES, " "), DEGREE[0]: DEGREE[1]}
FOLDS: dict[str, str] = {**LOOKALIKES, **TYPOGRAPHY}
FIRST_FOLDS: dict[str, str] = {**{c: LOOKALIKES[c] for c in FIRST_VERSION_SOURCES}, **_wide(FIRST_VERSION_WIDE)}

# --- Fixed values: word lists ---------------------------------------------------
FUNCTION_WORDS = (
    "the a an and or but if then else when at by for with about against between into through during before after above "
    "below from up down in out on off over under to of is are was were be been being have has had do does did will would "
    "could should may might shall can need dare ought used it its this that these those i you he she we they me him her us "
    "them my your his our their what which who whom whose how where why not no nor so yet both either neither each every all "
    "any few more most some such than too very just also as well even still already"
).split()
PRONOUNS = (
    "i me my myself you your yourself he him his himself she her hers herself it its itself we us our ourselves they them "
    "their themselves"
).split()
CONJUNCTIONS = "and but or nor for yet so although because since unless until while after before if though when where".split()
SENSITIVE_TITLE_WORDS = ["suppressor", "silencer", "weapon", "explosive", "poison", "bomb", "drug", "hack", "malware", "suicide", "self-harm", "pick a lock", "hotwire"]
SPLIT_ABBREVIATIONS = (
    "Dr Mr Mrs Ms Prof St Jr Sr vs etc Inc Ltd Co Corp Fig No Vol approx al cf Ave Rd Blvd Mt Gen Sen Rep Gov "
    "Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec"
).split()
REFUSAL_PATTERN = r"(?i)(^(i cannot|i can't|i am unable|as an ai|i'm sorry)|(i cannot (create|write|generate|provide))|(note:|disclaimer:)\s+this|wikihow article)"
# --- Fixed values: names of label classes -----------------------------------------
MACHINE_LABEL = r"(^|[^a-z])(ai|fake|machine|generated|gpt|chatgpt|llm|synthetic)([^a-z]|$)"
HUMAN_LABEL = r"(human|real)"
# --- Fixed values: quotas ---------------------------------------------------------
FILLER_DOMAIN_WEIGHTS = [0.45, 0.30, 0.15, 0.10]
