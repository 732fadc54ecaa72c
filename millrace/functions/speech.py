"""What may be said or shown: cleaning of replies and the first reason against one, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as hygiene

# Crude words, sentences that give an access code, name tokens, web addresses, words of a link.
CRUDE = (
    r"(?i)(?<![a-z])(?:f+u+c+k\w*|motherf\w*|shit\w*|bullshit\w*|damn\w*|dammit|goddam\w*|bitch\w*|bastard\w*|asshole\w*|jackass\w*|dumbass\w*|piss(?:ed|ing)?|dick|dicks|cock|cocks|cunt\w*|wtf|slut\w*|whore\w*)(?![a-z])"
    r"|(?<![a-z])f[\-*]+(?:ing|ed|er|in)?(?![\w\-*])|(?<![a-z])(?:sh|s)\*+t(?![a-z])"
)
ACCESS_CODE = (
    r"(?i)\b(?:quiz|survey|attendance|access|exam|check[- ]?in|canvas|entry)\b[^.!?\n]{0,60}?\b(?:code|password|passcode|pin)\b\s*(?:is|:|=|will be|was)\s*[\"“”'‘’]?[A-Za-z0-9][A-Za-z0-9 _-]{0,30}"
    r"|\b(?:code|password|passcode)\b\s*(?:is|:)\s*[\"“'‘][^\"”'’]{1,30}[\"”'’]|\[access code removed\]"
)
NAME_TOKEN = r"(?i)\[\s*(?:student|students|person|people|name|removed|redacted)\s*\]"
WEB_ADDRESS = r"(?i)https?://|www\.|\b[a-z0-9\-]+\.(?:com|net|org|io|ai|ly|xyz|co|me|app)\b"
LINK = "the link on the slide"
LINKS = "the links on the slide"
_STOPS = r"([.,;:!?\]]*)(?=[\s<>\"'()]|$)"
_ADDRESS = (
    rf"(?i)(?:https?://|www\.)(?=[^\s<>\"'()])[^\s<>\"'()]*?{_STOPS}"
    rf"|\b(?:[a-z0-9\-]+\.)+(?:com|net|org|io|ai|ly|xyz|co|me|app|edu|gov|dev)\b(?:/[^\s<>\"'()]*?{_STOPS})?"
)
#: Softened or crude words of recorded speech, and masks of names in it.
SPOKEN = (
    r"(?i)\b(?:f+u+c+k\w*|motherf\w*|shit\w*|bullshit\w*|horseshit|damn\w*|dammit|goddam\w*|god\s+damn\w*|hell|hellish|crap\w*|piss\w*|bitch\w*|bastard\w*|ass|asses|asshole\w*|jackass\w*|badass\w*|dumbass\w*"
    r"|dick|dicks|cock|cocks|prick|pricks|wtf|omfg|oh\s+my\s+god|my\s+god|jesus|christ|jeez|geez|holy\s+(?:god|christ))\b|\bf[\-*]+(?:ing|ed|er|in)?(?![\w\-*])"
)
MASKS = ("[student]", "[person]")
_SENTENCE = r"([^.!?]+(?:[.!?]+[\"'”’)\]]*|$)\s*)"


def first_problem(checks: list[tuple[Column, str]]) -> Column:
    """The name of the first check that holds, null where none does."""
    out = None
    for holds, name in checks:
        out = (F if out is None else out).when(holds, name)
    return out


def _has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def clean_speech(text: Column) -> Column:
    """Dashes as commas, white space as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*[—–]\s*", ", "), r"\s+", " "))


def speakable_links(text: Column) -> Column:
    """Web addresses said as "the link on the slide", several in a row as links; the stop after one stays."""
    once = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(_ADDRESS), F.lit(f"{LINK}$1$2"))
    return F.regexp_replace(once, F.lit(rf"(?i){LINK}(?:\s*(?:,\s*(?:and |or )?|\s+and\s+|\s+or\s+){LINK})+"), F.lit(LINKS))


def trim_to_sentences(text: Column, max_words: int, max_chars: int | None = None, min_words: int | None = None) -> Column:
    """The whole sentences from the start that fit the caps; null where none does or too little is left."""
    least = max_words // 2 if min_words is None else min_words
    fits = lambda t: (word_count(t) <= max_words) & (F.length(t) <= max_chars if max_chars is not None else F.lit(True))
    start = F.struct(F.lit("").alias("raw"), F.lit("").alias("kept"), F.lit(True).alias("open"))

    def step(held: Column, sentence: Column) -> Column:
        raw = F.concat(held["raw"], sentence)
        plain = F.regexp_replace(raw, r"^\s+|\s+$", "")
        go = held["open"] & fits(plain)
        return F.struct(raw.alias("raw"), F.when(go, plain).otherwise(held["kept"]).alias("kept"), go.alias("open"))

    kept = F.aggregate(F.regexp_extract_all(text, F.lit(_SENTENCE), 1), start, step)["kept"]
    ended = _has(kept, r"[.!?\"'”’)\]]$") & (word_count(kept) >= least)
    return F.when(fits(text), text).when(ended, kept)


def trim_to_cap(text: Column, max_words: int, max_chars: int) -> Column:
    """As ``trim_to_sentences``, but a text without a fitting sentence stays as it is."""
    return F.coalesce(trim_to_sentences(text, max_words, max_chars, 1), text)


def speech_problem(text: Column) -> Column:
    """Why a voice must not say a text."""
    return first_problem([(_has(text, CRUDE), "crude word"), (_has(text, ACCESS_CODE), "access code"), (_has(text, NAME_TOKEN), "name token")])


def answer_problem(text: Column, max_words: int = 120, max_chars: int = 1200) -> Column:
    """Why an answer must not be shown: the first reason in order."""
    limits = first_problem([
        (F.coalesce(text, F.lit("")) == "", "empty"), (word_count(text) > max_words, "too many words"), (F.length(text) > max_chars, "too many characters"), (_has(text, WEB_ADDRESS), "web address"),
    ])
    rest = first_problem([(_has(text, hygiene.API_KEY), "key or token"), (hygiene.scrub(text) != text, "personal detail")])
    return F.coalesce(limits, speech_problem(text), rest)


def spoken_problem(text: Column, softened: Column) -> Column:
    """Whether a cue was softened or holds a listed word."""
    return F.coalesce(softened, F.lit(False)) | _has(F.coalesce(text, F.lit("")), SPOKEN)


def clean_cue(text: Column, speaker: Column, softened: Column, voice: str = "instructor") -> Column:
    """Whether a cue may be heard: the wanted speaker, no mask of a name, nothing crude."""
    masked = F.coalesce(*(F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(m)), True) for m in MASKS), F.lit(False))
    return F.coalesce(speaker == voice, F.lit(False)) & ~masked & ~spoken_problem(text, softened)


def lists_people(strong: Column, strict: Column, words: Column) -> Column:
    """Whether a text is a list of people: three sure hits, or six hits that are dense among its words."""
    return (strong >= 3) | ((strict >= 6) & (strict > 0.02 * F.greatest(words, F.lit(1))))
