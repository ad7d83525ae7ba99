"""Text cleaning and n-gram Column functions: built-in expressions, and the cleaning of
whole texts in Arrow batches (``words.py``)."""
from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import cleaner

# --- fixed values: must equal the reference for identical tokens ------------
# English stopword list of the era (127 words), in its natural order.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he "
    "him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can "
    "will just don should now"
).split()
# The 21 extra stopwords of the project, in their natural order.
ADDITIONAL_STOPWORDS = [
    "said", "would", "like", "many", "also", "could", "mr", "ms", "mrs", "may",
    "even", "say", "much", "going", "might", "dont", "go", "another", "around",
    "says", "editor",
]
ALL_STOPWORDS = sorted(set(ENGLISH_STOPWORDS + ADDITIONAL_STOPWORDS))
# Non-ASCII characters become a space; the 32 ASCII punctuation characters are deleted.
# A run becomes one space, as the split takes runs of blanks anyway.
NON_ASCII = r"[^\x00-\x7F]+"
PUNCTUATION_CHARS = string.punctuation
PUNCTUATION = r"[!-/:-@\[-`{-~]"          # the same 32 characters as a regex class
# Word-tokenizer splits that need no apostrophe: (first part, second part); the
# last one applies only when a space follows.
CONTRACTION_SPLITS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"),
                      ("lem", "me"), ("wan", "na")]
# ---------------------------------------------------------------------------
_SPACE_AFTER = {("wan", "na")}
# one pass: insert a space after the first part when the whole word matches
CONTRACTION_REGEX = r"\b(" + "|".join(
    f"{a}(?={b}{' ' if (a, b) in _SPACE_AFTER else chr(92) + 'b'})"
    for a, b in CONTRACTION_SPLITS) + ")"
# one whitespace class for every engine
WHITESPACE = r"[\t\n\x0B\f\r\x1C-\x1F ]+"
# tokens the vectorizer sees: runs of at least two word characters
VECTOR_TOKEN = r"[a-z0-9]{2,}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_tokens(text) -> Column:
    """array<string>: ASCII-fold, lower, strip punctuation, split, drop stopwords."""
    s = F.lower(F.regexp_replace(_col(text), NON_ASCII, " "))
    s = F.translate(s, PUNCTUATION_CHARS, "")
    # padding mirrors the tokenizer, which surrounds the text with spaces
    s = F.concat(F.lit(" "), s, F.lit(" "))
    s = F.regexp_replace(s, CONTRACTION_REGEX, "$1 ")
    toks = F.split(s, WHITESPACE)
    return F.filter(toks, lambda t: (t != "") & ~t.isin(*ALL_STOPWORDS))


def clean_tokenize(text) -> Column:
    """clean_text string: the cleaned tokens joined by one space ('' if none), equal to
    ``array_join(clean_tokens(text), ' ')`` but made in Arrow batches: the expressions
    turn every text into a string for each pattern and weigh token by token."""
    clean = cleaner(PUNCTUATION_CHARS, ALL_STOPWORDS, CONTRACTION_SPLITS, _SPACE_AFTER)

    def run(texts: pa.Array) -> pa.Array:
        return clean(texts)
    return F.arrow_udf(run, "string")(_col(text))


def doc_word_count(clean_text) -> Column:
    """Whitespace word count of a clean text (0 for '')."""
    c = _col(clean_text)
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " ")))


def vector_tokens(clean_text) -> Column:
    """Tokens kept by the vectorizer (>= 2 word characters), before n-grams."""
    return F.regexp_extract_all(_col(clean_text), F.lit(VECTOR_TOKEN), 0)


def _gram_at(tokens: Column, n: int):
    # one-argument lambda (F.transform reads the arity: two arguments = index). Elements
    # are taken one by one: a slice would copy the whole array for every position
    return lambda i: F.array_join(F.array(*(F.get(tokens, i + k) for k in range(n))), " ")


def ngrams(tokens, ngram_range=(1, 1)) -> Column:
    """All n-grams for n in [lo, hi], in order n=lo.., position 0.. ."""
    lo, hi = ngram_range
    if lo < 1 or hi < lo:
        raise ValueError(f"bad ngram_range {ngram_range}")
    t = _col(tokens)
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(t)
            continue
        grams = F.transform(F.sequence(F.lit(0), F.size(t) - n), _gram_at(t, n))
        parts.append(F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)
