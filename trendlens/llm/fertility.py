"""Quality rules from what public vocabularies make of a text.

Two vocabularies that were trained on ordinary text measure every document: characters
per token (byte-level pairs, and pieces), the share of byte-fallback pieces, and the
entropy of the tokens. Text unlike what the vocabularies know (menus, symbols strewn in,
shouting, binary remains) breaks into more or fewer tokens than its language does.

Rejection bands belong to a language, or to a script where the language is unknown or has
few labelled rows: a range of each measure, and a cut along the axis that parts ordinary
from junk rows. They are learned from a bounded sample of labelled rows.

A word is encoded once: tasks remember the tokens of words they have met, and encode the
new words of a block of texts in one call.
"""
from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prepare, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = re.compile(r"[#*$%&|<>]")
LEAST_WORDS, MOST_REPEATED = 50, 50            # words; hundredths of the words
BLOCK_BYTES = 1 << 20                          # text a task measures at once, and one text at least
REMEMBERED = 300_000                           # words whose tokens a task keeps
SEGMENT = 256                                  # longer words are encoded in segments of so many code points
SAMPLE = 40_000                                # labelled rows the bands are learned from, at most
FEW, FEW_JUNK = 30, 8                          # ordinary and junk rows that a language needs for bands of its own
MEASURES = ["chars_per_token", "chars_per_piece", "byte_share", "token_entropy", "log_tokens"]
SCRIPTS = ["LATIN", "GREEK", "CYRILLIC", "HEBREW", "ARABIC", "DEVANAGARI", "BENGALI", "THAI", "HANGUL", "HIRAGANA",
           "KATAKANA", "CJK", "ARMENIAN", "GEORGIAN", "TAMIL", "TELUGU", "OTHER", "NONE"]


def script_of(word: str) -> int:
    """The script of the word's first letter, by its Unicode name."""
    for c in word:
        if c.isascii():
            if c.isalpha():
                return 0
        elif c.isalpha():
            name = unicodedata.name(c, "").split(" ")[0]
            return SCRIPTS.index(name) if name in SCRIPTS else SCRIPTS.index("OTHER")
    return SCRIPTS.index("NONE")


class Vocabularies:
    """The two public vocabularies, and the tokens of words met so far."""

    def __init__(self, ranks_file: str, piece_file: str):
        import base64

        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_ = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.opens_token = np.zeros(max(ranks.values()) + 1, bool)
        self.opens_token[[r for b, r in ranks.items() if b[:1] == b" "]] = True
        every = range(self.pieces.get_piece_size())
        self.opens_piece = np.array([self.pieces.id_to_piece(i)[:1] == "▁" for i in every])
        self.is_byte = np.array([self.pieces.is_byte(i) for i in every])
        self.forget()

    def forget(self):
        self.index: dict[str, int] = {}
        self.tokens, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.facts = np.zeros((0, 5), np.int64)        # pieces, byte pieces, characters, symbols, script

    def learn(self, words: list[str]):
        """Encode words not met before, each as it stands after a blank."""
        segments = [w[k:k + SEGMENT] for w in words for k in range(0, len(w), SEGMENT)]
        of = np.repeat(np.arange(len(words)), [-(-len(w) // SEGMENT) for w in words])
        ids, many, _ = encoded(lambda t: self.bytes_.encode_ordinary(" " + t), segments, self.opens_token)
        pieces, parts, at = encoded(self.pieces.encode, segments, self.opens_piece)
        facts = np.zeros((len(words), 5), np.int64)
        facts[:, 0] = np.bincount(of, parts, len(words))
        facts[:, 1] = np.bincount(of[at], self.is_byte[pieces], len(words))
        facts[:, 2] = [len(w) for w in words]
        facts[:, 3] = [len(SYMBOLS.findall(w)) for w in words]
        facts[:, 4] = [script_of(w) for w in words]
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.tokens = np.concatenate([self.tokens, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(of, many, len(words)).astype(np.int64))])
        self.facts = np.concatenate([self.facts, facts])


def encoded(encode, segments: list[str], opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ids of each segment, segment of each id). One call does for all segments, as
    every one opens with a token that begins with its blank; segments that hold the sign
    for blanks themselves are encoded alone."""
    alone = np.array(["▁" in s for s in segments], bool)
    ids = np.array(encode(" ".join(s for s, a in zip(segments, alone) if not a)) if not alone.all() else [], np.int32)
    at = np.cumsum(opens[ids]) - 1
    if len(ids) and at[-1] + 1 != len(segments) - alone.sum() or len(ids) and at[0] < 0:
        alone[:] = True
        ids, at = ids[:0], at[:0]
    at = np.flatnonzero(~alone)[at]
    if alone.any():
        own = [(k, encode(segments[k])) for k in np.flatnonzero(alone).tolist()]
        ids = np.concatenate([ids, *(np.array(e, np.int32) for _, e in own)])
        at = np.concatenate([at, np.repeat([k for k, _ in own], [len(e) for _, e in own])]).astype(np.int64)
        order = np.argsort(at, kind="stable")
        ids, at = ids[order], at[order]
    return ids, np.bincount(at, minlength=len(segments)), at


def repeated_words(w: np.ndarray) -> int:
    """Words within 3-word windows that are found twice or more."""
    if len(w) < 4:
        return 0
    m = int(w.max()) + 1
    if m >= 1 << 21:
        w = np.unique(w, return_inverse=True)[1]
        m = int(w.max()) + 1
    if m < 1 << 21:
        key = (w[:-2] * m + w[1:-1]) * m + w[2:]
    else:
        key = np.unique(w[:-2] * m + w[1:-1], return_inverse=True)[1] * m + w[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key) + 2, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = twice.copy()
    hit[1:] |= twice[:-1]
    hit[2:] |= twice[:-2]
    return int(hit.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


SCHEMA = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "script string, n_tokens long, " + ", ".join(f"{m} double" for m in MEASURES))


def measure_texts(texts: list[str], vocabularies: Vocabularies) -> dict[str, list]:
    """The columns of SCHEMA after ``lang`` for texts (nulls as empty ones)."""
    v = vocabularies
    found = [WORD.findall(t) for t in texts]
    flat = [w for ws in found for w in ws]
    if len(v.index) > REMEMBERED:
        v.forget()
    new = list(dict.fromkeys(w for w in flat if w not in v.index))
    if new:
        v.learn(new)
    w = np.fromiter(map(v.index.__getitem__, flat), np.int64, len(flat))
    n = np.array([len(ws) for ws in found], np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    total = lambda x: np.bincount(doc, x, len(texts)).astype(np.int64)
    pieces, byte_pieces, chars, symbols = (total(v.facts[w, k]) for k in range(4))
    scripts = np.bincount(doc * len(SCRIPTS) + v.facts[w, 4], minlength=len(texts) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
    scripts[:, -1] = 0
    script = [SCRIPTS[k] if row[k] else "NONE" for row, k in zip(scripts, scripts.argmax(1))]

    many = v.ends[w + 1] - v.ends[w]
    tokens = total(many)
    source = np.repeat(v.ends[w] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(w) else w, many) + np.arange(many.sum())
    key = np.sort(np.repeat(doc, many) * len(v.opens_token) + v.tokens[source])
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    run = np.diff(starts, append=len(key))
    bits = np.bincount(key[starts] // len(v.opens_token), run * np.log2(run), len(texts))
    some = np.maximum(tokens, 1)
    cuts = np.cumsum(n)[:-1]
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": [repeated_lines(t) for t in texts],
            "n_repeat_words": [repeated_words(x) for x in np.split(w, cuts)] if len(texts) else [], "script": script,
            "n_tokens": tokens, "chars_per_token": (chars + n) / some, "chars_per_piece": (chars + n) / np.maximum(pieces, 1),
            "byte_share": byte_pieces / np.maximum(pieces, 1), "token_entropy": np.log2(some) - bits / some,
            "log_tokens": np.log2(some)}


def measure(docs: DataFrame, ranks_file: str, piece_file: str) -> DataFrame:
    """SCHEMA for every row. Null texts have no words; an empty one measures zero."""
    lang = F.lower(F.trim(F.col("lang").cast("string"))) if "lang" in docs.columns else F.lit(None).cast("string")
    types = {"n_dup_lines": pa.int64(), "n_repeat_words": pa.int64()}

    def run(batches):
        vocabularies = Vocabularies(ranks_file, piece_file)
        for batch in batches:
            for a, b in chunks(batch.column(2), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                found = measure_texts([t or "" for t in part.column(2).to_pylist()], vocabularies)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c, types.get(k)) for k, c in found.items())],
                    names=["doc_id", "lang", *found])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, SCHEMA)


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def parting(good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, float]:
    """The axis that parts standardised junk from ordinary rows, and the cut along it with
    the fewest rows on the wrong side, in the middle of its gap."""
    cover = np.cov(good.T) + 0.01 * np.eye(good.shape[1])
    axis = np.linalg.solve(cover, -bad.mean(0))
    ours, theirs = np.sort(good @ axis), np.sort(bad @ axis)
    at = np.unique(np.concatenate([ours, theirs]))
    gaps = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2])
    wrong = np.searchsorted(ours, gaps) + len(theirs) - np.searchsorted(theirs, gaps)
    best = np.flatnonzero(wrong == wrong.min())
    return axis, float((gaps[best[0]] + gaps[best[-1]]) / 2)


def bands_of(groups: dict[str, tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
    """A band for every group of (ordinary, junk) rows with enough ordinary ones: ranges,
    and a cut along its own axis, or with little junk along that of all groups, each
    standardised by its own ordinary rows."""
    groups = {k: g for k, g in groups.items() if len(g[0]) >= FEW}
    middle = {k: good.mean(0) for k, (good, _) in groups.items()}
    unit = {k: np.maximum(good.std(0), 1e-9) for k, (good, _) in groups.items()}
    plain = {k: tuple((x - middle[k]) / unit[k] for x in g) for k, g in groups.items()}
    pooled = [np.concatenate(x) for x in zip(*plain.values())] if plain else None
    out = []
    for k, (good, _) in groups.items():
        ours, theirs = plain[k] if len(plain[k][1]) >= FEW_JUNK else pooled
        axis, cut = parting(ours, theirs) if len(theirs) >= FEW_JUNK else (np.zeros(len(MEASURES)), -1.0)
        axis = axis / unit[k]
        low, high = good.min(0) - unit[k], good.max(0) + unit[k]
        out.append((k, *axis.tolist(), float(middle[k] @ axis + cut), *low[:3].tolist(), *high[:3].tolist()))
    return out


def learn_bands(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple]:
    """Bands by language ('lang:xx') and script ('script:X') from labelled rows that pass
    the base rules, but those held out (crc32 of doc_id modulo 4 is 2); equal measures count
    once, so copies weigh nothing. Labels that contradict each other are not used."""
    labelled = labels.where("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("of")).agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    labelled = labelled.where((F.col("quality") == F.col("most")) & (F.crc32(F.col("of").cast("string")) % 4 != 2))
    rows = (measured.where(~base_failed()).join(labelled, F.col("doc_id") == F.col("of"))
            .select("lang", "script", "quality", *MEASURES).distinct()
            .orderBy(F.xxhash64("lang", "script", *MEASURES), *MEASURES).limit(sample).toPandas())
    good = rows["quality"].to_numpy() > 0
    x = rows[MEASURES].to_numpy(float)
    bands = []
    for column in ("lang", "script"):
        bands += bands_of({f"{column}:{name}": (x[at][good[at]], x[at][~good[at]])
                           for name, at in rows.groupby(column).indices.items()})
    return bands


AXIS = [f"axis_{k}" for k in range(len(MEASURES))]
LOW, HIGH = [f"low_{k}" for k in range(3)], [f"high_{k}" for k in range(3)]


def quality_rules(docs: DataFrame, labels: DataFrame | None, ranks_file: str, piece_file: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, band, MEASURES of every row.

    A row is kept if it passes the base rules and lies within the bands of its language,
    else of its script, else (no such bands: few labels, or none) as it is. ``band`` names
    the bands it was held against. Null and empty texts have no words and fail the base
    rules; repeated rows and null ids count as they come; other columns are not read. A
    word of over SEGMENT code points is measured in segments. An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    prepare(spark)
    measured = stored(measure(docs, ranks_file, piece_file), "fertility")
    bands = spark.createDataFrame(learn_bands(measured, labels) if labels is not None else [], ", ".join(
        ["band string", *(f"{c} double" for c in [*AXIS, "cut", *LOW, *HIGH])]))
    known = F.broadcast(bands)                                   # a row a language or script of the sample
    rows = measured.join(known.withColumn("of", F.col("band")), F.concat(F.lit("lang:"), "lang") == F.col("of"), "left")
    for c in ["band", *AXIS, "cut", *LOW, *HIGH]:
        rows = rows.withColumnRenamed(c, "l_" + c)
    rows = rows.drop("of").join(known.withColumnRenamed("band", "of"), F.concat(F.lit("script:"), "script") == F.col("of"), "left")
    use = {c: F.when(F.col("l_band").isNotNull(), F.col("l_" + c)).otherwise(F.col(c)) for c in [*AXIS, "cut", *LOW, *HIGH]}
    along = sum((F.col(m) * use[a] for m, a in zip(MEASURES, AXIS)), F.lit(0.0))
    inside = along >= use["cut"]
    for m, low, high in zip(MEASURES, LOW, HIGH):
        inside &= F.col(m).between(use[low], use[high])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base_failed().alias("base_failed"), (~base_failed() & F.coalesce(inside, F.lit(True))).alias("kept"),
                       F.coalesce("l_band", "of").alias("band"), *MEASURES)
