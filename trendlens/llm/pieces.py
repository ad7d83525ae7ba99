"""SentencePiece BPE encoding by backtracking, and decoding.

BPE of this family merges, again and again, the adjacent pair whose
concatenation is the best-scored piece. A token sequence is the result of that
process exactly if every adjacent pair of tokens is: re-merging the text of the
pair gives the pair back. The encoder therefore walks left to right, takes the
longest piece that starts at the position (Aho-Corasick matches), checks it
against the previous token, tries shorter ones, and steps back when none fits;
a bitfield remembers positions from which the rest cannot be encoded, so every
position fails at most once.

No piece continues over a word start or joins letters to other signs (both are
read off the model), so a text is encoded word by word and repeated words are
looked up.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing

SPACE = "▁"


def merge_pieces(text: str, score: dict[str, float]) -> list[str]:
    """The merge process itself: best score first, leftmost on a tie."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class PieceEncoder:
    """Encoder for one model file; holds its tables and two bounded memories (of
    words and of token pairs) that are emptied when full."""

    def __init__(self, model_file: str, memory: int = 400_000):
        import ahocorasick
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        self.memory = memory
        self.bytes = {int(m.id_to_piece(i)[1:-1], 16): i for i in range(n) if m.is_byte(i)}
        special = {i for i in range(n) if m.is_byte(i) or m.is_control(i) or m.is_unknown(i)
                   or m.is_unused(i)}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in range(n) if i not in special}
        self.piece_id = {p: m.piece_to_id(p) for p in self.score}
        self.chars = {p for p in self.score if len(p) == 1}
        self.unknown = m.unk_id()
        self.listed = re.escape("".join(sorted(self.chars)))
        if any(SPACE in p.lstrip(SPACE) for p in self.score) or any(
                c not in self.chars for p in self.score for c in p):
            raise ValueError("pieces over word starts or of unlisted characters are not supported")
        self.probe()
        self.width = np.uint16 if n <= 1 << 16 else np.uint32
        self.raw = {p: self.width(i).tobytes() for p, i in self.piece_id.items()}
        self.last_merge: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if self.reachable(p):                          # others never come out of the merging
                self.automaton.add_word(p, p)
        # the next shorter piece that starts alike, "" if there is none
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.automaton), "")
                        for p in self.automaton}
        self.automaton.make_automaton()
        self.longest_piece = max(map(len, self.score))
        self.fits: dict[str, dict[str, bool]] = {}
        self.n_fits = 0
        self.words = _Words(self)
        joined = "".join(sorted(self.joined_to("a")))
        own, rest = f"[{re.escape(joined)}]+", f"[^{re.escape(joined)}{SPACE}]+"
        self.units = re.compile(f"{SPACE}*(?:{own}|{rest})|{SPACE}+" if joined else f"{SPACE}*{rest}|{SPACE}+").findall

    def joined_to(self, char: str) -> set[str]:
        """Characters linked to ``char`` by neighbourhood inside any piece; no piece
        holds one of them next to another character, but for the space mark."""
        near: dict[str, set[str]] = {}
        for p in self.score:
            p = p.lstrip(SPACE)
            for x, y in zip(p, p[1:]):
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
        found, ahead = set(), [char] if char in near else []
        while ahead:
            x = ahead.pop()
            if x not in found:
                found.add(x)
                ahead += near[x]
        return found

    def reachable(self, piece: str) -> bool:
        """Whether merging the characters of ``piece`` ends in it; notes the last merge."""
        parts = list(piece)
        while len(parts) > 1:
            found = [(-s, i) for i in range(len(parts) - 1)
                     if (s := self.score.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                return False
            i = min(found)[1]
            if len(parts) == 2:
                self.last_merge[piece] = (parts[0], parts[1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return True

    def probe(self) -> None:
        """The model must keep every character and put one space in front."""
        for text in ("a  b ", " x\ty\n z", "ﬁ①Ａ", " "):
            if self.model.normalize(text) != SPACE + text.replace(" ", SPACE):
                raise ValueError("models that rewrite characters are not supported")

    def compatible(self, a: str, b: str) -> bool:
        """Whether re-merging the characters of a + b gives a and b again.

        The merges of both are replayed backwards along the boundary, the later
        one first: had the two parts that met there a better merge than the one
        that came next, it would have happened instead. Equal scores depend on
        positions, so these are left to the merge process itself.
        """
        score, split = self.score, self.last_merge
        x, y, bound = a, b, float("-inf")
        while True:
            s = score.get(x + y)
            if s is not None:
                if s == bound:
                    return merge_pieces(a + b, score) == [a, b]
                if s > bound:
                    return False
            sx = score[x] if x in split else None
            sy = score[y] if y in split else None
            if sx is None and sy is None:
                return True
            if sx is not None and sx == sy:
                return merge_pieces(a + b, score) == [a, b]
            if sy is None or sx is not None and sx < sy:
                bound, x = sx, split[x][1]
            else:
                bound, y = sy, split[y][0]

    def longest(self, text: str, pos: int) -> str:
        """The automaton's longest match from ``pos`` on, "" if there is none."""
        window = text[pos:pos + self.longest_piece]
        window = window[:self.automaton.longest_prefix(window)]    # a path of the automaton,
        while window and window not in self.shorter:               # down to its last piece
            window = window[:-1]
        return window

    def fit(self, a: str, b: str) -> bool:
        if self.n_fits >= self.memory:
            self.fits, self.n_fits = {}, 0
        self.n_fits += 1
        found = self.fits.setdefault(a, {})[b] = self.compatible(a, b)
        return found

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all pieces."""
        n = len(text)
        open_ = bytearray(b"\1") * (n + 1)                 # positions that are not known to fail
        tokens: list[str] = []
        shorter, fit, longest = self.shorter, self.fit, self.longest
        pos, piece, known = 0, longest(text, 0), None
        while pos < n:
            while piece:
                if open_[pos + len(piece)]:
                    if known is None:
                        break
                    ok = known.get(piece)
                    if ok or ok is None and fit(tokens[-1], piece):
                        break
                piece = shorter[piece]
            if piece:
                tokens.append(piece)
                pos += len(piece)
                known = self.fits.get(piece, _NONE)
                piece = longest(text, pos)
            else:
                if not tokens:
                    raise ValueError("no encoding")
                open_[pos] = 0
                piece = tokens.pop()
                pos -= len(piece)
                known = self.fits.get(tokens[-1], _NONE) if tokens else None
        return tokens

    def word_ids(self, word: str) -> bytes:
        """Ids of a word, as the bytes of an array."""
        if self.chars.issuperset(word):
            return b"".join([self.raw[p] for p in self.backtrack(word)])
        out = []
        for known, other in re.findall(f"([{self.listed}]+)|(.)", word, re.S):
            if known:
                out += [self.raw[p] for p in self.backtrack(known)]
            else:                                          # an unlisted character joins nothing
                ids = [self.bytes.get(b, self.unknown) for b in other.encode()] if self.bytes else [self.unknown]
                out.append(np.asarray(ids, self.width).tobytes())
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.width)
        words = self.units(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), self.width)


class _Words(dict):
    """word -> ids as bytes; emptied when it holds ``memory`` words. Words over 64
    characters are not kept, others from their second time on: most words of a large
    collection come once (a mark is shared by words of one hash, which only keeps more)."""

    MARKS = 1 << 21

    def __init__(self, encoder: PieceEncoder):
        self.encoder = encoder
        self.marks = bytearray(self.MARKS)

    def __missing__(self, word: str) -> bytes:
        got = self.encoder.word_ids(word)
        if len(self) >= self.encoder.memory:
            self.clear()
            self.marks = bytearray(self.MARKS)
        if len(word) <= 64:
            at = hash(word) % self.MARKS
            if self.marks[at]:
                self[word] = got
            else:
                self.marks[at] = 1
        return got


_NONE: dict[str, bool] = {}
_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_of(model_file: str) -> PieceEncoder:
    """One encoder per Python worker and model."""
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = PieceEncoder(model_file)
    return _ENCODERS[model_file]


def encode_and_decode(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, piece_ids array<int>, decoded string) of every whole text, without
    begin or end ids; ``decoded`` is the library's decoding of the ids.

    A null text counts as empty: no ids, empty decoding. Rows are kept as they
    come (repeated or null ids too); other columns are not read. An empty
    table gives an empty table. Map-only: no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(model_file)
        for batch in batches:
            ids, texts, doc_ids, size = [], [], [], 0
            for d, text in zip(batch.column(0), batch.column(1)):
                got = e.encode(text.as_py() or "")
                doc_ids.append(d.as_py())
                ids.append(got)
                texts.append(e.model.decode(got.tolist()) if len(got) else "")
                size += len(got)
                if size >= 1 << 18:
                    yield _batch(doc_ids, ids, texts)
                    ids, texts, doc_ids, size = [], [], [], 0
            if doc_ids:
                yield _batch(doc_ids, ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        releasing(run), "doc_id long, piece_ids array<int>, decoded string")


def _batch(doc_ids: list, ids: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.concatenate(ids).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
         pa.array(texts, pa.string())], names=["doc_id", "piece_ids", "decoded"])


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encode_and_decode``."""
    return encoded.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
