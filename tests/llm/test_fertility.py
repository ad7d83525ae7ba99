"""Tokeniser fertility: base rules and measures against plain code, bands on invented rows."""
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from trendlens.llm import fertility
from trendlens.llm.queries import tokenizer_file

FILES = tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("piece_bpe_32k.model")
RNG = random.Random(3)
WORDS = "the of and to in is it was for that this house river stone light winter morning walked quietly towards".split()
PROSE = lambda n: " ".join(RNG.choice(WORDS) for _ in range(n)) + ".\n"
TEXTS = [None, "", " \t\n\x0b\x0c\r ", "one", "a b c a b c", PROSE(60) * 2, "#1 *2 $%&|<> x\n\n#1 *2\n #1 *2\n#1 *2", "x" * 70_000,
         "ab cd ▁▁ ▁x 　   z\u0085y", "日本語 テスト ελληνικά русский 😀 ﬁ ünï\x00cödé " * 30, "\n".join(["same line"] * 40),
         PROSE(30_000), "▁ " * 50, "don't  we'll\r\nI'd 12345 --- ..."]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(hit)}


def plain_measures(text, v):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    parts = [w[k:k + 256] for w in words for k in range(0, len(w), 256)]
    tokens = [t for p in parts for t in v.bytes_.encode_ordinary(" " + p)]
    pieces = [t for p in parts for t in v.pieces.encode(p)]
    n = max(1, len(tokens))
    entropy = math.log2(n) - sum(c * math.log2(c) for c in Counter(tokens).values()) / n
    chars = sum(map(len, words)) + len(words)
    return [chars / n, chars / max(1, len(pieces)), sum(v.pieces.is_byte(p) for p in pieces) / max(1, len(pieces)), entropy]


def test_rules_and_measures_against_plain_code(spark):
    rows = [(i, t, "en", "x", 1) for i, t in enumerate(TEXTS)] + [(None, "one", None, "x", 1), (3, "one", " EN ", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, band string, n_words int")
    got = fertility.quality_rules(docs, None, *FILES).collect()
    assert len(got) == len(rows)
    v = fertility.Vocabularies(*FILES)
    for r in got:
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "one"
        want = plain(text)
        assert {k: r[k] for k in want} == want, text[:50]
        assert [r[m] for m in fertility.MEASURES[:4]] == pytest.approx(plain_measures(text, v))
        assert r["base_failed"] == (want["n_words"] < 50 or 2 * want["n_repeat_words"] > want["n_words"])
        assert r["kept"] == (not r["base_failed"]) and r["band"] is None


def test_forgetting_and_blocks_change_nothing(monkeypatch):
    v = fertility.Vocabularies(*FILES)
    texts = [t or "" for t in TEXTS]
    whole = fertility.measure_texts(texts, v)
    monkeypatch.setattr(fertility, "REMEMBERED", 2)
    each = [fertility.measure_texts([t], v) for t in texts]
    for k, column in whole.items():
        assert list(column) == [e[k][0] for e in each], k
    assert fertility.measure_texts([], v)["n_words"].tolist() == []


def test_scripts_by_their_letters():
    assert [fertility.SCRIPTS[fertility.script_of(w)] for w in ("42a", "-", "éa", "λ", "日", "ж9", "ᚠ")] == [
        "LATIN", "NONE", "LATIN", "GREEK", "CJK", "CYRILLIC", "OTHER"]
    assert all(unicodedata.name(c).startswith(s) for c, s in (("λ", "GREEK"), ("ж", "CYRILLIC")))


def test_repeats_of_many_words():
    big = np.arange(0, 1 << 23, 1 << 12) + (1 << 22)
    assert fertility.repeated_words(np.concatenate([big, [5, 6, 7], big[:3], [8, 9]])) == 6
    assert fertility.repeated_words(np.array([1, 1, 1, 1])) == 4 and fertility.repeated_words(np.array([1, 1, 1])) == 0


def test_bands_reject_junk_of_each_language(spark):
    rng = random.Random(5)
    parts = {"en": "the ing and er tion ly re hou ed st".split(), "zz": "ko ru mi na shi ta wo yu ha ne".split()}

    def text(lang, junk):
        word = lambda: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3)))
        return " ".join(word() + (rng.choice(["***", "%%%", "$$$"]) if junk else "") for _ in range(rng.randint(60, 200)))
    rows, labels = [], []
    for i in range(700):
        lang, junk = ("en", "zz")[i % 2], i % 5 == 0
        rows.append((i, text(lang, junk), lang))
        labels.append((i, int(not junk)))
    rows += [(700, text("en", True), None), (701, text("en", False), "new"), (702, None, "en"), (703, "", "en")]
    rows += [(800 + i, rows[1][1], "zz") for i in range(300)]               # a large group of copies
    labels += [(800 + i, 1) for i in range(300)] + [(1, None), (2, 0), (None, 1)]     # one contradicts
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in fertility.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int"), *FILES).collect()}
    wrong = [i for i in range(700) if got[i]["kept"] != (i % 5 != 0) and not got[i]["base_failed"]]
    assert len(wrong) < 10
    assert all(got[800 + i]["kept"] for i in range(300))
    assert got[700]["band"] == got[701]["band"] == "script:LATIN" and not got[702]["kept"] and not got[703]["kept"]
    none = fertility.quality_rules(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"), *FILES)
    assert none.count() == 0
