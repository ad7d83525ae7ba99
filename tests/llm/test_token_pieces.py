"""Pieces of all texts of a batch, found together, are whole pretokens."""
import random

import pyarrow as pa

from trendlens.llm import bitpack
from trendlens.llm.queries import tokenizer_file


def test_pieces_are_found_for_all_texts_at_once():
    rng = random.Random(4)
    parts = ["ab", "A1", "'s", "don't", ",", " ", "  ", "\n", "\r\n", "\t", "ét", "日", "-", "\x1c", "\x7f", "9"]
    texts = ["", " ", "\n"] + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(400)]
    coded, ends = bitpack.pieces(pa.array(["x", *texts, " y"], pa.large_string())[1:-1])
    found = coded.to_pylist()
    e = bitpack.encoder_of(tokenizer_file("byte_bpe_50k.json"))
    start = 0
    for text, end in zip(texts, ends):
        own = found[start:end]
        # whole pretokens, none left out, and never more pieces than pretokens
        ids = [i for w in own for i in e.tokenizer.encode(w, add_special_tokens=False).ids]
        assert "".join(own) == text and ids == e.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(own) <= len(e.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        start = end
