"""What the workers of the text stages hold, during a task and after it."""
import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa

from trendlens.llm import common, fmindex, pieces
from trendlens.llm.queries import tokenizer_file


def test_a_shard_holds_numbers_in_place_of_words():
    rng = random.Random(4)
    n_words = 200_000
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(1000)) for _ in range(n_words // 1000)]
    texts[7] += " one two three four five six seven eight nine ten"
    items = SimpleNamespace(value=[("b1", "one two three four five six seven eight nine ten")])
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 50)), pa.array(texts[i:i + 50])], names=["doc_id", "text"])
               for i in range(0, len(texts), 50)]
    search = fmindex._searcher(items, 10, fmindex.SHARD_WORDS, False)
    list(search(iter(batches[:1])))                         # imports
    tracemalloc.start()
    found = pa.Table.from_batches(search(iter(batches))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["doc_id"] for r in found if r["items"]] == [7] and sum(r["n_words"] for r in found) == n_words + 10
    assert peak < 30 * n_words                              # a list of the words takes over 40 bytes for each


def test_words_that_come_once_are_not_remembered():
    e = pieces.PieceEncoder(tokenizer_file("piece_bpe_32k.model"))
    text = " ".join(f"word{i}" for i in range(2000))
    first = e.encode(text).tolist()
    assert first == e.model.encode(text) and len(e.words) < 100
    assert e.encode(text).tolist() == first and len(e.words) > 1900
    assert e.encode(text).tolist() == first


def test_arrow_batches_are_bounded_in_bytes(spark):
    common.prepare(spark)
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat('abcdefgh', 16384) AS text")      # 128 KB each

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])
    got = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 400 and max(got) <= common.BATCH_BYTES // (8 * 16384) + 1


def test_memory_is_released_at_the_end_of_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    run = common.releasing(lambda batches: (b for b in batches))
    made = run(iter([1, 2]))
    assert next(made) == 1 and not calls
    assert list(made) == [2] and calls == [1]
