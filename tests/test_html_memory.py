"""Pages are read and freed one by one."""
import gc

import pyarrow as pa

from trendlens.operators import html


def test_trees_are_freed_at_once():
    page = "<html><body><article>" + "<div><p>text</p></div>" * 50 + "</article></body></html>"
    gc.collect()
    gc.disable()
    try:
        for _ in range(20):
            assert html.extract_one(page, html.TEST_PROFILE_RULES)[1] == "article_p"
        assert gc.collect() < 100
    finally:
        gc.enable()


def test_batches_leave_in_slices():
    n = 3 * html.SLICE_ROWS + 1
    batch = pa.RecordBatch.from_pydict({"web_url": [str(i) for i in range(n)], "html": ["<nyt_text>x</nyt_text>", None, ""] * (n // 3) + [None] * (n % 3)})
    out = list(html.bodies_in()(iter([batch])))
    assert max(b.num_rows for b in out) == html.SLICE_ROWS
    rows = [r for b in out for r in b.to_pylist()]
    assert rows[0] == {"web_url": "0", "body": "x", "rule": "nyt_text"} and rows[1]["body"] == "" and rows[1]["rule"] is None and len(rows) == n
