import random

import numpy as np
import pyarrow as pa
from logweave.llm import textkernel as tk
from logweave.llm.graph import connected_components
from logweave.llm.suffix_dedup import Plan, anchors


def test_words_and_hashes_do_not_depend_on_place(monkeypatch):
    texts = ["Ab  c\tÉ d", None, "", " x ", "ab c", "q" * 3_000_000 + " ab", "\x0bAB\x0c"]
    buf, offsets = tk.utf8(pa.array(texts))
    w = tk.Words(buf, offsets)
    found = [[bytes(w.buf[a:b]) for a, b in zip(w.starts[f:g], w.ends[f:g])] for f, g in zip(w.first[:-1], w.first[1:])]
    assert found == [[b"ab", b"c", "É".encode(), b"d"], [], [], [b"x"], [b"ab", b"c"], [b"q" * 3_000_000, b"ab"], [b"ab"]]
    assert w.hashes[0] == w.hashes[5] == w.hashes[8] == w.hashes[9] and len(set(w.hashes.tolist())) == 6


def test_sliced_columns():
    whole = pa.array(["zero", "one two", None, "three"])
    buf, offsets = tk.utf8(whole.slice(1, 3))
    assert bytes(buf) == b"one twothree" and offsets.tolist() == [0, 7, 7, 12]


def test_every_window_has_an_anchor_that_equal_windows_share():
    rnd, plan = random.Random(4), Plan(100)
    window = bytes(rnd.randrange(97, 123) for _ in range(100))
    where = []
    for _ in range(5):
        before = bytes(rnd.randrange(97, 123) for _ in range(rnd.randrange(300)))
        text = before + window + bytes(rnd.randrange(97, 123) for _ in range(200))
        buf = np.frombuffer(text, np.uint8)
        _, pos, kh, _ = anchors(buf, np.array([0, len(buf)]), plan)
        inside = [(p - len(before), int(h)) for p, h in zip(pos.tolist(), kh.tolist()) if len(before) <= p <= len(before) + 100 - plan.gram]
        where.append(set(inside))
        assert max(np.diff(pos)) <= plan.span
    assert set.intersection(*where)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 180)] + [(200, 200), (300, None), (5, 4), (400, 399)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 180)} | {399: 399, 400: 399}
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in want.items() if k != v}
