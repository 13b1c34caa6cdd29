import random

import numpy as np
import pyarrow as pa

from pairmill.llm import common
from pairmill.llm.common import Words, bites
from tests.llm.helpers import EDGE, WORD, low


def test_words_equal_the_plain_split(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("aAbé 日\t\n.-", k=rng.randrange(60))) for _ in range(300)] + [t for _, t, _ in EDGE]
    for step in (64, 1 << 20):  # slabs cut inside and outside of texts
        monkeypatch.setattr(common, "_STEP", step)
        w = Words(pa.array(texts, pa.string()))
        seen = {}
        for r, t in enumerate(texts):
            want = WORD.findall(low(t))
            assert w.ptr[r + 1] - w.ptr[r] == len(want)
            for h, x in zip(w.hash[w.ptr[r] : w.ptr[r + 1]].tolist(), want, strict=True):
                assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)


def test_grams_of_short_rows():
    w = Words(pa.array(["a b c d e f", "a b", "", "b a", None, "a b"]))
    g, ptr = w.grams(5)
    assert np.diff(ptr).tolist() == [2, 1, 0, 1, 0, 1]
    assert g[2] == g[4] and g[2] != g[3]


def test_bites_keep_all_rows():
    b = pa.RecordBatch.from_pydict({"id": list(range(100)), "text": ["x" * (k * 37 % 91) if k % 7 else None for k in range(100)]})
    parts = list(bites([b, b.slice(0, 0)], size=100))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(100))
