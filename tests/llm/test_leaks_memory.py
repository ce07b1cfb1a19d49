"""What the passage search keeps in memory."""

import random
import tracemalloc

import pyarrow as pa

from pointstrata.llm import qgram_leaks as leaks


def test_search_of_a_batch_is_bounded(monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(20)]
    texts = [" ".join(rng.choices(words, k=100)) for _ in range(8000)]
    for i in range(0, 8000, 400):
        texts[i] += " " + items[i // 400][1]
    index, batch = leaks.index_of(items), pa.array(texts, pa.large_string())
    tracemalloc.start()
    found = leaks.find(batch, index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(r, item) for r, item, *_ in found} == {(i, i // 400) for i in range(0, 8000, 400)}
    assert peak < 100 << 20
    monkeypatch.setattr(leaks, "PIECE", 500)  # counts of many pieces add up to those of one
    assert leaks.find(batch, index) == found
