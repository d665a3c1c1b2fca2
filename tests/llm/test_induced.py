import numpy as np
import pytest

from touchtally.llm import induced as I


def plain(text, cap):
    data = text.tolist()
    order = sorted(range(len(data)), key=lambda i: data[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and a + k < len(data) and b + k < len(data) and data[a + k] == data[b + k]:
            k += 1
        shared.append(k)
    return order, shared


@pytest.mark.parametrize("seed", range(30))
def test_against_sorting(seed):
    rng = np.random.default_rng(seed)
    n, letters = int(rng.integers(1, 400)), int(rng.integers(1, 9))
    text = rng.integers(0, letters, n).astype(np.uint16)
    if seed % 3 == 0:
        text = np.tile(text[: max(1, n // 4)], 4)
    if seed % 5 == 0:
        text = np.sort(text)
    order, shared = I.suffix_array(text, cap=20, memory=64 if seed % 2 else 1 << 20)
    expect, common = plain(text, 20)
    assert order.tolist() == expect
    assert shared.tolist() == common


def test_recursion_on_disk(monkeypatch):
    monkeypatch.setattr(I, "IN_MEMORY", 4)
    monkeypatch.setattr(I, "BLOCK", 7)
    rng = np.random.default_rng(5)
    for _ in range(10):
        text = rng.integers(0, 4, 300).astype(np.uint16)
        order, shared = I.suffix_array(text, cap=50, memory=100)
        assert (order.tolist(), shared.tolist()) == plain(text, 50)


def test_empty():
    assert len(I.suffix_array(np.zeros(0, np.uint16))[0]) == 0


def test_working_memory_a_symbol():
    """Arrays of positions and letters are four bytes wide; those of eight took over 30 bytes a symbol at once."""
    import tracemalloc

    text = np.random.default_rng(5).integers(1, 25, 1 << 20).astype(np.uint16)
    tracemalloc.start()
    I.smaller_types(text)
    assert tracemalloc.get_traced_memory()[1] < 16 * len(text)
    tracemalloc.reset_peak()
    I.Prefixes(text, 400)
    assert tracemalloc.get_traced_memory()[1] < 14 * len(text)
    tracemalloc.stop()
