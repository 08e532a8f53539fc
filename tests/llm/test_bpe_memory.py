"""What a worker keeps of the words that it has met, and of what it has freed."""

import gc
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tessera.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def lib():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(4, 9))) for _ in range(n)]


def test_met_words_take_little_memory(lib):
    """Under 100 bytes a word: a dictionary of strings and bytes took 124."""
    c = bpe.Codec(bpe.load_ranks(PATH))
    ws = words(20_000, 1)
    gc.collect()
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        got = c.encode(pa.array([ws]))
        assert got == [b"".join(np.array(lib.encode_ordinary(w), "<u4").tobytes() for w in ws)]
        del got
        gc.collect()
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert held < 100 * len(set(ws)), held / len(set(ws))


def test_forgotten_words_are_coded_again(lib, monkeypatch):
    """A memory of few words or bytes, words longer than it, tokens, and lists that are null, empty and sliced."""
    for known, memo in ((50, 1 << 20), (1 << 20, 1000), (0, 0)):
        monkeypatch.setattr(bpe, "KNOWN", known)
        monkeypatch.setattr(bpe, "MEMO", memo)
        c = bpe.Codec(bpe.load_ranks(PATH))
        for k in range(4):
            texts = [[*words(60, k % 2), " the", "of", "x" * 1500, "é", "🎉"], None, [], words(60, k), ["the"] * 5]
            want = [b"".join(np.array(lib.encode_ordinary(w), "<u4").tobytes() for w in t or []) for t in texts]
            assert c.encode(pa.array(texts, pa.list_(pa.string()))) == want
            assert c.encode(pa.array(texts, pa.list_(pa.string())).slice(2, 2)) == want[2:4]
            assert len(c.known) == len(c.ids) <= known and c.known.nbytes + c.ids.nbytes <= memo + 64
        assert c.encode(pa.array([], pa.list_(pa.string()))) == []


def test_freed_memory_goes_back():
    """Arrays of small pieces below one that stays, as a batch leaves them."""
    from tessera.session import give_back

    def anonymous() -> float:
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nAnonymous:\s+(\d+)", f.read()).group(1)) / 1024

    many = [np.ones(8000) for _ in range(1600)]
    stays = np.ones(8000)
    del many
    before = anonymous()
    give_back()
    assert before - anonymous() > 50 and stays.sum() == 8000
