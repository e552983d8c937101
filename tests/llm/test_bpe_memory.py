"""Long texts without blanks through the digest: the library's ids, and ids that never gather."""

import hashlib
import random
import tracemalloc

import pytest
from tokenizers import Tokenizer

from sandglass.llm import bpe_stream, token_files


@pytest.fixture(scope="module")
def path(spark):
    return token_files.tokenizer_path(spark, "word_bpe_49k.json")


def made(kind, n, seed=1):
    rng = random.Random(seed)
    letters = {
        "latin": "abcdefghij", "cjk": [chr(c) for c in range(0x4E00, 0x4F00)], "mixed": [*"abc12.,!'é", "日", "本", "é", "́", "ﬁ", "<"],
        "digits": "0123456789", "marks": [*"<|end>", "<|endoftext|>", "日", "7", "x"],
    }[kind]
    return "".join(rng.choices(letters, k=n))


@pytest.mark.parametrize("kind", ["latin", "cjk", "mixed", "digits", "marks"])
def test_equals_the_library_beyond_a_slice(path, kind, monkeypatch):
    monkeypatch.setattr(bpe_stream, "SLICE", 500)  # so that the library has little to do
    tok, own = Tokenizer.from_file(path), bpe_stream.codec(path)
    tok.no_truncation()
    for seed in range(3):
        text = made(kind, 6000, seed) + " and " + made(kind, 300, seed + 9)
        ids = tok.encode(text, add_special_tokens=False).ids
        n, shown, told = own.digest(text)
        assert (n, shown) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert told == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("kind", ["latin", "cjk", "mixed"])
def test_ids_do_not_gather(path, kind):
    own = bpe_stream.codec(path)
    own.digest(made(kind, 1000))
    peaks, most = [], []
    for n in (150_000, 600_000):
        text, sizes = made(kind, n), []
        trip = own.encode
        tracemalloc.start()
        trip(text, lambda ids: sizes.append(len(ids)))
        peaks.append(tracemalloc.get_traced_memory()[1] / len(text.encode()))
        tracemalloc.stop()
        most.append(max(sizes))
    assert max(most) <= 2 * bpe_stream.SLICE + bpe_stream.HELD and (kind == "mixed" or max(most) < 2 * bpe_stream.HELD)
    assert peaks[1] < 16  # bytes beside each byte of text: copies of it, no ids
