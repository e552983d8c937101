"""Missing words reach the tokenizers library many at once, with the ids they have in whole texts."""

import random

from sandglass.llm import token_files


class Counted:
    def __init__(self, own):
        self.own, self.calls = own, 0

    def encode_batch_fast(self, *args, **how):
        self.calls += 1
        return self.own.encode_batch_fast(*args, **how)


def test_words_are_learned_together():
    import public_tokenizers

    rnd = random.Random(3)
    enc = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), limit=2000)
    texts = []
    for _ in range(40):
        words = ["".join(rnd.choices("abcdeioustéñßøŁĠĊž", k=rnd.randrange(1, 12))) + rnd.choice(["", "", ",", ".", "-x", "7", "..", "'s"]) for _ in range(300)]
        texts.append("".join(w + rnd.choice(" \n") for w in words) + "end")
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    enc.splits = Counted(enc.splits)
    for at in range(0, 40, 10):
        assert [x.tolist() for x in enc.encode(texts[at : at + 10])] == want[at : at + 10]
    assert 4 <= enc.splits.calls <= 12
    assert [x.tolist() for x in enc.encode(["", None, "a", "a, b", "Ġ.\nĊ,", "x."])] == [enc.tok.encode(t, add_special_tokens=False).ids for t in ("", "", "a", "a, b", "Ġ.\nĊ,", "x.")]
