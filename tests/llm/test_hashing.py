import random

import pyarrow as pa

from sparkrag.llm.hashing import text_slices, word_hashes, words


def hashes(text, lower=False):
    out = []
    for _, _, data, offsets in text_slices(pa.array([text])):
        begin, end, _ = words(data, offsets)
        out += word_hashes(data, begin, end, lower).tolist()
    return out


def test_words_of_a_structured_pair_differ():
    """Such pairs collide under any polynomial modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    assert len(set(hashes(f"{one} {two}"))) == 2


def test_equal_words_and_only_those_are_equal():
    rng = random.Random(1)
    many = ["".join(rng.choice("abcéZ\0") for _ in range(rng.randint(1, 40))) for _ in range(20_000)]
    got = hashes(" ".join(many))
    assert len(set(got)) == len(set(many)) and len(dict(zip(many, got, strict=True))) == len(set(many))
    assert hashes("abcdefgh abcdefghi ABCDEFGHI", True)[1:] == hashes("abcdefghi", True) * 2
    assert hashes("abcdefgh ijklmnop" * 2) == hashes("abcdefgh ijklmnopabcdefgh ijklmnop")
