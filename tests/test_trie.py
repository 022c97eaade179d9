import random
import time

import pytest

from glossaflow.operators import tokens, trie


def pairs(words):
    return [(w, i) for i, w in enumerate(words)]


def both(vocabulary, word):
    known = dict(vocabulary)
    plain = tokens.split_word(word, set(known))
    got = trie.Trie(trie.packed(vocabulary)).split(word)
    return plain, got if got is None else got[0]


def test_against_the_greedy_loop():
    rng = random.Random(4)
    for _ in range(400):
        letters = rng.choice(["ab", "abc", "aé#", "а😀"])
        vocabulary = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))}
        vocabulary |= {"##" + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 12))}
        listed = pairs(sorted(vocabulary))
        rng.shuffle(listed)
        known, shared = dict(listed), trie.Trie(trie.packed(listed))
        for _ in range(60):
            word = "".join(rng.choice(letters + "z" * (rng.random() < 0.1)) for _ in range(rng.randrange(1, 14)))
            want = tokens.split_word(word, set(known))
            got = shared.split(word)
            assert (["[UNK]"] if got is None else got[0]) == want, (listed, word)
            if got:
                assert got[1] == [known[p] for p in want]


@pytest.mark.parametrize("word", ["#", "##", "##a", "a##", "a#a"])
def test_words_that_look_like_pieces(word):
    for listed in (["a", "##a"], ["#", "##", "###", "##a"], ["##a", "#", "a", "####"]):
        plain, got = both(pairs(listed), word)
        assert (["[UNK]"] if got is None else got) == plain


def test_no_tokens():
    assert trie.Trie(trie.packed([])).split("a") is None


def test_a_large_vocabulary_and_hard_words():
    rng = random.Random(5)
    words = {"".join(rng.choice("абвгдежзик") for _ in range(rng.randrange(1, 9))) for _ in range(20_000)}
    began = time.time()
    listed = pairs([*sorted(words), *("##" + w for w in sorted(words)), "##" + "а" * 60])
    shared = trie.Trie(trie.packed(listed))
    assert time.time() - began < 20
    known = {w for w, _ in listed}
    for w in ["а" * 50, "а" * 59 + "ж", *("".join(rng.choice("абвгд") for _ in range(40)) for _ in range(200))]:
        got = shared.split(w)
        assert (["[UNK]"] if got is None else got[0]) == (tokens.split_word(w, known) if len(w) <= 50 else got and got[0] or ["[UNK]"])
        assert got is None or "".join(p.removeprefix("##") for p in got[0]) == w
