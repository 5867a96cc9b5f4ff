"""What scoring looks up: hashes of words, and a state's arcs."""

import numpy as np

from rasterloom.llm import lm
from rasterloom.llm import text as T


def test_words_hash_as_sums_over_their_bytes():
    rng = np.random.default_rng(3)
    letters = list("abZ \t\n\x0b\x0c\r\x1f　é.")
    texts = ["", "  ", " a", "a ", "y" * 31 + " " + "z" * 32 + " " + "w" * 33 + "  " + "Q" * 500, *("".join(rng.choice(letters, n)) for n in (5, 40, 300, 3000))]
    for t in texts:
        words = t.encode().lower().split()
        place = [np.arange(len(w), dtype=np.uint64) for w in words]
        want = [T.mix(T.mix(T._VALUE[np.frombuffer(w, np.uint8)] + p * T._STEP).sum(keepdims=True))[0] for w, p in zip(words, place)]
        assert T.word_hashes(t).tolist() == want
    # white space counts nothing, so no text needs to be closed up before it is hashed
    assert not T._PLACED.reshape(-1, 256)[:, T._SPACE].any()


def test_arcs_are_found_within_their_state():
    texts = ["a b a c a d a e a f", "a b c", "", "x a b a c q", "b b b b"]
    grams = lm.Grams(texts, np.array([1.0, 1.0, 1.0, 0.0, 1.0]), 3)
    for k in range(3):
        grams.collect(k)
    m = lm.Automaton(grams, lm.Stats(20, 7, 3, 1))
    states, tokens = (v.ravel() for v in np.meshgrid(np.arange(len(m.fail)), np.arange(m.words), indexing="ij"))
    where = {int(k): i for i, k in enumerate(m.arc)}
    want = [where.get(int(s) * m.words + int(t), -1) for s, t in zip(states, tokens)]
    assert m.arcs(states, tokens).tolist() == want and max(want) == len(m.arc) - 1
    empty = lm.Grams([""], np.array([0.0]), 3)
    for k in range(3):
        empty.collect(k)
    assert lm.Automaton(empty, lm.Stats()).walk().tolist() == [0.0]
