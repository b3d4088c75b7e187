"""A worker's memory of words in op7: what stays when it is full, and that samples do not depend on it."""

import random

import numpy as np

from quillwork.llm import segmentation_sampling as S
from quillwork.llm.unigram import public_pieces


def test_words_that_came_again_stay(monkeypatch):
    lattice = S.Lattice(public_pieces())
    lattice.learn(["▁often", "▁once", "▁日本ü\U0001f600"])
    lattice.learn(["▁often", "▁日本ü\U0001f600"])
    monkeypatch.setattr(S, "MEMORY", 2 * len(lattice.to) - 2)
    lattice._forget_rare()
    assert set(lattice.words) == {"▁often", "▁日本ü\U0001f600"}
    lattice._forget_rare()  # neither came again since
    assert not lattice.words


def test_samples_do_not_depend_on_memory(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé日\U0001f600", k=rng.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(60)]
    found = []
    for memory in (S.MEMORY, 2500):
        monkeypatch.setattr(S, "MEMORY", memory)
        monkeypatch.setattr(S, "TOGETHER", 3)
        rows = S.Sampler(public_pieces()).samples(list(range(60)), texts, 3)
        found.append([(i, n, ids.tolist(), lp, g, inclusion, same) for i, n, ids, lp, g, inclusion, same in rows])
    assert found[0] == found[1] and all(r[-1] for r in found[0]) and np.isfinite([r[3] for r in found[0]]).all()
