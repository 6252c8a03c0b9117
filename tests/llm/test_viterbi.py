"""The blocked search against a word-by-word one, rows shorter and longer than a block, ties included."""

import numpy as np
import pytest

from tsfoundry.llm import language


def plain(scores, switch):
    """Best path of one row; a tie keeps the language, or takes the first."""
    d, back = np.zeros(scores.shape[1]), []
    for s in scores:
        top = int(d.argmax())
        stay = d >= d[top] - switch
        back.append([k if stay[k] else top for k in range(len(d))])
        d = np.where(stay, d, d[top] - switch) + s
    path, state = [], int(d.argmax())
    for came in reversed(back):
        path.append(state)
        state = came[state]
    return path[::-1]


@pytest.mark.parametrize("width", [1, 2, 4, 7])
@pytest.mark.parametrize("block", [1, 5, 64])
def test_blocks_equal_word_by_word(monkeypatch, width, block):
    monkeypatch.setattr(language, "BLOCK", block)
    rng = np.random.default_rng(width * 100 + block)
    lengths = np.array([0, 1, 63, 64, 65, 128, 129, 700, 0, 5])
    off = np.concatenate(([0], np.cumsum(lengths)))
    scores = -(rng.integers(0, 25, (off[-1], width)) / 4).astype(np.float32)
    scores[np.arange(off[-1]), rng.integers(0, width, off[-1] // 40 + 1).repeat(40)[: off[-1]]] = 0
    got = language.viterbi(scores, off, 9.0)
    want = [x for a, b in zip(off, off[1:]) for x in plain(scores[a:b].astype(float), 9.0)]
    assert got.tolist() == want


def test_no_words():
    assert len(language.viterbi(np.zeros((0, 3), np.float32), np.zeros(4, np.int64), 9.0)) == 0


def test_many_languages_take_longer_blocks(monkeypatch):
    monkeypatch.setattr(language, "BLOCK_CELLS", 50)
    scores = -np.random.default_rng(3).random((400, 5)).astype(np.float32)
    assert language.viterbi(scores, np.array([0, 400]), 0.5).tolist() == plain(scores.astype(float), 0.5)
