"""A window's suffix depends on its bytes alone, wherever long texts are cut into pieces."""

import random

import numpy as np
import pytest

from tessera.llm import common, suffixes


def suffix_by_window(texts):
    out = {}
    for pieces, place in suffixes.pieces_of(texts):
        r = suffixes.runs_of(pieces)
        edge = np.cumsum([0, *map(len, pieces)])
        for p, a, b, s in zip(r.piece.tolist(), r.first.tolist(), r.last.tolist(), r.suffix.tolist()):
            text, offset = place[p]
            for at in range(a, b + 1):
                key = (text, at - int(edge[p]) + offset)
                assert key not in out
                out[key] = s
    return out


@pytest.mark.parametrize("piece", [300, 512, 1 << 19])
def test_pieces(monkeypatch, piece):
    monkeypatch.setattr(suffixes, "PIECE", piece)
    r = random.Random(piece)
    texts = [bytes(r.choices(b"ab c\n", k=n)) for n in (0, 5, 199, 200, 201, 777, 2500)]
    texts += [texts[-1][300:1900], b"z" * 1500, b"xy" * 700]
    found = suffix_by_window(texts)
    assert set(found) == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - suffixes.LENGTH + 1)}
    by_content = {}
    for (i, k), s in found.items():
        assert by_content.setdefault(texts[i][k : k + suffixes.LENGTH], s) == s


def test_hashes_do_not_depend_on_the_place():
    buf = np.frombuffer(b"xxhello worldyyhello world", dtype=np.uint8)
    a, b = common.span_hashes(buf, np.array([2, 15]), np.array([13, 26]))
    assert a == b and len(set(common.span_hashes(buf, np.arange(20), np.arange(20) + 2).tolist())) == len({bytes(buf[i : i + 2]) for i in range(20)})


def test_words_of_a_block():
    texts = [b"", b" a  bb\tccc\n", b"\xc3\xa9\xc2\xa0x", b"d"]
    block = common.Block(texts, lower=True)
    words = [bytes(block.buf[s:e]) for s, e in zip(block.word_start, block.word_end)]
    assert words == [w for t in texts for w in t.split()] and block.n_words.tolist() == [len(t.split()) for t in texts]
