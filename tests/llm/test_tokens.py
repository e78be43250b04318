"""Ids of pieces against the library, and boundaries read all at once."""

from __future__ import annotations

import random

import numpy as np

from stormline.llm.queries import vocabulary
from stormline.llm.token_files import EliasFano
from stormline.llm.tokens import Memo

TEXTS = ["tree tree, tree. (tree) Tree... don't it's 42nd a1b", None, "", "École,  école. ÉCOLE naïve× straße ß; ÿ÷ œuvre",
         "a<|endoftext|>b <| x<|, |> ABC<|endoftext|>", "你好, \U0001f600. étude, Ångstrom ....,, -- _x_", "\x00\x01 a\x00b,"]


class Watched:
    """A source of ids that tells which texts the model was given."""

    def __init__(self, source):
        self.source, self.given = source, []
        self.model, source.model = source.model, self

    def encode(self, line, **named):
        self.given += line.split(" ")
        return self.model.encode(line, **named)


def test_pieces_have_the_ids_of_the_library():
    held = Memo(vocabulary())
    small = Memo(vocabulary(), most=5)
    library = held.source.library
    expected = [np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u2").tobytes() for t in TEXTS]
    assert held.encode(TEXTS) == expected
    assert held.encode(TEXTS[::-1]) == expected[::-1]
    assert [small.encode([t])[0] for t in TEXTS] == expected


def test_a_word_is_encoded_once_whatever_marks_follow(monkeypatch):
    held = Memo(vocabulary())
    monkeypatch.setattr(held.source, "model", held.source.model)
    watched = Watched(held.source)
    held.encode(["tree tree, tree.", "leaf."])
    held.encode(["leaf, tree; tree."])
    assert sorted(watched.given) == sorted({"tree", "leaf", ",", ".", ";"})


def test_boundaries_are_read_all_at_once():
    rng = random.Random(3)
    for n in (1, 2, 63, 64, 65, 300):
        for most in (0, 1, 2, 1000):
            values = np.cumsum([0] + [rng.randint(0, most) for _ in range(n)])
            marks = EliasFano.of(values)
            assert marks.first(n + 1).tolist() == values.tolist() == [marks[i] for i in range(n + 1)]
