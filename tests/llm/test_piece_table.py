"""The hash table that leads through the beginnings of pieces."""

import numpy as np
import public_tokenizers

from cadenza.llm import piece_lattice


def test_the_table_leads_to_every_beginning_and_nowhere_else():
    lattice = piece_lattice._lattice(piece_lattice._read(public_tokenizers.path("piece_bpe_32k.model")), 3)
    node = {p: i + 1 for i, p in enumerate(lattice.prefixes)} | {"": 0}
    letters = {p for p in node if len(p) == 1}
    asked = [(p[:-1], p[-1]) for p in node if p] + [(p, c) for p in list(node)[::7] for c in "eq▁é" if c in letters]
    keys = np.array([node[p] * lattice.letters + lattice.letter[ord(c)] for p, c in asked], np.int64)
    assert lattice._next(keys).tolist() == [node.get(p + c, 0) for p, c in asked]


def test_a_batchs_texts_are_decoded_at_once(monkeypatch):
    lattice = piece_lattice.Lattice(piece_lattice._read(public_tokenizers.path("piece_bpe_32k.model")), 1)
    texts = ["a plain text", "", " two  spaces ", "né 漢\U0001f600\x00", "a ▁ mark"]
    says = [lattice.says(found[0][1], t) for t, found in zip(texts, lattice.checked(texts))]
    monkeypatch.setattr(lattice, "_bytes", None)  # no text is decoded by itself
    assert [found[0][2] for found in lattice.checked(texts)] == says == [True, True, True, True, False]
