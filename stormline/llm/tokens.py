"""Token ids of text, one distinct piece of text at a time."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping

import numpy as np

# The vocabulary's own rule for cutting pre-tokens, and a class of pieces to which that rule
# can be applied without the library: letters of ASCII and Latin-1, then ASCII marks without the apostrophe.
CUT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LINE = 256  # words or marks given to the library as one text

_ENCODERS: dict[str, PieceEncoder] = {}


def pieces(text: str | None) -> list[bytes]:
    """The runs between ASCII white space, which no pre-token crosses; lower-cased where that changes nothing.

    The library lower-cases everything but its special strings, all of which hold "<|".
    """
    data = (text or "").encode()
    return (data if b"<|" in data else data.lower()).split()


class PieceEncoder:
    """Ids of pieces as the library gives them for whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        rules = json.loads(self.library.to_str())
        steps = [s["type"] for s in (rules["normalizer"] or {}).get("normalizers", [])]
        cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        known = steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern") == {"Regex": CUT_RULE}
        if not known:
            raise ValueError("pieces are cut at white space; this vocabulary has other rules")
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def ids(self, wanted: Iterable[bytes], known: Mapping[bytes, bytes] | None = None) -> dict[bytes, bytes]:
        """The ids of each piece, as 16-bit little-endian bytes; those of its word and marks are taken from ``known``.

        Words and marks are returned too: pieces that differ in marks alone share their word.
        """
        found, cut = {}, []
        for piece in wanted:
            word = piece.rstrip(MARKS)
            if word.isalpha() or LETTERS.fullmatch(word):
                cut.append((piece, word, piece[len(word):]))
            else:
                own = self.library.encode(piece.decode(), add_special_tokens=False).ids
                found[piece] = np.array(own, dtype="<u2").tobytes()
        parts = {word for _, word, _ in cut}.union({marks for _, _, marks in cut if marks})
        if known:
            found.update((part, known[part]) for part in parts if part in known)
        new = list(parts.difference(found))
        for k in range(0, len(new), LINE):
            line = new[k:k + LINE]
            code = self.model.encode(b" ".join(line).decode().lower(), add_special_tokens=False)
            data, start = np.array(code.ids, dtype="<u2").tobytes(), 0
            ends = 2 * np.cumsum(np.bincount(np.array(code.word_ids, dtype="<i8"), minlength=len(line)))
            for part, end in zip(line, ends.tolist()):
                found[part] = data[start:end]
                start = end
        for piece, word, marks in cut:
            if marks:
                found[piece] = found[word] + found[marks]
        return found


def encoder(path: str) -> PieceEncoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


class Memo:
    """Ids of pieces as 16-bit little-endian bytes; forgotten when ``most`` pieces are held."""

    def __init__(self, path: str, most: int = 1_500_000):
        self.source, self.most, self.held = encoder(path), most, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [pieces(text) for text in texts]
        found = [list(map(self.held.get, one)) for one in cut]
        missing = {p for one, own in zip(cut, found) if None in own for p, ids in zip(one, own) if ids is None}
        if missing:
            new = self.source.ids(missing, self.held)
            if len(self.held) + len(new) > self.most:
                self.held.clear()
            self.held.update(new)
            found = [[new[p] if ids is None else ids for p, ids in zip(one, own)] if None in own else own
                     for one, own in zip(cut, found)]
        return [b"".join(own) for own in found]


_MEMOS: dict[str, Memo] = {}


def memo(path: str) -> Memo:
    if path not in _MEMOS:
        _MEMOS[path] = Memo(path)
    return _MEMOS[path]
