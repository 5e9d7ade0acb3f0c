"""Public tokenizers inside tasks: one loaded copy a worker, and words encoded once.

``word_bpe_49k.json`` drops white space and never looks across it, so the ids of a
text are the ids of its space-separated words one after another. Words repeat, and
the whole-text call spends most of its time on splitting them; keeping each word's
ids makes a text a chain of lookups. Other tokenizers are called on whole texts.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

WORD_BPE = "word_bpe_49k.json"
#: Words kept by a worker; beyond that it starts anew, which costs time, not results.
KEPT_WORDS = 300_000

#: Printable ASCII and the Latin letters up to U+012F: here lower case keeps the
#: length, nothing composes, and the classes below are the library's.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-į]*")
_PLAIN_TEXT = re.compile(r"[ \n!-~À-ÖØ-öø-į]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-į]+|[0-9]|[^ \na-z0-9ß-öø-į]+")

_loaded: dict[str, Words] = {}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself if it prints, else from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(other)}


def tokenizer_path(name_or_path: str) -> str:
    """A path stays as it is; a bare name is looked up among the installed public tokenizers."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


def words_of(name_or_path: str) -> Words:
    if name_or_path not in _loaded:
        _loaded[name_or_path] = Words(tokenizer_path(name_or_path))
    return _loaded[name_or_path]


def drops_space(config: dict) -> bool:
    """Whether the tokenizer's file says that no token crosses or depends on white space."""
    steps = (config.get("normalizer") or {}).get("normalizers", [])
    first = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and config["model"].get("end_of_word_suffix") == "</w>"
        and "'s|'t|'re|'ve|'m|'ll|'d|" in first["pattern"].get("Regex", "")
    )


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Words:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.config = json.load(file)
        self.by_word = drops_space(self.config)
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not self.by_word:
            return self.whole(text)
        if _PLAIN_TEXT.fullmatch(text) and "<|" not in text:
            return self.plain(text)
        words = text.replace("\n", " ").split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.word(words[i])
        return b"".join(found)

    def plain(self, text: str) -> bytes:
        """A text of plain letters: its pieces are found at once, and only new ones are encoded."""
        pieces = _PIECE.findall(text.lower())
        found, at = list(map(self.pieces.get, pieces)), -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = self.piece(pieces[at])
        return b"".join(found)

    def word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            ids = self.plain(word)
        else:
            ids = self.whole(word)
        if len(word) <= 64:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            spelled = piece
            if not piece.isascii():
                spelled = piece.encode().decode("latin-1").translate(self.letters)
            ids = _packed([t.id for t in self.library.model.tokenize(spelled)])
            if len(piece) <= 64:
                if len(self.pieces) >= KEPT_WORDS:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids
