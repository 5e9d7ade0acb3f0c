"""Operator 6: exact token counts of every prefix of a text, by dynamic programming.

Byte-pair encoding has the property that a text's ids without the last one are the
ids of the text that they spell. So the ids of every prefix of a word follow from
those of shorter prefixes: the last token is the one that ends here and may stand
after the last token of the rest. Whether two tokens may stand side by side depends
on the two alone and is remembered. Words are sorted, so that words with a common
beginning share its states.

A text cut inside a word ends in a shorter word with its own end mark. Its count is
kept as well: ``deltas`` holds, for every code point, by how much the count changes
(16 bit, little-endian), and running sums answer any budget without encoding again.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from functools import lru_cache
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quernstone.llm.tokens import _PIECE, _PLAIN, KEPT_WORDS, WORD_BPE, words_of

#: Code points after which the words not met before are solved together.
_TOGETHER = 2_000_000
#: Remembered pairs of tokens; beyond that the memory starts anew.
_PAIRS = 1_500_000
_END = "</w>"

_CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}

_loaded: dict[str, Prefixes] = {}


def prefixes_of(tokenizer: str) -> Prefixes:
    if tokenizer not in _loaded:
        _loaded[tokenizer] = Prefixes(tokenizer)
    return _loaded[tokenizer]


class PieceCounts:
    """Token counts of all prefixes of one piece (a run that the merges never leave)."""

    def __init__(self, config: dict):
        vocab = config["model"]["vocab"]
        special = {t["id"] for t in config.get("added_tokens", [])}
        self.merge_rank: dict[tuple[int, int], int] = {}
        # how a token was merged: its rank and its two halves; letters have rank -1
        self.formed = {i: -1 for i in vocab.values()}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(config["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocab[left], vocab[right]
            self.merge_rank[a, b] = rank
            joined = vocab[left + right]
            if joined not in self.halves:
                self.formed[joined], self.halves[joined] = rank, (a, b)
        self.together: dict[int, bool] = {}
        self.inner, self.closing = {}, {}
        for text, i in vocab.items():
            if i in special or not self._reachable(i):
                continue
            if text.endswith(_END) and text != _END:
                self.closing[text[: -len(_END)]] = i
            else:
                self.inner[text] = i
        self._suffixes()
        self.word = ""
        self.last, self.count, self.closed, self.states = [0], [0], [0], [0]

    def _suffixes(self) -> None:
        """An automaton over the tokens' letters: after each letter, the tokens that end there.

        A state is the longest beginning of a token that ends at the letter; ``shorter`` leads to
        the next shorter one. ``inside`` and ``at_end`` list its tokens, the longest first, as
        (length, token).
        """
        self.follow: list[dict[str, int]] = [{}]
        own_inside, own_end = {}, {}
        for texts, own in ((self.inner, own_inside), (self.closing, own_end)):
            for text, token in texts.items():
                state = 0
                for letter in text:
                    at = self.follow[state].get(letter)
                    if at is None:
                        at = self.follow[state][letter] = len(self.follow)
                        self.follow.append({})
                    state = at
                own[state] = (len(text), token)
        n = len(self.follow)
        self.shorter, self.inside, self.at_end = [0] * n, [()] * n, [()] * n
        level = [0]
        while level:
            below = []
            for state in level:
                for letter, at in self.follow[state].items():
                    below.append(at)
                    back = self._step(self.shorter[state], letter) if state else 0
                    self.shorter[at] = back
                    for out, own in ((self.inside, own_inside), (self.at_end, own_end)):
                        out[at] = (own[at], *out[back]) if at in own else out[back]
            level = below

    def _step(self, state: int, letter: str) -> int:
        while True:
            at = self.follow[state].get(letter)
            if at is not None:
                return at
            if not state:
                return 0
            state = self.shorter[state]

    def _apart(self, a: int, b: int, before: int) -> bool:
        """Whether no merge joined ``a``'s right edge to ``b``'s left edge before rank ``before``.

        Walks back in time: of the two tokens the one merged last is taken apart, and
        at each step the pair of edges stood side by side until ``before``. Merges
        of one rank run from left to right.
        """
        while True:
            rank = self.merge_rank.get((a, b))
            if rank is not None and rank < before:
                return False
            of_a, of_b = self.formed[a], self.formed[b]
            if of_a < 0 and of_b < 0:
                return True
            if of_a > of_b:
                before, a = of_a, self.halves[a][1]
            else:
                before, b = of_b + 1, self.halves[b][0]

    def _reachable(self, token: int) -> bool:
        """Whether encoding the token's own text gives the token."""
        pending = [token]
        while pending:
            t = pending.pop()
            if t in self.halves:
                a, b = self.halves[t]
                if not self._apart(a, b, self.formed[t]):
                    return False
                pending += (a, b)
        return True

    def _fits(self, a: int, b: int, key: int) -> bool:
        if len(self.together) >= _PAIRS:
            self.together.clear()
        known = self.together[key] = self._apart(a, b, 1 << 60)
        return known

    def counts(self, word: str) -> list[int]:
        """``counts[j]``: tokens of ``word[:j]`` as a word of its own. ``word`` is spelled in byte letters."""
        same, most = 0, min(len(word), len(self.word))
        while same < most and word[same] == self.word[same]:
            same += 1
        last, count, closed, states = self.last, self.count, self.closed, self.states
        del last[same + 1 :], count[same + 1 :], closed[same + 1 :], states[same + 1 :]
        follow, inside, at_end, together = self.follow, self.inside, self.at_end, self.together.get
        state = states[same]
        for j in range(same + 1, len(word) + 1):
            letter = word[j - 1]
            state = follow[state].get(letter) or self._step(state, letter)
            states.append(state)
            # of all tokens that end here exactly one may follow what stands before it
            for n, token in inside[state]:
                i = j - n
                if i:
                    key = last[i] << 32 | token
                    fits = together(key)
                    if fits is None:
                        fits = self._fits(last[i], token, key)
                    if not fits:
                        continue
                count.append(count[i] + 1)
                last.append(token)
                break
            else:
                raise ValueError(f"no encoding of {word[:j]!r}")
            for n, token in at_end[state]:
                i = j - n
                if i:
                    key = last[i] << 32 | token
                    fits = together(key)
                    if fits is None:
                        fits = self._fits(last[i], token, key)
                    if not fits:
                        continue
                closed.append(count[i] + 1)
                break
            else:
                raise ValueError(f"no encoding of {word[:j]!r}")
        self.word = word
        return self.closed


@lru_cache(1)
def _follows() -> frozenset[str]:
    """Code points that may compose with the one before: second halves of canonical pairs."""
    out = set()
    for cp in range(0x110000):
        halves = unicodedata.decomposition(chr(cp))
        if halves and halves[0] != "<" and " " in halves:
            out.add(chr(int(halves.split(" ")[1], 16)))
    return frozenset(out | {chr(c) for r in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for c in range(*r)})


def _deltas(counts: list[int]) -> bytes:
    out = array("h", map(sub, counts[1:], counts))
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Prefixes:
    """``deltas`` of whole texts for a tokenizer that drops white space."""

    def __init__(self, tokenizer: str):
        self.words = words_of(tokenizer)
        if not self.words.by_word:
            raise ValueError("prefix counts need a tokenizer whose tokens never cross white space")
        self.table = PieceCounts(self.words.config)
        self.known: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        special = [t["content"] for t in self.words.config.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")

    def deltas(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set()
        for words in split:
            new.update(words)
        new.difference_update(self.known)
        if len(self.known) + len(new) > KEPT_WORDS + 100_000:
            self.known = {"": b""}
            new = {w for words in split for w in words if w}
        plain = [w for w in new if _PLAIN.fullmatch(w) and "<|" not in w]
        self._solve_pieces({p for w in plain for p in _PIECE.findall(w.lower())})
        for word in plain:
            self.known[word] = self._plain(word.lower())
        for word in new.difference(plain):
            self.known[word] = self._any(word)
        out = [b"\0\0".join(map(self.known.__getitem__, words)) for words in split]
        if len(self.pieces) > KEPT_WORDS:
            self.pieces = {}
        return out

    def _spelled(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.words.letters)

    def _solve_pieces(self, pieces: set[str]) -> None:
        spelled = sorted((self._spelled(p), p) for p in pieces if p not in self.pieces)
        solve, keep = self.table.counts, self.pieces
        for word, piece in spelled:
            counts = solve(word)
            if len(word) != len(piece):  # the letters of a code point's bytes come together
                at, ends = 0, [0]
                for c in piece:
                    at += len(c.encode())
                    ends.append(counts[at])
                counts = ends
            keep[piece] = _deltas(counts)

    def _piece(self, piece: str) -> bytes:
        deltas = self.pieces.get(piece)
        if deltas is None:
            self._solve_pieces({piece})
            deltas = self.pieces[piece]
        if piece in _CONTRACTIONS:
            # before its last letter a contraction is an apostrophe and a word
            parts = np.frombuffer(self._piece("'") + self._piece(piece[1:])[:-2], "<i2")
            whole = int(np.frombuffer(deltas, "<i2").sum())
            deltas = parts.tobytes() + np.array([whole - parts.sum()], "<i2").tobytes()
        return deltas

    def _plain(self, lower: str) -> bytes:
        return b"".join([self._piece(p) for p in _PIECE.findall(lower)])

    def _any(self, text: str) -> bytes:
        """Any text: special strings, code points that compose, every alphabet and white space."""
        out, before, at = [], 0, 0
        for found in [*self.special.finditer(text), None]:
            stop = found.start() if found else len(text)
            # cut inside a special string, it is ordinary text after what stands before it
            tail = found.group()[:-1] if found else ""
            counts = self._ordinary(text[at:stop] + tail)
            out += [before + n for n in counts]
            if found:
                before += (counts[stop - at - 1] if stop > at else 0) + 1
                out.append(before)
                at = found.end()
        return np.diff(np.array(out, "<i4"), prepend=0).astype("<i2").tobytes()

    def _ordinary(self, raw: str) -> list[int]:
        """Count after each code point of ``raw``, none of its special strings treated so."""
        if not raw:
            return []
        follows, norm, ends, tails = _follows(), [], [], {}
        start = length = 0
        for i in range(1, len(raw) + 1):
            if i < len(raw) and (unicodedata.combining(raw[i]) or raw[i] in follows):
                continue
            for k in range(start + 1, i):  # inside a run that composes
                tails[k] = (length, self._normal(raw[start:k]))
                ends.append(-1)
            done = self._normal(raw[start:i])
            norm.append(done)
            length += len(done)
            ends.append(length)
            start = i
        text = "".join(norm)
        counts, starts = np.zeros(len(text) + 1, "i8"), np.zeros(len(text) + 1, "i8")
        before = at = 0
        for found in self._pattern().finditer(text):
            a, b = found.span()
            counts[at : a + 1], starts[at + 1 : a + 1] = before, np.arange(at + 1, a + 1)
            counts[a + 1 : b + 1] = before + self._counts(found.group())
            starts[a + 1 : b + 1] = a
            before, at = int(counts[b]), b
        counts[at:] = before if at < len(text) else counts[at:]
        starts[at + 1 :] = np.arange(at + 1, len(text) + 1)
        out = []
        for k, end in enumerate(ends, 1):
            if end >= 0:
                out.append(int(counts[end]))
                continue
            here, tail = tails[k]
            # from a piece earlier on: an apostrophe may go together with what follows it
            a = int(starts[starts[here]])
            whole = self._pattern().findall(text[a:here] + tail)
            out.append(int(counts[a]) + sum(int(self._counts(p)[-1]) for p in whole))
        return out

    def _counts(self, piece: str) -> np.ndarray:
        return np.cumsum(np.frombuffer(self._piece(piece), "<i2"), dtype="i8")

    @staticmethod
    def _normal(part: str) -> str:
        return "".join(c.lower() for c in unicodedata.normalize("NFC", part))

    @staticmethod
    @lru_cache(1)
    def _pattern():
        import regex

        return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x85\p{Z}\p{L}\p{N}]+")


def prefix_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, deltas`` of every whole text, in row order.

    ``deltas`` has two bytes per code point; see ``tokens_at`` and ``longest_within``. NULL
    text counts as empty: no bytes, no tokens, empty deltas. NULL ids and repeated
    rows stay as they are; an empty table gives no rows.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, deltas binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                       ("n_tokens", pa.int64()), ("deltas", pa.binary())])

    def run(batches):
        solver = prefixes_of(tokenizer)
        for batch in batches:
            ids, sizes = batch.column(0), batch.column(2)
            texts, start = batch.column(1), 0
            while start < len(ids):
                part, held, stop = [], 0, start
                while stop < len(ids) and (held < _TOGETHER or not part):
                    part.append(texts[stop].as_py() or "")
                    held += len(part[-1])
                    stop += 1
                deltas = solver.deltas(part)
                totals = [int(np.frombuffer(d, "<i2").sum(dtype="i8")) for d in deltas]
                n = stop - start
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, n), sizes.slice(start, n),
                     pa.array(totals, pa.int64()), pa.array(deltas, pa.binary())],
                    schema=arrow,
                )
                start = stop

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n")
    ).mapInArrow(run, schema)


@F.pandas_udf(LongType())
def _at(deltas: pd.Series, code_points: pd.Series) -> pd.Series:
    return pd.Series(
        [None if d is None or n is None or n != n or n < 0
         else int(np.frombuffer(d, "<i2")[: int(n)].sum(dtype="i8"))
         for d, n in zip(deltas, code_points, strict=True)], dtype="Int64"
    )


@F.pandas_udf(LongType())
def _within(deltas: pd.Series, budget: pd.Series) -> pd.Series:
    def longest(d, most):
        if d is None or most is None or most != most or most < 0:
            return None
        fits = np.flatnonzero(np.cumsum(np.frombuffer(d, "<i2"), dtype="i8") <= most)
        return int(fits[-1]) + 1 if len(fits) else 0

    return pd.Series(
        [longest(d, b) for d, b in zip(deltas, budget, strict=True)], dtype="Int64"
    )


def tokens_at(deltas: str | Column, code_points: Column) -> Column:
    """Tokens of the text cut after ``code_points`` (a longer cut: of the whole text)."""
    return _at(deltas, code_points)


def longest_within(deltas: str | Column, budget: Column) -> Column:
    """The most code points that a prefix of at most ``budget`` tokens can have."""
    return _within(deltas, budget)
