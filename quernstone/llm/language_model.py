"""Operator 3: a log-bilinear language model, trained by noise-contrastive estimation.

The next word's vector is predicted as a sum of the two previous words' vectors, each
weighted by its place; a word scores by the product with its own vector plus a bias.
Every word has a vector as context and one as target. The first level tells the end of a
text, the most frequent words, and classes apart; inside a class its members are told apart:
further words, and slots that the rarest words share by hash, inside which they share the mass
by their counts. Training never normalizes: on either level it tells the true next word from
noise, on all training texts at once (every task trains on its own texts; parameters are
averaged each round). Scoring normalizes exactly, over the first level for the distinct contexts
of a batch, and over the members of the word's class.

Word counts cover all training texts. A bounded number of frequent words is handed to
every task; the counts of the others are joined to the texts that hold them.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import PARTS, averaged, in_parts, row_ids, written

#: Frequent words every task knows (about 3 MB), and entries of the model's first level.
FREQUENT, MODEL = 200_000, 384
#: Classes (at most two thirds of the first level), and the members that they hold at most
#: together: words of their own, and slots shared by hash. Both grow with the words found.
#: First level and classes are of about one size: a rare token is normalized over both.
CLASSES, OWN, SHARED = 256, 33_408, 32_768
END = b"\n"  # no word holds white space
_LOG2E = np.float32(np.log2(np.e))  # powers of 2 take half the time of those of e
_DISTINCT, _CODED = 500_000, 6_000_000  # words, and tokens, of texts that are coded together
_TOKENS = 500_000  # tokens trained or scored together
#: Few large rows: their sizes are looked at one by one, so neither side holds more than some of them.
_LARGE_ROWS = {
    "parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1,
    "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false",
    "compression": "zstd",
}
_BLOCK = 512  # rows of a product that stays in the processor's cache
#: Units whose part in a norm, as the near word, a scoring task keeps: those of the most frequent words (50 MB).
NEAR = 32_768


def words(text: bytes | None) -> list[bytes]:
    """Lower-case A-Z, split at ASCII white space, one end: what ``bytes`` does on UTF-8."""
    return [*(text or b"").lower().split(), END]


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text (NULL: empty) leaves 2 modulo 7."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _in_planes(codes: np.ndarray) -> bytes:
    """Four bytes a number, all lowest bytes first: the upper ones, mostly 0, take next to no room on disk."""
    return codes.astype("<i4").view("u1").reshape(-1, 4).T.tobytes()


def _from_planes(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, "u1").reshape(4, -1).T.copy().view("<i4")[:, 0]


def coded_texts(texts: DataFrame) -> DataFrame:
    """Groups of the rows of ``doc_id, text, held_out``, their words told apart once for all steps that follow.

    A row holds a group: the number of its first row, ids, flags and numbers of tokens of its rows,
    its distinct words, joined by spaces, how often each occurs in texts to learn from, and every
    token's word among them. Numbers are written by ``_in_planes``.
    """
    arrow = pa.schema([
        ("row", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
        ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("times", pa.binary()), ("codes", pa.binary()),
    ])

    def code(batches):
        rows = row_ids()

        def started():
            number = defaultdict()
            number.default_factory = number.__len__  # a new word gets the next number
            return [], [], [], number

        def coded(doc_ids, held, codes, number):
            lengths = [len(c) for c in codes]
            codes, distinct = np.concatenate(codes), list(number)
            # the most frequent words come first, so most of the upper bytes are 0
            order = np.argsort(-np.bincount(codes), kind="stable")
            rank = np.empty(len(order), "i4")
            rank[order] = np.arange(len(order))
            codes = rank[codes]
            learned = np.repeat([flag is False for flag in held], lengths)
            times = np.bincount(codes[learned], minlength=len(order))
            first = list(itertools.islice(rows, len(lengths)))[0]
            columns = [
                first, doc_ids, held, lengths, b" ".join([distinct[i] for i in order.tolist()]),
                _in_planes(times), _in_planes(codes),
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([c], f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

        doc_ids, held, codes, number = started()
        size = 0
        for batch in batches:
            for doc_id, text, flag in zip(
                batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True
            ):
                tokens = words(text.as_py())
                doc_ids.append(doc_id)
                held.append(flag)
                codes.append(np.fromiter(map(number.__getitem__, tokens), "i4", len(tokens)))
                size += len(tokens)
                if len(number) >= _DISTINCT or size >= _CODED:
                    yield coded(doc_ids, held, codes, number)
                    doc_ids, held, codes, number = started()
                    size = 0
        if codes:
            yield coded(doc_ids, held, codes, number)

    return texts.select("doc_id", "text", "held_out").mapInArrow(
        code,
        "row long, doc_ids array<long>, held array<boolean>, lengths array<long>, words binary, times binary, "
        "codes binary",
    )


def word_counts(coded: DataFrame) -> DataFrame:
    """``word, c`` of all texts to learn from, each group's words added up before the shuffle."""
    arrow = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def count(batches):
        for group in _groups(batches):
            times = _from_planes(group["times"].as_buffer())
            counts = pa.record_batch([pa.array(group["words"], pa.binary()), pa.array(times, pa.int64())], schema=arrow)
            yield counts.filter(pa.array(times > 0))

    counted = coded.select("words", "times").mapInArrow(count, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words above a count that at most ``most`` words reach, by count, then word.

    The bound comes from a histogram of counts, so only the words chosen move.
    """
    step = F.floor(F.log2("c") * 64)
    bars = counts.groupBy(step.alias("bar")).agg(F.count("*").alias("n")).collect()
    total, lowest = 0, None
    for bar, n in sorted(((r["bar"], r["n"]) for r in bars), reverse=True):
        total += n
        if total > most:
            break
        lowest = bar
    if lowest is None:
        return []
    rows = counts.where(step >= lowest).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda r: (-r[1], r[0]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; a logit too low for the type gives 0."""
    return _sigmoid_of_negative(np.negative(x, out=x))


def _sigmoid_of_negative(x: np.ndarray, exp=np.exp) -> np.ndarray:
    """The same, of logits with their signs turned; for ``exp2`` times ``_LOG2E``."""
    with np.errstate(over="ignore"):
        exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _largest(q: np.ndarray, t: np.ndarray) -> float:
    """A bound of the products of rows of ``q`` and of ``t``."""
    if not len(q) or not len(t):
        return 0.0
    return float(np.sqrt(np.einsum("ij,ij->i", q, q).max() * np.einsum("ij,ij->i", t, t).max()))


def _log_sums(z: np.ndarray, small: bool = False) -> np.ndarray:
    """Logarithm of each row's sum of exp2(z), all within 86 if ``small``; ``z`` is used up."""
    top = None
    if not small and z.size and not -86 < z.min() <= z.max() < 86:
        top = z.max(axis=1)
    if top is not None:
        z -= top[:, None]
    np.exp2(z, out=z)
    sums = np.log((z @ np.ones(z.shape[1], z.dtype)).astype("f8"))
    return sums if top is None else top / _LOG2E + sums


class Units(dict):
    """The unit of every word: frequent ones by table, any other shares a slot by its hash.

    Units are the single words of the first level, then the members, class by class.
    """

    def __init__(self, table: dict[bytes, int], heads: int, own: int, shared: int, classes: int):
        super().__init__(table)
        self.heads, self.own, self.shared, self.classes = heads, own, shared, classes
        self.slots = -(-(own + shared) // classes)

    def member(self, m):
        """The members are dealt to the classes in turn."""
        return self.heads + m % self.classes * self.slots + m // self.classes

    def slot(self, word: bytes) -> int:
        return zlib.crc32(word) % self.shared

    def hashed(self, words: list[bytes]) -> np.ndarray:
        """The units of words that are not in the table, at once."""
        crc = np.fromiter(map(zlib.crc32, words), "i8", len(words))
        return self.member(self.own + crc % self.shared)

    def __missing__(self, word: bytes) -> int:
        return self.member(self.own + self.slot(word))


def _whole_rows(table: np.ndarray) -> np.ndarray:
    """The same memory, a row as one item: rows are put in place without a loop over columns."""
    return table.view(f"V{table.shape[1] * table.itemsize}")[:, 0]


class _RowSums:
    """Sums of the vectors that a batch adds to the same row, without sorting them."""

    def __init__(self, rows: int):
        self.place = np.zeros(rows, "i8")

    @staticmethod
    def _add(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Of an even number of columns two are added as one complex number."""
        if values.shape[1] % 2 == 0:
            kind = np.result_type(values.dtype, "c8")
            _RowSums._add_pairs(out.view(kind), rows, values.view(kind))
        else:
            _RowSums._add_pairs(out, rows, values)
        return out

    @staticmethod
    def _add_pairs(out, rows, values):
        cells = (rows * values.shape[1])[:, None] + np.arange(values.shape[1])
        np.add.at(out.reshape(-1), cells.reshape(-1), values.reshape(-1))

    @staticmethod
    def whole(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """The sums of all ``n`` rows."""
        return _RowSums._add(np.zeros((n, values.shape[1]), values.dtype), rows, values)

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows that occur, the place of each entry's row among them, and one entry of each row."""
        entry = np.arange(len(rows))
        self.place[rows] = entry
        once = self.place[rows] == entry
        found = rows[once]
        self.place[found] = entry[: len(found)]
        return found, self.place[rows], once

    @staticmethod
    def summed(place: np.ndarray, once: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The sums of the rows found: of each the one entry, and then what repeats it."""
        more = np.flatnonzero(~once)
        out = np.take(values, np.flatnonzero(once), axis=0)
        return _RowSums._add(out, place[more], np.take(values, more, axis=0))

    def touched(self, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that occur, and their sums."""
        found, place, once = self.places(rows)
        return found, self.summed(place, once, values)


class LogBilinear:
    """Parameters in ``p``; contexts are the units of the two previous words, ``units`` standing for no word.

    ``unigram`` weighs the first level, whose last entries are the classes, ``inside`` (a row for
    each class) their members; a weight of 0 is no member.
    """

    def __init__(
        self, unigram: np.ndarray, size: int = 16, seed: int = 3, inside: np.ndarray | None = None
    ):
        rng = np.random.default_rng(seed)
        inside = np.zeros((0, 1)) if inside is None else inside
        n, (classes, self.slots) = len(unigram), inside.shape
        self.n, self.size, self.unigram = n, size, unigram / unigram.sum()
        self.heads, self.units = n - classes, n - classes + inside.size
        self.inside = (inside / inside.sum(axis=1, keepdims=True)).ravel()
        with np.errstate(divide="ignore"):
            self.log_inside = np.maximum(np.log(self.inside), -1e4).astype("f4")
        context = rng.normal(0, 0.1, (self.units + 1, size)).astype("f4")
        context[self.heads : self.units] = 0  # what members have in common is in "rest"
        self.p = {
            "context": context,
            "rest": rng.normal(0, 0.1, size).astype("f4"),
            "near": np.full(size, 0.5, "f4"),
            "far": np.full(size, 0.25, "f4"),
            "target": rng.normal(0, 0.1, (n, size)).astype("f4"),
            "bias": np.log(self.unigram).astype("f4"),
            # inside a class all start at their weights; the last column is the bias
            "member": np.concatenate(
                [np.zeros((inside.size, size)), self.log_inside[:, None]], axis=1
            ).astype("f4"),
        }

    def first(self, unit: np.ndarray) -> np.ndarray:
        """Entry of the first level: the word itself, or the member's class."""
        return np.where(unit < self.heads, unit, self.heads + (unit - self.heads) // self.slots)

    def _is_member(self, unit: np.ndarray) -> np.ndarray:
        return ((unit >= self.heads) & (unit < self.units)).astype("f4")[:, None]

    def looked_up(self, unit: np.ndarray) -> np.ndarray:
        out = np.take(self.p["context"], unit, axis=0)
        out += self._is_member(unit) * self.p["rest"]
        return out

    def predicted(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        return self.looked_up(far) * self.p["far"] + self.looked_up(near) * self.p["near"]

    def context_tables(self) -> tuple[np.ndarray, np.ndarray, tuple | None]:
        """What every unit adds to a prediction as the far and as the near word, and ``near_factors``.

        A last column, 1 in all, meets the bias in products.
        """
        whole = self.looked_up(np.arange(self.units + 1))
        one = np.ones((len(whole), 1), "f4")
        as_far = np.concatenate([whole * self.p["far"], one], axis=1)
        as_near = np.concatenate([whole * self.p["near"], one * 0], axis=1)
        return as_far, as_near, self.near_factors(as_far, as_near)

    def near_factors(self, as_far, as_near) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Each unit's row, or -1, in a table of exp(what it adds to the first level's scores) as the near word.

        A norm is the sum over the first level of exp(far part) * exp(near part): so the exponentials are
        taken once a word, not once a context. Last, whether a unit as the far word keeps its factors in
        the type's range; near words that might leave it have no row. None where most units might.
        """
        target = self.p["target"]
        longest = np.sqrt(np.einsum("ij,ij->i", target, target).max())
        far, near = (np.sqrt(np.einsum("ij,ij->i", x[:, :-1], x[:, :-1])) * longest for x in (as_far, as_near))
        far, near = far + np.abs(self.p["bias"]).max() < 40, near < 40
        if 2 * min(far.sum(), near.sum()) < len(far):
            return None
        unit = np.arange(self.units)
        member = unit - self.heads  # dealt to the classes in turn, frequent ones first
        rank = self.heads + member % self.slots * (self.n - self.heads) + member // self.slots
        rank[: self.heads] = unit[: self.heads]
        row = np.append(np.where((rank < NEAR) & near[:-1], rank, -1), -1)
        kept = np.argsort(rank)[:NEAR]
        table, turned = np.empty((len(kept), self.n), "f4"), np.ascontiguousarray(self.targets().T)
        for at in range(0, len(kept), _BLOCK):
            z = np.take(as_near, kept[at : at + _BLOCK], axis=0) @ turned
            np.exp(np.minimum(z, 80, out=z), out=table[at : at + _BLOCK])
        return row, table, far

    def targets(self) -> np.ndarray:
        """The first level's vectors, each with its bias as the last column."""
        return np.concatenate([self.p["target"], self.p["bias"][:, None]], axis=1)

    def _noise_members(self, rng, each: int = 512) -> np.ndarray:
        """For every class a row of members drawn by weight."""
        classes = len(self.inside) // self.slots
        ends = np.cumsum(self.inside).reshape(classes, -1)[:, -1:]
        at = ends - 1 + rng.random((classes, each))
        drawn = np.searchsorted(np.cumsum(self.inside), at, side="right")
        first = np.arange(classes)[:, None] * self.slots
        drawn = np.clip(drawn, first, first + self.slots - 1)
        # rounding may lead to an empty place: the first member is never one
        return np.where(self.inside[drawn] > 0, drawn, first)

    def train(
        self, far, near, word, rng, noise: int = 64, batch: int = 1_024, rate: float = 0.05,
        member_noise: int = 1,
    ):
        """One pass of noise-contrastive estimation.

        On the first level the words of a batch share their noise words; inside the classes
        every word has noise members of its own.
        """
        p, size, most = self.p, self.size, max(len(word), 1)
        # after each vector its bias, which meets a 1, and a column that meets a 0: there lies a word's
        # mean square, one for all of its vector, so that a row is all that a batch fetches of a word
        small = [np.full((len(t), 1), 1e-6, "f4") for t in (p["context"], p["member"])]
        target = np.concatenate([self.targets(), np.zeros((self.n, 1), "f4")], axis=1)
        context = np.concatenate([p["context"], 0 * small[0], small[0]], axis=1)
        member = np.concatenate([p["member"], small[1]], axis=1)
        weights = np.stack([p["far"], p["near"], p["rest"]])
        squares = [np.full(t.shape, 1e-6, "f4") for t in (target, weights)]
        share = np.log(noise * self.unigram).astype("f4")
        sums = _RowSums(max(self.units + 1, len(self.inside)))
        member_share = self.log_inside + np.float32(np.log(member_noise))
        # what is drawn, for all batches at once
        draws = rng.random((-(-most // batch), noise))
        noises = np.minimum(np.searchsorted(np.cumsum(self.unigram), draws), self.n - 1)
        entries, others = self.first(word), None
        if len(self.inside):
            members = self._noise_members(rng)
            others = np.maximum(entries - self.heads, 0)[:, None] * members.shape[1]
            others = np.take(members, others + rng.integers(0, members.shape[1], (len(word), member_noise)))

        def step(table, square, g):
            square += g * g
            g *= np.float32(rate)
            g /= np.sqrt(square)
            table += g

        def sparse(table, rows, before, g, columns):
            """Only the rows that a batch touches change."""
            square = before[:, -1] + np.einsum("ij,ij->i", g, g) / np.float32(columns)
            g *= (np.float32(rate) / np.sqrt(square))[:, None]
            g += before
            g[:, -1] = square
            _whole_rows(table)[rows] = _whole_rows(g)

        for number, at in enumerate(range(0, len(word), batch)):
            w, c, drawn = word[at : at + batch], entries[at : at + batch], noises[number]
            m, part = len(w), np.float32(1 / len(w))
            # each unit of the batch is fetched once
            units, place, once = sums.places(np.concatenate([far[at : at + batch], near[at : at + batch]]))
            before, common = np.take(context, units, axis=0), self._is_member(units)
            vectors = before[:, :size] + common * weights[2]
            rows = np.take(vectors, place, axis=0)
            q = np.zeros((m, size + 2), "f4")
            np.multiply(rows[:m], weights[0], out=q[:, :size])
            q[:, :size] += rows[m:] * weights[1]
            q[:, size] = 1
            # log of model score over (noise words x noise probability)
            dq = np.take(target, c, axis=0)
            up = _sigmoid_of_negative(np.einsum("ij,ij->i", q, dq) - share[c])  # wants the true word higher
            dq *= up[:, None]
            noisy = np.take(target, drawn, axis=0)
            against = -noisy
            against[:, size] += share[drawn]
            down = _sigmoid_of_negative(q @ (against * _LOG2E).T, np.exp2)  # and the noise lower
            dq -= down @ noisy
            away = down.T @ q
            inner = np.flatnonzero(w >= self.heads)
            if len(inner):
                own = (w[inner] - self.heads).astype("i8")
                asked = np.concatenate([own[:, None], others[at + inner]], axis=1)
                t = np.take(member, asked, axis=0)
                q1 = np.take(q, inner, axis=0)
                pull = -_sigmoid(np.einsum("ijk,ik->ij", t, q1) - member_share[asked])
                pull[:, 0] += 1
                g = np.take(dq, inner, axis=0)
                g += np.einsum("ij,ijk->ik", pull, t)
                _whole_rows(dq)[inner] = _whole_rows(g)
                pull *= part
                moves = pull[:, :, None] * q1[:, None, :]
                changed, g = sums.touched(asked.reshape(-1), moves.reshape(-1, moves.shape[2]))
                sparse(member, changed, np.take(member, changed, axis=0), g, size + 1)
            dq *= part
            up *= part
            g = sums.whole(c, up[:, None] * q, self.n)
            away *= part
            g -= sums.whole(drawn, away, self.n)
            dq = dq[:, :size]
            both = np.zeros((2 * m, size + 2), "f4")
            np.multiply(dq, weights[0], out=both[:m, :size])
            np.multiply(dq, weights[1], out=both[m:, :size])
            moved = sums.summed(place, once, both)
            turns = [np.einsum("ij,ij->j", dq, rows[:m]), np.einsum("ij,ij->j", dq, rows[m:])]
            step(weights, squares[1], np.stack([*turns, common[:, 0] @ moved[:, :size]]))
            step(target, squares[0], g)
            sparse(context, units, before, moved, size)

        p["target"], p["bias"] = target[:, :size].copy(), target[:, size].copy()
        p["context"], p["member"] = context[:, :size].copy(), member[:, : size + 1].copy()
        p["far"], p["near"], p["rest"] = weights

    def log_norms(self, q: np.ndarray, block: int = _BLOCK) -> np.ndarray:
        """Logarithm of the sum over the first level of exp(score), per prediction and its 1."""
        out = np.empty(len(q))
        turned = np.ascontiguousarray(self.targets().T) * _LOG2E
        small = _largest(q[:, :-1], self.p["target"]) + np.abs(self.p["bias"]).max() < 60
        for at in range(0, len(q), block):
            out[at : at + block] = _log_sums(q[at : at + block] @ turned, small)
        return out

    def known_norms(self) -> np.ndarray:
        """Room for the logarithm of the sum of contexts without members: 5 MB for 768 words."""
        return np.full((self.heads + 1) ** 2, np.nan)

    def _norms(self, far, near, q: np.ndarray, known: np.ndarray, tables: tuple) -> np.ndarray:
        """Per token; each distinct context without members is normalized once, and kept in ``known``."""
        f, n = (np.where(u == self.units, self.heads, u).astype("i8") for u in (far, near))
        often = ((far < self.heads) | (far == self.units)) & (
            (near < self.heads) | (near == self.units)
        )
        out = np.empty(len(far))
        context = (f * (self.heads + 1) + n)[often]
        distinct, at = np.unique(context, return_index=True)
        new = np.isnan(known[distinct])
        known[distinct[new]] = self.log_norms(q[often][at[new]])
        out[often] = known[context]
        rest = np.flatnonzero(~often)
        if tables[2] is not None:
            row, _, fits = tables[2]
            whole = (row[near[rest]] >= 0) & fits[far[rest]]
            by_factors, rest = rest[whole], rest[~whole]
            out[by_factors] = self._factored(far[by_factors], near[by_factors], tables)
        out[rest] = self.log_norms(q[rest])
        return out

    def _factored(self, far, near, tables: tuple) -> np.ndarray:
        """The norms of contexts whose near words have rows in the table of ``near_factors``."""
        as_far, _, (row, table, _) = tables
        key = far.astype("i8") * (self.units + 1) + near
        order = np.argsort(key)  # a far word's tokens follow each other, as do those of a context
        key = key[order]
        other = np.ones(len(key), bool)
        other[1:] = key[1:] != key[:-1]
        distinct = order[other]
        far, rows = far[distinct], row[near[distinct]]
        first = np.ones(len(far), bool)
        first[1:] = far[1:] != far[:-1]
        sums, turned = np.empty(len(far)), np.ascontiguousarray(self.targets().T)
        # blocks are put in the same memory, which stays in the cache
        held = [np.empty((_BLOCK, self.n), "f4") for _ in range(3)]
        for at in range(0, len(far), _BLOCK):
            new = first[at : at + _BLOCK].copy()
            new[0], m = True, len(new)
            words_far = far[at : at + _BLOCK][new]
            by_far, by_near, of_far = held[0][: len(words_far)], held[1][:m], held[2][:m]
            np.matmul(np.take(as_far, words_far, axis=0), turned, out=by_far)
            np.exp(by_far, out=by_far)
            np.take(table, rows[at : at + _BLOCK], axis=0, mode="clip", out=by_near)
            if len(words_far) <= 8:
                cuts = [*np.flatnonzero(new).tolist(), m]
                for k, (low, high) in enumerate(itertools.pairwise(cuts)):
                    sums[at + low : at + high] = by_near[low:high] @ by_far[k]
            else:
                np.take(by_far, np.cumsum(new) - 1, axis=0, mode="clip", out=of_far)
                sums[at : at + _BLOCK] = np.vecdot(by_near, of_far)
        out = np.empty(len(key))
        out[order] = np.log(sums)[np.cumsum(other) - 1]
        return out

    def log_probabilities(
        self, far, near, word, known: np.ndarray | None = None, tables: tuple | None = None
    ) -> np.ndarray:
        """Natural logarithms: of the entry of the first level, and of the member in its class."""
        known = self.known_norms() if known is None else known
        c = self.first(word)
        tables = tables or self.context_tables()
        as_far, as_near, _ = tables
        q, out, targets = np.take(as_far, far, axis=0), np.empty(len(far)), self.targets()
        for at in range(0, len(far), _BLOCK * 16):
            rows = slice(at, at + _BLOCK * 16)
            q[rows] += np.take(as_near, near[rows], axis=0)
            out[rows] = np.einsum("ij,ij->i", q[rows], np.take(targets, c[rows], axis=0))
        out -= self._norms(far, near, q, known, tables)
        inner = np.flatnonzero(word >= self.heads)
        # short numbers are sorted by their digits
        inner = inner[np.argsort(c[inner].astype("u2" if self.n < 1 << 16 else "i8"), kind="stable")]
        cuts = np.searchsorted(c[inner], np.arange(self.heads, self.n + 1))
        # a weight of 0 adds nothing to its class, however low it is
        bias = np.abs(self.p["member"][self.inside > 0, -1]).max(initial=0)
        small = _largest(q[:, :-1], self.p["member"][:, :-1]) + bias < 60
        for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            t = np.ascontiguousarray(self.p["member"][k * self.slots : (k + 1) * self.slots].T) * _LOG2E
            for at in range(low, high, _BLOCK):
                rows = inner[at : min(at + _BLOCK, high)]
                z = np.take(q, rows, axis=0) @ t
                mine = z[np.arange(len(rows)), word[rows] - self.heads - k * self.slots]
                out[rows] += mine.astype("f8") / _LOG2E - _log_sums(z, small)
        return out

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype("f4")
            at += v.size


def model_ids(tokens: list[bytes], ids: Units) -> list[int]:
    return list(map(ids.__getitem__, tokens))


def contexts(texts: list[list[int]], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id before the previous one, the previous one, and the id, of every token of every text."""
    lengths = [len(t) for t in texts]
    word = np.fromiter(itertools.chain.from_iterable(texts), "i4", sum(lengths))
    return _around(word, np.cumsum([0, *lengths[:-1]]), start)


def _around(word: np.ndarray, first: np.ndarray, start: int) -> tuple:
    """The contexts of ids that lie one text after another, from the places ``first`` on."""
    near, far = np.full(len(word), start, "i4"), np.full(len(word), start, "i4")
    near[1:], far[2:] = word[:-1], word[:-2]
    near[first], far[first] = start, start
    second = first + 1
    far[second[second < len(word)]] = start
    return far, near, word


def _gathered(batches, column: int = 0):
    """Texts as words, in groups of about ``_TOKENS`` tokens."""
    held, n = [], 0
    for batch in batches:
        for text in batch.column(column):
            held.append(words(text.as_py()))
            n += len(held[-1])
            if n >= _TOKENS:
                yield held
                held, n = [], 0
    if held:
        yield held


def _units(words: list[bytes], ids: Units) -> np.ndarray:
    coded = np.fromiter(map(ids.get, words, itertools.repeat(-1)), "i4", len(words))
    lost = np.flatnonzero(coded < 0)
    coded[lost] = ids.hashed([words[i] for i in lost])
    return coded


def _flat_ids(texts: list[list[bytes]], ids: Units) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one text after another, and the place where each text starts."""
    lengths = np.array([len(t) for t in texts])
    return _units(list(itertools.chain.from_iterable(texts)), ids), np.cumsum(lengths) - lengths


def text_groups(batches, ids: Units):
    """``_flat_ids`` of groups of the texts in the first column."""
    for group in _gathered(batches):
        yield _flat_ids(group, ids)


def _groups(batches):
    """The rows of ``coded_texts``, one at a time: each column's value, words as a list."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
            yield row | {"words": row["words"].as_py().split(b" ")}


def _chunks(lengths: np.ndarray):
    """Slices of texts, in order, of about ``_TOKENS`` tokens."""
    ends, first, done = np.cumsum(lengths), 0, 0
    while first < len(lengths):
        last = min(int(np.searchsorted(ends, done + _TOKENS)), len(lengths) - 1) + 1
        yield slice(first, last), slice(done, int(ends[last - 1]))
        first, done = last, int(ends[last - 1])


def coded_groups(batches, ids: Units):
    """The same of rows of ``coded_texts``, of which only texts to learn from are taken."""
    for group in _groups(batches):
        learned = np.array([flag is False for flag in group["held"].as_py()])
        lengths, units = group["lengths"].values.to_numpy(), _units(group["words"], ids)
        codes = _from_planes(group["codes"].as_buffer())[np.repeat(learned, lengths)]
        lengths = lengths[learned]
        for texts, tokens in _chunks(lengths):
            yield units[codes[tokens]], np.cumsum(lengths[texts]) - lengths[texts]


def learn_all(model: LogBilinear, batches, ids, rng, groups=text_groups) -> int:
    """Tokens of the batches, all of which the model has learned from."""
    tokens = 0
    for group in groups(batches, ids):
        far, near, word = _around(*group, model.units)
        order = rng.permutation(len(word))
        model.train(far[order], near[order], word[order], rng)
        tokens += len(word)
    return tokens


def train_model(
    texts: DataFrame, ids: Units, unigram: np.ndarray, inside: np.ndarray, rounds: int = 1,
    seed: int = 3, coded: bool = False,
) -> LogBilinear:
    """Average of what all tasks learn from their own texts, round by round.

    ``texts`` holds texts in its column ``text``, or is what ``coded_texts`` gives, as ``coded`` tells.
    Every round goes over every text. A task's parameters come back in chunks; Spark adds
    them up, weighted by tokens, so the driver receives one set of parameters however many tasks
    there are.
    """
    model = LogBilinear(unigram, seed=seed, inside=inside)
    handed = texts.sparkSession.sparkContext.broadcast(ids)
    parts = pa.schema([("start", pa.int64()), ("tokens", pa.int64()), ("part", pa.binary())])
    for number in range(rounds):
        start = texts.sparkSession.sparkContext.broadcast(model)

        def learn(batches, number=number, start=start):
            ids, own = handed.value, LogBilinear(unigram, seed=seed, inside=inside)
            own.put(start.value.vector())
            groups = coded_groups if coded else text_groups
            tokens = learn_all(own, batches, ids, np.random.default_rng(seed + number), groups)
            yield pa.RecordBatch.from_pandas(in_parts(own.vector(), tokens), parts, preserve_index=False)

        columns = ["held", "lengths", "words", "codes"] if coded else ["text"]
        flat = averaged(texts.select(*columns).mapInArrow(learn, PARTS))
        if flat is None:
            break
        model = LogBilinear(unigram, seed=seed, inside=inside)
        model.put(flat)
    return model


def units_of(
    counts: DataFrame, known: list[tuple[bytes, int]], c_end: int, types: int, vocabulary: int
) -> tuple[Units, np.ndarray, np.ndarray, np.ndarray]:
    """Units, weights of the first level and of the members, and log10 of every slot's weight.

    Weights are add-one counts; a slot has one share more for the words never seen.
    """
    ranked = [k for k in known if k[0] != END]
    classes = max(1, min(CLASSES, vocabulary * 2 // 3))
    heads = ranked[: max(0, vocabulary - 1 - classes)]
    own = ranked[len(heads) : len(heads) + OWN]
    left = types - (c_end > 0) - len(heads) - len(own)
    shared = min(SHARED, max(1, left))
    units = Units({}, 1 + len(heads), len(own), shared, min(classes, len(own) + shared))
    # the order of frequent_words
    beyond = F.col("word") != F.lit(END)
    if heads or own:
        word, c = (heads + own)[-1]
        beyond &= (F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > F.lit(word)))
    slots = np.ones(shared)
    slot = (F.crc32("word") % shared).alias("slot")
    for r in counts.where(beyond).groupBy(slot).agg((F.sum("c") + F.count("*")).alias("w")).collect():
        slots[r["slot"]] += r["w"]
    members = np.zeros(units.classes * units.slots)
    weights = np.array([*[c + 1 for _, c in own], *slots], "f8")
    members[units.member(np.arange(len(weights))) - units.heads] = weights
    inside = members.reshape(units.classes, units.slots)
    single = np.array([c_end + 1, *[c + 1 for _, c in heads]], "f8")
    units.update({w: units[w] for w, _ in ranked[len(heads) + len(own) :]})
    units.update({w: units.member(m) for m, (w, _) in enumerate(own)})
    units.update({w: i for i, (w, _) in enumerate([(END, 0), *heads])})
    return units, np.concatenate([single, inside.sum(axis=1)]), inside, np.log10(slots)


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=held_out,
    frequent: int = FREQUENT, vocabulary: int = MODEL, rounds: int = 1,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row.

    ``held`` tells from the id column which texts are not learned from. ``base_score`` is the
    add-one unigram's log10 probability of the text, ``score`` the model's. NULL text counts
    as empty and has the end alone, NULL ids are kept, repeated rows count as often as
    they occur. Without training texts nothing is known and the model is uniform.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
        held(F.col(id_col)).alias("held_out"),
    )
    coded = written(coded_texts(texts), "coded-texts", _LARGE_ROWS)
    counts = written(word_counts(coded), "word-counts")
    end = F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))
    n, v, c_end = counts.agg(F.sum("c"), F.count("*"), end).first()
    n, c_end = n or 0, c_end or 0
    known = frequent_words(counts, frequent)
    c_of = dict(known)
    if n:
        c_of[END] = c_end
    ids, unigram, inside, slots = units_of(counts, known, c_end, v, vocabulary)
    outside = np.log10(n + v + 1)
    model = (
        train_model(coded, ids, unigram, inside, rounds, coded=True)
        if n
        else LogBilinear(unigram, inside=inside)
    )
    # one lookup a token: the word's rank gives its unit and its logarithm
    ranked = [*c_of]
    units_of_rank = np.array([ids[word] for word in ranked], "i4")
    logs_of_rank = np.log10(np.array([*c_of.values()], "f8") + 1)
    others_by_hash = Units({END: 0}, ids.heads, ids.own, ids.shared, ids.classes)
    handed = docs.sparkSession.sparkContext.broadcast(
        (ranked, units_of_rank, logs_of_rank, others_by_hash, slots, model)
    )

    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()),
              ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
              ("own", pa.float64()), ("others", pa.list_(pa.struct([
                  ("word", pa.binary()), ("times", pa.int64())])))]
    arrow = pa.schema(fields)

    def score(batches):
        ranked, units, logs_of, ids, slots, model = handed.value
        norms, tables = model.known_norms(), model.context_tables()
        unit_slot = np.full(model.units, -1)  # of units that words share
        shared = np.arange(ids.shared)
        unit_slot[ids.member(ids.own + shared)] = shared
        rank = {word: i for i, word in enumerate(ranked)}
        for group in _groups(batches):
            distinct = group["words"]
            # of the distinct words first
            place = np.fromiter(map(rank.get, distinct, itertools.repeat(-1)), "i4", len(distinct))
            missing = np.flatnonzero(place < 0)
            if len(units):
                unit, log = units[place], np.where(place >= 0, logs_of[place], 0)
                unit[missing] = ids.hashed([distinct[i] for i in missing])
            else:
                unit, log = np.array(model_ids(distinct, ids), "i4"), np.zeros(len(distinct))
            # inside a slot: add-one, with one share for the unseen
            slot = unit_slot[unit]
            inside_slot = np.where(slot >= 0, log - slots[slot], 0)
            every, every_length = _from_planes(group["codes"].as_buffer()), group["lengths"].values.to_numpy()
            row, doc_ids, flags = group["row"].as_py(), group["doc_ids"].values, group["held"].values
            for texts, tokens in _chunks(every_length):
                codes, lengths = every[tokens], every_length[texts]
                starts, n = np.cumsum(lengths) - lengths, len(lengths)
                known = (place >= 0)[codes]
                text = np.repeat(np.arange(n), lengths)
                lost, times = np.unique(text[~known] * len(distinct) + codes[~known], return_counts=True)
                others = pa.ListArray.from_arrays(
                    np.searchsorted(lost, np.arange(n + 1) * len(distinct)).astype("i4"),
                    pa.StructArray.from_arrays(
                        [pa.array([distinct[i] for i in (lost % len(distinct)).tolist()], pa.binary()),
                         pa.array(times, pa.int64())],
                        names=["word", "times"],
                    ),
                )
                n_known = np.add.reduceat(known.astype("i8"), starts)
                base = np.add.reduceat(log[codes], starts) - lengths * outside
                far, near, word = _around(unit[codes], starts, model.units)
                own = model.log_probabilities(far, near, word, norms, tables) / np.log(10) + inside_slot[codes]
                columns = [
                    row + np.arange(texts.start, texts.stop), doc_ids[texts], flags[texts], lengths,
                    n_known, base, np.add.reduceat(own, starts),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, f.type) for c, f in zip(columns, arrow, strict=False)), others],
                    schema=arrow,
                )

    partial = written(
        coded.drop("times").mapInArrow(
            score,
            "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
            "own double, others array<struct<word:binary,times:long>>",
        ),
        "text-scores",
    )
    others = partial.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.times")
    # a word missing here was never seen in training: count 0, logarithm 0
    added = (
        others.join(counts, "word")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"),
             F.sum("times").alias("more_known"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return partial.drop("others").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("own") + more).alias("score"),
    )
