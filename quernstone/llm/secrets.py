"""Operator 1: secrets by fixed rules, and more of their kind by a character network.

The rules' findings always stay. They are also the labelled examples from which a
small convolutional network learns what a secret and its surroundings look like;
candidates that no rule reports are its counterexamples. Every distinct window of all texts
takes part: groups of windows train next to each other, and their parameters are averaged
each round. A quarter, chosen by hash, is held out: on all of it the network is calibrated, and its
thresholds are the highest that still find ``recall`` of the held-out secrets. It then judges
every remaining candidate of every text, long ones in overlapping windows, and what the
rules' findings leave of the runs that they touch.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernstone.llm.common import PARTS, averaged, in_parts, written

KINDS = ("assign", "access", "hex")
#: Kind of a span that only the network reports.
LEARNED = "learned"
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates: long runs of the letters that keys are written in.
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Shorter ones, and such with other signs, where capitals, small letters and digits mix.
_WORD = re.compile(r"(?<![!-~])(?=[!-~]*[0-9])(?=[!-~]*[A-Z])(?=[!-~]*[a-z])[!-~]{8,}(?![!-~])")
#: A finding inside a run covers everything between two of these.
_SEPARATORS = "/.="

#: Characters of the window: before, of the candidate, after.
BEFORE, INSIDE, AFTER = 24, 48, 24
WIDTH = BEFORE + INSIDE + AFTER
#: Windows of a longer candidate start so far apart: 32 characters in a row are whole in one.
STEP = 16
_SYMBOLS = 130  # ASCII, other, beyond the text

#: Distinct windows of one group, whose training is one task's work; the more, the more groups.
GROUP = 8_192
#: Windows of either class that a group has about at least: of a rare class some stand in several.
BOTH = 256
#: How often the training goes over all windows, and steps that few windows get at least.
ROUNDS, STEPS = 8, 400


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, start of the value)`` of the fixed rules, by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text)
               if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)
                if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def window(text: str, start: int, end: int) -> str:
    """``BEFORE`` characters, the whole candidate, ``AFTER`` characters; NUL pads to ``WIDTH``."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    inside = text[start:end].ljust(INSIDE, "\0")
    return before + inside + text[end : end + AFTER].ljust(AFTER, "\0")


def cut(around: str) -> list[tuple[int, str]]:
    """Offset and text of the windows of ``WIDTH`` that cover what ``window`` returned."""
    last = len(around) - WIDTH
    return [(at, around[at : at + WIDTH]) for at in (*range(0, last, STEP), last)]


def _joined(base: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """The base spans, overlapping ones joined."""
    covered: list[list[int]] = []
    for start, _, end, _ in base:
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    return covered


def _all_candidates(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``runs`` and, apart from them, the words that mix letters and digits; in order."""
    out, at = [], 0
    for m in _WORD.finditer(text):
        start, end = m.span()
        while start < end and text[start] in "\"'`([{<":
            start += 1
        while start < end and text[end - 1] in "\"'`)]}>,;:.":
            end -= 1
        while at < len(runs) and runs[at][1] <= start:
            out.append(runs[at])
            at += 1
        if end - start >= 8 and (at == len(runs) or runs[at][0] >= end):
            out.append((start, end))
    return out + runs[at:]


def split_runs(
    text: str, base: list[tuple[int, int, int, int]]
) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Runs that no base span touches; the parts outside base spans of the others."""
    covered, whole, parts, at = _joined(base), [], [], 0
    runs = [m.span() for m in _RUN.finditer(text)]
    for run in _all_candidates(text, runs):
        while at < len(covered) and covered[at][1] <= run[0]:
            at += 1
        if at == len(covered) or covered[at][0] >= run[1]:
            whole.append(run)
            continue
        start, k = run[0], at
        while k < len(covered) and covered[k][0] < run[1]:
            if start < covered[k][0]:
                parts.append((start, covered[k][0]))
            start, k = covered[k][1], k + 1
        if start < run[1]:
            parts.append((start, run[1]))
    return whole, parts


def candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Runs that no base span touches."""
    return split_runs(text, base)[0]


_FOUND = (
    "doc_id long, n_assign long, n_access long, n_hex long, base string, "
    "open array<struct<start:long,end:long,window:string>>, "
    "parts array<struct<start:long,end:long,window:string>>, "
    "known array<struct<start:long,end:long,window:string>>"
)
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("window", pa.string())]))
_FOUND_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
    ("n_hex", pa.int64()), ("base", pa.string()), ("open", _SPAN), ("parts", _SPAN),
    ("known", _SPAN),
])


def _scan(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            base = base_spans(text)
            counts = [sum(kind == k for _, kind, _, _ in base) for k in range(3)]
            named = ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b, _ in base)
            describe = lambda a, b, text=text: {"start": a, "end": b, "window": window(text, a, b)}
            runs, parts = split_runs(text, base)
            rows.append((
                doc_id, *counts, named, [describe(a, b) for a, b in runs],
                [describe(a, b) for a, b in parts],
                [describe(value, b) for _, _, b, value in base],
            ))
        columns = list(zip(*rows, strict=True)) or [()] * len(_FOUND_ARROW)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _FOUND_ARROW, strict=True)],
            schema=_FOUND_ARROW,
        )


def encode(windows: list[str]) -> np.ndarray:
    codes = np.array([list(map(ord, w)) for w in windows], dtype="i8").reshape(-1, WIDTH)
    return np.where(codes == 0, _SYMBOLS - 1, np.minimum(codes, _SYMBOLS - 2))


class CharNet:
    """Convolution over characters, the maximum in each region of the window, two dense layers."""

    REGIONS = (slice(0, BEFORE), slice(BEFORE, BEFORE + INSIDE), slice(BEFORE + INSIDE, None))

    def __init__(self, filters: int = 16, span: int = 5, hidden: int = 16, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.span, self.filters = span, filters
        self.w = {
            "conv": rng.normal(0, 0.3, (span, _SYMBOLS, filters)),
            "conv_bias": np.zeros(filters),
            "dense": rng.normal(0, 0.3, (3 * filters, hidden)),
            "dense_bias": np.zeros(hidden),
            "out": rng.normal(0, 0.3, hidden),
            "out_bias": np.zeros(1),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.steps = 0.0
        self.slope, self.shift = 1.0, 0.0  # calibration of the logit

    def vector(self) -> np.ndarray:
        """All parameters, and what the next step knows of those before."""
        tables = [t for part in (self.w, self.m, self.v) for t in part.values()]
        return np.concatenate([*(t.ravel() for t in tables), [self.steps]])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for part in (self.w, self.m, self.v):
            for k, t in part.items():
                part[k] = flat[at : at + t.size].reshape(t.shape).astype("f8")
                at += t.size
        self.steps = float(flat[at])

    def _forward(self, x: np.ndarray):
        padded = np.pad(x, ((0, 0), (2, 2)), constant_values=_SYMBOLS - 1)
        maps = sum(self.w["conv"][k][padded[:, k : k + WIDTH]] for k in range(self.span))
        maps = maps + self.w["conv_bias"]
        best = [maps[:, r].argmax(axis=1) + (r.start or 0) for r in self.REGIONS]
        top = np.stack([np.take_along_axis(maps, b[:, None], 1)[:, 0] for b in best], axis=1)
        pooled = np.tanh(top).reshape(len(x), -1)
        hidden = np.tanh(pooled @ self.w["dense"] + self.w["dense_bias"])
        return padded, best, pooled, hidden, hidden @ self.w["out"] + self.w["out_bias"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 2048])[-1] for i in range(0, len(x), 2048)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits * self.slope + self.shift, -50, 50)))

    def probability(self, windows: list[str]) -> np.ndarray:
        parts = [self.logits(encode(windows[i : i + 2048])) for i in range(0, len(windows), 2048)]
        return self.calibrated(np.concatenate(parts) if parts else np.zeros(0))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        padded, best, pooled, hidden, z = self._forward(x)
        dz = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        dh = dz[:, None] * self.w["out"] * (1 - hidden * hidden)
        dp = (dh @ self.w["dense"].T) * (1 - pooled * pooled)
        g = {"out": hidden.T @ dz, "out_bias": dz.sum()[None], "dense": pooled.T @ dh,
             "dense_bias": dh.sum(0), "conv": np.zeros_like(self.w["conv"])}
        dp = dp.reshape(len(x), 3, self.filters)
        g["conv_bias"] = dp.sum((0, 1))
        rows, channel = np.arange(len(x))[:, None], np.arange(self.filters)[None]
        for r in range(3):
            for k in range(self.span):
                np.add.at(g["conv"][k], (padded[rows, best[r] + k], channel), dp[:, r])
        return g

    def fit(self, x, y, epochs: int, batch: int = 256, rate: float = 0.004, seed=1):
        parts = max(1, len(y) // batch)
        rng = np.random.default_rng(seed)
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        m, v = self.m, self.v
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(y)), parts):
                self.steps += 1
                for k, g in self.gradients(x[part], y[part], weight[part] / len(part)).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    hat = np.sqrt(v[k] / (1 - 0.999**self.steps)) + 1e-8
                    self.w[k] = self.w[k] - rate * m[k] / (1 - 0.9**self.steps) / hat
        return self

    def calibrate(self, sums) -> None:
        """Logistic regression of the labels on the logit, by Newton steps; a ridge keeps the slope near 1.

        ``sums(a, b)``, with p the probability at the slope a and the shift b, r = p - label and s = p (1 - p),
        gives the sums of r z, r, s z z, s z and s over all logits z.
        """
        a, b = 1.0, 0.0
        for _ in range(30):
            rz, r, szz, sz, s = sums(a, b)
            step = np.linalg.solve([[szz + 1, sz], [sz, s + 1]], [rz + (a - 1), r + b])
            a, b = a - step[0], b - step[1]
            if not np.isfinite([a, b]).all() or np.abs(step).max() < 1e-9:
                break
        if np.isfinite([a, b]).all() and a > 0:
            self.slope, self.shift = float(a), float(b)


def epochs_of(n: int, batch: int = 256) -> int:
    """How often to go through ``n`` windows: small numbers more often."""
    return max(ROUNDS, -(-STEPS // max(1, n // batch)))


_SHAPES = (
    ("digits", r"[0-9]+"), ("lower hex", r"[0-9a-f]+"), ("upper", r"[A-Z0-9]+"), ("lower", r"[a-z0-9]+"),
    ("letters", r"[A-Za-z0-9]+"), ("signs", r"[A-Za-z0-9+/_.=-]+"),
)


def shape(window_text: str) -> str:
    """The alphabet of the candidate, and whether it is short or fills the window: each has a threshold."""
    inside = window_text[BEFORE : BEFORE + INSIDE].rstrip("\0")
    name = next((name for name, letters in _SHAPES if re.fullmatch(letters, inside)), "any")
    length = "short " if len(inside) < INSIDE // 2 else "long " if len(inside) == INSIDE else ""
    return length + name


_DIGITS = "0123456789"
_SMALL = "abcdefghijklmnopqrstuvwxyz"
#: Alphabets in which a labelled secret is spelled anew; the first two letters of "_" are a prefix.
_ALPHABETS = (
    _DIGITS + "abcdef", _DIGITS + "ABCDEF", _DIGITS + _SMALL, _DIGITS + _SMALL.upper(),
    _DIGITS + _SMALL + _SMALL.upper(), _DIGITS + _SMALL + _SMALL.upper(),
    _DIGITS + _SMALL + _SMALL.upper() + "+/", _DIGITS + _SMALL + _SMALL.upper() + "_-",
)
_SIGNS = "!#$%&*+-?@^_~"


def respelled(rng) -> str:
    """A key in some alphabet and length: 16 to 160 letters, or 8 to 15 that mix with signs."""
    if rng.random() < 0.15:
        letters = _DIGITS + _SMALL + _SMALL.upper() + _SIGNS
        some = [rng.choice(list(a)) for a in (_DIGITS, _SMALL, _SMALL.upper())]
        some += list(rng.choice(list(letters), int(rng.integers(5, 13))))
        return "".join(rng.permutation(some))
    letters = _ALPHABETS[int(rng.integers(len(_ALPHABETS)))]
    length = int(rng.integers(16, 49)) if rng.random() < 0.7 else int(rng.integers(49, 161))
    key = "".join(rng.choice(list(letters), length))
    if rng.random() < 0.2:
        key = "".join(rng.choice(list(_SMALL), int(rng.integers(2, 5)))) + "_" + key
    return key


def compound(words: list[str], rng) -> str:
    """A run of common words, joined as in paths, names and labels: not a secret."""
    chosen = [words[i] for i in rng.integers(0, len(words), int(rng.integers(1, 7)))]
    if rng.random() < 0.5:
        chosen = [w.capitalize() for w in chosen]
    end = str(rng.integers(0, 10_000)) if len(chosen) < 3 or rng.random() < 0.5 else ""
    return str(rng.choice(["", "", "-", "_", "/", ".", "="])).join([*chosen, end] if end else chosen)


def planted(secret: str, other: str, rng) -> str:
    """The window ``other``, which its candidate fills, with the secret at some place inside."""
    value = secret[BEFORE : BEFORE + INSIDE].rstrip("\0")
    at = BEFORE + int(rng.integers(0, INSIDE - len(value) + 1))
    return other[:at] + value + other[at + len(value) :]


def examples(
    known: list[str], other: list[str], rng, around: list[str] | None = None
) -> tuple[list[str], np.ndarray]:
    """Windows to learn from and their labels.

    The secrets are also shown with the surroundings of other candidates, so that a secret is
    recognized without the words that the rules look for, inside the windows of
    long candidates, if there are any, and spelled anew in other alphabets and lengths, twice as
    often. Against these stand as many runs of common words of the surroundings. The surroundings
    are those of ``around``, by default of ``other``.
    """
    around = other if around is None else around
    moved = [
        around[j][:BEFORE] + k[BEFORE : BEFORE + INSIDE] + around[j][BEFORE + INSIDE :]
        for k, j in zip(known, rng.integers(0, len(around), len(known)), strict=True)
    ]
    long = [w for w in around if w[BEFORE + INSIDE - 1] != "\0"]
    if long:
        moved += [planted(k, long[j], rng)
                  for k, j in zip(known, rng.integers(0, len(long), len(known)), strict=True)]
    words = [w for o in around for w in re.findall(r"[^\W\d_]{2,}", f"{o[:BEFORE]} {o[-AFTER:]}")]

    def shown(value: str) -> str:
        """One of the windows of ``value``, set apart in the surroundings of some candidate."""
        near = around[int(rng.integers(len(around)))]
        before = near[:BEFORE].rsplit(" ", 1)[0] + str(rng.choice([" ", " ", ' "', "=", ": "]))
        after = str(rng.choice([" ", " ", '"', ". ", ","])) + near[-AFTER:].split(" ", 1)[-1]
        text = before[-BEFORE:].rjust(BEFORE, "\0") + value
        windows = cut(window(text + after, BEFORE, len(text)))
        return windows[int(rng.integers(len(windows)))][1]

    moved += [shown(respelled(rng)) for _ in range(2 * len(known))]
    runs = [shown(compound(words, rng)) for _ in range(2 * len(known))] if words else []
    labels = [1.0] * (len(known) + len(moved)) + [0.0] * (len(other) + len(runs))
    return [*known, *moved, *other, *runs], np.array(labels)


def held_out(texts: list[str]) -> np.ndarray:
    """A quarter of all windows; equal windows fall on the same side, in every group and round."""
    return np.array(
        [hashlib.blake2b(t.encode(), digest_size=1).digest()[0] % 4 == 0 for t in texts], dtype=bool
    )


def _at(n: int, recall: float) -> int:
    """The place, from 0, of the logit that ``recall`` of ``n`` ascending ones reach."""
    return int((n - 1) * (1 - recall))


def thresholds_of(
    net: CharNet, reached: dict[str, tuple[int, float]], highest: dict[str, float], least: int
) -> dict[str, float]:
    """The probability to reach overall ("") and for each shape.

    ``reached`` has for each shape, and overall, the number of held-out secrets and the logit that
    enough of them reach, ``highest`` for each shape the highest logit of what is no secret.
    """
    out = {"": float(net.calibrated(reached[""][1]))}
    for kind, (n, z) in reached.items():
        if n >= least:
            out[kind] = float(net.calibrated(z))
    # where recall cannot be measured, a finding has to stand out from all that is no secret
    for kind in set(highest) - set(out):
        out[kind] = max(out[""], float(np.nextafter(net.calibrated(highest[kind]), 2)))
    return out


def train(
    known: list[str], other: list[str], recall: float = 0.995, least: int = 20, seed: int = 1
) -> tuple[CharNet, dict[str, float]] | None:
    """The network and its thresholds: for each shape with ``least`` held-out secrets, and overall.

    What ``train_on_all`` does, for windows that are one group. None without at least ``least``
    examples of either class.
    """
    if min(len(known), len(other)) < least:
        return None
    texts, y = examples(known, other, np.random.default_rng(seed))
    held, x = held_out(texts), encode(texts)
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 1:
        return None
    net = CharNet(seed=seed).fit(x[~held], y[~held], epochs_of(int((~held).sum())), seed=seed)
    z, label = net.logits(x), y > 0

    def sums(a, b):
        p = 1 / (1 + np.exp(-np.clip(a * z[held] + b, -50, 50)))
        r, s, zh = p - y[held], p * (1 - p), z[held]
        return (r * zh).sum(), r.sum(), (s * zh * zh).sum(), (s * zh).sum(), s.sum()

    net.calibrate(sums)
    kinds = np.array([shape(t) for t in texts])
    real = held & label  # secrets of both kinds: with the words that the rules look for, and without them
    reached = {}
    for kind in ("", *set(kinds[real])):
        ascending = np.sort(z[real & ((kinds == kind) | (kind == ""))])
        reached[kind] = (len(ascending), ascending[_at(len(ascending), recall)])
    highest = {kind: z[~label & (kinds == kind)].max() for kind in set(kinds[~label])}
    return net, thresholds_of(net, reached, highest, least)


def training_windows(found: DataFrame) -> DataFrame:
    """``known, window``: every distinct window of the rules' findings and of the other candidates."""

    def of(column: str, known: bool) -> DataFrame:
        around = found.select(F.explode(column).alias("c")).select(F.col("c.window").alias("w"))
        # as cut() does; nearly all have one window
        return around.select(F.lit(known).alias("known"), F.explode(F.expr(
            f"transform(sequence(0, cast(ceil((length(w) - {WIDTH}) / {STEP}) as int)), "
            f"i -> substring(w, 1 + least({STEP} * i, length(w) - {WIDTH}), {WIDTH}))"
        )).alias("window"))

    return of("known", True).union(of("open", False)).distinct()


def dealt(windows: DataFrame, n_known: int, n_other: int) -> DataFrame:
    """``windows`` with their group, and ``copy``, which is above 0 where a group borrows a window.

    Groups go by hash. Of a class too rare to give every group ``BOTH`` windows, each stands in
    several groups.
    """
    groups = -(-(n_known + n_other) // GROUP)
    copies = [min(groups, -(-BOTH * groups // n)) for n in (n_known, n_other)]
    last = F.when(F.col("known"), F.lit(copies[0] - 1)).otherwise(F.lit(copies[1] - 1))
    placed = windows.select("known", "window", F.explode(F.sequence(F.lit(0), last)).alias("copy"))
    group = F.pmod(F.xxhash64("window") + F.col("copy"), F.lit(groups))
    # as many partitions as groups, however few bytes they have: training them is the work
    return placed.withColumn("group", group).repartition(groups, "group")


def train_on_all(
    windows: DataFrame, recall: float = 0.995, least: int = 20, seed: int = 1
) -> tuple[CharNet, dict[str, float]] | None:
    """``train`` for any number of distinct windows, all of which take part.

    Every round goes over all windows: each group goes on from the network of the round before, and
    Spark averages what the groups learned. Calibration and thresholds come from all held-out windows.
    The driver receives one network a round, sums, and a threshold for each shape.
    """
    windows = written(windows, "secret-windows")
    n = {r["known"]: r["n"] for r in windows.groupBy("known").agg(F.count("*").alias("n")).collect()}
    if min(n.get(True, 0), n.get(False, 0)) < least:
        return None
    groups = dealt(windows, n[True], n[False]).groupBy("group")
    alone = n[True] + n[False] <= GROUP  # nothing to average: all rounds at once
    net = CharNet(seed=seed)

    def classes(pdf):
        pdf = pdf.sort_values(["known", "window"], kind="stable")
        known = pdf["known"].to_numpy()
        return pdf["window"].to_numpy(), known, pdf["copy"].to_numpy() == 0

    def learning(number: int, start: np.ndarray):
        def learn(key, pdf):
            texts, known, _ = classes(pdf)
            texts, y = examples(
                texts[known].tolist(), texts[~known].tolist(),
                np.random.default_rng([seed, number, int(key[0])]),
            )
            held = held_out(texts)
            x, y = encode(texts)[~held], y[~held]
            own, epochs = CharNet(seed=seed), epochs_of(len(y))
            own.put(start)
            own.fit(x, y, epochs if alone else -(-epochs // ROUNDS), seed=[seed, number, int(key[0])])
            return in_parts(own.vector(), len(y))

        return learn

    for number in range(1 if alone else ROUNDS):
        net.put(averaged(groups.applyInPandas(learning(number, net.vector()), PARTS)))

    def score(key, pdf):
        texts, known, own = classes(pdf)
        texts, y = examples(
            texts[known & own].tolist(), texts[~known & own].tolist(),
            np.random.default_rng([seed, ROUNDS, int(key[0])]), texts[~known].tolist(),
        )
        z = net.logits(encode(texts))
        return pd.DataFrame({"shape": [shape(t) for t in texts], "known": y > 0,
                             "held": held_out(texts), "z": z})

    scores = written(
        groups.applyInPandas(score, "shape string, known boolean, held boolean, z double"),
        "secret-scores",
    )
    if scores.select("known", "held").distinct().count() < 4:
        return None
    held = scores.where("held")

    def sums(a, b):
        z, p = F.col("z"), F.col("p")
        margin = F.least(F.greatest(a * z + b, F.lit(-50.0)), F.lit(50.0))
        r, s = p - F.col("known").cast("double"), p * (1 - p)
        row = held.withColumn("p", 1 / (1 + F.exp(-margin))).agg(
            F.sum(r * z), F.sum(r), F.sum(s * z * z), F.sum(s * z), F.sum(s)
        )
        return tuple(row.first())

    net.calibrate(sums)
    real = held.where("known").select(F.explode(F.array(F.lit(""), "shape")).alias("shape"), "z")
    n_real = {r["shape"]: r["n"] for r in real.groupBy("shape").agg(F.count("*").alias("n")).collect()}
    # only the lowest logits move: Spark keeps no more of a shape than the largest needs
    place = F.row_number().over(Window.partitionBy("shape").orderBy("z")).alias("place")
    lowest = real.select("shape", "z", place).where(F.col("place") <= _at(n_real[""], recall) + 1)
    wanted = F.lit(False)
    for kind, count in n_real.items():
        wanted |= (F.col("shape") == kind) & (F.col("place") == _at(count, recall) + 1)
    reached = {r["shape"]: (n_real[r["shape"]], r["z"]) for r in lowest.where(wanted).collect()}
    no_secret = scores.where("NOT known").groupBy("shape").agg(F.max("z").alias("z")).collect()
    return net, thresholds_of(net, reached, {r["shape"]: r["z"] for r in no_secret}, least)


def _candidates_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return written(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
            _scan, _FOUND
        ),
        "secret-candidates",
    )


def judged(model, windows: list[str]) -> np.ndarray:
    """The network's probability where it reaches the threshold, else 0."""
    if not model or not windows:
        return np.zeros(len(windows))
    net, thresholds = model
    p = net.probability(windows)
    return np.where(p >= np.array([thresholds.get(shape(w), thresholds[""]) for w in windows]), p, 0.0)


def judged_spans(
    model, runs: list[tuple[int, int, str]], most: int = 65_536
) -> list[list[tuple[int, int, float]]]:
    """For each ``start, end, window`` the ``start, end, score`` that the network reports in it.

    These are the windows that reach the threshold, touching ones joined, with the
    highest of their scores; each grows to the separators around it, or to the ends of its run. About
    ``most`` windows are held at a time.
    """
    out: list[list[tuple[int, int, float]]] = []
    held: list[tuple[int, int, int, str]] = []

    def flush():
        for (run, a, b, _), score in zip(held, judged(model, [h[3] for h in held]), strict=True):
            if score <= 0:
                continue
            if out[run] and a <= out[run][-1][1]:
                first, _, top = out[run].pop()
                out[run].append((first, b, max(top, float(score))))
            else:
                out[run].append((a, b, float(score)))
        held.clear()

    for start, end, around in runs:
        for at, text in cut(around):
            held.append((len(out), start + at, min(end, start + at + INSIDE), text))
        out.append([])
        if len(held) >= most:
            flush()
    flush()
    return [_grown(run, spans) if spans else spans for run, spans in zip(runs, out, strict=True)]


def _grown(run: tuple[int, int, str], spans: list[tuple[int, int, float]]):
    """Each span up to the separators around it, those that meet joined."""
    start, end, around = run
    inside, out = around[BEFORE : BEFORE + end - start], []
    for a, b, score in spans:
        a, b = a - start, b - start
        while a and inside[a - 1] not in _SEPARATORS:
            a -= 1
        while b < len(inside) and inside[b] not in _SEPARATORS:
            b += 1
        if out and start + a <= out[-1][1]:
            first, _, top = out.pop()
            out.append((first, start + b, max(top, score)))
        else:
            out.append((start + a, start + b, score))
    return out


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.995
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base, spans, learned`` of every whole text.

    ``spans``: array of ``kind, start, end, score`` by start, then kind; code points, end
    exclusive; rules score 1. ``base`` names the rules' spans as text, ``learned`` counts the others. The
    network learns from all findings and all other candidates; with too few of either only the
    rules speak. NULL text counts as empty, NULL ids are kept, repeated rows stay, an empty table
    gives no rows.
    """
    found = _candidates_of(docs, id_col, text_col)
    model = train_on_all(training_windows(found), recall)
    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base string, "
        "spans array<struct<kind:string,start:long,end:long,score:double>>, learned long"
    )
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                ("score", pa.float64())]))

    def judge(batches):
        for batch in batches:
            base = batch.column("base").to_pylist()
            runs = [a + b for a, b in zip(batch.column("open").to_pylist(),
                                          batch.column("parts").to_pylist(), strict=True)]
            keep = judged_spans(
                model, [(c["start"], c["end"], c["window"]) for part in runs for c in part]
            )
            out, learned, at = [], [], 0
            for text, part in zip(base, runs, strict=True):
                named = [s.split(":") for s in text.split(",") if s]
                all_spans = [(int(a), KINDS.index(k), int(b), 1.0) for k, a, b in named]
                extra = [(a, len(KINDS), b, score)
                         for found in keep[at : at + len(part)] for a, b, score in found]
                at += len(part)
                learned.append(len(extra))
                out.append([
                    {"kind": (*KINDS, LEARNED)[k], "start": a, "end": b, "score": s}
                    for a, k, b, s in sorted(all_spans + extra)
                ])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(out, spans), pa.array(learned, pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "learned"],
            )

    return found.drop("known").mapInArrow(judge, schema)


def redact_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]",
    recall: float = 0.995,
) -> DataFrame:
    """``docs`` with every span that ``find_secrets`` finds replaced by ``mask``; other texts stay as they are.

    So do NULL texts, ids (NULL or repeated), all other columns, and the number of rows; an empty table
    stays empty.
    """
    found = _candidates_of(docs, id_col, text_col)
    model = train_on_all(training_windows(found), recall)

    @F.pandas_udf(StringType())
    def masked(texts: pd.Series) -> pd.Series:
        # the network is asked once for all texts of a batch
        rows, runs = [], []
        for text in texts:
            base = base_spans(text or "")
            mine = [(a, b, window(text, a, b)) for part in split_runs(text or "", base) for a, b in part]
            rows.append((text, [(a, b) for a, _, b, _ in base], len(mine)))
            runs += mine
        keep, out = iter(judged_spans(model, runs)), []
        for text, spans, n in rows:
            spans += [(a, b) for _ in range(n) for a, b, _ in next(keep)]
            out.append(redacted(text, spans, mask))
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, masked(F.col(text_col)))


def redacted(text: str | None, spans: list[tuple[int, int]], mask: str = "[SECRET]") -> str | None:
    """``text`` with each group of overlapping spans replaced by ``mask``."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
