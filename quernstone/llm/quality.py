"""Operator 5: a quality classifier by co-training of two views.

One classifier sees the text (letters, repetition, word shape), the other what is known
about the page (source, language, size, layout). Each starts from the labelled
documents; round by round each hands the unlabelled documents of which it is sure to
the other, as if labelled. Both are calibrated on labelled documents that neither
learned from, and a last small model weighs the two.

The classifiers are fitted on bounded samples, chosen by a hash of the id; every
document is then scored, in whole.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled and unlabelled documents that the classifiers may see.
LABELLED, POOL = 6_000, 6_000
_LANGS, _SOURCES = 8, 32


def content_features(text: str | None) -> np.ndarray:
    """Shares of the ASCII letters, and how words repeat and look. Zero for an empty text."""
    raw = (text or "").encode()
    out = np.zeros(137, "f4")
    words = raw.split()
    if not words:
        return out
    letters = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    out[:128] = np.sqrt(letters[:128] / len(raw))
    out[128] = letters[128:].sum() / len(raw)
    n = len(words)
    counts = Counter(words)
    capital = letters[65:91].sum()
    out[129] = sum(map(eq, words, words[1:])) / n
    out[130] = len(counts) / n
    out[131] = max(counts.values()) / n
    out[132] = np.log1p(n) / 10
    out[133] = capital / max(1, capital + letters[97:123].sum())
    out[134] = np.log1p(sum(map(len, words)) / n)
    marks = letters[33:48].sum() + letters[58:65].sum() + letters[91:97].sum() + letters[123:127].sum()
    out[135] = min(3.0, marks / n)
    out[136] = sum(c for c in counts.values() if c > 1) / n
    return out


def _bucket(value, n: int) -> int:
    import zlib

    return zlib.crc32(("" if value is None else str(value)).encode()) % n


def page_features(text: str | None, lang, source) -> np.ndarray:
    """Size and layout of the page, language and source by hashed places (NULL has one too)."""
    out = np.zeros(5 + _LANGS + _SOURCES, "f4")
    text = text or ""
    lines = text.split("\n")
    out[0] = np.log1p(len(text)) / 10
    out[1] = np.log1p(len(lines)) / 5
    out[2] = np.log1p(len(text) / len(lines)) / 10
    out[3] = np.log1p(max(map(len, lines))) / 10
    out[4] = np.log1p(min(map(len, lines))) / 10
    out[5 + _bucket(lang, _LANGS)] = 1
    out[5 + _LANGS + _bucket(source, _SOURCES)] = 1
    return out


class Logistic:
    """Logistic regression on standardized features, classes weighed equally, Newton steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 15):
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        z = self._with_one(x)
        w = np.zeros(z.shape[1])
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve = weight * p * (1 - p)
            step = np.linalg.solve(
                (z * curve[:, None]).T @ z + np.diag(penalty),
                z.T @ (weight * (p - y)) + penalty * w,
            )
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def _with_one(self, x):
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._with_one(x) @ self.w, -30, 30)


class View:
    """One classifier and its calibration to the true share of good documents."""

    def fit(self, x, y, held_x, held_y):
        self.model = Logistic().fit(x, y)
        z, a, b = self.model.logit(held_x), 1.0, 0.0
        for _ in range(25):  # held-out labels on the logit, with a ridge towards no change
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            r, s = p - held_y, p * (1 - p)
            g = np.array([r @ z + 0.1 * (a - 1), r.sum() + 0.1 * b])
            h = np.array([[s @ (z * z), s @ z], [s @ z, s.sum()]]) + 0.1 * np.eye(2)
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        self.slope, self.shift = max(0.0, float(a)), float(b)
        return self

    def probability(self, x) -> np.ndarray:
        z = np.clip(self.slope * self.model.logit(x) + self.shift, -30, 30)
        return 1 / (1 + np.exp(-z))


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sure_from(chance: np.ndarray, right: np.ndarray, sure: float) -> float:
    """The least chance above which the judgements tried were right often enough; above 1 if none.

    One more error than seen is assumed, so a few right judgements prove nothing.
    """
    order = np.argsort(-chance, kind="stable")
    errors = np.cumsum(~right[order])
    share = (errors + 1) / (np.arange(len(order)) + 3)
    good = np.flatnonzero(share <= 1 - sure)
    return max(0.5, float(chance[order[good[-1]]])) if len(good) else 2.0


class QualityModel:
    """Two views, their combination, and the score below which a document is rejected."""

    def __init__(self, content: View, page: View, combined: View, threshold: float, taught: list):
        self.content, self.page, self.combined = content, page, combined
        self.threshold, self.taught = threshold, taught

    def score(self, x: np.ndarray, m: np.ndarray):
        a, b = self.content.probability(x), self.page.probability(m)
        return a, b, self.combined.probability(np.stack([_odds(a), _odds(b)], axis=1))


def co_train(
    content: np.ndarray, page: np.ndarray, y: np.ndarray, pool_content: np.ndarray,
    pool_page: np.ndarray, rounds: int = 5, each: int = 200, sure: float = 0.98,
    lost: float = 0.005, least: int = 10, seed: int = 5,
) -> QualityModel | None:
    """Fit on labelled rows and an unlabelled pool; None with under ``least`` rows of either class.

    In each round a view gives the other at most ``each`` documents of each class of which
    it is sure: above a probability from which on the share ``sure`` of its held-out judgements
    was right. The threshold is 0.5, or lower, down to 0.1, where more than the share ``lost`` of the
    held-out good documents would be rejected.
    """
    if min(y.sum(), (1 - y).sum()) < least:
        return None
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for value in (0, 1):  # a third of either class calibrates
        rows = np.flatnonzero(y == value)
        held[rng.permutation(rows)[: max(1, len(rows) // 3)]] = True
    views = [content, page]
    pools = [pool_content, pool_page]
    x = [v[~held] for v in views]
    labels = [y[~held], y[~held]]
    free = [np.ones(len(pool_content), bool), np.ones(len(pool_content), bool)]
    taught = []
    for number in range(rounds + 1):
        fitted = [View().fit(x[i], labels[i], views[i][held], y[held]) for i in (0, 1)]
        if number == rounds or not len(pool_content):
            break
        given = []
        for i, other in ((0, 1), (1, 0)):
            p, q = fitted[i].probability(pools[i]), fitted[i].probability(views[i][held])
            for value, chance, tried in ((1.0, p, q), (0.0, 1 - p, 1 - q)):
                least_chance = _sure_from(tried, y[held] == value, sure)
                rows = np.flatnonzero((chance >= least_chance) & free[other])
                rows = rows[np.argsort(-chance[rows], kind="stable")][:each]
                free[other][rows] = False
                given.append((other, rows, value))
        for other, rows, value in given:
            x[other] = np.concatenate([x[other], pools[other][rows]])
            labels[other] = np.concatenate([labels[other], np.full(len(rows), value)])
        taught.append([len(rows) for _, rows, _ in given])
    both = np.stack([_odds(fitted[i].probability(views[i][held])) for i in (0, 1)], axis=1)
    combined = View().fit(both, y[held], both, y[held])
    good = np.sort(combined.probability(both)[y[held] == 1])
    threshold = float(np.clip(good[min(len(good) - 1, max(1, int(lost * len(good))))], 0.1, 0.5))
    return QualityModel(*fitted, combined, threshold, taught)


def _features(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    content = np.stack([content_features(t) for t in rows["text"]])
    columns = zip(rows["text"], rows["lang"], rows["source"], strict=True)
    return content, np.stack([page_features(*c) for c in columns])


def fit_quality(
    docs: DataFrame, labels: DataFrame, most_labelled: int = LABELLED, most_pool: int = POOL,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> QualityModel | None:
    """Fit on at most ``most_labelled`` labelled and ``most_pool`` other documents.

    ``docs`` has ``lang`` and ``source`` too. NULL labels, ids and empty texts teach nothing; a
    document labelled twice counts as good if most of its labels do.
    """
    given = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("y"))
    )
    texts = docs.where(F.col(id_col).isNotNull() & (F.length(F.trim(text_col)) > 0)).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), "lang", "source"
    )
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40))
    n_given, n_docs = given.count(), texts.count()
    below = lambda most, n: place < int((1 << 40) * min(1.0, most / max(1, n)))
    # a little more than the bound passes the hash, the rest is cut by order of the hash
    chosen = given.where(below(most_labelled, n_given)).orderBy(place, "id").limit(most_labelled)
    labelled = texts.join(chosen, "id")
    pool = texts.where(below(most_pool, n_docs)).join(given, "id", "left_anti")

    def run(batches):
        for pdf in batches:
            if len(pdf):
                content, page = _features(pdf)
                yield pd.DataFrame({
                    "id": pdf["id"], "y": pdf["y"],
                    "content": [r.tobytes() for r in content], "page": [r.tobytes() for r in page],
                })

    schema = "id long, y double, content binary, page binary"
    taken = []
    for df, most in ((labelled, most_labelled), (pool.withColumn("y", F.lit(0.0)), most_pool)):
        rows = df.mapInPandas(run, schema).orderBy(place, "id", "content").limit(most).collect()
        matrices = [np.stack([np.frombuffer(r[c], "f4") for r in rows]).astype("f8")
                    if rows else np.zeros((0, 0)) for c in ("content", "page")]
        taken.append((*matrices, np.array([r["y"] for r in rows])))
    (content, page, y), (pool_content, pool_page, _) = taken
    if not len(y):
        return None
    if not len(pool_content):
        pool_content, pool_page = content[:0], page[:0]
    return co_train(content, page, y, pool_content, pool_page)


def quality_of(model: QualityModel | None, text: Column, lang: Column, source: Column) -> Column:
    """Struct of ``p_content, p_page, score, kept`` for every row.

    An empty or NULL text has nothing to judge: all scores 0, not kept. Without a model
    (too few labels) all others score 1 and are kept.
    """

    @F.pandas_udf("p_content double, p_page double, score double, kept boolean")
    def judged(text: pd.Series, lang: pd.Series, source: pd.Series) -> pd.DataFrame:
        some = np.array([t is not None and bool(t.strip()) for t in text], bool)
        if model is None:
            a = b = s = some.astype("f8")
            kept = some
        else:
            rows = pd.DataFrame({"text": text, "lang": lang, "source": source})
            parts = [model.score(*_features(rows.iloc[i : i + 512])) for i in range(0, len(rows), 512)]
            a, b, s = (np.concatenate([p[k] for p in parts]) * some for k in range(3))
            kept = some & (s >= model.threshold)
        return pd.DataFrame({"p_content": a, "p_page": b, "score": s, "kept": kept})

    return judged(text, lang, source)


def classify_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, p_content, p_page, score, kept`` for every row of ``docs`` (``doc_id, text, lang, source``).

    NULL ids are kept, repeated rows score alike, an empty table gives no rows.
    """
    model = fit_quality(docs, labels, **options)
    found = quality_of(model, F.col("text"), F.col("lang"), F.col("source"))
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.*")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    model = fit_quality(docs, labels, **options)
    found = quality_of(model, F.col("text"), F.col("lang"), F.col("source"))
    return docs.where(found["kept"])
