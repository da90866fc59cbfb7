"""Quality rules: fixed rules of thumb, and a calibrated logistic regression on hashed n-grams.

The classifier reads hashed words and hashed byte n-grams. It is fitted on a bounded sample of labelled rows, its scores
are turned into probabilities on rows kept out of the fit, and it is applied to all documents in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

WORD_BUCKETS = 1 << 14
GRAM_BUCKETS = 1 << 14
BUCKETS = WORD_BUCKETS + GRAM_BUCKETS
GRAM_BYTES = 3
SAMPLE_PER_CLASS = 2000
HOLDOUT = 5
LEAST_PROBABILITY = 0.5
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words inside a three-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + ids[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    many = count[place] > 1
    hit = np.zeros(len(words), bool)
    for shift in range(3):
        hit[shift:shift + len(many)] |= many
    return int(hit.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n += line in seen
            seen.add(line)
    return n


def measures(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(text),
        repeated_words(words))


def features(raw: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text: damped counts, words and byte n-grams each scaled to length one."""
    known: dict[bytes, int] = {}
    for word in words:
        known[word] = known.get(word, 0) + 1
    hashed = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in known), np.int64, len(known))
    by_word = np.bincount(hashed, np.fromiter(known.values(), float, len(known)), WORD_BUCKETS)
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(data) >= GRAM_BYTES:
        grams = np.zeros(len(data) - GRAM_BYTES + 1, np.uint32)
        for i in range(GRAM_BYTES):
            grams = (grams << np.uint32(8)) + data[i:len(data) - GRAM_BYTES + 1 + i]
        by_gram = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(18), minlength=GRAM_BUCKETS)
    else:
        by_gram = np.zeros(GRAM_BUCKETS)
    parts = []
    for offset, counts in ((0, by_word), (WORD_BUCKETS, by_gram)):
        place = np.flatnonzero(counts)
        damped = np.log1p(counts[place])
        parts.append((place + offset, damped / max(np.sqrt((damped**2).sum()), 1e-9)))
    return np.concatenate([parts[0][0], parts[1][0]]), np.concatenate([parts[0][1], parts[1][1]])


@dataclass(frozen=True)
class QualityModel:
    """Weights per bucket, intercept, and the two numbers that turn a score into a probability."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def probability(self, raw: bytes, words: list[bytes]) -> float:
        place, weight = features(raw, words)
        score = float(self.weights[place] @ weight) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -500, 500))))


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ridge: float = 1e-4, steps: int = 120) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sparse rows by accelerated gradient steps, classes weighing alike."""
    place = np.concatenate([r[0] for r in rows])
    weight = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    w, b = np.zeros(BUCKETS), 0.0
    ahead, b_ahead, t = w.copy(), b, 1.0
    rate = 1.3  # rows have squared length 2 and an intercept: the curvature is at most 3 / 4
    for _ in range(steps):
        score = np.bincount(row, ahead[place] * weight, len(rows)) + b_ahead
        miss = (1 / (1 + np.exp(-np.clip(score, -500, 500))) - labels) * share
        gradient = np.bincount(place, miss[row] * weight, BUCKETS) + ridge * ahead
        new, new_b = ahead - rate * gradient, b_ahead - rate * miss.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, b_ahead = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, float(b)


def _calibrate(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that gives held-out scores their frequencies, with smoothed targets."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack([scores, np.ones(len(scores))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        curve = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (target - p))
        beta = beta + step / max(1.0, np.abs(step).max())
    return float(beta[0]), float(beta[1])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> QualityModel | None:
    """The classifier of `label_col` (1 good, 0 bad), from at most `per_class` labelled rows of each class.

    The sample is the labelled ids with the smallest hashes. A fifth of it, by hash, only calibrates. Null labels, ids
    and texts are left out, as are ids with both labels. None when a class has no row to fit or to calibrate on.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label"))
    known = known.filter("id is not null and label in (0, 1)").groupBy("id").agg(
        F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    order = F.xxhash64(F.lit("sample"), F.col("id"))
    sample = None
    for value in (0, 1):
        own = known.filter(F.col("label") == value).orderBy(order, "id").limit(per_class).select("id", "label")
        sample = own if sample is None else sample.union(own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [features(raw, raw.split()) for raw in (t.encode("utf-8", "replace") for t in batch["text"])]
            yield pd.DataFrame({
                "id": batch["id"].astype(str), "label": batch["label"], "fold": batch["fold"],
                "place": [p.astype(np.int32).tobytes() for p, _ in pairs],
                "weight": [w.astype(np.float32).tobytes() for _, w in pairs]})

    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter("text is not null")
    joined = texts.join(F.broadcast(sample), "id").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(HOLDOUT)))
    rows = joined.mapInPandas(run, "id string, label int, fold long, place binary, weight binary").collect()
    rows = sorted({(r["id"], r["label"]): r for r in rows}.values(), key=lambda r: r["id"])
    pairs = [(np.frombuffer(r["place"], np.int32), np.frombuffer(r["weight"], np.float32).astype(float)) for r in rows]
    label = np.array([r["label"] for r in rows], float)
    held = np.array([r["fold"] == 0 for r in rows], bool)
    if any(not (label[own] == value).any() for own in (held, ~held) for value in (0, 1)):
        return None
    weights, intercept = _fit([p for p, h in zip(pairs, held) if not h], label[~held])
    scores = np.array([weights[p] @ w + intercept for (p, w), h in zip(pairs, held) if h])
    return QualityModel(weights.astype(np.float32), intercept, *_calibrate(scores, label[held]))


def judge_quality(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, the five measures, `base_failed`, `probability` and `kept`.

    A text fails the rules with fewer than 50 words, or with more than half of them in repeated three-word windows; null
    and empty texts have no words and fail. Other texts are kept if their probability of being good is a half or more,
    and always without a model (`probability` null). Repeated rows give equal rows, an empty table an empty one.
    """
    @F.pandas_udf(
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "probability double, kept boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            raw = text.encode("utf-8", "replace")
            words = raw.split()
            own = measures(text, words)
            failed = own[0] < LEAST_WORDS or 100 * own[4] > MOST_REPEATED_PERCENT * own[0]
            p = model.probability(raw, words) if model else None
            rows.append((*own, failed, p, not failed and (p is None or p >= LEAST_PROBABILITY)))
        return pd.DataFrame(rows, columns=[
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"])

    return docs.select(docs[id_col], judged(docs[text_col]).alias("judged")).select(id_col, "judged.*")


def keep_good(docs: DataFrame, model: QualityModel | None, text_col: str = "text") -> DataFrame:
    """The documents that pass, columns as they are: the verdict is a column of the same row, so nothing is joined."""
    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        verdicts = []
        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            words = raw.split()
            verdicts.append(
                len(words) >= LEAST_WORDS and 100 * repeated_words(words) <= MOST_REPEATED_PERCENT * len(words)
                and (model is None or model.probability(raw, words) >= LEAST_PROBABILITY))
        return pd.Series(verdicts, dtype=bool)

    return docs.filter(good(docs[text_col]))
