"""Importance resampling towards a target corpus: bucket counts as bit planes, gains as signed bit planes.

Words (or short runs of words) are hashed into buckets. A bucket's gain is the scaled logarithm of its smoothed share in
the target over that in the corpus. A document's counts per bucket become bit planes, one per binary digit, each a bit per
bucket; so do the gains, positive and negative ones apart. ANDing a plane of each, counting bits and weighting with powers
of two adds up to the exact sum of gains over the document's features. Gumbel noise from a hash of the id turns
weights into a draw without replacement of the highest scores.
"""

from __future__ import annotations

from collections.abc import Iterator
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visitlens.llm.common import word_pieces, written
from visitlens.operators.skew import global_index

BUCKETS = 10_000
LONGEST_RUN = 1
GAIN_SCALE = 1000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10

DOCUMENTS_AT_ONCE = 128

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feature_buckets(text: bytes, buckets: int, longest: int) -> Iterator[np.ndarray]:
    """The buckets of the features of a text, a piece of the text at a time; single words first in every piece."""
    before: list[bytes] = []
    for words in word_pieces(text, _WORD):
        features = words
        for size in range(2, longest + 1):
            run = before[max(len(before) - size + 1, 0):] + words
            features = features + [b" ".join(run[i:i + size]) for i in range(len(run) - size + 1)]
        before = (before + words)[1 - longest:] if longest > 1 else []
        yield np.fromiter(map(zlib.crc32, features), np.int64, len(features)) % buckets


def document_counts(text: bytes, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Filled buckets of a text in order and how many features each holds."""
    parts = [np.unique(b, return_counts=True) for b in feature_buckets(text, buckets, longest)]
    if len(parts) < 2:
        return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    total = np.zeros(buckets, np.int64)
    for place, n in parts:
        total[place] += n
    filled = np.flatnonzero(total)
    return filled, total[filled]


# corpus counts and gains

def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """Rows (bucket, n) of the filled buckets of all texts; a task sends at most one row per bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for found in feature_buckets(text, buckets, longest):
                    np.add.at(total, found, 1)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(filled, pa.int32()), "n": pa.array(total[filled], pa.int64())})

    read = texts.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    return read.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = GAIN_SCALE) -> np.ndarray:
    """Gain per bucket from the counts of both, floor(scale * ln(smoothed target share / smoothed corpus share)).

    `buckets` rows of two numbers reach the driver, whatever the input.
    """
    def dense(counts: DataFrame) -> np.ndarray:
        total = np.zeros(buckets, np.int64)
        for bucket, n in counts.collect():
            total[bucket] = n
        return total

    s, t = dense(corpus).astype(float), dense(target).astype(float)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


# bit planes

def gain_planes(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the positive gains and of the sizes of the negative ones: [sign, digit, words of 64 buckets]."""
    size = np.stack([np.maximum(gains, 0), np.maximum(-gains, 0)])
    digits = max(int(size.max(initial=0)).bit_length(), 1)
    bits = (size[:, None, :] >> np.arange(digits)[None, :, None] & 1).astype(np.uint8)
    return _packed(bits), np.int64(1) << np.arange(digits, dtype=np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """0/1 along the last axis as words of 64 bits."""
    short = -bits.shape[-1] % 64
    padded = np.concatenate([bits, np.zeros((*bits.shape[:-1], short), np.uint8)], axis=-1)
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def count_planes(filled: list[np.ndarray], sums: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the documents' counts, empty ones left out: planes, and document and power of two of each."""
    planes, owner, power = [], [], []
    for doc, (place, count) in enumerate(zip(filled, sums)):
        for digit in range(int(count.max(initial=0)).bit_length()):
            own = place[count >> digit & 1 == 1]
            if len(own):
                plane = np.zeros(buckets, np.uint8)
                plane[own] = 1
                planes.append(np.packbits(plane, bitorder="little"))
                owner.append(doc)
                power.append(digit)
    width = -(-buckets // 64) * 8
    out = np.zeros((len(planes), width), np.uint8)
    if planes:
        out[:, :len(planes[0])] = np.stack(planes)
    return out.view(np.uint64), np.array(owner, np.int64), np.int64(1) << np.array(power, np.int64)


def plane_weights(filled: list[np.ndarray], sums: list[np.ndarray], buckets: int, gains: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sum of gains times counts per document: AND of planes, bits counted, powers of two added up."""
    planes, owner, power = count_planes(filled, sums, buckets)
    signed, digit_power = gains
    total = np.zeros(len(planes), np.int64)
    for digit in range(signed.shape[1]):
        for sign in (0, 1):
            common = np.bitwise_count(planes & signed[sign, digit]).sum(axis=1, dtype=np.int64)
            total += (1 - 2 * sign) * digit_power[digit] * common
    weights = np.zeros(len(filled), np.int64)
    np.add.at(weights, owner, total * power)
    return weights


def document_weights(
    docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, longest: int = LONGEST_RUN,
) -> DataFrame:
    """Rows (`id_col`, n_features, weight) of all documents; null texts have no features and weight 0."""
    buckets, planes = len(gains), gain_planes(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
                rows = batch.slice(part, DOCUMENTS_AT_ONCE)
                filled, sums = zip(*(document_counts(text, buckets, longest) for text in rows.column(1).to_pylist()))
                n = np.array([s.sum() for s in sums], np.int64)
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), pa.array(n, pa.int64()),
                    pa.array(plane_weights(filled, sums, buckets, planes), pa.int64())], names=["id", "n_features", "weight"])

    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(weigh, f"id {kind}, n_features long, weight long").withColumnRenamed("id", id_col)


# draw

def noise(id_col: str, seed: str = SEED, scale: int = GAIN_SCALE):
    """Scaled Gumbel noise, a function of the seed and the id only; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-float(scale) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def least_features(words: int, longest: int) -> int:
    """Features of a text of `words` words; more words never have fewer."""
    return sum(max(words - size + 1, 0) for size in range(1, longest + 1))


def importance_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST_RUN, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """Rows (`id_col`, n_features, weight, score, rank) of all documents; drawn ones have a rank from 1, others null.

    Features are all runs of one to `longest` words, repeats counted; words are runs of letters, digits and everything beyond
    ASCII, A-Z lower-cased. Of the N documents with `least_words` words or more the floor(percent * N / 100) highest scores
    are drawn, ties to the smaller id, a null id being the smallest. Null and empty texts have no features, weight 0 and are
    drawn only if `least_words` is 0. Repeated rows are documents of their own with equal scores. An empty target leaves
    gains of smoothing only, an empty corpus gives no rows. Other columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest), buckets)
    weighed = document_weights(docs, gains, id_col, text_col, longest)
    scored = written(weighed.withColumn("score", F.col("weight") + noise(id_col, seed)))
    many = F.col("n_features") >= least_features(least_words, longest)
    drawn = percent * scored.filter(many).count() // 100
    # A range sort numbers the documents that take part; the others stand behind them.
    placed = global_index(scored, [F.desc(many), F.desc("score"), F.asc_nulls_first(id_col)], "_place")
    rank = F.when(many & (F.col("_place") < drawn), F.col("_place") + 1)
    return placed.select(id_col, "n_features", "weight", "score", rank.alias("rank"))
