"""Near-duplicate groups by Order MinHash and banded alignment.

A sketch of a document samples, per hash function, the few occurrence-labelled word shingles with the smallest hashes and
keeps them in text order, so that two sketches agree when the texts share shingles and keep their order. Several sketches
make a band; documents that share a band become candidates of the band's first and last document, and candidates are
verified by aligning their shingles inside a band around the diagonal. Documents of bands that still hold several groups
then meet all documents of other groups with which they share a shingle among their rarest, as any similar pair must.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from visitlens.llm.common import written
from visitlens.llm.components import connected_components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 32
SKETCHES_PER_BAND = 3
KEPT_PER_SKETCH = 2
CELLS_AT_ONCE = 1 << 21
CHARACTERS_AT_ONCE = 1 << 19
WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Hashes of the word shingles of each text in text order; a text of fewer words, but not none, is one shingle.

    Texts are split in slices of about `CHARACTERS_AT_ONCE`, so that the words of a whole batch are never held at a time.
    """
    out, start, held = [], 0, 0
    for end, text in enumerate(texts, start=1):
        held += len(text)
        if held >= CHARACTERS_AT_ONCE or end == len(texts):
            out += _slice_hashes(texts[start:end], size)
            start, held = end, 0
    return out


def _slice_hashes(texts: list[str], size: int) -> list[np.ndarray]:
    known, found = {}, []
    for text in texts:
        own = [known.setdefault(w, len(known)) for w in WORD.findall(text.lower())]
        found.append(np.array(own, np.int64))
    hashed = pd.util.hash_array(np.array(list(known), dtype=object), categorize=False) if known else np.zeros(0, np.uint64)
    out = []
    for own in found:
        h = hashed[own]
        if not len(h):
            out.append(h.astype(np.uint64))
            continue
        n = min(size, len(h))
        total = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            total = _mixed(total * MIX + h[i:len(h) - n + 1 + i] + np.uint64(i))
        out.append(total)
    return out


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingles told apart by their occurrence number: the second of its kind differs from the first."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    starts = np.r_[True, ranked[1:] != ranked[:-1]]
    if starts.all():
        return shingles
    place = np.arange(len(ranked))
    number = place - np.maximum.accumulate(np.where(starts, place, 0))
    out = np.empty_like(shingles)
    out[order] = np.where(number > 0, _mixed(ranked + number.astype(np.uint64) * MIX), ranked)
    return out


def order_min_hash(shingles: np.ndarray, bands: int, per_band: int, kept: int) -> np.ndarray:
    """One number per band: its sketches, each the `kept` smallest labelled shingles in text order."""
    own = labelled(shingles)
    kept = min(kept, len(own))
    count = bands * per_band
    salts = _mixed(np.arange(1, count + 1, dtype=np.uint64) * MIX) | np.uint64(1)
    sketches = np.empty(count, np.uint64)
    step = max(1, CELLS_AT_ONCE // len(own))
    for low in range(0, count, step):
        values = own[None, :] * salts[low:low + step, None]
        rows = np.arange(len(values))
        place = np.empty((len(values), kept), np.int64)
        for i in range(kept):
            place[:, i] = values.argmin(axis=1)
            values[rows, place[:, i]] = np.iinfo(np.uint64).max
        place.sort(axis=1)
        total = np.zeros(len(values), np.uint64)
        for i in range(kept):
            total = _mixed(total * MIX + own[place[:, i]])
        sketches[low:low + step] = total
    total = np.zeros(bands, np.uint64)
    for own_band in sketches.reshape(bands, per_band).T:
        total = _mixed(total * MIX + own_band)
    return total


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Labelled shingles that align in order over all different ones: m / (len(a) + len(b) - m), m the longest alignment.

    An alignment worth `least` leaves so few shingles out that it never strays from the diagonal by more than these;
    matches beyond that band are not looked at. The value is exact where it is `least` or more, else it may be too low.
    """
    total = len(a) + len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)) or not total:
        return 0.0
    needed = int(np.ceil(least / (1 + least) * total - 1e-9))
    _, place_a, place_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(place_a - place_b) <= total - 2 * needed
    place_a, place_b = place_a[near], place_b[near]
    if len(place_a) < needed:
        return 0.0
    matched = longest_chain(place_b[np.argsort(place_a)])
    return matched / (total - matched)


def longest_chain(places: np.ndarray) -> int:
    """Length of the longest increasing subsequence of different numbers."""
    if (np.diff(places) > 0).all():
        return len(places)
    ends: list[int] = []
    for place in places.tolist():
        at = bisect.bisect_left(ends, place)
        ends[at:at + 1] = [place]
    return len(ends)


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, bands: int, per_band: int, kept: int, size: int) -> DataFrame:
    """`id`, `digest` of the text and its `bands` (null for a text without words)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            sketches = [order_min_hash(s, bands, per_band, kept).view(np.int64) if len(s) else None
                        for s in shingle_hashes(texts, size)]
            yield pd.DataFrame({
                "id": batch["id"], "digest": [hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest() for t in texts],
                "bands": sketches})

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter("id is not null and text is not null")
    return slim.mapInPandas(run, f"id {kind}, digest binary, bands array<long>")


def shared_buckets(keys: DataFrame) -> DataFrame:
    """The members (`id`, `key`) of buckets with two members or more, with the bucket's `low` and `high` member."""
    ends = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high")
    return keys.join(ends, "key").select("id", "key", "low", "high")


def mixed_members(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """The members (`id`, `class`) of buckets that hold several classes (`node`, `component`)."""
    by_class = written(shared.select("id", "key").join(classes, F.col("id") == F.col("node"), "left").select(
        "id", "key", F.coalesce("component", "id").alias("class")))
    # a table of its own, so that the join may split heavy buckets
    mixed = written(by_class.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high").select("key"))
    return by_class.join(mixed, "key").select("id", "class").distinct()


def star_pairs(shared: DataFrame) -> DataFrame:
    """Pairs `a`, `b` of every member with the smallest and the largest member of its bucket."""
    pairs = shared.select("id", F.explode(F.array("low", "high")).alias("end")).filter("id != end")
    return pairs.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct()


def verified_pairs(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs `a`, `b` whose `texts` (`id`, `text`) align with a `similarity` of at least `least`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            both, place = np.unique(np.concatenate([batch["text_a"], batch["text_b"]]).astype(object), return_inverse=True)
            shingles = [labelled(s) if len(s) else s for s in shingle_hashes(list(both), size)]
            found = np.array([aligned_similarity(shingles[i], shingles[j], least) for i, j in zip(place[:n], place[n:])])
            out = pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": found.astype(float)})
            yield out[out["similarity"] >= least]

    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    kind = texts.schema["id"].dataType.simpleString()
    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, f"a {kind}, b {kind}, similarity double")


def needed_shingles(least: float, total):
    """Shingles that two texts of `total` shingles together must share to be similar."""
    return F.ceil(F.lit(least / (1 + least)) * total - 1e-9)


def shingle_rows(texts: DataFrame, size: int) -> DataFrame:
    """`id`, `class`, `n` and one `shingle` a row of `texts` (`id`, `class`, `text`); shingles of a text differ, `n` counts them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shingles = [labelled(s) if len(s) else s for s in shingle_hashes(list(batch["text"]), size)]
            sizes = np.array([len(s) for s in shingles], np.int64)
            held = batch[["id", "class"]].loc[batch.index.repeat(sizes)].reset_index(drop=True)
            yield held.assign(n=np.repeat(sizes, sizes), shingle=np.concatenate([*shingles, np.zeros(0, np.uint64)]).view(np.int64))

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "class", "text").mapInPandas(run, f"id {kind}, class {kind}, n long, shingle long")


def rare_prefixes(rows: DataFrame, least: float) -> DataFrame:
    """The shingles of `rows` that may link classes: `id`, `class`, `n`, `shingle`, `place`, `short`, `minor`.

    `place` is that of the shingle in its text in one order of all shingles: first those that stand in one class only, then by
    the number of pairs of different classes that they make, counted exactly. Kept are places that a partner of any size
    may need (`short`: one of the same size or longer); texts with too few shingles of several classes have no partner.
    `minor` tells the rows outside the shingle's largest class.
    """
    by_class = rows.groupBy("shingle", "class").agg(F.count("*").cast("double").alias("rows"))
    pairs = F.sum("rows") * F.sum("rows") - F.sum(F.col("rows") * F.col("rows"))
    shared = written(by_class.groupBy("shingle").agg(
        pairs.alias("pairs"), F.count("*").alias("classes"), F.max_by("class", F.struct("rows", "class")).alias("main"))
        .filter("classes > 1").select("shingle", "pairs", "main"))
    # tables of their own, so that the join may split heavy shingles
    found = written(rows.join(shared, "shingle").withColumn("minor", F.col("class") != F.col("main")).drop("main"))
    held = F.count("*").over(Window.partitionBy("id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("pairs", "shingle"))
    placed = found.withColumn("held", held).withColumn("place", F.col("n") - F.col("held") + rank - 1)
    last = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9)
    return placed.filter((F.col("n") - F.col("held") <= last) & (F.col("place") <= last)).select(
        "id", "class", "n", "shingle", "place", (F.col("place") <= F.col("n") - needed_shingles(least, 2 * F.col("n"))).alias("short"), "minor")


def prefix_pairs(texts: DataFrame, size: int, least: float) -> DataFrame:
    """All pairs `a`, `b` of `texts` (`id`, `class`, `text`) in different classes that may be similar, each once.

    Similar texts share `needed_shingles`, so the first shingle they share stands so early in both that enough are left
    after it. Members of the largest class of a shingle meet members of the others only, never each other.
    """
    rows = written(rare_prefixes(written(shingle_rows(texts, size)), least))
    enough = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= needed_shingles(least, F.col("x.n") + F.col("y.n"))
    meet = ((F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.class") != F.col("y.class"))
            & (F.struct("x.n", "x.id") < F.struct("y.n", "y.id")) & enough)
    found = [
        left.alias("x").join(right.alias("y").hint("merge"), meet).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        for left, right in ((rows.filter("short and minor"), rows), (rows.filter("short and not minor"), rows.filter("minor")))]
    return found[0].union(found[1]).distinct()


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, least: float = SIMILARITY,
    bands: int = BANDS, per_band: int = SKETCHES_PER_BAND, kept: int = KEPT_PER_SKETCH,
) -> DataFrame:
    """One row per document: `id_col`, `class_id` (smallest id of its group), `copy_of` (smallest id of equal texts).

    Documents belong to one group when a chain of texts links them, each similar to the next: `least` or more of their
    `size`-word shingles align in order (words are lower-cased runs of letters and digits). Equal texts always share a
    group, empty ones too. Null texts and ids are their own class (`class_id` is the id). Rows that repeat an id
    with one text are one document and each returned; of an id with several texts the smallest is compared. Copies meet
    once per text and members of a bucket its two ends; members of buckets where that leaves several classes are joined
    exactly (`prefix_pairs`).
    """
    ids = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    sketches = written(sketch_documents(docs, id_col, text_col, bands, per_band, kept, size))
    copies = written(
        sketches.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    members = sketches.select("id", "digest").join(copies, "digest", "left").select("id", F.coalesce("first", "id").alias("first"))
    members = written(members.groupBy("id").agg(F.min("first").alias("copy_of")))
    firsts = sketches.join(members.filter("id = copy_of").select("id"), "id").filter("bands is not null").select(
        "id", F.posexplode("bands").alias("band", "value"))
    shared = written(shared_buckets(firsts.select("id", F.xxhash64("band", "value").alias("key"))))
    texts = written(
        ids.filter("text is not null").join(shared.select("id").distinct(), "id", "left_semi")
        .groupBy("id").agg(F.min("text").alias("text")))
    pairs = written(star_pairs(shared))
    links = written(verified_pairs(pairs, texts, size, least))
    classes = written(connected_components(links, "a", "b"))

    # Members of buckets that still hold several classes meet every possible partner of another class.
    rest = written(mixed_members(shared, classes))
    exact = written(prefix_pairs(texts.join(rest, "id"), size, least).join(pairs, ["a", "b"], "left_anti"))
    links = links.union(verified_pairs(exact, texts, size, least))
    classes = connected_components(links, "a", "b")
    found = members.join(classes, F.col("copy_of") == F.col("node"), "left").select(
        F.col("id").alias("known"), "copy_of", F.coalesce("component", "copy_of").alias("class_id"))
    return ids.select("id").join(found, F.col("id") == F.col("known"), "left").select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copy_of", "id").alias("copy_of"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with the smallest id of their group, columns as they are.

    Rows without an id or a text stay; rows that repeat an id are one document and stay or go together.
    """
    gone = near_duplicate_classes(docs, id_col, text_col, **how).filter(F.col("class_id") != F.col(id_col)).select(
        F.col(id_col).alias("gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("gone"), "left_anti")
