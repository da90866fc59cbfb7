"""How far the sources of a language lie apart: smoothed term shares of every two sources, and the terms that set a source off.

Texts become counts per (language, source, term) inside the tasks that read them. Every source's counts of the kept terms are
sorted arrays of (term id, count), in blocks of term ids. A pair task gets the arrays of two tiles of sources over one
block and merges them pair by pair: the shorter array gallops through the longer one, which splits the terms into those of
both, of one and of neither; each kind is priced apart, the last one at once. Blocks add up to the divergence of the pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from visitlens.llm.common import word_pieces, written
from visitlens.operators.skew import global_index, join_per_key

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10

BLOCK_BITS = 13
TILE = 8
FLUSH_TERMS = 500_000

_TERM = re.compile(TERM.encode())


# counts

def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences and documents per term; term is null once per group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = [None, *n]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *map(docs.__getitem__, n)], pa.int64())], schema=schema)

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                seen = set()
                for terms in word_pieces(text, _TERM):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                size += len(n)
                if size > FLUSH_TERMS:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    lang, source, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col))
    read = docs.select(lang.alias("lang"), source.alias("source"), text.cast("binary").alias("text"))
    partial = read.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exactly: a long division in three digits of a thousand."""
    rest = count.astype(np.int64) + 2
    whole = rest // total
    rest -= whole * total
    for _ in range(3):
        rest *= 1000
        digit = rest // total
        rest -= digit * total
        whole = whole * 1000 + digit
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits."""
    return (p - q) ** 2 // (p + q)


def gallop(few: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both sorted id arrays of the ids they share.

    The search for an id goes on from the place of the one before it (numpy keeps its bounds between ascending keys), so a
    short array costs its own length times a logarithm, whatever the length of the other.
    """
    if len(few) > len(many):
        there, here = gallop(many, few)
        return here, there
    place = np.searchsorted(many, few)
    inside = np.flatnonzero(place < len(many))
    here = inside[many[place[inside]] == few[inside]]
    return here, place[here]


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], total_a: int, total_b: int, terms: int) -> int:
    """Divergence of two sorted (term id, count) arrays over a block of `terms` terms, absent ones included."""
    (ids_a, n_a), (ids_b, n_b) = a, b
    here, there = gallop(ids_a, ids_b)
    p, q = shares(n_a, total_a), shares(n_b, total_b)
    none = np.zeros(1, np.int64)
    p_none, q_none = shares(none, total_a), shares(none, total_b)
    only_a, only_b = np.delete(p, here), np.delete(q, there)
    both = apart(p[here], q[there]).sum()
    one = apart(only_a, q_none).sum() + apart(p_none, only_b).sum()
    neither = terms - len(ids_a) - len(ids_b) + len(here)
    return int(both) + int(one) + neither * int(apart(p_none, q_none)[0])


# profiles

@dataclass(frozen=True)
class Profiles:
    """What `profile_sources` found, all in written tables.

    groups: lang, source, total, tile, n_terms (kept terms of the language), lang_total (their occurrences). counts: lang, source,
    term, id, n, lang_n (occurrences in the language). blocks: lang, block, terms (kept terms in the block).
    """

    groups: DataFrame
    counts: DataFrame
    blocks: DataFrame


def profile_sources(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    least_documents: int = LEAST_DOCUMENTS,
) -> Profiles:
    """Counts of the kept terms of every (language, source); a term is kept in at least `least_documents` rows of its language."""
    counts = written(term_counts(docs, lang_col, source_col, text_col))
    of_lang = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    kept = of_lang.filter(F.col("docs") >= least_documents).select("lang", "term", "lang_n")
    kept = written(global_index(kept, ["lang", "term"], "id"))
    block = F.shiftright("id", BLOCK_BITS).alias("block")
    blocks = kept.groupBy("lang", block).agg(F.count("*").alias("terms"))
    found = written(counts.filter("term IS NOT NULL").select("lang", "source", "term", "n").join(kept, ["lang", "term"]).select(
        "lang", "source", "term", "id", "n", "lang_n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left")
    groups = join_per_key(groups, langs, ["lang"], "left")
    # Tiles are consecutive sources of a language, TILE at most; the index is a range sort, so no language needs one task.
    placed = global_index(groups.fillna(0), ["lang", "source"], "place")
    first = placed.groupBy("lang").agg(F.min("place").alias("first"))
    tile = F.floor((F.col("place") - F.col("first")) / TILE).cast("long")
    groups = written(join_per_key(placed, first, ["lang"], "left").select(
        "lang", "source", "total", "n_terms", "lang_total", tile.alias("tile")))
    return Profiles(groups, found, written(blocks))


def pair_divergence(profiles: Profiles) -> DataFrame:
    """Rows (lang, a, b, value) of every two sources a < b of a language; blocks of two tiles meet in one co-grouped task."""
    groups, counts = profiles.groups, profiles.counts
    arrays = counts.groupBy("lang", "source", F.shiftright("id", BLOCK_BITS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("id", "n"))).alias("cells"))  # at most 2^BLOCK_BITS cells
    # A source without a term in a block still has a price there: one row per source and block.
    rows = groups.join(profiles.blocks, "lang").join(arrays, ["lang", "source", "block"], "left").select(
        "lang", "source", "tile", "block", "terms", (F.col("total") + 2 * F.col("n_terms")).alias("total"),
        F.coalesce(F.col("cells")["id"], F.array().cast("array<long>")).alias("ids"),
        F.coalesce(F.col("cells")["n"], F.array().cast("array<long>")).alias("counts"))
    rows = written(rows)
    tiles = groups.select("lang", "tile").distinct()
    others = tiles.select(F.col("lang").alias("_lang"), F.col("tile").alias("right"))
    pairs = tiles.join(others, (F.col("lang") == F.col("_lang")) & (F.col("tile") <= F.col("right"))).select(
        "lang", F.col("tile").alias("left"), "right")
    left = rows.withColumnRenamed("tile", "left").join(pairs, ["lang", "left"])
    right = rows.toDF(*["right" if c == "tile" else c for c in rows.columns]).join(pairs, ["lang", "right"])
    key = ["lang", "left", "right", "block"]

    def price(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        right_cells = list(zip(right["source"], right["ids"], right["counts"], right["total"]))
        for a, ids_a, n_a, total_a, terms, lang in zip(
                left["source"], left["ids"], left["counts"], left["total"], left["terms"], left["lang"]):
            for b, ids_b, n_b, total_b in right_cells:
                if a.encode() < b.encode():
                    value = merge((ids_a, n_a), (ids_b, n_b), total_a, total_b, int(terms))
                    out.append((lang, a, b, value))
        return pd.DataFrame(out, columns=["lang", "a", "b", "value"])

    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(price, "lang string, a string, b string, value long")
    priced = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # Languages without a kept term have no block: their pairs are worth 0.
    bare = groups.filter("n_terms = 0").select("lang", "source")
    other = bare.select(F.col("lang").alias("_lang"), F.col("source").alias("b"))
    none = bare.join(other, (F.col("lang") == F.col("_lang")) & (F.col("source") < F.col("b"))).select(
        "lang", F.col("source").alias("a"), "b", F.lit(0).cast("long").alias("value"))
    return priced.unionByName(none)


def share(count: Column, total: Column) -> Column:
    """`shares` as a column, in exact decimals."""
    return (F.call_function("div", F.lit(SCALE).cast("decimal(38,0)") * (count + 2).cast("decimal(19,0)"), total.cast("decimal(19,0)")) + 1).cast("long")


def distinctive_terms(profiles: Profiles, top: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, term, value, rank): the terms that a source has more of than its language, the farthest first."""
    groups = profiles.groups.select("lang", "source", "total", "n_terms", "lang_total")
    counts = join_per_key(profiles.counts, groups, ["lang", "source"], "left")
    p = share(F.col("n"), F.col("total") + 2 * F.col("n_terms"))
    q = share(F.col("lang_n"), F.col("lang_total") + 2 * F.col("n_terms"))
    rows = counts.select("lang", "source", "term", p.alias("p"), q.alias("q")).filter("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    # The filter on the row number lets Spark keep `top` rows per group and task before they are exchanged.
    return rows.select("lang", "source", "term", value.cast("long").alias("value")).withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def audit_sources(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): every other source of the language, and the source's own terms.

    Null texts, languages and sources are empty strings. Every row is a document, repeated rows and null ids too. Terms are
    runs of letters (A-Z lower-cased, everything beyond ASCII). A source alone in its language has no `pair` rows; a
    group without a kept term has no `term` rows, and its pairs are priced by absent terms only. No rows give no rows.
    Other columns are not read. Counts are exact up to 2^53 occurrences.
    """
    profiles = profile_sources(docs, lang_col, source_col, text_col, least_documents)
    pairs = pair_divergence(profiles)
    both = pairs.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way"), "value")
    ranked = both.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = distinctive_terms(profiles, top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return ranked.unionByName(terms)
