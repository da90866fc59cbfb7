"""Line deduplication by content-defined chunks of lines.

A rolling hash over the last line hashes decides where chunks end: where its value is 0 modulo a number, where the window
stands less often in the corpus than those beside it (two passages meet there), and where it stands only once, so that no
chunk holds a line that no repeat reaches. The same run of lines is cut in the same places wherever it stands. Chunks of several lines that occur more than once are compared byte by byte, and all
but the first occurrence go.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, functions as F
import xxhash

from visitlens.llm.common import document_key, written

WINDOW_LINES = 2
LINES_PER_CHUNK = 3
LEAST_LINES = 2
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
END_BITS = 32


def window_hashes(lines: list[str], window: int = WINDOW_LINES) -> list[int]:
    """The rolling hash of every `window` consecutive lines, as signed 64-bit numbers."""
    hashes, rolling, out = [xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) for line in lines], 0, []
    drop = pow(BASE, window, 1 << 64)
    for i, own in enumerate(hashes):
        rolling = (rolling * BASE + own) & MASK
        if i >= window:
            rolling = (rolling - hashes[i - window] * drop) & MASK
        if i + 1 >= window:
            out.append(rolling - (rolling >> 63 << 64))
    return out


def chunk_bounds(
    hashes: list[int], times: Mapping[int, int], window: int = WINDOW_LINES, mean: int = LINES_PER_CHUNK, least: int = LEAST_LINES
) -> list[tuple[int, int]]:
    """(first line, line after the last) of every chunk in the stretches of repeated windows, which `times` holds.

    Inside a stretch a chunk ends where the hash of the last lines is 0 modulo `mean`, or inside a window that stands less
    often than the one before and the one after; no chunk is shorter than `least`.
    """
    bounds, at = [], 0
    while at < len(hashes):
        if hashes[at] not in times:
            at += 1
            continue
        start, end = at, at
        while end < len(hashes) and hashes[end] in times:
            end += 1
        stop = end + window - 1
        for after in range(start + window, stop):
            if after - start < least or stop - after < least:
                continue
            around = [times.get(h, 0) for h in hashes[after - window:after - window + 3]]
            if (hashes[after - window] >> 32) % mean == 0 or around[1] < min(around[0], around[-1]):
                bounds.append((start, after))
                start = after
        if stop - start >= least:
            bounds.append((start, stop))
        at = end
    return bounds


def _windows(docs: DataFrame) -> DataFrame:
    """`id`, `content`, `hash` and `times` of every window of lines of a text, once per text."""
    @F.pandas_udf("array<struct<hash:long,times:int>>")
    def roll(texts: pd.Series) -> pd.Series:
        counted = [Counter(window_hashes(text.split("\n"))) for text in texts]
        return pd.Series([[{"hash": h, "times": n} for h, n in own.items()] for own in counted], dtype=object)

    return docs.select("id", "content", F.inline(roll("text")))


def _chunks(texts: DataFrame, least: int) -> DataFrame:
    """`id`, `content`, `span`, `hash` and `lines` of the chunks of every text in the stretches of its `shared` windows."""
    @F.pandas_udf("array<struct<span:long,hash:binary,lines:string>>")
    def cut(texts: pd.Series, shared: pd.Series) -> pd.Series:
        found = []
        for text, windows in zip(texts, shared):
            lines, own = text.split("\n"), []
            for start, end in chunk_bounds(window_hashes(lines), {w["hash"]: w["times"] for w in windows}, least=least):
                part = "\n".join(lines[start:end])
                own.append({"span": start << END_BITS | end, "hash": xxhash.xxh3_128_digest(part.encode("utf-8", "replace")), "lines": part})
            found.append(own)
        return pd.Series(found, dtype=object)

    return texts.select("id", "content", F.inline(cut("text", "shared")))


def drop_spans(text: str, gone: list[int]) -> tuple[str, int, int]:
    """The text without the lines of these spans, its number of lines, and how many of them went."""
    lines, out, at = text.split("\n"), [], 0
    for span in sorted(gone):
        start, end = span >> END_BITS, span & (1 << END_BITS) - 1
        out += lines[at:start]
        at = end
    out += lines[at:]
    return "\n".join(out), len(lines), len(lines) - len(out)


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LINES) -> DataFrame:
    """`docs` with `text_col` cut, and `n_lines`, `n_removed_lines`, `n_removed_chunks` (long).

    A chunk of `least` lines or more goes if the same bytes are a chunk at a smaller place, places being ordered by id (null
    first), hash of the whole text, and place in the text. Lines in no repeated window stay.
    Lines end at `\\n`. A null text stays null with no lines; an empty text is one empty line. Rows alike in id and text are one
    document and get equal results. Other columns are kept; columns of the input named like the counts are replaced.
    """
    counts = ("n_lines", "n_removed_lines", "n_removed_chunks")
    key = document_key(docs, id_col, text_col)
    # The joins to the texts are merges at every size: what they bring grows with the corpus.
    slim = docs.filter(docs[text_col].isNotNull()).select(key.alias("key"), docs[text_col].alias("text")).select(
        F.col("key")["id"].alias("id"), F.col("key")["content"].alias("content"), "text")
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("content") == F.col("own_content"))
    owner = [F.col("id").alias("own_id"), F.col("content").alias("own_content")]

    windows = written(_windows(slim))
    # Tables of their own, so that the joins may split heavy hashes.
    standing_twice = written(windows.groupBy("hash").agg(F.sum("times").alias("times")).filter("times > 1"))
    shared = written(windows.select("id", "content", "hash").join(standing_twice, "hash").groupBy("id", "content").agg(
        F.collect_set(F.struct("hash", "times")).alias("shared")))
    texts = slim.join(shared.select(*owner, "shared").hint("merge"), same).select("id", "content", "text", "shared")
    chunks = written(_chunks(texts, least))

    # Null ids compare as less than any other, and rows alike count once.
    place = F.struct("id", "content", "span")
    repeated = written(
        chunks.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low != high").select("hash"))
    candidates = chunks.select("id", "content", "span", "hash").join(repeated, "hash").groupBy("id", "content").agg(
        F.collect_set("span").alias("wanted"))
    firsts = chunks.join(repeated, "hash").groupBy("lines").agg(F.min(place).alias("first")).select("first.*")
    kept = firsts.groupBy("id", "content").agg(F.collect_set("span").alias("stay")).select(*owner, "stay")
    gone = candidates.join(kept, same, "left").select(
        F.col("id").alias("gone_id"), F.col("content").alias("gone_content"),
        F.array_except("wanted", F.coalesce("stay", F.array().cast("array<long>"))).alias("gone")).filter(F.size("gone") > 0)
    gone = written(gone)

    @F.pandas_udf("text string, n_lines long, n_removed_lines long")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0) if t is None else drop_spans(t, [] if g is None else list(g)) for t, g in zip(texts, gone)]
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed_lines"])

    names = [c for c in docs.columns if c.lower() not in counts and c != text_col]
    rows = docs.select(
        F.struct(*[docs[c] for c in names]).alias("row"), docs[text_col].alias("text"), key["id"].alias("id"), key["content"].alias("content"))
    joined = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("content") == F.col("gone_content")), "left")
    done = joined.select("row", "gone", cut("text", "gone").alias("cut"))
    kept_columns = {c: F.col("row").getField(c) for c in names} | {text_col: F.col("cut")["text"]}
    return done.select(
        *[kept_columns[c].alias(c) for c in docs.columns if c in kept_columns], F.col("cut")["n_lines"].alias("n_lines"),
        F.col("cut")["n_removed_lines"].alias("n_removed_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_chunks"))
