"""Removal of repeated byte strings by merging suffix orders of many chunks.

A string of 50 bytes that stands in two documents is found without sorting all suffixes of the corpus:

1. Documents are packed into chunks. Every window of 50 bytes names an anchor, the 24-byte gram in it with the smallest
   hash; equal windows name equal anchors at equal offsets.
2. Anchors meet by hash. Only those that stand in two documents matter from here on.
3. Each chunk sends the surroundings of these anchors. Per bucket of anchors, the chunks' suffixes are interleaved into one
   order by refinement, 8 symbols a round and only within intervals that are still equal. Then the order is carried to
   the left as in a Burrows-Wheeler transform: a stable pass by the preceding symbol turns the order of the suffixes at
   one offset into that at the next. Neighbours whose common prefix is 50 bytes or more form repeated intervals, and
   the smallest document of an interval keeps its bytes.
4. Chunks get back which windows to remove.

Strings are compared byte by byte; hashes only choose what to compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
import zstandard

from visitlens.llm.common import written

LENGTH = 50
GRAM = 24
OFFSETS = LENGTH - GRAM + 1
REACH = OFFSETS - 1
CONTEXT = REACH + LENGTH
CHUNK_BYTES = 1 << 20
ANCHORS_PER_BUCKET = 1_000_000
BASE = 0x01000193
HASH_BYTES = 6
LEVEL = 6


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(op: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """`op` (minimum or maximum) over every run of `width` values."""
    size, done, out = len(x) - width + 1, 1, x
    while done * 2 <= width:
        out = op(out[:-done], out[done:])
        done *= 2
    return op(out[:size], out[width - done:width - done + size]) if done < width else out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes (`HASH_BYTES` wide) of the anchors of all windows that lie inside one of the documents [start, end)."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power = [np.uint32(pow(BASE, k, 1 << 32)) for k in range(9)]
    h1 = data.astype(np.uint32) + np.uint32(1)
    h2 = h1[:-1] * power[1] + h1[1:]
    h4 = h2[:-2] * power[2] + h2[2:]
    h8 = h4[:-4] * power[4] + h4[4:]
    h16 = h8[:-8] * power[8] + h8[8:]
    count = len(data) - GRAM + 1
    h = h16[:count] * power[8] + h8[16:16 + count]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    h |= np.uint32(1)
    least = _sliding(np.minimum, h, OFFSETS)
    inside = np.zeros(len(least) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    least[np.cumsum(inside[:-1]) == 0] = 0
    edge = np.zeros(REACH, np.uint32)
    place = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge]), OFFSETS) == h)
    words = data[place[:, None] + np.arange(GRAM)].view(np.uint64)
    total = np.zeros(len(place), np.uint64)
    for i in range(GRAM // 8):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + words[:, i])
    return place, total >> np.uint64(64 - 8 * HASH_BYTES)


def _planes(numbers: np.ndarray, width: int = 8) -> bytes:
    """The lowest `width` bytes of whole numbers, all first bytes before all second ones."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def _from_planes(raw: bytes, count: int, width: int = 8, at: int = 0) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count).T
    return out.view(np.int64).ravel()


def pack_anchors(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    """Ascending hashes with the smallest and largest id of each; all but the noise of the hashes is compressed."""
    noise = (HASH_BYTES - 1) * len(values)
    raw = _planes(values, HASH_BYTES) + _planes(low) + _planes(low ^ high)
    return len(values).to_bytes(4, "little") + raw[:noise] + zstandard.ZstdCompressor(LEVEL).compress(raw[noise:])


def unpack_anchors(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    noise = (HASH_BYTES - 1) * n
    raw = blob[4:4 + noise] + zstandard.ZstdDecompressor().decompress(blob[4 + noise:])
    low = _from_planes(raw, n, at=HASH_BYTES * n)
    return _from_planes(raw, n, HASH_BYTES).view(np.uint64), low, low ^ _from_planes(raw, n, at=(HASH_BYTES + 8) * n)


def pack_contexts(numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> bytes:
    """Ascending numbers of contexts (their steps are stored), their ids and bytes; the bytes in a frame of their own."""
    pack = zstandard.ZstdCompressor(LEVEL).compress
    known = pack(_planes(np.diff(numbers.astype(np.int64), prepend=0), 4) + _planes(ids))
    return len(numbers).to_bytes(4, "little") + len(known).to_bytes(4, "little") + known + pack(np.ascontiguousarray(rows).tobytes())


def unpack_contexts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    unpack = zstandard.ZstdDecompressor().decompress
    known = unpack(blob[8:8 + size])
    rows = np.frombuffer(unpack(blob[8 + size:]), np.uint8).reshape(n, CONTEXT + 2)
    return np.cumsum(_from_planes(known, n, 4)).astype(np.int32), _from_planes(known, n, at=4 * n), rows


class Chunk:
    """One packed chunk: its bytes, documents, anchors, and which of these are repeated elsewhere."""

    def __init__(self, row, repeated: list[bytes] | None = None):
        sizes = np.array(row.sizes, np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.blob), np.uint8) if len(row.blob) else np.zeros(0, np.uint8)
        self.sizes = sizes
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.known = np.array(row.known, bool)
        self.ids = np.array(row.ids, np.int64)
        usable = self.known & (sizes >= LENGTH)
        if repeated is not None and not repeated:
            usable[:] = False
        if usable.any():
            self.place, self.hash = anchors(self.data, self.starts[usable], self.ends[usable])
        else:
            self.place, self.hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if repeated is not None and len(self.place):
            met = np.isin(self.hash, np.concatenate([_from_planes(b, len(b) // HASH_BYTES, HASH_BYTES).view(np.uint64) for b in repeated]))
            self.place, self.hash = self.place[met], self.hash[met]
        self.doc = np.searchsorted(self.ends, self.place, side="right")
        self.id = self.ids[self.doc]

    def contexts(self):
        """Different surroundings of the anchors (bytes, first and last offset, smallest id, hash), and each anchor's own."""
        begin, end = self.starts[self.doc], self.ends[self.doc]
        place = self.place[:, None] + np.arange(-REACH, LENGTH)
        out = (place < begin[:, None]) | (place >= end[:, None])
        rows = np.zeros((len(self.place), CONTEXT + 2), np.uint8)
        rows[:, :CONTEXT] = np.where(out, 0, self.data[np.clip(place, 0, len(self.data) - 1)])
        rows[:, CONTEXT] = np.maximum(0, self.place + LENGTH - end)
        rows[:, CONTEXT + 1] = np.minimum(REACH, self.place - begin)
        _, first, own = np.unique(rows.view(f"V{CONTEXT + 2}").ravel(), return_index=True, return_inverse=True)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, own, self.id)
        return rows[first], least, self.hash[first], own


def _per_bucket(buckets: np.ndarray, count: int, pack: Callable[[np.ndarray], bytes]) -> list[tuple[int, bytes]]:
    order = np.argsort(buckets, kind="stable")
    cuts = np.searchsorted(buckets[order], np.arange(count + 1))
    return [(b, pack(order[cuts[b]:cuts[b + 1]])) for b in range(count) if cuts[b] < cuts[b + 1]]


def pack_documents(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Chunks of documents: `chunk`, `ids`, `known` (has an id), `null` (has no text), `sizes` in bytes, compressed `blob`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        rows, size = [], 0

        def packed():
            texts = [r[3] for r in rows]
            return pd.DataFrame({
                "chunk": [number], "ids": [[r[0] for r in rows]], "known": [[r[1] for r in rows]], "null": [[r[2] for r in rows]],
                "sizes": [[len(t) for t in texts]], "blob": [zstandard.ZstdCompressor(LEVEL).compress(b"".join(texts)) if size else b""]})

        for batch in batches:
            for own, known, text in zip(batch["id"].tolist(), batch["known"].tolist(), batch["text"]):
                raw = b"" if text is None else text.encode("utf-8", "replace")
                if rows and size + len(raw) > chunk_bytes:
                    yield packed()
                    rows, size, number = [], 0, number + 1
                rows.append((own, known, text is None, raw))
                size += len(raw)
        if rows:
            yield packed()

    identity = docs[id_col].cast("long")
    slim = docs.select(F.coalesce(identity, F.lit(0)).alias("id"), identity.isNotNull().alias("known"), docs[text_col].alias("text"))
    return slim.mapInPandas(
        run, "chunk long, ids array<long>, known array<boolean>, null array<boolean>, sizes array<long>, blob binary")


def repeated_anchors(chunks: DataFrame, buckets: int) -> DataFrame:
    """`chunk` with `repeated`: blobs of the anchors in it that stand in two documents of different ids or more."""
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                own = Chunk(row)
                order = np.lexsort((own.id, own.hash))
                values, ids = own.hash[order], own.id[order]
                first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
                last = np.r_[first[1:], len(values)] - 1 if len(values) else first
                values, low, high = values[first], ids[first], ids[last]

                def pack(i, values=values, low=low, high=high):
                    return pack_anchors(values[i], low[i], high[i])

                sent = _per_bucket(values % np.uint64(buckets), buckets, pack)
                yield pd.DataFrame({"bucket": [b for b, _ in sent], "chunk": row.chunk, "blob": [x for _, x in sent]})

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        sent = [unpack_anchors(b) for b in group["blob"]]
        values, low, high = (np.concatenate(x) for x in zip(*sent))
        chunk = np.repeat(group["chunk"].to_numpy(), [len(v) for v, _, _ in sent])
        del sent
        order = np.argsort(values, kind="stable")
        new = np.r_[True, values[order][1:] != values[order][:-1]]
        first, run = np.flatnonzero(new), np.cumsum(new) - 1
        many = np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first)
        met = order[many[run]]
        met = met[np.argsort(chunk[met], kind="stable")]
        owners, cuts = np.unique(chunk[met], return_index=True)
        cuts = np.r_[cuts, len(met)]
        return pd.DataFrame({"chunk": owners, "blob": [_planes(values[met[a:b]], HASH_BYTES) for a, b in zip(cuts[:-1], cuts[1:])]})

    sent = chunks.mapInPandas(send, "bucket int, chunk long, blob binary")
    met = sent.groupBy("bucket").applyInPandas(meet, "chunk long, blob binary")
    return met.groupBy("chunk").agg(F.collect_list("blob").alias("repeated"))


def interleaved(words: np.ndarray) -> np.ndarray:
    """Order of the rows by their words: every round refines the intervals that the words before left equal."""
    order, interval = np.arange(len(words)), np.zeros(len(words), np.int64)
    for column in words.T:
        step = np.lexsort((column[order], interval))
        order, interval = order[step], interval[step]
        own = column[order]
        interval = np.cumsum(np.r_[False, (interval[1:] != interval[:-1]) | (own[1:] != own[:-1])])
        if interval[-1] == len(words) - 1:
            break
    return order


def repeated_offsets(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bit o of a row's number: the window that begins o bytes before its anchor stands in a row of a smaller id too."""
    right = np.zeros((len(rows), -(-LENGTH // 8) * 8), np.uint8)
    right[:, :LENGTH] = rows[:, REACH:CONTEXT]
    order = interleaved(right.view(">u8").astype(np.uint64))
    first, last = rows[:, CONTEXT], rows[:, CONTEXT + 1]
    found = np.zeros(len(rows), np.uint32)
    for offset in range(OFFSETS):
        if offset:
            order = order[np.argsort(rows[order, REACH - offset], kind="stable")]
        live = order[(first[order] <= offset) & (offset <= last[order])]
        if not len(live):
            continue
        windows = rows[:, REACH - offset:CONTEXT - offset][live]
        new = np.r_[True, (windows[1:] != windows[:-1]).any(axis=1)]
        least = np.minimum.reduceat(ids[live], np.flatnonzero(new))[np.cumsum(new) - 1]
        found[live[least < ids[live]]] |= np.uint32(1 << offset)
    return found


def merged_windows(chunks: DataFrame, buckets: int) -> DataFrame:
    """`chunk` with `found`: blobs of (number of a context, its repeated offsets), from chunks with `repeated`."""
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                own = Chunk(row, list(row.repeated))
                rows, ids, values, _ = own.contexts()

                def pack(i, rows=rows, ids=ids):
                    return pack_contexts(i, ids[i], rows[i])

                sent = _per_bucket(values % np.uint64(buckets), buckets, pack)
                yield pd.DataFrame({"bucket": [b for b, _ in sent], "chunk": row.chunk, "blob": [x for _, x in sent]})

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        sent = [unpack_contexts(b) for b in group["blob"]]
        numbers, ids, rows = (np.concatenate(x) for x in zip(*sent))
        chunk = np.repeat(group["chunk"].to_numpy(), [len(n) for n, _, _ in sent])
        del sent
        found = repeated_offsets(rows, ids)
        met = np.flatnonzero(found)
        met = met[np.argsort(chunk[met], kind="stable")]
        owners, cuts = np.unique(chunk[met], return_index=True)
        cuts = np.r_[cuts, len(met)]
        blobs = [numbers[met[a:b]].tobytes() + found[met[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        return pd.DataFrame({"chunk": owners, "blob": blobs})

    sent = chunks.mapInPandas(send, "bucket int, chunk long, blob binary")
    met = sent.groupBy("bucket").applyInPandas(meet, "chunk long, blob binary")
    return met.groupBy("chunk").agg(F.collect_list("blob").alias("found"))


def cut_documents(chunks: DataFrame) -> DataFrame:
    """`id`, `n_bytes`, `spans` removed and `kept` bytes of every document, from chunks with `repeated` and `found`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                repeated = [] if row.repeated is None else list(row.repeated)
                own = Chunk(row, repeated)
                gone = np.zeros(len(own.data), bool)
                if len(own.place):
                    rows, ids, _, context = own.contexts()
                    masks = np.zeros(len(rows), np.uint32)
                    for blob in [] if row.found is None else row.found:
                        n = len(blob) // 8
                        masks[np.frombuffer(blob, np.int32, n)] = np.frombuffer(blob, np.uint32, n, 4 * n)
                    first, last = rows[:, CONTEXT].astype(np.int64), rows[:, CONTEXT + 1].astype(np.int64)
                    every = ((np.int64(1) << (last + 1)) - (np.int64(1) << first)).astype(np.uint32)
                    mask = np.where(own.id > ids[context], every[context], masks[context])
                    begins = np.zeros(len(own.data), np.int32)
                    for offset in range(OFFSETS):
                        begins[own.place[(mask >> np.uint32(offset)) & np.uint32(1) == 1] - offset] = 1
                    total = np.cumsum(begins)
                    total[LENGTH:] -= total[:-LENGTH].copy()
                    gone = total > 0
                out = []
                for start, end in zip(own.starts.tolist(), own.ends.tolist()):
                    mine = gone[start:end]
                    edges = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
                    out.append(([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()], own.data[start:end][~mine].tobytes()))
                yield pd.DataFrame({
                    "id": own.ids, "known": own.known, "null": np.array(row.null, bool), "n_bytes": own.sizes,
                    "spans": [s for s, _ in out], "kept": [k for _, k in out]})

    cut = chunks.mapInPandas(
        run, "id long, known boolean, null boolean, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return cut.select(F.when(F.col("known"), F.col("id")).alias("id"), "n_bytes", "spans", F.when(~F.col("null"), F.col("kept")).alias("kept"))


def drop_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: the id, `n_bytes`, `spans` (start, end in bytes, what was removed) and `kept` (binary).

    Every byte goes that lies in a string of 50 bytes which also begins in a document of a smaller id. Ids are whole
    numbers. Documents without an id lose nothing and take nothing from others; rows of one id do not cut each other, so
    repeated rows get equal results. A null text has no bytes, no spans and a null `kept`. An empty table gives an empty
    result. Texts of any length are read whole, a long one being a chunk of its own.
    """
    spark = docs.sparkSession
    chunks = written(pack_documents(docs, id_col, text_col, chunk_bytes))
    size = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size * 2 / (OFFSETS + 1) / ANCHORS_PER_BUCKET))
    repeated = written(repeated_anchors(chunks, buckets))
    found = written(merged_windows(chunks.join(repeated, "chunk"), buckets))
    marked = chunks.join(repeated.join(found, "chunk", "left"), "chunk", "left")
    return cut_documents(marked).withColumnRenamed("id", id_col)
