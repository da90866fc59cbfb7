"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source whose target is c times its size should be taken c times on average. The whole part of c is
certain. The fraction is settled by pairing documents: in each pair, mass moves from one document to the other, in one
of two directions drawn at random so that no expectation changes, until one of the two is integral; the words the two
take together stay the same. Blocks of documents are rounded where they lie and hand on one unsettled document each;
those are rounded again, in groups, up a tree, until each source has one left, which a last draw settles.
"""

from __future__ import annotations

from collections.abc import Iterator
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from visitlens.llm.common import written

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
ROWS_PER_BLOCK = 4096
FANOUT = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, cap: float = MOST_COPIES) -> DataFrame:
    """`source`, `source_size` with `target`: the words each source should give.

    Sources by code point, null last, take the weights in turn. Together they give `share` of all words; no source gives
    more than `cap` times its size, what is too much being reshared by weight among the others. This is the level at
    which all sources below their cap give the same per weight: sources are filled in the order of cap per weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumn("most", F.col("source_size") * float(cap))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = ranked.select(
        "*", (F.sum("source_size").over(whole) * share).alias("goal"),
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("full"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"))
    level = (F.col("goal") - F.col("full")) / F.col("open")
    rank = F.row_number().over(by_level)
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("rank", "level"))).over(whole)
    share_of = F.coalesce(first["level"] * F.col("weight"), F.col("most"))
    return filled.withColumn("level", level).withColumn("rank", rank).withColumn("share", share_of).select(
        "source", "source_size", F.least("most", "share").alias("target"))


def _pivot(rows: list[dict], seed: str) -> None:
    """Settle all but at most one of `rows` (dicts with `size` and fraction `x`), in place."""
    draw = random.Random(seed)
    held = None
    for row in rows:
        if row["size"] == 0 or not 0 < row["x"] < 1:
            row["x"] = float(round(row["x"]))
            continue
        if held is None:
            held = row
            continue
        a, b = held["size"], row["size"]
        up = min((1 - held["x"]) * a, row["x"] * b)
        down = min(held["x"] * a, (1 - row["x"]) * b)
        move = up if draw.random() * (up + down) < down else -down
        held["x"] += move / a
        row["x"] -= move / b
        pair = [r for r in (held, row) if 1e-9 < r["x"] < 1 - 1e-9]
        for r in (held, row):
            if r not in pair:
                r["x"] = float(round(r["x"]))
        held = pair[0] if pair else None


def _rounded(rows: DataFrame, keys: list[str], seed: int, last: bool) -> DataFrame:
    """`rows` rounded within `keys`; `x` is 0 or 1 where settled."""
    def settle(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["order", "size"], kind="stable").reset_index(drop=True)
        own = [{"size": int(s), "x": float(x)} for s, x in zip(batch["size"], batch["x"])]
        tag = f"{seed}:{batch['order'].iloc[0]}:{len(batch)}"
        _pivot(own, tag)
        if last:
            for row in own:
                if 0 < row["x"] < 1:
                    row["x"] = float(random.Random(tag + ":last").random() < row["x"])
        batch["x"] = [row["x"] for row in own]
        return batch

    return rows.groupBy(*keys).applyInPandas(settle, rows.schema)


def mixed_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, cap: int = MOST_COPIES, seed: int = 8) -> DataFrame:
    """How often the mix takes each document: `id`, `source`, `content`, `rows`, `size`, `source_size`, `target`, `copies`.

    Rows alike in id, source and text are one unit (`rows` of them) and are taken equally often. A document is never
    taken more than `cap` times, and every source's words differ from its target by less than one document. Null is a
    source like any other; null, empty and wordless texts have size 0 and are taken the certain number of times. An empty
    table gives an empty result. Equal input gives equal output, whatever the partitions.
    """
    slim = docs.select(
        docs[id_col].alias("id"), docs[source_col].alias("source"), F.xxhash64(docs[text_col]).alias("content"),
        word_count(docs[text_col]).alias("size"))
    units = written(slim.groupBy("id", "source", "content", "size").agg(F.count("*").alias("rows")))
    sizes = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, cap)
    plan = targets.join(sizes.select(F.col("source").alias("own"), "units"), F.col("source").eqNullSafe(F.col("own"))).select(
        "own", "source_size", "target", F.ceil(F.col("units") / ROWS_PER_BLOCK).cast("long").alias("blocks"))
    plan = written(plan)
    rate = F.col("target") / F.greatest("source_size", F.lit(1))
    certain = F.least(F.floor(rate + 1e-12), F.lit(cap))
    order = F.xxhash64(F.lit(seed), F.col("id"), F.col("content"))
    rows = units.join(plan, F.col("source").eqNullSafe(F.col("own"))).select(
        "id", "source", "content", "rows", (F.col("size") * F.col("rows")).alias("size"), "source_size", "target",
        certain.cast("long").alias("certain"), F.least(F.greatest(rate - certain, F.lit(0.0)), F.lit(1.0)).alias("x"),
        order.alias("order"), F.pmod(order, "blocks").alias("block"))
    most = plan.agg(F.max("blocks")).first()[0] or 0
    settled = None
    pending = rows
    while True:
        last = most <= 1
        done = written(_rounded(pending, ["source", "block"], seed, last))
        own = done if last else done.filter("x = 0 or x = 1")
        settled = own if settled is None else settled.unionByName(own)
        if last:
            break
        pending = done.filter("x != 0 and x != 1").withColumn("block", F.floor(F.col("block") / FANOUT))
        most = -(-most // FANOUT)
    return settled.select(
        "id", "source", "content", "rows", (F.col("size") / F.col("rows")).cast("long").alias("size"), "source_size", "target",
        (F.col("certain") + F.col("x")).cast("long").alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """`docs` with every row repeated as often as the mix takes it, columns as they are; see `mixed_copies`."""
    copies = mixed_copies(docs, id_col, text_col, source_col, **how).filter("copies > 0").select(
        F.struct("id", "source", "content").alias("key"), "copies")
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.struct(docs[id_col].alias("id"), docs[source_col].alias("source"), F.xxhash64(docs[text_col]).alias("content")).alias("own"))
    taken = rows.join(copies, F.col("own") == F.col("key"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])
