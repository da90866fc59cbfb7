"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from visitlens.operators.sizing import checkpoint_folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder."""
    return f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: later jobs never run what is above it."""
    spark = df.sparkSession
    path = new_folder(spark, "llm")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts only."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(2**53))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def document_key(docs: DataFrame, id_col: str, *text_cols: str) -> Column:
    """The identity of a row for joins: its id with a hash of its texts, nulls being equal to nulls.

    Rows alike in id and texts share a key; every operator treats them as one document and returns each of them.
    """
    return F.struct(docs[id_col].alias("id"), F.xxhash64(*[docs[c] for c in text_cols]).alias("content"))


def word_pieces(text: bytes, word: re.Pattern, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, lower-cased from A to Z, in order, about `piece` bytes of the text at a time.

    `word` is a run of one class of bytes that holds all those beyond ASCII; a word is never cut.
    """
    text, at = text.lower(), 0
    while at < len(text):
        end = min(at + piece, len(text))
        inside = word.match(text, end - 1)
        end = max(end, inside.end()) if inside else end
        yield word.findall(text[at:end])
        at = end
