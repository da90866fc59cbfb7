"""Benchmark decontamination: a hash table of test n-grams against every window of every document.

The n-grams of the test items become a small hash table (buckets of n-grams with their items) that travels with the plan.
Documents are scanned where they lie: no row is exchanged. A window whose hash meets a filled bucket is verified against
the n-grams of that bucket, word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from visitlens.llm.common import ascii_lower, let, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 13
TABLE_BYTES = 16 * 1024 * 1024


def words_of(text: Column) -> Column:
    """Lower-cased words (digits, letters and everything beyond ASCII); none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Distinct n-grams of the items: `gram` (words joined by blanks), `length` in words, `items` (sorted ids as text).

    An item of fewer words than `size`, but not none, is one n-gram.
    """
    length = F.least(F.size("words"), F.lit(size))
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    grams = words.filter(F.size("words") > 0).select(
        "item", length.alias("length"), "words", F.explode(starts).alias("start")).select(
        "item", "length", F.array_join(F.slice("words", F.col("start"), F.col("length")), " ").alias("gram"))
    return grams.groupBy("length", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def hash_tables(grams: DataFrame) -> list[tuple[int, int, Column]]:
    """(length, buckets, table) per n-gram length and block of n-grams.

    A table is an array of buckets, each null or an array of (gram, items), and holds at most `TABLE_BYTES`; more
    n-grams make more tables, never a larger one.
    """
    size = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda a, b: a + F.octet_length(b) + 16) + 64
    sizes = grams.groupBy("length").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()
    tables = []
    for length, n, total in sorted(tuple(r) for r in sizes):
        parts = -(-total // (TABLE_BYTES // 2))
        buckets = 1 << max(4, (8 * n // parts).bit_length())
        for part in range(parts):
            own = grams.filter(F.col("length") == length).withColumn("h", gram_hash(F.split("gram", " ")))
            own = own.filter(F.pmod(F.shiftright("h", 32), F.lit(parts)) == part)
            filled = own.groupBy(bucket_of(F.col("h"), buckets).alias("b")).agg(
                F.collect_list(F.struct("gram", "items")).alias("entries"))
            places = grams.sparkSession.range(buckets).join(filled, F.col("id") == F.col("b"), "left")
            table = places.agg(F.sort_array(F.collect_list(F.struct("id", "entries"))).alias("places")).select(
                F.transform("places", lambda place: place["entries"]).alias("table"))
            tables.append((length, buckets, table.scalar()))
    return tables


def gram_hash(words: Column) -> Column:
    return F.xxhash64(words)


def bucket_of(hashed: Column, buckets: int) -> Column:
    return hashed.bitwiseAND(buckets - 1).cast("int")


def scan_table(words: Column, length: int, buckets: int, table: Column) -> Column:
    """Verified windows of `length` words against one table: array of (start from 0, length, items)."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1))).otherwise(
        F.array().cast("array<int>"))

    def bucket(i):
        return F.get(table, bucket_of(gram_hash(F.slice(words, i, F.lit(length))), buckets))

    def verified(i):
        return let(F.array_join(F.slice(words, i, F.lit(length)), " "), lambda gram: F.struct(
            (i - 1).alias("start"), F.lit(length).alias("length"),
            F.get(F.filter(bucket(i), lambda entry: entry["gram"] == gram), F.lit(0))["items"].alias("items")))

    met = F.filter(starts, lambda i: bucket(i).isNotNull())
    return F.filter(F.transform(met, verified), lambda hit: hit["items"].isNotNull())


def scan_windows(words: Column, tables: list[tuple[int, int, Column]]) -> Column:
    """Verified windows of one document against all tables, in text order."""
    empty = F.array().cast("array<struct<start:int,length:int,items:array<string>>>")
    return F.array_sort(F.concat(empty, *[scan_table(words, *table) for table in tables]))


def covered(windows: Column) -> Column:
    """Places of the words inside any of the windows."""
    return F.array_distinct(F.flatten(F.transform(
        windows, lambda w: F.sequence(w["start"], w["start"] + w["length"] - 1))))


def with_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
              item_text: str = "text", size: int = WINDOW_WORDS, out: str = "hits") -> DataFrame:
    """`docs` with a struct column `out`: `n_words`, `n_hit` (words inside a test n-gram), `items` (sorted ids), `windows`.

    Null and wordless texts have no words and no hits; neither have items without words. Items of equal id count
    once, and an item whose id is null marks words but is not listed. An empty item table hits nothing. Repeated rows
    get equal results. A column of the input named `out` is replaced.
    """
    tables = hash_tables(item_windows(items, item_id, item_text, size))
    names = [f"__table_{i}" for i in range(len(tables))]
    held = docs.withColumns({name: table for name, (_, _, table) in zip(names, tables)})

    def scanned(bound, rest, words):
        if rest:
            return let(F.col(rest[0]), lambda table: scanned([*bound, table], rest[1:], words))
        known = [(length, buckets, table) for (length, buckets, _), table in zip(tables, bound)]
        return let(scan_windows(words, known), lambda windows: F.struct(
            F.size(words).cast("long").alias("n_words"), F.size(covered(windows)).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(windows, lambda w: w["items"])))).alias("items"),
            windows.alias("windows")))

    judged = let(words_of(docs[text_col]), lambda words: scanned([], names, words))
    return held.withColumn(out, judged).drop(*names)


def contaminated(hits: Column) -> Column:
    """True where a twentieth of the words or more lies in test n-grams."""
    return (hits["n_hit"] > 0) & (hits["n_hit"] * 20 >= hits["n_words"])


def drop_contaminated(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """The documents that are not contaminated, with their columns as they are."""
    marked = with_hits(docs, items, out="__hits", **names)
    return marked.filter(~contaminated(F.col("__hits"))).select(*[docs[c] for c in docs.columns])


def cut_windows(docs: DataFrame, items: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The documents with every hit word replaced by nothing: `text_col` becomes the words that are left, blank-joined."""
    marked = written(with_hits(docs, items, text_col=text_col, out="__hits", **names))
    places = F.sequence(F.lit(0), F.col("__hits")["n_words"].cast("int") - 1)
    left = let(words_of(F.col(text_col)), lambda words: F.array_join(F.transform(
        F.array_except(places, covered(F.col("__hits")["windows"])), lambda i: F.get(words, i)), " "))
    cut = F.when(F.col("__hits")["n_hit"] > 0, left).otherwise(F.col(text_col))
    return marked.withColumn(text_col, cut).select(*docs.columns)
