"""Sharding, benchmark decontamination and url filter against plain code and on awkward rows."""

from collections import Counter
import random
import re

from pyspark.sql import functions as F
import pytest

from visitlens.llm import decontaminate, sharding, urls
from visitlens.llm.components import connected_components

ITEM = "item_id long, text string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# sharding

def test_shards_hold_every_row_once_with_gapless_slots(spark):
    rows = spark.range(1003).withColumn("shard", F.lit("old")).repartition(7)
    got = sharding.shuffle_to_shards(rows, 16).toPandas()
    assert list(got.columns) == ["id", "shard", "slot"]
    assert sorted(got["id"]) == list(range(1003))
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_matrix_draws_have_the_hypergeometric_mean_and_spread(spark):
    u = [(float((i + 0.5) / 4000),) for i in range(4000)]
    draw = sharding.hypergeometric(F.col("u"), F.lit(30).cast("long"), F.lit(70).cast("long"), F.lit(40).cast("long"))
    got = spark.createDataFrame(u, "u double").select(draw.alias("x")).agg(F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x")).first()
    assert got[0] == pytest.approx(12, abs=0.01)
    assert got[1] == pytest.approx(40 * 0.3 * 0.7 * 60 / 99, rel=0.01)
    assert got[2] >= 0 and got[3] <= 30


@pytest.mark.parametrize("good, bad, draws, want", [(5, 0, 3, 3), (0, 5, 3, 0), (3, 4, 7, 3), (3, 4, 0, 0), (0, 0, 0, 0)])
def test_certain_draws(spark, good, bad, draws, want):
    args = [F.lit(n).cast("long") for n in (good, bad, draws)]
    assert spark.range(1).select(sharding.hypergeometric(F.lit(0.7), *args).alias("x")).first()[0] == want


def test_draws_whose_counts_multiply_beyond_a_long(spark):
    half = F.lit(10**10).cast("long")
    u = spark.createDataFrame([(0.5,), (0.1,), (0.9,)], "u double")
    got = [r[0] for r in u.select(sharding.hypergeometric(F.col("u"), half, half, half).alias("x")).collect()]
    spread = (10**10 / 8) ** 0.5
    assert abs(got[0] - 5 * 10**9) <= 2 and got[1] - got[0] == pytest.approx(-1.2816 * spread, rel=0.01)
    assert got[2] - got[0] == pytest.approx(1.2816 * spread, rel=0.01)


def test_matrix_rows_and_columns_add_up(spark):
    counts = spark.createDataFrame([(i, 10 + 7 * i) for i in range(9)], "block long, n long")
    rows = {r["block"]: r["sends"] for r in sharding.communication_matrix(counts, 4, 1).collect()}
    assert {b: sum(s) for b, s in rows.items()} == {i: 10 + 7 * i for i in range(9)}
    columns = [sum(s[j] for s in rows.values()) for j in range(4)]
    assert sum(columns) == 342 and max(columns) - min(columns) <= 1


def test_shards_of_awkward_rows(hard, documents):
    got = sharding.shuffle_to_shards(hard, 5).toPandas()
    assert len(got) == 12 and sorted(got.groupby("shard").size()) == [2, 2, 2, 3, 3]
    assert set(got.columns) == set(hard.columns) | {"slot"}
    assert sharding.shuffle_to_shards(documents([]), 4).count() == 0


# decontamination

def brute_hits(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    own, hit, met = words(text), set(), set()
    for item, item_text in items:
        item_words = words(item_text)
        size = min(13, len(item_words))
        grams = {tuple(item_words[i:i + size]) for i in range(len(item_words) - size + 1)} if size else set()
        for i in range(len(own) - size + 1) if size else ():
            if tuple(own[i:i + size]) in grams:
                hit.update(range(i, i + size))
                met.add(item)
    return len(own), len(hit), sorted(str(i) for i in met if i is not None)


def test_windows_against_plain_code(spark, documents):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Éa", "ß9", "A-b"]
    items = [(i, " ".join(draw.choices(vocabulary, k=n))) for i, n in enumerate([30, 13, 14, 5, 1, 0, 20])]
    items += [(3, items[0][1]), (None, items[2][1]), (9, None)]
    items[4] = (4, "unusual")
    texts = []
    for _ in range(60):
        parts = draw.choices(vocabulary, k=draw.randrange(40))
        part = items[draw.randrange(7)][1].split()
        cut = draw.randrange(len(part) + 1)
        texts.append(" ".join(parts + (part if draw.random() < 0.5 else part[cut:]) + draw.choices(vocabulary, k=5)).upper())
    texts += [None, "", "unusual"]
    docs = documents(list(enumerate(texts)))
    got = decontaminate.with_hits(docs, spark.createDataFrame(items, ITEM)).select("doc_id", "hits.*").collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_small_tables_give_the_same_hits(spark, documents, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(30)], ITEM)
    docs = documents([(i, "start " + " ".join(f"q{i}x{j}" for j in range(3, 18)) + " end") for i in range(30)])
    want = decontaminate.with_hits(docs, items).select("doc_id", "hits").collect()
    monkeypatch.setattr(decontaminate, "TABLE_BYTES", 20_000)
    assert len(decontaminate.hash_tables(decontaminate.item_windows(items, "item_id", "text", 13))) > 1
    got = decontaminate.with_hits(docs, items).select("doc_id", "hits").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert all(r["hits"]["n_hit"] == 15 for r in got)


def test_contaminated_documents_go_and_spans_are_cut(spark, documents):
    item = " ".join(f"t{i}" for i in range(13))
    items = spark.createDataFrame([(1, item)], ITEM)
    clean = " ".join(f"c{i}" for i in range(300))
    docs = documents([(1, item), (2, clean), (3, f"{clean} {item}"), (4, f"one {item} two"), (5, None)])
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and "Python" not in plan_of(left)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 5]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_windows(docs, items).collect()}
    assert cut == {1: "", 2: clean, 3: clean, 4: "one two", 5: None}


def test_decontamination_of_awkward_rows(spark, hard, documents):
    items = spark.createDataFrame([(1, "same text here"), (2, None), (3, "")], ITEM)
    got = decontaminate.with_hits(hard, items)
    assert sorted(got.columns) == sorted(hard.columns)
    assert Counter(r["n"] for r in got.select(F.col("hits")["n_hit"].alias("n")).collect()) == {0: 8, 3: 4}
    assert decontaminate.with_hits(documents([]), items).count() == 0
    assert decontaminate.with_hits(hard, items.limit(0)).filter(F.col("hits")["n_hit"] > 0).count() == 0


# urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judged(spark, pages, redirects=None):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = spark.createDataFrame(pages, "page_id long, url string, html string, verdict string, host string")
    if redirects is not None:
        redirects = spark.createDataFrame(redirects, "from_url string, to_url string")
    got = urls.judge_urls(rows, rules, redirects)
    assert sorted(got.columns) == ["host", "html", "page_id", "path", "rule", "url", "verdict"]
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}


def test_rules_by_suffix_and_length(spark):
    pages = ["http://A.Example.NET/en/x", "https://example.net/fr/", "http://badexample.net", "http://x.example.com/de/1?q#f", "http://q.org/fr/", "no scheme", None, "http://example.com/en"]
    got = judged(spark, [(i, u, None, "v", "h") for i, u in enumerate(pages)])
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/fr/", "net/", "block")
    assert got[2] == ("badexample.net", "", None, "allow")
    assert got[3] == ("x.example.com", "/de/1", "example.com/de/", "block")
    assert got[4][2:] == ("org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == (None, "allow")


def test_blocks_reach_aliases_but_not_allowed_pages(spark):
    link = '<head><LINK href="{}" rel=canonical></head>'
    pages = [
        (1, "http://a.com/1", link.format("http://b.com/2"), "", ""), (2, "http://b.com/2", link.format("//spam.net/x"), "", ""),
        (3, "http://c.com/3", '<meta http-equiv="refresh" content="0; url=/4">', "", ""), (4, "https://c.com/4#top", None, "", ""),
        (5, "http://ok.org/fr/", link.format("http://spam.net/x"), "", ""), (6, "http://d.com/6", None, "", ""), (7, "http://c.com/5", "", "", "")]
    got = judged(spark, pages, [("http://d.com/6?utm_source=z", "http://b.com/2"), ("http://c.com/4", "https://example.com/de/9"), (None, "x")])
    assert {p: v[3] for p, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow"}


def test_url_plan_is_native_and_empty_pages_stay_empty(spark):
    assert judged(spark, []) == {}
    same = [(1, "http://spam.net/", None, "", "")] * 5
    assert judged(spark, same) == {1: ("spam.net", "/", "net/", "block")}


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(40)] + [(2000, 2000), (None, 5)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)}
    assert len(got) == 101
