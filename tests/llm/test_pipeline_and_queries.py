"""The pipeline's stages against plain code, and the corpus queries beside their SQL."""

import re

import pytest

from checks.compare import compare, connect
import corpus_pipeline
from visitlens.llm import quality
from visitlens.llm.common import written
from visitlens.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    problem, _, _ = compare(name, QUERIES[name], ORACLES.get(name), spark, connect(FOLDER), FOLDER)
    assert problem is None


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, before = docs.columns, docs
    kept = [before]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], FOLDER)))
    good, apart, clean, mixed, dealt = kept[1:]
    assert all(k.columns == names for k in (good, apart, clean, mixed))

    model = quality.fit_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    verdicts = quality.judge_quality(docs, model).filter("kept").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r["doc_id"] for r in verdicts)
    texts = [r["text"] for r in apart.collect()]
    assert len(texts) == len(set(texts))
    assert set(texts) <= {r["text"] for r in good.collect()}

    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r["text"].lower()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    grams = {tuple(w[i:i + 13]) for w in items for i in range(len(w) - 12)}
    want = []
    for r in apart.collect():
        words, hit = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r["text"].lower()), set()
        for i in range(len(words) - 12):
            if tuple(words[i:i + 13]) in grams:
                hit.update(range(i, i + 13))
        if 20 * len(hit) < len(words) or not hit:
            want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(want)

    counts = mixed.groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in counts} <= set(want) and max(r["count"] for r in counts) <= 2
    assert sorted(r["doc_id"] for r in dealt.collect()) == sorted(r["doc_id"] for r in mixed.collect())
    sizes = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1
