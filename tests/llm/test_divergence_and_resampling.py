"""Source divergence and importance resampling against plain code and on awkward rows."""

from collections import Counter, defaultdict
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from visitlens.llm import divergence, resampling
from visitlens.llm.common import word_pieces

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# divergence

def brute_audit(rows, least, top):
    """Rows (lang, source, text): every term of every language priced for every two sources."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall(divergence.TERM, (text or "").translate(UPPER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = sorted(s for la, s in counts if la == lang)
        of = {s: {t: counts[lang, s][t] for t in kept} for s in groups}
        whole = {t: sum(of[s][t] for s in groups) for t in kept}

        def price(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def far(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: price(of[s]) for s in groups}, price(whole)
        for s in groups:
            pairs = sorted((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            own = sorted((-far(p[s][t], q[t]), t.encode()) for t in kept if of[s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(own[:top])}
    return out


def audit_of(spark, rows, **options):
    full = [(i, r[2], r[0], r[1], "x", "y", 3) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, term string, block string, n int").repartition(3)
    got = [tuple(r) for r in divergence.audit_sources(docs, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_audit_equals_plain_code(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)] + ["été", "日本", "Ünder"]
    rows = []
    for i in range(400):
        source = None if i % 17 == 0 else f"s{int(rng.integers(0, 21)) if i % 3 else 0}"
        text = " ".join(rng.choice(words, int(rng.integers(0, 40)), p=rng.dirichlet(np.full(len(words), 0.1))))
        rows.append((["en", "de", None, "x"][int(rng.integers(0, 3))], source, text.upper() if i % 5 == 0 else text))
    rows += [("lone", "only", "alone " * 9)] * 12 + [("bare", f"b{i}", "seldom") for i in range(4)] + [("bare", None, None), ("en", "empty", ""), ("en", "null", None)]
    want = brute_audit(rows, 10, 10)
    assert audit_of(spark, rows) == want
    assert {r[2] for r in want if r[0] == "lone"} <= {"term"} and sum(r[0] == "bare" for r in want) == 20


def test_audit_of_more_terms_than_a_block(spark, monkeypatch):
    rows = [("en", f"s{i % 11}", " ".join("".join(chr(97 + d) for d in ((i + k) // 676 % 26, (i + k) // 26 % 26, (i + k) % 26)) for k in range(0, 900, 1 + i % 3))) for i in range(33)]
    monkeypatch.setattr(divergence, "BLOCK_BITS", 6)
    assert audit_of(spark, rows, least_documents=2, top=4) == brute_audit(rows, 2, 4)


def test_audit_of_no_documents(spark):
    assert audit_of(spark, []) == set()
    assert audit_of(spark, [(None, None, None)] * 3) == set()


def test_merge_prices_both_one_sided_and_absent_terms():
    rng = np.random.default_rng(1)
    for terms in (1, 7, 300):
        for _ in range(30):
            dense = [rng.integers(0, 5, terms) * (rng.random(terms) < share) for share in rng.random(2)]
            totals = [int(d.sum()) + 2 * terms for d in dense]
            arrays = [(np.flatnonzero(d), d[np.flatnonzero(d)]) for d in dense]
            shares = [[1 + 10**9 * (int(c) + 2) // t for c in d] for d, t in zip(dense, totals)]
            want = sum((p - q) ** 2 // (p + q) for p, q in zip(*shares))
            assert divergence.merge(*arrays, *totals, terms) == want == divergence.merge(*arrays[::-1], *totals[::-1], terms)


def test_shares_are_exact_for_large_counts():
    for total in (3, 10**6 + 3, 9 * 10**15):
        counts = np.array([0, 1, total // 3, total - 2], np.int64)
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]


def test_long_texts_are_read_in_pieces():
    text = ("".join(f"Wort{chr(97 + i % 26)}{'é' * (i % 40)} . " for i in range(3000)) + "x" * 5000).encode()
    for word in (divergence._TERM, resampling._WORD):
        whole = list(word_pieces(text, word))
        cut = list(word_pieces(text, word, 64))
        assert len(whole) == 1 and len(cut) > 100 and [w for piece in cut for w in piece] == whole[0]
    assert list(word_pieces(b"", divergence._TERM)) == []


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_across_pieces(monkeypatch, longest):
    text = " ".join(f"w{i * 7919 % 23}" for i in range(500)).encode()
    whole = resampling.document_counts(text, 1000, longest)
    monkeypatch.setattr(resampling, "word_pieces", lambda t, w: word_pieces(t, w, 7))
    cut = resampling.document_counts(text, 1000, longest)
    assert [x.tolist() for x in whole] == [x.tolist() for x in cut]
    assert whole[1].sum() == resampling.least_features(500, longest)


# resampling

def brute_resample(rows, target, longest, least, percent, buckets):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        runs = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    own, goal = [features(r[1]) for r in rows], [features(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in goal for b in f)
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for (i, _), (n, f) in zip(rows, own):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    return sorted([(*r[:4], next((k + 1 for k, d in enumerate(drawn) if d is r), None)) for r in out], key=repr)


@pytest.mark.parametrize("longest, least, percent, buckets", [(1, 2, 60, 10_000), (2, 0, 100, 77), (3, 3, 50, 1000)])
def test_resampling_equals_plain_code(spark, hard, longest, least, percent, buckets):
    target = ["same text of a target", None, "", "WORD1 word2 word3 here here"]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "weight long, text string")
    got = resampling.importance_resample(hard, goal, buckets=buckets, longest=longest, least_words=least, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(rows, target, longest, least, percent, buckets)


def test_resampling_without_rows(spark, documents):
    none = documents([])
    assert resampling.importance_resample(none, none).count() == 0
    got = resampling.importance_resample(documents([(1, "word " * 30), (2, None)]), none).orderBy("doc_id").collect()
    assert [(r["n_features"], r["rank"]) for r in got] == [(30, None), (0, None)]
    assert got[0]["weight"] < 0 == got[1]["weight"]


@pytest.mark.parametrize("buckets", [1, 63, 64, 65, 10_000])
def test_planes_give_the_exact_sum(buckets):
    rng = np.random.default_rng(buckets)
    gains = rng.integers(-9000, 9000, buckets)
    dense = rng.integers(0, 2, (40, buckets)) * rng.integers(0, 100_000, (40, buckets))
    dense[3] = 0
    filled = [np.flatnonzero(d) for d in dense]
    got = resampling.plane_weights(filled, [d[f] for d, f in zip(dense, filled)], buckets, resampling.gain_planes(gains))
    assert got.tolist() == (dense @ gains).tolist()
    assert resampling.plane_weights(filled, [d[f] for d, f in zip(dense, filled)], buckets, resampling.gain_planes(gains * 0)).tolist() == [0] * 40
