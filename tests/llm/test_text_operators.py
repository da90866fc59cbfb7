"""Secrets, line chunks, near duplicates, licenses, mixing, repeated strings and quality against plain code."""

from collections import Counter, defaultdict
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F
import pytest

from visitlens.llm import licenses, line_chunks, mixing, near_duplicates, quality, secrets, suffixes

WORDS = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "en", "io", "ur", "est", "ing")]


def prose(draw, n):
    return " ".join(draw.choices(WORDS, k=n))


# secrets

def test_base_patterns():
    text = 'PASSWORD: "abcdef" token=abc Api_Key" = zzzzzz- AKIA' + "A1" * 8 + " " + "0f" * 12 + " " + "0f" * 11 + " ſecret=abcdefg"
    kinds = [(text[a:b], kind) for a, b, kind in secrets.base_spans(text)]
    assert kinds == [('PASSWORD: "abcdef', "assign"), ('Api_Key" = zzzzzz-', "assign"), ("AKIA" + "A1" * 8, "access"), ("0f" * 12, "hex")]
    assert secrets.base_spans("token: token: abcdefgh") == []


@pytest.mark.parametrize("text, found", [
    ('key = "Zx81kQ02mmPq77aa"\nclient_secret = key', ["Zx81kQ02mmPq77aa"]),
    ('a = "Zx81kQ02"\nb = "mmPq77aa"\nauth_token = a + b', ["Zx81kQ02", "mmPq77aa"]),
    ('a = "Zx81kQ02"\nauth_token = a . "mmPq77aa"', ["Zx81kQ02", "mmPq77aa"]),
    ('a = "Zx81kQ02mm"\na = a + a\nauth_token = a + a', ["Zx81kQ02mm"]),
    ('{"dbPassword": "s3cr3t-Value!"}', ["s3cr3t-Value!"]),
    ("<apiKey>Zx81kQ02mmPq</apiKey>", ["Zx81kQ02mmPq"]),
    ('config.set("private_key", "Zx81kQ02mmPq77")', ["Zx81kQ02mmPq77"]),
    ('password = "changeme"', []), ('password_length = "Zx81kQ02mmPq"', []), ("title: Zx81kQ02mmPq77aa", []), ("a == b", [])])
def test_lexer_follows_constants(text, found):
    assert sorted(text[a:b] for a, b, _ in secrets.lexed_spans(text)) == sorted(found)


def test_secret_scan_is_linear_on_hostile_text():
    for text in ("a" * 300_000, "token " * 50_000, "a=" * 100_000, '"' * 100_000, "x = " + "y + " * 50_000):
        secrets.scan(text)


@pytest.mark.parametrize("name", ["x", "client_secret"])
def test_constants_that_double_stay_small(name):
    """Every line doubles the value; its strings stay those of the text."""
    text = f'{name} = "Zx81kQ02mm"\n' + f"{name} = {name} + {name}\n" * 2000 + f"auth_token = {name}"
    assert [text[a:b] for a, b, _ in secrets.lexed_spans(text)] == ["Zx81kQ02mm"]
    chain = 'a0 = "Zx81kQ02"\n' + "".join(f'a{i} = a{i - 1} + "p{i}"\n' for i in range(1, 20_000)) + "auth_token = a19999"
    assert len(secrets.lexed_spans(chain)) == 20_000


def test_secrets_of_awkward_rows(hard, documents):
    got = secrets.scan_secrets(hard).collect()
    assert len(got) == 12 and all(r["spans"] == "" for r in got)
    assert {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.scan_secrets(documents([])).count() == 0


# line chunks

def bounds_of(lines, times=None):
    hashes = line_chunks.window_hashes(lines)
    return line_chunks.chunk_bounds(hashes, dict.fromkeys(hashes, 2) if times is None else times)


def test_chunks_shift_with_the_text():
    draw = random.Random(1)
    lines = [prose(draw, 6) for _ in range(200)]
    own = {tuple(lines[a:b]) for a, b in bounds_of(lines)}
    moved = ["new", *lines[:90], "and here", *lines[90:]]
    again = {tuple(moved[a:b]) for a, b in bounds_of(moved)}
    assert len(own & again) >= len(own) - 6
    bounds = bounds_of(lines)
    assert bounds[0][0] == 0 and bounds[-1][1] == 200 and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    assert all(b - a >= 2 for a, b in bounds) and bounds_of(["one"]) == [] == bounds_of(lines, {})


def brute_chunks(rows):
    """The kept text of every document, pairs of lines counted one by one."""
    pairs = Counter(pair for _, text in rows for lines in [text.split("\n")] for pair in zip(lines, lines[1:]))
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines, kept, at = text.split("\n"), [], 0
        times = {line_chunks.window_hashes(list(pair))[0]: pairs[pair] for pair in zip(lines, lines[1:]) if pairs[pair] > 1}
        for start, end in bounds_of(lines, times):
            part = "\n".join(lines[start:end])
            kept += lines[at:start] + ([] if part in seen else lines[start:end])
            seen.add(part)
            at = end
        out[doc_id] = "\n".join(kept + lines[at:])
    return out


def lines_of_repeated_runs(rows):
    """Per document the numbers of its lines in runs of two or more that an earlier text has; no hash and no chunk."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        pairs = list(zip(lines, lines[1:]))
        out[doc_id] = {j for i, pair in enumerate(pairs) if pair in seen for j in (i, i + 1)}
        seen |= set(pairs)
    return out


def test_repeated_chunks_against_plain_code(documents):
    draw = random.Random(2)
    block = [prose(draw, 5) for _ in range(30)]
    rows = []
    for i in range(25):
        own = [prose(draw, 5) for _ in range(draw.randrange(1, 12))]
        rows.append((i, "\n".join(own + (block if i % 2 else block[:draw.randrange(30)]) + own)))
    docs = documents(rows)
    got = line_chunks.drop_repeated_chunks(docs).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute_chunks(rows)
    assert sum(r["n_removed_lines"] for r in got) > 100
    assert all(len(r["text"].split("\n")) == r["n_lines"] - r["n_removed_lines"] or not r["text"] for r in got)


def test_nine_of_ten_repeated_lines_go(documents):
    """Passages of two to eight lines in other surroundings, against all repeated runs of lines."""
    draw = random.Random(7)
    passages = [[prose(draw, 5) for _ in range(draw.randrange(2, 9))] for _ in range(30)]
    rows = []
    for i in range(150):
        lines = [prose(draw, 5) for _ in range(draw.randrange(1, 6))]
        for passage in draw.sample(passages, draw.randrange(3)):
            at = draw.randrange(len(lines) + 1)
            lines[at:at] = passage
        rows.append((i, "\n".join(lines)))
    due = lines_of_repeated_runs(rows)
    got = {r["doc_id"]: r for r in line_chunks.drop_repeated_chunks(documents(rows)).collect()}
    text = "\n".join(r["text"] for r in got.values())
    assert all(line in text for passage in passages for line in passage if any(line in t for _, t in rows))
    assert all(got[i]["n_removed_lines"] <= len(due[i]) for i, _ in rows)
    assert sum(r["n_removed_lines"] for r in got.values()) >= 0.9 * sum(map(len, due.values())) > 300


def test_recall_of_repeated_lines_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    due = lines_of_repeated_runs(rows)
    got = {r["doc_id"]: r["text"] for r in line_chunks.drop_repeated_chunks(docs).select("doc_id", "text").collect()}
    gone = 0
    for doc_id, text in rows:
        # lines that went: what is left is a subsequence of the lines
        kept = iter(got[doc_id].split("\n"))
        want = next(kept, None)
        for number, line in enumerate(text.split("\n")):
            if line == want:
                want = next(kept, None)
            else:
                gone += number in due[doc_id]
    assert gone >= 0.9 * sum(map(len, due.values()))


def test_line_chunks_of_awkward_rows(hard, documents):
    got = line_chunks.drop_repeated_chunks(hard.withColumn("n_lines", F.lit("old"))).collect()
    assert len(got) == 12 and sum(r["n_removed_lines"] for r in got) == 0
    assert sorted(str(r["text"])[:20] for r in got) == sorted(str(r["text"])[:20] for r in hard.collect())
    assert line_chunks.drop_repeated_chunks(documents([])).count() == 0


# near duplicates

def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        at = draw.randrange(len(words))
        words[at:at + 1] = draw.choice([[], [draw.choice(WORDS)], [words[at], draw.choice(WORDS)]])
    return words


def plain_similarity(a, b):
    """Longest common subsequence of the labelled shingles by the full table."""
    x, y = [near_duplicates.labelled(s).tolist() for s in near_duplicates.shingle_hashes([a, b])]
    row = [0] * (len(y) + 1)
    for i in x:
        new = [0]
        for j, other in enumerate(y):
            new.append(row[j] + 1 if i == other else max(row[j + 1], new[j]))
        row = new
    return row[-1] / (len(x) + len(y) - row[-1])


def test_alignment_against_the_full_table():
    draw = random.Random(5)
    for _ in range(60):
        words = draw.choices(WORDS, k=draw.randrange(6, 120))
        other = edited(draw, words, draw.randrange(6))
        if draw.random() < 0.3:
            cut = draw.randrange(len(other) + 1)
            other = other[cut:] + other[:cut]
        a, b = " ".join(words), " ".join(other)
        x, y = [near_duplicates.labelled(s) for s in near_duplicates.shingle_hashes([a, b])]
        want, got = plain_similarity(a, b), near_duplicates.aligned_similarity(x, y)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_groups_against_all_pairs(documents):
    draw = random.Random(7)
    rows = []
    for _ in range(25):
        words = draw.choices(WORDS, k=draw.randrange(60, 200))
        for _ in range(draw.randrange(1, 5)):
            rows.append((len(rows), " ".join(edited(draw, words, draw.randrange(5)))))
        rows.append((len(rows), rows[-1][1]))
    docs = documents(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(docs).collect()}
    label = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows[:i]:
            if a == b or plain_similarity(a, b) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert got == label
    kept = sorted(r["doc_id"] for r in near_duplicates.keep_first(docs).collect())
    assert kept == sorted(set(label.values()))


def test_no_link_of_a_crowded_bucket_is_lost(documents):
    draw = random.Random(19)
    passage, texts = draw.choices(WORDS, k=80), []
    for _ in range(30):
        words = passage + draw.choices(WORDS, k=50)
        texts += [" ".join(words), " ".join(edited(draw, words, 2))]
    draw.shuffle(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(
        documents(list(enumerate(texts))), bands=1, per_band=1, kept=1).collect()}
    bucket = [near_duplicates.order_min_hash(s, 1, 1, 1)[0] for s in near_duplicates.shingle_hashes(texts)]
    links = [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if plain_similarity(a, b) >= 0.8]
    shared = [(i, j) for i, j in links if bucket[i] == bucket[j]]
    assert len(shared) >= 15 and all(got[i] == got[j] for i, j in shared)
    assert all((i, j) in links for i in got for j in got if j < i and got[i] == got[j])  # every group is one planted pair


def test_prefix_join_keeps_every_similar_pair_and_few_others(spark):
    draw = random.Random(23)
    passage, rows = draw.choices(WORDS, k=30), []
    for i in range(40):
        words = draw.choices(WORDS, k=70) + passage + draw.choices(WORDS, k=draw.randrange(20))
        rows.append((2 * i, i % 25, " ".join(words)))
        rows.append((2 * i + 1, i % 25 if i % 4 == 0 else 100 + i, " ".join(edited(draw, words, draw.randrange(1, 4)))))
    texts = spark.createDataFrame(rows, "id long, class long, text string")
    got = {(r["a"], r["b"]) for r in near_duplicates.prefix_pairs(texts, 5, 0.8).collect()}
    want = {(i, j) for i, a, x in rows for j, b, y in rows if i < j and a != b and plain_similarity(x, y) >= 0.8}
    assert len(want) >= 10 and want <= got and len(got) <= 40


def test_near_duplicates_of_awkward_rows(hard, documents):
    got = near_duplicates.near_duplicate_classes(hard).collect()
    assert len(got) == 12
    assert {r["doc_id"]: r["class_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, None: None, 6: 6, 7: 7, 8: 8, 9: 4}
    assert near_duplicates.keep_first(hard).columns == hard.columns
    assert sorted(str(r["doc_id"]) for r in near_duplicates.keep_first(hard).collect()) == sorted(["1", "2", "3", "4", "6", "7", "8", "None", "None"])
    assert near_duplicates.near_duplicate_classes(documents([])).count() == 0


def test_sketches_depend_on_order_and_labels():
    words = [f"w{i}" for i in range(30)]
    forward, again = near_duplicates.shingle_hashes([" ".join(words), " ".join(words).upper()])
    assert (forward == again).all()
    twice = near_duplicates.labelled(np.r_[forward, forward])
    assert len(set(twice.tolist())) == 2 * len(forward)
    a = near_duplicates.order_min_hash(forward, 8, 1, 2)
    b = near_duplicates.order_min_hash(forward[::-1].copy(), 8, 1, 2)
    assert (a != b).all() and len(a) == 8


# licenses

def test_license_found_with_changes():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    notice = licenses.TEMPLATES["ISC"].replace("any purpose", "every purpose").replace("hereby", "")
    text = "Intro words here.\n" + notice + "\nand more text Released under the\nMIT License. end"
    found = licenses.match_licenses(text, index)
    assert [f[0] for f in found] == ["ISC", "MIT-line"]
    name, coverage, start, end = found[0]
    assert 0.9 < coverage < 1 and text[start:end].startswith("Permission to use") and text[start:end].endswith("copies")
    assert found[1][1] == 1.0 and text[found[1][2]:found[1][3]] == "Released under the\nMIT License"


def test_alignment_reports_every_place_and_no_half_notice():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    line = licenses.TEMPLATES["GPL-3.0-line"]
    filler = " ".join(f"x{i}" for i in range(40))
    assert [f[0] for f in licenses.match_licenses(f"{line} {filler} {line}", index)] == ["GPL-3.0-line"] * 2
    assert licenses.match_licenses(" ".join(licenses.TEMPLATES["MIT"].split()[:30]), index) == []


@pytest.mark.parametrize("name", ["MIT-line", "CC-BY-NC-4.0-line", "Apache-2.0-line", "GPL-3.0-line", "ISC"])
def test_notices_back_to_back_are_separate_places(name):
    index, line = licenses.TemplateIndex({name: licenses.TEMPLATES[name]}), licenses.TEMPLATES[name]
    for n in (1, 2, 3, 7):
        text = "\n".join([line] * n)
        want = [(name, 1.0, i * (len(line) + 1), i * (len(line) + 1) + len(line) - 1) for i in range(n)]
        assert licenses.match_licenses(text, index) == want
        assert [m[0] for m in licenses.match_licenses("one two " + text + " three", index)] == [name] * n


@pytest.mark.parametrize("name", ["MIT-line", "CC-BY-NC-4.0-line", "Apache-2.0-line"])
def test_short_notice_with_any_word_changed(name):
    index, words = licenses.TemplateIndex(licenses.TEMPLATES), licenses.WORD.findall(licenses.TEMPLATES[name])
    for i in range(len(words)):
        text = " ".join(["before", *words[:i], "changed", *words[i + 1:], "after"])
        assert (name, (len(words) - 1) / len(words)) in [m[:2] for m in licenses.match_licenses(text, index)]


def test_banded_alignment_against_the_full_table():
    draw = random.Random(9)
    for _ in range(40):
        a = np.array(draw.choices(range(6), k=12), np.uint64)
        b = np.array(draw.choices(range(6), k=14), np.uint64)
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert licenses.banded_alignment(a, b, 0, 20)[0] == row[-1]


def test_licenses_of_awkward_rows(hard, documents):
    assert [r["n_matches"] for r in licenses.scan_licenses(hard).collect()] == [0] * 12
    assert licenses.scan_licenses(documents([])).count() == 0


# mixing

def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in over}


def test_targets_against_resharing_rounds(spark):
    draw = random.Random(4)
    for n in (1, 2, 5, 20):
        sizes = {f"s{i}": draw.randrange(1, 2000) for i in range(n)} | {None: 50, "zero": 0}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_pivots_keep_sums_and_expectations():
    draw, mean = random.Random(6), np.zeros(12)
    sizes, fractions = [draw.randrange(1, 50) for _ in range(12)], [draw.random() for _ in range(12)]
    for trial in range(3000):
        rows = [{"size": s, "x": x} for s, x in zip(sizes, fractions)]
        mixing._pivot(rows, str(trial))
        assert sum(0 < r["x"] < 1 for r in rows) <= 1
        assert sum(r["size"] * r["x"] for r in rows) == pytest.approx(np.dot(sizes, fractions))
        mean += [r["x"] for r in rows]
    assert np.abs(mean / 3000 - fractions).max() < 0.05


def test_mix_comes_near_its_targets(documents, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", 20)
    monkeypatch.setattr(mixing, "FANOUT", 3)
    draw = random.Random(8)
    docs = documents([(i, prose(draw, draw.randrange(1, 60)), draw.choice(["a", "a", "a", "b", "c", None])) for i in range(800)])
    got = mixing.mixed_copies(docs).toPandas()
    assert len(got) == 800 and got["copies"].between(0, 2).all()
    for _, own in got.groupby("source", dropna=False):
        taken = (own["size"] * own["copies"]).sum()
        assert abs(taken - own["target"].iloc[0]) <= 60
    again = mixing.mixed_copies(docs.repartition(7)).toPandas()
    key = ["id", "source", "size", "copies"]
    assert got[key].sort_values("id").values.tolist() == again[key].sort_values("id").values.tolist()
    rows = mixing.mix_sources(docs)
    assert rows.columns == docs.columns and rows.count() == got["copies"].sum()


def test_mixing_of_awkward_rows(hard, documents):
    got = mixing.mixed_copies(hard).toPandas()
    assert got["rows"].sum() == 12 and got["copies"].between(0, 2).all()
    assert set(mixing.mix_sources(hard).columns) == set(hard.columns)
    assert mixing.mixed_copies(documents([])).count() == 0 and mixing.mix_sources(documents([])).count() == 0


# repeated strings

def brute_strings(rows):
    first = defaultdict(lambda: None)
    out = {}
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        gone, own = bytearray(len(raw)), []
        for i in range(len(raw) - 49):
            window = raw[i:i + 50]
            if first[window] is not None and first[window] < doc_id:
                gone[i:i + 50] = b"\1" * 50
            own.append(window)
        for window in own:
            first[window] = doc_id if first[window] is None else first[window]
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out[doc_id] = (len(raw), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def test_strings_against_plain_code(documents):
    draw = random.Random(11)
    passages = [prose(draw, n) for n in (9, 12, 15, 60)] + ["a" * 120, "ab" * 40, "é" * 40]
    rows = []
    for i in range(120):
        parts = [prose(draw, draw.randrange(12)) for _ in range(3)] + draw.choices(passages, k=2)
        draw.shuffle(parts)
        rows.append((i, " ".join(parts)[draw.randrange(8):]))
    rows += [(200, rows[3][1]), (201, rows[3][1][7:-9]), (202, "short"), (203, "")]
    docs = documents(rows)
    for chunk_bytes in (1 << 20, 700):
        got = suffixes.drop_repeated_strings(docs, chunk_bytes=chunk_bytes).collect()
        assert {r["doc_id"]: (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in got} == brute_strings(rows)


def test_strings_of_awkward_rows(hard, documents):
    got = suffixes.drop_repeated_strings(hard).collect()
    assert len(got) == 12 and all(r["kept"] is None or len(r["kept"]) == r["n_bytes"] for r in got)
    assert sum(r["kept"] is None for r in got) == 2
    text = "the same long text of more than fifty bytes, twice under one id and once without an id"
    same = suffixes.drop_repeated_strings(documents([(1, text), (1, text), (None, text), (2, text)])).collect()
    assert sorted((str(r["doc_id"]), len(r["kept"])) for r in same) == [("1", len(text))] * 2 + [("2", 0), ("None", len(text))]
    assert suffixes.drop_repeated_strings(documents([])).count() == 0


def test_exchanged_anchors_and_contexts_are_small():
    draw = np.random.default_rng(5)
    text = np.frombuffer(prose(random.Random(5), 40_000).encode(), np.uint8)
    place, values = suffixes.anchors(text, np.array([0]), np.array([len(text)]))
    values = np.unique(values)
    low = np.where(np.arange(len(values)) % 50, draw.integers(70_000, 70_300, len(values)), draw.integers(-(1 << 62), 1 << 62, len(values)))
    high = np.where(np.arange(len(values)) % 9, low, low + 1)
    blob = suffixes.pack_anchors(values, low, high)
    assert all((x == y).all() for x, y in zip(suffixes.unpack_anchors(blob), (values, low, high)))
    assert len(blob) < 8 * len(values)  # 24 bytes each as they are, half of them noise
    numbers = np.flatnonzero(draw.random(len(place)) < 0.2)
    rows = draw.integers(97, 101, (len(numbers), suffixes.CONTEXT + 2)).astype(np.uint8)
    blob = suffixes.pack_contexts(numbers, low[numbers % len(low)], rows)
    got = suffixes.unpack_contexts(blob)
    assert all((x == y).all() for x, y in zip(got, (numbers, low[numbers % len(low)], rows)))
    assert got[0].dtype == np.int32 and len(blob) < (4 + rows.shape[1] / 3.5) * len(numbers)


# quality

def plain_repeats(words):
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_measures_against_plain_code():
    draw = random.Random(13)
    for _ in range(80):
        text = "".join(draw.choices(["a", "b", "c", " ", "\n", "\x0b", "\x1c", " ", "é", "#", "|"], k=draw.randrange(60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = text.split("\n")
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
                sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines)), plain_repeats(words))
        raw = text.encode()
        assert quality.measures(text, raw.split()) == want


def test_classifier_separates_held_out_rows(spark, documents):
    draw = random.Random(17)
    def bad():
        return " ".join(w + draw.choice(["###", "$$$", "!!", "***"]) for w in draw.choices(WORDS, k=80))
    rows = [(i, bad() if i % 4 == 0 else prose(draw, 80)) for i in range(400)]
    docs = documents(rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(1, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = {r["doc_id"]: r for r in quality.judge_quality(docs, model).collect()}
    assert np.mean([got[i]["kept"] == (i % 4 > 0) for i in range(300, 400)]) >= 0.98
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in got if got[i]["kept"])
    assert quality.fit_quality(docs, labels.filter("quality = 1")) is None


def test_quality_of_awkward_rows(hard, documents):
    got = quality.judge_quality(hard, None).collect()
    assert len(got) == 12
    assert not any(r["kept"] for r in got)  # short, or the same words over and over
    assert {r["doc_id"]: r["n_words"] for r in got}[6] == 60_000
    assert quality.keep_good(hard, None).count() == 0 and quality.judge_quality(documents([]), None).count() == 0
