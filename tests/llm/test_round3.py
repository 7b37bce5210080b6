"""The conversation trie, importance resampling and exact search against plain versions."""

import hashlib
import math
import random
import re
import time
import zlib

import pytest

from civicframe.llm import html_extract, licences, pii, prefix_trie, resampling, vector_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def plain_trie(turns, rebuild):
    """The nodes by the definition: every prefix of every conversation, and every pair of node and ancestor."""
    of = {}
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            g = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            of.setdefault(c, []).append(((t is not None, t or 0, g), (role, text)))
    of = {c: tuple(x for _, x in sorted(v)) for c, v in of.items()}
    if rebuild:
        made = {}
        for c, v in of.items():
            h = zlib.crc32(str(c).encode()) % 4
            made[c] = of.get(c - int(math.fmod(c, 20)), ())[:h] + v[h:]  # % as SQL has it
        of = made
    members = {}
    for c, v in of.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * (len(WORD.findall(k[-1][1])) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(of[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, ())), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string"


def trie_of(turns, rebuild):
    nodes, ends = prefix_trie.prefix_trie(turns, rebuild)
    ends = {(r["depth"], r["digest"] and bytes(r["digest"])): r["ends_sha256"] for r in rows(prefix_trie.ends_sha256(ends))}
    out = []
    for r in rows(nodes):
        end = ends.pop((r["depth"], r["digest"] and bytes(r["digest"])), prefix_trie.EMPTY)
        out.append(tuple(r[c] for c in COLUMNS[:-1]) + (end,))
    assert not ends
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "rebuild"), [(32, True), (2, True), (3, False)])
def test_trie(spark, monkeypatch, block, rebuild):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(block)
    texts = ["a b", "c", "", "d  e\tf", None, "g h i"]
    turns = [(c, t, rng.choice(["user", "user", None]), rng.choice(texts[: 1 + c % 6])) for c in [*range(-5, 30), 47, 8_000_000_000] for t in range(rng.choice([1, 2, 3, 9, 30]))]
    turns += [(60, t, "user", "a b") for t in range(40)] + [(61, t, "user", "a b") for t in range(25)] + [(62, None, "user", "a b"), (62, None, "user", "z"), (62, 0, "user", "c"), (62, 0, "user", "c"), (None, 1, "user", "x")]
    rng.shuffle(turns)
    df = spark.createDataFrame(turns, TURNS).selectExpr("*", "1 block", "2 digest", "3 pos", "4 n")
    assert trie_of(df, rebuild) == plain_trie(turns, rebuild)


def test_trie_of_few(spark):
    assert trie_of(spark.createDataFrame([], TURNS), True) == []
    for turns in ([(7, 0, "user", "x")], [(41, 0, "u", "a"), (41, 1, "u", "b")], [(3, None, None, None)]):
        assert trie_of(spark.createDataFrame(turns, TURNS), True) == plain_trie(turns, True)


def test_trie_of_a_long_text(spark):
    turns = [(c, 0, "user", "word " * 400_000) for c in (20, 21)]
    assert trie_of(spark.createDataFrame(turns, TURNS), False) == plain_trie(turns, False)


ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_resample(docs, target, percent=10, least=20, most=1, buckets=10_000, seed=2024):
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
        return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)], len(w)

    def tally(texts):
        out = [0] * buckets
        for x in texts:
            for f in found(x)[0]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = tally(x for _, x in docs), tally(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        fs, n = found(text)
        weight = math.floor(sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = able[: percent * len(able) // 100]
    rest = able[len(rank) :] + [r for r in out if not r[4]]
    return sorted([(*r[:4], k + 1) for k, r in enumerate(rank)] + [(*r[:4], None) for r in rest], key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_resample(spark, most):
    rng = random.Random(most)
    words = ["Apple", "b\u00e4r", "the", "\u4e2d\u6587", "x9", "It's", "\U0001f600", "-", "zed", "\u00c4"]
    docs = [(i, " ".join(rng.choices(words[: 3 + i % 8], k=rng.choice([0, 3, 30, 60])))) for i in range(300)]
    docs += [(500, docs[9][1])] * 90 + [(None, "the end " * 30), (None, None), (-4, ""), (700, "word " * 300_000)]
    target = ["apple the x9 " * 5, None, "", "Zed"]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 score", "2 rank", "3 bucket").repartition(5)
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    for percent in (10, 100, 0):
        got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in rows(resampling.resample(df, bench, percent, most=most, buckets=500))), key=str)
        assert got == plain_resample(docs, target, percent, most=most, buckets=500)


def test_resample_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rows(resampling.resample(none, none)) == []
    few = [(i, "one two three " * 9) for i in range(20)]
    got = sorted((tuple(r.values()) for r in rows(resampling.resample(spark.createDataFrame(few, "doc_id long, text string"), none))), key=str)
    assert got == plain_resample(few, [])


def plain_search(vectors, every=20, k=20):
    kept = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(64 * x) < 2**63 for x in v)}
    out = []
    for q, a in kept:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>"


def found(df, **how):
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in rows(vector_search.search(df, **how)))


@pytest.mark.parametrize("block", [2048, 16])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(vector_search, "BLOCK", block)
    rng = random.Random(block)
    vectors = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(5)]) for i in range(400)]
    vectors += [(i, [10.0 * (i % 7), 0, 0, 0, rng.random()]) for i in range(400, 520)]  # far clusters, which bounds exclude
    vectors += [(i, vectors[3][1]) for i in range(520, 620)] + [(i, [0.0] * 5) for i in range(620, 640)]  # copies
    vectors += [(700, None), (701, [1.0, None, 0, 0, 0]), (702, [math.nan] * 5), (703, [math.inf, 0, 0, 0, 0]), (None, [1.0] * 5), (704, []), (720, []), (740, [1.0, 2.0]), (741, [2.0, -1.0])]
    vectors += [(760, [3e9, 0, 0, 0, 1.0]), (780, [1e9, -3e8, 0, 0, 0]), (781, [1e300, 0, 0, 0, 0]), vectors[20], vectors[21]]
    rng.shuffle(vectors)
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v]) for i, v in vectors], VECTORS).selectExpr("*", "1 dim", "2 vec", "3 score")
    want = plain_search(vectors)
    cap = lambda x: max(min(x, 2**63 - 1), -(2**63))
    assert found(df) == [(q, r, i, cap(s)) for q, r, i, s in want]
    assert found(df, every=7, k=3) == [(q, r, i, cap(s)) for q, r, i, s in plain_search(vectors, 7, 3)]


def test_search_of_few(spark):
    assert found(spark.createDataFrame([], VECTORS)) == []
    assert found(spark.createDataFrame([(0, [1.0])], VECTORS)) == []
    two = [(0, [1.0, 0.5]), (1, [0.1, 0.1]), (2, [-1.0, 0.0])]
    assert found(spark.createDataFrame(two, VECTORS)) == plain_search(two)


def test_bounds_exclude_far_annuli():
    import numpy as np

    reach = vector_search._reach(np.array([100.0]), np.array([[10.0, 10.0]]), np.array([9.0, 500.0]), np.array([11.0, 600.0]), np.array([100.0, 100.0]))
    assert reach[0, 0] >= 100 and reach[0, 1] < -1e5


REAL, TROLL = " ".join(f"real{i}" for i in range(40)), " ".join(f"troll{i}" for i in range(120))


@pytest.mark.parametrize(
    "page",
    [
        f'<article><h1>T</h1><p>{REAL}</p><section class="comments"><p>{TROLL}</p></section></article>',
        f'<div><h1>T</h1><p>{REAL}</p></div><div id="comments"><p>{TROLL}</p></div>',
        f'<div><h1>T</h1><p>{REAL}</p></div><ol class="comment-list"><li class="comment"><p>{TROLL}</p></ol>',
        f'<main><h1>T</h1><p>{REAL}</p><article class="comment"><p>{TROLL}</p></article></main>',
        f"<article><h1>T</h1><p>{REAL}</p><aside><p>{TROLL}</p></aside></article>",
        f"<div><h1>T</h1><p>{REAL}</p></div><footer><p>{TROLL}</p></footer>",
        f'<div class="cookie-consent"><p>{TROLL}</p></div><div><h1>T</h1><p>{REAL}</p></div>',
        f'<div class="sidebar"><p>{TROLL}</p></div><div class="ad-slot">{TROLL}</div><div><h1>T</h1><p>{REAL}</p></div>',
        f'<form id="page"><div class="comments"><p>{TROLL}</p></div><article><h1>T</h1><p>{REAL}</p></article></form><footer>{TROLL}</footer>',
        f'<form id="page"><h1>T</h1><p>{REAL}</p></form><div class="advert"><p>{TROLL}</p></div>',
        f'<nav><a href="/">home</a><div><h1>T</h1><p>{REAL}</p></div>',
        f'<div><h1>T</h1><p>{REAL}</p></div><form><p>{TROLL}</p></form>',
        f'<article><h1>T</h1><p>{REAL}</p></article><nav><p>{TROLL}</p></nav><dialog>{TROLL}</dialog><div role="complementary">{TROLL}</div>',
    ],
)
def test_main_text_whatever_the_size_of_the_rest(page):
    assert html_extract.extract(f"<html><body>{page}</body></html>")[0] == f"T {REAL}"


def test_main_text_in_a_form_alone():
    assert html_extract.extract(f"<body><form><div><p>{REAL}</p></div></form></body>")[0] == REAL


def test_long_secrets(spark):
    rng = random.Random(2)
    body = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1_000_000))
    texts = [f"api_key={body}", "token=" * 20_000, f"api_key={body[:63]}", f"api_key={body[:64]}", f"api_key={body[:65]}", f"api_key={body[:200]}", f"api_key={body[:199]}x", "secret: " + "g" * 130]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    rows(pii.pseudonymize(df.where("doc_id > 4"), "k"))  # compiled once
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in rows(pii.pseudonymize(df, "k"))}
    took = time.time() - began
    assert took < 30  # both in one task each, on a shared machine; 11.5 s for 32,000 letters before
    kind = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", t)))
    assert all(got[i] != t and kind(got[i]) == kind(t) for i, t in enumerate(texts))
    assert got[0][:72] == got[3] and got[5][:136] == got[0][:136]  # blocks depend on what comes before them alone
    assert got[6][:200] == got[5][:200] and got[6] != got[5]
    assert len({got[7][8:72], got[7][72:136]}) == 2  # equal blocks differ


def test_many_licence_lines(spark):
    lines = "license here\n" * 100_000
    df = spark.createDataFrame([(1, lines), (2, "x\n" * 50_000 + "Released under the MIT License.")], "doc_id int, text string")
    began = time.time()
    found = rows(licences.paragraphs(df))
    assert time.time() - began < 40  # 43 s for 16,000 lines before
    assert sum(r["doc_id"] == 1 for r in found) == 100_000 and [r["paragraph"] for r in found if r["doc_id"] == 2] == [50_000]


@pytest.mark.parametrize(
    ("text", "family"),
    [("SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("The tool is MIT licensed.", "MIT"), ("It is free software under the GPLv3.", "GPL-3.0"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("Licensed under LGPLv3.", "LGPL")],
)
def test_short_licence_names(spark, text, family):
    found = rows(licences.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    assert [(r["family"], r["confirmed"]) for r in found] == [(family, True)]


def test_licence_cases(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert rows(licences.scan(empty)) == []
    odd = [(None, "Released under the MIT License."), (1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (4, "word " * 300_000 + "\nReleased under the MIT License.")]
    got = rows(licences.scan(spark.createDataFrame(odd, "doc_id int, text string").selectExpr("*", "1 family", "2 run", "3 gram", "4 w")))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["paragraph"], r["family"]) for r in got) == [(False, 3, 0, "MIT"), (False, 4, 1, "MIT"), (True, 0, 0, "MIT")]
