"""Periodic runs, exact top-k and phrases on small fixtures: brute force, nulls, empty tables, ties, repeated rows, clashing columns."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import base, periodic, phrases, queries, topk

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def _prepared(spark):
    base.prepare(spark)


# ---------------------------------------------------------------- 11


def brute_runs(words):
    n, seen = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                seen.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, length) for (s, length), q in seen.items())


def brute_kept(words, runs):
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(seed, n_texts, most):
    rng = random.Random(seed)
    out = []
    for i in range(n_texts):
        n = rng.randrange(most)
        if i % 6 == 0:
            w = ["a"] * n
        elif i % 6 == 1:  # Thue and Morse: no run at all
            w = [str(bin(x).count("1") % 2) for x in range(n)]
        elif i % 6 == 2:  # Fibonacci: every power below 4
            a, b = "a", "ab"
            while len(b) < n:
                a, b = b, b + a
            w = list(b[:n])
        elif i % 6 == 3:
            w = [rng.choice("ab") for _ in range(n)]
        else:
            w = []
            while len(w) < n:
                unit = [rng.choice("abc") for _ in range(rng.randrange(1, 30))]
                w += (unit * rng.randrange(1, 9))[: len(unit) * 8 - rng.randrange(len(unit))]
        out.append(w)
    return out


def test_runs_in_tiles_equal_brute_force():
    texts = repetitive(1, 600, 200)
    code = {c: base.mix64(np.array([i + 7], np.uint64))[0] for i, c in enumerate("abc01")}
    words = np.array([code[w] for t in texts for w in t], np.uint64)
    docs, found = periodic._short_documents(words, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    got = collections.defaultdict(list)
    for d, q, start, stop in zip(docs.tolist(), *(x.tolist() for x in found), strict=True):
        got[d].append((start, q, stop - start + q))
    assert all(sorted(got[i]) == brute_runs(t) for i, t in enumerate(texts))


@pytest.mark.parametrize("chunk, apart", [(1 << 15, 10), (64, 3), (40, 1)])
def test_collapsed_texts_equal_brute_force(spark, chunk, apart):
    texts = [None, "", " \n ", "x", "a a a a a", "é é é é é é", "\ta b a b\x0ba b a b c"] + [" ".join(w) for w in repetitive(2, 60, 400)]
    rows = [(i if i % 9 else None, t, i, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, *rows[:6]], "doc_id long, text string, row long, runs string").repartition(3)
    got = periodic.collapse(df, chunk=chunk, apart=apart)
    assert got.columns == ["doc_id", "n_words", "runs", "kept_text", "kept_sha256"]
    want = []
    for i, t, *_ in [*rows, *rows[:6]]:
        w = (t or "").split()
        runs = brute_runs(w)
        want.append((str(i), len(w), str(runs), brute_kept(w, runs)))
    assert sorted((str(r.doc_id), r.n_words, str([tuple(x) for x in r.runs]), r.kept_text) for r in got.collect()) == sorted(want)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got.collect())
    assert periodic.collapse(df.limit(0)).count() == 0 and periodic.collapse(df.select("text"), texts=False).select("kept_text").distinct().collect() == [(None,)]


def test_long_text_is_dealt_and_solved(spark):
    rng = random.Random(3)
    words = [rng.choice("abcdefgh") for _ in range(150_000)]
    for at, q, times in ((1000, 3, 9), (32_700, 500, 6), (60_000, 7_001, 5), (100_000, 12_000, 4)):
        words[at : at + q * times] = (words[at : at + q]) * times
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    runs = [tuple(r) for r in periodic.collapse(df, texts=False).first().runs]
    assert {q for _, q, _ in runs} >= {500, 7_001, 12_000}
    for start, q, length in runs:
        part = words[start : start + length]
        assert part[q:] == part[:-q] and length >= max(6, 4 * q)
        assert start == 0 or words[start - 1] != words[start + q - 1]
        assert start + length == len(words) or words[start + length] != words[start + length - q]


def test_op11_equals_brute_force(spark):
    import zlib

    out = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    for d in docs:
        w = (d.text or "").split()  # the texts have no other white space
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w) if n < 3000 else None
        r = out[d.doc_id]
        if runs is None:
            continue
        lines = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
        assert (r.n_runs, r.runs_sha256) == (len(runs), hashlib.sha256(lines.encode()).hexdigest())
        assert r.collapsed_sha256 == hashlib.sha256(brute_kept(w, runs).encode()).hexdigest()
        best = max(runs, key=lambda x: (x[2] / x[1], -x[0], -x[1]), default=None)
        assert (r.start, r.period, r.length) == (best or (None,) * 3) and r.exponent_milli == (1000 * best[2] // best[1] if best else None)


# ---------------------------------------------------------------- 12


def brute_top(rows, asks, k, scale=64):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for j, (q, x) in enumerate(fine):
        if asks(q):
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for o, (i, y) in enumerate(fine) if o != j)  # noqa: B905
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "hot", "wide"])
def test_topk_equals_brute_force(spark, monkeypatch, kind):
    for name, value in (("SAMPLE", 50), ("ANNULUS", 16), ("PIVOTS", 8), ("ROUNDS", (1, 3))):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(4)
    size = 1e6 if kind == "wide" else 1.0
    rows = [(i, [size * rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    if kind == "hot":  # a third of all rows are one vector, and some are shorter
        rows = [(i, [0.5] * 6 if i % 3 == 0 else v[: 2 + i % 5]) for i, v in rows]
    odd = [(None, [1.0] * 6), (1001, None), (1002, [1.0, None]), (1003, [float("nan")]), (1004, [float("inf"), 1.0]), (20, [9.0] * 6), (20, [9.0] * 6), (40, []), (1005, [0.25] * 6)]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows + odd], "vec_id long, embedding array<double>, v string, score double").repartition(3)
    got = topk.nearest(df, F.col("vec_id") % 20 == 0, 7)
    assert sorted(map(tuple, got.collect())) == brute_top(rows + odd, lambda i: i % 20 == 0, 7)


def test_topk_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    every = F.col("vec_id") % 20 == 0
    assert topk.nearest(spark.createDataFrame([], schema), every).count() == 0
    assert topk.nearest(spark.createDataFrame([(20, [1.0])], schema), every).count() == 0
    assert topk.nearest(spark.createDataFrame([(1, [1.0]), (2, [1.0])], schema), every).count() == 0
    assert [tuple(r) for r in topk.nearest(spark.createDataFrame([(20, [1.0]), (2, [-0.01])], schema), every).collect()] == [(20, 1, 2, -64)]
    with pytest.raises(Exception, match="fit a long"):
        topk.nearest(spark.createDataFrame([(20, [3e18]), (2, [1.0])], schema), every).collect()


# ---------------------------------------------------------------- 13


def brute_phrases(rows, least, top, share):
    import re

    grams = collections.defaultdict(collections.Counter)
    total = collections.Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for size in (1, 2, 3):
                grams[lang or "und"].update(" ".join(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in grams.items():
        cand = {p: a for p, a in f.items() if " " in p and a >= least}
        best = []
        for p, a in cand.items():
            w = p.split(" ")
            cuts = [(1000000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            s, k = min(cuts)
            inside = any(f" {p} " in f" {x} " and 100 * b >= share * a for x, b in cand.items() if x.count(" ") > p.count(" "))
            if not inside:
                best.append((-s, -a, p.encode(), p, a, f[" ".join(w[:k])], f[" ".join(w[k:])]))
        for r, (s, _, _, p, a, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, r + 1, p, a, left, right, total[lang], -s))
    return sorted(out)


def test_phrases_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocab = ["the", "of", "New", "york", "éa", "x" * 40, "b", "c", "It's", "中文"]
    texts = [(None, "en"), ("", "en"), (" \n ", None), (". , ;", "de"), ("one", "fr"), ("a " * 3000, "aa"), ("the new york " * 30, None)]
    for i in range(400):
        w = [rng.choice(vocab[: 3 + i % 8]) + rng.choice(["", "", "", ".", ", x", "\n", "\t"]) for _ in range(rng.randrange(40))]
        texts.append((" ".join(w), rng.choice(["en", "en", "de", None])))
    texts += texts[10:60] * 3
    df = spark.createDataFrame([(*t, 1, "clash") for t in texts], "text string, lang string, n long, phrase string").repartition(3)
    want = brute_phrases(texts, 10, 25, 50)
    assert sorted(map(tuple, phrases.collocations(df, top=25).collect())) == want and len(want) > 40
    small = {tuple(r) for r in phrases.phrase_counts(df, 4, page_bytes=2_000, task_words=500).where("size > 0").collect()}
    assert small == {tuple(r) for r in phrases.phrase_counts(df, 4).where("size > 0").collect()} and len({r[0] for r in small}) == 4
    assert phrases.collocations(df.limit(0)).count() == 0 and phrases.collocations(df.where("text is null")).count() == 0


def test_scores_beyond_64_bits_are_exact(spark, monkeypatch):
    a, left, right = 3_000_000_001, 3_000_000_007, 3_000_000_019
    rows = [("en", 0, "", 9_000_000_000), ("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)]
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: spark.createDataFrame(rows, "lang string, size int, phrase string, n long"))
    assert [tuple(r) for r in phrases.collocations(None).collect()] == [("en", 1, "x y", a, left, right, 9_000_000_000, 1000000 * a * a // (left * right))]


def test_requests_of_annuli_are_not_broadcast(spark, monkeypatch):
    """A query is asked of every annulus, which no estimate of Spark's shows."""
    plans = []

    def kept(df, name, real=topk.written):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(topk, "written", kept)
    x = np.random.default_rng(3).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = topk.nearest(df, F.col("vec_id") % 50 == 0, 5)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out.collect()}
    n = np.floor(64 * x).astype(int)
    for q in range(0, 300, 50):
        best = sorted((-int(n[q] @ n[i]), i) for i in range(300) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    searched = [p for name, p in plans if name == "best"]
    assert searched and not any("Broadcast" in p for p in searched)
