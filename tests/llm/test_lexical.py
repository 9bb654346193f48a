"""Ranked search against a plain version, with small buckets, ties, repeated ids and several blocks of queries."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, k):
    own = [(d, Counter(ts)) for d, t in docs if (ts := terms(t))]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in own:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["é日本", "Ünï", "x1"]
    odds = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()).tolist())
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(700)] + [(None, "w50 w51"), (None, None), (5, "W50, w51!"), (3, ""), (4, " \t")] + [(1000 + i, "w40 w41 w42 once more") for i in range(40)] + [(9, "W1 " * 20_000)]
    items = [(i, text(int(rng.integers(1, 30)))) for i in range(30)] + [(100, None), (101, "?!"), (102, "unknown"), (103, "w50 W50 w51"), (103, "w50"), (104, "w40 w41 w42"), (None, "once more")]
    return docs, items


@pytest.mark.parametrize("k", [1, 10])
def test_against_brute_force(spark, tables, k, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 15)
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, score int, terms string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.rank(d, q, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, k)


def test_bounds_leave_out_most(tables):
    """With few words in common, buckets and documents are left out, and nothing is lost."""
    rng = np.random.default_rng(1)
    n = 6_000
    sizes = np.minimum(rng.geometric(0.1, n), 200)
    ids = np.concatenate([rng.choice(400, s, replace=False) for s in sizes])
    impacts = rng.integers(100_000, 900_000, len(ids))
    ends = np.append(0, np.cumsum(sizes))
    norms = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, ends[:-1]))
    order = np.argsort(-norms, kind="stable")
    seen = 0
    for _ in range(40):
        ts = np.sort(rng.choice(400, 6, replace=False))
        ws = rng.integers(1, 30_000, 6)
        weight = dict(zip(ts.tolist(), ws.tolist()))
        exact = sorted(((-sum(weight.get(t, 0) * int(x) for t, x in zip(ids[ends[d] : ends[d + 1]].tolist(), impacts[ends[d] : ends[d + 1]])), d) for d in range(n)))[:10]
        query = lexical._Query(ts, ws, 0, 10)
        for begin in range(0, n, 500):
            some = order[begin : begin + 500]
            if query.norm * norms[some[0]] * lexical.SLACK < query.threshold:
                break
            seen += 1
            at = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in some])
            query.search(lexical._Bucket(some, np.zeros(500, bool), sizes[some], ids[at], impacts[at], float(norms[some[0]])))
        assert [(-s, d) for s, d in zip(query.best[0].tolist(), query.best[2].tolist())] == [e for e in exact if e[0] < 0]
    assert seen < 0.95 * 40 * 12  # Cauchy-Schwarz leaves out the shortest


def test_empty_tables(spark, tables):
    docs = spark.createDataFrame(tables[0], "doc_id long, text string")
    items = spark.createDataFrame(tables[1], "item_id long, text string")
    assert lexical.rank(docs.where("false"), items).count() == 0
    assert lexical.rank(docs, items.where("false")).count() == 0
