"""The graph of words against plain counts, its compaction on known shapes, and whole results by brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import collocations as C
from tidemark.llm.common import Scratch


def pieces(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [ws for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (ws := re.findall(r"[^\x20\x09]+", p))]


def plain(docs, least, share, top):
    f = defaultdict(Counter)
    for lang, text in docs:
        for ws in pieces(text):
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(a for p, a in c.items() if len(p) == 1)
        own = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in own.items():
            if any(100 * b >= share * a for q, b in own.items() if len(q) > len(p) and p in (q[:-1], q[1:])):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("size", [8_000_000, 64])
def test_against_brute_force(spark, monkeypatch, size):
    """Small slices cut texts within pieces; counts stay."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(25)] + ["É", "日本", "a b", "x\x1cy"]
    text = lambda n: "".join(w + s for w, s in zip(rng.choice(words, n).tolist(), rng.choice([" ", " ", "\t", " ", ". ", "!", "\n", "  "], n).tolist()))
    passage = "one two three four five six seven eight"
    docs = [(lang, text(int(rng.integers(0, 400)))) for lang in ("en", "de", None) for _ in range(15)] + [("en", passage), ("en", passage.upper() + "!")] * 12
    docs += [("und", None), (None, ""), ("x", "A a a a a a a a a a a a a"), ("x", "single"), ("en", "ab " * 3_000), ("y y", " .,;"), ("y y", "b c b c b c b c b c b c b c b c b c b c b c b c")]
    for name in ("SLICE", "HELD"):
        monkeypatch.setattr(C, name, size)
    df = spark.createDataFrame([(x, t, "n", 5) for x, t in docs], "lang string, text string, node string, n int").repartition(4)
    got = C.collocations(df, least=10, share=50, top=40)
    assert sorted(map(tuple, got.collect())) == plain(docs, 10, 50, 40)


def chain(words, n):
    ws = words.split()
    return [("x", " ".join(ws[i : i + 3]), n) for i in range(len(ws) - 2)]


def test_compaction(spark, monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 1_000)
    long = " ".join(f"v{i}" for i in range(300))
    rows = chain(long, 12)  # one path
    rows += chain("a b c d e", 10) + chain("p b c q", 11)[1:]  # b c has two edges out
    rows += chain("k l m n k l", 10)  # a cycle of four
    rows += [("y", "u u u", 15), ("z", "g h i", 10), ("z", "h i j", 20)]  # a loop; unequal weights
    solid = spark.createDataFrame(rows, "lang string, phrase string, n long")
    scratch = Scratch(spark)
    got = sorted(map(tuple, C.compacted(solid, scratch).collect()))
    assert ("x", long, 12, 298) in got
    assert ("x", "k l m n k l", 10, 4) in got
    assert [g for g in got if g[0] in "yz"] == [("y", "u u u", 15, 1), ("z", "g h i", 10, 1), ("z", "h i j", 20, 1)]
    assert sorted(g[1] for g in got if g[0] == "x" and len(g[1]) < 12) == ["a b c", "b c d e", "b c q", "k l m n k l"]
    again = C.triples(C.compacted(solid, scratch))
    assert sorted(map(tuple, again.collect())) == sorted(rows)
    monkeypatch.setattr(C, "STRETCH", 7)
    assert sorted(map(tuple, C.triples(C.compacted(solid, scratch)).collect())) == sorted(rows)
    scratch.clear()


def test_edges_go_over_the_network_once(spark, sf):
    found = C.graph(spark.read.parquet(f"{sf}/documents.parquet"), 10)
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("MapInArrow") == 1
    assert final.count("ReusedExchange") == 3


def test_empty(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(none).count() == 0
