import numpy as np
import pytest

from tidemark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, key string, links int"


def rows():
    rng = np.random.default_rng(5)
    out = []
    for label in range(3):
        base = rng.normal(size=(60, 16))
        for i, v in enumerate(base):
            out.append((label * 1000 + i, v, label))
        for i in range(20):  # near ones of growing distance, some beyond the threshold
            out.append((label * 1000 + 100 + i, base[i] + rng.normal(size=16) * 0.02 * i, label))
        for i in range(80):  # a dense group
            out.append((label * 1000 + 200 + i, base[59] + rng.normal(size=16) * 0.05, label))
    made = [(i, [float(np.float32(x)) for x in v], label, "k", 1) for i, v, label in out]
    made += [(9001, made[0][1], 0, None, None), (9001, made[0][1], 0, None, None), (9002, made[0][1], None, "k", 1), (9003, None, 0, "k", 1), (9004, [0.0] * 16, 0, "k", 1), (9005, [float("nan")] + [1.0] * 15, 0, "k", 1)]
    made += [(9006, [None] + [1.0] * 15, 0, "k", 1), (9007, [1.0] * 5, 0, "k", 1), (9008, [], 0, "k", 1), (None, made[0][1], 0, "k", 1), (9009, [float("inf")] * 16, 0, "k", 1), (9010, [2 * x for x in made[0][1]], 0, "k", 1)]
    return made


def plain(made):
    """n_links and component of every row by comparing all pairs."""
    ok = [i for i, (k, v, label, *_) in enumerate(made) if k is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(made), list(range(len(made)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ok:
        for b in ok:
            if a != b and made[a][2] == made[b][2] and len(made[a][1]) == len(made[b][1]):
                x, y = np.array(made[a][1]), np.array(made[b][1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[a] += 1
                    root[find(a)] = find(b)
    low = {}
    for i in ok:
        low[find(i)] = min(low.get(find(i), made[i][0]), made[i][0])
    return sorted(((made[i][0] is None, made[i][0] or 0, links[i], low[find(i)] if i in set(ok) else made[i][0]) for i in range(len(made))), key=str)


@pytest.mark.parametrize("shard_rows", [1024, 60])
def test_links_and_components(spark, shard_rows):
    made = rows()
    got = vectors.near_duplicates(spark.createDataFrame(made, SCHEMA), shard_rows=shard_rows).collect()
    mine = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in got), key=str)
    want = plain(made)
    if shard_rows == 1024:
        assert mine == want
    else:  # several shards: recall of at least 0.99, and nothing below the threshold
        assert all(a[2] <= b[2] for a, b in zip(mine, want))
        assert sum(a[2] for a in mine) >= 0.99 * sum(b[2] for b in want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_a_large_tight_cluster_keeps_its_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    tight = base / np.linalg.norm(base) + rng.normal(size=(700, 64)) * 0.0235
    made = np.concatenate([tight, rng.normal(size=(500, 64))]).astype(np.float32)
    x = vectors.matrix(made)
    want = ((x @ x.T) >= 0.93).sum(axis=1) - 1
    assert want[:700].min() > 600
    frame = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(made)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame, shard_rows=100).collect()}
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_links_across_shards(spark):
    """Rows that share no shard are linked by walking united lists."""
    from tidemark.llm.common import Scratch

    rng = np.random.default_rng(6)
    made = [[float(v) for v in rng.normal(size=8)] for _ in range(4)]
    made[3] = [a + 0.01 for a in made[0]]
    made[1] = [a - 0.01 for a in made[0]]
    nodes = spark.createDataFrame([(0, made[0], [1], [10], 1), (1, made[1], [0, 3, 2], [10, 20], 1), (3, made[3], [1], [20], 1), (2, made[2], [1], [20], 1)], "key long, vector array<double>, near array<long>, grps array<long>, weight long")
    links = spark.createDataFrame([(0, 1, 0, [1]), (1, 1, 0, []), (3, 1, 1, [1]), (2, 0, 2, [])], "key long, links long, root long, ways array<long>")
    assert [tuple(r) for r in vectors.across(links, nodes, 0.93, Scratch(spark)).collect()] == [(0, 3)]


def test_one_vec_id_with_two_vectors(spark):
    rng = np.random.default_rng(7)
    a, b = ([float(v) for v in rng.normal(size=8)] for _ in range(2))
    rows_ = [(5, a, 0), (5, b, 0), (5, b, 0), (3, [2 * v for v in b], 0), (9, [v + 0.001 for v in a], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(3, 2, 3, True), (5, 1, 5, True), (5, 2, 3, False), (5, 2, 3, False), (9, 1, 5, False)]


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_robust_lists_keep_the_nearest():
    x = vectors.matrix(np.random.default_rng(0).normal(size=(50, 8)))
    s = x @ x.T
    np.fill_diagonal(s, -1)
    lists = vectors.robust_lists(x)
    assert (lists[:, 0] == s.argmax(axis=1)).all()
