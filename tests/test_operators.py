"""Small literal cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions import text as X
from tidemark.functions import times as M
from tidemark.operators import intervals as I
from tidemark.operators import sampling as S
from tidemark.operators import serving as V
from tidemark.operators import splits as D
from tidemark.operators import timeline as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


@pytest.mark.parametrize(
    ("lo", "hi", "n", "grid", "anchors", "want"),
    [(0, 10, 3, 1, None, [0, 5, 10]), (0, 10, 3, 1, [4], [0, 4, 10]), (0, 10, 3, 1, [4, 6], [0, 6, 10]), (0, 12, 3, 5, None, [0, 5, 10]), (7, 7, 5, 1, None, [7])],
)
def test_uniform(spark, lo, hi, n, grid, anchors, want):
    got = value(spark, S.uniform(F.lit(lo), F.lit(hi), F.lit(n), F.lit(grid), arr(*anchors) if anchors else None))
    assert got == want


def test_spread_and_take(spark):
    got = value(spark, S.spread(arr(0, 5, 10, 15, 20), arr(0, 0, 1, 1, 0), F.lit(0), F.lit(20), F.lit(4), 0.5, F.lit(5)))
    assert got == [0, 10, 15, 20]
    assert value(spark, S.take(arr(3, 3, 18), F.lit(0), F.lit(20), F.lit(4), F.lit(5))) == [0, 5, 15, 20]
    assert value(spark, S.take(arr().cast("array<double>"), F.lit(0), F.lit(20), F.lit(4), F.lit(5))) is None


def test_unmasked_moves_to_free_points(spark):
    masked = F.array(F.struct(F.lit(4.0).alias("a"), F.lit(6.0).alias("b")))
    assert value(spark, S.unmasked(arr(0, 5, 10), F.lit(0), F.lit(10), F.lit(1), masked)) == [0, 3, 10]


def test_erosion_and_runs(spark):
    mask = spark.createDataFrame([(1, i, m) for i, m in enumerate([0, 1, 1, 1, 1, 0, 1])], "k int, t int, m int")
    assert [r.t for r in T.eroded(mask, ["k"], "t", "m", 3).orderBy("t").collect()] == [2, 3]
    runs = T.runs(T.eroded(mask, ["k"], "t", "m", 3), ["k"], "t").collect()
    assert [(r.start, r.end, r.n) for r in runs] == [(2, 4, 2)]
    assert [r.t for r in T.eroded(mask, ["k"], "t", "m", 4).collect()] == [3]


def test_change_points_floor(spark):
    rows = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 5)], "k int, t int, v int")
    levels = T.change_points(rows, ["k"], "t", "v", 3).where("t = 1").collect()
    assert [r.level for r in levels] == [2]


def test_greedy_thinning(spark):
    rows = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 2.5, 3.2, 9.0)], "k int, t double")
    assert sorted(r.t for r in T.thinned(rows, ["k"], "t", 2).collect()) == [0.0, 2.5, 9.0]


def test_interval_joins(spark):
    points = spark.createDataFrame([(1, 5.5), (1, 5.6)], "k int, t double")
    iv = spark.createDataFrame([(1, 2.0, 5.0)], "k int, start double, end double")
    assert [r.t for r in I.in_intervals(points, iv, ["k"], "t", "start", "end", 0.5, 10.0).collect()] == [5.5]
    windows = spark.createDataFrame([(1, 4.0, 9.0)], "k int, lo double, hi double")
    two = spark.createDataFrame([(1, 2.0, 5.0), (1, 0.0, 4.0)], "k int, start double, end double")
    assert [(r.clip_start, r.clip_end) for r in I.clipped(two, windows, ["k"], 3.0).collect()] == [(4.0, 5.0)]
    want = spark.createDataFrame([(1, 100)], "k int, t int")
    have = spark.createDataFrame([(1, 90), (1, 101)], "k int, t int")
    assert I.lowest_within(want, have, ["k"], "t", 15, 15).first().hit == 90
    near = I.nearest(spark.createDataFrame([(1, 7.5)], "k int, t double"), spark.createDataFrame([(1, 5.0), (1, 10.0)], "k int, t double"), ["k"], "t")
    assert near.first().near == 5.0


@pytest.mark.parametrize(("s", "want"), [(3661.5, "01:01:02"), (2.5, "00:00:02"), (-3.0, "00:00:00")])
def test_clock(spark, s, want):
    assert value(spark, M.hhmmss(F.lit(s))) == want


def test_clock_parsing(spark):
    assert value(spark, M.strict_times(F.lit("00:00:10, 00:00:05"))) == [5, 10]
    assert value(spark, M.strict_times(F.lit("00:00:10."))) is None
    assert value(spark, M.strict_times(F.lit(""))) is None
    assert value(spark, M.centre(arr(1, 2, 3, 4), F.lit(1))) == [2]
    assert [round(value(spark, M.tolerance(F.lit(d))), 4) for d in (30, 360, 1000)] == [1.3333, 5, 5]


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("In %, how many? Please provide a number.", "percentage"), ("Please provide a single integer.", "open_ended"), ("Name it or answer with 'none'.", "open_ended"),
        ("Answer with yes or no and explain.", "open_ended"), ("Name it or answer with none.", "fo_class"), ("Please select one answer: a; b", "multiple_choice"),
        ("Use the format hh:mm:ss.", "time"), ("Please provide a number.", "number"), ("Please answer with yes or no.", "binary"), ("What happens?", "open_ended"),
    ],
)
def test_question_format(spark, q, want):
    assert value(spark, X.question_format(F.lit(q))) == want


def test_templates_and_entities(spark):
    assert value(spark, X.folded(F.lit("Is the Clip at 00:01:02 one of 3 Clips?"))) == "Is the <FO> at <TS> one of <N> <FO>?"
    names = ("Specimen Bag", "Specimen", "Needle")
    assert value(spark, X.entities(F.lit("the Specimen Bag"), names)) == ["specimen bag"]
    assert value(spark, X.entities(F.lit("Needle and Specimen Bag"), names)) == ["specimen bag", "needle"]
    assert value(spark, X.options(F.lit("Please select one answer: a; b."))) == ["a", "b"]


@pytest.mark.parametrize(
    ("form", "text", "want"),
    [("number", "about 3.", "3"), ("binary", "Yes, it", "yes"), ("percentage", "about 12.5%", "12.5"), ("fo_class", "Clip, Sponge.", "Clip, Sponge"), ("fo_class", "clip, none", "none"), ("fo_class", "Clip, Trocar cap.", "Clip, Trocar cap.")],
)
def test_normalised(spark, form, text, want):
    assert value(spark, X.normalised(F.lit(text), form)) == want


def test_normalised_unknown(spark):
    assert value(spark, X.normalised(F.lit("Clip, Trocar cap."), "fo_class", unknown=True)) == "Clip, Trocar cap"


@pytest.mark.parametrize(("b", "c", "p"), [(83, 53, 0.0126), (207, 143, 0.0007), (23, 18, 0.533), (0, 0, 1.0)])
def test_mcnemar(spark, b, c, p):
    assert value(spark, stats.mcnemar(F.lit(b), F.lit(c))) == pytest.approx(p, abs=6e-4 if p > 0.1 else 6e-5)


def test_mcnemar_does_not_underflow(spark):
    assert math.isclose(value(spark, stats.mcnemar(F.lit(1000), F.lit(1000))), 1.0)


@pytest.mark.parametrize(("a", "b", "want"), [("AAABBC", "AABBBC", 100), ("AAABBC", "AABABC", 60)])
def test_edit_score(spark, a, b, want):
    squeeze = lambda s: "".join(c for i, c in enumerate(s) if i == 0 or s[i - 1] != c)
    letters = lambda s: F.array(*map(F.lit, squeeze(s)))
    assert value(spark, stats.edit_score(letters(a), letters(b))) == pytest.approx(want)


@pytest.mark.parametrize(("votes", "want"), [("ABB", "B"), ("ABC", "A"), ("AB", "A"), ("", "")])
def test_majority(spark, votes, want):
    v = spark.createDataFrame([(1, a, i) for i, a in enumerate(votes)], "q int, answer string, member int")
    q = spark.createDataFrame([(1,)], "q int")
    assert V.majority(v, q, "q", "answer", "member").first().answer == want


def test_confidence_ties(spark):
    assert value(spark, V.challenger(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.5))) == "b"


def test_quadrant_boundary(spark):
    assert value(spark, X.quadrant(F.lit(50), F.lit(50), F.lit(100), F.lit(100))) == "bottom/right"


def test_stratified_folds_cover_every_unit(spark):
    vectors = spark.createDataFrame([(u, f"v{u % 3}", 1 + u % 5) for u in range(40)], "unit long, value string, n long")
    folds = D.stratified_greedy(vectors, 4, 3).collect()
    assert len(folds) == 40
    assert {r.fold for r in folds} == {0, 1, 2, 3}
    assert folds[0].score < 1


def test_prefixes_nest(spark):
    rows = spark.range(200).withColumnRenamed("id", "k").withColumn("g", F.lit(1))
    order = D.seeded_rank(rows, ["g"], "k", "s")
    small = {r.k for r in order.where("order < 20").collect()}
    assert small < {r.k for r in order.where("order < 60").collect()}


def test_rare_swaps_against_a_plain_version(spark):
    import random

    from tidemark.operators import lookups

    rng = random.Random(4)
    made = [(i, rng.randrange(4), i % 2, rng.randrange(1, 90) if i % 6 == 0 else 0, f"{rng.random():.9f}") for i in range(90)]
    got = {r.unit: r.new_fold for r in lookups.rare_swaps(spark.createDataFrame(made, "unit long, fold long, kind long, n long, draw string"), 4).collect()}
    fold, load = {u: f for u, f, *_ in made}, [0] * 4
    kind, plain = {m[0]: m[2] for m in made}, [m[0] for m in sorted(made, key=lambda m: m[4]) if not m[3]]
    target = {}
    for u, _, _, n, _ in sorted((m for m in made if m[3]), key=lambda m: (-m[3], m[0])):
        target[u] = min(range(4), key=lambda f: (load[f], f))
        load[target[u]] += n
    for u, f in target.items():
        if fold[u] != f:
            d = [x for x in plain if fold[x] == f and kind[x] == kind[u]][0]
            fold[u], fold[d] = f, fold[u]
    assert got == fold
    sizes = lambda of: sorted(list(of.values()).count(f) for f in range(4))
    assert sizes(got) == sizes({u: f for u, f, *_ in made})


def test_masked_times_move_to_the_nearest_free_point(spark, sf):
    from tidemark.plans import sampling as P

    rows = {r.o_orderkey: r for r in P._requests(spark, sf).where("n > 1").collect()}
    for r in P.smp_unmasked(spark, sf).collect():
        q = rows[r.o_orderkey]
        lo, hi, n, grid = q.lo, q.hi, q.n, q.grid
        masked = lambda t: lo + 9.5 <= t <= lo + 25.5 or lo + 39.5 <= t <= lo + 44.5  # noqa: E731, B023
        points = [(lo + hi) / 2] if hi <= lo else [lo + (hi - lo) * i / (n - 1) for i in range(n)]
        last = (hi - lo) // grid
        have = sorted({round(lo + min(max(round((x - lo) / grid), 0), last) * grid, 3) for x in points})
        assert r.before == len(have)
        free = [lo + k * grid for k in range(last + 1) if not masked(lo + k * grid)]
        for t in list(have):
            if masked(t):
                left = sorted((abs(c - t), c) for c in free if c not in have)
                have.remove(t)
                have += [left[0][1]] if left else []
        assert r.t == ",".join(str(round(x)) for x in sorted(have))


def test_stratified_folds_by_their_own_score(spark):
    """The score is the largest relative deviation of the folds given, and far below that of dealing by turns."""
    import random

    from tidemark.operators import splits

    rng = random.Random(2)
    made = [(u, v, rng.randrange(1, 20)) for u in range(60) for v in rng.sample("abcdefg", 3)]
    got = splits.stratified_greedy(spark.createDataFrame(made, "unit long, value string, n long"), 4, 6).collect()
    fold = {r.unit: r.fold for r in got}
    assert sorted(fold) == list(range(60))

    def deviation(of):
        out = 0.0
        for v in "abcdefg":
            have = [sum(n for u, x, n in made if x == v and of[u] == f) for f in range(4)]
            out = max(out, max(abs(h - sum(have) / 4) for h in have) / (sum(have) / 4))
        return out

    assert abs(got[0].score - deviation(fold)) < 1e-9
    assert deviation(fold) < 0.5 * deviation({u: u % 4 for u in range(60)})
