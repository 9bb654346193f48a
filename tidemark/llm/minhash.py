"""Operator 10, near-duplicate documents by min-max hashing.

1. Shingles: A-Z lower-cased, words between ASCII white space, distinct ``shingle`` -word shingles as
   64-bit hashes (a shorter text is one shingle; a text without words has none and links with nothing).
2. Documents with equal shingle sets form a class (128-bit digest of the set), which goes on alone, so
   copies cost one row each, however many there are.
3. Min-max signature: each of ``permutations`` hash permutations gives its minimum and its maximum, so
   256 values take 128 hash evaluations. A band holds ``band_rows`` of them; at a similarity of 0.8 a pair
   misses all 42 bands of 6 with a chance of 3e-6. Minimum and maximum of a small set depend on each other,
   so sets of at most ``SMALL`` shingles also meet by their own digest and those without one shingle, which
   finds every pair of them that differs by one. One bit of each value goes along, so that candidates whose
   bits agree too rarely need no full sets (at 0.8 a chance below 4e-6 to go wrong).
4. Stars: in the buckets of some bands, then of all, every component sends one member to hubs, members of
   the bucket's largest component: one is drawn, others are those that meet most nodes in all their buckets, the
   middle of a family, as what lies at its edge links with the middle alone. Of several hubs of one kind and
   component one is kept, and no more than ``STARS`` per member and kind. Links are confirmed on full sets and
   components joined. A group of m near copies costs a few pairs per member.
5. Rest: what still shares a bucket with another component is compared without all pairs of the bucket. Two
   sets of similarity 0.8 share one of the first n - ceil(0.8 n) + 1 of their shingles in any common order;
   the order is by the number of documents that hold a shingle, rarest first. So members outside their
   bucket's largest component are joined with all others on such rare shingles, at places that leave enough
   shingles behind for sets of the two sizes, and pairs of one bucket and two components are confirmed on full
   sets. The places are bounded before the join, by classes of sizes. This loses no candidate, and shingles that
   a whole group shares come last in the order.
6. Components of the confirmed links and of the classes.

Nulls and the like: a null or blank text has n_shingles 0 and is its own component; a null doc_id is
ignored as a link end and is its own component; rows that repeat a doc_id get one row each, by their own
texts; ties go to the smaller id; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import BROADCAST_ROWS, Scratch, fresh_path, join_small, tidy
from tidemark.llm.components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]

#: Sets of at most so many shingles meet by exact digests too; up to a union of nine shingles, a similarity
#: of 0.8 leaves room for one shingle of difference.
SMALL = 9
#: Pairs that a member of a bucket sends to hubs of one kind in one round.
STARS = 4
#: Classes of members, by hash, each of which has its own middle of a bucket.
MIDDLES = 3
#: Classes of sizes for the rest: each spans a factor of so much.
SIZE_RATIO = 1.1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    from xxhash import xxh64_intdigest

    out = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        w = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        k = min(size, len(w))
        if not k:
            out.append(w)
            continue
        h = np.full(len(w) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            h = _mixed(h * _MIX[0] + w[i : len(w) - k + 1 + i])
        out.append(np.unique(h))
    return out


def min_max_bands(sets: list[np.ndarray], permutations: int, band_rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets, bands) keys and (sets, words) bits, one bit of each signature value; all sets have members.
    A permutation is x -> a x + b modulo 2**64, a odd."""
    draw = np.random.default_rng(seed).integers(0, 2**64, size=(permutations, 2), dtype=np.uint64)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    values = np.empty((2 * permutations, len(sets)), dtype=np.uint64)
    for i, (a, b) in enumerate(draw):
        v = flat * (a | np.uint64(1)) + b
        values[2 * i], values[2 * i + 1] = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
    n_bands = 2 * permutations // band_rows
    keys = np.empty((len(sets), n_bands), dtype=np.uint64)
    for j in range(n_bands):
        k = np.full(len(sets), j + 1, dtype=np.uint64)
        for row in values[j * band_rows : (j + 1) * band_rows]:
            k = _mixed(k * _MIX[0] + row)
        keys[:, j] = k
    bits = np.packbits((_mixed(values) & np.uint64(1)).astype(np.uint8).T, axis=1)
    return keys, np.ascontiguousarray(bits).view(np.int64)


def small_keys(own: np.ndarray) -> np.ndarray:
    """Keys that small sets share if one has one shingle more, at least five in all."""
    h = _mixed(own ^ _MIX[0])
    return np.append(h.sum() - h[: len(h) if len(h) > 4 else 0], h.sum())


def _pieces(column: pa.Array, most: int = 4_000_000):
    """Slices of a text column of a few megabytes, as lists."""
    begin, held = 0, 0
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1])
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= most or i + 1 == len(sizes):
            yield begin, column.slice(begin, i + 1 - begin).to_pylist()
            begin, held = i + 1, 0


def signatures(docs: DataFrame, shingle: int, permutations: int, band_rows: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (digest of the set, null for an empty one), bands, bits."""

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for part in parts:
            for begin, texts in _pieces(part.column(1)):
                sets = shingle_sets(texts, shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                bits: list = [None] * len(sets)
                if full:
                    keys, marks = min_max_bands([sets[i] for i in full], permutations, band_rows, seed)
                    for i, row, mark in zip(full, keys.view(np.int64), marks):
                        more = small_keys(sets[i]).view(np.int64) if len(sets[i]) <= SMALL else row[:0]
                        bands[i], bits[i] = np.concatenate([row, more]), mark
                digest = [[signed(xxh64_intdigest(s.tobytes(), seed=k)) if len(s) else None for s in sets] for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(begin, len(texts)), pa.array(list(map(len, sets)), pa.int64()), *(pa.array(d, pa.int64()) for d in digest), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands", "bits"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, bits array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int, repeated: bool) -> DataFrame:
    """(node, shingles) of the sets that ``wanted`` (node, doc, d1, d2) names; ``repeated`` tells whether a
    doc_id may stand for several rows."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for part in parts:
            for begin, texts in _pieces(part.column(1)):
                sets = shingle_sets(texts, shingle)
                digest = [np.array([xxh64_intdigest(s.tobytes(), seed=k) for s in sets], dtype=np.uint64).view(np.int64) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(begin, len(texts)), *map(pa.array, digest), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc", "d1", "d2", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    ids = wanted.select("doc").distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)  # spares a shuffle of all texts
    out = rows.join(ids, "doc", "left_semi").mapInArrow(read, "doc long, d1 long, d2 long, shingles array<long>")
    if not repeated:  # a node is its document
        return out.select(F.col("doc").alias("node"), "shingles")
    out = out.dropDuplicates(["doc", "d1", "d2"]).join(wanted.select("node", "doc", "d1", "d2"), ["doc", "d1", "d2"])
    return out.select("node", "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _differ(x, y):
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, n: a + n)


def _close(na, nb, differ, percent: int, permutations: int):
    """Pairs that may reach the similarity J: the smaller set is at least that share of the larger, which is
    exact, and the signatures' bits agree often enough. Bits agree with a chance of (1 + J) / 2; the limit
    lies 4.5 deviations below, counted as if minimum and maximum went together. Small sets all pass."""
    p = (1 + percent / 100) / 2
    least = 2 * (permutations * p - 4.5 * (permutations * p * (1 - p)) ** 0.5)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((F.greatest(na, nb) <= SMALL) | (2 * permutations - differ >= least))


def class_nodes(sized: DataFrame, repeated: bool) -> DataFrame:
    """One row per distinct set: node, doc (its smallest doc_id), d1, d2, n, bands, bits. The node is doc, or
    a number beyond 2**62 where another set has the same doc."""
    own = sized.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits"))
    if not repeated:
        return own.select(F.col("doc").alias("node"), "*")
    first = own.groupBy("doc").agg(F.min(F.struct("d1", "d2")).alias("first"))
    high = F.shiftrightunsigned(F.xxhash64("d1", "d2"), 2).bitwiseOR(F.lit(1 << 62))
    return own.join(first, "doc").select(F.when(F.col("first") == F.struct("d1", "d2"), F.col("doc")).otherwise(high).alias("node"), "doc", "d1", "d2", "n", "bands", "bits")


def meeting(nodes: DataFrame) -> DataFrame:
    """The nodes that share a bucket with another one; of their bands, the buckets that are shared; ``weight``, the
    members of these, which is largest for the middle of a family."""
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    met = spread.join(shared, "bucket").groupBy("node").agg(F.collect_list("bucket").alias("bands"), F.sum("members").alias("weight"))
    return nodes.drop("bands").join(met, "node")


def star_pairs(now: DataFrame, turn: int, percent: int, permutations: int, of: int) -> DataFrame:
    """Pairs (a, b) of members and hubs of other components, in the buckets of every ``of``-th band.

    A bucket's hubs are a drawn member and the members of most weight in each of ``MIDDLES`` classes, all of its largest
    component, and the member of most weight of any component. What lies at the edge of a family links with its middle,
    but with few of the members that one draws.
    """
    pick = F.filter("bands", lambda b: F.pmod(F.xxhash64(b), F.lit(of)) == 0)
    part = now.select(F.explode(pick).alias("bucket"), "root", "node", "weight")
    of_class = lambda node, i: F.pmod(F.xxhash64(F.lit(turn), node), F.lit(MIDDLES)) == i
    middles = [F.max_by("node", F.when(of_class("node", i), F.struct("weight", "node"))).alias(f"m{i}") for i in range(MIDDLES)]
    reps = part.groupBy("bucket", "root").agg(F.count("*").alias("k"), F.max(F.struct("weight", "node")).alias("top"), F.min_by("node", F.xxhash64(F.lit(turn), "node")).alias("x"), *middles)
    to = F.array("x", *(f"m{i}" for i in range(MIDDLES)))
    hubs = reps.groupBy("bucket").agg(F.max(F.struct("k", "top", "root", to.alias("to"))).alias("hub"), F.max(F.struct("top", "root")).alias("middle"), F.count("*").alias("roots")).where("roots > 1")
    to = F.concat(F.transform("hub.to", lambda y: F.struct(F.col("hub.root").alias("other"), y.alias("y"))), F.array(F.struct(F.col("middle.root").alias("other"), F.col("middle.top.node").alias("y"))))
    pairs = reps.select("bucket", "root", "x").join(hubs.select("bucket", to.alias("to")), "bucket").select("root", "x", F.posexplode("to").alias("kind", "to"))
    pairs = pairs.where("to.other <> root and to.y is not null").select("root", "to.other", "x", "to.y", "kind").distinct()
    for k in "xy":
        pairs = pairs.join(now.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"b{k}"), F.col("weight").alias(f"w{k}")), k)
    pairs = pairs.withColumn("differ", _differ(F.col("bx"), F.col("by"))).where(_close(F.col("nx"), F.col("ny"), F.col("differ"), percent, permutations))
    heavy = F.when(F.col("kind") > 0, -F.col("wy")).otherwise(0)
    best = pairs.groupBy("root", "other", "kind").agg(F.min(F.struct(heavy.alias("heavy"), "differ", "x", "y")).alias("p")).select("kind", "p.*")
    # a member has at most one pair per band and kind of hub
    best = best.groupBy("x", "kind").agg(F.slice(F.sort_array(F.collect_list(F.struct("differ", "y"))), 1, STARS).alias("to"))
    return best.select("x", F.explode("to").alias("to")).select(F.least("x", "to.y").alias("a"), F.greatest("x", "to.y").alias("b")).distinct()


def mixed_members(now: DataFrame) -> DataFrame:
    """The members of buckets with several components, with ``minor``: outside the largest component of one."""
    part = now.select(F.explode("bands").alias("bucket"), "node", "root")
    per = part.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    mixed = per.groupBy("bucket").agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count("*").alias("roots")).where("roots > 1")
    minor = part.join(mixed.select("bucket", "major"), "bucket").groupBy("node").agg(F.max(F.col("root") != F.col("major")).alias("minor"))
    return now.join(minor, "node")


def rest_heads(own: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Where nodes may meet: token, class, other (class of the partner's size), at, node, root, n, minor.

    A node's shingles are put in order, the rarest first. Sets of sizes n and m link only with ``need`` common ones, so
    the first of these lies at a place that leaves ``need`` behind it. As m is not known yet, sizes are put in
    classes, and m is taken to be the least size in the partner's class that holds the very shingle: what is too far
    behind for that never leaves its node. Documents of a family that shares all but their own, rarer shingles,
    just below the threshold, thus meet nowhere.
    """
    tokens = sets.join(own.select("node"), "node", "left_semi").select("node", F.explode("shingles").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(held, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    first = F.size("t") - F.ceil(F.size("t") * F.lit(percent) / 100).cast("int") + 1
    heads = ranked.select("node", F.posexplode(F.slice("t", F.lit(1), first)).alias("at", "t")).where("t.df > 1")
    heads = heads.join(own.select("node", "root", "n", "minor"), "node")
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.lit(math.log(SIZE_RATIO))).cast("int")
    low, high = F.ceil(F.col("n") * F.lit(percent) / 100), F.floor(F.col("n") * F.lit(100) / F.lit(percent))
    heads = heads.select(F.col("t.token").alias("token"), size_class(F.col("n")).alias("class"), "at", "node", "root", "n", "minor")
    least = heads.groupBy("token", F.col("class").alias("other")).agg(F.min("n").alias("least"))
    heads = heads.withColumn("other", F.explode(F.sequence(size_class(low), size_class(high)))).join(least, ["token", "other"])
    return heads.where(F.col("at") <= F.col("n") - _need(F.col("n"), F.greatest("least", low), percent)).drop("least")


def _need(n, m, percent: int):
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent))


def met_at(heads: DataFrame) -> DataFrame:
    """All meetings of a minor x with a node y at a shingle, of sizes in each other's class."""
    x, y = (heads.select("token", F.col("class").alias(a), F.col("other").alias(b), F.col("at").alias(f"i{k}"), F.col("node").alias(k), F.col("root").alias(f"r{k}"), F.col("n").alias(f"n{k}"), F.col("minor").alias(f"m{k}")) for k, a, b in (("x", "cx", "cy"), ("y", "cy", "cx")))
    return x.where("mx").join(y, ["token", "cx", "cy"])


def rest_pairs(own: DataFrame, heads: DataFrame, percent: int, permutations: int) -> DataFrame:
    """Pairs (a, b) of two components that share a bucket and a rare shingle; one of them is a minor."""
    # a pair of minors meets once, from the larger node
    pairs = met_at(heads).where("rx <> ry and (not my or x > y)").where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    # sets of these sizes need so many common shingles; the first of them has as many more behind it
    need = _need(F.col("nx"), F.col("ny"), percent)
    pairs = pairs.where((F.col("ix") <= F.col("nx") - need) & (F.col("iy") <= F.col("ny") - need))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    for k in "ab":
        pairs = pairs.join(own.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"b{k}"), F.col("bands").alias(f"w{k}")), k)
    near = _close(F.col("na"), F.col("nb"), _differ(F.col("ba"), F.col("bb")), percent, permutations)
    return pairs.where(near & F.arrays_overlap("wa", "wb")).select("a", "b")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, permutations: int = 128, band_rows: int = 6, star_bands: tuple[int, ...] = (10, 1), seed: int = 11
) -> DataFrame:
    """Returns doc_id, n_shingles, component_id, kept, class_id (the smallest id with the same set), and d1, d2
    (digest of the set) and lead (the set stands for its component).

    ``star_bands``: the rounds of stars use the buckets of every so-manieth band.
    """
    spark = docs.sparkSession
    staged = Scratch(spark)
    signed = staged(signatures(docs, shingle, permutations, band_rows, seed), "minhash-signed")
    sized = signed.where("d1 is not null and doc_id is not null")
    repeated = bool(sized.groupBy("doc_id").count().where("count > 1").limit(1).count())
    nodes = staged(class_nodes(sized, repeated), "minhash-nodes")
    held = staged(meeting(nodes), "minhash-meeting")
    sets = staged(full_sets(docs, held.select("node", "doc", "d1", "d2"), shingle, repeated), "minhash-sets")

    tested, turn = None, 0
    now = held.withColumn("root", F.col("node"))

    def settle(pairs: DataFrame) -> None:
        """Tests the pairs that were not tested before, and joins components. Links of earlier turns are in the roots
        already, so new ones are taken between roots, and a turn without any runs no rounds."""
        nonlocal tested, now
        first = tested is None  # every node is its own root
        pairs = staged(pairs if first else pairs.join(tested, ["a", "b"], "left_anti"), f"minhash-pairs{turn}")
        tested = pairs if first else tested.unionByName(pairs)
        links = confirmed(pairs, sets, percent)
        if not first:
            for k in "ab":
                links = links.join(now.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")), k)
            links = links.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        links = staged(links, f"minhash-links{turn}")
        tidy(spark)
        if not links.limit(1).count():
            return
        roots = components(links, staged).select(F.col("node").alias("root"), F.col("root").alias("__to"))
        joined = now.join(roots, "root", "left") if first else join_small(now, roots, ["root"], "left")
        now = staged(joined.withColumn("root", F.coalesce("__to", "root")).drop("__to"), f"minhash-now{turn}")
        tidy(spark)

    for turn, of in enumerate(star_bands):
        settle(star_pairs(now, turn, percent, permutations, of))
    own = staged(mixed_members(now), "minhash-members")
    if own.limit(1).count():
        turn += 1
        heads = staged(rest_heads(own, sets, percent), "minhash-heads")  # joined with itself: read twice, not planned twice
        settle(rest_pairs(own, heads, percent, permutations))

    # a component bears the smallest doc_id of its classes; the least (doc, digest) stands for it
    roots = now.select("root", "node").where("root <> node")
    joined = roots.unionByName(roots.select("root", F.col("root").alias("node")).distinct()).join(nodes.select("node", "doc", "d1", "d2"), "node")
    heads = joined.groupBy("root").agg(F.min(F.struct("doc", "d1", "d2")).alias("head"))
    joined = joined.join(heads, "root").select(F.col("d1").alias("j1"), F.col("d2").alias("j2"), "head")
    classes = nodes.select("d1", "d2", F.col("doc").alias("class_id")).join(joined, F.expr("d1 = j1 and d2 = j2"), "left")
    classes = classes.select("d1", "d2", "class_id", F.coalesce("head.doc", "class_id").alias("root"), F.coalesce(F.col("head.d1") == F.col("d1"), F.lit(True)).alias("lead"))
    # a class of a thousandth of all rows is one of a thousand at most: those go to every task
    rows = signed.select("doc_id", "n_shingles", "d1", "d2")
    hot = sized.groupBy("d1", "d2").count().where(F.col("count") * 1000 >= max(signed.count(), 1)).select("d1", "d2")
    hot = staged(hot.join(classes, ["d1", "d2"]), "minhash-hot")
    tidy(spark)
    some = bool(hot.limit(1).count())
    same = ["d1", "d2"]
    cold = rows.join(F.broadcast(hot.select(*same)), same, "left_anti") if some else rows
    out = cold.join(classes, same, "left")
    if some:
        out = out.unionByName(rows.join(F.broadcast(hot), same))
    out = out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), "d1", "d2", F.coalesce("lead", F.lit(True)).alias("lead"))
    path = fresh_path(spark, "minhash-found")
    out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).write.parquet(path)
    staged.clear()
    return spark.read.parquet(path).select("doc_id", "n_shingles", "component_id", "kept", "class_id", "d1", "d2", "lead")


def deduplicated(docs: DataFrame, shingle: int = 5, **options) -> DataFrame:
    """The documents whose set stands for its component, with all their columns: the smallest doc_id, and of
    its rows the least text of the least set.

    Of rows that repeat a doc_id each is judged by its own text, so one that links with nothing stays.
    Documents without words, and those without an id, link with nothing and stay.
    """
    found = near_duplicates(docs, shingle=shingle, **options)
    known = found.where("doc_id is not null")
    again = known.groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("n")).where("n > 1").select("__again")
    gone = known.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    key = docs["doc_id"].cast("long")
    out = docs.join(F.broadcast(gone) if small else gone, key == F.col("__gone"), "left_anti")
    if not again.limit(1).count():
        return out
    # rows of repeated ids: by the digests of their own texts
    rows = docs.join(again, key == F.col("__again"), "left_semi")
    marked = with_digests(rows, shingle)
    lead = known.where("kept and lead and d1 is not null").join(again, F.col("doc_id") == F.col("__again"), "left_semi").select(F.col("doc_id").alias("__id"), F.col("d1").alias("__l1"), F.col("d2").alias("__l2")).distinct()
    same = (marked["doc_id"].cast("long") == F.col("__id")) & (F.col("__d1") == F.col("__l1")) & (F.col("__d2") == F.col("__l2"))
    firsts = marked.join(lead, same, "left_semi").groupBy("doc_id", "__d1", "__d2").agg(F.min_by(F.struct(*[f"`{c}`" for c in docs.columns]), F.col("text")).alias("__row")).select("__row.*")
    wordless = marked.where("__d1 is null").select(*[f"`{c}`" for c in docs.columns])
    return out.join(again, key == F.col("__again"), "left_anti").unionByName(firsts).unionByName(wordless)


def with_digests(rows: DataFrame, shingle: int) -> DataFrame:
    """The rows with __d1 and __d2, the digest of their texts' sets, null without words."""
    at = rows.columns.index("text")

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for part in parts:
            for begin, texts in _pieces(part.column(at)):
                sets = shingle_sets(texts, shingle)
                more = [pa.array([signed(xxh64_intdigest(s.tobytes(), seed=k)) if len(s) else None for s in sets], pa.int64()) for k in (1, 2)]
                own = part.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns, *more], names=[*own.schema.names, "__d1", "__d2"])

    return rows.mapInArrow(mark, StructType([*rows.schema.fields, StructField("__d1", LongType()), StructField("__d2", LongType())]))
