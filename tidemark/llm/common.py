"""What the training-data operators share: staged tables, checked broadcasts, apportionment, spans."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contracts: runs of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most so many rows may be broadcast: 200,000 slim rows are about 20 MB.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the cluster names none, as in local tests, a folder of this machine is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


class _Made(threading.local):
    """Paths made by ``fresh_path`` that ``sweep`` may still remove, oldest first; each thread has its own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_MADE = _Made()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.paths.append(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes the paths; nothing may read them afterwards."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def sweep(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Deletes what this thread's ``fresh_path`` made after the first ``since`` paths (``len(made())`` at some time), but for ``keep``."""
    old = [p for p in _MADE.paths[since:] if p not in keep]
    _MADE.paths[since:] = [p for p in _MADE.paths[since:] if p in keep]
    remove(spark, old)


def made() -> list[str]:
    return list(_MADE.paths)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later reads survive a lost executor."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one operator run, which ``clear`` removes once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Nothing may read the tables afterwards."""
        remove(self.spark, self.paths)
        gone = set(self.paths)
        _MADE.paths[:] = [p for p in _MADE.paths if p not in gone]
        self.paths = []


def tidy(spark: SparkSession) -> None:
    """Shuffle files and broadcasts that nothing refers to go once the driver collects its garbage, which a large heap
    puts off: for rounds of many plans it is collected between them."""
    spark._jvm.System.gc()


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """Joins ``df`` with a table that has one row per key, null keys matching null keys.

    The table is counted. Up to ``BROADCAST_ROWS`` rows it is broadcast; beyond that its rows are
    repeated ``salts`` times, so that a hot key of ``df`` spreads over as many tasks.
    """
    names = [c for c in small.columns if c not in on]
    right = small.select(*[F.col(c).alias(f"__k_{c}") for c in on], *names)
    same = [df[c].eqNullSafe(F.col(f"__k_{c}")) for c in on]
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = df.join(F.broadcast(right), same, how)
    else:
        left = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        right = right.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        same = [left[c].eqNullSafe(F.col(f"__k_{c}")) for c in on]
        out = left.join(right, [*same, left["__salt"] == F.col("__at")], how).drop("__salt", "__at")
    return out.drop(*[f"__k_{c}" for c in on])


def seats(sizes: Column, caps: Column, total: Column, rounds: int = 80) -> Column:
    """Sainte-Laguë apportionment of ``total`` seats: array<long> in the order of ``sizes``.

    A party of size n that has q seats bids n / (q + 1/2); the highest bids win, none beyond its cap.
    The winning bid is found by bisection, as all bids above it are served together; seats that
    remain belong to equal bids and go to the parties in order. A total above the sum of the caps
    fills every cap. ``sizes`` is array<double>, ``caps`` array<long>.
    """
    pairs = F.transform(sizes, lambda n, i: F.struct(n.alias("n"), F.get(caps, i).alias("cap")))

    def held(n: Column, cap: Column, bid: Column) -> Column:
        return F.least(cap.cast("double"), F.floor(n / bid + 0.5).cast("double"))

    def summed(bid: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda a, p: a + held(p["n"], p["cap"], bid))

    top = F.greatest(F.coalesce(F.array_max(sizes), F.lit(0.0)) * 2.0 + 1.0, F.lit(1.0))
    low = F.lit(1e-9)
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        F.struct(low.alias("low"), top.alias("high")),
        lambda s, _: F.aggregate(  # one step: the middle bid is bound to a name by a one-element fold
            F.array(F.sqrt(s["low"] * s["high"])),
            s,
            lambda t, mid: F.when(summed(mid) > total, F.struct(mid.alias("low"), t["high"].alias("high"))).otherwise(F.struct(t["low"].alias("low"), mid.alias("high"))),
        ),
    )["high"]
    first = F.transform(F.array(found), lambda bid: F.transform(pairs, lambda p: F.struct(p["n"].alias("n"), p["cap"].alias("cap"), held(p["n"], p["cap"], bid).cast("long").alias("q"))))[0]

    def fill(rows: Column) -> Column:
        left = F.greatest(total.cast("long") - F.aggregate(rows, F.lit(0).cast("long"), lambda a, r: a + r["q"]), F.lit(0).cast("long"))
        bids = F.transform(rows, lambda r, i: F.struct(F.when(r["q"] < r["cap"], -r["n"] / (r["q"] + 0.5)).otherwise(F.lit(1e300)).alias("bid"), i.alias("i")))
        ranked = F.transform(F.slice(F.array_sort(F.filter(bids, lambda b: b["bid"] < 0)), F.lit(1), left.cast("int")), lambda b: b["i"])
        return F.transform(rows, lambda r, i: r["q"] + F.array_contains(ranked, i).cast("long"))

    return F.transform(F.array(first), fill)[0]
