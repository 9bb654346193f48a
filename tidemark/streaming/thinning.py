"""Streaming forms of the batch operators: greedy thinning by state, tumbling counts, an idempotent sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of events as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def hourly_counts(stream: DataFrame, ts: str, cls: str, late: str = "2 hours") -> DataFrame:
    """Counts per hour and class; hours close once the watermark has passed them."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), cls).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), cls, "n")


def settle(times: list[float], last: float | None, gap: float) -> tuple[list[str], float | None]:
    """The fate of times in their order, and the last one kept."""
    fates = []
    for x in times:
        keep = last is None or x - last >= gap
        last = x if keep else last
        fates.append("kept" if keep else "thinned")
    return fates, last


def thinned_stream(stream: DataFrame, key: str, t: str, gap: float, delay: float = 0.0, forget_ms: int = 0) -> DataFrame:
    """All rows of a stream as key, t and fate: ``kept`` if ``gap`` or more behind the last one kept of their key,
    else ``thinned``, or ``late`` if they came after later ones were settled.

    Times wait until one of their key comes that lies ``delay`` behind them; then they are settled in order. So rows may
    come out of order by ``delay``, those of one micro-batch by any amount, and every row is accounted for once.
    ``forget_ms`` after a key's last row (0: never) a timer settles what waits and drops the state. State then holds
    the times of the last ``delay``, of the keys of the last ``forget_ms``. Timers keep a stream running, so one that is
    to end when all is read (``write_answers(once=True)``) has none.
    """
    kinds = dict(stream.dtypes)

    def step(k, batches, state):
        import pandas as pd

        def rows(times, fates):
            return pd.DataFrame({key: [k[0]] * len(times), t: times, "fate": fates})

        last, settled, waiting = state.get if state.exists else (None, None, [])
        if state.hasTimedOut:
            fates, _ = settle(sorted(waiting), last, gap)
            state.remove()
            yield rows(sorted(waiting), fates)
            return
        new = [float(x) for pdf in batches for x in pdf[t]]
        late = [x for x in new if settled is not None and x < settled]
        times = sorted([*waiting, *(x for x in new if settled is None or x >= settled)])
        until = max(times[-1] - delay if times else settled, settled if settled is not None else float("-inf"))
        ready = [x for x in times if x <= until]
        fates, last = settle(ready, last, gap)
        state.update((last, until, times[len(ready) :]))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield rows(late + ready, ["late"] * len(late) + fates)

    source = stream.select(key, F.col(t).cast("double").alias(t)).where(F.col(t).isNotNull())
    state = "last double, settled double, waiting array<double>"
    return source.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {t} double, fate string", state, "append", "ProcessingTimeTimeout" if forget_ms else "NoTimeout")


def write_answers(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Each micro-batch to a folder of its own number, so that a repeated batch replaces itself.

    ``once`` ends the stream when what is there has been read.
    """

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
