"""Rolling statistics of a generation log (seq, score): batch frames, and the same as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.ordered import framed, sliding, unused, with_ordinal

RECENT, HISTORY, WIDTH = 50, 5000, 60
BARS = " ▁▂▃▄▅▆▇█"
LOW, HIGH = -3.0, 4.0


def valid_rate(log: DataFrame, seq: str = "seq", score: str = "score", size: int = RECENT) -> DataFrame:
    """Per row: share of the last size rows with a score above 0 (rows without a score count as not above)."""
    (above,) = unused(log, "above")
    up = F.when(F.col(score) > 0, 1.0).otherwise(0.0)
    return framed(with_ordinal(log, seq).withColumn(above, up), "ordinal", size, {"valid_rate": lambda w: F.avg(above).over(w)}).drop(above)


def reward_stats(log: DataFrame, seq: str = "seq", score: str = "score", size: int = HISTORY) -> DataFrame:
    """Per row: min, max, mean of the last size scores, the count of all rows so far, and the scale lo, hi."""
    out = sliding(with_ordinal(log, seq), "ordinal", score, size, "min_score", "max_score", "mean_score")
    return out.withColumn("n_total", F.col("ordinal") + 1).withColumns(_scale())


def _scale() -> dict[str, Column]:
    return {"lo": F.least(F.col("min_score") - 0.5, F.lit(LOW)), "hi": F.greatest(F.col("max_score") + 0.5, F.lit(HIGH))}


def bar_level(value: Column, lo: Column, hi: Column) -> Column:
    """0 to 8; the scale's ends are cut off."""
    span = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    x = (value - lo) / span * 8
    return F.greatest(F.lit(0), F.least(F.lit(8), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int")))


def sparkline(log: DataFrame, seq: str = "seq", score: str = "score", size: int = HISTORY, width: int = WIDTH) -> DataFrame:
    """One row, line: the last width scores as bars, padded on the left, on the scale of the last size scores. Only these last rows are looked at."""
    last = log.orderBy(F.desc(seq)).limit(max(size, width)).select(F.col(seq).alias("seq"), F.col(score).alias("v"))
    own = last.agg(F.array_sort(F.collect_list(F.struct("seq", "v")))["v"].alias("x"))
    end = lambda n: F.slice("x", F.greatest(F.lit(1), F.size("x") - n + 1), F.lit(n))
    scaled = own.select(end(width).alias("x"), F.array_min(end(size)).alias("min_score"), F.array_max(end(size)).alias("max_score")).withColumns(_scale())
    bars = F.array(*[F.lit(b) for b in BARS])
    line = F.array_join(F.transform("x", lambda v: F.element_at(bars, F.coalesce(bar_level(v, F.col("lo"), F.col("hi")), F.lit(0)) + 1)), "")
    return scaled.select(F.lpad(line, width, "─").alias("line"))


def latest(log: DataFrame, seq: str = "seq") -> DataFrame:
    return log.agg(F.max_by(F.struct(*log.columns), seq).alias("r")).select("r.*")


def recent(log: DataFrame, seq: str = "seq", k: int = 10) -> DataFrame:
    return log.orderBy(F.desc(seq)).limit(k)


def plain_log(log: DataFrame, seq: str = "seq", score: str = "score", judge: str = "judge", every: int = 10, size: int = RECENT) -> DataFrame:
    """Per row the log's line of text: seq, line, step_line (each every-th step but 0, else null), reward_mean (of the last size rows, there).

    A mark tells scores above 1.5 and above 0 from the rest; a judge's score that is null or 0 is not shown. Numbers
    are rounded to two places, half up. A null score shows as nan.
    """
    two = lambda c: F.coalesce(F.round(c, 2).cast("decimal(12,2)").cast("string"), F.lit("nan"))
    s, j, k = F.col(score), F.col(judge), F.col(seq)
    mark = F.when(s > 1.5, "✓").when(s > 0, "~").otherwise("✗")
    shown = F.when(F.coalesce(j, F.lit(0.0)) != 0, F.concat(F.lit(" | judge="), two(j))).otherwise("")
    line = F.concat(F.lit("["), k.cast("string"), F.lit("] "), mark, F.lit(" verifier="), two(s), shown)
    out = framed(with_ordinal(log, seq), "ordinal", size, {"reward_mean": lambda w: F.avg(score).over(w)})
    due = (k % every == 0) & (k != 0)
    step = F.when(due, F.concat(F.lit("  Step "), k.cast("string"), F.lit(": reward_mean="), two(F.col("reward_mean"))))
    return out.select(k.alias("seq"), line.alias("line"), step.alias("step_line"), F.when(due, F.col("reward_mean")).alias("reward_mean"))


STATE = "recent array<double>, total long"
STREAM = "log string, seq long, score double, valid_rate double, min_score double, max_score double, n_total long"


def rolled(kept: list[float], scores: pd.Series, size: int) -> tuple[pd.DataFrame, list[float]]:
    """valid_rate, min_score, max_score of new scores that follow the kept ones, and what to keep. A step costs the same whatever the
    size: pandas' rolling minimum and maximum are monotone queues, and the rate is a running count."""
    every = pd.concat([pd.Series(kept, dtype="float64"), scores.astype("float64")], ignore_index=True)
    frame = every.rolling(size, min_periods=1)
    above = (every > 0).cumsum()
    n = pd.Series(range(1, len(every) + 1)).clip(upper=size)
    rate = (above - above.shift(size, fill_value=0)) / n
    out = pd.DataFrame({"valid_rate": rate, "min_score": frame.min(), "max_score": frame.max()}).iloc[len(kept) :].reset_index(drop=True)
    return out, every.iloc[-size:].tolist()


def stream_stats(log: DataFrame, size: int = RECENT) -> DataFrame:
    """Streaming (log, seq, score): each row with the statistics over the last size rows of its log, by arrival and, in a
    batch, by seq. The state holds size scores per log. A null score counts as a row, not above 0."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, total = state.get if state.exists else ([], 0)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable").reset_index(drop=True)
        out, kept = rolled([float("nan") if x is None else x for x in kept], rows["score"], size)
        state.update((kept, total + len(rows)))
        own = rows[["seq", "score"]].assign(log=key[0], n_total=range(total + 1, total + len(rows) + 1))
        yield pd.concat([own, out], axis=1)[[c.split()[0] for c in STREAM.split(", ")]]

    return log.groupBy("log").applyInPandasWithState(run, STREAM, STATE, "append", GroupStateTimeout.NoTimeout)
