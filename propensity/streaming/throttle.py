"""Per-key sliding-window request throttle (batch and Structured Streaming).

Rule, per key in time order: forget remembered admission times <= t - window; if
``max_requests`` are still remembered the request is limited (and not
remembered), otherwise it is admitted and remembered.

Admission depends on earlier admissions, so a saturated stretch of a key is a
sequential scan that no window aggregate expresses.  The batch form cuts keys at
their calm stretches: time is divided into cells of one window, and a cell that
holds at most ``max_requests`` rows together with the cell before admits them all,
whatever came earlier.  Calm cells are settled by counts alone.  Runs of the other
cells, with the calm cell in front of each, are scanned as segments of their own:
dealt by (key, segment), sorted inside partitions and read by ``mapInPandas`` while
carrying at most ``max_requests`` timestamps; neither a key nor a segment is
collected into one in-memory group.  The streaming form keeps the same bounded list
in ``applyInPandasWithState`` state between micro-batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from propensity.constants import THROTTLE_MAX_REQUESTS, THROTTLE_WINDOW_SECONDS


def _make_scan():
    """The sequential scan, built as a closure so Python workers receive it by
    value (no import of this package is needed on executors)."""
    from collections import deque as _deque

    import numpy as _np

    def scan(keys, micros, state: dict, max_requests: int, window_us: int):
        """Limited flags for rows sorted by (key, time); ``state`` carries the current
        key and its remembered admission times across calls."""
        out = _np.zeros(len(keys), dtype=bool)
        cur, kept = state.get("key"), state.get("kept")
        for i in range(len(keys)):
            if kept is None or keys[i] != cur:
                cur, kept = keys[i], _deque()
            t = int(micros[i])
            while kept and kept[0] <= t - window_us:
                kept.popleft()
            if len(kept) >= max_requests:
                out[i] = True
            else:
                kept.append(t)
        state["key"], state["kept"] = cur, kept
        return out

    return scan


def saturated_cells(timed: DataFrame, key: str, max_requests: int) -> DataFrame:
    """``(_key, _at, _segment)``: the cells to scan, from rows with ``_cell``.

    Every cell learns the counts of its two neighbours from one more aggregate; the
    segments are then numbered by a window over the cells that are left, a few for
    every ``max_requests`` rows of a key."""
    n = F.col("_n")
    counts = timed.where("_cell is not null").groupBy(F.col(key).alias("_key"), "_cell").agg(F.count("*").alias("_n"))
    near = counts.select("_key", F.inline(F.array(*[
        F.struct((F.col("_cell") - shift).alias("_at"), *[(n if k == shift else F.lit(0).cast("long")).alias(c)
                                                          for k, c in ((-1, "_before"), (0, "_own"), (1, "_after"))])
        for shift in (-1, 0, 1)])))
    cells = near.groupBy("_key", "_at").agg(*[F.sum(c).alias(c) for c in ("_before", "_own", "_after")]).where("_own > 0")
    full = F.col("_own") + F.col("_before") > max_requests
    leads = (F.col("_after") > 0) & (F.col("_own") + F.col("_after") > max_requests)  # the calm cell in front
    opens = ~full | (F.col("_before") == 0)
    run = Window.partitionBy("_key").orderBy("_at")
    return cells.where(full | leads).select(
        "_key", "_at", F.last(F.when(opens, F.col("_at")), ignorenulls=True).over(run).alias("_segment"))


def throttle(df: DataFrame, key: str, ts: str, max_requests: int = THROTTLE_MAX_REQUESTS,
             window_seconds: float = THROTTLE_WINDOW_SECONDS, tie: str | None = None) -> DataFrame:
    """Adds ``limited`` (boolean) to every request row.  NULL keys are one key; rows
    without a time are not limited and count for nothing."""
    window_us = int(round(window_seconds * 1_000_000))
    t = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        # wall-clock arithmetic: independent of the session time zone (no DST shifts)
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)
    else:
        micros = F.unix_micros(t.cast("timestamp"))
    timed = df.withColumn("_us", micros).withColumn("_cell", F.expr(f"(_us - pmod(_us, {window_us}L)) div {window_us}L"))
    cells = saturated_cells(timed, key, max_requests)
    same = timed[key].eqNullSafe(cells["_key"]) & (timed["_cell"] == cells["_at"])
    calm = timed.join(cells, same, "left_anti").select(*df.columns, F.lit(False).alias("limited"))
    order = [key, "_segment", "_us"] + ([tie] if tie else [])
    rows = timed.join(cells, same).select(*df.columns, "_us", "_segment")
    prepared = rows.repartition(key, "_segment").sortWithinPartitions(*order)
    schema = T.StructType(prepared.schema.fields + [T.StructField("limited", T.BooleanType(), False)])

    scan = _make_scan()

    def run(batches):
        state: dict = {}
        for pdf in batches:
            keys = pdf[key].astype(object).where(pdf[key].notna(), None)
            flags = scan(list(zip(keys, pdf["_segment"])), pdf["_us"].to_numpy(), state, max_requests, window_us)
            yield pdf.assign(limited=flags)

    return calm.unionByName(prepared.mapInPandas(run, schema).drop("_us", "_segment"))


def throttle_stream(stream: DataFrame, key: str, ts: str, max_requests: int = THROTTLE_MAX_REQUESTS,
                    window_seconds: float = THROTTLE_WINDOW_SECONDS, max_delay: str | None = None) -> DataFrame:
    """Streaming form: per key, the remembered admission times (at most
    ``max_requests``) live in the group state between micro-batches.

    With ``max_delay`` (such as "10 minutes") the stream gets a watermark of that delay: a
    key's state goes once the watermark is a window past its last admission, when it would be
    empty anyway, and rows that come later than the delay are dropped by the watermark.  Without
    it no row is dropped, and every key ever seen keeps its list."""
    window_us = int(round(window_seconds * 1_000_000))
    key_type = stream.schema[key].dataType.simpleString()
    out_schema = f"{key} {key_type}, {ts} timestamp, limited boolean"
    state_schema = "kept array<bigint>"

    scan = _make_scan()

    def fn(k, pdfs, state):
        import pandas as pd
        from collections import deque
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0]) if state.exists else deque()
        parts = []
        for pdf in pdfs:
            parts.append(pdf)
        if not parts:
            return
        pdf = pd.concat(parts).sort_values(ts, kind="stable")
        micros = (pdf[ts].astype("datetime64[us]").astype("int64")).to_numpy()
        st = {"key": k[0], "kept": kept}
        flags = scan(np.full(len(pdf), k[0], dtype=object), micros, st, max_requests, window_us)
        state.update((list(st["kept"]),))
        if max_delay and st["kept"]:
            state.setTimeoutTimestamp(max((st["kept"][-1] + window_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: pdf[key].to_numpy(), ts: pdf[ts].to_numpy(), "limited": flags})

    timeout = GroupStateTimeout.EventTimeTimeout if max_delay else GroupStateTimeout.NoTimeout
    if max_delay:
        stream = stream.withWatermark(ts, max_delay)
    return stream.groupBy(key).applyInPandasWithState(fn, out_schema, state_schema, "append", timeout)
