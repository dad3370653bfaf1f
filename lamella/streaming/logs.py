"""Acquisition logs as they grow."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamella.sources.logs import BACK_SECONDS, STAMP, TRIAL

OUT = "dataset string, line_no long, trial long, type string, s long, gap_s double, late boolean"
STATE = "line long, day long, clock long, shot long"
_STAMP, _TRIAL, _EPOCH = re.compile(STAMP), re.compile(TRIAL), dt.date(1970, 1, 1)


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    line, day, clock, shot = state.get if state.exists else (-1, None, None, None)
    rows, out = pd.concat(list(batches)).sort_values("line_no"), []
    for no, value in zip(rows.line_no, rows.value, strict=True):
        late = no <= line
        line = max(line, no)
        m = _STAMP.match((value or "") + " ")
        if m is None:
            continue
        if late:
            out.append((key[0], no, None, None, None, None, True))
            continue
        now = int(m[2]) * 3600 + int(m[3]) * 60 + int(m[4])
        if m[1]:
            day = (dt.datetime.strptime(m[1], "%m/%d/%y").date() - _EPOCH).days
        elif day is not None and clock is not None and clock - now > BACK_SECONDS:
            day += 1
        clock = now
        t = _TRIAL.match(value)
        if day is None or t is None:
            continue
        s, gap = day * 86400 + now, None
        if t[2] == "Snapshot":
            gap, shot = None if shot is None else round(float(s - shot), 1), s
        out.append((key[0], no, int(t[1]), t[2], s, gap, False))
    state.update(tuple(None if x is None else int(x) for x in (line, day, clock, shot)))
    frame = pd.DataFrame(out, columns=["dataset", "line_no", "trial", "type", "s", "gap_s", "late"])
    yield frame.astype({"trial": "Int64", "s": "Int64", "gap_s": "Float64"})


def entries(lines: DataFrame) -> DataFrame:
    """Entries of a stream of log lines ``(dataset, line_no, value)`` with the seconds since the snapshot before.

    Rules are those of the batch (:func:`lamella.sources.logs.parse` and the gaps of snapshots). A batch is put in line
    order for each log; stamped lines no later than one already read come out as ``late`` and change nothing. State is
    the last line, the day, the clock and the last snapshot of each log.
    """
    known = lines.where("dataset IS NOT NULL AND line_no IS NOT NULL").select(F.col("dataset").cast("string").alias("dataset"), "line_no", "value")
    return known.groupBy("dataset").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
