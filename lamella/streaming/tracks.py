"""Camera tracks as they arrive: keyframes and a bounded sample of moving frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamella.operators.tracks import BLACK, SHOULDER, STILL, Walk
from lamella.plans.session import scratch

SAMPLE = 16
OUT = "video long, frame long, segment long, reason string"
STATE = "last long, seen long, segment long, travel long, armed boolean, dwell long, first long, end long, blacks array<long>, recent array<long>"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, seen, segment, *fields = state.get if state.exists else (-1, 0, -1)
    walk, out = Walk(*fields), []
    rows = pd.concat(list(batches)).sort_values(["frame", "step"])
    for frame, gray, step in zip(rows.frame, rows.gray, rows.step):
        if frame <= last:
            out.append((key[0], frame, segment, "late"))
            continue
        last, seen, black = frame, seen + 1, not gray >= BLACK
        if black:
            out += [(key[0], k, segment, "withdrawn") for k in walk.recent if seen - k <= SHOULDER]
        first = walk.first
        found = walk.step(seen, black, int(step) if step == step else None)
        opened = walk.first == seen and walk.first != first
        # what closes a segment belongs to the one before
        out += [(key[0], k, segment + int(opened and k == seen), reason) for k, reason in found]
        segment += int(opened)
    state.update((int(last), seen, segment, int(walk.travel), bool(walk.armed), int(walk.dwell), int(walk.first), int(walk.last), [int(b) for b in walk.blacks], [int(k) for k in walk.recent]))
    yield pd.DataFrame(out, columns=["video", "frame", "segment", "reason"])


def keyframes(track: DataFrame) -> DataFrame:
    """Keyframes of the stream ``(video, frame, gray, step)`` by the rule of the batch, :class:`lamella.operators.tracks.Walk`.

    ``frame`` in the result is the frame's place in its video, from 1. A batch is put in frame order for each video; frames no
    later than one already seen come out as ``late``, by their own number, and change nothing. A keyframe that a later black
    frame is too near to comes out again as ``withdrawn``. A frame without grey value is black, one without step starts a
    segment. State is a few numbers a video.
    """
    return track.where("video IS NOT NULL AND frame IS NOT NULL").groupBy("video").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _offer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, seen, stride, held = state.get if state.exists else (-1, 0, 1, [])
    rows, held = pd.concat(list(batches)).sort_values("frame"), list(held)
    for frame in rows.frame:
        if frame <= last:
            continue
        last = frame
        if seen % stride == 0:
            held.append(int(frame))
            if len(held) >= 2 * SAMPLE:
                held, stride = held[::2], 2 * stride
        seen += 1
    state.update((int(last), int(seen), int(stride), held))
    yield pd.DataFrame([(key[0], int(seen), int(stride), held)], columns=["video", "seen", "stride", "frames"])


def moving_sample(track: DataFrame) -> DataFrame:
    """T4: after each batch an evenly spread sample of a video's moving frames so far ``(video, seen, stride, frames)``.

    Every ``stride``-th frame is kept; at ``2 * SAMPLE`` of them each second one goes and the stride doubles, so state is
    bounded. The row with the largest ``seen`` is the last. Frames no later than one already seen are left out.
    """
    moving = track.where((F.col("gray") >= BLACK) & (F.col("step") >= STILL) & F.col("frame").isNotNull()).select("video", "frame")
    return moving.groupBy("video").applyInPandasWithState(_offer, "video long, seen long, stride long, frames array<long>", "last long, seen long, stride long, held array<long>", "append", GroupStateTimeout.NoTimeout)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    return rows.select(F.col("user_id").alias("video"), F.col("event_id").alias("frame"), F.col("value").alias("gray"), (F.floor(F.col("value") * 100).cast("long") % 700).alias("step"))


def _to_the_end(stream: DataFrame, label: str) -> DataFrame:
    """All that a stream gives until its source's present end."""
    at = scratch(stream.sparkSession, label)
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def live_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes of all events read as a stream until its present end, without those withdrawn; frames are numbered in their video."""
    rows = _to_the_end(keyframes(_events(spark, sf_dir)), "keyframes")
    gone = rows.where("reason in ('withdrawn', 'late')").select("video", "frame")
    return rows.join(gone, ["video", "frame"], "left_anti").select("video", "frame", "segment", "reason")


def live_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sample of each video's moving frames when all events are read as a stream."""
    rows = _to_the_end(moving_sample(_events(spark, sf_dir)), "sample")
    last = rows.groupBy("video").agg(F.max(F.struct("seen", "stride", "frames")).alias("s"))
    return last.select("video", "s.seen", "s.stride", F.posexplode("s.frames").alias("place", "frame"))
