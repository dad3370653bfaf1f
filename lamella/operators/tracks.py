"""Camera tracks of survey videos: black frames, segments, travel, dwell, keyframes and their candidates.

A track has rows ``(video, frame, gray, step, response)``; step is the distance to the frame before, in hundredths of a pixel.
Frames without a grey value count as black.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLACK, BREAK, STILL, SHOULDER, TRAVEL, DWELL = 3.0, 600, 50, 5, 3000, 3
#: Travel that a dwell or a segment's end needs, and the frames looked back from a segment's end.
LEAST, TAIL = 1000, SHOULDER + 15
REASONS = ("travel", "dwell", "segment-start", "segment-end")


def lit_frames(track: DataFrame) -> DataFrame:
    return track.where(F.col("gray") >= BLACK)


def segments(track: DataFrame, limit: int = BREAK) -> DataFrame:
    """Segment of each usable frame and its travel inside the segment; black frames and long steps start a new one."""
    by = Window.partitionBy("video").orderBy("frame")
    start = F.lag("frame").over(by).isNull() | (F.col("frame") - F.lag("frame").over(by) > 1) | (F.col("step") > limit)
    rows = lit_frames(track).withColumn("start", start.cast("long")).withColumn("segment", F.sum("start").over(by) - 1)
    travel = F.sum(F.when(F.col("start") == 1, 0).otherwise(F.col("step"))).over(Window.partitionBy("video", "segment").orderBy("frame"))
    return rows.select("video", "frame", "segment", F.col("step").cast("long").alias("step"), travel.cast("long").alias("travel"))


def shoulders(track: DataFrame, reach: int = SHOULDER) -> DataFrame:
    """Usable frames within ``reach`` frames of a black one."""
    near = Window.partitionBy("video").orderBy("frame").rangeBetween(-reach, reach)
    black = F.coalesce(F.col("gray") < BLACK, F.lit(True))
    return track.select("video", "frame", black.alias("black"), F.max(black).over(near).alias("near")).where("near AND NOT black").select("video", "frame")


def dwells(track: DataFrame, still: int = STILL, least: int = 2) -> DataFrame:
    """Stretches of at least ``least`` adjacent frames of one segment that hardly move."""
    slow = segments(track).where(F.col("step") < still)
    island = F.col("frame") - F.row_number().over(Window.partitionBy("video", "segment").orderBy("frame"))
    return slow.withColumn("island", island).groupBy("video", "segment", "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


class Walk:
    """Keyframes along a video, frame by frame; the batch query and the stream both take their steps here.

    The first frame of a segment is one, and each frame ``TRAVEL`` after the last; where that frame lies within ``SHOULDER``
    frames of a black one the trigger stays armed until a frame doesn't. The middle of a dwell of ``DWELL`` frames is one if the view
    moved ``LEAST`` since the last, and so is the newest frame of a segment that ends that far on. What has moved, and an
    armed trigger, outlast a segment.
    """

    FIELDS = ("travel", "armed", "dwell", "first", "last", "blacks", "recent")

    def __init__(self, travel: int = 0, armed: bool = False, dwell: int = -1, first: int = -1, last: int = -1, blacks: list[int] | None = None, recent: list[int] | None = None):
        self.travel, self.armed, self.dwell, self.first, self.last = travel, armed, dwell, first, last
        self.blacks, self.recent = list(blacks or []), list(recent or [])

    def _emit(self, frame: int, reason: str, out: list) -> bool:
        if frame in self.recent or any(abs(frame - b) <= SHOULDER for b in self.blacks):
            return False
        oldest = min(self.last, frame, self.dwell if self.dwell >= 0 else frame) - TAIL
        self.recent = [f for f in self.recent if f >= oldest] + [frame]
        self.travel, self.armed = 0, False
        out.append((frame, reason))
        return True

    def _close_dwell(self, end: int, out: list) -> None:
        begin, self.dwell = self.dwell, -1
        if begin >= 0 and end - begin >= DWELL and self.travel >= LEAST:
            self._emit((begin + end) // 2, "dwell", out)

    def close(self, out: list) -> None:
        """The segment has ended at the last frame seen."""
        if self.first >= 0:
            self._close_dwell(self.last, out)
            if self.travel > LEAST:
                any(self._emit(j, "segment-end", out) for j in range(self.last, max(self.first - 1, self.last - TAIL), -1))
        self.first = -1

    def step(self, frame: int, black: bool, length: int | None, gap: bool = False) -> list[tuple[int, str]]:
        """Keyframes ``(frame, reason)`` that are known once this frame is seen; length is None where it can't be told."""
        out: list[tuple[int, str]] = []
        if black:
            self.blacks = [*self.blacks[-1:], frame]
            self.close(out)
        elif self.first < 0 or gap or length is None or length > BREAK:
            self.close(out)
            self.first = self.last = frame
            self.armed = not self._emit(frame, "segment-start", out)
        else:
            self.travel, self.last = self.travel + length, frame
            if length < STILL:
                self.dwell = self.dwell if self.dwell >= 0 else frame
            else:
                self._close_dwell(frame, out)
            self.armed = self.armed or self.travel >= TRAVEL
            if self.armed:
                self._emit(frame, "travel", out)
        return out


def travel_keyframes(track: DataFrame) -> DataFrame:
    """Keyframes ``(video, segment, frame, travel, reason)`` by the rule of :class:`Walk`; travel is the segment's own.

    Of those the ones within ``SHOULDER`` frames of a black one go: lights may go out after a keyframe. A task walks its videos
    one after another and keeps a few numbers of the one it is in; a video is one chain, so it isn't split.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, w, before = None, Walk(), 0
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for v, frame, lit, step in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found: list[tuple[int, str]] = []
                if v != video:
                    w.close(found)
                    out += [(video, *k) for k in found]
                    video, w, found = v, Walk(), []
                found += w.step(frame, not lit, step, frame - before > 1)
                before = frame
                out += [(video, *k) for k in found]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["video", "frame", "reason"])
        found = []
        w.close(found)
        yield pa.RecordBatch.from_arrays([pa.array([video] * len(found), pa.int64()), pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.string())], names=["video", "frame", "reason"])

    rows = track.where("video is not null and frame is not null").select(F.col("video").cast("long"), F.col("frame").cast("long"), F.coalesce(F.col("gray") >= BLACK, F.lit(False)).alias("lit"), F.col("step").cast("long"))
    found = rows.repartition("video").sortWithinPartitions("video", "frame").mapInArrow(walk, "video long, frame long, reason string")
    clean = found.join(shoulders(track), ["video", "frame"], "left_anti")
    return clean.join(segments(track), ["video", "frame"]).select("video", "segment", "frame", F.coalesce("travel", F.lit(0)).alias("travel"), "reason")


def sequential_candidates(keyframes: DataFrame) -> DataFrame:
    """Each keyframe with the next one and the next but one of its segment."""
    by = Window.partitionBy("video", "segment").orderBy("frame")
    rows = keyframes.withColumn("one", F.lead("frame", 1).over(by)).withColumn("two", F.lead("frame", 2).over(by))
    return rows.select("video", "segment", F.col("frame").alias("a"), F.explode(F.array("one", "two")).alias("b")).where("b IS NOT NULL")


def bridge_candidates(keyframes: DataFrame, back: int = 3, tail: int = 4, head: int = 3, to_first: bool = False) -> DataFrame:
    """The last ``tail`` keyframes of each of the ``back`` previous segments, on refining of segment 0 too, with the first ``head`` of a segment."""
    by = Window.partitionBy("video", "segment")
    ends = keyframes.withColumn("up", F.row_number().over(by.orderBy("frame"))).withColumn("down", F.row_number().over(by.orderBy(F.desc("frame"))))
    late = ends.where(F.col("down") <= tail).select("video", "segment", F.col("frame").alias("a"))
    before = F.sequence(F.greatest(F.lit(0), F.col("segment") - back), F.col("segment") - 1)
    before = F.array_union(F.array(F.lit(0).cast("long")), before) if to_first else before
    early = ends.where((F.col("up") <= head) & (F.col("segment") > 0)).select("video", F.col("frame").alias("b"), F.explode(before).alias("segment"))
    return late.join(early, ["video", "segment"]).select("video", "a", "b")


def track_statistics(track: DataFrame) -> DataFrame:
    """Frames, black ones, segments and breaks inside the light, path, longest travel, median positive response (column ``response``), keyframes by reason."""
    every = track.groupBy("video").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("gray") < BLACK, F.lit(True))).alias("n_black"))
    by = Window.partitionBy("video").orderBy("frame")
    lit = lit_frames(track).withColumn("jump", (F.col("frame") - F.lag("frame").over(by) == 1) & (F.col("step") > BREAK))
    lit = lit.groupBy("video").agg(F.count_if("jump").alias("n_breaks"), F.round(F.median(F.when(F.col("response") > 0, F.col("response"))), 6).alias("median_response"))
    last = segments(track).groupBy("video", "segment").agg(F.max("travel").alias("travel"))
    used = last.groupBy("video").agg(F.count("*").alias("n_segments"), F.max("travel").alias("longest"), F.sum("travel").alias("path"))
    reasons = travel_keyframes(track).groupBy("video").agg(*[F.count_if(F.col("reason") == r).alias(f"n_{r.replace('-', '_')}") for r in REASONS])
    rows = every.join(lit, "video", "left").join(used, "video", "left").join(reasons, "video", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("video", "n", "n_black", none("n_segments"), none("n_breaks"), "longest", "path", "median_response", *[none(f"n_{r.replace('-', '_')}") for r in REASONS])


def _placed(track: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("video").orderBy("frame")) - 1
    return track.select("video", "frame", place.alias("i"), F.count("*").over(Window.partitionBy("video")).alias("n"))


def sampled_frames(track: DataFrame, most: int = 96) -> DataFrame:
    """Up to ``most`` frames of each video spread evenly from its first to its last, both included."""
    rows = _placed(track)
    spots = rows.where(F.col("i") == 0).select("video", "n", F.explode(F.sequence(F.lit(0), F.least("n", F.lit(most)) - 1)).alias("k"))
    spots = spots.select("video", F.when(F.col("n") <= most, F.col("k")).otherwise(F.rint(F.col("k") * (F.col("n") - 1) / max(1, most - 1))).cast("long").alias("i")).distinct()
    return rows.withColumn("i", F.col("i").cast("long")).join(spots, ["video", "i"], "left_semi").select("video", "frame")


def tone_frames(track: DataFrame, most: int = 96) -> DataFrame:
    """The first ``most`` frames that are a whole stride apart, the sample that the tone is measured on."""
    rows = _placed(track).withColumn("stride", F.greatest(F.lit(1), F.floor(F.col("n") / most)))
    return rows.where((F.col("i") % F.col("stride") == 0) & (F.col("i") / F.col("stride") < most)).select("video", "frame")


def activity(track: DataFrame) -> DataFrame:
    """Stretches of usable frames between black ones, as sessions one frame (here: a second) apart; also on a stream."""
    rows = lit_frames(track).withColumn("at", F.timestamp_seconds("frame"))
    rows = rows.withWatermark("at", "1 minute") if track.isStreaming else rows
    found = rows.groupBy("video", F.session_window("at", "1500 milliseconds").alias("w")).agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n"))
    return found.select("video", "first", "last", "n")
