"""Column functions of the survey jobs (X1, X3, X4, X6, X7, X9-X14): times, keys, angles, tone, lattice coordinates, records."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reach of a snap in pixels, and the share of a drag that it must cover.
SNAP_LEAST, SNAP_MOST, SNAP_SHARE, SNAP_MARGIN = 96, 768, 1.25, 64.0


def xml_time(date: Column, time: Column) -> Column:
    """``yymmdd`` and ``hhmmss`` as UTC text to the second; empty where either has another length."""
    part = lambda c, i: F.substring(c, i, 2)
    text = F.concat(F.lit("20"), part(date, 1), F.lit("-"), part(date, 3), F.lit("-"), part(date, 5), F.lit("T"), part(time, 1), F.lit(":"), part(time, 3), F.lit(":"), part(time, 5), F.lit("Z"))
    return F.when((F.length(date) == 6) & (F.length(time) == 6), text).otherwise("")


def utc_second(seconds: Column) -> Column:
    """Seconds since the epoch as UTC text, whatever the session's time zone."""
    at = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def dataset_key(path: Column) -> Column:
    """A folder's name and eight hex digits of the SHA-1 of its lower-cased path."""
    return F.concat(F.element_at(F.split(path, "/"), -1), F.lit("-"), F.substring(F.sha1(F.lower(path)), 1, 8))


def trial_tag(trials: Column) -> Column:
    """First, last, number and eight hex digits of the SHA-1 of an ordered list of trials."""
    pad = lambda c: F.lpad(c.cast("string"), 3, "0")
    first, last = F.element_at(trials, 1), F.element_at(trials, -1)
    wide = lambda c: F.when(c < 1000, pad(c)).otherwise(c.cast("string"))
    digest = F.substring(F.sha1(F.array_join(trials.cast("array<string>"), ",")), 1, 8)
    return F.concat(F.lit("trials_"), wide(first), F.lit("-"), wide(last), F.lit("_n"), F.size(trials).cast("string"), F.lit("_"), digest)


def config_key(text: Column) -> Column:
    """Ten hex digits of the SHA-1 of a configuration's canonical text."""
    return F.substring(F.sha1(text), 1, 10)


def position_line(trial: Column, x: Column, y: Column) -> Column:
    """A position to two decimals as text, the unit of position stamps."""
    return F.concat_ws(":", trial.cast("string"), F.format_string("%.2f", F.bround(x, 2)), F.format_string("%.2f", F.bround(y, 2)))


def fold_angle(degrees: Column) -> Column:
    """An angle between square lattices, in [-45, 45)."""
    return F.pmod(degrees + 45.0, F.lit(90.0)) - 45.0


def scale_ladder(low: float = 0.25, high: float = 4.0, n: int = 13) -> Column:
    """``n`` log-even scale factors from ``low`` to ``high``, to four decimals."""
    step = (math.log(high) - math.log(low)) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(F.exp(F.lit(math.log(low)) + i * F.lit(step)), 4))


def tone_mapped(px: Column, low: Column, high: Column) -> Column:
    """Pixels on a window as whole numbers from 0 to 255, cut off below the next one."""
    return F.transform(px, lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v - low) / (high - low) * 255.0))).cast("int"))


def signal_plane(b: Column, g: Column, r: Column) -> Column:
    """The largest of three channels."""
    return F.greatest(b, g, r)


def palette(tint: Column) -> Column:
    """256 (r, g, b) entries of a tint (b, g, r; null: grey), entry 0 black."""
    one = lambda i, k: F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), i * F.coalesce(F.element_at(tint, k), F.lit(1.0))))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.array(one(i, 3), one(i, 2), one(i, 1)))


def xy_pair(value: Column) -> Column:
    """``struct(x, y)`` of an array of two numbers held as text; null for anything else, halves included."""
    x, y = F.try_element_at(value, F.lit(1)).try_cast("double"), F.try_element_at(value, F.lit(2)).try_cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when((F.size(value) == 2) & finite(x) & finite(y), F.struct(x.alias("x"), y.alias("y")))


def electrode_id(col: Column, row: Column) -> Column:
    """``col-row``."""
    return F.concat_ws("-", col.cast("string"), row.cast("string"))


def csv_field(value: Column) -> Column:
    """A CSV field, quoted only where it has to be; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def lattice_coordinates(dx: Column, dy: Column, a1: tuple[Column, Column], a2: tuple[Column, Column]) -> tuple[Column, Column]:
    """X11: how many steps of the vectors ``a1`` and ``a2`` an offset is, by the inverse of their matrix; null if they are parallel."""
    det = a1[0] * a2[1] - a1[1] * a2[0]
    det = F.when(F.abs(det) >= 1e-9, det)
    return (a2[1] * dx - a2[0] * dy) / det, (a1[0] * dy - a1[1] * dx) / det


def snap_radius(moved: Column) -> Column:
    """Half-width of the search that reaches back from a drag of so many pixels."""
    want = F.rint(F.lit(SNAP_SHARE) * F.abs(moved) + F.lit(SNAP_MARGIN))
    return F.greatest(F.lit(SNAP_LEAST), F.least(F.lit(SNAP_MOST), want)).cast("int")


def hit_radius(strict: Column, pitch: Column, scale: Column, least: float = 4.0) -> Column:
    """Radius of a click at a zoom: ``least`` screen pixels, at least ``strict``, never beyond a cell's corner."""
    cap = F.greatest(strict, pitch * math.sqrt(0.5))
    return F.when(scale > 0, F.least(F.greatest(strict, least / scale), cap)).otherwise(strict)


def physical_scale(um: Column) -> Column:
    """What is known of the micrometres in a pixel: ``unknown``, ``supplied`` or ``refused`` (not a positive number)."""
    good = (um > 0) & ~F.isnan(um) & (um < float("inf"))
    return F.when(um.isNull(), "unknown").when(good, "supplied").otherwise("refused")
