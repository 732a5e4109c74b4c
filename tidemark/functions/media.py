"""Facts about media files from the JSON that a prober writes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.fold import bound

PROBE = (
    "struct<streams: array<struct<codec_type: string, r_frame_rate: string, avg_frame_rate: string, width: bigint, height: bigint, duration: string>>, format: struct<duration: string>>"
)


def frame_rate(value: Column) -> Column:
    """'30000/1001' or '25' as frames a second; 0 for null, an empty string and a zero denominator."""
    parts = F.split(value, "/", 2)
    top = F.coalesce(parts[0].try_cast("double"), F.lit(0.0))
    bottom = F.when(F.size(parts) > 1, F.get(parts, 1).try_cast("double")).otherwise(1.0)
    return F.when(value.isNull() | (value == ""), 0.0).otherwise(F.coalesce(F.try_divide(top, bottom), F.lit(0.0)))


def is_variable(declared: Column, average: Column, tolerance: float) -> Column:
    return (declared > 0) & (average > 0) & (F.abs(declared - average) > tolerance)


def probe_info(probe_json: Column, tolerance: float) -> Column:
    """duration_s, fps, width, height, has_audio, is_variable_frame_rate of the first video stream; null without one.

    The JSON is parsed once, and each rate is, however many fields are made from them.
    """

    def facts(probe: Column) -> Column:
        video = F.get(F.filter(probe["streams"], lambda s: s["codec_type"] == "video"), 0)
        found = F.struct(
            video.alias("video"), frame_rate(video["r_frame_rate"]).alias("declared"), frame_rate(video["avg_frame_rate"]).alias("average"),
            F.exists(probe["streams"], lambda s: F.coalesce(s["codec_type"] == "audio", F.lit(False))).alias("has_audio"), probe["format"]["duration"].alias("whole"),
        )
        return bound(found, info)

    def info(x: Column) -> Column:
        duration = F.coalesce(F.nullif(x["video"]["duration"], F.lit("")), F.nullif(x["whole"], F.lit("")))
        return F.when(
            x["video"].isNotNull(),
            F.struct(
                F.coalesce(duration.try_cast("double"), F.lit(0.0)).alias("duration_s"),
                F.when(x["average"] > 0, x["average"]).otherwise(x["declared"]).alias("fps"),
                F.coalesce(x["video"]["width"], F.lit(0)).cast("long").alias("width"),
                F.coalesce(x["video"]["height"], F.lit(0)).cast("long").alias("height"),
                x["has_audio"].alias("has_audio"),
                is_variable(x["declared"], x["average"], tolerance).alias("is_variable_frame_rate"),
            ),
        )

    return bound(F.from_json(probe_json, PROBE), facts)


def sample_range(t_start: Column, t_end: Column, pad_s: float, rate: int, total: Column) -> tuple[Column, Column]:
    """First and end sample of a padded span, within the recording."""
    first = F.greatest(F.lit(0).cast("long"), ((t_start - pad_s) * rate).cast("long"))
    return first, F.least(total, ((t_end + pad_s) * rate).cast("long"))
