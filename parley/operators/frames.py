"""Audio-shaped operators: hopping windows, energy, mix-down, smoothing of frame labels.

Positions are sample or frame numbers counted from the start of a recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parley.plans.slabs import side_by_side, slab_of

# Fixed defaults of the operators' arguments.
WINDOW_MS = 10_000
HOP_MS = 8_500
MIN_SPEECH_RMS = 0.008
TAIL_MIN_MS = 400
SLAB_SECONDS = 300
MIN_STREAM_SAMPLES = 1600


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def _length(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.groupBy(*keys).agg((F.max("frame_idx") + 1).alias("n_frames"))


def _window_sums(frames: DataFrame, keys: list[str], window: int, hop: int) -> DataFrame:
    """Sum of squares and count per (key, window number); a frame feeds every window it lies in."""
    i = F.col("frame_idx")
    first = F.greatest(F.lit(0), F.floor((i - window) / hop) + 1)
    return (
        frames.select(*keys, F.explode(F.sequence(first, F.floor(i / hop))).alias("k"), "x", "frame_idx")
        .where(F.col("frame_idx") < F.col("k") * hop + window)
        .groupBy(*keys, "k")
        .agg(F.sum(F.col("x") * F.col("x")).alias("sq"), F.count(F.lit(1)).alias("n"))
    )


def hopping_windows(
    frames: DataFrame,
    keys: list[str],
    frame_ms: int,
    window_ms: int = WINDOW_MS,
    hop_ms: int = HOP_MS,
    min_rms: float = MIN_SPEECH_RMS,
) -> DataFrame:
    """Complete windows counted from the start of the recording, quiet ones left out."""
    window, hop = window_ms // frame_ms, hop_ms // frame_ms
    sums = side_by_side(_window_sums(frames, keys, window, hop), _length(frames, keys), keys)
    return (
        sums.where(F.col("k") * hop + window <= F.col("n_frames"))
        .withColumn("rms", F.sqrt(F.col("sq") / F.col("n")))
        .where(F.col("rms") >= min_rms)
        .select(
            *keys,
            F.col("k").alias("window_no"),
            (F.col("k") * hop * frame_ms).alias("start_ms"),
            ((F.col("k") * hop + window) * frame_ms).alias("end_ms"),
            "rms",
        )
    )


def tail_window(
    frames: DataFrame,
    keys: list[str],
    frame_ms: int,
    window_ms: int = WINDOW_MS,
    hop_ms: int = HOP_MS,
    min_rms: float = MIN_SPEECH_RMS,
) -> DataFrame:
    """What is left after the last complete window, if long and loud enough."""
    window, hop = window_ms // frame_ms, hop_ms // frame_ms
    size = _length(frames, keys)
    full = F.when(F.col("n_frames") >= window, F.floor((F.col("n_frames") - window) / hop) + 1).otherwise(0)
    size = size.withColumn("window_no", full).withColumn("from_frame", full * hop)
    rest = side_by_side(frames, size, keys).where(F.col("frame_idx") >= F.col("from_frame"))
    return (
        rest.groupBy(*keys, "window_no", "from_frame", "n_frames")
        .agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
        .where((F.col("n_frames") - F.col("from_frame")) * frame_ms >= TAIL_MIN_MS)
        .where(F.col("rms") >= min_rms)
        .select(
            *keys,
            "window_no",
            (F.col("from_frame") * frame_ms).alias("start_ms"),
            (F.col("n_frames") * frame_ms).alias("end_ms"),
            "rms",
        )
    )


def stream_slabs(
    frames: DataFrame,
    keys: list[str],
    frame_ms: int,
    samples_per_frame: int,
    slab_s: int = SLAB_SECONDS,
    min_rms: float = MIN_SPEECH_RMS,
) -> DataFrame:
    """Back-to-back slabs of one speaker's stream; too short streams and quiet slabs are skipped."""
    per = slab_s * 1000 // frame_ms
    size = _length(frames, keys).where(F.col("n_frames") * samples_per_frame >= MIN_STREAM_SAMPLES)
    slabs = (
        frames.groupBy(*keys, F.floor(F.col("frame_idx") / per).alias("slab_no"))
        .agg(rms(F.col("x")).alias("rms"))
        .where(F.col("rms") >= min_rms)
    )
    start = F.col("slab_no") * per
    return side_by_side(slabs, size, keys).select(
        *keys,
        "slab_no",
        (start * frame_ms).alias("start_ms"),
        (F.least(start + per, F.col("n_frames")) * frame_ms).alias("end_ms"),
        "rms",
    )


def mix_down(frames: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """Sum the streams per position; scale a meeting down when its peak exceeds 1."""
    mixed = frames.groupBy(meeting, "frame_idx").agg(F.sum("x").alias("x"))
    peak = mixed.groupBy(meeting).agg(F.max(F.abs("x")).alias("peak"))
    return mixed.join(peak, meeting).select(
        meeting,
        "frame_idx",
        F.when(F.col("peak") > 1, F.col("x") / F.col("peak")).otherwise(F.col("x")).alias("x"),
    )


def stream_duration(frames: DataFrame, sample_rate: int, samples: Column) -> DataFrame:
    """Length per stream in whole ms and of the longest stream of the meeting."""
    per_stream = frames.groupBy("meeting_id", "stream_id").agg(F.sum(samples).alias("samples"))
    ms = F.floor(F.col("samples") * 1000 / sample_rate)
    per_meeting = per_stream.groupBy("meeting_id").agg(F.max(ms).alias("meeting_ms"))
    return per_stream.withColumn("stream_ms", ms).join(per_meeting, "meeting_id")


def with_halo(df: DataFrame, pos: str, width: int, radius: int) -> DataFrame:
    """Put every row in its slab of positions, and rows near an edge in the next slab too."""
    p = F.col(pos)
    return df.withColumn(
        "_slab", F.explode(F.sequence(slab_of(F.greatest(p - radius, F.lit(0)), width), slab_of(p + radius, width)))
    )


def smooth_labels(
    frames: DataFrame, keys: list[str], label: str, radius: int = 2, width: int = 100_000
) -> DataFrame:
    """Most common label among the neighbours within `radius` rows; ties go to the smallest.

    Series of under three rows stay as they are.
    """
    halo = with_halo(frames, "frame_idx", width, radius)
    w = W.partitionBy(*keys, "_slab").orderBy("frame_idx").rowsBetween(-radius, radius)
    smooth = halo.withColumn("smoothed", F.mode(F.col(label), True).over(w)).where(F.col("_slab") == slab_of(F.col("frame_idx"), width))
    lengths = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_length"))
    return smooth.join(lengths, keys).withColumn(
        "smoothed", F.when(F.col("_length") < 3, F.col(label)).otherwise(F.col("smoothed"))).drop("_slab", "_length")


def sparse_energy(frames: DataFrame, keys: list[str], step: int = 8, floor: float = 1e-7) -> DataFrame:
    """Energy of a batch judged by every `step`-th sample, as the capture side does before sending."""
    x2 = F.when(F.col("frame_idx") % step == 0, F.col("x") * F.col("x"))
    return frames.groupBy(*keys).agg(
        (F.sum(x2) / F.greatest(F.lit(1.0), F.count(F.lit(1)) / step)).alias("energy")
    ).withColumn("send", F.col("energy") >= floor)


def zscore(frames: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Standardise feature columns per key; the statistics are one small row per key."""
    stats = frames.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols]
    )
    out = frames.join(stats, keys)
    for c in cols:
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-6))
    return out.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])
