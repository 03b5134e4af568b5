"""Short-time features of a sample stream and the test for a second speaker."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

# 30 ms analysis frames every 15 ms.
FRAME_MS, HOP_MS = 30, 15
SLAB_FRAMES = 4_000


def frame_features(
    samples: DataFrame, keys: list[str], sample_rate: int, threshold: float, slab_frames: int = SLAB_FRAMES
) -> DataFrame:
    """Loudness, spectral centre and zero crossings of every frame above the energy threshold.

    Samples (frame_idx, x) are dealt to slabs of `slab_frames` analysis frames, with the
    overhang of the last frame copied into both slabs, so no recording sits in one task.
    """
    frame, hop = sample_rate * FRAME_MS // 1000, sample_rate * HOP_MS // 1000
    slab = slab_frames * hop
    i = F.col("frame_idx")
    spread = samples.select(
        *keys, "frame_idx", "x",
        F.explode(F.sequence(F.floor(F.greatest(i - frame + 1, F.lit(0)) / slab), F.floor(i / slab))).alias("_slab"),
    )
    key_fields = [spread.schema[k] for k in keys]
    schema = T.StructType(
        key_fields
        + [T.StructField("pos", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("loudness", "centroid", "zcr")]
    )
    taper, freqs = np.hanning(frame), np.fft.rfftfreq(frame, d=1.0 / sample_rate)

    def analyse(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        x, first = pdf["x"].to_numpy(), int(pdf["frame_idx"].iloc[0])
        base = int(key[-1]) * slab
        starts = np.arange(base, base + slab, hop)
        starts = starts[(starts >= first) & (starts + frame <= first + len(x))]
        if not len(starts):
            return pd.DataFrame(columns=schema.names)
        w = x[(starts - first)[:, None] + np.arange(frame)]
        rms = np.sqrt((w * w).mean(axis=1) + 1e-12)
        power = np.abs(np.fft.rfft(w * taper, axis=1))
        out = pd.DataFrame(
            {
                "pos": starts,
                "loudness": np.log1p(rms * 100),
                "centroid": (power @ freqs) / (power.sum(axis=1) + 1e-12) / 1000.0,
                "zcr": np.abs(np.diff(np.sign(w), axis=1)).mean(axis=1) / 2.0,
            }
        )
        out = out[rms >= threshold]
        for name, value in zip(keys, key):
            out[name] = value
        return out[schema.names]

    return spread.groupBy(*keys, "_slab").applyInPandas(analyse, schema)
