"""Samples as arrays: mixing down, peak scaling, WAV headers and cutting at quiet places."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Energy window and hop in seconds, the shortest last chunk.
WINDOW, HOP, LAST = 0.25, 0.05, 3.0


def mono(channels: Column) -> Column:
    """AUD2: the mean of the channels of each frame."""
    return F.transform(channels, lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(c))


def peak_scaled(samples: Column) -> Column:
    """AUD2: samples divided by their peak where that is above 1."""
    peak = F.array_max(F.transform(samples, F.abs))
    return F.when(peak > 1, F.transform(samples, lambda x: x / peak)).otherwise(samples)


def wav_header(content: Column) -> Column:
    """AUD3: ``(channels, rate, bits, pcm)`` from the first 36 bytes of a canonical WAV file; null for other files."""

    def number(at: int, size: int) -> Column:
        return F.conv(F.hex(F.reverse(F.substring(content, at + 1, size)) if size == 1 else F.concat(*[F.substring(content, at + size - i, 1) for i in range(size)])), 16, 10).cast("bigint")

    good = (F.substring(content, 1, 4) == F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WAVE"))
    return F.when(good, F.struct(number(22, 2).alias("channels"), number(24, 4).alias("rate"), number(34, 2).alias("bits"), (number(20, 2) == 1).alias("pcm")))


def _rms(power: np.ndarray, centers: np.ndarray, win: int, start: int) -> np.ndarray:
    """Root mean square of the window around each center, from a running sum of squares; windows stay inside the chunk and the recording."""
    lo = np.maximum(start, centers - win // 2)
    hi = np.minimum(len(power) - 1, lo + win)
    return np.sqrt(np.maximum(power[hi] - power[lo], 0) / (hi - lo))


def _cut_points(x: np.ndarray, rate: int, most: float) -> list[int]:
    """Frames at which chunks end.

    The places for a cut are the hops of a chunk's second half that leave the least
    last chunk whole. They are ranked by one key: pauses (energy at most a quarter of
    the median) by time, then places in the last 30 percent by energy, then the rest
    by energy, the later of equals first. Without any place the chunk is as long as it
    may be.
    """
    n, top, win, hop, last = len(x), *(max(1, round(s * rate)) for s in (most, WINDOW, HOP, LAST))
    power = np.concatenate([[0.0], np.cumsum(np.square(x.astype(np.float64)))])
    ends = [0]
    while n - ends[-1] > top:
        at = ends[-1]
        places = np.arange(at + top // 2, min(at + top - win // 2, n - last) + 1, hop)
        places = places[places > at]
        if not len(places):
            ends.append(at + top)
            continue
        rms = _rms(power, places, win, at)
        quiet = rms <= max(1e-4, 0.25 * float(np.median(rms)))
        tier = np.where(quiet, 0, np.where(places >= at + int(top * 0.7), 1, 2))
        ends.append(int(places[np.lexsort((-places, np.where(quiet, places, rms), tier))[0]]))
    return [*ends[1:], n] if ends[-1] < n or not n else ends[1:]


@F.arrow_udf(T.ArrayType(T.LongType()))
def quiet_cuts(samples: pa.Array, rate: pa.Array, most: pa.Array) -> pa.Array:
    """AGG27: the end frames of chunks of at most ``most`` seconds, cut in pauses; null for null samples."""
    out = []
    for s, r, m in zip(samples, rate.to_pylist(), most.to_pylist()):
        out.append(_cut_points(np.asarray(s.values), r, m) if s.is_valid else None)
    return pa.array(out, pa.list_(pa.int64()))
