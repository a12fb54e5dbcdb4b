"""Expressions on sample arrays; a NULL element is a missing sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F


# The kernels are closures, so that workers get them by value and need not have this
# package installed.


def _nan_mask():
    """An Arrow kernel: NaN elements of float arrays to NULL."""

    def kernel(samples: pa.Array) -> pa.Array:
        flat = samples.flatten()
        sizes = pc.fill_null(pc.list_value_length(samples), 0).to_numpy()
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        missing = np.isnan(flat.to_numpy(zero_copy_only=False))
        values = pc.if_else(pa.array(missing), pa.scalar(None, flat.type), flat)
        return pa.ListArray.from_arrays(offsets, values, mask=samples.is_null())

    return F.arrow_udf(kernel, "array<float>")


def nan_to_null(samples: Column) -> Column:
    """NaN samples to missing ones; a NULL array stays NULL."""
    return _nan_mask()(samples.cast("array<float>"))


def nulls(count: Column, kind: str = "float") -> Column:
    """``count`` missing samples (none when ``count`` is negative)."""
    return F.array_repeat(F.lit(None).cast(kind), F.greatest(count, F.lit(0)).cast("int"))


def pad(samples: Column, size, kind: str = "float") -> Column:
    """Right-pad with missing samples up to ``size``; longer arrays stay as they are."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.concat(samples, nulls(size - F.size(samples), kind))


def nan_max(samples: Column) -> Column:
    """Largest real sample; NULL when there is none."""
    return F.array_max(F.filter(samples, lambda x: x.isNotNull() & ~F.isnan(x)))


def usable_rate(fs: Column) -> Column:
    """Whether a sampling rate is a positive number."""
    return F.coalesce((fs > 0) & ~F.isnan(fs) & (fs < F.lit(float("inf"))), F.lit(False))


def resampled_size(n: Column, fs: Column, target_fs: float) -> Column:
    """Samples that ``n`` samples at ``fs`` become at ``target_fs``; NULL without a usable rate."""
    fs = F.when(usable_rate(fs), fs)
    scaled = F.floor(n * F.lit(float(target_fs)) / fs)
    return F.when(fs == F.lit(float(target_fs)), n).otherwise(scaled).cast("long")


def _resampler(target_fs: float):
    """An Arrow kernel (sample arrays, rates) -> sample arrays at ``target_fs``."""

    def interpolated(x: np.ndarray, fs: float) -> np.ndarray:
        if len(x) == 0:
            return x
        m = int(np.floor(len(x) * target_fs / fs))
        at = np.arange(m) * fs / target_fs
        low = np.floor(at).astype(np.int64)
        part = at - low
        a = x[low]
        b = x[np.minimum(low + 1, len(x) - 1)]
        return np.where(part == 0, a, a + (b - a) * part)

    def kernel(samples: pa.Array, fs: pa.Array) -> pa.Array:
        flat = samples.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = pc.fill_null(pc.list_value_length(samples), 0).to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        rates = fs.to_numpy(zero_copy_only=False)
        out = [
            interpolated(flat[i:j], rate)
            for i, j, rate in zip(starts[:-1], starts[1:], rates)
        ]
        lengths = np.fromiter((len(o) for o in out), np.int32, len(out))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = np.concatenate([*out, np.empty(0)]).astype(np.float32)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(values, mask=np.isnan(values))
        )

    return F.arrow_udf(kernel, "array<float>")


def resample(samples: Column, fs: Column, target_fs: float) -> Column:
    """Linear interpolation onto the ``target_fs`` time grid.

    Output sample j sits at source position ``j * fs / target_fs``.  Missing samples
    are never bridged: a value needs both of its neighbours.  The loop over samples is
    a NumPy kernel on Arrow batches: as a lambda over the array it takes microseconds
    per sample.  Arrays already at ``target_fs`` do not leave the JVM.  Samples whose rate
    is NULL, NaN, infinite or not positive have no place in time: they become a NULL
    array, never an empty one.
    """
    same = F.coalesce(fs == F.lit(float(target_fs)), F.lit(False))
    other = ~same & usable_rate(fs) & samples.isNotNull()
    moved = _resampler(float(target_fs))(F.when(other, samples), F.when(other, fs))
    return F.when(same, samples.cast("array<float>")).when(other, moved)
