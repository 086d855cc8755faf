"""Surrogate-data test of nonlinearity."""

from __future__ import annotations

import math
from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestat.errors import InsufficientData
from lodestat.plans.checkpoints import stored
from lodestat.plans.joins import join_on
from lodestat.plans.series import Series, detrended, with_lags
from lodestat.plans.tiles import TILE

#: Chunk summaries that one step of the scan composes.
FAN_IN = 64
#: Hexadecimal digits of the hash that orders a surrogate.
HASH_DIGITS = 15
#: Consecutive residuals that are packed together, and chunks whose rows meet in a task.
BLOCK, SPAN = 16_384, 64
PACKED = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def fitted_ar1(series: Series) -> tuple[DataFrame, DataFrame]:
    """(keys, mean, phi, statistic_real) and (keys, t, n, e) of the detrended series."""
    keys = series.key_cols()
    flat = detrended(series)
    centre = flat.df.groupBy(*keys).agg(F.avg("x").alias("mean"))
    pairs = stored(with_lags(flat, [1], series.attach(flat.df, centre)).where(F.col("t") >= 1))
    mu, x, y = F.col("mean"), F.col("x"), F.col("lag1")
    top, bottom = F.sum((x - mu) * (y - mu)), F.sum((y - mu) * (y - mu))
    model = pairs.groupBy(*keys).agg(
        F.first("mean").alias("mean"),
        F.when(bottom > 0, F.try_divide(top, bottom)).otherwise(F.lit(0.0)).alias("phi"),
        F.avg(x * x * y - x * y * y).alias("statistic_real"),
    )
    model = stored(model)
    joined = series.attach(pairs, model.select(*keys, "phi"))
    residuals = joined.select(*keys, "t", "n", ((x - mu) - F.col("phi") * (y - mu)).alias("e"))
    return model, residuals


def ar1_fit(series: Series) -> DataFrame:
    """Mean, AR(1) coefficient and time-reversal asymmetry of the detrended series."""
    series.require(3)
    model, _ = fitted_ar1(series)
    return series.present(model, "mean", "phi", F.col("statistic_real").alias("asymmetry"))


def recurrence(e: np.ndarray, phi: float) -> np.ndarray:
    """y_i = phi y_{i-1} + e_i from y_{-1} = 0, by doubling steps."""
    y, reach, power = np.array(e, dtype=float), 1, phi
    while reach < len(y) and power != 0.0:
        y[reach:] = y[reach:] + power * y[:-reach]
        reach, power = reach * 2, power * power
    return y


def chunk_summary(e: np.ndarray, phi: float, mean: float, first: bool) -> list[float]:
    """What a chunk adds, as a cubic in the deviation ``y`` it starts from.

    Returns the chunk's last deviation as (constant, factor of y) and the four
    coefficients of its summed asymmetry. The values of the chunk are
    ``A + F y``, the one before it being ``mean + y``.
    """
    a = mean + np.concatenate([[0.0], recurrence(e, phi)])
    f = phi ** np.arange(len(e) + 1, dtype=float)
    last = [float(a[-1] - mean), float(f[-1])]
    if first:
        a, f = a[1:], f[1:]
    a0, a1, f0, f1 = a[:-1], a[1:], f[:-1], f[1:]
    cross, rise, slope = a1 * f0 + f1 * a0, a1 - a0, f1 - f0
    terms = (a1 * a0 * rise, cross * rise + a1 * a0 * slope, f1 * f0 * rise + cross * slope, f1 * f0 * slope)
    return last + [float(t.sum()) for t in terms]


def composed(first: Column, second: Column) -> Column:
    """Summary of two neighbouring stretches from theirs, each as :func:`chunk_summary` gives it."""
    a, f = first[0], first[1]
    c0, c1, c2, c3 = (second[k] for k in range(2, 6))
    cubic = (
        c0 + a * (c1 + a * (c2 + a * c3)),
        f * (c1 + a * (c2 * 2 + a * c3 * 3)),
        f * f * (c2 + a * c3 * 3),
        f * f * f * c3,
    )
    return F.array(second[0] + second[1] * a, second[1] * f, *[first[k + 2] + gain for k, gain in enumerate(cubic)])


def hash_order(seed: int, b: int, times: Sequence[bytes]) -> np.ndarray:
    """The leading :data:`HASH_DIGITS` digits of the hash of (seed, b, t), as numbers."""
    start = b"%d:%d:" % (seed, b)
    digests = b"".join([md5(start + t, usedforsecurity=False).digest() for t in times])
    return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(64 - 4 * HASH_DIGITS)).astype(np.int64)


def chunk_of(h: np.ndarray, n: int) -> np.ndarray:
    """Chunk of each hash, of as many as hold about TILE rows."""
    return np.floor(h.astype(float) / float(1 << 4 * HASH_DIGITS) * max(math.ceil(n / TILE), 1)).astype(np.int64)


def packed_gaps(h: np.ndarray) -> bytes:
    """Steps between sorted numbers, byte by byte of all: the leading bytes are zeros, which a shuffle compresses."""
    return np.diff(h).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_gaps(first: int, gaps: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(gaps, np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return first + np.concatenate([[0], np.cumsum(steps)])


def hashed_statistics(series: Series, model: DataFrame, residuals: DataFrame, surrogates: int, seed: int) -> DataFrame:
    """(keys, b, statistic): AR(1) driven by residuals in hashed order.

    The order of surrogate b sorts the residuals by a hash of (seed, b, t).
    Its leading bits assign rows to chunks of about TILE rows, its value sorts
    them inside: one shuffle of rows however long a series is. They travel as
    sorted arrays, one for each block of BLOCK rows and SPAN chunks. A chunk maps
    the value it starts from to its last one and adds a cubic of it. Such maps
    compose, so a tree that merges FAN_IN of them a step finishes surrogates
    of any length.
    """
    keys, names = series.key_cols(), list(series.keys)
    model_rows = series.attach(residuals, model.select(*keys, "phi", "mean"))
    blocks = model_rows.withColumn("block", F.floor(F.col("t") / BLOCK).cast("long"))
    fields = [blocks.schema[c] for c in (*names, "n", "block", "phi", "mean")]
    sent = StructType([*fields, *StructType.fromDDL("b int, span long, first long, gaps binary, e binary").fields])

    def pack(table: pa.Table) -> pa.Table:
        t = table["t"].to_numpy()
        order = np.argsort(t, kind="stable")
        e, times, n = table["e"].to_numpy()[order], [b"%d" % x for x in t[order].tolist()], table["n"][0].as_py()
        rows = []
        for b in range(surrogates):
            h = hash_order(seed, b, times)
            # Equal hashes stay in the order of time.
            place = np.argsort(h, kind="stable")
            h, driven = h[place], e[place]
            span = chunk_of(h, n) // SPAN
            cuts = [0, *(np.flatnonzero(np.diff(span)) + 1).tolist(), len(h)]
            rows += [(b, int(span[i]), int(h[i]), packed_gaps(h[i:j]), driven[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), PACKED)]
        own = table.select([f.name for f in fields]).take(pa.array(np.zeros(len(rows), np.int64)))
        return pa.table({**{f.name: own[f.name] for f in fields}, **dict(zip(("b", "span", "first", "gaps", "e"), columns))})

    made = StructType([*fields[: len(names) + 1], *StructType.fromDDL("b int, chunk long, s array<double>").fields])

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        h = np.concatenate([unpacked_gaps(f, g) for f, g in zip(table["first"].to_pylist(), table["gaps"].to_pylist())])
        e = np.concatenate([np.frombuffer(x) for x in table["e"].to_pylist()])
        order = np.argsort(h, kind="stable")
        h, e = h[order], e[order]
        n, phi, mean, b = (table[c][0].as_py() for c in ("n", "phi", "mean", "b"))
        chunk = chunk_of(h, n)
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(h)]
        parts = [chunk_summary(e[i:j], phi, mean, bool(chunk[i] == 0)) for i, j in zip(cuts, cuts[1:])]
        own = table.select([*names, "n", "b"]).take(pa.array(np.zeros(len(parts), np.int64)))
        columns = {"chunk": pa.array(chunk[cuts[:-1]], pa.int64()), "s": pa.array(parts, pa.list_(pa.float64()))}
        return pa.table({**{c: own[c] for c in (*names, "n", "b")}, **columns})

    packed = blocks.repartition(series.tasks(surrogates), *keys, "block").groupBy(*keys, "block").applyInArrow(pack, sent)
    by = [*keys, F.col("b"), F.col("span")]
    parts = packed.repartition(series.tasks(surrogates, 5_000_000), *by).groupBy(*by).applyInArrow(summed, made)
    spans = max(-(-series.longest // TILE), 1)
    while True:
        spans = -(-spans // FAN_IN)
        near = F.floor(F.col("chunk") / FAN_IN).cast("long").alias("chunk")
        listed = parts.groupBy(*keys, "b", "n", near).agg(F.sort_array(F.collect_list(F.struct("chunk", "s"))).alias("parts"))
        nothing = F.array(*[F.lit(v) for v in (0.0, 1.0, 0.0, 0.0, 0.0, 0.0)])
        parts = listed.select(*keys, "b", "n", "chunk", F.aggregate("parts", nothing, lambda done, part: composed(done, part["s"])).alias("s"))
        if spans == 1:
            break
    return parts.select(*keys, "b", (F.col("s")[2] / (F.col("n") - 2)).alias("statistic"))


def surrogate_test(series: Series, num_surrogates: int = 100, seed: int = 12345) -> DataFrame:
    """Time-reversal asymmetry against AR(1) surrogates, per series."""
    series.require(10)
    if num_surrogates < 2:
        raise InsufficientData(2)
    model, residuals = fitted_ar1(series)
    runs = hashed_statistics(series, model, residuals, num_surrogates, seed)
    spread = runs.groupBy(*series.key_cols()).agg(F.avg("statistic").alias("surrogate_mean"), F.stddev_samp("statistic").alias("surrogate_std"))
    both = join_on(model, spread, series.keys)
    z = F.when(F.col("surrogate_std") > 0, F.try_divide(F.col("statistic_real") - F.col("surrogate_mean"), F.col("surrogate_std")))
    out = both.withColumn("z_score", F.coalesce(z, F.lit(0.0)))
    return series.present(out, "statistic_real", "surrogate_mean", "surrogate_std", "z_score", (F.abs("z_score") > 2).alias("is_nonlinear"))
