"""Implausible readings in step signals, by a Kalman filter per source and dimension.

The steps are read and put in order once, packed, and kept; two passes go over the packed recordings. The first
learns each source's usual behaviour: quantiles of values and of changes from step to step, per (dataset,
signal, dimension), as mergeable histograms. The second runs a local-linear-trend Kalman filter over
each series with noise taken from these quantiles. A standardised innovation above the threshold makes a
reading suspect and its update is withheld; a suspect burst is confirmed against the readings on both
sides. Where the running variance of the innovations vanishes a series may be stuck: the exact repeats around
such a reading count if the arm's other joints move. Readings that are not finite or far outside the
usual range are impossible.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepforge.session import durable

SIGNALS = ("qpos", "epos")


@dataclass(frozen=True)
class SpikeRules:
    """Parameters of the detector; defaults suit seven values an arm, the last a gripper."""

    arm_width: int = 7
    #: Angle positions within an arm of the epos signal, wrapped to [-pi, pi) ...
    angles: tuple[int, ...] = (3, 4, 5)
    #: ... unless the source stores changes per step.
    delta_sources: tuple[str, ...] = ("bridge", "droid", "fractal")
    #: Innovations above so many standard deviations are suspect.
    sigmas: float = 4.0
    #: A spike leaves both sides by so many times the 99% quantile of the usual change; a first or
    #: last reading, which has one side, by so many times.
    jump: float = 1.8
    end_jump: float = 3.6
    #: Part of ``jump`` that each step missing between two readings adds.
    gap: float = 0.35
    #: Longest spike.
    burst: int = 2
    #: Fewest repeats of a stuck reading.
    repeats: int = 10
    #: The innovations' variance has vanished below this part (squared) of the usual one; weight of its past at each step.
    quiet: float = 0.05
    memory: float = 0.4
    #: Far outside: so many usual widths beyond the usual range.
    beyond: float = 1.0
    #: Steps of a recording that one task filters at a time, and the steps seen around them.
    chunk: int = 4096
    context: int = 64


# ---------------------------------------------------------------- layout of the steps


def _ordered(steps: DataFrame, rules: SpikeRules) -> DataFrame:
    """Steps by recording and time, one row of (ep_key, part, t); long recordings are cut into parts.

    A row near a part's border is also sent to the neighbouring part (``own`` is false
    there), so a recording that holds a third of all rows is filtered by many tasks.
    """
    part = F.floor(F.col("t") / rules.chunk)
    near = F.array_distinct(
        F.array(part, F.floor((F.col("t") - rules.context) / rules.chunk), F.floor((F.col("t") + rules.context) / rules.chunk))
    )
    parts = F.filter(near, lambda p: (p >= 0) | (p == part))
    return (
        steps.where(F.col("ep_key").isNotNull() & F.col("t").isNotNull())
        .where(F.col("qpos").isNotNull() | F.col("epos").isNotNull())
        .select("ep_key", "dataset", "t", "qpos", "epos", F.explode(parts).alias("part"))
        .repartition("ep_key", "part")
        .sortWithinPartitions("ep_key", "part", "t")
    )


def _floats(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat values (null elements as NaN), row starts and row widths (-1: null row)."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(array.offsets)
    values = array.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    widths = np.diff(offsets).astype(np.int64)
    widths[np.asarray(array.is_null())] = -1
    return values, offsets[:-1].astype(np.int64), widths


@dataclass
class _Block:
    """Series of equal width: values [series, step, dim], NaN where missing."""

    values: np.ndarray
    t: np.ndarray
    length: np.ndarray
    ep: np.ndarray
    part: np.ndarray
    source: np.ndarray


def _blocks(table: pa.Table, signal: str, cells: int = 2_000_000) -> Iterator[_Block]:
    """Padded blocks of the whole recordings in ``table`` (sorted by ep_key, part, t)."""
    values, starts, widths = _floats(table.column(signal))
    ep = table.column("ep_key").to_numpy()
    part = table.column("part").to_numpy()
    t = table.column("t").to_numpy().astype(np.int64)
    names = table.column("dataset").to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(widths > 0)
    if not len(keep):
        return
    # A repeated step row comes next to its twin; the first with a reading counts.
    e, p, s, w = ep[keep], part[keep], t[keep], widths[keep]
    fresh = np.ones(len(keep), bool)
    fresh[1:] = (e[1:] != e[:-1]) | (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    keep, e, p, w = keep[fresh], e[fresh], p[fresh], w[fresh]
    # A series ends with its recording, and where the number of dimensions changes.
    first = np.ones(len(keep), bool)
    first[1:] = (e[1:] != e[:-1]) | (p[1:] != p[:-1]) | (w[1:] != w[:-1])
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, len(keep)))
    width = w[begin]
    for one in np.unique(width):
        chosen = np.flatnonzero(width == one)
        chosen = chosen[np.argsort(length[chosen], kind="stable")]
        at = 0
        while at < len(chosen):
            size = 1
            while at + size < len(chosen) and (size + 1) * length[chosen[at + size]] * one <= cells:
                size += 1
            group = chosen[at : at + size]
            at += size
            longest = int(length[group].max())
            steps = np.arange(longest)
            real = steps[None, :] < length[group][:, None]
            row = keep[np.minimum(begin[group][:, None] + steps, len(keep) - 1)]
            flat = np.minimum(starts[row][:, :, None] + np.arange(one), len(values) - 1)
            yield _Block(
                np.where(real[:, :, None], values[flat], np.nan),
                np.where(real, t[row], np.iinfo(np.int64).max),
                length[group],
                ep[keep[begin[group]]],
                part[keep[begin[group]]],
                names[keep[begin[group]]],
            )


def _recordings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end between two parts of recordings."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        ep, part = table.column("ep_key").to_numpy(), table.column("part").to_numpy()
        last = np.flatnonzero((ep != ep[-1]) | (part != part[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


# ---------------------------------------------------------------- first pass: usual behaviour

#: Bins an octave of the histograms: 1.1% from bin to bin.
_OCTAVE = 64
_LEAST = 2.0**-40


def _bin(x: np.ndarray) -> np.ndarray:
    size = np.log2(np.maximum(np.abs(x), _LEAST)) - np.log2(_LEAST)
    return (np.sign(x) * (1 + np.floor(size * _OCTAVE))).astype(np.int64)


def _unbin(column: str) -> F.Column:
    size = (F.abs(F.col(column)) - 0.5) / _OCTAVE
    return F.when(F.col(column) == 0, F.lit(0.0)).otherwise(
        F.signum(F.col(column).cast("double")) * F.pow(F.lit(2.0), size) * F.lit(_LEAST)
    )


def _wrap(x: np.ndarray) -> np.ndarray:
    return np.mod(x + np.pi, 2 * np.pi) - np.pi


def _is_wrapped(block: _Block, signal: str, rules: SpikeRules) -> np.ndarray:
    """[series, dim]: whether differences of this dimension are angles."""
    dims = np.isin(np.arange(block.values.shape[2]) % rules.arm_width, rules.angles)
    absolute = ~np.isin(block.source.astype(object), list(rules.delta_sources))
    return (absolute[:, None] & dims[None, :]) if signal == "epos" else np.zeros((len(absolute), len(dims)), bool)


_PACKED = "body binary, dataset string, kind int, dim int, what string, bin bigint, n bigint"


def _pack(batches: Iterator[pa.RecordBatch], rules: SpikeRules) -> Iterator[pa.RecordBatch]:
    """Whole recordings in order, packed as compressed tables, then counts of what they hold by source, dimension and bin."""
    total: dict[tuple, int] = {}
    for table in _recordings(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table.combine_chunks())
        empty = [pa.nulls(1, k) for k in (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), *empty], _PACKED.replace(",", "").split()[::2])
        _count(table, rules, total)
    if total:
        columns = list(zip(*total, strict=True))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
        counts = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(total), pa.binary()), *counts, pa.array(list(total.values()), pa.int64())], _PACKED.replace(",", "").split()[::2]
        )


def _count(table: pa.Table, rules: SpikeRules, total: dict[tuple, int]) -> None:
    """Add the readings of a table: ``all`` readings, finite values and changes from step to step by bin."""
    for kind, signal in enumerate(SIGNALS):
        for b in _blocks(table, signal):
            own = (b.t // rules.chunk == b.part[:, None])[:, :, None]
            real = np.broadcast_to((b.t < np.iinfo(np.int64).max)[:, :, None], b.values.shape)
            x = np.where(np.isfinite(b.values), b.values, np.nan)
            change = np.diff(x, axis=1)
            wrapped = _is_wrapped(b, signal, rules)[:, None, :]
            change = np.abs(np.where(wrapped, _wrap(change), change))
            change[(np.diff(b.t, axis=1) != 1)] = np.nan
            names, code = np.unique(b.source.astype(str), return_inverse=True)
            width = x.shape[2]
            dims = np.broadcast_to(np.arange(width), x.shape)
            for what, data, seen in (("all", None, real & own), ("value", x, ~np.isnan(x) & own), ("change", change, ~np.isnan(change) & own[:, 1:])):
                if not seen.any():
                    continue
                c = np.broadcast_to(code[:, None, None], seen.shape)[seen]
                at = 1 << 19 if data is None else _bin(data[seen]) + (1 << 19)
                key = (c * width + dims[:, : seen.shape[1]][seen]) * (1 << 20) + at
                for k, n in zip(*np.unique(key, return_counts=True), strict=True):
                    rest, place = divmod(int(k), 1 << 20)
                    s, d = divmod(rest, width)
                    where = (names[s], kind, d, what, place - (1 << 19))
                    total[where] = total.get(where, 0) + int(n)


def packed(steps: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """The ordered recordings of ``steps`` as compressed tables (``body``), and counts of their readings; read, shuffled and kept once."""
    steps = steps.withColumn("dataset", F.coalesce("dataset", F.lit("")))
    return durable(_ordered(steps, rules).mapInArrow(lambda b: _pack(b, rules), _PACKED))


def usual_behaviour(layout: DataFrame) -> DataFrame:
    """Per (dataset, kind, dim) of a ``packed`` table: low, mid, high (0.1%, 50%, 99.9% of the values), typical and large (50%, 99% of the changes).

    Quantiles are exact to 1.1%, over all rows. Sources without a reading have no row.
    """
    counts = layout.where("body IS NULL AND what <> 'all'").groupBy("dataset", "kind", "dim", "what", "bin").agg(F.sum("n").alias("n"))
    # A window holds the bins of one dimension, of which there are few, not its rows.
    w = Window.partitionBy("dataset", "kind", "dim", "what")
    part = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)).withColumn("x", _unbin("bin"))

    def quantile(what: str, q: float) -> F.Column:
        return F.min(F.when((F.col("what") == what) & (F.col("upto") >= q), F.struct("upto", "bin", "x")))["x"]

    return part.groupBy("dataset", "kind", "dim").agg(
        quantile("value", 0.001).alias("low"),
        quantile("value", 0.5).alias("mid"),
        quantile("value", 0.999).alias("high"),
        quantile("change", 0.5).alias("typical"),
        quantile("change", 0.99).alias("large"),
    )


# ---------------------------------------------------------------- second pass: filter and flags


def _filtered(x: np.ndarray, large: np.ndarray, wrapped: np.ndarray, rules: SpikeRules) -> tuple[np.ndarray, np.ndarray]:
    """Readings whose innovation is too large in a forward Kalman pass, and those at which the innovations' variance has vanished.

    x: [step, series], NaN missing.

    State: level and slope. The measurement's and the slope's noise follow from the usual
    large change of the dimension. Flagged updates are withheld; after more than ``burst``
    withheld ones in a row the course has really changed, and the filter starts again there. The variance of the
    innovations is a running one that forgets its past by ``memory`` a step; missing and withheld readings don't change it.
    """
    steps, n = x.shape
    sigma = large / 2.6
    r, q = (0.35 * sigma) ** 2, (0.5 * sigma) ** 2
    level, slope = np.zeros(n), np.zeros(n)
    p11, p12, p22 = r.copy(), np.zeros(n), 4 * sigma**2
    started, held = np.zeros(n, bool), np.zeros(n, np.int64)
    out, quiet = np.zeros((steps, n), bool), np.zeros((steps, n), bool)
    spread, vanished = sigma**2, (rules.quiet * sigma) ** 2
    for i in range(steps):
        z = x[i]
        there = ~np.isnan(z)
        a, b, c = p11 + 2 * p12 + p22 + q / 4, p12 + p22 + q / 2, p22 + q
        guess = level + slope
        new = z - guess
        new = np.where(wrapped, _wrap(new), new)
        s = a + r
        bad = there & started & (np.abs(new) > rules.sigmas * np.sqrt(s))
        held = np.where(bad, held + 1, np.where(there, 0, held))
        again = bad & (held > rules.burst)
        fresh = (there & ~started) | again
        use = there & started & ~bad
        out[i] = bad & ~again
        gain1, gain2 = np.where(use, a / s, 0.0), np.where(use, b / s, 0.0)
        move = np.where(use, new, 0.0)
        spread = np.where(use, rules.memory * spread + (1 - rules.memory) * move * move, np.where(fresh, sigma**2, spread))
        quiet[i] = use & (spread < vanished)
        level = np.where(started, guess + gain1 * move, level)
        slope = np.where(started, slope + gain2 * move, slope)
        p11 = np.where(started, (1 - gain1) * a, p11)
        p12 = np.where(started, (1 - gain1) * b, p12)
        p22 = np.where(started, c - gain2 * b, p22)
        level = np.where(fresh, z, level)
        slope = np.where(fresh, 0.0, slope)
        p11, p12, p22 = np.where(fresh, r, p11), np.where(fresh, 0.0, p12), np.where(fresh, 4 * sigma**2, p22)
        held = np.where(fresh, 0, held)
        started |= fresh
        wild = p22 > 16 * sigma**2  # an unobserved slope fades, so that a gap doesn't let the course drift
        slope = np.where(wild, 0.0, slope)
        p22 = np.where(wild, 4 * sigma**2, p22)
        p12 = np.where(wild, 0.0, p12)
    return out, quiet


def _neighbours(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the last true row before and the first after each row; -1 and len where none. good: [step, series]."""
    steps = len(good)
    index = np.where(good, np.arange(steps)[:, None], -1)
    before = np.maximum.accumulate(index, axis=0)
    left = np.vstack([np.full((1, good.shape[1]), -1), before[:-1]])
    index = np.where(good, np.arange(steps)[:, None], steps)
    after = np.minimum.accumulate(index[::-1], axis=0)[::-1]
    right = np.vstack([after[1:], np.full((1, good.shape[1]), steps)])
    return left, right


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, first and last row of each run of true. same: [step, series]."""
    edge = np.diff(np.vstack([np.zeros((1, same.shape[1]), np.int8), same.astype(np.int8), np.zeros((1, same.shape[1]), np.int8)]), axis=0)
    c0, s0 = np.nonzero((edge == 1).T)
    _, e0 = np.nonzero((edge == -1).T)
    return c0, s0, e0 - 1


def flag_block(
    x: np.ndarray, t: np.ndarray, low: np.ndarray, high: np.ndarray, large: np.ndarray, wrapped: np.ndarray, rules: SpikeRules
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spike, stuck and impossible flags of padded series.

    x: [series, step, dim] with NaN where a reading is missing and the padding is NaN with the
    largest integer in t: [series, step]. low, high, large, wrapped: [series, dim].
    """
    n, steps, dims = x.shape
    real = t < np.iinfo(np.int64).max
    # Quantiles are exact to 1.1%; a dimension that never changes says nothing about its reach but its size.
    size = np.maximum(np.abs(low), np.abs(high))
    width = np.maximum(high - low, 0.05 * size)
    width = np.where(high > low, width, 100 * np.maximum(size, 1.0))[:, None, :]
    finite = np.isfinite(x)
    with np.errstate(invalid="ignore"):
        far = (x < low[:, None, :] - rules.beyond * width) | (x > high[:, None, :] + rules.beyond * width)
    impossible = (~finite | far) & real[:, :, None]
    flat = lambda a: np.moveaxis(a, 1, 0).reshape(steps, n * dims)
    back = lambda a: np.moveaxis(a.reshape(steps, n, dims), 0, 1)
    y = flat(np.where(impossible | ~finite, np.nan, x))
    big, turn = large.reshape(-1), wrapped.reshape(-1)
    gripper = np.tile(np.arange(dims) % rules.arm_width == rules.arm_width - 1, n)
    time = np.repeat(np.minimum(t, 1 << 40)[:, :, None], dims, axis=2)
    time = flat(time).astype(np.float64)

    live = np.flatnonzero((big > 0) & ~gripper)
    spike, quiet = np.zeros_like(y, bool), np.zeros_like(y, bool)
    if len(live):
        z, w, g, tt = y[:, live], turn[live], big[live], time[:, live]
        suspect, quiet[:, live] = _filtered(z, g, w, rules)
        suspect |= _filtered(z[::-1], g, w, rules)[0][::-1]
        some = np.flatnonzero(suspect.any(axis=0))
        if len(some):
            spike[:, live[some]] = _confirmed(z[:, some], tt[:, some], suspect[:, some], g[some], w[some], rules)

    same = np.zeros_like(y, bool)
    same[1:] = y[1:] == y[:-1]
    moves = np.zeros_like(y, bool)
    moves[1:] = ~same[1:] & ~np.isnan(y[1:]) & ~np.isnan(y[:-1])
    moves[:, gripper] = False
    arms = -(-dims // rules.arm_width)
    arm = np.repeat(np.arange(n) * arms, dims) + np.tile(np.arange(dims) // rules.arm_width, n)
    order = np.zeros((steps, n * arms), np.int64)
    np.add.at(order.T, arm, moves.T.astype(np.int64))
    joints = np.bincount(arm, weights=~gripper, minlength=n * arms)
    stuck = np.zeros_like(y, bool)
    same[:, gripper | ~(big > 0)] = False  # a dimension that never changes isn't stuck
    col, s, e = _runs(same)
    long = e - s + 1 >= rules.repeats
    for c, i, j in zip(col[long], s[long], e[long], strict=True):
        # Without a vanished variance this is no stuck sensor; the repeats around one are its extent.
        if not quiet[i : j + 1, c].any():
            continue
        others = order[i : j + 1, arm[c]]
        # The other joints move on where most of them change.
        if np.count_nonzero(2 * others >= joints[arm[c]] - 1) >= max(rules.repeats, (j - i + 1) / 2) and joints[arm[c]] > 1:
            stuck[i : j + 1, c] = True
    return back(spike), back(stuck), impossible


def _confirmed(
    z: np.ndarray, t: np.ndarray, suspect: np.ndarray, large: np.ndarray, wrapped: np.ndarray, rules: SpikeRules
) -> np.ndarray:
    """Suspects that leave the course on both sides; bursts up to ``burst`` readings."""

    def step(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(wrapped, _wrap(a - b), a - b)

    steps, n = z.shape
    column = np.arange(n)
    for _ in range(2):  # a second look, with neighbours that the first look cleared
        left, right = _neighbours(~np.isnan(z) & ~suspect)
        inside_l, inside_r = left >= 0, right < steps
        li, ri = np.maximum(left, 0), np.minimum(right, steps - 1)
        d_l, d_r = step(z, z[li, column]), step(z, z[ri, column])
        gap_l, gap_r = np.maximum(np.abs(t - t[li, column]) - 1, 0), np.maximum(np.abs(t[ri, column] - t) - 1, 0)
        size_l, size_r = np.abs(d_l) / (1 + rules.gap * gap_l), np.abs(d_r) / (1 + rules.gap * gap_r)
        peak = (d_l * d_r > 0) & (np.minimum(size_l, size_r) > rules.jump * large)
        at_end = np.where(inside_l, size_l, size_r) > rules.end_jump * large
        confirmed = suspect & ~np.isnan(z) & np.where(inside_l & inside_r, peak, (inside_l | inside_r) & at_end)
        suspect = confirmed
    c, s, e = _runs(confirmed)
    for k in np.flatnonzero(e - s + 1 > rules.burst):
        confirmed[s[k] : e[k] + 1, c[k]] = False
    return confirmed


_FLAGS = "ep_key bigint, dataset string, t int, signal_kind string, dim int, spike boolean, stuck boolean, impossible boolean"


def _flags(batches: Iterator[pa.RecordBatch], model: dict, rules: SpikeRules) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column(0):
            with pa.ipc.open_stream(body.as_buffer()) as reader:
                table = reader.read_all()
            found: list[list[np.ndarray]] = []
            for kind, signal in enumerate(SIGNALS):
                for b in _blocks(table, signal):
                    dims = b.values.shape[2]
                    names, code = np.unique(b.source.astype(str), return_inverse=True)
                    rows = np.array([[model.get((s, kind, d), (-np.inf, np.inf, 0.0)) for d in range(dims)] for s in names])
                    rows = rows[code]
                    spike, stuck, impossible = flag_block(
                        b.values, b.t, rows[:, :, 0], rows[:, :, 1], rows[:, :, 2], _is_wrapped(b, signal, rules), rules
                    )
                    own = (b.t // rules.chunk == b.part[:, None])[:, :, None]
                    i, j, d = np.nonzero((spike | stuck | impossible) & own)
                    if len(i):
                        found.append([b.ep[i], b.source[i].astype(str), b.t[i, j], np.full(len(i), kind), d, spike[i, j, d], stuck[i, j, d], impossible[i, j, d]])
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1].tolist(), pa.string()),
                        pa.array(columns[2], pa.int32()),
                        pa.array([SIGNALS[k] for k in columns[3]], pa.string()),
                        pa.array(columns[4], pa.int32()),
                        *[pa.array(c, pa.bool_()) for c in columns[5:]],
                    ],
                    _FLAGS.replace(",", "").split()[::2],
                )


#: Most (dataset, signal, dimension) triples whose figures are sent to every task.
MODEL_ROWS = 1_000_000


def flag_readings(steps: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """Rows (ep_key, t, signal_kind, dim, spike, stuck, impossible), one per flagged reading.

    ``steps`` needs ep_key, dataset, t, qpos, epos; other columns are ignored. Rows with a null
    ep_key or t have no place in a recording and are left out; a null dataset is a source of its own.
    A null array is missing, a null element counts as not finite. Repeated step rows
    count once. Sources whose dimension never changes have no spikes. Empty input: no rows.

    The figures of the first pass are sent to the tasks: three numbers per (dataset, signal,
    dimension), at most MODEL_ROWS, else an error is raised.
    """
    return _flagged(packed(steps, rules), rules).drop("dataset")


def _flagged(layout: DataFrame, rules: SpikeRules) -> DataFrame:
    usual = usual_behaviour(layout).limit(MODEL_ROWS + 1).collect()
    if len(usual) > MODEL_ROWS:
        raise ValueError("too many sources for a model that every task holds")
    model = {
        (u.dataset, u.kind, u.dim): (u.low, u.high, u.large or 0.0)
        for u in usual
        if u.low is not None and u.high is not None
    }
    return layout.where("body IS NOT NULL").select("body").mapInArrow(lambda b: _flags(b, model, rules), _FLAGS)


def flag_rates(steps: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """(dataset, signal_kind, dim, n_readings, n_spike, n_stuck, n_impossible, rate): also of dimensions without a flag.

    A reading that is missing because its array is null doesn't count; a null dataset is a source.
    """
    layout = packed(steps, rules)
    names = F.array(*[F.lit(s) for s in SIGNALS])
    seen = layout.where("what = 'all'").groupBy("dataset", F.get(names, F.col("kind")).alias("signal_kind"), "dim").agg(F.sum("n").alias("n_readings"))
    reasons = ("spike", "stuck", "impossible")
    flags = _flagged(layout, rules).groupBy("dataset", "signal_kind", "dim").agg(
        *[F.count_if(c).alias(f"n_{c}") for c in reasons], F.count(F.lit(1)).alias("_n")
    )
    both = seen.join(flags, ["dataset", "signal_kind", "dim"], "left").na.fill(0, [f"n_{c}" for c in reasons] + ["_n"])
    return both.select(
        F.nullif("dataset", F.lit("")).alias("dataset"), "signal_kind", "dim", "n_readings", *[f"n_{c}" for c in reasons], (F.col("_n") / F.col("n_readings")).alias("rate")
    )
