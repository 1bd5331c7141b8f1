"""Media columns: chroma audio fingerprints, and recordings aligned by them.

A recording is a binary column of RIFF/WAVE bytes. Frames of its spectrum are folded to twelve pitch classes;
filters over the integral image of that sequence compare areas, and each gives two bits of a 32-bit integer a
frame. Two recordings are aligned by the histogram of offsets at which they share integers, and their distance is
the share of differing bits where they overlap at the best offset.

Null and undecodable recordings, and ones too short for a filter, have an empty fingerprint, are in a class of
their own and align with nothing. Recordings of equal fingerprint are one class, named by the least id;
an id that names several recordings may name several classes.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near, runtime

WINDOW, HOP = 2048, 512
LOWEST, HIGHEST = 60.0, 1800.0
SPAN = 8
#: Filters: kind of comparison, first pitch class, classes, frames. Made by rule: every kind at spread places.
KINDS = ("sum", "halves up", "halves on", "quarters")
FILTERS = tuple((k % 4, (5 * k) % 12, 2 + 2 * (k % 3), SPAN if k % 2 else SPAN // 2) for k in range(16))
#: Log ratios between which a filter's four levels change; levels are Gray-coded.
STEP = 0.25
GRAY = np.array([0, 1, 3, 2], np.uint32)


def tone_wav(notes: np.ndarray, rate: int = 4000, length: int = 512) -> bytes:
    """A WAVE recording of pitches, semitones over 110 Hz, each with its octave, one after the other."""
    steps = 110.0 * 2.0 ** (np.repeat(notes, length) / 12) / rate
    phase = 2 * np.pi * np.cumsum(steps)
    wave = 0.6 * np.sin(phase) + 0.3 * np.sin(2 * phase)
    data = (wave * 32767).astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(data)) + data


def decode_wav(data: bytes | None) -> tuple[int, np.ndarray]:
    """(rate, mono samples in -1 to 1) of 8- or 16-bit PCM; nothing for what can't be decoded."""
    none = (0, np.zeros(0))
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return none
    at, form = 12, None
    while at + 8 <= len(data):
        tag, n = struct.unpack_from("<4sI", data, at)
        if tag == b"fmt " and n >= 16 and at + 24 <= len(data):
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif tag == b"data" and form and form[0] == 1 and form[5] in (8, 16) and form[1]:
            body = data[at + 8:at + 8 + n]
            if form[5] == 16:
                samples = np.frombuffer(body[: len(body) // 2 * 2], "<i2") / 32768.0
            else:
                samples = np.frombuffer(body, np.uint8) / 128.0 - 1.0
            whole = len(samples) // form[1] * form[1]
            return form[2], samples[:whole].reshape(-1, form[1]).mean(1)
        at += 8 + n + n % 2
    return none


@functools.cache
def _fold(rate: int) -> np.ndarray:
    """Spectrum bins to pitch classes."""
    hertz = np.fft.rfftfreq(WINDOW, 1 / rate)
    use = np.flatnonzero((hertz >= LOWEST) & (hertz <= HIGHEST))
    out = np.zeros((len(hertz), 12))
    out[use, np.round(12 * np.log2(hertz[use] / 440.0)).astype(int) % 12] = 1
    return out


def chroma(rate: int, samples: np.ndarray) -> np.ndarray:
    """(frames, 12): normalised, smoothed energy of each pitch class."""
    if rate <= 0 or len(samples) < WINDOW:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    out = []
    for at in range(0, len(frames), 256):
        out.append((np.abs(np.fft.rfft(frames[at:at + 256] * np.hanning(WINDOW), axis=1)) ** 2) @ _fold(rate))
    energy = np.concatenate(out)
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    energy = np.where(norm > 1e-9, energy / np.where(norm > 0, norm, 1), 0)
    pad = np.pad(energy, ((1, 1), (0, 0)), mode="edge")
    return 0.25 * pad[:-2] + 0.5 * pad[1:-1] + 0.25 * pad[2:]


def fingerprint(image: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each place of the widest filter on the chroma image."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 25))
    total[1:, 1:] = np.tile(image, (1, 2)).cumsum(0).cumsum(1)  # twice round the pitch classes
    at = np.arange(n)

    def area(t0, t1, c0, c1):
        return total[at + t1, c1] - total[at + t0, c1] - total[at + t1, c0] + total[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for k, (kind, c, h, w) in enumerate(FILTERS):
        m, v = c + h // 2, w // 2
        if kind == 0:
            a, b = area(0, w, c, c + h) * (12 - h) / h, area(0, w, c + h, c + 12)
        elif kind == 1:
            a, b = area(0, w, m, c + h), area(0, w, c, m)
        elif kind == 2:
            a, b = area(v, w, c, c + h), area(0, v, c, c + h)
        else:
            a, b = area(0, v, c, m) + area(v, w, m, c + h), area(v, w, c, m) + area(0, v, m, c + h)
        ratio = np.log((a + 0.05) / (b + 0.05))
        level = (ratio > -STEP).astype(int) + (ratio > 0) + (ratio > STEP)
        out |= GRAY[level] << np.uint32(2 * k)
    return out


def fingerprints(audio: Column, render: Callable[[object], bytes | None] | None = None) -> Column:
    """Binary column: little-endian 32-bit integers of a recording, or of the one that ``render`` makes of a value.

    Recordings are rendered one at a time, so that a batch never holds more than its values and one recording.
    """

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        values = (v.as_py() for v in column)
        return pa.array([fingerprint(chroma(*decode_wav(render(v) if render else v))).astype("<u4").tobytes() for v in values], pa.binary())

    return run(audio)


#: Frames of the query recordings that one block holds, about 20 MB of a task; a longer one is a block of its own.
BLOCK_FRAMES = 1_000_000
#: Equal pairs of frames that are written out at a time.
EXPAND = 1 << 20


def offset_counts(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How often the two fingerprints share an integer at each offset, from ``1 - len(own)`` to ``len(other) - 1``.

    Integers that both hold seldom are counted pair by pair, the others (silence, held tones) by a correlation of
    their places, whose memory grows with the lengths and not with their product.
    """
    n, m = len(own), len(other)
    total = np.zeros(n + m - 1, np.int64)
    width = 1 << (n + m - 2).bit_length()
    ours, theirs = np.argsort(own, kind="stable"), np.argsort(other, kind="stable")
    values = np.intersect1d(own, other)
    a, b = own[ours], other[theirs]
    a0, a1, b0, b1 = (np.searchsorted(x, values, side) for x in (a, b) for side in ("left", "right"))
    held, size = [], 0
    for i0, i1, j0, j1 in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist()):
        i, j = ours[i0:i1], theirs[j0:j1]
        if len(i) * len(j) <= 8 * (n + m):
            held.append((j[:, None] - i + n - 1).ravel())
            size += len(held[-1])
            if size > EXPAND:
                total += np.bincount(np.concatenate(held), minlength=n + m - 1)
                held, size = [], 0
        else:
            left, right = np.zeros(width), np.zeros(width)
            left[n - 1 - i] = 1
            right[j] = 1
            total += np.rint(np.fft.irfft(np.fft.rfft(left) * np.fft.rfft(right), width)[:n + m - 1]).astype(np.int64)
    if held:
        total += np.bincount(np.concatenate(held), minlength=n + m - 1)
    return total


class Index:
    """Integers of a block of recordings, sorted, with the recording and frame of each."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        self.ids, self.prints = ids, prints
        n = np.fromiter(map(len, prints), np.int64, len(prints))
        value = np.concatenate([np.zeros(0, np.uint32), *prints])
        order = np.argsort(value, kind="stable")
        self.length, self.value = n, value[order]
        self.owner = np.repeat(np.arange(len(n)), n)[order]
        self.frame = (np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n))[order]

    def _best(self, own: np.ndarray, shared: int):
        """(recording, best offset) of those that share ``shared`` integers with ``own`` at one offset; the least of
        equally good offsets.

        Recordings that share few integers in all are counted together, some at a time; one that shares many more
        than it has frames is counted by itself.
        """
        places = np.argsort(own, kind="stable")
        values, start, count = np.unique(own[places], return_index=True, return_counts=True)
        lo, hi = np.searchsorted(self.value, values, "left"), np.searchsorted(self.value, values, "right")
        n = hi - lo
        entry = _runs(lo, n)
        start, count = np.repeat(start, n), np.repeat(count, n)
        owner = self.owner[entry]
        hits = np.bincount(owner, count, len(self.ids)).astype(np.int64)
        many = hits > 64 * (len(own) + self.length)
        for w in np.flatnonzero(many).tolist():
            total = offset_counts(own, self.prints[w])
            k = int(total.argmax())
            if total[k] >= shared:
                yield w, k + 1 - len(own)
        use = np.flatnonzero((hits >= shared)[owner] & ~many[owner])
        use = use[np.argsort(owner[use], kind="stable")]
        owner, entry, start, count = owner[use], entry[use], start[use], count[use]
        ends = np.append(np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(owner))
        upto = np.append(0, np.cumsum(count))
        wide, at = 1 << 32, 0
        while at < len(owner):
            # Whole recordings, as many as the bound allows and one at least.
            last = np.searchsorted(upto[ends], upto[at] + EXPAND, "right") - 1
            fit = ends[max(last, np.searchsorted(ends, at, "right"))]
            each = count[at:fit]
            offset = np.repeat(self.frame[entry[at:fit]], each) - places[_runs(start[at:fit], each)]
            key, total = np.unique(np.repeat(owner[at:fit], each) * wide + offset + wide // 2, return_counts=True)
            who = key // wide
            order = np.lexsort((-total, who))
            first = np.ones(len(order), bool)
            first[1:] = who[order][1:] != who[order][:-1]
            for k in order[first & (total[order] >= shared)].tolist():
                yield int(who[k]), int(key[k] % wide) - wide // 2
            at = int(fit)

    def align(self, own: np.ndarray, shared: int, overlap: int, error: float) -> list[tuple[int, int, float]]:
        """(recording of the block, offset, share of differing bits) of those that align with ``own``."""
        out = []
        if not len(own) or not len(self.value):
            return out
        for w, shift in self._best(own, shared):
            other = self.prints[w]
            a, b = max(0, -shift), min(len(own), len(other) - shift)
            if b - a >= overlap:
                differing = np.bitwise_count(own[a:b] ^ other[a + shift:b + shift]).sum() / (32 * (b - a))
                if differing <= error:
                    out.append((w, shift, float(differing)))
        return sorted(out)


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each of ``first`` on, ``n`` of each, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _write_blocks(asking: DataFrame, path: str, frames: int) -> list[str]:
    """Write (class_id, print) rows as files of at most ``frames`` frames, or one recording; their names.

    Tasks write them, named by task and turn, so that a task that is run again replaces its own.
    """

    def run(batches):
        store, part, turn = runtime.FileStore(path), TaskContext.get().partitionId(), 0
        ids, prints, size = [], [], 0

        def flush():
            name = f"{part}-{turn}"
            head = np.array([len(ids), *ids, *map(len, prints)], "<i8").tobytes()
            store.write(name, lambda f: f.write(head + b"".join(prints)))
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for b in batches:
            for class_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and size + len(data) > 4 * frames:
                    yield flush()
                    ids, prints, size, turn = [], [], 0, turn + 1
                ids.append(class_id)
                prints.append(data)
                size += len(data)
        if ids:
            yield flush()

    total = asking.agg(F.sum(F.length("print"))).first()[0] or 0
    dealt = asking.select("class_id", "print").repartition(-(-total // (4 * frames)) or 1, "class_id")
    return sorted(r.name for r in runtime.stored(dealt.mapInArrow(runtime.lean(run), "name string"), "block-names").collect())


def _read_block(path: str, name: str) -> Index:
    with runtime.FileStore(f"{path}/{name}").open() as f:
        data = f.read()
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ids, size = np.frombuffer(data, "<i8", 2 * n, 8).reshape(2, n)
    every = np.frombuffer(data, "<u4", offset=8 + 16 * n)
    return Index(ids.tolist(), [x.astype(np.uint32) for x in np.split(every, np.cumsum(size // 4)[:-1])])


def aligned(media: DataFrame, id_col: str, audio_col: str, render: Callable[[object], bytes | None] | None = None, every: int = 20, shared: int = 4, overlap: int = 16, error: float = 0.2, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """(id, class_id, n_frames, n_links) of every row.

    ``n_links`` counts other classes, among those with an id divisible by ``every``, that align with the row's:
    at least ``shared`` equal integers at the best offset (the least, if several are equally good), ``overlap`` frames
    there, at most ``error`` bits differing. Query classes are files of blocks in the shared folder, which the tasks
    of one scan read one by one for the rows they hold; only the blocks' names come to the driver. Rows meet them as
    classes, so copies cost once. A recording of any length, and integers that any number of recordings share, are
    counted exactly within a bound of memory that grows with the two lengths.
    """
    spark = media.sparkSession
    runtime.prepare(spark)
    prints = runtime.stored(media.select(F.col(id_col).alias("id"), fingerprints(F.col(audio_col), render).alias("print")), "prints")
    full = prints.where(F.length("print") > 0)
    classes = runtime.stored(full.groupBy("print").agg(F.min("id").cast("long").alias("class_id"), F.max(F.coalesce(F.col("id") % every == 0, F.lit(False))).alias("asks")), "print-classes")
    path = runtime.fresh_path(spark, "print-blocks")
    names = _write_blocks(classes.where("asks"), path, block_frames)

    def run(batches):
        last: list = [None, None]

        def block(name):
            if last[0] != name:
                last[:] = name, _read_block(path, name)
            return last[1]

        for b in batches:
            rows = [(i, np.frombuffer(data, "<u4")) for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            n = np.zeros(len(rows), np.int64)
            for name in names:
                index = block(name)
                for k, (class_id, own) in enumerate(rows):
                    found = index.align(own, shared, overlap, error)
                    n[k] += sum(index.ids[w] != class_id or not np.array_equal(index.prints[w], own) for w, _, _ in found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], ["class_id", "known", "n_links"])

    linked = classes.select("class_id", "print").mapInArrow(runtime.lean(run), "class_id long, known binary, n_links long")
    linked = runtime.stored(linked, "print-links")
    known = near.few(linked, linked.count())
    joined = prints.join(known, F.col("print") == F.col("known"), "left")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"),
        (F.coalesce(F.length("print"), F.lit(0)) / 4).cast("int").alias("n_frames"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def sonified(vector: list[float | None] | None) -> bytes | None:
    """A recording of a vector: a note of two octaves for each component, by its size relative to the vector's spread."""
    if not vector:
        return None
    a = np.nan_to_num(np.array([0.0 if y is None else y for y in vector]))
    return tone_wav(np.clip(np.round(12 + 5 * (a - a.mean()) / (a.std() or 1.0)), 0, 24))
