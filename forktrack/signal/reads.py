"""From raw signal to aligned positions, a read at a time in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BandConfig, EventConfig, HmmConfig
from . import align, events

SCHEMA = "read_id string, coord long, base int, kmer string, event int, is_match boolean, signal array<double>, shift double, scale double, average_log double, longest_gap int, model_mean double"


def model_arrays(model: DataFrame, k: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Dense levels of all 4^k k-mers, which is the bound of what is collected."""
    mean, sd = np.zeros(4**k), np.full(4**k, 1e-6)
    for r in model.select("kmer_idx", "mean", "sd").toLocalIterator():
        mean[r.kmer_idx], sd[r.kmer_idx] = r["mean"], max(r["sd"], 1e-6)
    return mean, sd


def align_read(raw: np.ndarray, basecall: str, reference: str, ref_to_query: dict[int, int], mean: np.ndarray, sd: np.ndarray, k: int = 9, band: BandConfig = BandConfig(), detect: EventConfig = EventConfig(), hmm: HmmConfig = HmmConfig()):
    """(aligned events, detected events, scaling, banded alignment) of one read, or None if it fails a quality limit."""
    found = events.events(raw, detect)
    query, target = align.kmer_indexes(basecall, k), align.kmer_indexes(reference, k)
    if len(found) < 10 or len(query) < 10 or len(target) < 10:
        return None
    means = np.array([e[2] for e in found])
    rough = align.rough_scaling(means, mean[target])
    if rough.scale == 0:
        return None
    banded = align.banded_alignment(means, mean[query], sd[query], rough, band)
    to_ref = {q: r for r, q in ref_to_query.items()}
    seen: dict[int, list[float]] = {}
    for e, q in banded.pairs:
        if to_ref.get(q, len(target)) < len(target):
            seen.setdefault(q, []).append(means[e])
    if not banded.passes(band) or len(seen) < band.min_events:
        return None
    scaling = align.refined_scaling(np.array([np.mean(v) for v in seen.values()]), mean[target[[to_ref[q] for q in seen]]], rough)
    if scaling is None:
        return None
    t = align.Transitions.of(max(len(found) / max(len(basecall) - k, 1), 1.0 + 1e-9), hmm)
    return align.event_alignment(means, banded.pairs, ref_to_query, reference, mean, sd, scaling, t, k=k), found, scaling, banded


def align_reads(reads: DataFrame, model: DataFrame, k: int = 9, band: BandConfig = BandConfig()) -> DataFrame:
    """Aligned positions of every read that passes quality limits.

    ``reads``: read_id, raw, basecall, reference (both in sequencing direction), ref_start, ref_end, is_reverse,
    ref_to_query (array by reference index). A read is one row, so memory is bounded by the longest read.
    """
    levels = SparkSession.active().sparkContext.broadcast(model_arrays(model, k))

    def run(batches):
        mean, sd = levels.value
        for b in batches:
            for row in b.to_pylist():
                raw, q = np.array(row["raw"], float), dict(enumerate(row["ref_to_query"]))
                got = align_read(raw, row["basecall"], row["reference"], q, mean, sd, k, band)
                if got is None:
                    continue
                aligned, found, scaling, banded = got
                out = []
                for a in aligned:
                    at = row["ref_end"] - a.base - k // 2 - 1 if row["is_reverse"] else row["ref_start"] + a.base + k // 2
                    start, n = found[a.event][:2]
                    kmer = row["reference"][a.base:a.base + k]
                    level = float(mean[align.kmer_indexes(kmer, k)[0]])
                    out.append({"read_id": row["read_id"], "coord": at, "base": a.base, "kmer": kmer if a.match else "N" * k, "event": a.event, "is_match": a.match, "signal": scaling(raw[start:start + n]).tolist(), "shift": scaling.shift, "scale": scaling.scale, "average_log": banded.average_log, "longest_gap": banded.longest_gap, "model_mean": level if a.match else 0.0})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("read_id", pa.string()), ("coord", pa.int64()), ("base", pa.int32()), ("kmer", pa.string()), ("event", pa.int32()), ("is_match", pa.bool_()), ("signal", pa.list_(pa.float64())), ("shift", pa.float64()), ("scale", pa.float64()), ("average_log", pa.float64()), ("longest_gap", pa.int32()), ("model_mean", pa.float64())]))

    lean = reads.select("read_id", "raw", "basecall", "reference", "ref_start", "ref_end", "is_reverse", "ref_to_query")
    return lean.mapInArrow(run, SCHEMA)


def positions(aligned: DataFrame, depth: int = 20) -> DataFrame:
    """(read_id, coord, kmer, signal): samples of a position's matches in order, for the call model."""
    matched = aligned.where("is_match").groupBy("read_id", "coord", "kmer").agg(F.array_sort(F.collect_list(F.struct("event", "signal"))).alias("s"))
    return matched.select("read_id", "coord", "kmer", F.flatten(F.transform("s", lambda x: x["signal"])).alias("signal"))
