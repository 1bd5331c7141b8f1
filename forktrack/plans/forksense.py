"""Calls to segments, forks, origins, terminations and scores, in one plan over each read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..config import ForkConfig
from ..operators import density, forks, fractions, match, segment, stall


@dataclass(frozen=True)
class ForkTables:
    """What the analysis finds; every table is lazy."""

    labelled: DataFrame
    segments: DataFrame
    forks: DataFrame
    origins: DataFrame
    terminations: DataFrame
    painted: DataFrame


def densities(calls: DataFrame, config: ForkConfig = ForkConfig()) -> tuple[float, float]:
    """Least densities (EdU, BrdU) from the incorporation that the calls show."""
    found = fractions.incorporation(fractions.call_fractions(calls, config), config)
    return density.least_density(found["edu"][1], config), density.least_density(found["brdu"][1], config)


def find_segments(labelled: DataFrame, config: ForkConfig = ForkConfig(), trim: bool = True) -> DataFrame:
    """Segments of both analogues: islands, trimmed, then stitched."""
    found = segment.segments(labelled, config)
    return segment.stitch(segment.trim(found, labelled, config) if trim else found, config)


def analyse(calls: DataFrame, edu_density: float, brdu_density: float, config: ForkConfig = ForkConfig(), edu_first: bool = True, trim: bool = True) -> ForkTables:
    """All tables of the analysis; segments and forks, which several others use, are written once."""
    labelled = density.label_calls(calls, edu_density, brdu_density, config)
    found = tables.written(find_segments(labelled, config, trim), "segments")
    first, second = ("E", "B") if edu_first else ("B", "E")
    pairs = forks.paired(found.where(F.col("label") == first), found.where(F.col("label") == second), config)
    bounds = forks.signatures(forks.bounds(pairs), calls, config)
    scored = tables.written(stall.stall_scores(bounds, calls, "p_brdu" if edu_first else "p_edu", config), "forks")
    left, right = scored.where("direction = 'left'"), scored.where("direction = 'right'")
    partnered = pairs.select("read_id", F.explode(F.array(
        F.struct(F.lit(first).alias("label"), F.col("a_left_coord").alias("left_coord")), F.struct(F.lit(second).alias("label"), F.col("b_left_coord").alias("left_coord")),
    )).alias("s")).select("read_id", "s.*").distinct()
    ours = found.join(partnered, ["read_id", "label", "left_coord"], "left_semi")
    painted = segment.paint(calls.join(ours.select("read_id").distinct(), "read_id", "left_semi"), ours)
    return ForkTables(labelled, found, scored, match.origins(left, right), match.terminations(left, right), painted)


def bed_families(found: ForkTables, reads: DataFrame, cigar_map: DataFrame | None = None) -> dict[str, DataFrame]:
    """BED rows of every feature, with the columns of its family; ``reads``: read_id, contig, ref_start, ref_end, strand.

    With ``cigar_map`` (read_id, ref_idx, query_idx), as alignments with tags have, forks get their span on the query;
    without one, as for text input, it is -1.
    """
    r = reads.select("read_id", "contig", F.col("ref_start").alias("read_start"), F.col("ref_end").alias("read_end"), "strand")
    base = ["contig", "start", "end", "read_id", "read_start", "read_end", "strand"]
    numbers = ["length", "first_length", "second_length", "brdu_in_first", "edu_in_first", "edu_in_second", "brdu_in_second"]

    def spans(df):
        return df.withColumnsRenamed({"left_coord": "start", "right_coord": "end"}).join(r, "read_id")

    out = {"origins": found.origins.join(r, "read_id").select(*base), "terminations": found.terminations.join(r, "read_id").select(*base)}
    for name, label in (("edu_regions", "E"), ("brdu_regions", "B")):
        out[name] = spans(found.segments.where(F.col("label") == label)).select(*base)
    for side in ("left", "right"):
        own = found.forks.where(F.col("direction") == side)
        if cigar_map is None:
            own = own.withColumn("query_span", F.lit(-1))
        else:
            own = forks.query_span(own, reads.withColumn("is_reverse", F.col("strand") == "rev"), cigar_map).withColumn("query_span", F.coalesce("query_span", F.lit(-1)))
        rows = spans(own)
        out[f"{side}_forks"] = rows.select(*base, "query_span", "score")
        out[f"{side}_signatures"] = rows.select(*base, *numbers, "score")
    return out
