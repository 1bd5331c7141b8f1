"""Registered queries of the operators, over the tables at hand.

``events`` stand for molecules: a user is a read, a timestamp in microseconds a coordinate, clicks and views are
positive EdU calls, purchases and signups positive BrdU calls. Thresholds are scaled to days.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle, tables
from .config import AlignmentFilter, BreakConfig, ForkConfig, GmmConfig
from .functions import cigar, logmath, modtags, seq
from .operators import breaks, density, forks, fractions, lookup, match, segment, stall
from .plans import forksense
from .signal import align, events as detection
from .signal import model as call_model
from .streaming import calls as streaming
from .training import gmm

DAY = 86_400_000_000
CONFIG = ForkConfig(radius=2 * DAY, min_segment=DAY // 2, trim_span=5 * DAY, stitch_gap=2 * DAY + DAY // 12, pair_gap=300_000_000_000, stall_rows=10, stall_radius=2 * DAY, stall_attempts=3, fraction_span=DAY, fraction_calls=3, min_calls=60)
DENSITY = 0.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} AS TIMESTAMP_NTZ))")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").alias("read_id"), micros("ts").alias("coord"),
        F.when(F.col("event_type").isin("click", "view"), 1.0).otherwise(0.0).alias("p_edu"), F.when(F.col("event_type").isin("purchase", "signup"), 1.0).otherwise(0.0).alias("p_brdu"),
    )
    return rows.withColumn("idx", (F.row_number().over(Window.partitionBy("read_id").orderBy("coord")) - 1).cast("long"))


def labelled(spark, sf_dir):
    return density.label_calls(calls(spark, sf_dir), DENSITY, DENSITY, CONFIG)


def density_labels(spark, sf_dir):
    """Label of every call."""
    return labelled(spark, sf_dir).select("read_id", "coord", F.coalesce("label", F.lit("ambiguous")).alias("label"))


def label_segments(spark, sf_dir):
    """Islands of both analogues."""
    return segment.segments(labelled(spark, sf_dir), CONFIG)


def trim_segments(spark, sf_dir):
    """Islands with sparse ends trimmed."""
    rows = labelled(spark, sf_dir)
    return segment.trim(segment.segments(rows, CONFIG), rows, CONFIG)


def spans(spark, sf_dir):
    return forksense.find_segments(labelled(spark, sf_dir), CONFIG)


def stitch_segments(spark, sf_dir):
    """Trimmed islands joined across short gaps."""
    return spans(spark, sf_dir)


def _sides(spark, sf_dir):
    found = tables.written(spans(spark, sf_dir), "segments")
    return found.where("label = 'E'"), found.where("label = 'B'")


_PAIR = ["read_id", "a_left_coord", "a_right_coord", "b_left_coord", "b_right_coord", "distance"]


def right_forks(spark, sf_dir):
    """Pairs of segments that a right-moving fork left."""
    return match.right_pairs(*_sides(spark, sf_dir), CONFIG).select(*_PAIR)


def left_forks(spark, sf_dir):
    """Pairs of segments that a left-moving fork left."""
    return match.left_pairs(*_sides(spark, sf_dir), CONFIG).select(*_PAIR)


def _bounds(spark, sf_dir):
    return forks.bounds(forks.paired(*_sides(spark, sf_dir), CONFIG))


_NUMBERS = ["brdu_in_first", "edu_in_first", "edu_in_second", "brdu_in_second"]


def fork_bounds_signature(spark, sf_dir):
    """Fork bounds and the seven stress numbers."""
    found = forks.signatures(_bounds(spark, sf_dir), calls(spark, sf_dir), CONFIG)
    return found.select("read_id", "direction", "left_coord", "left_idx", "right_coord", "right_idx", "tip_partners", "length", "first_length", "second_length", *[F.round(c, 6).alias(c) for c in _NUMBERS])


def origins(spark, sf_dir):
    """Regions between diverging forks."""
    found = tables.written(_bounds(spark, sf_dir), "forks")
    return match.origins(found.where("direction = 'left'"), found.where("direction = 'right'"))


def terminations(spark, sf_dir):
    """Regions between converging forks."""
    found = tables.written(_bounds(spark, sf_dir), "forks")
    return match.terminations(found.where("direction = 'left'"), found.where("direction = 'right'"))


def stall_scores(spark, sf_dir):
    """Score of every fork tip; tips without one have null."""
    found = stall.stall_scores(_bounds(spark, sf_dir), calls(spark, sf_dir), "p_brdu", CONFIG)
    return found.select("read_id", "direction", "left_coord", "right_coord", F.round("score", 6).alias("score"))


def paint_labels(spark, sf_dir):
    """Segment flags of every call."""
    return segment.paint(calls(spark, sf_dir), spans(spark, sf_dir)).select("read_id", "coord", "edu", "brdu")


def read_gate(spark, sf_dir):
    """Calls of molecules with more than the least number of them, counted."""
    return segment.enough_calls(calls(spark, sf_dir), CONFIG).groupBy("read_id").agg(F.count("*").alias("n"))


def call_fractions(spark, sf_dir):
    """Call fractions of windows that end by distance and count."""
    found = fractions.call_fractions(calls(spark, sf_dir), CONFIG)
    return found.select("read_id", "window", F.round("brdu_fraction", 6).alias("brdu_fraction"), F.round("edu_fraction", 6).alias("edu_fraction"))


def two_means(spark, sf_dir):
    """Two clusters of EdU fractions."""
    m = fractions.two_means(tables.written(fractions.call_fractions(calls(spark, sf_dir), CONFIG), "fractions"), "edu_fraction")
    names = ["centroid_1", "lower_1", "deviation_1", "centroid_2", "lower_2", "deviation_2"]
    return spark.createDataFrame([tuple(None if getattr(m, n) is None else round(getattr(m, n), 6) for n in names)], ", ".join(f"{n} double" for n in names))


def sized_segments(spark, sf_dir):
    """Number and length of segments of each analogue: population deviation, as all summaries here."""
    size = (F.col("right_coord") - F.col("left_coord")) / 60_000_000
    return spans(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(size), 6).alias("mean_minutes"), F.round(F.stddev_pop(size), 6).alias("sd_minutes"))


# Breaks, over lineitem as fork lines


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    start = F.floor("l_extendedprice") % 8000 + 2500
    rows = li.select(
        F.col("l_orderkey").alias("read_id"), "l_returnflag", start.cast("long").alias("start"), (start + 500 + F.col("l_partkey") % 5000).cast("long").alias("end"),
        F.lit(0).cast("long").alias("read_start"), (15000 + (F.col("l_orderkey") % 7) * 1500).cast("long").alias("read_end"), F.col("l_suppkey").alias("supp"),
    )
    return breaks.fork_lines(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'")).drop("l_returnflag")


def _tracks(lines):
    tip = F.when(F.col("supp") % 5 == 0, 1).otherwise(0)  # some tracks don't share the fork's tip
    rows = lines.select(
        "read_id", F.when(F.col("is_right"), F.col("start") + 100).otherwise(F.col("start") + tip).alias("start"), F.when(F.col("is_right"), F.col("end") + tip).otherwise(F.col("end") - 100).alias("end"), F.lit(1).alias("line"),
    )
    return rows


def dup_reads_anti(spark, sf_dir):
    """Fork lines of molecules that have one only."""
    return breaks.single_lines(_lines(spark, sf_dir)).select("read_id", "is_right", "start", "end")


def _known(spark, sf_dir):
    single = breaks.single_lines(_lines(spark, sf_dir))
    return breaks.with_track(single, _tracks(single))


def track_join(spark, sf_dir):
    """Forks with the track that shares their tip."""
    return _known(spark, sf_dir).select("read_id", "is_right", "start", "end", "track_start", "track_end")


def track_stats(spark, sf_dir):
    """Interior track lengths: mean, deviation and the least read length from them."""
    return breaks.length_stats(breaks.interior_lengths(_known(spark, sf_dir))).select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "min_read_length")


_TOLERANCES = BreakConfig().tolerances


def runoff_observed(spark, sf_dir):
    """Observed run-off at each tolerance."""
    return breaks.observed_by_tolerance(_known(spark, sf_dir), _TOLERANCES).select("tolerance", F.round("p", 6).alias("p"), "n")


def _expected(spark, sf_dir):
    reads = table(spark, sf_dir, "orders").select(F.lit(0).alias("read_start"), (15000 + (F.col("o_orderkey") % 7) * 1500).alias("read_end"))
    return breaks.expected_by_tolerance(reads, breaks.interior_lengths(_known(spark, sf_dir)), _TOLERANCES)


def runoff_expected(spark, sf_dir):
    """Expected run-off at each tolerance, in closed form."""
    return _expected(spark, sf_dir).select("tolerance", F.round("p", 6).alias("p"))


def runoff_ci(spark, sf_dir):
    """Observed less expected run-off with its interval."""
    seen = breaks.observed_by_tolerance(_known(spark, sf_dir), _TOLERANCES)
    n = F.max("n")
    both = breaks.difference(breaks.pooled(seen, F.col("n")), breaks.pooled(_expected(spark, sf_dir).crossJoin(seen.agg(n.alias("n"))), F.col("n")))
    return both.select(*[F.round(c, 6).alias(c) for c in both.columns])


# Lookups


def read_filter(spark, sf_dir):
    """Lines of enough quality and length."""
    li = table(spark, sf_dir, "lineitem")
    a = li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("mapq"), F.lit(0).alias("ref_start"), (F.col("l_extendedprice") / 10).cast("int").alias("ref_end"), F.col("l_returnflag").alias("seq"))
    return lookup.usable(a, AlignmentFilter(20, 1000)).groupBy("seq").agg(F.count("*").alias("n"), F.sum("ref_end").alias("bases"))


def _index(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("read_id"), F.col("c_name").alias("path"))


def _reads(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("read_id"), "o_orderkey")


def index_join(spark, sf_dir):
    """Reads that the index knows."""
    return lookup.with_index(_reads(spark, sf_dir), _index(spark, sf_dir)).select("o_orderkey", "read_id", "path")


def index_missing(spark, sf_dir):
    """Reads that the index doesn't know: documents that are not labelled."""
    index = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("read_id"))
    return lookup.missing_from(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), "n_chars"), index).select("read_id", "n_chars")


def signal_join(spark, sf_dir):
    """Customers as reads, every other one split from a parent, with the signal that is stored for them."""
    k = F.col("c_custkey")
    reads = table(spark, sf_dir, "customer").select(k.alias("read_id"), F.when(k % 2 == 0, k % 97).alias("pi"))
    signals = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("read_id"), F.size("embedding").alias("n_samples"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))
    return lookup.with_signal(reads, signals).select("read_id", "pi", "n_samples", "first")


def reference_substring(spark, sf_dir):
    """Orders as alignments to the sequences, with the bases that they cover; short tiles, so that most span several."""
    k = F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select(k.alias("read_id"), (k % 40).alias("contig"), (F.col("o_custkey") % 60).alias("ref_start"), (F.col("o_custkey") % 60 + 1 + k % 70).alias("ref_end"))
    return lookup.reference_slices(a, sequences(spark, sf_dir).withColumnRenamed("item_id", "contig"), tile=16).select("read_id", "contig", "ref_start", "reference")


def event_calls(spark, sf_dir):
    """Every call's place with the calls of molecules that have enough of them."""
    c = calls(spark, sf_dir)
    return lookup.with_calls(c.select("read_id", "coord", "idx"), segment.enough_calls(c, CONFIG)).select("read_id", "coord", "idx", "p_edu", "p_brdu")


def prefix_sums(spark, sf_dir):
    """Running sums of every supplier's quantities, summed up."""
    rows = detection.prefix_sums(table(spark, sf_dir, "lineitem").select("l_suppkey", *_ORDER), "l_suppkey", _ORDER, "l_quantity")
    return rows.groupBy("l_suppkey").agg(F.round(F.max("sum"), 2).alias("total"), F.round(F.max("sum_sq"), 2).alias("squares"), F.round(F.sum("sum"), 2).alias("area"))


def densities(spark, sf_dir):
    """Log normal, uniform and Cauchy densities of quantities, summed for every part."""
    x = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.round(F.sum(logmath.log_normal_density(F.lit(25.0), F.lit(9.0), x)), 5).alias("log_normal"), F.round(F.sum(logmath.uniform_density(F.lit(10.0), F.lit(30.0), x)), 6).alias("uniform"),
        F.round(F.sum(logmath.cauchy_density(F.lit(20.0), F.lit(4.0), x)), 6).alias("cauchy"),
    )


def index_latest(spark, sf_dir):
    """One index row for each id: the last."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("read_id"), F.col("o_orderkey").alias("line"), "o_orderstatus")
    return lookup.latest(rows, "read_id", "line")


def basename_join(spark, sf_dir):
    """Files found by their last path component."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    names = pages.select(lookup.basename(F.col("path")).alias("filename")).where("filename <> ''").distinct()
    return lookup.by_basename(names, "filename", pages, "path")


def path_parts(spark, sf_dir):
    """Base, extension and stem of every page's address."""
    u = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", lookup.basename(u).alias("base"), lookup.extension(u).alias("ext"), lookup.without_extension(u).alias("stem"))


def semi_targets(spark, sf_dir):
    """Documents that are labelled."""
    return lookup.restricted(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")


def topn_per_key(spark, sf_dir):
    """First five lines of each part."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return lookup.top_per_key(li, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"], 5)


def collect_signal(spark, sf_dir):
    """Values of every user in order, at a fixed depth."""
    rows = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("at"), "value")
    lists = lookup.collected(rows, ["user_id"], "at", "value", 20)
    return lists.select("user_id", F.round(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.size("values").alias("depth"), F.round(F.element_at("values", 1), 6).alias("first"))


def bedgraph_intervals(spark, sf_dir):
    """Half-open intervals between a user's events."""
    c = calls(spark, sf_dir)
    start = c.groupBy("read_id").agg((F.min("coord") - 1).alias("ref_start"))
    return lookup.intervals(c.join(start, "read_id"), "read_id", "coord", F.col("ref_start")).select("read_id", "interval_start", "interval_end", "p_edu")


def shards(spark, sf_dir):
    """Shard of every document, 300 to a folder."""
    return lookup.sharded(table(spark, sf_dir, "documents").select("doc_id").distinct(), "doc_id")


# Scaling and clustering


def _quantiles(spark, sf_dir, value):
    return lookup.quantile_medians(table(spark, sf_dir, "lineitem"), "l_suppkey", value)


def quantile_scaling(spark, sf_dir):
    """Line through ten quantile medians of quantity and price of every supplier."""
    x = _quantiles(spark, sf_dir, "l_quantity").withColumnRenamed("median", "x")
    y = _quantiles(spark, sf_dir, "l_extendedprice").withColumnRenamed("median", "y")
    both = x.join(y, ["l_suppkey", "part"])
    return both.groupBy("l_suppkey").agg(F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.round(F.regr_intercept("y", "x"), 3).alias("intercept"))


_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]


def theil_sen(spark, sf_dir):
    """Upper-median line through thinned points of every supplier."""
    rows = lookup.thinned(table(spark, sf_dir, "lineitem").select("l_suppkey", *_ORDER), "l_suppkey", _ORDER)
    return lookup.theil_sen(rows, "l_suppkey", "l_quantity", "l_extendedprice").select("l_suppkey", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


def prefix_tstat(spark, sf_dir):
    """Windowed t-statistic of quantities, summed for every supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", *_ORDER)
    t = detection.windowed_t(rows, "l_suppkey", _ORDER, "l_quantity", 3)
    return t.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("t") > 1.4, 1)).alias("above"), F.round(F.max(F.when(F.col("t") < 1e6, F.col("t"))), 4).alias("most"))


def event_segments(spark, sf_dir):
    """Events detected in the sequence of every supplier's quantities."""
    lists = lookup.collected(table(spark, sf_dir, "lineitem").select("l_suppkey", F.struct(*_ORDER).alias("o"), "l_quantity"), ["l_suppkey"], "o", "l_quantity")
    return detection.detect_events(lists, key="l_suppkey", signal="values")


def dbscan_noise(spark, sf_dir):
    """Rows in sparse stretches of every supplier's prices."""
    rows = lookup.noise(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice"), "l_suppkey", "l_extendedprice", 300.0, 0.025)
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_noise"), 1)).alias("noise"))


def gmm_loglik(spark, sf_dir):
    """Log likelihood of every part's quantities under two fixed components."""
    x = F.col("l_quantity")
    p = 0.5 * logmath.normal_density(F.lit(15.0), F.lit(8.0), x) + 0.5 * logmath.normal_density(F.lit(35.0), F.lit(8.0), x)
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.sum(F.log(p)), 5).alias("log_likelihood"))


def gmm_fit(spark, sf_dir):
    """Mixtures of the quantities of every kind of line."""
    li = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("kmer"), F.col("l_quantity").alias("level"))
    model = li.select("kmer").distinct().select("kmer", F.lit(15.0).alias("mean"), F.lit(8.0).alias("sd"))
    return gmm.train(li, model, GmmConfig(eps=2.0, min_points=0.001))


# Sequences


def sequences(spark, sf_dir):
    """Benchmark texts with their letters folded onto bases."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "benchmark").select("item_id", F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ATGCATGCATGCATGCATGCATGCAT").alias("seq"))


def kmer_counts(spark, sf_dir):
    """Overlapping 5-mers."""
    return sequences(spark, sf_dir).select(F.explode(seq.kmers(F.col("seq"), 5)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def kmer_index(spark, sf_dir):
    """Indexes of the distinct 9-mers."""
    k = sequences(spark, sf_dir).select(F.explode(seq.kmers(F.col("seq"), 9)).alias("kmer")).distinct()
    return k.select("kmer", seq.kmer_index(F.col("kmer")).alias("idx"), seq.core_index(F.col("kmer")).alias("core"), seq.residual_index(F.col("kmer")).alias("residual"))


def all_kmers(spark, sf_dir):
    """Every 4-mer in the order of its index."""
    return seq.all_kmers(spark, 4)


def revcomp(spark, sf_dir):
    """Reverse complements, base counts and whether a sequence is bases only."""
    s = F.col("seq")
    return sequences(spark, sf_dir).select("item_id", seq.reverse_complement(s).alias("rc"), seq.base_count(s, "T").alias("n_t"), seq.defined(s).alias("defined"))


def positions_of_interest(spark, sf_dir):
    """Thymidines away from both ends."""
    return sequences(spark, sf_dir).select("item_id", F.explode(seq.thymidine_positions(F.col("seq"), 12)).alias("place"))


def kmer_model_join(spark, sf_dir):
    """Levels of every sequence's 5-mers under a derived model, scaled."""
    model = seq.all_kmers(spark, 5).select("kmer", (F.col("kmer_index") % 97 + 0.5).alias("mean"))
    k = sequences(spark, sf_dir).select("item_id", F.explode(seq.kmers(F.col("seq"), 5)).alias("kmer")).join(F.broadcast(model), "kmer")
    return k.groupBy("item_id").agg(F.round(F.avg((F.col("mean") - 10) / 2), 6).alias("level"))


# Tags and alignments


def _marked(spark, sf_dir):
    c = calls(spark, sf_dir)
    return c.select("read_id", (F.col("idx") * 3 + F.col("coord") % 3).alias("query_idx"), ((F.col("coord") % 256) / 255).alias("p_brdu"), ((F.col("coord") % 101) / 101).alias("p_edu"))


def mm_encode(spark, sf_dir):
    """Skipped bases before every call."""
    return modtags.deltas(_marked(spark, sf_dir), "read_id", "query_idx").select("read_id", "query_idx", "delta")


def mm_roundtrip(spark, sf_dir):
    """Tags of every molecule written and read back."""
    back = modtags.decode(modtags.encode(_marked(spark, sf_dir)))
    return back.groupBy("read_id", "query_idx").agg(F.max(F.when(F.col("code") == "b", F.col("value"))).alias("b"), F.max(F.when(F.col("code") == "e", F.col("value"))).alias("e"))


def ml_quantise(spark, sf_dir):
    """Probabilities as bytes."""
    return _marked(spark, sf_dir).select(modtags.quantise(F.col("p_edu")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def _alignments(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(k % 4 + 1, F.lit("S"), k % 5 + 3, F.lit("M"), k % 3 + 1, F.lit("I"), k % 4 + 2, F.lit("M"), k % 2 + 1, F.lit("D"), k % 6 + 2, F.lit("M"))
    return o.select(k.alias("read_id"), (k * 7).alias("pos"), (k % 2 == 1).alias("is_reverse"), text.alias("cigar")).withColumn("ops", cigar.parse(F.col("cigar")))


def cigar_refend(spark, sf_dir):
    """Reference ends from operations."""
    return _alignments(spark, sf_dir).select("read_id", cigar.reference_end(F.col("pos"), F.col("ops")).alias("ref_end"), cigar.has_long_indel(F.col("ops"), 2).alias("long_indel"))


def cigar_map(spark, sf_dir):
    """Reference to query, summed for every alignment."""
    m = cigar.reference_to_query(_alignments(spark, sf_dir))
    return m.groupBy("read_id").agg(F.count("*").alias("n"), F.sum(F.col("ref_idx") * F.col("query_idx")).alias("mix"), F.count(F.when(F.col("is_del"), 1)).alias("deleted"))


def query_spans(spark, sf_dir):
    """Distance on the query between the first and last reference base of every alignment, by strand."""
    a = _alignments(spark, sf_dir).withColumn("ref_start", F.col("pos")).withColumn("ref_end", cigar.reference_end(F.col("pos"), F.col("ops")))
    ends = a.select("read_id", F.when(F.col("is_reverse"), F.col("ref_start") + 1).otherwise(F.col("ref_start")).alias("left_coord"), F.when(F.col("is_reverse"), F.col("ref_end")).otherwise(F.col("ref_end") - 1).alias("right_coord"))
    return forks.query_span(ends, a).select("read_id", "query_span")


# Probabilities and models


def log_space(spark, sf_dir):
    """Sums and densities in log space."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    x = F.abs(F.col("x").cast("double"))
    rows = e.withColumn("a", logmath.log_of(x)).withColumn("b", logmath.log_of(x * x))
    return rows.groupBy("vec_id").agg(F.round(F.sum(logmath.exp_of(logmath.log_sum(F.col("a"), F.col("b")))), 5).alias("total"), F.count(F.when(logmath.log_greater(F.col("a"), F.col("b")), 1)).alias("greater"))


def _model_rows(spark, sf_dir, names: str, each):
    """A row of numbers for every embedding taken as a signal, by batches."""
    columns = names.split(", ")

    def run(batches):
        for b in batches:
            rows = [(i, *each(np.array(v or [], float))) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.float64()) for k in range(len(columns))], [c.split()[0] for c in columns])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, names)


def _levels(x, low: float, high: float, least: int):
    """Evenly spaced levels, one for every two values of a signal, ``least`` at least, and their deviations."""
    n = max(least, -(-len(x) // 2))
    return np.linspace(low, high, n), np.full(n, 0.2)


def hmm_forward(spark, sf_dir):
    """Log likelihood ratio of two level models for every signal."""
    t = align.Transitions.of(1.5, literal=False)
    return _model_rows(spark, sf_dir, "vec_id long, log_ratio double", lambda x: (round(align.log_likelihood_ratio(x, _levels(x, -0.3, 0.3, 12), _levels(x, -0.2, 0.4, 12), t), 6),))


def viterbi(spark, sf_dir):
    """Best path of every signal through a base for every two values: score and states."""
    t = align.Transitions.of(1.5, literal=False)

    def each(x):
        score, path = align.viterbi(x, *_levels(x, -0.3, 0.3, 12), t)
        return round(score, 6), float(sum(s == "M" for _, s in path)), float(sum(s == "D" for _, s in path))

    return _model_rows(spark, sf_dir, "vec_id long, score double, matches double, deletions double", each)


def banded_align(spark, sf_dir):
    """Banded alignment of every signal to its own shape."""

    def each(x):
        got = align.banded_alignment(x, *_levels(x, -0.3, 0.3, 20), align.Scaling(0.0, 1.0))
        return round(got.average_log, 6), float(len(got.pairs)), float(got.longest_gap)

    return _model_rows(spark, sf_dir, "vec_id long, average_log double, pairs double, longest_gap double", each)


def model_calls(spark, sf_dir):
    """Calls of the stub model at every thymidine 9-mer of the sequences."""
    k = sequences(spark, sf_dir).select("item_id", F.posexplode(seq.kmers(F.col("seq"), 9)).alias("place", "kmer"))
    rows = call_model.features(k.withColumn("signal", F.array((F.col("place") % 7 / 7.0), (F.col("place") % 5 / 5.0))))
    found = call_model.call(call_model.thymidine_calls(rows), call_model.LogisticStub)
    return found.select("item_id", "place", "kmer", F.round("p_brdu", 6).alias("p_brdu"), F.round("p_edu", 6).alias("p_edu"))


# Streams


def _drained(spark, sf_dir, label, build):
    """A streaming aggregate over the events that are there, as the table its last state wrote."""
    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = tables.scratch(spark, label)
    query = build(stream).writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def _stamped(df):
    """Window bounds in microseconds, apart from the session's time zone."""
    zone = F.current_timezone()
    return df.select(*[F.unix_micros(F.to_utc_timestamp(F.from_utc_timestamp(c, zone), zone)).alias(c) if c.startswith("window_") else F.col(c) for c in df.columns])


def _totals():
    return F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")


def stream_tumbling(spark, sf_dir):
    """Events of every day by kind, from a stream."""
    return _stamped(_drained(spark, sf_dir, "tumbling", lambda s: streaming.tumbling(s, "ts", "1 day", "1 hour", ["event_type"], *_totals())))


def stream_sliding(spark, sf_dir):
    """Events of overlapping days, from a stream."""
    return _stamped(_drained(spark, sf_dir, "sliding", lambda s: streaming.sliding(s, "ts", "1 day", "12 hours", "1 hour", [], *_totals())))


def stream_session(spark, sf_dir):
    """Sessions of every user, from a stream."""
    return _stamped(_drained(spark, sf_dir, "session", lambda s: streaming.sessions(s, "ts", "6 hours", "1 hour", ["user_id"], F.count("*").alias("n"))))


def stream_fractions(spark, sf_dir):
    """Call-fraction windows that a stream of calls closes."""
    batch = calls(spark, sf_dir).select("read_id", "coord", "p_edu", "p_brdu")
    source, out = tables.scratch(spark, "calls"), tables.scratch(spark, "fractions")
    batch.repartitionByRange(4, "coord").write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    streaming.run_available(streaming.fractions(stream, CONFIG), "parquet", out, f"{out}-state")
    return spark.read.parquet(out).select("read_id", "start", "n", F.round("brdu_fraction", 6).alias("brdu_fraction"), F.round("edu_fraction", 6).alias("edu_fraction"))


_REGISTERED = (
    density_labels, label_segments, trim_segments, stitch_segments, right_forks, left_forks, fork_bounds_signature, origins, terminations, stall_scores, paint_labels, read_gate, call_fractions, two_means, sized_segments,
    dup_reads_anti, track_join, track_stats, runoff_observed, runoff_expected, runoff_ci, read_filter, index_join, index_missing, signal_join, reference_substring, event_calls, prefix_sums, densities, index_latest, basename_join, path_parts, semi_targets, topn_per_key, collect_signal,
    bedgraph_intervals, shards, quantile_scaling, theil_sen, prefix_tstat, event_segments, dbscan_noise, gmm_loglik, gmm_fit, kmer_counts, kmer_index, all_kmers, revcomp, positions_of_interest, kmer_model_join,
    mm_encode, mm_roundtrip, ml_quantise, cigar_refend, cigar_map, query_spans, log_space, hmm_forward, viterbi, banded_align, model_calls, stream_tumbling, stream_sliding, stream_session, stream_fractions,
)


def queries() -> dict:
    return {f.__name__: f for f in _REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracle.SQL.items() if name in queries()}
