"""Readers of the domain's text formats, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq

#: Columns of the BED families; the second is one line per fork, the last adds the stress signature.
REGION = "contig string, start int, end int, read_id string, read_start int, read_end int, strand string"
FORK = REGION + ", query_span int, score double"
LEGACY_FORK = REGION + ", score double"
SIGNATURE = REGION + ", length double, first_length double, second_length double, f4 double, f5 double, f6 double, f7 double, score double"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, body): one row for each record that starts with ``>``; comment lines are dropped.

    Records are split by Spark's text reader at ``\\n>``, so that no line depends on one in another task.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"))
    lines = F.filter(F.split("value", "\r?\n"), lambda s: (F.trim(s) != "") & ~s.startswith("#"))
    rows = rows.where(~F.col("value").startswith("#")).select(lines.alias("lines")).where(F.size("lines") > 0)
    return rows.select(F.get("lines", F.lit(0)).alias("header"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("body"))


def _cells(column: str, separator: str) -> list:
    """Seven cells of a line, null where it is shorter."""
    parts = F.split(column, separator)
    return [F.get(parts, F.lit(i)) for i in range(7)]


def _headers(records: DataFrame) -> DataFrame:
    h = F.split(F.trim("header"), r"\s+")
    cell = [F.get(h, F.lit(i)) for i in range(5)]
    return records.select(cell[0].alias("read_id"), cell[1].alias("contig"), cell[2].cast("int").alias("ref_start"), cell[3].cast("int").alias("ref_end"), cell[4].alias("strand"), "body")


def read_calls(spark: SparkSession, path: str, min_calls: int = 0) -> DataFrame:
    """Per-base calls: read header columns, idx, coord, p_edu, p_brdu, kmer (null where the file has none)."""
    reads = _headers(read_records(spark, path)).where(F.size("body") > min_calls)
    rows = reads.select("read_id", "contig", "ref_start", "ref_end", "strand", F.posexplode("body").alias("idx", "line"))
    p = _cells("line", r"\s+")
    return rows.select("read_id", "contig", "ref_start", "ref_end", "strand", "idx", p[0].cast("long").alias("coord"), p[1].cast("double").alias("p_edu"), p[2].cast("double").alias("p_brdu"), p[3].alias("kmer"))


def read_bounds(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    """(read_id, contig, read_start, read_end) of a calls file's reads of enough length."""
    reads = _headers(read_records(spark, path)).select("read_id", "contig", F.col("ref_start").alias("read_start"), F.col("ref_end").alias("read_end"))
    return reads.where(F.col("read_end") - F.col("read_start") >= min_length)


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """Segment text: read header columns, idx, coord, edu, brdu."""
    rows = _headers(read_records(spark, path)).select("read_id", "contig", "ref_start", "ref_end", "strand", F.posexplode("body").alias("idx", "line"))
    p = _cells("line", r"\s+")
    return rows.select("read_id", "contig", "ref_start", "ref_end", "strand", "idx", p[0].cast("long").alias("coord"), p[1].cast("int").alias("edu"), p[2].cast("int").alias("brdu"))


def read_aligned(spark: SparkSession, path: str) -> DataFrame:
    """Event alignment text: coord, kmer_ref, signal, kmer_strand, model_mean, p_edu, p_brdu; insertions keep their Ns."""
    rows = _headers(read_records(spark, path)).select("read_id", "contig", "ref_start", "ref_end", "strand", F.posexplode("body").alias("idx", "line"))
    p = _cells("line", "\t")
    cells = [p[0].cast("long").alias("coord"), p[1].alias("kmer_ref"), p[2].cast("double").alias("signal"), p[3].alias("kmer_strand"), p[4].cast("double").alias("model_mean"), p[5].cast("double").alias("p_edu"), p[6].cast("double").alias("p_brdu")]
    return rows.select("read_id", "contig", "ref_start", "ref_end", "strand", "idx", *cells)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, seq): the first word of a name, the sequence in upper case without white space."""
    rows = read_records(spark, path)
    return rows.select(F.get(F.split(F.trim("header"), r"\s+"), F.lit(0)).alias("contig"), F.upper(F.regexp_replace(F.array_join("body", ""), r"\s+", "")).alias("seq"))


def check_fasta(contigs: DataFrame) -> DataFrame:
    """Contigs, refusing letters outside the IUPAC code."""
    bad = F.col("seq").rlike("[^ATGCNURYKMSWBDHV]")
    return contigs.withColumn("seq", F.when(bad, F.raise_error(F.concat(F.lit("not a nucleotide sequence: "), "contig")).cast("string")).otherwise(F.col("seq")))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Read index: read_id, batch, row, path."""
    return spark.read.csv(path, sep="\t", schema="read_id string, batch long, row long, path string", comment="#")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Sequencing summary, columns found by header: (read_id, filename)."""
    rows = spark.read.csv(path, sep="\t", header=True)
    names = [c for c in ("filename", "filename_fast5") if c in rows.columns]
    if not names or "read_id" not in rows.columns:
        raise ValueError("a sequencing summary needs the columns read_id and filename or filename_fast5")
    return rows.select("read_id", F.coalesce(*names).alias("filename"))


def list_signal_files(spark: SparkSession, path: str) -> DataFrame:
    """Sorted paths of signal files under a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{fast5,pod5}").load(path)
    return found.select("path").orderBy("path")


def read_pore_model(spark: SparkSession, path: str, fitted: bool = False, k: int = 9, sd: float = 0.14) -> DataFrame:
    """(kmer, kmer_idx, mean, sd) of all 4^k k-mers: those a fitted model lacks are (0, 0); a static one has one sd."""
    schema = "kmer string, mean double" + (", sd double" if fitted else "")
    rows = spark.read.csv(path, sep="\t", schema=schema, comment="#").where(F.col("kmer").rlike("^[ATGC]+$"))
    if not fitted:
        return rows.select("kmer", seq.kmer_index(F.col("kmer")).alias("kmer_idx"), "mean", F.lit(sd).alias("sd"))
    every = seq.all_kmers(spark, k).withColumnRenamed("kmer_index", "kmer_idx")
    return every.join(F.broadcast(rows), "kmer", "left").fillna(0.0, ["mean", "sd"]).select("kmer", "kmer_idx", "mean", "sd")


def read_bed(spark: SparkSession, path: str, schema: str = REGION) -> DataFrame:
    return spark.read.csv(path, sep=" ", comment="#", schema=schema)


def read_forks(spark: SparkSession, path: str) -> DataFrame:
    """Fork BED of either generation, told apart by its number of columns; legacy rows have no query span."""
    cells = F.split("value", " ")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(cells.alias("c"))
    wide = F.size("c") >= 9
    kind = F.when(F.size("c") < 8, F.raise_error(F.lit("a fork line needs eight or nine columns")).cast("boolean")).otherwise(~wide)
    return rows.select(
        F.col("c")[0].alias("contig"), F.col("c")[1].cast("int").alias("start"), F.col("c")[2].cast("int").alias("end"), F.col("c")[3].alias("read_id"),
        F.col("c")[4].cast("int").alias("read_start"), F.col("c")[5].cast("int").alias("read_end"), F.col("c")[6].alias("strand"),
        F.when(wide, F.col("c")[7].cast("int")).alias("query_span"), F.when(wide, F.get("c", F.lit(8))).otherwise(F.col("c")[7]).cast("double").alias("score"), kind.alias("is_legacy"),
    )


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Distinct read ids of a BED file's fourth column."""
    return read_bed(spark, path).select("read_id").distinct()


def signal_table(spark: SparkSession, path: str) -> DataFrame:
    """Raw signal kept as Parquet: (read_id, samples, offset, scale)."""
    return spark.read.parquet(path)


def calibrated(signal: DataFrame) -> DataFrame:
    """Signal in picoamperes."""
    return signal.withColumn("raw", F.transform("samples", lambda s: (s + F.col("offset")) * F.col("scale")))


def sliced(signal: DataFrame) -> DataFrame:
    """The part of a signal that belongs to a read: ``ts`` to ``ns``, both after ``sp`` for a split read."""
    start = F.coalesce("sp", F.lit(0)) + F.coalesce("ts", F.lit(0))
    end = F.when(F.col("ns").isNull(), F.size("raw")).otherwise(F.coalesce("sp", F.lit(0)) + F.col("ns"))
    return signal.withColumn("raw", F.slice("raw", start + 1, F.greatest(end - start, F.lit(0))))


def enumerate_reads(signal: DataFrame) -> DataFrame:
    """Index rows of a signal table; a FAST5-style ``read_`` prefix is dropped."""
    return signal.select(F.regexp_replace("read_id", "^read_", "").alias("read_id"), F.col("batch").cast("long"), F.col("row").cast("long"), "path")
