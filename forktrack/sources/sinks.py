"""Writers of the domain's formats; every file format is a text column, so that Spark writes in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import intervals, sharded


def _number(x: Column) -> Column:
    return F.format_string("%.6f", x.cast("double"))


def _records(rows: DataFrame, line: Column, order: str = "coord") -> DataFrame:
    """(read_id, value): a record's header and lines, ascending by coordinate."""
    key = ["read_id", "contig", "ref_start", "ref_end", "strand"]
    head = F.concat(F.lit(">"), F.concat_ws(" ", *key))
    held = rows.select(*key, F.struct(F.col(order).alias("o"), line.alias("t")).alias("s")).groupBy(*key).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return held.select("read_id", F.concat(head, F.lit("\n"), F.array_join(F.transform("s", lambda x: x["t"]), "\n")).alias("value"))


def header_lines(settings: dict[str, object]) -> list[str]:
    return [f"#{name} {value}" for name, value in settings.items()]


def calls_text(calls: DataFrame) -> DataFrame:
    """Records of per-base calls; a k-mer column is written where there is one."""
    cells = [F.col("coord").cast("string"), _number(F.col("p_edu")), _number(F.col("p_brdu"))] + ([F.col("kmer")] if "kmer" in calls.columns else [])
    return _records(calls, F.concat_ws("\t", *cells))


def flags_text(painted: DataFrame) -> DataFrame:
    return _records(painted, F.concat_ws("\t", "coord", "edu", "brdu"))


def aligned_text(rows: DataFrame) -> DataFrame:
    """Event alignment records; calls are written where there are some."""
    cells = F.concat_ws("\t", "coord", "kmer_ref", _number(F.col("signal")), "kmer_strand", _number(F.col("model_mean")))
    if "p_edu" in rows.columns:
        cells = F.when(F.col("p_edu").isNotNull(), F.concat_ws("\t", cells, _number(F.col("p_edu")), _number(F.col("p_brdu")))).otherwise(cells)
    return _records(rows, cells, "idx")


def write_records(records: DataFrame, path: str, header: dict[str, object] | None = None) -> None:
    """One text per task; the header is a file of its own that sorts first."""
    records.select("value").write.mode("overwrite").text(path)
    if header:
        spark = records.sparkSession
        spark.createDataFrame([("\n".join(header_lines(header)),)], "value string").coalesce(1).write.mode("append").text(path)


def write_bed(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep=" ", nullValue="-1", quote="")


def write_tsv(rows: DataFrame, path: str, header: bool = False) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=header)


def write_families(families: dict[str, DataFrame], path: str) -> None:
    """A folder of BED files for each feature."""
    for name, rows in families.items():
        write_bed(rows, f"{path}/{name}")


def report_lines(result, lists: dict[str, list[float]] | None = None) -> list[str]:
    """Lines of a break report from its one row."""
    return header_lines(result.asDict()) + [f"{name}\n" + " ".join(f"{v:.6f}" for v in values) for name, values in (lists or {}).items()]


def bedgraph_lines(rows: DataFrame, value: str) -> DataFrame:
    """(read_id, value): a track for each read, of half-open intervals between its positions."""
    cut = intervals(rows, "read_id", "coord", F.col("ref_start"))
    line = F.concat_ws(" ", "contig", "interval_start", "interval_end", _number(F.col(value)))
    held = cut.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("coord", line.alias("t")))).alias("s"))
    head = F.concat(F.lit('track type=bedGraph name="'), "read_id", F.lit(f'" description="{value}"'))
    return held.select("read_id", F.concat(head, F.lit("\n"), F.array_join(F.transform("s", lambda x: x["t"]), "\n")).alias("value"))


def write_bedgraphs(rows: DataFrame, value: str, path: str, min_length: int = 0, max_length: int = 1 << 30, size: int = 300) -> None:
    """Tracks of reads of suitable length, ``size`` reads to a folder."""
    length = F.col("ref_end") - F.col("ref_start")
    use = rows.where((length > min_length) & (length < max_length))
    numbered = sharded(use.select("read_id").distinct(), "read_id", size)
    bedgraph_lines(use, value).join(numbered, "read_id").write.mode("overwrite").partitionBy("shard", "read_id").text(path)


def missing_log(missing: DataFrame, path: str) -> None:
    missing.select(F.col("read_id").alias("value")).write.mode("overwrite").text(path)

