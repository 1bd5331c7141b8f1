import math
import random

import pytest
from pyspark.sql import functions as F

from forktrack.functions import cigar, logmath, modtags, seq


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sequences(spark):
    assert one(spark, seq.kmers(F.lit("ATGCA"), 3)) == ["ATG", "TGC", "GCA"]
    assert one(spark, seq.kmers(F.lit("AT"), 3)) == []
    assert one(spark, seq.kmer_index(F.lit("TGC"))) == 1 * 16 + 2 * 4 + 3
    assert one(spark, seq.kmer_index(F.lit("NGC"))) == 2 * 4 + 3
    assert one(spark, seq.reverse_complement(F.lit("AACGTUN"))) == "NAACGTT"
    with pytest.raises(Exception, match="nucleotide"):
        one(spark, seq.reverse_complement(F.lit("AXC")))
    every = seq.all_kmers(spark, 3).orderBy("kmer_index").collect()
    assert len(every) == 64 and every[27].kmer == "TGC"
    assert one(spark, seq.thymidine_positions(F.lit("TTTTTT"), 1)) == [2, 3]
    assert one(spark, seq.padded_signal(F.array(F.lit(1.0)), 3)) == [1.0, 0.0, 0.0]
    assert one(spark, seq.defined(F.lit("ATN"))) is False and one(spark, seq.base_count(F.lit("TTA"), "T")) == 2


def test_log_space(spark):
    low, high = logmath.log_of(F.lit(0.0)), logmath.log_of(F.lit(0.25))
    assert one(spark, low) == float("-inf") and one(spark, logmath.exp_of(low)) == 0.0
    assert one(spark, logmath.log_sum(low, high)) == pytest.approx(math.log(0.25))
    assert one(spark, logmath.log_sum(low, low)) == float("-inf")
    assert one(spark, logmath.log_sum(high, high)) == pytest.approx(math.log(0.5))
    assert one(spark, logmath.log_greater(high, low)) is True
    with pytest.raises(Exception, match="negative"):
        one(spark, logmath.log_of(F.lit(-1.0)))
    assert one(spark, logmath.log_normal_density(F.lit(1.0), F.lit(2.0), F.lit(2.0))) == pytest.approx(math.log(one(spark, logmath.normal_density(F.lit(1.0), F.lit(2.0), F.lit(2.0)))))


def naive_maps(ops, reverse):
    r = q = 0
    to_query, to_ref, gone = {}, {}, {}
    for n, op in (ops[::-1] if reverse else ops):
        for x in range(n):
            if op in "M=X":
                to_query[r], to_ref[q], gone[r] = q, r, False
                r, q = r + 1, q + 1
            elif op in "DN":
                to_query[r], gone[r] = q, True
                r += 1
            elif op in "IS":
                to_ref[q] = r + x
                q += 1
    return to_query, to_ref, gone


def test_cigar_maps(spark):
    r = random.Random(4)
    reads = {}
    for i in range(40):
        middle = [(r.randint(1, 5), r.choice("MMMIDX")) for _ in range(r.randint(1, 7))]
        reads[f"r{i}"] = ([(r.randint(1, 3), "S")] + middle + [(2, "M")], r.random() < 0.5)
    df = spark.createDataFrame([(k, "".join(f"{n}{op}" for n, op in ops), rev) for k, (ops, rev) in reads.items()], "read_id string, cigar string, is_reverse boolean").withColumn("ops", cigar.parse(F.col("cigar")))
    forward, backward = {}, {}
    for x in cigar.reference_to_query(df).collect():
        forward.setdefault(x.read_id, {})[x.ref_idx] = (x.query_idx, x.is_del)
    for x in cigar.query_to_reference(df).collect():
        backward.setdefault(x.read_id, {})[x.query_idx] = x.ref_idx
    for k, (ops, rev) in reads.items():
        q, ref, gone = naive_maps(ops, rev)
        assert forward[k] == {i: (v, gone[i]) for i, v in q.items()}
        assert backward[k] == ref
    ends = {x.read_id: x.e for x in df.select("read_id", cigar.reference_end(F.lit(100), F.col("ops")).alias("e")).collect()}
    assert all(ends[k] == 100 + sum(n for n, op in ops if op in "MDN=X") for k, (ops, _) in reads.items())
    mix = spark.createDataFrame([("m", "3S4M2I2M2D2M3S", False)], "read_id string, cigar string, is_reverse boolean").withColumn("ops", cigar.parse(F.col("cigar")))
    at = {x.ref_idx: (x.query_idx, x.is_del) for x in cigar.reference_to_query(mix).collect()}
    assert len(at) == 10 and at[4] == (9, False) and at[6] == at[7] == (11, True)


def test_modification_tags(spark):
    rows = [("r", q, p, 1 - p) for q, p in ((0, 0.5), (1, 0.501), (5, 0.502), (9, 1.0))]
    calls = spark.createDataFrame(rows, "read_id string, query_idx int, p_brdu double, p_edu double")
    tags = modtags.encode(calls).first()
    assert tags.mm == "N+b?,0,0,3,3;N+e?,0,0,3,3;" and tags.ml[:4] == [127, 127, 128, 255]
    back = modtags.decode(modtags.encode(calls)).collect()
    assert sorted((x.code, x.query_idx) for x in back) == sorted((c, q) for c in "be" for q, *_ in [(0,), (1,), (5,), (9,)])
    empty = spark.createDataFrame([("x", "N+b?;", [])], "read_id string, mm string, ml array<smallint>")
    assert modtags.decode(empty).count() == 0
