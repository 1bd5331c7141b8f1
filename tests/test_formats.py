import numpy as np
from pyspark.sql import functions as F

from forktrack.sources import bam, sinks, text

CALLS = """#Software x
#Mode CNN
>r1 chr1 100 900 fwd
101\t0.125751\t0.131483
105\t0.500000\t0.600000
>r2 chr2 5 50 rev
7\t0.100000\t0.200000\tAAATTAAAA
"""


def test_calls_round_trip(spark, tmp_path):
    path = tmp_path / "x.detect"
    path.write_text(CALLS)
    rows = text.read_calls(spark, str(path)).orderBy("read_id", "idx").collect()
    assert [(r.read_id, r.idx, r.coord, r.p_edu) for r in rows] == [("r1", 0, 101, 0.125751), ("r1", 1, 105, 0.5), ("r2", 0, 7, 0.1)]
    assert rows[2].kmer == "AAATTAAAA" and rows[0].kmer is None and rows[2].strand == "rev"
    out = sinks.calls_text(text.read_calls(spark, str(path)).drop("kmer")).orderBy("read_id").collect()
    assert out[0].value == ">r1 chr1 100 900 fwd\n101\t0.125751\t0.131483\n105\t0.500000\t0.600000"
    sinks.write_records(sinks.calls_text(text.read_calls(spark, str(path)).drop("kmer")), str(tmp_path / "out"))
    assert text.read_calls(spark, str(tmp_path / "out")).count() == 3
    assert [r.read_id for r in text.read_bounds(spark, str(path), 100).collect()] == ["r1"]
    headless = tmp_path / "y.detect"
    headless.write_text(">r1 c 0 9 fwd\n1\t0\t0\n")
    assert text.read_calls(spark, str(headless)).first().read_id == "r1"


def test_small_formats(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 first\nacgt\nAC GT\n>chr2\nNNNN\n")
    assert {r.contig: r.seq for r in text.check_fasta(text.read_fasta(spark, str(tmp_path / "g.fa"))).collect()} == {"chr1": "ACGTACGT", "chr2": "NNNN"}
    (tmp_path / "i.tsv").write_text("a\t1\t2\t/x/y.pod5\nb\t-1\t-1\t/x/z.fast5\n")
    assert text.read_index(spark, str(tmp_path / "i.tsv")).where("batch = 1").first().path == "/x/y.pod5"
    (tmp_path / "s.tsv").write_text("other\tread_id\tfilename_fast5\n1\ta\tq.fast5\n")
    assert text.read_summary(spark, str(tmp_path / "s.tsv")).first().filename == "q.fast5"
    (tmp_path / "m.tsv").write_text("kmer\tmean\nAAA\t1.5\nAAT\t2.5\n")
    model = text.read_pore_model(spark, str(tmp_path / "m.tsv"), k=3)
    assert {r.kmer: (r.kmer_idx, r["mean"], r.sd) for r in model.collect()} == {"AAA": (0, 1.5, 0.14), "AAT": (1, 2.5, 0.14)}
    (tmp_path / "f.bed").write_text("#h\nc 1 5 r 0 9 fwd -1 0.5\nc 2 6 s 0 9 rev 0.25\n")
    forks = {r.read_id: (r.query_span, r.score, r.is_legacy) for r in text.read_forks(spark, str(tmp_path / "f.bed")).collect()}
    assert forks == {"r": (-1, 0.5, False), "s": (None, 0.25, True)}
    (tmp_path / "d").mkdir()
    for n in ("b.pod5", "a.fast5", "c.txt"):
        (tmp_path / "d" / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in text.list_signal_files(spark, str(tmp_path / "d")).collect()] == ["a.fast5", "b.pod5"]


def test_signal(spark):
    s = spark.createDataFrame([("r", [1, 2, 3, 4, 5], 1.0, 2.0, 1, 4, 0)], "read_id string, samples array<int>, offset double, scale double, ts int, ns int, sp int")
    assert text.sliced(text.calibrated(s)).first().raw == [6.0, 8.0, 10.0]


def test_bedgraph(spark, tmp_path):
    rows = spark.createDataFrame([("r", "c", 0, 100, 10, 0.5), ("r", "c", 0, 100, 20, 0.25)], "read_id string, contig string, ref_start int, ref_end int, coord int, p_edu double")
    line = sinks.bedgraph_lines(rows, "p_edu").first().value
    assert line.endswith("c 0 10 0.500000\nc 10 20 0.250000")
    sinks.write_bedgraphs(rows, "p_edu", str(tmp_path / "bg"))
    assert spark.read.text(str(tmp_path / "bg")).count() == 3


def test_bam_round_trip_in_stretches(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        n = int(r.integers(20, 200))
        rows.append({"read_id": f"read-{i}", "contig": "chr2" if i % 3 else "chr1", "pos": i * 7, "mapq": i % 60, "flag": 16 * (i % 2), "ops": [{"len": 3, "op": "S"}, {"len": n - 3, "op": "M"}], "seq": "".join("ACGT"[k] for k in r.integers(0, 4, n)), "ns": i, "pi": f"p{i}" if i % 5 == 0 else None, "mm": "N+b?,0,1;", "ml": [1, 2, i % 256]})
    path = str(tmp_path / "x.bam")
    bam.write_bam(path, [("chr1", 1000), ("chr2", 10**6)], iter(rows))
    spark.dataSource.register(bam.BamSource)
    for size in (1 << 30, 40_000):
        got = spark.read.format("bam").option("path", path).option("stretch", size).load()
        assert got.rdd.getNumPartitions() == (1 if size > 1 << 20 else -(-(tmp_path / "x.bam").stat().st_size // size))
        back = {x.read_id: x for x in got.collect()}
        assert len(back) == 3000 and got.count() == 3000
        for w in rows[:: 101]:
            g = back[w["read_id"]]
            assert (g.contig, g.pos, g.mapq, g.seq, g.ns, g.pi, g.mm, g.ml) == (w["contig"], w["pos"], w["mapq"], w["seq"], w["ns"], w["pi"], w["mm"], w["ml"])
            assert g.ref_end == w["pos"] + len(w["seq"]) - 3 and g.is_reverse == bool(w["flag"])
    want = sum(w["mapq"] >= 50 for w in rows)
    assert got.where(F.col("mapq") >= 50).count() == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("bam").option("path", path).option("stretch", 40_000).option("pushdown", "true").load()
    assert pushed.where(F.col("mapq") >= 50).count() == want
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
