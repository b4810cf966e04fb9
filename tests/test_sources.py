"""Format detection, readers, validation and streams."""

import bz2
import gzip
import io
import lzma

import pytest
import zstandard

from reploom.operators.structure import degrees
from reploom.plans import model as md
from reploom.sources import reader
from reploom.streaming.builder import StreamBuilder, windowed_counts

AIRR = "sequence_id\tv_call\tj_call\tjunction_aa\tduplicate_count\ns1\tIGHV1-2*02\tIGHJ4*02\tCASSLGQAYEQYF\t7\ns2\tIGHV3-7*01\tIGHJ6*02\tCASSPGTGVYGYTF\t2\n"
FILES = {
    "airr.tsv": AIRR,
    "quoted.csv": 'junction_aa,note,duplicate_count\nCASSLGQAYEQYF,"comma, inside",3\n',
    "a.fasta": ">good1\nCASSLG\nQAYEQYF\n>bad\nCASS!!LG\n>good2\nCASSPGTGVYGYTF\n",
    "a.fastq": "@r1\nACGTACGT\n+\nIIIIIIII\n@r2\nTTGGCCAA\n+\nIIIIIIII\n",
    "plain.txt": "﻿CASSLGQAYEQYF\n\n CASSPGTGVYGYTF \n",
    "counts.txt": "CASSLGQAYEQYF\t3.0\nCASSPGTGVYGYTF\t0\n",
    "flags.tsv": "junction_aa\tproductive\nCASS\tT\nCASF\tF\nCASY\ttrue\n",
    "lone.txt": "junction_aa\nCASS\n",
}
KINDS = {"airr.tsv": "tabular", "quoted.csv": "tabular", "a.fasta": "fasta", "a.fastq": "fastq", "plain.txt": "plain", "counts.txt": "seqcount", "flags.tsv": "tabular", "lone.txt": "tabular"}
READ = {
    "airr.tsv": [("CASSLGQAYEQYF", 7), ("CASSPGTGVYGYTF", 2)], "quoted.csv": [("CASSLGQAYEQYF", 3)], "a.fasta": [("CASSLGQAYEQYF", 1), ("CASSPGTGVYGYTF", 1)],
    "a.fastq": [("ACGTACGT", 1), ("TTGGCCAA", 1)], "plain.txt": [("CASSLGQAYEQYF", 1), ("CASSPGTGVYGYTF", 1)], "counts.txt": [("CASSLGQAYEQYF", 3), ("CASSPGTGVYGYTF", 1)], "flags.tsv": [("CASS", 1), ("CASY", 1)], "lone.txt": [("CASS", 1)],
}


@pytest.mark.parametrize("name", FILES)
def test_formats(spark, tmp_path, name):
    path = tmp_path / name
    path.write_text(FILES[name], encoding="utf-8")
    assert reader.detect(str(path)).format == KINDS[name]
    rows, stats = reader.read_sequences(spark, str(path))
    assert sorted((r["seq"], r["abundance"]) for r in rows.collect()) == READ[name]
    if name == "a.fasta":
        assert tuple(stats.first()) == (3, 2, 1, 0)
    if name == "flags.tsv":
        assert tuple(stats.first()) == (3, 2, 0, 1)
    if name == "airr.tsv":
        assert {r["v_gene"] for r in rows.collect()} == {"IGHV1-2*02", "IGHV3-7*01"}


@pytest.mark.parametrize(("codec", "suffix"), [(gzip.compress, "gz"), (bz2.compress, "bz2"), (lzma.compress, "xz"), (zstandard.ZstdCompressor().compress, "zst"), (gzip.compress, "txt")])
@pytest.mark.parametrize("name", ["plain.txt", "airr.tsv"])
def test_compressed(spark, tmp_path, codec, suffix, name):
    path = tmp_path / f"{name}.{suffix}"
    path.write_bytes(codec(FILES[name].encode()))
    assert sorted((r["seq"], r["abundance"]) for r in reader.read_sequences(spark, str(path))[0].collect()) == READ[name]


def test_refusals(spark, tmp_path):
    def at(text, name="x.txt"):
        p = tmp_path / name
        p.write_bytes(text)
        return str(p)

    for bad in (b"", b"\n\n", b"AB\x00C", b"\xff\xfe\xff", b"junction_aa\tJunction_AA\nA\tB\n", b"foo,bar\n1,2\n"):
        with pytest.raises(reader.FormatError):
            reader.detect(at(bad))
    with pytest.raises(reader.FormatError):
        reader.read_sequences(spark, at(FILES["a.fasta"].encode()), expect="plain")
    with pytest.raises(reader.FormatError):
        reader.read_sequences(spark, at(b"CASS\nCASF\t2\n"), format="plain", strict=True)


def test_validate(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_text(FILES["a.fasta"])
    report, issues = reader.validate(spark, str(p))
    assert tuple(report.first()) == ("fasta", "fasta", "amino_acid", 3, 2, False) and [tuple(r) for r in issues.collect()] == [(2, "CASS!!LG", "malformed")]
    q = tmp_path / "m.txt"
    q.write_text("CASS\nCASF\t2\nC1\n")
    report, issues = reader.validate(spark, str(q))
    assert report.first()["mode"] == "mixed" and not report.first()["ok"]


def test_folders(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "a.txt").write_text("CASS\nCASF\n")
    (d / "b.txt").write_text("CASY\t2\n")
    (d / "c.txt").write_text("")
    (d / "_skip").write_text(">x\n")
    assert reader.read_sequences(spark, str(d), expect="seqcount")[0].count() == 3 and reader.read_simple(spark, str(d)).columns == ["seq"]
    (d / "e.fa").write_text(">x\nCASS\n")
    with pytest.raises(reader.FormatError):
        reader.detect(str(d))
    assert reader.detect_input_kind(f"file://{d}/e.fa") == "fasta" and reader.read_sequences(spark, f"file://{d}/e.fa")[0].count() == 1


def test_spooled_stream(spark):
    path = reader.spool(spark, io.BytesIO(gzip.compress(FILES["airr.tsv"].encode())))
    assert sorted((r["seq"], r["abundance"]) for r in reader.read_sequences(spark, path)[0].collect()) == READ["airr.tsv"]


@pytest.mark.parametrize("codec", [None, "xz"])
def test_quoted_line_breaks(spark, tmp_path, codec):
    text = 'junction_aa,note,duplicate_count\nCASS,"two\nlines, one field",3\nCASF,plain,2\n'
    p = tmp_path / ("t.csv" + (".xz" if codec else ""))
    p.write_bytes(lzma.compress(text.encode()) if codec else text.encode())
    assert sorted((r["seq"], r["abundance"]) for r in reader.read_sequences(spark, str(p))[0].collect()) == [("CASF", 2), ("CASS", 3)]


def test_tables_and_fastq_are_split(spark, tmp_path):
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    seqs = ["ACGT"[i % 4] * (i % 7 + 1) + "TTGCA" for i in range(400)]
    (tmp_path / "q.fastq").write_text("".join(f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(seqs)))
    (tmp_path / "t.tsv").write_text("junction_aa\tnote\n" + "".join(f'{s}\t"n"\n' for s in seqs))
    try:
        for size in ("700b", "61b", "4096b"):
            spark.conf.set(conf, size)
            got = reader.read_sequences(spark, str(tmp_path / "q.fastq"))[0]
            assert sorted(r["seq"] for r in got.collect()) == sorted(seqs)
        assert reader.read_raw(spark, reader.detect(str(tmp_path / "t.tsv"))).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set(conf, before)


def test_alphabet():
    assert reader.infer_alphabet(["ACGTN-"]) == "nucleotide" and reader.infer_alphabet(["CASSF"]) == "amino_acid" and reader.infer_alphabet(["-"]) == "ambiguous" and reader.infer_alphabet(["RYSWKM"]) == "amino_acid"


SEQS = [("CASSLGIRRT", 2), ("CASSLGYEQYF", 1), ("", 4), (None, 1), ("CASSQETQYF", 0), ("CASSQETQYF", None)]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(SEQS, "seq string, abundance bigint")
    whole = md.fit(spark.createDataFrame([("CASSLGIRRT", 2), ("CASSLGYEQYF", 1), ("CASSQETQYF", 1)], "seq string, abundance bigint"), "flashback")
    want = sorted((r["src"], r["dst"], r["cnt"]) for r in whole.edges.collect())
    with StreamBuilder(spark, str(tmp_path / "s1")) as b:
        assert b.peek() == (0, 0)
        b.add(df.limit(2))
        b.add(df.exceptAll(df.limit(2)))
        b.add(df.exceptAll(df.limit(2)), number=1)  # a retried batch counts once
        assert sorted((r["src"], r["dst"], r["cnt"]) for r in b.snapshot().edges.collect()) == want
        assert b.peek() == (degrees(whole).count(), whole.edges.count())
    with pytest.raises(RuntimeError):
        b.add(df)
    assert b.peek() == (0, 0)
    for i, part in enumerate((df.limit(3), df.exceptAll(df.limit(3)))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("seq string, abundance bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    s = StreamBuilder(spark, str(tmp_path / "s2"))
    s.attach(stream, str(tmp_path / "c2")).awaitTermination()
    assert sorted((r["src"], r["dst"], r["cnt"]) for r in s.finalize().edges.collect()) == want


def test_windows(spark, tmp_path):
    spark.sql("select * from values (timestamp'2030-01-01 01:00:00', 'CASF'), (timestamp'2030-01-02 01:00:00', 'CASF'), (timestamp'2030-01-02 02:00:00', 'CASF') t(ts, seq)").coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema("ts timestamp, seq string").parquet(str(tmp_path / "w"))
    q = windowed_counts(stream, "ts").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "wc")).start()
    q.awaitTermination()
    assert sorted(r[0] for r in spark.sql("select sum(cnt) from w where dst = 'CF_1{1}' group by window").collect()) == [1, 2]
