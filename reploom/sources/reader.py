"""Readers of sequence files with content-based detection: plain, seq+count, FASTA, FASTQ, delimited tables, compressed or not.

Detection looks at the first bytes of every file on the driver, through Hadoop for paths with a scheme; reading is distributed. Plain text, tables
and FASTQ are split within a file; gzip and bzip2 go through Hadoop codecs, xz and zstd through a stream for each file on the executors.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import lzma
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain, groupby, islice
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reploom.functions import text as tx
from reploom.session import cut, work_folder

# Column names by what they hold, most wanted first.
SEQ_COLUMNS = {
    "aap": ("junction_aa", "cdr3_amino_acid", "cdr3_aa", "aminoacid"),
    "ndp": ("junction", "cdr3_rearrangement", "cdr3_nt", "nucleotide"),
    "naive": ("junction_aa", "cdr3_amino_acid", "junction", "cdr3_rearrangement"),
}
SEQ_FALLBACK = ("sequence", "cdr3", "seq")
COUNT_COLUMNS = ("duplicate_count", "count", "abundance", "reads", "copies")
V_COLUMNS = ("v_call", "v_gene", "vgene")
J_COLUMNS = ("j_call", "j_gene", "jgene")
# Magic bytes.
MAGIC = {"gzip": b"\x1f\x8b", "bzip2": b"BZh", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd"}
FORMATS = ("plain", "seqcount", "fasta", "fastq", "tabular")
#: Formats that count as one when a format is expected.
FAMILY = {"plain": "lines", "seqcount": "lines"}
HEAD_LINES = 32
HEAD_BYTES = 1 << 20


class FormatError(ValueError):
    """Input that is no sequence file, or not of the format declared."""


class EmptyFileError(FormatError):
    """A file without a line that is not blank."""


@dataclass(frozen=True)
class InputSpec:
    """What detection found out."""

    path: str
    format: str
    compression: str | None = None
    delimiter: str | None = None
    seq_column: str | None = None
    count_column: str | None = None
    v_column: str | None = None
    j_column: str | None = None
    productive_column: str | None = None
    alphabet: str = "ambiguous"


def detect_compression(head: bytes) -> str | None:
    """By magic bytes, never by the name of the file."""
    return next((k for k, m in MAGIC.items() if head.startswith(m)), None)


def _hadoop(path: str):
    """(file system, path) of the active session for a path with a scheme; None for a local one."""
    spark = SparkSession.getActiveSession()
    if spark is None or not re.match(r"[A-Za-z][A-Za-z0-9+.\-]+:", path):
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def list_files(path: str) -> list[str]:
    """The file, or the visible files of a folder in name order; an error if there are none."""
    if far := _hadoop(path):
        fs, at = far
        names = sorted(str(f.getPath().toString()) for f in fs.listStatus(at) if f.isFile())
        files = [n for n in names if not n.rsplit("/", 1)[-1].startswith((".", "_"))]
    elif os.path.isdir(path):
        files = [os.path.join(path, n) for n in sorted(os.listdir(path)) if not n.startswith((".", "_"))]
    else:
        files = [path]
    if not files:
        raise FormatError(f"{path} is empty")
    return files


def _first_bytes(path: str, n: int = HEAD_BYTES) -> bytes:
    if far := _hadoop(path):
        fs, at = far
        size, stream = min(n, fs.getFileStatus(at).getLen()), fs.open(at)
        try:
            return bytes(SparkSession.getActiveSession()._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size)))
        finally:
            stream.close()
    with open(path, "rb") as f:
        return f.read(n)


def spool(spark: SparkSession, stream: BinaryIO) -> str:
    """Copy a stream, such as standard input, into a new file of the shared folder and give its path."""
    folder = work_folder(spark, "input")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/stream")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    while chunk := stream.read(1 << 20):
        out.write(bytearray(chunk))
    out.close()
    return str(at.toString())


def _inflated(head: bytes, compression: str | None) -> bytes:
    """As much of a file's text as its first bytes hold."""
    if compression is None:
        return head
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(head)
    opener = {"gzip": lambda: zlib.decompressobj(31), "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[compression]
    return opener().decompress(head)


def _stream(raw: BinaryIO, compression: str | None) -> BinaryIO:
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw)
    return {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open, None: lambda r: r}[compression](raw)


def head_lines(path: str, n: int = HEAD_LINES) -> tuple[list[str], str | None]:
    """First n lines of a file and the compression; binary and non-UTF-8 text is refused."""
    head = _first_bytes(path)
    compression = detect_compression(head)
    raw = _inflated(head, compression)[: 1 << 16]
    if b"\x00" in raw:
        raise FormatError(f"{path} looks like a binary file")
    ended = raw[: raw.rfind(b"\n") + 1] or raw if len(raw) == 1 << 16 else raw
    try:
        text = ended.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise FormatError(f"{path} is no UTF-8 text") from e
    return re.split(r"\r\n|\n|\r", text)[:n], compression


def is_count(s: str) -> bool:
    return re.fullmatch(r"\s*[+-]?\d+(\.0*)?\s*", s) is not None


def _find(names: list[str], wanted: tuple[str, ...]) -> str | None:
    low = {n.strip().lower(): n.strip() for n in reversed(names)}
    return next((low[w] for w in wanted if w in low), None)


def _sequence_column(names: list[str], variant: str) -> str | None:
    own = _find(names, SEQ_COLUMNS[variant] + SEQ_FALLBACK)
    every = tuple(c for v in SEQ_COLUMNS.values() for c in v)
    return own or _find(names, every)


def detect(path: str, variant: str = "aap", seq_column: str | None = None, override: str | None = None) -> InputSpec:
    """Format of a file or of all files of a folder, each looked at; a folder of several formats, headers or compressions is an error.

    FASTA, FASTQ, a table, sequences with counts, a table of one known column, or plain lines, tried in this order. Empty files, duplicate header names
    and tables without a sequence column are errors; in a folder of several files empty ones are passed over.
    """
    specs: dict[tuple, InputSpec] = {}
    files, counted = list_files(path), False
    for name in files:
        try:
            s = _detect_file(name, variant, seq_column, override)
        except EmptyFileError:
            if len(files) == 1:
                raise
            continue
        counted = counted or s.format == "seqcount"
        specs.setdefault((FAMILY.get(s.format, s.format), s.compression, s.delimiter if s.format == "tabular" else None, s.seq_column, s.count_column, s.v_column, s.j_column, s.productive_column), s)
    if not specs:
        raise EmptyFileError(f"{path} is empty")
    if len(specs) > 1:
        raise FormatError(f"{path} mixes files of different formats: {', '.join(sorted({str(k[0]) for k in specs}))}")
    spec = next(iter(specs.values()))
    if spec.format == "plain" and counted and not override:  # lines without a count are read by the same rule
        spec = replace(spec, format="seqcount", delimiter="\t")
    alphabets = {s.alphabet for s in specs.values()}
    return replace(spec, path=path, alphabet=alphabets.pop() if len(alphabets) == 1 else "amino_acid")


def detect_input_kind(path: str) -> str:
    """The name of the format alone."""
    return detect(path).format


def _detect_file(path: str, variant: str, seq_column: str | None, override: str | None) -> InputSpec:
    lines, compression = head_lines(path)
    filled = [x for x in lines if x.strip()]
    if not filled:
        raise EmptyFileError(f"{path} is empty")
    first = next((x.strip() for x in filled if not x.strip().startswith(";")), "")
    delimiter = "\t" if "\t" in filled[0] else "," if "," in filled[0] else None
    pairs = [x.split("\t") for x in filled]
    seqcount = all(len(p) == 2 and is_count(p[1]) for p in pairs)
    known = tuple(c for v in SEQ_COLUMNS.values() for c in v) + SEQ_FALLBACK
    at = next((i for i, x in enumerate(lines) if x.strip().startswith("@")), None)
    if override:
        kind = override
        if kind not in FORMATS:
            raise FormatError(f"unknown format {kind}")
    elif first.startswith(">"):
        kind = "fasta"
    elif at is not None and at + 2 < len(lines) and lines[at + 2].strip().startswith("+"):
        kind = "fastq"
    elif delimiter and not seqcount:
        kind = "tabular"
    elif seqcount:
        kind = "seqcount"
    elif filled[0].strip().lower() in known:
        kind = "tabular"
    else:
        kind = "plain"
    if kind != "tabular":
        sample = [x for x in filled if x[:1] not in (">", ";", "@", "+")]
        return InputSpec(path, kind, compression, "\t" if kind == "seqcount" else None, alphabet=infer_alphabet([x.split("\t")[0] for x in sample]))
    names = [n.strip() for n in next(csv.reader([filled[0]], delimiter=delimiter or ","))]
    low = [n.lower() for n in names if n]
    if twice := sorted({n for n in low if low.count(n) > 1}):
        raise FormatError(f"{path} has columns twice: {', '.join(twice)}")
    seq = _find(names, (seq_column.lower(),)) if seq_column else _sequence_column(names, variant)
    if seq is None:
        raise FormatError(f"{path} has no sequence column")
    rows = list(csv.reader(filled[1:], delimiter=delimiter or ","))
    sample = [r[names.index(seq)] for r in rows if len(r) > names.index(seq)]
    return InputSpec(path, "tabular", compression, delimiter or ",", seq, _find(names, COUNT_COLUMNS), _find(names, V_COLUMNS), _find(names, J_COLUMNS), _find(names, ("productive",)), infer_alphabet(sample))


def infer_alphabet(samples: list[str]) -> str:
    """As functions.text.alphabet, for text on the driver."""
    found = [c for s in samples for c in s.upper() if c not in "-.*_ \t"]
    if not found:
        return "ambiguous"
    if not set(found) <= set("ACGTUNRYSWKMBDHV"):
        return "amino_acid"
    return "nucleotide" if sum(c in "ACGTUN" for c in found) >= 0.65 * len(found) else "amino_acid"


def _hadoop_reads(spec: InputSpec) -> bool:
    """Whether Spark's own text readers open the files: no compression, or a codec that goes by the name's ending."""
    ending = {"gzip": ".gz", "bzip2": ".bz2"}.get(spec.compression)
    return spec.compression is None or (ending is not None and all(f.endswith(ending) for f in list_files(spec.path)))


def _opened(content: bytes, compression: str | None, newline: str | None = None) -> io.TextIOWrapper:
    return io.TextIOWrapper(_stream(io.BytesIO(content), compression), encoding="utf-8-sig", newline=newline)


def _batched(rows: Iterator, columns: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    batch: list = []
    for r in rows:
        batch.append(r)
        if len(batch) == size:
            yield pd.DataFrame(batch, columns=columns, dtype="object")
            batch = []
    yield pd.DataFrame(batch, columns=columns, dtype="object")


def _text(spark: SparkSession, spec: InputSpec, separator: str | None = None) -> DataFrame:
    """(value) lines of the file without a byte order mark; codecs that Hadoop lacks, or that the name hides, are streamed file by file on the executors."""
    if _hadoop_reads(spec):
        reader = spark.read.option("lineSep", separator) if separator else spark.read
        return reader.text(spec.path).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    compression = spec.compression

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                text = _opened(content, compression)
                yield from _batched(((x,) for x in text.read().split(separator)) if separator else ((x.rstrip("\n"),) for x in text), ["value"])

    return spark.read.format("binaryFile").load(spec.path).select("content").mapInPandas(lines, "value string")


def fastq_records(lines: Iterator[str]) -> Iterator[str]:
    """Sequences of whole four-line records; a record that does not begin with @, or whose third line does not with +, is an error."""
    for line in lines:
        if not line.strip():
            continue
        if not line.startswith("@"):
            raise FormatError("a FASTQ record has to begin with @")
        seq, plus = next(lines, "").strip(), next(lines, "").strip()
        if not plus.startswith("+"):
            raise FormatError("the third line of a FASTQ record has to begin with +")
        next(lines, None)
        yield seq


def first_record(lines: list[str]) -> int | None:
    """Where the first whole record begins in lines cut out of a FASTQ file; None if it cannot be told from them.

    A record is a line with @, and two lines on one with +. A quality line may begin with @ too, but two lines on it meets a sequence.
    """
    return next((i for i in range(len(lines) - 2) if lines[i].startswith("@") and lines[i + 2].startswith("+") and (i + 3 >= len(lines) or len(lines[i + 1].strip()) == len(lines[i + 3].strip()))), None)


def _fastq(spark: SparkSession, spec: InputSpec) -> DataFrame:
    """(seq) of FASTQ files. Uncompressed ones are split: a part of a file keeps the lines of the records that it cuts, a few, and those are put together."""
    if spec.compression is not None:
        compression = spec.compression

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for content in pdf["content"]:
                    yield from _batched(((s,) for s in fastq_records(iter(_opened(content, compression)))), ["seq"])

        return spark.read.format("binaryFile").load(spec.path).select("content").mapInPandas(whole, "seq string")
    parts = spark.read.text(spec.path).select(F.regexp_replace("value", "^\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, str]]:
        for pdf in batches:
            yield from pdf[["file", "start", "value"]].itertuples(index=False, name=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for (file, start), block in groupby(blocks(batches), key=lambda r: r[:2]):
                lines = (r[2] for r in block)
                held = list(islice(lines, 8))
                at = 0 if start == 0 else first_record(held)
                if at is None:
                    # no record begins here: all of it is the inside of one
                    yield None, file, start, [*held, *lines], True
                    continue
                yield None, file, start, held[:at], False
                rest, record = chain(held[at:], lines), []
                for line in rest:
                    if not record and not line.strip():
                        continue
                    record.append(line)
                    if len(record) == 4:
                        yield next(fastq_records(iter(record))), file, start, None, False
                        record = []
                yield None, file, start + 1, record, False

        return _batched(rows(), ["seq", "file", "start", "lines", "inside"])

    cut_up = cut(parts.mapInPandas(run, "seq string, file string, start bigint, lines array<string>, inside boolean"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = [x for part in pdf.sort_values("start", kind="stable")["lines"] for x in part]
        return pd.DataFrame({"seq": list(fastq_records(iter(lines)))}, dtype="object")

    # at most a record's lines from either end of a part
    ends = cut_up.filter("seq is null").groupBy("file").applyInPandas(join, "seq string")
    return cut_up.filter("seq is not null").select("seq").unionAll(ends)


def _table(spark: SparkSession, spec: InputSpec, multiline: bool | None) -> DataFrame:
    """The table's columns as text. Lines are split within a file unless a quoted field holds a line break, which a line of unpaired quotes shows."""
    if _hadoop_reads(spec):
        if multiline is None:
            quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
            multiline = not _text(spark, spec).filter(quotes % 2 == 1).isEmpty()
        df = spark.read.csv(spec.path, header=True, sep=spec.delimiter, quote='"', escape='"', multiLine=multiline, enforceSchema=False)
        return df.toDF(*[c.strip().removeprefix("\ufeff") for c in df.columns])
    names = [n.strip() for n in next(csv.reader([head_lines(list_files(spec.path)[0])[0][0]], delimiter=spec.delimiter))]
    wanted = [n or f"_{i}" for i, n in enumerate(names)]
    compression, delimiter = spec.compression, spec.delimiter

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = csv.reader(_opened(content, compression, ""), delimiter=delimiter)
                next(rows, None)
                yield from _batched(([*r, *[None] * len(names)][: len(names)] for r in rows if any(x.strip() for x in r)), wanted)

    return spark.read.format("binaryFile").load(spec.path).select("content").mapInPandas(records, ", ".join(f"`{n}` string" for n in wanted))


def read_raw(spark: SparkSession, spec: InputSpec, multiline: bool | None = None) -> DataFrame:
    """(seq, count_text, v_gene, j_gene, productive): the records as they are in the file; columns that the file lacks are null.

    multiline says whether quoted fields of a table hold line breaks; without it one pass over the lines finds out.
    """
    none = F.lit(None).cast("string")
    extra = [none.alias("v_gene"), none.alias("j_gene"), none.alias("productive")]
    if spec.format == "plain":
        return _text(spark, spec).select(tx.strip(F.col("value")).alias("seq"), none.alias("count_text"), *extra).filter("seq <> ''")
    if spec.format == "seqcount":
        p = F.split("value", "\t")
        return _text(spark, spec).filter(tx.strip(F.col("value")) != "").select(tx.strip(p[0]).alias("seq"), F.get(p, F.lit(1)).alias("count_text"), *extra).filter("seq <> ''")
    if spec.format == "fasta":
        body = F.regexp_replace("value", r"(?m)^;.*$", "")
        seq = F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"\s+", "")
        records = _text(spark, spec, ">").select(F.concat(F.lit(">"), F.col("value")).alias("value"))
        return records.select(seq.alias("seq"), none.alias("count_text"), *extra).filter("seq <> ''")
    if spec.format == "fastq":
        return _fastq(spark, spec).select("seq", none.alias("count_text"), *extra).filter("seq <> ''")
    df = _table(spark, spec, multiline)
    at = {c.lower(): c for c in df.columns}
    col = lambda n: df[f"`{at[n.lower()]}`"] if n and n.lower() in at else none
    return df.select(tx.strip(col(spec.seq_column)).alias("seq"), col(spec.count_column).alias("count_text"), col(spec.v_column).alias("v_gene"), col(spec.j_column).alias("j_gene"), col(spec.productive_column).alias("productive"))


def _issues(raw: DataFrame, spec: InputSpec, keep_nonproductive: bool) -> DataFrame:
    """raw plus issue: null for a record that is kept, else empty, malformed or nonproductive."""
    bad_flag = F.lit(spec.productive_column is not None and not keep_nonproductive) & ~tx.is_productive(F.col("productive"))
    return raw.withColumn("issue", F.when(F.coalesce("seq", F.lit("")) == "", "empty").when(~F.coalesce(tx.is_sequence(F.col("seq")), F.lit(False)), "malformed").when(bad_flag, "nonproductive"))


def read_sequences(spark: SparkSession, path: str, variant: str = "aap", seq_column: str | None = None, format: str | None = None, expect: str | None = None, keep_nonproductive: bool = False, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, stats): records (seq, abundance, v_gene, j_gene, productive), stats one row total, kept, malformed, nonproductive.

    Kept are well-formed sequences and, where the table has the column, affirmatively productive ones. A count that is no integral number, or is
    below 1, counts 1. expect makes a detected format of another family an error, lines with and without counts being one; strict refuses files that
    mix lines with and without counts.
    """
    spec = detect(path, variant, seq_column, format)
    if expect and FAMILY.get(spec.format, spec.format) != FAMILY.get(expect, expect):
        raise FormatError(f"{path} is {spec.format}, not {expect}")
    raw = read_raw(spark, spec)
    if strict and mode(spark, spec) == "mixed":
        raise FormatError(f"{path} mixes lines with and without counts")
    judged = _issues(raw, spec, keep_nonproductive)
    kept = judged.filter("issue is null").select("seq", tx.parse_count(F.col("count_text")).alias("abundance"), "v_gene", "j_gene", "productive")
    filled = judged.filter("issue is null or issue <> 'empty'")
    stats = filled.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("issue").isNull()).alias("kept"), F.count_if(F.col("issue") == "malformed").alias("malformed"), F.count_if(F.col("issue") == "nonproductive").alias("nonproductive"))
    return kept, stats


def read_simple(spark: SparkSession, path: str, variant: str = "aap") -> DataFrame:
    """(seq): the kept sequences alone, a row a record."""
    return read_sequences(spark, path, variant)[0].select("seq")


def mode(spark: SparkSession, spec: InputSpec) -> str:
    """The format, or mixed for lines of which some have a count and others have none."""
    if FAMILY.get(spec.format) != "lines":
        return spec.format
    shapes = _text(spark, spec).filter(tx.strip(F.col("value")) != "").select(F.size(F.split("value", "\t")).alias("n")).distinct().limit(2).count()
    return "mixed" if shapes > 1 else spec.format


def validate(spark: SparkSession, path: str, variant: str = "aap") -> tuple[DataFrame, DataFrame]:
    """(report, issues): report one row format, mode, alphabet, total, kept, ok; issues (record, seq, issue) of the records not kept.

    record counts from 1 in the order in which the records are read, that of the file where there is one. Mixed lines are not ok.
    """
    spec = detect(path, variant)
    kind = mode(spark, spec)
    numbered = cut(_issues(read_raw(spark, spec), spec, False).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("low"))  # one row a partition
    first = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), "low")
    bad = numbered.filter("issue is not null").join(F.broadcast(first), part == F.col("part"))
    report = numbered.agg(F.lit(spec.format).alias("format"), F.lit(kind).alias("mode"), F.lit(spec.alphabet).alias("alphabet"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("issue").isNull()).alias("kept"))
    ok = (F.col("kept") == F.col("total")) & (F.col("total") > 0) & F.lit(kind != "mixed")
    return report.withColumn("ok", ok), bad.select((F.col("before") + F.col("_id") - F.col("low") + 1).alias("record"), "seq", "issue")
