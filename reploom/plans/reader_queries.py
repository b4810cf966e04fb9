"""Queries of the readers: tables written out as files of each format, read back and held against the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reploom.plans import model as md
from reploom.plans import oracle as o
from reploom.session import table, work_folder
from reploom.sources import reader

_COLUMNS = ("junction_aa", "duplicate_count", "v_call", "j_call", "productive")
_COUNTED = "select seq, cast(sum(abundance) as bigint) as abundance from unit group by 1"


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("seq").agg(F.sum("abundance").alias("abundance"))


def _table_file(spark: SparkSession, d: str, sep: str, **how: str) -> str:
    folder = work_folder(spark, "table")
    rows = table(spark, d, "regression_input", *_COLUMNS)
    rows.write.csv(folder, sep=sep, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **how)
    return folder


def _lines(spark: SparkSession, d: str, line: str, **how: str) -> str:
    """unit_repertoire, one record a counted sequence, as text lines by an SQL expression."""
    folder = work_folder(spark, "lines")
    rows = md.repertoire(table(spark, d, "unit_repertoire"), "seq", "abundance")
    rows.selectExpr(f"{line} as value").write.text(folder, **how)
    return folder


def read_tsv(spark, d):
    return _summed(reader.read_sequences(spark, _table_file(spark, d, "\t"))[0])


def read_csv_gzip(spark, d):
    return _summed(reader.read_sequences(spark, _table_file(spark, d, ",", compression="gzip"))[0])


def read_genes(spark, d):
    """Records by their genes, as the table has them."""
    rows = reader.read_sequences(spark, _table_file(spark, d, "\t"))[0]
    return rows.groupBy("v_gene", "j_gene").agg(F.count(F.lit(1)).alias("n"))


def read_stats(spark, d):
    return reader.read_sequences(spark, _table_file(spark, d, "\t"))[1]


def read_validation(spark, d):
    """Issues of a table by kind; their record numbers are all different."""
    report, issues = reader.validate(spark, _table_file(spark, d, "\t"))
    return issues.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record").alias("n_records"))


def read_plain(spark, d):
    return _summed(reader.read_sequences(spark, _lines(spark, d, "seq"), format="plain")[0])


def read_seqcount(spark, d):
    return _summed(reader.read_sequences(spark, _lines(spark, d, "concat(seq, '\t', abundance)"), expect="plain")[0])


def read_fasta(spark, d):
    """Sequences wrapped at ten letters a line, under headers."""
    return _summed(reader.read_sequences(spark, _lines(spark, d, "concat('>', abundance, ' x\n', regexp_replace(seq, '(.{10})', '$1\n'))"))[0])


def read_fastq(spark, d):
    return _summed(reader.read_sequences(spark, _lines(spark, d, "concat('@r\n', seq, '\n+\n', repeat('@', length(seq)))"))[0])


def read_fastq_gzip(spark, d):
    return _summed(reader.read_sequences(spark, _lines(spark, d, "concat('@r\n', seq, '\n+\n', repeat('I', length(seq)))", compression="gzip"))[0])


QUERIES = {f.__name__: f for f in (read_tsv, read_csv_gzip, read_genes, read_stats, read_validation, read_plain, read_seqcount, read_fasta, read_fastq, read_fastq_gzip)}

_REP = o.query(o.REP, select="select seq, abundance from rep")
_UNIT, _ONE = o.query(o.UNIT, select=_COUNTED), o.query(o.UNIT, select="select seq, cast(1 as bigint) as abundance from unit")
_JUDGED = rf"""j as (select v_call, j_call, coalesce(trim(junction_aa, {o._B}), '') as s, coalesce(regexp_full_match(trim(junction_aa, {o._B}), '[*.\-]*\p{{L}}[\p{{L}}*.\-]*'), false) as fine,
    coalesce(lower(trim(productive, {o._B})) in ('t', 'true', '1', 'yes'), false) as prod from regression_input)"""
ORACLE = {
    "read_tsv": _REP,
    "read_csv_gzip": _REP,
    "read_genes": o.query(_JUDGED, select="select nullif(v_call, '') as v_gene, nullif(j_call, '') as j_gene, count(*) as n from j where fine and prod group by 1, 2"),
    "read_stats": o.query(_JUDGED, select="select count(*) filter (s <> '') as total, count(*) filter (fine and prod) as kept, count(*) filter (s <> '' and not fine) as malformed, count(*) filter (fine and not prod) as nonproductive from j"),
    "read_validation": o.query(_JUDGED, select="select case when s = '' then 'empty' when not fine then 'malformed' else 'nonproductive' end as issue, count(*) as n, count(*) as n_records from j where not (fine and prod) group by 1"),
    "read_plain": _ONE,
    "read_seqcount": _UNIT,
    "read_fasta": _ONE,
    "read_fastq": _ONE,
    "read_fastq_gzip": _ONE,
}
