"""Command line: python -m reploom.cli COMMAND ...; results as TSV or JSON lines on standard output."""

from __future__ import annotations

import argparse
import json
import logging
import math
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reploom.functions import tokens as tk
from reploom.operators import algebra, analytics, grammar, occupancy, score, simulate, structure
from reploom.plans import model as md
from reploom.sources import reader
from reploom.session import cut, running_total

log = logging.getLogger("reploom")


def _emit(df: DataFrame, as_json: bool) -> None:
    """Write rows to standard output as they come, without collecting them at once."""
    if as_json:
        for r in df.toLocalIterator():
            print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))
        return
    print("\t".join(df.columns))
    for r in df.toLocalIterator():
        print("\t".join("" if v is None else " ".join(map(str, v)) if isinstance(v, list) else str(v) for v in r))


def _read(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.input == "-":
        args.input = reader.spool(spark, sys.stdin.buffer)
    variant = {"flashback": "aap"}.get(args.variant, args.variant) if hasattr(args, "variant") else "aap"
    rows, stats = reader.read_sequences(spark, args.input, variant, format=getattr(args, "format", None), expect=args.expect_format, strict=args.strict)
    log.info("records: %s", stats.first().asDict())
    spec = reader.detect(args.input, variant)
    if getattr(args, "variant", "aap") in ("aap", "flashback") and spec.alphabet == "nucleotide":
        log.warning("the input looks like nucleotides, the variant is for amino acids")
    return rows


def _grid(text: str) -> list[float]:
    """Depths as a list or START:END:N, spaced by equal factors."""
    if ":" in text:
        a, b, n = text.split(":")
        return [float(a) * (float(b) / float(a)) ** (i / max(1, int(n) - 1)) for i in range(int(n))]
    return [float(x) for x in text.split(",")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="reploom", description=__doc__)
    p.add_argument("--json", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--expect-format", choices=reader.FORMATS, help="an error if the input is of another kind")
    p.add_argument("--strict", action="store_true", help="refuse inputs that mix lines with and without counts")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, **kw) -> argparse.ArgumentParser:
        c = sub.add_parser(name, **kw)
        for a in args:
            c.add_argument(*a[0], **a[1])
        return c

    inp, mod = (("input",), {"help": "a file, a folder, or - for standard input"}), (("model",), {})
    seed, n = (("--seed",), {"type": int, "default": 42}), (("-n",), {"type": int, "default": 1000})
    variant = (("--variant",), {"default": "aap", "choices": [*md.VARIANTS, "flashback"]})
    add("build", inp, (("output",), {}), variant, (("--smoothing",), {"type": float, "default": 0.0}), (("--genes",), {"action": "store_true"}), (("--format",), {}))
    add("validate-input", inp)
    add("info", mod)
    add("score", mod, inp, (("--absorption",), {"default": "mc", "choices": ["mc", "exact", "none"]}))
    add("simulate", mod, n, seed)
    add("diversity", mod, (("--orders",), {"default": "0,1,2"}), seed)
    add("compare", mod, (("other",), {}))
    add("decompose", (("sequences",), {"nargs": "+"}), variant)
    add("saturation", inp, variant, (("--every",), {"type": int, "default": 100}))
    add("predict", (("what",), {"choices": ["richness", "overlap", "sharing"]}), mod, (("depths",), {}), seed)
    add("posterior", mod, inp, (("output",), {}), (("--kappa",), {"type": float, "default": 1.0}))
    add("scale", mod, inp, n, seed)
    add("grammar", inp, (("--backoff",), {"default": "good_turing", "choices": ["none", "good_turing"]}))
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    out = lambda df: _emit(df, args.json)
    if hasattr(args, "model"):
        m = md.load(spark, args.model)
    if args.command == "build":
        rep = _read(spark, args)
        keep = ["seq", "abundance", "v_gene", "j_gene"] if args.genes else ["seq", "abundance"]
        md.save(md.fit(rep.groupBy(*[k for k in keep if k != "abundance"]).agg(F.sum("abundance").alias("abundance")), args.variant, args.smoothing, args.genes), args.output)
    elif args.command == "validate-input":
        report, issues = reader.validate(spark, reader.spool(spark, sys.stdin.buffer) if args.input == "-" else args.input)
        out(report)
        out(issues.orderBy("record"))
        return 0 if report.first()["ok"] else 2
    elif args.command == "info":
        size = structure.summary(m).withColumn("has_gene_data", F.lit(structure.has_gene_data(m)))
        out(size.crossJoin(analytics.entropy(m)).crossJoin(analytics.support(m)) if m.variant == "flashback" else size)  # one row each
    elif args.command == "score":
        out(score.log_pgen(m, _read(spark, args), log_absorption=math.log(simulate.absorption(m, args.absorption))))
    elif args.command == "simulate":
        out(simulate.simulate(m, args.n, args.seed))
    elif args.command == "diversity":
        orders = tuple(float(x) for x in args.orders.split(","))
        if m.variant == "flashback":
            curve, top = analytics.hill_curve(m, orders), analytics.dynamic_range(m)
        else:
            sims = cut(simulate.simulate(m, 10_000, args.seed))
            curve, top = analytics.monte_carlo(sims, orders), analytics.sampled_profile(sims)
        out(curve.unionAll(top.select(F.lit(float("inf")), "d_infinity")))
    elif args.command == "compare":
        out(algebra.compare(m, md.load(spark, args.other)))
    elif args.command == "decompose":
        df = spark.createDataFrame([(s,) for s in args.sequences], "seq string")
        toks = tk.flashback(F.col("seq")) if args.variant == "flashback" else tk.lz76(F.col("seq"))
        out(df.select("seq", toks.alias("tokens")))
    elif args.command == "saturation":
        seqs = _read(spark, args).select("seq").distinct().withColumn("one", F.lit(1))
        out(occupancy.saturation(running_total(seqs, "seq", "one", "idx").select("idx", "seq"), args.variant, args.every).orderBy("n_seqs"))
    elif args.command == "predict":
        sims, depths = cut(simulate.simulate(m, 5000, args.seed)), _grid(args.depths)
        if args.what == "richness":
            out(occupancy.richness_curve(sims, depths))
        elif args.what == "overlap":
            out(occupancy.predicted_overlap(sims, *depths[:2]))
        else:
            out(occupancy.predict_sharing(analytics.mixture(sims), depths))
    elif args.command == "posterior":
        md.save(algebra.posterior(m, _read(spark, args).groupBy("seq").agg(F.sum("abundance").alias("abundance")), args.kappa), args.output)
    elif args.command == "scale":
        cal = cut(simulate.calibrate_scale(simulate.simulate(m, args.n, args.seed)))
        out(simulate.scale_scores(score.log_pgen(m, _read(spark, args)), cal))
    elif args.command == "grammar":
        out(grammar.profile(grammar.fit(_read(spark, args), backoff=args.backoff)))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, stream=sys.stderr)
    spark = SparkSession.builder.appName("reploom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        return run(spark, args)
    except (md.ModelError, reader.FormatError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
