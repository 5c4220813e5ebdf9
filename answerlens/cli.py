"""Command line: python -m answerlens.cli ingest|run|curve|rescore|rejudge|compare|label-sheet|calibrate|generate ..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.operators.calibrate import calibrate
from answerlens.operators.compare import changes, group_changes
from answerlens.operators.goldset import approved
from answerlens.operators.ingest import Catalog
from answerlens.operators.metrics import headline
from answerlens.operators.scoring import score
from answerlens.plans import flows
from answerlens.providers import FirstSourceGenerator, SentenceDrafter, WordEmbedder, WordJudge
from answerlens.settings import Settings, experiment_overrides, from_environment
from answerlens.sources import sinks
from answerlens.sources.files import items, label_sheet, run_tables, scan, text_pages

Command = Callable[[SparkSession, Settings, argparse.Namespace], int]


def embedder(settings: Settings) -> WordEmbedder:
    return WordEmbedder(settings.embed_dim)


def gold_of(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return items(spark, args.gold, args.files)


def ingest(spark: SparkSession, settings: Settings, args: argparse.Namespace) -> int:
    result = flows.ingest_files(spark, args.paths, Catalog(spark, args.catalog), embedder(settings), settings, args.force, args.dry_run)
    sinks.show_table(result)
    return int(result.filter("status = 'failed'").limit(1).count() > 0)


def saved(settings: Settings, args: argparse.Namespace, records: DataFrame, checks: DataFrame, scored: DataFrame, **info: object) -> int:
    """Saves a run, shows its headline and says whether a record failed."""
    folder = sinks.save_run(args.runs, args.name, records, checks, scored, sinks.provenance(settings, name=args.name, **info))
    sinks.show_table(headline(scored))
    print(folder)
    return int(records.filter("status = 'error'").limit(1).count() > 0)


def run(spark: SparkSession, settings: Settings, args: argparse.Namespace) -> int:
    gold = gold_of(spark, args)
    made = flows.evaluate(gold, Catalog(spark, args.catalog), embedder(settings), FirstSourceGenerator(), WordJudge(), settings, args.repeats, first=args.limit)
    return saved(settings, args, *made, repeats=args.repeats, limit=args.limit)


def curve(spark: SparkSession, settings: Settings, args: argparse.Namespace) -> int:
    ks = [int(k) for k in args.k.split(",")]
    sinks.show_table(flows.retrieval_curve(gold_of(spark, args), Catalog(spark, args.catalog), embedder(settings), settings, ks).orderBy("group", "k"))
    return 0


def rescore(spark: SparkSession, settings: Settings, args: argparse.Namespace) -> int:
    sinks.show_table(headline(score(gold_of(spark, args), *run_tables(spark, args.run), settings)))
    return 0


def rejudge(spark: SparkSession, settings: Settings, args: argparse.Namespace) -> int:
    """Stored answers, judged and scored again; failed records stay failed and aren't counted against this command."""
    gold, (records, _) = approved(gold_of(spark, args)), run_tables(spark, args.run)
    checks = flows.rejudge(gold, records, WordJudge(), settings)
    saved(settings, args, records, checks, score(gold, records, checks, settings), rejudged_from=args.run)
    return 0


def compare(spark: SparkSession, settings: Settings, args: argparse.Namespace) -> int:
    gold = gold_of(spark, args)
    a, b = (score(gold, *run_tables(spark, folder), settings) for folder in (args.before, args.after))
    text = sinks.comparison(a, b, group_changes(a, b), changes(a, b), True)
    print(text)
    if args.out:
        sinks.write_text(spark, args.out, text)
    return 0


def make_sheet(spark: SparkSession, settings: Settings, args: argparse.Namespace) -> int:
    sinks.save_label_sheet(*run_tables(spark, args.run), args.out, args.repeat, args.support)
    print(args.out)
    return 0


def agreement(spark: SparkSession, settings: Settings, args: argparse.Namespace) -> int:
    _, checks = run_tables(spark, args.run)
    labels = label_sheet(spark.read.text(args.sheet))
    sinks.show_table(calibrate(labels, checks.filter(F.col("repeat") == args.repeat), settings.taus()))
    return 0


def generate(spark: SparkSession, settings: Settings, args: argparse.Namespace) -> int:
    pages = text_pages(scan(spark, args.paths))
    drafts, rejects = flows.draft_gold(pages, SentenceDrafter(), args.quant, args.qual, args.traps, args.seed)
    sinks.save_gold(drafts, args.out, {"name": args.name or args.out.rstrip("/").rsplit("/", 1)[-1], "seed": args.seed})
    sinks.write_text(spark, f"{args.out}/review", sinks.review(drafts))
    sinks.show_table(drafts.groupBy("type").agg(F.count("*").alias("n")).unionByName(rejects.select(F.lit("rejected").alias("type")).groupBy("type").agg(F.count("*").alias("n"))))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="answerlens")
    top.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    top.add_argument("--experiment", metavar="FILE.toml")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, does: Command, *positional: str, gold: bool = False, saves: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(does=does)
        for each in positional:
            p.add_argument(each, nargs="+" if each == "paths" else None)
        if gold:
            p.add_argument("gold")
            p.add_argument("files", nargs="+")
        if saves:
            p.add_argument("--runs", default="runs")
            p.add_argument("--name", default=name)
        return p

    p = command("ingest", ingest, "catalog", "paths")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--force", action="store_true")
    p = command("run", run, "catalog", gold=True, saves=True)
    p.add_argument("--repeats", type=int, default=1)
    p.add_argument("--limit", type=int, default=0, help="only so many items, by id")
    command("curve", curve, "catalog", gold=True).add_argument("--k", default="1,3,5,8,10,15,20,30,50")
    command("rescore", rescore, "run", gold=True)
    command("rejudge", rejudge, "run", gold=True, saves=True)
    command("compare", compare, "before", "after", gold=True).add_argument("--out")
    p = command("label-sheet", make_sheet, "run", "out")
    p.add_argument("--repeat", type=int, default=0)
    p.add_argument("--support", type=int, default=30)
    command("calibrate", agreement, "run", "sheet").add_argument("--repeat", type=int, default=0)
    p = command("generate", generate, "out", "paths")
    p.add_argument("--name")
    for name, n in (("quant", 10), ("qual", 5), ("traps", 5), ("seed", 7)):
        p.add_argument(f"--{name}", type=int, default=n)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    settings = from_environment().replaced(experiment_overrides(args.experiment, args.set))
    return args.does(SparkSession.builder.getOrCreate(), settings, args)


if __name__ == "__main__":
    sys.exit(main())
