"""Sinks: runs, gold sets, reports, label sheets and answer events."""

from __future__ import annotations

import datetime
import json
import platform
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.functions.text import cell, escaped, percent, percent_range, quoted
from answerlens.operators.goldgen import mixed
from answerlens.operators.metrics import cause_counts, diagnostics, headline
from answerlens.settings import Settings


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file at any path that Spark can write; an existing one raises."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def provenance(settings: Settings, **more: object) -> dict[str, object]:
    """What a run depends on: public settings, index version, commit and Python version, and what the caller adds."""
    commit, _, dirty = revision().partition("-")
    return {"settings": settings.public(), "index_version": settings.index_version, "commit": commit, "dirty": bool(dirty), "python": platform.python_version(), **more}


def revision() -> str:
    """The commit of the working folder, with "-dirty" behind if files differ from it; empty outside a repository."""
    try:
        said = subprocess.check_output(("git", "describe", "--always", "--abbrev=40", "--exclude=*", "--dirty"), stderr=subprocess.DEVNULL, timeout=10)
    except (OSError, subprocess.SubprocessError):
        return ""
    return said.decode().strip()


def save_run(root: str, name: str, records: DataFrame, checks: DataFrame, scored: DataFrame, info: dict[str, object], now: datetime.datetime | None = None) -> str:
    """Writes records, checks, scores, info and the report to a folder named by time and run; returns it."""
    stamp = (now or datetime.datetime.now()).strftime("%Y%m%d-%H%M%S")
    folder = f"{root.rstrip('/')}/{stamp}_{name}"
    spark = records.sparkSession
    records.write.parquet(f"{folder}/records")
    checks.write.parquet(f"{folder}/checks")
    scored.select("id", "group", "repeat", "score", "cause", "refusal_reason").write.json(f"{folder}/scores")
    write_text(spark, f"{folder}/run", json.dumps(info, ensure_ascii=False, indent=2, default=str))
    failures(scored).select("id", "group", "repeat", "score", "cause", "refusal_reason").write.json(f"{folder}/failures")
    write_text(spark, f"{folder}/report", report(scored, info))
    return folder


def save_gold(items: DataFrame, folder: str, manifest: dict[str, object]) -> None:
    """Items by type as JSON lines, and the manifest first: a folder that has one raises before anything is written."""
    write_text(items.sparkSession, f"{folder}/manifest", json.dumps(manifest, ensure_ascii=False, indent=2))
    items.write.partitionBy("type").json(f"{folder}/items")


def failures(scored: DataFrame) -> DataFrame:
    """Rows below 2 points: errors first, then 0, then 1, each by id."""
    return scored.filter("score IS NULL OR score < 2").orderBy(F.coalesce("score", F.lit(-1)), "id", "repeat")


def first_lines(rows: DataFrame, most: int, where: str) -> tuple[list, list[str]]:
    """The first `most` rows, and a line that says how many more there are and where."""
    shown = rows.limit(most).collect()
    more = rows.count() - len(shown) if len(shown) == most else 0
    return shown, [f"- and {more} more, in {where}"] if more else []


def report(scored: DataFrame, info: dict[str, object], most: int = 200) -> str:
    """Markdown of a run: headline, diagnostics, causes and the first `most` failures; save_run() writes all of them beside it."""
    lines = [f"# {info.get('name', 'run')}", "", "| group | n | errors | safety | usefulness | 0 | 1 | 2 |", "|---|---|---|---|---|---|---|---|"]
    shown = [F.concat(percent(F.col(c)), percent_range(F.col(f"{c}_min"), F.col(f"{c}_max"))).alias(c) for c in ("safety", "usefulness")]
    rows = {r["group"]: r for r in headline(scored).select("group", "n", "errors", *shown, "score_0", "score_1", "score_2").collect()}
    for name in ("quant", "qual", "negative", "total"):
        r = rows[name]
        lines.append(f"| {name} | {r.n} | {r.errors} | {r.safety} | {r.usefulness} | {r.score_0} | {r.score_1} | {r.score_2} |")
    lines += ["", "| diagnostic | value |", "|---|---|", *[f"| {k} | {'-' if v is None else v} |" for k, v in diagnostics(scored).first().asDict().items()]]
    lines += ["", "| cause | n |", "|---|---|", *[f"| {r.cause} | {r.n} |" for r in cause_counts(scored).collect()], "", "## Failures", ""]
    failed, more = first_lines(failures(scored), most, "failures")
    lines += [f"- {'error' if r.score is None else r.score} {r.id} (repeat {r['repeat']}): {r.cause}{' / ' + r.refusal_reason if r.refusal_reason else ''}" for r in failed]
    return "\n".join([*lines, *more]) + "\n"


def comparison(before: DataFrame, after: DataFrame, groups: DataFrame, changed: DataFrame, same_gold: bool, most: int = 200) -> str:
    """Markdown of two runs: changes of groups in points, diagnostics side by side, and items that changed (`most` of a kind,
    and how many more there are in `changed`)."""
    lines = [] if same_gold else ["> The runs were scored on different gold sets.", ""]
    lines += ["| group | safety | usefulness |", "|---|---|---|"]
    points = lambda x: "-" if x is None else f"{x:+.1f} pp"
    both = [F.concat(percent(F.col(f"{c}_a")), F.lit(" → "), percent(F.col(f"{c}_b"))).alias(c) for c in ("safety", "usefulness")]
    lines += [f"| {r['group']} | {r.safety} ({points(r.safety_points)}) | {r.usefulness} ({points(r.usefulness_points)}) |" for r in groups.select("group", *both, "safety_points", "usefulness_points").orderBy("group").collect()]
    a, b = (diagnostics(x).first().asDict() for x in (before, after))
    lines += ["", "| diagnostic | before | after |", "|---|---|---|", *[f"| {k} | {a[k]} | {b[k]} |" for k in a]]
    for kind in ("improved", "regressed"):
        ids, more = first_lines(changed.filter(F.col("change") == kind).select("id").orderBy("id"), most, "the table of changes")
        lines += ["", f"{kind}: {', '.join(r.id for r in ids) or '-'}", *more]
    return "\n".join(lines) + "\n"


def sheet_rows(records: DataFrame, checks: DataFrame, support_n: int = 30, seed: int = 7, doubtful: float = 0.9) -> DataFrame:
    """(section, id, check_id, line): the rows of a label sheet, without the judge's probabilities.

    Of the support checks, those under `doubtful` go in, and others up to support_n in a mixed order.
    """
    support = checks.filter("kind = 'support'")
    low = support.filter(F.col("p") < doubtful)
    spare = max(0, support_n - low.count())
    rest = support.filter(F.col("p") >= doubtful).orderBy(mixed(seed, "id", "check_id"), "id", "check_id").limit(spare)
    chosen = checks.filter("kind <> 'support'").unionByName(low).unionByName(rest)
    section = F.when(F.col("kind").isin("fact", "must_not"), 1).when(F.col("kind") == "value", 2).when(F.col("kind") == "grade", 3).otherwise(4)
    line = F.concat(F.lit("| "), "id", F.lit("#"), "check_id", F.lit(" | "), "kind", F.lit(" | "), cell(F.coalesce("target", F.lit(""))), F.lit(" |  |  |"))
    answered = records.filter("status = 'answered'").select("id", "repeat")
    return chosen.join(answered, ["id", "repeat"]).select(section.alias("section"), "id", "check_id", line.alias("line"))


SECTIONS = {1: "Facts and wrong statements", 2: "Values", 3: "Grades", 4: "Support of sentences (a sample)"}


def label_lines(records: DataFrame, checks: DataFrame, support_n: int = 30, seed: int = 7) -> DataFrame:
    """(section, id, place, value): the lines of a label sheet for one repeat's records.

    Each section has a heading with its number of rows, then a block and a table for each record.
    """
    rows = sheet_rows(records, checks, support_n, seed)
    at = lambda df, id, place, value: df.select("section", id.alias("id"), place.alias("place"), value.alias("value"))
    none = F.lit("")
    title = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])[F.col("section")]
    heads = at(section_counts(rows), none, none, F.format_string("\n## %d. %s (%d)\n", "section", title, "n"))
    blocks = rows.select("section", "id").distinct().join(sheet_block(records), "id")
    table = F.lit("\n| key | kind | what | verdict | memo |\n|---|---|---|---|---|")
    lines = at(rows, F.col("id"), F.concat(F.lit(" "), "check_id"), F.col("line"))
    return heads.unionByName(at(blocks, F.col("id"), none, F.concat(F.lit("\n"), "block", F.lit("\n"), table))).unionByName(lines)


def save_label_sheet(records: DataFrame, checks: DataFrame, path: str, repeat: int = 0, support_n: int = 30, seed: int = 7) -> None:
    """The label sheet of one repeat as text, its lines in order over all part files; an existing path raises."""
    of = lambda df: df.filter(F.col("repeat") == repeat)
    label_lines(of(records), of(checks), support_n, seed).orderBy("section", "id", "place").select("value").write.text(path)


def section_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("section").agg(F.count("*").alias("n"))


def sheet_block(record: DataFrame) -> DataFrame:
    """(id, block): question, quoted answer and folded sources of each record."""
    source = lambda h: F.concat(F.lit("<p><b>["), h["ref"].cast("string"), F.lit("] "), escaped(h["document_id"]), F.lit("</b><br>\n"), F.replace(escaped(h["content"]), F.lit("\n"), F.lit("<br>\n")), F.lit("</p>"))
    sources = F.concat(F.format_string("<details><summary>sources (%d)</summary>\n", F.size("retrieved")), F.array_join(F.transform("retrieved", source), "\n"), F.lit("\n</details>"))
    return record.select("id", F.concat(F.lit("### "), "id", F.lit("\n\n**Question** "), F.coalesce("question", F.lit("")), F.lit("\n\n"), quoted(F.coalesce("answer", F.lit(""))), F.lit("\n\n"), sources).alias("block"))


def review(items: DataFrame, most: int = 1000) -> str:
    """Markdown for the review of drafts: `most` of them, and how many more there are."""
    out = []
    rows, more = first_lines(items.orderBy("type", "id"), most, "items")
    for r in rows:
        out += [f"## {r.id} ({r.type})", "", r.question or "", ""]
        out += [f"- answer: {r.answer}"] if r.answer else []
        out += [f"- point: {p.point} — {'; '.join(p.facts or [])}" for p in r.must_include or []]
        out += [f"- evidence: {e.document_id} {'p.' + str(e.page) if e.page is not None else ''} {e.quote or ''}" for e in r.evidence or []]
        out.append("")
    return "\n".join([*out, *more])


def event_frames(events: DataFrame) -> DataFrame:
    """(request_id, seq, frame): server-sent event text of (request_id, seq, event, payload)."""
    return events.select("request_id", "seq", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), "payload", F.lit("\n\n")).alias("frame"))


def show_table(df: DataFrame, rows: int = 50) -> None:
    df.show(rows, truncate=False)
