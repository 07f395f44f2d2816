"""The command line."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException

from . import config as settings
from . import narrate, rpc, voices
from .model import BANDS, SEVERITIES, TableProfile
from .operators import expectations, multi, redact
from .operators.diff import compare, diff_to_dict
from .operators.profile import is_remote, profile
from .operators.score import badge_svg, compute_score
from .plans.adhoc import DialectError, open_session
from .render import reports
from .session import session
from .sources import excel
from .sources.errors import ExcelReaderError, RemoteAccessError, SQLiteTableError, UnsupportedFormatError
from .sources.load import load
from .streaming import watch as watching

# What each exit code means.
OK, BAD_INPUT, PII, NO_READING, DIFFERS, LOW_SCORE = 0, 2, 3, 4, 5, 6
WRONG = (UnsupportedFormatError, SQLiteTableError, ExcelReaderError, RemoteAccessError, FileNotFoundError, multi.MultiInputError, redact.RedactionError, settings.ConfigError, voices.UnknownPersonaError, DialectError, PySparkException)


class UsageError(ValueError):
    """Options that don't go together."""


def _sheet(text: str | None) -> str | int | None:
    return int(text) if text is not None and text.isdigit() else text


def _above(least: int, most: int | None = None):
    def kind(text: str) -> int:
        n = int(text)
        if n < least or most is not None and n > most:
            raise argparse.ArgumentTypeError(f"{n} is out of range")
        return n

    return kind


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="prismetric", description="Profiles of tables.")
    top.add_argument("--persona")
    top.add_argument("--config", type=Path)
    top.add_argument("--no-config", action="store_true")
    commands = top.add_subparsers(dest="command")

    def command(name: str, said: str, *shared: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=said)
        options = {
            "table": {"help": "table of an SQLite file"}, "sheet": {"help": "sheet of a workbook, by name or place"}, "sample": {"type": _above(1), "help": "only the first rows"},
            "json": {"action": "store_true"}, "quiet": {"action": "store_true"}, "html": {"type": Path}, "region": {}, "format": {"choices": ["csv", "tsv", "jsonl", "ndjson", "parquet"], "type": str.lower},
        }
        for option in shared:
            p.add_argument(f"--{option}", **options[option])
        return p

    p = command("summon", "profile a file, folder or glob", "table", "sheet", "sample", "json", "quiet", "html", "region", "format")
    p.add_argument("path")
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--max-files", type=_above(1), default=multi.MOST_FILES)
    p.add_argument("--fail-on-pii", choices=list(BANDS), type=str.lower)
    p.add_argument("--no-timeseries", action="store_true", default=None)
    p.add_argument("--expectations", choices=expectations.FORMATS, type=str.lower)
    p.add_argument("--suite-name")
    p.add_argument("--include-pii", action="store_true")
    p.add_argument("--min-samples", type=_above(0), default=0)
    p.add_argument("--score", action="store_true")
    p.add_argument("--score-only", action="store_true")
    p.add_argument("--min-score", type=_above(0, 100))
    p.add_argument("--badge", type=Path)

    p = command("read", "profile a file and have it read", "table", "sheet", "sample", "quiet", "html", "region", "format")
    p.add_argument("path")
    p.add_argument("--timeout", type=float)
    p.add_argument("--show-profile", action=argparse.BooleanOptionalAction, default=True)

    p = command("compare", "compare two files", "sample", "json")
    p.add_argument("before")
    p.add_argument("after")
    p.add_argument("--before-table")
    p.add_argument("--after-table")
    p.add_argument("--fail-on", choices=SEVERITIES[1:], type=str.lower)

    p = command("watch", "profile files again when they change", "table", "sheet", "sample")
    p.add_argument("paths", nargs="+")
    p.add_argument("--diff", action="store_true")
    p.add_argument("--interval", type=float)
    p.add_argument("--debounce-ms", type=_above(0))
    p.add_argument("--no-clear", action="store_true")
    p.add_argument("--poll", action="store_true")

    p = command("parlor", "SQL over a file, as view data", "table", "sheet")
    p.add_argument("path")
    p.add_argument("--sql", help="one statement; else statements come from standard input")

    p = command("redact", "write a copy without personal data", "table", "sheet", "json")
    p.add_argument("path")
    p.add_argument("-o", "--output", type=Path)
    p.add_argument("--min-confidence", default="high")
    p.add_argument("--strategy", action="append", default=[])
    p.add_argument("--format", choices=redact.FORMATS, type=str.lower)
    p.add_argument("--dry-run", action="store_true")

    command("list-sheets", "sheets of a workbook", "json").add_argument("path")
    command("mcp", "serve tools over standard input and output")
    command("personas", "list voices")
    command("config", "show settings and where they come from", "json")
    return top


def _profiled(args: argparse.Namespace, path: str, conf: settings.LoadedConfig, table: str | None = None) -> TableProfile:
    spark = session()
    df = load(spark, path, table=table or getattr(args, "table", None), form=getattr(args, "format", None), region=getattr(args, "region", None), sheet=_sheet(getattr(args, "sheet", None)))
    rules = conf.values.get("pii", {}).get("name_rules", [])
    series = not (getattr(args, "no_timeseries", None) if getattr(args, "no_timeseries", None) is not None else conf.values.get("no_timeseries", False))
    return profile(df, path=path if is_remote(path) else Path(path), sample=args.sample or conf.values.get("sample"), timeseries_=series, rules=rules)


def summon(args: argparse.Namespace, conf: settings.LoadedConfig, voice: voices.Persona) -> int:
    fail_on = args.fail_on_pii or conf.values.get("fail_on_pii")
    min_score = args.min_score if args.min_score is not None else conf.values.get("min_score")
    scored = args.score or args.score_only or args.badge or min_score is not None
    if args.expectations and (args.json or scored or multi.is_multi(args.path)):
        raise UsageError("--expectations goes with neither --json, scores nor many files")
    if args.score_only and args.json:
        raise UsageError("--score-only and --json cannot be combined")
    if multi.is_multi(args.path):
        if args.score or args.score_only or args.badge or args.min_score is not None:
            raise UsageError("scores are for single files")
        spark = session()
        files = multi.expand_inputs(spark, args.path, include=args.include, exclude=args.exclude, max_files=args.max_files, region=args.region)
        many = multi.profile_many(spark, files, sample=args.sample, table=args.table, sheet=_sheet(args.sheet), region=args.region, form=args.format, timeseries_=not args.no_timeseries, rules=conf.values.get("pii", {}).get("name_rules", []))
        if not args.quiet or args.json:
            print(reports.dumps(reports.multi_to_dict(many)) if args.json else reports.multi_text(many))
        if fail_on and any(f.report.most_personal()[0] >= BANDS[fail_on] for f in many.files if f.report):
            return PII
        return OK if many.loaded_count else BAD_INPUT
    report = _profiled(args, args.path, conf)
    score = compute_score(report) if scored else None
    if args.badge:
        args.badge.write_text(badge_svg(score), encoding="utf-8")
    if args.html:
        args.html.write_text(reports.page(report), encoding="utf-8")
    if args.expectations:
        print(expectations.dumps(report, args.expectations, name=args.suite_name, include_pii=args.include_pii, min_samples=args.min_samples))
    elif args.score_only:
        print(score.score)
    elif args.json:
        print(reports.dumps(reports.report_to_dict(report, score if args.score else None)))
    elif not args.quiet:
        print(reports.text(report, score))
    confidence, kind, column = report.most_personal()
    if fail_on and confidence >= BANDS[fail_on]:
        if not args.json and not args.quiet:
            print(f"{voice.refusal} {kind} in column '{column}' (confidence {confidence:.2f} ≥ {fail_on} threshold {BANDS[fail_on]:.2f}).")
        return PII
    if min_score is not None and score.score < min_score:
        if not args.json and not args.quiet:
            print(f"{voice.refusal} quality score {score.score} (grade {score.grade}) is below --min-score {min_score}.")
        return LOW_SCORE
    return OK


def read(args: argparse.Namespace, conf: settings.LoadedConfig, voice: voices.Persona) -> int:
    report = _profiled(args, args.path, conf)
    if args.show_profile and not args.quiet:
        print(reports.text(report))
    llm = conf.values.get("llm", {})
    try:
        result = narrate.read(report, narrate.load_config(timeout=args.timeout, base_url=llm.get("base_url"), model=llm.get("model")), voice)
    except narrate.LLMUnavailableError as e:
        print(f"No reading: {e}", file=sys.stderr)
        return NO_READING
    print(result.text)
    if args.html:
        args.html.write_text(reports.page(report, reading=result.text), encoding="utf-8")
    return OK


def compare_(args: argparse.Namespace, conf: settings.LoadedConfig, voice: voices.Persona) -> int:
    diff = compare(_profiled(args, args.before, conf, args.before_table), _profiled(args, args.after, conf, args.after_table))
    print(reports.dumps(diff_to_dict(diff)) if args.json else reports.diff_text(diff))
    return DIFFERS if args.fail_on and SEVERITIES.index(diff.severity) >= SEVERITIES.index(args.fail_on) else OK


def watch(args: argparse.Namespace, conf: settings.LoadedConfig, voice: voices.Persona) -> int:
    told = conf.values.get("watch", {})
    interval = args.interval if args.interval is not None else told.get("poll_interval", 1.0)
    wait = args.debounce_ms if args.debounce_ms is not None else told.get("debounce_ms", watching.DEBOUNCE_MS)
    before: dict[Path, TableProfile] = {}

    def render(path: Path) -> None:
        report = _profiled(args, str(path), conf)
        old = before.get(path.resolve())
        before[path.resolve()] = report
        if not args.no_clear and sys.stdout.isatty():
            print("\033[2J\033[H", end="")
        print(reports.diff_text(compare(old, report)) if args.diff and old else reports.text(report), flush=True)

    events = watching.debounced(watching.polled(lambda: watching.targets(args.paths), interval), wait)
    watching.watch(events, render, watching.targets(args.paths), lambda p, e: print(f"{p}: {e}", file=sys.stderr))
    return OK


def parlor(args: argparse.Namespace, conf: settings.LoadedConfig, voice: voices.Persona) -> int:
    opened = open_session(session(), args.path, table=args.table, sheet=_sheet(args.sheet))
    for sql in [args.sql] if args.sql else sys.stdin.read().split(";\n"):
        try:
            names, rows = opened.run_sql(sql)
        except (PySparkException, DialectError) as e:
            if args.sql:
                raise
            print(e, file=sys.stderr)
            continue
        if names:
            print(reports.table(names, [list(r) for r in rows]))
    return OK


def redact_(args: argparse.Namespace, conf: settings.LoadedConfig, voice: voices.Persona) -> int:
    if not args.output and not args.dry_run:
        raise UsageError("--output is needed, or --dry-run")
    df = load(session(), args.path, table=args.table, sheet=_sheet(args.sheet))
    report = profile(df, path=args.path, timeseries_=False, rules=conf.values.get("pii", {}).get("name_rules", []))
    plan = redact.build_plan(report, min_confidence=args.min_confidence, overrides=redact.parse_overrides(args.strategy))
    said: dict[str, Any] = {
        "path": args.path, "min_confidence": plan.min_confidence, "output": str(args.output) if args.output else None, "format": args.format or (redact.format_of(args.output) if args.output else None), "dry_run": args.dry_run,
        "actions": [vars(a) | {"default": a.strategy == redact.DEFAULTS.get(a.kind)} for a in plan.actions],
    }
    if not args.dry_run:
        said["counts"] = redact.run_redaction(df, args.output, plan, form=args.format)
        said["total_cells_redacted"] = sum(said["counts"].values())
    if args.json:
        print(json.dumps(said, indent=2, sort_keys=True))
    else:
        print("\n".join(f"{a.column}: {a.strategy} ({a.kind}, confidence {a.confidence:.2f}), {said.get('counts', {}).get(a.column, 0)} cells" for a in plan.actions) or "nothing to redact")
    return OK


def list_sheets(args: argparse.Namespace, *_) -> int:
    sheets = excel.list_sheets(args.path)
    print(json.dumps([{"name": n, "rows": r} for n, r in sheets]) if args.json else reports.table(["sheet", "rows"], [list(s) for s in sheets]))
    return OK


def mcp(*_) -> int:
    rpc.serve()
    return OK


def personas(*_) -> int:
    print(reports.table(["id", "voice"], [[p.id, p.name] for p in voices.PERSONAS.values()]))
    return OK


def config_(args: argparse.Namespace, conf: settings.LoadedConfig, *_) -> int:
    flat = {name: (conf.values if "." not in name else conf.values[name.split(".")[0]])[name.split(".")[-1]] for name in conf.sources}
    if args.json:
        print(json.dumps({"files": conf.sources_by_path, "values": {k: {"value": v, "source": conf.sources[k]} for k, v in flat.items()}}, default=str))
    else:
        print(reports.table(["setting", "value", "from"], [[k, v, conf.sources[k]] for k, v in flat.items()]) if flat else "no settings")
    return OK


COMMANDS = {"summon": summon, "read": read, "compare": compare_, "watch": watch, "parlor": parlor, "redact": redact_, "list-sheets": list_sheets, "mcp": mcp, "personas": personas, "config": config_}


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        conf = settings.load(args.config, disable=args.no_config)
        voice = voices.resolve(args.persona or conf.values.get("persona"))
        if not args.command:
            print(voice.greeting)
            parser().print_help()
            return OK
        return COMMANDS[args.command](args, conf, voice)
    except (UsageError, *WRONG) as e:
        print(f"error: {e}", file=sys.stderr)
        return BAD_INPUT


if __name__ == "__main__":
    sys.exit(main())
