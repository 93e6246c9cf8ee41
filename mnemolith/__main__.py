"""Command line: validate, fingerprint, diff, merge and hygiene over bundle files."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.jsonschema import errors, schema_errors
from .operators import bundles, hygiene
from .schemas import FIELDS, json_schema
from .session import prepare
from .sources import jsonio


def _spark() -> SparkSession:
    builder = SparkSession.builder.appName("mnemolith").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    spark = prepare(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _bundle(spark: SparkSession, path: str, ix: int = 0, id_field: str = "id"):
    return bundles.envelope(jsonio.read_bundle(spark, path), doc="doc", position="pos", bundle_ix=ix, id_field=id_field)


def _listed(rows, args: argparse.Namespace) -> list:
    """Rows of an ordered result: all of them, or as many as were asked for."""
    return list((rows.limit(args.most) if args.most else rows).toLocalIterator())


def validate(args: argparse.Namespace) -> tuple[int, dict]:
    schema = json_schema(args.schema)
    if args.jsonl or args.bundle:
        if args.jsonl:
            found = jsonio.validate_jsonl(_spark(), args.path, schema).select(F.col("line").alias("at"), "errors")
        else:
            docs = jsonio.read_bundle(_spark(), args.path)
            found = docs.select(F.col("pos").alias("at"), schema_errors(F.col("doc"), schema).alias("errors")).where(F.size("errors") > 0)
        total = found.count()
        bad = [{"line" if args.jsonl else "record": r["at"], "errors": r["errors"]} for r in _listed(found.orderBy("at"), args)]
    else:
        bad = list(errors(jsonio.load_single_json(args.path), schema))
        total, bad = len(bad), bad[: args.most or None]
    return int(total > 0), {"total": total, "errors": bad}


def fingerprint(args: argparse.Namespace) -> tuple[int, dict]:
    return 0, {"fingerprint": bundles.fingerprint(_bundle(_spark(), args.path, id_field=args.id_field))}


def diff(args: argparse.Namespace) -> tuple[int, dict]:
    spark = _spark()
    changes = bundles.diff(_bundle(spark, args.left, id_field=args.id_field), _bundle(spark, args.right, 1, args.id_field))
    counts = {s: 0 for s in ("added", "removed", "changed", "unchanged")} | {r.status: r.records for r in bundles.diff_summary(changes).collect()}
    listed = _listed(changes.where("status <> 'unchanged'").orderBy("status", "id").select("id", "status"), args)
    return int(any(counts[s] for s in ("added", "removed", "changed"))), {"counts": counts, "changes": [{"id": r.id, "status": r.status} for r in listed]}


def merge(args: argparse.Namespace) -> tuple[int, dict]:
    spark = _spark()
    both = None
    for ix, path in enumerate(args.paths):
        part = _bundle(spark, path, ix, args.id_field)
        both = part if both is None else both.unionByName(part)
    merged = bundles.merge(both, prefer=args.prefer)
    if args.out:
        merged.records.orderBy("id").select(F.col("doc").alias("value")).write.mode("overwrite").text(args.out)
    conflicts = [r.id for r in _listed(merged.conflicts.orderBy("id").select("id"), args)]
    duplicates = [r.id for r in _listed(merged.duplicate_ids.orderBy("bundle_ix", "pos"), args)]
    totals = {"records": merged.records.count(), "conflicts": merged.conflicts.count(), "duplicate_ids": merged.duplicate_ids.count()}
    return 0, {"records": totals["records"], "totals": totals, "conflicts": conflicts, "duplicate_ids": duplicates}


def hygiene_report(args: argparse.Namespace) -> tuple[int, dict]:
    spark = _spark()
    docs = jsonio.read_bundle(spark, args.path)
    fields = {"id", "ledger_type", "candidate_type", "privacy_class", "valid_from", "valid_until", "stale_after", "asserted_at", "observed_at", "created_at", "updated_at"}
    record = F.from_json("doc", ", ".join([f"{f} string" for f in sorted(fields)] + ["superseded_by array<string>", "evidence_span_ids array<string>"]))
    rows = docs.select(record.alias("r")).select("r.*")
    now = F.lit(args.now).cast("timestamp") if args.now else F.current_timestamp()
    whole = bundles.envelope(docs, doc="doc", position="pos", id_field=args.id_field)
    report = hygiene.report(rows, rows.select("id"), now=now, window_start=args.window_start, window_end=args.window_end, fingerprint=bundles.fingerprint(whole))
    return 0, {"id": report.id, "fingerprint": report.fingerprint, "counts": report.counts, "by": report.by, "missing_evidence": report.missing_evidence, "orphaned_evidence": report.orphaned_evidence, "window": [report.window_start, report.window_end], "markdown": report.markdown()}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mnemolith", allow_abbrev=False)
    top.add_argument("--version", action="version", version=__version__)
    shared = argparse.ArgumentParser(add_help=False, allow_abbrev=False)
    shared.add_argument("--json", action="store_true", help="print one JSON object")
    shared.add_argument("--most", type=int, default=0, help="how many errors, changes or ids to list (0: all); totals are always given")
    shared.add_argument("--id-field", default="id")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, run, **kw: sub.add_parser(name, parents=[shared], allow_abbrev=False, **kw)
    p = add("validate", validate)
    p.add_argument("path")
    p.add_argument("--schema", required=True, choices=sorted(FIELDS))
    p.add_argument("--jsonl", action="store_true")
    p.add_argument("--bundle", action="store_true")
    p.set_defaults(run=validate)
    p = add("fingerprint", fingerprint)
    p.add_argument("path")
    p.set_defaults(run=fingerprint)
    p = add("diff", diff)
    p.add_argument("left")
    p.add_argument("right")
    p.set_defaults(run=diff)
    p = add("merge", merge)
    p.add_argument("paths", nargs="+")
    p.add_argument("--prefer", choices=("last", "first", "raise"), default="last")
    p.add_argument("--out")
    p.set_defaults(run=merge)
    p = add("hygiene", hygiene_report)
    p.add_argument("path")
    p.add_argument("--now")
    p.add_argument("--from", dest="window_start")
    p.add_argument("--to", dest="window_end")
    p.set_defaults(run=hygiene_report)
    return top


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0 fine, 1 differences or violations, 2 unusable input."""
    words = list(sys.argv[1:] if argv is None else argv)
    if words[:1] == ["--json"]:  # --json may also come before the command
        words = [*words[1:], "--json"]
    args = parser().parse_args(words)
    paths = [getattr(args, n) for n in ("path", "left", "right") if hasattr(args, n)] + list(getattr(args, "paths", ()))
    try:
        missing = [p for p in paths if "://" not in p and not Path(p).exists()]
        if missing:
            raise FileNotFoundError(f"no such file: {missing[0]}")
        code, result = args.run(args)
    except (ValueError, OSError) as error:
        print(json.dumps({"ok": False, "error": str(error)}) if args.json else f"error: {error}", file=sys.stderr)
        return 2
    if args.json:
        print(json.dumps({"ok": code == 0, "command": args.command, **result}))
    else:
        print("\n".join(f"{k}: {v}" for k, v in result.items()))
    return code


if __name__ == "__main__":
    sys.exit(main())
