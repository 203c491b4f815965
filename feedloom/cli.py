"""Command line: ``python -m feedloom.cli run|backfill|weekly|weeks|list|show ...``. Exit codes: 0 ok or skipped, 1 failed, 2 partial, 64 usage."""

from __future__ import annotations

import argparse
import json
import sys

from .plans import pipeline, runplan


def _one(spark, config, args, week: str | None) -> dict:
    from .sources.audit_log import AuditLog

    plan = runplan.build_plan(config, args.product, week, args.dry_run, True if getattr(args, "draft_only", False) else None, getattr(args, "force_resend", False))
    out = pipeline.execute(spark, plan, config, spark.read.parquet(args.landed), AuditLog(spark, f"{args.out}/audit"), args.out)
    return {"run_id": plan.run_id, "product": plan.product.slug, "iso_week": plan.iso_week, "status": out.status, "reason": out.reason, **out.counts}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="feedloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "backfill"):
        p = sub.add_parser(name)
        p.add_argument("--product", required=True)
        p.add_argument("--config", required=True)
        p.add_argument("--landed", required=True, help="Parquet of landed reviews")
        p.add_argument("--out", default="runs")
        p.add_argument("--dry-run", action="store_true")
        if name == "run":
            p.add_argument("--week")
            p.add_argument("--force-resend", action="store_true")
            p.add_argument("--draft-only", action="store_true")
        else:
            p.add_argument("--weeks", required=True, help="A..B")
    p = sub.add_parser("weekly", help="the last complete week of all products")
    for name in ("--config", "--landed"):
        p.add_argument(name, required=True)
    p.add_argument("--out", default="runs")
    p.add_argument("--dry-run", action="store_true")
    one = sub.add_parser("show")
    one.add_argument("--audit", required=True)
    one.add_argument("run_id")
    weeks = sub.add_parser("weeks")
    weeks.add_argument("range", help="A..B")
    show = sub.add_parser("list")
    show.add_argument("--audit", required=True)
    show.add_argument("--product")
    show.add_argument("--limit", type=int, default=50)
    args = parser.parse_args(argv)
    try:
        if args.command == "weeks":
            print("\n".join(runplan.week_range(*args.range.split("..", 1))))
            return 0
        from .session import build_session
        from .shipping import ship

        spark = build_session()
        ship(spark)
        if args.command == "list":
            from .operators.audit import recent
            from .sources.audit_log import AuditLog

            runs = AuditLog(spark, args.audit).state()
            for row in recent(runs.where(runs.product == args.product) if args.product else runs, args.limit).collect():
                print(json.dumps(row.asDict(), default=str))
            return 0
        if args.command == "show":
            from .sources.audit_log import AuditLog

            row = AuditLog(spark, args.audit).get(args.run_id)
            if row is None:
                print(f"no run {args.run_id}", file=sys.stderr)
                return 1
            print(json.dumps(row.asDict(), default=str))
            return 0
        config = runplan.load_config(args.config)
        if args.command == "weekly":
            from .sources.audit_log import AuditLog

            plans = [runplan.build_plan(config, slug, dry_run=args.dry_run) for slug, p in sorted(config.products.items()) if p.sources]
            done = pipeline.weekly(spark, config, plans, spark.read.parquet(args.landed), AuditLog(spark, f"{args.out}/audit"), args.out)
            for run_id, status in done.items():
                print(json.dumps({"run_id": run_id, "status": status}))
            return pipeline.exit_code(done.values())
        todo = [args.week] if args.command == "run" else runplan.week_range(*args.weeks.split("..", 1))
        results = [_one(spark, config, args, week) for week in todo]
    except (runplan.PlanError, TypeError) as e:
        print(e, file=sys.stderr)
        return 64
    for r in results:
        print(json.dumps(r))
    return pipeline.exit_code(r["status"] for r in results)


if __name__ == "__main__":
    sys.exit(main())
