"""Command line: load NDJSON source files into tables, then print reports.

    python -m commitlens load --in data/ --out tables/ [--mode refresh|accumulate --prior old/]
    python -m commitlens apply --tables tables/ --changes changes.json --out tables2/ [--mode if_absent|upsert]
    python -m commitlens store --tables tables/ --out store/ [--ranges N]
    python -m commitlens apply --tables store/ --changes changes.json [--mode if_absent|upsert]
    python -m commitlens read --tables tables/ --hash H
    python -m commitlens list --tables tables/ --repo R [--top N]
    python -m commitlens search --tables tables/ --author PATTERN [--top N]
    python -m commitlens report words|activity|licenses|languages|watch|tiers|names|repos \
        --tables tables/ [--repo NAME] [--top N] [--ties asc|desc] [--out reports/]

Reports are computed by Spark over the stored tables; only the small report
rows are shown, and reports with a row per repository are written to a folder.
"""

from __future__ import annotations

import argparse

from commitlens.plans import load as LD
from commitlens.plans import reports as RP
from commitlens.plans import store as SO
from commitlens.session import build_session, read_if_exists


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="commitlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ld = sub.add_parser("load")
    ld.add_argument("--in", dest="in_dir", required=True)
    ld.add_argument("--out", dest="out_dir", required=True)
    ld.add_argument("--mode", default="refresh", choices=["refresh", "accumulate"])
    ld.add_argument("--prior", default=None)
    chg = sub.add_parser("apply")
    chg.add_argument("--tables", required=True)
    chg.add_argument("--changes", required=True)
    chg.add_argument("--out", dest="out_dir", default=None, help="new table folder; a store gets a new version in place")
    chg.add_argument("--mode", default="if_absent", choices=["if_absent", "upsert"])
    sto = sub.add_parser("store")
    sto.add_argument("--tables", required=True)
    sto.add_argument("--out", dest="out_dir", required=True)
    sto.add_argument("--ranges", type=int, default=SO.RANGES)
    for name in ("read", "list", "search"):
        rec = sub.add_parser(name)
        rec.add_argument("--tables", required=True)
        rec.add_argument("--hash", default=None)
        rec.add_argument("--repo", default=None)
        rec.add_argument("--author", default=None)
        rec.add_argument("--top", type=int, default=10)
    rp = sub.add_parser("report")
    rp.add_argument("name", choices=["words", "activity", "licenses", "languages", "watch", "tiers", "names", "repos"])
    rp.add_argument("--tables", required=True)
    rp.add_argument("--repo", default=None)
    rp.add_argument("--top", type=int, default=None)
    rp.add_argument("--ties", default=None, choices=["asc", "desc"])
    rp.add_argument("--out", default=None, help="write the report there instead of showing it")
    ap.add_argument("--master", default=None, help="default: that of spark-submit, else local[*]")
    ap.add_argument("--cores", type=int, default=None, help="cores of the cluster: sizes shuffles and splits for it")
    args = ap.parse_args(argv)
    if args.cmd == "report" and args.ties and args.name not in ("activity", "licenses", "languages"):
        ap.error(f"--ties does not apply to report {args.name}")
    if args.cmd == "report" and args.out is None and (args.name == "repos" or args.name == "activity" and not args.repo):
        ap.error(f"report {args.name} has a row per repository: name a folder with --out")

    spark = build_session(args.master, total_cores=args.cores)
    if args.cmd == "load":
        written: dict = {}
        paths = LD.load_from_files(spark, args.in_dir, args.out_dir, args.mode, args.prior, metrics=written)
        for name in sorted(paths):
            rows = f" ({written[name]:,} rows)" if name in written else ""
            print(f"{name}: {paths[name]}{rows}")
        if "rejects" in paths:
            spark.read.parquet(paths["rejects"]).orderBy("source", "outcome").show(truncate=False)
        return 0

    if args.cmd == "store":
        store = SO.CommitStore.create(spark, args.out_dir, spark.read.parquet(f"{args.tables.rstrip('/')}/commits"), args.ranges)
        print(f"{args.out_dir}: version {store.version}, {store.ranges} ranges")
        return 0

    if args.cmd == "apply" and read_if_exists(spark, f"{args.tables.rstrip('/')}/versions") is not None:
        if args.out_dir:
            ap.error("a store gets a new version in place: leave out --out")
        store = SO.CommitStore(spark, args.tables)
        changes, rejects = LD.read_changes(spark, args.changes)
        store.apply(changes, args.mode).groupBy("op", "status").count().orderBy("op", "status").show(truncate=False)
        rejects.show(truncate=False)
        print(f"{args.tables}: version {store.version}")
        return 0

    if args.cmd == "apply":
        if not args.out_dir:
            ap.error("apply needs --out")
        written: dict = {}
        paths = LD.apply_change_file(spark, args.tables, args.changes, args.out_dir, args.mode, metrics=written)
        for name in sorted(paths):
            print(f"{name}: {paths[name]} ({written.get(name, 0):,} rows)")
        status = spark.read.parquet(paths["change_status"])
        status.groupBy("op", "status").count().orderBy("op", "status").show(truncate=False)
        return 0

    def t(name):
        if store is not None and name in SO.TABLES:
            return store.read(name)
        return spark.read.parquet(f"{args.tables.rstrip('/')}/{name}")

    store = SO.CommitStore(spark, args.tables) if read_if_exists(spark, f"{args.tables.rstrip('/')}/versions") is not None else None

    if args.cmd in ("read", "list", "search"):
        from pyspark.sql import functions as F

        from commitlens.operators import lookup as L

        commits = t("commits")
        if args.cmd == "read":
            keyed = commits if store is None else store.lookup(spark.createDataFrame([(args.hash,)], "commit_hash string"))
            out = L.read_record(keyed, args.hash).withColumn("files_changed", F.to_json("files_changed"))
        elif args.cmd == "list":
            out = L.list_by_repo(commits, args.repo, args.top)
        else:
            out = L.search_author(commits, args.author, args.top).select(
                "commit_hash", "repo_name", "author_name", "subject")
        out.show(args.top, truncate=False)
        return 0

    kw = {} if args.top is None else {"n": args.top}
    if args.ties:
        kw["ties"] = args.ties
    frames = []
    if args.name == "words":
        frames = [RP.word_report(t("commits"), **{k: v for k, v in kw.items() if k == "n"})]
    elif args.name == "activity":
        if args.repo:
            frames = [RP.commit_activity(t("author_counts"), args.repo, **kw)]
        else:
            frames = [RP.commit_activity_all(t("author_counts"), **kw)]
    elif args.name == "licenses":
        frames = [RP.license_report(t("license_counts"), **kw)]
    elif args.name == "languages":
        frames = [RP.language_report(t("language_bytes"), **kw)]
    elif args.name == "watch":
        frames = list(RP.watch_report_buckets(t("repos"), **{k: v for k, v in kw.items() if k == "n"}))
    elif args.name == "tiers":
        frames = list(RP.watch_report_tiers(t("repos"), **{k: v for k, v in kw.items() if k == "n"}))
    elif args.name == "names":
        frames = list(RP.name_report(t("repos"), **{k: v for k, v in kw.items() if k == "n"}))
    elif args.name == "repos":
        frames = [RP.loaded_repositories(t("commits"))]
    for i, df in enumerate(frames):
        order = [c for c in ("rank", "tier_order", "bucket_order") if c in df.columns]
        if args.out:
            df.write.parquet(args.out if len(frames) == 1 else f"{args.out}/{i}")
        else:  # these reports have n rows, or one per tier or bucket
            rows = (df.orderBy(*order) if order else df).toPandas()
            print(rows.to_string(index=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
