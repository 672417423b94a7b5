"""``python -m gaugeworks``: list or run registered queries, show results, or say what runs here."""

from __future__ import annotations

import argparse
import json

from gaugeworks.session import session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gaugeworks", description=__doc__)
    top.add_argument("--master", default=None, help="Spark master; by default the one that is configured")
    todo = top.add_subparsers(dest="command", required=True)
    todo.add_parser("list", help="names of the registered queries")
    run = todo.add_parser("run", help="run a query over the tables in a folder")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet there instead of showing rows")
    results = todo.add_parser("results", help="the results of a run registry as Markdown")
    results.add_argument("root")
    audit = todo.add_parser("audit", help="duplicates and leaks among the documents in a folder")
    audit.add_argument("folder")
    settings = todo.add_parser("settings", help="settings as they resolve")
    settings.add_argument("path")
    settings.add_argument("overrides", nargs="*")
    todo.add_parser("info", help="versions and sizes")
    return top


def main(argv: list[str] | None = None) -> int:
    from gaugeworks.plans import catalog, catalog_models, catalog_studies  # noqa: F401  (they fill the catalog)
    from gaugeworks.sources import registry
    from gaugeworks.sources.settings import environment, read_settings

    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if args.command == "run" and args.query not in catalog.QUERIES:
        print(f"no query {args.query}")
        return 2
    spark = session(args.master)
    if args.command == "run":
        df = catalog.QUERIES[args.query](spark, args.folder)
        df.write.mode("overwrite").parquet(args.out) if args.out else print(registry.markdown(df))
    elif args.command == "results":
        found = registry.Registry(spark, args.root).results()
        print("no results" if found is None else registry.markdown(found.drop("spec").orderBy("run_id")))
    elif args.command == "audit":
        print(registry.markdown(catalog.QUERIES["leak_audit"](spark, args.folder)))
    elif args.command == "settings":
        print(json.dumps(read_settings(spark, args.path, args.overrides), indent=1, sort_keys=True))
    else:
        print(json.dumps(environment(spark), indent=1, sort_keys=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
