"""Command line: validate a release, or search it."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate", help="check a release")
    v.add_argument("release")
    v.add_argument("--skip-hashes", action="store_true", help="do not read the files to compare their digests")
    s = sub.add_parser("search", help="search a release")
    s.add_argument("release")
    s.add_argument("query")
    s.add_argument("--top-k", type=int, default=10)
    s.add_argument("--windows-per-hit", type=int, default=3)
    s.add_argument("--first-stage-only", action="store_true")
    s.add_argument("--no-reranker", action="store_true", help="the first stage's order; no reranking model is built")
    args = p.parse_args(argv)
    from tessera.session import session
    from tessera.sources.release import load_release, validate_release

    spark = session("tessera")
    release = load_release(spark, args.release)
    if args.command == "validate":
        problems = validate_release(release, hashes=not args.skip_hashes)
        print(json.dumps({"valid": not problems, "problems": problems}))
        return int(bool(problems))
    from tessera.plans.search import Engine, SearchConfig

    queries = spark.createDataFrame([("q", args.query)], "query_id string, query_text string")
    for r in Engine(release, config=SearchConfig(top_k=args.top_k, windows_per_hit=args.windows_per_hit, first_stage_only=args.first_stage_only or args.no_reranker)).search(queries).orderBy("rank").collect():
        print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
