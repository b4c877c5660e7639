"""Command line over the registered queries."""

from __future__ import annotations

import argparse
import importlib
import json
import sys


def main(argv: list[str] | None = None) -> int:
    from tidegraph import catalog

    queries, sql = catalog.queries(), catalog.oracle_sql()
    p = argparse.ArgumentParser(prog="tidegraph", description=__doc__)
    p.add_argument("--tables", default=".", help="folder of Parquet tables")
    p.add_argument("--catalog", action="append", default=[], help="module with further QUERIES and SQL")
    argv = sys.argv[1:] if argv is None else argv
    for name in p.parse_known_args([x for x in argv if x not in ("-h", "--help")])[0].catalog:
        more = importlib.import_module(name)
        queries, sql = queries | more.QUERIES, sql | more.SQL
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("run", "explain", "sql"):
        s = sub.add_parser(name)
        s.add_argument("query", choices=sorted(queries))
        if name == "run":
            s.add_argument("--out", help="write Parquet here, else print the first rows as JSON")
            s.add_argument("--rows", type=int, default=20)
    a = p.parse_args(argv)
    if a.command == "list":
        for name, f in queries.items():
            print(f"{name}\t{'sql' if name in sql else '-'}\t{(f.__doc__ or '').strip().splitlines()[0] if f.__doc__ else ''}")
        return 0
    if a.command == "sql":
        print(sql.get(a.query, "-- not expressed in SQL"))
        return 0
    from tidegraph.session import session

    df = queries[a.query](session(), a.tables)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.parquet(a.out)
    else:
        for row in df.limit(a.rows).toJSON().collect():
            print(json.dumps(json.loads(row), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
