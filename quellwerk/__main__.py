"""python -m quellwerk QUERY TABLES [OUT]: run a registered query over a folder of tables; show it, or write it as parquet."""

from __future__ import annotations

import argparse

from quellwerk.session import build_session


def main(arguments: list[str] | None = None) -> None:
    from quellwerk.plans.registry import QUERIES

    parser = argparse.ArgumentParser(prog="quellwerk", description="Run a registered query.")
    parser.add_argument("query", choices=sorted(QUERIES))
    parser.add_argument("tables", help="folder of parquet tables")
    parser.add_argument("out", nargs="?", help="folder for the result; shown without one")
    told = parser.parse_args(arguments)
    result = QUERIES[told.query](build_session(), told.tables)
    result.write.mode("overwrite").parquet(told.out) if told.out else result.show(50, truncate=80)


if __name__ == "__main__":
    main()
