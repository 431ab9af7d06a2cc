"""Run a registered query: python -m corpusloom QUERY TABLES OUTPUT [--format json|parquet]"""

from __future__ import annotations

import argparse

from corpusloom.plans import registry
from corpusloom.session import local_session
from corpusloom.sources.jsonl import write_atomic


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    p.add_argument("query", choices=sorted(registry.QUERIES))
    p.add_argument("tables", help="folder of the test tables")
    p.add_argument("output", help="folder that is replaced at the end")
    p.add_argument("--format", choices=("json", "parquet"), default="json")
    x = p.parse_args(args)
    write_atomic(registry.QUERIES[x.query](local_session(), x.tables), x.output, x.format)


if __name__ == "__main__":
    main()
