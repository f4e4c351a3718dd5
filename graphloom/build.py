"""Builds the concept graph of a database from a CSV catalog.

    python -m graphloom.build CATALOG DATABASE FOLDER [--tables FILE] [--model MODULE:NAME] [--reviewer MODULE:NAME] [--purpose TEXT]

CATALOG has a row for each column (table, column, and if there are any type and
description).  FOLDER gets ``<graph>_concept_graph.json``.
"""

from __future__ import annotations

import argparse

from graphloom.operators import building
from graphloom.sources.catalog import columns_catalog, group_columns, read_csv, table_filter
from graphloom.sources.store import write_document
from graphloom.unifying import named_callable


def main(argv: list[str] | None = None) -> int:
    from graphloom.session import session

    p = argparse.ArgumentParser(prog="graphloom.build", description="Build a concept graph")
    p.add_argument("catalog")
    p.add_argument("database")
    p.add_argument("folder")
    p.add_argument("--tables")
    p.add_argument("--model")
    p.add_argument("--reviewer")
    p.add_argument("--purpose", default=building.Context.purpose)
    a = p.parse_args(argv)
    spark = session("build")
    tables = group_columns(columns_catalog(read_csv(spark, a.catalog), a.database)).drop("parts")
    only = [r["table_name"] for r in table_filter(spark, a.tables).collect()] if a.tables else None
    context = building.Context(a.database, a.purpose)
    graph, trace = building.build(tables, a.database, named_callable(a.model), named_callable(a.reviewer), only, [context])
    path = f"{a.folder.rstrip('/')}/{context.name()}_concept_graph.json"
    write_document(spark, building.as_document(graph), path)
    print("\n".join([*trace, path]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
