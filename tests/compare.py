"""Run a registered query and its checking SQL on the same files and compare the results.

Usage: python -m tests.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return repr(float(value)) if isinstance(value, float) else value


def compare(df, connection, sql: str) -> list[str]:
    """Differences in columns, types and rows; empty when the two agree."""
    described = {r[0]: r[1] for r in connection.execute(f"DESCRIBE {sql}").fetchall()}
    types = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    if described != types:
        return [f"columns differ: {set(types.items()) ^ set(described.items())}"]
    names = sorted(types)
    ours = Counter(tuple(_plain(row[n]) for n in names) for row in df.collect())
    picked = ", ".join(f'"{n}"' for n in names)
    theirs = Counter(tuple(_plain(v) for v in row)
                     for row in connection.execute(f"SELECT {picked} FROM ({sql})").fetchall())
    if ours == theirs:
        return []
    return [f"rows {sum(ours.values())} vs {sum(theirs.values())}",
            f"only here: {list((ours - theirs).items())[:3]}",
            f"only there: {list((theirs - ours).items())[:3]}"]


def main() -> int:
    sys.path.insert(0, str(Path(__file__).parent.parent))
    from yardframe.catalog import registry
    from yardframe.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registry.QUERIES)
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = registry.QUERIES[name](spark, folder)
            sql = registry.CHECKS.get(name)
            if sql is None:
                problems, note = [], f"{df.count()} rows, no check"
            else:
                problems, note = compare(df, connection, sql), "ok"
        except Exception as error:  # report and go on with the next query
            problems, note = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        failed += bool(problems)
        print(f"{name}: {'FAIL ' + ' | '.join(problems) if problems else note} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
