"""Load a file of operations as one commit: ``python -m tessera.tools.load STORE ORG/DB COMMIT FILE``.

Ends with 1 if any document was skipped, 2 if nothing was indexed.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tessera.functions.strings import parse_path
from tessera.operators.embed import HashingProvider
from tessera.operators.ingest import push
from tessera.operators.versions import Conflict, NotFound, Store, Unavailable
from tessera.sources import ndjson


def main(argv: list[str] | None = None, spark: SparkSession | None = None, provider=None) -> int:
    p = argparse.ArgumentParser(prog="load", description=__doc__)
    p.add_argument("store", help="folder of the datasets")
    p.add_argument("domain", help="org/db[/repo/branch/name]")
    p.add_argument("commit")
    p.add_argument("file", help="NDJSON operations")
    p.add_argument("--dim", type=int, default=64, help="dimension of the hashing provider")
    p.add_argument("--clustering", action="store_true")
    p.add_argument("--strict", action="store_true", help="an inserted document must be new")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    where = parse_path(a.domain)
    store = Store.domain(spark, a.store, where["org"], where["db"])
    try:
        report = push(store, a.commit, where["ref"], ndjson.read(spark, a.file).drop("line"), provider or HashingProvider(a.dim), strict=a.strict, clustering=a.clustering)
    except (ndjson.Malformed, ndjson.Aborted, Conflict, NotFound, Unavailable) as e:
        print(f"nothing was indexed: {type(e).__name__}: {e}", file=sys.stderr)
        return 2
    print(f"version {report.version}: {report.indexed} indexed, {report.deleted} deleted, {len(report.skipped)} skipped")
    for doc, why in report.skipped:
        print(f"skipped {doc}: {why}", file=sys.stderr)
    return 1 if report.skipped else 0


if __name__ == "__main__":
    sys.exit(main())
