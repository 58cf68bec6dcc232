"""Fill an embedding cache from a commit's stored vectors: ``python -m tessera.tools.prime_cache STORE ORG/DB COMMIT MODEL CACHE``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.strings import cache_key, parse_path, task_prefix
from tessera.operators.versions import NotFound, Store


def entries(chunks: DataFrame, model: str, clustering: bool = False) -> DataFrame:
    """(key, vector) of every distinct chunk text, as ``embed`` looks them up."""
    role, column = ("clustering", "clustering_embedding") if clustering else ("document", "embedding")
    key = cache_key(F.lit(model), F.concat(F.lit(task_prefix(model, role)), "content"))
    stored = chunks.where(F.exists(column, lambda x: x != 0)).select(key.alias("key"), F.col(column).alias("vector"))
    return stored.groupBy("key").agg(F.min("vector").alias("vector"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="prime_cache", description=__doc__)
    for name in ("store", "domain", "commit", "model", "cache"):
        p.add_argument(name)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    where = parse_path(a.domain)
    try:
        live = Store.domain(spark, a.store, where["org"], where["db"]).at(a.commit)
    except NotFound as e:
        print(f"no such commit: {e}", file=sys.stderr)
        return 2
    entries(live, a.model).unionByName(entries(live, a.model, clustering=True)).write.mode("append").parquet(a.cache)
    return 0


if __name__ == "__main__":
    sys.exit(main())
