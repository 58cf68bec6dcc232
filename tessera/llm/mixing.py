"""Operator 6: mixing sources to target weights by pivotal dependent rounding.

Each source's expected copies per document are its target share of the
corpus's characters over its own characters.  The whole part is given to every
document; the fractional parts are rounded together: two units meet, and mass
moves at random from one to the other until one of them is 0 or 1, so that
every unit keeps its expectation and each source's total is kept to the last
unit.  Units meet first inside hash buckets of a source; the one fractional
unit a bucket leaves goes up a tree that merges ``FAN_IN`` buckets at a time.
The random numbers are hashes of ids, so any rerun of a task draws the same.

Cases: a unit is a (doc_id, source) pair, and rows that repeat it get the same
copies; a null source is a source of its own, a null doc_id an id of its own;
null or negative ``n_chars`` count as 0, and a source without characters gets
no copies unless its documents can't carry a share (then its weight goes to
the others); weights for sources that aren't there are ignored, absent or
non-positive weights give no copies; an empty table gives an empty result;
texts aren't read; other columns are ignored by ``copies`` and kept by ``mix``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64, shared_dir, written

SEED = 20_240
#: Without target weights a source's share is its share of characters to this power.
FLATTEN = 0.5
#: Characters wanted, as a multiple of the corpus.
BUDGET = 1.0
#: Units that a bucket should hold.
BUCKET_UNITS = 20_000
FAN_IN = 16

_UNITS = "doc_id long, source string, n_rows long, bucket long, base long, p double, decided boolean"


def uniforms(h: np.ndarray, level: int, seed: int) -> np.ndarray:
    """One number in (0, 1) per unit and level."""
    salt = mix64(np.array([seed * 1_000_003 + level], np.uint64))
    return ((mix64(h.view(np.uint64) ^ salt) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def pivot(p: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounded values, all 0 or 1 but the one at the returned place (-1: none)."""
    out = p.tolist()
    draws = u.tolist()
    held = -1
    for i, q in enumerate(out):
        if q <= 1e-12 or q >= 1 - 1e-12:
            out[i] = float(round(q))
            continue
        if held < 0:
            held = i
            continue
        a = out[held]
        s = a + q
        if s < 1:
            if draws[i] * s < a:
                out[held], out[i] = s, 0.0
            else:
                out[held], out[i] = 0.0, s
                held = i
        elif draws[i] * (2 - s) < 1 - q:
            out[held], out[i] = 1.0, s - 1
            held = i
        else:
            out[held], out[i] = s - 1, 1.0
        left = out[held]
        if left <= 1e-12 or left >= 1 - 1e-12:
            out[held] = float(round(left))
            held = -1
    return np.array(out), held


def _rounds(level: int, seed: int, last: bool):
    """Rows sorted by (source, bucket, h): one pivotal pass per bucket."""

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, own in g.groupby(["source", "bucket"], sort=False, dropna=False):
            own = own.sort_values(["h", "doc_id"])
            u = uniforms(own["h"].to_numpy(np.int64), level, seed)
            value, held = pivot(own["p"].to_numpy(float), u)
            decided = np.ones(len(own), bool)
            if held >= 0 and last:
                # a number of its own, not the one that it met another unit with
                draw = uniforms(own["h"].to_numpy(np.int64)[held : held + 1], level + 1_000, seed)[0]
                value[held] = float(draw < value[held])
            elif held >= 0:
                decided[held] = False
            parts.append(own.assign(p=value, decided=decided))
        out = pd.concat(parts)
        return out[["doc_id", "source", "n_rows", "bucket", "base", "p", "decided"]].astype({"doc_id": "Int64"})

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.astype({"doc_id": "Int64"})
            same = lambda a, b: a["bucket"] == b["bucket"] and (a["source"] == b["source"] or (a["source"] is None and b["source"] is None))
            end = batch.iloc[-1]
            if held and same(held[-1].iloc[-1], end) and same(batch.iloc[0], end):
                held.append(batch)
                continue
            other = (batch["bucket"] != end["bucket"]) | (batch["source"].isna() if end["source"] is not None else batch["source"].notna())
            if end["source"] is not None:
                other |= (batch["source"] != end["source"]).fillna(True)
            cut = int(other.to_numpy(bool).sum())
            ready = pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = [batch.iloc[cut:]]
            if len(ready):
                yield whole(ready)
        if held:
            yield whole(pd.concat(held, ignore_index=True))

    return run


def expected(docs: DataFrame, weights: dict | None = None, flatten: float = FLATTEN, budget: float = BUDGET) -> DataFrame:
    """(source, expected): copies that a document of each source should have on average."""
    sizes = docs.groupBy("source").agg(F.sum(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        aimed = sizes.withColumn("w", F.pow("chars", F.lit(float(flatten))))
    else:
        rows = [(k, float(v)) for k, v in weights.items() if v is not None and v > 0]
        given = docs.sparkSession.createDataFrame(rows, "source string, w double")
        aimed = sizes.join(given.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    aimed = aimed.withColumn("w", F.when(F.col("chars") > 0, F.coalesce("w", F.lit(0.0))).otherwise(0.0))
    whole = aimed.agg(F.sum("w").alias("all_w"), F.sum("chars").alias("all_chars"))
    share = F.col("w") / F.col("all_w") * F.col("all_chars") * F.lit(float(budget)) / F.col("chars")
    # one row of totals beside one row per source
    return aimed.crossJoin(F.broadcast(whole)).select("source", F.when((F.col("chars") > 0) & (F.col("all_w") > 0), share).otherwise(0.0).alias("expected"))


def copies(docs: DataFrame, weights: dict | None = None, seed: int = SEED, bucket_units: int = BUCKET_UNITS, **how) -> DataFrame:
    """(doc_id, source, expected, copies), a row for every unit."""
    folder = shared_dir(docs.sparkSession)
    aim = written(expected(docs, weights, **how), f"{folder}/expected")
    units = docs.groupBy("doc_id", "source").agg(F.count("*").alias("n_rows"))
    aims = aim.select(F.col("source").alias("s"), "expected")
    units = units.join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    units = written(units, f"{folder}/units")
    buckets = max(1, math.ceil(units.count() / bucket_units))
    h = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-(2**62))), F.coalesce("source", F.lit("\u0000")))
    rows = units.select(
        "doc_id", "source", "n_rows", F.pmod(h, F.lit(buckets)).alias("bucket"), F.floor("expected").alias("base"), (F.col("expected") - F.floor("expected")).alias("p")
    )
    done, level = None, 0
    while True:
        last = buckets == 1
        ordered = rows.withColumn("h", h).repartition("source", "bucket").sortWithinPartitions("source", "bucket", "h")
        out = written(ordered.mapInPandas(_rounds(level, seed, last), _UNITS), f"{folder}/level{level}")
        fixed = out.where("decided")
        done = fixed if done is None else done.unionByName(fixed)
        if last:
            break
        buckets, level = math.ceil(buckets / FAN_IN), level + 1
        rows = out.where("not decided").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).drop("decided")
    return done.join(aims, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "expected", (F.col("base") + F.col("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: dict | None = None, seed: int = SEED, **how) -> DataFrame:
    """The rows of docs that get a copy, with all their columns and ``copies``."""
    name = "copies" if "copies" not in docs.columns else "mix_copies"
    taken, mark = {c.lower() for c in docs.columns}, "_mix"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    drawn = copies(docs, weights, seed, **how).where("copies > 0").select(F.col("doc_id").alias(f"{mark}d"), F.col("source").alias(f"{mark}s"), F.col("copies").alias(name))
    same = F.col("doc_id").eqNullSafe(F.col(f"{mark}d")) & F.col("source").eqNullSafe(F.col(f"{mark}s"))
    return docs.join(drawn, same).select(*docs.columns, name)
