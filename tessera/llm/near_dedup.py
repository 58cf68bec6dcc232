"""Operator 10: MinHash near-duplicates with sequential Bayesian verification.

Documents whose word 3-shingle sets have Jaccard similarity of at least
``THRESHOLD`` are linked; a group is a connected component of those links, and
its least ``doc_id`` stays.

1. One pass makes a content hash, 128 MinHashes (kept as 8-bit values) and 28
   band keys of 4 MinHashes per document.  Equal contents collapse first.
2. Documents that share a band key are candidates.  Inside a bucket the 8-bit
   signatures are compared 32 at a time; a pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold falls below
   ``MISS``.  Pairs that earlier surviving pairs of the bucket already connect
   are skipped: they can't change a component.  A bucket of more than ``HOT``
   documents is cut into groups, each a task of its own; pairs of different
   groups are compared in the first of the rounds of step 4, a task for each
   pair of groups.
3. Every survivor is verified on the exact shingle sets of whole texts.  Only
   texts of candidates are shuffled; those that pair with the same document come
   to it, ``HUB`` at a time, so its shingles are made once for all of them.
4. Buckets in which a survivor failed are compared again from the verified
   components, without the failed pairs, until no bucket yields a new pair; so
   what step 2 skipped is never lost.  These rounds skip only what verified
   links connect, and each tries 16 times as many pairs of a document and a
   component, so there are few.

Cases: null ``doc_id`` rows take no part and stay; null, empty and blank texts
have no shingles and are never duplicates; texts under three words are one
shingle; rows that repeat a ``doc_id`` are one document, linked through each
of its texts; of a group the least ``doc_id`` stays, so ties don't arise; very
long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, in_batches, mix64, release, shared_dir, slices, small, words, written
from tessera.llm.components import connected_components

THRESHOLD = 0.6
SHINGLE = 3
HASHES, BATCH = 128, 32
BANDS, ROWS = 28, 4
MISS = 0.005
#: Buckets up to this size are compared pair by pair in one vector operation.
DENSE = 64
#: Documents of a bucket that one task compares, at most.
HOT = 20_000
#: Documents verified against one and the same document in a task, at most.
HUB = 2_000
#: Bits of the filter that keeps texts of no candidate out of the shuffle, at most (8 MB).
FILTER_BITS = 1 << 26
#: In ``other``: the row is a member of its bucket, not a failed pair.
_MEMBER = -(2**63)

_rng = np.random.default_rng(20_240_117)
_MUL = _rng.integers(0, 2**31, HASHES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.int64).astype(np.uint32)
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of k consecutive word hashes, sorted."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return np.unique(mix64(h))


def minhash(sh: np.ndarray) -> np.ndarray:
    """128 minima of 32-bit values; long documents go through in slices."""
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    short = (sh >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(sh), 2048):
        x = short[None, i : i + 2048] * _MUL[:, None]
        x += _ADD[:, None]
        low = np.minimum(low, x.min(axis=1))
    return low


def _signatures(batches):
    for batch in batches:
        every, texts = batch["doc_id"].to_numpy(np.int64), batch["text"].tolist()
        for a, b in slices(texts):
            found = _signed(every[a:b], texts[a:b])
            if len(found):
                yield found
        release()


def _signed(docs: np.ndarray, texts: list[str]) -> pd.DataFrame:
    hashed, counts = words(texts)
    stop = np.cumsum(counts)
    ids, content, lows = [], [], []
    for doc, i, j in zip(docs.tolist(), (stop - counts).tolist(), stop.tolist()):
        if i == j:
            continue
        ids.append(doc)
        content.append(xxhash.xxh3_128_digest(hashed[i:j].tobytes()))
        lows.append(minhash(shingles(hashed[i:j])))
    if not ids:
        return pd.DataFrame()
    low = np.array(lows, np.uint64)
    sigs = [x.tobytes() for x in (mix64(low) & np.uint64(255)).astype(np.uint8)]
    low = low[:, : BANDS * ROWS].reshape(len(ids), BANDS, ROWS)
    key = np.broadcast_to(_BAND, (len(ids), BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + low[:, :, r])
    return pd.DataFrame({"doc_id": ids, "content": content, "sig": sigs, "bands": list(key.view(np.int64))})


def least_matches(threshold: float = THRESHOLD, miss: float = MISS) -> list[int]:
    """Matches that a pair needs after each batch to stay.

    With a uniform prior on similarity s, a pair of 8-bit values agrees with
    p = s + (1 - s) / 256, so the posterior of p is a Beta distribution cut at
    1/256, and its tail is a binomial sum.
    """

    def above(p: float, m: int, n: int) -> float:
        return sum(comb(n + 1, j) * p**j * (1 - p) ** (n + 1 - j) for j in range(m + 1))

    cut = threshold + (1 - threshold) / 256
    need = []
    for n in range(BATCH, HASHES + 1, BATCH):
        need.append(next(m for m in range(n + 1) if above(cut, m, n) / above(1 / 256, m, n) >= miss))
    return need


def survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, need: list[int]) -> np.ndarray:
    """Positions of the pairs (i, j) that no batch prunes."""
    alive = np.arange(len(i))
    matches = np.zeros(len(i), np.int32)
    for b, least in enumerate(need):
        if not len(alive):
            break
        cut = slice(b * BATCH, (b + 1) * BATCH)
        matches = matches + (sig[i[alive], cut] == sig[j[alive], cut]).sum(axis=1, dtype=np.int32)
        ok = matches >= least
        alive, matches = alive[ok], matches[ok]
    return alive


def spanning(sig: np.ndarray, need: list[int], label: np.ndarray, refused: set[tuple[int, int]] = frozenset(), most: int = 0) -> list[tuple[int, int]]:
    """Surviving pairs that together connect all that any surviving pairs connect.

    label: components known beforehand.  Every pair is compared or connected.
    most: 0 takes survivors as links at once and skips what they connect.
    Otherwise only the labels connect, and a document gives up to ``most``
    surviving pairs that were not refused with each other component.
    """
    comp = np.unique(label, return_inverse=True)[1].astype(np.int64)
    n, edges = len(sig), []
    wrong: dict[int, list[int]] = {}
    for a, b in refused:
        wrong.setdefault(a, []).append(b)
        wrong.setdefault(b, []).append(a)
    first_of = np.unique(comp, return_index=True)[1]
    main = np.bincount(comp).argmax() if most else -1

    def join(i: int) -> None:
        other = comp != comp[i]
        if most:  # of two documents outside the largest component only the first asks
            other &= (comp == main) | (np.arange(n) > i)
        rest = np.flatnonzero(other)
        if i in wrong:
            rest = np.setdiff1d(rest, np.array(wrong[i]))
        hits = []
        for at in range(0, len(rest), 65536):
            part = rest[at : at + 65536]
            hits.append(part[survivors(sig, np.full(len(part), i), part, need)])
        hit = np.concatenate(hits) if hits else rest
        hit = hit[np.argsort(comp[hit], kind="stable")]
        groups, first, size = np.unique(comp[hit], return_index=True, return_counts=True)
        edges.extend((i, int(j)) for j in hit[np.arange(len(hit)) - np.repeat(first, size) < max(1, most)])
        if not most:
            comp[np.isin(comp, groups)] = comp[i]

    if most:
        todo = np.flatnonzero(comp != main)
    else:
        join(int(first_of[0]))
        # every pair that is still apart has an end outside the largest component
        todo = np.flatnonzero(comp != np.bincount(comp).argmax())
    for i in todo:
        join(int(i))
    return edges


def _dense(key, doc, sig, start, size, need):
    """All pairs of small buckets at once; union-find thins the survivors."""
    left, right = [], []
    for gap in range(1, int(size.max(initial=1))):
        wide = size > gap
        reps = size[wide] - gap
        base = np.repeat(start[wide], reps)
        pos = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        left.append(base + pos)
        right.append(base + pos + gap)
    if not left:
        return [], []
    i, j = np.concatenate(left), np.concatenate(right)
    keep = [at + survivors(sig, i[at : at + 200_000], j[at : at + 200_000], need) for at in range(0, len(i), 200_000)]
    keep = np.concatenate(keep)
    i, j = i[keep], j[keep]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    order = np.lexsort((j, i))
    out_i, out_j = [], []
    for x, y in zip(i[order].tolist(), j[order].tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out_i.append(x)
            out_j.append(y)
    return out_i, out_j


def _buckets(need: list[int], again: int):
    """Rows sorted by key -> (key, a, b).  A bucket may span batches.

    again: 0 at first; later the ``most`` of ``spanning``, from known labels.
    """

    def whole(frame: pd.DataFrame):
        if again:
            out = []
            for key, g in frame.groupby("key", sort=False):
                members = g[g["other"] == _MEMBER].sort_values("doc_id")
                doc = members["doc_id"].to_numpy(np.int64)
                sig = np.frombuffer(b"".join(members["sig"]), np.uint8).reshape(-1, HASHES)
                at: dict[int, list[int]] = {}  # a document may be here with several texts
                for n, d in enumerate(doc.tolist()):
                    at.setdefault(d, []).append(n)
                bad = g[g["other"] != _MEMBER]
                refused = {(i, j) for a, b in zip(bad["doc_id"].tolist(), bad["other"].tolist()) for i in at.get(a, ()) for j in at.get(b, ())}
                found = spanning(sig, need, members["label"].to_numpy(np.int64), refused, again)
                out += [(key, min(doc[i], doc[j]), max(doc[i], doc[j])) for i, j in found]
            return pd.DataFrame(out, columns=["key", "a", "b"]).astype("int64")
        key = frame["key"].to_numpy(np.int64)
        doc = frame["doc_id"].to_numpy(np.int64)
        sig = np.frombuffer(b"".join(frame["sig"]), np.uint8).reshape(-1, HASHES)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        little = size <= DENSE
        i, j = _dense(key, doc, sig, start[little], size[little], need)
        for s, n in zip(start[~little], size[~little]):
            part = spanning(sig[s : s + n], need, doc[s : s + n])
            i += [int(s) + x for x, _ in part]
            j += [int(s) + y for _, y in part]
        i, j = np.array(i, np.int64), np.array(j, np.int64)
        i, j = i[doc[i] != doc[j]], j[doc[i] != doc[j]]
        return pd.DataFrame({"key": key[i], "a": np.minimum(doc[i], doc[j]), "b": np.maximum(doc[i], doc[j])})

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch["key"].iloc[-1]
            if held and held[-1]["key"].iloc[-1] == last and batch["key"].iloc[0] == last:
                held.append(batch)  # all of it belongs to the bucket that is open
                continue
            cut = int((batch["key"] != last).to_numpy().sum())
            ready = pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = [batch.iloc[cut:]]
            if len(ready):
                yield whole(ready)
        if held:
            yield whole(pd.concat(held, ignore_index=True))

    return run


def _exact(batches):
    """Rows sorted by (a, salt, b), those of a itself (b null) first -> (a, b, jaccard)."""
    last, own = None, []
    for batch in batches:
        texts = batch["text"].tolist()
        hub, other = list(zip(batch["a"], batch["salt"])), batch["b"].astype("Int64")
        for i, j in slices(texts):
            hashed, counts = words(texts[i:j])
            stop = np.cumsum(counts)
            found = []
            for at, b, x, y in zip(hub[i:j], other.iloc[i:j], (stop - counts).tolist(), stop.tolist()):
                if at != last:
                    last, own = at, []
                here = shingles(hashed[x:y])
                if b is pd.NA:
                    own.append(here)
                    continue
                best = 0.0
                for set_a in own:
                    both = len(np.intersect1d(set_a, here, assume_unique=True))
                    best = max(best, both / max(1, len(set_a) + len(here) - both))
                found.append((at[0], b, best))
            yield pd.DataFrame(found, columns=["a", "b", "jaccard"]).astype({"a": "int64", "b": "int64", "jaccard": "float64"})
        release()


def _among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """texts of ``ids`` (distinct); a bit filter keeps most of the others out of the join's shuffle."""
    n = ids.count()
    if n <= BROADCAST_ROWS:
        return texts.join(F.broadcast(ids), "doc_id", "left_semi")
    bits = min(FILTER_BITS, 1 << (16 * n).bit_length())
    if n > bits // 2:
        return texts.join(ids, "doc_id", "left_semi")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) + 1
    parts = ids.select(at.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    held = bytearray(bits // 8)
    for row in parts.toLocalIterator():
        held[(row.n - 1) * 4096 : row.n * 4096] = row.bits
    byte = F.conv(F.hex(F.substring(F.lit(bytes(held)), F.floor((at - 1) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.call_function("getbit", byte, ((at - 1) % 8).cast("int")) == 1
    return texts.where(maybe).join(ids, "doc_id", "left_semi")


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, jaccard) of distinct pairs on whole texts; of several texts of a document the best counts."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    held = _among(texts, ids)
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("salts"))
    salted = pairs.join(hubs, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int"))
    others = salted.select(F.col("b").alias("doc_id"), "a", "salt").join(held, "doc_id").select("a", "salt", F.col("doc_id").alias("b"), "text")
    own = hubs.select(F.col("a").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(held, "doc_id")
    own = own.select(F.col("doc_id").alias("a"), "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = others.unionByName(own).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return in_batches(rows, _exact, "a long, b long, jaccard double").groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def _cell(*groups) -> Column:
    """Bucket of one group (twice) or of two groups of a hot key."""
    return F.when(F.col("groups") == 1, F.col("key")).otherwise(F.xxhash64("key", *groups))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(doc_id, kept_doc_id), a row for every document that should go."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    need = least_matches(threshold, miss)
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")

    signed = written(in_batches(texts, _signatures, "doc_id long, content binary, sig binary, bands array<long>"), f"{folder}/signed")
    firsts = signed.groupBy("content").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    firsts = written(firsts, f"{folder}/firsts")
    reps = signed.join(firsts.select("content", F.col("rep").alias("doc_id")), ["content", "doc_id"], "left_semi")

    keyed = reps.select("doc_id", "content", F.explode("bands").alias("key")).distinct()
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("groups"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = keyed.join(sizes, "key").withColumn("g", F.pmod(F.xxhash64("doc_id", "key"), "groups").cast("int"))
    sigs = reps.select("doc_id", "content", "sig").dropDuplicates(["doc_id", "content"])
    cells = written(shared.join(sigs, ["doc_id", "content"]).select("key", "groups", "g", "doc_id", "sig"), f"{folder}/cells")
    # the first pass compares inside groups, later ones also across them
    members = cells.select(_cell("g", "g").alias("key"), "doc_id", "sig")
    hot = not cells.where("groups > 1").isEmpty()
    across = members
    if hot:
        pairs = cells.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        across = pairs.select(_cell(F.least("g", "h"), F.greatest("g", "h")).alias("key"), "groups", "doc_id", "sig")

    pairs_schema = "key long, a long, b long"
    edges = (
        members.select("key", "doc_id", "sig").repartition("key").sortWithinPartitions("key", "doc_id").mapInPandas(_buckets(need, 0), pairs_schema)
    )
    links, turn, tried = None, 0, None
    copies = signed.select("doc_id", "content").join(firsts.where("n > 1").select("content", "rep"), "content").where("doc_id != rep")
    exact_links = written(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), f"{folder}/copies")
    while True:
        edges = written(edges, f"{folder}/edges{turn}")
        fresh = edges.select("a", "b").distinct()
        if turn and fresh.isEmpty():
            break
        checked = verified(texts, written(fresh, f"{folder}/fresh{turn}"))
        checked = written(checked, f"{folder}/checked{turn}")
        good = checked.where(F.col("jaccard") >= threshold).select("a", "b")
        links = good if links is None else links.unionByName(good)
        bad = edges.join(checked.where(F.col("jaccard") < threshold).select("a", "b"), ["a", "b"], "left_semi")
        tried = bad if tried is None else tried.unionByName(bad)
        if bad.isEmpty() and not (hot and turn == 0):
            break
        # only buckets in which a survivor failed may hold pairs that were wrongly skipped
        known = connected_components(links.unionByName(exact_links), "a", "b")
        open_keys = bad.select("key").distinct()
        if hot and turn == 0:  # every pair of groups of a hot bucket
            open_keys = open_keys.unionByName(across.where("groups > 1").select("key")).distinct()
        rows = (
            across.join(open_keys, "key", "left_semi")
            .join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("key", "doc_id", "sig", F.coalesce("component", "doc_id").alias("label"), F.lit(_MEMBER).alias("other"))
        )
        refused = tried.join(open_keys, "key", "left_semi").distinct().select(
            "key", F.col("a").alias("doc_id"), F.lit(None).cast("binary").alias("sig"), F.lit(0).cast("long").alias("label"), F.col("b").alias("other")
        )
        # written first: over a union of joins the optimizer may drop the repartition below
        rows = written(rows.unionByName(refused), f"{folder}/again{turn}")
        edges = rows.repartition("key").sortWithinPartitions("key").mapInPandas(_buckets(need, 16 ** (turn + 1)), pairs_schema)
        turn += 1
    groups = connected_components(links.unionByName(exact_links), "a", "b")
    return groups.where("node != component").select(F.col("node").alias("doc_id"), F.col("component").alias("kept_doc_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, with all their columns.

    Of rows that repeat both ``doc_id`` and text one stays.
    """
    spark = docs.sparkSession
    gone = written(near_duplicates(docs, threshold).select("doc_id"), f"{shared_dir(spark)}/gone")
    kept = docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    copies = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return copies.unionByName(kept.where("doc_id is null"))
