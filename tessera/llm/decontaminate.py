"""Operator 8: benchmark decontamination by spaced-seed hashing.

A fixed mask selects some positions of a short token window and ignores the
rest, so a window whose ignored tokens were substituted still has the same
hash.  The seeds of all benchmark items are joined with those of every
position of every document; around each hit the two texts are laid side by
side and the best-scoring run (a match counts 1, a substitution -``PENALTY``)
is the verified overlap.  It counts if it has ``MIN_TOKENS`` matching tokens,
or ``MIN_SHARE`` of an item shorter than that would need.

The benchmark side goes to the workers in blocks of at most ``BLOCK_TOKENS``
tokens, one pass over the documents per block, so memory is bounded whatever
the size of the benchmark.

Cases: tokens are lower-cased words, punctuation ignored; null or empty texts
and null ids on either side give no row; an item with fewer tokens than a mask
spans is also sought as one run of all its tokens, and items without tokens
never match; rows that repeat a (doc_id, item_id) pair give the best overlap
once, of equally good ones that with the fewest tokens, then the first; very long
texts are read whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_batches, mix64, release, shared_dir, slices, small, words, written

MASKS = ("1110110101", "110010101011", "11011000101101")
MIN_TOKENS = 12
MIN_SHARE = 0.8
PENALTY = 2.0
BLOCK_TOKENS = 2_000_000
#: Positions hashed at once in a worker.
STEP = 400_000

_COEF = mix64(np.arange(101, 229, dtype=np.uint64)) | np.uint64(1)


def seeds(tokens: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seed hash of every window that lies in one row, and where it starts."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, len(mask) * 0x1000193 + int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h += tokens[k : k + n] * _COEF[k % 128] + np.uint64(k)
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    return mix64(h[at]), at


class Block:
    """Seeds of some benchmark items, ready for look-up."""

    def __init__(self, ids: list[int], texts: list[str], masks=MASKS) -> None:
        self.tokens, counts = words(texts)
        self.ids = np.array(ids, np.int64)
        self.stop = np.cumsum(counts)
        self.start = self.stop - counts
        row = np.repeat(np.arange(len(ids)), counts)
        short = sorted({int(c) for c in counts if 0 < c < max(map(len, masks))})
        self.masks = [*masks, *("1" * c for c in short)]
        self.tables = []
        for n, mask in enumerate(self.masks):
            h, at = seeds(self.tokens, row, mask)
            if n >= len(masks):  # a run of a short item's length is only for items of that length
                own = counts[row[at]] == len(mask)
                h, at = h[own], at[own]
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], at[order]))
        bits = max(16, min(26, int(sum(len(h) for h, _ in self.tables) * 64).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        for h, _ in self.tables:
            self.maybe[(h >> self.shift).astype(np.int64)] = True

    def hits(self, tokens: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in tokens, position in the block) of every shared seed."""
        left, right = [], []
        widest = max(map(len, self.masks))
        for from_ in range(0, len(tokens), STEP):
            cut = slice(from_, from_ + STEP + widest - 1)
            part, rows = tokens[cut], row[cut]
            for mask, (h, at) in zip(self.masks, self.tables):
                got, where = seeds(part, rows, mask)
                new = where < STEP
                got, where = got[new], where[new]
                ok = np.flatnonzero(self.maybe[(got >> self.shift).astype(np.int64)])
                lo = np.searchsorted(h, got[ok], "left")
                hi = np.searchsorted(h, got[ok], "right")
                n = hi - lo
                left.append(np.repeat(where[ok], n) + from_)
                right.append(at[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(left), np.concatenate(right)

    def overlap(self, tokens: np.ndarray, item: int, diag: int, hit: int) -> tuple[int, int, int, int]:
        """(start in tokens, start in item, length, matches) of the best run over the hit."""
        theirs = self.tokens[self.start[item] : self.stop[item]]
        lo, hi = max(0, diag), min(len(tokens), diag + len(theirs))
        same = tokens[lo:hi] == theirs[lo - diag : hi - diag]
        score = np.where(same, 1.0, -PENALTY)
        at = hit - lo
        before = np.cumsum(score[: at + 1][::-1])
        after = np.cumsum(score[at:])
        a, b = at - int(before.argmax()), at + int(after.argmax()) + 1
        return lo + a, lo + a - diag, b - a, int(same[a:b].sum())

    def need(self, item: int) -> int:
        n = int(self.stop[item] - self.start[item])
        return min(MIN_TOKENS, max(1, math.ceil(MIN_SHARE * n)))


OUT = "doc_id long, item_id long, doc_start long, item_start long, n_tokens long, n_matched long"


def _scan(block: Block):
    def run(batches):
        for batch in batches:
            every, texts = batch["doc_id"].to_numpy(np.int64), batch["text"].tolist()
            yield from (_overlaps(block, every[i:j], texts[i:j]) for i, j in slices(texts))
            release()

    return run


def _overlaps(block: Block, docs: np.ndarray, texts: list[str]) -> pd.DataFrame:
    tokens, counts = words(texts)
    stop = np.cumsum(counts)
    start = stop - counts
    row = np.repeat(np.arange(len(docs)), counts)
    pos, other = block.hits(tokens, row)
    item = np.searchsorted(block.stop, other, "right")
    diag = (pos - start[row[pos]]) - (other - block.start[item])
    found = np.unique(np.stack([row[pos], item, diag, pos - start[row[pos]]], axis=1), axis=0)
    out, done = [], (-1, -1, 0, -1)
    for r, i, g, p in found.tolist():
        if (r, i, g) == done[:3] and p < done[3]:
            continue  # inside a run that is already measured
        a, b, n, same = block.overlap(tokens[start[r] : stop[r]], i, g, p)
        done = (r, i, g, a + n)
        if same >= block.need(i):
            out.append((docs[r], block.ids[i], a, b, n, same))
    return pd.DataFrame(out, columns=["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_matched"]).astype("int64")


def contaminated(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_tokens, n_matched): verified overlaps."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_tokens))
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    found = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted((r.item_id, r.text) for r in part.toLocalIterator())
        one = in_batches(texts, _scan(Block([i for i, _ in rows], [t for _, t in rows])), OUT)
        found = one if found is None else found.unionByName(one)
    best = F.struct("n_matched", -F.col("n_tokens"), -F.col("doc_start"), -F.col("item_start"))
    return (
        found.groupBy("doc_id", "item_id")
        .agg(F.max(best).alias("b"))
        .selectExpr("doc_id", "item_id", "-b.col3 as doc_start", "-b.col4 as item_start", "-b.col2 as n_tokens", "b.n_matched as n_matched")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a verified overlap; rows with a null id stay."""
    gone = written(contaminated(docs, benchmark).select("doc_id").distinct(), f"{shared_dir(docs.sparkSession)}/gone")
    return docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)
