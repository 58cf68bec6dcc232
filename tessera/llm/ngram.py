"""Operator 9: language-model scores from an Elias-Fano n-gram trie.

All words and trigrams of all documents are counted into an interpolated
Kneser-Ney model of order 3; nothing is pruned by default (``min_word`` and
``min_trigram`` of ``train`` fold rare ones into the unknown word or the shorter
context).  The model is a set of shards in the shared folder, one per hash of a
trigram's middle word; their number grows with the text.  The trigrams of a very
frequent middle word are split further by the first word, the pairs that begin
with a very frequent word (or the mark before a text) by the second, so no shard
grows with one word.  The first words of all texts follow the same two marks:
they are one context, and one shard.

A shard is a trie in three memory-mapped levels.  Level 2 has the successors of
each middle word, level 3a the contexts (middle, first), level 3b the words
after each context; a word is stored there by its rank among the successors of
the middle word, and each level is one increasing Elias-Fano sequence, so a
search is a successor search relative to the context.  The discounted shares
and back-off weights are quantised to 8 bits on a log scale.  A shard is one
file, mapped without being held open: a worker needs no file descriptor per
shard, and keeps at most ``MAPS`` of them mapped.

    p(w3 | w1 w2) = a3 + b3 (a2 + b2 p1)

Scoring walks the documents once more, whole texts, and looks all their n-grams
up in the mapped shards.  The folder must be a mounted path (file: or plain).

Cases: null, empty and wordless texts have 0 words and null scores; a null
doc_id is kept as null; rows that repeat a document count and are scored each;
very long texts are counted and scored whole; equal texts get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_batches, mix64, ragged, release, shared_dir, words, written
from tessera.llm.eliasfano import EliasFano, encode

#: Characters of text per vocabulary shard.
SHARD_CHARS = 16_000_000
#: Words of text per trie shard, and occurrences after which a middle word is split.
SHARD_TOKENS = 1_500_000
SPLIT = 1_000_000
#: Occurrences from which a word, a trigram is kept.
MIN_WORD, MIN_TRIGRAM = 1, 1
DISCOUNT = 0.75
#: Words looked up at once.
STEP = 1_000_000
#: Characters of text counted at once.
PIECE = 5_000_000
#: Files of each kind that a worker keeps mapped; Linux allows a process 65,530 maps.
MAPS = 16_384
_FLOOR = -23.0  # log of the least quantised value


def quantise(x: np.ndarray) -> np.ndarray:
    """0 is zero; 1 .. 255 are a log scale up to 1."""
    with np.errstate(divide="ignore"):
        code = np.rint(np.maximum(np.log(x), _FLOOR) / _FLOOR * -254 + 255)
    return np.where(x > 0, np.clip(code, 1, 255), 0).astype(np.uint8)


_VALUE = np.r_[0.0, np.exp((255 - np.arange(1, 256)) / 254 * _FLOOR)]


def _path(uri: str) -> str:
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"the trie is memory-mapped, so spark.checkpoint.dir must be a mounted folder, not {u.scheme}:")
    return u.path


def _save(path: str, arrays: dict[str, np.ndarray]) -> int:
    """Write arrays to one file at once: a rerun of the task replaces it whole."""
    part = f"{path}.{os.getpid()}.{np.random.default_rng().integers(1 << 40)}"
    index = {}
    with open(part, "wb") as f:
        for name, a in arrays.items():
            f.write(bytes(-f.tell() % 64))
            index[name] = a.dtype.str, a.shape, f.tell()
            f.write(np.ascontiguousarray(a).data)
        last = json.dumps(index).encode()
        f.write(last + len(last).to_bytes(8, "little"))
    os.replace(part, path)
    return sum(a.nbytes for a in arrays.values())


def _load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; the file is closed, the map lives as long as they do."""
    with pa.memory_map(path) as f:
        raw = f.read_buffer()
    end = raw.size - 8
    start = end - int.from_bytes(raw[end:].to_pybytes(), "little")
    index = json.loads(raw[start:end].to_pybytes())
    return {name: np.ndarray(shape, kind, raw, at) for name, (kind, shape, at) in index.items()}


class Shards:
    """The files of a folder, mapped when first needed; those beyond ``MAPS`` are mapped anew for each use."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.open: dict[str, tuple | None] = {}

    def get(self, name: str, prefixes: str = "") -> tuple[dict[str, np.ndarray], dict[str, EliasFano]] | None:
        """(arrays, sequences) of a file; None if there is no such file."""
        if name in self.open:
            return self.open[name]
        path, found = f"{self.folder}/{name}", None
        if os.path.exists(path):
            parts = _load(path)
            found = parts, {p: _sub(parts, p) for p in prefixes.split()}
        if len(self.open) < MAPS:
            self.open[name] = found
        return found


def _sub(parts: dict[str, np.ndarray], prefix: str) -> EliasFano:
    return EliasFano({k: np.asarray(parts[f"{prefix}_{k}"]) for k in ("low", "high", "sample", "inner", "meta")})


def _ef(prefix: str, values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    return {f"{prefix}_{k}": v for k, v in encode(values, universe).items()}


# ---- vocabulary


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _pieces(texts: list[str]):
    """Whole texts, about PIECE characters at once."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _edges(shards: int) -> np.ndarray:
    """Hashes at which the vocabulary shards (a power of two) after the first begin."""
    return np.arange(1, shards, dtype=np.uint64) << np.uint64(65 - shards.bit_length())


def _count_words(shards: int):
    def run(batches):
        for batch in batches:
            for part in _pieces(batch["text"].tolist()):
                found, n = np.unique(words(part)[0], return_counts=True)
                cut = np.searchsorted(found, _edges(shards))
                rows = [(s, len(h), _pack(h, c.astype(np.uint32))) for s, (h, c) in enumerate(zip(np.split(found, cut), np.split(n, cut))) if len(h)]
                yield pd.DataFrame(rows, columns=["shard", "n", "blob"])
            release()

    return run


def _unpack(blob: bytes, n: int, *kinds) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, kind, n, at))
        at += size
    return out


def _sum_sorted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _build_vocab(folder: str, min_word: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        parts = [_unpack(b, n, np.uint64, np.uint32) for b, n in zip(group["blob"], group["n"])]
        keys, n = _sum_sorted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
        keep = n >= min_word
        _save(f"{folder}/vocab{shard:04d}", {"hash": keys[keep], "count": n[keep]})
        return pd.DataFrame({"shard": [shard], "kept": [int(keep.sum())], "tokens": [int(n.sum())]})

    return run


class Vocabulary:
    """Word hash -> id; 0 is the unknown word, the ids after the last word is the text start."""

    def __init__(self, folder: str, sizes: tuple[int, ...]) -> None:
        self.offset = np.r_[0, np.cumsum(sizes)] + 1
        self.start = int(self.offset[-1])
        self.size = self.start + 1
        self.sizes = sizes
        self.shards = Shards(folder)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of every hash."""
        found, back = np.unique(hashes, return_inverse=True)
        out, count = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        edge = np.searchsorted(found, _edges(len(self.sizes)))
        edge = np.r_[0, edge, len(found)]
        for s, kept in enumerate(self.sizes):
            own = found[edge[s] : edge[s + 1]]
            if not kept or not len(own):
                continue
            part, _ = self.shards.get(f"vocab{s:04d}")
            at = np.minimum(np.searchsorted(part["hash"], own), len(part["hash"]) - 1)
            ok = part["hash"][at] == own
            out[edge[s] : edge[s + 1]] = np.where(ok, at + self.offset[s], 0)
            count[edge[s] : edge[s + 1]] = np.where(ok, part["count"][at], 0)
        return out[back], count[back]

    def often(self, ids: np.ndarray, unknown: int, texts: int) -> np.ndarray:
        """Times that words (ids in order) occur, the start mark once before each text."""
        out = np.where(ids == 0, unknown, texts)
        edge = np.searchsorted(ids, self.offset)
        for s, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
            if b > a:
                out[a:b] = self.shards.get(f"vocab{s:04d}")[0]["count"][ids[a:b] - self.offset[s]]
        return out


@lru_cache(1)
def _vocabulary(folder: str, sizes: tuple[int, ...]) -> Vocabulary:
    return Vocabulary(folder, sizes)


def trigrams(vocabulary: Vocabulary, hashes: np.ndarray, counts: np.ndarray, unknown: int, texts: int):
    """(w1, w2, w3, times w2 occurs) at every word; texts start with two start marks."""
    ids, n = vocabulary.ids(hashes)
    n = np.where(ids == 0, unknown, n)
    row, pos = ragged(counts)
    shift = lambda a, k, fill: np.where(pos >= k, np.r_[np.full(min(k, len(a)), fill), a[: max(0, len(a) - k)]], fill)
    often = np.where(pos == 0, texts, shift(n, 1, 0))  # the start mark occurs once before each text
    return shift(ids, 2, vocabulary.start), shift(ids, 1, vocabulary.start), ids, often


def shard_of(w1: np.ndarray, w2: np.ndarray, often: np.ndarray, shards: int, split: int = SPLIT) -> np.ndarray:
    """Shards by w2; where that occurs ``split`` times and more, by w1 too."""
    part = mix64(w1.astype(np.uint64) + np.uint64(77)) % (often // split + 1).astype(np.uint64)
    return (mix64(w2.astype(np.uint64) * np.uint64(1009) + part) % np.uint64(shards)).astype(np.int64)


def _order(*columns: np.ndarray) -> np.ndarray:
    """Lexicographic order (of equal rows any), in one packed sort where the columns fit 63 bits."""
    keys, width = [], 64
    for c in columns[::-1]:
        bits = int(c.max(initial=0)).bit_length()
        if width + bits > 63:
            keys.append(np.zeros(len(c), np.int64))
            width = 0
        keys[-1] |= c.astype(np.int64) << width
        width += bits
    order = np.argsort(keys[0])
    for key in keys[1:]:  # a stable sort by few bits is a radix sort
        key = key[order]
        order = order[np.argsort(key.astype(np.uint16) if key.max(initial=0) < 1 << 16 else key, kind="stable")]
    return order


def _unique_rows(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    order = _order(*columns)
    columns, n = [c[order] for c in columns], n[order]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(n, first, dtype=np.int64) if len(first) else n


def _count_trigrams(folder: str, sizes: tuple[int, ...], shards: int, unknown: int, texts: int, split: int):
    def run(batches):
        vocabulary = _vocabulary(folder, sizes)
        for batch in batches:
            for part in _pieces(batch["text"].tolist()):
                w1, w2, w3, often = trigrams(vocabulary, *words(part), unknown, texts)
                shard = shard_of(w1, w2, often, shards, split)
                (shard, w2, w1, w3), n = _unique_rows([shard, w2, w1, w3], np.ones(len(w1), np.int64))
                cut = np.searchsorted(shard, np.arange(shards + 1))
                rows = []
                for s in range(shards):
                    own = slice(cut[s], cut[s + 1])
                    m = cut[s + 1] - cut[s]
                    if m:
                        step = np.diff(w2[own], prepend=0).astype(np.uint32)
                        rows.append((s, int(m), _pack(step, w1[own].astype(np.uint32), w3[own].astype(np.uint32), n[own].astype(np.uint32))))
                yield pd.DataFrame(rows, columns=["shard", "n", "blob"])
            release()

    return run


def _distinct(columns: list[np.ndarray], extra: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct rows in order, each row's place among them, and ``extra`` of the distinct rows."""
    order = _order(*columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return [c[new] for c in columns], back, extra[order[new]]


def _find_runs(ef: EliasFano, keys: np.ndarray) -> np.ndarray:
    """Places of keys that come in runs of equal ones."""
    first = _group_starts(keys)
    return np.repeat(ef.find(keys[first]), np.diff(np.r_[first, len(keys)]))


def _group_starts(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)


def _build_trigrams(folder: str, size: int, middle_shards: int, min_trigram: int, often, split: int):
    """One shard: write its trie; give its bigram counts on to the bigram shards."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        parts = []
        for b, m in zip(group["blob"], group["n"]):
            step, *rest = _unpack(b, m, *[np.uint32] * 4)
            parts.append((np.cumsum(step, dtype=np.uint32), *rest))
        del group
        w2, w1, w3, n = (np.concatenate(c) for c in zip(*parts))
        del parts
        # 32 bits until here: a shard's rows are held twice while they are sorted
        rows, n = _unique_rows([w2, w1, w3], n)
        w2, w1, w3 = (c.astype(np.int64) for c in rows)
        n = n.astype(np.int64)
        del rows
        # bigrams: different words before
        (b2, b3), before = _unique_rows([w2, w3], np.ones(len(w2), np.int64))
        # contexts with a trigram that is kept
        ctx = _group_starts(w2 * size + w1) if size < 1 << 31 else np.flatnonzero(np.r_[True, (w2[1:] != w2[:-1]) | (w1[1:] != w1[:-1])])
        of = np.zeros(len(n), np.int64)
        of[ctx[1:]] = 1
        of = np.cumsum(of)
        total = np.add.reduceat(n, ctx)
        keep = np.flatnonzero(n >= min_trigram)
        share = (n[keep] - DISCOUNT) / total[of[keep]]
        kept_ctx, where = np.unique(of[keep], return_inverse=True)
        left = 1 - np.bincount(where, weights=share, minlength=len(kept_ctx))
        mids = np.unique(w2[keep])
        succ_mid, succ_word = _unique_rows([np.searchsorted(mids, w2[keep]), w3[keep]], np.ones(len(keep), np.int64))[0]
        first = np.searchsorted(succ_mid, np.arange(len(mids) + 1))
        mid = np.searchsorted(mids, w2[keep])
        at = EliasFano(encode((succ_mid * size + succ_word).astype(np.uint64), max(1, len(mids) * size)))
        rank = at.find((mid * size + w3[keep]).astype(np.uint64)) - first[mid]
        widest = int(np.diff(first).max(initial=1))
        arrays = {
            **_ef("mid", mids.astype(np.uint64), size),
            **_ef("ptr", first.astype(np.uint64), len(succ_word) + 1),
            **_ef("succ", (succ_mid * size + succ_word).astype(np.uint64), max(1, len(mids) * size)),
            **_ef("ctx", (np.searchsorted(mids, w2[ctx[kept_ctx]]) * size + w1[ctx[kept_ctx]]).astype(np.uint64), max(1, len(mids) * size)),
            **_ef("tri", (where * widest + rank).astype(np.uint64), max(1, len(kept_ctx) * widest)),
            "share": quantise(share),
            "left": quantise(left),
            "widest": np.array([widest]),
        }
        kb = _save(f"{folder}/tri{shard:05d}", arrays)
        to = shard_of(b3, b2, often(b2.astype(np.int64)), middle_shards, split)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(middle_shards + 1))
        rows = []
        for s in range(middle_shards):
            own = order[cut[s] : cut[s + 1]]
            if len(own):
                rows.append((s, len(own), _pack(b2[own].astype(np.uint32), b3[own].astype(np.uint32), before[own].astype(np.uint32)), kb))
        return pd.DataFrame(rows, columns=["shard", "n", "blob", "bytes"])

    return run


def _build_bigrams(folder: str, size: int, often, split: int):
    """One bigram shard: shares by different words before; counts of words after others go on.

    Shares of a word whose pairs are split are of this shard's pairs; ``_sum_split`` gives their scale.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        parts = [_unpack(b, m, *[np.uint32] * 3) for b, m in zip(group["blob"], group["n"])]
        del group
        rows = [np.concatenate(c) for c in zip(*parts)]
        del parts
        rows, before = _unique_rows(rows[:2], rows[2])
        b2, b3 = (c.astype(np.int64) for c in rows)
        del rows
        start = _group_starts(b2)
        of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(b2)]))
        total = np.add.reduceat(before, start)
        share = (before - DISCOUNT) / total[of]
        mids = b2[start]
        hot = often(mids) >= split
        arrays = {
            "hot": mids[hot],
            "hot_total": total[hot],
            "hot_kinds": np.diff(np.r_[start, len(b2)])[hot],
            **_ef("mid", mids.astype(np.uint64), size),
            **_ef("bi", (of * size + b3).astype(np.uint64), max(1, len(mids) * size)),
            "share": quantise(share),
            "left": quantise(1 - np.bincount(of, weights=share, minlength=len(mids))),
        }
        _save(f"{folder}/bi{shard:05d}", arrays)
        word, n = np.unique(b3, return_counts=True)
        return pd.DataFrame({"word": word, "n": n})

    return run


def _sum_split(folder: str, middle: int) -> None:
    """Write, for the words whose pairs are split, each shard's share of a word's pairs and the word's back-off weight."""
    held = []
    for shard in range(middle):
        path = f"{folder}/bi{shard:05d}"
        if os.path.exists(path):
            parts = _load(path)
            held.append([parts["hot"], np.full(len(parts["hot"]), shard), parts["hot_total"], parts["hot_kinds"]])
    mid, shard, total, kinds = (np.concatenate(c) for c in zip(*held))
    word, of = np.unique(mid, return_inverse=True)
    totals = np.bincount(of, total, len(word))
    order = np.lexsort([shard, mid])
    arrays = {
        "word": word,
        "left": DISCOUNT * np.bincount(of, kinds, len(word)) / totals,
        "key": (mid * middle + shard)[order],
        "scale": (total / totals[of])[order],
    }
    _save(f"{folder}/split", arrays)


class Model:
    """The mapped shards, opened when first needed."""

    def __init__(self, folder: str, sizes: tuple[int, ...], shards: int, middle: int, unknown: int, texts: int, kinds: int, split: int) -> None:
        self.args = (folder, sizes, shards, middle, unknown, texts, kinds, split)
        self.folder, self.sizes, self.shards, self.middle, self.unknown, self.texts, self.kinds, self.split = self.args
        self.files = Shards(folder)

    def __reduce__(self):
        return _model, self.args

    def probabilities(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """p of every word given the two before it in its text."""
        vocabulary = _vocabulary(self.folder, self.sizes)
        size = vocabulary.size
        w1, w2, w3, often = trigrams(vocabulary, hashes, counts, self.unknown, self.texts)
        # in the order of the shards' keys: look-ups walk the arrays forward, and each is made once
        (w2, w1, w3), back, often = _distinct([w2, w1, w3], often)
        unigram = np.load(f"{self.folder}/unigram.npy", mmap_mode="r")
        (b2, b3), pair, begins = _distinct([w2, w3], often)
        to = shard_of(b3, b2, begins, self.middle, self.split)
        share, left = np.zeros(len(b2)), np.ones(len(b2))
        for own in self._by(to):
            found = self.files.get(f"bi{int(to[own[0]]):05d}", "mid bi")
            if found is None:
                continue
            parts, ef = found
            mid = _find_runs(ef["mid"], b2[own])
            own, mid = own[mid >= 0], mid[mid >= 0]
            at = ef["bi"].find(mid * size + b3[own])
            share[own] = np.where(at >= 0, _VALUE[parts["share"][np.maximum(at, 0)]], 0.0)
            left[own] = _VALUE[parts["left"][mid]]
        hot, _ = self.files.get("split")
        own = np.flatnonzero(begins >= self.split)
        own = own[np.isin(b2[own], hot["word"])]
        if len(own):
            left[own] = hot["left"][np.searchsorted(hot["word"], b2[own])]
            # a shard without pairs of the word has no scale, and found no share
            at = np.minimum(np.searchsorted(hot["key"], b2[own] * self.middle + to[own]), len(hot["key"]) - 1)
            share[own] *= hot["scale"][at]
        p = share + left * np.maximum(_VALUE[unigram[b3]], 1e-10)
        p = p[pair]
        to = shard_of(w1, w2, often, self.shards, self.split)
        for own in self._by(to):
            found = self.files.get(f"tri{int(to[own[0]]):05d}", "mid ptr succ ctx tri")
            if found is None:
                continue
            parts, ef = found
            mid = _find_runs(ef["mid"], w2[own])
            own, mid = own[mid >= 0], mid[mid >= 0]
            ctx = _find_runs(ef["ctx"], mid * size + w1[own])
            own, mid, ctx = own[ctx >= 0], mid[ctx >= 0], ctx[ctx >= 0]
            if not len(own):
                continue
            place = ef["succ"].find(mid * size + w3[own])
            a = np.zeros(len(own))
            hit = np.flatnonzero(place >= 0)
            if len(hit):
                mids, where = np.unique(mid[hit], return_inverse=True)
                rank = place[hit] - ef["ptr"].access(mids).astype(np.int64)[where]
                at = ef["tri"].find(ctx[hit] * int(parts["widest"][0]) + rank)
                a[hit] = np.where(at >= 0, _VALUE[parts["share"][np.maximum(at, 0)]], 0.0)
            p[own] = a + _VALUE[parts["left"][ctx]] * p[own]
        return np.minimum(p, 1.0)[back]

    @staticmethod
    def _by(to: np.ndarray):
        order = np.argsort(to, kind="stable")
        edge = np.r_[_group_starts(to[order]), len(to)]
        for a, b in zip(edge[:-1], edge[1:]):
            yield order[a:b]


@lru_cache(1)
def _model(*args) -> Model:
    """A worker's tasks share the model, and so its mapped files."""
    return Model(*args)


def train(docs: DataFrame, folder: str | None = None, min_word: int = MIN_WORD, min_trigram: int = MIN_TRIGRAM) -> Model | None:
    """Count all documents and write the trie; None if there are no words."""
    uri = folder or shared_dir(docs.sparkSession)
    folder = _path(uri)
    os.makedirs(folder, exist_ok=True)
    texts = docs.select("text").where("text is not null")
    n_texts, chars = texts.agg(F.count("*"), F.sum(F.length("text"))).first()
    vocab = 1 << max(4, ((chars or 0) // SHARD_CHARS).bit_length())
    blob = "shard long, n long, blob binary"
    stats = in_batches(texts, _count_words(vocab), blob).groupBy("shard").applyInPandas(_build_vocab(folder, min_word), "shard long, kept long, tokens long")
    rows = written(stats, f"{uri}/vocabulary").collect()  # a row per vocabulary shard
    if not rows:
        return None
    kept = {r.shard: r.kept for r in rows}
    sizes = tuple(kept.get(s, 0) for s in range(vocab))
    size, tokens = sum(sizes) + 2, sum(r.tokens for r in rows)
    unknown = max(1, tokens // 50)
    shards = max(1, -(-tokens // SHARD_TOKENS))
    middle = max(1, -(-shards // 4))
    split = SPLIT

    def often(ids: np.ndarray) -> np.ndarray:
        return _vocabulary(folder, sizes).often(ids, unknown, n_texts)

    found = in_batches(texts, _count_trigrams(folder, sizes, shards, unknown, n_texts, split), blob)
    pairs = found.groupBy("shard").applyInPandas(_build_trigrams(folder, size, middle, min_trigram, often, split), f"{blob}, bytes long")
    ends = pairs.groupBy("shard").applyInPandas(_build_bigrams(folder, size, often, split), "word long, n long")
    per_word = ends.groupBy("word").agg(F.sum("n").alias("n"))
    per_word = written(per_word, f"{uri}/continuations")
    total, kinds = per_word.agg(F.sum("n"), F.count("*")).first()
    _sum_split(folder, middle)
    # one byte per word: the array is filled range by range, never held whole
    share = np.lib.format.open_memmap(f"{folder}/unigram.npy", "w+", np.uint8, (size,))
    floor = DISCOUNT * kinds / total / size
    share[:] = quantise(np.array([floor]))[0]
    share.flush()
    del share

    def fill(batches):
        out = np.load(f"{folder}/unigram.npy", mmap_mode="r+")
        for batch in batches:
            out[batch["word"].to_numpy(np.int64)] = quantise((batch["n"].to_numpy(float) - DISCOUNT) / total + floor)
            yield pd.DataFrame({"done": [len(batch)]})
        out.flush()

    per_word.mapInPandas(fill, "done long").agg(F.sum("done")).collect()
    return Model(folder, sizes, shards, middle, unknown, n_texts, int(kinds), split)


OUT = "doc_id long, n_words long, log10_prob_per_word double, perplexity double, log10_prob double"


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_words, log10_prob_per_word, perplexity, log10_prob) for every row of docs."""
    model = model or train(docs)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch["text"].tolist()]
            hashes, counts = words(texts)
            stop = np.cumsum(counts)
            total = np.zeros(len(texts))
            if model is not None and len(hashes):
                at = 0
                while at < len(texts):  # whole texts, about STEP words at once
                    to = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + STEP)))
                    a, b = (int(stop[at - 1]) if at else 0), int(stop[to - 1])
                    if b > a:
                        own = counts[at:to]
                        logs = np.log10(model.probabilities(hashes[a:b], own))
                        total[at:to] = np.bincount(np.repeat(np.arange(len(own)), own), weights=logs, minlength=len(own))
                    at = to
            none = counts == 0
            mean = total / np.maximum(counts, 1)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "n_words": counts,
                    "log10_prob_per_word": pd.Series(mean).mask(none).astype("Float64"),
                    "perplexity": pd.Series(10.0 ** np.minimum(-mean, 300)).mask(none).astype("Float64"),
                    "log10_prob": pd.Series(total).mask(none).astype("Float64"),
                }
            )
            release()

    return in_batches(docs.select("doc_id", "text"), run, OUT)
