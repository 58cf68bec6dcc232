"""Operator 3: language of every span of a document.

The script of a word (Unicode ranges) narrows its candidates to the languages
whose labelled documents are written in it.  A word's score is a character
n-gram model of each language and script, trained here on documents with a known
``lang``; Viterbi over the words with a penalty for every switch gives the spans.
A script that no labelled language is written in stands for the language in
``SCRIPTS`` (fit 0, as there is nothing to compare with), any other for ``und``.
Words of digits or of letters common to scripts score nothing and take their
neighbours' language.

Cases: null, empty and letterless texts have no spans, language ``und`` and
``accepted`` false; a null ``doc_id`` is kept as null; rows that repeat a
document give equal rows; ties go to the first language in order of name;
without any labelled document all Latin words are ``und``; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import in_batches, narrow, release, small

#: Labelled documents of each language that the n-gram model is fitted on, at most.
TRAIN_DOCS = 1_000
#: Documents counted at once.
TRAIN_BATCH = 20
ORDER = 4
#: Buckets of the hashed n-grams.
BUCKETS = 1 << 17
SMOOTH = 0.002
#: Log-probability lost at a switch of language.
SWITCH = 7.0
#: The most that one word can speak against a language of its script.
CAP = 4.0
#: Score of a language that the script of a word rules out.
RULED_OUT = -40.0
#: A document is accepted if so large a share of its letters is one language ...
MIN_SHARE = 0.5
#: ... and they look like that language: average log-probability of an n-gram.
MIN_FIT = -10.5
#: A language is written in a script that holds such a share of its labelled letters.
WRITTEN = 0.1
#: Outside Latin script fits are moved so that labelled text has, on average, MIN_FIT and this.
FIT_MARGIN = 3.0
#: Characters taken through Viterbi at once.
PIECE = 500_000

SCRIPTS = {
    "el": (r"\p{Greek}",),
    "ru": (r"\p{Cyrillic}",),
    "ar": (r"\p{Arabic}",),
    "he": (r"\p{Hebrew}",),
    "hi": (r"\p{Devanagari}",),
    "th": (r"\p{Thai}",),
    "ko": (r"\p{Hangul}",),
    "ja": (r"[\p{Hiragana}\p{Katakana}]",),
    "zh": (r"\p{Han}",),
}
#: Blocks of scripts that stand for no language by themselves.
BLOCKS = {
    "Armenian": [(0x530, 0x590)], "Syriac": [(0x700, 0x750)], "Thaana": [(0x780, 0x7C0)], "NKo": [(0x7C0, 0x800)],
    "Bengali": [(0x980, 0xA00)], "Gurmukhi": [(0xA00, 0xA80)], "Gujarati": [(0xA80, 0xB00)], "Oriya": [(0xB00, 0xB80)],
    "Tamil": [(0xB80, 0xC00)], "Telugu": [(0xC00, 0xC80)], "Kannada": [(0xC80, 0xD00)], "Malayalam": [(0xD00, 0xD80)],
    "Sinhala": [(0xD80, 0xE00)], "Lao": [(0xE80, 0xF00)], "Tibetan": [(0xF00, 0x1000)], "Myanmar": [(0x1000, 0x10A0)],
    "Georgian": [(0x10A0, 0x1100), (0x1C90, 0x1CC0), (0x2D00, 0x2D30)], "Ethiopic": [(0x1200, 0x13A0), (0x2D80, 0x2DE0)],
    "Cherokee": [(0x13A0, 0x1400), (0xAB70, 0xABC0)], "Canadian": [(0x1400, 0x1680)], "Khmer": [(0x1780, 0x1800)],
    "Mongolian": [(0x1800, 0x18B0)], "Ol Chiki": [(0x1C50, 0x1C80)], "Tifinagh": [(0x2D30, 0x2D80)], "Yi": [(0xA000, 0xA4D0)],
    "Javanese": [(0xA980, 0xA9E0)], "Meetei": [(0xAAE0, 0xAB00), (0xABC0, 0xAC00)], "Adlam": [(0x1E900, 0x1E960)],
}
_NONE, _LATIN, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = {code: 4 + i for i, code in enumerate(SCRIPTS)}
_BLOCK = {name: 4 + len(SCRIPTS) + i for i, name in enumerate(BLOCKS)}
#: All further scripts together.
_REST = 4 + len(SCRIPTS) + len(BLOCKS)


@cache
def script_table() -> np.ndarray:
    """Class of every code point: none, Latin, digit, letter common to scripts, or a script."""
    table = np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def mark(pattern: str, value: int) -> None:
        for m in regex.finditer(f"(?:{pattern})+", points):
            a, b = (ord(m.group()[0]), ord(m.group()[-1]))
            table[a : b + 1] = value  # a run may cross the surrogates, which are no text

    mark(r"\p{L}", _REST)
    mark(r"\p{N}", _DIGIT)
    for name, parts in BLOCKS.items():
        for at in (c for a, b in parts for c in range(a, b)):
            if unicodedata.category(chr(at))[0] in "LM":
                table[at] = _BLOCK[name]
    for code, (pattern,) in SCRIPTS.items():
        mark(pattern, _CLASS[code])
    mark(r"\p{Latin}", _LATIN)
    mark(r"(?=\p{L})[\p{Common}\p{Inherited}]", _OTHER)
    table[0xD800:0xE000] = _NONE
    return table


def _codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each followed by a line end; lengths."""
    parts = []
    for text in texts:
        text = text or ""
        low = text.lower()
        if len(low) != len(text):  # keeps offsets right where lower case is longer
            low = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))
        parts.append(low)
    flat = "\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(flat, np.uint32), np.array([len(x) + 1 for x in parts], np.int64)


class Words:
    """The words of some texts: runs of one script (digits are words of no script)."""

    def __init__(self, texts: list) -> None:
        self.codes, self.chars = _codes(texts)
        self.kind = script_table()[self.codes]
        edge = np.flatnonzero(np.diff(self.kind, prepend=np.uint8(0), append=np.uint8(0)) != 0)
        self.begin, self.end = edge[:-1], edge[1:]
        own = self.kind[self.begin] != _NONE if len(edge) else np.zeros(0, bool)
        self.begin, self.end = self.begin[own], self.end[own]
        self.cls = self.kind[self.begin]
        stops = np.cumsum(self.chars)
        self.text_start = stops - self.chars
        self.counts = np.diff(np.searchsorted(self.begin, stops), prepend=0)

    def grams(self):
        """For every order: (word, bucket) of the n-grams of lettered words with their boundaries."""
        lettered = (self.kind == _LATIN) | (self.kind > _OTHER)
        same = self.kind[1:] == self.kind[:-1]
        of = np.cumsum(np.bincount(self.begin, minlength=len(self.kind))[: len(self.kind)]) - 1
        for n in range(2, ORDER + 1):
            if len(self.codes) < n:
                return
            m = len(self.codes) - n + 1
            ok = lettered[:m] | lettered[1 : m + 1] if n == 2 else lettered[1 : m + 1].copy()
            for k in range(2, n - 1):
                ok &= same[k - 1 : m + k - 1]
            at = np.flatnonzero(ok)
            left = lettered[at] if n == 2 else same[at]
            right = (same[at] | ~left) if n == 2 else same[at + n - 2]
            h = np.full(len(at), n, np.uint32)
            for k in range(n):
                code = self.codes[at + k]
                h = h * np.uint32(1_000_003) + (np.where(left, code, np.uint32(1)) if k == 0 else np.where(right, code, np.uint32(1)) if k == n - 1 else code)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            word = of[at + 1]
            if n == 2:
                word = np.where(left, of[at], word)
            yield word, (h >> np.uint32(15)).astype(np.int64)


class Model:
    """Languages in order of name; for each script's languages tables of n-gram log-probabilities.

    tables: class of a script -> (languages, a row of log-probabilities for each, what to add to their fits).
    """

    def __init__(self, tables: dict[int, tuple[list[str], np.ndarray, np.ndarray]]) -> None:
        self.tables = tables
        self.latin = tables[_LATIN][0] if _LATIN in tables else []
        self.langs = sorted({*(x for langs, _, _ in tables.values() for x in langs), *SCRIPTS, "und"})
        self.at = {x: i for i, x in enumerate(self.langs)}

    def scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word x language) scores for Viterbi; average log-probability of a word's n-grams."""
        n = len(words.begin)
        score = np.full((n, len(self.langs)), RULED_OUT, np.float32)
        fit = np.zeros((n, len(self.langs)), np.float32)
        here = {int(c) for c in np.unique(words.cls)} - {_DIGIT, _OTHER}
        totals = {c: np.zeros((n, len(self.tables[c][0]))) for c in here if c in self.tables}
        count = np.zeros(n)
        for word, bucket in words.grams() if totals else ():
            count += np.bincount(word, minlength=n)
            of = words.cls[word]
            for c, total in totals.items():
                own = of == c
                w, b = (word, bucket) if own.all() else (word[own], bucket[own])
                for j, row in enumerate(self.tables[c][1]):
                    total[:, j] += np.bincount(w, weights=row[b], minlength=n)
        for c, total in totals.items():
            own = words.cls == c
            part = np.maximum(total - total.max(axis=1, keepdims=True), -CAP)
            for j, lang in enumerate(self.tables[c][0]):
                score[own, self.at[lang]] = part[own, j]
                fit[own, self.at[lang]] = (total[:, j] / np.maximum(count, 1))[own] + self.tables[c][2][j]
        score[(words.cls == _DIGIT) | (words.cls == _OTHER)] = 0
        default = {cls: code for code, cls in _CLASS.items()}
        for c in here - set(totals):
            score[words.cls == c, self.at[default.get(c, "und")]] = 0
        # Han alone may be Japanese; the kana around it decide
        han = words.cls == _CLASS["zh"]
        known = self.tables.get(_CLASS["zh"], ((), None, None))[0]
        if "zh" not in known:
            score[han] = np.maximum(score[han] - 1, RULED_OUT)
            score[han, self.at["zh"]] = 0
        if "ja" not in known:
            score[han, self.at["ja"]] = -1.0
        return score, fit


def viterbi(score: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word of many documents, stepped side by side.

    score: words of all documents one after the other x languages.
    """
    n, langs = score.shape
    path = np.zeros(n, np.int16)
    docs = np.argsort(-lengths, kind="stable")
    docs = docs[lengths[docs] > 0]
    if not len(docs):
        return path
    start = (np.cumsum(lengths) - lengths)[docs]
    size = lengths[docs]
    active = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # documents with more than t words
    back = np.empty(n, np.int16)
    stayed = np.empty((n, langs), bool)
    state = score[start].astype(np.float64)
    last = np.empty((len(docs), langs))
    for t in range(1, int(size[0])):
        k = active[t]
        if k < len(state):
            last[k : len(state)] = state[k:]
            state = state[:k]
        at = start[:k] + t
        best = state.argmax(axis=1)
        top = state[np.arange(k), best][:, None] - switch
        stay = state >= top
        back[at] = best
        stayed[at] = stay
        state = np.where(stay, state, top) + score[at]
    last[: len(state)] = state
    now = last.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        path[at] = now[:k]
        if t:
            cur = now[:k]
            now[:k] = np.where(stayed[at, cur], cur, back[at])
    return path


def best_path(score: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The path of ``viterbi``, without stepping through documents of one language.

    A path with s switches has at most s + 1 runs in another language than the
    document's best; if none gains more than half of what a switch costs, all of
    them gain no more than the s switches cost, and no path beats that one.
    """
    lengths = np.asarray(lengths, np.int64)
    if not len(score):
        return np.zeros(0, np.int16)
    has = np.flatnonzero(lengths > 0)
    size = lengths[has]
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(has)), size)
    total = np.add.reduceat(score.astype(np.float64), first, axis=0)
    main = total.argmax(axis=1)
    base = score[np.arange(len(score)), main[row]].astype(np.float64)
    gain = np.zeros(len(has))
    for j in range(score.shape[1]):
        c = np.cumsum(score[:, j] - base)
        before = np.r_[0.0, c[:-1]]
        c, before = c - before[first][row], before - before[first][row]
        # a lower level for each document makes the running minimum start anew
        level = row * -(float(np.abs(c).max()) * 2 + 1)
        low = np.minimum.accumulate(before + level) - level
        gain = np.maximum(gain, np.maximum.reduceat(c - low, first))
    path = main[row].astype(np.int16)
    mixed = gain > switch / 2 - 1e-3
    if mixed.any():
        own = mixed[row]
        path[own] = viterbi(score[own], size[mixed], switch)
    return path


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """The model from at most ``train_docs`` whole documents of each labelled language, chosen by hash.

    The hashes are cut first, so no text of the other rows leaves its scan.
    """
    docs = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    first = docs.select("lang", "h").withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("n") <= train_docs)
    cut = {r.lang: r.h for r in first.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    counts = Counts()
    if not cut:
        return counts.model()
    last = docs.sparkSession.createDataFrame(list(cut.items()), "lang string, last long")
    rows = docs.join(small(last, len(cut)), "lang").where("h <= last").select("lang", "h", "text").orderBy("lang", "h", "text")
    lang, seen, held = None, 0, []
    for row in rows.toLocalIterator():
        if row.lang != lang:
            counts.add(lang, held)
            lang, seen, held = row.lang, 0, []
        seen += 1
        if seen > train_docs:  # rows that are repeated have equal hashes
            continue
        held.append(row.text)
        if len(held) == TRAIN_BATCH:
            counts.add(lang, held)
            held = []
    counts.add(lang, held)
    return counts.model()


class Counts:
    """n-grams and letters of every language in every script; documents go to two halves in turn."""

    def __init__(self) -> None:
        self.grams: dict[tuple[int, str], np.ndarray] = {}
        self.letters: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        self.half = 0

    def add(self, lang: str, texts: list[str]) -> None:
        texts = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
        for at, to in pieces(texts):
            self.half ^= 1
            words = Words(texts[at:to])
            size = np.bincount(words.cls, weights=words.end - words.begin, minlength=256)
            own = [c for c in np.flatnonzero(size).tolist() if c not in (_DIGIT, _OTHER)]
            for c in own:
                self.letters[lang][c] += int(size[c])
                self.grams.setdefault((c, lang), np.zeros((2, BUCKETS)))
            for word, bucket in words.grams():
                of = words.cls[word]
                for c in own:
                    self.grams[c, lang][self.half] += np.bincount(bucket[of == c], minlength=BUCKETS)

    def model(self) -> Model:
        """Smoothed log-probabilities of hashed n-grams, a row for each language that a script is written in."""
        written = {}
        for lang, size in self.letters.items():
            least = min(WRITTEN * sum(size.values()), max(size.values()))
            for c in (c for c, k in size.items() if k >= least):
                written.setdefault(c, []).append(lang)
        tables = {}
        for c, langs in written.items():
            langs.sort()
            halves = np.array([self.grams[c, x] for x in langs])
            # smoothed towards all languages, so that an n-gram seen nowhere says nothing
            shared = (halves.sum(axis=(0, 1))[None] + 1) / (halves.sum() + BUCKETS)
            smooth = lambda k: np.log((k / np.maximum(k.sum(axis=1, keepdims=True), 1) + SMOOTH * shared) / (1 + SMOOTH))  # noqa: B023, E731
            shift = np.zeros(len(langs))
            if c != _LATIN:
                for j, (a, b) in enumerate(halves):
                    other = (b * smooth(a[None])[0]).sum() / max(b.sum(), 1)
                    # a language of a single piece has nothing to be compared with
                    shift[j] = MIN_FIT + FIT_MARGIN - other if a.any() and b.any() else -MIN_FIT * 2
            tables[c] = (langs, smooth(halves.sum(axis=1)).astype(np.float32), shift)
        return Model(tables)


def train(texts: dict[str, list[str]]) -> Model:
    """The model of texts by language."""
    counts = Counts()
    for lang in sorted(texts):
        for at in range(0, len(texts[lang]), TRAIN_BATCH):
            counts.add(lang, texts[lang][at : at + TRAIN_BATCH])
    return counts.model()


OUT = "doc_id long, language string, share double, fit double, accepted boolean, spans array<struct<start:int,end:int,language:string>>"


def label(model: Model, texts: list, switch: float = SWITCH) -> list[tuple]:
    """(language, share, fit, accepted, spans) of every text; span ends are characters."""
    words = Words(texts)
    score, fits = model.scores(words)
    lettered = (words.cls != _DIGIT) & (words.cls != _OTHER)
    used = np.flatnonzero((score[lettered] > RULED_OUT).any(axis=0)) if lettered.any() else np.zeros(1, np.int64)
    path = used[best_path(score[:, used], words.counts, switch)]
    fits = fits[np.arange(len(path)), path]
    chars = words.end - words.begin
    out, at = [], 0
    for i, n in enumerate(words.counts.tolist()):
        cut = slice(at, at + n)
        at += n
        part, here, size = path[cut], lettered[cut], chars[cut]
        if not here.any():
            out.append(("und", 0.0, 0.0, False, []))
            continue
        mass = np.bincount(part[here], weights=size[here], minlength=len(model.langs))
        main = int(mass.argmax())
        share = float(mass[main] / mass.sum())
        own = here & (part == main)
        good = float(np.average(fits[cut][own], weights=size[own]))
        turn = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        stop = np.r_[turn[1:], n] - 1
        begin, end = words.begin[cut] - words.text_start[i], words.end[cut] - words.text_start[i]
        spans = [(int(begin[a]), int(end[b]), model.langs[part[a]]) for a, b in zip(turn, stop)]
        lang = model.langs[main]
        out.append((lang, share, good, lang != "und" and share >= MIN_SHARE and good >= MIN_FIT, spans))
    return out


def pieces(texts: list):
    """Positions (from, to) that cut texts into lists of about PIECE characters."""
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text or "") + 1
        if size >= PIECE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def identify(docs: DataFrame, model: Model | None = None, switch: float = SWITCH) -> DataFrame:
    """(doc_id, language, share, fit, accepted, spans), a row for every row of docs."""
    if model is None:
        model = fit(docs)

    def run(batches):
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in pieces(texts):
                part = pd.DataFrame(label(model, texts[a:b], switch), columns=["language", "share", "fit", "accepted", "spans"])
                part["spans"] = [[{"start": i, "end": j, "language": x} for i, j, x in s] for s in part["spans"]]
                part.insert(0, "doc_id", batch["doc_id"].iloc[a:b].astype("Int64").to_numpy())
                yield part
            release()

    return in_batches(docs.select("doc_id", "text"), run, OUT)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents whose language is accepted, with all their columns."""
    if model is None:
        model = fit(docs)

    @F.pandas_udf("boolean")
    def accepted(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        found = [x[3] for a, b in pieces(texts) for x in label(model, texts[a:b])]
        release()
        return pd.Series(found, index=text.index, dtype=bool)

    narrow(docs.sparkSession)
    return docs.where(accepted("text"))
