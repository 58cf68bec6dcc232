"""Operator 7: secret scan; a random forest removes false positives.

High-recall patterns give candidates: known token shapes, values assigned to a
name that sounds secret, and long runs of token characters.  A forest trained
on labelled findings then scores length, character transitions, dictionary
coverage, path-likeness and the neighbouring words of every candidate.

The labelled findings are a parameter: rows (before, candidate, after, label).
Without them the forest is trained on ``labelled_findings()``, a fixed set
written here: random credentials in the contexts they leak in, against hashes,
identifiers, placeholders, paths, encoded images and long plain words.

The dictionary and the transitions count every word of every document, in one
aggregate; only the 4-letter pieces and letter pairs, and for the generated
findings a bounded choice of words, reach the driver.

Cases: null and empty texts have no findings; a null ``doc_id`` is kept as
null; rows that repeat a document give equal findings; of overlapping
candidates a known shape stays, else the longer, of equal ones the first; very long texts are scanned
whole, in time that grows with their length; an empty table gives an empty result; other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_batches, narrow, release, shared_dir, slices, written
from tessera.llm.forest import Forest

#: Words that the generated findings are made of, at most; they are a sample, chosen by hash.
FINDING_WORDS = 50_000
#: A 4-letter piece or a word is an ordinary one if it occurs so often; a piece also that often among all
#: words, as in a large corpus any piece of random tokens comes three times.
MIN_PIECE = 3
PIECE_SHARE = 3e-8
MIN_WORD = 2
DECISION = 0.5
#: Characters of context on either side.
CONTEXT = 48

_KNOWN = re.compile(
    r"\b(?:(?P<aws>(?:AKIA|ASIA)[A-Z0-9]{16})|(?P<github>gh[pousr]_[A-Za-z0-9]{20,})|(?P<slack>xox[abprs]-[A-Za-z0-9-]{10,})"
    r"|(?P<stripe>[rs]k_(?:live|test)_[A-Za-z0-9]{16,})|(?P<google>AIza[A-Za-z0-9_-]{35})|(?P<jwt>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+))"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]{16,}-----END (?:[A-Z]+ )*PRIVATE KEY-----")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_ASSIGN = re.compile(r"""(?:=>|[=:])\s{0,3}["'`]?(?P<v>[^\s"'`<>,;(){}]{8,})""")
_URL_PASSWORD = re.compile(r"://[^\s:/@]{1,64}:(?P<v>[^\s:/@]{4,})@")
_SOUNDS = re.compile(r"(?i)(api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|passwd|pwd|credential|private[_-]?key|auth)")
_HASHES = re.compile(r"(?i)(sha\d*|md5|commit|checksum|digest|hash|revision|etag|integrity|uuid|guid|blob|fingerprint)")
_DUMMY = re.compile(r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]|xxxx|\*{3}|test[_-]?key|insert|redacted|0{8}|1234567|abcdef)")
_SCHEME = re.compile(r"(?i)(https?://|www\.|ftp://|data:image|base64,)\S*$")
_PIECES = re.compile(r"[a-z]+")

FEATURES = (
    "length digits upper lower symbols entropy class_changes transition worst_transition coverage hex_only distinct "
    "slashes extension in_url sounds_before hash_before dummy dummy_near assigned quoted word_before known repeats"
).split()


#: The most that one word counts in the letter transitions, and from 1,000,000 words on its share of them.
WORD_CAP = 50
CAP_SHARE = 5e-5


def _pairs(word: str) -> tuple[list[int], list[int]]:
    at = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in f" {word} "]
    return at[:-1], at[1:]


class Dictionary:
    """Letter transitions and pieces of ordinary words, from words and how often they occur."""

    def __init__(self, words: Counter) -> None:
        counts = np.zeros((27, 27))
        pieces: Counter = Counter()
        for word, n in words.items():
            np.add.at(counts, _pairs(word), min(n, WORD_CAP))
            for i in range(len(word) - 3):
                pieces[word[i : i + 4]] += n
        self._set(counts, (p for p, n in pieces.items() if n >= MIN_PIECE))

    @classmethod
    def of(cls, counts: np.ndarray, pieces) -> Dictionary:
        """From counts of letter pairs and the frequent pieces."""
        own = cls.__new__(cls)
        own._set(counts, pieces)
        return own

    def _set(self, counts: np.ndarray, pieces) -> None:
        counts = counts + 1
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))
        self.pieces = frozenset(pieces)

    def transitions(self, token: str) -> tuple[float, float]:
        at = np.frombuffer(token.lower().encode("ascii", "replace"), np.uint8).astype(np.int64) - 96
        at[(at < 1) | (at > 26)] = 0
        if len(at) < 2:
            return -9.0, -9.0
        got = self.log[at[:-1], at[1:]]
        both = (at[:-1] > 0) | (at[1:] > 0)
        got = np.where(both, got, -4.0)
        return float(got.mean()), float(np.sort(got)[: max(1, len(got) // 4)].mean())

    def coverage(self, token: str) -> float:
        covered = 0
        for run in _PIECES.findall(token.lower()):
            reach = 0
            for i in range(len(run) - 3):
                if run[i : i + 4] in self.pieces:
                    covered += i + 4 - max(reach, i)
                    reach = i + 4
        return covered / len(token)


def features(dictionary: Dictionary, before: str, token: str, after: str) -> list[float]:
    n = len(token)
    digits = sum(c.isdigit() for c in token)
    upper = sum(c.isupper() for c in token)
    lower = sum(c.islower() for c in token)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in token]
    count = Counter(token)
    entropy = -sum(k / n * math.log2(k / n) for k in count.values())
    mean, worst = dictionary.transitions(token)
    near = before[-32:]
    lead = before.rstrip()
    word = re.search(r"([^\W\d_]+)\W*$", before)
    return [
        min(n, 200),
        digits / n,
        upper / n,
        lower / n,
        (n - digits - upper - lower) / n,
        entropy,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        mean,
        worst,
        dictionary.coverage(token),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", token))),
        len(count) / n,
        token.count("/") / n,
        float(bool(re.search(r"\.[a-z]{2,4}$|^\.[a-z]{2,4}\b", token + after[:5]))),
        float(bool(_SCHEME.search(before))) or float(before.endswith("/")) * 0.5,
        float(bool(_SOUNDS.search(near))),
        float(bool(_HASHES.search(near))),
        float(bool(_DUMMY.search(token))),
        float(bool(_DUMMY.search(before[-24:] + " " + after[:16]))),
        float(lead.rstrip("\"'`").rstrip().endswith(("=", ":", "=>"))),
        float(before[-1:] in "\"'`" and before != "" and after[:1] in "\"'`" and after != ""),
        dictionary.transitions(word.group(1))[0] if word else -9.0,
        float(bool(_KNOWN.fullmatch(token) or token.startswith("-----BEGIN"))),
        max(count.values()) / n,
    ]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), none inside another."""
    found = [(*m.span(), m.lastgroup) for m in _KNOWN.finditer(text)]
    if "PRIVATE KEY" in text:
        found += [(*m.span(), "private_key") for m in _PEM.finditer(text)]
    if "://" in text:
        found += [(*m.span("v"), "url_password") for m in _URL_PASSWORD.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span("v"), "assigned") for m in _ASSIGN.finditer(text) if _SOUNDS.search(text, max(0, m.start() - 32), m.start())]
    found += [(*m.span(), "token") for m in _RUN.finditer(text)]
    rank = {"assigned": 1, "token": 2}
    found.sort(key=lambda c: (rank.get(c[2], 0) > 0, c[0] - c[1], rank.get(c[2], 0), c[0]))
    kept: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))  # a mark for each place of a kept candidate
    for a, b, kind in found:
        if taken.find(1, a, b) < 0:
            kept.append((a, b, kind))
            taken[a:b] = b"\1" * (b - a)
    return sorted(kept)


def labelled_findings(words: list[str], n: int = 6_000, seed: int = 13) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, label): real-looking secrets and common false alarms."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    full = low + up + dig
    word = lambda: words[int(rng.integers(len(words)))] if words else pick(low, 6)
    prose = lambda k: " ".join(word() for _ in range(k))
    names = ["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "API_TOKEN", "SECRET_KEY", "passwd", "apikey", "TOKEN"]
    out = []
    for i in range(n):
        name, quote = str(rng.choice(names)), str(rng.choice(['"', "'", ""]))
        glue = str(rng.choice([" = ", "=", ": ", " => "]))
        if i % 2:
            kind = int(rng.integers(0, 9))
            token = [
                lambda: pick(hexa, rng.choice([32, 40, 64])),
                lambda: pick(full, rng.integers(20, 64)),
                lambda: base64.b64encode(rng.bytes(int(rng.integers(15, 48)))).decode(),
                lambda: "AKIA" + pick(up + dig, 16),
                lambda: "ghp_" + pick(full, 36),
                lambda: "sk_live_" + pick(full, 24),
                lambda: pick(full + "!#%&*+-", rng.integers(10, 20)),
                lambda: pick(hexa.upper(), rng.choice([32, 40])),
                lambda: f"-----BEGIN RSA PRIVATE KEY-----\n{pick(full + '+/', rng.integers(20, 400))}\n-----END RSA PRIVATE KEY-----",
            ][kind]()
            bare = kind in (3, 4, 5, 8) and rng.random() < 0.6
            before = prose(4) + (" " if bare else f" {name}{glue}{quote}")
            after = (" " if bare else quote + str(rng.choice(["", " ", ";", "###", "!!"]))) + prose(3)
            out.append((before[-CONTEXT:], token, after[:CONTEXT], 1))
        else:
            kind = int(rng.integers(0, 12))
            before, after = prose(5) + " ", " " + prose(3)
            if kind == 0:
                token, before = pick(hexa, rng.choice([40, 64, 32])), prose(3) + str(rng.choice([" commit ", " sha256: ", " md5=", " checksum ", ' "sha1": "', " revision "]))
            elif kind == 1:
                h = pick(hexa, 32)
                token = "-".join([h[:8], h[8:12], h[12:16], h[16:20], h[20:]])
                before = prose(3) + str(rng.choice([" id: ", " uuid ", " ", " guid="]))
            elif kind == 2:
                token = str(rng.choice(["your_api_key_here_xxxx", "xxxxxxxxxxxxxxxxxxxxxxxx", "EXAMPLEKEYEXAMPLEKEY1234", "changeme-please-changeme", "insert-your-token-here", "<redacted-secret-value>", "0000000000000000000000"]))
                before, after = f"{prose(2)} {name}{glue}{quote}", quote + after
            elif kind == 3:
                token = "/".join(word() for _ in range(5)) + "/" + word()
                after = str(rng.choice([".html", ".py", ".jpg", " "])) + prose(2)
            elif kind == 4:
                token, before = pick(full + "+/", rng.integers(40, 90)), prose(2) + " data:image/png;base64,"
            elif kind == 5:
                token = "_".join(word() for _ in range(6))
            elif kind == 6:
                token = "-".join(word() for _ in range(6))
                before = prose(2) + str(rng.choice([" https://site.example.com/", " "]))
            elif kind == 7:
                token, before = "-" * int(rng.integers(20, 60)) if rng.random() < 0.5 else "=" * 40, prose(2) + " "
            elif kind == 8:
                token, before = pick(dig, rng.integers(20, 30)), prose(3) + " "
            elif kind == 9:
                token = word() + "_" + word()
                before, after = f"{prose(2)} {name}{glue}", " " + prose(3)
            else:
                token = "".join(word() for _ in range(6))[: int(rng.integers(20, 40))]
                token = token.upper() if rng.random() < 0.2 else token.capitalize() if rng.random() < 0.2 else token
            out.append((before[-CONTEXT:], token, after[:CONTEXT], 0))
    return out


class Scanner:
    def __init__(self, words: Counter, labelled: list[tuple[str, str, str, int]] | None = None, dictionary: Dictionary | None = None) -> None:
        self.dictionary = dictionary or Dictionary(words)
        plain = sorted(w for w in words if w.isascii() and w.isalpha())
        labelled = labelled or labelled_findings(plain)
        x = np.array([features(self.dictionary, b, c, a) for b, c, a, _ in labelled])
        self.forest = Forest().fit(x, np.array([y for *_, y in labelled]))

    def scores(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        return self.forest.score(np.array([features(self.dictionary, *r) for r in rows]))

    def scan(self, texts: list) -> list[list[tuple[int, int, str, float]]]:
        """Findings (start, end, kind, score) of every text."""
        rows, where = [], []
        for i, text in enumerate(texts):
            for a, b, kind in candidates(text or ""):
                rows.append((text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT]))
                where.append((i, a, b, kind))
        out: list[list] = [[] for _ in texts]
        for (i, a, b, kind), score in zip(where, self.scores(rows).tolist()):
            if score >= DECISION:
                out[i].append((a, b, kind, round(score, 6)))
        return out


_WORD = re.compile(r"[^\W\d_]{2,}")
#: Distinct words that a task holds before it passes their counts on, and characters it splits at once.
HELD_WORDS = 200_000
PIECE = 1 << 20


def _word_counts(batches):
    held: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            at = 0
            while at < len(text):
                stop = at + PIECE
                while stop < len(text) and text[stop].isalnum():
                    stop += 1
                held.update(_WORD.findall(text[at:stop].lower()))
                at = stop
                if len(held) >= HELD_WORDS:
                    yield pd.DataFrame(held.items(), columns=["word", "n"])
                    held.clear()
    if held:
        yield pd.DataFrame(held.items(), columns=["word", "n"])
    release()


def _piece_counts(cap: int):
    """Counts of 4-letter pieces, and of letter pairs under names of two numbers."""

    def run(batches):
        held: Counter = Counter()
        pairs = np.zeros((27, 27), np.int64)
        for batch in batches:
            for word, n in zip(batch["word"], batch["n"].tolist()):
                np.add.at(pairs, _pairs(word), min(n, cap))
                for i in range(len(word) - 3):
                    piece = word[i : i + 4]
                    # others cover nothing: tokens are looked up by runs of a to z
                    if piece.isascii():
                        held[piece] += n
        found = [*held.items(), *((f"{i} {j}", int(pairs[i, j])) for i, j in zip(*np.nonzero(pairs)))]
        if found:
            yield pd.DataFrame(found, columns=["piece", "n"])
        release()

    return run


def fit(docs: DataFrame, labelled: DataFrame | None = None, finding_words: int = FINDING_WORDS) -> Scanner:
    """Scanner with a dictionary of all words of all documents."""
    words = in_batches(docs.where("text is not null").select("text"), _word_counts, "word string, n long")
    words = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_WORD)
    words = written(words, shared_dir(docs.sparkSession) + "/words")
    total = words.agg(F.sum("n")).first()[0] or 0
    cap, least = max(WORD_CAP, round(CAP_SHARE * total)), max(MIN_PIECE, round(PIECE_SHARE * total))
    pieces = words.mapInPandas(_piece_counts(cap), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts, frequent = np.zeros((27, 27)), []
    for row in pieces.where(F.col("n") >= F.when(F.col("piece").contains(" "), 1).otherwise(least)).collect():
        if " " in row.piece:
            i, j = map(int, row.piece.split())
            counts[i, j] = row.n
        else:
            frequent.append(row.piece)
    findings, chosen = None, []
    if labelled is not None:
        findings = sorted((r.before or "", r.candidate, r.after or "", r.label) for r in labelled.where("candidate is not null and label is not null").toLocalIterator())
    if not findings:
        chosen = [r.word for r in words.where(F.col("word").rlike("^[a-z]+$")).orderBy(F.xxhash64("word"), "word").limit(finding_words).collect()]
    return Scanner(Counter(chosen), findings, Dictionary.of(counts, frequent))


OUT = "doc_id long, start int, end int, kind string, score double, masked string"


def _mask(token: str) -> str:
    return token[:4] + "*" * min(len(token) - 4, 8)


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, start, end, kind, score, masked), a row for every secret."""
    scanner = scanner or fit(docs)

    def run(batches):
        for batch in batches:
            texts = batch["text"].tolist()
            ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            for i, j in slices(texts):
                out = [(d, a, b, kind, score, _mask(t[a:b])) for d, t, found in zip(ids[i:j], texts[i:j], scanner.scan(texts[i:j])) for a, b, kind, score in found]
                frame = pd.DataFrame(out, columns=["doc_id", "start", "end", "kind", "score", "masked"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame
            release()

    return in_batches(docs.select("doc_id", "text"), run, OUT)


def redact(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """All documents; every secret is replaced by its kind, and n_chars (if there) follows."""
    scanner = scanner or fit(docs)

    @F.pandas_udf("string")
    def cleaned(text: pd.Series) -> pd.Series:
        texts, out = text.tolist(), []
        for i, j in slices(texts):
            for t, found in zip(texts[i:j], scanner.scan(texts[i:j])):
                parts, at = [], 0
                for a, b, kind, _ in found:
                    parts += [t[at:a], f"[{kind}]"]
                    at = b
                out.append("".join([*parts, t[at:]]) if parts else t)
        release()
        return pd.Series(out, index=text.index, dtype=object)

    narrow(docs.sparkSession)
    done = docs.withColumn("text", cleaned("text"))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
