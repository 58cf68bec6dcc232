"""Operator 5: licence scan by ordered signature rules.

Texts are first squeezed: a run of white space, with the comment leaders after
its line ends, becomes one blank, so wrapped and commented headers read as
prose; places found are mapped back to the whole text.  An Aho-Corasick
automaton over the rules' keywords gates the rules: a regex runs only over texts
that hold one of its keywords.  Detections are then resolved: going by priority,
then length, then order of the rules, one is dropped if its interval lies inside
a kept one; others stay, also where they overlap in part.  Time grows with a
text's length and, but for a logarithm, with its detections.

Cases: null and empty texts give no rows; a null doc_id is kept as null; rows
that repeat a document give equal rows; of equal intervals the first by that
order stays; keywords and patterns ignore case; very long texts are read whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.llm.common import in_batches
from tessera.llm.license_rules import Rule, rules

#: White space that is more or other than one blank, and what begins a line of a comment.
_RUN = re.compile(r"\s*\n(?:\s*(?:/\*+|//+!?|\*+|#+!?|--+|;+|%+|>+|<!--|\"{3}|'{3}|dnl\b|rem\b))*\s*|[^\S ]\s*| \s+", re.IGNORECASE)
#: Letters that a pattern takes for i and s when it ignores case.
_FOLD = {0x130: "i", 0x131: "i", 0x17F: "s"}

OUT = "doc_id long, start int, end int, license string, rule string, priority int"


class Scanner:
    def __init__(self, ordered: list[Rule]) -> None:
        self.rules = ordered
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for n, rule in enumerate(ordered):
            for keyword in rule.keywords:
                by.setdefault(keyword, []).append(n)
        for keyword, own in by.items():
            self.automaton.add_word(keyword, tuple(own))
        self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """Rules with a keyword in the squeezed text."""
        low = _RUN.sub(" ", (text if text.isascii() else text.translate(_FOLD)).lower())
        found: set[int] = set()
        for _, own in self.automaton.iter(low):
            found.update(own)
        return sorted(found)

    def detections(self, text: str, own: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, rule) of every match in the squeezed text, at its place in the text."""
        gaps = [m.span() for m in _RUN.finditer(text)]
        if not gaps:
            return [(*m.span(), n) for n in own for m in self.rules[n].pattern.finditer(text) if m.end() > m.start()]
        squeezed = _RUN.sub(" ", text)
        edge = np.array(gaps, np.int64)
        longer = np.cumsum(edge[:, 1] - edge[:, 0] - 1)
        place = edge[:, 0] - np.r_[0, longer[:-1]]
        longer = np.r_[0, longer]
        found = [(*m.span(), n) for n in own for m in self.rules[n].pattern.finditer(squeezed) if m.end() > m.start()]
        if not found:
            return []
        a, b, n = np.array(found, np.int64).T
        back = lambda x: x + longer[np.searchsorted(place, x, "left")]
        return list(zip(back(a).tolist(), (back(b - 1) + 1).tolist(), n.tolist()))

    def scan(self, text: str | None) -> list[tuple[int, int, int]]:
        """Kept (start, end, rule), in order of place."""
        if not text:
            return []
        return resolve(self.detections(text, self.candidates(text)), self.rules)


def resolve(found: list[tuple[int, int, int]], ordered: list[Rule]) -> list[tuple[int, int, int]]:
    """The detections that lie inside no other one that goes before them.

    A Fenwick tree holds, for every place, the greatest end of the kept ones that
    start there or before.
    """
    found = sorted(found, key=lambda d: (ordered[d[2]].priority, d[0] - d[1], d[2], d[0]))
    starts = {a: i + 1 for i, a in enumerate(sorted({d[0] for d in found}))}
    ends = [0] * (len(starts) + 1)
    kept: list[tuple[int, int, int]] = []
    for a, b, n in found:
        at = i = starts[a]
        while i and ends[i] < b:
            i &= i - 1
        if i:
            continue
        kept.append((a, b, n))
        while at < len(ends):
            if ends[at] < b:
                ends[at] = b
            at += at & -at
    return sorted(kept)


@cache
def scanner() -> Scanner:
    return Scanner(rules())


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, license, rule, priority), a row for every licence found."""

    def run(batches):
        own = scanner()
        for batch in batches:
            ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            rows = [(d, a, b, own.rules[n].licence, own.rules[n].name, own.rules[n].priority) for d, t in zip(ids, batch["text"]) for a, b, n in own.scan(t)]
            frame = pd.DataFrame(rows, columns=["doc_id", "start", "end", "license", "rule", "priority"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return in_batches(docs.select("doc_id", "text"), run, OUT)
