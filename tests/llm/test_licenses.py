import random
from re import _constants as op
from re import _parser

import pytest

from tessera.llm import licenses as lc
from tessera.llm.license_rules import Rule, rules

SCHEMA = "doc_id long, text string, license string, start int"
CASES = [
    ("Released under the MIT License.", ["MIT"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ("licensed under the GNU General Public License, version 3 or any later version", ["GPL-3.0-or-later"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("LICENSED UNDER\n\tTHE APACHE LICENSE, VERSION 2.0", ["Apache-2.0"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]),
    ("distributed under the terms of the GNU Lesser General Public License v2.1", ["LGPL-2.1-only"]),
    ("see https://creativecommons.org/licenses/by-sa/4.0/ and CC0 1.0", ["CC-BY-SA-4.0", "CC0-1.0"]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ["MIT"]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", ["BSD-2-Clause"]),
    ("Copyright (c) 2019-2021 A. All rights reserved.", ["copyright-notice", "proprietary"]),
    ("the mission to apache country, a generic agreement", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_signatures(text, want):
    own = lc.scanner()
    assert [own.rules[n].licence for _, _, n in own.scan(text)] == want


def test_there_are_hundreds_of_rules_and_each_compiles_once():
    own = rules()
    assert len(own) > 400 and len({r.name for r in own}) == len(own)
    assert len({r.pattern.pattern for r in own}) > 400


def test_prefilter_loses_nothing():
    """The gate against running every rule on every text."""
    own = lc.scanner()
    for text, _ in CASES:
        every = lc.resolve(own.detections(text, list(range(len(own.rules)))), own.rules)
        assert own.scan(text) == every


def test_containment_priority_and_ties():
    ordered = [Rule("low", "L", 5, ("a",), "a"), Rule("high", "H", 1, ("a",), "a"), Rule("high2", "H2", 1, ("a",), "a")]
    assert lc.resolve([(0, 10, 0), (2, 5, 1)], ordered) == [(0, 10, 0), (2, 5, 1)]  # the low one isn't inside the high one
    assert lc.resolve([(2, 5, 0), (0, 10, 1)], ordered) == [(0, 10, 1)]
    assert lc.resolve([(0, 5, 2), (0, 5, 1), (0, 5, 1)], ordered) == [(0, 5, 1)]
    assert lc.resolve([(0, 6, 1), (4, 9, 1)], ordered) == [(0, 6, 1), (4, 9, 1)]


def test_edge_cases(spark):
    mit = "Released under the MIT License."
    long = "plain words " * 200_000 + mit
    rows = [(1, None), (2, ""), (None, mit), (3, mit), (3, mit), (4, long), (5, "nothing here")]
    docs = spark.createDataFrame([(i, t, "own", 7) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id or -1, r.start, r.license) for r in lc.scan(docs).collect())
    assert got == [(-1, 0, "MIT"), (3, 0, "MIT"), (3, 0, "MIT"), (4, 2_400_000, "MIT")]
    assert lc.scan(docs.where("false")).count() == 0


LEFT_OUT = [
    ("https://opensource.org/license/mit", "MIT"),
    ("https://opensource.org/license/bsd-3-clause", "BSD-3-Clause"),
    ("MIT/X11 License", "MIT"),
    ("Creative Commons Zero", "CC0-1.0"),
    ("Open RAIL-M", "OpenRAIL-M"),
    ("Unauthorised copying of this file", "proprietary"),
    ("MIT  License", "MIT"),
    ("M\u0130T License", "MIT"),
    (" * Permission is hereby\n     granted, free of charge, to any\u00a0 person obtaining a copy of this software", "MIT"),
]


LEFT_OUT += [
    ("GNU  General Public License, version 3", "GPL-3.0-only"),
    ("GNU\n    General Public License version 2", "GPL-2.0-only"),
    ("# Mozilla\n# Public License, version 2.0", "MPL-2.0"),
    ("/*\n * Licensed under the Apache\n * License, Version 2.0\n */", "Apache-2.0"),
    ("// Permission is hereby\n// granted, free of charge, to any person obtaining a copy of this software", "MIT"),
    ("-- Licensed under the\n--   Apache License, Version 2.0", "Apache-2.0"),
]


@pytest.mark.parametrize("text,want", LEFT_OUT)
def test_every_alternative_passes_the_gate(text, want):
    own = lc.scanner()
    assert [own.rules[n].licence for _, _, n in own.scan(text)] == [want]


def written(parts, rng):
    """A text that a parsed pattern matches, with odd white space."""
    out = ""
    for kind, value in parts:
        if kind is op.LITERAL:
            out += rng.choice([str.lower, str.upper])(chr(value))
        elif kind is op.IN:
            kind, value = rng.choice(value)
            out += {op.LITERAL: lambda: chr(value), op.RANGE: lambda: chr(value[0]), op.CATEGORY: lambda: rng.choice(" \n\t\u00a0") if value is op.CATEGORY_SPACE else "1"}[kind]()  # noqa: B023
        elif kind is op.SUBPATTERN:
            out += written(value[-1], rng)
        elif kind is op.BRANCH:
            out += written(rng.choice(value[1]), rng)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            out += "".join(written(inner, rng) for _ in range(rng.randint(low, min(int(high), low + 2))))
        elif kind is op.ANY:
            out += "x"
        else:
            assert kind in (op.AT, op.ASSERT, op.ASSERT_NOT)
    return out


def test_gate_against_texts_written_from_every_rule():
    own, rng = lc.scanner(), random.Random(3)
    every = list(range(len(own.rules)))
    for n, rule in enumerate(own.rules):
        tree = _parser.parse(rule.pattern.pattern, rule.pattern.flags)
        for i in range(40):
            text = f"so {written(tree, rng)} it"
            assert n in own.candidates(text) or not rule.pattern.search(text), (rule.name, text)
            if i == n % 40:
                assert own.scan(text) == lc.resolve(own.detections(text, every), own.rules)


def test_places_are_those_of_the_whole_text():
    own = lc.scanner()
    text = "a  b\n\n# c\n/*\n * Licensed under the\n *   Apache License,\n * Version 2.0 for   you\n */ MIT\tLicense"
    assert [text[a:b] for a, b, _ in own.scan(text)] == ["Licensed under the\n *   Apache License,\n * Version 2.0", "MIT\tLicense"]


def test_resolve_against_comparing_all_pairs():
    def plain(found, ordered):
        kept = []
        for a, b, n in sorted(found, key=lambda d: (ordered[d[2]].priority, d[0] - d[1], d[2], d[0])):
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, n))
        return sorted(kept)

    rng = random.Random(1)
    ordered = [Rule(f"r{i}", "L", i % 3, ("a",), "a") for i in range(9)]
    for _ in range(300):
        found = [(a, a + rng.randint(1, 12), rng.randrange(9)) for a in (rng.randrange(30) for _ in range(rng.randrange(25)))]
        assert lc.resolve(found, ordered) == plain(found, ordered)


def test_half_a_million_hits_take_seconds():
    import time

    own = lc.scanner()
    found = [(i * 40, i * 40 + 30 + i % 7, i % len(own.rules)) for i in range(500_000)]
    began = time.time()
    assert len(lc.resolve(found, own.rules)) == 500_000 and time.time() - began < 60
    text = "Licensed under the Apache License, Version 2.0.\n" * 20_000
    assert len(own.scan(text)) == 20_000
