import random
import re

import fixtures
import pytest
from ledgerloom.llm import licenses

WORD = re.compile(r"[^\W_]+")
SMALL = (("A", "released under the a license"), ("B", "this work is licensed under the general b license version 3"), ("A", "a license"), ("C", "word"))


def brute(text, templates, dice):
    """Best window of each license among all windows within the size bound, better ones
    first and none over a better one of another license."""
    found = [(m.group(), m.start(), m.end()) for m in WORD.finditer((text or "").lower())]
    w = [x for x, _, _ in found]
    pairs = list(zip(w[:-1], w[1:], strict=True))
    windows = []
    for i, (name, t) in enumerate(templates):
        tw = WORD.findall(t.lower())
        own = set(zip(tw[:-1], tw[1:], strict=True))
        if not own:
            continue
        most = int(len(own) * (2 - dice) / dice + 1e-9)
        for first in range(len(pairs)):
            for last in range(first, min(first + most, len(pairs))):
                window = set(pairs[first : last + 1])
                # A window that doesn't begin and end with a hit is never the best one.
                if pairs[first] in own and pairs[last] in own:
                    d = 2 * len(window & own) / (len(window) + len(own))
                    if d >= dice - 1e-12:
                        windows.append((-len(window & own), -d, first, last, i, name))
    best, owner = {}, {}
    for _, d, first, last, i, name in sorted(windows):
        if not any(p in owner for p in range(first, last + 1)):
            best.setdefault(name, (d, first, last, i))
            owner |= dict.fromkeys(range(first, last + 1), name)
    return [(name, i, -d, found[first][1], found[last + 1][2]) for name, (d, first, last, i) in sorted(best.items())]


@pytest.mark.parametrize("dice", [0.8, 0.6, 1.0])
def test_against_all_windows(dice):
    rng = random.Random(6)
    pool = "released under the a license this work is licensed general b version 3 and of".split()
    matcher = licenses.Matcher(SMALL, dice)
    for n in range(300):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 40)))
        if n % 2:
            at = rng.randrange(len(text) + 1)
            text = f"{text[:at]} {rng.choice(SMALL)[1].upper()}. {text[at:]}"
        got = [(m["license"], m["template"], m["dice"], m["begin"], m["end"]) for m in matcher.matches(text)]
        assert got == pytest.approx(brute(text, SMALL, dice)) if not got else got == brute(text, SMALL, dice), text


def test_notices_in_long_and_edited_texts(spark):
    rng = random.Random(7)
    rows = fixtures.odd_texts()
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        rows.append((5000 + i, f"{fixtures.prose(rng, 800)}\n{t.upper()}\n{fixtures.prose(rng, 800)}", "s"))
    rows.append((6000, "This work is licensed under the GNU Affero Public License, version 3.", "s"))
    got = licenses.find_licenses(fixtures.documents(spark, rows)).collect()
    by = {(r.doc_id, r.license): r for r in got}
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert by[5000 + i, name].dice == 1.0
        assert [r.license for r in got if r.doc_id == 5000 + i] == [name]
    assert by[6000, "AGPL-3.0"].dice < 1.0 and (6000, "GPL-3.0") not in by
    assert {r.doc_id for r in got} == {*range(5000, 5000 + len(licenses.TEMPLATES)), 6000}


NEIGHBOURS = {
    "This file is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
    "This work is licensed under the GNU Affero General Public License, version 3": ["AGPL-3.0"],
    "This work is licensed under the GNU Lesser General Public License, version 3": ["LGPL-3.0"],
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": ["CC-BY-SA-4.0"],
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": ["CC-BY-ND-4.0"],
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": ["CC-BY-NC-ND-4.0"],
    "It is released under the BSD 2-Clause License": ["BSD-2-Clause"],
    "It is released under the ISC license, see below": ["ISC"],
    "Code: licensed under the Apache License, version 2.0. Text: licensed under CC BY-ND 4.0.": ["Apache-2.0", "CC-BY-ND-4.0"],
    "This work is licensed under the GNU General Public License, version 2. Parts: this work is licensed by the GNU General Public License, version 3.": ["GPL-2.0", "GPL-3.0"],
    "the general public has no license": [],
}


@pytest.mark.parametrize("text", NEIGHBOURS)
def test_neighbours_are_told_apart(text):
    assert [m["license"] for m in licenses.Matcher().matches(text)] == NEIGHBOURS[text]


def test_span_is_of_the_text():
    text = "é\U0001f600 x — Released under the MIT License. y"
    (m,) = licenses.Matcher().matches(text)
    assert text[m["begin"] : m["end"]] == "Released under the MIT License"


def test_empty_table(spark):
    assert licenses.find_licenses(fixtures.documents(spark, [])).count() == 0
