"""Small tables with the cases every operator has to bear, and plain-Python helpers."""

from __future__ import annotations

import random
import re

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " size int, shard string, slot int, score double, `group` int, rank int, _crc string, blob int, row string, passes int"
)
NAMES = [c.split()[0].strip("`") for c in DOCS.split(", ")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice("the of and to in that is was for on".split()) if rng.random() < 0.3 else f"w{rng.randrange(4000)}" for _ in range(n)]
    return " ".join(words)


def edited(rng: random.Random, text: str, k: int) -> str:
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def odd_texts(seed: int = 1) -> list[tuple]:
    """(doc_id, text, source) with nulls, empties, copies, near copies and a long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(5, 160)) for _ in range(40)]
    rows = [(i, t, f"src{i % 5}" if i % 7 else None) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 6], "src0") for i in range(30)]
    rows += [(200 + i, edited(rng, base[7], 1 + i % 4), "src1") for i in range(25)]
    rows += [(300, None, "src0"), (301, "", None), (302, " \t\n", "src2"), (303, "one", None), (304, "one TWO", "src0")]
    rows += [(None, base[3], "src3"), (None, None, None), (None, "only here null id " + base[9], None)]
    rows += [(305, prose(rng, 30_000), "src4"), (306, "éİſK \U0001f600 \x00 café x", "src2")]
    rows += [rows[3], rows[3], (4, "another text under the id of another row", "src9")]
    return rows


def documents(spark, rows: list[tuple]):
    """A documents table with extra columns whose names operators use inside."""
    return spark.createDataFrame(
        [(i, t, "en", s, len(t or ""), 1, "s", 2, 0.5, 3, 4, "c", 5, "r", 6) for i, t, s in rows], DOCS
    )


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingle_set(text: str | None, k: int) -> set[tuple]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    if not w:
        return set()
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
