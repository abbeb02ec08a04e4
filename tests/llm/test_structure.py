import hashlib
import itertools
import random
from collections import Counter

import pytest
from ledgerloom.llm import structure as S
from pyspark.sql import functions as F

TURNS = "conv_id long, turn long, role string, text string, copies int, n int, first string, gaps int"
SPACE = " \t\n\v\f\r"


def brute(rows: list[tuple[str, str, bool, int]]) -> tuple[int, str, list[str]]:
    """The cheapest edits by trying all: rows are (role, text, must go, extra)."""
    best = None

    def walk(i: int, place: str, cost: int, audit: str, out: list[str], inserts: int) -> None:
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and place in "ea" and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        if inserts < 2:
            role = "assistant" if place == "u" else "user"
            walk(i, role[0], cost + 3, audit + "I", [*out, f"{role}:"], inserts + 1)
        if i == len(rows):
            return
        role, text, must_go, extra = rows[i]
        walk(i + 1, place, cost + 4, audit + "D", out, 0)
        if must_go:
            return
        next_ = {"e": "su", "s": "u", "u": "a", "a": "u"}[place]
        if role[:1] and role[:1] in next_:
            walk(i + 1, role[0], cost + extra, audit + "K", [*out, f"{role}:{text}"], 0)
        other = "assistant" if place == "u" else "user"
        walk(i + 1, other[0], cost + 3 + extra, audit + "R", [*out, f"{other}:{text}"], 0)

    walk(0, "e", 0, "", [], 0)
    return best


@pytest.mark.parametrize("settle", [1, 8, 4096])
def test_cheapest_edits_against_all_edits(settle):
    rng = random.Random(settle)
    for _ in range(250):
        rows = [
            (rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", " "]), f"t{i}", rng.random() < 0.2, 3 * (rng.random() < 0.3))
            for i in range(rng.randrange(6))
        ]
        repair = S.Repair(settle)
        for role, text, must_go, extra in rows:
            repair.push(role, text, must_go, bool(extra))
        cost, audit, out = brute(rows)
        assert repair.finish() == (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), rows


def test_settling_changes_nothing_and_bounds_memory():
    rng = random.Random(5)
    rows = [(rng.choice(["user", "assistant", "system"]), str(i), rng.random() < 0.1, rng.random() < 0.1) for i in range(20_000)]
    results, most = [], 0
    for settle in (500, 10**9):
        repair = S.Repair(settle)
        for r in rows:
            repair.push(*r)
            if settle == 500:
                most = max(most, len(repair.edits.parent), len(repair.waiting))
        results.append(repair.finish())
    assert results[0] == results[1]
    assert most < 2_000


def test_collisions_of_hashes_are_found(monkeypatch):
    rng = random.Random(6)
    rows = [[(rng.choice(["user", "assistant", "tool"]), str(i), rng.random() < 0.2, rng.random() < 0.3) for i in range(12)] for _ in range(60)]

    def all_results():
        out = []
        for conv in rows:
            repair = S.Repair()
            for r in conv:
                repair.push(*r)
            out.append(repair.finish())
        return out

    right = all_results()
    for prime in (1, 2, 5):  # nearly every two hashes collide
        monkeypatch.setattr(S, "_PRIME", prime)
        assert all_results() == right


def test_order_of_sequences_is_that_of_their_texts(monkeypatch):
    rng = random.Random(7)
    for prime in (S._PRIME, 3):
        monkeypatch.setattr(S, "_PRIME", prime)
        edits = S.Edits()
        for _ in range(300):
            edits.add(rng.randrange(max(0, len(edits.parent) - 20), len(edits.parent)), rng.choice("DIKR"))
        for _ in range(2000):
            a, b = rng.randrange(300), rng.randrange(300)
            x, y = edits.text(a), edits.text(b)
            assert edits.less(a, b) == (x < y), (x, y)
            assert edits.text(a) == x and edits.text(b) == y


def plain(rows):
    """The audit of a table of (conv_id, turn, role, text, copies) without Spark."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, n in rows if c == conv for _ in range(n)]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, fed = set(), Counter(), []
        for _, role, text in mine:
            core = text.strip(SPACE)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            fed.append((role, text, fault in ("blank", "duplicate"), 3 if fault == "truncated" else 0))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in S.LEGAL for a, b in itertools.pairwise(mine))
        cost, audit, said = brute(fed)
        sha = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha, len(mine))
    return out


def test_tables_against_plain_rules(spark):
    rng = random.Random(8)
    texts = ["", " \t\n\v\f\r", "Yes.", "Yes.", "no", "Why? ", "é!\n", " ", "a\x00.", "\x1c", "x" * 5000 + "."]
    rows = [
        (rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9]), rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", None, "tool", ""]),
         rng.choice([*texts, None]), rng.choice([0, 1, 1, 1, 2]))
        for _ in range(60)
    ]
    rows += [(50, 1, "user", "only dropped", 0), (51, None, "user", "same.", 1), (51, 4, "user", "same.", 2), (51, None, "user", "same.", 1)]
    table = spark.createDataFrame([(*r, 3, "x", 4) for r in rows], TURNS)
    got = {r.conv_id: tuple(r)[1:] for r in S.audit(table).collect()}
    assert got == plain(rows)


def test_one_conversation_with_many_copies(spark):
    turns = spark.range(30_000).select(
        F.lit(1).cast("long").alias("conv_id"), (F.col("id") % 3).alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text")
    )
    row = S.audit(turns).collect()[0]
    assert (row.duplicate, row.cost, row.n_rows) == (29_999, 4 * 29_999 + 3, 30_000)
    assert row.audit == "K" + "D" * 29_999 + "I"


def test_empty_table_and_damage(spark):
    empty = spark.createDataFrame([], TURNS)
    assert S.audit(empty).count() == 0
    rows = [(i, None if i == 3 else j, "assistant", "A. b!", 1, 1, "", 0) for i in range(60) for j in range(3)] + [(None, None, None, None, 1, 1, "", 0)]
    import zlib

    for r in S.damaged(spark.createDataFrame(rows, TURNS)).collect():
        key = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        fault = zlib.crc32(key.encode()) % 20
        assert r.copies == {0: 0, 3: 2}.get(fault, 1)
        if r.conv_id is not None:
            assert r.text == {1: "", 2: "A b"}.get(fault, "A. b!") and r.role == ("user" if fault == 4 else "assistant")
