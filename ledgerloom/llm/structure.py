"""Conversation structure repair: the cheapest edits that make a conversation well formed.

Every row is kept, given the other role or deleted, and empty turns may be inserted,
so that the roles' initials read ``(s?(ua)+)?``.  A dynamic programme over the rows
keeps, for each of the four places in that pattern, the cheapest edits so far.

Edit sequences are persistent: linked nodes that share their prefixes.  Each node has
a rolling hash of its whole sequence and binary-lifting ancestors (1, 2, 4, ... edits
back).  Of two sequences of equal cost the one that is least in ASCII order wins; the
search for their longest common prefix compares hashes while jumping back, then the
letters after that prefix.  Prefixes taken for equal by their hashes are compared link
by link up to the first shared node; if a collision misled the search, the sequences
are compared letter by letter.  (Equal in cost, over the same rows, one can't be a
proper prefix of the other: what is longer has paid for more inserts.  So the order of
two sequences never changes by what comes after.)

Conversations stream through sorted tasks.  Once all sequences that can still win share
a prefix, that prefix is settled: it is written out, its rows are digested and
forgotten.  So memory follows the unsettled rows and the result, not the conversation.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3  # what a truncated row costs that stays
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)  # places in the pattern; EMPTY and AFTER_A may end it
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\v\f\r"
RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
    " repaired_sha256 string, n_rows long"
)
_PRIME, _BASE = (1 << 61) - 1, 911_382_323
_SETTLE = 4096  # nodes after which settled prefixes are looked for


class Edits:
    """Edit sequences as linked nodes; node 0 is the empty one."""

    def __init__(self) -> None:
        self.parent, self.letter, self.depth, self.hash = [0], [""], [0], [0]
        self.up: list[list[int]] = [[]]

    def add(self, node: int, letter: str) -> int:
        new = len(self.parent)
        self.parent.append(node)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % _PRIME)
        ups, at, k = [], node, 0
        while True:
            ups.append(at)
            if k >= len(self.up[at]):
                break
            at = self.up[at][k]
            k += 1
        self.up.append(ups)
        return new

    def back(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps >>= 1
            k += 1
        return node

    def text(self, node: int, above: int = 0) -> str:
        letters = []
        while node != above:
            letters.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(letters))

    def _same(self, a: int, b: int) -> bool:
        """Whether two sequences of equal length and hash are equal, link by link."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.parent[a], self.parent[b]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the sequence at ``a`` comes before the one at ``b``."""
        shorter = min(self.depth[a], self.depth[b])
        x, y = self.back(a, self.depth[a] - shorter), self.back(b, self.depth[b] - shorter)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        over_x, over_y = self.parent[x], self.parent[y]
        if self.letter[x] == self.letter[y] or not self._same(over_x, over_y):
            return self.text(a) < self.text(b)
        self.parent[y] = over_x  # proven equal: the next comparison meets here at once
        return self.letter[x] < self.letter[y]

    def meet(self, nodes: list[int]) -> int:
        """The last node that all of ``nodes`` have in common."""
        while len(set(nodes)) > 1:
            deepest = max(self.depth[n] for n in nodes)
            nodes = [self.parent[n] if self.depth[n] == deepest else n for n in nodes]
        return nodes[0]


class Repair:
    """The rows of one conversation, in order, through the dynamic programme."""

    def __init__(self, settle: int = _SETTLE) -> None:
        self.edits = Edits()
        # Cost and node of each place; None where no edits lead.
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self._insert()
        self.waiting: deque[tuple[str, str]] = deque()  # rows not yet settled
        self.audit: list[str] = []
        self.digest, self.lines, self.role = hashlib.sha256(), 0, ""
        self.settle, self.look = settle, settle

    def _cheaper(self, now: tuple[int, int] | None, was: tuple[int, int] | None, letter: str, cost: int) -> tuple[int, int] | None:
        """``was`` followed by an edit, or ``now`` if that is better."""
        if was is None or (now is not None and now[0] < was[0] + cost):
            return now
        new = was[0] + cost, self.edits.add(was[1], letter)
        return new if now is None or new[0] < now[0] or self.edits.less(new[1], now[1]) else now

    def _insert(self) -> None:
        """Turns inserted after what there is: user where one may follow, then assistant."""
        for place in (EMPTY, AFTER_S, AFTER_A):
            self.best[AFTER_U] = self._cheaper(self.best[AFTER_U], self.best[place], INSERT, COST[INSERT])
        self.best[AFTER_A] = self._cheaper(self.best[AFTER_A], self.best[AFTER_U], INSERT, COST[INSERT])

    def push(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        self.waiting.append((role, text))
        was, extra = self.best, TRUNCATED if truncated else 0
        now = [self._cheaper(None, w, DELETE, COST[DELETE]) for w in was]
        if not must_go:
            initial = role[:1]
            if initial == "s":
                now[AFTER_S] = self._cheaper(now[AFTER_S], was[EMPTY], KEEP, extra)
            for letter_of, froms, to in (("u", (EMPTY, AFTER_S, AFTER_A), AFTER_U), ("a", (AFTER_U,), AFTER_A)):
                edit = KEEP if initial == letter_of else REROLE  # keeping is cheaper and leads to the same place
                for place in froms:
                    now[to] = self._cheaper(now[to], was[place], edit, COST[edit] + extra)
        self.best = now
        self._insert()
        self._give_up()
        if len(self.edits.parent) > self.look:
            self._settle()

    def _give_up(self) -> None:
        """Places that can't win any more, whatever comes.

        What can follow an empty start or a system turn can follow a full pair too, at
        most one deletion dearer (of the system turn).
        """
        pair = self.best[AFTER_A]
        if pair is not None:
            for place, more in ((EMPTY, COST[DELETE]), (AFTER_S, 0)):
                other = self.best[place]
                if other is not None and other[0] > pair[0] + more:
                    self.best[place] = None

    def _settle(self) -> None:
        edits, live = self.edits, [b for b in self.best if b is not None]
        shared = edits.meet([n for _, n in live])
        self._write(edits.text(shared))
        fresh, nodes = Edits(), {}
        for _, node in live:
            at = 0
            for letter in edits.text(node, shared):
                at = nodes.get((at, letter)) or nodes.setdefault((at, letter), fresh.add(at, letter))
            nodes[node] = at
        self.best = [None if b is None else (b[0], nodes[b[1]]) for b in self.best]
        self.edits, self.look = fresh, self.settle + 2 * len(fresh.parent)

    def _write(self, audit: str) -> None:
        """Settles the edits ``audit``: digests the turns they leave."""
        self.audit.append(audit)
        for letter in audit:
            role, text = ("", "") if letter == INSERT else self.waiting.popleft()
            if letter == DELETE:
                continue
            if letter != KEEP:
                role = "assistant" if self.role == "u" else "user"
            self.role = role[:1]
            self.digest.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
            self.lines += 1

    def finish(self) -> tuple[int, str, str]:
        """Cost, audit and the repaired conversation's digest."""
        best = self.best[EMPTY]
        other = self.best[AFTER_A]
        if best is None or (other is not None and (other[0] < best[0] or (other[0] == best[0] and self.edits.less(other[1], best[1])))):
            best = other
        self._write(self.edits.text(best[1]))
        return best[0], "".join(self.audit), self.digest.hexdigest()


class Conversation:
    """Counts the faults of one conversation's rows and repairs it."""

    def __init__(self) -> None:
        self.repair = Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.rows = 0
        self.least = self.most = self.before = None

    def push(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        """``repeated``: role and text were seen earlier in the conversation."""
        stripped = text.strip(SPACE)
        blank = not stripped
        duplicate = not blank and (repeated or (turn, role, text) == self.before)
        truncated = not blank and not duplicate and stripped[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in LEGAL
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.before = (turn, role, text)
        self.rows += 1
        self.repair.push(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.finish(), self.rows)


def _audits(kind: pa.DataType):
    names = [c.split()[0] for c in RESULT.split(", ")]

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        conv = None
        ids: list = []
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(ids, kind)]
            for i, name in enumerate(names):
                columns.append(pa.array([d[i] for d in done], pa.string() if name in ("audit", "repaired_sha256") else pa.int64()))
            ids.clear(), done.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *names])

        for batch in batches:
            for conv_id, turn, role, text, copies, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != conv:
                    if now is not None:
                        ids.append(conv)
                        done.append(now.result())
                    now, conv = Conversation(), conv_id
                for _ in range(copies):
                    now.push(turn, role, text, not first)
            if done:
                yield out()
        if now is not None:
            ids.append(conv)
            done.append(now.result())
            yield out()

    return audits


def audit(turns: DataFrame) -> DataFrame:
    """One row per conversation: its faults, and the cheapest edits that repair it.

    ``turns`` has conv_id, turn, role and text; an optional column ``copies`` says how
    often a row is there (0: the conversation exists, the row doesn't).  Rows are taken
    by turn, nulls first, then role and text.  A null role or text is one space.  A null
    conv_id is a conversation like any other; other columns aren't read.  Each row's
    first fault counts: blank; duplicate, of an earlier row's role and text; truncated.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (initials
    of the edits), repaired_sha256 (of ``role:text`` lines) and n_rows.  A conversation
    without rows has zeros and empty strings; an empty table gives no rows.

    A row is a duplicate if its conversation has the same role and text at a smaller
    turn, found by an aggregate and a join that Spark can split; or if it repeats the
    row before it.  Then a conversation's rows run through one task, as its digest has
    to, in sorted batches.
    """
    ship(turns.sparkSession)
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), _spaced("role"), _spaced("text"), copies.alias("copies")
    ).withColumn("_said", F.struct("conv_id", "role", F.sha2("text", 256).alias("text")))
    # Nulls come first in structs; as a struct the key is dealt anew for the join below.
    least = rows.where("copies > 0").groupBy("_said").agg(F.min(F.struct("turn")).alias("_least"))
    least = least.select(F.struct("_said").alias("_key"), "_least")
    rows = rows.withColumn("_key", F.struct("_said")).join(least, "_key", "left")
    first = F.coalesce(F.struct("turn") == F.col("_least"), F.lit(True)).alias("first")
    ordered = (
        rows.select("conv_id", "turn", "role", "text", "copies", first)
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    kind = ordered.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return ordered.mapInArrow(_audits(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, {RESULT}")


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(" ")).alias(column)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with planted faults, for trying the repair: by crc32 of ``conv_id:turn``
    modulo 20, 0 drops the row (copies 0), 1 empties its text, 2 removes ``.!?``, 3
    repeats it (copies 2), 4 makes it a user's.  Nulls are one space."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(F.encode(key, "UTF-8")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return turns.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
