"""Exact Jaccard self-join of documents on word n-grams, with set-relation skipping.

A document is the set of its distinct k-word shingles.  Shingles are ordered rare first
(by their rarest word, counted over all documents in a fixed-size table, then by hash);
two sets with Jaccard at least t share one of their first |x| - ceil(t |x|) + 1
shingles.  Those are the entries of the index lists, each with its position and its
set's size.

Relations between sets keep the lists from being multiplied out:

* Equal sets are one node.
* Index level: in a list a set at position i of n needs n - i >= o and, against position
  j, i + j <= n + m - 2 o, where o is the overlap that sizes n and m ask for.  Blocks of
  other sizes and later positions are skipped by these bounds.
* Before whole sets are fetched or, in the second step, pairs are formed at all, parity
  bitmaps bound the difference: two sets differ in at least as many shingles as their
  bitmaps in bits.
* Answer level: the set of a list with the lowest position (the one with the fewest
  rare shingles of its own) leads it, and is compared with the others on whole sets.
  What a set has other than its leader, its *difference*, is kept.  Sets gather round
  leaders; two sets x, y of one leader differ in exactly the symmetric difference of
  their differences, so all answers inside such a family come from the answers of its
  leader, without lists and without whole sets.  Only pairs of different families are
  formed from lists, and compared by the difference of their leaders, worked out once
  for two families, and their own.

So every link between different sets is found and counted.  Sets are hashed to 64 bits:
two of n different sets get one hash with probability about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, ship, staged, text_or_empty
from ledgerloom.llm.graph import components
from ledgerloom.llm.learning import flat
from ledgerloom.llm.shingles import Shingler, texts_of

PARITY = 16  # longs of a set's parity bitmap
COUNTERS = 1 << 22  # of words, over all documents
BITS = 1 << 25  # of the bitmaps of shared shingles and of documents to read again
BLOCK = 512  # sets of a family that are compared with each other at once
SPREAD = 1024  # sets compared with one leader in one task
_SHIFT = np.uint64(64 - 22)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    shingler = Shingler(k)
    for text in texts_of(column):
        yield np.unique(shingler.shingles(text))


def parity(own: np.ndarray) -> np.ndarray:
    """PARITY longs; a bit tells whether an odd number of the shingles falls on it."""
    odd = np.bincount((own & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def word_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How often the words of each counter occur, over all rows."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        shingler = Shingler(k)
        for batch in batches:
            waiting, size = [], 0
            for text in texts_of(batch.column(0)):
                waiting.append((shingler.words(text) >> _SHIFT).astype(np.int64))
                size += len(waiting[-1])
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
                    waiting, size = [], 0
            if waiting:
                total += np.bincount(np.concatenate(waiting), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["c", "n"])

    rows = docs.select("text").mapInArrow(per_task, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[rows["c"].to_numpy()] = rows["n"].to_numpy()
    return np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)


def _rarity(words: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Of each shingle the count of its rarest word."""
    each = counts[(words >> _SHIFT).astype(np.int64)]
    k = min(k, len(words))
    least = each[: len(words) - k + 1]
    for i in range(1, k):
        least = np.minimum(least, each[i : len(words) - k + 1 + i])
    return least


def _in_index_order(words: np.ndarray, shingles: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles by hash, and their places in order of rarity, then hash."""
    by = np.argsort(shingles)
    own = shingles[by]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    own = own[new]
    rarity = _rarity(words, counts, k)[by[new]] if len(own) else np.zeros(0, np.int32)
    ranked = np.sort(rarity.astype(np.uint64) << np.uint64(32) | np.arange(len(own), dtype=np.uint64))
    return own, (ranked & np.uint64(0xFFFFFFFF)).astype(np.int64)


def index_entries(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, crc, bit, set (hash), n, prefix (shingles in index order) and bits of each row.

    ``bit`` stands for the doc_id where rows are read again.  In each task only the first
    row of a set carries prefix and bits (its parity).
    """
    ship(docs.sparkSession)
    counts = docs.sparkSession.sparkContext.broadcast(word_counts(docs, k))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        shingler = Shingler(k)
        for batch in batches:
            hashes, sizes, prefixes, bits = [], [], [], []
            for text in texts_of(batch.column(3)):
                words = shingler.words(text)
                own, order = _in_index_order(words, shingler.of_words(words), counts.value, k)
                n = len(own)
                h = xxhash.xxh3_64_intdigest(own.tobytes())
                hashes.append(h)
                sizes.append(n)
                if n and h not in seen:
                    seen.add(h)
                    prefixes.append(own[order[: n - -(-num * n // den) + 1]].view(np.int64))
                    bits.append(parity(own))
                else:
                    prefixes.append(None)
                    bits.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], _signed(np.array(hashes, dtype=np.uint64)),
                    pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
                ],
                ["doc_id", "crc", "bit", "set", "n", "prefix", "bits"],
            )

    rows = docs.select("doc_id", F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("crc"), _bit("doc_id").alias("bit"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, crc long, bit int, set long, n int, prefix array<long>, bits array<long>"
    return staged(rows.mapInArrow(per_task, schema), "ngram-index")


def _bitmap(values: DataFrame) -> np.ndarray:
    """Bits of all values of the int column ``bit``: BITS / 64 words at most."""
    words = (
        values.groupBy(F.expr("bit div 64").cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("b")).toArrow()
    )
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def _in_bitmap(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 6] >> (bits & 63)) & 1 == 1


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS)).cast("int")


def index_lists(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(token, pos, n, set) of the shingles that two or more sets have in their prefix.

    Tokens are first told apart by 57 of their bits, so that few bytes are shuffled;
    the bitmap of those in several sets then thins the lists out before they are.  A
    list of two entries that its sizes or positions rule out is skipped whole.
    """
    single = entries.where("prefix is not null").select("prefix", "set")
    low = single.select(F.explode("prefix").alias("t"), F.hash("set").alias("s"))
    low = low.select(F.shiftright("t", 7).alias("t"), "s")
    shared = low.groupBy("t").agg(F.min("s").alias("a"), F.max("s").alias("z")).where("a <> z")
    bitmap = entries.sparkSession.sparkContext.broadcast(_bitmap(shared.select(F.pmod("t", F.lit(BITS)).cast("int").alias("bit"))))

    @F.arrow_udf("array<struct<token:long,pos:int>>")
    def thinned(prefixes: pa.Array) -> pa.Array:
        tokens, offsets = flat(prefixes)
        keep = _in_bitmap(bitmap.value, (tokens >> 7) % BITS)
        pos = np.arange(len(tokens)) - np.repeat(offsets[:-1], np.diff(offsets))
        ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
        items = pa.StructArray.from_arrays(
            [pa.array(tokens[keep]), pa.array(pos[keep].astype(np.int32))], ["token", "pos"]
        )
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items)

    kept = entries.where("prefix is not null").select("set", "n", F.explode(thinned("prefix")).alias("e"))
    kept = kept.select("e.token", "e.pos", "n", "set")
    several = kept.groupBy("token").agg(
        F.min("set").alias("_a"), F.max("set").alias("_z"), F.count("*").alias("_k"),
        F.min("n").alias("_least"), F.max("n").alias("_most"), F.sum("n").alias("_n"), F.sum("pos").alias("_pos"),
    )
    overlap = f"(({num}L * _n + {num + den - 1}) div {num + den})"
    fits = f"{den}L * _least >= {num}L * _most and _pos <= _n - 2 * {overlap}"
    several = several.where(f"_a <> _z and (_k > 2 or ({fits}))")
    return staged(kept.join(several.select("token"), "token"), "ngram-lists")


def _may_link(num: int, den: int, i: str, n: str, j: str, m: str) -> Column:
    """Size and position bounds of two entries of a list."""
    overlap = f"(({num}L * ({n} + {m}) + {num + den - 1}) div {num + den})"
    return F.expr(
        f"{den}L * least({n}, {m}) >= {num}L * greatest({n}, {m})"
        f" and {n} - {i} >= {overlap} and {m} - {j} >= {overlap}"
        f" and {i} + {j} <= {n} + {m} - 2 * {overlap}"
    )


def parities(entries: DataFrame) -> DataFrame:
    """(set, n, bits), one row per set."""
    carried = entries.where("bits is not null").groupBy("set").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    return staged(carried, "ngram-bits")


def _may_overlap(num: int, den: int, x: str, n: str, y: str, m: str) -> Column:
    """Parity bound of two sets of sizes n and m."""
    differ = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(PARITY))
    return F.expr(f"{differ} <= {n} + {m} - 2 * (({num}L * ({n} + {m}) + {num + den - 1}) div {num + den})")


def leader_pairs(lists: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): leaders of lists and the sets that may link with them, each two sets once."""
    rank = F.expr("pos * 4294967296L + n")
    first = lists.groupBy("token").agg(F.min(rank).alias("_r"))
    led = (
        lists.join(first, "token").where(rank == F.col("_r"))
        .groupBy("token").agg(F.min("set").alias("_s"), F.min("_r").alias("_r"))
        .select("token", "_s", F.expr("_r div 4294967296L").cast("int").alias("_i"), F.expr("_r % 4294967296L").cast("int").alias("_n"))
    )
    pairs = lists.join(led, "token").where((F.col("set") != F.col("_s")) & _may_link(num, den, "pos", "n", "_i", "_n"))
    pairs = pairs.select(F.col("_s").alias("a"), F.col("set").alias("b")).distinct()
    left = bits.select(F.col("set").alias("a"), F.col("n").alias("_na"), F.col("bits").alias("_x"))
    right = bits.select(F.col("set").alias("b"), F.col("n").alias("_nb"), F.col("bits").alias("_y"))
    near = pairs.join(left, "a").join(right, "b").where(_may_overlap(num, den, "_x", "_na", "_y", "_nb"))
    near = staged(near.select("a", "b"), "ngram-led")
    # Two sets may lead each other in different lists: the one that leads more stays.
    weight = near.groupBy("a").agg(F.struct(F.count("*"), F.col("a")).alias("_w"))
    weight = weight.select(F.struct("a").alias("_key"), "_w")
    weighed = near.withColumn("_key", F.struct("a")).join(weight, "_key")
    both = weighed.groupBy(F.greatest("a", "b").alias("_hi"), F.least("a", "b").alias("_lo"))
    return both.agg(F.max("_w").alias("_w")).select(
        F.col("_w.a").alias("a"), F.when(F.col("_w.a") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_hi")).alias("b")
    )


def whole_sets(docs: DataFrame, entries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(set, items) of the sets in ``asked`` (column set), and of some others.

    Texts are read again where they lie; only sets leave their task.  A set may come more
    than once, where its document is repeated.
    """
    places = entries.groupBy("set").agg(F.min("bit").alias("bit")).join(asked, "set")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(places.select("bit")))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(_in_bitmap(bitmap.value, batch.column(0).to_numpy())))
            hashes, sets = [], []
            for own in _sets(batch.column(1), k):
                h = xxhash.xxh3_64_intdigest(own.tobytes())
                if h not in seen:
                    seen.add(h)
                    hashes.append(h)
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [_signed(np.array(hashes, dtype=np.uint64)), pa.array(sets, pa.list_(pa.int64()))], ["set", "items"]
            )

    read = docs.select(_bit("doc_id").alias("bit"), "text")
    return staged(read.mapInArrow(per_task, "set long, items array<long>"), "ngram-sets")


def differences(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b, na, nb, delta): what each set b has other than set a, sorted by hash.

    Each b travels to its a's; each a comes once for SPREAD of its b's, so a set that many
    are compared with is neither copied per pair nor left to one task.  Sets that come
    more than once give equal rows once.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("_salts"))
    # As a struct the key is dealt anew, so that a leader of many is split, see functions.skew.
    keyed = salts.select(F.struct("a").alias("_key"), "_salts")
    salted = pairs.select("a", "b", F.struct("a").alias("_key")).join(keyed, "_key")
    salted = salted.select("a", "b", F.pmod(F.xxhash64("b"), "_salts").cast("int").alias("_salt"))
    others = salted.join(whole.select(F.col("set").alias("b"), "items"), "b")
    leads = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    leads = leads.join(whole.select(F.col("set").alias("a"), "items"), "a")
    both = leads.select("a", "_salt", F.lit(True).alias("lead"), F.col("a").alias("b"), "items").unionByName(
        others.select("a", "_salt", F.lit(False).alias("lead"), "b", "items")
    )
    sorted_ = both.repartition("a", "_salt").sortWithinPartitions("a", "_salt", F.desc("lead"), "b")

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine, last = None, np.zeros(0, np.uint64), None
        for batch in batches:
            values, offsets = flat(batch.column("items"))
            values = values.view(np.uint64)
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "_salt", "lead", "b")), strict=True)
            out: list[tuple] = []
            deltas: list[np.ndarray] = []
            for i, (a, salt, is_lead, b) in enumerate(rows):
                own = values[offsets[i] : offsets[i + 1]]
                if is_lead:
                    group, mine, last = (a, salt), own.copy(), None
                elif group == (a, salt) and b != last:
                    last = b
                    out.append((a, b, len(mine), len(own)))
                    deltas.append(np.setxor1d(mine, own, assume_unique=True).view(np.int64))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(deltas, pa.list_(pa.int64()))], ["a", "b", "na", "nb", "delta"]
            )

    return sorted_.mapInArrow(per_task, "a long, b long, na int, nb int, delta array<long>")


def _is_link(num: int, den: int, differ: str = "size(delta)", n: str = "na", m: str = "nb") -> Column:
    """den * shared >= num * union, with shared = (n + m - differ) / 2."""
    return F.expr(f"{den}L * ({n} + {m} - {differ}) >= {num}L * ({n} + {m} + {differ})")


def families(near: DataFrame) -> DataFrame:
    """(set, root, n, delta): each set that has a leader of its own kind, and those leaders.

    Of the leaders that a set links with it takes the one with most links; a leader that
    would itself follow another is none.  Roots are in their family with no difference.
    """
    weight = near.groupBy("a").agg(F.struct(F.count("*"), F.col("a")).alias("_w"))
    ranked = near.join(weight, "a")
    follows = ranked.join(weight.select(F.col("a").alias("b"), F.col("_w").alias("_own")), "b", "left")
    beaten = follows.where(F.col("_own").isNotNull() & (F.col("_w") > F.col("_own"))).select(F.col("b").alias("a")).distinct()
    led = ranked.join(beaten, "a", "left_anti")
    roots = led.select(F.col("a").alias("b")).distinct()
    best = led.join(roots, "b", "left_anti").groupBy("b").agg(F.max_by(F.struct("a", "nb", "delta"), "_w").alias("x"))
    members = best.select(F.col("b").alias("set"), F.col("x.a").alias("root"), F.col("x.nb").alias("n"), F.col("x.delta").alias("delta"))
    own = near.groupBy("a").agg(F.first("na").alias("n"))
    own = own.join(members.select(F.col("root").alias("a")).distinct(), "a", "left_semi")
    return members.unionByName(own.select(F.col("a").alias("set"), F.col("a").alias("root"), "n", F.array().cast("array<long>").alias("delta")))


def _shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``x`` shares with each of ``y``."""
    out = np.zeros((len(x), len(y)), np.float64)
    sides = []
    for sets in (x, y):
        who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        sides.append((np.concatenate([np.zeros(0, np.int64), *sets]), who))
    common = np.intersect1d(sides[0][0], sides[1][0])
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]
        grids = []
        for (values, who), sets in zip(sides, (x, y), strict=True):
            place = np.searchsorted(part, values)
            hit = (place < len(part)) & (part[np.minimum(place, len(part) - 1)] == values)
            grid = np.zeros((len(sets), len(part)), np.float32)
            grid[who[hit], place[hit]] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T  # whole numbers below 2**24: exact
    return out


def family_links(members: DataFrame, copies: DataFrame, num: int, den: int) -> DataFrame:
    """(set, links): rows of other sets of its family that each set links with.

    Families are cut in blocks of about BLOCK sets; each two blocks meet in one group, so
    a large family is spread over tasks and no pair is written down.
    """
    rows = members.join(copies, "set")
    size = rows.groupBy("root").agg(F.count("*").alias("_m")).where("_m > 1")
    size = size.select(F.struct("root").alias("_key"), F.ceil(F.col("_m") / BLOCK).cast("int").alias("_blocks"))
    rows = rows.withColumn("_key", F.struct("root")).join(size, "_key").drop("_key")
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("set"), "_blocks").cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = rows.select(
        "root", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), "_block", "set", "n", "delta", "copies"
    )

    def counted(key: tuple, group: pa.Table) -> pa.Table:
        sides = [group.filter(pc.equal(group["_block"], key[i])) for i in (1, 2)]
        deltas, sizes, copies_of = [], [], []
        for side in sides:
            values, offsets = flat(side["delta"])
            deltas.append([values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            sizes.append(side["n"].to_numpy().astype(np.int64))
            copies_of.append(side["copies"].to_numpy())
        shared = _shared_counts(*deltas)
        lengths = [np.array([len(d) for d in ds], np.int64) for ds in deltas]
        differ = lengths[0][:, None] + lengths[1][None, :] - 2 * shared.astype(np.int64)
        both = sizes[0][:, None] + sizes[1][None, :]
        link = den * (both - differ) >= num * (both + differ)
        same = key[1] == key[2]
        if same:
            np.fill_diagonal(link, False)
        out = [(sides[0]["set"], link @ copies_of[1])] + ([] if same else [(sides[1]["set"], copies_of[0] @ link)])
        sets = pa.chunked_array([c for s, _ in out for c in s.chunks], pa.int64())
        return pa.table({"set": sets, "links": np.concatenate([n for _, n in out])})

    found = met.groupBy("root", "_i", "_j").applyInArrow(counted, "set long, links long")
    return found.groupBy("set").agg(F.sum("links").alias("links"))


def cross_pairs(lists: DataFrame, bits: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, ra, rb): pairs of sets of different families that a list and all bounds allow."""
    known = members.select("set", "root")
    marked = staged(lists.join(known, "set", "left").withColumn("root", F.coalesce("root", "set")), "ngram-marked")
    several = marked.groupBy("token").agg(F.min("root").alias("_a"), F.max("root").alias("_z")).where("_a <> _z").select("token")
    still = staged(marked.join(several, "token", "left_semi").join(bits.select("set", "bits"), "set"), "ngram-open")
    one = still.select("token", "pos", "n", "set", "root", "bits")
    other = still.select(
        "token", F.col("pos").alias("_i"), F.col("n").alias("_n"), F.col("set").alias("_s"), F.col("root").alias("_root"),
        F.col("bits").alias("_y"),
    )
    pairs = one.join(other, "token").where(
        (F.col("set") > F.col("_s")) & (F.col("root") != F.col("_root"))
        & _may_link(num, den, "pos", "n", "_i", "_n")
        & _may_overlap(num, den, "bits", "n", "_y", "_n")
    )
    return pairs.select(F.col("set").alias("a"), F.col("_s").alias("b"), F.col("root").alias("ra"), F.col("_root").alias("rb")).distinct()


def cross_links(pairs: DataFrame, members: DataFrame, docs: DataFrame, entries: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of different families that link.

    a and b differ in the symmetric difference of three: of their roots, of a from its
    root, of b from its root.  The first is worked out once for two families; what is not
    in a family is its own root and has none of the others.
    """
    ordered = pairs.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
    between = staged(ordered, "ngram-roots")
    asked = between.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    base = differences(between, whole_sets(docs, entries, asked, k))
    base = base.select(F.col("a").alias("_p"), F.col("b").alias("_q"), F.col("delta").alias("_base"))
    sizes = entries.where("prefix is not null").groupBy("set").agg(F.first("n").alias("n"))
    own = members.select("set", "delta")
    rows = pairs
    for side in ("a", "b"):
        rows = rows.join(sizes.select(F.col("set").alias(side), F.col("n").alias(f"n{side}")), side)
        rows = rows.join(own.select(F.col("set").alias(side), F.col("delta").alias(f"_{side}")), side, "left")
    rows = rows.join(base, (F.greatest("ra", "rb") == F.col("_p")) & (F.least("ra", "rb") == F.col("_q")))

    @F.arrow_udf("int")
    def differ(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        lists = [flat(c) for c in (x, y, z)]
        out = []
        for i in range(len(x)):
            a, b, c = (v[o[i] : o[i + 1]] for v, o in lists)
            out.append(len(np.setxor1d(np.setxor1d(a, b, assume_unique=True), c, assume_unique=True)))
        return pa.array(out, pa.int32())

    return rows.withColumn("_d", differ("_base", "_a", "_b")).where(_is_link(num, den, "_d")).select("a", "b")


def join_documents(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, counted: bool = True) -> DataFrame:
    """doc_id, crc (crc32 of the text), n_shingles, group, component_id and n_links of each row.

    Words are runs of other than ASCII white space, A-Z lowered; a text of fewer than k
    words is one shingle of all of them.  Two rows link when den * |x and y| >=
    num * |x or y|; component_id is the smallest doc_id reachable by links, group a
    number that the rows of a component share, n_links the number of other rows that a
    row links with, copies included.  Null and empty texts have no shingle and link with
    nothing: their component is their own id.  Null ids are never the smallest.  Repeated
    rows are in one component.  An empty table gives no rows.  Ids are of any type that
    can be compared; other columns aren't read.  Without ``counted`` links inside a
    family are not counted and n_links is left out.
    """
    entries = index_entries(docs, k, num, den)
    lists = index_lists(entries, num, den)
    bits = parities(entries)
    tried = staged(leader_pairs(lists, bits, num, den), "ngram-pairs")
    asked = tried.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    near = differences(tried, whole_sets(docs, entries, asked, k)).where(_is_link(num, den))
    near = staged(near, "ngram-near")
    members = staged(families(near), "ngram-families")
    open_ = staged(cross_pairs(lists, bits, members, num, den), "ngram-open-pairs")
    across = staged(cross_links(open_, members, docs, entries, k, num, den), "ngram-across")
    edges = near.select("a", "b").unionByName(across)
    roots = staged(components(edges), "ngram-roots")
    nodes = entries.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("_least"), F.count("*").alias("copies"))
    nodes = staged(nodes, "ngram-nodes")
    grouped = nodes.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("group", F.coalesce("root", "set"))
    least = grouped.groupBy("group").agg(F.min("_least").alias("component_id"))
    found = grouped.join(least, "group").select("set", "group", "component_id", "copies")
    columns = ["doc_id", "crc", "n_shingles", "group", "component_id"]
    if counted:
        weights = nodes.select("set", "copies")
        both = across.select("a", "b").unionByName(across.select(F.col("b").alias("a"), F.col("a").alias("b")))
        outside = both.join(weights.withColumnRenamed("set", "b"), "b").groupBy("a").agg(F.sum("copies").alias("links"))
        links = family_links(members, weights, num, den).unionByName(outside.select(F.col("a").alias("set"), "links"))
        links = links.groupBy("set").agg(F.sum("links").alias("links"))
        found = found.join(links, "set", "left")
        columns.append("n_links")
        found = found.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    own = entries.select("doc_id", "crc", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set")).alias("set"))
    rows = own.join(found, "set", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    )
    if counted:
        rows = rows.withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return rows.select(*columns)


def one_of_each_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, whole, less all but the smallest id of each component.

    Rows without an id, and without a word, all stay.  Of repeated rows one stays.
    """
    joined = join_documents(docs, k, num, den, counted=False).where("doc_id is not null and group is not null")
    kept = joined.groupBy("group").agg(F.min(F.struct("doc_id", "crc")).alias("k")).select("k.doc_id", "k.crc")
    crc = F.crc32(F.encode(text_or_empty(), "UTF-8"))
    free = F.col("doc_id").isNull() | ~F.regexp_like(text_or_empty(), F.lit(WORD))
    rows = docs.where(~free).select(F.struct(*docs.columns).alias("row"), "doc_id", crc.alias("crc"))
    first = Window.partitionBy("doc_id", "crc").orderBy(F.lit(1))
    stay = rows.join(kept, ["doc_id", "crc"]).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return stay.select("row.*").unionByName(docs.where(free))
