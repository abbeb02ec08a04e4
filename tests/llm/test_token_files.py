import zlib

import fixtures
import numpy as np
import public_tokenizers
import pytest
from ledgerloom.llm import id_coder, token_files
from ledgerloom.llm.common import shared_folder
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def stepwise(ids: list[int]) -> list[tuple[int, int, str]]:
    """The model's three-way choices of one block, written down one id at a time."""
    table, weights = [{}, {}], {}
    one = two_mixed = 0
    out = []
    for x in ids:
        places = [(one * 40503 >> 3) & (id_coder._TABLE - 1), (one * 40503 + two_mixed >> 3) & (id_coder._TABLE - 1)]
        (id1, s1), (id2, s2) = (t.get(p, (id_coder._NONE, 0)) for t, p in zip(table, places, strict=True))
        w = weights.setdefault((s1, s2, id1 == id2), list(id_coder._WEIGHTS))
        order = 0 if x == id2 else 1 if x == id1 else 2
        out.append((w[order], sum(w), order))
        if sum(w) > id_coder._LIMIT - id_coder._STEP:
            w[order] += id_coder._STEP
            w[:] = [(v + 1) >> 1 for v in w]
        else:
            w[order] += id_coder._STEP
        for t, p, k, s in ((table[0], places[0], id1, s1), (table[1], places[1], id2, s2)):
            t[p] = (k, min(s + 1, 3)) if k == x else (k, 1) if s > 1 else (x, 1)
        two_mixed, one = one * 60493, x
    return out


def test_the_model_against_one_id_at_a_time(monkeypatch):
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.geometric(0.05, 700), 60)
    seen = []
    real = id_coder._Writer.code

    def spy(self, lane, start, freq, total):
        if isinstance(lane, slice):
            seen.append((int(freq[0]), int(total[0])))
        real(self, lane, start, freq, total)

    monkeypatch.setattr(id_coder._Writer, "code", spy)
    id_coder.encode(ids, 1000, 100)
    assert seen == [(f, t) for f, t, _ in stepwise(ids.tolist())]


@pytest.mark.parametrize("vocabulary", [1, 2, 17, 300, 49_408, 65_535])
@pytest.mark.parametrize("n", [0, 1, 2, 255, 4000])
def test_round_trip(vocabulary, n):
    rng = np.random.default_rng(n + vocabulary)
    for ids in (rng.integers(0, vocabulary, n), np.full(n, vocabulary - 1), np.minimum(rng.geometric(0.1, n), vocabulary - 1)):
        blocks = id_coder.encode(ids, 256, vocabulary)
        assert sum(b[0] for b in blocks) == n
        assert np.array_equal(id_coder.decode(blocks, vocabulary), ids)


def test_blocks_are_independent_and_checked():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 5000), 1999)
    blocks = id_coder.encode(ids, 512, 2000)
    for i in (0, 3, 9):
        assert np.array_equal(id_coder.decode([blocks[i]], 2000), ids[512 * i : 512 * i + 512])
    back = id_coder.decode(blocks[::-1], 2000)
    assert np.array_equal(back[: len(ids) - 9 * 512], ids[9 * 512 :])
    for at in range(0, len(blocks[2][2]), 37):
        payload = bytearray(blocks[2][2])
        payload[at] ^= 0x41
        damaged = (*blocks[2][:2], bytes(payload))
        with pytest.raises(id_coder.CorruptBlock):
            id_coder.decode([blocks[0], damaged], 2000)
    with pytest.raises(id_coder.CorruptBlock):
        id_coder.decode([(*blocks[2][:2], b"")], 2000)


def test_the_predictions_help():
    rng = np.random.default_rng(4)
    phrase = rng.integers(0, 49_408, 40)
    sizes = {}
    for name, ids in (("random", rng.integers(0, 49_408, 4000)), ("few", rng.choice(phrase, 4000)), ("again", np.tile(phrase, 100))):
        sizes[name] = sum(len(p) for _, _, p in id_coder.encode(ids, 4000, 49_408)) * 8 / 4000
    assert sizes["again"] < 1 < sizes["few"] < 8 < 15 < sizes["random"] < 18


def test_ids_are_limited():
    for bad in ([-1], [100], [70_000]):
        with pytest.raises(ValueError):
            id_coder.encode(np.array(bad), 256, 100)
    with pytest.raises(ValueError):
        id_coder.encode(np.array([1]), 256, 70_000)


def test_documents_read_back_from_the_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME", 1 << 12)
    rows = fixtures.odd_texts()
    docs = fixtures.documents(spark, rows).repartition(3)
    folder = shared_folder(spark, "test-ids")
    token_files.write(docs, folder, PATH)
    got = token_files.read(spark, folder, with_ids=True).orderBy("start").collect()
    whole = Tokenizer.from_file(PATH)
    expected = [(d, whole.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(expected, key=key)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += len(r.ids)
    small = token_files.read(spark, folder)
    assert small.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and small.count() == len(rows)


def test_frames_are_checked():
    ids = np.arange(600) % 50
    frame = token_files.pack([None, 7, -1], [200, 0, 400], ids, 64)
    doc_ids, lengths, back = token_files.unpack(frame)
    assert (doc_ids, lengths.tolist()) == ([None, 7, -1], [200, 0, 400]) and np.array_equal(back, ids)
    for at in (0, 5, 30, 45, 80, len(frame) - 9):
        damaged = bytearray(frame)
        damaged[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unpack(bytes(damaged))


def test_empty_table(spark):
    folder = shared_folder(spark, "test-ids")
    token_files.write(fixtures.documents(spark, []), folder, PATH)
    assert token_files.read(spark, folder).count() == 0
