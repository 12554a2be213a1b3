import io
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recordwarden.llm import packing, planes, queries, shards, tokens
from recordwarden.llm.tokens import TokenEncoder

from .helpers import ODD_TEXTS, TABLES, empty_documents, odd_documents, read, rows_of

END = (2).to_bytes(4, "little")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    return lambda text: np.array(
        tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def encoder():
    return TokenEncoder(queries.vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x00\x1c\x85  ab'sS1!.é"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_pieces_give_the_ids_of_the_whole_text(texts):
    encoder = TokenEncoder.__new__(TokenEncoder)
    encoder.__dict__.update(_SHARED.__dict__)
    whole = encoder._tokenizer.encode_batch(texts, add_special_tokens=False)
    assert list(encoder.encode_all(texts)) == [np.array(e.ids, dtype="<u4").tobytes() for e in whole]


_SHARED = TokenEncoder(queries.vocabulary())


def test_all_documents_encode_as_wholes(plain, encoder, monkeypatch):
    texts = read("documents").text.tolist() + [t for _, t in ODD_TEXTS]
    want = [plain(t) for t in texts]
    assert [ids + END for ids in encoder.encode_all(texts)] == want
    monkeypatch.setattr(tokens, "TOGETHER", 700)  # portions within texts
    assert [ids + END for ids in encoder.encode_all(texts)] == want


def test_added_tokens_keep_their_id(plain, encoder):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y z", "<|endoftext| >", "end<|endoftext|>", "<|endoftext|>\n<|endoftext|>"]
    assert [ids + END for ids in encoder.encode_all(texts)] == [plain(t) for t in texts]
    assert np.frombuffer(next(encoder.encode_all(texts)), "<u4").tolist() == [50256]


def test_every_character_between_words(plain, encoder):
    """Letters, digits and signs of all alphabets, alone, inside a word and after one."""
    shown = [c for c in map(chr, range(0x21, 0x20000)) if not c.isspace() and not 0xD800 <= ord(c) < 0xE000]
    texts = [" ".join(f"{c} a{c}b {c}c a{c}" for c in shown[i:i + 500]) for i in range(0, len(shown), 500)]
    assert [ids + END for ids in encoder.encode_all(texts)] == [plain(t) for t in texts]


# --- packing -------------------------------------------------------------------

def check_packing(found, texts, plain, capacity):
    """Pieces rebuild their documents, and sequences have no gap and no overlap."""
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts:
        ids, at = plain(text), 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(ids[4 * at:4 * (at + r.length)])
            assert r.length == capacity or k == 0
            at += r.length
        assert 4 * at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def first_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= n), None)
        if k is None:
            room.append(capacity - n)
        else:
            room[k] -= n
    return len(room)


def test_packing_query(spark, plain):
    docs = read("documents")
    found = queries.op3_best_fit_packing(spark, TABLES).collect()
    sequences = check_packing(found, zip(docs.doc_id, docs.text), plain, 1024)
    assert sequences <= first_fit_decreasing([r.length for r in found], 1024)
    assert sequences <= 1.02 * sum(r.length for r in found) / 1024


def test_packing_odd_rows(spark, plain):
    found = packing.pack(odd_documents(spark), queries.vocabulary(), capacity=16).collect()
    assert sum(r.length for r in found) == sum(len(plain(t)) // 4 for _, t in ODD_TEXTS)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= 16
    assert packing.pack(empty_documents(spark), queries.vocabulary()).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 6), min_size=1, max_size=8))
def test_fullest_combination_is_the_best_with_the_longest_piece(counts):
    used = packing.fullest(counts, 20)
    longest = max(counts)
    sums = {longest}
    for n, c in counts.items():
        for _ in range(c - (n == longest)):
            sums |= {s + n for s in sums if s + n <= 20}
    assert sum(n * k for n, k in used.items()) == max(sums)
    assert used[longest] >= 1 and all(k <= counts[n] for n, k in used.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 2000), max_size=20))
def test_patterns_place_every_piece(counts):
    slots, sequences = packing.pack_lengths(counts, 50)
    fill = {}
    for n, held in slots.items():
        ends = [s.first for s in held[1:]] + [counts[n]]
        for s, end in zip(held, ends):
            for rank in range(s.first, end):
                turn, place = divmod(rank - s.first, s.each)
                fill.setdefault(s.sequence + turn, []).append((s.offset + place * n, n))
    assert sum(map(len, fill.values())) == sum(counts.values())
    assert set(fill) == set(range(sequences))
    for held in fill.values():
        held.sort()
        assert [o for o, _ in held] == list(np.cumsum([0] + [n for _, n in held])[:-1])
        assert sum(n for _, n in held) <= 50


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


# --- planes --------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=8), st.sampled_from(["byte", "bit"]))
def test_file_round_trip(docs, kind):
    sink = io.BytesIO()
    writer = planes.PlaneWriter(sink, kind, block=16)
    want = [(None if k == 2 else -k, np.array(ids, dtype="<u4").tobytes()) for k, ids in enumerate(docs)]
    for doc_id, ids in want:
        writer.add(doc_id, ids)
    assert writer.close() == (len(docs), sum(map(len, docs)))
    assert list(planes.PlaneFile(sink.getvalue()).documents()) == want


@pytest.mark.parametrize("kind, file_ids", [("byte", 1 << 26), ("bit", 1 << 26), ("byte", 3000)])
def test_token_files(spark, plain, kind, file_ids):
    docs = read("documents").sort_values("doc_id")
    want, start = [], 0
    for doc_id, text in zip(docs.doc_id.tolist(), docs.text):
        ids = plain(text)
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    source = queries.documents(spark, TABLES).repartition(5)
    found = planes.token_file_index(source, queries.vocabulary(), kind, block=1000, file_ids=file_ids)
    assert rows_of(found, "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_token_file_odd_rows(spark, plain):
    found = planes.token_file_index(odd_documents(spark), queries.vocabulary()).collect()
    assert sorted(r.ids_crc32 for r in found) == sorted(zlib.crc32(plain(t)) for _, t in ODD_TEXTS)
    assert sorted(r.start for r in found) == np.cumsum([0] + [r.n_tokens for r in sorted(found, key=lambda r: r.start)])[:-1].tolist()
    starts = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(found, key=lambda r: r.start)]
    assert starts == sorted(starts)
    assert planes.token_file_index(empty_documents(spark), queries.vocabulary()).collect() == []


def test_a_broken_file_is_refused():
    with pytest.raises(ValueError):
        planes.PlaneFile(b"x" * 200)


# --- shards ----------------------------------------------------------------------

def plain_jump(key, shards):
    key %= 2**64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63, 500)
    for n in (1, 2, 40, 41, 1000):
        assert shards.jump_shards(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_shard_query(spark):
    docs = read("documents").set_index("doc_id")
    found = queries.op7_jump_shards(spark, TABLES).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs.index)
    slots = {}
    for r in found:
        body = docs.text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 16, zlib.crc32(body), "key")
        key = xxhash.xxh64(r.doc_id.to_bytes(8, "little"), seed=42).intdigest()
        assert (r.shard, r.grown_shard) == (plain_jump(key, 40), plain_jump(key, 41))
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))


def test_shard_odd_rows(spark):
    found = shards.assign_shards(odd_documents(spark), 4, section_rows=1).collect()
    assert len(found) == len(ODD_TEXTS)
    slots, of = {}, {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
        of.setdefault(r.doc_id, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())
    assert [r.size for r in found if r.doc_id == 2] == [16]
    assert shards.assign_shards(empty_documents(spark)).collect() == []


def test_one_id_on_a_third_of_all_rows(spark):
    rows = [(7 if i % 3 == 0 else i, f"text {i}") for i in range(6000)] + [(7, "same")] * 5
    found = shards.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 3, section_rows=4).collect()
    assert len(found) == len(rows) and len({r.shard for r in found if r.doc_id == 7}) == 1
    for shard in range(3):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))
    # The rows of the hot id are spread over the shard, so many sections count them.
    hot = [r.slot for r in found if r.doc_id == 7]
    assert max(hot) - min(hot) > 1.2 * len(hot)
