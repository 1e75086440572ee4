"""Token counts, training order and packing against the tokenizers library."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from heliograph.llm import binary_output, packing, token_count
from heliograph.llm.queries import QUERIES

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bpe():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def unigram():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocabulary = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    t = Tokenizer(Unigram(vocabulary, unk_id=0, byte_fallback=True))
    return lambda text: len(t.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


def test_counts_equal_the_unigram_tokenizer(spark, data, documents, unigram):
    got = {r.doc_id: r.n_tokens for r in QUERIES["op1_token_counts"](spark, data).collect()}
    for r in documents.collect():
        assert got[r.doc_id] == unigram(r.text or ""), r.doc_id


def test_counts_of_odd_texts(unigram):
    counter = token_count.UnigramCounter(*token_count.read_pieces(PIECES))
    rng = random.Random(3)
    letters = "abcdefghij  \n\té☃😀▁.,"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
        assert counter.count(text) == unigram(text), repr(text)


def test_ties_follow_the_library():
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("ba", -2.0), ("c", -1.0), ("abc", -3.0)]
    own = token_count.UnigramCounter(pieces, -3.0)
    theirs = Tokenizer(Unigram([("<unk>", -3.0), *pieces], unk_id=0, byte_fallback=False))
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        assert own.best(text)[1] == len(theirs.encode(text).ids), text


def test_feistel_is_a_permutation():
    for total in (1, 2, 3, 5, 64, 1000, 4097):
        half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
        keys = [11, 222, 3333, 44444, 5, 6]
        got = binary_output.permute(np.arange(total, dtype=np.uint64), total, half, keys)
        assert sorted(got.tolist()) == list(range(total))


def test_training_order_round_trip(spark, documents, bpe):
    ledger, shards = binary_output.materialise(documents, BPE, length=100, per_shard=16)
    slots = {r.slot: (r.doc_id, r.seq_no) for r in ledger.collect()}
    assert sorted(slots) == list(range(len(slots)))
    size = binary_output.stride(100)
    found = defaultdict(dict)
    for s in shards.collect():
        assert len(s.payload) == s.n_slots * size and s.first_slot == 16 * s.shard
        for i in range(s.n_slots):
            one = s.payload[i * size : (i + 1) * size]
            n = int.from_bytes(one[:4], "little")
            doc, k = slots[s.first_slot + i]
            found[doc][k] = np.frombuffer(one[4 : 4 + 2 * n], dtype="<u2").tolist()
            assert not any(one[4 + 2 * n :])
    for r in documents.collect():
        assert [x for k in sorted(found[r.doc_id]) for x in found[r.doc_id][k]] == bpe(r.text or "") + [1]
    assert sorted(r.slot for r in binary_output.read_range(shards, 13, 40, 100).collect()) == list(range(13, 40))
    order = [slots[s] for s in sorted(slots)]
    assert order != sorted(order)


def test_training_order_query_against_brute_force(spark, data, documents, bpe):
    rows = QUERIES["op4_training_order"](spark, data).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    got, want = {(r.doc_id, r.seq_no): r for r in rows}, {}
    for d in documents.collect():
        ids = bpe(d.text or "") + [1]
        for n, at in enumerate(range(0, len(ids), 2048)):
            want[d.doc_id, n] = np.array(ids[at : at + 2048], dtype="<u2")
    assert set(got) == set(want) and len(got) == len(rows)
    for place, ids in want.items():
        r = got[place]
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        assert (r.shard, r.byte_offset) == (r.slot // 512, r.slot % 512 * 4100)


def test_shards_stay_at_a_given_path(spark, documents, tmp_path):
    at = str(tmp_path / "shards")
    _, shards = binary_output.materialise(documents.limit(20), BPE, length=100, per_shard=8, path=at)
    assert binary_output.read_slots(spark.read.parquet(at), 100).count() == shards.agg({"n_slots": "sum"}).head()[0] > 0


def check_packing(rows, texts, bpe):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = bpe(texts[doc] or "") + [1], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing_is_whole_and_without_padding(spark, data, documents, bpe):
    rows = QUERIES["op5_packing"](spark, data).collect()
    assert check_packing(rows, {r.doc_id: r.text for r in documents.collect()}, bpe) == 0


def test_plan_covers_each_tail_once():
    rng = np.random.default_rng(1)
    for top in (1, 5, 400):
        histogram = rng.integers(0, top + 1, 128)
        histogram[0] = 0
        combos, stream, n, length = packing.plan(histogram, 128, 500)
        for v in range(1, 128):
            spans = sorted((r.lo, r.hi) for r in combos[combos["len"] == v].itertuples())
            tail = stream[stream["len"] == v]
            covered = spans[-1][1] if spans else 0
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and (not spans or spans[0][0] == 0)
            assert (len(tail) == 1 and tail.iloc[0].lo == covered) if covered < histogram[v] else covered == histogram[v]
        assert length + 128 * n == int((histogram * np.arange(128)).sum())


def test_combinations_fill_the_window_and_few_tails_are_left():
    rng = np.random.default_rng(2)
    have = rng.random(200) < 0.3
    got, g = packing.combinations(have, 10**9)
    assert g == 1 and (got[:, 1] * got[:, 0] + got[:, 2] + got[:, 3] == 200).all() and have[got[:, 0]].all()
    assert all(have[x] or x == 0 for x in got[:, 2:].ravel()) and (got[:, 2] <= got[:, 3]).all()
    lengths = [x for x in range(1, 200) if have[x]]
    want = {(v, m, a, 200 - m * v - a) for v in lengths for m in range(1, 201) for a in [0, *lengths] if a <= 200 - m * v - a and (200 - m * v - a in lengths or 200 - m * v - a == 0)}
    assert set(map(tuple, got.tolist())) == want
    for n, share in ((2_000, 0.7), (200_000, 0.9)):
        tails = np.clip(rng.lognormal(6.3, 0.8, n).astype(int), 1, 2047)
        tails = tails[tails < 2047]
        combos, _, _, _ = packing.plan(np.bincount(tails, minlength=2048))
        assert (combos.hi - combos.lo).sum() >= share * len(tails) and len(combos) < 40_000


def test_odd_rows(spark, odd, nothing, bpe):
    counts = token_count.count_tokens(odd, PIECES).collect()
    assert len(counts) == 12 and sorted(r.n_tokens for r in counts)[:3] == [0, 0, 0]
    packed = packing.pack(odd, BPE).collect()
    assert sum(r.length for r in packed) == sum(len(bpe(r.text or "")) + 1 for r in odd.collect())
    ledger, shards = binary_output.materialise(odd, BPE)
    assert ledger.count() == binary_output.read_slots(shards).count()
    assert packing.pack(nothing, BPE).count() == 0 and token_count.count_tokens(nothing, PIECES).count() == 0
    ledger, shards = binary_output.materialise(nothing, BPE)
    assert ledger.count() == 0 and shards.count() == 0
