"""Cross-tokenizer alignment against whole-text tokenisation and plain counting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heliograph.llm import alignment, token_ids
from heliograph.llm.queries import QUERIES

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """(groups, links) of a text by whole tokenisation; None without tokens."""
    a_tok, b_tok = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_tok.encode_special_tokens = True
    symbols = token_ids.byte_symbols()
    b_bytes = alignment.piece_bytes(b_tok)

    def ends(ids, spell):
        at, out = 0, []
        for i in ids:
            at += len(spell(i))
            out.append(at)
        return out

    def told(text):
        if not text:
            return None
        a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
        of_a = lambda i: bytes(symbols[c] for c in a_tok.id_to_token(i))
        if not b"".join(map(of_a, a)) == (" " + text).encode() == b"".join(b_bytes[i] for i in b):
            return None
        ends_a, ends_b = ends(a, of_a), ends(b, b_bytes.__getitem__)
        at_a, at_b = ({e: i for i, e in enumerate(x)} for x in (ends_a, ends_b))
        groups, links, i, j = [], [], 0, 0
        for e in ends_a:
            if e in at_b:
                k, m = at_a[e] + 1, at_b[e] + 1
                groups.append((a[i:k], b[j:m]))
                links.append((a[k - 1], b[m - 1]))
                i, j = k, m
        return a, b, groups, links

    return told


def expected(texts: list, plain) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, digest of each text."""
    found = [plain(t) for t in texts]
    counts = Counter(x for f in found if f for x in f[3])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_against_plain_counting(spark, data, documents, plain):
    rows = documents.orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_alignment"](spark, data).collect()}
    assert got == dict(zip([r.doc_id for r in rows], expected([r.text for r in rows], plain), strict=True))


@pytest.fixture(scope="module")
def own():
    with open(PIECES, "rb") as file:
        return alignment.aligner({"name": "test", "a": token_ids.pack_vocabulary(BPE), "b": file.read()})


PARTS = [" ", "  ", "\n", "\n\n", "\t", "the", " of", "é", "😀", "▁", "\x00", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "12", "don't", "'s", " ", "　", "\r", "ßü", "x" * 60, ".", ",", "日本", "\x85", "a", "B"]


def test_random_texts_by_themselves(own, plain):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 14))) for _ in range(2000)]
    for text, got in zip(texts, own.aligned(texts), strict=True):
        want = plain(text)
        if want is None:
            assert got[:5] == (0, 0, 0, 0, ""), repr(text)
            continue
        a, b, groups, links = want
        told = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        assert got[:5] == (len(a), len(b), len(groups), len(links), hashlib.sha256(told.encode()).hexdigest()), repr(text)
        pairs = np.repeat(np.frombuffer(got[5], dtype="<i8"), np.frombuffer(got[6], dtype="<u4"))
        assert pairs.tolist() == sorted(x << alignment.B_BITS | y for x, y in links)


def test_a_small_memory_changes_nothing(own):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    small = alignment.Aligner(own.encode_a, own.pieces, *own.bytes, remember=4)
    assert [small.aligned([t])[0] for t in texts] == own.aligned(texts)


def test_counts_in_many_blocks(spark, documents):
    rows = alignment.aligned(documents.limit(60), BPE, PIECES).persist()
    counts = alignment.pair_counts(rows)
    told = lambda n: sorted(map(tuple, alignment.with_counts(rows, counts, n).collect()))
    assert told(500) == told(10**6)
    rows.unpersist()


def test_odd_rows(spark, odd, nothing, plain):
    got = alignment.align_tokenizers(odd, BPE, PIECES).select("doc_id", *COLUMNS).collect()
    rows = odd.select("doc_id", "text").collect()
    want = [(r.doc_id, *w) for r, w in zip(rows, expected([r.text for r in rows], plain), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert alignment.align_tokenizers(nothing, BPE, PIECES).count() == 0
    marked = odd.where("doc_id = 9").withColumn("text", F.concat("text", F.lit("▁")))
    assert [tuple(r[c] for c in COLUMNS) for r in alignment.align_tokenizers(marked, BPE, PIECES).collect()] == [(0, 0, 0, 0, 0, 0, "")]
