"""Collocations against plain counting; SQL is held elsewhere."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from heliograph.llm import collocation
from heliograph.llm.queries import QUERIES


def plain(rows: list[tuple], least: int = 10, top: int = 2000) -> set[tuple]:
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        counts = f.setdefault(lang, Counter())
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            counts.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            if any(100 * b >= 50 * a for q, b in often.items() if len(q) > len(p) and p in (q[:2], q[1:])):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def rows_of(df):
    return {tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_query_against_plain_counting(spark, data, documents):
    got = rows_of(QUERIES["op11_collocations"](spark, data))
    assert got and got == plain([(r.lang, r.text) for r in documents.collect()])


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(8)
    words = ["the", "The", "of", "é", "É", "a", "b", "c", "d", "x y", "no\tway", "end.", "3.5", "a,b", "\x0b", "ß", "　", "q" * 50]
    return [(rng.choice(["en", None, "und", ""]), rng.choice([None, "", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(6))])) for _ in range(400)]


@pytest.mark.parametrize("entries", [50, 10**6])
def test_odd_texts_and_small_memory(spark, odd_texts, entries, monkeypatch):
    frame = spark.createDataFrame(odd_texts, "lang string, text string").repartition(3)
    counts = collocation.phrase_counts(frame, entries=entries, parts=5)
    assert rows_of(collocation.scored(counts)) == plain(odd_texts)


def test_slices_bursts_and_spills_lose_nothing():
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(6000)]
    want = Counter(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    for parts, entries, slice_words, kept, burst in ((7, 300, 64, 90, 4), (1, 10**6, 10**6, 10**6, 16), (3, 2000, 500, 10**6, 8)):
        own = collocation.PhraseCounter(parts, entries, slice_words, kept, burst)
        runs = [r for step in (own.read("en", " ".join(words)), own.count_waiting(), own.spill(0)) for frame in step for r in frame.itertuples(index=False)]
        mergers = {}
        for r in runs:
            mergers.setdefault(r.part, collocation.PartMerger(500)).add(r.words, r.places, r.counts)
        got, total = Counter(), 0
        for m in mergers.values():
            found, n = m.frequent(1)
            total += n
            for size, phrase, count in found:
                assert size == len(phrase.split(" ")) and tuple(phrase.split(" ")) not in got
                got[tuple(phrase.split(" "))] = count
        assert got == want and total == len(words)


def test_runs_are_sorted_and_prefixes_stay_together():
    own = collocation.PhraseCounter(4)
    list(own.read("en", "a b c a b d a b e f g"))
    list(own.count_waiting())
    where = {}
    for frame in own.spill(0):
        for r in frame.itertuples(index=False):
            words = r.words.split(b" ")
            places = [int.from_bytes(r.places[4 * i : 4 * i + 4], "little") for i in range(len(r.places) // 4)]
            n = len(places) // 3
            phrases = [tuple(own.ids.hashes[own.ids[words[places[k * n + i]]]] for k in range(3)) for i in range(n)]
            assert phrases == sorted(phrases)
            for p in phrases:
                assert where.setdefault(p[:2], r.part) == r.part


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", 0, "", 4 * big), ("en", 1, "x", big + 1), ("en", 1, "y", big + 7), ("en", 2, "x y", big)], "lang string, size int, phrase string, n long")
    got = collocation.scored(counts).collect()
    assert [(r.a, r.l, r.r, r.n, r.score) for r in got] == [(big, big + 1, big + 7, 4 * big, 10**6 * big * big // ((big + 1) * (big + 7)))]


def test_ties_go_to_the_smaller_cut_and_bytes(spark):
    counts = spark.createDataFrame([("en", 0, "", 500), *(("en", 1, w, 20) for w in "abcé"), ("en", 2, "a b", 20), ("en", 2, "b c", 20), ("en", 3, "a b c", 20), ("en", 2, "é a", 12), ("en", 2, "c a", 12)], "lang string, size int, phrase string, n long")
    got = [(r.rank, r.phrase, r.l, r.r) for r in collocation.scored(counts).orderBy("rank").collect()]
    assert got == [(1, "a b c", 20, 20), (2, "c a", 20, 20), (3, "é a", 20, 20)]


def test_odd_rows(spark, odd, nothing):
    assert rows_of(collocation.collocations(odd)) == plain([(r.lang, r.text) for r in odd.collect()])
    assert collocation.collocations(nothing).count() == 0
