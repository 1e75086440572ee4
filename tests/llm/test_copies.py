"""SimHash, decontamination, line dedup and the pipeline."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from heliograph.llm import components, decontamination, line_dedup, simhash
from heliograph.llm.queries import QUERIES


def brute_print(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: {doc: fp}; smallest doc reachable over links of at most two bits."""
    names, docs = {}, sorted(prints)
    fps = defaultdict(list)
    for d in docs:
        fps[prints[d]].append(d)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for f, ds in fps.items():
        least[find(f)] = min([least.get(find(f), 1 << 62), *ds])
    for f, ds in fps.items():
        for d in ds:
            names[d] = least[find(f)]
    return names


def test_simhash_query_against_brute_force(spark, data, documents):
    got = {r.doc_id: r for r in QUERIES["op6_simhash"](spark, data).collect()}
    prints = {d.doc_id: brute_print(d.text or "", 3) for d in documents.collect()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: r.component_id for d, r in got.items()} == brute_components(prints)


@pytest.mark.parametrize("bucket", [2, 16])
def test_links_of_crowded_fingerprints(spark, bucket):
    rng = random.Random(7)
    prints = {}
    for c in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randrange(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints[len(prints) * 3 + c] = x
    prints |= {10_000 + i: (1 << i) - 1 for i in range(65)}  # a chain, a bit a step
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(d, signed(p)) for d, p in prints.items()], "doc_id long, fp long")
    named = {r.fp: r.component_id for r in simhash.link(rows, 2, bucket).collect()}
    assert {d: named[signed(p)] for d, p in prints.items()} == brute_components(prints)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 5: 3, 9: 3}


def edited(words, rng, share):
    return [rng.choice(["zumo", "kalt", "vire", "olan"]) if rng.random() < share else w for w in words]


def sentence_words(rng, n):
    return ["".join(rng.choice(["ka", "to", "ri", "mes", "un", "bel"]) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(11)
    rows, groups = [], defaultdict(list)
    for g in range(40):
        words = sentence_words(rng, rng.randrange(60, 400))
        for k in range(4):
            d = len(rows)
            text = " ".join(words if k < 2 else edited(words, rng, 0.008))
            rows.append((d, text))
            groups[g].append(d)
    rows += [(1000 + i, " ".join(sentence_words(rng, n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 8, 20, 50, 300] * 4)]
    rows += [(2000, ""), (2001, " "), (2002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_duplicates(docs).where("keep").collect()}
    words = {d: tuple((t or "").split()) for d, t in rows}

    def shingles(d):
        w = words[d]
        return {w[i : i + 5] for i in range(len(w) - 4)} or {w}

    for ds in groups.values():
        for d in ds:
            for e in ds:
                j = len(shingles(d) & shingles(e)) / len(shingles(d) | shingles(e))
                if d < e and j >= 0.8:
                    assert not {d, e} <= kept
        assert ds[0] in kept
    singles = [d for d, _ in rows if 1000 <= d < 2000]
    first_of = {}
    for d in singles:
        first_of.setdefault(words[d], d)
    assert set(first_of.values()) <= kept
    assert len(kept & {2000, 2001, 2002}) == 1


def test_twins_inside_a_template_family(spark):
    rng = random.Random(23)
    template = sentence_words(rng, 400)
    rows = []
    for g in range(1000):  # twins of Jaccard about 0.96 among relatives of about 0.67
        own = list(template)
        own[4 + 5 * (g % 60) : 44 + 5 * (g % 60)] = [f"{w}{g}" for w in sentence_words(rng, 40)]
        twin = [*own[:-4], "zumo", *own[-3:]]
        rows += [(2 * g, " ".join(own)), (2 * g + 1, " ".join(twin))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_duplicates(docs).where("keep").collect()}
    assert sum({2 * g, 2 * g + 1} <= kept for g in range(1000)) == 0


def test_pairs_at_the_threshold_are_decided_by_their_shingles(spark):
    rng = random.Random(29)
    nodes, likely, want = [], [], set()
    for g in range(200):
        words = sentence_words(rng, 400)
        rows = (words, [*words[: 400 - (34 + g % 20)], *(f"x{g}y{k}" for k in range(34 + g % 20))])
        nodes += [(2 * g + k, " ".join(w)) for k, w in enumerate(rows)]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows)
        likely.append((2 * g, 2 * g + 1))
        if len(a & b) >= 0.8 * len(a | b):
            want.add((2 * g, 2 * g + 1))
    marks = pd.concat(simhash._marks(5, 0.8)(iter([pd.DataFrame({"doc_id": [n for n, _ in nodes], "text_key": [0] * len(nodes), "text": [t for _, t in nodes]})])))
    prints = [np.frombuffer(f, dtype=np.uint8) for f in marks["fp"]]
    apart = {p: int(np.bitwise_count(prints[p[0]] ^ prints[p[1]]).sum()) for p in likely}
    assert want and all(apart[p] <= simhash.hamming_limit(0.8) for p in want)


def test_blocks_hold_their_share_of_pairs(spark):
    rng = np.random.default_rng(31)
    shared, own = rng.choice([-1.0, 1.0], (300, 1024)) * (rng.random((300, 1024)) < 0.35), lambda: rng.choice([-1.0, 1.0], (300, 1024)) * (rng.random((300, 1024)) < 0.03)
    keys = [simhash.wide_fingerprints((shared + own()).astype(np.float32))[1] for _ in range(2)]
    assert keys[0].shape == (300, 32) and (keys[0] == keys[1]).any(axis=1).mean() > 0.95
    assert not hasattr(simhash, "codes_for")  # nothing changes them with the number of documents


def sketch(shingles):
    at, signs = (shingles & np.uint64(1023)).astype(np.int64), (shingles >> np.uint64(20) & np.uint64(1)) * 2.0 - 1.0
    return np.bincount(at, weights=signs, minlength=1024).astype(np.float32)


@pytest.mark.parametrize("size", [100, 400])
def test_pairs_near_the_threshold_share_a_block(size):
    rng = np.random.default_rng(37)
    met = []
    for k in range(600):  # Jaccard 0.80 to 0.85
        shared = round(size * (0.80 + 0.05 * k / 600))
        both, a, b = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (shared, (size - shared) // 2, size - shared - (size - shared) // 2))
        met.append((sketch(np.concatenate([both, a])), sketch(np.concatenate([both, b]))))
    keys = [simhash.wide_fingerprints(np.stack(side))[1] for side in zip(*met, strict=True)]
    assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.93


def test_hot_fingerprints_are_joined_like_others(spark, monkeypatch):
    from heliograph.llm import common

    rng = random.Random(43)
    rows = [(d, "the same text in a third of all rows" if d % 3 == 0 else " ".join(sentence_words(rng, 30))) for d in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    keep = {r.doc_id for r in simhash.near_duplicates(docs).where("keep").collect()}
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    assert {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()} == want
    assert {r.doc_id for r in simhash.near_duplicates(docs).where("keep").collect()} == keep == {0} | {d for d, _ in rows if d % 3}


def test_smith_waterman_against_plain_programming():
    rng = random.Random(3)
    for _ in range(200):
        p, q = ([rng.choice("abcde") for _ in range(rng.randrange(1, n))] for n in (30, 12))
        table = np.zeros((len(q) + 1, len(p) + 1), dtype=int)
        for i, a in enumerate(q, 1):
            for j, b in enumerate(p, 1):
                table[i, j] = max(0, table[i - 1, j - 1] + (2 if a == b else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
        assert decontamination.smith_waterman(p, q)[0] == table.max()


def test_leaks_are_found_and_clean_documents_left(spark, data):
    rng = random.Random(5)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows, want = [], set()
    for i, text in bench:
        words = text.split()
        for k, share in enumerate((0.0, 0.1, 0.2)):
            d = 10 * i + k
            rows.append((d, " ".join([*sentence_words(rng, 40), *edited(words, rng, share), *sentence_words(rng, 40)])))
            want.add((d, i))
    rows += [(5000 + k, " ".join(sentence_words(rng, 200))) for k in range(20)] + [(6000, None), (6001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([*bench, (900, None), (901, "one two")], "item_id long, text string")
    for block in (8_000_000, 2_000):
        got = {(r.doc_id, r.item_id) for r in decontamination.decontaminate(docs, items, block_chars=block).collect()}
        assert all(d < 5000 for d, _ in got)
        exact = {(d, i) for d, i in want if d % 10 == 0}
        assert exact <= got and len(want & got) >= 0.97 * len(want)


def test_exact_leaks_of_the_given_documents(spark, data, documents):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontamination"](spark, data).collect()}
    bench = {r.item_id: decontamination.words_of(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    for d in documents.collect():
        body = " " + " ".join(decontamination.words_of(d.text or "")) + " "
        for i, words in bench.items():
            if len(words) > 2 and " " + " ".join(words) + " " in body:
                assert (d.doc_id, i) in got


def test_against_alignment_of_every_document_with_every_item(spark, data, documents):
    rng = random.Random(19)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = [(d.doc_id, d.text or "") for d in documents.collect() if len(d.text or "") < 20_000]
    for k, (_, text) in enumerate(bench):  # copies with up to 35 % of the words exchanged
        rows.append((10_000 + k, " ".join([*sentence_words(rng, 15), *edited(text.split(), rng, 0.05 * (k % 8)), *sentence_words(rng, 15)])))
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = {}
    for d, text in rows:
        words = decontamination.words_of(text)
        for i, item in bench:
            own = decontamination.words_of(item)
            score = decontamination.smith_waterman(words, own)[0] / (2 * len(own))
            if score >= 0.5:
                want[d, i] = score
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and len(want) > 20
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_windows_over_long_regions_lose_no_alignment():
    import random

    from heliograph.llm import decontamination as d

    rng = random.Random(3)
    common = "as well as the".split()
    items = [(i, " ".join([*(f"w{i}x{k}" for k in range(20)), *common, *(f"v{i}x{k}" for k in range(20))])) for i in range(50)]
    words = [w for k in range(1600) for w in [*common, *(f"f{rng.randrange(9000)}" for _ in range(26))]]
    index = d.SeedIndex(items)
    assert not list(index.passages(" ".join(words)))
    for edit in (3, 5, 9):
        copy = [w if k % edit else "zz" for k, w in enumerate(items[7][1].split(), 1)]
        text = words.copy()
        at = rng.randrange(len(words))
        text[at:at] = copy
        found = list(index.passages(" ".join(text)))
        assert all(len(p) <= 2 * d.longest(44, d.THRESHOLD) for _, _, p in found)
        best = max((d.align(p, items[7][1].split())[0] for i, _, p in found if i == 7), default=0.0)
        assert abs(best - d.align(text[max(0, at - 200) : at + 300], items[7][1].split())[0]) < 1e-12 or edit == 3
    for _ in range(300):
        n, m = rng.randrange(10, 3000), rng.randrange(3, 60)
        region = sorted({rng.randrange(0, n - 2) for _ in range(rng.randrange(1, 80))})
        step, made = d.longest(m, 0.5), list(d.windows(region, m, n, 0.5))
        low, high = max(0, region[0] - m), min(n, region[-1] + 3 + m)
        for seed in region:
            for start in range(max(low, seed - step + 3), min(seed, high - step) + 1):
                assert any(a <= start and start + step <= b for a, b in made)


def test_leaks_that_many_documents_repeat_with_one_edit(spark):
    rng = random.Random(17)
    words = sentence_words(rng, 45)
    edit, part = [*words[:20], "zzz", *words[21:]], words[:30]
    around = lambda body: " ".join([*sentence_words(rng, 5), *body, *sentence_words(rng, 5)])
    rows = [(0, around(words))] + [(d, around(edit if d <= 1000 else part)) for d in range(1, 1101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontamination.decontaminate(docs, items).collect()}
    assert set(got) == set(range(1101))
    assert got[0] == 1.0 and min(got[d] for d in range(1, 1001)) > 0.95 and min(got[d] for d in range(1001, 1101)) > 0.65


def brute_chunks(lines):
    """Chunks (first, end) of lines that hold words: places whose number is less than both neighbours', and both sides of long lines."""
    hashes = [xxhash.xxh64_intdigest(x.encode()) for x in lines]
    number = {}
    for i in range(len(lines) - 1):
        v = (hashes[i] * 11400714785074694791 + hashes[i + 1]) % 2**64
        number[i] = v ^ v >> 33
    out, first = [], 0
    for i in range(len(lines)):
        low = i - 1 in number and i + 1 in number and number[i] < min(number[i - 1], number[i + 1])
        long = len(lines[i].split()) >= 30 or (i + 1 < len(lines) and len(lines[i + 1].split()) >= 30)
        if i == len(lines) - 1 or low or long:
            out.append((first, i + 1))
            first = i + 1
    return out


def size_of(lines):
    return sum(len(x.split()) for x in lines)


def brute_lines(rows):
    """Texts after line dedup, by plain comparison of strings."""
    where, spans = defaultdict(list), {}
    for d, text in rows:
        lines = [x for x in text.split("\n") if x.split()]
        size = lambda a, b: sum(len(x.split()) for x in lines[a:b])  # noqa: B023, E731
        cut = {(a, b) for a, b in brute_chunks(lines) if size(a, b) >= (30 if b - a == 1 else 8)}
        spans[d] = (lines, cut)
        for a, b in sorted(cut | {(i, i + 2) for i in range(len(lines) - 1)}):
            where["\n".join(lines[a:b])].append((d, a, b))
    goes = {}
    for d, _ in rows:
        lines, cut = spans[d]
        first = lambda a, b: min(where["\n".join(lines[a:b])])[:2]  # noqa: B023, E731
        found, i = [], 0
        while i + 1 < len(lines):
            at, j = first(i, i + 2), i + 1  # the longest run of lines that stands whole where its first pair stands first
            whole = spans[at[0]][0]
            while j < len(lines) and at != (d, i) and lines[i : j + 1] == whole[at[1] : at[1] + j + 1 - i] and first(j - 1, j + 1) == (at[0], at[1] + j - 1 - i):
                j += 1
            if j - i > 1 and size_of(lines[i:j]) >= 30:
                found.append((i, j, at))
                i = j
            else:
                i = max(j - 1, i + 1)
        covered = {i for a, b, _ in found for i in range(a, b)}
        goes[d] = found + [(a, b, first(a, b)) for a, b in sorted(cut) if first(a, b) != (d, a) and set(range(a, b)) - covered]
    stays = {(e, k + n) for found in goes.values() for a, b, (e, k) in found for n in range(b - a)}
    out = {}
    for d, text in rows:
        lines, _ = spans[d]
        taken = {i for a, b, _ in goes[d] for i in range(a, b) if (d, i) not in stays}
        kept, k, waiting = [], -1, []
        for line in text.split("\n"):
            if line.split():
                k += 1
                if k in taken:
                    waiting = [] if k - 1 in taken else waiting
                    kept += waiting
                else:
                    kept += [*waiting, line]
                waiting = []
            else:
                waiting.append(line)
        out[d] = "\n".join([*kept, *waiting]) if set(range(len(lines))) - taken or not lines else ""
    return out


def test_line_dedup_against_brute_force(spark, documents):
    rows = [(d.doc_id, d.text or "") for d in documents.collect()]
    got = {r.row.doc_id: r.kept for r in line_dedup.dedup_lines(documents).collect()}
    assert got == brute_lines(rows)


def deduped(spark, texts):
    return {r.row.doc_id: r.kept for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_a_run_needs_one_document_that_holds_it_whole(spark):
    rng = random.Random(41)
    a, b, c, d = (" ".join(sentence_words(rng, 20)) for _ in range(4))
    texts = ["\n".join(x) for x in ((a, b), (b, c), (c, d), (a, b, c, d))]
    got = deduped(spark, texts)
    held = [x.split("\n") for x in (got[0], got[1], got[2])]
    assert [got[i] for i in range(3)] == texts[:3] and all("\n".join(x) in texts for x in held)
    assert got[3] == ""  # a b stands whole in the first, c d in the third
    e, f, g = (" ".join(sentence_words(rng, 12)) for _ in range(3))
    mixed = ["\n".join(x) for x in ((e, f), (f, g), (e, f, g))]
    assert deduped(spark, mixed) == dict(enumerate(mixed))  # 36 words, but no document holds the three lines, and 24 are too few


def test_what_a_removal_points_to_stays(spark):
    rng = random.Random(42)
    a, b, c = (" ".join(sentence_words(rng, 20)) for _ in range(3))
    texts = ["\n".join(x) for x in ((b, c), (a, b, c), (a, b))]
    got = deduped(spark, texts)
    assert got[0] == texts[0] and got[1] == f"{a}\n{b}" and got[2] == ""


def test_removed_lines_stand_whole_elsewhere(spark, documents):
    rows = [(r.doc_id, r.text or "") for r in documents.collect()]
    kept = {r.row.doc_id: r.kept for r in line_dedup.dedup_lines(documents).collect()}
    left = ["\n".join(["", *(x for x in t.split("\n") if x.split()), ""]) for t in kept.values()]
    n = 0
    for doc, text in rows:
        lines, stays = [x for x in text.split("\n") if x.split()], [x for x in kept[doc].split("\n") if x.split()]
        if len(stays) == len(lines):
            continue
        i = 0
        gone = []
        for x in lines:  # what is kept is a subsequence: the others are gone
            if i < len(stays) and x == stays[i]:
                i += 1
                gone.append(None)
            else:
                gone.append(x)
        assert i == len(stays)
        for x in filter(None, gone):
            n += 1
            assert any(f"\n{x}\n" in t for t in left)
    assert n


def test_line_dedup_of_random_lines(spark):
    rng = random.Random(41)
    few = [" ".join(sentence_words(rng, rng.choice([1, 4, 9, 20, 31]))) for _ in range(12)] + ["", " "]
    rows = [(d, "\n".join(rng.choice(few) if rng.random() < 0.7 else f"own {rng.random()}" for _ in range(rng.randrange(0, 14)))) for d in range(300)]
    got = {r.row.doc_id: r.kept for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


@pytest.mark.parametrize("shape", [(1, 60), (2, 28), (3, 20), (6, 10), (10, 8), (6, 25)])
def test_shared_passages_go_and_clean_texts_stay(spark, shape):
    rng = random.Random(9)
    passage = "\n".join(" ".join(sentence_words(rng, shape[1])) for _ in range(shape[0]))
    rows = [(d, "\n".join([" ".join(sentence_words(rng, 12)) for _ in range(6)] + ([passage] if d < 30 else []) + [" ".join(sentence_words(rng, 9))])) for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: r.kept for r in line_dedup.dedup_lines(docs).collect()}
    for d, text in rows:
        assert got[d] == (text if d == 0 or d >= 30 else text.replace("\n" + passage, ""))


def test_only_what_is_repeated_goes(spark):
    rng = random.Random(10)
    licence, own = " ".join(sentence_words(rng, 40)), " ".join(sentence_words(rng, 25))
    rows = [(1, licence), (2, f"{own}\n{licence}"), (3, f"{licence}\n\nshort words"), (4, "short words\nand more"), (5, licence)]
    got = {r.row.doc_id: (r.kept, r.lines.lines_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (licence, 0), 2: (own, 1), 3: ("\nshort words", 1), 4: ("short words\nand more", 0), 5: ("", 1)}


def test_hot_chunks_are_joined_like_others(spark, monkeypatch):
    from heliograph.llm import common

    rng = random.Random(12)
    shared = [" ".join(sentence_words(rng, 35)) for _ in range(3)]
    rows = [(d, "\n".join([" ".join(sentence_words(rng, 12)), *shared[: 1 + (d % 3 == 0) + (d % 50 == 0)]])) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.row.doc_id: r.kept for r in line_dedup.dedup_lines(docs).collect()}
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    assert {r.row.doc_id: r.kept for r in line_dedup.dedup_lines(docs).collect()} == want == brute_lines(rows)


def test_chunks_resist_shifts():
    rng = random.Random(1)
    lines = [" ".join(sentence_words(rng, 8)) for _ in range(60)]

    def bodies(ls):
        cut = line_dedup.chunks([x.encode() for x in ls], [len(x.split()) for x in ls])
        assert cut == brute_chunks(ls) and all(b - a > 1 for a, b in cut)
        return {tuple(ls[a:b]) for a, b in cut}

    for at in range(61):
        assert len(bodies(lines) - bodies([*lines[:at], "a new line", *lines[at:]])) <= 3


def test_odd_rows(spark, data, odd, nothing):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    assert simhash.near_components(odd).count() == 12 and simhash.near_components(nothing).count() == 0
    assert simhash.near_duplicates(odd).count() == 12 and simhash.near_duplicates(nothing).count() == 0
    assert decontamination.decontaminate(odd, bench).count() == 0 and decontamination.decontaminate(nothing, bench).count() == 0
    assert decontamination.decontaminate(odd, bench.limit(0)).count() == 0
    assert line_dedup.dedup_lines(odd).count() == 12 and line_dedup.dedup_lines(nothing).count() == 0


def test_pipeline_stages(spark, data, odd):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("row", F.lit(1)).withColumn("key", F.lit(1)).withColumn("score", F.lit("x"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before and len(after) >= 0.5 * len(before), name
        docs = out.checkpoint()
    packed = cp.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    for name, stage in cp.STAGES:
        assert stage(spark, odd, data).count() >= 1, name
        stage(spark, odd.limit(0), data).count()


def test_pipeline_against_brute_force(spark, data, documents):
    import corpus_pipeline as cp
    import public_tokenizers
    from tokenizers import Tokenizer

    from heliograph.llm import toxicity

    model = toxicity.fit(documents, spark.read.parquet(f"{data}/labels.parquet"))
    rows = [(d.doc_id, d.text or "") for d in documents.collect()]
    rows = [(d, t) for d, t in rows if model.score(t) < 0.5]
    lines = brute_lines(rows)
    rows = sorted((d, lines[d]) for d, t in rows if lines[d] == t or lines[d].split())

    def shingles(text):
        w = tuple("".join(c.lower() if "A" <= c <= "Z" else c for c in text).split())
        return {w[i : i + 5] for i in range(len(w) - 4)} or {w}

    sets, first = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for k in range(i):
            if first[i] != first[k] and len(a & sets[k]) >= 0.8 * len(a | sets[k]):
                low, high = sorted((first[i], first[k]))
                first = [low if f == high else f for f in first]
    rows = [r for i, r in enumerate(rows) if first[i] == i]
    bench = [decontamination.words_of(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not any(2 * decontamination.smith_waterman(decontamination.words_of(t), b)[0] >= 2 * len(b) for b in bench)]
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe.encode_special_tokens = True
    want = {d: len(bpe.encode(t, add_special_tokens=False).ids) + 1 for d, t in rows}
    got = cp.run(spark, data).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == want and sum(r.length for r in got) == sum(want.values())
