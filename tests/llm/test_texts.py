"""PII, quality rules and toxicity."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pytest

from heliograph.llm import pii, quality, toxicity
from heliograph.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = [int(x) for x in d[::-1]]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(s)) % 10 == 0


def brute_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), k, m.end()))
    return sorted(found)


TRICKY = ["a@b.c@d.e", "x.@y.z a@@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.256 001.002.003.004", "+1 (017) 555-7713 +12 +(1) 2", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111", "9" * 3000, "me@a-b.c.d. +1.2.3.4.5.6.7.8.9 1-2-3-4-5-6-7-8-9-0-1-8", "@a.b a@b. a@.c", "12345.1.1.1.1.", ""]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans_of_tricky_texts(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_of_random_texts():
    import random

    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("a1.2@+- ()9%b4") for _ in range(rng.randrange(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), repr(text)


def test_pii_query_against_brute_force(spark, data, documents):
    got = {r.doc_id: r for r in QUERIES["op7_pii"](spark, data).collect()}
    for d in documents.collect():
        want, r = brute_spans(d.text or ""), got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert set(filter(None, pii.told(want).split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("write to john (at) example (dot) com today", "email", "john (at) example (dot) com"),
        ("write to john [AT] mail.example [dot] org.", "email", "john [AT] mail.example [dot] org"),
        ("ask john.doe at example dot co dot uk please", "email", "john.doe at example dot co dot uk"),
        ("so jоhn@exаmple.com it is", "email", "jоhn@exаmple.com"),
        ("das ist ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ hier", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
        ("call +1 five five five one two three four five six seven", "phone", "+1 five five five one two three four five six seven"),
        ("host one nine two dot one six eight dot one dot seven", "ip", "one nine two dot one six eight dot one dot seven"),
        ("ip １９２.１６８.１.７ here", "ip", "１９２.１６８.１.７"),
        ("card four one one one 1111 1111 1111 now", "card", "four one one one 1111 1111 1111"),
        ("call +1 555 123 four five six!", "phone", "+1 555 123 four five six"),
        ("call (+1 555 123 four five six)", "phone", "+1 555 123 four five six"),
        ("to jane [at] example dot com", "email", "jane [at] example dot com"),
        ("to jane at example [dot] com.", "email", "jane at example [dot] com"),
        ("to jane dot doe at mail.example dot com.", "email", "jane dot doe at mail.example dot com"),
        ("to jane @ example.com.", "email", "jane @ example.com"),
        ("to jane@example dot com.", "email", "jane@example dot com"),
        ("mit ſix seven eight nine four +4 9 zero two two two two two two", "phone", "+4 9 zero two two two two two two"),
        ("to jаne@example.com.", "email", "jаne@example.com"),
        ("to jane dot doe@example.com.", "email", "jane dot doe@example.com"),
        ("host 192 dot 168 dot 1 dot 1 is up", "ip", "192 dot 168 dot 1 dot 1"),
        ("card 4111 1111 1111 one 111 now", "card", "4111 1111 1111 one 111"),
        ("zero​width joh​n@exa​mple.com", "email", "joh​n@exa​mple.com"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, hidden):
    found = pii.added_spans(text, pii.base_spans(text))
    spans = [(pii.KINDS[k], text[a:b]) for a, k, b in found]
    assert (kind, hidden) in spans, (spans, pii.deobfuscate(text) and pii.deobfuscate(text).text)


@pytest.mark.parametrize("text", ["we meet at example.com or at home", "point one dot two at last", "one two many four, at six dot", "look at this. dot com", "thanks @jane.doe for it"])
def test_prose_gains_nothing(text):
    assert not pii.added_spans(text, pii.base_spans(text))


def test_screens_pass_over_no_spelled_number():
    import random

    rng = random.Random(6)
    parts = ["one", "Two", "ſix", "FÜNF", "un", "7", "42", "+", "plus ", "(", ")", "!", " ", " ", "-", ".", " dot ", ",", "x", "_", "\n", "é"]
    hits = 0
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(3, 16)))
        if pii._spelled(text):
            hits += 1
            assert pii.shows_spelled(text), repr(text)
    assert hits > 20


def test_touched_and_overlaps_against_plain_loops():
    import random

    rng = random.Random(8)
    parts = ["a", "b@c.de", " (at) ", "x", " [dot] ", "\u200b", " at ", "．", " dot ", "1.2.3.4", " ", "one two three four ", "о", "+49 12 ", "5555 "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(2, 30)))
        clear = pii.deobfuscate(text)
        if clear is None:
            continue
        for a, _, b in pii.base_spans(clear.text):
            assert clear.touched(a, b) == any(a < pos + n and pos < b or n == 0 and a < pos < b for pos, _, _, n in clear.edits), repr(text)
        base = pii.base_spans(text)
        every = [*base, *pii.added_spans(text, base)]
        more = every[len(base) :]
        assert all(0 <= a < b <= len(text) for a, _, b in every)
        assert all(b <= c or d <= a for i, (a, _, b) in enumerate(more) for c, _, d in more[:i])
        assert all(b <= c or d <= a or a <= c and d <= b and (a, b) != (c, d) for a, _, b in more for c, _, d in base)


@pytest.mark.parametrize("unit", ["a dot ", "a dot at ", "a at ", "at dot ", "dot dot at ", "a@a dot ", "one ", "4 one ", "1 dot ", "x (dot) ", " @ a.b", "a . "])
def test_chains_of_every_disguise_take_linear_time(unit):
    import time

    took = []
    for n in (200_000, 400_000):
        text = unit * (n // len(unit))
        began = time.process_time()
        pii.added_spans(text, pii.base_spans(text))
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.5


def test_long_hostile_texts_take_linear_time():
    import time

    took = []
    for n in (8_000, 64_000):
        text = "john (at) example (dot) com 1.2.3.4 a dot b at c dot d one two three four " * (n // 40)
        began = time.process_time()
        assert len(pii.added_spans(text, pii.base_spans(text))) > n // 50
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0] + 1


def test_clean_texts_gain_nothing(documents):
    for d in documents.collect():
        assert not pii.added_spans(d.text or "", pii.base_spans(d.text or ""))


SPACES = "[^\x20\x09-\x0d]+"


def brute_quality(text):
    words = re.findall(SPACES, text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(SPACES, line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_against_brute_force(spark, data, documents):
    got = {r.doc_id: r for r in QUERIES["op8_quality"](spark, data).collect()}
    for d in documents.collect():
        want, r = brute_quality(d.text or ""), got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_capitals_of_all_scripts_and_words_of_long_texts(spark):
    assert quality.letter_counts("ПРИВЕТ мир ÄÖ ß 12 汉 Ab") == (9, 15)
    rng = __import__("random").Random(4)
    rows = [(1, "ЖУК ПИЛ " * 40), (2, "one two three four five six " * 3000), (3, " ".join(f"w{rng.randrange(9000)}" for _ in range(60_000)))]
    bits = {r.doc_id: r.fail_bits for r in quality.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert bits[1] & quality.BITS["upper_case"] and bits[2] & quality.BITS["few_distinct_words"] and not bits[3] & quality.BITS["few_distinct_words"]


@pytest.mark.parametrize("text", ["", " \n \n", "a b c a b c", "a\x0bb\x0cc\x1cd\xa0e", "é é é é", "x\nx\nx \n y\n y", "one two"])
def test_measures_of_odd_texts(text):
    assert quality.measure(text)[:5] == brute_quality(text)


def test_ledger_answers_policies_and_ablations(spark, data, documents):
    entries = quality.ledger(documents).cache()
    for key in quality.POLICIES:
        kept = {r.doc_id for r in quality.apply_policy(entries, *key).where("kept").collect()}
        assert kept == {r.doc_id for r in entries.collect() if not r.fail_bits & quality.POLICIES[key]}
    bits = [r.fail_bits for r in entries.collect()]
    mask = quality.POLICIES["prose", 2]
    for r in quality.ablation(entries, "prose", 2).collect():
        bit = quality.BITS[r.rule]
        assert r.n_failed == sum(bool(b & bit) for b in bits) and r.n_only == sum(b & mask == bit for b in bits) and r.n_rejected == sum(bool(b & mask) for b in bits)


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = quality.apply_policy(quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")), "prose", 2).join(labels, "doc_id").where("n_words >= 50").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    for r in rows[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean) + 1
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)


def test_a_long_text_of_clean_sentences_stays_clean(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").select("text").collect() if model.score(r.text or "") < 0.5]
    text = next(r.text for r in docs.join(labels.where("toxic = 1"), "doc_id").collect() if model.offending(r.text or ""))
    worst = max(model.offending(text), key=lambda o: o["score"])
    spans, whole = 0, []
    while spans < 10_000:
        for t in clean:
            if spans < 10_000 and t:
                spans += len(toxicity.sentences(t))
                whole.append(t)
    half = len(whole) // 2
    assert model.score("\n".join(whole)) < 0.5
    mixed = "\n".join([*whole[:half], text[worst["start"] : worst["end"]], *whole[half:]])
    assert model.score(mixed) >= 0.5 and any(mixed[o["start"] : o["end"]].strip() == text[worst["start"] : worst["end"]].strip() for o in model.offending(mixed))
    joined = "\n".join(t for t in clean if t and model.score(t) < toxicity.FLOOR)
    assert model.score(joined) < toxicity.FLOOR


def test_clean_texts_stay_clean_however_many_are_joined(spark):
    import random

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    scored = [(r.text or "", toxic[r.doc_id], model.score(r.text or "")) for r in docs.select("doc_id", "text").collect() if toxic.get(r.doc_id) is not None]
    clean = [t for t, y, s in scored if not y and s < 0.5]
    for n in (300, 1000, 3000):
        for seed in range(10 if n < 3000 else 3):
            assert model.score("\n".join(random.Random(seed).choices(clean, k=n))) < 0.5, (n, seed)
    bad = next(t[f["start"] : f["end"]] for t, y, s in scored if y and s >= 0.5 for f in model.offending(t))
    drawn = random.Random(1).choices(clean, k=1000)
    assert model.score("\n".join([*drawn[:500], bad, *drawn[500:]])) >= 0.5


def test_toxicity_query_against_brute_force(spark, data, documents):
    """Every sentence by its words' features, all of the text, with the weights that were fitted."""
    import math

    from heliograph.llm.queries import QUERIES

    model = toxicity.fit(documents, spark.read.parquet(f"{data}/labels.parquet"))
    got = {(r.doc_id, r.score, r.predicted) for r in QUERIES["op2_toxicity"](spark, data).collect()}
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert len(got) == len(texts)
    for doc_id, score, predicted in got:
        p, n = [], 0
        for sentence in re.findall(r"[^.!?\n]+[.!?]*|[.!?]+", texts[doc_id]):
            words = re.findall(r"[^\W\d_]+", sentence.lower())
            n += bool(words)
            weight = sum(model.weights.get(f, 0.0) for w in words for f in [w, *("^" + w[:k] for k in range(3, min(len(w), 8) + 1))])
            if weight > 0:
                p.append(1 / (1 + math.exp(-model.bias - weight)))
        weak = sum(-math.log(1 - x) for x in p if 0.05 <= x < 0.5) - 3 * model.usual * n - 3 * model.spread * math.sqrt(n)
        clear = math.prod(1 - x for x in p if x >= 0.5) * math.exp(-max(weak, 0.0))
        want = max(1 - clear, max(p)) if p else 1 / (1 + math.exp(-model.bias))
        assert abs(score - want) < 1e-9 and predicted == (score >= 0.5)


def test_the_sample_is_bounded_in_rows_and_characters(spark):
    rows = spark.createDataFrame([(i, f"{i} " + "x" * 100 * (i % 7), i % 2) for i in range(200)], "doc_id long, text string, toxic int")
    got = toxicity.bounded(rows, 50, 10_000).collect()
    assert 10 < len(got) <= 50 and sum(len(r.text) for r in got) <= 10_000
    assert toxicity.bounded(rows, 500, 10**9).count() == 200


def test_offending_sentences_are_located():
    model = toxicity.SentenceModel(-6.0, {"idiot": 12.0, "^mor": 9.0})
    text = "All is well here.\nYou idiot go away! Fine again. Some morons came."
    assert [text[o["start"] : o["end"]].strip() for o in model.offending(text)] == ["You idiot go away!", "Some morons came."]
    assert model.score(text) > 0.9 > 0.1 > model.score("All is well here. Fine.") and model.score("") == pytest.approx(1 / (1 + 2.718281828**6), rel=1e-6)
    assert model.score("Fine. " * 100_000) == model.score("")
    assert model.score("İ idiot.") > 0.9


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (9, None, None), (None, 1, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, labels).count() == 12 and toxicity.toxicity(nothing, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).where("score between 0 and 1").count() == 12
    assert pii.find_personal_data(odd).count() == 12 and quality.ledger(odd).count() == 12
    assert pii.find_personal_data(nothing).count() == 0 and quality.ledger(nothing).count() == 0
