"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once a document: the ledger has the measurements and an integer whose bit i
says that rule i failed.  A policy is a versioned mask of rules; it, a changed policy, or the
ablation of a rule is then a bitwise question to the ledger and never reads a text again.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

SYMBOLS = re.compile(r"[#*$%&|<>]")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_bangs long, n_distinct long"
#: Name and failing condition of each rule; the place is the bit.  Distinct words grow about as the root of a text's
#: words, so their rule compares the square and means the same at every length.
RULES = (
    ("too_short", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words and n_words > 0"),
    ("duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("upper_case", "n_letters > 0 and 2 * n_upper > n_letters"),
    ("exclamation", "10 * n_bangs > 3 * n_words and n_words > 0"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    ("few_distinct_words", "n_words >= 50 and 2 * n_distinct * n_distinct < 5 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["too_short"] | BITS["repeated_windows"]
#: Policies by name and version: the rules whose failure rejects a document.
POLICIES = {
    ("base", 1): BASE,
    ("prose", 1): BASE | BITS["symbols"] | BITS["upper_case"] | BITS["exclamation"],
    ("prose", 2): (1 << len(RULES)) - 1,
}


def measure(text: str) -> tuple[int, ...]:
    """The measurements of a text, in the order of MEASURES."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split on the ASCII white space of the contract
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if raw.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    repeat = 0
    if n >= 3:
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        if len(windows) < n - 2:
            again = np.fromiter((windows[w] > 1 for w in zip(words, words[1:], words[2:], strict=False)), dtype=bool, count=n - 2)
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            repeat = int(covered.sum())
    upper, letters = letter_counts(text)
    return n, chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat, len(lines), upper, letters, text.count("!"), len(set(words))


_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_ASCII = re.compile(r"[\x00-\x7f]+")


def letter_counts(text: str) -> tuple[int, int]:
    """Capitals (category Lu) and letters (L) of all scripts; only characters beyond ASCII are looked up, each once."""
    raw = text.encode("ascii", "ignore")
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = len(raw) - len(raw.translate(None, _UPPER + _LOWER))
    if len(raw) < len(text):
        for c, n in Counter(_ASCII.sub("", text)).items():
            kind = unicodedata.category(c)
            upper += n * (kind == "Lu")
            letters += n * (kind[0] == "L")
    return upper, letters


def measurements(text: Column) -> Column:
    @F.pandas_udf(MEASURES)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [m.split()[0] for m in MEASURES.split(", ")]
        for batch in batches:
            yield pd.DataFrame([measure(t or "") for t in batch], columns=names, dtype="int64")

    return measured(text)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``fail_bits``; null texts are empty, null ids and repeated rows stay, no rows give no rows."""
    rows = texts(docs).withColumn("m", measurements(F.col("text"))).select("doc_id", "m.*")
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, condition) in enumerate(RULES)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return rows.withColumn("fail_bits", mask.cast("long"))


def apply_policy(entries: DataFrame, name: str, version: int) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[name, version])) == 0)


def ablation(entries: DataFrame, name: str, version: int) -> DataFrame:
    """rule, n_failed, n_only (rejected by this rule alone), n_rejected (by the policy) for each rule of the policy.

    The ledger is first counted by bit pattern, of which there are at most 2 to the number of rules.
    """
    mask = POLICIES[name, version]
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in BITS.items() if b & mask))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return patterns.select("bits", "n", F.explode(rules).alias("r")).groupBy("r.rule").agg(count(hit)("n_failed"), count(F.col("bits") == F.col("r.bit"))("n_only"), count(F.col("bits") != 0)("n_rejected"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = apply_policy(ledger(table(spark, sf_dir, "documents")), "prose", 2)
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


def op8_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(ledger(table(spark, sf_dir, "documents")), "prose", 2)
