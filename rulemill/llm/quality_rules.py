"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one long whose bit i says that rule i
failed. Policies are versioned masks over these bits, so another policy, or the effect of leaving a rule out, needs no
second look at the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rulemill.llm.common import id_and_text, map_rows

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: name -> failure, as SQL over the measurements. The position in this mapping is the rule's bit; append only.
RULES: Mapping[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE = ("few_words", "repeated_words")

#: version -> rules that reject. A published version never changes.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": BASE,
    "2": (*BASE, "short_words", "long_words", "symbols", "duplicate_lines"),
}


def covered_by_repeats(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of `window` words that occurs at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size, code, used = len(number), ids[:n], len(number)
    for k in range(1, window):
        if used * size >= 2**62:  # renumber before the code could overflow
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            used = n
        code = code * size + ids[k : k + n]
        used *= size
    kinds, which, count = np.unique(code, return_inverse=True, return_counts=True)
    if len(kinds) == n:
        return 0
    repeated = count[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= repeated
    return int(covered.sum())


def _measure(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, text in rows:
        text = text or b""
        words = text.split()
        solid = b"".join(words)
        lines = [line for line in text.split(b"\n") if line.strip()]
        yield (
            doc_id, len(words), len(solid.decode("utf-8", "replace")), len(solid) - len(solid.translate(None, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), covered_by_repeats(words),
        )


def mask_of(rules: Iterator[str] | tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the measurements and `failures`, the bits of the rules it fails. One narrow pass.

    A NULL text counts as empty. Repeated ids stay repeated rows; other columns are not read; an empty table gives an empty ledger.
    """
    measured = map_rows(id_and_text(docs, id_column, text_column), _measure, MEASURES)
    bits = [F.when(F.expr(failure), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, failure in enumerate(RULES.values())]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measured.withColumn("failures", failures)


def with_verdict(rows: DataFrame, version: str, name: str = "kept") -> DataFrame:
    """Add whether a ledger row passes a policy version."""
    return rows.withColumn(name, F.col("failures").bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0)


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that only it rejects (kept if it were left out).

    The ledger is first counted by its masked bits, at most 2 ** rules groups combined before the shuffle, so any number of
    ablations costs one pass. With an empty ledger every rule has zeros.
    """
    names, spark = list(RULES), rows.sparkSession
    masked = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = spark.createDataFrame([(r, 1 << names.index(r)) for r in POLICIES[version]], "rule string, bit long")
    hit = masked.select("n", "bits", F.explode(F.array(*[F.lit(1 << names.index(r)).cast("long") for r in POLICIES[version]])).alias("bit"))
    hit = hit.filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).groupBy("bit").agg(
        F.sum("n").alias("failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rules.join(hit, "bit", "left").select("rule", zero("failed"), zero("only_this"))
