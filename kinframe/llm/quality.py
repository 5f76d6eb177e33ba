"""Quality rules as a bitmask ledger (built-in expressions only).

Every rule is evaluated once per document; the ledger stores the measurements and one failure bit per
rule. Policies are versioned masks over those bits, so changing a policy or asking which rule costs how
many documents never reads the texts again.

Defined cases: a null or empty text has no words (fails ``few_words``, and no other rule since the other
rules compare against counts that are then zero); texts of any length are measured whole; repeated rows
and repeated ids are judged row by row; an empty table gives an empty ledger; columns of the input other
than id and text are ignored by :func:`ledger` and kept by :func:`filter_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.llm.common import WHITE, whole_text, words_of

SYMBOLS = "#*$%&|<>"

#: Rule name -> failure test over the measurement columns; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
}
BASE_RULES = ("few_words", "repeated_windows")

#: Policy version -> rules that reject. The base rules are part of every policy.
POLICIES: dict[int, tuple[str, ...]] = {
    1: BASE_RULES,
    2: tuple(RULES),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: int | tuple[str, ...]) -> int:
    rules = POLICIES[policy] if isinstance(policy, int) else tuple(policy)
    return sum(bit(r) for r in dict.fromkeys(rules + BASE_RULES))


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _covered(pairs: Column) -> Column:
    """Words in windows that occur twice or more, given the sorted (hash, position) pairs of the windows.

    Equal windows stand side by side; the positions of those with an equal neighbour are walked in text
    order, each adding the words (at most 3) not yet counted.
    """
    def repeated(p, j):
        return (F.get(pairs, j - 1)["h"] == p["h"]) | (F.get(pairs, j + 1)["h"] == p["h"])

    hit = F.transform(F.filter(pairs, repeated), lambda p: p["i"])
    return F.aggregate(
        F.array_sort(hit),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` with the measurements, one row per input row."""
    text = F.col("_text")
    words, hashes = F.col("_words"), F.col("_hashes")
    lines = F.col("_lines")
    staged = (
        docs.select(F.col(id_col), whole_text(text_col).alias("_text"))
        .select("*", words_of(text).alias("_words"),
                F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("_lines"))
        .select(
            id_col, "_words",
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
            _count_of(text, SYMBOLS).alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))
        .select("*", F.when(F.size(words) >= 3, F.transform(
            F.sequence(F.lit(1), F.size(words) - 2),
            lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))))
            .otherwise(F.array().cast("array<bigint>")).alias("_hashes"))
        .drop("_words")
        # only texts with some repeated window pay for the sort
        .select("*", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.array_sort(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_pairs"))
        .drop("_hashes")
    )
    # a generator of one row: filters on the measurements stay above it, else the optimiser would write their
    # expressions into the filter, into its lambdas too
    return staged.select(id_col, F.inline(F.array(F.struct(
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(_covered(F.col("_pairs")), F.lit(0).cast("long")).alias("n_repeat_words")))))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus ``fail_bits``: bit i is set where rule i of ``RULES`` fails."""
    bits = F.lit(0).cast("long")
    for rule, test in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(bit(rule)).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, policy: int | tuple[str, ...]) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy version (or a tuple of rule names)."""
    hits = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) != 0
    return led.select("*", hits(mask(BASE_RULES)).alias("base_failed"), (~hits(mask(policy))).alias("kept"))


def verdicts(led: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and, for every version of the policy, ``kept_v<version>``."""
    hits = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) != 0
    return led.select("*", hits(mask(BASE_RULES)).alias("base_failed"), *[(~hits(mask(v))).alias(f"kept_v{v}") for v in POLICIES])


def ablations(led: DataFrame, policy: int | tuple[str, ...]) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone (kept once it is dropped), that
    the policy rejects. Bit patterns are counted first, so what is regrouped is at most 2^rules rows."""
    m = mask(policy)
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit"))
                      for r in RULES if m & bit(r)])
    one = patterns.select("bits", "n", F.explode(rules).alias("r"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return one.groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(
        total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("r.bit")).alias("n_failed_alone"),
        total(F.col("bits") != 0).alias("n_rejected"))


def filter_documents(docs: DataFrame, policy: int = max(POLICIES), text_col: str = "text") -> DataFrame:
    """The rows that the policy keeps, with the columns of the input."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text_col).alias("_body"))
    judged = apply_policy(ledger(packed, "_row", "_body"), policy)
    return judged.filter("kept").select("_row.*")
