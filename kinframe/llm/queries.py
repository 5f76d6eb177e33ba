"""One thin query per operator over the driver tables."""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm import (chat, decontamination, lexical_search, line_dedup, packing, quality, quality_net, sharding, simhash,
                          suffix_dedup, token_counts, url_templates, whitening)
from kinframe.llm.common import scratch, stored
from kinframe.llm.registry import ORACLE, QUERIES, query  # noqa: F401
from kinframe.sources.tables import Tables


@query("op2_sharding")
def op2(t: Tables) -> DataFrame:
    """Documents in 8 shards of near equal bytes."""
    placed = sharding.shard_documents(t.documents, 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT rid, doc_id, t,
        list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM m WHERE len(w) >= 3),
k AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM x),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM k) WHERE c >= 2),
c AS (SELECT rid, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN c USING (rid)),
b AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END
        + CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END
        + CASE WHEN 10 * n_symbols > 3 * n_words THEN 16 ELSE 0 END
        + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM f)
"""
VERDICT_SQL = QUALITY_SQL + "SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, " + ", ".join(
    f"(fail_bits & {quality.mask(v)}) = 0 AS kept_v{v}" for v in quality.POLICIES) + " FROM b"
ABLATION_SQL = QUALITY_SQL + " UNION ALL ".join(
    f"SELECT {v} AS policy, '{r}' AS rule, CAST({quality.bit(r)} AS BIGINT) AS bit, count(*) FILTER (WHERE fail_bits & {quality.bit(r)} <> 0) AS n_failed, "
    f"count(*) FILTER (WHERE fail_bits & {quality.mask(v)} = {quality.bit(r)}) AS n_failed_alone, "
    f"count(*) FILTER (WHERE fail_bits & {quality.mask(v)} <> 0) AS n_rejected FROM b" for v, rules in quality.POLICIES.items() for r in rules)


def quality_ledger(t: Tables) -> DataFrame:
    """The rule ledger of all documents, stored once; every verdict and count is read from it."""
    return stored(quality.ledger(t.documents), "ledger")


@query("op8_quality_rules", VERDICT_SQL)
def op8(t: Tables) -> DataFrame:
    """Rule ledger of every document with the verdicts of all policies; ``kept`` is the newest one's."""
    return quality.verdicts(quality_ledger(t)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "fail_bits",
        "base_failed", F.col(f"kept_v{max(quality.POLICIES)}").alias("kept"), *[f"kept_v{v}" for v in quality.POLICIES])


@query("quality_ablations", ABLATION_SQL)
def quality_ablations(t: Tables) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that fail it alone, that the policy rejects."""
    led = quality_ledger(t)
    return reduce(DataFrame.unionByName, [quality.ablations(led, v).select(F.lit(v).alias("policy"), "*") for v in quality.POLICIES])


@query("op5_token_counts")
def op5(t: Tables) -> DataFrame:
    """Token counts of every document, from a cache of its own that starts empty."""
    counts = token_counts.count_tokens(t.documents, public_tokenizers.path("piece_bpe_32k.model"),
                                       scratch(t.spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query("token_counts_cached")
def token_counts_cached(t: Tables) -> DataFrame:
    """Token counts of every document from a cache that an earlier run over the labelled documents has filled."""
    cache, model = scratch(t.spark, "token-cache"), public_tokenizers.path("piece_bpe_32k.model")
    token_counts.count_tokens(t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi"), model, cache)
    return token_counts.count_tokens(t.documents, model, cache)


@query("op6_best_fit_packing")
def op6(t: Tables) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack_documents(t.documents, public_tokenizers.path("word_bpe_49k.json"), 2048)


@query("op3_simhash")
def op3(t: Tables) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(t.documents, 4).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_decontamination")
def op4(t: Tables) -> DataFrame:
    """Benchmark passages in every document."""
    hits = decontamination.find_hits(t.documents, t.benchmark, 10)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


@query("op9_url_filters")
def op9(t: Tables) -> DataFrame:
    """Verdict on every page url; a page's label is that of the document with its number."""
    labels = t.labels.select(F.col("doc_id").alias("page_id"),
                             F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return url_templates.judge(t.pages, labels).select("page_id", "host", "path", "rule", "template", "verdict")


@query("op10_suffix_dedup")
def op10(t: Tables) -> DataFrame:
    """What is left of every document without strings of 100 bytes that start earlier."""
    cut = suffix_dedup.remove_repeats(t.documents)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_line_dedup")
def op7(t: Tables) -> DataFrame:
    """Every document without the line blocks that an earlier document has."""
    return line_dedup.dedup_lines(t.documents)


@query("op1_chat_format")
def op1(t: Tables) -> DataFrame:
    """Every turn of every conversation, repaired and rendered."""
    return chat.format_turns(t.conversations)


@query("op11_embedding_whitening")
def op11(t: Tables) -> DataFrame:
    """Every usable vector on the 8 leading components, whitened."""
    white = whitening.whiten(t.embeddings, 8)
    return white.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
b AS (SELECT item_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY item_id, term),
o AS (SELECT rid, unnest(ts) AS term FROM d),
p AS (SELECT rid, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
m AS (SELECT rid, doc_id, 100 - 25 + ((25 * len(ts) * n_docs) // n_terms) AS m FROM d, s WHERE len(ts) > 0),
r AS (SELECT item_id, doc_id, rid, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY item_id, doc_id, rid)
SELECT item_id, CAST(rk AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk FROM r WHERE score > 0) WHERE rk <= 20
"""


@query("op13_lexical_search", SEARCH_SQL)
def op13(t: Tables) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return lexical_search.search(t.documents, t.benchmark, 20)


@query("op12_quality_classifier")
def op12(t: Tables) -> DataFrame:
    """Quality score of every document."""
    return quality_net.score_documents(t.documents, t.labels)
