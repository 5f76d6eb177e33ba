"""Line dedup by pairwise alignment.

Documents that share rare lines are paired, their line sequences aligned by patience diff, and the common
blocks deleted from the later document. Documents are ordered by (id, hash of the text).

Pairs: every line of ``min_line`` characters or more is a key, and every shorter one together with the short
lines after it (blank ones aside) that are needed to reach ``min_line`` characters; so verse, code and wrapped
passages have keys, too. A key is owned by the first document that has it, and a later document with the key is
paired with the owner, so pairs grow with the lines and not with the square of a group of copies. A pair counts
if the lines that begin its shared keys are a passage by their length (``PASSAGE * min_line`` characters
together, so any three lines, or one long line), or one of the keys is rare (in at most the share ``rare`` of the
documents, or in two), or they are all that the later document has: so copies and passages are found however
large their group and the table, and a lone line that is common pairs nothing.

Alignment: lines that occur once in each of two ranges are matched along their longest increasing
subsequence, ranges between matches and common ends likewise. Consecutive matches are blocks; a block of
``min_line`` characters is deleted from the later document. What the alignment leaves although the earlier
document has it (a passage that it holds twice, or in another order) is found as the longest blocks of the
earlier document that end at each line of the later one, and deleted likewise: so all blocks of ``min_line``
characters that a pair shares go, and no further partner is needed. The first document that has such a block
never loses it, so none is deleted everywhere.

A task reads a later document once and then its partners one after the other, so its memory holds two documents
however many partners there are.

Only line hashes are exchanged for this; texts move once, to be cut.

Defined cases: a null or empty text has no lines and stays as it is; rows that repeat id and text are one
document and get the same result; a null id sorts before all others; an empty table gives an empty
result; other columns are ignored by :func:`dedup_lines` and kept by :func:`remove_lines`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.llm.common import WHITE, small_batches, stored, whole_text

#: Fixed value: shared lines with the characters of so many lines of the least length are a passage.
PASSAGE = 3
#: A key with more than this part (1 / 500) of all rows of shared keys is joined by a broadcast.
HOT = 500


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (ordered by the first number) whose second numbers increase."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tops, j)
        before[k] = at[n - 1] if n else -1
        tops[n:n + 1], at[n:n + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of two sequences, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {b[n]: n for n in range(j, j_end) if in_b[b[n]] == 1 and in_a[b[n]] == 1}
        anchors = _increasing([(n, place[a[n]]) for n in range(i, i_end) if a[n] in place])
        if not anchors:
            continue
        for m, n in anchors:
            todo.append((i, m, j, n))
            i, j = m, n  # the match itself is the common start of the next range
        todo.append((i, i_end, j, j_end))
    return sorted(out)


def longest_ends(a: list[int | None], b: list[int]) -> list[int]:
    """Length of the longest block of ``a`` that ends at each position of ``b``, by the suffix automaton of ``a``."""
    step: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for x in a:
        new, p = len(step), last
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if length[q] > length[p] + 1:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = copy
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = copy
                    p = link[p]
                q = copy
            link[new] = q
        last = new
    out, at, n = [], 0, 0
    for x in b:
        while at and x not in step[at]:
            at = link[at]
            n = length[at]
        at, n = (step[at][x], n + 1) if x in step[at] else (0, 0)
        out.append(n)
    return out


def _moved(earlier: list[int], later: list[int], size: list[int], done: list[int], least: int) -> list[int]:
    """Positions in ``later`` of blocks of ``earlier`` in any place with ``least`` characters, if some are not ``done``."""
    have, cut = set(earlier), set(done)
    if not any(x in have and k not in cut for k, x in enumerate(later)):
        return []
    also = set(later)
    ends = longest_ends([x if x in also else None for x in earlier], later)
    before = [0, *accumulate(size)]
    out: list[int] = []
    upto = 0
    for j, n in enumerate(ends):
        whole = j + 1 == len(ends) or ends[j + 1] != n + 1  # else the next position's block holds this one
        if whole and before[j + 1] - before[j + 1 - n] >= least:
            out += range(max(upto, j + 1 - n), j + 1)  # starts never go back
            upto = j + 1
    return out


def common_blocks(earlier: list[int], later: list[int], size: list[int], least: int) -> list[int]:
    """Positions in ``later`` of common blocks with at least ``least`` characters (``size`` per line): aligned ones first,
    then what the alignment leaves."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(size[k] for k in block) >= least:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out + _moved(earlier, later, size, out, least)


def _aligner(least: int):
    """Rows ``id, digest, owner, lines, size``, a document (``owner`` 0) before its partners (1), to ``id, digest, cut``:
    positions to delete."""
    def run(batches):
        lines, size = [], []
        for b in batches:
            owner, at, cuts = b.column(2).to_pylist(), [], []
            for k in range(b.num_rows):
                if not owner[k]:
                    lines, size = b.column(3)[k].as_py(), b.column(4)[k].as_py()
                    continue
                cut = common_blocks(b.column(3)[k].as_py(), lines, size, least)
                if cut:
                    at.append(k), cuts.append(cut)
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)),
                                                  pa.array(cuts, pa.list_(pa.int32()))], names=["id", "digest", "cut"])

    return run


def _keys(min_line: int) -> tuple[Column, Column]:
    """The lines with characters (to be named ``solid``), and from them ``line, size`` per distinct key of a document: the
    hash of a long line, or of a run of short ones, and the characters of the line that begins it."""
    solid = F.filter(F.arrays_zip("lines", "size"), lambda x: x["size"] > 0)
    none = F.array().cast("array<long>")
    start = F.struct(F.lit(0).alias("chars"), none.alias("run"), F.lit(False).alias("over"))

    def longer(s: Column, y: Column) -> Column:
        more = F.struct((s["chars"] + y["size"]).alias("chars"), F.concat(s["run"], F.array(y["lines"])).alias("run"), F.lit(False).alias("over"))
        ended = F.struct(s["chars"].alias("chars"), s["run"].alias("run"), F.lit(True).alias("over"))
        return F.when(s["over"] | (s["chars"] >= min_line), s).when(y["size"] >= min_line, ended).otherwise(more)

    # every line has a character, so ``min_line`` lines are enough
    run = lambda i: F.aggregate(F.slice("solid", i + 1, min_line), start, longer, lambda s: F.when(s["chars"] >= min_line, F.xxhash64(s["run"])))
    key = lambda x, i: F.struct(F.when(x["size"] >= min_line, x["lines"]).otherwise(run(i)).alias("line"), x["size"].alias("size"))
    return solid, F.array_distinct(F.filter(F.transform("solid", key), lambda k: k["line"].isNotNull()))


def deletions(docs: DataFrame, min_line: int = 20, rare: float = 0.2, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``id, digest, cut``: line positions (from 0, distinct) to delete from each document that loses any."""
    small_batches(docs.sparkSession)
    text = whole_text(text_col)
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), F.split(text, "\n").alias("l"))
    substance = lambda x: F.length(F.trim(F.translate(x, WHITE[1:], "     ")))
    lines = stored(
        split.select("id", "digest", F.transform("l", lambda x: F.xxhash64(x)).alias("lines"),
                     F.transform("l", substance).alias("size"))
        .groupBy("id", "digest").agg(F.first("lines").alias("lines"), F.first("size").alias("size")), "lines")
    few = max(2, rare * lines.count())

    solid, keys = _keys(min_line)
    met = lines.select("id", "digest", solid.alias("solid")).select("id", "digest", keys.alias("own")).select(
        "id", "digest", F.size("own").alias("n_own"), F.explode("own").alias("own")).select(
        "id", "digest", "n_own", F.col("own.line").alias("line"), F.col("own.size").alias("chars"))
    # a run can begin with lines of several sizes only if their hashes collide, so a key occurs once in a document
    owners = met.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("id", "digest")).alias("owner"))
    owners = stored(owners.filter("docs > 1"), "owners")
    # keys with more than this part of all shared ones are fewer than HOT, and are broadcast
    many = F.col("docs") * HOT > (owners.agg(F.sum("docs")).first()[0] or 0)
    hot = F.broadcast(owners.filter(many))
    shared = met.join(hot, "line").unionByName(met.join(hot.select("line"), "line", "left_anti").join(owners.filter(~many), "line"))
    shared = shared.filter(~(F.col("id").eqNullSafe(F.col("owner.id")) & (F.col("digest") == F.col("owner.digest"))))
    pairs = (shared.groupBy("id", "digest", "owner").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.min("docs").alias("rarest"),
        F.max("n_own").alias("n_own"))
        .filter((F.col("chars") >= PASSAGE * min_line) | (F.col("rarest") <= few) | (F.col("n") == F.col("n_own"))))
    pairs = stored(pairs.select("id", "digest", F.col("owner.id").alias("owner_id"), F.col("owner.digest").alias("owner_digest")), "pairs")

    own = lines.select(F.col("id").alias("i"), F.col("digest").alias("d"), "lines", "size")
    later = own.join(pairs.select("id", "digest").distinct(), F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))).select(
        "id", "digest", F.lit(0).alias("owner"), "lines", "size")
    earlier = pairs.join(own, F.col("owner_id").eqNullSafe(F.col("i")) & (F.col("owner_digest") == F.col("d"))).select(
        "id", "digest", F.lit(1).alias("owner"), "lines", F.array().cast(lines.schema["size"].dataType).alias("size"))
    id_type = docs.schema[id_col].dataType.simpleString()
    both = later.unionByName(earlier).repartition("id", "digest").sortWithinPartitions("id", "digest", "owner")
    cut = both.mapInArrow(_aligner(min_line), f"id {id_type}, digest long, cut array<int>")
    return cut.groupBy("id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))


def _with_cuts(docs: DataFrame, id_col: str, text_col: str, min_line: int, rare: float) -> DataFrame:
    """``row`` (a struct of the row's columns), ``cut`` (null: nothing) and ``kept``, the text that is left."""
    cut = deletions(docs, min_line, rare, id_col, text_col)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row")[text_col]
    digest = F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
    joined = row.join(cut, F.col("row")[id_col].eqNullSafe(F.col("id")) & (digest == F.col("digest")), "left")
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("cut"))
    return joined.select("row", "cut", F.when(F.col("cut").isNotNull(), F.split(text, "\n")).alias("lines")).select(
        "row", "cut", F.when(F.col("cut").isNull(), text).otherwise(
            F.array_join(F.transform(rest, lambda k: F.get("lines", k)), "\n")).alias("kept"))


def dedup_lines(docs: DataFrame, min_line: int = 20, rare: float = 0.2, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``id_col, n_lines, n_removed, removed_lines, kept_text`` per row."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cut, text = F.coalesce("cut", F.array().cast("array<int>")), F.col("row.text")
    n_lines = F.when(F.length(text) > 0, F.size(F.split(text, "\n"))).otherwise(0)
    return _with_cuts(narrow, "id", "text", min_line, rare).select(
        F.col("row.id").alias(id_col), n_lines.cast("long").alias("n_lines"), F.size(cut).cast("long").alias("n_removed"),
        F.array_sort(cut).alias("removed_lines"), F.col("kept").alias("kept_text"))


def remove_lines(docs: DataFrame, min_line: int = 20, rare: float = 0.2, id_col: str = "doc_id",
                 text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows without the deleted lines, in the columns of ``docs``; rows that lose their last word go, and
    ``length_col``, where the table has it, follows the text."""
    changed = F.col("cut").isNotNull()
    left = _with_cuts(docs, id_col, text_col, min_line, rare).filter(
        ~changed | (F.length(F.translate("kept", WHITE, "")) > 0))

    def column(c: str):
        if c == text_col:
            return F.col("kept").alias(c)
        if c == length_col:
            return F.when(changed, F.length("kept").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]).alias(c)
        return F.col("row")[c].alias(c)

    return left.select(*[column(c) for c in docs.columns])
