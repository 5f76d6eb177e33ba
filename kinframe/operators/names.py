"""Which names occur inside any of a set of texts, without comparing every name with every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.functions.common import wide

#: Length of the grams; texts of one gram in a group before the group is split.
GRAM, GROUP = 6, 4096


def _pieces(text: str, length: Column) -> Column:
    """All distinct substrings of ``text`` of a length."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - length + 1), lambda i: F.substring(F.col(text), i, length)))


def contained_names(names: DataFrame, texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """The distinct ``name``s that are a substring of some ``text`` (equality included); nulls are neither.

    A name of at least ``gram`` characters looks for texts by its rarest gram only (none of the texts has one of its
    grams: not contained) and is verified; a gram that many texts share is dealt by a hash of the texts. A shorter name
    must equal a substring of its length. The empty name is contained wherever there is a text.
    """
    names, texts = names.select("name").where("name IS NOT NULL").distinct(), texts.select("text").where("text IS NOT NULL").distinct()
    size = F.lit(gram)
    index = texts.where(F.length("text") >= gram).select("text", F.explode(_pieces("text", size)).alias("g"))
    frequency = index.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    own = names.where(F.length("name") >= gram).select("name", F.explode(_pieces("name", size)).alias("g"))
    rarest = own.join(wide(frequency), "g", "left").groupBy("name").agg(
        F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), F.col("g"))).alias("g"), F.min(F.coalesce("df", F.lit(0))).alias("df")).where("df > 0")
    salts = F.ceil(F.col("df") / GROUP).cast("int")
    asks = rarest.select("name", "g", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    held = index.join(wide(frequency), "g").select("g", "text", F.pmod(F.xxhash64("text"), salts).cast("int").alias("salt"))
    long = asks.join(wide(held), ["g", "salt"]).where(F.col("text").contains(F.col("name"))).select("name")
    lengths = F.sequence(F.lit(1), F.least(F.length("text"), F.lit(gram - 1)))
    suffixes = texts.where(F.length("text") > 0).select(F.explode(F.flatten(F.transform(lengths, lambda n: F.transform(
        F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substring(F.col("text"), i, n))))).alias("name")).distinct()
    short = names.where(F.length("name").between(1, gram - 1)).join(wide(suffixes), "name", "left_semi")
    empty = names.where("name = ''").join(texts.limit(1), F.lit(True), "left_semi")  # one row against one row
    return long.unionByName(short).unionByName(empty).distinct()
