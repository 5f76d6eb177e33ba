"""Identifier and tag-list column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinframe.functions.common import col

# Tag prefixes expanded into their own list columns.
TAG_PREFIXES = {"regions": "region:", "licenses": "license:", "arxiv_papers": "arxiv:", "datasets": "dataset:"}
# Typed base-model tag prefixes, by relation.
PARENT_PREFIXES = {"finetune_parent": "base_model:finetune:", "quantized_parent": "base_model:quantized:",
                   "adapter_parent": "base_model:adapter:", "merge_parent": "base_model:merge:"}


def with_prefix(tags, prefix: str) -> Column:
    """Tags starting with ``prefix``, prefix removed."""
    return F.transform(F.filter(col(tags), lambda x: x.startswith(prefix)),
                       lambda x: F.replace(x, F.lit(prefix), F.lit("")))


def generic_parents(tags) -> Column:
    """``base_model:<id>`` tags with exactly one colon."""
    return F.transform(
        F.filter(col(tags), lambda x: x.startswith("base_model:") & (F.size(F.split(x, ":")) == 2)),
        lambda x: F.substring(x, len("base_model:") + 1, 1 << 30))


def typed_parents(tags, prefix: str) -> Column:
    return F.transform(F.filter(col(tags), lambda x: x.startswith(prefix)),
                       lambda x: F.substring(x, len(prefix) + 1, 1 << 30))


def lookup_list(arr, mapping: dict[str, str]) -> Column:
    """Keep elements present in a small fixed dictionary, mapped to their value
    (a literal map: no join, no shuffle)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.filter(F.transform(col(arr), lambda x: F.try_element_at(m, x)), lambda x: x.isNotNull())


def normalize_name(c) -> Column:
    return F.translate(F.lower(F.trim(col(c))), "-/_", "")


def model_type_token(model_id) -> Column:
    last = F.element_at(F.split(col(model_id), "/"), -1)
    return F.split(last, "-").getItem(0)


def parse_list_text(c) -> Column:
    """Python-literal list / JSON list / comma text / scalar → array<string>;
    empty for null, '', '[]' or unparsable."""
    s = F.trim(col(c))
    inner = F.regexp_replace(s, r"^\[|\]$", "")
    items = F.regexp_extract_all(inner, F.lit(r"""\s*('[^']*'|"[^"]*"|[^,]+)"""), 1)  # a comma in quotes splits nothing
    bracket = F.transform(items, lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    plain = F.transform(F.split(s, ","), lambda x: F.trim(x))
    arr = F.when(s.startswith("[") & s.endswith("]"), bracket).otherwise(plain)
    empty = F.array().cast("array<string>")
    return F.when(s.isNull() | (s == "") | (s == "[]"), empty).otherwise(F.filter(arr, lambda x: x != ""))
