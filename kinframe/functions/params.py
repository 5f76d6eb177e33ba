"""Parameter counts, precision, architecture and dates from ids, cards and JSON.

Every function maps Columns to a Column with built-in expressions (regex,
JSON path, CASE), so the work stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.functions.common import col

# Multipliers of number suffixes.
MULTIPLIERS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6,
               "b": 1e9, "billion": 1e9, "g": 1e9, "giga": 1e9}
# Metadata keys holding a parameter count, in lookup order.
PARAM_KEYS = ["parameters", "num_parameters", "total_parameters", "n_parameters", "size", "model_size"]
# Safetensors dtype keys tried in order.
SAFETENSOR_DTYPES = ["F32", "BF16", "I64"]
# Floating point formats recognised as precision.
PRECISION_PATTERNS = ["bf16", "f16", "fp16", "f32", "fp32", "float16", "float32"]
# Metadata keys naming the architecture, in lookup order.
ARCH_KEYS = ["architecture", "model_type", "model_architecture", "library_name"]
# Key aliases of creation / modification dates, in lookup order.
DATE_KEYS = {"created_at": ["created_at", "model_created_at", "createdAt", "modelCreatedAt"],
             "last_modified": ["last_modified", "model_last_modified", "lastModified", "modelLastModified"]}
# Ordered card patterns for a parameter count (case-insensitive).
CARD_PATTERNS = [
    r"parameters:\s*(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?[BKMkmb]?)",
    r"Total parameters:\s*(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?[BKMkmb]?)",
    r"~?(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?[BKMkmb]?)\s*parameters?",
    r"Params:\s*(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?[BKMkmb]?)",
    r"[A-Za-z0-9_-]+-(\d+(?:\.\d+)?[BKMkmb])\b",
    r"(\d+x\d+[BKMkmb]?)",
    r'"num_parameters":\s*(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?[BKMkmb]?)',
]
# Forms of a number text and of a time stamp.
NXM = r"^(\d+)x(\d+)([bkmg])?$"
SUFFIXED = r"^(\d+(?:\.\d+)?)\s*(thousand|million|billion|k|m|b|g)?$"
ISO_TS = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?"


def multiplier(suffix: Column) -> Column:
    """Suffix → factor by one literal-map lookup (1.0 when absent/unknown)."""
    table = F.create_map(*[x for k, v in MULTIPLIERS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, suffix), F.lit(1.0))


# The parsers below are staged DataFrame transforms: each stage is a select
# whose outputs the next stage references by name. Catalyst does not inline a
# non-trivial alias that is used more than once, so every regex / JSON lookup
# runs once per row instead of once per reference.

def parse_numbers(df: DataFrame, sources: dict[str, Column], keep=None) -> DataFrame:
    """Add one double column per ``name -> text`` (see ``parse_suffixed_number``)."""
    keep = list(df.columns) if keep is None else keep
    names = list(sources)
    s1 = df.select(*keep, *[F.lower(F.regexp_replace(F.trim(c.cast("string")), ",", "")).alias(f"_t_{n}")
                            for n, c in sources.items()])
    parts = []
    for n in names:
        t = F.col(f"_t_{n}")
        parts += [t.rlike(NXM).alias(f"_isx_{n}"), t.rlike(SUFFIXED).alias(f"_iss_{n}"),
                  F.regexp_extract(t, NXM, 1).alias(f"_x1_{n}"), F.regexp_extract(t, NXM, 2).alias(f"_x2_{n}"),
                  F.regexp_extract(t, NXM, 3).alias(f"_x3_{n}"), F.regexp_extract(t, SUFFIXED, 1).alias(f"_s1_{n}"),
                  F.regexp_extract(t, SUFFIXED, 2).alias(f"_s2_{n}"), t.try_cast("double").alias(f"_p_{n}")]
    s2 = s1.select(*keep, *parts)
    vals = []
    for n in names:
        v = (F.when(F.col(f"_isx_{n}"), F.col(f"_x1_{n}").cast("double") * F.col(f"_x2_{n}").cast("double")
                    * multiplier(F.col(f"_x3_{n}")))
             .when(F.col(f"_iss_{n}"), F.col(f"_s1_{n}").cast("double") * multiplier(F.col(f"_s2_{n}")))
             .otherwise(F.col(f"_p_{n}")))
        vals.append(v.alias(f"_v_{n}"))
    s3 = s2.select(*keep, *vals)
    return s3.select(*keep, *[F.nanvl(F.col(f"_v_{n}"), F.lit(None).cast("double")).alias(n) for n in names])


def parse_suffixed_number(df: DataFrame, text: str | Column, out: str = "value") -> DataFrame:
    """'7b' → 7e9, '1.5 million' → 1.5e6, '8x7b' → 5.6e10, '1,234' → 1234,
    '1e9' → 1e9; anything else → null."""
    return parse_numbers(df, {out: col(text)})


def params_from_card(df: DataFrame, card: str, out: str = "params", patterns=CARD_PATTERNS) -> DataFrame:
    """First pattern (in order) whose match parses to a number."""
    keep = list(df.columns)
    c = F.col(card)
    srcs = {f"_pc{i}": F.when(c.rlike("(?i)" + p), F.regexp_extract(c, "(?i)" + p, 1))
            for i, p in enumerate(patterns)}
    parsed = parse_numbers(df, srcs, keep)
    return parsed.select(*keep, F.coalesce(*[F.col(n) for n in srcs]).alias(out))


def params_from_id(model_id: str | Column) -> Column:
    """First number+[bkmg] in the id, else an NxM[suffix] id."""
    s = F.lower(col(model_id))
    rx = r"(\d+(?:\.\d+)?)([bkmg])"
    first = F.regexp_extract(s, rx, 1).cast("double") * multiplier(F.regexp_extract(s, rx, 2))
    nxm = (F.regexp_extract(s, NXM, 1).cast("double") * F.regexp_extract(s, NXM, 2).cast("double")
           * multiplier(F.regexp_extract(s, NXM, 3)))
    return F.when(s.rlike(rx), first).when(s.rlike(NXM), nxm)


def json_doc(text: str | Column) -> Column:
    """The JSON text itself when it parses as an object; otherwise the text
    with Python-style quotes and trailing commas repaired (null if that fails)."""
    t = F.trim(col(text))
    ok = F.from_json(t, "map<string,string>").isNotNull()
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, '""', '"'), "'", '"'), r",(\s*[}\]])", "$1")
    ok2 = F.from_json(fixed, "map<string,string>").isNotNull()
    return F.when(ok, t).when(ok2, fixed)


def number_of(text: Column) -> Column:
    """``parse_numbers`` of one text as a single expression, for use inside array functions."""
    t = F.lower(F.regexp_replace(F.trim(text), ",", ""))
    nxm = F.regexp_extract(t, NXM, 1).cast("double") * F.regexp_extract(t, NXM, 2).cast("double") * multiplier(F.regexp_extract(t, NXM, 3))
    suffixed = F.regexp_extract(t, SUFFIXED, 1).cast("double") * multiplier(F.regexp_extract(t, SUFFIXED, 2))
    value = F.when(t.rlike(NXM), nxm).when(t.rlike(SUFFIXED), suffixed).otherwise(t.try_cast("double"))
    return F.nanvl(value, F.lit(None).cast("double"))


_MAP = "map<string,string>"


def nested_numbers(doc: Column) -> Column:
    """The texts that can hold a parameter count, in order of search, from a JSON object of any depth: the values under
    the ordered keys (an object stands for its values, depth first), then ``safetensors``, then the same for every nested
    object, depth first in document order.

    A stack machine in one fold: ``o`` entries are objects to search, ``v`` entries are values to read. Every pair of
    the document is pushed twice at most, which bounds the number of steps by its colons and braces.
    """
    def is_object(x: Column) -> Column:
        return x.startswith("{")

    def marked(kind: str, texts: Column) -> Column:
        return F.transform(F.filter(texts, lambda x: x.isNotNull()), lambda x: F.concat(F.lit(kind), x))

    def search(text: Column) -> Column:
        m = F.from_json(text, _MAP)
        safe = F.from_json(F.try_element_at(m, F.lit("safetensors")), _MAP)
        dtypes = F.from_json(F.try_element_at(safe, F.lit("parameters")), _MAP)
        scalars = F.array(F.try_element_at(safe, F.lit("total")), *[F.try_element_at(dtypes, F.lit(t)) for t in SAFETENSOR_DTYPES])
        return F.concat(marked("v", F.array(*[F.try_element_at(m, F.lit(k)) for k in PARAM_KEYS])),
                        marked("v", F.filter(scalars, lambda x: ~is_object(x))),
                        marked("o", F.filter(F.map_values(m), is_object)))

    none = F.array().cast("array<string>")

    def step(state: Column, _: Column) -> Column:
        top, rest = F.try_element_at(state["stack"], F.lit(1)), F.slice(state["stack"], 2, 1 << 30)
        text, value = F.substring(top, 2, 1 << 30), top.startswith("v")
        push = F.when(value & is_object(text), marked("v", F.map_values(F.from_json(text, _MAP)))).when(
            value, none).otherwise(search(text))
        found = F.when(value & ~is_object(text), F.array(text)).otherwise(none)
        return F.when(top.isNull(), state).otherwise(F.struct(
            F.concat(F.coalesce(push, none), rest).alias("stack"), F.concat(state["found"], found).alias("found")))

    steps = 2 * (F.length(doc) - F.length(F.replace(F.replace(doc, F.lit(":")), F.lit("{")))) + 1
    start = F.struct(F.array(F.concat(F.lit("o"), doc)).alias("stack"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["found"])


def params_from_metadata(df: DataFrame, metadata: str, out: str = "params") -> DataFrame:
    """Ordered keys → safetensors.total → safetensors.parameters.{F32,BF16,I64} → the same in nested objects, depth
    first in document order; an object under a key stands for its values.

    Documents whose own keys answer with plain values are read by path; only the others are searched (``nested_numbers``).
    """
    keep = list(df.columns)
    d = df.select(*keep, json_doc(F.col(metadata)).alias("_doc"))
    raw = [F.get_json_object("_doc", f"$.{k}").alias(f"_r{i}") for i, k in enumerate(PARAM_KEYS)]
    d = d.select(*keep, "_doc", *raw)
    keys = {f"_m{i}": F.col(f"_r{i}") for i, _ in enumerate(PARAM_KEYS)}
    srcs = {**keys, "_mt": F.get_json_object("_doc", "$.safetensors.total"),
            **{f"_md{t}": F.get_json_object("_doc", f"$.safetensors.parameters.{t}") for t in SAFETENSOR_DTYPES}}
    objects = [F.coalesce(F.col(f"_r{i}").startswith("{"), F.lit(False)) for i, _ in enumerate(PARAM_KEYS)]
    deep = F.col("_doc").rlike(r"(?s)^\s*\{.*\{")
    d = d.select(*keep, "_doc", *[F.col(f"_r{i}") for i, _ in enumerate(PARAM_KEYS)],
                 F.greatest(*objects).alias("_obj"), deep.alias("_deep"))
    parsed = parse_numbers(d, srcs, [*keep, "_doc", "_obj", "_deep"]).select(
        *keep, "_doc", "_obj", "_deep", F.coalesce(*[F.col(n) for n in srcs]).alias("_flat"))
    search = F.col("_deep") & (F.col("_obj") | F.col("_flat").isNull())
    hits = F.when(search, F.transform(nested_numbers(F.col("_doc")), number_of))
    first = F.try_element_at(F.filter(hits, lambda x: x.isNotNull()), F.lit(1))
    return parsed.select(*keep, F.when(search, first).otherwise(F.col("_flat")).alias(out))


def params_coalesced(df: DataFrame, metadata: str, card: str, model_id: str) -> DataFrame:
    """Adds ``parameters`` and ``parameter_source`` ∈ metadata/card/model_id/unknown."""
    keep = list(df.columns)
    x = params_from_metadata(df, metadata, "_pm")
    x = params_from_card(x, card, "_pcard")
    x = x.select(*keep, "_pm", "_pcard", params_from_id(F.col(model_id)).alias("_pid"))
    src = (F.when(F.col("_pm").isNotNull(), "metadata").when(F.col("_pcard").isNotNull(), "card")
           .when(F.col("_pid").isNotNull(), "model_id").otherwise("unknown"))
    return x.select(*keep, F.coalesce("_pm", "_pcard", "_pid").alias("parameters"), src.alias("parameter_source"))


def precision_from_sources(df: DataFrame, metadata: str, card: str, model_id: str,
                           out: str = "precision") -> DataFrame:
    keep = list(df.columns)
    d = df.select(*keep, json_doc(F.col(metadata)).alias("_doc"))
    pats = F.array(*[F.lit(p.upper()) for p in PRECISION_PATTERNS])
    any_pat = "(?i)(" + "|".join(PRECISION_PATTERNS) + ")"
    d = d.select(*keep, "_doc", F.get_json_object("_doc", "$.precision").alias("_kp"),
                 F.get_json_object("_doc", "$.dtype").alias("_kd"),
                 F.map_keys(F.from_json(F.get_json_object("_doc", "$.safetensors.parameters"),
                                        "map<string,string>")).alias("_stk"),
                 F.flatten(F.transform(
                     F.filter(F.map_values(F.from_json("_doc", "map<string,string>")), lambda x: x.startswith("{")),
                     lambda x: F.map_keys(F.from_json(x, "map<string,string>")))).alias("_nk"))
    by_key = [F.when(F.col(k).rlike(any_pat), F.upper(F.col(k))) for k in ["_kp", "_kd"]]
    st_hit = F.try_element_at(F.filter(F.transform("_stk", lambda k: F.upper(k)),
                                       lambda k: F.array_contains(pats, k)), F.lit(1))
    nested_hit = F.try_element_at(F.filter(F.transform("_nk", lambda k: F.upper(k)),
                                           lambda k: F.array_contains(pats, k)), F.lit(1))
    rx = "(?i)(bf16|f16|fp16|f32|fp32|float16|float32)"
    card_hit = F.when(F.col(card).rlike(rx), F.upper(F.regexp_extract(F.col(card), rx, 1)))
    id_hit = F.when(F.col(model_id).rlike(rx), F.upper(F.regexp_extract(F.col(model_id), rx, 1)))
    return d.select(*keep, F.coalesce(*by_key, st_hit, nested_hit, card_hit, id_hit, F.lit("Unknown")).alias(out))


def architecture_from_metadata(metadata: str | Column) -> Column:
    t = F.trim(col(metadata))
    ok = F.from_json(t, "map<string,string>").isNotNull()
    vals = [F.get_json_object(t, f"$.{k}") for k in ARCH_KEYS]
    return F.when(ok, F.coalesce(*vals, F.lit("Unknown"))).otherwise(F.lit("Unknown"))


def _naive_ts(iso: Column) -> Column:
    """ISO text → local date-time part as timestamp_ntz (offset dropped)."""
    local = F.regexp_extract(iso, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1)
    return F.to_timestamp_ntz(F.nullif(F.regexp_replace(local, "T", " "), F.lit("")))


def date_from_metadata(metadata: str | Column, date_type: str = "created_at") -> Column:
    """By key alias order in JSON, else the first ISO timestamp in the text."""
    t = F.trim(col(metadata))
    ok = F.from_json(t, "map<string,string>").isNotNull()
    keyed = [F.when(ok, _naive_ts(F.get_json_object(t, f"$.{k}"))) for k in DATE_KEYS[date_type]]
    found = _naive_ts(F.nullif(F.regexp_extract(t, ISO_TS, 0), F.lit("")))
    return F.coalesce(*keyed, found)
