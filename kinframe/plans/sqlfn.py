"""SQL-text twins of the column functions, for the DuckDB oracle only.

They restate the same rules in plain SQL (regexp_extract / json_extract_string
/ CASE), independently of the DataFrame code, so the oracle checks it.
"""

from __future__ import annotations

from kinframe.functions.params import (ARCH_KEYS, CARD_PATTERNS, DATE_KEYS, ISO_TS, MULTIPLIERS, NXM,
                                       PARAM_KEYS, PRECISION_PATTERNS, SAFETENSOR_DTYPES, SUFFIXED)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mult(x: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in MULTIPLIERS.items())
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 1.0 ELSE (CASE {x} {whens} ELSE 1.0 END) END)"


def parse_number(x: str) -> str:
    t = f"lower(replace(trim({x}), ',', ''))"
    nxm = (f"CAST(regexp_extract({t}, {q(NXM)}, 1) AS DOUBLE) * CAST(regexp_extract({t}, {q(NXM)}, 2) AS DOUBLE)"
           f" * {mult(f'regexp_extract({t}, {q(NXM)}, 3)')}")
    suf = f"CAST(regexp_extract({t}, {q(SUFFIXED)}, 1) AS DOUBLE) * {mult(f'regexp_extract({t}, {q(SUFFIXED)}, 2)')}"
    v = (f"(CASE WHEN regexp_matches({t}, {q(NXM)}) THEN {nxm} WHEN regexp_matches({t}, {q(SUFFIXED)}) THEN {suf}"
         f" ELSE TRY_CAST({t} AS DOUBLE) END)")
    return f"(CASE WHEN isnan({v}) THEN NULL ELSE {v} END)"


def params_from_card(c: str) -> str:
    out = "CAST(NULL AS DOUBLE)"
    for p in reversed(CARD_PATTERNS):
        rx = q("(?i)" + p)
        hit = parse_number(f"regexp_extract({c}, {rx}, 1)")
        out = f"(CASE WHEN regexp_matches({c}, {rx}) AND {hit} IS NOT NULL THEN {hit} ELSE {out} END)"
    return out


def params_from_id(i: str) -> str:
    s = f"lower({i})"
    rx = q(r"(\d+(?:\.\d+)?)([bkmg])")
    first = f"CAST(regexp_extract({s}, {rx}, 1) AS DOUBLE) * {mult(f'regexp_extract({s}, {rx}, 2)')}"
    nxm = (f"CAST(regexp_extract({s}, {q(NXM)}, 1) AS DOUBLE) * CAST(regexp_extract({s}, {q(NXM)}, 2) AS DOUBLE)"
           f" * {mult(f'regexp_extract({s}, {q(NXM)}, 3)')}")
    return f"(CASE WHEN regexp_matches({s}, {rx}) THEN {first} WHEN regexp_matches({s}, {q(NXM)}) THEN {nxm} END)"


def json_obj(x: str) -> str:
    """The text if it is a JSON object, else the quote/comma-repaired text if that is one."""
    t = f"trim({x})"
    fixed = f"regexp_replace(replace(replace({t}, '\"\"', '\"'), '''', '\"'), ',(\\s*[}}\\]])', '\\1', 'g')"
    return (f"(CASE WHEN json_valid({t}) AND json_type({t}) = 'OBJECT' THEN {t} "
            f"WHEN json_valid({fixed}) AND json_type({fixed}) = 'OBJECT' THEN {fixed} END)")


def params_from_metadata(m: str) -> str:
    d = json_obj(m)
    tries = []
    for k in PARAM_KEYS:
        v = f"json_extract_string({d}, {q('$.' + k)})"
        tries.append(f"(CASE WHEN json_type({d}, {q('$.' + k)}) = 'OBJECT' THEN "
                     f"{parse_number(f'json_extract_string({v}, json_keys({v})[1])')} ELSE {parse_number(v)} END)")
    tries.append(parse_number(f"json_extract_string({d}, '$.safetensors.total')"))
    tries += [parse_number(f"json_extract_string({d}, {q('$.safetensors.parameters.' + t)})")
              for t in SAFETENSOR_DTYPES]
    # nested objects: the first number under any of the keys, wherever it lies
    found = "list_concat(" + ", ".join(f"json_extract_string({d}, {q('$..' + k)})" for k in PARAM_KEYS) + ")"
    tries.append(f"list_filter(list_transform({found}, lambda x: {parse_number('x')}), lambda x: x IS NOT NULL)[1]")
    return "coalesce(" + ", ".join(tries) + ")"


def precision(m: str, card: str, mid: str) -> str:
    d = json_obj(m)
    anyp = q("(?i)(" + "|".join(PRECISION_PATTERNS) + ")")
    pats = "[" + ", ".join(q(p.upper()) for p in PRECISION_PATTERNS) + "]"
    by_key = [f"(CASE WHEN regexp_matches(json_extract_string({d}, {q('$.' + k)}), {anyp}) THEN upper(json_extract_string({d}, {q('$.' + k)})) END)"
              for k in ["precision", "dtype"]]
    st = f"json_keys({d}, '$.safetensors.parameters')"
    st_hit = f"list_filter(list_transform({st}, lambda k: upper(k)), lambda k: list_contains({pats}, k))[1]"
    rx = q("(?i)(bf16|f16|fp16|f32|fp32|float16|float32)")
    card_hit = f"(CASE WHEN regexp_matches({card}, {rx}) THEN upper(regexp_extract({card}, {rx}, 1)) END)"
    id_hit = f"(CASE WHEN regexp_matches({mid}, {rx}) THEN upper(regexp_extract({mid}, {rx}, 1)) END)"
    return "coalesce(" + ", ".join(by_key + [st_hit, card_hit, id_hit, "'Unknown'"]) + ")"


def architecture(m: str) -> str:
    t = f"trim({m})"
    vals = ", ".join(f"json_extract_string({t}, {q('$.' + k)})" for k in ARCH_KEYS)
    return f"(CASE WHEN json_valid({t}) AND json_type({t}) = 'OBJECT' THEN coalesce({vals}, 'Unknown') ELSE 'Unknown' END)"


def naive_ts(iso: str) -> str:
    local = f"regexp_extract({iso}, {q(r'^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)')}, 1)"
    return f"TRY_CAST(nullif(replace({local}, 'T', ' '), '') AS TIMESTAMP)"


def date_from_metadata(m: str, date_type: str = "created_at") -> str:
    t = f"trim({m})"
    obj = f"(CASE WHEN json_valid({t}) AND json_type({t}) = 'OBJECT' THEN {t} END)"
    keyed = [naive_ts(f"json_extract_string({obj}, {q('$.' + k)})") for k in DATE_KEYS[date_type]]
    found = naive_ts(f"nullif(regexp_extract({t}, {q(ISO_TS)}, 0), '')")
    return "coalesce(" + ", ".join(keyed + [found]) + ")"
