"""Text column functions: card statistics, cleaning, licenses, languages, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinframe.functions.common import col

# Phrases marking an automatically generated card.
AUTO_PHRASES = ["automatically generated", "generated automatically"]
# Full-width / CJK punctuation and its ASCII replacement.
FULLWIDTH_MAP = [("・", "."), ("ー", "-"), ("（", "("), ("）", ")"), ("：", ":"), ("、", ","), ("。", "."),
                 ("「", '"'), ("」", '"'), ("『", '"'), ("』", '"'), ("【", "["), ("】", "]"), ("［", "["),
                 ("］", "]"), ("／", "/"), ("～", "~"), ("！", "!"), ("？", "?"), ("；", ";"), ("＆", "&"),
                 ("＠", "@"), ("＃", "#"), ("＄", "$"), ("％", "%"), ("＾", "^"), ("＊", "*"), ("＋", "+"),
                 ("＝", "="), ("｜", "|"), ("＜", "<"), ("＞", ">"), ("｛", "{"), ("｝", "}"), ("｢", "["),
                 ("｣", "]"), ("､", ","), ("･", "."), ("ｰ", "-"), ("ﾞ", '"'), ("ﾟ", '"'), ("　", " ")]
# Patterns of secrets in cards.
SECRET_PATTERNS = [r"hf_[a-zA-Z0-9]{30,}", r"sk-[a-zA-Z0-9]{20,}", r"(?i)api[_-]?key.{0,10}[=:].{10,}"]
# An access token as the given documents have it: for callers that add it to the patterns.
TOKEN_PATTERN = r'token = "[0-9a-f]{40}"'
# License card patterns in order (case-insensitive).
LICENSE_PATTERNS = [r"license:\s*([^\n]+)", r"license:\s*\[?([^\]]+)\]?", r"license type:\s*([^\n]+)"]
# Substrings that make a license permissive.
PERMISSIVE = ["mit", "bsd", "apache-2.0", "openrail"]
# Labels of a last-modified date in a card, in order.
LAST_MODIFIED_PATTERNS = [r"last modified:\s*(\d{4}-\d{2}-\d{2})", r"last_modified:\s*(\d{4}-\d{2}-\d{2})",
                          r"last updated:\s*(\d{4}-\d{2}-\d{2})", r"last_updated:\s*(\d{4}-\d{2}-\d{2})"]
# The language block of a card.
LANGUAGE_BLOCK = r"language:\s*(\[[^\]]*\]|(?:\s*-\s*[a-z]{2}[\-\w]*\s*)+)"


def strip_ws(c: Column) -> Column:
    """Python-style strip (all Unicode whitespace, not just spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squash_ws(c: Column) -> Column:
    """' '.join(text.split())."""
    return strip_ws(F.regexp_replace(c, r"\s+", " "))


def card_length_chars(card) -> Column:
    return F.length(F.coalesce(col(card), F.lit("nan")))


def card_length_words(card) -> Column:
    c = strip_ws(F.coalesce(col(card), F.lit("nan")))
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, r"\s+")))


def auto_generated(card, phrases=AUTO_PHRASES) -> Column:
    low = F.lower(F.coalesce(col(card), F.lit("nan")))
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def clean_text(c) -> Column:
    t = squash_ws(col(c))
    # every mapping is one character to one character: a single translate pass
    t = F.translate(t, "".join(a for a, _ in FULLWIDTH_MAP), "".join(b for _, b in FULLWIDTH_MAP))
    t = F.regexp_replace(t, r"[^\x00-\x7F]", "")
    return F.when(col(c).isNull(), F.lit("Unknown")).otherwise(squash_ws(t))


def truncate_text(c, n: int, ellipsis: str = "always") -> Column:
    """First n characters; '...' appended always, only when longer, or never."""
    s = F.substring(col(c), 1, n)
    if ellipsis == "always":
        return F.concat(s, F.lit("..."))
    if ellipsis == "if_longer":
        return F.when(F.length(col(c)) > n, F.concat(s, F.lit("..."))).otherwise(col(c))
    return s


def secret_flag(text, patterns=SECRET_PATTERNS) -> Column:
    """True when any secret pattern occurs (one combined regex pass)."""
    return F.coalesce(col(text).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def license_from_card(card) -> Column:
    c = col(card)
    out = F.lit("unknown")
    for p in reversed(LICENSE_PATTERNS):
        rx = "(?i)" + p
        out = F.when(c.rlike(rx), strip_ws(F.regexp_extract(c, rx, 1))).otherwise(out)
    return F.when(c.isNull(), F.lit("unknown")).otherwise(out)


def license_class(lic) -> Column:
    low = F.lower(col(lic))
    perm = F.lit(False)
    for p in PERMISSIVE:
        perm = perm | low.contains(p)
    return F.when(col(lic).isNull(), "unknown").when(perm, "permissive").otherwise("noncommercial")


def last_modified_from_card(card) -> Column:
    c = col(card)
    out = F.lit(None).cast("date")
    for p in reversed(LAST_MODIFIED_PATTERNS):
        rx = "(?i)" + p
        out = F.when(c.rlike(rx), F.to_date(F.regexp_extract(c, rx, 1))).otherwise(out)
    return out


def languages_from_card(card) -> Column:
    """YAML ``language:`` block (inline list or dashed lines) → array of codes."""
    rx = "(?i)" + LANGUAGE_BLOCK
    block = strip_ws(F.regexp_extract(col(card), rx, 1))
    inline = F.transform(F.split(F.regexp_replace(block, r"^\[|\]$", ""), ","),
                         lambda x: F.regexp_replace(strip_ws(x), "^['\"]|['\"]$", ""))
    inline = F.filter(inline, lambda x: x != "")
    lines = F.filter(F.split(block, "\n"), lambda x: strip_ws(x).startswith("-"))
    dashed = F.transform(lines, lambda x: strip_ws(F.regexp_replace(x, r"^\s*-\s*", "")))
    empty = F.array().cast("array<string>")
    return (F.when(~col(card).rlike(rx) | col(card).isNull(), empty)
            .when(block.startswith("["), inline).otherwise(dashed))


def words(text, pattern: str = r"(?U)\w\w+") -> Column:
    """Tokens of ≥2 word characters (Unicode), lower-cased."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(pattern), 0)
