"""Document / card / page keys (§2.1 html, §2.2 text, §2.3 filters, §2.4 card join)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinframe.functions import text as X
from kinframe.functions.common import r6
from kinframe.functions.dictionaries import LANGUAGES, SUBJECTS
from kinframe.plans.catalog import LANG_SQL
from kinframe.plans.registry import query
from kinframe.plans.sqlfn import q
from kinframe.sources import bindings as b
from kinframe.sources.tables import Tables

WS_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip_sql(x):
    return WS_STRIP.format(x=x)


def docs(t: Tables):
    return t.documents.select("doc_id", "text", "lang", "source", "n_chars")


@query("card_stats", sql=f"""SELECT doc_id, CAST(length(coalesce(text, 'nan')) AS INTEGER) AS model_card_length_characters,
  CAST(CASE WHEN {strip_sql("coalesce(text, 'nan')")} = '' THEN 0 ELSE len(string_split_regex({strip_sql("coalesce(text, 'nan')")}, '\\s+')) END AS INTEGER) AS model_card_length_words,
  (contains(lower(coalesce(text, 'nan')), 'automatically generated') OR contains(lower(coalesce(text, 'nan')), 'generated automatically')) AS model_card_automatically_generated
FROM documents""")
def q_card_stats(t: Tables):
    d = docs(t)
    return d.select("doc_id", X.card_length_chars("text").alias("model_card_length_characters"),
                    X.card_length_words("text").alias("model_card_length_words"),
                    X.auto_generated("text").alias("model_card_automatically_generated"))


def _clean_sql(x):
    s = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    s = strip_sql(s)
    for a, c in X.FULLWIDTH_MAP:
        s = f"replace({s}, {q(a)}, {q(c)})"
    s = f"regexp_replace({s}, '[^\\x00-\\x7F]', '', 'g')"
    s = strip_sql(f"regexp_replace({s}, '\\s+', ' ', 'g')")
    return f"CASE WHEN {x} IS NULL THEN 'Unknown' ELSE {s} END"


@query("clean_text", sql=f"SELECT doc_id, {_clean_sql('text')} AS clean FROM documents")
def q_clean_text(t: Tables):
    return docs(t).select("doc_id", X.clean_text("text").alias("clean"))


@query("truncate_text", sql="""SELECT doc_id, substr(text, 1, 30) || '...' AS label,
  CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS abstract, substr(text, 1, 512) AS card_head
FROM documents""")
def q_truncate_text(t: Tables):
    d = docs(t)
    return d.select("doc_id", X.truncate_text("text", 30, "always").alias("label"),
                    X.truncate_text("text", 500, "if_longer").alias("abstract"),
                    X.truncate_text("text", 512, "never").alias("card_head"))


#: The patterns of secrets and the form of access tokens in the given documents.
SECRETS = X.SECRET_PATTERNS + [X.TOKEN_PATTERN]
_SECRET_RX = "|".join(f"(?:{p})" for p in SECRETS)


@query("secret_filter", sql=f"""SELECT doc_id, source, coalesce(regexp_matches(text, {q(_SECRET_RX)}), false) AS excluded FROM documents""")
def q_secret_filter(t: Tables):
    """Every card with its verdict."""
    d = docs(t)
    return d.select("doc_id", "source", X.secret_flag("text", SECRETS).alias("excluded"))


@query("eligible_cards", sql="""SELECT doc_id, substr(text, 1, 512) AS clean_text FROM documents
WHERE text IS NOT NULL AND length(text) >= 512
  AND NOT (contains(lower(text), 'automatically generated') OR contains(lower(text), 'generated automatically'))""")
def q_eligible_cards(t: Tables):
    d = docs(t)
    return (d.where(F.col("text").isNotNull() & (F.length("text") >= 512) & ~X.auto_generated("text"))
            .select("doc_id", F.substring("text", 1, 512).alias("clean_text")))


@query("missing_cards", sql=b.with_views(
    """SELECT c.id, c.model_id FROM cat c LEFT JOIN documents d ON d.doc_id = c.id
WHERE d.text IS NULL OR trim(d.text) = '' OR d.text = 'N/A'""", "cat"))
def q_missing_cards(t: Tables):
    from kinframe.sources import bindings as bb
    c = bb.cat(t).select("id", "model_id")
    d = docs(t).select(F.col("doc_id").alias("id"), "text")
    j = c.join(d, "id", "left")
    return j.where(F.col("text").isNull() | (F.trim("text") == "") | (F.col("text") == "N/A")).select("id", "model_id")


def _license_sql(x):
    out = "'unknown'"
    for p in reversed(X.LICENSE_PATTERNS):
        rx = q("(?i)" + p)
        out = f"CASE WHEN regexp_matches({x}, {rx}) THEN {strip_sql(f'regexp_extract({x}, {rx}, 1)')} ELSE {out} END"
    return f"CASE WHEN {x} IS NULL THEN 'unknown' ELSE {out} END"


@query("license_from_card", sql=f"SELECT doc_id, {_license_sql('text')} AS license FROM documents")
def q_license_from_card(t: Tables):
    return docs(t).select("doc_id", X.license_from_card("text").alias("license"))


LIC_WORD = r"(?i)licen[sc]e"


@query("license_class", sql=f"""SELECT doc_id, CASE WHEN lic IS NULL THEN 'unknown'
  WHEN contains(lower(lic), 'mit') OR contains(lower(lic), 'bsd') OR contains(lower(lic), 'apache-2.0') OR contains(lower(lic), 'openrail') THEN 'permissive'
  ELSE 'noncommercial' END AS license_class FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {q(LIC_WORD)}))[1] AS lic FROM documents) x""")
def q_license_class(t: Tables):
    # first line mentioning a licence; splitting into lines keeps this linear
    lines = F.filter(F.split("text", "\n"), lambda ln: ln.rlike(LIC_WORD))
    d = docs(t).select("doc_id", F.try_element_at(lines, F.lit(1)).alias("lic"))
    return d.select("doc_id", X.license_class("lic").alias("license_class"))


def dated_docs(t: Tables):
    d = docs(t)
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("string")
    pre = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("last modified: "), day, F.lit("\n")))
           .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Last_Updated: "), day, F.lit("\n"))).otherwise(F.lit("")))
    return d.select("doc_id", F.concat(pre, F.col("text")).alias("card"))


DATED_SQL = """dd AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'last modified: ' || CAST(DATE '2020-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR) || chr(10)
  WHEN 1 THEN 'Last_Updated: ' || CAST(DATE '2020-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR) || chr(10) ELSE '' END || text AS card FROM documents)"""


def _lastmod_sql(x):
    out = "CAST(NULL AS DATE)"
    for p in reversed(X.LAST_MODIFIED_PATTERNS):
        rx = q("(?i)" + p)
        out = f"CASE WHEN regexp_matches({x}, {rx}) THEN CAST(regexp_extract({x}, {rx}, 1) AS DATE) ELSE {out} END"
    return out


@query("last_modified_from_card", sql=b.with_views(
    f"SELECT doc_id, {_lastmod_sql('card')} AS last_modified FROM dd", ctes=(DATED_SQL,)))
def q_last_modified_from_card(t: Tables):
    return dated_docs(t).select("doc_id", X.last_modified_from_card("card").alias("last_modified"))


def yaml_docs(t: Tables):
    d = docs(t)
    pre = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("language:\n- "), F.col("lang"), F.lit("\n- en\n")))
           .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("language: ['"), F.col("lang"), F.lit("', 'en']\n")))
           .otherwise(F.lit("")))
    return d.select("doc_id", F.concat(pre, F.col("text")).alias("card"))


YAML_SQL = """yd AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'language:' || chr(10) || '- ' || lang || chr(10) || '- en' || chr(10)
  WHEN 1 THEN 'language: [''' || lang || ''', ''en'']' || chr(10) ELSE '' END || text AS card FROM documents)"""


def _langs_sql(x):
    rx = q("(?i)" + X.LANGUAGE_BLOCK)
    block = strip_sql(f"regexp_extract({x}, {rx}, 1)")
    inline = (f"list_filter(list_transform(string_split(regexp_replace({block}, '^\\[|\\]$', '', 'g'), ','), "
              f"lambda y: regexp_replace({strip_sql('y')}, '^[''\"]|[''\"]$', '', 'g')), lambda y: y <> '')")
    dashed = (f"list_transform(list_filter(string_split({block}, chr(10)), lambda y: starts_with({strip_sql('y')}, '-')), "
              f"lambda y: {strip_sql('regexp_replace(y, ' + q(r'^\s*-\s*') + ', ' + q('') + ')')})")
    return (f"CASE WHEN {x} IS NULL OR NOT regexp_matches({x}, {rx}) THEN [] "
            f"WHEN starts_with({block}, '[') THEN {inline} ELSE {dashed} END")


@query("languages_from_card", sql=b.with_views(
    f"SELECT doc_id, array_to_string({_langs_sql('card')}, ',') AS languages FROM yd", ctes=(YAML_SQL,)))
def q_languages_from_card(t: Tables):
    return yaml_docs(t).select("doc_id", F.array_join(X.languages_from_card("card"), ",").alias("languages"))


@query("language_distribution", sql=b.with_views(
    f"""SELECT x.code, coalesce(l.name, x.code) AS name, x.n FROM (
  SELECT code, count(*) AS n FROM (SELECT unnest({_langs_sql('card')}) AS code FROM yd) u GROUP BY code) x
LEFT JOIN dim_language l ON l.code = x.code""", ctes=(YAML_SQL, LANG_SQL)))
def q_language_distribution(t: Tables):
    """Language codes declared in cards, counted, with display name (code when unknown)."""
    codes = yaml_docs(t).select(F.explode(X.languages_from_card("card")).alias("code"))
    cnt = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    names = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return cnt.select("code", F.coalesce(F.try_element_at(names, F.col("code")), F.col("code")).alias("name"), "n")


@query("join_cards_left", sql="""SELECT d.doc_id, l.quality, l.toxic,
  CASE WHEN l.doc_id IS NULL THEN 'no label row for this document' END AS exception_raised
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def q_join_cards_left(t: Tables):
    d = t.documents.select("doc_id")
    lab = t.labels.select(F.col("doc_id").alias("l_doc"), "quality", "toxic")
    j = d.join(lab, d.doc_id == lab.l_doc, "left")
    return j.select("doc_id", "quality", "toxic",
                    F.when(F.col("l_doc").isNull(), F.lit("no label row for this document")).alias("exception_raised"))


@query("expand_json", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def q_expand_json(t: Tables):
    e = t.events.select("event_id", F.from_json("props", "struct<k:bigint>").alias("j"))
    return e.select("event_id", "j.k")


@query("embedding_text", sql=b.with_views(
    """SELECT c.id, CASE WHEN d.text IS NOT NULL AND trim(d.text) <> '' AND lower(d.text) <> 'n/a' THEN 'card'
  WHEN c.pipeline_tag IS NOT NULL AND trim(c.pipeline_tag) <> '' THEN 'pipeline_tag' ELSE 'model_id' END AS text_source,
  CASE WHEN d.text IS NOT NULL AND trim(d.text) <> '' AND lower(d.text) <> 'n/a' THEN d.text
  WHEN c.pipeline_tag IS NOT NULL AND trim(c.pipeline_tag) <> '' THEN c.pipeline_tag ELSE c.model_id END AS text
FROM cat c LEFT JOIN documents d ON d.doc_id = c.id""", "cat"))
def q_embedding_text(t: Tables):
    from kinframe.sources import bindings as bb
    c = bb.cat(t).select("id", "model_id", "pipeline_tag")
    d = docs(t).select(F.col("doc_id").alias("id"), "text")
    j = c.join(d, "id", "left")
    card_ok = F.col("text").isNotNull() & (F.trim("text") != "") & (F.lower("text") != "n/a")
    tag_ok = F.col("pipeline_tag").isNotNull() & (F.trim("pipeline_tag") != "")
    return j.select("id", F.when(card_ok, "card").when(tag_ok, "pipeline_tag").otherwise("model_id").alias("text_source"),
                    F.when(card_ok, F.col("text")).when(tag_ok, F.col("pipeline_tag")).otherwise(F.col("model_id")).alias("text"))


URL_PREFIX = r"^https?://[^/]+/"


@query("clean_ids", sql=f"""SELECT page_id, regexp_replace(url, {q(URL_PREFIX)}, '') AS path,
  array_to_string(list_slice(list_filter(string_split(regexp_replace(regexp_replace(url, {q(URL_PREFIX)}, ''), '[?#].*$', ''), '/'), lambda x: x <> ''), -2, -1), '/') AS last_two,
  regexp_matches(url, {q(r'^https?://[^/]+/[^/?#]+/[^/?#]+')}) AS valid_shape FROM pages""")
def q_clean_ids(t: Tables):
    p = t.pages.select("page_id", "url")
    path = F.regexp_replace("url", URL_PREFIX, "")
    segs = F.filter(F.split(F.regexp_replace(path, r"[?#].*$", ""), "/"), lambda x: x != "")
    last_two = F.array_join(F.slice(segs, -2, 2), "/")
    return p.select("page_id", path.alias("path"),
                    F.when(F.size(segs) >= 2, last_two).otherwise(F.array_join(segs, "/")).alias("last_two"),
                    F.col("url").rlike(r"^https?://[^/]+/[^/?#]+/[^/?#]+").alias("valid_shape"))


def cite_docs(t: Tables):
    d = docs(t).select("doc_id", "lang")
    aid = F.concat(F.lit("17"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("."),
                   F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    k = F.col("doc_id") % 3
    body = (F.when(k == 0, F.concat(F.lit(",\n  eprint={"), aid, F.lit("},\n  archivePrefix={arXiv}")))
            .when(k == 1, F.concat(F.lit(",\n  url={https://arxiv.org/abs/"), aid, F.lit("}")))
            .otherwise(F.concat(F.lit(",\n  doi={10.1000/"), F.col("doc_id").cast("string"), F.lit("}"))))
    entry = F.concat(F.when(k == 2, F.lit("@inproceedings{d")).otherwise(F.lit("@article{d")),
                     F.col("doc_id").cast("string"), F.lit(",\n  title={Paper "), F.col("doc_id").cast("string"),
                     F.lit("}"), body, F.lit("\n}"))
    return d.select("doc_id", "lang", entry.alias("citation"))


CITE_SQL = """cd AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 2 THEN '@inproceedings{d' ELSE '@article{d' END || CAST(doc_id AS VARCHAR)
  || ',' || chr(10) || '  title={Paper ' || CAST(doc_id AS VARCHAR) || '}' || CASE doc_id % 3
  WHEN 0 THEN ',' || chr(10) || '  eprint={17' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || '},' || chr(10) || '  archivePrefix={arXiv}'
  WHEN 1 THEN ',' || chr(10) || '  url={https://arxiv.org/abs/17' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || '}'
  ELSE ',' || chr(10) || '  doi={10.1000/' || CAST(doc_id AS VARCHAR) || '}' END || chr(10) || '}' AS citation FROM documents)"""

# Bibtex fields read from the first entry.
BIB_FIELDS = ["title", "url", "eprint", "archivePrefix", "doi"]
# URL patterns holding an arXiv id, in order.
ARXIV_URL_PATTERNS = [r"arxiv\.org/abs/([0-9]{4}\.[0-9]{4,5})", r"arxiv\.org/pdf/([0-9]{4}\.[0-9]{4,5})",
                      r"arxiv:([0-9]{4}\.[0-9]{4,5})"]
def field_rx(f):
    return r"(?i)\b" + f + r"\s*=\s*\{([^}]*)\}"


def bib_cols(c):
    cols = [F.regexp_extract(c, field_rx(f), 1).alias(f) for f in BIB_FIELDS]
    cols.append(F.regexp_extract(c, r"^\s*@(\w+)\{", 1).alias("entry_type"))
    return cols


def bib_sql(c):
    return ", ".join([f"regexp_extract({c}, {q(field_rx(f))}, 1) AS \"{f}\"" for f in BIB_FIELDS]
                     + [f"regexp_extract({c}, {q(r'^\s*@(\w+)\{')}, 1) AS entry_type"])


def arxiv_col(eprint, url):
    out = F.lit(None).cast("string")
    for p in reversed(ARXIV_URL_PATTERNS):
        out = F.when(url.rlike(p), F.regexp_extract(url, p, 1)).otherwise(out)
    return F.when(eprint != "", eprint).otherwise(out)


def arxiv_sql(e, u):
    out = "CAST(NULL AS VARCHAR)"
    for p in reversed(ARXIV_URL_PATTERNS):
        out = f"CASE WHEN regexp_matches({u}, {q(p)}) THEN regexp_extract({u}, {q(p)}, 1) ELSE {out} END"
    return f"CASE WHEN {e} <> '' THEN {e} ELSE {out} END"


@query("bibtex_fields", sql=b.with_views(f"SELECT doc_id, {bib_sql('citation')} FROM cd", ctes=(CITE_SQL,)))
def q_bibtex_fields(t: Tables):
    return cite_docs(t).select("doc_id", *bib_cols(F.col("citation")))


@query("arxiv_id", sql=b.with_views(
    f"SELECT doc_id, {arxiv_sql('eprint', 'url')} AS arxiv_id FROM (SELECT doc_id, {bib_sql('citation')} FROM cd) x", ctes=(CITE_SQL,)))
def q_arxiv_id(t: Tables):
    x = cite_docs(t).select("doc_id", *bib_cols(F.col("citation")))
    return x.select("doc_id", arxiv_col(F.col("eprint"), F.col("url")).alias("arxiv_id"))


def categories(doc_id):
    """Stored category list of a paper (a stand-in for the lookup): codes of the table in turn, some unknown, and cs.AI."""
    codes = F.array(*[F.lit(c) for c in [*SUBJECTS, "q-none.XX"]])
    return F.array(F.get(codes, (doc_id % (len(SUBJECTS) + 1)).cast("int")), F.lit("cs.AI"))


CATS_SQL = f"[[{', '.join(q(c) for c in [*SUBJECTS, 'q-none.XX'])}][doc_id % {len(SUBJECTS) + 1} + 1], 'cs.AI']"
ARXIV_DIM_SQL = "dim_arxiv(code, name) AS (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in SUBJECTS.items()) + ")"


def decode_cats(arr):
    names = F.create_map(*[x for k, v in SUBJECTS.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(arr, lambda c: F.concat(c, F.lit(": "),
                                               F.coalesce(F.try_element_at(names, c), F.lit("Unknown category"))))


def decode_sql(arr):
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in SUBJECTS.items())
    return f"list_transform({arr}, lambda c: c || ': ' || (CASE c {whens} ELSE 'Unknown category' END))"


@query("arxiv_subjects", sql=b.with_views(
    f"SELECT doc_id, {CATS_SQL}[1] AS primary_category, array_to_string({decode_sql(CATS_SQL)}, '; ') AS subjects FROM documents"))
def q_arxiv_subjects(t: Tables):
    d = docs(t).select("doc_id", categories(F.col("doc_id")).alias("cats"))
    return d.select("doc_id", F.col("cats").getItem(0).alias("primary_category"),
                    F.array_join(decode_cats(F.col("cats")), "; ").alias("subjects"))


@query("classify_citations", sql=b.with_views(
    f"""SELECT doc_id, title, {arxiv_sql('eprint', 'url')} AS arxiv_id, nullif(doi, '') AS doi,
  CASE WHEN {arxiv_sql('eprint', 'url')} IS NOT NULL THEN array_to_string({decode_sql(CATS_SQL)}, '; ') END AS subjects
FROM (SELECT doc_id, lang, {bib_sql('citation')} FROM cd) x""", ctes=(CITE_SQL,)))
def q_classify_citations(t: Tables):
    x = cite_docs(t).select("doc_id", "lang", *bib_cols(F.col("citation")))
    aid = arxiv_col(F.col("eprint"), F.col("url"))
    return x.select("doc_id", "title", aid.alias("arxiv_id"), F.nullif(F.col("doi"), F.lit("")).alias("doi"),
                    F.when(aid.isNotNull(), F.array_join(decode_cats(categories(F.col("doc_id"))), "; ")).alias("subjects"))


def sibling_meta(t: Tables):
    """Metadata with stringified repository siblings built from part columns."""
    p = t.part.select("p_partkey", "p_type", "p_size")
    k = F.col("p_partkey")
    files = F.concat(F.lit('"RepoSibling(rfilename=\'config.json\')", '),
                     F.when(k % 3 != 1, F.lit('"RepoSibling(rfilename=\'model.safetensors.index.json\')", ')).otherwise(F.lit("")),
                     F.lit('"RepoSibling(rfilename=\''), F.lower("p_type"), F.lit("-"), F.col("p_size").cast("string"),
                     F.lit('.bin\')", "RepoSibling(rfilename=\'config.json\')"'))
    meta = F.when(k % 5 == 4, F.lit("{broken")).otherwise(F.concat(F.lit('{"siblings": ['), files, F.lit("]}")))
    return p.select(k.alias("id"), meta.alias("metadata"))


SIB_SQL = """sm AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 4 THEN '{broken' ELSE '{"siblings": [' || '"RepoSibling(rfilename=''config.json'')", '
  || CASE WHEN p_partkey % 3 <> 1 THEN '"RepoSibling(rfilename=''model.safetensors.index.json'')", ' ELSE '' END
  || '"RepoSibling(rfilename=''' || lower(p_type) || '-' || CAST(p_size AS VARCHAR) || '.bin'')", "RepoSibling(rfilename=''config.json'')"' || ']}' END AS metadata FROM part)"""
SIB_RX = r"rfilename='([^']+)'"


def repo_file_list(meta):
    sib = F.from_json(F.get_json_object(meta, "$.siblings"), "array<string>")
    names = F.transform(F.filter(sib, lambda s: s.rlike(SIB_RX)), lambda s: F.regexp_extract(s, SIB_RX, 1))
    return F.coalesce(F.array_sort(F.array_distinct(names)), F.array().cast("array<string>"))


def repo_sql(m):
    sib = f"CAST(json_extract({m}, '$.siblings') AS VARCHAR[])"
    names = f"list_transform(list_filter({sib}, lambda s: regexp_matches(s, {q(SIB_RX)})), lambda s: regexp_extract(s, {q(SIB_RX)}, 1))"
    return f"coalesce(CASE WHEN json_valid({m}) THEN list_sort(list_distinct({names})) END, [])"


@query("repo_files", sql=b.with_views(f"SELECT id, array_to_string({repo_sql('metadata')}, ',') AS files FROM sm", ctes=(SIB_SQL,)))
def q_repo_files(t: Tables):
    return sibling_meta(t).select("id", F.array_join(repo_file_list(F.col("metadata")), ",").alias("files"))


@query("file_presence", sql=b.with_views(
    f"""SELECT id, list_contains(f, 'config.json') AND list_contains(f, 'model.safetensors.index.json') AS can_analyze,
  list_contains(f, 'model.safetensors.index.json') AS has_index FROM (SELECT id, {repo_sql('metadata')} AS f FROM sm) x""", ctes=(SIB_SQL,)))
def q_file_presence(t: Tables):
    x = sibling_meta(t).select("id", repo_file_list(F.col("metadata")).alias("f"))
    return x.select("id", (F.array_contains("f", "config.json") & F.array_contains("f", "model.safetensors.index.json")).alias("can_analyze"),
                    F.array_contains("f", "model.safetensors.index.json").alias("has_index"))


@query("presence_summary", sql=b.with_views(
    f"""SELECT count(*) FILTER (WHERE h) AS with_index, count(*) FILTER (WHERE NOT h) AS without_index,
  round(100.0 * count(*) FILTER (WHERE h) / count(*), 6)::DOUBLE AS pct_with_index FROM (SELECT list_contains({repo_sql('metadata')}, 'model.safetensors.index.json') AS h FROM sm) x""",
    ctes=(SIB_SQL,)))
def q_presence_summary(t: Tables):
    x = sibling_meta(t).select(F.array_contains(repo_file_list(F.col("metadata")), "model.safetensors.index.json").alias("h"))
    return x.agg(F.count_if("h").alias("with_index"), F.count_if(~F.col("h")).alias("without_index"),
                 r6(100.0 * F.count_if("h") / F.count(F.lit(1))).alias("pct_with_index"))


A_HREF = r'<a href="([^"]+)"'


@query("html_listing_links", sql=f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, link FROM (
  SELECT page_id, unnest(regexp_extract_all(html, {q(A_HREF)}, 1)) AS link, unnest(range(1, len(regexp_extract_all(html, {q(A_HREF)}, 1)) + 1)) AS pos FROM pages) x""")
def q_html_listing_links(t: Tables):
    p = t.pages.select("page_id", "html")
    x = p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(A_HREF), 1)).alias("pos0", "link"))
    return x.select("page_id", (F.col("pos0") + 1).alias("pos"), "link")


@query("html_linked_spaces", sql=f"""SELECT page_id, array_to_string(s, ',') AS links, CAST(len(s) AS INTEGER) AS n_links FROM (
  SELECT page_id, list_sort(list_distinct(list_filter(regexp_extract_all(html, {q(A_HREF)}, 1), lambda x: starts_with(x, '/')))) AS s FROM pages) x""")
def q_html_linked_spaces(t: Tables):
    p = t.pages.select("page_id", "html")
    s = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all("html", F.lit(A_HREF), 1), lambda x: x.startswith("/"))))
    return p.select("page_id", F.array_join(s, ",").alias("links"), F.size(s).alias("n_links"))


H1 = r"<h1>([^<]*)</h1>"
# Entities of stored pages and the characters they stand for (the ampersand last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
# Classes of tags that hold a subject.
SUBJECT_CLASSES = "subject|keyword|classification"


def decoded(c):
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def plain(c):
    """Text of a piece of a page: tags removed, entities decoded, white space at the ends removed."""
    return X.strip_ws(decoded(F.regexp_replace(c, "<[^>]*>", "")))


def subjects_of(html):
    """Distinct subjects of a landing page: the parts of the content of the first keywords meta tag (as they are, between
    commas) and the text of every span, div or p tag whose class names a subject, a keyword or a classification."""
    meta = F.regexp_extract(html, r'(?is)<meta\b[^>]*\bname="keywords"[^>]*>', 0)
    content = decoded(F.regexp_extract(meta, r'(?is)\bcontent="([^"]*)"', 1))
    listed = F.when(meta != "", F.split(content, ",")).otherwise(F.array().cast("array<string>"))
    tag = rf'(?is)<(span|div|p)\b[^>]*\bclass="[^"]*(?:{SUBJECT_CLASSES})[^"]*"[^>]*>(.*?)</\1>'
    marked = F.filter(F.transform(F.regexp_extract_all(html, F.lit(tag), 2), plain), lambda x: x != "")
    return F.array_distinct(F.concat(listed, marked))


def landing_pages(t: Tables):
    """Stored landing pages (stand-in): every page with its language and heading as keywords, and a subject line."""
    p = t.pages.select("page_id", "html")
    return p.select("page_id", F.concat(
        F.lit('<meta name="keywords" content="'), F.regexp_extract("html", r'<html lang="([^"]*)"', 1), F.lit(","),
        F.regexp_replace(F.regexp_extract("html", H1, 1), r'[ "]+', ","), F.lit('"><p class="Subject-area"> area '),
        (F.col("page_id") % 7).cast("string"), F.lit(" <b>x</b></p><span class='other'>no</span>"), "html").alias("html"))


@query("html_keywords", sql=rf"""SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(
  string_split(replace(replace(replace(replace(replace(lang || ',' || regexp_replace(h1, '[ "]+', ',', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), ','),
  ['area ' || CAST(page_id % 7 AS VARCHAR) || ' x']))), '|') AS keywords
FROM (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, {q(H1)}, 1) AS h1 FROM pages) z""")
def q_html_keywords(t: Tables):
    """Subjects of stored landing pages."""
    return landing_pages(t).select("page_id", F.array_join(F.array_sort(subjects_of(F.col("html"))), "|").alias("keywords"))


# Section label keywords → relationship, in lookup order.
REL_LABELS = [("finetuned", "finetuned"), ("finetunes", "finetuned"), ("quantized", "quantized"),
              ("adapter", "adapter"), ("adapters", "adapter"), ("merge", "merged"), ("merges", "merged")]
_HOME = r"(?is)<p[^>]*>\s*base model\s*</p>"
_TREE = r'(?i)<div\b[^>]*\bclass="[^"]*\btext-smd\b[^"]*"[^>]*>'
_SECTION = r'(?i)<div\b[^>]*\bclass="[^"]*\bflex\b[^"]*"[^>]*>'
_LABEL = r'(?is)<div\b[^>]*\bclass="[^"]*\bfont-semibold\b[^"]*"[^>]*>(.*?)</div>'
_LINK = r'(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>'


def lineage_rows(pages):
    """``model_id, parent_model_id, parent_relationship, base_model_id`` from stored model pages ``(model_id, html)``.

    The tree is the ``text-smd`` container with a paragraph "Base model"; a page without it gives nothing. Its ``flex``
    sections have a bold label, whose first known word gives the relationship, and links: the parent is what follows
    ``base_model:`` (and the relation) in a link, else the link's text. A parent needs a slash and is not the model
    itself. The base model is the first link of the section with the paragraph, null if it has none."""
    trees = F.filter(F.slice(F.split("html", _TREE), 2, 1 << 20), lambda x: x.rlike(_HOME))
    s = pages.select("model_id", F.get(trees, F.lit(0)).alias("tree")).where("tree IS NOT NULL")
    s = s.select("model_id", F.split("tree", _SECTION).alias("sections"))
    home = F.get(F.filter("sections", lambda x: x.rlike(_HOME)), F.lit(0))
    base = F.when(home.rlike(_LINK), plain(F.regexp_extract(home, _LINK, 2)))
    x = s.select("model_id", base.alias("base_model_id"), F.explode("sections").alias("section"))
    label = F.lower(plain(F.regexp_extract("section", _LABEL, 1)))
    rel = F.lit(None).cast("string")
    for k, v in reversed(REL_LABELS):
        rel = F.when(label.contains(k), F.lit(v)).otherwise(rel)
    x = x.select("model_id", "base_model_id", rel.alias("parent_relationship"), "section").where("parent_relationship IS NOT NULL")
    links = F.arrays_zip(F.regexp_extract_all("section", F.lit(_LINK), 1).alias("href"), F.regexp_extract_all("section", F.lit(_LINK), 2).alias("text"))
    x = x.select("model_id", "base_model_id", "parent_relationship", F.explode(links).alias("a"))
    named = F.element_at(F.split(F.element_at(F.split("a.href", "base_model:"), -1), ":"), -1)
    parent = F.when(F.col("a.href").contains("base_model:"), named).otherwise(plain(F.col("a.text")))
    x = x.select("model_id", parent.alias("parent_model_id"), "parent_relationship", "base_model_id")
    return x.where(F.col("parent_model_id").contains("/") & (F.col("parent_model_id") != F.col("model_id")))


def model_pages(t: Tables):
    """Stored model pages (stand-in): every catalog model with parents, a section per relation."""
    names = b.cat(t).select(F.col("id").alias("src"), F.col("model_id").alias("parent"))
    r = b.lin_rel(t).join(names, "src").select("dst", "src", "rel", "parent").distinct()
    label = F.create_map(*[F.lit(x) for x in ("finetune", "Finetuned", "quantized", "Quantized from", "adapter", "Adapters", "merge", "Merges", "generic", "Other")])
    section = F.concat(F.lit('<div class="flex"><div class="font-semibold">'), label[F.col("rel")], F.lit("</div>"), F.when(
        F.col("rel") == "finetune", F.concat(F.lit('<a href="/models?other=base_model:finetune:'), "parent", F.lit('">this model</a>'))).otherwise(
        F.concat(F.lit('<a href="/'), "parent", F.lit('">\n '), "parent", F.lit("</a>"))), F.lit("</div>"))
    pages = r.groupBy("dst").agg(F.min(F.struct("src", "parent")).alias("b"), F.array_join(F.array_sort(F.collect_list(section)), "").alias("s"))
    me = b.cat(t).select(F.col("id").alias("dst"), "model_id")
    return pages.join(me, "dst").select("model_id", F.concat(
        F.lit('<html><nav><a href="/x/y">x/y</a></nav><div class="w text-smd"><div class="flex"><p> Base Model </p><a href="/'), "b.parent", F.lit('">'), "b.parent",
        F.lit("</a></div>"), "s", F.lit("</div></html>")).alias("html"))


@query("html_lineage_rows", sql=b.with_views(
    """SELECT model_id, parent_model_id, parent_relationship, base_model_id FROM (
  SELECT m.model_id, p.model_id AS parent_model_id, r.rel, CASE r.rel WHEN 'finetune' THEN 'finetuned' WHEN 'merge' THEN 'merged' ELSE r.rel END AS parent_relationship,
    first_value(p.model_id) OVER (PARTITION BY r.dst ORDER BY r.src) AS base_model_id
  FROM (SELECT DISTINCT dst, src, rel FROM lin_rel) r JOIN cat m ON m.id = r.dst JOIN cat p ON p.id = r.src) z WHERE rel <> 'generic'""", "cat", "lin_rel"))
def q_html_lineage_rows(t: Tables):
    """Relation rows from stored model pages by section label."""
    return lineage_rows(model_pages(t))
