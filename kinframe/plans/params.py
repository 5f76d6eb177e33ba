"""Parameter / precision / architecture / date extraction keys (§2.2, §2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinframe.functions import params as P
from kinframe.functions.common import r6
from kinframe.plans import sqlfn as S
from kinframe.plans.registry import query
from kinframe.session import ensure_checkpoint_dir
from kinframe.sources import bindings as b
from kinframe.sources.tables import Tables


def par(t: Tables):
    return b.par(t)


def catmeta(t: Tables):
    """Catalog rows with a JSON metadata text (architecture / family inputs)."""
    c = b.cat(t)
    return c.select("id", "model_id", "pipeline_tag", "library_name",
                    F.when(F.col("id") % 4 == 0, F.concat(F.lit('{"model_type": "'), F.col("pipeline_tag"), F.lit('"}')))
                     .when(F.col("id") % 4 == 1, F.concat(F.lit('{"library_name": "'), F.col("library_name"), F.lit('"}')))
                     .when(F.col("id") % 4 == 2, F.lit("broken {")).alias("metadata"))


CATMETA_SQL = """catmeta AS (SELECT id, model_id, pipeline_tag, library_name,
  CASE id % 4 WHEN 0 THEN '{"model_type": "' || pipeline_tag || '"}' WHEN 1 THEN '{"library_name": "' || library_name || '"}' WHEN 2 THEN 'broken {' END AS metadata FROM cat)"""


def evtmeta(t: Tables):
    """Event rows with a metadata text: JSON date key, free text with an offset, or neither."""
    e = t.events.select("event_id", "ts", "props")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0,
                                       F.concat(F.lit('{"k": 1, "createdAt": "'), iso, F.lit('Z"}')))
                     .when(F.col("event_id") % 3 == 1, F.concat(F.lit("created "), iso, F.lit("+02:00 by job")))
                     .otherwise(F.col("props")).alias("metadata"))


EVTMETA_SQL = """evtmeta AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"k": 1, "createdAt": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}'
  WHEN 1 THEN 'created ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+02:00 by job' ELSE props END AS metadata FROM events)"""


def psql(body, *ctes):
    return b.with_views(body, "par", ctes=ctes)


_LAST = "string_split(model_id, '-')[-1]"


@query("parse_suffixed_number", sql=psql(
    f"SELECT id, {_LAST} AS text, {S.parse_number(_LAST)} AS value FROM par"))
def q_parse_suffixed_number(t: Tables):
    p = par(t).select("id", F.element_at(F.split("model_id", "-"), -1).alias("text"))
    return P.parse_suffixed_number(p, "text", "value")


@query("params_from_metadata", sql=psql(f"SELECT id, metadata, {S.params_from_metadata('metadata')} AS params FROM par"))
def q_params_from_metadata(t: Tables):
    return P.params_from_metadata(par(t).select("id", "metadata"), "metadata", "params")


@query("params_from_card", sql=psql(f"SELECT id, card, {S.params_from_card('card')} AS params FROM par"))
def q_params_from_card(t: Tables):
    return P.params_from_card(par(t).select("id", "card"), "card", "params")


@query("params_from_id", sql=psql(f"SELECT id, model_id, {S.params_from_id('model_id')} AS params FROM par"))
def q_params_from_id(t: Tables):
    return par(t).select("id", "model_id", P.params_from_id("model_id").alias("params"))


PARAMS_SQL = f"""pp AS (SELECT id, model_id, {S.params_from_metadata('metadata')} AS pm, {S.params_from_card('card')} AS pc,
  {S.params_from_id('model_id')} AS pi FROM par),
pc AS (SELECT id, model_id, coalesce(pm, pc, pi) AS parameters,
  CASE WHEN pm IS NOT NULL THEN 'metadata' WHEN pc IS NOT NULL THEN 'card' WHEN pi IS NOT NULL THEN 'model_id' ELSE 'unknown' END AS parameter_source FROM pp)"""


def coalesced(t: Tables):
    return P.params_coalesced(par(t), "metadata", "card", "model_id").select("id", "model_id", "parameters", "parameter_source")


def params_table(t: Tables):
    """Parameter count and its source per model, extracted once.

    The extraction is a wide expression over JSON, card and id; downstream
    statistics read it several times (counts, histograms, quantiles), so it is
    checkpointed into the shared checkpoint folder instead of re-derived."""
    ensure_checkpoint_dir(t.spark)
    return coalesced(t).checkpoint(eager=True)


@query("params_coalesced", sql=psql("SELECT * FROM pc", PARAMS_SQL))
def q_params_coalesced(t: Tables):
    return coalesced(t)


@query("precision_from_sources", sql=psql(
    f"SELECT id, {S.precision('metadata', 'card', 'model_id')} AS precision FROM par"))
def q_precision_from_sources(t: Tables):
    return P.precision_from_sources(par(t), "metadata", "card", "model_id").select("id", "precision")


@query("architecture_from_metadata", sql=b.with_views(
    f"SELECT id, {S.architecture('metadata')} AS architecture FROM catmeta", "cat", ctes=(CATMETA_SQL,)))
def q_architecture_from_metadata(t: Tables):
    return catmeta(t).select("id", P.architecture_from_metadata("metadata").alias("architecture"))


@query("dates_from_metadata", sql=b.with_views(
    f"SELECT event_id, {S.date_from_metadata('metadata')} AS created_at FROM evtmeta", ctes=(EVTMETA_SQL,)))
def q_dates_from_metadata(t: Tables):
    return evtmeta(t).select("event_id", P.date_from_metadata("metadata").alias("created_at"))


@query("valid_parameters", sql=b.with_views(
    "SELECT pc.id, pc.parameters, c.created_at FROM pc JOIN cat c ON c.id = pc.id WHERE pc.parameters IS NOT NULL AND c.created_at IS NOT NULL AND pc.parameters > 0",
    "par", "cat", ctes=(PARAMS_SQL,)))
def q_valid_parameters(t: Tables):
    c = b.cat(t).select("id", "created_at")
    p = params_table(t).select("id", "parameters")
    return (p.join(c, "id").dropna(subset=["parameters", "created_at"])
            .where(F.col("parameters") > 0))
