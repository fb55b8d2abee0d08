"""``parse_document``: the projection of records and parsed tables to nested JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from .structure import StructureTables, annex_block, parse_structure

VERSION = __version__

# Record keys in order of priority, kinds of dates, defaults.
ALIASES = {
    "document_id": ("document_id", "id", "doc_id"),
    "title": ("title", "name"),
    "document_type": ("document_type", "type", "doc_type"),
    "document_number": ("doc_number", "document_number", "number"),
    "issuing_authority": ("issuer", "issuing_authority", "authority"),
    "status": ("effect_status", "status"),
    "source_url": ("source_url", "url", "source"),
    "domain": ("sector", "domain"),
    "sub_domain": ("legal_field", "sub_domain"),
    "code": ("doc_number", "document_number"),
}
DATES = {
    "enactment": ("enactment_date", "issue_date", "promulgation_date", "date", "year"),
    "effective": ("effective_date", "date_effective"),
    "expiry": ("expiry_date", "expiration_date", "date_expiry"),
    "last_amended": ("last_amended", "amended_date"),
    "consolidation": ("consolidation_date",),
}
DEFAULTS = {"jurisdiction": "Vietnam", "language": "vi"}
NOT_URLS = ("main", "legacy")
# End of the fixed values.


def first_of(record: Column, keys: tuple[str, ...]) -> Column:
    """The first of a string map's values that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(record, F.lit(k)), F.lit("")) for k in keys])


def record_map(record_json: Column) -> Column:
    """A JSON object as ``map<string, string>``; nested values keep their JSON."""
    return F.from_json(record_json, "map<string,string>")


def project(records: DataFrame, record_col: str = "record") -> DataFrame:
    """``document`` struct columns from a record's JSON."""
    m = F.col("_m")
    url = first_of(m, ALIASES["source_url"])
    text = lambda name: F.coalesce(first_of(m, ALIASES[name]), F.lit("")).alias(name)
    nested = lambda k: F.coalesce(F.try_parse_json(F.try_element_at(m, F.lit(k))), F.parse_json(F.lit("[]"))).alias(k)
    code = first_of(m, ALIASES["code"])
    return records.withColumn("_m", record_map(F.col(record_col))).select(
        *[c for c in records.columns], *[text(k) for k in ALIASES if k not in ("source_url", "code")],
        *[F.coalesce(first_of(m, (k,)), F.lit(v)).alias(k) for k, v in DEFAULTS.items()],
        F.when(url.isin(*NOT_URLS), "").otherwise(F.coalesce(url, F.lit(""))).alias("source_url"), *[first_of(m, keys).alias(f"date_{k}") for k, keys in DATES.items()],
        F.when(code.isNotNull(), F.array(code)).otherwise(F.array().cast("array<string>")).alias("classification_codes"),
        *[nested(k) for k in ("keywords", "subject_areas", "version_history", "related_documents")], F.map_filter(m, lambda k, v: k != "content").alias("source_metadata"),
    )


def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def _target(r: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k in ("point", "clause", "article") for x in (F.lit(k), r[k])]), lambda k, v: v.isNotNull())


def structure_json(tables: StructureTables) -> DataFrame:
    """``doc_id, structure``: each document's nodes nested as JSON."""
    return tables.summaries("structure").select(*tables.key, "structure")


def parse_documents(records: DataFrame, record_col: str = "record", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, confidence, json`` of records ``(doc_id, record JSON)``, each parsed by itself."""
    rows = records.select(F.col(id_col).cast("string").alias("doc_id"), F.col(record_col).alias("record"), F.try_element_at(record_map(F.col(record_col)), F.lit("content")).alias("content"))
    parsed = project(parse_structure(rows, keep=("record",)).summaries("diagnostics", "references", "structure"), "_k0")
    document = F.struct(
        "document_id", "title", "document_type", "document_number", *DEFAULTS, "issuing_authority", "status", F.struct(*[F.col(f"date_{k}").alias(k) for k in DATES]).alias("dates"),
        F.struct("domain", "sub_domain", "keywords", "subject_areas", "classification_codes").alias("classification"), "source_url", "version_history", "related_documents", "source_metadata",
    )
    annex = F.when(F.col("annex").isNotNull(), F.array(annex_block("struct"))).otherwise(F.array())
    references = F.transform("references", lambda r: F.struct(r["source_element_id"].alias("source_element_id"), r["text"].alias("text"), _target(r).alias("target"), r["start"].alias("start"), r["end"].alias("end")))
    said = F.transform("diagnostics", lambda d: d.dropFields("diag_seq"))
    parser = F.struct(F.lit("lexspark").alias("name"), F.lit(VERSION).alias("version"), "source_content_sha256", "confidence", said.alias("diagnostics"), "stats")
    rest = _json(F.struct(document.alias("document"), annex.alias("annex_blocks"), references.alias("cross_references"), parser.alias("parser")))
    whole = F.concat(F.regexp_replace(rest, r"\}$", ""), F.lit(',"structure":'), F.col("structure"), F.lit("}"))
    return parsed.select("doc_id", "confidence", whole.alias("json"))
