"""``parse_structure``: documents in, a bundle of tables out.

A document is one row until its tables: one Arrow pass normalises it, cuts the annex, reads its lines and returns the rows
and columns that are asked for; the score is an expression.  Nothing is shuffled or joined, so rows with a null
id, or with one that others have too, are documents like any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.references import cross_references
from ..operators import quality, structure


@dataclass
class StructureTables:
    """Lazy tables of a parsed corpus.  Each is one scan and at most one pass over lines.

    Every table begins with ``doc_id``; where ids repeat, ``documents`` may carry a key of its own as another column
    and name it in ``keep``.
    """

    documents: DataFrame
    id_col: str = "doc_id"
    content_col: str = "content"
    keep: tuple[str, ...] = ()

    @cached_property
    def _source(self) -> DataFrame:
        quoted = lambda c: "`" + c.replace("`", "``") + "`"
        extra = [self.documents[quoted(c)].alias(f"_k{i}") for i, c in enumerate(self.keep)]  # no name of theirs meets one of ours
        return self.documents.select(self.documents[quoted(self.id_col)].alias("doc_id"), *extra, self.documents[quoted(self.content_col)].alias("content"))

    @cached_property
    def prepared(self) -> DataFrame:
        """Sizes, annex and body of every document."""
        return structure.prepared(self._source)

    @property
    def key(self) -> list[Column]:
        """``doc_id`` and the kept columns, which have names of their own (_k0, _k1, ...) until a table is done."""
        return [F.col("doc_id"), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(self.keep))]

    def rows(self, table: str, *names: str) -> DataFrame:
        """The key and the columns named of ``table`` (lines, nodes, diagnostics, references); no other leaves the pass."""
        return structure.table_rows(self._source, table, list(names)).select(*self.key, *(F.col(f"`{n}`") for n in names))

    def summaries(self, *more: str) -> DataFrame:
        """One row per document with ``confidence`` and ``stats``; ``more`` as ``structure.summaries`` has it."""
        return with_stats(structure.summaries(self._source, more))

    def _whole(self, table: str) -> DataFrame:
        names = [n for n in structure._fields(structure.TABLES[table]) if n != "place"]
        return self.rows(table, *names)

    @cached_property
    def segments(self) -> DataFrame:
        """Logical lines with their markers and the decisions about them."""
        return self._whole("lines")

    @cached_property
    def nodes(self) -> DataFrame:
        return self._whole("nodes")

    @cached_property
    def diagnostics(self) -> DataFrame:
        return self._whole("diagnostics")

    @cached_property
    def cross_references(self) -> DataFrame:
        return self._whole("references")

    @cached_property
    def annex_blocks(self) -> DataFrame:
        return self.prepared.filter("annex is not null").select(*self.key, annex_block("*"))

    @cached_property
    def doc_stats(self) -> DataFrame:
        return self.summaries().select(*self.key, "source_content_sha256", "confidence", "stats.*")


def annex_block(form: str) -> Column:
    """An annex's columns as one struct, or with ``*`` spread."""
    raw = F.col("annex")
    fields = F.struct(F.lit(1).alias("index"), F.col("annex_number").alias("number"), F.col("annex_heading").alias("heading"), raw.alias("raw_text"), T.collapse_ws(raw).alias("normalized_text"), F.col("annex_line").alias("start_line"), F.lit(False).alias("parsed"))
    return F.inline(F.array(fields)) if form == "*" else fields


def with_stats(rows: DataFrame) -> DataFrame:
    """Adds ``confidence`` and ``stats`` to summaries."""
    stats = F.struct(
        "raw_character_count", F.col("normalized_characters").alias("normalized_character_count"), F.col("main_characters").alias("main_body_character_count"), F.coalesce(F.length("annex"), F.lit(0)).alias("annex_character_count"),
        F.col("annex").isNotNull().cast("int").alias("annex_block_count"), "logical_line_count", F.col("flattened").alias("flattened_input"), F.col("made").alias("reconstructed_boundary_count"), F.col("cut").alias("reconstructed_physical_line_count"),
        "node_count", "element_counts", F.col("embedded").alias("embedded_marker_count"), F.col("reference_count").alias("cross_reference_count"),
    )
    score = quality.confidence(*map(F.col, ("flattened", "made", "embedded", "errors", "warnings", "infos")))
    return rows.withColumns({"confidence": F.when(F.col("nothing"), F.lit(0.0)).otherwise(score), "stats": stats})


def parse_structure(documents: DataFrame, id_col: str = "doc_id", content_col: str = "content", keep: tuple[str, ...] = ()) -> StructureTables:
    """Tables of every row's text by itself.  Null content is empty text; ids may be null and may repeat."""
    return StructureTables(documents, id_col, content_col, keep)


def extract_cross_references(df: DataFrame, text_col: str = "text", out: str = "cross_references") -> DataFrame:
    return df.withColumn(out, cross_references(F.col(text_col)))
