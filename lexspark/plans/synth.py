"""A deterministic legal corpus made from ``orders`` and ``lineitem``, and what parsing it must give.

``LINES`` states the corpus, and expectations come from its rows, without parsing.  Spark builds the same texts in one
aggregation per order and one per customer: each table is read and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: the corpus's lines, and what each is expected to be
LINES = """
o AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS art
  FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem})),
l AS (SELECT o.doc_id, o.art, CAST(row_number() OVER (PARTITION BY o.o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS k,
  CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS flag, l_linestatus AS st FROM o JOIN {lineitem} x ON x.l_orderkey = o.o_orderkey),
d AS (SELECT DISTINCT doc_id FROM o),
lines AS (
  SELECT doc_id, 0 AS art, 0 AS k, 0 AS sub, 'chapter' AS what, 'I' AS number, 'Chương I' AS text FROM d
  UNION ALL SELECT doc_id, 0, 0, 1, 'title', '', 'QUY ĐỊNH CHUNG' FROM d
  UNION ALL SELECT doc_id, art, 0, 0, 'article', CAST(art AS {S}), 'Điều ' || CAST(art AS {S}) || '. Nội dung đơn hàng ' || CAST(o_orderkey AS {S}) FROM o
  UNION ALL SELECT doc_id, art, k, 0, 'clause', CAST(k AS {S}), CAST(k AS {S}) || '. Khoản mục có số lượng ' || CAST(qty AS {S}) || ' theo Điều ' || CAST(art AS {S}) FROM l
  UNION ALL SELECT doc_id, art, k, 1, 'point', 'a', 'a) Loại ' || flag FROM l WHERE flag = 'R'
  UNION ALL SELECT doc_id, art, k, 2, 'point', 'b', 'b) Trạng thái ' || st FROM l WHERE flag = 'R'
  UNION ALL SELECT doc_id, art, 1000000, 0, 'cited', '', 'Điều 5 của Luật Đất đai' FROM o WHERE o_orderkey % 5 = 0
  UNION ALL SELECT doc_id, art, 1000000, 0, 'numeric', '', '12.5 triệu đồng' FROM o WHERE o_orderkey % 5 = 1
  UNION ALL SELECT doc_id, art, 1000000, 0, 'quoted', '', '“Điều 9. Nội dung trích”' FROM o WHERE o_orderkey % 5 = 2
  UNION ALL SELECT doc_id, art, 1000000, 0, 'dotted', '', 'k. Ghi chú riêng' FROM o WHERE o_orderkey % 5 = 3
  UNION ALL SELECT doc_id, 1000000, 0, 0, 'annex', 'I', 'PHỤ LỤC I' FROM d WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, 1000000, 0, 1, 'annex', '', '1. Biểu mẫu đơn' FROM d WHERE doc_id % 7 = 0),
body AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY art, k, sub) AS INT) AS line_no FROM lines WHERE what <> 'annex')
"""

DUCK = "SELECT doc_id, string_agg(text, chr(10) ORDER BY art, k, sub) AS content FROM lines GROUP BY doc_id"

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_TAILS = ("Điều 5 của Luật Đất đai", "12.5 triệu đồng", "“Điều 9. Nội dung trích”", "k. Ghi chú riêng")


def _documents(spark: SparkSession, sf_dir: str, stop: str, tails: bool, gap: str) -> DataFrame:
    """A text per customer: ``stop`` ends articles, clauses and points, ``gap`` stands between lines, ``tails`` are noise and annex."""
    orders, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    items = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_ORDER))).alias("items"))
    having = orders.select("o_custkey", "o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "items")
    grouped = having.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "items"))).alias("orders"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def order(o: Column, i: Column) -> Column:
        art = i + 1

        def item(x: Column, n: Column) -> Column:
            k, flag = n + 1, x["l_returnflag"]
            own = F.array(said(k, ". Khoản mục có số lượng ", x["l_quantity"].cast("long"), " theo Điều ", art, stop))
            return F.when(flag == "R", F.concat(own, F.array(said("a) Loại ", flag, stop), said("b) Trạng thái ", x["l_linestatus"], stop)))).otherwise(own)

        lines = [F.array(said("Điều ", art, ". Nội dung đơn hàng ", o["o_orderkey"], stop)), F.flatten(F.transform(o["items"], item))]
        if tails:
            tail = F.get(F.array(*map(F.lit, _TAILS)), (o["o_orderkey"] % 5).cast("int"))
            lines.append(F.array(tail))
        return F.array_join(F.concat(*lines), gap)

    ends = [F.when(F.col("doc_id") % 7 == 0, gap.join(("PHỤ LỤC I", "1. Biểu mẫu đơn")))] if tails else []
    return grouped.select("doc_id", F.concat_ws(gap, F.lit(gap.join(("Chương I", "QUY ĐỊNH CHUNG"))), F.array_join(F.transform("orders", order), gap), *ends).alias("content"))


def legal_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, "", True, "\n")


def flat_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without noise or annex whose lines are put one behind the other, as sentences (``FLAT``)."""
    return _documents(spark, sf_dir, ".", False, " ")


def duck(select: str, more: str = "") -> str:
    return "WITH " + LINES.replace("{S}", "VARCHAR").replace("{orders}", "orders").replace("{lineitem}", "lineitem") + more + select


#: nodes with their content: a line that isn't a node belongs to the node before it
NODES = """,
n AS (SELECT *, max(CASE WHEN what IN ('chapter', 'article', 'clause', 'point') THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS owner,
  'chapter-I' || CASE WHEN art > 0 THEN '/article-' || art ELSE '' END || CASE WHEN what IN ('clause', 'point') THEN '/clause-' || k ELSE '' END || CASE WHEN what = 'point' THEN '/point-' || number ELSE '' END AS id FROM body),
t AS (SELECT doc_id, owner, string_agg(text, chr(10) ORDER BY line_no) FILTER (what IN ('cited', 'numeric', 'quoted', 'dotted')) AS extra FROM n GROUP BY doc_id, owner),
nodes AS (SELECT n.doc_id, line_no AS node_seq, id AS element_id, CASE what WHEN 'chapter' THEN NULL WHEN 'article' THEN 'chapter-I' ELSE regexp_replace(id, '/[^/]*$', '') END AS parent_id, what AS element_type, number,
  CASE what WHEN 'chapter' THEN 'QUY ĐỊNH CHUNG' WHEN 'article' THEN regexp_replace(text, '^[^.]*[.] ', '') WHEN 'clause' THEN 'Khoản ' || number ELSE 'Điểm ' || number END AS title,
  concat_ws(chr(10), CASE WHEN what IN ('clause', 'point') THEN regexp_replace(text, '^[0-9a-z]+[.)] ', '') END, extra) AS raw_text
  FROM n JOIN t ON t.doc_id = n.doc_id AND t.owner = n.line_no WHERE what IN ('chapter', 'article', 'clause', 'point'))
"""

MARKERS = """SELECT doc_id, line_no, CASE what WHEN 'cited' THEN 'article' WHEN 'numeric' THEN 'clause' WHEN 'quoted' THEN 'article' WHEN 'dotted' THEN 'point' ELSE what END AS kind,
  CASE what WHEN 'cited' THEN '5' WHEN 'numeric' THEN '12' WHEN 'quoted' THEN '9' WHEN 'dotted' THEN 'k' ELSE number END AS number,
  CASE what WHEN 'chapter' THEN 'Chương I' WHEN 'cited' THEN 'Điều 5' WHEN 'numeric' THEN '12.' WHEN 'quoted' THEN 'Điều 9.' WHEN 'dotted' THEN 'k.' WHEN 'article' THEN 'Điều ' || number || '.' WHEN 'clause' THEN number || '.' ELSE number || ')' END AS marker,
  CASE what WHEN 'chapter' THEN '' WHEN 'cited' THEN 'của Luật Đất đai' WHEN 'numeric' THEN '5 triệu đồng' WHEN 'quoted' THEN 'Nội dung trích”' WHEN 'dotted' THEN 'Ghi chú riêng' ELSE regexp_replace(text, '^[^.)]*[.)] ', '') END AS rest FROM body WHERE what <> 'title'"""

#: documents whose lines are put one behind the other, as sentences
FLAT = """,
flat AS (SELECT doc_id, art, k, sub, what, number, text || CASE WHEN what IN ('clause', 'point', 'article') THEN '.' ELSE '' END AS text FROM lines WHERE what IN ('chapter', 'title', 'article', 'clause', 'point'))"""

FLAT_NODES = """,
flat_nodes AS (SELECT doc_id, what, 'chapter-I' || CASE WHEN art > 0 THEN '/article-' || art ELSE '' END || CASE WHEN what IN ('clause', 'point') THEN '/clause-' || k ELSE '' END || CASE WHEN what = 'point' THEN '/point-' || number ELSE '' END AS element_id,
  CASE what WHEN 'chapter' THEN 'QUY ĐỊNH CHUNG' WHEN 'article' THEN regexp_replace(text, '^[^.]*[.] ', '') WHEN 'clause' THEN 'Khoản ' || number ELSE 'Điểm ' || number END AS title,
  CASE WHEN what IN ('clause', 'point') THEN regexp_replace(text, '^[0-9a-z]+[.)] ', '') ELSE '' END AS raw_text FROM flat WHERE what <> 'title')
"""

#: nested JSON of ``NODES``, put together from the leaves
JSON = """,
x AS (SELECT *, regexp_extract_all(t, 'Điều [0-9]+') AS m, regexp_split_to_array(t, 'Điều [0-9]+') AS p, max(CASE element_type WHEN 'article' THEN node_seq END) OVER w AS art_seq, max(CASE element_type WHEN 'clause' THEN node_seq END) OVER w AS clause_seq
  FROM (SELECT *, title || ' ' || replace(raw_text, chr(10), ' ') AS t FROM nodes) WINDOW w AS (PARTITION BY doc_id ORDER BY node_seq)),
y AS (SELECT doc_id, node_seq, element_type, art_seq, clause_seq, '{"element_id":' || to_json(element_id)::VARCHAR || ',"element_type":"' || element_type || '","number":' || to_json(number)::VARCHAR || ',"title":' || to_json(title)::VARCHAR
  || ',"content":{"raw_text":' || to_json(raw_text)::VARCHAR || ',"normalized_text":' || to_json(replace(raw_text, chr(10), ' '))::VARCHAR || ',"provisions":[]},"cross_references":['
  || coalesce(array_to_string(list_transform(range(1, len(m) + 1), lambda i: '{"text":"' || m[i] || '","target":{"article":"' || m[i][6:] || '"},"start":' || (list_sum(list_transform(p[1 : i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda v: length(v))), 0))::INT || ',"end":' || (list_sum(list_transform(p[1 : i], lambda v: length(v))) + list_sum(list_transform(m[1 : i], lambda v: length(v))))::INT || '}'), ','), '')
  || '],"metadata":{"marker":"' || CASE element_type WHEN 'chapter' THEN 'Chương I' WHEN 'article' THEN 'Điều ' || number || '.' WHEN 'clause' THEN number || '.' ELSE number || ')' END || '","raw_number":"' || number || '","line_no":' || node_seq || ',"source":"line","embedded":false,"context_score":'
  || CASE element_type WHEN 'clause' THEN '0.93' WHEN 'point' THEN '0.96' ELSE '0.98' END || ',"context_reasons":["' || CASE element_type WHEN 'clause' THEN 'valid_bare_clause_sequence' WHEN 'point' THEN 'canonical_point_parenthesis' ELSE 'explicit_major_keyword' END || '"]},"children":[' AS head FROM x),
points AS (SELECT doc_id, clause_seq AS node_seq, string_agg(head || ']}', ',' ORDER BY node_seq) AS below FROM y WHERE element_type = 'point' GROUP BY ALL),
clauses AS (SELECT doc_id, art_seq AS node_seq, string_agg(head || coalesce(below, '') || ']}', ',' ORDER BY y.node_seq) AS below FROM y LEFT JOIN points USING (doc_id, node_seq) WHERE element_type = 'clause' GROUP BY ALL),
articles AS (SELECT doc_id, string_agg(head || coalesce(below, '') || ']}', ',' ORDER BY y.node_seq) AS below FROM y LEFT JOIN clauses USING (doc_id, node_seq) WHERE element_type = 'article' GROUP BY ALL),
tree AS (SELECT doc_id, '[' || head || coalesce(below, '') || ']}]' AS j FROM y LEFT JOIN articles USING (doc_id) WHERE element_type = 'chapter')
"""
