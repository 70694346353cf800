"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

The tables stand in for the engine's relations: documents and benchmark for corpora, embeddings for
dense vectors, labels with documents for truth and predictions, events and conversations for
stored answers. Every query reads its tables whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import extraction, ledger, providers, similarity
from ..session import scratch_dir, table
from ..sources import matrix, readers, records, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Parameters that suit the tables' invented prose.
CUES = ("that", "with", "from")
VOCABULARY = ["and", "are", "das", "del", "den", "der", "des", "die", "ein", "est", "for", "hash", "les", "los", "not", "par", "que", "that", "the", "threat", "token", "und", "une", "was", "with"]
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "it", "on", "de", "la", "der", "die", "que", "el"]
CUTS = [(0.40, "EQUIVALENCE"), (0.30, "OVERLAP"), (0.20, "COMPLEMENTARITY")]
METHODS = ["length_rule", "language_rule", "silent_rule"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# ---------------------------------------------------------------- cleaning and clauses

# SQL's white space as functions.text.strip has it
_WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_STRIP = lambda e: rf"regexp_replace({e}, '\A{_WS}+|{_WS}+\z', '', 'g')"


_CLEAN = lambda e: _STRIP(f"regexp_replace(regexp_replace(regexp_replace({e}, 'ETSI\\s*\\n', chr(10), 'g'), 'ETSI EN \\d+ \\d+ V[\\d.]+ \\(\\d{{4}}-\\d{{2}}\\)\\s*\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
#: A document as a publisher's pages have it: lines and running headers around the text, in both dialects.
_PAGED = "'ETSI ' || chr(10) || chr(10) || 'ETSI EN 303 645 V2.1.1 (2020-06)' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || 'ETSI' || chr(10) || lang || ' '"


@query(f"SELECT doc_id, {_CLEAN(_PAGED)} AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.clean_text(F.expr(_PAGED)).alias("cleaned"))


@query("""
SELECT doc_id, CASE WHEN p > 0 THEN substr(text, 1, CAST(p AS BIGINT) + 199) ELSE text END AS head
FROM (SELECT *, strpos(substr(text, 201), chr(10)) AS p FROM documents)
""")
def annex_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.cut_at_marker(F.col("text"), "\n", 200).alias("head"))


@query(r"""
SELECT page_id, pos - 1 AS pos, m[pos] AS match
FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<p>[^<]*</p>') AS m FROM pages))
""")
def clause_extract(spark: SparkSession, sf: str) -> DataFrame:
    out = extraction.matches(table(spark, sf, "pages"), "html", "<p>[^<]*</p>")
    return out.select("page_id", F.col("pos").cast("long").alias("pos"), "match")


@query(rf"""
SELECT doc_id, {_STRIP(r"regexp_replace(regexp_replace(text, '\n(Of|Der|La)\s', chr(10) || 'NOTE 1: ', 'g'), '(?s)\n(NOTE|EXAMPLE)\s+\d*:.*', '')")} AS trimmed FROM documents
""")
def explanatory_trim(spark: SparkSession, sf: str) -> DataFrame:
    noted = F.regexp_replace("text", r"\n(Of|Der|La)\s", "\nNOTE 1: ")
    return table(spark, sf, "documents").select("doc_id", X.trim_explanations(noted).alias("trimmed"))


#: Normative documents made of the part table, a clause for each part, in both dialects of SQL.
_PIECE = """'Provision 5.' || CAST(p_size % 15 AS STRING) || {sub} || '-' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 5 = 0 THEN {letter} ELSE '' END || ' '
  || CASE WHEN p_partkey % 13 = 0 THEN 'Void.' ELSE 'The ' || p_name || CASE p_partkey % 4 WHEN 0 THEN ' shall' WHEN 1 THEN ' should' WHEN 2 THEN ' may' ELSE ' can' END || ' be' || chr(10) || 'kept.' END
  || chr(10) || CASE WHEN p_partkey % 7 = 0 THEN 'NOTE 1: as sold' || chr(10) || 'by others' || chr(10) ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN '12 Next heading' || chr(10) || 'lost words' || chr(10) ELSE '' END"""
_PIECE_A, _PIECE_B = _PIECE.format(sub="''", letter="'A'"), _PIECE.format(sub="'.' || CAST(p_partkey % 6 AS STRING)", letter="'.2'")


def _standard(spark: SparkSession, sf: str, piece: str) -> DataFrame:
    """(doc, text): a document for each hundred parts."""
    rows = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.expr(piece).alias("piece")))).alias("c"))
    return rows.select("doc", F.array_join(F.transform("c", lambda x: x.piece), "").alias("text"))


def _provisions_sql(piece: str, head: str, section: str, sections, standard: str, trim: bool) -> str:
    quoted = ", ".join("('" + r[0] + "', '" + r[1].replace("'", "''") + "')" for r in sections)
    body = f"regexp_extract(clause, '(?s)^{head}(.*)$', 2)"
    if trim:
        body = f"regexp_replace({_STRIP("regexp_replace(" + body + ", '(?s)\\n\\d+\\s.*', '')")}, '(?s)\\n(NOTE|EXAMPLE)\\s+\\d*:.*', '')"
    kept = "NOT (regexp_matches(body, '(?m)^\\s*[Vv]oid\\.?\\s*$') OR contains(substr(body, 1, 20), 'Void'))" if trim else "TRUE"
    return rf"""
WITH d AS (SELECT p_partkey // 100 AS doc, string_agg({piece}, '' ORDER BY p_partkey) AS text FROM part GROUP BY ALL),
c AS (SELECT doc, unnest(string_split(regexp_replace({_CLEAN("text")}, '(Provision\s+5\.\d)', chr(1) || '\1', 'g'), chr(1))) AS clause FROM d),
b AS (SELECT regexp_extract(clause, '^{head}', 1) AS provision_id, {_STRIP(body)} AS body FROM c WHERE regexp_matches(clause, '^{head}')),
s AS (SELECT provision_id, regexp_extract(provision_id, '^({section})', 1) AS section_id, body FROM b WHERE {kept})
SELECT provision_id, '{standard}' AS standard, s.section_id, coalesce(t.title, 'Unknown') AS title, body AS text,
  CASE WHEN contains(lower(body), 'shall') THEN 'shall' WHEN contains(lower(body), 'should') THEN 'should' WHEN contains(lower(body), 'may') THEN 'may' ELSE 'unknown' END AS modality
FROM s LEFT JOIN (VALUES {quoted}) t(section_id, title) ON t.section_id = s.section_id
"""


@query(_provisions_sql(_PIECE_A, r"Provision\s+(5\.\d{1,2}-\d+[A-Z]?)\s+", r"5\.\d+", S.SECTIONS_A, "EN 303 645", True))
def provisions_a(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.provisions_a(_standard(spark, sf, _PIECE_A), "text", readers.dimension(spark, S.SECTIONS_A))


@query(_provisions_sql(_PIECE_B, r"Provision\s+(5\.\d+\.\d+-\d+(?:\.\d+)?)\s+", r"5\.\d+\.\d+", S.SECTIONS_B, "EN 304 223", False))
def provisions_b(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.provisions_b(_standard(spark, sf, _PIECE_B), "text", readers.dimension(spark, S.SECTIONS_B))


def _standard_files(spark: SparkSession, sf: str, piece: str) -> str:
    """The documents of _standard as text files, a file each."""
    path = f"{scratch_dir(spark)}/standards-{uuid.uuid4().hex}"
    _standard(spark, sf, piece).write.partitionBy("doc").text(path)
    return path


@query(ORACLES["provisions_a"])
def provisions_a_files(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.provisions_a_of_files(spark, _standard_files(spark, sf, _PIECE_A), readers.dimension(spark, S.SECTIONS_A))


@query(ORACLES["provisions_b"])
def provisions_b_files(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.provisions_b_of_files(spark, _standard_files(spark, sf, _PIECE_B), readers.dimension(spark, S.SECTIONS_B))


@query(r"""
SELECT doc_id, n_chars FROM documents
WHERE NOT (regexp_matches(text, '(?m)^\s*[Oo]f\.?\s*$') OR contains(substr(text, 1, 20), 'The'))
""")
def void_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.filter(~X.is_void(F.col("text"), r"[Oo]f\.?", "The")).select("doc_id", "n_chars")


@query("""
SELECT doc_id, CASE WHEN contains(lower(text), 'that') THEN 'that' WHEN contains(lower(text), 'with') THEN 'with'
  WHEN contains(lower(text), 'from') THEN 'from' ELSE 'unknown' END AS modality FROM documents
""")
def modality_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.modality(F.col("text"), CUES).alias("modality"))


@query(r"""
SELECT p_partkey, k AS section_id, coalesce(title, 'Unknown') AS title
FROM (SELECT p_partkey, regexp_extract(p_brand, '(\d+)$', 1) AS k FROM part)
LEFT JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS section_id, n_name AS title FROM nation) ON k = section_id
""")
def id_prefix_dim_join(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.regexp_extract("p_brand", r"(\d+)$", 1).alias("section_id"))
    dim = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("section_id"), F.col("n_name").alias("title"))
    return extraction.titled(parts, dim).select("p_partkey", "section_id", "title")


@query(r"""
SELECT '5.' || p_size || '.' || p_partkey || '-1' AS clause, regexp_extract('5.' || p_size || '.' || p_partkey || '-1', '^(5\.\d+)', 1) AS section_id,
       regexp_extract('5.' || p_size || '.' || p_partkey || '-1', '^(5\.\d+\.\d+)', 1) AS principle_id FROM part
""")
def clause_sections(spark: SparkSession, sf: str) -> DataFrame:
    clause = F.concat(F.lit("5."), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"), F.lit("-1"))
    rows = table(spark, sf, "part").select(clause.alias("clause"))
    return rows.select("clause", X.section_of(F.col("clause")).alias("section_id"), X.section_of(F.col("clause"), 3).alias("principle_id"))


# ---------------------------------------------------------------- features

_KEYWORDS_SQL = rf"list_sort(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))), [{_quoted(VOCABULARY)}]))"


@query(f"SELECT doc_id, {_KEYWORDS_SQL} AS keywords FROM documents")
def keyword_sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.keywords(F.col("text"), VOCABULARY).alias("keywords"))


@query(f"""
WITH a AS (SELECT item_id, {_KEYWORDS_SQL} AS k FROM benchmark), b AS (SELECT doc_id, {_KEYWORDS_SQL} AS k FROM documents),
p AS (SELECT item_id AS src_id, doc_id AS tgt_id, list_sort(list_intersect(a.k, b.k)) AS shared_keywords, len(a.k) AS m, len(b.k) AS n FROM a, b),
s AS (SELECT *, len(shared_keywords) / (m + n - len(shared_keywords)) AS s FROM p WHERE len(shared_keywords) > 0)
SELECT src_id, tgt_id, round(s, 4) AS score, shared_keywords,
  CASE WHEN s >= 0.60 THEN 'EQUIVALENCE' WHEN s >= 0.35 THEN 'OVERLAP' WHEN s >= 0.15 THEN 'COMPLEMENTARITY' ELSE 'NO_RELATION' END AS predicted_rel
FROM s WHERE s >= 0.5
""")
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.jaccard_pairs(_items(spark, sf), _docs(spark, sf), VOCABULARY, 0.5)


# all pairs that the method reports by default, the lower labels too
@query(ORACLES["jaccard_pairs"].replace("WHERE s >= 0.5\n", f"WHERE s >= {S.PAIR_THRESHOLDS['jaccard']}\n"))
def jaccard_pairs_default(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.jaccard_pairs(_items(spark, sf), _docs(spark, sf), VOCABULARY)


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", "text")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def _tfidf_sql(second: str) -> str:
    return rf"""
WITH c AS (SELECT 'a' AS side, CAST(item_id AS VARCHAR) AS id, text FROM benchmark UNION ALL {second}),
w AS (SELECT side, id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains([{_quoted(STOP_WORDS)}], x)) AS ws FROM c),
t AS (SELECT side, id, unnest(ws) AS term FROM w
      UNION ALL SELECT side, id, ws[i] || ' ' || ws[i + 1] FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM w)),
tf AS (SELECT side, id, term, 1 + ln(count(*)) AS tf FROM t GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM c)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
raw AS (SELECT side, id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
nrm AS (SELECT side, id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY side, id),
wt AS (SELECT side, id, term, w / norm AS w FROM raw JOIN nrm USING (side, id)),
dot AS (SELECT a.id AS src_id, b.id AS tgt_id, sum(a.w * b.w) AS s FROM wt a JOIN wt b ON a.term = b.term AND a.side = 'a' AND b.side = 'b' GROUP BY a.id, b.id)
"""


_DOCS_SQL = "SELECT 'b', CAST(doc_id AS VARCHAR), text FROM documents"


@query(_tfidf_sql(_DOCS_SQL) + "SELECT side, id, term, round(w, 6) AS w FROM wt")
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    out = similarity.tfidf_weights(_items(spark, sf), _docs(spark, sf), STOP_WORDS)
    return out.select("side", "id", "term", F.round("w", 6).alias("w"))


@query(
    _tfidf_sql(_DOCS_SQL)
    + """SELECT src_id, tgt_id, round(s, 4) AS score,
  CASE WHEN s >= 0.60 THEN 'EQUIVALENCE' WHEN s >= 0.35 THEN 'OVERLAP' WHEN s >= 0.15 THEN 'COMPLEMENTARITY' ELSE 'NO_RELATION' END AS predicted_rel
FROM dot WHERE s >= 0.10"""
)
def tfidf_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.tfidf_pairs(_items(spark, sf), _docs(spark, sf), STOP_WORDS)


@query(
    _tfidf_sql("SELECT 'b', CAST(item_id AS VARCHAR), text FROM benchmark")
    + """SELECT a.id AS src_id, b.id AS tgt_id, round(coalesce(s, 0.0), 4) AS score
FROM (SELECT id FROM c WHERE side = 'a') a CROSS JOIN (SELECT id FROM c WHERE side = 'b') b LEFT JOIN dot ON src_id = a.id AND tgt_id = b.id"""
)
def tfidf_grid(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.tfidf_grid(_items(spark, sf), _items(spark, sf), STOP_WORDS)


@query("""
SELECT vec_id, i - 1 AS d, round(v[i] / greatest(n, 1e-9), 6) AS x
FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n, unnest(range(1, len(v) + 1)) AS i
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))
""")
def l2_normalise(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(X.l2_normalised(F.col("embedding"))).alias("d", "x"))
    return rows.select("vec_id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


@query("""
SELECT label AS id, d, round(avg(x), 6) AS x
FROM (SELECT label, i - 1 AS d, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id % 3 <> 0))
GROUP BY label, d
""")
def mean_pooling(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), (F.col("vec_id") % 3).alias("mask"))
    out = similarity.mean_pooled(rows).select("id", F.posexplode("vector").alias("d", "x"))
    return out.select("id", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


# ---------------------------------------------------------------- pairs


@query("SELECT item_id AS src_id, r_regionkey AS tgt_id, text AS src_text, r_name AS tgt_text FROM benchmark, region")
def candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.candidate_pairs(_items(spark, sf), table(spark, sf, "region").select("r_regionkey", "r_name"))


_COSINE_SQL = """
WITH e AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-9)) AS v
           FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
s AS (SELECT a.vec_id AS src_id, b.vec_id AS tgt_id, list_dot_product(a.v, b.v) AS s FROM e a, e b WHERE a.vec_id % 50 = 0)
SELECT src_id, tgt_id, round(s, 4) AS score,
  CASE WHEN s >= 0.40 THEN 'EQUIVALENCE' WHEN s >= 0.30 THEN 'OVERLAP' WHEN s >= 0.20 THEN 'COMPLEMENTARITY' ELSE 'NO_RELATION' END AS predicted_rel
FROM s WHERE s >= 0.1500001
"""


def _search(spark: SparkSession, sf: str) -> DataFrame:
    """A search: every vector whose id is divisible by 50 against all."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return similarity.cosine_pairs(rows, rows.filter("vec_id % 50 = 0"), 0.1500001, CUTS).select(F.col("tgt_id").alias("src_id"), F.col("src_id").alias("tgt_id"), "score", "predicted_rel")


@query(_COSINE_SQL)
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf)


@query(_COSINE_SQL + " AND src_id <> tgt_id ORDER BY score DESC, src_id, tgt_id LIMIT 10")
def topk_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.ranked(_search(spark, sf).filter("src_id <> tgt_id"), 10)


@query(f"""
WITH p AS ({_COSINE_SQL}), t AS (SELECT {matrix.TILE} AS size),
r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS at FROM (SELECT DISTINCT src_id AS id FROM p)),
c AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS at FROM (SELECT DISTINCT tgt_id AS id FROM p)),
m AS (SELECT r.at // size AS tile_row, c.at // size AS tile_col, r.at % size AS y, c.at % size AS x, CAST(round(score * 10000) AS BIGINT) AS v,
        least(size, (SELECT count(*) FROM r) - r.at // size * size) AS n_rows, least(size, (SELECT count(*) FROM c) - c.at // size * size) AS n_cols
      FROM p JOIN r ON src_id = r.id JOIN c ON tgt_id = c.id, t)
SELECT tile_row, tile_col, n_rows, n_cols, count(*) AS cells, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * n_cols + x)) AS BIGINT) AS moment
FROM m GROUP BY tile_row, tile_col, n_rows, n_cols
""")
def matrix_tiles(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/matrix-{uuid.uuid4().hex}"
    matrix.write_matrix(_search(spark, sf), path)
    tiles = matrix.read_matrix(spark, path)[2]
    v = F.transform("values", lambda x: F.round(x * 10000).cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x)
    out = tiles.withColumn("v", v).withColumn("cells", F.size(F.filter("v", lambda x: x != 0)).cast("long"))
    return out.select("tile_row", "tile_col", "n_rows", "n_cols", "cells", total(F.col("v")).alias("total"), total(F.transform("v", lambda x, i: x * i)).alias("moment"))


# ---------------------------------------------------------------- prompts and answers

TEMPLATE = "Which of the labels fits?\nA: {first}\nB: {second}\nOne label only."


@query("SELECT conv_id, turn, 'Which of the labels fits?' || chr(10) || 'A: ' || role || chr(10) || 'B: ' || text || chr(10) || 'One label only.' AS prompt FROM conversations")
def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", X.prompt(TEMPLATE, first=F.col("role"), second=F.col("text")).alias("prompt"))


@query("""
SELECT item_id, CAST(to_json({'contents': [{'role': 'user', 'parts': [{'text': text}]}], 'config': {'temperature': 0, 'candidate_count': 1}}) AS VARCHAR) AS request
FROM benchmark
""")
def request_json(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("item_id", F.to_json(X.request(F.col("text"))).alias("request"))


_ANSWERS = [(1, " overlap\n"), (2, "Label: EQUIVALENCE."), (3, "complementarity or overlap"), (4, "SUBSUMPTION"), (5, "subsumption_b_broader"), (6, "")]


@query(
    "WITH v(id, answer) AS (VALUES "
    + ", ".join(f"({i}, '{a}')" if "\n" not in a else f"({i}, '{a.strip()}')" for i, a in _ANSWERS)
    + """), c AS (SELECT conv_id * 1000 + turn + 100 AS id, text AS answer FROM conversations UNION ALL SELECT * FROM v), u AS (SELECT id, upper(answer) AS a FROM c)
SELECT id, CASE """
    + " ".join(f"WHEN contains(a, '{x}') THEN '{x}'" for x in S.LABELS)
    + " ELSE 'NO_RELATION' END AS label FROM u"
)
def label_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 100).alias("id"), F.col("text").alias("answer"))
    rows = rows.union(spark.createDataFrame(_ANSWERS, "id long, answer string"))
    return rows.select("id", X.parse_label(F.col("answer")).alias("label"))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """(pair_id, conv_id, turn, response): stored responses, each third one with a text, with parts of a candidate, or with neither."""
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "conv_id", "turn", F.col("text").alias("t"))
    label = F.element_at(F.array(*map(F.lit, S.LABELS)), (F.pmod(F.col("pair_id"), F.lit(len(S.LABELS))) + 1).cast("int"))
    whole = F.to_json(F.struct(F.concat(label, F.lit(": "), "t").alias("text")))
    parts = F.array(F.struct(F.substring(label, 1, 4).alias("text")), F.struct(F.concat(F.substring(label, 5, 99), F.lit(" "), "t").alias("text")))
    nested = F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates")))
    kind = F.pmod("pair_id", F.lit(3))
    return rows.select("pair_id", "conv_id", "turn", F.when(kind == 0, whole).when(kind == 1, nested).otherwise("{}").alias("response"))


_RESPONSE_SQL = f"""
WITH r AS (SELECT conv_id * 1000 + turn AS pair_id, conv_id, turn, text AS t, [{_quoted(S.LABELS)}][1 + (conv_id * 1000 + turn) % {len(S.LABELS)}] AS label FROM conversations),
j AS (SELECT pair_id, conv_id, turn, CAST(CASE pair_id % 3 WHEN 0 THEN to_json({{'text': label || ': ' || t}})
  WHEN 1 THEN to_json({{'candidates': [{{'content': {{'parts': [{{'text': substr(label, 1, 4)}}, {{'text': substr(label, 5) || ' ' || t}}]}}}}]}}) ELSE '{{}}' END AS JSON) AS response FROM r),
a AS (SELECT pair_id, conv_id, turn, coalesce(json_extract_string(response, '$.text'), array_to_string(json_extract_string(response, '$.candidates[0].content.parts[*].text'), ''), '') AS answer FROM j)
"""


@query(_RESPONSE_SQL + "SELECT pair_id, answer FROM a")
def response_decode(spark: SparkSession, sf: str) -> DataFrame:
    return _responses(spark, sf).select("pair_id", X.response_text(F.col("response")).alias("answer"))


@query(
    _RESPONSE_SQL
    + "SELECT 'stored' AS method, CAST(conv_id AS STRING) AS src_id, CAST(turn AS STRING) AS tgt_id, CASE WHEN turn = 2 OR conv_id % 7 = 0 THEN 'NO_RELATION' "
    + " ".join(f"WHEN contains(upper(answer), '{x}') THEN '{x}'" for x in S.LABELS)
    + " ELSE 'NO_RELATION' END AS predicted_rel FROM a"
)
def stored_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = _responses(spark, sf)
    failed = F.when(F.col("turn") == 2, "failed")
    answers = rows.filter("conv_id % 7 <> 0").select("pair_id", "response", failed.alias("error"))
    pairs = rows.select("pair_id", F.col("conv_id").cast("string").alias("src_id"), F.col("turn").cast("string").alias("tgt_id"))
    return providers.label_pairs(pairs, answers, "stored").drop("score")


def _stub_service():
    """A labelling service without a network: the label follows from the length of the text, every seventh length fails."""

    def ask(keys, requests):
        texts = [json.loads(r)["contents"][0]["parts"][0]["text"] for r in requests]
        return [{"error": "busy"} if len(t) % 7 == 0 else {"response": {"text": S.LABELS[len(t) % 3]}} for t in texts]

    return ask


@query(f"""
SELECT 'ledger' AS method, CAST(conv_id AS VARCHAR) AS src_id, CAST(turn AS VARCHAR) AS tgt_id,
  CASE WHEN text IS NULL OR length(text) % 7 = 0 THEN 'NO_RELATION' {" ".join(f"WHEN length(text) % 3 = {i} THEN '{S.LABELS[i]}'" for i in range(3))} END AS predicted_rel
FROM conversations
""")
def ledger_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    pairs = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("conv_id").cast("string").alias("src_id"), F.col("turn").cast("string").alias("tgt_id"), "text")
    path = f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
    return ledger.label_with_ledger(pairs, F.col("text"), _stub_service, "ledger", path, attempts=2).drop("score")


@query("SELECT vec_id, i - 1 AS d, CAST(CAST(embedding[i] AS STRING) AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def stored_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    values = F.struct(F.col("embedding").alias("values"))
    response = F.when(F.col("vec_id") % 2 == 0, F.to_json(F.struct(values.alias("embedding")))).otherwise(F.to_json(F.struct(F.array(values).alias("embeddings"))))
    rows = table(spark, sf, "embeddings").select("vec_id", F.explode(X.response_embeddings(response)).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("d", "x")).select("vec_id", F.col("d").cast("long").alias("d"), "x")


# ---------------------------------------------------------------- evaluation

_TRUTH_SQL = """
truth AS (
  SELECT CAST(doc_id AS VARCHAR) AS src_id, source AS tgt_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'EQUIVALENCE' WHEN quality = 1 THEN 'OVERLAP'
    WHEN toxic = 1 THEN 'SUBSUMPTION_A_BROADER' ELSE 'NO_RELATION' END AS relationship
  FROM documents JOIN labels USING (doc_id)
), preds AS (
  SELECT 'length_rule' AS method, CAST(doc_id AS VARCHAR) AS src_id, source AS tgt_id, CASE WHEN n_chars < 300 THEN 'NO_RELATION' WHEN n_chars < 2500 THEN 'OVERLAP'
    WHEN n_chars < 4000 THEN 'COMPLEMENTARITY' WHEN n_chars < 6000 THEN 'EQUIVALENCE' ELSE 'SUBSUMPTION_B_BROADER' END AS predicted_rel FROM documents
  UNION ALL
  SELECT 'language_rule', CAST(doc_id AS VARCHAR), source, CASE WHEN lang = 'en' THEN 'OVERLAP' WHEN lang = 'de' THEN 'EQUIVALENCE' ELSE 'SUBSUMPTION_B_BROADER' END
  FROM documents WHERE lang <> 'fr'
), methods(method, method_order) AS (VALUES ('length_rule', 0), ('language_rule', 1), ('silent_rule', 2))
"""
_MERGE = lambda c: f"CASE WHEN {c} LIKE 'SUBSUMPTION_%' THEN 'SUBSUMPTION' ELSE {c} END"
_CMP_SQL = (
    "WITH "
    + _TRUTH_SQL
    + f""", cmp AS (
  SELECT m.method, t.src_id, t.tgt_id, {_MERGE("relationship")} AS true_rel, coalesce({_MERGE("predicted_rel")}, 'NO_RELATION') AS pred_rel
  FROM truth t CROSS JOIN methods m LEFT JOIN preds p ON p.method = m.method AND p.src_id = t.src_id AND p.tgt_id = t.tgt_id
), cm AS (SELECT method, true_rel, pred_rel, count(*) AS n FROM cmp GROUP BY ALL)
, cls AS (
  SELECT r.method, r.label, support, round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 4) AS f1
  FROM (SELECT r.method, r.label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS q
    FROM (SELECT method, true_rel AS label, CAST(sum(n) AS BIGINT) AS support, coalesce(sum(n) FILTER (WHERE true_rel = pred_rel), 0) AS tp FROM cm GROUP BY ALL) r
    LEFT JOIN (SELECT method, pred_rel AS label, sum(n) AS predicted FROM cm GROUP BY ALL) c USING (method, label)) r
), macro AS (
  SELECT method, accuracy, macro_precision, macro_recall, macro_f1
  FROM (SELECT method, round(sum(n) FILTER (WHERE true_rel = pred_rel) / sum(n), 4) AS accuracy FROM cm GROUP BY method)
  JOIN (SELECT method, round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1 FROM cls GROUP BY method) USING (method)
), pos AS (SELECT src_id, tgt_id FROM truth WHERE relationship <> 'NO_RELATION' GROUP BY ALL)
, neg AS (SELECT src_id, tgt_id FROM truth WHERE relationship = 'NO_RELATION' GROUP BY ALL)
, det AS (
  SELECT method, p AS positive_pairs, q AS negative_pairs, n AS predicted_pairs, tp AS true_positives, n - tp AS false_positives, p - tp AS false_negatives,
    round(CASE WHEN n > 0 THEN tp / n ELSE 0.0 END, 4) AS precision, round(CASE WHEN p > 0 THEN tp / p ELSE 0.0 END, 4) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (n + p) ELSE 0.0 END, 4) AS f1
  FROM (SELECT m.method, (SELECT count(*) FROM pos) AS p, (SELECT count(*) FROM neg) AS q, count(f.src_id) AS n, count(pos.src_id) AS tp
    FROM methods m LEFT JOIN (SELECT DISTINCT method, src_id, tgt_id FROM preds SEMI JOIN truth USING (src_id, tgt_id) WHERE predicted_rel <> 'NO_RELATION') f ON f.method = m.method
    LEFT JOIN pos ON pos.src_id = f.src_id AND pos.tgt_id = f.tgt_id GROUP BY m.method)
)
"""
)


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    rel = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "EQUIVALENCE").when(F.col("quality") == 1, "OVERLAP")
    rel = rel.when(F.col("toxic") == 1, "SUBSUMPTION_A_BROADER").otherwise("NO_RELATION")
    return docs.join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("src_id"), F.col("source").alias("tgt_id"), rel.alias("relationship"))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang")
    pair = [F.col("doc_id").cast("string").alias("src_id"), F.col("source").alias("tgt_id")]
    n, lang = F.col("n_chars"), F.col("lang")
    by_length = F.when(n < 300, "NO_RELATION").when(n < 2500, "OVERLAP").when(n < 4000, "COMPLEMENTARITY").when(n < 6000, "EQUIVALENCE").otherwise("SUBSUMPTION_B_BROADER")
    by_lang = F.when(lang == "en", "OVERLAP").when(lang == "de", "EQUIVALENCE").otherwise("SUBSUMPTION_B_BROADER")
    out = docs.select(F.lit(METHODS[0]).alias("method"), *pair, by_length.alias("predicted_rel"))
    return out.union(docs.filter(lang != "fr").select(F.lit(METHODS[1]), *pair, by_lang))


def _methods(spark: SparkSession) -> DataFrame:
    return E.method_dimension(spark, METHODS)


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    return E.compared(_truth(spark, sf), _predictions(spark, sf), _methods(spark))


def _confusion(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion_matrix(_compared(spark, sf))


@query(_CMP_SQL + "SELECT * FROM det")
def detection_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.detection_metrics(_truth(spark, sf), _predictions(spark, sf), _methods(spark))


@query(_CMP_SQL + "SELECT * FROM cls")
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.class_metrics(_confusion(spark, sf))


@query(_CMP_SQL + "SELECT * FROM cm")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _confusion(spark, sf)


@query(_CMP_SQL + "SELECT * FROM macro")
def macro_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.macro_metrics(_confusion(spark, sf))


@query(_CMP_SQL + "SELECT method, src_id, tgt_id, true_rel, pred_rel, true_rel = pred_rel AS correct FROM cmp")
def comparison(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf)


def _errors_sql(strict: bool) -> str:
    order = ["true_rel <> 'NO_RELATION' AND pred_rel = 'NO_RELATION'|FALSE_NEGATIVE|labelled pair that the method missed", "true_rel <> pred_rel AND pred_rel <> 'NO_RELATION'|WRONG_LABEL|pair found with another label", "true_rel = 'NO_RELATION' AND pred_rel <> 'NO_RELATION'|FALSE_POSITIVE_ON_NEGATIVE|relation predicted for an unrelated pair"]
    order = [order[0], order[2], order[1]] if strict else order
    case = lambda i: "CASE " + " ".join(f"WHEN {t.split('|')[0]} THEN '{t.split('|')[i]}'" for t in order) + " END"
    return _CMP_SQL + f"SELECT method, {case(1)} AS error_type, src_id, tgt_id, true_rel, pred_rel, {case(2)} AS note FROM cmp WHERE true_rel <> pred_rel"


@query(_errors_sql(False))
def error_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return E.error_analysis(_compared(spark, sf))


@query(_errors_sql(True))
def error_analysis_strict(spark: SparkSession, sf: str) -> DataFrame:
    return E.error_analysis(_compared(spark, sf), strict=True)


@query("WITH " + _TRUTH_SQL + "SELECT relationship, count(*) AS n FROM truth GROUP BY ALL")
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.value_counts(_truth(spark, sf), "relationship")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.value_counts(table(spark, sf, "events"), "event_type")


@query("WITH " + _TRUTH_SQL + f"SELECT DISTINCT {_MERGE('relationship')} AS label FROM truth")
def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    return E.distinct_labels(_truth(spark, sf).select(X.merged_label(F.col("relationship")).alias("label")), "label")


@query("WITH " + _TRUTH_SQL + f"SELECT src_id, tgt_id, relationship, {_MERGE('relationship')} AS merged FROM truth")
def normalise_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _truth(spark, sf).withColumn("merged", X.merged_label(F.col("relationship")))


@query(_CMP_SQL + "SELECT macro.* FROM macro JOIN methods USING (method) ORDER BY macro_f1 DESC, method_order LIMIT 1")
def best_method(spark: SparkSession, sf: str) -> DataFrame:
    return E.best_method(E.macro_metrics(_confusion(spark, sf)), _methods(spark))


@query(
    _CMP_SQL
    + "SELECT method, "
    + ", ".join(f"CAST(round({c} * 100, 1) AS DECIMAL(9, 1)) || '%' AS {c}_pct" for c in ("precision", "recall", "f1", "accuracy", "macro_f1"))
    + " FROM det JOIN macro USING (method)"
)
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    detection = E.detection_metrics(_truth(spark, sf), _predictions(spark, sf), _methods(spark))
    return E.report_rows(detection, E.macro_metrics(_confusion(spark, sf)), _methods(spark))


_SETS_SQL = "WITH " + _TRUTH_SQL + ", a AS (SELECT src_id, tgt_id FROM truth WHERE relationship <> 'NO_RELATION'), b AS (SELECT src_id, tgt_id FROM preds WHERE predicted_rel <> 'NO_RELATION') SELECT * FROM a {} SELECT * FROM b"


def _sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _truth(spark, sf).filter("relationship <> 'NO_RELATION'"), _predictions(spark, sf).filter("predicted_rel <> 'NO_RELATION'")


@query(_SETS_SQL.format("UNION"))
def pair_union(spark: SparkSession, sf: str) -> DataFrame:
    return E.pair_union(*_sets(spark, sf))


@query(_SETS_SQL.format("INTERSECT"))
def pair_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return E.pair_intersect(*_sets(spark, sf))


@query(_SETS_SQL.format("EXCEPT") + " WHERE src_id IN (SELECT src_id FROM preds WHERE method = 'language_rule')")
def pair_except(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sets(spark, sf)[0], _predictions(spark, sf).filter("predicted_rel <> 'NO_RELATION'")
    return E.pair_except(a, b.join(b.filter(F.col("method") == METHODS[1]).select("src_id").distinct(), "src_id", "left_semi"))


# ---------------------------------------------------------------- files


def _file(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("WITH " + _TRUTH_SQL + f"""SELECT src_id, tgt_id, relationship, 'says "' || relationship || '", twice' || chr(10) || 'or so' AS justification, 2 AS confidence, {_MERGE('relationship')} AS relationship_merged FROM truth""")
def truth_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _file(spark, "truth")
    why = F.concat(F.lit('says "'), "relationship", F.lit('", twice\nor so'))
    sinks.write_csv(_truth(spark, sf).select("src_id", "tgt_id", "relationship", why.alias("justification"), F.lit(2).alias("confidence")), path)
    return readers.read_truth(spark, path)


@query("WITH " + _TRUTH_SQL + f"SELECT method, src_id, tgt_id, 0.5 AS score, predicted_rel, {_MERGE('predicted_rel')} AS predicted_rel_merged FROM preds")
def predictions_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _file(spark, "predictions")
    for m in METHODS[:2]:
        sinks.write_csv(_predictions(spark, sf).filter(F.col("method") == m).select("src_id", "tgt_id", F.lit(0.5).alias(f"{m}_score"), "predicted_rel"), f"{path}/{m}")
    found, _ = readers.read_all_predictions(spark, {m: f"{path}/{m}" for m in METHODS})
    return found.drop("ord")


@query("SELECT CAST(n_nationkey AS STRING) AS provision_id, 'EN' AS standard, CAST(n_regionkey AS STRING) AS section_id, n_name AS title, 'of ' || n_name AS text, 'may' AS modality FROM nation")
def provisions_json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _file(spark, "provisions")
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("provision_id"), F.lit("EN").alias("standard"), F.col("n_regionkey").cast("string").alias("section_id"), F.col("n_name").alias("title"), F.concat(F.lit("of "), "n_name").alias("text"), F.lit("may").alias("modality"))
    sinks.write_json_array(rows, path)
    return readers.without_void(readers.read_provisions(spark, path))


@query("SELECT CAST(doc_id AS VARCHAR) AS provision_id, lang AS standard, source AS section_id, CAST(n_chars AS VARCHAR) AS title, text, 'may' AS modality FROM documents WHERE doc_id % 7 <> 0")
def void_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON arrays, read back by ranges of bytes; every seventh is marked as void and goes."""
    path = _file(spark, "marked")
    text = lambda c: F.col(c).cast("string")
    rows = table(spark, sf, "documents").select(text("doc_id").alias("provision_id"), F.col("lang").alias("standard"), F.col("source").alias("section_id"), text("n_chars").alias("title"), "text", F.lit("may").alias("modality"), F.when(F.col("doc_id") % 7 == 0, True).alias("is_void"))
    sinks.write_json_arrays(rows, path)
    return readers.without_void(readers.read_provisions(spark, path))


@query("SELECT doc_id, text, lang, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS number FROM documents")
def json_array_order(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as one JSON array in one file, the longest first, read back by ranges of bytes with the place of each record."""
    path = _file(spark, "ordered")
    docs = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id")
    sinks.write_json_array(docs.select("doc_id", "text", "lang", "source"), path)
    back = records.json_records(spark, path)
    kinds = "doc_id long, text string, lang string, source string"
    return back.select(F.from_json("record", kinds).alias("r"), F.col("row").alias("number")).select("r.*", "number")


@query("SELECT doc_id, 'says \"' || text || '\",' || chr(10) || lang AS text, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents")
def csv_line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, line breaks and quotes included, as CSV in the order of their ids, read back by ranges of bytes with the number of each row."""
    path = _file(spark, "lines")
    said = F.concat(F.lit('says "'), "text", F.lit('",\n'), "lang")
    sinks.write_csv(table(spark, sf, "documents").select(F.col("doc_id"), said.alias("text")).orderBy("doc_id"), path)
    back = records.numbered(records.read_csv(spark, path))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "number")


@query(_CMP_SQL + "SELECT cls.method, label, support, cls.precision, cls.recall, cls.f1, accuracy, det.f1 AS detection_f1 FROM cls JOIN macro USING (method) JOIN det ON det.method = cls.method")
def metrics_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    detection = E.detection_metrics(_truth(spark, sf), _predictions(spark, sf), _methods(spark))
    confusion = _confusion(spark, sf)
    path = _file(spark, "metrics")
    rows = sinks.summary(detection, E.macro_metrics(confusion), E.class_metrics(confusion))
    sinks.write_metrics(rows, path)
    back = readers.read_summary(spark, path, rows.schema)
    per = back.select("method", F.explode("classification.per_class").alias("label", "m"), "classification.accuracy", F.col("detection.f1").alias("detection_f1"))
    return per.select("method", "label", "m.support", "m.precision", "m.recall", "m.f1", "accuracy", "detection_f1")


@query("WITH " + _TRUTH_SQL + "SELECT count(*) AS n_rows, count(*) FILTER (WHERE relationship <> 'NO_RELATION') AS related FROM truth")
def observed_counts(spark: SparkSession, sf: str) -> DataFrame:
    df, seen = E.counted(_truth(spark, sf), "truth", related="relationship <> 'NO_RELATION'")
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["related"])], "n_rows long, related long")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.06 THEN 'EQUIVALENCE' WHEN l_discount >= 0.04 THEN 'OVERLAP' WHEN l_discount >= 0.02 THEN 'COMPLEMENTARITY' ELSE 'NO_RELATION' END AS label,
  printf('%.3f', l_discount) AS shown, CASE WHEN l_tax > 0 THEN round(l_discount / l_tax, 4) ELSE 0.0 END AS ratio FROM lineitem
""")
def score_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("l_discount")
    cuts = [(0.06, "EQUIVALENCE"), (0.04, "OVERLAP"), (0.02, "COMPLEMENTARITY")]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.label_of(d, cuts).alias("label"), X.decimal3(d).alias("shown"), F.round(X.safe_ratio(d, F.col("l_tax")), 4).alias("ratio"))


@query(f"SELECT doc_id, CASE WHEN len(k) > 0 THEN '[''' || array_to_string(k, ''', ''') || ''']' ELSE '[]' END AS shown FROM (SELECT doc_id, {_KEYWORDS_SQL} AS k FROM documents)")
def keyword_list_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.list_text(X.keywords(F.col("text"), VOCABULARY)).alias("shown"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
