"""Registered queries of the text operators and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "copy", "mix_key", "text")


OP10_SQL = """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(CAST(n AS DOUBLE), 0.7) AS w FROM c),
r AS (SELECT source, w / (SELECT sum(w) FROM w) * (SELECT sum(n) FROM w) * 1.0 / n AS rate FROM w),
d AS (SELECT r.source, k, rate, list_sum(list_transform(range(0, k + 1), lambda j: exp(-rate) * pow(rate, j) / gamma(j + 1.0))) AS cdf
      FROM r, range(0, 60) t(k) WHERE k <= rate + 8 * sqrt(rate) + 16),
u AS (SELECT doc_id, source, text, CAST(CAST('0x' || substr(md5('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM documents),
n AS (SELECT u.doc_id, u.source, u.text, (SELECT count(*) FROM d WHERE d.source = u.source AND d.cdf <= u.u) AS n FROM u)
SELECT doc_id, source, CAST(i AS INTEGER) AS copy, md5('mix-1:order:' || CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR)) AS mix_key, text
FROM n, range(0, 60) t(i) WHERE i < n
"""

def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.tokens import count_tokens, public_path

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_path("byte_bpe_50k.json"), limit=1024)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.quality import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.linededup import drop_repeated_runs

    return drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS line FROM t),
s AS (SELECT doc_id, line, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM l),
f AS (SELECT doc_id, line, s, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos,
             len(regexp_split_to_array(s, '[\x20\x09-\x0D]+')) AS w FROM s WHERE s <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM f),
r AS (SELECT a.doc_id, a.pos AS p1, min(b.pos) AS p2 FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto >= a.upto - a.w + 50 GROUP BY 1, 2
      UNION
      SELECT b.doc_id, max(a.pos), b.pos FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto >= a.upto - a.w + 50 GROUP BY b.doc_id, b.pos),
n AS (SELECT r.doc_id, p1, p2, string_agg(s, chr(10) ORDER BY pos) AS body FROM r JOIN c ON c.doc_id = r.doc_id AND pos BETWEEN p1 AND p2 GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, p1) AS nth FROM n),
g AS (SELECT DISTINCT c.doc_id, c.line FROM k JOIN c ON c.doc_id = k.doc_id AND c.pos BETWEEN p1 AND p2 WHERE nth > 1),
o AS (SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.line) AS text FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line = l.line WHERE g.line IS NULL GROUP BY 1)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text, CAST(len(parts) AS INTEGER) AS n_lines,
       CAST((SELECT count(*) FROM g WHERE g.doc_id = t.doc_id) AS INTEGER) AS removed_lines
FROM t LEFT JOIN o ON o.doc_id = t.doc_id
"""


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import pack, pieces_digest
    from gridloom.llm.tokens import public_path

    return pieces_digest(pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json")))


def op6_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from gridloom.llm._common import shared_dir
    from gridloom.llm.audio import read_media, store_media

    path = f"{shared_dir(spark)}/audio-{uuid.uuid4().hex}"
    store_media(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    # A row holds five times its text, and the result is read after this function ends, so the session keeps smaller batches.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return read_media(spark.read.parquet(path))


def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.jaccard import near_components

    return near_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.html import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from gridloom.llm._common import shared_dir
    from gridloom.llm.repair import read_shards, write_shards
    from gridloom.llm.tokens import public_path

    path = f"{shared_dir(spark)}/repair-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), path, public_path("word_bpe_49k.json"), end_id=2)
    return read_shards(spark, path, with_ids=False)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_curve_packing": op5_curve_packing,
    "op6_telephony_audio": op6_telephony_audio,
    "op7_jaccard_components": op7_jaccard_components,
    "op8_main_text": op8_main_text,
    "op9_repair_files": op9_repair_files,
    "op10_poisson_mix": op10_poisson_mix,
}
ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op4_line_dedup": OP4_SQL,
    "op10_poisson_mix": OP10_SQL,
}
