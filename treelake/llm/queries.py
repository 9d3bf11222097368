"""The registered queries of this subpackage: thin layers that apply an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, gif, license_scan, line_dedup, minhash, nbest, packing, quality, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(df: DataFrame, score: str, fold: str) -> DataFrame:
    s = F.col(score)
    return df.select("doc_id", F.expr(fold).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines_removed", F.length("text").alias("chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model).drop("text")
    return _scored(scored, "toxicity", "crc32(cast(doc_id as string)) % 5 = 0")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(_table(spark, sf_dir, "documents"), words=2, similarity=(80, 100))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, _table(spark, sf_dir, "labels"))
    return _scored(quality.add_quality(docs, model).drop("text"), "quality_score", "crc32(cast(doc_id as string)) % 3 = 1")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.text_media(_table(spark, sf_dir, "documents"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op10_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.nbest_encode(_table(spark, sf_dir, "documents"), decode=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_line_dedup, op3_toxicity, op4_minhash, op5_quality, op6_chat, op7_gif, op8_license, op9_exact_dedup, op10_nbest)} | {"pipeline": pipeline}

OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: Line runs in SQL: with min_lines 2 and min_words 10, a line goes if it is a later copy of a long line or belongs to
#: a later copy of two successive lines.
OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY seq) AS nxt FROM s),
f AS (
  SELECT doc_id, pos, seq, words, row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) > 1 AS later,
         nxt IS NOT NULL AND row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, seq) > 1 AS run FROM n),
g AS (SELECT doc_id, pos, (later AND words >= 10) OR run OR coalesce(lag(run) OVER (PARTITION BY doc_id ORDER BY seq), false) AS gone FROM f),
k AS (
  SELECT l.doc_id, string_agg(CASE WHEN NOT coalesce(gone, false) THEN line END, chr(10) ORDER BY l.pos) AS t, count(*) FILTER (WHERE gone) AS removed
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT k.doc_id, CAST(removed AS INTEGER) AS lines_removed, CAST(length(coalesce(t, '')) AS INTEGER) AS chars_left, sha256(coalesce(t, '')) AS text_sha256 FROM k
"""

#: Bounds by the same dynamic programme, layer by layer; the numbering holds for buckets of one shard.
OP1_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
h AS (SELECT n, row_number() OVER (ORDER BY n) AS j, CAST(sum(count(*)) OVER (ORDER BY n) AS BIGINT) AS r FROM t GROUP BY n),
dp AS (
  SELECT 1 AS k, j, {'c': n * r, 'i': CAST(0 AS BIGINT)} AS best FROM h
  UNION ALL
  SELECT k + 1, j, best FROM (
    SELECT d.k, h.j, min({'c': d.best.c + h.n * (h.r - p.r), 'i': p.j}) AS best FROM dp d JOIN h p ON d.j = p.j JOIN h ON h.j > d.j WHERE d.k < 16 GROUP BY d.k, h.j)),
back AS (
  SELECT k, j, best.i AS i FROM dp WHERE j = (SELECT max(j) FROM h) AND k = (SELECT least(16, count(*)) FROM h)
  UNION ALL
  SELECT d.k, d.j, d.best.i FROM back b JOIN dp d ON d.k = b.k - 1 AND d.j = b.i),
bounds AS (SELECT n AS bound, CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS bucket, greatest(1, 16384 // greatest(1, n)) AS cap FROM back JOIN h USING (j)),
put AS (SELECT doc_id, n, (SELECT min(bound) FROM bounds WHERE bound >= n) AS bound FROM t),
numbered AS (SELECT put.*, bucket, cap, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, n) - 1 AS place FROM put JOIN bounds USING (bound))
SELECT doc_id, n AS n_tokens, bucket, bound AS bucket_len, place // cap AS batch, place % cap AS slot, bound - n AS padding FROM numbered
"""

#: All pairs that share a shingle, then reachability.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 80 * (x.c + y.c - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(c, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS m FROM r GROUP BY node) USING (doc_id)
"""

ORACLE_SQL = {"op1_packing": OP1_SQL, "op2_line_dedup": OP2_SQL, "op4_minhash": OP4_SQL, "op6_chat": chat.ORACLE_SQL, "op9_exact_dedup": OP9_SQL}
