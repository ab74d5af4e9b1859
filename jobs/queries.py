"""The jobs as registered queries: each runs twice into one new folder; the result is the output after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import image_votes, label_texts
from voxelweave import catalog
from voxelweave.stage import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """In the shared folder; what a job wrote there stays."""
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_image_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "image_votes")
    for _ in range(2):
        done = image_votes.run(spark, f"{sf_dir}/embeddings.parquet", out)
    r = catalog.r
    return done.select("image", "label", r("votes", 5).alias("votes"), "cnt", r("share", 5).alias("share"), r("loglik", 4).alias("loglik"), "place")


def job2_label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "label_texts")
    # a stream reads folders: the pattern fits the table whether it is a file or a folder of files
    for _ in range(2):
        done = label_texts.run(spark, f"{sf_dir}/documents.parque[t]", f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    r = catalog.r
    return done.select("doc_id", "source", "label", r("votes", 5).alias("votes"), r("share", 5).alias("share"), "nearest", F.col("dist").cast("long").alias("dist"))


QUERIES = {f.__name__: f for f in (job1_image_votes, job2_label_texts)}

_LOGLIK = catalog.ORACLE["label_loglik"]

ORACLE = {
    "job1_image_votes": f"""
WITH lk AS ({_LOGLIK}), vt AS (WITH {catalog._VOTES} SELECT * FROM votes),
b AS (SELECT lk.image, lk.label, coalesce(vt.votes, 0) AS votes, coalesce(vt.cnt, 0) AS cnt, lk.loglik FROM lk LEFT JOIN vt ON lk.image = vt.image AND lk.label = vt.label)
SELECT image, label, round(votes, 5) + 0.0 AS votes, cnt, round(coalesce(votes / nullif(sum(votes) OVER (PARTITION BY image), 0), 0), 5) + 0.0 AS share, loglik,
       row_number() OVER (PARTITION BY image ORDER BY round(votes, 9) DESC, label)::INT AS place FROM b""",
    "job2_label_texts": """
WITH d AS (SELECT doc_id, source, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::INT) AS b FROM documents),
n AS (SELECT doc_id, unnest(list_zip(b[1:-2], b[2:])) AS z FROM d),
g AS (SELECT doc_id, ((z[2] - z[1]) % 64 + 64) % 64 AS bin, count(*) AS n FROM n WHERE z[2] IS NOT NULL GROUP BY 1, 2),
h AS (SELECT d.doc_id, r.bin, coalesce(g.n, 0) AS n FROM d CROSS JOIN (SELECT unnest(range(64)) AS bin) r LEFT JOIN g ON g.doc_id = d.doc_id AND g.bin = r.bin),
k AS (SELECT doc_id, bin, row_number() OVER (PARTITION BY doc_id ORDER BY n, bin) - 1 AS rk FROM h),
p AS (SELECT doc_id, list(rk ORDER BY bin) AS pc FROM k GROUP BY doc_id),
a AS (SELECT p.doc_id, p.pc, l.quality AS label FROM p JOIN labels l ON l.doc_id = p.doc_id),
nn AS (SELECT q.doc_id AS q, a.doc_id AS t, a.label, power(list_distance(q.pc::DOUBLE[], a.pc::DOUBLE[]), 2)::BIGINT AS d, row_number() OVER (PARTITION BY q.doc_id ORDER BY power(list_distance(q.pc::DOUBLE[], a.pc::DOUBLE[]), 2)::BIGINT, a.doc_id) AS rank
       FROM p q JOIN a ON q.doc_id <> a.doc_id QUALIFY rank <= 5),
m AS (SELECT *, coalesce(min(CASE WHEN d > 0 THEN d END) OVER (PARTITION BY q), 1)::DOUBLE AS m FROM nn),
e AS (SELECT *, exp(-(d / m) * (d / m)) AS e FROM m),
w AS (SELECT *, log2(e / sum(e) OVER (PARTITION BY q) + 1) AS w FROM e),
v AS (SELECT q, label, sum(w) AS votes FROM w GROUP BY 1, 2),
s AS (SELECT q, label, votes, votes / sum(votes) OVER (PARTITION BY q) AS share, row_number() OVER (PARTITION BY q ORDER BY round(votes, 9) DESC, label) AS place FROM v)
SELECT d.doc_id, d.source, s.label, round(s.votes, 5) + 0.0 AS votes, round(s.share, 5) + 0.0 AS share, nn.t AS nearest, nn.d AS dist
FROM d LEFT JOIN s ON s.q = d.doc_id AND s.place = 1 LEFT JOIN nn ON nn.q = d.doc_id AND nn.rank = 1""",
}
