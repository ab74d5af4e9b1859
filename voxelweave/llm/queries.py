"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelweave.llm.simhash import hexed, near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelweave.llm.pieces import encode, load

    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), load(), decoded="decoded")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), sha("decoded").alias("decoded_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelweave.llm.langid import fit, identify, in_fold

    docs = table(spark, sf_dir, "documents")
    held = in_fold(F.col("doc_id"), 4, 2)
    out = identify(docs.select("doc_id", "text"), fit(docs.filter(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelweave.llm.gru_lm import score_documents
    from voxelweave.llm.langid import in_fold

    out = score_documents(table(spark, sf_dir, "documents"), ~in_fold(F.col("doc_id"), 7, 2))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelweave.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelweave.llm.media import stored

    return stored(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelweave.llm.lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelweave.llm.urls import Rule, judge

    out = judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), [Rule(*r) for r in RULES])
    return out.select("page_id", "host", "path", "rule", "verdict")


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 with redirects given as edges: of seven pages that follow each other, all are aliases of the first."""
    from voxelweave.llm.urls import Rule, judge

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    first = pages.select((F.col("page_id") - F.col("page_id") % 7).alias("first"), F.col("url").alias("src"))
    edges = first.join(pages.select(F.col("page_id").alias("first"), F.col("url").alias("dst")), "first").select("src", "dst")
    out = judge(pages, [Rule(*r) for r in (*RULES, ("block", "spam-farm.example.org", "/"))], edges)
    return out.select("page_id", "rule", "verdict")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelweave.llm.mixing import mix, word_count

    out = mix(table(spark, sf_dir, "documents"), word_count(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelweave.llm.shards import shard

    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(narrow, "doc_id", [1.0] * 24, [1.0] * 25)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelweave.llm.common import fresh_path
    from voxelweave.llm.digests import DigestIndex, exact_duplicates

    index = DigestIndex(spark, fresh_path(spark, "digest-index"))
    out = exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), index)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelweave.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_sentencepiece, op3_language_id, op4_line_dedup, op5_gru_lm, op6_top_k, op7_url_filters, op8_webp, op9_mixing, op10_sharding, op11_exact_dedup, op12_source_divergence, url_aliases)}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = {
    "op6_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10""",
    "op4_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_SPACE}), {_LETTERS}) AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id <> c.top AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op7_url_filters": r"""
WITH p AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT h.page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
      FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id""",
    "url_aliases": r"""
WITH RECURSIVE p AS (SELECT page_id, url, regexp_extract(url, '^[^:/?#]*') AS scheme, regexp_extract(url, '^[^:/?#]*://([^/?#]*)', 1) AS h, regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#]*)', 1) AS path,
                            regexp_extract(regexp_replace(url, '#.*$', ''), '^[^?]*([?].*)$', 1) AS query FROM pages),
n AS (SELECT page_id, lower(h) AS host, path, lower(scheme) || '://' || lower(h) || CASE path WHEN '' THEN '/' ELSE path END || query AS url FROM p),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'), ('block', 'spam-farm.example.org', '/')),
m AS (SELECT n.page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
      FROM n JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n.page_id),
o AS (SELECT n.*, m.rule, m.verdict FROM n LEFT JOIN m ON n.page_id = m.page_id),
e AS (SELECT a.url AS src, b.url AS dst FROM n a JOIN n b ON b.page_id = a.page_id - a.page_id % 7 WHERE a.url <> b.url),
both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
reach AS (SELECT src, dst FROM both_ways UNION SELECT reach.src, b.dst FROM reach JOIN both_ways b ON reach.dst = b.src),
hit AS (SELECT DISTINCT reach.src FROM reach JOIN o ON o.url = reach.dst WHERE o.verdict = 'block')
SELECT page_id, rule, coalesce(verdict, CASE WHEN hit.src IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM o LEFT JOIN hit ON o.url = hit.src""",
    "op9_mixing": f"""
WITH x AS (SELECT doc_id, source, coalesce(len({_WORDS}), 0)::BIGINT AS size,
                  (('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM x GROUP BY source),
g AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS stop FROM s),
lv AS (SELECT a.stop, ((SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM s) - coalesce((SELECT sum(cap) FROM g b WHERE b.stop <= a.stop), 0)) AS lack,
              (SELECT sum(w) FROM g b WHERE b.stop > a.stop) AS open FROM (SELECT stop FROM g UNION SELECT -1.0) a),
level AS (SELECT lack / open AS level FROM lv WHERE open > 0 AND lack / open > stop AND lack / open < (SELECT min(stop) FROM g b WHERE b.stop > lv.stop)),
t AS (SELECT source, source_size, least(cap, w * (SELECT max(level) FROM level)) AS target FROM g),
f AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
k AS (SELECT *, floor(rate) AS whole, target - floor(rate) * source_size AS lack FROM f),
d AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS digits FROM x),
gr AS (SELECT source, digits, sum(size)::BIGINT AS words FROM d WHERE digits > 0 GROUP BY 1, 2),
gw AS (SELECT source, digits, coalesce(sum(words) OVER (PARTITION BY source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS certain,
              (sum(words * digits) OVER (PARTITION BY source ORDER BY digits ROWS UNBOUNDED PRECEDING))::BIGINT AS open FROM gr),
sc AS (SELECT k.*, gw.digits AS most_digits, k.lack - gw.certain AS open_lack, (k.lack - gw.certain) / gw.open::DOUBLE AS scale FROM k JOIN gw ON k.source IS NOT DISTINCT FROM gw.source),
b AS (SELECT * FROM sc WHERE scale * most_digits <= 1 QUALIFY row_number() OVER (PARTITION BY source ORDER BY most_digits DESC) = 1),
j AS (SELECT d.*, k.source_size, k.target, k.whole, k.lack, coalesce(b.most_digits, 0) AS most_digits, b.open_lack, b.scale * d.digits AS p
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source),
r AS (SELECT *, CASE WHEN digits > 0 AND digits <= most_digits AND p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS q FROM j),
o AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) END AS upto FROM r)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN digits > most_digits AND lack > 0 OR q IS NOT NULL AND abs(upto - open_lack) < abs(upto - size - open_lack) THEN 1 ELSE 0 END))::BIGINT AS taken FROM o""",
    "op10_sharding": r"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n::BIGINT)) AS t),
x AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
b AS (SELECT doc_id, s, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM x),
c AS (SELECT doc_id, len(bytes) + 8 AS size, xor(list_reduce(bytes, lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM b, t),
m AS (SELECT *, list_transform(range(25), lambda i: ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || i), 1, 13))::BIGINT) AS bids FROM c),
o AS (SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, (list_position(bids[:24], list_max(bids[:24])) - 1)::INT AS shard, (list_position(bids, list_max(bids)) - 1)::INT AS grown_shard FROM m)
SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, size, text_crc32, grown_shard) - 1 AS slot, grown_shard FROM o""",
    "op11_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_LETTERS})) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)""",
    "op12_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT r) AS docs FROM t GROUP BY 1, 2, 3),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2 HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
o AS (SELECT c.* FROM c JOIN k ON c.lang = k.lang AND c.term = k.term),
g AS (SELECT x.lang, x.source, coalesce(sum(o.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN o ON x.lang = o.lang AND x.source = o.source GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (g.n + v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM u QUALIFY part = 'pair' OR rank <= 200""",
}
