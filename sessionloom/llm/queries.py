"""The opN_ queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import chat, decontaminate, licenses, media, mixing, neardup, quality, tokencount, tokenfile, toxicity, turntrie, vectorcodes, webarchive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_digests(chat.with_probe(table(spark, sf_dir, "conversations")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_files(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.round("mix_target", 6).alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webarchive.archived_pages(table(spark, sf_dir, "pages"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_report(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.token_files(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.prefix_trie(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, list_reduce(list_prepend(text, ['<s>', '</s>', '[INST]', '[/INST]', '<|reply|>', '<<SYS>>', '<</SYS>>', '<|role|>', '<|text|>', '<|end|>']), lambda a, x: replace(a, x, x[1] || chr(92) || x[2:])) AS e FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(e) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 13 WHEN 'system' THEN 19 ELSE 23 + length(role) END) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

OP2_SQL = r"""
WITH t(license, text) AS (VALUES %s),
f AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || array_to_string(string_split(CAST(doc_id AS VARCHAR), ''), '/') AS path, regexp_replace(lower(text), '^[ \t\n\x0B\f\r]+', '') AS x FROM documents),
m AS (SELECT path, string_split(x, chr(10)) AS l FROM f WHERE %s),
k AS (SELECT path, i - 1 AS segment, i = 1 AS first, l[i] AS x FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM m)),
o AS (SELECT path, segment, first, x FROM k WHERE %s),
s AS (SELECT * FROM o UNION ALL SELECT path, -1, false, string_agg(x, ' ' ORDER BY segment) FROM o GROUP BY path HAVING count(*) > 1),
tok AS (SELECT path, segment, first, token, count(*) AS tf FROM (SELECT path, segment, first, unnest(regexp_extract_all(x, '[a-z0-9]+(?:[-.][a-z0-9]+)*')) AS token FROM s) GROUP BY ALL),
own AS (SELECT license, token, count(*) AS tf FROM (SELECT license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-.][a-z0-9]+)*')) AS token FROM t) GROUP BY ALL),
n AS (SELECT count(DISTINCT (path, segment, first)) + (SELECT count(*) FROM t) AS n FROM tok),
idf AS (SELECT token, ln((n + 1.0) / (1 + d0 + coalesce(d1, 0))) + 1 AS idf FROM (SELECT token, count(*) AS d0 FROM own GROUP BY token) LEFT JOIN (SELECT token, count(*) AS d1 FROM tok GROUP BY token) USING (token), n),
w AS (SELECT license, token, tf * idf AS w FROM own JOIN idf USING (token)),
u AS (SELECT license, token, w / sqrt(sum(w * w) OVER (PARTITION BY license)) AS u FROM w),
mine AS (SELECT path, segment, first, token, tf * coalesce(idf, (SELECT ln(n + 1.0) + 1 FROM n)) AS w FROM tok LEFT JOIN idf USING (token)),
len AS (SELECT path, segment, first, sqrt(sum(w * w)) AS len FROM mine GROUP BY ALL),
c AS (SELECT path, segment, first, license, round(sum(w * u) / any_value(len), 6) AS similarity FROM mine JOIN u USING (token) JOIN len USING (path, segment, first) GROUP BY ALL),
b AS (SELECT path, arg_min(license, (-similarity, license)) AS license, max(similarity) AS similarity, bool_or(first) AS heads FROM c WHERE similarity >= 0.6 GROUP BY path),
g AS (SELECT regexp_replace(path, '/[^/]*$', '') AS directory, arg_min(path, (-similarity, path)) AS license_path, arg_min(license, (-similarity, path)) AS given FROM b WHERE heads GROUP BY 1),
d AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM f),
a AS (SELECT folder, j AS depth, array_to_string(string_split(folder, '/')[1 : j], '/') AS directory FROM (SELECT folder, unnest(range(0, len(string_split(folder, '/')) + 1)) AS j FROM d)),
r AS (SELECT folder, arg_max(license_path, depth) AS license_path, arg_max(given, depth) AS given FROM a JOIN g USING (directory) GROUP BY folder)
SELECT doc_id, f.path, coalesce(b.license, given) AS license, coalesce(similarity, 0.0) AS similarity,
  CASE WHEN b.license IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN b.license IS NOT NULL THEN f.path ELSE license_path END AS license_path
FROM f LEFT JOIN b ON f.path = b.path LEFT JOIN r ON regexp_replace(f.path, '/[^/]*$', '') = r.folder
""" % (
    ", ".join(f"('{license}', '{text}')" for license, text in licenses.TEMPLATES),
    " OR ".join(f"contains(x, '{stem}')" for stem in licenses.STEMS),
    " OR ".join(f"contains(x, '{stem}')" for stem in licenses.STEMS),
)

OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS n FROM d GROUP BY source),
w AS (SELECT source, CAST(n AS BIGINT) AS n, 2.0::DOUBLE * n AS cap, ([5.0::DOUBLE, 2.0, 1.0])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source) AS k, (1.5::DOUBLE * (SELECT sum(n) FROM w) - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT coalesce(arg_min(level, k) FILTER (level < cap / w), max(cap / w)) AS level FROM o),
t AS (SELECT source, n, least(cap, w * level) AS target FROM w, l),
c AS (SELECT doc_id, size, n, target, CASE WHEN n > 0 THEN target / n ELSE 0 END AS rate, CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, round(target, 6) AS target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
h AS (SELECT doc_id, dw.l, i, item_id FROM dw JOIN bw USING (l, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM h)) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) USING (doc_id)
"""

OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: (instr('0123456789abcdef', substr(s, 1 + (5 * i + j) // 4, 1)) - 1) // (CASE (5 * i + j) % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END) % 2 * (CASE j WHEN 0 THEN 16 WHEN 1 THEN 8 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 1 END))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

_ASSIGN = "a%d AS (SELECT r, part, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, part, x, e, list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS d FROM p JOIN b%d USING (part)) GROUP BY r, part)"
_MEANS = (
    "m%d AS (SELECT part, e, list(m ORDER BY i) AS c FROM (SELECT part, e, i, floor(sum(v) / count(*)) AS m FROM (SELECT part, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM a%d) GROUP BY part, e, i) GROUP BY part, e),\n"
    "b%d AS (SELECT part, e, coalesce(m.c, b.c) AS c FROM b%d b LEFT JOIN m%d m USING (part, e))"
)
OP12_SQL = r"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT r, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM (SELECT r, v, unnest(range(4)) AS part FROM k)),
b0 AS (SELECT part, r - 1 AS e, x AS c FROM p WHERE r <= 256),
%s,
f AS (SELECT r, string_agg(printf('%%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r),
s AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM (SELECT part, e, unnest(c) AS v, unnest(range(len(c))) AS i FROM b4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r), s
""" % ",\n".join(_ASSIGN % (k, k) + (",\n" + _MEANS % (k, k, k + 1, k, k) if k < 4 else "") for k in range(5))

OP13_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'k': md5(role) || md5(text), 'n': strlen(text)} ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY conv_id),
h AS (SELECT conv_id, l, CAST(xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: list_transform(range(0, 8), lambda j: (ord(s) >> j) & 1)))), lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 AS INTEGER) AS h FROM c),
b AS (SELECT x.conv_id, CASE WHEN x.conv_id % 5 = 0 THEN x.l ELSE coalesce(y.l[1 : x.h], []) || x.l[x.h + 1 :] END AS l FROM h x LEFT JOIN c y ON y.conv_id = x.conv_id - x.conv_id % 5),
q AS (SELECT conv_id, l, d, list_transform(l[1 : d], lambda x: x.k) AS k FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM b)),
p AS (SELECT conv_id, d, md5(array_to_string(k, '')) AS key, CASE WHEN d > 0 THEN md5(array_to_string(k[1 : d - 1], '')) END AS above, CASE WHEN d > 0 THEN l[d].n ELSE 0 END AS bytes, d = len(l) AS last FROM q),
n AS (SELECT d, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last) AS ends FROM p GROUP BY d, key),
k AS (SELECT d - 1 AS d, above AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, key)),
s AS (SELECT p.d, p.key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * v.bytes) AS saved FROM v JOIN p ON p.conv_id = v.conv_id AND p.d <= v.d GROUP BY 1, 2)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN s USING (d, key) LEFT JOIN n u ON u.d = v.d - 1 AND u.key = v.above
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_license_scan": op2_license_scan,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_media": op8_media,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_token_files": op11_token_files,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op2_license_scan": OP2_SQL, "op3_mixing": OP3_SQL, "op4_decontamination": OP4_SQL, "op5_minhash_neardup": OP5_SQL, "op7_warc": OP7_SQL, "op12_vector_codes": OP12_SQL, "op13_prefix_trie": OP13_SQL}
