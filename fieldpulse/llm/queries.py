"""Registered queries of the training-data operators, and their SQL where SQL can express them.

Each query applies its operator with production parameters to its whole table
and derives the digest columns from the operator's real output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, scratch_path
from . import (byte_bpe, decontaminate, jaccard_join, language_id, license_scan, line_dedup, merkle_manifest, posting_lists,
               quality_bands, token_alignment, token_files, toxicity_cnn, url_filter)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


#: bytes of rows that Spark hands to a Python worker at once (rows may be very long)
ARROW_BATCH = 32 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH))
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def _fold(modulus: int):
    """crc32 of the id as text, mod ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    path = scratch_path(spark, "token-files")
    token_files.write(docs, path, TOKENIZER, end_id=0, added_tokens=True)
    return token_files.read(spark, path, ids_crc32=F.crc32("ids"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language_id.train(docs.filter(_fold(3) != 1))
    return language_id.predict(docs, model).select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def _md5_number(x):
    return F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("int")


def _list_log(pages: DataFrame) -> DataFrame:
    """A dated list log over the hosts, parent domains and first path segments of all pages."""
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    places = pages.select(host.alias("host"), F.split(path, "/").alias("parts")).filter("host is not null")
    first = F.coalesce(F.get("parts", F.lit(1)), F.lit(""))

    def key(in_list: str, kind: str, value):
        return F.struct(F.lit(in_list).alias("list"), F.lit(kind).alias("kind"), value.alias("key"))

    def entry(action: str, day):
        return F.struct(F.lit(action).alias("action"), day.alias("listed_at"))

    keys = places.select(F.explode(F.array(
        key("block", "host", F.col("host")),
        key("block", "domain", F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1)),
        key("allow", "prefix", F.when(first != "", F.lower(F.concat_ws("/", "host", first))).otherwise("")))).alias("k"))
    h = _md5_number(F.concat_ws("|", "list", "kind", "key"))
    listed = (keys.select("k.*").filter("key <> ''").distinct().withColumn("h", h).filter("h % 4 = 0")
              .withColumn("d", F.expr("date_add(DATE '2024-01-01', cast(floor(h / 4) % 200 as int))"))
              .withColumn("gone", F.expr("date_add(d, cast(30 + floor(h / 1000) % 100 as int))")))
    entries = F.array(entry("add", F.col("d")), F.when(F.col("h") % 8 == 0, entry("remove", F.col("gone"))),
                      F.when(F.col("h") % 16 == 0, entry("add", F.date_add("gone", 15))))
    return (listed.select("list", "kind", "key", F.explode(entries).alias("e")).filter("e is not null")
            .select("list", "kind", "key", "e.action", "e.listed_at"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (_md5_number(F.col("page_id").cast("string")) % 365))
    got = url_filter.evaluate(pages.withColumn("fetched_at", day), _list_log(pages))
    return got.withColumns({c: F.col(c).cast("string") for c in ("fetched_at", "active_since")})


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    index = line_dedup.LineIndex(spark, min_docs=10).insert(docs)
    return index.drop_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                         F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def _toxicity_model(docs: DataFrame, labels: DataFrame) -> bytes:
    return toxicity_cnn.train(docs, labels.filter(_fold(4) != 2))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    model = _toxicity_model(docs, _table(spark, sf_dir, "labels"))
    return toxicity_cnn.score(docs, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "score", "predicted")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir)).drop("spans")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_documents(spark, sf_dir), width=5, percent=80)


def op10_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands.score(_documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, proof and a check with some texts changed, for every document."""
    docs = _documents(spark, sf_dir, "doc_id", "source", "lang", "n_chars", "text")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.when(_fold(5) == 0, merkle_manifest.leaf_of(*head, lowered))      # null: as it was
    manifest = merkle_manifest.Manifest(docs, merkle_manifest.leaf_of(*head, F.col("text")), F.col("source"), F.col("doc_id"),
                                        {"doc_id": F.col("doc_id"), "found": found})
    proofs = manifest.proofs().withColumn("found", F.coalesce("found", "leaf"))
    return merkle_manifest.verify(proofs, "found").select(
        "doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", "verified")


def op12_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, by inner product."""
    return posting_lists.nearest(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of the two tokenizers line up in every document."""
    return token_alignment.alignment(spark, _documents(spark, sf_dir), TOKENIZER, PIECES)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_line_dedup": op4_line_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_license_scan": op8_license_scan,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality_bands": op10_quality_bands,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_posting_lists": op12_posting_lists,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE: dict[str, str] = {}

ORACLE["op4_line_dedup"] = r"""
WITH l AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
k AS (
  SELECT r, doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM e),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

ORACLE["op3_url_filter"] = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 7))::INT % 365 AS INT) AS fetched_at,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
keys AS (
  SELECT 'block' AS list, 'host' AS kind, host AS key FROM p WHERE host IS NOT NULL
  UNION SELECT 'block', 'domain', regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) FROM p WHERE host IS NOT NULL
  UNION SELECT 'allow', 'prefix', lower(host || '/' || split_part(path, '/', 2)) FROM p
        WHERE host IS NOT NULL AND split_part(path, '/', 2) <> ''),
listed AS (
  SELECT *, d + CAST(30 + (h // 1000) % 100 AS INT) AS gone FROM (
    SELECT *, DATE '2024-01-01' + CAST((h // 4) % 200 AS INT) AS d FROM (
      SELECT *, ('0x' || substr(md5(list || '|' || kind || '|' || key), 1, 7))::INT AS h FROM keys WHERE key <> '')
    WHERE h % 4 = 0)),
log AS (
  SELECT list, kind, key, 'add' AS action, d AS day FROM listed
  UNION ALL SELECT list, kind, key, 'remove', gone FROM listed WHERE h % 8 = 0
  UNION ALL SELECT list, kind, key, 'add', gone + 15 FROM listed WHERE h % 16 = 0),
spans AS (
  SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, kind, key ORDER BY day) AS until FROM log) WHERE action = 'add'),
labels_of AS (SELECT page_id, host, fetched_at, string_split(host, '.') AS l,
                     list_filter(string_split(path, '/'), lambda x: x <> '')[1:4] AS seg FROM p WHERE host IS NOT NULL),
tried AS (
  SELECT page_id, fetched_at, 'domain' AS kind, array_to_string(l[len(l) - i + 1:], '.') AS key, i AS rank
    FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM labels_of)
  UNION ALL SELECT page_id, fetched_at, 'host', host, 1001 FROM labels_of
  UNION ALL SELECT page_id, fetched_at, 'prefix', lower(host || '/' || array_to_string(seg[1:i], '/')), i + 1001
    FROM (SELECT *, unnest(range(1, len(seg) + 1)) AS i FROM labels_of)),
active AS (
  SELECT t.*, s.list, s.day FROM tried t JOIN spans s ON t.kind = s.kind AND t.key = s.key
   AND s.day <= t.fetched_at AND (s.until IS NULL OR t.fetched_at < s.until)),
best AS (
  SELECT *, count(*) OVER (PARTITION BY page_id) AS n,
         row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, list = 'block' DESC, kind DESC, key DESC, day DESC) AS r
  FROM active)
SELECT p.page_id, p.host, CAST(p.fetched_at AS VARCHAR) AS fetched_at,
       CASE WHEN p.host IS NULL THEN 'no_host' WHEN b.list IS NULL THEN 'unlisted'
            WHEN b.list = 'block' THEN 'blocked' ELSE 'allowed' END AS verdict,
       CASE WHEN b.kind IS NULL THEN '' ELSE b.kind || ':' || b.key END AS listed_by,
       CAST(b.day AS VARCHAR) AS active_since, CAST(coalesce(b.n, 0) AS BIGINT) AS n_active
FROM p LEFT JOIN best b ON p.page_id = b.page_id AND b.r = 1
"""

ORACLE["op7_decontaminate"] = r"""
WITH d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT id AS doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s
       FROM (SELECT id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT id AS item_id, array_to_string(w[i + 1:i + 5], ' ') AS s
       FROM (SELECT id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""

ORACLE["op11_merkle_manifest"] = r"""
WITH RECURSIVE
f AS (
  SELECT *, list_aggregate(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
                           lambda x: coalesce(strlen(x) || ':' || x, '-')), 'string_agg', '') AS head
  FROM documents),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS g,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS low_leaf,
         xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda c, b: list_reduce(range(8), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END,
                                      xor(c, b)), 4294967295)) % 5 = 0 AS hit
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM f)),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY g) AS n FROM d),
tree AS (
  SELECT g, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM tree WHERE n > 1 GROUP BY g, level, pos // 16),
sub AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM sub
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM top WHERE n > 1 GROUP BY level, pos // 16),
beside AS (
  SELECT g, level, pos, coalesce(string_agg(digest, '') OVER before, '') AS l, coalesce(string_agg(digest, '') OVER after, '') AS rt
  FROM tree WHERE n > 1
  WINDOW before AS (PARTITION BY g, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY g, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
beside_top AS (
  SELECT level, pos, coalesce(string_agg(digest, '') OVER before, '') AS l, coalesce(string_agg(digest, '') OVER after, '') AS rt
  FROM top WHERE n > 1
  WINDOW before AS (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
steps AS (
  SELECT r, b.level AS step, b.l, b.rt FROM placed p JOIN beside b
    ON p.g = b.g AND b.pos = p.pos // CAST(pow(16, b.level) AS BIGINT)
  UNION ALL
  SELECT r, 100 + b.level, b.l, b.rt FROM placed p JOIN sub s ON p.g = s.g JOIN beside_top b
    ON b.pos = s.pos // CAST(pow(16, b.level) AS BIGINT)),
paths AS (SELECT r, list(l ORDER BY step) AS ls, list(rt ORDER BY step) AS rs, string_agg(l || rt, '' ORDER BY step) AS beside
          FROM steps GROUP BY r),
folded AS (
  SELECT p.r, 1 AS i, CASE WHEN hit THEN low_leaf ELSE leaf END AS acc, ls, rs FROM placed p LEFT JOIN paths USING (r)
  UNION ALL
  SELECT r, i + 1, sha256(ls[i] || acc || rs[i]), ls, rs FROM folded WHERE i <= len(ls))
SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(coalesce(w.beside, '')) AS proof_sha256, f.acc AS folded_root,
       f.acc = t.digest AS verified
FROM placed p JOIN sub s ON p.g = s.g JOIN (SELECT digest FROM top WHERE n = 1) t ON true LEFT JOIN paths w ON p.r = w.r
JOIN folded f ON f.r = p.r AND f.i = coalesce(len(f.ls), 0) + 1
"""
