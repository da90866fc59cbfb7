"""Registered queries over the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from visitlens.llm import (
    decontaminate, divergence, licenses, line_chunks, mixing, near_duplicates, quality, resampling, secrets, sharding, suffixes, urls, warc,
)
from visitlens.llm.common import new_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_shards")
def op1_shards(spark, folder):
    """All documents dealt into 16 shards, counts at most one apart."""
    dealt = sharding.shuffle_to_shards(table(spark, folder, "documents"), 16)
    text = F.coalesce("text", F.lit(""))
    return dealt.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op2_decontaminate", rf"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{decontaminate.WORD}') AS w
           FROM benchmark),
g AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS gram
      FROM (SELECT item_id, w, least(len(w), 13) AS l, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{decontaminate.WORD}') AS w
      FROM documents),
p AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS gram
      FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT l FROM g) WHERE len(w) >= l)),
h AS (SELECT doc_id, l, s, item_id FROM p JOIN g USING (l, gram)),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS place FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""")
def op2_decontaminate(spark, folder):
    """Words of all documents inside 13-word windows of the benchmark."""
    marked = decontaminate.with_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hits = F.col("hits")
    return marked.select(
        "doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        decontaminate.contaminated(hits).alias("contaminated"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op7_urls", r"""
WITH RECURSIVE rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
links AS (
  SELECT url AS a, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''>\s]+)', 1) AS b FROM
    (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<link\b[^>]*>')) AS tag FROM pages)
  WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b')
  UNION ALL
  SELECT url, regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''>\s]+)', 1) FROM
    (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<meta\b[^>]*>')) AS tag FROM pages)
  WHERE regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')),
urls AS (SELECT url AS u FROM pages UNION SELECT b FROM links),
parts AS (SELECT u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query
  FROM (SELECT u, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM urls)),
keys AS (SELECT u, host, path, CASE WHEN host <> '' THEN host || CASE path WHEN '' THEN '/' ELSE path END
    || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS key
  FROM (SELECT *, regexp_replace(regexp_replace(query, '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS q FROM parts)),
ruled AS (SELECT u, host, path, key, max(struct_pack(size := length(rhost) + length(rpath), rule := rhost || rpath, verdict := verdict)) AS best
  FROM keys LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1, 2, 3, 4),
edges AS (SELECT x.key AS a, y.key AS b FROM links JOIN keys x ON links.a = x.u JOIN keys y ON links.b = y.u
  WHERE x.key IS NOT NULL AND y.key IS NOT NULL AND x.key <> y.key),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT key, key FROM ruled WHERE best.verdict = 'block' AND key IS NOT NULL
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
blocked AS (SELECT DISTINCT b AS key FROM reach WHERE b IN (SELECT a FROM both_ways))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN blocked.key IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM pages LEFT JOIN ruled ON pages.url = ruled.u LEFT JOIN blocked ON ruled.key = blocked.key""")
def op7_urls(spark, folder):
    """Verdict on the url of every page, carried over redirects and canonical links."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS rules(host, path, verdict)")
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return urls.judge_urls(pages, rules, carry=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


@query("op3_secrets")
def op3_secrets(spark, folder):
    """Secrets in the texts of all documents."""
    return secrets.scan_secrets(table(spark, folder, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed")


@query("op10_quality")
def op10_quality(spark, folder):
    """Rules and the classifier's verdict on all documents."""
    docs = table(spark, folder, "documents")
    model = quality.fit_quality(docs, table(spark, folder, "labels"))
    return quality.judge_quality(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


@query("op8_mix")
def op8_mix(spark, folder):
    """Words the mix takes of every document."""
    copies = mixing.mixed_copies(table(spark, folder, "documents"))
    return copies.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))), "*").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op5_near_duplicates")
def op5_near_duplicates(spark, folder):
    """The near-duplicate group of every document."""
    return near_duplicates.near_duplicate_classes(table(spark, folder, "documents"))


@query("op4_line_chunks")
def op4_line_chunks(spark, folder):
    """What all documents keep when repeated chunks of lines are cut."""
    cut = line_chunks.drop_repeated_chunks(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_licenses")
def op6_licenses(spark, folder):
    """License notices in the texts of all documents, with spans and coverage."""
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query("op9_suffixes")
def op9_suffixes(spark, folder):
    """What all documents keep without strings of 50 bytes that an earlier document has."""
    cut = suffixes.drop_repeated_strings(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("kept", F.lit("").cast("binary")), 256).alias("kept_sha256"))


@query("op11_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM q""")
def op11_warc(spark, folder):
    """Every page written into WARC archives and read back."""
    archives = warc.write_archives(table(spark, folder, "pages"), new_folder(spark, "warc"))
    records = warc.read_archives(spark, archives, payloads=False).filter(
        F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", "archive", "start", "problem")).cast("boolean"))
        .otherwise(F.col("record_type") != "warcinfo"))
    return records.select(
        F.col("row_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_row_id").cast("long").alias("refers_to"))


AUDIT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '{divergence.TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
found AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN found USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, source, term, coalesce(f.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(f.n, 0) + 2) // (t.total + 2 * v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
priced AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
both_parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN priced USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
WHERE part = 'pair' OR rank <= 10"""


@query("op12_divergence", AUDIT_SQL)
def op12_divergence(spark, folder):
    """How far the sources of each language lie apart, and the terms that set them off."""
    return divergence.audit_sources(table(spark, folder, "documents"))


# The checksum of a word in SQL: a table of 256 values by its rule, then one step per byte of the distinct words.
RESAMPLE_SQL = rf"""
WITH crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{decontaminate.WORD}') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{decontaminate.WORD}') AS w FROM benchmark),
all_words AS (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
hashed AS (SELECT word, xor(list_reduce(list_transform(range(strlen(word)), lambda i:
      CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)), lambda c, x:
      xor(t[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM all_words, crc_table),
s AS (SELECT bucket, count(*) AS s FROM (SELECT unnest(w) AS word FROM d) JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM b) JOIN hashed USING (word) GROUP BY 1),
sums AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM s) AS s_all, (SELECT coalesce(sum(t), 0)::DOUBLE FROM t) AS t_all),
gains AS (SELECT r.bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))
      AS BIGINT) AS gain FROM range(10000) AS r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
weights AS (SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, len(w) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
      (CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS score
  FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place,
    10 * count(*) OVER (PARTITION BY n >= 20) // 100 AS drawn FROM scored)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CAST(CASE WHEN n >= 20 AND place <= drawn THEN place END AS BIGINT) AS rank FROM ranked"""


@query("op13_resample", RESAMPLE_SQL)
def op13_resample(spark, folder):
    """Weights of all documents towards the benchmark, and a draw of a tenth of them."""
    return resampling.importance_resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
