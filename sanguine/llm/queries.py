"""The corpus operators' queries, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat
from .common import table
from .decontaminate import overlaps
from .nbsvm import classify
from .packing import pack
from .pii import find_pii
from .quality import quality_rules
from .repair import damaged, repaired
from .sharding import shard_documents
from .simhash import near_duplicates
from .spelling import variants
from .suffix import without_repeats
from .tokenfile import token_files
from .tokens import vocabulary
from .urls import judged


def op1_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_quality(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source_queue")


def op6_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), copies=True)


def op8_classifier(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_chat(spark, sf_dir):
    planted = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digest(chat.formatted(turns.unionByName(planted)))


def op11_spelling(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents"))


def op12_urls(spark, sf_dir):
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op13_repair(spark, sf_dir):
    return repaired(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op1_simhash": op1_simhash, "op2_sharding": op2_sharding, "op3_suffix_dedup": op3_suffix_dedup, "op4_quality": op4_quality, "op5_packing": op5_packing, "op6_pii": op6_pii, "op7_decontamination": op7_decontamination, "op8_classifier": op8_classifier, "op9_token_files": op9_token_files, "op10_chat": op10_chat, "op11_spelling": op11_spelling, "op12_urls": op12_urls, "op13_repair": op13_repair}
_ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), ']', '&rb;')"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(points: str) -> str:
    """SQL for the crc32 of a text of characters up to U+00FF, given as a list of code points; a byte's remainder comes from its eight divisions."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    utf8 = f"flatten(list_transform({points}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))"
    return f"xor(list_reduce(list_transform({utf8}, lambda c: CAST(c AS BIGINT)), lambda a, c: xor(a >> 8, ({table})[1 + (xor(a, c) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _points(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda x: unicode(x))"


ORACLES: dict[str, str] = {
    "op10_chat": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS roles,
    sum(length({_ESCAPED.format("text")}) + 1 + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + length({_ESCAPED.format("role")}) END) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
  regexp_full_match(roles, 's?(ua)+') AS valid
FROM g
""",
    "op11_spelling": f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, {_LOWER.format("run")} AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
  SELECT run, n, {_crc32(_points("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM runs
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS k)
), ways AS (
  SELECT w.word, l.word AS near, l.n FROM words w JOIN less l ON w.word = l.rest
  UNION SELECT l.word, w.word, w.n FROM words w JOIN less l ON w.word = l.rest
  UNION SELECT a.word, b.word, b.n FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS top, min(near) FILTER (n = m) AS near
  FROM (SELECT *, max(n) OVER (PARTITION BY word) AS m FROM ways) GROUP BY word
), forms AS (
  SELECT w.word, CASE WHEN top >= 2 * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n
FROM forms f LEFT JOIN (SELECT walk.word, walk.at AS root FROM walk JOIN forms g ON g.word = walk.at AND g.form IS NULL) r ON r.word = f.word
""",
    "op12_urls": f"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS rid, page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, coalesce(html, '') AS html FROM pages
), rules(ruled, domain, start) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), hit AS (
  SELECT rid, arg_max(domain || start, (length(domain || start), domain || start)) AS rule, arg_max(ruled, (length(domain || start), domain || start)) AS ruled
  FROM p JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start) GROUP BY rid
), q AS (SELECT p.*, rule, ruled FROM p LEFT JOIN hit USING (rid)
), links AS (
  SELECT host AS src, dst, count(*) AS w FROM (
    SELECT host, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?is)<a\\s[^>]*?\\bhref\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]*)', 1),
      lambda x: {_LOWER.format("regexp_extract(x, '//([^/?#]*)', 1)")}))) AS dst FROM p)
  WHERE host <> '' AND dst <> '' AND host <> dst GROUP BY ALL
), names AS (SELECT DISTINCT host FROM (SELECT host FROM p UNION SELECT dst FROM links) WHERE host <> ''
), chain AS (
  SELECT DISTINCT array_to_string(labels[k:], '.') AS src, array_to_string(labels[k + 1:], '.') AS dst
  FROM (SELECT string_split(host, '.') AS labels FROM names), LATERAL (SELECT unnest(range(1, len(labels))) AS k)
), edges AS (
  SELECT src, dst, sum(w) AS w FROM (SELECT * FROM links UNION ALL SELECT src, dst, 1 FROM chain UNION ALL SELECT dst, src, 1 FROM chain) GROUP BY ALL
), ways AS (SELECT 0 AS kind, src, dst, w FROM edges UNION ALL SELECT 1, dst, src, w FROM edges
), shares AS (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS share FROM ways
), seeds AS (
  SELECT CASE ruled WHEN 'allow' THEN 0 ELSE 1 END AS kind, host, CAST(count(*) AS DOUBLE) AS s FROM q WHERE ruled IS NOT NULL AND host <> '' GROUP BY ALL
), terms AS (
  SELECT 0 AS k, kind, host, s FROM seeds
  UNION ALL SELECT k + 1, kind, host, sum(s) FROM (
    SELECT t.k, t.kind, e.dst AS host, CAST(0.85 AS DOUBLE) * t.s * e.share AS s FROM terms t JOIN shares e ON e.kind = t.kind AND e.src = t.host WHERE t.k < 24) GROUP BY k, kind, host
), ranks AS (
  SELECT host, coalesce(sum(s) FILTER (kind = 0), 0) AS trust, coalesce(sum(s) FILTER (kind = 1), 0) AS distrust
  FROM (SELECT kind, host, sum(s) / sum(sum(s)) OVER (PARTITION BY kind) AS s FROM terms GROUP BY kind, host) GROUP BY host
)
SELECT page_id, q.host, path, rule, coalesce(ruled, CASE WHEN round(distrust - 0.5 * (trust + distrust), 12) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN ranks ON ranks.host = q.host
""",
    "op13_repair": f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32(_points("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"))} % 20 AS kind FROM conversations
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM t, LATERAL (SELECT unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END))) WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_extract(text, '(?s)([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS final, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS init FROM d
), r AS (
  SELECT *, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(init) OVER (PARTITION BY conv_id ORDER BY i) || init AS pair FROM o
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id
), expects(st, goes) AS (VALUES ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')
), inserts(st, k, mid) AS (
  SELECT st, 0, st FROM expects UNION ALL SELECT st, 1, goes FROM expects UNION ALL SELECT e.st, 2, f.goes FROM expects e JOIN expects f ON f.st = e.goes
), moves AS (
  SELECT st, 3 * k + 4 AS cost, repeat('I', k) || 'D' AS letters, mid AS goes, NULL AS init FROM inserts
  UNION ALL SELECT i.st, 3 * k + 3, repeat('I', k) || 'R', e.goes, NULL FROM inserts i JOIN expects e ON e.st = mid
  UNION ALL SELECT i.st, 3 * k, repeat('I', k) || 'K', e.goes, e.goes FROM inserts i JOIN expects e ON e.st = mid
  UNION ALL SELECT st, 0, 'K', 's', 's' FROM expects WHERE st = ''
), b AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS st, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS v FROM stats
  UNION ALL SELECT conv_id, i, st, min(v) FROM (
    SELECT b.conv_id, r.i, m.goes AS st, {{'c': b.v.c + m.cost + CASE WHEN r.fault = 'truncated' AND m.letters NOT LIKE '%D' THEN 3 ELSE 0 END, 'a': b.v.a || m.letters}} AS v
    FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1
    JOIN moves m ON m.st = b.st AND (m.init IS NULL OR m.init = r.init) AND (coalesce(r.fault, 'truncated') = 'truncated' OR m.letters LIKE '%D')) GROUP BY conv_id, i, st
), best AS (
  SELECT b.conv_id, min({{'c': b.v.c + 3 * x.k, 'a': b.v.a || repeat('I', x.k)}}) AS v
  FROM b JOIN stats s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.n = b.i JOIN inserts x ON x.st = b.st AND x.mid IN ('', 'a') GROUP BY b.conv_id
), steps AS (
  SELECT conv_id, p, v.a[p] AS edit, length(replace(left(v.a, p), 'I', '')) AS i, length(replace(left(v.a, p - 1), 'D', '')) AS j FROM best, LATERAL (SELECT unnest(range(1, length(v.a) + 1)) AS p)
), placed AS (
  SELECT s.*, r.role, r.text, max(CASE WHEN j = 0 AND edit = 'K' AND r.init = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS lead
  FROM steps s LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i AND edit <> 'I'
), whole AS (
  SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role ELSE CASE (j + lead) % 2 WHEN 0 THEN 'user' ELSE 'assistant' END END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS repaired FROM placed WHERE edit <> 'D' GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.v.c, 0) AS BIGINT) AS cost, coalesce(best.v.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM c.conv_id
""",
}
