"""The registered query of every operator in this subpackage, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, common, decontaminate, fingerprint, html_text, jaccard_join, language_id, merkle, spelling, substring_dedup, token_files, toxicity, warc

table = common.table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.planted(table(spark, sf_dir, "conversations")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_jaccard_join, op2_toxicity, op3_byte_bpe, op4_warc, op5_substring_dedup, op6_decontaminate, op7_token_files, op8_fingerprint, op9_html_text,
    op10_language_id, op11_chat_format, op12_spelling_variants, op13_merkle_manifest,
)}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY x, y),
link AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * k >= 4 * (nx.n + ny.n - k)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(y) FROM reach WHERE reach.x = d.doc_id), d.doc_id)) AS class_id,
       CAST((SELECT count(*) FROM link WHERE link.x = d.doc_id) AS BIGINT) AS n_links
FROM d
""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, min(page_id) AS first_page FROM d GROUP BY payload_digest)
SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN payload_bytes < 100 OR d.page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR d.page_id = first_page THEN NULL ELSE first_page END AS refers_to
FROM d JOIN m USING (payload_digest)
""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM (SELECT doc_id, i FROM win JOIN least_doc USING (s) WHERE doc_id > m)),
lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
word AS (SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.k) AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.k = gone.k WHERE gone.k IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op6_decontaminate": r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT place.doc_id, place.n, place.i, win.item_id FROM place JOIN win ON place.n = win.n AND place.s = win.s),
cover AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN cover USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
    "op11_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS t(k)),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
         sum(length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_start|><|im_end|>') + 2) AS formatted_chars,
         list(role ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM c GROUP BY conv_id),
-- The order of turns as text: a system turn at first, then user and assistant in turn.
o AS (SELECT *, array_to_string(roles, ' ') || ' ' AS line,
             len(regexp_extract(array_to_string(roles, ' ') || ' ', '^((system )?(user assistant )*(user )?)').split(' ')) AS fine FROM g)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars,
       CASE WHEN fine <= n_turns THEN 'error' WHEN roles[-1] = 'user' THEN 'asked' WHEN roles[-1] = 'assistant' THEN 'answered' ELSE 'ready' END AS end_state,
       CASE WHEN fine <= n_turns THEN fine END AS error_turn, fine > n_turns AND roles[-1] = 'assistant' AS complete
FROM o
""",
    "op12_spelling_variants": r"""
WITH r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
once AS (SELECT id, run, count(*) AS k FROM r GROUP BY ALL),
-- crc32, bit by bit over each byte: 0xEDB88320 is the reflected polynomial.
crc AS (
  SELECT run, k, list_reduce(list_prepend(4294967295::UBIGINT, [CAST(('0x' || x) AS UBIGINT) FOR x IN regexp_extract_all(hex(encode(id || ':' || run)), '..')]),
         lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT FOR i IN range(8)]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384::UBIGINT))) AS h
  FROM once),
hashed AS (SELECT run, k, xor(h, 4294967295::UBIGINT) AS h FROM crc),
made AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
-- Words near each other share a word with one character left out (both leave one out: replaced; one does: inserted).
hole AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS less, i FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM hole a JOIN hole b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM hole a JOIN w ON w.word = a.less
  UNION SELECT w.word, a.word, a.n FROM hole a JOIN w ON w.word = a.less),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
form AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN (SELECT min(encode(other)) FROM near WHERE near.word = w.word AND near.m = best.m) END AS f, m
  FROM w LEFT JOIN best ON best.word = w.word),
chain AS (SELECT word, n, n_near, decode(f) AS form, CASE WHEN f IS NOT NULL THEN m END AS form_n FROM form),
steps AS (SELECT word, form FROM chain WHERE form IS NOT NULL)
SELECT word, form, coalesce((
  WITH RECURSIVE go(a, b) AS (SELECT word, form FROM steps UNION SELECT go.a, steps.form FROM go JOIN steps ON steps.word = go.b)
  SELECT b FROM go WHERE go.a = chain.word AND b NOT IN (SELECT word FROM steps)), word) AS root, n, n_near, form_n
FROM chain
""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE field AS (
  SELECT *, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') AS f1, coalesce(octet_length(encode(source)) || ':' || source, '-') AS f2,
         coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS f3, coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS f4,
         -- crc32, bit by bit over each byte: 0xEDB88320 is the reflected polynomial.
         xor(list_reduce(list_prepend(4294967295::UBIGINT, [CAST(('0x' || x) AS UBIGINT) FOR x IN regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..')]),
             lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT FOR i IN range(8)]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) AS h
  FROM documents),
leaf AS (
  SELECT doc_id, lang, sha256(f1 || f2 || f3 || f4 || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         CASE WHEN h % 3 = 0 THEN sha256(f1 || f2 || f3 || f4 || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
  FROM field),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS size,
         dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g
  FROM leaf),
node AS (
  SELECT g, 0 AS level, i, size, leaf AS digest FROM placed
  UNION ALL SELECT g, level + 1, i // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM node WHERE size > 1 GROUP BY g, level, i // 8, size),
crown AS (
  SELECT 0 AS level, g AS i, count(*) OVER () AS size, digest FROM node WHERE size = 1
  UNION ALL SELECT level + 1, i // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM crown WHERE size > 1 GROUP BY level, i // 8, size),
-- Each level of a proof: the place in the run, a colon, the siblings.
low AS (
  SELECT p.g, p.i, n.level, (p.i // CAST(8 ** n.level AS BIGINT)) % 8 AS k, string_agg(n.digest, '' ORDER BY n.i) AS s
  FROM placed p JOIN node n ON n.g = p.g AND n.size > 1 AND n.i // 8 = p.i // CAST(8 ** (n.level + 1) AS BIGINT) AND n.i <> p.i // CAST(8 ** n.level AS BIGINT) GROUP BY ALL
  UNION ALL SELECT p.g, p.i, n.level, 0, '' FROM placed p JOIN node n ON n.g = p.g AND n.size % 8 = 1 AND n.size > 1 AND n.i = n.size - 1 AND p.i // CAST(8 ** n.level AS BIGINT) = n.i),
high AS (
  SELECT p.i AS g, n.level, (p.i // CAST(8 ** n.level AS BIGINT)) % 8 AS k, string_agg(n.digest, '' ORDER BY n.i) AS s
  FROM (SELECT i FROM crown WHERE level = 0) p JOIN crown n ON n.size > 1 AND n.i // 8 = p.i // CAST(8 ** (n.level + 1) AS BIGINT) AND n.i <> p.i // CAST(8 ** n.level AS BIGINT) GROUP BY ALL
  UNION ALL SELECT p.i, n.level, 0, '' FROM (SELECT i FROM crown WHERE level = 0) p JOIN crown n ON n.size % 8 = 1 AND n.size > 1 AND n.i = n.size - 1 AND p.i // CAST(8 ** n.level AS BIGINT) = n.i),
steps AS (SELECT g, i, 0 AS tree, level, k, s FROM low UNION ALL SELECT placed.g, placed.i, 1, level, k, s FROM high JOIN placed USING (g)),
proof AS (SELECT g, i, string_agg(s, '' ORDER BY tree, level) AS all_siblings, list(k || ':' || s ORDER BY tree, level) AS path FROM steps GROUP BY g, i),
whole AS (
  SELECT doc_id, leaf, coalesce(other, leaf) AS shown, g, i, coalesce(all_siblings, '') AS all_siblings, coalesce(path, []) AS path,
         (SELECT digest FROM crown WHERE size = 1) AS root
  FROM placed LEFT JOIN proof USING (g, i)),
fold AS (
  SELECT *, list_reduce(list_prepend(shown, path), lambda a, x: sha256(substr(x, 3, 64 * CAST(left(x, 1) AS INT)) || a || substr(x, 3 + 64 * CAST(left(x, 1) AS INT)))) AS folded_root
  FROM whole)
SELECT doc_id, leaf, (SELECT digest FROM node WHERE node.g = fold.g AND node.size = 1) AS subroot, root, sha256(all_siblings) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM fold
""",
}
