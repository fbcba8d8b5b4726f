"""SQL of its own for each registered query, for another engine to run over the same tables."""

P = """
r AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS f, count(*) AS k FROM lineitem GROUP BY l_orderkey),
p AS (SELECT o_orderkey AS sample_id, o_custkey AS group_id, c_mktsegment AS category, o_orderstatus AS label,
             CASE WHEN k IS NULL OR f = 0 THEN 'O' WHEN f = k THEN 'F' ELSE 'P' END AS prediction
      FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN r ON l_orderkey = o_orderkey)"""
IMG = """
img AS (SELECT c_custkey AS image_id, n_name AS category, r_name AS family, sha256(CAST(c_custkey AS VARCHAR)) AS sha256, c_mktsegment AS segment
        FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey)"""
SPLIT = IMG + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('44|' || CAST(image_id AS VARCHAR)), image_id) AS rank, CAST(round_even(count(*) OVER (PARTITION BY category) * 0.15e0, 0) AS BIGINT) AS part FROM img),
s AS (SELECT *, CASE WHEN rank <= part THEN 'test' WHEN rank <= 2 * part THEN 'validation' ELSE 'train' END AS split FROM ranked)"""
QUOTA = IMG + """,
cnt AS (SELECT category, family, count(*) AS n FROM img GROUP BY category, family),
q AS (SELECT *, 2 * max(n) OVER (PARTITION BY family) AS quota, row_number() OVER (PARTITION BY family ORDER BY category) - 1 AS fi, count(*) OVER (PARTITION BY family) AS fn FROM cnt)"""
REL = QUOTA + """,
ft AS (SELECT family, sum(quota) AS ftot FROM q GROUP BY family),
ordered AS (SELECT img.*, row_number() OVER (PARTITION BY img.category ORDER BY sha256, image_id) - 1 AS idx FROM img),
unit AS (SELECT q.category, q.family, q.n, ftot, k, partial.category AS partner
         FROM (SELECT *, unnest(range(quota)) AS k FROM q) q JOIN ft USING (family) JOIN q AS partial ON partial.family = q.family AND partial.fi = (q.fi + 1) % q.fn),
place AS (SELECT unit.*, image_id, row_number() OVER (ORDER BY ftot DESC, unit.family, unit.category, k) - 1 AS pos
          FROM unit JOIN ordered ON ordered.category = unit.category AND ordered.idx = unit.k % unit.n),
z AS (SELECT count(*) AS z, max(ftot) AS m FROM place),
lab AS (SELECT 'MATCH' AS label, pos, image_id, family, category, category AS tcat FROM place
        UNION ALL SELECT 'PARTIAL_MATCH', pos, image_id, family, category, partner FROM place
        UNION ALL SELECT 'MISMATCH', a.pos, a.image_id, a.family, a.category, b.category FROM place a, z, place b WHERE b.pos = (a.pos + m) % z),
num AS (SELECT *, (row_number() OVER (PARTITION BY label, tcat ORDER BY pos) - 1) % 2 AS template, row_number() OVER (PARTITION BY image_id, label ORDER BY pos) AS occ FROM lab),
rel AS (SELECT CAST(image_id AS VARCHAR) || '_' || lower(label) || '_' || lpad(CAST(occ AS VARCHAR), 2, '0') AS sample_id, image_id, num.family AS part_family, num.category AS part_category, tcat AS text_category,
               cnt.family AS text_family, CASE template WHEN 0 THEN 'A: ' ELSE 'B: ' END || replace(tcat, '_', ' ') AS description, label, 'generated' AS source
        FROM num JOIN cnt ON cnt.category = tcat)"""
PARTNERS = QUOTA + """,
line AS (SELECT q.*, row_number() OVER (ORDER BY family, category) - 1 AS k, count(*) OVER () AS z FROM q),
partners AS (SELECT line.category, line.family, a.category AS partial_partner, b.category AS mismatch_partner
             FROM line JOIN line a ON a.family = line.family AND a.fi = (line.fi + 1) % line.fn JOIN line b ON b.k = (line.k + line.fn) % line.z)"""
HASH = """
v AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS category, [CAST(x AS DOUBLE) for x in list_concat(embedding, embedding)] AS e FROM embeddings),
cosine AS (SELECT u, i, sqrt((CASE WHEN u = 0 THEN 1 ELSE 2 END) / 32e0) * cos(pi() * (2 * i + 1) * u / 64) AS c FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(32)) AS i)),
down AS (SELECT id, u, j, sum(c * e[3 * i + j + 1]) AS t FROM v, cosine, (SELECT unnest(range(32)) AS j) GROUP BY id, u, j),
corner AS (SELECT id, 8 * down.u + cosine.u AS place, sum(t * c) AS x FROM down JOIN cosine ON down.j = cosine.i GROUP BY id, down.u, cosine.u),
mid AS (SELECT id, median(x) AS m FROM corner WHERE place > 0 GROUP BY id),
ph AS (SELECT id, string_agg(CASE WHEN x > m THEN '1' ELSE '0' END, '' ORDER BY place) AS bits FROM corner JOIN mid USING (id) GROUP BY id),
dh AS (SELECT id, string_agg(CASE WHEN e[8 * r + c + 2] > e[8 * r + c + 1] THEN '1' ELSE '0' END, '' ORDER BY r, c) AS bits FROM v, (SELECT unnest(range(8)) AS r), (SELECT unnest(range(8)) AS c) GROUP BY id),
h0 AS (SELECT v.id, category, CAST(CAST(ph.bits AS BIT) AS BIGINT) AS phash, CAST(CAST(dh.bits AS BIT) AS BIGINT) AS dhash FROM v JOIN ph ON ph.id = v.id JOIN dh ON dh.id = v.id),
hr AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('44|' || CAST(id AS VARCHAR)), id) AS rank, CAST(round_even(count(*) OVER (PARTITION BY category) * 0.15e0, 0) AS BIGINT) AS part FROM h0),
hs AS (SELECT id, category, phash, dhash, CASE WHEN rank <= part THEN 'test' WHEN rank <= 2 * part THEN 'validation' ELSE 'train' END AS split FROM hr)"""
NEAR = HASH + """,
met AS (SELECT a.category, a.split AS left_split, b.split AS right_split, a.id AS left_id, b.id AS right_id, CAST(bit_count(xor(a.phash, b.phash)) AS BIGINT) AS pd, CAST(bit_count(xor(a.dhash, b.dhash)) AS BIGINT) AS dd
        FROM hs a JOIN hs b ON a.category = b.category AND ((a.split = 'train' AND b.split IN ('validation', 'test')) OR (a.split = 'validation' AND b.split = 'test'))),
near AS (SELECT CASE WHEN pd <= 16 AND dd <= 24 THEN 'very_strict' WHEN pd <= 20 AND dd <= 28 THEN 'strict' WHEN pd <= 24 AND dd <= 32 THEN 'screen' END AS severity, * FROM met),
found AS (SELECT * FROM near WHERE severity IS NOT NULL)"""
DOCS = """
dr AS (SELECT doc_id, text, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('44|' || CAST(doc_id AS VARCHAR)), doc_id) AS rank, CAST(round_even(count(*) OVER (PARTITION BY lang) * 0.15e0, 0) AS BIGINT) AS part FROM documents),
ds AS (SELECT doc_id, text, CASE WHEN rank <= part THEN 'test' WHEN rank <= 2 * part THEN 'validation' ELSE 'train' END AS split FROM dr)"""
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
TERMS = DOCS + f""",
tok AS (SELECT doc_id, split, {TOKENS} AS t FROM ds),
term AS (SELECT doc_id, split, unnest(t) AS term FROM tok UNION ALL SELECT doc_id, split, t[i] || ' ' || t[i + 1] FROM (SELECT doc_id, split, t, unnest(range(1, len(t))) AS i FROM tok)),
tf AS (SELECT doc_id, split, term, count(*) AS tf FROM term GROUP BY ALL),
n AS (SELECT count(*) AS n FROM ds WHERE split = 'train'),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf WHERE split = 'train' GROUP BY term ORDER BY total DESC, term LIMIT 512),
fit AS (SELECT term, df, total, ln((1e0 + n) / (1e0 + df)) + 1e0 AS idf, row_number() OVER (ORDER BY term) - 1 AS index FROM vocab, n)"""
HISTORY = """
h AS (SELECT event_type AS model, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch, round(avg(value), 6) AS macro_f1, count(*) AS n FROM events GROUP BY ALL)"""
PAIRED = P + """,
top AS (SELECT label AS best FROM p GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
pair AS (SELECT sample_id, group_id, CAST(label = prediction AS INTEGER) AS l, CAST(label = best AS INTEGER) AS r FROM p, top)"""


def f1(source: str, by: str, labels: str | None) -> str:
    """Macro F1 over rows of source: label, prediction and the columns of by."""
    key, on = (f"{by}, " if by else ""), "".join(f" AND a.{c} = b.{c}" for c in by.split(", ") if c)
    every = f"SELECT DISTINCT {key}c FROM (SELECT {key}label AS c FROM {source} UNION ALL SELECT {key}prediction FROM {source})" if labels is None else f"SELECT {key}c FROM (SELECT DISTINCT {key}1 AS one FROM {source}), (SELECT unnest({labels}) AS c)"
    return f"""SELECT {key}avg(CASE WHEN sup + pred = 0 THEN 0e0 ELSE 2e0 * hit / (sup + pred) END) AS macro_f1 FROM (
      SELECT {', '.join(f'a.{c}' for c in by.split(', ')) + ', ' if by else ''}a.c, count(*) FILTER (b.label = a.c) AS sup, count(*) FILTER (b.prediction = a.c) AS pred, count(*) FILTER (b.label = a.c AND b.prediction = a.c) AS hit
      FROM ({every}) a JOIN {source} b ON 1 = 1{on} GROUP BY ALL) GROUP BY ALL"""


def block(source: str, by: str, group: str, labels: str | None) -> str:
    key = f"{by}, " if by else ""
    return f"""SELECT {key}rows, independent_groups, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM
      (SELECT {key}count(*) AS rows, count(DISTINCT {group}) AS independent_groups, avg(CAST(label = prediction AS INTEGER)) AS accuracy FROM {source} {'GROUP BY ALL' if by else ''}) {'JOIN' if by else 'LEFT JOIN'} ({f1(source, by, labels)}) {f'USING ({by})' if by else 'ON 1 = 1'}"""


STATES = "['F', 'O', 'P']"
MODES = "(SELECT unnest(['clean', 'natural']) AS text_mode)"
def _weighted(v: str) -> str:
    return f"round(list_sum([x * i FOR x, i IN {v}]), 6) AS weighted"


def _sums(v: str) -> str:
    """Sums of a list's values, and of the values times their places from 1."""
    return f"round(list_sum({v}), 6) AS total, {_weighted(v)}"


ORACLE_SQL: dict[str, str] = {
    "S1_image_manifest": f"WITH {IMG} SELECT image_id, category, family, sha256 FROM img",
    "S2_split_relations": f"WITH {REL}, {SPLIT.removeprefix(IMG + ',')} SELECT sample_id, label, split FROM rel JOIN s USING (image_id) WHERE split = 'validation'",
    "S5_archive_members": "SELECT CAST(doc_id AS VARCHAR) AS archive, 'data/' || CAST(doc_id AS VARCHAR) || '.jpg' AS path, true AS safe, true AS crc_ok, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "S6_S7_collected_files": """WITH d AS (SELECT lang, sha256(coalesce(text, '')) AS h FROM documents), x AS (SELECT 'category_size' AS "check", (SELECT count(*) FROM (SELECT lang FROM d GROUP BY lang HAVING count(*) <> 250)) AS value
      UNION ALL SELECT 'repeated_content', count(*) - count(DISTINCT h) FROM d UNION ALL SELECT 'known_content', count(*) FROM d WHERE h IN (SELECT sha256(text) FROM benchmark)) SELECT "check", value, value = 0 AS ok FROM x""",
    "S10_cached_features": f"SELECT vec_id, {_sums('e')} FROM (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings)",
    "S11_single_record": """
      WITH r AS (SELECT 'files/' || p_partkey || '.' || ['JPG', 'png', 'webp', 'gif', 'jpeg.txt'][p_partkey % 5 + 1] AS path, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS description FROM part)
      SELECT path, description, CASE WHEN path LIKE '%.gif' OR path LIKE '%.txt' THEN 'not one of jpg, jpeg, png, webp: ' || path WHEN description = '' THEN 'a description is required' END AS problem FROM r""",
    "K1_csv_report": f"WITH {IMG} SELECT image_id, category, family FROM img",
    "K2_K3_documents": """SELECT 0 AS same, 1 AS changed, sha256('{' || chr(10) || (SELECT string_agg('  "' || k || '": ' || CAST(v AS VARCHAR), ',' || chr(10) ORDER BY k) FROM (SELECT n_name AS k, n_regionkey AS v FROM nation UNION ALL SELECT 'more', 1)) || chr(10) || '}' || chr(10)) AS sha256""",
    "K4_K5_partitioned": f"WITH {SPLIT} SELECT split, count(*) AS images FROM s GROUP BY split",
    "K6_saved_model": """SELECT layer, CAST(size AS BIGINT) AS size FROM (VALUES ('i', 64 * 128), ('t', 64 * 128), ('h', 256 * 128), ('o', 128 * 3), ('ci', 128 * 25), ('ct', 128 * 25), ('i_bias', 128), ('t_bias', 128), ('h_bias', 128), ('o_bias', 3), ('ci_bias', 25), ('ct_bias', 25), ('terms', 64)) AS x(layer, size)""",
    "K7_verified_copies": f"WITH {SPLIT} SELECT 'v4_' || category || '_' || split || '_' || lpad(CAST(rank AS VARCHAR), 4, '0') || '_' || left(sha256, 16) AS target, sha256 FROM s",
    "K8_F3_model_summary": """
      WITH n AS (SELECT (SELECT max(len(embedding)) FROM embeddings) AS image, (SELECT count(*) FROM region) AS words, (SELECT count(*) FROM nation) AS c),
      a AS (SELECT unnest(['i', 't', 'h', 'o', 'ci', 'ct']) AS name, unnest([image, words, 16, 8, 8, 8]) AS inputs, unnest([8, 8, 8, 3, c, c]) AS outputs FROM n),
      p AS (SELECT name, inputs * outputs AS parameters FROM a UNION ALL SELECT name || '_bias', outputs FROM a)
      SELECT name, parameters, true AS same, false AS changed_same FROM (SELECT * FROM p UNION ALL SELECT 'total', CAST(sum(parameters) AS BIGINT) FROM p)""",
    "P17_lock": "SELECT * FROM (VALUES ('after', 'flag official'), ('after', 'changed b.json')) AS x(moment, difference)",
    "P19_forbidden_text": "SELECT doc_id AS path, word FROM documents, (VALUES ('@'), ('http'), ('password')) AS w(word) WHERE contains(text, word)",
    "A24_recomputed": "SELECT * FROM (VALUES ('rows'), ('lost')) AS x(metric)",
    "W3_selection": f"WITH {IMG}, c AS (SELECT category, category || '|' || CAST(image_id AS VARCHAR) AS candidate FROM img) SELECT category, candidate, row_number() OVER (PARTITION BY category ORDER BY sha256(candidate), candidate) AS selection_order FROM c QUALIFY selection_order <= 10",
    "S3_category_index": "SELECT n_name AS category, r_name AS family, rank() OVER (ORDER BY n_name) - 1 AS index FROM nation JOIN region ON n_regionkey = r_regionkey",
    "S4_json_document": "SELECT event_type, count(*) AS events, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS k_sum, max(CAST(props->>'k' AS BIGINT)) AS k_max FROM events GROUP BY event_type",
    "S8_lazy_dataset": f"""WITH {REL}, c AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS k FROM nation)
      SELECT sample_id, CASE rel.label WHEN 'MATCH' THEN 0 WHEN 'MISMATCH' THEN 1 ELSE 2 END::BIGINT AS label_code, a.k AS image_code, b.k AS text_code, {_sums('[CAST(x AS DOUBLE) FOR x IN embedding]')}
      FROM rel JOIN c a ON a.n_name = part_category JOIN c b ON b.n_name = text_category JOIN embeddings ON vec_id = image_id % (SELECT count(*) FROM embeddings)""",
    "S9_hash_manifest": "SELECT sha256(text) AS sha256, CAST(doc_id AS VARCHAR) AS path FROM documents",
    "K7_content_path": f"""WITH {SPLIT}, k AS (SELECT *, 'v4_' || category || '_' || split || '_' || lpad(CAST(rank AS VARCHAR), 4, '0') || '_' || left(sha256, 16) AS content_id FROM s)
      SELECT image_id, content_id, split || '/' || category || '/' || content_id AS path FROM k""",
    "P1_P2_prediction_rows": f"WITH {P} SELECT sample_id, label AS true_label, prediction AS predicted_label, label = prediction AS is_correct FROM p",
    "P3_membership": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (0, 1, 2) AND c_acctbal > 0",
    "P5_label_rule": f"WITH {REL} SELECT label, CASE WHEN part_category = text_category THEN 'MATCH' WHEN part_family = text_family THEN 'PARTIAL_MATCH' ELSE 'MISMATCH' END AS rule_label, count(*) AS rows FROM rel GROUP BY ALL",
    "P6_encode": "SELECT o_orderpriority, CAST(left(o_orderpriority, 1) AS BIGINT) - 1 AS code, count(*) AS rows FROM orders GROUP BY ALL",
    "P7_strict_boolean": f"WITH {P} SELECT label = prediction AS correct, count(*) AS rows FROM p GROUP BY ALL",
    "P10_uniqueness": """SELECT 'unique(c_custkey)' AS "check", count(*) - count(DISTINCT c_custkey) AS value, value = 0 AS ok FROM customer
      UNION ALL SELECT 'unique(c_name)', count(*) - count(DISTINCT c_name) AS v, v = 0 FROM customer UNION ALL SELECT 'unique(doc_id)', count(*) - count(DISTINCT doc_id) AS v, v = 0 FROM documents
      UNION ALL SELECT 'unique(text)', count(*) - count(DISTINCT text) AS v, v = 0 FROM documents UNION ALL SELECT 'unique(l_orderkey,l_linenumber)', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS v, v = 0 FROM lineitem""",
    "P11_domain": """SELECT 'unexpected(c_nationkey)' AS "check", count(*) AS value, count(*) = 0 AS ok FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20))
      UNION ALL SELECT 'missing(c_nationkey)', count(*), count(*) = 0 FROM nation WHERE n_nationkey < 20 AND n_nationkey NOT IN (SELECT c_nationkey FROM customer)""",
    "P12_counts": f"""WITH {IMG}, d AS (SELECT * FROM (VALUES ('BUILDING', 300), ('MACHINERY', 299), ('NOWHERE', 1)) AS x(segment, declared)), h AS (SELECT segment, count(*) AS rows FROM img GROUP BY segment)
      SELECT segment, coalesce(rows, 0) AS rows, CAST(coalesce(declared, 0) AS BIGINT) AS declared, coalesce(rows, 0) = coalesce(declared, 0) AS ok FROM h FULL JOIN d USING (segment)""",
    "P13_rule_violations": f"""WITH {REL} SELECT count(*) AS total, count(*) FILTER (label = 'MATCH' AND part_category <> text_category) AS match_violations,
      count(*) FILTER (label = 'PARTIAL_MATCH' AND (part_category = text_category OR part_family <> text_family)) AS partial_violations, count(*) FILTER (label = 'MISMATCH' AND part_family = text_family) AS mismatch_violations,
      count(*) FILTER (a.family <> part_family OR b.family <> text_family) AS family_violations FROM rel JOIN cnt a ON a.category = part_category JOIN cnt b ON b.category = text_category""",
    "P14_content_hashes": "SELECT count(*) AS files, CAST(0 AS BIGINT) AS missing, count(*) FILTER (doc_id % 10 = 0) AS mismatched FROM documents",
    "P15_path_policy": f"""WITH {SPLIT} SELECT 'open_under_prefix' AS "check", CAST(0 AS BIGINT) AS value, true AS ok
      UNION ALL SELECT 'locked_elsewhere', count(*) FILTER (split = 'test' AND image_id % 11 = 0) AS v, v = 0 FROM s""",
    "P16_plan_check": f"""WITH {PARTNERS}, x AS (SELECT * FROM (SELECT 'categories_per_family' AS "check", (SELECT count(*) FROM (SELECT family FROM partners GROUP BY family HAVING count(*) <> 5)) AS value)
      UNION ALL SELECT 'partial_partner_repeated', count(*) - count(DISTINCT partial_partner) FROM partners UNION ALL SELECT 'mismatch_partner_repeated', count(*) - count(DISTINCT mismatch_partner) FROM partners
      UNION ALL SELECT 'partial_partner_unknown', count(*) FILTER (partial_partner NOT IN (SELECT category FROM partners)) FROM partners UNION ALL SELECT 'mismatch_partner_unknown', count(*) FILTER (mismatch_partner NOT IN (SELECT category FROM partners)) FROM partners
      UNION ALL SELECT 'partial_partner_itself', count(*) FILTER (partial_partner = category) FROM partners UNION ALL SELECT 'mismatch_partner_itself', count(*) FILTER (mismatch_partner = category) FROM partners
      UNION ALL SELECT 'partial_partner_family', count(*) FROM partners a JOIN partners b ON a.partial_partner = b.category WHERE a.family <> b.family UNION ALL SELECT 'mismatch_partner_family', count(*) FROM partners a JOIN partners b ON a.mismatch_partner = b.category WHERE a.family = b.family)
      SELECT "check", value, value = 0 AS ok FROM x""",
    "P18_provenance": """SELECT 'placeholders' AS "check", count(*) FILTER (event_type = 'purchase') AS value, count(*) FILTER (event_type = 'purchase') = 0 AS ok FROM events UNION ALL SELECT 'reviewed_not_set', count(*) FILTER (NOT value > 1) AS v, v = 0 FROM events""",
    "P21_any_contains": "SELECT p_partkey FROM part WHERE p_name ILIKE '%econ%' OR p_brand ILIKE '%econ%' OR p_type ILIKE '%econ%'",
    "J2_feature_lookup": "SELECT c_custkey AS image_id, vec_id, round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 4) AS feature_sum FROM customer JOIN embeddings ON vec_id = c_custkey % (SELECT count(*) FROM embeddings)",
    "J3_text_lookup": f"SELECT doc_id, CAST(coalesce(len({TOKENS}), 0) AS BIGINT) AS n_tokens FROM documents",
    "J4_J6_relation_pairs": f"WITH {REL} SELECT * FROM rel",
    "J7_expand_modes": f"""WITH {PARTNERS} SELECT CAST(image_id AS VARCHAR) || '_' || text_mode || '_' || lower(label) AS sample_id, image_id, category AS part_category, text_category, label, text_mode FROM (
      SELECT image_id, img.category, 'MATCH' AS label, img.category AS text_category FROM img UNION ALL SELECT image_id, img.category, 'PARTIAL_MATCH', partial_partner FROM img JOIN partners USING (category)
      UNION ALL SELECT image_id, img.category, 'MISMATCH', mismatch_partner FROM img JOIN partners USING (category)), {MODES}""",
    "J8_near_duplicate_pairs": f"WITH {NEAR} SELECT severity, category, left_split, right_split, left_id, right_id, pd AS phash_distance, dd AS dhash_distance FROM found",
    "J8_banded_near_duplicates": f"""WITH {HASH}, h AS (SELECT * FROM hs WHERE split = 'train'),
      c AS (SELECT id + 1000000 AS id, category, xor(phash, CAST(1::HUGEINT << CAST(id % 64 AS INTEGER) AS UBIGINT)::BIT::BIGINT | ((id % 32) << 7)) AS phash, dhash FROM h),
      m AS (SELECT h.id AS left_id, c.id AS right_id, CAST(bit_count(xor(h.phash, c.phash)) AS BIGINT) AS p, CAST(bit_count(xor(h.dhash, c.dhash)) AS BIGINT) AS d FROM h JOIN c USING (category))
      SELECT CASE WHEN p <= 4 AND d <= 6 THEN 'very_strict' WHEN p <= 6 AND d <= 8 THEN 'strict' ELSE 'screen' END AS severity, left_id, right_id, p AS phash_distance, d AS dhash_distance FROM m WHERE p <= 8 AND d <= 10""",
    "J9_split_overlap": f"""WITH {SPLIT}, l AS (SELECT split, 'image_id' AS "column", CAST(image_id AS VARCHAR) AS v FROM s UNION SELECT split, 'segment', segment FROM s UNION SELECT split, 'sha256', sha256 FROM s),
      pairs AS (SELECT * FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) AS x("left", "right")), cols AS (SELECT DISTINCT "column" FROM l)
      SELECT "left", "right", cols."column", (SELECT count(*) FROM l a JOIN l b ON a.v = b.v AND a."column" = b."column" WHERE a.split = "left" AND b.split = "right" AND a."column" = cols."column") AS shared FROM pairs, cols""",
    "J10_description_overlap": f"""WITH {DOCS}, pairs AS (SELECT * FROM (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) AS x("left", "right"))
      SELECT "left", "right", 'text' AS "column", (SELECT count(*) FROM (SELECT text FROM ds WHERE split = "left" INTERSECT SELECT text FROM ds WHERE split = "right")) AS shared FROM pairs""",
    "J12_A17_paired_difference": f"""WITH {PAIRED}, g AS (SELECT group_id, sum(l - r) AS d, count(*) AS n FROM pair GROUP BY group_id)
      SELECT (SELECT count(*) FROM g) AS independent_groups, count(*) AS paired_rows, CAST(sum(l) AS BIGINT) AS left_correct_total, CAST(sum(r) AS BIGINT) AS right_correct_total, CAST(sum(l - r) AS BIGINT) AS observed_difference,
        round(sum(l - r) / count(*), 6) AS observed_accuracy_difference, (SELECT count(*) FROM g WHERE d > 0) AS left_better_groups, (SELECT count(*) FROM g WHERE d < 0) AS right_better_groups, (SELECT count(*) FROM g WHERE d = 0) AS tied_groups,
        count(*) FILTER (l = 1 AND r = 0) AS left_only_rows, count(*) FILTER (l = 0 AND r = 1) AS right_only_rows, count(*) FILTER (l <> r) AS discordant_rows FROM pair""",
    "J13_frames_equal": f"""WITH {P} SELECT 'frames_equal' AS "check", 2 * count(*) FILTER (sample_id % 100 = 0 AND prediction <> 'P') AS value, value = 0 AS ok FROM p""",
    "J14_sampled_relations": f"""WITH {REL}, rk AS (SELECT image_id, row_number() OVER (PARTITION BY category ORDER BY sha256('44|' || CAST(image_id AS VARCHAR)), image_id) AS rank, CAST(round_even(count(*) OVER (PARTITION BY category) * 0.15e0, 0) AS BIGINT) AS part FROM img),
      sp AS (SELECT image_id, CASE WHEN rank <= part THEN 'test' WHEN rank <= 2 * part THEN 'validation' ELSE 'train' END AS split FROM rk),
      pick AS (SELECT image_id FROM sp QUALIFY row_number() OVER (PARTITION BY split ORDER BY sha256('44|' || CAST(image_id AS VARCHAR)), image_id) <= 20)
      SELECT sample_id, label FROM rel WHERE image_id IN (SELECT image_id FROM pick)""",
    "A1_value_counts": f"WITH {SPLIT} SELECT split, category, count(*) AS images FROM s GROUP BY ALL",
    "A2_distinct_counts": "SELECT count(DISTINCT doc_id) AS ids, count(DISTINCT text) AS texts, count(DISTINCT source) AS sources FROM documents",
    **{k: f"""WITH {REL}, w AS (SELECT {c}, count(*) FILTER (label = 'MATCH') AS "MATCH", count(*) FILTER (label = 'MISMATCH') AS "MISMATCH", count(*) FILTER (label = 'PARTIAL_MATCH') AS "PARTIAL_MATCH" FROM rel GROUP BY {c})
      SELECT *, "MATCH" = "MISMATCH" AND "MATCH" = "PARTIAL_MATCH" AND "MATCH" >= 1 AS balanced FROM w""" for k, c in (("A3_A4_balance_image", "image_id"), ("A4_balance_category", "text_category"), ("A4_balance_description", "description"))},
    "A5_crosstab": f"""WITH {SPLIT}, v AS (SELECT * FROM (VALUES (0, 'AUTOMOBILE'), (1, 'BUILDING'), (2, 'FURNITURE'), (3, 'HOUSEHOLD'), (4, 'MACHINERY')) AS x(position, row_value))
      SELECT position, row_value, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation FROM v LEFT JOIN s ON segment = row_value GROUP BY ALL""",
    "A6_quotas": f"WITH {QUOTA} SELECT category, family, n, quota FROM q",
    "A7_margins": f"""WITH {REL}, a AS (SELECT text_category, label, count(*) AS n FROM rel GROUP BY ALL)
      SELECT 'margins' AS "check", count(*) FILTER (a.n <> quota) AS value, value = 0 AS ok, count(*) AS compared FROM a JOIN q ON q.category = text_category""",
    "A8_metric_by_segment": f"WITH {P} {block('p', 'category', 'group_id', None)}",
    "A8_fixed_and_union": f"""WITH {P}, w AS (SELECT * FROM p WHERE label <> 'P' AND prediction <> 'P') SELECT 'fixed' AS labels, * FROM ({block('w', '', 'group_id', STATES)})
      UNION ALL SELECT 'union', * FROM ({block('w', '', 'group_id', None)}) UNION ALL SELECT 'empty', 0, 0, NULL, NULL""",
    "A9_confusion_matrix": f"""WITH {P}, l AS (SELECT * FROM (VALUES (0, 'F'), (1, 'O'), (2, 'P')) AS x(position, lab)) SELECT position, lab AS label, count(*) FILTER (prediction = 'F') AS "F", count(*) FILTER (prediction = 'O') AS "O", count(*) FILTER (prediction = 'P') AS "P"
      FROM l LEFT JOIN p ON label = lab GROUP BY ALL""",
    "A10_per_class": f"""WITH {P}, c AS (SELECT x AS label, (SELECT count(*) FROM p WHERE p.label = x) AS support, (SELECT count(*) FROM p WHERE prediction = x) AS pred, (SELECT count(*) FROM p WHERE prediction = x AND p.label = x) AS hit FROM (SELECT unnest({STATES}) AS x))
      SELECT label, round(CASE WHEN pred = 0 THEN 0 ELSE hit / pred END, 6) AS precision, round(CASE WHEN support = 0 THEN 0 ELSE hit / support END, 6) AS recall, round(CASE WHEN pred + support = 0 THEN 0 ELSE 2 * hit / (pred + support) END, 6) AS f1, support FROM c""",
    "A11_per_category": f"WITH {P}, w AS (SELECT p.*, n_name AS nation FROM p JOIN customer ON c_custkey = group_id JOIN nation ON n_nationkey = c_nationkey) {block('w', 'nation', 'group_id', None)}",
    "A12_group_accuracy": f"""WITH {P}, g AS (SELECT group_id, avg(CAST(label = prediction AS INTEGER)) AS a, count(*) AS n FROM p GROUP BY group_id)
      SELECT count(*) AS groups, round(avg(a), 6) AS mean_accuracy, round(median(a), 6) AS median_accuracy, round(min(a), 6) AS min_accuracy, count(*) FILTER (a = 1) AS perfect_groups, round(count(*) FILTER (a = 1) / count(*), 6) AS perfect_fraction, min(n) AS min_rows, median(n) AS median_rows, max(n) AS max_rows FROM g""",
    "A13_error_directions": f"WITH {P} SELECT category, label, prediction, count(*) AS errors FROM p WHERE label <> prediction GROUP BY ALL",
    "A13_O4_errors_top10": f"WITH {P} SELECT group_id, category, count(*) AS errors FROM p WHERE label <> prediction GROUP BY ALL ORDER BY errors DESC, group_id, category LIMIT 10",
    "A14_J11_duplicate_sensitivity": f"""WITH {NEAR}, {P}, w AS (SELECT id, label, prediction FROM p JOIN hs ON id = sample_id WHERE split = 'test'),
      flag AS (SELECT right_id AS id, min(CASE severity WHEN 'very_strict' THEN 1 WHEN 'strict' THEN 2 ELSE 3 END) AS k FROM found WHERE right_split = 'test' GROUP BY right_id),
      """ + ", ".join(f"w{k} AS (SELECT * FROM w WHERE id NOT IN (SELECT id FROM flag WHERE k <= {k}))" for k in (1, 2, 3)) + " " + " UNION ALL ".join(f"""SELECT '{s}' AS severity, (SELECT count(DISTINCT id) FROM w WHERE id IN (SELECT id FROM flag WHERE k <= {k})) AS flagged_groups,
      round((SELECT count(DISTINCT id) FROM w WHERE id IN (SELECT id FROM flag WHERE k <= {k})) / (SELECT count(DISTINCT id) FROM w), 6) AS flagged_fraction, * FROM ({block(f'w{k}', '', 'id', STATES)})""" for k, s in enumerate(("very_strict", "strict", "screen"), 1)),
    "A15_severity_counts": f"""WITH {NEAR}, sv AS (SELECT * FROM (VALUES (1, 'very_strict'), (2, 'strict'), (3, 'screen')) AS x(position, name)), t AS (SELECT found.*, sv.position AS k FROM found JOIN sv ON name = severity)
      SELECT sv.position, name AS severity, (SELECT count(*) FROM t WHERE k = sv.position) AS pairs, (SELECT count(DISTINCT right_id) FROM t WHERE right_split = 'test' AND k <= sv.position) AS flagged FROM sv""",
    "A16_accuracy_groups": f"""WITH {P} SELECT category, label, CAST(grouping(category, label) AS BIGINT) AS "grouping", count(*) AS rows, round(avg(CAST(label = prediction AS INTEGER)), 6) AS accuracy FROM p GROUP BY GROUPING SETS ((), (category), (label), (category, label))""",
    "A18_sign_flip_exact": f"""WITH {PAIRED}, d AS (SELECT r_name, sum(l - pair.r) AS v FROM pair JOIN customer ON c_custkey = group_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name),
      num AS (SELECT v, row_number() OVER (ORDER BY r_name) - 1 AS i FROM d), a AS (SELECT unnest(range(CAST(pow(2, (SELECT count(*) FROM d)) AS BIGINT))) AS a),
      t AS (SELECT a, abs(sum(CASE WHEN (a >> i) & 1 = 1 THEN v ELSE -v END)) AS s FROM a, num GROUP BY a)
      SELECT count(*) AS assignments, count(*) FILTER (s >= (SELECT abs(sum(v)) FROM d)) AS extreme, round(count(*) FILTER (s >= (SELECT abs(sum(v)) FROM d)) / count(*), 6) AS p_value FROM t""",
    "A19_sign_flip_monte_carlo": f"""WITH {PAIRED}, d AS (SELECT group_id, sum(l - r) AS v FROM pair GROUP BY group_id),
      h AS (SELECT v, b, sha256('42|' || CAST(b AS VARCHAR) || '|' || CAST(group_id AS VARCHAR)) AS x FROM d, (SELECT unnest(range(391)) AS b) WHERE v <> 0),
      digit AS (SELECT b, k, v, strpos('0123456789abcdef', substr(x, CAST(k + 1 AS INTEGER), 1)) - 1 AS y FROM h, (SELECT unnest(range(64)) AS k)),
      four AS (SELECT b, k, [sum(CASE WHEN y >= 8 THEN v ELSE -v END), sum(CASE WHEN y & 4 > 0 THEN v ELSE -v END), sum(CASE WHEN y & 2 > 0 THEN v ELSE -v END), sum(CASE WHEN y & 1 > 0 THEN v ELSE -v END)] AS z FROM digit GROUP BY b, k),
      t AS (SELECT abs(s) AS s FROM (SELECT b * 256 + k * 4 AS r, unnest(z) AS s, unnest(range(4)) AS i FROM four) WHERE r + i < 100000)
      SELECT count(*) AS repeats, count(*) FILTER (s >= (SELECT abs(sum(v)) FROM d)) AS extreme, round((count(*) FILTER (s >= (SELECT abs(sum(v)) FROM d)) + 1) / (count(*) + 1), 6) AS p_value FROM t""",
    "A20_cluster_bootstrap": f"""WITH {P}, g AS (SELECT group_id, row_number() OVER (ORDER BY sha256(CAST(group_id AS VARCHAR)), group_id) - 1 AS i, count(*) OVER () AS z FROM (SELECT DISTINCT group_id FROM p)),
      x AS (SELECT seed, b, j, z, sha256(CAST(seed AS VARCHAR) || '|' || CAST(b AS VARCHAR) || '|' || CAST(j // 5 AS VARCHAR)) AS x
            FROM (VALUES (42), (43)) AS seeds(seed), (SELECT unnest(range(2000)) AS b), (SELECT z, unnest(range(z)) AS j FROM (SELECT max(z) AS z FROM g))),
      draw AS (SELECT seed, b, CAST(concat('0x', substr(x, CAST(1 + 12 * (j % 5) AS INTEGER), 12)) AS BIGINT) % z AS i FROM x),
      own AS (SELECT i, label, prediction, count(*) AS n FROM g JOIN p USING (group_id) GROUP BY ALL),
      cell AS (SELECT seed, b, label, prediction, sum(n) AS n FROM draw JOIN own USING (i) GROUP BY ALL),
      lab AS (SELECT seed, b, c, sum(t) AS sup, sum(q) AS pred, sum(h) AS hit FROM (SELECT seed, b, label AS c, n AS t, 0 AS q, CASE WHEN label = prediction THEN n ELSE 0 END AS h FROM cell UNION ALL SELECT seed, b, prediction, 0, n, 0 FROM cell) GROUP BY ALL),
      acc AS (SELECT b, sum(n) FILTER (label = prediction) / sum(n) AS acc FROM cell WHERE seed = 42 GROUP BY b),
      f AS (SELECT b, avg(2e0 * hit / (sup + pred)) AS f FROM lab WHERE seed = 43 GROUP BY b)
      SELECT round(quantile_cont(acc, 0.025), 6) AS accuracy_low, round(quantile_cont(acc, 0.975), 6) AS accuracy_high, round(quantile_cont(f, 0.025), 6) AS macro_f1_low, round(quantile_cont(f, 0.975), 6) AS macro_f1_high FROM acc JOIN f USING (b)""",
    "A21_ablation": f"""WITH {P}, run AS (SELECT category, sample_id % 3 AS seed, avg(CAST(label = prediction AS INTEGER)) AS a, min(prediction) AS m FROM p GROUP BY ALL)
      SELECT category, round(avg(a), 6) AS mean_metric, round(min(a), 6) AS min_metric, round(max(a), 6) AS max_metric, count(DISTINCT m) = 1 AS collapsed, round(0.4e0 - avg(a), 6) AS gap_to_selected FROM run GROUP BY category""",
    "A22_rule_diagnostic": f"""WITH {REL}, nx AS (SELECT a.category, b.category AS nxt FROM q a JOIN q b ON a.family = b.family AND b.fi = (a.fi + 1) % a.fn),
      w AS (SELECT label, CASE WHEN image_id % 3 = 0 THEN 'MATCH' ELSE label END AS guess, part_category AS pc, text_category AS tc, CASE WHEN image_id % 5 = 0 THEN a.nxt ELSE part_category END AS gp, CASE WHEN image_id % 7 = 0 THEN b.nxt ELSE text_category END AS gt, part_family, text_family
            FROM rel JOIN nx a ON a.category = part_category JOIN nx b ON b.category = text_category),
      y AS (SELECT *, CASE WHEN gp = gt THEN 'MATCH' WHEN part_family = text_family THEN 'PARTIAL_MATCH' ELSE 'MISMATCH' END AS rule FROM w)
      SELECT count(*) AS rows, round(avg((label = guess)::INT), 6) AS learned_accuracy, round(avg((pc = gp)::INT), 6) AS image_category_accuracy, round(avg((tc = gt)::INT), 6) AS text_category_accuracy, round(avg((label = rule)::INT), 6) AS rule_accuracy, 1e0 AS oracle_accuracy,
        round(avg((label = guess)::INT) - avg((label = rule)::INT), 6) AS learned_minus_rule FROM y""",
    "A23_running_mean": f"WITH {HISTORY} SELECT a.model, a.epoch, round(sum(b.macro_f1 * b.n) / sum(b.n), 6) AS running_mean FROM h a JOIN h b ON a.model = b.model AND b.epoch <= a.epoch GROUP BY ALL",
    "W1_W2_stratified_split": f"WITH {SPLIT} SELECT image_id, category, rank, split FROM s",
    "W4_W5_templates": f"WITH {REL} SELECT label, text_category, description, count(*) AS rows, min(sample_id) AS first_sample, max(sample_id) AS last_sample FROM rel GROUP BY ALL",
    "W7_best_epoch": f"WITH {HISTORY} SELECT model, epoch, macro_f1 FROM h QUALIFY row_number() OVER (PARTITION BY model ORDER BY macro_f1 DESC, epoch) = 1",
    "W8_early_stop": f"""WITH RECURSIVE {HISTORY}, o AS (SELECT model, epoch, macro_f1 AS loss, row_number() OVER (PARTITION BY model ORDER BY epoch) AS i FROM h),
      f AS (SELECT model, i, epoch AS best_step, loss AS best_loss, 0 AS stale, CAST(NULL AS BIGINT) AS stopped_step FROM o WHERE i = 1
        UNION ALL SELECT f.model, o.i, CASE WHEN loss < best_loss - 1e-4 THEN epoch ELSE best_step END, CASE WHEN loss < best_loss - 1e-4 THEN loss ELSE best_loss END, CASE WHEN loss < best_loss - 1e-4 THEN 0 ELSE stale + 1 END,
          CASE WHEN loss >= best_loss - 1e-4 AND stale + 1 >= 3 THEN epoch END FROM f JOIN o ON o.model = f.model AND o.i = f.i + 1 WHERE stopped_step IS NULL)
      SELECT model, best_step, best_loss, stopped_step FROM f QUALIFY row_number() OVER (PARTITION BY model ORDER BY i DESC) = 1""",
    "O1_multi_key_sort": "SELECT row_number() OVER (ORDER BY n DESC, balance DESC, c_mktsegment, c_nationkey) AS position, c_mktsegment, c_nationkey, n FROM (SELECT c_mktsegment, c_nationkey, round(sum(c_acctbal), 2) AS balance, count(*) AS n FROM customer GROUP BY ALL)",
    "O2_custom_order": f"WITH {SPLIT} SELECT row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END, category) AS position, split, category, count(*) AS n FROM s GROUP BY split, category",
    "O3_model_select": f"""WITH {P}, top AS (SELECT label AS best FROM p GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), m AS (SELECT label, best AS prediction, group_id FROM p, top),
      b AS (SELECT 'rule' AS model, * FROM ({block('p', '', 'group_id', None)}) UNION ALL SELECT 'majority', * FROM ({block('m', '', 'group_id', None)})) SELECT model, accuracy, macro_f1 FROM b ORDER BY macro_f1 DESC, accuracy DESC, model LIMIT 1""",
    "O5_head": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25",
    "O6_seeded_sample": f"WITH {IMG} SELECT segment, image_id, row_number() OVER (PARTITION BY segment ORDER BY sha256('44|' || CAST(image_id AS VARCHAR)), image_id) AS rank FROM img QUALIFY rank <= 15",
    "O8_sorted_distinct": "SELECT row_number() OVER (ORDER BY p_type, p_brand) AS position, p_type, p_brand FROM (SELECT DISTINCT p_type, p_brand FROM part)",
    "U1_U2_unions": f"WITH {SPLIT} SELECT count(*) AS all_rows, count(DISTINCT segment) AS distinct_rows FROM s WHERE split IN ('train', 'validation')",
    "U3_U6_sets": """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier), w AS (SELECT k, k IN (SELECT k FROM a) AS ia, k IN (SELECT k FROM b) AS ib FROM (SELECT k FROM a UNION SELECT k FROM b))
      SELECT 'intersection' AS "set", count(*) FILTER (ia AND ib) AS n FROM w UNION ALL SELECT 'left_only', count(*) FILTER (ia AND NOT ib) FROM w UNION ALL SELECT 'right_only', count(*) FILTER (ib AND NOT ia) FROM w UNION ALL SELECT 'symmetric_difference', count(*) FILTER (ia <> ib) FROM w""",
    "F1_F2_digests": "SELECT n_name AS category, sha256(n_name) AS sha256, 44 + CAST(concat('0x', left(sha256(n_name), 8)) AS BIGINT) AS seed FROM nation",
    "F4_F6_strings": """SELECT p_partkey, p_name AS display, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, CASE WHEN p_partkey % 50 = 0 THEN 'x.JPG' ELSE replace(p_name, ' ', '_') || '.jpg' END AS file, true AS is_jpg, p_partkey % 50 <> 0 AS safe FROM part""",
    "F7_tokens": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS BIGINT) AS n_terms FROM (SELECT doc_id, {TOKENS} AS t FROM documents)",
    "F8_tfidf_fit": f"WITH {TERMS} SELECT term, df, CAST(total AS BIGINT) AS total, round(idf, 6) AS idf, index FROM fit",
    "F9_tfidf_transform": f"WITH {TERMS}, raw AS (SELECT doc_id, term, (1e0 + ln(tf)) * idf AS raw FROM tf JOIN fit USING (term) WHERE split = 'test'), norm AS (SELECT doc_id, sqrt(sum(raw * raw)) AS z FROM raw GROUP BY doc_id) SELECT doc_id, term, round(raw / z, 6) AS weight FROM raw JOIN norm USING (doc_id)",
    "F10_recognised": f"WITH {TERMS} SELECT ds.doc_id, count(fit.term) AS recognised FROM ds LEFT JOIN tf ON tf.doc_id = ds.doc_id LEFT JOIN fit ON fit.term = tf.term WHERE ds.split = 'test' GROUP BY ds.doc_id",
    "F11_F12_hashes": f"WITH {HASH} SELECT id, split, phash, dhash FROM hs",
    "F13_hamming": f"WITH {HASH} SELECT id, CAST(bit_count(xor(phash, dhash)) AS BIGINT) AS distance FROM hs",
    "F14_math": f"WITH {IMG} SELECT category, CAST(round_even(count(*) * 0.15e0, 0) AS BIGINT) AS part, abs(count(*) - 60) AS gap, round(avg(image_id), 6) AS mean_id, median(image_id) AS median_id, round(quantile_cont(image_id, 0.975), 6) AS high FROM img GROUP BY category",
    "F15_softmax": f"""WITH l AS (SELECT vec_id, [CAST(x AS DOUBLE) * 10 FOR x IN embedding] AS z FROM embeddings), e AS (SELECT vec_id, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM l),
      p AS (SELECT vec_id, z, [x / list_sum(e) FOR x IN e] AS p FROM e)
      SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS BIGINT) AS best, round(list_max(p), 6) AS score, {_weighted('p')} FROM p""",
    "F16_F21_arrays": f"""
      WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
      v AS (SELECT vec_id, list_concat([(e[i % 64 + 1] - 0.485e0) / 0.229e0 FOR i IN range(64)], [(e[(i + 1) % 64 + 1] - 0.456e0) / 0.224e0 FOR i IN range(64)], [(e[(i + 2) % 64 + 1] - 0.406e0) / 0.225e0 FOR i IN range(64)], e) AS v FROM e)
      SELECT vec_id, len(v) AS size, {_sums('v')} FROM v""",
    "F18_augmentation": f"""WITH h AS (SELECT vec_id, [abs(CAST(x AS DOUBLE)) FOR x IN embedding] AS e, sha256('44|' || CAST(vec_id AS VARCHAR)) AS h FROM embeddings),
      f AS (SELECT vec_id, e, left(h, 1) < '8' AS turned, 0.9e0 + (1.1e0 - 0.9e0) * CAST(concat('0x', substr(h, 2, 8)) AS BIGINT) / 4294967296e0 AS b FROM h),
      v AS (SELECT vec_id, [least(e[CASE WHEN turned THEN i // 8 * 8 + 8 - i % 8 ELSE i + 1 END] * b, 1e0) FOR i IN range(64)] AS v FROM f)
      SELECT vec_id, {_sums('v')} FROM v""",
    "F19_json": f"""WITH {P} SELECT '{{' || string_agg('"' || category || '":' || CAST(n AS VARCHAR), ',' ORDER BY category) || '}}' AS document FROM (SELECT category, count(*) AS n FROM p GROUP BY category)""",
    "M1_majority": f"WITH {P}, top AS (SELECT label AS best FROM p GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) SELECT category, best AS prediction, round(avg(CAST(label = best AS INTEGER)), 6) AS accuracy FROM p, top GROUP BY category, best",
}

EMB = """
v AS (SELECT vec_id, CAST(label % 3 AS INT) AS label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
vr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('44|' || CAST(vec_id AS VARCHAR)), vec_id) AS rank, CAST(round_even(count(*) OVER (PARTITION BY label) * 0.15e0, 0) AS BIGINT) AS part FROM v),
emb AS (SELECT vec_id, label, e, CASE WHEN rank <= part THEN 'test' WHEN rank <= 2 * part THEN 'validation' ELSE 'train' END AS split FROM vr)"""


def _drawn(layer: str, inputs: int, outputs: int) -> str:
    """A layer's first weights (i, j, w): each from the SHA-256 of its name and place; the bias is the row after the last input."""
    name = f"CASE WHEN i < {inputs} THEN '44|{layer}|' || i || '|' || j ELSE '44|{layer}_bias|0|' || j END"
    draw = f"CAST('0x' || left(sha256({name}), 8) AS BIGINT) / 2147483648e0 - 1"
    return f"(SELECT i, j, ({draw}) / sqrt({inputs}e0) AS w FROM (SELECT unnest(range({inputs + 1})) AS i), (SELECT unnest(range({outputs})) AS j))"


def _product(rows: str, weights: str, relu: bool, inputs: int) -> str:
    """rows (id, i, x) with a one after the last input, times weights: id, i, x."""
    total = "greatest(sum(x * w), 0)" if relu else "sum(x * w)"
    return f"(SELECT id, j AS i, {total} AS x FROM (SELECT id, i, x FROM {rows} UNION ALL SELECT DISTINCT id, {inputs}, 1e0 FROM {rows}) a JOIN {weights} b USING (i) GROUP BY id, j)"


def _softmax(logits: str) -> str:
    top = f"(SELECT *, max(x) OVER (PARTITION BY id) AS top FROM {logits})"
    return f"(SELECT id, i, exp(x - top) / sum(exp(x - top)) OVER (PARTITION BY id) AS p FROM {top})"


def _rows(name: str, where: str) -> str:
    """name_x (id, i, x) and name_y (id, label) of the embeddings of some splits."""
    return f"""
{name}_x AS MATERIALIZED (SELECT vec_id AS id, unnest(range(64)) AS i, unnest(e) AS x FROM emb WHERE {where}), {name}_y AS (SELECT vec_id AS id, label FROM emb WHERE {where})"""


def _one(rows: str, inputs: int) -> str:
    """rows and a one after the last input."""
    return f"(SELECT id, i, x FROM {rows} UNION ALL SELECT DISTINCT id, {inputs}, 1e0 FROM {rows})"


def _trained(run: str, data: str, epochs: int, rate: float) -> list[str]:
    """Forward pass, gradients and an Adam step over all rows of data, for each epoch k: {run}_l{k} has the loss, {run}_wh{k} and {run}_wo{k} the weights."""
    nothing = ", ".join(f"{run}_a{y}0 AS (SELECT i, j, 0e0 AS m, 0e0 AS v FROM {run}_w{y}0)" for y in "ho")
    steps = [f"""
{run}_wh0 AS MATERIALIZED {_drawn("h", 64, 8)}, {run}_wo0 AS MATERIALIZED {_drawn("o", 8, 3)}, {nothing}"""]
    for k in range(1, epochs + 1):
        h, o, p, d, dh = (f"{run}_{x}{k}" for x in ("h", "o", "p", "d", "dh"))
        wh, wo = f"{run}_wh{k - 1}", f"{run}_wo{k - 1}"
        steps.append(f"""
{h} AS MATERIALIZED {_product(data + "_x", wh, True, 64)}, {o} AS MATERIALIZED {_product(h, wo, False, 8)}, {p} AS MATERIALIZED {_softmax(o)},
{run}_l{k} AS (SELECT -avg(ln(p)) AS loss FROM {p} JOIN {data}_y USING (id) WHERE i = label),
{d} AS MATERIALIZED (SELECT id, i AS j, (p - CASE WHEN i = label THEN 1 ELSE 0 END) / (SELECT count(*) FROM {data}_y) AS d FROM {p} JOIN {data}_y USING (id)),
{dh} AS MATERIALIZED (
  SELECT a.id, a.i AS j, CASE WHEN a.x > 0 THEN sum(d.d * w.w) ELSE 0 END AS d FROM {h} a JOIN {wo} w ON w.i = a.i JOIN {d} d ON d.id = a.id AND d.j = w.j GROUP BY a.id, a.i, a.x),
{run}_go{k} AS (SELECT i, j, sum(x * d) AS g FROM {_one(h, 8)} a JOIN {d} USING (id) GROUP BY i, j),
{run}_gh{k} AS (SELECT i, j, sum(x * d) AS g FROM {_one(data + "_x", 64)} a JOIN {dh} USING (id) GROUP BY i, j)""")
        for y in "ho":
            step = f"{rate}e0 * (m / (1 - 0.9e0 ** {k})) / (sqrt(v / (1 - 0.999e0 ** {k})) + 1e-8)"
            steps.append(f"""
{run}_a{y}{k} AS MATERIALIZED (SELECT i, j, 0.9e0 * m + 0.1e0 * g AS m, 0.999e0 * v + 0.001e0 * g * g AS v FROM {run}_a{y}{k - 1} JOIN {run}_g{y}{k} USING (i, j)),
{run}_w{y}{k} AS MATERIALIZED (SELECT i, j, w - {step} AS w FROM {run}_a{y}{k} JOIN {run}_w{y}{k - 1} USING (i, j))""")
    return steps


def _measured(run: str, data: str, k: int) -> str:
    """{run}_e{k} (a, f): accuracy and macro F1 on data after epoch k; {run}_c{k}: each row's label and guess."""
    me = f"{run}_{data}{k}"
    return f"""
{me}_h AS MATERIALIZED {_product(data + "_x", f"{run}_wh{k}", True, 64)}, {me}_o AS MATERIALIZED {_product(me + "_h", f"{run}_wo{k}", False, 8)},
{run}_c{k} AS (SELECT label, arg_max(i, (x, -i)) AS guess FROM {me}_o JOIN {data}_y USING (id) GROUP BY id, label),
{me}_f AS (SELECT c, 2e0 * count(*) FILTER (label = c AND guess = c) / (count(*) FILTER (label = c) + count(*) FILTER (guess = c)) AS f1
           FROM {run}_c{k}, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c HAVING count(*) FILTER (label = c OR guess = c) > 0),
{run}_e{k} AS (SELECT {k} AS epoch, (SELECT avg(CASE WHEN label = guess THEN 1e0 ELSE 0 END) FROM {run}_c{k}) AS a, (SELECT avg(f1) FROM {me}_f) AS f)"""


def _validated(epochs: int, rate: float) -> str:
    """Common table expressions up to every (epoch, a, f) and best (epoch): training on train, measured on validation."""
    steps = [_rows("train", "split = 'train'"), _rows("validation", "split = 'validation'"), *_trained("t", "train", epochs, rate), *(_measured("t", "validation", k) for k in range(1, epochs + 1))]
    every = " UNION ALL ".join(f"SELECT *, (SELECT loss FROM t_l{k}) AS loss FROM t_e{k}" for k in range(1, epochs + 1))
    return f"WITH {EMB},{','.join(steps)},\nevery AS ({every}), best AS (SELECT min(epoch) AS epoch FROM every WHERE f = (SELECT max(f) FROM every))"


def _history(epochs: int, rate: float) -> str:
    return f"""{_validated(epochs, rate)}
SELECT epoch, round(loss, 6) AS train_loss, round(a, 6) AS validation_accuracy, round(f, 6) AS validation_macro_f1, epoch = (SELECT epoch FROM best) AS best FROM every"""


def _refitted(epochs: int, rate: float) -> str:
    """As many epochs on train and validation as were best on validation, then the test split."""
    steps = [_rows("both", "split <> 'test'"), _rows("test", "split = 'test'"), *_trained("r", "both", epochs, rate), *(_measured("r", "test", k) for k in range(1, epochs + 1))]
    every = " UNION ALL ".join(f"SELECT e.*, label, guess, count(*) AS n FROM r_e{k} e, r_c{k} GROUP BY ALL" for k in range(1, epochs + 1))
    return f"""{_validated(epochs, rate)},{",".join(steps)}, final AS ({every})
SELECT epoch AS epochs, round(a, 6) AS accuracy, round(f, 6) AS macro_f1, CAST(label AS INT) AS label, CAST(guess AS INT) AS prediction, n FROM final WHERE epoch = (SELECT epoch FROM best)"""


ORACLE_SQL["M8_refit_and_test"] = _refitted(4, 0.05)
ORACLE_SQL["M7_training_history"] = _history(4, 0.05)
ORACLE_SQL["M9_scores_of_saved_weights"] = f"""
WITH {EMB},
x AS MATERIALIZED (SELECT vec_id AS id, unnest(range(64)) AS i, unnest(e) AS x FROM emb), t AS MATERIALIZED (SELECT id, i - 48 AS i, x FROM x WHERE i >= 48),
wi AS MATERIALIZED {_drawn("i", 64, 8)}, wt AS MATERIALIZED {_drawn("t", 16, 8)}, wh AS MATERIALIZED {_drawn("h", 16, 8)}, wo AS MATERIALIZED {_drawn("o", 8, 3)},
a AS MATERIALIZED {_product("x", "wi", True, 64)}, b AS MATERIALIZED {_product("t", "wt", True, 16)}, ab AS (SELECT * FROM a UNION ALL SELECT id, i + 8, x FROM b),
h AS MATERIALIZED {_product("ab", "wh", True, 16)}, o AS MATERIALIZED {_product("h", "wo", False, 8)}, p AS {_softmax("o")}
SELECT id AS vec_id, ['MATCH', 'MISMATCH', 'PARTIAL_MATCH'][arg_max(i, (p, -i)) + 1] AS prediction, round(max(p), 6) AS model_score,
       round(max(p) FILTER (i = 0), 6) AS score_match, round(max(p) FILTER (i = 1), 6) AS score_mismatch, round(max(p) FILTER (i = 2), 6) AS score_partial_match
FROM p GROUP BY id"""

TEXTURE = """
tx AS MATERIALIZED (
  SELECT vec_id, k, y, x, h, w, CAST(floor(abs(CAST(embedding[(13 * y + 7 * x + 5 * k) % 64 + 1] AS DOUBLE)) * 1e6) AS BIGINT) % 256 AS v
  FROM (SELECT vec_id, embedding, 20 + vec_id % 7 AS h, 30 + vec_id % 5 AS w FROM embeddings), range(3) AS c(k), range(26) AS a(y), range(34) AS b(x) WHERE y < h AND x < w)"""


def _taps(name: str, sizes: str, target: int, curve: str, reach: int) -> str:
    """name (s, o, i, w): the whole-number weight of place i of s in place o of the target."""
    return f"""
{name} AS MATERIALIZED (
  SELECT s, o, i, CAST(trunc(w / sum(w) OVER (PARTITION BY s, o) * 4194304e0 + CASE WHEN w / sum(w) OVER (PARTITION BY s, o) < 0 THEN -0.5e0 ELSE 0.5e0 END) AS BIGINT) AS w
  FROM (SELECT s, o, i, {curve} AS w
        FROM (SELECT *, (i - c + 0.5e0) / f AS t FROM (SELECT s, o, (o + 0.5e0) * (s / {target}e0) AS c, greatest(s / {target}e0, 1e0) AS f FROM {sizes}, range({target}) AS t(o)), range(64) AS u(i)
              WHERE i < s AND i >= trunc(c - {reach} * f + 0.5e0) AND i < trunc(c + {reach} * f + 0.5e0))))"""


def _resized(name: str, source: str, across: str, down: str) -> str:
    """source (vec_id, k, y, x, h, w, v) as name (vec_id, k, y, x, v): rows first, then columns, whole numbers after each."""
    whole = "CAST(least(greatest(floor((2097152 + sum(v * t.w)) / 4194304e0), 0), 255) AS BIGINT) AS v"
    return f"""
{name}a AS MATERIALIZED (SELECT vec_id, k, y, t.o AS x, h, {whole} FROM {source} p JOIN {across} t ON t.s = p.w AND t.i = p.x GROUP BY vec_id, k, y, t.o, h),
{name} AS MATERIALIZED (SELECT vec_id, k, t.o AS y, x, {whole} FROM {name}a p JOIN {down} t ON t.s = p.h AND t.i = p.y GROUP BY vec_id, k, t.o, x)"""


_SIZES = "hs AS (SELECT DISTINCT h AS s FROM tx), ws AS (SELECT DISTINCT w AS s FROM tx)"
_SINC = "(CASE WHEN t = 0 THEN 1e0 WHEN abs(t) >= 3 AND t <> -3 THEN 0e0 ELSE sin(pi() * t) / (pi() * t) * (sin(pi() * t / 3) / (pi() * t / 3)) END)"

ORACLE_SQL["S6_F21_loaded_images"] = f"""
WITH {TEXTURE}, {_SIZES},{_taps("wt", "ws", 16, "greatest(1 - abs(t), 0)", 1)},{_taps("ht", "hs", 16, "greatest(1 - abs(t), 0)", 1)},{_resized("small", "tx", "wt", "ht")}
SELECT vec_id, count(*) AS size, round(sum(v / 255e0), 6) AS total, round(sum(v / 255e0 * (48 * y + 3 * x + k + 1)), 6) AS weighted FROM small GROUP BY vec_id"""

ORACLE_SQL["F11_F12_resized_hashes"] = f"""
WITH {TEXTURE}, {_SIZES},
grey AS MATERIALIZED (SELECT vec_id, 0 AS k, y, x, h, w, (sum(v * CASE k WHEN 0 THEN 19595 WHEN 1 THEN 38470 ELSE 7471 END) + 32768) // 65536 AS v FROM tx GROUP BY vec_id, y, x, h, w),
{_taps("wa", "ws", 32, _SINC, 3)},{_taps("ha", "hs", 32, _SINC, 3)},{_taps("wb", "ws", 9, _SINC, 3)},{_taps("hb", "hs", 8, _SINC, 3)},{_resized("big", "grey", "wa", "ha")},{_resized("low", "grey", "wb", "hb")},
cosine AS (SELECT u, i, sqrt((CASE WHEN u = 0 THEN 1 ELSE 2 END) / 32e0) * cos(pi() * (2 * i + 1) * u / 64) AS c FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(32)) AS i)),
half AS (SELECT vec_id, u, x, sum(c * v) AS t FROM big JOIN cosine ON i = y GROUP BY vec_id, u, x),
corner AS (SELECT vec_id, 8 * half.u + cosine.u AS place, sum(t * c) AS v FROM half JOIN cosine ON x = i GROUP BY vec_id, half.u, cosine.u),
mid AS (SELECT vec_id, median(v) AS m FROM corner WHERE place > 0 GROUP BY vec_id),
ph AS (SELECT vec_id, string_agg(CASE WHEN v > m THEN '1' ELSE '0' END, '' ORDER BY place) AS bits FROM corner JOIN mid USING (vec_id) GROUP BY vec_id),
dh AS (SELECT a.vec_id, string_agg(CASE WHEN b.v > a.v THEN '1' ELSE '0' END, '' ORDER BY a.y, a.x) AS bits FROM low a JOIN low b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = a.x + 1 GROUP BY a.vec_id),
every AS (SELECT vec_id, 32 * y + x + 1 AS place, v FROM big UNION ALL SELECT vec_id, 1024 + 9 * y + x + 1, v FROM low),
sums AS (SELECT vec_id, CAST(sum(v) AS DOUBLE) AS total, CAST(sum(v * place) AS DOUBLE) AS weighted FROM every GROUP BY vec_id)
SELECT vec_id, CAST(CAST(ph.bits AS BIT) AS BIGINT) AS phash, CAST(CAST(dh.bits AS BIT) AS BIGINT) AS dhash, total, weighted FROM ph JOIN dh USING (vec_id) JOIN sums USING (vec_id)"""


def _jitter(k: int) -> str:
    """The k-th change of each picture, by its order's k-th place."""
    return f"""
g{k} AS MATERIALIZED (SELECT vec_id, y, x, sum(v * CASE k WHEN 0 THEN 0.2989e0 WHEN 1 THEN 0.587e0 ELSE 0.114e0 END) AS g FROM p{k} GROUP BY vec_id, y, x),
m{k} AS (SELECT vec_id, avg(g) AS m FROM g{k} GROUP BY vec_id),
p{k + 1} AS MATERIALIZED (
  SELECT vec_id, k, y, x, least(greatest(CASE substr(o, {k + 1}, 1) WHEN 'b' THEN v * fb WHEN 'c' THEN m + fc * (v - m) ELSE g + fs * (v - g) END, 0), 1) AS v
  FROM p{k} JOIN g{k} USING (vec_id, y, x) JOIN m{k} USING (vec_id) JOIN d USING (vec_id))"""


ORACLE_SQL["F18_full_augmentation"] = f"""
WITH h AS (SELECT vec_id, embedding AS e, sha256('44|' || CAST(vec_id AS VARCHAR)) AS h FROM embeddings),
u AS (SELECT vec_id, e, h, [CAST('0x' || substr(h, 2 + 8 * i, 8) AS BIGINT) / 4294967296e0 FOR i IN range(5)] AS u FROM h),
d AS (SELECT vec_id, e, left(h, 1) < '8' AS mirror, radians(12 * u[1] - 6) AS t, 0.9e0 + 0.2e0 * u[2] AS fb, 0.9e0 + 0.2e0 * u[3] AS fc, 0.92e0 + 0.16e0 * u[4] AS fs,
             ['bcs', 'bsc', 'cbs', 'csb', 'sbc', 'scb'][CAST(floor(u[5] * 6) AS INT) + 1] AS o FROM u),
p AS MATERIALIZED (SELECT vec_id, k, y, CASE WHEN mirror THEN 7 - x ELSE x END AS x, least(abs(CAST(e[(8 * y + x + 21 * k) % 64 + 1] AS DOUBLE)), 1) AS v FROM d, range(3) AS a(k), range(8) AS b(y), range(8) AS c(x)),
-- Where each place comes from, and the four pixels around it.
s AS (SELECT vec_id, y, x, sin(t) * (x - 3.5e0) + cos(t) * (y - 3.5e0) + 3.5e0 AS sy, cos(t) * (x - 3.5e0) - sin(t) * (y - 3.5e0) + 3.5e0 AS sx FROM d, range(8) AS b(y), range(8) AS c(x)),
near AS (SELECT vec_id, y, x, floor(sy) + a AS ny, floor(sx) + b AS nx, (CASE a WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE b WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS f FROM s, range(2) AS i(a), range(2) AS j(b)),
p0 AS MATERIALIZED (SELECT n.vec_id, c.k, n.y, n.x, coalesce(sum(n.f * p.v), 0) AS v FROM near n CROSS JOIN range(3) AS c(k) LEFT JOIN p ON p.vec_id = n.vec_id AND p.k = c.k AND p.y = n.ny AND p.x = n.nx GROUP BY n.vec_id, c.k, n.y, n.x),
{_jitter(0)},{_jitter(1)},{_jitter(2)}
SELECT vec_id, round(sum(v), 6) AS total, round(sum(v * (24 * y + 3 * x + k + 1)), 6) AS weighted FROM p3 GROUP BY vec_id"""

# What a converged regression must give: each feature's sum by class, and derivatives of 0.
_LABELLED = """
ld AS (SELECT doc_id, split, quality AS class FROM ds JOIN labels USING (doc_id) JOIN documents USING (doc_id)),
lt AS (SELECT doc_id, class FROM ld WHERE split = 'train')"""
_LTERMS = f"""
tok AS (SELECT doc_id, split, {TOKENS} AS t FROM ds JOIN (SELECT doc_id FROM labels) USING (doc_id)),
term AS (SELECT doc_id, split, unnest(t) AS term FROM tok UNION ALL SELECT doc_id, split, t[i] || ' ' || t[i + 1] FROM (SELECT doc_id, split, t, unnest(range(1, len(t))) AS i FROM tok)),
tf AS (SELECT doc_id, split, term, count(*) AS tf FROM term GROUP BY ALL),
n AS (SELECT count(*) AS n FROM lt),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf WHERE split = 'train' GROUP BY term ORDER BY total DESC, term LIMIT 512),
fit AS (SELECT term, ln((1e0 + n) / (1e0 + df)) + 1e0 AS idf, row_number() OVER (ORDER BY term) - 1 AS index FROM vocab, n),
raw AS (SELECT doc_id, index, (1e0 + ln(tf)) * idf AS raw FROM tf JOIN fit USING (term) WHERE split = 'train'),
norm AS (SELECT doc_id, sqrt(sum(raw * raw)) AS z FROM raw GROUP BY doc_id),
tx AS (SELECT doc_id, index, raw / z AS x FROM raw JOIN norm USING (doc_id))"""
_LPIXELS = "px AS (SELECT doc_id, unnest(range(64)) AS index, unnest([CAST(v AS DOUBLE) FOR v IN embedding]) AS x FROM lt JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings))"


def _optimum(entries: str, size: str) -> str:
    return f"""
kinds AS (SELECT DISTINCT class FROM lt), every AS (SELECT class, index FROM kinds, (SELECT unnest(range(-1, {size})) AS index)),
entry AS (SELECT doc_id, index, x FROM ({entries}) UNION ALL SELECT doc_id, -1, 1e0 FROM lt),
observed AS (SELECT class, index, sum(x) AS x FROM entry JOIN lt USING (doc_id) GROUP BY ALL)
SELECT CAST(class AS INT) AS class, CAST(index AS INT) AS index, round(coalesce(x, 0), 6) AS observed, 0e0 AS gradient FROM every LEFT JOIN observed USING (class, index)"""


ORACLE_SQL["M2_text_optimum"] = f"WITH {DOCS},{_LABELLED},{_LTERMS},{_optimum('SELECT * FROM tx', '(SELECT count(*) FROM fit)')}"
ORACLE_SQL["M2_pixels_optimum"] = f"WITH {DOCS},{_LABELLED},{_LPIXELS},{_optimum('SELECT * FROM px', '64')}"
ORACLE_SQL["M2_F17_combined_optimum"] = f"WITH {DOCS},{_LABELLED},{_LTERMS},{_LPIXELS},{_optimum('SELECT * FROM px UNION ALL SELECT doc_id, index + 64, x FROM tx', '64 + (SELECT count(*) FROM fit)')}"


def _rows_digest(name: str, columns: list[str]) -> str:
    """A table's name, and the number of its rows and sums over parts of each row's SHA-256."""
    row = " || chr(31) || ".join(f"CAST({c} AS VARCHAR)" for c in sorted(columns))
    parts = " || '-' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT)) AS VARCHAR)" for k in range(8))
    return f"SELECT '{name}' AS input, CAST(count(*) AS VARCHAR) || '-' || {parts} AS digest, 44 AS seed, true AS same_version FROM (SELECT sha256({row}) AS h FROM {name})"


ORACLE_SQL["K9_lineage"] = " UNION ALL ".join(_rows_digest(n, c) for n, c in (("region", ["r_regionkey", "r_name"]), ("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("customer", ["c_custkey", "c_mktsegment", "c_nationkey"])))

FILES = """
f AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 0 THEN '.hidden/old_Set' WHEN s_suppkey % 10 = 0 THEN '__pycache__' ELSE 'nation/' || s_nationkey END AS folder,
             ['json', 'pt', 'txt', 'TMP'][s_suppkey % 4 + 1] AS kind, CASE WHEN s_suppkey % 11 = 0 THEN 'changed' ELSE s_name END AS content FROM supplier),
w AS (SELECT *, folder || '/' || k || '.' || kind AS path FROM f WHERE k % 13 <> 0)"""
ORACLE_SQL |= {
    "P20_forbidden_paths": f"""WITH {FILES}, kept AS (SELECT * FROM w WHERE folder <> '__pycache__')
      SELECT path, '*.' || kind AS rule FROM kept WHERE kind IN ('pt', 'TMP') UNION ALL SELECT path, 'OLD_set' FROM kept WHERE folder LIKE '.hidden%'
      UNION ALL SELECT DISTINCT folder, 'OLD_set' FROM kept WHERE folder LIKE '.hidden%'""",
    "P14_P20_tree": f"WITH {FILES} SELECT folder, count(*) AS files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes FROM w GROUP BY folder",
    "S9_P14_verified_files": f"""WITH {FILES} SELECT folder || '/' || k || '.' || kind AS path, CASE WHEN k % 13 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM f WHERE k % 13 = 0 OR k % 11 = 0""",
    "S5_archive_source": "SELECT 'data/' || doc_id || '.JPG' AS path, true AS safe, true AS crc_ok, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "M6_S10_feature_store": f"""
WITH {TEXTURE}, {_SIZES},{_taps("wt", "ws", 16, "greatest(1 - abs(t), 0)", 1)},{_taps("ht", "hs", 16, "greatest(1 - abs(t), 0)", 1)},{_resized("small", "tx", "wt", "ht")},
weight AS (SELECT i, j, (CAST('0x' || left(sha256('44|filter|' || i || '|' || j), 8) AS BIGINT) / 2147483648e0 - 1) / sqrt(27e0) AS w FROM range(27) AS a(i), range(4) AS b(j)),
place AS (SELECT vec_id, py, px, j, sum(v / 255e0 * w) AS z FROM small JOIN range(7) AS a(py) ON y - 2 * py BETWEEN 0 AND 2 JOIN range(7) AS b(px) ON x - 2 * px BETWEEN 0 AND 2
          JOIN weight ON i = 9 * k + 3 * (y - 2 * py) + x - 2 * px GROUP BY vec_id, py, px, j)
SELECT vec_id, CAST(j AS INT) AS filter, round(avg(greatest(z, 0)), 6) AS feature FROM place GROUP BY vec_id, j""",
    "K4_published_tables": f"WITH {REL} SELECT 'images' AS table, count(*) AS rows, true AS intact FROM img UNION ALL SELECT 'relations', count(*), true FROM rel",
    "M12_bar_chart": f"""WITH {P}, b AS ({block('p', 'category', 'group_id', STATES)}), s AS (SELECT category, macro_f1 AS last, unnest([0, 1]) AS k, unnest(['accuracy', 'macro_f1']) AS series, unnest([accuracy, macro_f1]) AS value FROM b)
      SELECT CAST(row_number() OVER (ORDER BY last, category, k) - 1 AS INT) AS place, category, series, value FROM s""",
    "M12_line_chart": f"WITH {HISTORY} SELECT CAST(row_number() OVER (ORDER BY model, epoch) - 1 AS INT) AS place, model, epoch, macro_f1 FROM h",
    "M12_heat_map": f"""WITH {P}, c AS (SELECT unnest(range(9)) AS place, unnest(['F', 'F', 'F', 'O', 'O', 'O', 'P', 'P', 'P']) AS label, unnest(['F', 'O', 'P', 'F', 'O', 'P', 'F', 'O', 'P']) AS prediction)
      SELECT CAST(place AS INT) AS place, label, prediction, CAST((SELECT count(*) FROM p WHERE p.label = c.label AND p.prediction = c.prediction) AS DOUBLE) AS n FROM c""",
    "M12_histogram": """WITH m AS (SELECT min(CAST(o_totalprice AS DOUBLE)) AS low, max(CAST(o_totalprice AS DOUBLE)) AS high FROM orders),
      b AS (SELECT CAST(least(floor((CAST(o_totalprice AS DOUBLE) - low) / ((high - low) / 20)), 19) AS INT) AS bin FROM orders, m)
      SELECT bin AS place, bin, (SELECT count(*) FROM b WHERE b.bin = r.bin) AS rows FROM (SELECT CAST(unnest(range(20)) AS INT) AS bin) r""",
}

ORACLE_SQL["M10_predicted_records"] = f"""
WITH part_text AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '0000 zzzz' ELSE p_name END AS text FROM part),
tok AS (SELECT id, {TOKENS} AS t FROM part_text),
term AS (SELECT id, unnest(t) AS term FROM tok UNION ALL SELECT id, t[i] || ' ' || t[i + 1] FROM (SELECT id, t, unnest(range(1, len(t))) AS i FROM tok)),
vocab AS (SELECT term FROM term WHERE id % 5 <> 0 GROUP BY term ORDER BY count(*) DESC, term LIMIT 16),
known AS (SELECT id, count(DISTINCT vocab.term) AS recognised FROM part_text LEFT JOIN term USING (id) LEFT JOIN vocab USING (term) GROUP BY id),
x AS MATERIALIZED (SELECT vec_id AS id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
wh AS MATERIALIZED {_drawn("h", 64, 8)}, wo AS MATERIALIZED {_drawn("o", 8, 3)},
h AS MATERIALIZED {_product("x", "wh", True, 64)}, o AS MATERIALIZED {_product("h", "wo", False, 8)}, p AS {_softmax("o")},
s AS (SELECT known.id, ['MATCH', 'MISMATCH', 'PARTIAL_MATCH'][i + 1] AS label, p, recognised FROM known JOIN p ON p.id = known.id % (SELECT count(*) FROM embeddings))
SELECT 'p/' || id || '.png' AS path, CAST(row_number() OVER (PARTITION BY id ORDER BY p DESC, label) - 1 AS INT) AS place, label, round(p, 6) AS score, recognised,
       CASE WHEN recognised = 0 THEN 'no term of the description is known; the picture alone decides' END AS warning
FROM s"""

# The networks with encoders.  Their weights are stored by output: an output's row of weights, drawn from the SHA-256 of its name and place.


def _drawn_by_output(layer: str, inputs: int, outputs: int) -> str:
    """A layer's first weights (i, j, w) from input i to output j; the bias is the row after the last input."""
    name = f"CASE WHEN i < {inputs} THEN '44|{layer}|' || j || '|' || i ELSE '44|{layer}_bias|' || j || '|0' END"
    draw = f"CAST('0x' || left(sha256({name}), 8) AS BIGINT) / 2147483648e0 - 1"
    return f"(SELECT i, j, ({draw}) / sqrt({inputs}e0) AS w FROM (SELECT unnest(range({inputs + 1})) AS i), (SELECT unnest(range({outputs})) AS j))"


def _chain(name: str, rows: str, part: str, widths: tuple[int, ...], open_end: bool = False) -> str:
    """Dense layers of one part over rows (id, i, x): {name}."""
    out, now = [], rows
    for k, (a, b) in enumerate(zip(widths, widths[1:])):
        last = k == len(widths) - 2
        to = name if last else f"{name}{k}"
        out.append(f"{name}_w{k} AS MATERIALIZED {_drawn_by_output(f'{part}{k}', a, b)}, {to} AS MATERIALIZED {_product(now, f'{name}_w{k}', not (last and open_end), a)}")
        now = to
    return ",\n".join(out)


def _convolved(name: str, pixels: str, k: int, inputs: int, outputs: int, side: int) -> str:
    """Filters of 3 x 3 over pixels (id, c, y, x, v) of side x side, rectified: {name} (id, c, y, x, v)."""
    return f"""
{name}_w AS MATERIALIZED {_drawn_by_output(f"convolution{k}", 9 * inputs, outputs)},
{name}_p AS MATERIALIZED (SELECT id, y - dy + 1 AS y, x - dx + 1 AS x, 9 * c + 3 * dy + dx AS i, v FROM {pixels}, range(3) AS a(dy), range(3) AS b(dx)
  WHERE y - dy + 1 BETWEEN 0 AND {side - 1} AND x - dx + 1 BETWEEN 0 AND {side - 1}
  UNION ALL SELECT id, y, x, {9 * inputs}, 1e0 FROM (SELECT DISTINCT id, y, x FROM {pixels})),
{name} AS MATERIALIZED (SELECT id, j AS c, y, x, greatest(sum(v * w), 0) AS v FROM {name}_p JOIN {name}_w USING (i) GROUP BY id, j, y, x)"""


def _scores(steps: list[str]) -> str:
    return f"""
WITH e AS (SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), t AS MATERIALIZED (SELECT id, unnest(range(64)) AS i, unnest(e) AS x FROM e),
{",".join(steps)}, p AS {_softmax("o")}
SELECT id AS vec_id, ['MATCH', 'MISMATCH', 'PARTIAL_MATCH'][arg_max(i, (p, -i)) + 1] AS prediction, round(max(p), 6) AS model_score,
       round(max(p) FILTER (i = 0), 6) AS score_match, round(max(p) FILTER (i = 1), 6) AS score_mismatch, round(max(p) FILTER (i = 2), 6) AS score_partial_match
FROM p GROUP BY id"""


_POOL = "{to} AS (SELECT id, c, y // 2 AS y, x // 2 AS x, max(v) AS v FROM {rows} GROUP BY id, c, y // 2, x // 2)"
ORACLE_SQL["M3_small_network_scores"] = _scores([
    "px AS MATERIALIZED (SELECT id, c, y, x, e[(64 * c + 8 * y + x) % 64 + 1] AS v FROM e, range(3) AS a(c), range(8) AS b(y), range(8) AS d(x))",
    _convolved("c0", "px", 0, 3, 16, 8), _POOL.format(to="q0", rows="c0"), _convolved("c1", "q0", 1, 16, 32, 4), _POOL.format(to="q1", rows="c1"), _convolved("c2", "q1", 2, 32, 48, 2),
    "f AS MATERIALIZED (SELECT id, c AS i, avg(v) AS x FROM c2 GROUP BY id, c)", _chain("a", "f", "projection", (48, 48)), _chain("b", "t", "text", (64, 64, 32)),
    "ab AS (SELECT * FROM a UNION ALL SELECT id, i + 48, x FROM b)", _chain("o", "ab", "head", (80, 96, 48, 3), True),
])
ORACLE_SQL["M5_large_network_scores"] = _scores([
    "f AS MATERIALIZED (SELECT id, i, e[i % 64 + 1] AS x FROM e, range(512) AS r(i))", _chain("a", "f", "projection", (512, 128)), _chain("b", "t", "text", (64, 256, 128)),
    "ab AS (SELECT * FROM a UNION ALL SELECT id, i + 128, x FROM b)", _chain("o", "ab", "head", (256, 256, 96, 3), True),
])
_SMALL_IMAGE = "3 * 16 * 9 + 16 + 16 * 32 * 9 + 32 + 32 * 48 * 9 + 48 + 48 * 48 + 48"
_SMALL_BOTH = f"{_SMALL_IMAGE} + t * 64 + 64 + 64 * 32 + 32 + 80 * 96 + 96 + 96 * 48 + 48 + 48 * 3 + 3"
_LARGE_BOTH = "512 * 128 + 128 + t * 256 + 256 + 256 * 128 + 128 + 256 * 256 + 256 + 256 * 96 + 96 + 96 * 3 + 3"
ORACLE_SQL["M3_M5_parameters"] = f"""
WITH {DOCS}, tok AS (SELECT {TOKENS} AS t FROM ds WHERE split = 'train'),
n AS (SELECT least(342, (SELECT count(DISTINCT w) FROM (SELECT unnest(t) AS w FROM tok UNION ALL SELECT t[i] || ' ' || t[i + 1] FROM (SELECT t, unnest(range(1, len(t))) AS i FROM tok)))) AS t,
             (SELECT count(*) FROM nation) AS c)
SELECT unnest(['small_text', 'small_image', 'small_multimodal', 'small_multimodal_no_auxiliary', 'large_multimodal', 'large_multimodal_no_auxiliary']) AS network,
       unnest([t * 64 + 64 + 64 * 32 + 32 + 32 * 3 + 3, {_SMALL_IMAGE} + 48 * 3 + 3, {_SMALL_BOTH} + 48 * c + c + 32 * c + c, {_SMALL_BOTH}, {_LARGE_BOTH} + 2 * (128 * c + c), {_LARGE_BOTH}]) AS parameters,
       unnest([6, 10, 22, 18, 16, 12]) AS arrays
FROM n"""
