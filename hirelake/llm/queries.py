"""Queries of the corpus operators over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.llm import decontaminate, merkle, minhash, mixing, pii, quality, ranking, repeats, secrets, sharding, simhash, tokens, urls
from hirelake.llm.common import read

SHARDS = 40
VOCABULARY = "file:///opt/tokenizers/byte_bpe_50k.tiktoken"
URL_RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
)


def op1_shards(spark, sf_dir):
    return sharding.assign_shards(read(spark, sf_dir, "documents"), SHARDS)


def op2_repeats(spark, sf_dir):
    found = repeats.repeated_bytes(read(spark, sf_dir, "documents"), words=repeats.PASSAGE)
    return found.withColumn("repeated", F.col("n_removed") > 0)


def op3_secrets(spark, sf_dir):
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op4_urls(spark, sf_dir):
    return urls.filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op5_mix(spark, sf_dir):
    rates = mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    chances = (F.round(F.get("p", F.lit(d)), 6).alias(f"p_{name}") for d, name in enumerate(mixing.DOMAINS))
    return rates.select("doc_id", "tokens", *chances, F.round("rate", 6).alias("rate"))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_tokens(spark, sf_dir, vocabulary=VOCABULARY):
    return tokens.token_counts(read(spark, sf_dir, "documents"), vocabulary)


def op9_quality(spark, sf_dir):
    return quality.quality(read(spark, sf_dir, "documents"))


def op10_personal(spark, sf_dir):
    return pii.find_personal(read(spark, sf_dir, "documents"))


def op11_merkle(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.audit(read(spark, sf_dir, "documents"), tampered)


def op12_minhash(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op13_ranked(spark, sf_dir):
    return ranking.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_shards": op1_shards,
    "op2_repeats": op2_repeats,
    "op3_secrets": op3_secrets,
    "op4_urls": op4_urls,
    "op5_mix": op5_mix,
    "op6_simhash": op6_simhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_tokens": op8_tokens,
    "op9_quality": op9_quality,
    "op10_personal": op10_personal,
    "op11_merkle": op11_merkle,
    "op12_minhash": op12_minhash,
    "op13_ranked": op13_ranked,
}

URLS_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(host, path, rule, verdict) AS (
  VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
         ('www.example.com', '/en/', 'www.example.com/en/', 'allow'),
         ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')
)
SELECT p.page_id, p.host, p.path,
       (SELECT max_by(r.rule, length(r.rule)) FROM rules r
        WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
       coalesce((SELECT max_by(r.verdict, length(r.rule)) FROM rules r
        WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)), 'allow') AS verdict
FROM parts p
"""

CONTAMINATION_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, w, least(len(w), 13) AS n
  FROM (SELECT item_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), sizes AS (SELECT DISTINCT n FROM items), grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs CROSS JOIN sizes)
), hits AS (
  SELECT g.r, g.n, g.i, x.item_id FROM grams g JOIN windows x ON g.n = x.n AND g.gram = x.gram
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

QUALITY_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM docs)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r
), lines AS (
  SELECT r, host, t, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         trim(regexp_replace(lower(l), '[\x20\x09-\x0D0-9]+', ' ', 'g')) AS line
  FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), often AS (
  SELECT host, line FROM lines GROUP BY host, line HAVING count(DISTINCT t) > 10
), lost AS (SELECT r, sum(n) AS gone FROM lines SEMI JOIN often USING (host, line) GROUP BY r),
same AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
base AS (
  SELECT docs.r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(same.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(gone, 0) AS BIGINT) AS n_frequent_words
  FROM docs LEFT JOIN same USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r)
)
SELECT * EXCLUDE (r), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND NOT (n_frequent_words > 0 AND (n_words - n_frequent_words < 20
                OR 100 * (n_words - n_frequent_words) < 30 * n_words)) AS kept
FROM base
"""

MERKLE_SQL = """
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS r, doc_id, lang, CAST(n_chars AS BIGINT) AS n, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
         || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
             lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents
), leaves AS (
  SELECT r, doc_id, coalesce('=' || lang, '') AS g,
         sha256(head || coalesce(strlen(CAST(n AS VARCHAR)) || ':' || CAST(n AS VARCHAR), '-') || tail) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 7 = 0
              THEN sha256(head || coalesce(strlen(CAST(n + 1 AS VARCHAR)) || ':' || CAST(n + 1 AS VARCHAR), '-') || tail) END AS changed
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), levels(g, level, h) AS (
  SELECT g, 0, list(leaf ORDER BY place) FROM placed GROUP BY g
  UNION ALL
  SELECT g, level + 1, list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], '')))
  FROM levels WHERE len(h) > 1
), subroots AS (
  SELECT g, h[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM levels WHERE len(h) = 1
), tops(level, h) AS (
  SELECT 0, list(subroot ORDER BY place) FROM subroots HAVING count(*) > 0
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], '')))
  FROM tops WHERE len(h) > 1
), steps AS (
  SELECT p.r, l.level, (p.place >> l.level) & 1 AS side, l.h[xor(p.place >> l.level, 1) + 1] AS sibling
  FROM placed p JOIN levels l ON p.g = l.g WHERE len(l.h) > 1
  UNION ALL
  SELECT p.r, 1000 + t.level, (s.place >> t.level) & 1, t.h[xor(s.place >> t.level, 1) + 1]
  FROM placed p JOIN subroots s ON p.g = s.g CROSS JOIN tops t WHERE len(t.h) > 1
), paths AS (
  SELECT r, list({'side': side, 's': coalesce(sibling, '')} ORDER BY level) AS path,
         string_agg(coalesce(sibling, ''), '' ORDER BY level) AS siblings FROM steps GROUP BY r
), folds(r, path, node) AS (
  SELECT p.r, coalesce(t.path, []), coalesce(p.changed, p.leaf) FROM placed p LEFT JOIN paths t ON p.r = t.r
  UNION ALL
  SELECT r, path[2:], CASE WHEN path[1].side = 1 THEN sha256(path[1].s || node) ELSE sha256(node || path[1].s) END
  FROM folds WHERE len(path) > 0
), root AS (SELECT h[1] AS root FROM tops WHERE len(h) = 1)
SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(coalesce(t.siblings, '')) AS proof_sha256,
       f.node AS folded_root, f.node = root.root AS verified
FROM placed p JOIN subroots s ON p.g = s.g CROSS JOIN root LEFT JOIN paths t ON p.r = t.r
JOIN folds f ON f.r = p.r AND len(f.path) = 0
"""

RANKED_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT row_number() OVER () AS i, item_id,
         list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM benchmark
), totals AS (
  SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM docs WHERE len(w) > 0
), postings AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM docs) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM postings, totals GROUP BY term, docs
), scores AS (
  SELECT q.i, q.item_id, p.r, p.doc_id,
         CAST(sum(x.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.n * docs) // total)))) AS BIGINT) AS score
  FROM (SELECT i, item_id, unnest(w) AS term FROM items) q JOIN postings p USING (term) JOIN weights x USING (term), totals
  GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
"""

ORACLES = {"op13_ranked": RANKED_SQL, "op11_merkle": MERKLE_SQL, "op4_urls": URLS_SQL, "op7_decontaminate": CONTAMINATION_SQL, "op9_quality": QUALITY_SQL}
