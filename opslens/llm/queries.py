"""One query per operator over the whole documents table, and their SQL twins."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from opslens.llm import (
    lexical_search,
    line_dedup,
    minhash,
    mixing,
    packing,
    phrases,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    token_files,
    toxicity,
    url_filters,
)
from opslens.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QUERIES = {
    "op1_minhash": lambda spark, d: minhash.digest(table(spark, d, "documents")),
    "op2_mixing": lambda spark, d: mixing.digest(table(spark, d, "documents")),
    "op3_simhash": lambda spark, d: simhash.digest(table(spark, d, "documents")),
    "op4_line_dedup": lambda spark, d: line_dedup.digest(table(spark, d, "documents")),
    "op5_packing": lambda spark, d: packing.digest(table(spark, d, "documents"), VOCABULARY),
    "op6_token_files": lambda spark, d: token_files.digest(table(spark, d, "documents"), VOCABULARY),
    "op7_toxicity": lambda spark, d: toxicity.digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_quality_model": lambda spark, d: quality_model.digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op9_sharding": lambda spark, d: sharding.digest(table(spark, d, "documents")),
    "op10_quality_rules": lambda spark, d: quality_rules.digest(table(spark, d, "documents")),
    "op11_phrases": lambda spark, d: phrases.collocations(table(spark, d, "documents")),
    "op12_url_filters": lambda spark, d: url_filters.digest(table(spark, d, "pages")),
    "op13_lexical_search": lambda spark, d: lexical_search.search(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op2_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, sum(size) AS source_size, 2.0 * sum(size) AS cap FROM d GROUP BY source),
w AS (SELECT *, CAST([3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM s),
b AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, source) AS i FROM w),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(CAST(cap AS DOUBLE)) OVER before, 0))
                / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
      FROM b WINDOW before AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * (SELECT arg_min(level, i) FROM l WHERE level * w < cap)) AS target FROM l),
e AS (SELECT *, floor(target) AS budget, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs FROM t),
c AS (SELECT d.*, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM c""",
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, s AS line, lower_ascii, pos FROM (
    SELECT doc_id, pos, lines[pos] AS s,
           translate(trim(lines[pos], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))),
k AS (SELECT lower_ascii, min(doc_id) AS owner FROM l WHERE length(lower_ascii) >= 10
      GROUP BY lower_ascii HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, (k.owner IS NOT NULL AND k.owner <> l.doc_id) AS gone FROM l LEFT JOIN k USING (lower_ascii))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op10_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             len(regexp_extract_all(text, '!!')) AS n_shouts,
             len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
             len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_different
      FROM d),
g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS word_at FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
n AS (SELECT doc_id, count(DISTINCT word_at) AS n FROM r GROUP BY doc_id),
f AS (SELECT c.*, coalesce(n.n, 0) AS n_repeat_words, n_lines - n_different AS n_dup_lines FROM c LEFT JOIN n USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 5 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_shouts > n_words) AS kept
FROM f""",
    "op11_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING n >= 30),
t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k > 1),
x AS (SELECT lang, phrase, k, w, a, unnest(range(1, k)) AS j FROM c),
s AS (SELECT x.lang, x.phrase, x.a, x.j, f.n AS l, r.n AS r, CAST(2000000::HUGEINT * x.a // (f.n + r.n) AS BIGINT) AS score
      FROM x JOIN f ON f.lang = x.lang AND f.phrase = array_to_string(w[1:j], ' ')
             JOIN f AS r ON r.lang = x.lang AND r.phrase = array_to_string(w[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS b FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, t.n AS n, score
FROM b JOIN t USING (lang) LEFT JOIN i USING (lang, phrase)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a QUALIFY rank <= 2000""",
    "op12_url_filters": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM u),
p AS (SELECT row_number() OVER () AS i, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT i, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
             arg_max(verdict, length(rule_host || rule_path)) AS verdict
      FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (i)""",
    "op13_lexical_search": r"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT d, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
l AS (SELECT d, sum(tf) AS n FROM f GROUP BY d),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM l),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM f, s GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT d, 50 + (50 * CAST(n AS BIGINT) * docs) // words AS m FROM l, s),
c AS (SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (d) GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM c QUALIFY rank <= 50""",
}
