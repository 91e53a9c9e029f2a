"""The queries over the corpus operators and, where SQL can say it, their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from demandgrid.llm import exact_dedup, language_id, line_dedup, mixing, packing, phrases, pii, prefix_trie, quality_classifier, quality_rules, rare_features, simhash, substring_dedup
from demandgrid.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op3_quality_rules", r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
cover AS (SELECT doc_id, CAST(sum(least(5, i - before)) AS BIGINT) AS n FROM (SELECT doc_id, i, lag(i, 1, -5) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY doc_id),
c AS (SELECT doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cover USING (doc_id)),
f AS (SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2, 10 * n_symbols > 3 * greatest(n_words, 1) AS f3, 10 * n_dup_lines > 3 * n_lines AS f4,
  word_chars < 2 * greatest(n_words, 1) OR word_chars > 15 * greatest(n_words, 1) AS f5 FROM c),
h AS (SELECT source, count(*) AS n, unnest([1, 2, 3, 4, 5]) AS rule, unnest([count_if(f1), count_if(f2), count_if(f3), count_if(f4), count_if(f5)]) AS k FROM f GROUP BY source),
p AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM h GROUP BY rule),
s AS (SELECT source, max((k + m * a) / (n + a)) AS worst FROM (SELECT h.*, m, least(1000.0, greatest(1.0, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000.0 END)) AS a FROM h JOIN p USING (rule)) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND worst <= 0.5 AS kept
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source""")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


@query("op4_exact_dedup", """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups_of_copies(table(spark, sf_dir, "documents"))


@query("op5_mixing", r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w,
  row_number() OVER (ORDER BY source NULLS LAST) AS src_no FROM d GROUP BY source),
fill(k, level, capped) AS (
  SELECT 0, (SELECT 1.5::DOUBLE * sum(source_size) / sum(w) FROM s), []::BIGINT[]
  UNION ALL
  SELECT k + 1, (SELECT ((SELECT 1.5::DOUBLE * sum(source_size) FROM s) - coalesce(sum(2 * source_size) FILTER (2 * source_size < level * w), 0)) / sum(w) FILTER (2 * source_size >= level * w) FROM s),
    (SELECT coalesce(list(src_no ORDER BY src_no) FILTER (2 * source_size < level * w), []) FROM s)
  FROM fill WHERE k = 0 OR (SELECT coalesce(list(src_no ORDER BY src_no) FILTER (2 * source_size < level * w), []) FROM s) <> capped),
t AS (SELECT source, src_no, source_size, least(2.0::DOUBLE * source_size, level * w) AS target FROM s, (SELECT level FROM fill ORDER BY k DESC LIMIT 1)),
q AS (SELECT d.doc_id, d.size, t.*, sum(d.size) OVER (PARTITION BY src_no ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS ends FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, floor(target) - (ends - size))) + greatest(0, least(size, floor(target) - source_size - (ends - size))) AS BIGINT) AS taken FROM q""")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.strip_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op8_line_dedup", r"""
WITH l AS (SELECT doc_id, i - 1 AS line, regexp_extract_all(x[i], '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT doc_id, line, list_sort(list_distinct(w)) AS s FROM l WHERE len(w) > 0),
s AS (SELECT row_number() OVER (ORDER BY f) AS id, s, len(s) AS n, f FROM (SELECT s, min((doc_id, line)) AS f FROM k GROUP BY s)),
t AS (SELECT id, n, unnest(s) AS w FROM s),
p AS (SELECT b.id, a.n AS n1, b.n AS n2, count(*) AS c FROM t b JOIN t a ON a.w = b.w AND a.id < b.id AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n),
g AS (SELECT DISTINCT id FROM p WHERE 10 * c >= 8 * (n1 + n2 - c)),
r AS (SELECT k.doc_id, count(*) AS n, string_agg(CAST(k.line AS VARCHAR), ',' ORDER BY k.line) AS removed FROM k JOIN s USING (s) LEFT JOIN g USING (id) WHERE g.id IS NOT NULL OR (k.doc_id, k.line) <> s.f GROUP BY k.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(r.n, 0) AS n_removed, coalesce(r.removed, '') AS removed FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query("op13_phrases", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k >= 2 AND a >= 10),
cuts AS (SELECT c.lang, phrase, k, a, i, array_to_string(w[:i], ' ') AS head, array_to_string(w[i + 1:], ' ') AS tail FROM c, (SELECT unnest([1, 2]) AS i) WHERE i < k),
s AS (SELECT cuts.*, x.a AS l, y.a AS r, CAST((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
o AS (SELECT b.lang, b.phrase, max(c.a) AS longer FROM b JOIN c ON c.lang = b.lang AND c.k = 3 AND b.k = 2 AND b.phrase IN (array_to_string(c.w[:2], ' '), array_to_string(c.w[2:], ' ')) GROUP BY ALL),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000""")
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(table(spark, sf_dir, "documents"))


@query("op12_fingerprints")
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare_features.fingerprints(table(spark, sf_dir, "documents"))


@query("op11_prefix_trie", """
WITH t8 AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) x(i))),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT c, count(*) AS n FROM o GROUP BY c),
k AS (SELECT c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 9 AS h FROM z, t8),
b AS (SELECT k.c, k.h, least(k.h, coalesce(z.n, 0)) AS pre FROM k LEFT JOIN z ON z.c = k.c - k.c % 5),
r AS (SELECT c, 0 AS d, '' AS role, '' AS text FROM b
  UNION ALL SELECT k.c, o.i, o.role, o.text FROM k JOIN o ON o.c = k.c - k.c % 5 AND o.i <= k.h
  UNION ALL SELECT b.c, b.pre + o.i - b.h, o.role, o.text FROM b JOIN o ON o.c = b.c AND o.i > b.h),
q AS (SELECT c, d, octet_length(encode(text)) AS size, list(sha256(role || chr(10) || text)) OVER (PARTITION BY c ORDER BY d) AS path FROM r),
s AS (SELECT c, d, size, sha256(array_to_string(path, ',')) AS node, lag(sha256(array_to_string(path, ','))) OVER (PARTITION BY c ORDER BY d) AS parent, lead(d) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM q),
n AS (SELECT node, d, any_value(parent) AS parent, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS ended FROM s GROUP BY node, d),
f AS (SELECT parent AS node, count(*) AS n_children FROM n GROUP BY parent),
g AS (SELECT s.node, sum((n.n_convs - 1) * n.size) AS saved_tokens, count_if(f.node IS NULL) AS n_leaves FROM n JOIN s ON s.c = n.conv_id AND s.d <= n.d LEFT JOIN f ON f.node = n.node GROUP BY s.node)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, CAST(g.n_leaves AS BIGINT) AS n_leaves, CAST(g.saved_tokens AS BIGINT) AS saved_tokens,
  sha256(coalesce(n.ended, '')) AS ends_sha256
FROM n LEFT JOIN n p ON p.node = n.parent LEFT JOIN f ON f.node = n.node JOIN g ON g.node = n.node""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
