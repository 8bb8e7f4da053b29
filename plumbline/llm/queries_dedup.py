"""Dedup and decontamination queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm.decontaminate import contamination
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.radix_dedup import exact_duplicates
from plumbline.llm.registry import query, table
from plumbline.llm.repeats import remove_repeats

OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), windows AS (
  SELECT doc_id, pos, line AS l0, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, rank() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, pos) AS r FROM windows WHERE l1 IS NOT NULL AND l2 IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (VALUES (0), (1), (2)) AS v(k) WHERE r > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, k.text AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query("op1_line_dedup", OP1_SQL)
def op1(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), low AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN low l ON l.doc_id = d.doc_id
"""


@query("op9_minhash_near_dedup", OP9_SQL)
def op9(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2).drop("class_id")


OP3_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), widths AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM item_words WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS s FROM widths
), doc_windows AS (
  SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS pos, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS s
  FROM doc_words, (SELECT DISTINCT k FROM widths) WHERE len(w) >= k
), hits AS (
  SELECT d.doc_id, d.pos, d.k, i.item_id FROM doc_windows d JOIN item_windows i ON i.k = d.k AND i.s = d.s
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + k)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


@query("op3_benchmark_decontamination", OP3_SQL)
def op3(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    named = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP6_SQL = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS pos, unnest(list_transform(range(0, len(h) // 2 - 49), lambda i: md5_number(substr(h, 2 * i + 1, 100)))) AS s
  FROM bytes WHERE len(h) >= 100
), later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY s) AS first_id FROM windows) WHERE first_id < doc_id
), runs AS (
  SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM (
    SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
      SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS fresh FROM later))
  GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next_a FROM runs
), kept AS (
  SELECT g.doc_id, count(*) AS n_spans, sum(g.b - g.a) AS n_removed,
         substr(any_value(d.h), 1, 2 * min(g.a)) || string_agg(substr(d.h, 2 * g.b + 1, 2 * (coalesce(g.next_a, len(d.h) // 2) - g.b)), '' ORDER BY g.a) AS rest
  FROM gaps g JOIN bytes d USING (doc_id) GROUP BY g.doc_id
)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.rest, d.h))) AS kept_sha256
FROM bytes d LEFT JOIN kept k USING (doc_id)
"""


@query("op6_suffix_array_dedup", OP6_SQL)
def op6(spark, sf_dir):
    left = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""


@query("op13_exact_dedup", OP13_SQL)
def op13(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))
