"""Queries on words inside texts: collocations and periodic runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.collocations import collocations
from plumbline.llm.periodic import periodic_runs
from plumbline.llm.registry import query, table


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of ids whose crc32 is divisible by ten repeat a stretch of their words up to their end."""
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    cut = hashed.select("doc_id", "text", F.expr("h div 10").alias("g"), F.explode(F.array(words)).alias("words")).withColumn("n", F.size("words").cast("long"))
    placed = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    longer = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", none, lambda best, r: F.when(best.isNull() | longer(r, best), r).otherwise(best))
    written = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(written, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM words, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k
), f AS MATERIALIZED (
  SELECT lang, phrase, count(*) AS n, any_value(k) AS k FROM grams GROUP BY lang, phrase
), totals AS (
  SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k > 1 AND n >= 10
), cuts AS MATERIALIZED (
  SELECT lang, phrase, a, size, 1 AS cut, w[1] AS first_part, array_to_string(w[2 :], ' ') AS rest FROM candidates
  UNION ALL SELECT lang, phrase, a, size, 2, array_to_string(w[1 : 2], ' '), w[3] FROM candidates WHERE size = 3
), lefts AS MATERIALIZED (
  SELECT c.*, x.n AS l FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first_part
), parts AS (
  SELECT c.*, y.n AS r FROM lefts c JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), scored AS (
  SELECT lang, phrase, a, size, cut AS k, l, r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM parts
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase, size ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a FROM candidates WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM candidates WHERE size = 3)
  GROUP BY ALL
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN longer g ON s.size = 2 AND g.lang = s.lang AND g.phrase = s.phrase WHERE NOT coalesce(100 * g.a >= 50 * s.a, false)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, k, CAST(n AS BIGINT) AS n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
