"""A stored inverted index for hybrid search (SR-03, SR-05): built once, read by token, extended by deltas.

Counts per document and token are kept as they come in, a document's together.  A commit derives from all of them what
depends on the whole corpus: document frequencies, the norms of the documents (terms, top weight, magnitude) where the counts
lie, and postings in buckets of their token, which hold counts, so that each is shuffled once.  A query reads the buckets of
its own tokens, the norms and the filtered documents, and tokenises nothing.  Frequencies come from the whole corpus,
whatever a query filters.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.operators.relational import contains_ci
from plumbline.operators.search import METADATA_POINTS, metadata_filter, query_snippet, token_counts, token_frequencies, with_idf
from plumbline.sources.snapshots import Snapshots


class SearchIndex:
    """Index of documents(id, title, text, metadata columns) under a shared folder.

    Postings are dealt over ``spread`` partitions, or as many as hold ``per_file`` of them each.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, spread: int = 8, per_file: int = 2_000_000):
        self.spark, self.tables, self.buckets, self.spread, self.per_file = spark, Snapshots(spark, root), buckets, spread, per_file

    def add(self, docs: DataFrame, doc_id: str, title: str, text: str, metadata: dict[str, str] | None = None, min_len: int = 2, stop: Sequence[str] = tuple(X.SEARCH_STOP_WORDS)) -> int:
        """Add documents whose ids are new; ``metadata`` maps roles (city, trade, has_phone, ...) to columns.  Returns the version."""
        base, manifest = self.tables.current()
        own = docs.select(F.col(doc_id).alias("doc"), F.col(title).alias("title"), F.col(text).alias("text"), *[F.col(c).alias(role) for role, c in (metadata or {}).items()])
        # files of bounded length, so that they can be counted by all cores
        documents = self.tables.stage(own, compression="zstd", maxRecordsPerFile=250_000)
        counts = token_counts(self.tables.staged(documents), "doc", F.concat_ws(" ", "title", "text"), min_len, stop)
        parts = {"documents": documents, "counts": self.tables.stage(counts, compression="zstd")}
        kept = {name: [*manifest["tables"].get(name, []), part] for name, part in parts.items()}
        # a version of its own for the inputs: what follows reads them as a table
        inputs = self.tables.commit(manifest["tables"] | kept, base, manifest["note"])
        return self._derive(inputs)

    def _derive(self, base: int) -> int:
        manifest = self.tables.current()[1]
        counts, size = self.tables.read("counts"), self.tables.read("documents").count()
        bucket = F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(self.buckets)).cast("int").alias("bucket")
        frequencies = self.tables.stage(token_frequencies(counts).select("token", "df", bucket).repartition("bucket"), ("bucket",), compression="zstd")
        df = self.tables.staged(frequencies)
        weighted = with_idf(counts, df, size).withColumn("weight", F.col("n") / F.col("len") * F.col("idf"))
        norms = weighted.groupBy("doc").agg(F.count(F.lit(1)).alias("terms"), F.max("weight").alias("top"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("magnitude"))
        total = df.agg(F.sum("df")).first()[0] or 0
        order = ("bucket", "token", "doc")  # by ranges: a frequent token fills several files, and equal tokens lie together
        postings = counts.select("token", "doc", "n", "len", bucket).repartitionByRange(max(self.spread, -(-total // self.per_file)), *order).sortWithinPartitions(*order)
        new = {"postings": [self.tables.stage(postings, ("bucket",), compression="zstd")], "frequencies": [frequencies], "norms": [self.tables.stage(norms, compression="zstd")]}
        number = self.tables.commit(manifest["tables"] | new, base, {"size": size})
        self.tables.expire(2)
        return number

    def postings(self, tokens: Sequence[str]) -> DataFrame:
        """(token, doc, weight) of some tokens, from their buckets alone."""
        idf = R.case([(F.col("token") == t, v) for t, v in self._idf(tokens).items()], 0.0)
        return self._of("postings", tokens).select("token", "doc", (F.col("n") / F.col("len") * idf).alias("weight"))

    def norms(self) -> DataFrame:
        """(doc, terms, top, magnitude) of the documents that have tokens: how many, their largest weight, the length of the vector."""
        return self.tables.read("norms")

    def _idf(self, tokens: Sequence[str]) -> dict[str, float]:
        """Of those tokens that occur."""
        size = self.tables.current()[1]["note"].get("size", 0)
        return {r["token"]: math.log((size + 1) / (r["df"] + 1)) + 1 for r in self._of("frequencies", tokens).collect()}

    def _of(self, name: str, tokens: Sequence[str]) -> DataFrame:
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in tokens})
        return self.tables.read(name).filter(F.col("bucket").isin(buckets or [-1]) & F.col("token").isin(list(tokens) or [""]))

    def query_vector(self, q: str) -> tuple[dict[str, float], list[str]]:
        """Weights of the query's tokens by the frequencies of the whole corpus."""
        toks = [t for t in re.split(r"[^a-z0-9]+", q.lower()) if len(t) > 1 and t not in X.SEARCH_STOP_WORDS]
        found = self._idf(list(dict.fromkeys(toks)))  # the query's own tokens
        n = max(len(toks), 1)
        return {t: c / n * found.get(t, 0.5) for t, c in Counter(toks).items()}, toks

    def search(self, q: str, k: int = 20, contains: dict[str, str] | None = None, equals: dict[str, str] | None = None, minimum: dict[str, float] | None = None, flags: dict[str, bool] | None = None) -> DataFrame:
        """Top k by .62 cosine + .28 metadata + .10 phrase overlap among the documents that pass the filters.

        Filters name metadata roles: ``contains`` (trade, city, county, stage; loose), ``equals`` (package_size), ``minimum``
        (valuation) and ``flags`` (has_phone).  A trade filter adds .35 to the metadata score.
        """
        weights, toks = self.query_vector(q)
        q_mag = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        qw = R.case([(F.col("token") == t, float(w)) for t, w in weights.items()], 0.0)
        dots = self.postings(list(weights)).groupBy("doc").agg(F.sum(F.col("weight") * qw).alias("_dot"))
        cosine = dots.join(self.norms(), "doc").select("doc", (F.col("_dot") / (F.col("magnitude") * F.lit(q_mag))).alias("_l"))
        docs = self.tables.read("documents")
        meta = F.lit(0.0)
        if (contains or {}).get("trade"):
            meta = meta + F.lit(0.35)
        for role, points in METADATA_POINTS.items():
            if role in docs.columns:
                meta = meta + F.when(contains_ci([role], q), points).otherwise(0.0)
        lower = F.lower(F.concat_ws(" ", "title", "text"))
        phrase = R.points([(lower.contains(t), 1) for t in toks if len(t) > 2], 0) / max(len(toks), 1)
        # judged before the join, so that a text travels only for a caller who reads it
        rows = metadata_filter(docs, contains, equals, minimum, flags).withColumn("_meta", F.least(F.lit(1.0), meta)).withColumn("_phrase", phrase).join(cosine, "doc", "left")
        lex = F.coalesce("_l", F.lit(0.0))
        hits = rows.withColumn("_s", lex * 0.62 + F.col("_meta") * 0.28 + F.col("_phrase") * 0.1).withColumn("_lex", lex).filter(~((F.col("_s") < 0.04) & (F.col("_lex") < 0.02)))
        r3 = lambda c: R.round_half_up(c, 3)
        scored = hits.select(*docs.columns, r3("_s").alias("score"), r3("_lex").alias("lexical_score"), r3("_meta").alias("metadata_score"))
        return scored.orderBy(F.desc("score"), "doc").limit(k).withColumn("snippet", query_snippet("text", toks))
