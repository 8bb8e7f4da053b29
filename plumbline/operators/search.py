"""Search and ranking (SR-*).

A query is turned into literals on the driver (its terms, synonyms and trades);
the corpus is scored in one pass and cut with a top-k, so nothing but the k hits
ever reaches one place.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.functions.rules import ColumnOrName, case, col, matches
from plumbline.operators.relational import contains_ci, filter_once, flag_semi
from plumbline.plans import permits as P
from plumbline.plans import vocab as V
from plumbline.session import ensure_checkpoint_dir
from plumbline.sources.snapshots import Snapshots


# WN-12
def sort_by(df: DataFrame, key: str, direction: str = "asc", tie: str | None = None) -> DataFrame:
    c = F.col(key)
    order = [c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last()]
    return df.orderBy(*order, *([tie] if tie else []))


# CL-49: query text to terms and trades
def query_terms(q: str, synonyms: dict[str, list[str]] | None = None) -> list[str]:
    base = [t for t in re.split(r"[^a-z0-9]+", q.lower()) if len(t) > 1]
    return list(dict.fromkeys(x for t in base for x in [t, *(synonyms or {}).get(t, [])]))


def query_trades(q: str, aliases: dict[str, list[str]] = V.SEARCH_TRADE_ALIASES) -> list[str]:
    return list(dict.fromkeys(t for a, ts in aliases.items() if a in q.lower() for t in ts))


def terms_from_table(queries: DataFrame, q: str, synonyms: dict[str, list[str]]) -> DataFrame:
    """Table form: (query row, term) with synonyms, for many queries at once."""
    spark = queries.sparkSession
    alias = spark.createDataFrame([(k, v) for k, vs in synonyms.items() for v in vs], "term STRING, synonym STRING")
    base = queries.select("*", F.explode(F.array_distinct(X.tokenize(q, 2, ()))).alias("term"))
    more = base.join(F.broadcast(alias), "term").withColumn("term", F.col("synonym")).drop("synonym")
    return base.unionByName(more).distinct()


def with_term_hits(df: DataFrame, columns: Sequence[ColumnOrName], terms: Sequence[str], name: str = "_hits") -> DataFrame:
    """Number of query terms in the row's text.  The blob is a column of its own, so it is built once per row."""
    return df.withColumn("_blob", X.text_blob(*columns)).withColumn(name, R.hits("_blob", terms)).drop("_blob")


def top_scored(df: DataFrame, score: str, floor: float, order: Sequence[ColumnOrName], k: int) -> DataFrame:
    """Top k by an order that starts with the score, then the floor.

    The floor is applied to the k rows that are left: the result is the same, and
    the score is not evaluated a second time in a filter pushed below it.
    """
    return df.orderBy(*[col(o) for o in order]).limit(k).filter(F.col(score) >= floor)


# SR-01
def keyword_search(projects: DataFrame, text_cols: Sequence[str], q: str, k: int, id_col: str, recency: str, companies: DataFrame | None = None,
                   signals: DataFrame | None = None, permits: DataFrame | None = None) -> DataFrame:
    """Synonym-expanded score (x3) with boosts for a matching company (4), signal (5) or permit (2).

    The boost inputs are (id_col, text) tables; each is filtered first and joined as a flag.
    """
    terms = query_terms(q, V.KEYWORD_SYNONYMS)
    out = projects
    boosts = []
    for name, frame, points in (("company", companies, 4), ("signal", signals, 5), ("permit", permits, 2)):
        if frame is not None:
            # dealt out by id before the distinct: the derived text and a hash aggregate in one stage exceed what the code generator compiles
            hit = filter_once(frame, R.contains_any(F.lower("text"), terms)).select(id_col).repartition(id_col)
            out = flag_semi(out, hit, id_col, f"_{name}")
            boosts.append((F.col(f"_{name}"), points))
    out = with_term_hits(out, text_cols, terms)
    out = out.withColumn("search_score", F.col("_hits") * 3 + R.points(boosts, 0)).drop("_hits")
    return top_scored(out, "search_score", 1, [F.desc("search_score"), F.desc(recency), id_col], k).drop("_company", "_signal", "_permit")


# SR-02
def global_search(parts: dict[str, tuple[DataFrame, Sequence[str], str, int]], q: str) -> DataFrame:
    """Grouped result: the first hits of each entity table, as (entity, id, score)."""
    terms = query_terms(q, V.KEYWORD_SYNONYMS)
    out = None
    for entity, (df, cols, id_col, k) in parts.items():
        hits = top_scored(with_term_hits(df, cols, terms, "score"), "score", 1, [F.desc("score"), id_col], k)
        rows = hits.select(F.lit(entity).alias("entity"), F.col(id_col).cast("string").alias("id"), "score")
        out = rows if out is None else out.unionByName(rows)
    return out


# SR-03
def token_counts(docs: DataFrame, doc_id: str, text: ColumnOrName, min_len: int = 2, stop: Sequence[str] = tuple(X.SEARCH_STOP_WORDS)) -> DataFrame:
    """(doc, len, token, n): how often a token occurs in a document of ``len`` tokens.

    A document is counted inside its row, as the runs of its sorted tokens, so nothing is shuffled and its counts stay
    together.  Only where rows share an id are the counts of equal ids and lengths added up.
    """
    rows = docs.select(F.col(doc_id).alias("doc"), F.sort_array(X.tokenize(text, min_len, stop)).alias("_t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
    rows = rows.withColumn("_at", F.when(F.size("_t") > 0, starts))
    run = lambda at, k: F.struct(F.get("_t", at).alias("token"), (F.coalesce(F.get("_at", k + 1), F.size("_t")) - at).cast("long").alias("n"))
    counts = rows.select("doc", F.size("_t").alias("len"), F.inline(F.transform("_at", run)))
    shared = docs.groupBy(F.col(doc_id)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return counts if shared.isEmpty() else counts.groupBy("doc", "len", "token").agg(F.sum("n").alias("n"))


def token_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def with_idf(counts: DataFrame, frequencies: DataFrame, size: int, head: int = 200_000) -> DataFrame:
    """``counts`` with the idf of each token; both are read several times, so they should be stored.

    At most ``head`` of the most frequent tokens (most of all counts) are looked up where the counts lie; the counts of
    all other tokens are joined by token.  None of those is frequent: more than ``head`` tokens have half its frequency or more.
    """
    level = F.floor(F.log2("df"))
    sizes = {r["level"]: r["count"] for r in frequencies.groupBy(level.alias("level")).count().collect()}  # at most 64 rows
    least, taken = 64, 0
    for v in sorted(sizes, reverse=True):
        taken += sizes[v]
        if taken > head:
            break
        least = v
    idf = (F.log((F.lit(size) + 1) / (F.col("df") + 1)) + 1).alias("idf")
    common = F.broadcast(frequencies.filter(level >= least).select("token", idf))  # not more than ``head`` rows
    near = counts.join(common, "token")
    if taken <= head:
        return near
    rare = counts.join(F.broadcast(common.select("token")), "token", "left_anti")
    return near.unionByName(rare.join(frequencies.filter(level < least).select("token", idf), "token").select(near.columns))


def build_tfidf(docs: DataFrame, doc_id: str, text: ColumnOrName, min_len: int = 2, stop: Sequence[str] = tuple(X.SEARCH_STOP_WORDS)) -> tuple[DataFrame, DataFrame, int]:
    """(vectors, document frequencies, corpus size).

    vectors(doc, token, weight) with weight = count / length * (ln((n + 1) / (df + 1)) + 1).  Counts and frequencies are
    written once to the checkpoint folder, as what follows reads them several times.
    """
    spark = docs.sparkSession
    tables = Snapshots(spark, f"{ensure_checkpoint_dir(spark)}/tfidf-{uuid.uuid4().hex}")
    once = lambda frame: tables.staged(tables.stage(frame, compression="zstd"))
    counts = once(token_counts(docs, doc_id, text, min_len, stop))
    df, size = once(token_frequencies(counts)), docs.count()
    return with_idf(counts, df, size).select("doc", "token", (F.col("n") / F.col("len") * F.col("idf")).alias("weight")), df, max(size, 1)


def query_vector(q: str, df: DataFrame, size: int) -> tuple[dict[str, float], list[str]]:
    """Query weights as literals; the frequencies fetched are those of the query's own tokens."""
    toks = [t for t in re.split(r"[^a-z0-9]+", q.lower()) if len(t) > 1 and t not in X.SEARCH_STOP_WORDS]
    found = {r["token"]: r["df"] for r in df.filter(F.col("token").isin(list(dict.fromkeys(toks)) or [""])).collect()}
    n = max(len(toks), 1)
    weight = lambda t, c: c / n * (math.log((size + 1) / (found[t] + 1)) + 1 if t in found else 0.5)
    return {t: weight(t, c) for t, c in Counter(toks).items()}, toks


def metadata_filter(df: DataFrame, contains: dict[str, str] | None = None, equals: dict[str, str] | None = None, minimum: dict[str, float] | None = None,
                    flags: dict[str, bool] | None = None) -> DataFrame:
    """FL-17: loose contains, exact equality, lower bounds and tri-state flags; absent filters are skipped."""
    for c, v in (contains or {}).items():
        df = df.filter(contains_ci([c], v))
    for c, v in (equals or {}).items():
        df = df.filter(F.coalesce(F.col(c), F.lit("")) == v)
    for c, v in (minimum or {}).items():
        df = df.filter(F.coalesce(F.col(c), F.lit(0)) >= v)
    for c, v in (flags or {}).items():
        df = df.filter(F.coalesce(F.col(c), F.lit(False)) == v)
    return df


# SR-05
METADATA_POINTS = {"city": 0.2, "county": 0.15, "trade": 0.25, "package_size": 0.1, "stage": 0.1}


def semantic_search(docs: DataFrame, doc_id: str, title: str, text: str, q: str, k: int, metadata: dict[str, str] | None = None, trade_filter: str | None = None) -> DataFrame:
    """Hybrid rank .62 cosine + .28 metadata + .10 phrase overlap; weak hits dropped, top k kept.

    ``metadata`` maps the metadata roles (city, county, trade, ...) to columns.
    """
    whole = F.concat_ws(" ", F.col(title), F.col(text))
    vectors, df, size = build_tfidf(docs, doc_id, whole)
    qv, toks = query_vector(q, df, size)
    q_mag = math.sqrt(sum(w * w for w in qv.values()))
    qw = case([(F.col("token") == t, float(w)) for t, w in qv.items()], 0.0)
    sims = vectors.groupBy("doc").agg(F.sum(F.col("weight") * qw).alias("dot"), F.sum(F.col("weight") * F.col("weight")).alias("mag"))
    lexical = F.when((F.col("mag") > 0) & F.lit(q_mag > 0), F.col("dot") / (F.sqrt("mag") * F.lit(q_mag or 1.0))).otherwise(F.lit(0.0))
    meta = F.lit(0.0)
    for role, column in (metadata or {}).items():
        meta = meta + F.when(F.lower(F.coalesce(F.col(column), F.lit(""))).contains(q.lower()), METADATA_POINTS[role]).otherwise(0.0)
    if trade_filter and metadata and "trade" in metadata:
        meta = meta + F.when(contains_ci([metadata["trade"]], trade_filter), 0.35).otherwise(0.0)
    lower = F.lower(whole)
    phrase = R.points([(lower.contains(t), 1) for t in toks if len(t) > 2], 0) / max(len(toks), 1)
    # judged before the join, so that a text travels only for a caller who reads its snippet
    rows = docs.withColumn("doc", F.col(doc_id)).withColumn("_meta", F.least(F.lit(1.0), meta)).withColumn("_phrase", phrase).join(sims, "doc", "left")
    lex = F.coalesce(lexical, F.lit(0.0))
    score = lex * 0.62 + F.col("_meta") * 0.28 + F.col("_phrase") * 0.1
    hits = rows.withColumn("_s", score).withColumn("_l", lex).filter(~((F.col("_s") < 0.04) & (F.col("_l") < 0.02)))
    r3 = lambda c: R.round_half_up(c, 3)
    hits = hits.withColumn("score", r3("_s")).withColumn("lexical_score", r3("_l")).withColumn("metadata_score", r3("_meta"))
    top = hits.select("doc", "score", "lexical_score", "metadata_score", text).orderBy(F.desc("score"), "doc").limit(k)
    return top.withColumn("snippet", query_snippet(text, toks)).drop(text)


def query_snippet(text: str, toks: Sequence[str]) -> Column:
    """Window around the first query token that occurs in the text, else its opening."""
    clean = X.collapse_ws(text)
    lower = F.lower(clean)
    hit = case([(lower.contains(t), t) for t in toks if len(t) > 2])
    pos = F.position(hit, lower)
    return F.when(hit.isNull(), F.substring(clean, 1, 160)).otherwise(X.window_snippet(clean, pos, 50, 110))


def dense_search(vectors: DataFrame, vec_id: str, embedding: str, seed: Sequence[float], k: int) -> DataFrame:
    """Pluggable vector stage: cosine of an embedding column with a query vector."""
    q = [float(x) for x in seed]
    mag = math.sqrt(sum(x * x for x in q)) or 1.0
    qa = F.array(*[F.lit(x) for x in q])
    dot = F.aggregate(F.zip_with(embedding, qa, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return vectors.withColumn("score", R.round_half_up(dot / (norm * mag), 6)).orderBy(F.desc("score"), vec_id).limit(k)


# SR-04
FIELD_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}


def weighted_text_search(df: DataFrame, fields: dict[str, str], q: str, k: int, id_col: str) -> DataFrame:
    """All query tokens must occur; the score sums the best field weight of each token.

    ``fields`` maps a column to its class (A name, B description, C place / type).
    Token arrays are compared inside the row, so the corpus is scanned once.
    """
    toks = query_terms(q)
    sets = {c: F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+") for c in fields}
    best = lambda t: F.greatest(*[F.when(F.array_contains(sets[c], t), FIELD_WEIGHTS[w]).otherwise(0.0) for c, w in fields.items()], F.lit(0.0))
    out = df
    for i, t in enumerate(toks):
        out = out.withColumn(f"_t{i}", best(t)).filter(F.col(f"_t{i}") > 0)
    total = sum((F.col(f"_t{i}") for i in range(len(toks))), F.lit(0.0))
    return out.withColumn("rank", R.round_half_up(total, 4)).orderBy(F.desc("rank"), id_col).limit(k).drop(*[f"_t{i}" for i in range(len(toks))])


# SR-07
PLANNING_WANTED = r"\b(planning|entitlement|subdivision|housing|development|tentative|rezone|ceqa|pre-?app)\b"
PLACES = r"\bsacramento|placer|roseville|rocklin|natomas|antelope|carmichael\b"


def planning_leads(signals: DataFrame, q: str, trade: str | None, k: int, id_col: str) -> DataFrame:
    """signals(title, summary, city, county, stage, package_hint, trades ARRAY, contact_phone, contact_email) ranked by an additive score >= 20."""
    ql = q.strip().lower()
    signals = signals.withColumn("_blob", X.text_blob("title", "summary", "city", "county", "stage", "package_hint", F.array_join("trades", " ")))
    blob = F.col("_blob")
    wants = bool(re.search(PLANNING_WANTED, ql)) or bool(trade)
    terms: list[tuple[Column, object]] = [(F.col("package_hint") == "development", 28), (F.col("package_hint") == "commercial", 18), (F.lit(wants), 10)]
    if re.search(PLACES, ql):
        terms += [(blob.contains(p), 16) for p in ("sacramento", "placer") if p in ql]
        terms.append((F.lit(ql).contains(F.lower(F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit("\u0000")))), 10))
    if trade:
        named = F.exists("trades", lambda x: F.lower(x) == trade.lower())
        terms += [(named, 24), (~named & blob.contains(trade.lower()), 12)]
    terms += [(blob.contains(t), 3) for t in re.split(r"[^a-z0-9]+", ql) if len(t) > 2]
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    terms += [(has("contact_phone"), 8), (~has("contact_phone") & has("contact_email"), 4)]
    rank = case([(F.col("package_hint") == "development", 3), (F.col("package_hint") == "commercial", 2)], 1)
    out = signals.withColumn("relevance_score", R.points(terms, 0))
    why = F.slice(R.labels_where([
        (F.col("package_hint") == "development", "development-scale planning package"), (F.col("package_hint") == "commercial", "commercial-scale entitlement"),
        (has("contact_phone"), "planner phone on file"),
    ]), 1, 2)
    out = out.withColumn("why", F.coalesce(F.nullif(F.array_join(why, "; "), F.lit("")), F.lit("early public-record planning signal")))
    return top_scored(out, "relevance_score", 20, [F.desc("relevance_score"), F.desc(rank), id_col], k).drop("_blob")


# SR-08
def access_search(df: DataFrame, text_cols: Sequence[str], q: str, k: int, id_col: str) -> DataFrame:
    terms = query_terms(q, V.ACCESS_SYNONYMS)
    fence = any(re.search("fenc|gate|chain link|perimeter|security", t) for t in terms)
    pts = [(F.col("opportunity_state") == "Actionable Opportunity", 18), (F.col("opportunity_state") == "Research Required", 10)]
    if fence:
        pts.append((F.col("fence_probability") >= 50, 30))
    if "sacramento" in terms:
        pts.append((matches(F.concat_ws(" ", "project_location", "county"), "sacramento"), 20))
    tenth = lambda c, num, den: F.floor(F.col(c) * num / den + 0.5).cast("int")
    out = with_term_hits(df, text_cols, terms)
    score = F.col("_hits") * 6 + R.points(pts, 0) + tenth("access_score", 2, 10) + tenth("qualification_score", 12, 100)
    out = out.withColumn("search_score", score).drop("_hits")
    return top_scored(out, "search_score", 1, [F.desc("search_score"), F.desc("access_score"), F.desc("qualification_score"), id_col], k)


# SR-10
def similar_items(df: DataFrame, seed: dict[str, str], k: int, id_col: str) -> DataFrame:
    """Rows of the seed's trade ranked by place, type-token overlap and stage; >= 50, top k.  ``seed`` is one row's values."""
    trade, city, county = (str(seed.get(x) or "").lower() for x in ("trade", "city", "county"))
    kind, stage = (str(seed.get(x) or "").lower() for x in ("project_type", "project_stage"))
    out = df.filter(F.col(id_col) != seed[id_col]).filter(F.lower("trade") == trade)
    toks = [t for t in re.split(r"\W+", kind) if len(t) > 3]
    shared = R.hits(F.lower(F.coalesce(F.col("project_type"), F.lit(""))), toks) if toks else F.lit(0)
    st = F.lower(F.coalesce(F.col("project_stage"), F.lit("")))
    loose = [t for t in re.split(r"\W+", stage) if len(t) > 3]
    same_city = F.lower("city") == city
    score = F.lit(50) + R.points(
        [(same_city, 30), (~same_city & (F.lower("county") == county), 12), (F.lit(bool(stage)) & (st == stage), 15), ((st != stage) & R.contains_any(st, loose), 8)], 0) + F.least(F.lit(25), shared * 5)
    return top_scored(out.withColumn("similarity", score), "similarity", 50, [F.desc("similarity"), id_col], k)


def planning_rows(planning: DataFrame) -> DataFrame:
    """Planning records as search signals."""
    blob = P.blob("title", "description", "entitlement", "status", "address")
    return planning.withColumn("summary", F.col("description")).withColumn("city", X.city_before_state("address")).withColumn("county", F.col("jurisdiction")).withColumn(
        "stage", P.planning_stage(P.blob("status", "entitlement", "description", "title"))).withColumn("package_hint", P.package_hint(blob)).withColumn(
        "trades", P.planning_trades(blob)).withColumn("contact_phone", F.col("planner_phone")).withColumn("contact_email", F.col("planner_email"))
