"""Entity resolution: blocked edit distance, record linkage, components (ER-*, JN-09, JN-10).

Nothing here pairs all members of a group.  Names are made distinct first, a
block key carries enough of a string to be selective, and keys that are still
hot are refined before the join.  Linked records meet through their shared
entity (a star), not through every pair of records.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.functions.rules import ColumnOrName, case, col, labels_where, matches, or_default
from plumbline.operators.keyed import best_per_key, first_per_key
from plumbline.plans import vocab as V
from plumbline.session import ensure_checkpoint_dir


# --- ER-01: nearest known name within an edit-distance budget -----------------------------
def edit_budget(length: ColumnOrName) -> Column:
    """max(2, floor(0.12 * length)), in whole numbers."""
    return F.greatest(F.lit(2), F.floor(col(length) * 12 / 100).cast("int"))


def _segment(i: Column, length: Column, t: Column) -> tuple[Column, Column]:
    """(0-based start, size) of segment ``i`` when ``length`` is cut into t + 1 parts."""
    parts = t + 1
    base = F.floor(length / parts).cast("int")
    longer = length - base * parts
    first_long = parts - longer
    return (i * base + F.greatest(F.lit(0), i - first_long), base + F.when(i >= first_long, 1).otherwise(0))


def _known_keys(text: Column, length: Column, t: Column) -> Column:
    """Segments of an indexed string; ``rest`` is the string without the segment."""
    def row(i: Column) -> Column:
        start, size = _segment(i, length, t)
        rest = F.concat(F.substr(text, F.lit(1), start), F.substr(text, start + size + 1))
        return F.struct(t.alias("t"), length.alias("len"), i.alias("part"), F.substr(text, start + 1, size).alias("seg"), rest.alias("rest"))

    return F.transform(F.sequence(F.lit(0), t), row)


def _probe_keys(text: Column, length: Column, t: Column) -> Column:
    """Substrings of a probe that can equal a segment of a string within t edits."""
    def of_length(known_len: Column) -> Column:
        def of_part(i: Column) -> Column:
            start, size = _segment(i, known_len, t)
            lo, hi = F.greatest(F.lit(0), start - t), F.least(length - size, start + t)

            def at(p: Column) -> Column:
                rest = F.concat(F.substr(text, F.lit(1), p), F.substr(text, p + size + 1))
                return F.struct(t.alias("t"), known_len.alias("len"), i.alias("part"), F.substr(text, p + 1, size).alias("seg"), rest.alias("rest"))

            return F.when(hi >= lo, F.transform(F.sequence(lo, hi), at))

        return F.flatten(F.array_compact(F.transform(F.sequence(F.lit(0), t), of_part)))

    return F.flatten(F.transform(F.sequence(F.greatest(F.lit(1), length - t), length + t), of_length))


BLOCK = ["t", "len", "part", "seg"]


# fixed value: up to this budget names meet in what is left when characters are deleted
DELETIONS = 3


def _deleted(df: DataFrame, name: str, budget: str) -> DataFrame:
    """(id, key): hash of a name, and of every string left when up to ``budget`` characters are deleted from it.

    Characters go from left to right, so a set of places is spelled once.  Few names become many strings, so they are dealt first
    and leave as numbers; the names come back to the pairs.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = df.repartition(tasks, name).select(name, budget, F.col(name).alias("_v"), F.lit(0).alias("_p"))
    out = level
    for n in range(1, DELETIONS + 1):
        at = level.filter((F.col(budget) >= n) & (F.col("_p") < F.length("_v"))).withColumn("_p", F.explode(F.sequence("_p", F.length("_v") - 1)))
        level = at.withColumn("_v", F.concat(F.substr("_v", F.lit(1), F.col("_p")), F.substr("_v", F.col("_p") + 2)))
        out = out.unionByName(level)
    return out.select(F.xxhash64(name).alias(f"{name}_id"), F.xxhash64("_v").alias("key"))


def candidate_pairs(probes: DataFrame, known: DataFrame, max_block_pairs: int = 20_000) -> DataFrame:
    """(probe, known): all pairs within the probe's budget and some others, a pair more than once.

    Strings within t edits of each other leave a common string when t characters or fewer are deleted from each.  Names that
    differ in two letters seldom leave the same string, so up to ``DELETIONS`` edits this is the block, however often the names
    share whole words.  Longer names have larger budgets: a string within t edits of another keeps at least one of its t + 1
    segments, shifted by at most t.  A segment that many strings share is no block: for those keys the strings without the
    segment are within t edits too, so one of *their* segments is added to the key.  No block loses a pair.
    """
    p = probes.select(F.col("norm").alias("probe")).filter("probe <> ''").withColumn("pl", F.length("probe")).withColumn("pt", edit_budget("pl"))
    k = known.select(F.col("norm").alias("known")).filter("known <> ''").withColumn("kl", F.length("known"))
    # every budget a probe within reach of this length can have
    least, most = edit_budget(F.greatest(F.lit(1), F.floor(F.col("kl") / 1.12).cast("int") - 3)), edit_budget(F.ceil(F.col("kl") * 1.14).cast("int") + 3)
    few = F.col("pt") <= DELETIONS
    k = k.withColumn("least", least).withColumn("most", most)
    # a probe that is longer by n loses n characters itself, so no more of the known name than its own length allows are deleted
    left = _deleted(k.filter(F.col("least") <= DELETIONS).withColumn("kt", F.least(F.lit(DELETIONS), edit_budget("kl"))), "known", "kt")
    # the planner takes all sides for as small as the names
    edits = _deleted(p.filter(few), "probe", "pt").join(left.hint("merge"), "key").select("probe_id", "known_id").distinct()
    named = lambda df, c: df.select(F.xxhash64(c).alias(f"{c}_id"), c).hint("merge")
    edits = edits.join(named(p, "probe"), "probe_id").join(named(k, "known"), "known_id").select("probe", "known")
    k = k.withColumn("kt", F.explode(F.sequence("least", "most"))).filter(F.col("kt") > DELETIONS)
    pk = p.filter(~few).select("probe", F.explode(F.array_distinct(_probe_keys(F.col("probe"), F.col("pl"), F.col("pt")))).alias("b")).select("probe", "b.*")
    kk = k.select("known", F.explode(_known_keys(F.col("known"), F.col("kl"), F.col("kt"))).alias("b")).select("known", "b.*")
    load = pk.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("np")).join(kk.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("nk")), BLOCK)
    heavy = load.filter(F.col("np").cast("bigint") * F.col("nk") > max_block_pairs).select(*BLOCK)
    light = pk.join(heavy, BLOCK, "left_anti").join(kk.drop("rest"), BLOCK).select("probe", "known")
    fine = ["t", "len", "part", "seg", "part2", "seg2"]
    refine_p = pk.join(heavy, BLOCK, "left_semi").select("probe", *BLOCK, F.explode(F.array_distinct(_probe_keys(F.col("rest"), F.length("rest"), F.col("t")))).alias("c"))
    refine_p = refine_p.select("probe", *BLOCK, F.col("c.len").alias("len2"), F.col("c.part").alias("part2"), F.col("c.seg").alias("seg2"))
    refine_k = kk.join(heavy, BLOCK, "left_semi").select("known", *BLOCK, F.explode(_known_keys(F.col("rest"), F.length("rest"), F.col("t"))).alias("c"))
    refine_k = refine_k.select("known", *BLOCK, F.col("c.len").alias("len2"), F.col("c.part").alias("part2"), F.col("c.seg").alias("seg2"))
    dense = refine_p.join(refine_k, fine + ["len2"]).select("probe", "known")
    return edits.unionByName(light).unionByName(dense)


def near_pairs(probes: DataFrame, known: DataFrame, max_block_pairs: int = 20_000) -> DataFrame:
    """(probe, known, distance) within the probe's budget; both inputs are distinct ``norm`` columns."""
    pairs = candidate_pairs(probes, known, max_block_pairs).withColumn("distance", F.levenshtein("probe", "known"))
    return pairs.filter(F.col("distance") <= edit_budget(F.length("probe"))).distinct()


def resolve_names(names: DataFrame, known: DataFrame, name: str = "name", known_name: str = "name", seq: str = "seq") -> DataFrame:
    """Each distinct name -> nearest known name, confidence .98 exact / .82 near / .72 itself.

    Ties go to the known name with the lowest ``seq``.  Exact matches are an equi
    join; only the rest takes part in the edit-distance search.
    """
    k = known.withColumn("norm", X.normalize_entity_name(known_name)).filter("norm <> ''").groupBy("norm").agg(
        F.min_by(F.col(known_name), F.col(seq)).alias("known_name"), F.min(seq).alias("known_seq"))
    n = names.select(F.col(name).alias("name")).distinct().withColumn("norm", X.normalize_entity_name("name"))
    exact = n.join(k, "norm").select("name", "known_name", F.lit(0).alias("distance"))
    rest = n.join(k.select("norm"), "norm", "left_anti")
    near = near_pairs(rest.select("norm").distinct(), k.select("norm"))
    near = near.join(k.select(F.col("norm").alias("known"), "known_name", "known_seq"), "known")
    near = best_per_key(near, ["probe"], ["distance", "known_seq"])
    fuzzy = rest.join(near.select(F.col("probe").alias("norm"), "known_name", "distance"), "norm", "left")
    both = exact.unionByName(fuzzy.select("name", "known_name", "distance"))
    conf = case([(F.col("distance") == 0, 0.98), (F.col("distance").isNotNull(), 0.82)], 0.72)
    return both.select("name", X.title_case(F.coalesce("known_name", F.trim("name"))).alias("canonical"), "distance", conf.alias("confidence"))


# --- ER-02: weight of an entity pair ---------------------------------------------------------
def pair_weight(a_norm: ColumnOrName, b_norm: ColumnOrName, a_conf: ColumnOrName, b_conf: ColumnOrName, same_type: Column) -> Column:
    a, b = col(a_norm), col(b_norm)
    ca, cb = col(a_conf), col(b_conf)
    j = X.jaccard(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " ")))
    w = j * 0.7
    w = F.when(a.contains(b) | b.contains(a), F.greatest(w, F.lit(0.82))).otherwise(w) + F.when(same_type, 0.08).otherwise(0.0)
    return case(
        [((a == "") | (b == ""), 0.0), (a == b, F.least(F.lit(0.99), F.lit(0.85) + ca * 0.07 + cb * 0.07))],
        F.least(F.lit(0.98), w * ((ca + cb) / 2 + 0.15)),
    )


LINK_FLOOR, STRONG_LINK, PAIR_LINK = 0.55, 0.78, 0.62


def family(kind: ColumnOrName) -> Column:
    """Types that may link: developer and company are one family."""
    return F.when(col(kind) == "company", F.lit("developer")).otherwise(col(kind))


def _ranked_tokens(e: DataFrame) -> DataFrame:
    """Adds ``ranked``: the entity's distinct tokens, rarest first (ties by token)."""
    tok = e.select("eid", "fam", F.explode(F.array_distinct(F.split("norm", " "))).alias("tok"))
    df = tok.groupBy("fam", "tok").agg(F.count(F.lit(1)).alias("df"))
    ranked = tok.join(df, ["fam", "tok"]).groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("ranked"))
    return e.join(ranked.withColumn("ranked", F.transform("ranked", lambda s: s["tok"])), "eid")


CELL = 2000
# fixed value: length of the substrings that block a name with those that contain it
SUBSTRING_GRAM = 8


def grid_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str = "a", right_id: str = "b", cell: int = CELL) -> DataFrame:
    """Join of two sides by block where a few blocks hold many members.

    The members of both sides of a block are counted first.  A block is a grid of cells of about ``cell`` members a side, and
    each cell is a join key of its own, so no task compares more than one cell; blocks of one cell are joined as they are.
    """
    size = lambda d, n: d.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias(n))
    cells = size(left, "_rows").join(size(right, "_cols"), list(on)).filter("_rows > 1 OR _cols > 1")
    one = F.lit(1)
    l, r = left.join(cells, list(on), "left"), right.join(cells, list(on), "left")
    rows, cols = F.coalesce("_rows", one), F.coalesce("_cols", one)
    place = lambda c, n: F.pmod(F.xxhash64(c), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    l = l.withColumn("_i", place(left_id, rows)).withColumn("_j", every(cols)).drop("_rows", "_cols")
    r = r.withColumn("_j", place(right_id, cols)).withColumn("_i", every(rows)).drop("_rows", "_cols")
    return l.join(r, [*on, "_i", "_j"]).drop("_i", "_j")


# --- ER-03: candidate links between distinct entities -------------------------------------------
def link_entities(entities: DataFrame) -> DataFrame:
    """Unordered links (a, b, weight >= .55) between distinct entities(eid, type, norm, confidence).

    A pair reaches .55 only with equal names, a substring, or a token Jaccard of
    at least 0.56 (the best case of the weight formula), which gives three lossless
    blocks: equal name; the rarest tokens of both names (prefix filter, with the bounds that the
    lengths and the places of the shared token give); and, for substrings, the rarest 8-gram of
    the shorter name.  The token counts of both names are part of the token block, so names that no
    count can bring to 0.56 never meet.  Blocks are joined by cells, so a token of many names is many tasks.
    """
    e = entities.withColumn("fam", family("type")).filter("norm <> ''").withColumn("len", F.length("norm"))
    ranked = _ranked_tokens(e)
    n = F.size("ranked")
    floor_j = 0.56
    prefix = ranked.select("eid", "fam", "norm", n.alias("n"), F.posexplode(F.slice("ranked", F.lit(1), n - F.ceil(n * floor_j).cast("int") + 1)).alias("pos", "key"))
    # 8-grams; a shorter name is its own gram, and only the lengths of such names are cut out of the others
    grams = lambda m: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("len") - m + 1)), lambda i: F.substr("norm", i, F.lit(m))))
    own = e.select("eid", "fam", "norm", F.explode(grams(SUBSTRING_GRAM)).alias("gram"))
    tiny = e.filter(F.col("len") < SUBSTRING_GRAM).select("fam", F.col("norm").alias("gram"), "len").distinct()
    every = own
    for m in sorted(r["len"] for r in tiny.select("len").distinct().collect()):
        cut = e.filter(F.col("len") > m).select("eid", "fam", "norm", F.explode(grams(m)).alias("gram"))
        every = every.unionByName(cut.join(tiny.filter(F.col("len") == m).select("fam", "gram"), ["fam", "gram"], "left_semi").select("eid", "fam", "norm", "gram"))
    df = every.groupBy("fam", "gram").agg(F.count(F.lit(1)).alias("df"))
    rare = best_per_key(own.join(df, ["fam", "gram"]), ["eid"], ["df", "gram"]).filter("df > 1").select("eid", "fam", "norm", "gram")
    short, full = rare.select(F.col("eid").alias("a"), "fam", F.col("norm").alias("an"), "gram"), every.select(F.col("eid").alias("b"), "fam", F.col("norm").alias("bn"), "gram")
    inside = grid_join(short, full, ["fam", "gram"]).filter((F.col("an") != F.col("bn")) & F.col("bn").contains(F.col("an"))).select("a", "b")
    # shared tokens are at most this one and those after it; a Jaccard of 0.56 takes 56 / 156 of all tokens
    reach = lambda most, n, m: (most * 156 >= (n + m) * 56) & (F.least(n, m) * 100 >= F.greatest(n, m) * 56)
    counts = F.filter(F.sequence(F.ceil(F.col("n") * 0.56).cast("int"), F.ceil(F.col("n") / 0.56).cast("int")), lambda m: reach(F.least(F.col("n") - F.col("pos"), m), F.col("n"), m))
    of = lambda i, j: prefix.select(F.col("eid").alias(i), "fam", F.col("norm").alias(f"{i}n"), F.col("n").alias(f"{i}_n"), F.col("pos").alias(f"{i}_pos"), "key", F.explode(counts).alias(f"{j}_n"))
    most = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    enough = reach(most, F.col("a_n"), F.col("b_n"))
    close = grid_join(of("a", "b"), of("b", "a"), ["fam", "key", "a_n", "b_n"]).filter((F.col("a") < F.col("b")) & (F.col("an") != F.col("bn")) & enough).select("a", "b")
    twin = grid_join(e.select(F.col("eid").alias("a"), "fam", "norm"), e.select(F.col("eid").alias("b"), "fam", "norm"), ["fam", "norm"]).filter("a < b").select("a", "b")
    ordered = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = ordered(inside).unionByName(close).unionByName(twin).distinct()
    info = entities.select("eid", "type", "norm", "confidence")
    side = lambda s: info.select(F.col("eid").alias(s), F.col("type").alias(f"{s}_type"), F.col("norm").alias(f"{s}_norm"), F.col("confidence").alias(f"{s}_conf"))
    scored = pairs.join(side("a"), "a").join(side("b"), "b")
    w = pair_weight("a_norm", "b_norm", "a_conf", "b_conf", F.col("a_type") == F.col("b_type"))
    return scored.withColumn("weight", w).filter(F.col("weight") >= LINK_FLOOR).select("a", "b", "weight")


# --- ER-04: which records link -------------------------------------------------------------------
def record_graph(records: DataFrame, key: str = "key") -> DataFrame:
    """Edges(src, dst) of the linkage graph over record nodes ``r:`` and entity nodes ``e:``.

    records(key, type, norm, confidence) without place and trade entities.  A link
    of .78 or more joins two records on its own: every record is tied to its
    entities and strongly linked entities to each other.  Weaker links need two
    between the same records, the best at .62 or more; that is decided on distinct
    co-occurring entity pairs, never on pairs of records.
    """
    ensure_checkpoint_dir(records.sparkSession)
    r = records.filter("norm <> ''").withColumn("eid", F.sha2(F.concat_ws("|", "type", "norm", F.col("confidence").cast("string")), 256))
    # each of these feeds several branches below, so it is written once
    r = r.select(key, "eid", "type", "norm", "confidence").checkpoint()
    entities = r.select("eid", "type", "norm", "confidence").distinct().checkpoint()
    links = link_entities(entities).checkpoint()
    rec = lambda c: F.concat(F.lit("r:"), F.col(c).cast("string"))
    ent = lambda c: F.concat(F.lit("e:"), F.col(c))
    member = r.select(rec(key).alias("src"), ent("eid").alias("dst"))
    strong = links.filter(F.col("weight") >= STRONG_LINK).select(ent("a").alias("src"), ent("b").alias("dst"))
    weak = links.filter(F.col("weight") < STRONG_LINK)
    if weak.isEmpty():
        return member.unionByName(strong).distinct()
    both = weak.select("a", "b", "weight").unionByName(weak.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    in_weak = r.join(both.select(F.col("a").alias("eid")).distinct(), "eid", "left_semi").select(key, "eid").distinct()
    co = in_weak.join(in_weak.select(key, F.col("eid").alias("eid2")), key).select("eid", "eid2").distinct()
    first = both.select(F.col("a").alias("e1"), F.col("b").alias("e2"), F.col("weight").alias("w1"))
    second = both.select(F.col("a").alias("f1"), F.col("b").alias("f2"), F.col("weight").alias("w2"))
    step = first.join(co.select(F.col("eid").alias("e1"), F.col("eid2").alias("f1")), "e1").join(second, "f1")
    step = step.filter(~((F.col("e1") == F.col("f1")) & (F.col("e2") == F.col("f2"))) & (F.greatest("w1", "w2") >= PAIR_LINK))
    ok = step.join(co.select(F.col("eid").alias("e2"), F.col("eid2").alias("f2")), ["e2", "f2"], "left_semi")
    # the two records are those that carry both entities of a side: tie the pairs, not the entities
    pair = lambda x, y: F.concat(F.lit("p:"), F.least(x, y), F.lit("+"), F.greatest(x, y))
    tie = ok.select(pair("e1", "f1").alias("src"), pair("e2", "f2").alias("dst")).distinct()
    used = tie.select(F.col("src").alias("pair")).union(tie.select(F.col("dst").alias("pair"))).distinct()
    carried = in_weak.join(in_weak.select(key, F.col("eid").alias("eid2")), key).filter("eid <= eid2").select(key, pair("eid", "eid2").alias("pair"))
    carried = carried.join(used, "pair", "left_semi").select(rec(key).alias("src"), F.col("pair").alias("dst"))
    return member.unionByName(strong).unionByName(tie).unionByName(carried).distinct()


# --- ER-05: connected components ------------------------------------------------------------------
def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """(node, component) with component = smallest node of the set.

    Large-star / small-star rounds: each is one aggregation by node (a minimum,
    combined map-side) and one join, and the edge count never grows past a
    constant factor, hubs included.  The rounds run on numbers in the order of the nodes, so
    long node names are moved only twice.  Lineage is cut with a reliable checkpoint.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select(src, dst).checkpoint()
    nodes = edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node"))).distinct()
    nodes = nodes.repartitionByRange("node").sortWithinPartitions("node").select("node", F.monotonically_increasing_id().alias("id")).checkpoint()
    number = lambda c, n: nodes.select(F.col("node").alias(c), F.col("id").alias(n))
    e = edges.filter(F.col(src) != F.col(dst)).join(number(src, "_a"), src).join(number(dst, "_b"), dst)
    e = e.select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")).distinct().checkpoint()
    previous = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: from each node to its smaller neighbours' minimum
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        small_min = down.groupBy("u").agg(F.min("v").alias("m"))
        j = down.join(small_min, "u")
        e = j.select(F.col("v").alias("x"), F.col("m").alias("y")).union(j.select(F.col("u").alias("x"), F.col("m").alias("y")))
        e = e.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct().checkpoint()
        state = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if previous == tuple(state):
            break
        previous = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = e.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("low")).join(number("component", "low"), "low").select("id", "component")
    return nodes.join(labels, "id", "left").select("node", F.coalesce("component", "node").alias("component"))


def cluster_records(records: DataFrame, all_keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, cluster): cluster = smallest key linked to it, directly or not.  Records without entities stay alone."""
    comp = connected_components(record_graph(records, key))
    mine = comp.filter(F.col("node").startswith("r:")).select(F.substr("node", F.lit(3)).alias("_k"), "component")
    keys = all_keys.select(key, F.col(key).cast("string").alias("_k")).join(mine, "_k", "left")
    group = F.coalesce("component", F.concat(F.lit("r:"), "_k"))
    keys = keys.withColumn("_g", group)
    low = keys.groupBy("_g").agg(F.min(key).alias("cluster"))
    # read by several branches of a hypothesis, so it is written once
    return keys.join(low, "_g").select(key, "cluster").checkpoint()


# --- ER-06: clusters to hypotheses -------------------------------------------------------------------
# fixed values: cues that the size classes depend on
BIG_BUILDERS = r"lennar|kb home|pulte|horton|meritage|taylor morrison"
COMMERCIAL_CUES = r"\b(commercial|industrial|warehouse|school|public works|tenant improvement)\b"
SMALL_CUES = r"\b(raise fence|side yard|patio|shed|repair)\b"


def hypotheses(atoms: DataFrame, entities: DataFrame, clusters: DataFrame, key: str = "key") -> DataFrame:
    """One row per cluster with size class and confidence; weak single records are dropped.

    atoms(key, title, text, city, county, trades ARRAY), entities(key, type, canonical).  Text cues are
    tested per record and combined as flags, so member texts are never gathered.
    The value lists of a hypothesis are the long table of :func:`hypothesis_values`.
    """
    a = atoms.join(clusters, key)
    flags = a.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"), F.min_by("title", key).alias("first_title"), F.max(matches("text", COMMERCIAL_CUES)).alias("commercial_cue"),
        F.max(matches("text", SMALL_CUES)).alias("small_cue"), F.count_distinct("city").alias("cities"), F.count_distinct("county").alias("counties"),
        F.min_by(F.xxhash64(key), key).alias("_h"))
    trades = a.select("cluster", F.explode("trades").alias("trade")).groupBy("cluster").agg(F.count_distinct("trade").alias("trades"))
    e = entities.join(clusters, key)
    # the first in the order of the members
    first_of = lambda kind: F.min(F.when(F.col("type") == kind, F.struct(F.col(key).alias("k"), "canonical")))["canonical"]
    named = e.groupBy("cluster").agg(
        F.count_distinct(F.when(F.col("type") == "developer", F.col("canonical"))).alias("developers"), F.count_distinct(F.when(F.col("type") == "subdivision", F.col("canonical"))).alias("subdivisions"),
        first_of("developer").alias("first_developer"), first_of("subdivision").alias("first_subdivision"),
        F.coalesce(F.max((F.col("type") == "developer") & matches("canonical", BIG_BUILDERS)), F.lit(False)).alias("big_builder"), F.max(F.col("type") == "parcel").alias("has_parcel"))
    h = flags.join(trades, "cluster", "left").join(named, "cluster", "left").na.fill(0, ["trades", "developers", "subdivisions"]).na.fill(False, ["big_builder", "has_parcel"])
    size = case(
        [
            ((F.col("subdivisions") > 0) | F.col("big_builder"), "development"), (F.col("commercial_cue"), "commercial"), (F.col("members") >= 3, "commercial"),
            (F.col("small_cue"), "small"), (F.col("members") > 1, "commercial"),
        ], "unknown")
    h = h.withColumn("package_size", size)
    cents = F.lit(28) + F.least(F.lit(35), F.col("members") * 8) + F.when(F.col("developers") > 0, 18).otherwise(0) + F.when(F.col("subdivisions") > 0, 20).otherwise(0) + F.when(
        F.col("trades") >= 2, 8).otherwise(0) + F.when(F.col("has_parcel"), 10).otherwise(0)
    h = h.withColumn("confidence", F.least(F.lit(97), cents) / 100)
    single = F.col("members") == 1
    h = h.filter(~(single & (F.col("package_size") == "small")) & ~(single & (F.col("confidence") < 0.4)))
    title = F.coalesce("first_subdivision", "first_developer", "first_title")
    return h.withColumn("title", F.when(F.col("package_size") == "development", F.concat(title, F.lit(" — housing / development package"))).otherwise(title)).withColumn(
        "hypothesis_id", F.concat(F.lit("hyp:"), X.hash31(F.col("cluster").cast("string")))).drop("_h")


def hypothesis_values(atoms: DataFrame, entities: DataFrame, clusters: DataFrame, key: str = "key") -> DataFrame:
    """(cluster, kind, value, first_key): developers, subdivisions, contractors, cities, counties, trades and members of every cluster.

    Values are distinct; their order in a list is (first_key, value), the member that brought them first.
    """
    kinds = {"developer": "developer", "subdivision": "subdivision", "gc": "contractor"}
    e = entities.filter(F.col("type").isin(*kinds)).select(key, case([(F.col("type") == k, v) for k, v in kinds.items()]).alias("kind"), F.col("canonical").alias("value"))
    own = [atoms.select(key, F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in ("city", "county")]
    own += [atoms.select(key, F.lit("trade").alias("kind"), F.explode("trades").alias("value")), atoms.select(key, F.lit("member").alias("kind"), F.col(key).cast("string").alias("value"))]
    rows = reduce(lambda a, b: a.unionByName(b), [e, *own]).filter("value IS NOT NULL AND value <> ''")
    return rows.join(clusters, key).groupBy("cluster", "kind", "value").agg(F.min(key).alias("first_key"))


def hypothesis_reasons(hyps: DataFrame, values: DataFrame) -> DataFrame:
    """(cluster, why): the reasons of each hypothesis, which name its first two developers and communities and first four trades."""
    shown = {"developer": 2, "subdivision": 2, "trade": 4}
    w = W.partitionBy("cluster", "kind").orderBy("first_key", "value")
    first = values.filter(F.col("kind").isin(*shown)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= case([(F.col("kind") == k, n) for k, n in shown.items()]))
    named = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("_n", "value"))))["value"], ", ").alias(f"_{k}")
    lists = first.groupBy("cluster").agg(*[named(k) for k in shown])
    h = hyps.join(lists, "cluster", "left")
    has = lambda k: F.coalesce(F.col(f"_{k}"), F.lit("")) != ""
    why = labels_where([
        (F.col("members") > 1, F.concat(F.col("members").cast("string"), F.lit(" linked public-record breadcrumbs reinforce the same package."))),
        (has("developer"), F.concat(F.lit("Developer signal: "), "_developer", F.lit("."))),
        (has("subdivision"), F.concat(F.lit("Subdivision / community cue: "), "_subdivision", F.lit("."))),
        (has("trade"), F.concat(F.lit("Trade breadcrumbs: "), "_trade", F.lit("."))),
        (F.col("package_size") == "development", "Looks like a housing / development package worth early pursuit."),
    ])
    return h.select("cluster", or_default(why, "Single-source signal with extractable entities.").alias("why"))


# --- ER-08 -----------------------------------------------------------------------------------------
def snapshot(atoms: DataFrame, hyps: DataFrame) -> DataFrame:
    rows = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value") for name, df in (("atoms", atoms), ("hypotheses", hyps))]
    return rows[0].unionByName(rows[1])


# --- JN-09 / ER-09: licence rows to target names -------------------------------------------------------
LICENSE_DROP = ["and", "of", "dba"]


def significant_tokens(name: ColumnOrName) -> Column:
    toks = F.split(X.normalize_license_name(name), " ")
    return F.filter(toks, lambda t: (F.length(t) > 1) & ~t.isin(LICENSE_DROP))


def strong_name_match(tokens: Column, candidate: Column) -> Column:
    """All target tokens are whole tokens of the candidate, with guards for short brands."""
    n, extra = F.size(tokens), F.size(candidate) - F.size(tokens)
    short = (n == 2) & F.forall(tokens, lambda t: F.length(t) <= 5)
    return (n >= 2) & (F.size(F.array_except(tokens, candidate)) == 0) & ~short & ~((n <= 2) & (extra >= 2))


def match_score(tokens: Column, candidate_words: Column, status: ColumnOrName, county: ColumnOrName, exact: Column) -> Column:
    base = F.when(exact, 100).otherwise(70) + F.least(F.lit(20), F.length(F.array_join(tokens, " ")))
    return base + R.points(
        [(matches(status, "clear"), 15), (matches(county, "sacramento|placer|el dorado|yolo|sutter|butte"), 20), (F.size(candidate_words) - F.size(tokens) > 3, -10)], 0)


def license_candidates(targets: DataFrame, licences: DataFrame, target: str, name_cols: Sequence[str], license_id: str) -> DataFrame:
    """(target, license, exact): exact key, else all target tokens contained.

    Both sides are reduced to distinct token sets.  Every token of a target must
    be in the candidate, so the target's two rarest tokens are one block key and
    a candidate offers the pairs of its own (few) tokens.
    """
    t = targets.select(target).distinct().withColumn("tkey", X.normalize_license_name(target)).withColumn("tokens", significant_tokens(target))
    c = None
    for n in name_cols:
        part = licences.select(license_id, F.col(n).alias("candidate"))
        c = part if c is None else c.unionByName(part)
    c = c.filter("candidate IS NOT NULL AND candidate <> ''").withColumn("ckey", X.normalize_license_name("candidate"))
    exact = t.join(c, F.col("tkey") == F.col("ckey")).select(target, license_id, "candidate", F.lit(True).alias("exact"))
    fuzzy_c = c.join(t.select("tkey"), F.col("ckey") == F.col("tkey"), "left_anti")
    ckeys = fuzzy_c.select("ckey").distinct().withColumn("words", F.array_distinct(F.filter(F.split("ckey", " "), lambda w: w != "")))
    df = ckeys.select(F.explode("words").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    tt = t.filter(F.size("tokens") >= 2).select(target, "tokens", F.explode(F.array_distinct("tokens")).alias("tok"))
    ranked = tt.join(df, "tok").groupBy(target, "tokens").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("r")).filter(F.size("r") >= 2)
    pair = lambda x, y: F.concat_ws(" ", F.least(x, y), F.greatest(x, y))
    blocks = ranked.select(target, "tokens", pair(F.col("r")[0]["tok"], F.col("r")[1]["tok"]).alias("block"))
    offers = ckeys.select("ckey", "words", F.explode("words").alias("w1")).withColumn("w2", F.explode("words")).filter("w1 < w2").select("ckey", "words", pair(F.col("w1"), F.col("w2")).alias("block"))
    hit = blocks.join(offers, "block").filter(strong_name_match(F.col("tokens"), F.col("words"))).select(target, "ckey").distinct()
    fuzzy = hit.join(fuzzy_c, "ckey").select(target, license_id, "candidate", F.lit(False).alias("exact"))
    return exact.unionByName(fuzzy)


def match_licenses(targets: DataFrame, licences: DataFrame, target: str, name_cols: Sequence[str], license_id: str, status: str, county: str) -> DataFrame:
    """Best licence per target name."""
    m = license_candidates(targets, licences, target, name_cols, license_id).join(licences.select(license_id, status, county), license_id)
    words = F.split(X.normalize_license_name("candidate"), " ")
    m = m.withColumn("score", match_score(significant_tokens(target), words, status, county, F.col("exact")))
    return best_per_key(m, [target], [F.desc("score"), license_id, "candidate"])


# --- JN-10: evidence documents to identities -------------------------------------------------------------
MATCH_STOP = ["area", "solar", "digital", "submittal", "paper", "review"]


def match_tokens(c: ColumnOrName) -> Column:
    toks = F.split(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(toks, lambda t: (F.length(t) > 3) & ~t.isin(MATCH_STOP)))


def match_evidence(identities: DataFrame, documents: DataFrame, floor: int = 20) -> DataFrame:
    """(identity, document, score >= floor).

    identities(iid, project_name, norm_key, number) and documents(did, project_name, title, text, norm_key)
    are first reduced to distinct names, so equal names are scored once.  A score
    of 20 needs an equal key, or at least two shared name tokens (one, when the
    project name has only one); those are the blocks.
    """
    inames = identities.select("project_name", "norm_key").distinct().withColumn("itok", match_tokens("project_name"))
    dnames = documents.select(F.col("project_name").alias("d_name"), "title", F.col("norm_key").alias("d_key")).distinct()
    dnames = dnames.withColumn("dtok", match_tokens(F.concat_ws(" ", "d_name", "title")))
    two = lambda df, arr, keep: df.select(*keep, F.explode(arr).alias("w1"), F.col(arr).alias("_a")).withColumn("w2", F.explode("_a")).filter("w1 < w2").select(*keep, F.concat_ws(" ", "w1", "w2").alias("block"))
    by_key = inames.join(dnames, (F.col("norm_key") == F.col("d_key")) & (F.col("norm_key") != "")).select("project_name", "d_name", "title")
    one = inames.filter(F.size("itok") == 1).select("project_name", F.col("itok")[0].alias("block"))
    by_one = one.join(dnames.select("d_name", "title", F.explode("dtok").alias("block")), "block").select("project_name", "d_name", "title")
    by_tok = two(inames, "itok", ["project_name"]).join(two(dnames, "dtok", ["d_name", "title"]), "block").select("project_name", "d_name", "title")
    pairs = by_key.unionByName(by_tok).unionByName(by_one).distinct().join(inames, "project_name").join(dnames, ["d_name", "title"])
    overlap = F.size(F.array_intersect("itok", "dtok"))
    scored = pairs.withColumn("overlap", overlap).withColumn(
        "score", F.when((F.col("norm_key") == F.col("d_key")) & (F.col("norm_key") != ""), 80).otherwise(0) + overlap * 8
        + F.when((F.length("project_name") > 4) & F.lower(F.concat_ws(" ", "d_name", "title")).contains(F.lower("project_name")), 24).otherwise(0))
    return scored.filter(F.col("score") >= floor).select("project_name", "d_name", "title", "overlap", "score")


def dedupe_entities(entities: DataFrame, key: str, seq: str) -> DataFrame:
    return first_per_key(entities, [key, "type", "norm"], [seq])
