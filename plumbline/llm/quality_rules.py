"""Quality rules: simple base limits, then robust multivariate outliers per language and source.

The statistics of a text are computed in its own row with array functions.  The outlier rule fits a minimum covariance
determinant (MCD) estimate to each (language, source) group: concentration steps shrink a location and a scatter matrix
to the ``coverage`` share of rows nearest to it, from two deterministic starts (classical moments, and medians with
absolute deviations), and the start with the smaller determinant wins.  A row is rejected when its squared Mahalanobis
distance exceeds ``cutoff``.

No group is taken to be narrower than ``FLOORS``.  Each floor lets its feature reach the cutoff alone.  The share of
repeated lines rests on few lines in a short text, so its floor is the sampling noise of the row where that is larger.

Scale: a step is two aggregates with partial sums over a narrow feature table, so a hot group is pre-aggregated by every
task.  Quantiles are exact counts on a fixed grid, mergeable and independent of the order of rows.  All in DataFrame
functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: feature -> smallest standard deviation that counts as a difference in writing; dup_lines is last, see ``_distance``
FLOORS = {"word_length": 0.25, "symbols": 0.1, "repeats": 0.1, "upper": 0.05, "dup_lines": 0.1}
#: median of a chi-square variable with one degree of freedom for each feature
CHI2_MEDIAN = 4.3515


def _once(array: Column) -> Column:
    """One row that carries ``array`` as a column of its own, so that lambdas read it instead of computing it again."""
    return F.explode(F.array(array))


def text_statistics(docs: DataFrame, text: str, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACES))
    split = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    written = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    chars = lambda drop: F.length(F.translate(body, drop, ""))
    out = docs.select(
        "*",
        (F.length(body) - chars(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(body) - chars(UPPER)).cast("long").alias("n_upper"),
        chars(SPACES).cast("long").alias("word_chars"),
        _once(written).alias("_lines"),
    )
    out = out.select("*", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), _once(split).alias("_words")).drop("_lines")
    window = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(3)])
    hashes = F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window))
    out = out.select("*", F.size("_words").cast("long").alias("n_words"), _once(hashes).alias("_hashes")).drop("_words")
    # the low bits of each hash give way to its position, so that one primitive sort brings equal windows together
    mask = F.expr("shiftleft(1L, 64 - length(regexp_replace(lpad(bin(size(_hashes)), 64, '0'), '1.*$', ''))) - 1")
    out = out.select("*", mask.alias("_mask"))
    packed = F.sort_array(F.transform("_hashes", lambda h, i: h.bitwiseAND(F.bitwise_not("_mask")).bitwiseOR(i.cast("long"))))
    out = out.select("*", _once(packed).alias("_packed"))
    place = lambda x: x.bitwiseAND(F.col("_mask")).cast("int")

    def again(x: Column, i: Column) -> Column:
        def same(y: Column) -> Column:
            near = x.bitwiseAND(F.bitwise_not("_mask")) == y.bitwiseAND(F.bitwise_not("_mask"))
            return F.coalesce(near & (F.get("_hashes", place(x)) == F.get("_hashes", place(y))), F.lit(False))

        return same(F.get("_packed", i - 1)) | same(F.get("_packed", i + 1))

    out = out.select("*", _once(F.sort_array(F.transform(F.filter("_packed", again), place))).alias("_at")).drop("_packed", "_hashes", "_mask")
    covered = F.aggregate("_at", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    out = out.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("_at")
    return out.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent))


def features() -> dict[str, Column]:
    """Transformed statistics, close to symmetric for ordinary prose."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "word_length": F.col("word_chars") / words,
        "symbols": F.sqrt(F.col("n_symbols") / words),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "upper": F.sqrt(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))),
    }


def _grid_quantile(df: DataFrame, keys: list[str], value: Column, share: float, step: float) -> DataFrame:
    """(keys, q): upper end of the first grid cell that brings the count of ``value`` to ``share`` of the rows."""
    cells = df.groupBy(*keys, F.floor(value / step).alias("cell")).agg(F.count(F.lit(1)).alias("m"))
    by = Window.partitionBy(*keys)
    seen = cells.select(*keys, "cell", F.sum("m").over(by.orderBy("cell")).alias("c"), F.sum("m").over(by).alias("n"))
    return seen.filter(F.col("c") >= F.col("n") * share).groupBy(*keys).agg(((F.min("cell") + 1) * step).alias("q"))


def _moments(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, n, means, scatter): scatter has the floors added to its diagonal."""
    d = range(len(names))
    scatter = [F.covar_pop(names[i], names[j]) + (FLOORS[names[i]] ** 2 if i == j else 0.0) for i in d for j in range(i + 1)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(x) for x in names]).alias("mean"), F.array(*scatter).alias("s"))


def _whitened(stats: DataFrame, d: int) -> DataFrame:
    """Adds w (rows of the inverse Cholesky factor of the scatter, lower triangle) and log_det."""
    at = lambda i, j: i * (i + 1) // 2 + j
    out = stats
    for i in range(d):
        for j in range(i + 1):
            rest = F.get("s", F.lit(at(i, j)))
            for k in range(j):
                rest = rest - F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}")
            out = out.withColumn(f"_l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"_l{j}_{j}"))
    for j in range(d):
        for i in range(j, d):
            if i == j:
                value = 1 / F.col(f"_l{i}_{i}")
            else:
                value = F.lit(0.0)
                for k in range(j, i):
                    value = value - F.col(f"_l{i}_{k}") * F.col(f"_w{k}_{j}")
                value = value / F.col(f"_l{i}_{i}")
            out = out.withColumn(f"_w{i}_{j}", value)
    log_det = F.lit(0.0)
    for i in range(d):
        log_det = log_det + 2 * F.ln(F.col(f"_l{i}_{i}"))
    w = F.array(*[F.col(f"_w{i}_{j}") for i in range(d) for j in range(i + 1)])
    return out.select(*stats.columns, w.alias("w"), log_det.alias("log_det"))


def _line_noise() -> Column:
    """Variance that the square root of a share of n_lines has by chance (1 / 4n), beyond the floor of dup_lines."""
    return F.greatest(F.lit(0.0), 0.25 / F.greatest(F.col("n_lines"), F.lit(1)) - FLOORS["dup_lines"] ** 2)


def _distance(names: list[str], last_noise: Column | None = None) -> Column:
    """Squared Mahalanobis distance of the features in a row that carries mean and w.

    ``last_noise`` is added to the variance of the last feature.  As w is lower triangular, only the last term shrinks.
    """
    total, at = F.lit(0.0), 0
    for i in range(len(names)):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.get("w", F.lit(at)) * (F.col(names[j]) - F.get("mean", F.lit(j)))
            at += 1
        square = part * part
        if last_noise is not None and i == len(names) - 1:
            square = square / (1 + last_noise * F.pow(F.get("w", F.lit(at - 1)), 2))
        total = total + square
    return total


def mcd_estimates(rows: DataFrame, scratch: Scratch, names: list[str], coverage: float = 0.75, steps: int = 4) -> DataFrame:
    """(group, mean, w): MCD location and whitening matrix of each ``group`` of ``rows`` (group, features)."""
    d = len(names)
    classic = _moments(rows, ["group"], names).select(F.lit(0).alias("start"), "group", "mean", "s")
    long = rows.select("group", F.posexplode(F.array(*names)).alias("j", "x"))
    middle = scratch.save(_grid_quantile(long, ["group", "j"], F.col("x"), 0.5, 0.005), "medians").withColumnRenamed("q", "m")
    spread = _grid_quantile(long.join(middle, ["group", "j"]).withColumn("x", F.abs(F.col("x") - F.col("m"))), ["group", "j"], F.col("x"), 0.5, 0.005)
    both = middle.join(scratch.save(spread, "deviations"), ["group", "j"]).groupBy("group").agg(*[F.max(F.when(F.col("j") == i, F.col(c))).alias(f"{c}{i}") for i in range(d) for c in ("m", "q")])
    diagonal = [(F.pow(F.col(f"q{i}") * 1.4826, 2) + FLOORS[names[i]] ** 2) if i == j else F.lit(0.0) for i in range(d) for j in range(i + 1)]
    robust = both.select(F.lit(1).alias("start"), "group", F.array(*[F.col(f"m{i}") - 0.0025 for i in range(d)]).alias("mean"), F.array(*diagonal).alias("s"))
    stats = scratch.save(_whitened(classic.union(robust), d), "mcd-0")
    for n in range(1, steps + 1):
        near = rows.join(stats.select("start", "group", "mean", "w"), "group").withColumn("d2", _distance(names)).drop("mean", "w")
        limit = scratch.save(_grid_quantile(near, ["start", "group"], F.ln(F.col("d2") + 1e-3), coverage, 1 / 64), f"limit-{n}")
        # written, so that its size is known and the rows of a hot group stay where they are
        bounded = scratch.save(stats.select("start", "group", "mean", "w").join(limit, ["start", "group"]), f"bounded-{n}")
        inner = rows.join(bounded, "group").filter(F.ln(_distance(names) + 1e-3) < F.col("q"))
        stats = scratch.save(_whitened(_moments(inner, ["start", "group"], names).drop("n"), d), f"mcd-{n}")
    best = stats.groupBy("group").agg(F.min_by(F.struct("mean", "s"), F.struct("log_det", "start")).alias("b")).select("group", "b.mean", "b.s")
    best = scratch.save(_whitened(best, d), "best")
    # the inner rows spread less than all: scale so that the median distance is that of normal rows, floors left as they are
    typical = _grid_quantile(rows.join(best, "group").withColumn("d2", _distance(names)), ["group"], F.ln(F.col("d2") + 1e-3), 0.5, 1 / 64)
    scale = F.greatest(F.lit(1.0), F.exp("q") / CHI2_MEDIAN)
    return scratch.save(best.join(typical, "group").select("group", "mean", F.transform("w", lambda x: x / F.sqrt(scale)).alias("w")), "estimates")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, min_rows: int = 100, coverage: float = 0.75, cutoff: float = 35.0, carry: Sequence[str] = ()) -> DataFrame:
    """Verdict of the quality rules for every document.

    Returns ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance (squared
    Mahalanobis, null where there is no estimate) and kept, a row for each input row.  Null and empty texts have no words
    and fail.  A null language or source is a group like others.  Groups of fewer than ``min_rows`` rows that pass the
    base rules share the estimate of their language's small groups, and if these are too few, of all such; where even
    those are fewer, rows that pass the base rules are kept.  Rows that repeat an id are judged each, by their own text.  The
    columns named in ``carry`` come back unchanged, others are not read.  The default ``cutoff`` lies far in the tail of normal rows (chi-square, 5 degrees: 2e-6), so that
    only texts of another kind go.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    carried = [f"_carry{i}" for i in range(len(carry))]
    base = docs.select(*[F.col(c).alias(x) for c, x in zip(carry, carried)], F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.to_json(F.struct(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))).alias("pair"), F.to_json(F.struct(F.col(lang_col).alias("lang"))).alias("lang_only"))
    counted = text_statistics(base, "text", min_words, max_repeat_percent).drop("text")
    names = list(FLOORS)
    table = scratch.save(counted.select("*", *[v.alias(k) for k, v in features().items()]), "statistics")
    passed = table.filter("NOT base_failed")
    sizes = passed.groupBy("pair", "lang_only").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < min_rows
    by_lang = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("lang_only"))
    sizes = sizes.withColumn("group", F.when(~small, F.col("pair")).when(by_lang >= min_rows, F.concat(F.lit("small "), "lang_only")).otherwise(F.lit("small")))
    groups = scratch.save(sizes.select("pair", "group"), "groups")
    rows = passed.join(groups, "pair").select("group", *names)
    rows = scratch.save(rows, "rows")
    estimates = mcd_estimates(rows, scratch, names, coverage)
    enough = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows).select("group")
    known = scratch.save(groups.join(estimates.join(enough, "group"), "group").select("pair", "mean", "w"), "known")
    judged = table.join(known, "pair", "left").withColumn("distance", _distance(names, _line_noise()))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"),
        *[F.col(x).alias(c) for x, c in zip(carried, carry)],
    )
