"""Near-duplicate documents: circulant MinHash signatures, banding, exact Jaccard verification, components.

A signature uses two permutations of the 64-bit hash space.  The first scatters the shingles; the second, shifted
circularly by k, gives coordinate k (C-MinHash).  ``bands`` x ``rows`` coordinates collide in at least one band with
probability 1 - (1 - J^rows)^bands: at J = 0.8 and 32 x 4 a link is missed with probability 5e-8.

Groups are never expanded into all pairs.  Equal shingle sets form one class.  In a bucket, the class that meets the
most bucket mates is compared with the others (a star); what it links is one component and needs no further pairs.
Only classes that share a bucket and are still in different components are then compared with each other, in blocks that
emit links, not pairs, so no link between components is lost.  Comparisons are exact, on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bytewords import NOT_SPACE, grams, ids, mix, text_slices, words_of
from plumbline.llm.components import components
from plumbline.llm.scratch import Scratch

_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingles of document i are hashes[bounds[i]:bounds[i + 1]].

    A document with fewer words than ``shingle`` has its whole word sequence as the one shingle, or none without words.
    """
    words = words_of(data, offsets, NOT_SPACE)
    full = grams(words.hash, shingle)
    out = []
    for lo, hi in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if hi - lo >= shingle:
            out.append(np.unique(full[lo : hi - shingle + 1]))
        else:
            out.append(grams(words.hash[lo:hi], hi - lo) if hi > lo else full[:0])
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])
    return (np.concatenate(out) if out else full[:0]), bounds


def signatures(sets: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """[size, documents] minima of the shifted second permutation over each document's scattered shingles."""
    scattered = mix(sets ^ _U(0xA0761D6478BD642F))
    out = np.empty((size, len(starts)), _U)
    step = np.empty_like(scattered)
    for k in range(size):
        np.subtract(scattered, _U(k), out=step)
        step *= _U(0xE7037ED1A0B428DB)
        step ^= step >> _U(32)
        step *= _U(0x8EBC6AF09C88C6E3)
        out[k] = np.minimum.reduceat(step, starts)
    return out


def _signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n, s1, s2, keys): set size, a 128-bit hash of the set, one bucket key for each band."""
    schema = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                sets, bounds = shingle_sets(data, offsets, shingle)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                s1, s2 = np.zeros(len(n), _U), np.zeros(len(n), _U)
                keys: list = [[]] * len(n)
                if len(some):
                    starts = bounds[some]
                    s1[some] = np.add.reduceat(mix(sets + _U(1)), starts)
                    s2[some] = np.add.reduceat(mix(sets ^ _U(0x2545F4914F6CDD1D)), starts)
                    coordinates = signatures(sets, starts, bands * rows)
                    found = np.empty((bands, len(some)), _U)
                    for b in range(bands):
                        found[b] = grams(np.full(len(some), b, _U), 1)
                        for r in range(rows):
                            found[b] = mix(found[b] ^ coordinates[b * rows + r])
                    counts = np.zeros(len(n), np.int32)
                    counts[some] = bands
                    keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), ids(np.ascontiguousarray(found.T).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), pa.array(n), ids(s1), ids(s2), keys if len(some) else pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "s1", "s2", "keys"])

    return docs.select("id", "text").mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        last_text, last_set = None, None

        def set_of(text: str) -> np.ndarray:
            data = np.frombuffer((text or "").encode(), np.uint8)
            return shingle_sets(data, np.array([0, len(data)]), shingle)[0]

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                if x != last_text:  # the pairs of one hub follow each other
                    last_text, last_set = x, set_of(x)
                other = set_of(y)
                common = len(np.intersect1d(last_set, other, assume_unique=True))
                union = len(last_set) + len(other) - common
                keep.append(common > 0 and 100 * common >= percent * union)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, pairs.select("a", "b").schema)


def _cross_links(rows: DataFrame, shingle: int, percent: int, block: int) -> DataFrame:
    """(a, b): for each document of ``rows`` (key, id, n, m, label, text), a link to every other label that it links to in its bucket.

    A bucket of more than ``block`` members is split into blocks by id, and each pair of blocks is a group of its own.
    A group compares the members outside its largest label with all others, one against all at a time, on full sets.
    """
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "id", F.xxhash64("label").alias("label"), "text")
    id_type = rows.schema["id"].dataType

    def compare(table: pa.Table) -> pa.Table:
        data_type = table.schema.field("id").type
        _, label = np.unique(table.column("label").to_numpy(), return_inverse=True)
        found: tuple[list, list] = ([], [])
        if label.max(initial=0) > 0:
            names = table.column("id")
            parts = [shingle_sets(d, o, shingle) for _, _, d, o in text_slices(table.column("text"))]
            sets = np.concatenate([p[0] for p in parts])
            sizes = np.concatenate([np.diff(p[1]) for p in parts])
            vocabulary, token = np.unique(sets, return_inverse=True)
            start = np.concatenate([[0], np.cumsum(sizes)])
            flag = np.zeros(len(vocabulary), bool)
            for i in np.flatnonzero(label != np.bincount(label).argmax()):
                mine = token[start[i] : start[i + 1]]
                flag[mine] = True
                common = np.add.reduceat(flag[token], start[:-1])
                flag[mine] = False
                links = np.flatnonzero((100 * common >= percent * (sizes + sizes[i] - common)) & (label != label[i]))
                _, one = np.unique(label[links], return_index=True)  # of each label
                found[0].extend([i] * len(one))
                found[1].extend(links[one].tolist())
            take = [names.take(pa.array(x, pa.int64())) for x in found]
            return pa.table(take, ["a", "b"])
        return pa.table([pa.array([], data_type), pa.array([], data_type)], ["a", "b"])

    return dealt.groupBy("key", "b1", "b2").applyInArrow(compare, T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, block: int = 512) -> DataFrame:
    """Components of documents whose distinct word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Returns ``id_col``, n_shingles, class_id (smallest id with the same set), component_id (smallest id reachable), kept
    (id is component_id), a row for each input row.  Words are runs without ASCII white space, A-Z lower-cased.  Null
    and empty texts have no shingles and are linked with nothing.  Rows that repeat an id are one document, whose text
    must be the same (else pass a struct of the id and a hash of the text as id); a row without id is linked with nothing, has null ids and is kept.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = scratch.save(_signed(base, shingle, bands, rows), "signed")
    usable = signed.filter("id IS NOT NULL AND n > 0")
    same = scratch.save(usable.groupBy("n", "s1", "s2").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "same")
    member = scratch.save(signed.select("id", "n", "s1", "s2").join(same, ["n", "s1", "s2"], "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("class", "id")).otherwise(F.col("id")).alias("class")), "member")
    heads = member.filter("class = id AND n > 0").select("id").distinct()
    keys = usable.join(heads, "id", "left_semi").select("id", "n", F.explode("keys").alias("key")).distinct()
    sizes = scratch.save(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "sizes")
    shared = scratch.save(keys.join(sizes, "key").select("key", "id", "n", "m"), "shared")
    scratch.drop("signed", "sizes", "same")
    mates = shared.groupBy("id").agg(F.sum(F.col("m") - 1).alias("mates"))
    mates = scratch.save(mates, "mates")
    texts = scratch.save(base.join(mates.select("id"), "id", "left_semi").dropDuplicates(["id"]), "texts")

    def fits(x: str, y: str):
        return F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)

    # star: the class with the most bucket mates of each bucket against the others
    hub = F.min(F.struct((-F.col("mates")).alias("w"), F.col("id"), F.col("n")))
    hubs = scratch.save(shared.join(mates, "id").groupBy("key").agg(hub.alias("hub")).select("key", F.col("hub.id").alias("a"), F.col("hub.n").alias("na")), "hubs")
    star = shared.join(hubs, "key").filter((F.col("id") != F.col("a")) & fits("n", "na")).select("a", F.col("id").alias("b")).distinct()
    star = scratch.save(star, "star")
    links = scratch.save(_verified(star, texts, shingle, percent), "star-links")
    labels = components(links, scratch, "star-cc")

    # the rest: bucket mates of different components, in blocks
    labelled = scratch.save(shared.join(labels, "id", "left").select("key", "id", "n", "m", F.coalesce("label", "id").alias("label")), "labelled")
    mixed = scratch.save(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key"), "mixed")
    rest = scratch.save(labelled.join(mixed, "key", "left_semi"), "rest")
    scratch.drop("labelled", "mixed", "hubs", "mates", "shared", "star")
    more = scratch.save(_cross_links(rest.join(texts, "id"), shingle, percent, block), "cross-links")
    labels = components(links.union(more), scratch, "cc")
    scratch.drop("texts", "rest")

    done = member.join(labels.select(F.col("id").alias("class"), "label"), "class", "left")
    component = F.coalesce("label", "class")
    return done.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("class").alias("class_id"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
