"""N-gram Jaccard join by MinHash banding (operator 1).

1. A text becomes the set of its five-word shingles (hashes), a digest of that set, and one MinHash per band row.
   Texts with equal sets form a class and are compared once.
2. Band hashes are shuffled; classes that share one are linked to the least of them (no pairs). The numbers of bands and
   rows are chosen so that a pair at the threshold shares a band with the wanted probability.
3. The linked groups are cut into blocks by hash, so that no task holds more than two bounded blocks, and every pair of
   classes of a group is verified on the full shingle sets inside a pair of blocks. A task counts links and returns a
   spanning forest, one row per class, never the pairs.
4. Connected components of the verified links give each document its group.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import pair_components
from .support import cut_lineage, join_split, map_columns

THRESHOLD = 0.8
WORDS = 5
RECALL = 0.9999
MOST_HASHES = 128
BLOCK_CLASSES = 512
BLOCK_GRAMS = 1 << 20
SLICE_GRAMS = 256

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int


def choose_banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> Banding:
    """The most rows a band (fewest false candidates) at which ``bands * rows <= most`` still reach ``recall``."""
    best = None
    for rows in range(1, most + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - chance))
        if bands * rows > most:
            break
        best = Banding(bands, rows)
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text is one shingle, an empty one none."""
    found = _WORD.findall((text or "").lower())
    if not found:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    n = max(1, len(hashes) - words + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(words, len(hashes))):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


@functools.cache
def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(20240501))
    draw = random.integers(1, 1 << 63, size=(2, count), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def band_hashes(grams: np.ndarray, banding: Banding) -> np.ndarray:
    """One hash per band of the MinHashes of a non-empty shingle set.

    All hash functions meet a slice of the set at once, in two tables that stay in the processor's cache.
    """
    a, b = (m[:, None] for m in _multipliers(banding.bands * banding.rows))
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    tables = np.empty((2, len(a) * min(SLICE_GRAMS, len(grams))), dtype=np.uint64)
    for at in range(0, len(grams), SLICE_GRAMS):
        part = grams[at : at + SLICE_GRAMS]
        mixed, high = (t[: len(a) * len(part)].reshape(len(a), len(part)) for t in tables)
        np.multiply(part, a, out=mixed)
        mixed += b
        np.right_shift(mixed, np.uint64(32), out=high)
        mixed ^= high
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, mixed.min(axis=1), out=least)
    out = np.zeros(banding.bands, dtype=np.uint64)
    for row in least.reshape(banding.bands, banding.rows).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def _signatures(words: int, banding: Banding):
    def work(texts: list[str | None]) -> list[list]:
        digests, sizes, bands = [], [], []
        for text in texts:
            grams = shingles(text, words)
            sizes.append(len(grams))
            digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
            bands.append(band_hashes(grams, banding).view(np.int64).tolist() if len(grams) else None)
        return [digests, sizes, bands]

    return work


def _gram_sets(words: int):
    """The shingle sets of the rows whose text is the one that stands for their id."""

    def work(texts: list[str | None], digests: list[bytes]) -> tuple[list[list[bytes]], list[int]]:
        sets = [shingles(t, words).tobytes() for t in texts]
        rows = [i for i, (s, d) in enumerate(zip(sets, digests)) if xxhash.xxh3_128_digest(s) == d]
        return [[sets[i] for i in rows]], rows

    return work


def _verify(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one pair of blocks: with itself all pairs, else the pairs across; per class the weight of its links and
    the least class it is joined to."""
    rows = rows.drop_duplicates("class_id").sort_values("class_id", kind="stable")
    ids, weight = rows["class_id"].to_numpy(), rows["members"].to_numpy()
    across = rows["low"].iat[0] != rows["high"].iat[0]
    side = (rows["block"] == rows["high"]).to_numpy()
    sets = [np.frombuffer(g, dtype=np.uint64) for g in rows["grams"]]
    sizes = np.array([len(s) for s in sets])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(gram, kind="stable")
    holder = np.repeat(np.arange(len(sets)), sizes)[order]  # classes by shingle
    first = np.concatenate([[0], np.cumsum(np.bincount(gram))])
    links, parent = np.zeros(len(sets), dtype=np.int64), list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(sets)):
        own = gram[ends[i] : ends[i + 1]]
        shared = np.zeros(len(sets), dtype=np.int64)
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            low, count = first[part], first[part + 1] - first[part]
            skip = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            shared += np.bincount(holder[np.arange(count.sum()) + skip], minlength=len(sets))
        near = shared >= threshold * (sizes[i] + sizes - shared) - 1e-9
        near[: i + 1] = False
        if across:
            near &= side != side[i]
        for j in np.flatnonzero(near):
            links[i] += weight[j]
            links[j] += weight[i]
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    joined = ids[[root(i) for i in range(len(sets))]]
    return pd.DataFrame({"class_id": ids, "joined_id": joined, "links": links})


def jaccard_groups(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL
) -> DataFrame:
    """``doc_id, class_id, copy_id, n_links`` of every row of ``docs(doc_id, text)``.

    ``copy_id`` is the least id with the same set of ``words``-word shingles, ``n_links`` the number of other documents
    whose sets have a Jaccard similarity of ``threshold`` or more (copies included), ``class_id`` the least id of the
    group that such links connect. Words are lower-case runs of letters, digits and underscores; a text of fewer words
    is one shingle. A text without words, null included, has no shingles and is linked to nothing, and so is a null id.
    A ``doc_id`` listed twice is one document; with two texts, the one of the least digest stands for it. One row comes
    back for each row of ``docs``, whose other columns play no part.
    """
    return _grouped(docs, threshold, words, recall).drop("grams")


def _grouped(docs: DataFrame, threshold: float, words: int, recall: float) -> DataFrame:
    """``jaccard_groups`` and ``grams``, the number of distinct shingles of the row's text."""
    banding = choose_banding(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    added = "digest BINARY, grams BIGINT, bands ARRAY<BIGINT>"
    signed = cut_lineage(map_columns(texts, ["text"], lambda: _signatures(words, banding), added, ["doc_id"]))
    meant = signed.where("grams > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    classes = (
        meant.groupBy("digest")
        .agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
        .join(
            signed.select(F.col("doc_id").alias("class_id"), F.col("digest"), F.col("grams").alias("size"), "bands"),
            ["class_id", "digest"],
        )
        .dropDuplicates(["class_id"])
    )
    classes = cut_lineage(classes)
    groups = _candidate_groups(classes)
    verified = cut_lineage(_links(classes, groups, texts, threshold, words))
    counted = verified.groupBy("class_id").agg(F.sum("links").alias("links"))
    joins = verified.where("class_id <> joined_id").select("class_id", "joined_id")
    final = _components(joins).join(counted, "class_id", "full_outer")
    labelled = classes.select("digest", "class_id", "members").join(final, "class_id", "left")
    per_class = labelled.select(
        "digest",
        F.col("class_id").alias("copy_id"),
        F.coalesce("group_id", "class_id").alias("class_id"),
        (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return (
        signed.select(
            "doc_id", "grams", F.when(F.expr("grams > 0 AND doc_id IS NOT NULL"), F.col("digest")).alias("digest")
        )
        .join(per_class, "digest", "left")
        .select(
            "doc_id",
            "grams",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("copy_id", "doc_id").alias("copy_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )


def one_of_each(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL
) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` without near copies, with all their columns.

    Rows go by their texts, not by their ids: of each group that links of ``jaccard_groups`` connect, the row of least id
    stays, a null id being the largest; of equal texts under one id any one row. So an id with two texts may keep one and
    lose the other. A text without words is linked to nothing, and its row stays. An empty table stays empty.
    """
    text = F.coalesce("text", F.lit(""))
    marks = {"_key": F.xxhash64(text), "_check": F.xxhash64(F.lit(1), text), "_id": F.col("doc_id").cast("long")}
    keyed = docs.withColumns(marks)
    groups = _grouped(keyed.select(F.col("_key").alias("doc_id"), "text"), threshold, words, recall)
    rows = cut_lineage(keyed.groupBy("_key", "_check", "_id").agg(F.count(F.lit(1)).alias("n")))
    classes = groups.where("grams > 0").groupBy(F.col("doc_id").alias("_key")).agg(F.min("class_id").alias("class"))
    clashing = rows.groupBy("_key").agg((F.min("_check") < F.max("_check")).alias("clash")).where("clash")
    if not clashing.isEmpty():  # two texts of one hash are never taken for copies
        classes = classes.join(clashing, "_key", "left_anti")
    placed = cut_lineage(join_split(rows, classes, "_key"))
    order = F.struct(F.col("_id").isNull().alias("late"), "_id", "_key")
    first = placed.groupBy("class").agg(F.min(order).alias("first"))
    ranked = join_split(placed, first, "class")
    marked = ranked.select("_key", "_check", "_id", "n", (order == F.col("first")).alias("stays")).where("n > 1 OR NOT stays")
    found = cut_lineage(marked.select(*(F.col(c).alias(f"m{c}") for c in ("_key", "_check", "_id")), "stays"))
    same = F.col("_key") == F.col("m_key")
    same = same & (F.col("_check") == F.col("m_check")) & F.col("_id").eqNullSafe(F.col("m_id"))
    kept = keyed.join(found, same, "left_anti")
    repeated = found.where("stays")
    if not repeated.isEmpty():  # rows that occur several times and stay once
        kept = kept.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(list(marks)))
    return kept.drop(*marks)


def _components(pairs: DataFrame) -> DataFrame:
    """``class_id, group_id`` of every class in ``pairs(class_id, joined_id)``."""
    found = pair_components(pairs, "class_id", "joined_id")
    return found.select(F.col("id").alias("class_id"), F.col("component").alias("group_id"))


def _candidate_groups(classes: DataFrame) -> DataFrame:
    """``class_id, group_id``: classes that bands connect. Each bucket is a star around its least class."""
    banded = classes.select("class_id", F.posexplode("bands").alias("band", "hash"))
    shared = (
        banded.groupBy("band", "hash")
        .agg(F.min("class_id").alias("least"), F.max("class_id").alias("most"))
        .where("least < most")
        .drop("most")
    )
    stars = banded.join(shared, ["band", "hash"]).where("class_id <> least").select("class_id", F.col("least").alias("joined_id"))
    return _components(cut_lineage(stars.distinct()))


def _links(classes: DataFrame, groups: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    members = groups.join(classes.select("class_id", "digest", "members", "size"), "class_id")
    blocks = members.groupBy("group_id").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_GRAMS), F.lit(1).cast("long")
        ).alias("blocks")
    )
    placed = members.join(blocks, "group_id").withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")))
    wanted = placed.select(F.col("class_id").alias("doc_id"), "digest", "group_id", "members", "block", "blocks")
    kept = ["doc_id", "group_id", "members", "block", "blocks"]
    sets = map_columns(texts.join(wanted, "doc_id"), ["text", "digest"], lambda: _gram_sets(words), "grams BINARY", kept)
    paired = sets.select(
        F.col("doc_id").alias("class_id"), "group_id", "members", "block", "grams",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"),
    )
    keyed = paired.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return (
        keyed.drop("other")
        .groupBy("group_id", "low", "high")
        .applyInPandas(lambda rows: _verify(rows, threshold), "class_id BIGINT, joined_id BIGINT, links BIGINT")
    )
