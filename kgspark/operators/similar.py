"""Names that are alike: an exact similarity join on q-grams, merged concepts, synonym groups."""

from __future__ import annotations

from collections.abc import Sequence
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import cut_lineage
from .components import connected_components
from .hot_keys import join_crowded
from .merge import ARRIVAL, alias_union, keyed_by_name, merge_groups

SIMILARITY = 0.8
MOST_GRAM = 3
BLOCK = 4096
MOST_CONCEPTS = 5  # a name that more concepts share tells nothing about any of them
ROUNDING = 1e-9


def gram_length(threshold: float) -> int:
    """The longest grams with which names at the threshold are certain to share one."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies above 0 and is at most 1")
    return MOST_GRAM if threshold == 1 else max(1, min(MOST_GRAM, floor(1 / (1 - threshold) + ROUNDING)))


def edits(length: Column, threshold: float) -> Column:
    """The most edits that a pair at the threshold may differ by, from the length of its longer name."""
    return F.floor((1 - threshold) * length + ROUNDING).cast("int")


def _prefixes(names: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """``by, name, length, gram, place``: the rarest padded grams of each name, enough that a similar name shares one."""
    q = gram_length(threshold)
    padded = F.concat(F.lit("\x01" * (q - 1)), F.col("name"), F.lit("\x02" * (q - 1)))
    cut = F.transform(F.sequence(F.lit(1), F.length("name") + q - 1), lambda i: F.substr(padded, i, F.lit(q)))
    grams = names.where("name <> ''").select(*by, "name", F.length("name").alias("length"), F.posexplode(cut).alias("place", "gram"))
    counts = grams.groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("rows"))
    ordered = Window.partitionBy(*by, "name").orderBy("rows", "gram", "place")
    longest = F.floor(F.col("length") / threshold + ROUNDING)  # of the names that may be similar
    return (
        join_crowded(grams, counts, [*by, "gram"])
        .withColumn("rank", F.row_number().over(ordered))
        .where(F.col("rank") <= q * edits(longest, threshold) + 1)
        .select(*by, "name", "length", "gram", "place")
    )


def similar_pairs(names: DataFrame, threshold: float = SIMILARITY, by: Sequence[str] = ()) -> DataFrame:
    """``by, a, b, similarity`` of all names of equal ``by`` that are alike, once each, ``a`` the longer or later one.

    Similarity is 1 less the edit distance over the length of the longer name. Names at the threshold differ in few
    q-grams, so their rarest grams meet: names are joined on gram and length, at places no farther apart than the edits
    allowed, and what meets is measured. A gram that many names of a length share is met in blocks. Exact at every
    threshold; the same name twice is one name, an empty or null one has no pair.
    """
    by = list(by)
    rows = cut_lineage(_prefixes(names.select(*by, "name").distinct(), by, threshold))
    least = F.ceil(threshold * F.col("length") - ROUNDING).cast("int")
    held = rows.select(*by, "gram", F.col("length").alias("b_length"), F.col("name").alias("b"), F.col("place").alias("b_place"))
    blocks = cut_lineage(held.groupBy(*by, "gram", "b_length").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))
    key = [*by, "gram", "b_length"]
    placed = held.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")))
    asked = rows.select(
        *by, "gram", F.col("length").alias("a_length"), F.col("name").alias("a"), F.col("place").alias("a_place"),
        F.explode(F.sequence(F.greatest(least, F.lit(1)), F.col("length"))).alias("b_length"),
    )
    asked = asked.join(blocks, key).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    allowed = edits(F.col("a_length"), threshold)
    near = F.abs(F.col("a_place") - F.col("b_place")) <= allowed
    other = (F.col("a_length") > F.col("b_length")) | (F.col("a") > F.col("b"))
    met = asked.drop("blocks").join(placed.drop("blocks"), [*key, "block"]).where(near & other)
    distance = F.expr("levenshtein(a, b)")
    return (
        met.select(*by, "a", "b", "a_length")
        .distinct()
        .withColumn("distance", distance)
        .where(F.col("distance") <= edits(F.col("a_length"), threshold))
        .select(*by, "a", "b", (1 - F.col("distance") / F.col("a_length")).alias("similarity"))
    )


def similar_groups(names: DataFrame, threshold: float = SIMILARITY, by: Sequence[str] = ()) -> DataFrame:
    """``by, name, group_name``: groups that similar names connect, called by their least name."""
    by = list(by)
    vertices = names.select(*by, F.col("name").alias("id")).distinct()
    found = connected_components(vertices, similar_pairs(names, threshold, by), by=by, source="a", target="b")
    return found.select(*by, F.col("id").alias("name"), F.col("component").alias("group_name"))


def merge_similar_concepts(
    concepts: DataFrame, similarity_threshold: float = SIMILARITY, order: Sequence[str] = ARRIVAL
) -> DataFrame:
    """One node for each group of concepts of a type whose names are alike, case aside; columns as given.

    The first node's fields stay, with the longest description. Aliases are those of all members and the names that are
    given up; a concept that is like no other is returned as it is.
    """
    keyed = keyed_by_name(concepts).withColumn("_like", F.lower("_name"))
    groups = similar_groups(keyed.select("_type", F.col("_like").alias("name")), similarity_threshold, ["_type"])
    named = groups.select("_type", F.col("name").alias("_like"), F.col("group_name").alias("_group"))
    members = join_crowded(keyed, named, ["_type", "_like"])
    keys = ["_group", "_type"]
    called = members.withColumn(
        "aliases", F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))
    )
    aliases = alias_union(called, keys)
    merged = merge_groups(members, keys, concepts.columns, order).join(aliases, keys, "left")
    given_up = F.array_remove(F.coalesce("_aliases", F.array().cast("array<string>")), F.coalesce("_base.name", F.lit("")))
    alone = F.col("_rows") == 1
    replaced = {
        "description": F.when(alone, F.col("_base.description")).otherwise(F.col("_description")),
        "aliases": F.when(alone, F.col("_base.aliases")).otherwise(given_up),
    }
    return merged.select(*[replaced.get(c, F.col(f"_base.{c}")).alias(c) for c in concepts.columns])


def _initials(name: str) -> Column:
    """First letters of a name of two or more words; null for one word."""
    words = F.split(F.col(name), "[ -]+")
    return F.when(F.size(words) > 1, F.array_join(F.transform(words, lambda w: F.substr(w, F.lit(1), F.lit(1))), ""))


def detect_synonyms(names: DataFrame, most_concepts: int = MOST_CONCEPTS) -> DataFrame:
    """``group_id, name, size``: groups of names that stand for the same, from ``names(name, aliases)``.

    A name belongs with its aliases, and with its initials where they are a name or an alias themselves. A name that more
    than ``most_concepts`` others claim as alias or initials joins nobody. Names are compared in lower case with single
    spaces, blank ones are left out. ``group_id`` is a hash of the group's least name; a name that joins nobody is a
    group of its own, and an alias that joins nobody is in no group.
    """
    concepts = names.select(
        F.lower(t.collapse(t.or_empty("name"))).alias("concept"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
    ).where("concept <> ''")
    aliases = (
        concepts.select("concept", F.explode("aliases").alias("alias"))
        .select("concept", F.lower(t.collapse(t.or_empty("alias"))).alias("alias"))
        .where("alias <> ''")
    )
    known = concepts.select("concept").distinct()
    short = known.unionByName(aliases.select(F.col("alias").alias("concept"))).where(F.length("concept") > 1).distinct()
    initials = known.select("concept", _initials("concept").alias("alias")).where("alias IS NOT NULL")
    spelled = initials.join(short.withColumnRenamed("concept", "alias"), "alias", "left_semi").select("concept", "alias")
    claims = aliases.unionByName(spelled).where("concept <> alias").distinct()
    crowded = claims.groupBy("alias").agg(F.count(F.lit(1)).alias("claimed")).where(F.col("claimed") <= most_concepts)
    links = join_crowded(claims, crowded, ["alias"]).select("concept", "alias")
    vertices = known.unionByName(links.select(F.col("alias").alias("concept"))).distinct().withColumnRenamed("concept", "id")
    groups = connected_components(vertices, links, by=(), source="concept", target="alias")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return join_crowded(groups, sizes, ["component"]).select(
        F.substr(F.md5("component"), F.lit(1), F.lit(16)).alias("group_id"), F.col("id").alias("name"), "size"
    )
