"""How filters interact in every order of application (operator 11).

Each document is a mask of the filters that it fails. In lexicographic order the permutations that share a prefix are
one interval of ranks (Lehmer code), so a mask is removed at step ``s`` on the intervals of those prefixes of length
``s`` that end in its first failing filter. Each mask adds its count where such an interval begins and takes it away
where it ends; a prefix sum over the ranks gives what every order removes at every step.

The corpus is only read into masks; what follows works on at most ``2 ** filters`` rows a part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
COPIES = "E"


def text_rules(words: Column, text: Column) -> dict[str, Column]:
    """Failure conditions on one text and its words: too short, repetitive, shouting, holding symbols."""
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n_words < 100,
        "B": 100 * distinct < 80 * n_words,
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, docs, good, toxic``: documents by ``lang`` and failed filters (bit 0: A, ..., bit 4: E).

    Filter E fails a document whose text equals that of any smaller id. A null text is empty, a null language is part
    ``''``. Each row of ``docs`` counts: of a row listed twice neither copy is smaller. A null id is neither smaller nor
    larger than another and has no label. Several labels of an id count together: one good or toxic is enough.

    Equal texts have equal masks, so rows are first counted by text digest, id and label, then by digest with the least
    id beside the count: a text that a third of all rows share sends a few rows from each task.
    """
    text = F.coalesce("text", F.lit(""))
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        F.array_remove(F.split(text, BLANKS), "").alias("words"),
    )
    rules = text_rules(F.col("words"), F.col("text"))
    bits = [F.when(rule, 1 << i).otherwise(0) for i, rule in enumerate(rules.values())]
    masked = known.select(
        "doc_id", "part", sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"),
        # ids that are null find no label; a salt keeps them from meeting in one task
        F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("salt"),
    )
    rated = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    rated = rated.withColumn("salt", F.lit(0).cast("long"))
    group = ["digest", "mask", "part", "good", "toxic"]
    rows = (
        masked.join(rated, ["doc_id", "salt"], "left")
        .fillna(0, ["good", "toxic"])
        .groupBy(*group, "doc_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    has_id = F.col("doc_id").isNotNull()
    texts = rows.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(has_id, F.col("n")).otherwise(0)).alias("with_id"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    copied = texts.withColumn("least", least).withColumn("copies", F.col("with_id") - firsts)
    split = F.array(
        F.struct("mask", (F.col("n") - F.col("copies")).alias("docs")),
        F.struct((F.col("mask") + (1 << len(rules))).alias("mask"), F.col("copies").alias("docs")),
    )
    both = copied.select("part", "good", "toxic", F.explode(split).alias("s")).where("s.docs > 0")
    docs_in = F.col("s.docs")
    return both.groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum(docs_in).alias("docs"), F.sum(docs_in * F.col("good")).alias("good"), F.sum(docs_in * F.col("toxic")).alias("toxic")
    )


def removal_intervals(mask: int, filters: int) -> Iterator[tuple[int, int, int]]:
    """``step, first rank, end rank`` of the permutations that remove a document of this mask at that step."""

    def walk(left: list[int], step: int, base: int) -> Iterator[tuple[int, int, int]]:
        width = factorial(len(left) - 1)
        for digit, letter in enumerate(left):
            first = base + digit * width
            if mask >> letter & 1:
                yield step, first, first + width
            else:
                yield from walk(left[:digit] + left[digit + 1 :], step + 1, first)

    if mask:
        yield from walk(list(range(filters)), 1, 0)


def interval_ends(filters: int) -> list[tuple[int, int, int, int]]:
    """``mask, step, rank, change`` rows of the difference arrays; ends that cancel are left out."""
    rows = []
    for mask in range(1, 1 << filters):
        changes: Counter[tuple[int, int]] = Counter()
        for step, first, end in removal_intervals(mask, filters):
            changes[step, first] += 1
            changes[step, end] -= 1
        rows += [(mask, *at, change) for at, change in sorted(changes.items()) if change]
    return rows


def audit(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """What each filter does at each step of each order, for ``counts(part, mask, docs, good, toxic)``.

    One row for every part, order of ``names`` and step: ``kept``, ``removed``, ``redundant`` (fails the filter, was
    removed before), ``unique_fails`` (fails this filter alone), ``good_lost``, ``toxic_lost`` and ``shapley``, the
    removals of the step's filter summed over all orders. Orders are ranked as ``names`` stand. The joined rule tables
    hold ``names! * len(names)`` and at most ``2 ** len(names)`` times as many rows, whatever the corpus. An empty table
    gives no rows. Rows of ``counts`` with equal part and mask add up.
    """
    spark, n = counts.sparkSession, len(names)
    ends = spark.createDataFrame(interval_ends(n), "mask INT, step INT, rank INT, change INT")
    orders = [
        (rank, step, letter, "".join(names[i] for i in order))
        for rank, order in enumerate(permutations(range(n)))
        for step, letter in enumerate(order, 1)
    ]
    orders = spark.createDataFrame(orders, "rank INT, step INT, letter INT, filter_order STRING")
    counts = counts.groupBy("part", F.col("mask").cast("int").alias("mask")).agg(
        *(F.sum(c).cast("long").alias(c) for c in ("docs", "good", "toxic"))
    )
    changes = (
        counts.join(F.broadcast(ends), "mask")
        .groupBy("part", "step", "rank")
        .agg(*(F.sum(F.col(c) * F.col("change")).alias(c) for c in ("docs", "good", "toxic")))
    )

    def by_filter(test) -> Column:
        return F.array(*(F.sum(F.when(test(F.col("mask"), 1 << i), F.col("docs")).otherwise(0)) for i in range(n)))

    grid = (
        counts.groupBy("part")
        .agg(
            F.sum("docs").alias("total"),
            by_filter(lambda mask, bit: mask.bitwiseAND(bit) != 0).alias("fails"),
            by_filter(lambda mask, bit: mask == bit).alias("alone"),
        )
        .withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .join(F.broadcast(orders), ["rank", "step"])
    )
    summed = Window.partitionBy("part", "step").orderBy("rank")
    earlier = Window.partitionBy("part", "rank").orderBy("step")
    at_step = grid.join(changes, ["part", "step", "rank"], "left").fillna(0, ["docs", "good", "toxic"])
    for name, changed in (("removed", "docs"), ("good_lost", "good"), ("toxic_lost", "toxic")):
        at_step = at_step.withColumn(name, F.sum(changed).over(summed))
    return at_step.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("removed").over(earlier)).alias("kept"),
        "removed",
        (F.element_at("fails", F.col("letter") + 1) - F.col("removed")).alias("redundant"),
        F.element_at("alone", F.col("letter") + 1).alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over all ``docs``; see ``mask_counts`` and ``audit``."""
    names: Mapping[str, Column] = text_rules(F.array(F.lit("")), F.lit(""))
    return audit(mask_counts(docs, labels), [*names, COPIES])


def check_sql() -> str:
    """The same rows by trying every order on every mask."""
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    return rf"""
        WITH t AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                   list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words
            FROM documents
        ), rated AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
        ), failed AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   concat(CASE WHEN len(words) < 100 THEN 'A' ELSE '' END,
                          CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
                          CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))
                                    > 10 * length(text) THEN 'C' ELSE '' END,
                          CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                          CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
            FROM t LEFT JOIN rated USING (doc_id)
        ), masks AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
            FROM failed GROUP BY ALL
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS o
            FROM {letters} a(x), {letters} b(x), {letters} c(x), {letters} d(x), {letters} e(x)
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), tried AS (
            SELECT part, o, fails, n, good, toxic,
                   list_min(list_transform(string_split(fails, ''), lambda x: strpos(o, x))) AS gone
            FROM masks, orders WHERE fails <> ''
        ), cells AS (
            SELECT p.part, p.total, o, s.step, substr(o, s.step, 1) AS letter
            FROM (SELECT part, sum(n) AS total FROM masks GROUP BY part) p, orders,
                 (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
        ), sums AS (
            SELECT c.part, c.total, c.o, c.step, c.letter,
                   coalesce(sum(t.n) FILTER (WHERE t.gone = c.step), 0) AS removed,
                   coalesce(sum(t.n) FILTER (WHERE t.gone <= c.step), 0) AS removed_so_far,
                   coalesce(sum(t.n) FILTER (WHERE t.gone < c.step AND contains(t.fails, c.letter)), 0) AS redundant,
                   coalesce(sum(t.n) FILTER (WHERE t.fails = c.letter), 0) AS unique_fails,
                   coalesce(sum(t.good) FILTER (WHERE t.gone = c.step), 0) AS good_lost,
                   coalesce(sum(t.toxic) FILTER (WHERE t.gone = c.step), 0) AS toxic_lost
            FROM cells c LEFT JOIN tried t ON t.part = c.part AND t.o = c.o
            GROUP BY ALL
        )
        SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(total - removed_so_far AS BIGINT) AS kept,
               CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM sums
    """
