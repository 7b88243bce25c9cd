"""URL filters: longest rule, else host words by Viterbi and a multinomial naive Bayes (operator 10).

Names in hosts are often words run together. The most probable split of each distinct name is found by Viterbi over
word frequencies of the pages' own texts; only the substrings of a name meet the word counts, by an equi join. Words of
the host and of the path are then scored by naive Bayes, trained on the urls that the rules judge. A score is that of the
host plus that of the path; each distinct host and each distinct path is scored once, however many pages have it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import cut_lineage, join_split, map_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct ``length, rule, verdict`` of the longest rule that fits, or null."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits))


def word_counts(pages: DataFrame) -> DataFrame:
    """``word, n``: lower-case words in the texts of all pages."""
    texts = F.lower(F.regexp_replace("html", "<[^>]*>", " "))
    words = pages.where(F.col("html").isNotNull()).select(F.explode(F.split(texts, r"[^\p{L}]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_name(name: str, known: dict[str, int], total: int) -> list[str]:
    """The most probable split of a name; an unknown part of n letters counts as 10 / (total * 10**n)."""
    part, letter = math.log(total), math.log(10)
    lengths = sorted({len(word) for word in known})
    best: list[tuple[float, int]] = [(0.0, 0)]  # cost up to here, and where the last part begins
    unknown = (math.inf, 0)  # the same if the last part is an unknown one
    for end in range(1, len(name) + 1):
        unknown = min((unknown[0] + letter, unknown[1]), (best[end - 1][0] + part, end - 1))
        words = [(best[end - n][0] + part - math.log(known[w]), end - n) for n in lengths if n <= end and (w := name[end - n : end]) in known]
        best.append(min([unknown, *words]))
    parts, end = [], len(name)
    while end:
        start = best[end][1]
        parts.append(name[start:end])
        end = start
    return parts[::-1]


def _split_names(total: int):
    def work(names: list[str], parts: list[list], counts: list[list]) -> list[list]:
        return [[split_name(n, dict(zip(p or [], c or [])), total) for n, p, c in zip(names, parts, counts)]]

    return work


def segment_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name, words`` of the distinct ``names(name)`` under ``counts(word, n)``.

    A name meets the counts by its substrings of the lengths that words have, however long those are.
    """
    counts = cut_lineage(counts)
    total = counts.agg(F.sum("n")).first()[0] or 1
    lengths = [r[0] for r in counts.select(F.length("word")).distinct().collect()]  # as many as the longest word at most
    starts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start"))
    room = F.length("name") - F.col("start") + 1
    parts = (
        starts.withColumn("size", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")))
        .where(F.col("size") <= room)
        .select("name", F.substring(F.col("name"), F.col("start"), F.col("size")).alias("word"))
        .distinct()
    )
    known = parts.join(counts, "word").groupBy("name").agg(F.collect_list("word").alias("p"), F.collect_list("n").alias("c"))
    return map_columns(
        names.join(known, "name", "left"), ["name", "p", "c"], lambda: _split_names(total), "words ARRAY<STRING>", ["name"]
    )


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages(page_id, url, html)``.

    The longest fitting rule decides; else the class with the higher naive Bayes score, ``allow`` on a tie or without
    any training row. A null url, or one without ``://``, has an empty host and path and is judged by the prior.
    Null pages count no words; repeated rows give repeated rows; other columns play no part.
    """
    host, path = url_parts(F.coalesce("url", F.lit("")))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    fit = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumn("fit", fit).withColumn("low_path", F.lower("path"))
    hosts, paths, prior = _scores(ruled, pages)
    scored = join_split(join_split(ruled, hosts, "host"), paths, "low_path")
    score = F.round(F.col("host_score") + F.col("path_score"), 6) + prior
    verdict = F.coalesce(F.col("fit.verdict"), F.when(score > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def _scores(ruled: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """``host, host_score`` and ``low_path, path_score``, the log odds of ``block`` of each distinct one, and the prior's."""
    judged = (
        F.count_if(F.col("fit.verdict") == "block").alias("blocked"),
        F.count_if(F.col("fit.verdict") == "allow").alias("allowed"),
    )
    hosts, paths = (cut_lineage(ruled.groupBy(key).agg(*judged)) for key in ("host", "low_path"))
    separators = r"[^\p{L}\p{N}]+"
    named = hosts.select("host", F.explode(F.split("host", separators)).alias("name")).where("name <> ''")
    split = segment_names(named.select("name").distinct(), word_counts(pages))
    host_words = join_split(named, split, "name").select("host", F.explode("words").alias("word"))
    host_words = cut_lineage(host_words)
    path_words = paths.select("low_path", F.explode(F.split("low_path", separators)).alias("word")).where("word <> ''")
    counted = (
        hosts.join(host_words, "host")
        .select("word", "blocked", "allowed")
        .unionByName(paths.join(path_words, "low_path").select("word", "blocked", "allowed"))
        .groupBy("word")
        .agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    )
    counted = cut_lineage(counted)
    vocabulary, all_b, all_a = counted.agg(F.count(F.lit(1)), F.sum("b"), F.sum("a")).first()
    rows_b, rows_a = hosts.agg(F.sum("blocked"), F.sum("allowed")).first()
    prior = math.log(((rows_b or 0) + 1) / ((rows_a or 0) + 1))
    shift = math.log(((all_a or 0) + vocabulary + 1) / ((all_b or 0) + vocabulary + 1))
    weight = F.log((F.col("b") + 1) / (F.col("a") + 1)) + shift
    weights = counted.select("word", F.round(weight, 9).alias("weight"))

    def scores(all_keys: DataFrame, words: DataFrame, key: str, name: str) -> DataFrame:
        summed = join_split(words, weights, "word").groupBy(key).agg(F.sum("weight").alias(name))
        return all_keys.select(key).join(summed, key, "left").fillna(0.0, [name])

    return scores(hosts, host_words, "host", "host_score"), scores(paths, path_words, "low_path", "path_score"), prior
