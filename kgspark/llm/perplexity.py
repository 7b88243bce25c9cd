"""Quality by n-gram perplexity (operator 12).

Spark counts every n-gram of characters of every text, by language, and estimates an interpolated modified Kneser-Ney
model: counts of the highest order, numbers of distinct left neighbours below it, three discounts for each language and
order from the counts of counts. The model is kept as sorted arrays of n-gram hashes with a log probability each, in
shards of a bounded size, so a task holds one shard however large the model is. A document is rejected when its
perplexity lies outside the band of its language, which follows from the quartiles over all documents of the language.

The words of a text are joined by one space; line feeds, which no word holds, stand before and after.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import cut_lineage, join_hot, map_columns, scratch_path, ship_package

ORDER = 5
FENCE = 1.0  # interquartile ranges between a quartile and the end of the band
CHANCE = 2.0  # standard errors of a text of its length that are added at both ends
SHARD_GRAMS = 1 << 23  # n-grams of the model that a task holds at a time
PIECE_CHARS = 1 << 20  # of one text that are looked at together
HELD_CHARS = 1 << 23  # of many texts that are counted together
MARK = "\n"
LEAST_WORDS = 10
WINDOW_WORDS = 5

BASE = (
    "n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT, base_failed BOOLEAN"
)
_SYMBOL = re.compile(r"[#*$%&|<>]")
_BLANKS = " \t\n\x0b\f\r"


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without blanks (space, tab to carriage return), in UTF-8."""
    return (text or "").encode().split()


def normal(words: list[bytes]) -> str:
    """The words joined by one space. NUL, which arrays of characters cannot end in, becomes the replacement sign."""
    return b" ".join(words).decode().replace("\0", "\ufffd")


# Base rules


def repeated_words(words: list[bytes], window: int = WINDOW_WORDS) -> int:
    """Words that lie in a window of words which the text has twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    ranks, size = ids, len(known)
    for i in range(1, window):  # numbers of ever longer windows, ranked anew before they leave a long
        if size * len(known) >= 2**63:
            kinds, ranks = np.unique(ranks, return_inverse=True)
            size = len(kinds)
        ranks, size = ranks[:-1] * len(known) + ids[i:], size * len(known)
    _, ranks, counts = np.unique(ranks, return_inverse=True, return_counts=True)
    again = counts[ranks] > 1
    ends = np.zeros(len(words) + 1, dtype=np.int64)
    ends[: n][again] += 1
    ends[window : window + n][again] -= 1
    return int(np.count_nonzero(np.cumsum(ends)[:-1]))


def base_figures(text: str | None, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    """The columns of ``BASE`` of a text and its words. A null text has no words, symbols or lines."""
    text = text or ""
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    chars = len(text) - sum(map(text.count, _BLANKS))
    repeated = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > 20 * len(words)
    return len(words), chars, len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated, failed


# N-grams of characters


def pieces(text: str, order: int, most: int = PIECE_CHARS) -> Iterator[str]:
    """The marked text in pieces whose n-grams together are those of the whole; a longer text is never held as codes."""
    lead = MARK * (order - 1)
    for at in range(0, len(text) + 1, most):
        part = text[max(0, at - order + 1) : at + most]
        part = lead[: max(0, order - 1 - at)] + part if at < order - 1 else part
        yield part + MARK if at + most > len(text) else part


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def gram_hashes(columns: list[np.ndarray], lang: str) -> np.ndarray:
    """A 64-bit hash of language and characters, from the first codes of all n-grams, their second codes and so on."""
    out = np.full(len(columns[0]), xxhash.xxh3_64_intdigest(lang), dtype=np.uint64)
    for codes in columns:
        out = (out ^ codes) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def window_hashes(codes: np.ndarray, order: int, lang: str) -> np.ndarray:
    """``gram_hashes`` of each window of ``order`` codes."""
    n = max(0, len(codes) - order + 1)
    return gram_hashes([codes[i : i + n] for i in range(order)], lang)


def count_windows(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows as a matrix of codes, and how often each occurs. A window that ends in two marks lies between
    two texts and is none."""
    n = len(codes) - order + 1
    if n < 1:
        return np.empty((0, order), np.uint32), np.empty(0, np.int64)
    mark = codes == ord(MARK)
    real = ~mark[order - 1 :]
    if order > 1:
        real |= ~mark[order - 2 : -1]
    there = np.zeros(0x110000, dtype=bool)
    there[codes] = True
    alphabet = np.flatnonzero(there).astype(np.uint32)
    bits = max(1, (len(alphabet) - 1).bit_length())
    if bits * order > 64:
        windows = np.lib.stride_tricks.sliding_window_view(codes, order)[real]
        return np.unique(windows, axis=0, return_counts=True)
    place = np.zeros(0x110000, dtype=np.uint64)
    place[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    dense = place[codes]
    keys = np.zeros(n, dtype=np.uint64)
    for i in range(order):
        keys = keys << np.uint64(bits) | dense[i : i + n]
    keys, counts = np.unique(keys[real], return_counts=True)
    low = np.uint64((1 << bits) - 1)
    columns = [alphabet[(keys >> np.uint64(bits * (order - 1 - i)) & low).astype(np.int64)] for i in range(order)]
    return np.stack(columns, axis=1), counts


def _counted(order: int):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def rows(lang: str, text: str) -> pa.RecordBatch:
        windows, counts = count_windows(code_points(text), order)
        grams = np.ascontiguousarray(windows).view(f"<U{order}").ravel()
        arrays = [pa.array([lang]).take(pa.array(np.zeros(len(grams), np.int64))), pa.array(grams, pa.string()), pa.array(counts)]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = defaultdict(list)
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    words = words_of(text)
                    if not words:
                        continue
                    marked = list(pieces(normal(words), order))
                    if len(marked) > 1:  # only the first piece starts with marks: each alone
                        yield from (rows(lang, piece) for piece in marked)
                        continue
                    held[lang] += marked
                    size += len(marked[0])
                    if size >= HELD_CHARS:
                        yield from (rows(lang, "".join(texts)) for lang, texts in held.items())
                        held.clear()
                        size = 0
        yield from (rows(lang, "".join(texts)) for lang, texts in held.items())

    return run


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, n``: every n-gram of every text with its count; a null language is ``''``.

    Tasks count before the shuffle; the rows are distinct n-grams, so no key is hot.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    sent = texts.mapInArrow(_counted(order), "lang STRING, gram STRING, n BIGINT")
    return sent.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# The model


def _discounts(level: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3, types``: modified discounts from the counts of counts, and the number of distinct n-grams.

    Where too few counts of one to four occur for an estimate in order, the discounts are 0.5, 1 and 1.5.
    """
    t = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"t{i}") for i in range(1, 5)]
    rows = level.groupBy("lang").agg(*t, F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("types"))
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
    parts = [i - (i + 1) * F.try_divide(y * F.col(f"t{i + 1}"), F.col(f"t{i}")) for i in range(1, 4)]
    sound = F.lit(True)
    for i, d in enumerate(parts, 1):
        sound = sound & (F.col(f"t{i}") > 0) & (d >= 0) & (d <= i)
    sound = F.coalesce(sound, F.lit(False))
    return rows.select(
        "lang", "types", *(F.when(sound, d).otherwise(F.lit(i / 2)).alias(f"d{i}") for i, d in enumerate(parts, 1))
    )


def _probabilities(level: DataFrame, lower: DataFrame | None) -> DataFrame:
    """``lang, gram, p`` of one order from its counts (``n`` may be 0) and the order below (None: uniform)."""
    n = F.col("n")
    context = F.expr("substring(gram, 1, length(gram) - 1)")
    level = level.withColumn("context", context)
    contexts = level.groupBy("lang", "context").agg(
        F.sum("n").alias("total"),
        *(F.sum(F.when(n == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2)),
        F.sum(F.when(n > 2, 1).otherwise(0)).alias("n3"),
    )
    rated = join_hot(contexts, _discounts(level), "lang", F.xxhash64("context"))
    freed = sum((F.col(f"d{i}") * F.col(f"n{i}") for i in (2, 3)), F.col("d1") * F.col("n1"))
    rated = rated.withColumn("backoff", F.coalesce(F.try_divide(freed, F.col("total")), F.lit(1.0)))
    discount = F.when(n > 2, F.col("d3")).when(n == 2, F.col("d2")).when(n == 1, F.col("d1")).otherwise(0.0)
    own = F.coalesce(F.try_divide(F.greatest(n - discount, F.lit(0.0)), F.col("total")), F.lit(0.0))
    joined = level.join(rated, ["lang", "context"])
    if lower is None:
        below = F.lit(1.0) / (F.col("types") + 1)
    else:
        suffix = F.expr("substring(gram, 2)")
        joined = joined.withColumn("suffix", suffix).join(lower.withColumnRenamed("gram", "suffix"), ["lang", "suffix"])
        below = F.col("p")
    return joined.select("lang", "gram", (own + F.col("backoff") * below).alias("p"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, p``: interpolated modified Kneser-Ney probability of the last character after those before it.

    ``counts(lang, gram, n)`` has each n-gram once; one with a count of 0 gets its probability and takes no other part.
    Below the highest order an n-gram counts its distinct left neighbours. A character that a language never shows has
    the share ``1 / (distinct characters + 1)`` below all orders.
    """
    levels = [counts]
    for _ in range(order - 1):
        higher = levels[-1].select("lang", F.expr("substring(gram, 2)").alias("gram"), (F.col("n") > 0).alias("seen"))
        n = F.sum(F.when(F.col("seen"), 1).otherwise(0)).alias("n")
        levels.append(cut_lineage(higher.groupBy("lang", "gram").agg(n)))
    found = None
    for level in reversed(levels):
        found = cut_lineage(_probabilities(level, found))
    return found


def _hashed(order: int):
    def work(langs: list[str], grams: list[str]) -> list[np.ndarray]:
        codes = code_points("".join(grams)).reshape(len(grams), order)
        names, place = np.unique(np.array(langs, dtype=object), return_inverse=True)
        out = np.empty(len(grams), dtype=np.uint64)
        for i, lang in enumerate(names):
            out[place == i] = gram_hashes(list(codes[place == i].T), lang)
        return [out.view(np.int64)]

    return work


def store_model(model: DataFrame, order: int = ORDER, shard_grams: int = SHARD_GRAMS) -> tuple[str, int]:
    """Writes ``lang, gram, p`` as shards of sorted hashes with log probabilities; gives the path and how many."""
    shards = max(1, -(-model.count() // shard_grams))
    hashed = map_columns(model, ["lang", "gram"], lambda: _hashed(order), "hash BIGINT", ["p"])
    placed = hashed.select("hash", F.log("p").cast("float").alias("log_p"), F.pmod("hash", F.lit(shards)).alias("shard"))
    path = scratch_path(model.sparkSession, "grams")
    placed.repartition("shard").sortWithinPartitions("shard", "hash").write.partitionBy("shard").parquet(path)
    return path, shards


class GramArrays:
    """One shard: sorted hashes and the log probability of each, with the place where each leading part begins."""

    def __init__(self, hashes: np.ndarray, log_p: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.log_p = np.append(log_p[order], np.float32(0))
        self.hashes = np.append(hashes[order], np.uint64(2**64 - 1))
        bits = len(hashes).bit_length()
        self.shift = np.uint64(64 - bits) if bits else np.uint64(63)
        leads = np.arange(1 << max(bits, 1), dtype=np.uint64) << self.shift
        self.first = np.searchsorted(self.hashes, leads).astype(np.int32)

    def sums(self, hashes: np.ndarray) -> tuple[float, float]:
        """Of the log probabilities of those that are here and of their squares; others belong to other shards."""
        at = self.first[hashes >> self.shift]
        behind = np.flatnonzero(self.hashes[at] < hashes)
        while len(behind):  # hashes are even: about one lies between a leading part and its place
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < hashes[behind]]
        here = self.hashes[at] == hashes
        found = self.log_p[at[here] if not here.all() else at].astype(np.float64)
        return float(found.sum()), float(found @ found)


def load_shard(df: DataFrame, path: str, shard: int) -> GramArrays:
    """At most about ``shard_grams`` rows come to the driver, which hands them to the tasks."""
    stored = df.sparkSession.read.schema("hash BIGINT, log_p FLOAT, shard INT").parquet(path)
    rows = stored.where(F.col("shard") == shard).select("hash", "log_p").toArrow()
    return GramArrays(rows.column("hash").to_numpy().view(np.uint64), rows.column("log_p").to_numpy())


def _scorer(shard, order: int):
    """Of one shard: the base figures, the number of n-grams of a text, the sums of their log probabilities here and of
    the squares, and a digest that equal texts share."""

    def work(langs: list[str], texts: list[str | None]) -> list[list]:
        arrays, out = shard.value, []
        for lang, text in zip(langs, texts):
            words = words_of(text)
            joined = normal(words)
            total = squares = 0.0
            for piece in pieces(joined, order) if words else ():
                more, more_squares = arrays.sums(window_hashes(code_points(piece), order, lang))
                total, squares = total + more, squares + more_squares
            digest = xxhash.xxh3_128_digest(text.encode()) if text is not None else None
            out.append((*base_figures(text, words), len(joined) + 1 if words else 0, total, squares, digest))
        return [list(c) for c in zip(*out)] or [[] for _ in range(10)]

    return work


def _scored(docs: DataFrame, path: str, shards: int, order: int) -> DataFrame:
    """``doc_id, lang, BASE, grams, log_p, squares`` of every row; one pass over the texts for each shard of the model."""
    context = docs.sparkSession.sparkContext
    added = f"{BASE}, grams BIGINT, log_p DOUBLE, squares DOUBLE, digest BINARY"
    sums = ("log_p", "squares")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text"
    )
    scored = None
    for shard in range(shards):
        sent = context.broadcast(load_shard(docs, path, shard))

        def make(sent=sent):
            return _scorer(sent, order)

        part = map_columns(texts, ["lang", "text"], make, added, ["doc_id", "lang"])
        if shards > 1:
            part = cut_lineage(part)
            if scored is not None:  # equal rows have equal sums
                key = ["doc_id", "lang", "digest"]
                more = part.groupBy(*key).agg(*(F.first(c).alias(f"more_{c}") for c in sums)).alias("b")
                same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
                joined = scored.alias("a").join(more, same[0] & same[1] & same[2])
                rest = [F.col(f"a.{c}") for c in scored.columns if c not in sums]
                part = cut_lineage(joined.select(*rest, *((F.col(c) + F.col(f"more_{c}")).alias(c) for c in sums)))
        scored = part
    return scored.drop("digest")


def bands(scored: DataFrame, fence: float = FENCE) -> DataFrame:
    """``lang, low, high, spread``: where the log perplexities of a language's long texts may lie.

    Quartiles over all documents of ``scored`` that pass the base rules, ``fence`` interquartile ranges to either side;
    ``spread`` is the standard deviation of the log probability of a character.
    """
    value = F.when(~F.col("base_failed"), F.col("log_perplexity"))
    mean, square = (F.try_divide(F.sum(c), F.sum("grams")) for c in ("log_p", "squares"))
    rows = scored.groupBy("lang").agg(
        F.percentile_approx(value, [0.25, 0.75], 10000).alias("q"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("spread")
    )
    low, high = F.col("q")[0], F.col("q")[1]
    reach = (high - low) * fence
    return rows.select("lang", (low - reach).alias("low"), (high + reach).alias("high"), "spread")


def judge(docs: DataFrame, order: int = ORDER, fence: float = FENCE, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """``doc_id``, the base figures, ``perplexity``, the band ``low, high`` and ``kept`` of every row of ``docs``.

    ``order`` is 2 or more. The model is counted on all of ``docs`` and every text is read whole. A document is kept when it passes the base
    rules and its perplexity, that of a character, lies within the band of its language, ends included; both ends are
    ``CHANCE`` standard errors wider for a text of its length, as the perplexity of a short text is a matter of luck. A null text has
    no words; a text without words has no perplexity and fails the base rules. A null language is one of its own, with
    ``''``. Rows listed twice count twice and come back twice; a null id is like any other. An empty table gives no rows.
    Other columns play no part.
    """
    counts = cut_lineage(count_grams(docs, order))
    path, shards = store_model(kneser_ney(counts, order), order, shard_grams)
    rows = _scored(docs, path, shards, order)
    rows = cut_lineage(rows.withColumn("log_perplexity", -F.try_divide("log_p", "grams")))
    judged = join_hot(rows, bands(rows, fence), "lang", F.xxhash64("doc_id", "log_p"))
    error = F.coalesce(CHANCE * F.try_divide("spread", F.sqrt("grams")), F.lit(0.0))
    judged = judged.withColumn("low", F.col("low") - error).withColumn("high", F.col("high") + error)
    inside: Column = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), F.exp("log_perplexity").alias("perplexity"),
        F.exp("low").alias("low"), F.exp("high").alias("high"),
    )
