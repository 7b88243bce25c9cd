"""Which of many names a text contains, as an equi join on each name's rarest piece.

A name is looked for only where the rarest of its pieces (tokens, or character n-grams) occurs, by the number of texts
that hold the piece. Texts meet names on that key alone, and whole names are verified on what is left. The sides of that
join come straight from a shuffle, so adaptive execution splits a key that very many texts share; there is no cross join
and no broadcast hint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import cut_lineage, dealt
from .hot_keys import join_crowded

GRAM = 3

# Scripts that put no spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
MAYBE_UNSPACED = r"[\u0E00-\u1FFF\u2E80-\uFFFF\x{10000}-\x{10FFFF}]"  # quick to tell, and true of each of these
SPACED = rf"[\p{{L}}\p{{N}}_&&[^{UNSPACED[1:-1]}]]"
PLAIN = r"[\p{L}\p{N}_]"  # the same, and much quicker, in texts without a character of those scripts


def comparable(text: Column | str) -> Column:
    """Lower case, with every run of white space as one space; null gives ``''``."""
    return t.collapse(F.lower(t.or_empty(text)))


def word_pieces(text: Column) -> Column:
    """Distinct words of spaced scripts, and the characters and pairs of neighbours of unspaced ones."""
    words = F.regexp_extract_all(text, F.lit(f"({SPACED}+)"), 1)
    plain = F.regexp_extract_all(text, F.lit(f"({PLAIN}+)"), 1)
    pairs = F.regexp_extract_all(text, F.lit(f"(?=({UNSPACED}{UNSPACED}))"), 1)
    single = F.regexp_extract_all(text, F.lit(f"({UNSPACED})"), 1)
    return F.array_distinct(F.when(text.rlike(MAYBE_UNSPACED), F.concat(words, pairs, single)).otherwise(plain))


def gram_pieces(text: Column, lengths: Sequence[int]) -> Column:
    """Distinct substrings of the given lengths."""

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        cut = F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of_length, lengths)))


def rarest_pieces(names: DataFrame, pieces: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, name, piece``: of each name the piece that the fewest texts hold; names with a piece in no text are left out.

    ``names`` has ``by, name, pieces``, ``pieces`` has ``by, piece`` once for every text that holds it. Texts are counted
    before the shuffle.
    """
    held = pieces.groupBy(*by, "piece").agg(F.count(F.lit(1)).alias("texts"))
    own = names.select(*by, "name", F.size("pieces").alias("wanted"), F.explode("pieces").alias("piece"))
    found = join_crowded(own, held, [*by, "piece"]).groupBy(*by, "name", "wanted")
    rarest = found.agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("texts", "piece")).alias("rarest"))
    return rarest.where("found = wanted").select(*by, "name", F.col("rarest.piece").alias("piece"))


def candidates(texts: DataFrame, keys: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, text_id, name`` pairs that share the name's key, from ``texts(by, text_id, piece)``."""
    return texts.join(keys, [*by, "piece"]).select(*by, "text_id", "name")


def _quoted(name: Column, word: str) -> Column:
    """A pattern for the name as it stands, with a word edge behind it where it ends in a word of a spaced script."""
    plain = F.regexp_replace(name, r"([^\p{L}\p{N}_ ])", r"\\$1")
    return F.concat(plain, F.when(name.rlike(f"{word}$"), F.lit(f"(?!{word})")).otherwise(""))


def _either(names: Column, word: str) -> Column:
    """A pattern for any of the names, the first in order where several fit; ``word`` is the class of word characters.

    Names that start in a word of a spaced script share one look for the edge before them; no other name can fit there.
    """
    starts = f"^{word}"
    quoted = lambda n: _quoted(n, word)
    words = F.array_join(F.transform(F.filter(names, lambda n: n.rlike(starts)), quoted), "|")
    others = F.array_join(F.transform(F.filter(names, lambda n: ~n.rlike(starts)), quoted), "|")
    edged = F.when(words != "", F.concat(F.lit(f"(?<!{word})(?:"), words, F.lit(")")))
    return F.concat_ws("|", edged, F.when(others != "", others))


def build_mentions(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``chunk_id, node_id, n``: how often each chunk names each node, by its name or an alias.

    Case and runs of white space make no difference. A name counts at word edges; scripts without spaces have none. A
    chunk is read from the left: at each place the longest name that fits counts, and reading goes on behind it, so a
    name inside or across a longer one is not counted again. Of names without a letter or digit nothing is known. A name
    that several nodes bear counts for all of them. Chunks with a null id are left out, a null text names nothing; the
    texts of a chunk id listed twice count together.
    """
    given = chunks.where("chunk_id IS NOT NULL").select(F.col("chunk_id").alias("text_id"), "text")
    words = cut_lineage(dealt(given).select("text_id", comparable("text").alias("text")))
    borne = (
        nodes.where("id IS NOT NULL")
        .select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
        .select("id", comparable("name").alias("name"))
        .distinct()
    )
    names = borne.select("name").distinct().withColumn("pieces", word_pieces(F.col("name"))).where(F.size("pieces") > 0)
    pieces = words.select("text_id", F.explode(word_pieces(F.col("text"))).alias("piece"))
    met = candidates(pieces, rarest_pieces(names, pieces)).distinct()
    held = met.join(words, "text_id").where(F.contains("text", F.col("name"))).select("text_id", "name")
    longest_first = F.array_sort(F.collect_set(F.struct((-F.length("name")).alias("shortness"), "name")))
    listed = held.groupBy("text_id").agg(F.transform(longest_first, lambda x: x["name"]).alias("names"))
    pattern = F.when(F.col("text").rlike(MAYBE_UNSPACED), _either(F.col("names"), SPACED)).otherwise(_either(F.col("names"), PLAIN))
    read = words.join(listed, "text_id").withColumn("pattern", pattern).select(
        "text_id", F.explode(F.expr("regexp_extract_all(text, pattern, 0)")).alias("name")
    )
    counted = read.groupBy("text_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.join(borne, "name")
        .groupBy(F.col("text_id").alias("chunk_id"), F.col("id").alias("node_id"))
        .agg(F.sum("n").alias("n"))
    )


def containing(texts: DataFrame, names: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, text, name``: the distinct texts and names of equal ``by`` where the name occurs anywhere in the text.

    ``texts(by, text)`` and ``names(by, name)`` are compared as they are. Names shorter than ``GRAM`` are their own key,
    longer ones have that of their rarest ``GRAM`` characters. An empty name is in no text.
    """
    names = names.where("name <> ''").select(*by, "name").distinct()
    texts = texts.where("text <> ''").select(*by, "text").distinct()
    own = F.when(F.length("name") < GRAM, F.array("name")).otherwise(gram_pieces(F.col("name"), [GRAM]))
    lengths = [r[0] for r in names.select(F.least(F.length("name"), F.lit(GRAM))).distinct().collect()]  # GRAM at most
    keyed = texts.withColumn("text_id", F.unhex(F.md5("text")))
    pieces = keyed.select(*by, "text_id", F.explode(gram_pieces(F.col("text"), lengths or [GRAM])).alias("piece"))
    met = candidates(pieces, rarest_pieces(names.withColumn("pieces", own), pieces, by), by)
    return met.join(keyed, [*by, "text_id"]).where(F.contains("text", F.col("name"))).select(*by, "text", "name")


def contained(texts: DataFrame, names: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, name``: the names that occur in some text of equal ``by``; see ``containing``."""
    return containing(texts, names, by).select(*by, "name").distinct()
