"""The n-gram model against one written with dictionaries, and the base rules against plain loops."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kgspark.llm import perplexity

DOCS = "doc_id BIGINT, text STRING, lang STRING, gram STRING, low DOUBLE, kept BOOLEAN"

ROWS = [
    (0, "the cat sat on the mat and the dog sat on the log while it rained and rained all day", "en"),
    (1, "a cat and a dog met on the road to the old town where the mill stood by the water", "en"),
    (2, "le chat est sur la table et le chien dort dans la cour depuis ce matin sans bouger", "fr"),
    (3, None, "en"),
    (4, "", None),
    (5, " \t\n ", "en"),
    (6, "one two three four five one two three four five\none two\none two\n \n", "en"),
    (7, "$$ ## the the the the the the the the the the the the the the", None),
    (8, "漢字 仮名 \U0001f600 zero\0byte line break x\x1cy end " * 3, "ja"),
    (8, "漢字 仮名 \U0001f600 zero\0byte line break x\x1cy end " * 3, "ja"),
    (None, "the cat sat on the mat and the dog sat on the log while it rained", "en"),
    (9, "short text", "en"),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), symbols, dup, len(covered), failed


def marked(text, order):
    joined = " ".join(words(text)).replace("\0", "�")
    return "\n" * (order - 1) + joined + "\n" if joined else ""


class Plain:
    """Interpolated modified Kneser-Ney of one language."""

    def __init__(self, texts, order):
        self.counts = {k: Counter() for k in range(1, order + 1)}
        for text in texts:
            s = marked(text, order)
            for i in range(order, len(s) + 1):
                self.counts[order][s[i - order : i]] += 1
        for k in range(order - 1, 0, -1):
            for gram in self.counts[k + 1]:
                self.counts[k][gram[1:]] += 1
        self.discounts = {k: self._discounts(c) for k, c in self.counts.items()}
        self.order = order

    @staticmethod
    def _discounts(counts):
        t = Counter(counts.values())
        try:
            y = t[1] / (t[1] + 2 * t[2])
            d = [i - (i + 1) * y * t[i + 1] / t[i] for i in (1, 2, 3)]
        except ZeroDivisionError:
            return [0.5, 1.0, 1.5]
        return d if t[4] >= 0 and all(0 <= x <= i for i, x in enumerate(d, 1)) else [0.5, 1.0, 1.5]

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.counts[1]) + 1)
        followers = [n for g, n in self.counts[k].items() if g[:-1] == gram[:-1]]
        if not followers:
            return self.p(gram[1:])
        d, n, total = self.discounts[k], self.counts[k][gram], sum(followers)
        own = max(n - (d[min(n, 3) - 1] if n else 0), 0) / total
        freed = sum(d[min(f, 3) - 1] for f in followers) / total
        return own + freed * self.p(gram[1:])


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, "clash", 1.0, True) for r in ROWS], DOCS)


def test_counts_are_those_of_all_texts(spark, frame):
    for order in (2, 5):
        expected = defaultdict(int)
        for _, text, lang in ROWS:
            s = marked(text, order)
            for i in range(order, len(s) + 1):
                expected[lang or "", s[i - order : i]] += 1
        got = {(r["lang"], r["gram"]): r["n"] for r in perplexity.count_grams(frame, order).collect()}
        assert got == dict(expected)


def test_probabilities_equal_the_plain_model(spark, frame):
    order = 3
    model = Plain([t for _, t, lang in ROWS if lang == "en"], order)
    counts = perplexity.count_grams(frame, order)
    unseen = spark.createDataFrame([("en", "thq", 0), ("en", "qqq", 0), ("en", "zat", 0)], counts.schema)
    found = {r["gram"]: r["p"] for r in perplexity.kneser_ney(counts.union(unseen), order).where("lang = 'en'").collect()}
    assert set(found) == set(model.counts[order]) | {"thq", "qqq", "zat"}
    for gram, p in found.items():
        if "q" in gram:  # a character that the language never shows also widens the alphabet of neither model
            continue
        assert p == pytest.approx(model.p(gram), rel=1e-9), gram
    by_context = defaultdict(float)
    for gram in model.counts[order]:
        by_context[gram[:-1]] += found[gram]
    assert all(total < 1 + 1e-9 for total in by_context.values())


def test_judge_against_the_plain_model(spark, frame):
    order = 3
    models = {lang: Plain([t for _, t, x in ROWS if (x or "") == lang], order) for lang in {r[2] or "" for r in ROWS}}
    expected = []
    for i, text, lang in ROWS:
        s = marked(text, order)
        logs = [math.log(models[lang or ""].p(s[j - order : j])) for j in range(order, len(s) + 1)]
        expected.append((i, *base(text), math.exp(-sum(logs) / len(logs)) if logs else None))
    for shard_grams in (1 << 20, 60):  # one shard of the model, and many
        judged = perplexity.judge(frame, order, shard_grams=shard_grams).collect()
        got = [tuple(r)[:7] + (r["perplexity"],) for r in judged]
        assert sorted(map(repr, (g[:7] for g in got))) == sorted(map(repr, (e[:7] for e in expected)))
        for g, e in zip(sorted(got, key=repr), sorted(expected, key=repr)):
            assert g[7] == (None if e[7] is None else pytest.approx(e[7], rel=1e-5))
        for r in judged:
            inside = r["perplexity"] is not None and r["low"] is not None and r["low"] <= r["perplexity"] * (1 + 1e-12)
            inside = inside and r["perplexity"] <= r["high"] * (1 + 1e-12)
            assert r["kept"] == (not r["base_failed"] and inside)


def test_long_text_is_scored_whole(spark):
    random = np.random.default_rng(3)
    long = " ".join("".join(random.choice(list("abcde"), 4)) for _ in range(30_000))
    for order, most in ((2, 7), (5, 3), (5, 1000)):
        head = long[:1999]
        whole = marked(head, order)
        windows = [whole[i - order : i] for i in range(order, len(whole) + 1)]
        cut = []
        for piece in perplexity.pieces(head, order, most):
            cut += [piece[i - order : i] for i in range(order, len(piece) + 1)]
        assert cut == windows
    df = spark.createDataFrame([(1, long, "en"), (2, long[:5000], "en")], "doc_id BIGINT, text STRING, lang STRING")
    got = {r["doc_id"]: r for r in perplexity.judge(df).collect()}
    assert got[1]["n_words"] == 30_000 and got[1]["perplexity"] > 1


def test_gibberish_lies_outside_the_band(spark):
    random = np.random.default_rng(4)
    known = ["river", "stone", "mill", "water", "bridge", "walks", "under", "over", "green", "garden", "morning", "quiet"]
    rows = [(i, " ".join(random.choice(known, 60)), "en") for i in range(300)]
    rows += [(1000, " ".join("".join(random.choice(list("qxzjkvw"), 7)) for _ in range(60)), "en")]
    judged = perplexity.judge(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")).collect()
    assert [r["doc_id"] for r in judged if not r["kept"] and not r["base_failed"]] == [1000]


def test_a_wide_alphabet_and_empty_tables(spark):
    codes = np.arange(0x4E00, 0x4E00 + 6000, dtype=np.uint32)
    text = "\n" * 4 + codes.tobytes().decode("utf-32-le") + "\n"
    windows, counts = perplexity.count_windows(perplexity.code_points(text), 5)
    assert len(windows) == 6001 and set(counts.tolist()) == {1}
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING, lang STRING")
    assert perplexity.judge(empty).collect() == []
    nulls = spark.createDataFrame([(None, None, None)], "doc_id BIGINT, text STRING, lang STRING")
    assert [(r["n_words"], r["kept"], r["perplexity"]) for r in perplexity.judge(nulls).collect()] == [(0, False, None)]
