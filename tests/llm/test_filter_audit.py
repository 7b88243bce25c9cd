"""The filter audit against removal in every order, one document after another."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

import pytest

from kgspark.llm import filter_audit

LABELS = "doc_id BIGINT, quality INT, toxic INT"
DOCS = "doc_id BIGINT, text STRING, lang STRING, mask INT, part STRING, n BIGINT"

LONG = " ".join(f"word{i}" for i in range(120))
REPEATED = " ".join("again" for _ in range(150))
SHOUTED = " ".join(f"WORD{i}" for i in range(110))
SYMBOLS = LONG + " 5 $"


def failures(rows):
    ids = defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            ids[text or ""].append(i)
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": i is not None and min(ids[text]) < i,
        }
        out.append({f for f, bad in fails.items() if bad})
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = failures(rows)
    out = {}
    parts = {lang or "" for *_, lang in rows}
    for part in parts:
        held = [(i, f) for (i, _, lang), f in zip(rows, fails) if (lang or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = held
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(gone)
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(letter in f for _, f in held) - len(gone),
                    sum(f == {letter} for _, f in held),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, 7, "clash", 1) for i, t, lang in rows], DOCS)
    found = filter_audit.audit_filters(docs, spark.createDataFrame(labels, LABELS)).collect()
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in found}
    assert len(got) == len(found)
    return got


def test_intervals_cover_each_order_once():
    for mask in range(1, 32):
        steps = {}
        for step, first, end in filter_audit.removal_intervals(mask, 5):
            for rank in range(first, end):
                assert rank not in steps
                steps[rank] = step
        expected = {}
        for rank, order in enumerate(permutations(range(5))):
            expected[rank] = next(s for s, letter in enumerate(order, 1) if mask >> letter & 1)
        assert steps == expected
    assert not list(filter_audit.removal_intervals(0, 5))
    assert max(rank for _, _, rank, _ in filter_audit.interval_ends(5)) <= factorial(5)


def test_odd_rows_against_every_order(spark):
    rows = [
        (0, LONG, "en"), (1, REPEATED, "en"), (2, SHOUTED, "en"), (3, SYMBOLS, "de"), (4, None, "en"), (5, "", None),
        (6, LONG, "de"), (6, LONG, "de"), (7, LONG, "en"), (None, LONG, "en"), (None, "", ""), (8, " \t\n", "fr"),
        (9, "A|B", "fr"), (9, LONG, "fr"), (10, "a b", "fr"), (10, "a b", "fr"), (0, LONG, "en"), (-3, "a b", "en"),
        (11, "word " * 20_000 + "é é\x1c", "en"), (12, SHOUTED + " $", None), (13, SHOUTED + " $", ""),
    ]
    labels = [(0, 1, 0), (1, 0, 1), (6, 1, 1), (6, 0, 0), (9, None, 1), (None, 1, 1), (12, 1, None), (77, 1, 1), (13, 0, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_a_text_shared_by_most_rows(spark):
    rows = [(i, LONG if i % 3 else f"{LONG} {i}", "en") for i in range(300)]
    labels = [(i, i % 2, i % 5 == 0) for i in range(300)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    rows = [(1, LONG, "en")]
    assert run(spark, rows, []) == brute(rows, [])


@pytest.mark.parametrize("names", ["AB", "ABC"])
def test_other_numbers_of_filters(spark, names):
    n = len(names)
    counts = [("p", mask, mask + 1, mask % 2, 0) for mask in range(1 << n)] + [("p", 1, 5, 0, 2)]
    df = spark.createDataFrame(counts, "part STRING, mask INT, docs BIGINT, good BIGINT, toxic BIGINT")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"]) for r in filter_audit.audit(df, names).collect()}
    expected = {}
    for order in permutations(range(n)):
        left = [(m, d) for _, m, d, _, _ in counts]
        for step, letter in enumerate(order, 1):
            gone = sum(d for m, d in left if m >> letter & 1)
            left = [(m, d) for m, d in left if not m >> letter & 1]
            expected["".join(names[i] for i in order), step] = (sum(d for _, d in left), gone)
    assert got == expected
