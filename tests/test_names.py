"""Mentions, contained names, similar concepts and synonyms against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kgspark.operators import containment, similar

CHUNKS = "chunk_id STRING, text STRING, name STRING, piece STRING, salt INT"
NODES = "id STRING, name STRING, aliases ARRAY<STRING>"
CONCEPTS = (
    "seq BIGINT, id STRING, name STRING, type STRING, description STRING, aliases ARRAY<STRING>, chapter STRING, scope STRING"
)

UNSPACED = "一-鿿぀-ヿ฀-๿"
WORD = rf"[^\W{UNSPACED}]"


def plain(x):
    return re.sub(r"\s+", " ", (x or "").lower()).strip()


def brute_mentions(chunks, nodes):
    borne = defaultdict(set)
    for i, name, aliases in nodes:
        for n in [name, *(aliases or [])]:
            if i is not None and re.search(r"\w", plain(n)):
                borne[plain(n)].add(i)

    def fits(text, at, name):
        if not text.startswith(name, at):
            return False
        if re.match(WORD, name) and at and re.match(WORD, text[at - 1]):
            return False
        end = at + len(name)
        return not (re.match(WORD, name[-1]) and end < len(text) and re.match(WORD, text[end]))

    out = Counter()
    for chunk, text in chunks:
        text, at = plain(text), 0
        while chunk is not None and at < len(text):
            found = [n for n in borne if fits(text, at, n)]
            if found:
                name = max(found, key=len)
                for i in borne[name]:
                    out[chunk, i] += 1
                at += len(name)
            else:
                at += 1
    return dict(out)


def mentions(spark, chunks, nodes):
    df = spark.createDataFrame([(c, x, "clash", "clash", 1) for c, x in chunks], CHUNKS)
    found = containment.build_mentions(df, spark.createDataFrame(nodes, NODES)).collect()
    got = {(r["chunk_id"], r["node_id"]): r["n"] for r in found}
    assert len(got) == len(found)
    return got


def test_mentions_of_all_kinds_of_names(spark):
    nodes = [
        ("n1", "Graph", ["graphs"]), ("n2", "knowledge  graph", None), ("n3", "知识图谱", ["图"]), ("n4", "C++", ["c#"]),
        ("n5", "a.b", []), ("n6", "the", None), ("n7", "图谱", None), ("n8", "graph theory of (x)", None), ("n9", "??", [""]),
        ("n10", None, ["Éa", None]), (None, "lost", None), ("n11", "GRAPH", None), ("n12", "A股", None), ("n13", "-b", None),
    ]
    chunks = [
        ("c1", "The Graph of knowledge\n graph, subgraph graphs; graph theory of (x) and C++ c# ab a.b"), ("c2", "知识图谱和图谱 图 A股"),
        ("c3", None), ("c4", ""), (None, "graph"), ("c5", "graph"), ("c5", "graph the-graph _graph graph_"), ("c6", "x-b -b éA ÉA"),
        ("c7", "the " * 5000), ("c8", "nothing here"), ("c9", "ac++ c+++ a.bc xa.b"),
    ]
    assert mentions(spark, chunks, nodes) == brute_mentions(chunks, nodes)


def test_random_mentions(spark):
    rnd = random.Random(8)
    alphabet = ["a", "b", "ab", "ba", "c", "图", "谱", "图谱", "-", "."]
    names = [(f"n{i}", "".join(rnd.choice(alphabet + [" "]) for _ in range(rnd.randrange(1, 5))), None) for i in range(60)]
    chunks = [(f"c{i}", "".join(rnd.choice(alphabet + [" ", " "]) for _ in range(40))) for i in range(80)]
    assert mentions(spark, chunks, names) == brute_mentions(chunks, names)


def test_mentions_of_empty_tables(spark):
    assert mentions(spark, [], [("n", "a", None)]) == {}
    assert mentions(spark, [("c", "a")], []) == {}


def test_a_word_of_most_chunks_is_split(spark):
    low = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        chunks = spark.range(0, 60_000, 1, 8).selectExpr(
            "concat('c', id) AS chunk_id", "CASE WHEN id % 3 > 0 THEN concat('the mill ', id % 1000) ELSE concat('a bridge ', id % 1000) END AS text"
        )
        pieces = chunks.select(F.col("chunk_id").alias("text_id"), F.explode(containment.word_pieces(F.col("text"))).alias("piece"))
        names = spark.createDataFrame([(f"{i}",) for i in range(1000)] + [("the",)], "name STRING")
        keys = containment.rarest_pieces(names.withColumn("pieces", F.array("name")), pieces)
        met = containment.candidates(pieces, keys)
        assert len(met.collect()) == 100_000
        plan = met._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_contained_equals_containment(spark):
    rnd = random.Random(6)
    names = [(rnd.choice("st"), "".join(rnd.choice("abc 机") for _ in range(rnd.randrange(0, 8)))) for _ in range(120)]
    texts = [(rnd.choice("st"), "".join(rnd.choice("abc 机") for _ in range(rnd.randrange(0, 40)))) for _ in range(30)] + [("s", None)]
    found = containment.contained(
        spark.createDataFrame(texts, "scope STRING, text STRING"), spark.createDataFrame(names, "scope STRING, name STRING"), ["scope"]
    ).collect()
    expected = {(s, n) for s, n in names for u, x in texts if s == u and n and x and n in x}
    assert sorted((r["scope"], r["name"]) for r in found) == sorted(expected)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(names, threshold):
    out = {}
    for x, y in combinations(sorted(n for n in names if n), 2):
        a, b = (x, y) if (len(x), x) > (len(y), y) else (y, x)
        if (d := distance(a, b)) <= (1 - threshold) * len(a) + 1e-9:
            out[a, b] = round(1 - d / len(a), 9)
    return out


def random_names(seed, count):
    rnd = random.Random(seed)
    seeds = ["".join(rnd.choice("abcdé机") for _ in range(rnd.randrange(1, 14))) for _ in range(count // 4)]
    names = set(seeds) | {"", "a", "aaaaaaaa", "aaaaaaa", "abababab", "babababa"}
    for s in seeds * 3:
        s = list(s)
        for _ in range(rnd.randrange(1, 4)):
            at = rnd.randrange(len(s) + 1)
            s[at : at + rnd.randrange(2)] = rnd.choice(["", "a", "机", "x"])
        names.add("".join(s))
    return sorted(names)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.8, 0.95, 1.0])
@pytest.mark.parametrize("block", [4096, 3])
def test_similar_pairs_equal_all_pairs(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(similar, "BLOCK", block)  # small blocks split every gram that names share
    names = random_names(int(threshold * 100), 160)
    df = spark.createDataFrame([(n,) for n in [*names, *names[:20], None]], "name STRING")
    found = similar.similar_pairs(df, threshold).collect()
    got = {(r["a"], r["b"]): round(r["similarity"], 9) for r in found}
    assert len(got) == len(found)
    assert got == alike(names, threshold)


def test_similar_pairs_stay_within_their_group(spark):
    df = spark.createDataFrame([("x", "graph"), ("x", "graphs"), ("y", "graph"), ("y", "grape")], "kind STRING, name STRING")
    got = [tuple(r)[:3] for r in similar.similar_pairs(df, 0.8, ["kind"]).collect()]
    assert sorted(got) == [("x", "graphs", "graph"), ("y", "graph", "grape")]
    with pytest.raises(ValueError):
        similar.similar_pairs(df, 0)


def concepts(spark, rows):
    return spark.createDataFrame(rows, CONCEPTS)


def test_merge_similar_concepts(spark):
    rows = [
        (3, "n3", "Neural networks", "T", "a longer text", ["nn"], "c", "s2"), (1, "n1", "neural network", "T", "short", ["ann"], "c", "s1"),
        (2, "n2", "neural network", "U", None, None, "c", "s1"), (4, "n4", "tree", "T", None, ["x", "x"], "d", "s1"),
        (5, "n5", None, "T", "none", None, None, None), (6, "n6", "", "T", "nothing at all", ["e"], None, None), (7, "n7", "neural  network", "T", None, None, "c", "s"),
    ]
    got = {r["id"]: r.asDict() for r in similar.merge_similar_concepts(concepts(spark, rows)).collect()}
    assert sorted(got) == ["n1", "n2", "n4", "n5"]
    assert got["n1"]["name"] == "neural network" and got["n1"]["description"] == "a longer text" and got["n1"]["scope"] == "s1"
    assert got["n1"]["aliases"] == ["Neural networks", "ann", "neural  network", "nn"]
    assert got["n4"]["aliases"] == ["x", "x"] and got["n2"]["aliases"] is None
    assert got["n5"]["description"] == "nothing at all"
    assert similar.merge_similar_concepts(concepts(spark, [])).collect() == []
    strict = similar.merge_similar_concepts(concepts(spark, rows), 1.0).collect()
    assert sorted(r["id"] for r in strict) == ["n1", "n2", "n3", "n4", "n5"]


def test_similar_groups_are_components(spark):
    names = random_names(77, 120)
    found = similar.similar_groups(spark.createDataFrame([(n,) for n in names], "name STRING"), 0.7).collect()
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in alike(names, 0.7):
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    groups = defaultdict(set)
    for n in names:
        groups[root(n)].add(n)
    assert {r["name"]: r["group_name"] for r in found} == {n: min(g) for g in groups.values() for n in g}


def test_detect_synonyms(spark):
    rows = [
        ("Neural Network", ["NN", "net"]), ("nn", None), ("Natural Number", []), ("Convolutional Neural Network", ["ConvNet"]),
        ("CNN", None), ("convnet", ["cnn model"]), ("alone", [None, " "]), ("", ["nn"]), (None, None), ("alone", None),
        *((f"item {i}", ["thing", f"only {i // 2}"]) for i in range(8)),
    ]
    df = spark.createDataFrame(rows, "name STRING, aliases ARRAY<STRING>")
    found = similar.detect_synonyms(df, most_concepts=3).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r["group_id"]].add(r["name"])
    assert all(r["size"] == len(groups[r["group_id"]]) for r in found) and len({r["name"] for r in found}) == len(found)
    assert sorted(map(sorted, groups.values())) == sorted(
        [
            ["natural number", "net", "neural network", "nn"],
            ["cnn", "cnn model", "convnet", "convolutional neural network"],
            ["alone"],
            *([f"item {i}", f"item {i + 1}", f"only {i // 2}"] for i in range(0, 8, 2)),
        ]
    )
    again = similar.detect_synonyms(df.repartition(3), most_concepts=3).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in found}
    assert similar.detect_synonyms(df.limit(0)).collect() == []


def counted(spark, df, name):
    """``df`` whose column is read through a counter of rows, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    return df.withColumn(name, F.udf(look, "string").asNondeterministic()(name)), seen


def test_each_text_is_read_once(spark):
    texts = [(f"c{i}", "The Red Pump feeds the pump" if i % 2 else "赤い pump と red_pump", "", "", 1) for i in range(20)]
    chunks, seen = counted(spark, spark.createDataFrame(texts, CHUNKS), "text")
    nodes = spark.createDataFrame([("a", "red pump", ["pump"])], NODES)
    found = {(r["chunk_id"], r["n"]) for r in containment.build_mentions(chunks, nodes).collect()}
    assert found == {(f"c{i}", 2 if i % 2 else 1) for i in range(20)}
    assert seen.value == len(texts)


def test_plain_texts_have_the_same_pieces(spark):
    texts = ["", "a-b_c 12", "éa ßx日本", "Ünï 한국어 x", "٣٤ abc", "áb"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    spaced = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({containment.SPACED}+)"), 1))
    for r in df.select("text", containment.word_pieces(F.col("text")).alias("found"), spaced.alias("spaced")).collect():
        assert set(r["spaced"]) <= set(r["found"])
        assert "日" in r["text"] or r["found"] == r["spaced"]
