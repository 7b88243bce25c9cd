"""Streams over several micro-batches against their batch twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from kgspark.operators import extract, telemetry
from kgspark.sources import runs
from kgspark.streaming import incremental, run_log, stateful


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def _stream(spark, df, path, batches=4):
    """Write ``df`` in time order as several files and read them one per micro-batch."""
    parts = df.orderBy("ts", "seq").collect()
    size = -(-len(parts) // batches)
    for i in range(batches):
        chunk = spark.createDataFrame(parts[i * size : (i + 1) * size], df.schema)
        chunk.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _run(spark, stream, path):
    running = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    assert running.awaitTermination(120)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _events(spark):
    kinds = ["[info] run started", '[progress] stage_start | {"stage": "a"}', '[progress] stage_end | {"stage": "a"}', "[done] ok"]
    rows = [(i, f"r{i % 3}", kinds[(i * 7 // 3) % 4], 200 if i % 5 < 2 else 500) for i in range(120)]
    return spark.createDataFrame(rows, "seq long, run_id string, message string, status_code int").withColumns(
        {"ts": F.timestamp_seconds(F.col("seq") * 100), "provider": F.lit("p"), "key_id": F.col("run_id")}
    )


def _rows(df):
    return sorted(map(str, df.collect()))


def test_stage_stream(spark, tmp_path):
    progress = extract.extract_progress(_events(spark)).select("run_id", "ts", "seq", "event", "stage")
    got = _run(spark, stateful.stage_stream(_stream(spark, progress, tmp_path / "in")), tmp_path)
    batch = telemetry.stage_durations(progress).where("ended_at IS NOT NULL")
    assert _rows(got.select("run_id", "stage", "seconds")) == _rows(batch.select("run_id", "stage", "seconds"))


def test_run_state_stream(spark, tmp_path):
    events = _events(spark).select("run_id", "ts", "seq", "message")
    got = _run(spark, stateful.run_state_stream(_stream(spark, events, tmp_path / "in")), tmp_path)
    last = got.groupBy("run_id").agg(F.max_by("status", "updated_at").alias("status"))
    assert _rows(last) == _rows(telemetry.run_states(events).select("run_id", "status"))


def test_circuit_stream(spark, tmp_path):
    calls = _events(spark).select("provider", "key_id", "ts", "seq", "status_code")
    got = _run(spark, stateful.circuit_stream(_stream(spark, calls, tmp_path / "in"), 3, 300.0), tmp_path)
    columns = ["key_id", "seq", "consecutive_failures", "state", "circuit_open_time"]
    assert _rows(got.select(*columns)) == _rows(telemetry.circuit_states(calls, 3, 300.0).select(*columns))


def test_the_rows_of_a_key_become_objects_by_the_piece():
    class Group:
        exists = False

        def update(self, state):
            self.state = state

    n = 2 * stateful.PIECE + 5
    calls = pd.DataFrame({"seq": range(n), "ok": [i % 4 == 0 for i in range(n)], "us": [i * 7 % n for i in range(n)]})
    columns = [c.split()[0] for c in stateful.CIRCUIT_ROWS.split(", ")]
    step, group = stateful._circuit_step(3, 300.0), Group()
    frames = list(stateful._at_once(step, columns, ["seq", "ok", "us"])(("p", "k"), iter([calls[:99], calls[99:]]), group))
    assert len(frames) == 3 and max(map(len, frames)) == stateful.PIECE
    state, rows = stateful._run(step, ("p", "k"), None, calls.sort_values("us").itertuples(index=False))
    assert [tuple(r) for f in frames for r in f.itertuples(index=False)] == rows and group.state == state


def test_rate_breaches_with_watermark(spark, tmp_path):
    calls = _events(spark).withColumn("ts", F.timestamp_seconds(F.col("seq") * 10)).select("provider", "ts", "seq")
    later = calls.unionByName(calls.agg(F.lit("p").alias("provider"), F.timestamp_seconds(F.lit(99999)).alias("ts"), F.lit(999).cast("long").alias("seq")))
    stream = _stream(spark, later, tmp_path / "in").withWatermark("ts", "10 minutes")
    got = _run(spark, telemetry.rate_breaches(stream, 5), tmp_path)
    assert _rows(got) == _rows(telemetry.rate_breaches(calls, 5))


def _output(seq, sub, nodes, arrows):
    lines = ["### 节点", *[f"- {n}: about {n}" for n in nodes], "### 关系", *[f"- {a} -> {b}: t" for a, b in arrows]]
    return (seq, "T", "C", sub, "en", "\n".join(lines))


def test_incremental_store(spark, tmp_path):
    schema = "seq long, topic string, chapter string, subchapter string, language string, raw string"
    path = str(tmp_path / "store")

    def add(batch_id, *rows):
        incremental.store_batch(spark, spark.createDataFrame(list(rows), schema), path, now(), batch_id)
        graph = incremental.current_graph(spark, path)
        return graph.nodes.count(), graph.edges.count()

    one = _output(1, "S1", "abc", ["ab", "bc"])
    assert add(0, one) == (3, 2)
    assert add(0, one) == (3, 2), "a repeated batch changes nothing"
    assert add(1, one, _output(2, "S2", "xy", ["xy"])) == (5, 3), "an unchanged section is skipped"
    assert add(2, _output(3, "S1", "xy", [])) == (4, 1), "a new version replaces the old one"
    book = incremental.current_book(spark, path, "book:t", "T")
    assert (book.nodes.count(), book.edges.count()) == (2, 1), "equal concepts of two sections are one"


def test_last_line_of_an_output_wins(spark, tmp_path):
    from pyspark.sql import functions as F

    from kgspark.streaming import incremental

    raw = "## 知识图谱\n### 节点\n- A: first\n- B: x\n- A: second\n### 关系\n- A -> B: part_of\n### 层次结构\n- A\n"
    columns = "seq long, topic string, chapter string, subchapter string, language string, raw string"
    outputs = spark.createDataFrame([(1, "t", "c", "s", "en", raw)], columns)
    incremental.store_batch(spark, outputs, str(tmp_path), F.current_timestamp(), 0)
    graph = incremental.current_graph(spark, str(tmp_path))
    assert {r["name"]: r["description"] for r in graph.nodes.collect()} == {"A": "second", "B": "x"}
    assert graph.edges.count() == 1


def test_malformed_outputs_are_rejected_and_change_nothing(spark, tmp_path):
    schema = "seq long, topic string, chapter string, subchapter string, language string, raw string"
    path, target = str(tmp_path / "store"), str(tmp_path / "compacted")

    def add(batch_id, *rows):
        incremental.store_batch(spark, spark.createDataFrame(list(rows), schema), path, now(), batch_id)
        return names(path)

    def names(where):
        graph = incremental.current_graph(spark, where)
        return sorted(r["name"] for r in graph.nodes.collect()), graph.edges.count()

    bad = "### 节点\n- x: x\n### 关系\n- broken: a -> b"
    assert add(0, _output(1, "S1", "ab", ["ab"])) == (["a", "b"], 1)
    assert add(1, (2, "T", "C", "S1", "en", bad), _output(3, "S2", "x", [])) == (["a", "b", "x"], 1)
    assert add(2, _output(4, "S1", "cd", ["cd"]), (5, "T", "C", "S1", "en", bad)) == (["c", "d", "x"], 1)
    rejects = incremental.rejected_outputs(spark, path).select("seq", "reason", "batch").collect()
    assert sorted(map(tuple, rejects)) == [(2, "bad_relation_line", 1), (5, "bad_relation_line", 2)]
    incremental.compact(spark, path, target)
    assert names(target) == (["c", "d", "x"], 1)
    assert spark.read.parquet(f"{target}/nodes").count() == 3 < spark.read.parquet(f"{path}/nodes").count()
    assert spark.read.parquet(f"{target}/rejects").count() == 2


def test_display_merge_of_built_graphs(spark):
    from kgspark.operators import merge
    from kgspark.plans.graph_build import build_section_graphs

    schema = "seq long, topic string, chapter string, subchapter string, language string, raw string"
    outputs = spark.createDataFrame([_output(1, "S1", "abc", ["ab", "bc"]), _output(2, "S2", "ab", ["ab"])], schema)
    built = build_section_graphs(outputs, now())
    shown = merge.merge_graphs_display(built.nodes, built.edges, built.sections)
    total = shown.summary.collect()[0]
    assert total["total_nodes"] == shown.nodes.count() and total["total_edges"] == shown.edges.count() > 0


SENTINEL = 10**9  # an event long after all others lets the watermark pass them


def _shuffled(spark, df, path, hours, batches=6, seed=4, **sentinel):
    """Rows in files of disturbed order: each comes at most some hours of event time too late, and one comes last of all."""
    import random

    rnd = random.Random(seed)
    rows = sorted(df.collect(), key=lambda r: r["ts"].timestamp() + rnd.random() * hours * 3600 * 0.9)
    rows = [tuple(r) for r in rows]
    names = df.columns
    last = [sentinel.get(n, f"z{n}") if t == "string" else SENTINEL if n == "seq" else None for n, t in df.dtypes]
    last = [v if n != "ts" else spark.sql(f"SELECT timestamp_seconds({SENTINEL})").first()[0] for n, v in zip(names, last)]
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = rows[i * size : (i + 1) * size] + ([tuple(last)] if i == batches - 1 else [])
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _hourly(spark):
    # a stream starts with its watermark at the beginning of 1970: nothing may lie there
    return _events(spark).withColumn("ts", F.timestamp_seconds(F.col("seq") * 1000 + 86_400))


def test_late_rows_give_the_stages_of_the_batch(spark, tmp_path):
    progress = extract.extract_progress(_hourly(spark)).select("run_id", "ts", "seq", "event", "stage")
    stream = _shuffled(spark, progress, tmp_path / "in", 3, event="stage_end")
    got = _run(spark, stateful.stage_stream(stream, "3 hours"), tmp_path)
    batch = telemetry.stage_durations(progress).where("ended_at IS NOT NULL")
    assert _rows(got.select("run_id", "stage", "started_at", "seconds")) == _rows(batch.select("run_id", "stage", "started_at", "seconds"))
    assert got.count() > 10


def test_late_rows_give_the_run_states_of_the_batch(spark, tmp_path):
    events = _hourly(spark).select("run_id", "ts", "seq", "message")
    stream = _shuffled(spark, events, tmp_path / "in", 3, message="[info] run started")
    got = _run(spark, stateful.run_state_stream(stream, "3 hours"), tmp_path)
    last = got.where("run_id LIKE 'r%'").groupBy("run_id").agg(F.max_by("status", "updated_at").alias("status"))
    assert _rows(last) == _rows(telemetry.run_states(events).select("run_id", "status"))


def test_late_rows_give_the_circuits_of_the_batch(spark, tmp_path):
    calls = _hourly(spark).select("provider", "key_id", "ts", "seq", "status_code")
    stream = _shuffled(spark, calls, tmp_path / "in", 3)
    got = _run(spark, stateful.circuit_stream(stream, 3, 3000.0, "3 hours"), tmp_path).where(F.col("seq") != SENTINEL)
    columns = ["key_id", "seq", "consecutive_failures", "state", "circuit_open_time"]
    assert _rows(got.select(*columns)) == _rows(telemetry.circuit_states(calls, 3, 3000.0).select(*columns))


def test_a_run_without_lines_is_forgotten(spark, tmp_path):
    rows = [(1, "a", "[info] run started", 0), (2, "a", "[done] ok", 100), (3, "b", "[info] run started", 100_000),
            (4, "a", "[info] run started", 200_000), (5, "c", "[info] run started", 900_000)]
    events = spark.createDataFrame(rows, "seq long, run_id string, message string, s long").select(
        "run_id", F.timestamp_seconds(F.col("s") + 86_400).alias("ts"), "seq", "message"
    )
    got = _run(spark, stateful.run_state_stream(_stream(spark, events, tmp_path / "in", 5), "10 seconds", 3600.0), tmp_path)
    assert sorted((r["run_id"], r["status"]) for r in got.collect()) == [
        ("a", "running"), ("a", "running"), ("a", "succeeded"), ("b", "running")
    ]


def test_split_late_keeps_every_row(spark, tmp_path):
    from kgspark.streaming import late

    schema = "seq long, run_id string, ts timestamp"
    times = [[100, 200], [150, 90, 260], [None, 140], [500], [100, 499]]
    for i, batch in enumerate(times):
        rows = spark.createDataFrame([(i * 10 + j, f"r{j}", t) for j, t in enumerate(batch)], "seq long, run_id string, t long")
        rows = rows.select("seq", "run_id", F.timestamp_seconds("t").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    assert late.split_late(stream, path, str(tmp_path / "cp"), 100).awaitTermination(120) in (None, True)
    found = sorted(r["seq"] for r in late.late_rows(spark, path, schema).collect())
    assert found == [11, 21, 40]  # 90 < 200 - 100, 140 < 260 - 100, 100 < 500 - 100
    accepted = late.accepted_rows(spark, path, schema)
    got = _run(spark, accepted.withWatermark("ts", "100 seconds").select("seq"), tmp_path / "again")
    assert sorted(r["seq"] for r in got.collect()) == sorted({i * 10 + j for i, b in enumerate(times) for j in range(len(b))} - set(found))


def test_compacted_store_is_published(spark, tmp_path):
    root, path = str(tmp_path / "store"), str(tmp_path / "store")
    schema = "seq long, topic string, chapter string, subchapter string, language string, raw string"
    for i in range(3):
        outputs = [_output(10 * i + j, f"S{j}", "abc" if i < 2 else "xy", []) for j in range(4)]
        incremental.store_batch(spark, spark.createDataFrame(outputs, schema), path, now(), i)
    before = _rows(incremental.current_graph(spark, incremental.current_path(spark, root)).nodes.select("scope", "name"))
    assert incremental.current_path(spark, root) == root
    for target in ("one", "two"):
        incremental.compact_store(spark, root, str(tmp_path / target))
        assert incremental.current_path(spark, root) == str(tmp_path / target)
        assert _rows(incremental.current_graph(spark, str(tmp_path / target)).nodes.select("scope", "name")) == before
    assert len(before) == 8


def test_logs_of_many_runs_take_few_folders_and_keep_their_runs(spark, tmp_path):
    rows = spark.range(3000).selectExpr(
        "CASE WHEN id < 2998 THEN concat('run ', id) END AS run_id", "timestamp_millis(id) AS ts", "'[info] a' AS message", "'info' AS level"
    )
    runs.write_run_log(rows, f"{tmp_path}/in")
    tailed = run_log.stream_run_log(spark, f"{tmp_path}/in")
    run_log.append_run_log(tailed, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    expected = {(f"run {i}" if i < 2998 else "__HIVE_DEFAULT_PARTITION__", i) for i in range(3000)}
    for part in ("in", "out"):
        read = runs.read_run_log(spark, f"{tmp_path}/{part}").selectExpr("run_id", "unix_millis(ts) AS ms").collect()
        assert len(read) == 3000 and {tuple(r) for r in read} == expected
        assert len(list((tmp_path / part).glob("*=*"))) <= runs.RUN_BUCKETS + 1


def test_logs_with_a_folder_for_each_run_are_read(spark, tmp_path):
    for folder in ("r1", "run_id=r2"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "logs.ndjson").write_text('{"timestamp": 5, "message": "m", "level": "info"}\n')
    read = runs.read_run_log(spark, str(tmp_path)).select("run_id", "message").collect()
    assert sorted(map(tuple, read)) == [("r1", "m"), ("r2", "m")]
