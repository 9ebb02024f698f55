"""Changes of edges that settle by their time, against a plain replay."""

import datetime
import random

from fillweave.streaming import maintain, settle


def stream(spark, folder, files):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, settle.SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(settle.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(spark, changes, folder):
    writer = settle.settled(changes).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True)
    settle.start(spark, writer).awaitTermination(300)


def test_late_and_repeated_changes(spark, tmp_path):
    """Any order, ties of time, repeated rows, no time, no id, ends either way round; a second run goes on from the state."""
    rng = random.Random(4)
    day = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        u, v = rng.sample(range(8), 2)
        ts = None if rng.random() < 0.05 else day + datetime.timedelta(hours=rng.randrange(60))
        rows.append((u, v, rng.choice(["add", "remove"]), ts, None if rng.random() < 0.02 else i))
    rows += rng.sample(rows, 40) + [(None, 1, "add", day, 1), (3, 3, "add", day, 2), (1, 2, "drop", day + datetime.timedelta(days=99), 10**6), (1, 2, None, day, 3)]
    rng.shuffle(rows)
    # two changes of an edge without time or id have nothing to tell them apart by
    seen, clear = {}, []
    for r in rows:
        if r[0] is None or r[1] is None or r[4] is not None or seen.setdefault((min(r[:2]), max(r[:2]), r[3]), r[2]) == r[2]:
            clear.append(r)
    last = {}
    for u, v, op, ts, i in clear:
        if u is not None and u != v and op in ("add", "remove"):
            e, at = (min(u, v), max(u, v)), (ts or datetime.datetime.min, -1 if i is None else i)
            if e not in last or at > last[e][0]:
                last[e] = (at, op, ts, i)
    want = {(*e, ts, i) for e, (_, op, ts, i) in last.items() if op == "add"}

    half = len(clear) // 2
    folder = str(tmp_path)
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    run(spark, stream(spark, folder, [clear[:half]]), folder)
    run(spark, stream(spark, folder, [clear[half:]]), folder)
    assert {tuple(r) for r in settle.edges_now(spark, f"{folder}/at").collect()} == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == store
    # what the stream passed on, replayed in order of batches, comes to the same edges
    out = spark.read.parquet(f"{folder}/out").collect()
    lasting = {}
    for r in sorted(out, key=lambda r: (r["ts"] or datetime.datetime.min, -1 if r["id"] is None else r["id"])):
        lasting[r["u"], r["v"]] = r["op"]
    assert {e for e, op in lasting.items() if op == "add"} == {(u, v) for u, v, *_ in want}


def test_order_kept_by_time(spark, tmp_path):
    """A removal that comes a batch late, from before an edge was added, doesn't take it away."""
    from fillweave.operators import ordering as O
    from fillweave.operators.incremental import Settings

    pairs = [(k, k + 1) for k in range(11)]
    vertices = spark.range(12).selectExpr("cast(id as int) v")
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "u int, v int")
    settings, folder, day = Settings(levels=2, lagging=False), str(tmp_path), datetime.datetime(2024, 1, 1)
    maintain.save(O.cold(vertices, edges, settings), f"{folder}/start")
    later = day + datetime.timedelta(hours=1)
    changes = stream(spark, folder, [[(0, 5, "add", later, 2), (3, 4, "remove", later, 3)], [(0, 5, "remove", day, 1), (4, 3, "add", day, 4)]])
    maintain.maintain(changes, folder, f"{folder}/at", settings).awaitTermination(300)
    batches = [b for b in (1, 0) if (tmp_path / str(b)).exists()]
    state, order = maintain.load(spark, f"{folder}/{batches[0]}")
    now = {(r["u"], r["v"]) for r in state.edges.where("u < v").collect()}
    assert now == set(pairs) - {(3, 4)} | {(0, 5)}
    assert sorted(r["v"] for r in order.collect()) == list(range(12))


def test_latest_by_aggregate(spark, tmp_path, monkeypatch):
    """Late, repeated and untimed changes in two batches settle in an aggregate's state, without a Python call for an edge."""

    def called(*_):
        raise AssertionError("Python for an edge")

    monkeypatch.setattr(settle, "LastChange", called)
    rng = random.Random(6)
    day = datetime.datetime(2024, 1, 1)
    rows = [(*rng.sample(range(8), 2), rng.choice(["add", "remove"]), None if i % 19 == 0 else day + datetime.timedelta(hours=rng.randrange(60)), i) for i in range(300)]
    rows += rows[:30] + [(None, 1, "add", day, 1), (3, 3, "add", day, 2), (1, 2, "drop", day + datetime.timedelta(days=99), 10**6), (20, 21, "add", None, None)]
    rng.shuffle(rows)
    last = {}
    for u, v, op, ts, i in rows:
        if u is not None and u != v and op in ("add", "remove"):
            e, at = (min(u, v), max(u, v)), (ts or datetime.datetime.min, -1 if i is None else i)
            if e not in last or at > last[e][0]:
                last[e] = (at, op, ts, i)
    want = {(*e, ts, i) for e, (_, op, ts, i) in last.items() if op == "add"}
    folder, seen = str(tmp_path), []
    for part in (rows[:150], rows[150:]):
        changes = settle.latest(stream(spark, folder, [part]))
        writer = changes.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append([tuple(r) for r in df.collect()])).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True)
        settle.start(spark, writer).awaitTermination(300)
    assert {tuple(r) for r in settle.latest_edges(spark, f"{folder}/at").collect()} == want
    assert len(seen) == 2 and all(len({r[:2] for r in batch}) == len(batch) for batch in seen)
    lasting = {r[:2]: r[2] for batch in seen for r in batch}
    assert {e for e, op in lasting.items() if op == "add"} == {w[:2] for w in want}
