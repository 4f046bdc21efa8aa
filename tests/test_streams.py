import datetime as dt

from colloquy.operators.upserts import Deltas, Versions
from colloquy.streaming import answers, jobs
from pyspark.sql import functions as F


def drained(stream, tmp, mode="append"):
    stream.writeStream.format("parquet").option("path", str(tmp / "out")).option("checkpointLocation", str(tmp / "state")).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp / "out")).collect()


def test_resumed_reads_repeat_no_rows(spark, tmp_path):
    data = spark.createDataFrame([("a", dt.datetime(2026, 1, 1)), ("b", dt.datetime(2026, 1, 2))], "id string, ts timestamp")
    for k in range(2):
        data.write.mode("append").parquet(str(tmp_path / "in"))
    got = drained(jobs.deduplicated(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))), tmp_path)
    assert sorted(r.id for r in got) == ["a", "b"]


def test_upserts_by_batch(spark, tmp_path):
    store = Deltas(spark, str(tmp_path / "store"))
    write = jobs.upserting(store)
    write(spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"), 0)
    write(spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int"), 1)
    assert sorted(map(tuple, store.read().collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_versions(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "versions"))
    assert store.read() is None
    for k in (1, 2):
        store.write(spark.createDataFrame([("a", k)], "id string, v int"))
    assert [tuple(r) for r in store.read().collect()] == [("a", 2)]


def test_streak_state(spark, tmp_path):
    rows = [(d, dt.date(2026, 8, d), "U1", "api") for d in (1, 2, 4)] + [(1, dt.date(2026, 8, 1), "U2", "db")]
    data = spark.createDataFrame(rows, "day bigint, date date, user string, blocker string")
    data.write.parquet(str(tmp_path / "in"))
    got = drained(jobs.streaks(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))), tmp_path)
    assert sorted((r.user, r.date, r.days, r.since) for r in got) == [("U1", "2026-08-01", 1, "2026-08-01"), ("U1", "2026-08-02", 2, "2026-08-01"), ("U1", "2026-08-04", 1, "2026-08-04"), ("U2", "2026-08-01", 1, "2026-08-01")]


def test_announced_once_per_bucket(spark, tmp_path):
    data = spark.createDataFrame([("x", 5), ("x", 5), ("x", 10), ("y", 5)], "key string, bucket bigint")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drained(jobs.announced_once(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))), tmp_path)
    assert sorted((r.key, r.bucket) for r in got) == [("x", 5), ("x", 10), ("y", 5)]


def test_windows_close_with_the_watermark(spark, tmp_path):
    data = spark.createDataFrame([(dt.datetime(2026, 1, 1, 0, m),) for m in (1, 2, 11, 40)], "ts timestamp")
    data.write.parquet(str(tmp_path / "in"))
    got = drained(jobs.windowed(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), "ts", "10 minutes", "5 minutes"), tmp_path)
    assert sorted((r.start.minute, r.n) for r in got) == [(0, 2), (10, 1)]


def test_a_day_of_answers_ends_with_its_timer(spark, tmp_path):
    def add(*rows):
        made = [(at.date() if at else None, user, via, at, n, f"t{n}") for user, via, at, n in rows]
        spark.createDataFrame(made, "date date, user string, via string, at timestamp, id bigint, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("date date, user string, via string, at timestamp, id bigint, text string").parquet(str(tmp_path / "in"))
        return sorted((str(r.date), r.user, r.id, r.kept) for r in drained(answers.day_answers(stream), tmp_path))

    at = lambda day, hour: dt.datetime(2026, 8, day, hour)
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        first = [("a", "thread", at(1, 9), 1), ("a", "dm", at(1, 11), 2), ("b", "dm", at(1, 9), 3), ("c", "simulated", at(1, 8), 4), ("d", "noise", at(1, 9), 5), (None, "dm", at(1, 9), 6), ("e", "dm", None, 7)]
        assert add(*first) == []  # the day is not over
        # late within the hour of the watermark, after a restart: a correction, an earlier reply, a second direct answer
        assert add(("a", "thread", at(1, 12), 8), ("a", "thread", at(1, 10), 9), ("b", "dm", at(1, 13), 10)) == []
        told = [("2026-08-01", "a", 8, False), ("2026-08-01", "b", 10, True), ("2026-08-01", "c", 4, True)]
        assert add(("a", "dm", at(2, 9), 11)) == told
        # too late for a day that was told; the next day goes on
        assert add(("a", "thread", at(1, 23), 12), ("a", "thread", at(2, 10), 13)) == told
        assert add(("a", "dm", at(5, 9), 14)) == [*told, ("2026-08-02", "a", 13, False)]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def test_a_late_answer_counts_while_its_day_is_open(spark, tmp_path):
    schema = "date date, user string, via string, at timestamp, id bigint, text string"

    def add(*rows):
        spark.createDataFrame([(dt.date(2026, 8, day), user, via, dt.datetime(2026, 8, day, hour), n, None) for day, hour, user, via, n in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        made = answers.day_answers(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        return sorted((str(r.date), r.user, r.id, r.text, r.kept) for r in drained(made, tmp_path))

    assert add((1, 20, "a", "dm", 1)) == []
    assert add((1, 21, "b", "dm", 2)) == []
    assert add((1, 3, "c", "thread", 3), (1, 2, "a", "thread", 4)) == []  # long past the watermark, but the day isn't told
    assert add((3, 9, "a", "dm", 5)) == [("2026-08-01", "a", 4, "", False), ("2026-08-01", "b", 2, "", True), ("2026-08-01", "c", 3, "", False)]


def test_streaks_of_many_persons_share_few_rows_of_state(spark, tmp_path):
    def add(*rows):
        data = spark.createDataFrame([(d, dt.date(2026, 8, 10) + dt.timedelta(d), user, "api") for d, user in rows], "day bigint, date date, user bigint, blocker string")
        data.write.mode("append").parquet(str(tmp_path / "in"))
        return sorted((r.user or 0, r.date[8:], r.days, r.since[8:]) for r in drained(jobs.streaks(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), groups=2), tmp_path))

    first = add(*[(d, u) for u in range(1, 41) for d in (-2, -1, -1, 1)], (0, None))
    each = lambda u: [(u, "08", 1, "08"), (u, "09", 2, "08"), (u, "11", 1, "11")]
    assert first == [(0, "10", 1, "10"), *[x for u in range(1, 41) for x in each(u)]]
    second = add((2, 1), (3, 1), (3, 2), (1, 3), (1, None), (5, (1 << 53) + 1))
    more = [(0, "11", 2, "10"), (1, "12", 2, "11"), (1, "13", 3, "11"), (2, "13", 1, "13"), ((1 << 53) + 1, "15", 1, "15")]
    assert second == sorted(first + more)
