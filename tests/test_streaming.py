import datetime as dt

from pyspark.sql import functions as F

from tallyframe.streaming import events as op


def source(spark, tmp_path):
    """Two files of events in order, the second with a very late one."""
    t0 = dt.datetime(2024, 1, 1)
    make = lambda i, minutes, user: (i, t0 + dt.timedelta(minutes=minutes), user, ("view", "click")[i % 2], float(i), "{}")
    parts = [[make(i, i * 7, i % 3) for i in range(40)], [make(i, i * 7, i % 3) for i in range(40, 80)], [make(99, 10**5, 0)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, op.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def drain(df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_windows_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    path = source(spark, tmp_path)
    batch = spark.read.schema(op.EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    for name, make in (("tumbling", lambda d: op.windowed(d, "1 hour", delay="100 days")), ("sliding", lambda d: op.windowed(d, "1 hour", "30 minutes", delay="100 days")), ("sessions", lambda d: op.sessions(d, "20 minutes", delay="100 days"))):
        got = as_set(drain(make(op.event_stream(spark, path)), tmp_path, name, "complete"))
        assert got == as_set(make(batch)) and got


def test_sequences_keep_counting_over_batches(spark, tmp_path):
    path = source(spark, tmp_path)
    got = drain(op.append_sequence(op.event_stream(spark, path)), tmp_path, "sequences").collect()
    per_user = {}
    for r in got:
        per_user.setdefault(r.user_id, []).append(r.sequence)
    assert sum(map(len, per_user.values())) == 81
    assert all(sorted(s) == list(range(1, len(s) + 1)) for s in per_user.values())


def test_illegal_transitions_are_refused(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    steps = [("r1", "queued"), ("r1", "succeeded"), ("r1", "running"), ("r1", "succeeded"), ("r2", "running"), ("r2", "queued"), ("r2", "cancelled"), ("r2", "running")]
    rows = [(i, t0 + dt.timedelta(minutes=i), r, s) for i, (r, s) in enumerate(steps)]
    schema = "event_id long, ts timestamp, run_id string, state string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/runs")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/runs")
    got = drain(op.run_states(stream), tmp_path, "states").collect()
    accepted = {}
    for r in got:
        accepted.setdefault(r.run_id, []).append((r.state, r.accepted))
    assert accepted == {"r1": [("queued", True), ("succeeded", False), ("running", True), ("succeeded", True)], "r2": [("running", False), ("queued", True), ("cancelled", True), ("running", False)]}
    last = spark.createDataFrame([("a", "running"), ("b", "succeeded")], "run_id string, state string")
    assert as_set(op.interrupted(last)) == {("a", "interrupted")}
