"""The message stream: repeats, restarts, a worker that stays away, and a batch that runs again."""

from datetime import datetime, timedelta

from strider.streaming import messages

START = datetime(2024, 1, 1)


def _message(kind, worker, seq, **more):
    row = dict(kind=kind, worker=worker, seq=seq, at=START + timedelta(seconds=seq or 0), clip=None, status=None, time=None, text=None) | more
    return tuple(row.values())


def test_repeats_restarts_and_a_missing_worker(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def send(*rows):
        spark.createDataFrame(rows, messages.MESSAGE).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(messages.MESSAGE).parquet(source)
        messages.route(messages.messages(stream), checkpoint, out).awaitTermination()
        left = messages.missing(spark.createDataFrame([("a",), ("b",)], "worker string"), messages.sink(spark, out, "done"))
        return sorted(r.worker for r in left.collect())

    first = [_message("result", "a", k, clip=f"c{k}", status="valid", time=0.5) for k in range(5)]
    send(*first, first[0], _message("error", "b", 0, clip="x", text="no video"), _message("odd", "b", 1, text="?"), _message("result", None, 3), _message("result", "a", None))
    assert run() == ["a", "b"]
    # a new query from the checkpoint: what was sent before comes again
    send(first[1], first[4], _message("result", "b", 2, clip="d", status="partial", time=1.0), _message("done", "a", 5))
    assert run() == ["b"]
    send(_message("done", "a", 5), _message("done", "b", 3))
    assert run() == []
    got = sorted((r.worker, r.seq, r.clip, r.status, r.time) for r in messages.sink(spark, out, "result").collect())
    assert got == [*(("a", k, f"c{k}", "valid", 0.5) for k in range(5)), ("b", 2, "d", "partial", 1.0)]
    assert sorted((r.seq, r.kind, r.text) for r in messages.sink(spark, out, "error").collect()) == [(0, "error", "no video"), (1, "odd", "?")]
    assert sorted((r.worker, r.seq) for r in messages.sink(spark, out, "done").collect()) == [("a", 5), ("b", 3)]


def test_a_batch_that_runs_again_writes_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([_message("result", "a", 0, clip="c", status="valid", time=1.0)], messages.MESSAGE).write.parquet(source)
    for checkpoint in ("one", "two"):  # a lost checkpoint: the batch of the same number comes again
        stream = spark.readStream.schema(messages.MESSAGE).parquet(source)
        messages.route(messages.messages(stream), str(tmp_path / checkpoint), out).awaitTermination()
    assert messages.sink(spark, out, "result").count() == 1
