"""The message index on a real stream: several micro-batches, repeats and rows out of order give what a batch over all of them gives."""

import datetime as dt
import random

import pytest

from quarry.streaming import sessions

SCHEMA = "thread long, message_id long, at timestamp"
DAY = dt.datetime(2024, 5, 1)


def messages(seed=3):
    rnd = random.Random(seed)
    rows, n = [], 0
    for thread in range(4):
        at = DAY
        for _ in range(40):
            at += dt.timedelta(seconds=rnd.choice([5, 60, 300, 900, 1799, 1801, 4000]))
            rows.append((thread, n, at))
            n += 1
    return sorted(rows, key=lambda r: r[2])


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def run(spark, tmp_path, batches, name):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/{name}/in/{i}")
    found = []
    query = None
    for i in range(len(batches)):  # one start a batch: state and watermark go on from the checkpoint
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/{name}/in/[0-{i}]")
        query = (
            sessions.index_messages(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}/checkpoint")
            .foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return found


def test_stream_gives_the_rows_of_a_batch(spark, rocks, tmp_path):
    rows = messages()
    rnd = random.Random(8)
    third = len(rows) // 3
    batches = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    # some rows come a batch late, within the watermark's delay, and some come again, as they are or at a later time
    late = [r for r in batches[0] if (batches[0][-1][2] - r[2]).total_seconds() < 3000 and rnd.random() < 0.5]
    batches[0] = [r for r in batches[0] if r not in late]
    again = rnd.sample(batches[0], 8)
    batches[1] = rnd.sample(batches[1] + late + again + [(t, m, at + dt.timedelta(hours=3)) for t, m, at in again[:4]], len(batches[1]) + len(late) + 12)
    end = [(99, 10**6, DAY + dt.timedelta(days=30))]
    got = run(spark, tmp_path, [*batches, end, [(99, 10**6 + 1, DAY + dt.timedelta(days=31))]], "a")
    want = sessions.index_messages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert late and sorted(r for r in got if r[0] != 99) == sorted(map(tuple, want))


def test_rows_beyond_the_watermark_are_dropped(spark, rocks, tmp_path):
    first = [(1, 1, DAY), (1, 2, DAY + dt.timedelta(hours=12))]
    stale, end = [(1, 3, DAY + dt.timedelta(minutes=1))], [(1, 4, DAY + dt.timedelta(days=9)), (1, 1, DAY + dt.timedelta(days=1))]
    got = run(spark, tmp_path, [first, stale, end, [(1, 5, DAY + dt.timedelta(days=19))]], "b")
    assert sorted(got)[:2] == [(1, 1, 0, 1), (1, 2, 1, 1)] and 3 not in {r[1] for r in got} and sum(r[1] == 1 for r in got) == 1


def test_batch_against_a_walk(spark):
    rows = messages(5) + [(None, 1, DAY), (None, 1, DAY), (7, None, DAY)]
    got = {(r.thread, r.message_id): (r.episode, r.n_turns) for r in sessions.index_messages(spark.createDataFrame(rows + rows[:9], SCHEMA)).collect()}
    want, state = {}, {}
    for thread, m, at in rows:
        if (thread, m) not in want:
            episode, n, last = state.get(thread, (-1, 0, at))
            if episode < 0 or (at - last).total_seconds() > sessions.GAP_SECONDS or n >= sessions.MOST_TURNS:
                episode, n = episode + 1, 0
            state[thread] = (episode, n + 1, at)
            want[thread, m] = (episode, n + 1)
    assert got == want


def test_streams_need_the_right_state_store(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    with pytest.raises(ValueError):
        sessions.index_messages(stream)
