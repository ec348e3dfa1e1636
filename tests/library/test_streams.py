"""Budgets with refunds: the stream decides what the batch decides, with late and repeated events."""

import random

import pandas as pd
import pytest

from lexiloom.streaming import policies

SCHEMA = "event_id long, client string, day string, at double, kind string, ts timestamp"


def replay(seed, n=160):
    """Events of two days in order of time."""
    r, start = random.Random(seed), pd.Timestamp("2024-01-01 20:00", tz="UTC").timestamp()
    out = []
    for i in range(n):
        at = start + i * 240.0 + r.randint(0, 200)
        moment = pd.Timestamp(at, unit="s", tz="UTC")
        out.append((i, f"c{r.randint(0, 5)}", moment.strftime("%Y-%m-%d"), at, r.choice(["request", "request", "request", "refund"]), moment.to_pydatetime().replace(tzinfo=None)))
    return out


def brute(rows, per_client, per_day, tracked):
    days, out = {}, {}
    for i, client, day, at, kind, _ in sorted(rows, key=lambda x: (x[3], x[0])):
        held = days.setdefault(day, {"n": 0, "of": {}, "order": []})
        mine = held["of"].get(client, 0)
        if kind == "refund":
            held["n"], out[i] = max(0, held["n"] - 1), None
            if mine:
                held["of"][client] = mine - 1
        elif mine >= per_client:
            out[i] = "client_daily"
        elif held["n"] >= per_day:
            out[i] = "global_daily"
        else:
            out[i] = None
            held["of"][client] = mine + 1
            held["n"] += 1
            held["order"] = [c for c in held["order"] if c != client] + [client]
            if len(held["of"]) > tracked:
                gone = held["order"].pop(0)
                del held["of"][gone]
    return out


@pytest.mark.parametrize("per_client, per_day, tracked", [(3, 12, 4096), (2, 100, 3), (100, 5, 4096)])
def test_batch_against_plain_python(spark, per_client, per_day, tracked):
    rows = replay(1)
    df = spark.createDataFrame([*rows, rows[5], rows[90]], SCHEMA)
    got = [(r["event_id"], r["reason"]) for r in policies.admitted_with_refunds(df, per_client, per_day, tracked).collect()]
    assert sum(r == "repeated" for _, r in got) == 2
    assert {i: r for i, r in got if r != "repeated"} == brute(rows, per_client, per_day, tracked)


def test_stream_and_batch_agree(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = replay(2)
    # within a stretch of some minutes events come in any order, and some come again
    r, parts = random.Random(3), [rows[i : i + 40] for i in range(0, 160, 40)]
    for part in parts[1:]:
        part.append(rows[r.randrange(0, 40)])
    for part in parts:
        r.shuffle(part)
    parts[0], parts[1] = parts[0][:-2], parts[1] + parts[0][-2:]
    end = pd.Timestamp("2024-02-01", tz="UTC")
    far = [(10_000 + i, "end", (end + pd.Timedelta(days=i)).strftime("%Y-%m-%d"), (end + pd.Timedelta(days=i)).timestamp(), "request", (end + pd.Timedelta(days=i)).to_pydatetime().replace(tzinfo=None)) for i in range(2)]
    try:
        (tmp_path / "in").mkdir()
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = policies.admitted_stream(source, 3, 20, 4, delay="4 hours").writeStream.format("memory").queryName("budgets").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        for n, part in enumerate([*parts, far[:1], far[1:]]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = [(x["event_id"], x["reason"]) for x in spark.table("budgets").where("event_id < 10000").collect()]
    decided = {i: reason for i, reason in got if reason != "repeated"}
    assert decided == brute(rows, 3, 20, 4) and len(got) > len(decided) == 160
