"""Guards on streams of deltas: order, flags, places, state."""

import random
import re
import time

import pytest

from docsight.streaming import guards
from docsight.streaming.guards import Guard

STANDING = [
    Guard("leak", (("prompt", "secret plan"), ("prompt", "inner rule")), keeps=False),
    Guard("harm", (("phrase", "jump off"), ("phrase", "off"))),
    guards.content_guard("risky"),
]


def by_hand(deltas, flags, standing):
    """Every guard on the whole text so far, after each delta."""
    said, out = "", []
    for delta, risky in zip(deltas, flags):
        before, said = len(said), said + delta
        for g in standing:
            if g.only and not risky:
                continue
            hit = next(((k, m.start(), m.group()) for k, p in g.patterns if (m := re.search(p, said))), None)
            hit = hit or next(((k, said.find(f), f) for k, f in g.fragments if f in said), None)
            if hit:
                kind, at, text = hit
                return [*out, (delta[: max(0, at - before)] if g.keeps else "", g.name, kind, text)]
        out.append((delta, None, None, None))
    return out


def made(n):
    draw = random.Random(n)
    words = ["secret", " ", "plan", "inner rule", "jump ", "off", "ok ", "rm -rf", " 5 m", "g", "泰诺", "format c", ":", "> /dev/", "sda", "x"]
    text = "".join(draw.choices(words, k=draw.randrange(1, 25)))
    cuts = sorted(draw.choices(range(len(text) + 1), k=draw.randrange(6)))
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])], bool(n % 2)


def test_guards_on_random_cuts_equal_whole_texts(spark):
    cases = {n: made(n) for n in range(300)}
    rows = [(n, i, d or None, risky) for n, (deltas, risky) in cases.items() for i, d in enumerate(deltas)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, o int, t string, risky boolean").repartition(5)
    want = sorted(map(str, ((n, *r) for n, (deltas, risky) in cases.items() for r in by_hand(deltas, [risky] * len(deltas), STANDING))))
    assert sorted(str(tuple(r)) for r in guards.guarded(df, "k", "o", "t", STANDING).collect()) == want
    assert guards.guarded(df.limit(0), "k", "o", "t", STANDING).count() == 0
    with pytest.raises(ValueError):
        guards.guarded(df, "k", "o", "t", [Guard("none")])


def test_guard_stream_shuts_and_forgets(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "k int, o int, t string, risky boolean, last boolean"
    batches = [
        [(1, 2, "ret p", False, False), (1, 1, "say sec", False, False), (2, 1, "take 5 m", True, False), (3, 1, "take 5 mg", False, True)],
        [(1, 3, "lan now", False, False), (2, 2, "g or so", True, False), (3, 2, "jump off", False, False)],
        [(1, 4, "more", False, False), (2, 3, "more", True, True), (3, 3, "again", False, False)],
        [(2, 4, "new", True, False)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    deltas = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in/*")
    out = guards.guard_stream(deltas, "k", "o", "t", STANDING, last="last")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="0 seconds").start()
    try:
        until = time.time() + 100  # idle batches for timers never end, so what was read is counted
        while time.time() < until and sum(p["numInputRows"] for p in query.recentProgress) < sum(map(len, batches)):
            time.sleep(0.5)
    finally:
        query.stop()
    got = sorted(map(str, (tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())))
    assert got == sorted(
        map(
            str,
            [
                (1, "say sec", None, None, None), (1, "ret p", None, None, None), (1, "", "leak", "prompt", "secret plan"),
                (2, "take 5 m", None, None, None), (2, "", "content", "drug", "5 mg"), (2, "new", None, None, None),
                (3, "take 5 mg", None, None, None), (3, "", "harm", "phrase", "jump off"),
            ],
        )
    )
