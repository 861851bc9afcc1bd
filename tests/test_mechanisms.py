"""Spark's own extension points: the generator as a source, the sink with commit, the stateful stream."""

import datetime
import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from pathwright.operators import instances as I
from pathwright.operators import splits
from pathwright.sources import instance_source, publish_sink
from pathwright.streaming import accepted

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def want(spark):
    return sorted(map(tuple, I.long(I.instances(spark.range(-50, 1500).withColumnRenamed("id", "seed"))).collect()))


@pytest.mark.parametrize("parts", [1, 7, 5000])
def test_source_gives_the_generators_rows(spark, want, parts):
    instance_source.register(spark)
    df = spark.read.format(instance_source.NAME).options(start=-50, end=1500, partitions=parts).load()
    assert sorted(map(tuple, df.collect())) == want
    assert df.rdd.getNumPartitions() == min(parts, 1550)
    assert spark.read.format(instance_source.NAME).options(start=5, end=5).load().collect() == []
    two = spark.read.format(instance_source.NAME).options(start=0, end=100, families="tsp,knapsack").load()
    assert sorted(map(tuple, two.collect())) == [r for r in want if 0 <= r[0] < 100 and r[1] in ("tsp", "knapsack")]


@pytest.fixture
def pushing(spark):
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    yield spark
    spark.conf.set(name, before)


def test_source_takes_filters(pushing, want):
    instance_source.register(pushing)
    df = pushing.read.format(instance_source.NAME).options(start=-50, end=1500, pushdown="true").load()
    some = df.where("seed > 100 AND seed <= 200 AND template_name IN ('tsp', 'assignment') AND i < 2")
    assert sorted(map(tuple, some.collect())) == [r for r in want if 100 < r[0] <= 200 and r[1] in ("tsp", "assignment") and r[3] < 2]
    line = next(x for x in some._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter" in x)
    assert "seed" not in line and "i#" in line
    assert sorted(map(tuple, df.where("seed = 7").collect())) == [r for r in want if r[0] == 7]


def test_requests_cover_all_blocks(spark):
    docs = spark.createDataFrame([("a", "# T\n" + "\n".join(f"- {i}" for i in range(23))), ("b", "x"), ("c", None), ("d", "")], "doc_id string, text string")
    rows = sorted(publish_sink.requests(docs).collect())
    assert [(r.document, r.request, r.first_block, len(json.loads(r.blocks))) for r in rows] == [("a", 0, 0, 10), ("a", 1, 10, 10), ("a", 2, 20, 3), ("b", 0, 0, 1)]


def test_second_write_sends_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "receiver.py").write_text(RECEIVER)
    env = os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}", "RECEIVED": str(tmp_path / "got")}
    os.makedirs(tmp_path / "got")
    done = subprocess.run([sys.executable, "-c", SENDER, str(tmp_path)], env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]
    first, second, blocks = json.loads(done.stdout.strip().split("\n")[-1])
    # the first run lost a task between a request and its note, and another before its request
    assert os.path.exists(tmp_path / "got" / "killed-after") and os.path.exists(tmp_path / "got" / "killed-before")
    got = [json.load(open(tmp_path / "got" / f)) for f in os.listdir(tmp_path / "got") if f.endswith(".json")]
    by = {}
    for r in got:
        by.setdefault(r["document"], []).append((r["first"], r["blocks"]))
    assert sum(len(b) for parts in by.values() for _, b in parts) == blocks == 12 * 24
    for parts in by.values():
        places = [first + k for first, b in sorted(parts) for k in range(len(b))]
        assert places == list(range(24))
    assert first["requests"] + first["skipped"] == 36 and second == {"requests": 0, "blocks": 0, "skipped": 36}


#: An endpoint that knows a request by its key, and that ends its worker once after it has taken a request and once before.
RECEIVER = '''
import json, os
def send(key, document, first, blocks):
    folder = os.environ["RECEIVED"]
    def once(name):
        try:
            os.close(os.open(f"{folder}/{name}", os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False
    if document == "3" and first == 10 and once("killed-before"):
        os._exit(7)
    path = f"{folder}/{key}.json"
    if not os.path.exists(path):
        with open(path + ".part", "w") as f:
            json.dump({"document": document, "first": first, "blocks": json.loads(blocks)}, f)
        os.replace(path + ".part", path)
    if document == "7" and first == 10 and once("killed-after"):
        os._exit(7)
'''
SENDER = '''
import json, sys
from pyspark.sql import SparkSession
from pathwright.sources import publish_sink
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
docs = spark.createDataFrame([(str(d), "# T%d\\n" % d + "\\n".join(f"- item {i}" for i in range(24))) for d in range(12)], "doc_id string, text string")
blocks = sum(len(json.loads(r.blocks)) for r in publish_sink.requests(docs).collect())
journal = sys.argv[1] + "/journal"
first = publish_sink.publish_once(docs, journal, endpoint="receiver:send", pace="0.001")
print(json.dumps([first, publish_sink.publish_once(docs, journal, endpoint="receiver:send"), blocks]))
'''


def test_stream_accepts_until_the_target(spark, tmp_path):
    rng, start = random.Random(1), datetime.datetime(2024, 1, 1)
    rows = [(run, start + datetime.timedelta(seconds=s), s, v, t, rng.random() < 0.3) for run in "abc" for s in range(60) for v in range(2) for t in range(3)]
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 6))
    schema = "run string, at timestamp, seed long, variant int, traj int, success boolean"
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", "3")

    def more(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    def run():
        stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        out = accepted.until_target(stream, 70, "10 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        out.trigger(availableNow=True).start().awaitTermination()

    for at in range(0, 500, 125):
        more(rows[at : at + 125])
    run()
    half = spark.read.parquet(f"{tmp_path}/out").count()
    for at in range(500, len(rows), 125):
        more(rows[at : at + 125])
    for day in (1, 2):  # later rows of another run move the watermark
        more([("z", start + datetime.timedelta(days=day), 0, 0, 0, False)])
    run()  # from the checkpoint
    got = sorted((r.run, r.seed, r.variant, r.traj, r.success, r.accepted) for r in spark.read.parquet(f"{tmp_path}/out").where("run <> 'z'").collect())
    want = []
    for name in "abc":
        batch = splits.until_target(spark.createDataFrame([r for r in rows if r[0] == name], schema), 70)
        want += [(name, *r) for r in batch.select("seed", "variant", "traj", "success", F.col("accepted")).collect()]
    assert got == sorted(map(tuple, want)) and 0 < half < len(got)
    assert {max(r[5] for r in got if r[0] == name) for name in "abc"} == {70}
