import brute
from lineloom.operators.mining import assign_templates, mine_templates
from lineloom.operators.messages import partition_by_length, preprocess
from lineloom.operators.sequential import Replay
from lineloom.plans.presets import Preset
from lineloom.streaming.counts import template_counts_stream
from lineloom.streaming.mining import TemplateStream, assign_stream, state_store_options

PRESET = Preset("", st=0.7, method="seqDist")
SCHEMA = "LineId bigint, Content string"


def contents(seed, count):
    return [(line, "".join(tokens)) for line, tokens in brute.random_messages(seed, count)]


def whole(spark, rows):
    lines = partition_by_length(preprocess(spark.createDataFrame(rows, SCHEMA), PRESET))
    mining = mine_templates(lines.select("LineId", "Bucket", "Signature"), "seqDist", 0.7, mode="sequential")
    return assign_templates(lines, mining)


def test_batches_continue_from_each_other(spark, tmp_path):
    rows = contents(21, 90)
    parts = [rows[:45], rows[45:]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / f"part={i}"))
    seen = {}

    def sink(lines, batch_id):
        seen[batch_id] = {r.LineId: r.EventTemplate for r in lines.select("LineId", "EventTemplate").collect()}

    stream = TemplateStream(spark, PRESET, sink, str(tmp_path / "state"))
    for i, part in enumerate(parts):
        stream.take(spark.read.schema(SCHEMA).json(str(tmp_path / "in" / f"part={i}")), i)
    final = {r.LineId: r.EventTemplate for r in whole(spark, rows).collect()}
    assert seen[1] == {line: final[line] for line, _ in parts[1]}
    again = dict(seen)
    stream.take(spark.read.schema(SCHEMA).json(str(tmp_path / "in" / "part=1")), 1)  # a batch tried again
    assert seen == again


def test_stream_query_in_one_batch_equals_batch_mining(spark, tmp_path):
    rows = contents(22, 60)
    spark.createDataFrame(rows, SCHEMA).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    got = {}

    def sink(lines, batch_id):
        got.update({r.LineId: r.EventTemplate for r in lines.select("LineId", "EventTemplate").collect()})

    TemplateStream(spark, PRESET, sink, str(tmp_path / "state")).start(source, availableNow=True).awaitTermination()
    assert got == {r.LineId: r.EventTemplate for r in whole(spark, rows).collect()}


def test_keyed_state_equals_batch_clusters(spark, tmp_path):
    rows = contents(23, 60)
    spark.createDataFrame(rows[:30], SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / "a"))
    spark.createDataFrame(rows[30:], SCHEMA).coalesce(1).write.json(str(tmp_path / "in" / "b"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    state_store_options(spark)
    try:
        for part in ("a", "b"):  # two runs over the same state
            source = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in" / "[ab]" if part == "b" else tmp_path / "in" / "a"))
            query = (
                assign_stream(source, PRESET).writeStream.format("parquet").outputMode("append")
                .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress"))
                .trigger(availableNow=True).start()
            )
            query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    got = {r.LineId: r.ClusterId for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    home, _ = brute.sequential(brute.random_messages(23, 60), "seqDist", 0.7, 3)
    assert got == home


def test_running_counts(spark, tmp_path):
    spark.createDataFrame([("i", "a"), ("i", "a"), ("j", "b")], "EventId string, EventTemplate string").write.json(
        str(tmp_path / "in")
    )
    source = spark.readStream.schema("EventId string, EventTemplate string").json(str(tmp_path / "in"))
    query = (
        template_counts_stream(source).writeStream.format("memory").queryName("running").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("running").collect()} == {("i", "a", 2), ("j", "b", 1)}


def test_a_replay_forgets(monkeypatch):
    monkeypatch.setattr("lineloom.operators.sequential.SETTLED", 20)
    replay = Replay([], "seqDist", 0.5, 3)
    homes = {replay.take(i, ("user", f"u{i}", "left")) for i in range(500)}
    assert homes == {0} and len(replay._settled) <= 20
    replay.take(500, ("disk", "full", "again"))  # a new template: nothing settled before it holds
    assert not replay._settled
    messages = brute.random_messages(24, 300)
    by_length = {}
    home = {line: by_length.setdefault(len(t), Replay([], "seqDist", 0.7, 3)).take(line, tuple(t)) for line, t in messages}
    assert home == brute.sequential(messages, "seqDist", 0.7, 3)[0]
    assert all(len(r._settled) <= 20 for r in by_length.values())
