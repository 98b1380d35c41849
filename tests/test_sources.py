import pytest
from pyspark.sql import Observation

from lineloom.sources import tables
from lineloom.sources.formats import (
    FormatError, compile_log_format, load_report, observe_load, parse_log_lines, require_loaded,
)
from lineloom.sources.lines import load_log, read_log_lines, read_messages, with_line_id


def lines(spark, *values):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "LineId bigint, value string")


def test_optional_header_is_null(spark):
    df = parse_log_lines(
        lines(spark, "Jun 1 kernel: hi", "Jun 1 sshd[12]: yo", "nothing"), r"<M> <D> <C>(\[<PID>\])?: <Content>"
    )
    rows = {r.LineId: r for r in df.collect()}
    assert set(rows) == {1, 2}
    assert (rows[1].PID, rows[1].Content, rows[1].C) == (None, "hi", "kernel")
    assert (rows[2].PID, rows[2].Content, rows[2].C) == ("12", "yo", "sshd")


@pytest.mark.parametrize("form, line, expected", [
    (r"<C>(?:\[<PID>\])?: <Content>", "kernel: hi", ("kernel", None, "hi")),
    (r"<C>(?:\[<PID>\])?: <Content>", "sshd[7]: hi", ("sshd", "7", "hi")),
    (r"<C>(\[<PID>\]){0,1}: <Content>", "kernel: hi", ("kernel", None, "hi")),
    (r"(kernel|<C>\[<PID>\]): <Content>", "kernel: hi", (None, None, "hi")),
    (r"(kernel|<C>\[<PID>\]): <Content>", "sshd[7]: hi", ("sshd", "7", "hi")),
])
def test_every_optional_form_gives_null(spark, form, line, expected):
    row = parse_log_lines(lines(spark, line), form).first()
    assert (row.C, row.PID, row.Content) == expected


def test_fields_keep_their_blanks(spark):
    row = parse_log_lines(lines(spark, "03/22 08:51:01 INFO   :x "), "<Date> <Time> <Level>:<Content>").first()
    assert (row.Level, row.Content) == ("INFO   ", "x")


def test_line_with_separator_takes_the_slow_path(spark):
    row = parse_log_lines(lines(spark, "a\u0001b c: d\u0001"), "<X> <Y>: <Content>").first()
    assert (row.X, row.Y, row.Content) == ("a\u0001b", "c", "d\u0001")


def test_group_numbers_skip_escapes_and_classes():
    fmt = compile_log_format(r"\(<A>\) [(<]x(?:y)(z)?<B>(\[<C>\])?")
    assert fmt.headers == ("A", "B", "C")
    assert fmt.groups == (1, 3, 5)
    assert fmt.guards == (0, 0, 4)


def test_bad_formats(spark):
    with pytest.raises(FormatError):
        compile_log_format("")
    with pytest.raises(FormatError):
        compile_log_format("<A> <A>")
    with pytest.raises(FormatError):
        require_loaded(parse_log_lines(lines(spark, "x"), "<A>: <Content>"))


def test_load_report(spark):
    df = lines(spark, "a: b", "c", "d: e", "f: g")
    assert tuple(load_report(df, "<A>: <Content>").first()) == (4, 3, 1, 0.75)
    seen = Observation("load")
    observe_load(df, "<A>: <Content>", seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"LinesRead": 4, "LinesLoaded": 3}


def test_line_ids_over_many_splits(spark, tmp_path):
    expected = []
    for name in ("a.log", "b.log", "c.log"):
        rows = [f"{name} line {i} {'odd' if i % 2 else 'even'} {'x' * (i % 50)}" for i in range(2000)]
        (tmp_path / name).write_text("\r\n".join(rows) if name == "b.log" else "\n".join(rows) + "\n")
        expected += rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        raw = read_log_lines(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() > 6
        physical = {r.LineId: r.value for r in with_line_id(raw).collect()}
        assert [physical[i + 1] for i in range(len(expected))] == expected
        odd = with_line_id(raw.where("value like '% odd %'"))
        assert {r.LineId: r.value for r in odd.collect()} == dict(
            enumerate((v for v in expected if " odd " in v), start=1)
        )
        per_file = with_line_id(raw, per_file=True).groupBy("SourceFile").agg({"LineId": "max"}).collect()
        assert [r[1] for r in per_file] == [2000] * 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_load_log(spark, tmp_path):
    path = tmp_path / "x.log"
    path.write_text("a: one\n\n   \nb: café ☃☃\nskip\n c: three\n")
    rows = sorted((r.LineId, r.A, r.Content) for r in load_log(spark, str(path), " <A>: <Content> ").collect())
    assert rows == [(1, "a", "one"), (4, "b", "caf<N/ASCII> <N/ASCII>"), (6, "c", "three")]
    with pytest.raises(FormatError):
        load_log(spark, str(path), "<A>;<Content>")


def test_structured_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'a "q", b', ["1", "x,y"], " pad "), (2, "", [], None)],
        "LineId bigint, EventTemplate string, ParameterList array<string>, Level string",
    )
    tables.write_structured(df, str(tmp_path / "s.csv"), "csv")
    schema = "LineId bigint, EventTemplate string, ParameterList string, Level string"
    back = {r.LineId: r for r in tables.read_structured_csv(spark, str(tmp_path / "s.csv"), schema).collect()}
    assert (back[1].EventTemplate, back[1].ParameterList, back[1].Level) == ('a "q", b', '["1","x,y"]', " pad ")
    assert (back[2].EventTemplate, back[2].Level) == ("", None)
    tables.write_structured(df, str(tmp_path / "s.parquet"))
    assert spark.read.parquet(str(tmp_path / "s.parquet")).where("LineId = 1").first().ParameterList == ["1", "x,y"]


def test_correct_templates_batch(spark, tmp_path):
    for name, head in (("HDFS", "LineId,EventTemplate"), ("Apache", "Time,LineId,EventTemplate")):
        body = "1,on 10.0.0.1:80 at  <*>s" if name == "HDFS" else "t,1,x #12# y"
        (tmp_path / f"{name}_2k.log_structured.csv").write_text(f"{head}\n{body}\n")
    (tmp_path / "Other_2k.log_structured.csv").write_text("EventTemplate\nx 1\n")
    out = tables.correct_templates_batch(spark, str(tmp_path), ["Mac", "HDFS", "Apache"], str(tmp_path / "out"))
    assert {tuple(r) for r in out.collect()} == {("HDFS", "on <*> at <*>"), ("Apache", "x <*> y")}
    kept = tables.read_structured_csv(spark, str(tmp_path / "out" / "Apache_2k.log_structured_modified.csv"))
    assert kept.columns == ["Time", "LineId", "EventTemplate"]


def test_read_messages(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"message": "a b"}\n{"message": "c"}\n')
    assert {r.message for r in read_messages(spark, str(tmp_path / "m.json"), "json").collect()} == {"a b", "c"}
    with pytest.raises(ValueError):
        read_messages(spark, "x", "toml")
