"""

The operators work on log lines.  The test tables hold none, so lines are derived from ``events`` (one sentence shape
per event type) or taken from ``documents``, ``conversations`` and ``pages``, always over the whole table.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from lineloom.functions import correction, masking, similarity, text  # noqa: E402
from lineloom.operators import evaluation  # noqa: E402
from lineloom.operators.drain import mine_drain  # noqa: E402
from lineloom.operators.iplom import mine_iplom  # noqa: E402
from lineloom.operators.leader import merge_template  # noqa: E402
from lineloom.operators.matching import match_templates  # noqa: E402
from lineloom.operators.messages import partition_by_length, preprocess, signature_table, with_tokens  # noqa: E402
from lineloom.operators.mining import (  # noqa: E402
    assign_templates, mine_templates, mined_template_counts, template_counts,
)
from lineloom.operators.parameters import extract_parameters  # noqa: E402
from lineloom.operators.slct import mine_slct, slct_outliers  # noqa: E402
from lineloom.operators.spell import mine_spell  # noqa: E402
from lineloom.plans.benchmark import Labelled, benchmark_suite  # noqa: E402
from lineloom.plans.joins import spread_rows  # noqa: E402
from lineloom.plans.parse import parse_logs, parse_messages  # noqa: E402
from lineloom.plans.presets import PRESETS, Preset  # noqa: E402
from lineloom.sources import tables  # noqa: E402
from lineloom.sources.formats import load_report, parse_log_lines  # noqa: E402
from lineloom.sources.lines import load_log, read_log_lines, read_messages, with_line_id  # noqa: E402
from lineloom.streaming.counts import template_counts_stream  # noqa: E402
from lineloom.streaming.mining import TemplateStream, assign_stream, state_store_options  # noqa: E402
from lineloom.workspace import Workspace  # noqa: E402

FORMAT = "<Date> <Time> <Level> <Component>: <Content>"
PRESET = Preset(FORMAT, st=0.6, method="seqDist")

# Template of each event type; K and U are the two numbers of its sentence.
SENTENCES = {
    "view": "page {K} shown to uid {U} today",
    "signup": "account {U} created through plan {K}",
    "purchase": "order by customer {U} paid with coupon {K}",
    "error": "request failed for id {U} code {K}",
    "click": "button number {K} was pressed near slot {U} again",
}
TEMPLATES = {kind: s.replace("{K}", "<*>").replace("{U}", "<*>") for kind, s in SENTENCES.items()}


# ---------------------------------------------------------------------------------------------------------------
# Lines from tables


def _read(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return spread_rows(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key)


def _by_type(make) -> F.Column:
    column = None
    for kind in SENTENCES:
        test = F.col("event_type") == kind
        column = F.when(test, make(kind)) if column is None else column.when(test, make(kind))
    return column


def _sentence(kind: str):
    parts, rest = [], SENTENCES[kind]
    while rest:
        cut = rest.find("{")
        if cut < 0:
            parts.append(F.lit(rest))
            break
        parts.append(F.lit(rest[:cut]))
        parts.append(F.col("k") if rest[cut + 1] == "K" else F.col("user_id").cast("string"))
        rest = rest[cut + 3:]
    return F.concat(*parts)


def _with_lines(events: DataFrame) -> DataFrame:
    events = events.withColumn("k", F.get_json_object("props", "$.k"))
    content = _by_type(_sentence)
    value = F.concat_ws(
        " ",
        F.substring(F.col("ts").cast("string"), 1, 19),
        F.upper("event_type"),
        F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string"), F.lit(":")),
        content,
    )
    return events.select(F.col("event_id").alias("LineId"), "event_type", "user_id", "k", value.alias("value"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_lines(_read(spark, sf_dir, "events", "event_id"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_log_lines(_events(spark, sf_dir), FORMAT)


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = partition_by_length(preprocess(_messages(spark, sf_dir), PRESET))
    return Workspace(spark).table(lines.select("LineId", "Content", "Bucket", "Signature"), "lines")


def _files(spark: SparkSession, sf_dir: str) -> str:
    """The event lines as text files whose order is the order of the events."""
    path = Workspace(spark).path("lines-text")
    _events(spark, sf_dir).orderBy("LineId").select("value").write.text(path)
    return path


FILE_EVENTS = 500


def _event_files(spark: SparkSession, sf_dir: str, value: F.Column) -> str:
    """A folder of log files: each holds the lines of ``FILE_EVENTS`` event ids in order, a blank line after each."""
    path = Workspace(spark).path("files-text")
    lines = _events(spark, sf_dir).select(
        "LineId", F.expr(f"LineId DIV {FILE_EVENTS}").alias("part"), F.posexplode(F.array(value, F.lit("   "))).alias("pos", "value")
    )
    lines = lines.repartition("part").sortWithinPartitions("part", "LineId", "pos")
    lines.select("part", "value").write.partitionBy("part").text(path)
    return path


def _file_number() -> F.Column:
    return F.regexp_extract("SourceFile", "part=([0-9]+)", 1).cast("bigint").alias("FileNumber")


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))


def _document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    line_id = F.shiftleft(F.col("doc_id"), 32) + F.col("pos")
    return _document_lines(spark, sf_dir).select(line_id.alias("LineId"), F.col("value").alias("Content"))


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages", "page_id").select("page_id", "url")


def _joined(tokens) -> F.Column:
    return F.array_join(tokens, "|")


# ---------------------------------------------------------------------------------------------------------------
# Sources and sinks


def a1(spark, sf_dir):
    return read_log_lines(spark, _files(spark, sf_dir)).select("value")


def a2_physical(spark, sf_dir):
    return with_line_id(read_log_lines(spark, _files(spark, sf_dir))).select("LineId", "value")


def a2_matched(spark, sf_dir):
    lines = read_log_lines(spark, _files(spark, sf_dir))
    return with_line_id(lines.where(F.col("value").rlike(r"^\S+ \S+ ERROR "))).select("LineId", "value")


def a4(spark, sf_dir):
    return _messages(spark, sf_dir)


def a4_optional(spark, sf_dir):
    """A format with an optional part: the bracketed number is there for some lines only."""
    lines = _events(spark, sf_dir).select(
        "LineId",
        F.when(F.col("event_type") == "error", F.concat(F.lit("  sshd["), "k", F.lit("]: "), "value"))
        .otherwise(F.concat(F.lit("kernel: "), "value", F.lit(" \t"))).alias("value"),
    )
    return parse_log_lines(lines, r"<Component>(\[<PID>\])?: <Content>")


def a5(spark, sf_dir):
    foreign = F.concat(F.lit("  "), "value", F.lit(" café ☃☃ naïve"))
    loaded = load_log(spark, _event_files(spark, sf_dir, foreign), FORMAT + " ")
    return loaded.withColumn("FileNumber", _file_number()).drop("SourceFile")


def a6(spark, sf_dir):
    return load_report(_events(spark, sf_dir), "<Date> <Time> ERROR <Component>: <Content>")


def _structured(spark, sf_dir):
    """A labelled log with quotes and commas in its text, written without any mining."""
    events = _events(spark, sf_dir)
    return events.select(
        "LineId",
        F.concat(F.lit('say "'), "event_type", F.lit('", then '), "k").alias("Content"),
        F.substring(F.md5("event_type"), 1, 8).alias("EventId"),
        F.concat(F.lit('say "'), "event_type", F.lit('", then <*>')).alias("EventTemplate"),
        F.array("k").alias("ParameterList"),
    )


def a8_structured(spark, sf_dir):
    path = Workspace(spark).path("structured.csv")
    _structured(spark, sf_dir).drop("ParameterList").write.options(header=True, quote='"', escape='"').csv(path)
    return tables.read_structured_csv(
        spark, path, "LineId bigint, Content string, EventId string, EventTemplate string"
    )


def a8_templates(spark, sf_dir):
    path = Workspace(spark).path("templates.csv")
    _structured(spark, sf_dir).select("EventId", "EventTemplate").distinct().write.options(
        header=True, quote='"', escape='"'
    ).csv(path)
    return tables.read_templates_csv(spark, path)


def a9(spark, sf_dir):
    ws = Workspace(spark)
    plain, rich = ws.path("structured.csv"), ws.path("structured.parquet")
    tables.write_structured(_structured(spark, sf_dir), plain, "csv")
    tables.write_structured(_structured(spark, sf_dir), rich)
    from_csv = tables.read_structured_csv(spark, plain).select(F.col("LineId").cast("bigint"), "ParameterList")
    from_parquet = spark.read.parquet(rich).select("LineId", F.element_at("ParameterList", 1).alias("First"))
    return from_csv.join(from_parquet, "LineId")


def a10(spark, sf_dir):
    path = Workspace(spark).path("templates.csv")
    tables.write_templates(template_counts(_structured(spark, sf_dir)), path)
    return tables.read_templates_csv(spark, path, occurrences=True)


def _rough_templates(spark, sf_dir):
    """Template text that every correction rule has work on."""
    urls = _urls(spark, sf_dir)
    holed = F.regexp_replace("url", "[0-9]+", "<*>")
    return urls.select(
        "page_id",
        F.concat(
            F.lit("  got  "), holed, F.lit(" at 10.0.<*>.7:80 #<*># #<*> #<*># x"), F.col("page_id").cast("string"),
            F.lit(' "<*>" \'<*>\' "<*>" <*>#<*>@<*>:<*>/<*> v<*> 12 <*><*>.<*> n='), F.col("page_id").cast("string"),
            F.lit(",5!\t"),
        ).alias("EventTemplate"),
    )


def a11(spark, sf_dir):
    ws = Workspace(spark)
    source, target = ws.path("batch-in"), ws.path("batch-out")
    rough = _rough_templates(spark, sf_dir)
    for name in ("HDFS", "Apache"):
        rough.select(F.lit(name).alias("Dataset"), "EventTemplate").write.options(
            header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(f"{source}/{name}_2k.log_structured.csv")
    return tables.correct_templates_batch(spark, source, list(PRESETS), target)


def a12(spark, sf_dir):
    ws = Workspace(spark)
    as_json, as_parquet = ws.path("messages.json"), ws.path("messages.parquet")
    records = _events(spark, sf_dir).select(F.col("value").alias("message"))
    records.write.json(as_json)
    records.write.parquet(as_parquet)
    return read_messages(spark, as_json, "json").unionByName(read_messages(spark, as_parquet, "parquet"))


# ---------------------------------------------------------------------------------------------------------------
# Masking


def b1(spark, sf_dir):
    masked = masking.mask_patterns(F.col("value"), [r"\d{2}:\d{2}:\d{2}", r"svc\d", r"(\d+-)+\d+"])
    return _events(spark, sf_dir).select("LineId", masked.alias("masked"))


def b2(spark, sf_dir):
    tokens = masking.tokenize(F.col("url"), r"(/|\?|=|&|#)")
    urls = _urls(spark, sf_dir).select("page_id", tokens.alias("t"))
    return urls.select("page_id", _joined("t").alias("tokens"), F.size("t").alias("n_tokens"))


def b2_documents(spark, sf_dir):
    tokens = masking.tokenize(F.col("value"), "[ ,.]+")
    lines = _document_lines(spark, sf_dir).select("doc_id", "pos", tokens.alias("t"))
    return lines.select("doc_id", "pos", _joined("t").alias("tokens"), F.size("t").alias("n_tokens"))


def _url_tokens(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", masking.tokenize(F.col("url"), r"(\?|=|&|\.)").alias("t"))


def _masked_urls(mask):
    def query(spark, sf_dir):
        return _url_tokens(spark, sf_dir).select("page_id", _joined(mask(F.col("t"))).alias("tokens"))

    return query


def b4(spark, sf_dir):
    line = F.concat(
        F.lit("for user "), F.col("k"), F.lit(" from User (root) then user in "), F.col("event_type"),
        F.lit(" USER "), F.col("event_type"),
    )
    tokens = _events(spark, sf_dir).select("LineId", masking.tokenize(line).alias("t"))
    return tokens.select("LineId", _joined(masking.mask_user(F.col("t"))).alias("tokens"))


def b8(spark, sf_dir):
    lines = _urls(spark, sf_dir).select(
        "page_id", F.concat(F.lit("GET = 7up [a_b] "), "url", F.lit(" size="), "page_id").alias("Content")
    )
    preset = Preset("", (r"example\.\w+",), r"(\s+|=|\[|\])", leading_digit=True)
    done = preprocess(lines, preset)
    return done.select("page_id", F.replace("Signature", F.lit(masking.SEP), F.lit("|")).alias("tokens"), "NTokens")


# ---------------------------------------------------------------------------------------------------------------
# Similarity and text functions


def _token_pairs(spark, sf_dir):
    """Each message beside the template of its type."""
    return _crossed_pairs(spark, sf_dir).where(F.col("Pair") == 0)


def _crossed_pairs(spark, sf_dir):
    """Each message beside the template of its type (``Pair`` 0), beside that of the next type (1), and beside both (2)."""
    messages = parse_log_lines(_events(spark, sf_dir), FORMAT, keep=("LineId", "event_type"))
    kinds = list(SENTENCES)
    own = _by_type(lambda kind: F.lit(TEMPLATES[kind]))
    other = _by_type(lambda kind: F.lit(TEMPLATES[kinds[(kinds.index(kind) + 1) % len(kinds)]]))
    beside = F.posexplode(F.array(own, other, F.concat(other, F.lit(" "), own))).alias("Pair", "Template")
    return messages.select("LineId", "Content", beside).select(
        "LineId", "Pair", "Content", "Template", masking.tokenize(F.col("Template")).alias("t"),
        masking.tokenize(F.col("Content")).alias("m"),
    )


def c1(spark, sf_dir):
    return _crossed_pairs(spark, sf_dir).select(
        "LineId", "Pair", similarity.position_similarity(F.col("t"), F.col("m")).alias("similarity"),
        similarity.wildcard_count(F.col("t")).alias("wildcards"),
    )


def c2(spark, sf_dir):
    return _crossed_pairs(spark, sf_dir).select(
        "LineId", "Pair", similarity.ngram_similarity(F.col("t"), F.col("m"), 2).alias("similarity")
    )


def c3(spark, sf_dir):
    return _crossed_pairs(spark, sf_dir).select(
        "LineId", "Pair", similarity.jaccard_similarity(F.col("t"), F.col("m")).alias("similarity")
    )


def c4(spark, sf_dir):
    return _crossed_pairs(spark, sf_dir).select(
        "LineId", "Pair", similarity.combined_similarity(F.col("t"), F.col("m"), "combined", 3).alias("similarity")
    )


def c5(spark, sf_dir):
    tokens = text.message_tokens(F.concat(F.regexp_replace("url", "[0-9]+", "<*>"), F.lit(" <*> (<*>) a|b 'c'")))
    urls = _urls(spark, sf_dir).select("page_id", tokens.alias("t"))
    return urls.select("page_id", _joined("t").alias("tokens"), F.size("t").alias("n_tokens"))


def c6(spark, sf_dir):
    return _crossed_pairs(spark, sf_dir).select(
        "LineId", "Pair", text.template_similarity(F.col("Template"), F.col("Content")).alias("similarity")
    )


def c7(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id")
    return docs.select("doc_id", text.event_id(F.col("text")).alias("event_id"))


def c8(spark, sf_dir):
    return _token_pairs(spark, sf_dir).select("LineId", text.render_template(F.col("m")).alias("text"))


def c9(spark, sf_dir):
    pairs = _token_pairs(spark, sf_dir)
    loose = F.replace("Template", F.lit("id <*>"), F.lit("id x<*>y"))
    strict = F.replace("Template", F.lit("uid <*>"), F.lit("uid x<*>y"))
    return pairs.select(
        "LineId",
        text.lenient_template_equal(loose, F.col("Template")).alias("loose_truth"),
        text.lenient_template_equal(F.col("Template"), strict).alias("loose_parsed"),
    )


def c10(spark, sf_dir):
    return _messages(spark, sf_dir).select("LineId", text.convert_date(F.col("Date")).alias("date"))


# ---------------------------------------------------------------------------------------------------------------
# Mining


def _counts_and_sample(structured: DataFrame) -> DataFrame:
    return structured.select("LineId", "EventId", "EventTemplate")


def d2(spark, sf_dir):
    lines = _signatures(spark, sf_dir)
    mining = mine_templates(lines, PRESET.method, PRESET.st, mode="sequential")
    return _counts_and_sample(assign_templates(lines, mining))


def d3(spark, sf_dir):
    lines = _signatures(spark, sf_dir)
    return mined_template_counts(mine_templates(lines, PRESET.method, PRESET.st))


def d3_jaccard(spark, sf_dir):
    lines = _signatures(spark, sf_dir)
    return mined_template_counts(mine_templates(lines, "jaccard", 0.4))


def d3_combined(spark, sf_dir):
    lines = _signatures(spark, sf_dir)
    return mined_template_counts(mine_templates(lines, "combined", 0.6))


def d4(spark, sf_dir):
    """All messages of a type merged into one template."""
    ws = Workspace(spark)
    lines = _signatures(spark, sf_dir)
    sigs = ws.table(with_tokens(signature_table(lines)), "signatures")
    kind = F.element_at("Tokens", 1)
    oldest = sigs.groupBy(kind.alias("kind")).agg(F.min("First").alias("ClusterId"))
    members = sigs.withColumn("kind", kind).join(oldest, "kind").drop("kind")
    merged = merge_template(ws.table(members, "members"))
    return merged.select(text.render_template(F.col("Tokens")).alias("EventTemplate"), "n", "Last")


def d5(spark, sf_dir):
    lines = _signatures(spark, sf_dir)
    mining = mine_templates(lines, PRESET.method, PRESET.st)
    return _counts_and_sample(assign_templates(lines, mining))


def d6(spark, sf_dir):
    return template_counts(_structured(spark, sf_dir))


def d7(spark, sf_dir):
    pairs = _token_pairs(spark, sf_dir).select("LineId", "Content", F.col("Template").alias("EventTemplate"))
    values = extract_parameters(pairs).select("LineId", "ParameterList")
    return values.select("LineId", _joined("ParameterList").alias("parameters"), F.size("ParameterList").alias("n"))


def d7_documents(spark, sf_dir):
    """Every document line under a template of its own, in which at most eight of its words are wildcards."""
    words = masking.tokenize(F.col("Content"), r"\s+")
    lines = _document_messages(spark, sf_dir).withColumn("words", words)
    every = F.expr("size(words) DIV 8 + 1")
    masked = F.transform("words", lambda word, i: F.when(i % every == every - 1, masking.WILDCARD).otherwise(word))
    values = extract_parameters(lines.select("LineId", "Content", F.array_join(masked, " ").alias("EventTemplate")))
    return values.select("LineId", F.md5(_joined("ParameterList")).alias("parameters"), F.size("ParameterList").alias("n"))


def d7_adjacent(spark, sf_dir):
    """Neighbouring wildcards: one value in the default mode, one each without collapsing."""
    lines = _events(spark, sf_dir).select(
        "LineId", F.concat(F.lit("copy "), "k", F.lit(" "), "event_type", F.lit(" done")).alias("Content"),
        F.lit("copy <*> <*> done").alias("EventTemplate"),
    )
    one = extract_parameters(lines).select(F.lit("collapsed").alias("Mode"), "LineId", _joined("ParameterList").alias("parameters"))
    each = extract_parameters(lines, collapse_wildcards=False)
    return one.unionByName(each.select(F.lit("separate").alias("Mode"), "LineId", _joined("ParameterList").alias("parameters")))


def d8(spark, sf_dir):
    structured = parse_logs(_events(spark, sf_dir), PRESET).structured
    return structured.withColumn("ParameterList", _joined("ParameterList"))


def d8_files(spark, sf_dir):
    """A folder of files whose line numbers all begin at 1."""
    loaded = load_log(spark, _event_files(spark, sf_dir, F.col("value")), FORMAT)
    return parse_messages(loaded, PRESET).structured.select(
        _file_number(), "LineId", "Content", "EventId", "EventTemplate", _joined("ParameterList").alias("ParameterList")
    )


def d8_documents(spark, sf_dir):
    """Free text as messages: every line of every document with its template and parameters."""
    structured = parse_messages(_document_messages(spark, sf_dir), Preset("", st=0.5, method="seqDist")).structured
    return structured.withColumn("ParameterList", _joined("ParameterList"))


def d9(spark, sf_dir):
    lines = _signatures(spark, sf_dir)
    age = _by_type(lambda kind: F.lit(list(SENTENCES).index(kind)))
    known = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().select(
        age.cast("bigint").alias("ClusterId"),
        masking.tokenize(_by_type(lambda kind: F.lit(TEMPLATES[kind]))).alias("Tokens"),
    )
    known = known.select(F.size("Tokens").cast("string").alias("Bucket"), "ClusterId", "Tokens")
    return match_templates(lines, known, 0.6).select("LineId", "ClusterId", "Score")


# ---------------------------------------------------------------------------------------------------------------
# Correction


def _corrected(rule):
    def query(spark, sf_dir):
        return _rough_templates(spark, sf_dir).select("page_id", rule(F.col("EventTemplate")).alias("template"))

    return query


def e1_documents(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents", "doc_id")
    return docs.select("doc_id", F.md5(correction.correct_template(F.col("text"))).alias("digest"))


def e2(spark, sf_dir):
    return correction.correct_templates(_rough_templates(spark, sf_dir))


# ---------------------------------------------------------------------------------------------------------------
# Evaluation


def _labels(spark, sf_dir):
    """Labels, and a parse that renames, merges, splits and loses some of them."""
    events = _read(spark, sf_dir, "events", "event_id")
    group = F.col("user_id") % 7
    label = F.concat("event_type", F.lit(" "), group.cast("string"), F.lit(" <*>"))
    truth = events.select(
        F.col("event_id").alias("LineId"), F.when(F.col("event_id") % 97 != 0, label).alias("EventTemplate")
    )
    parsed = events.select(
        F.col("event_id").alias("LineId"),
        F.when((F.col("event_type") == "signup") & (F.col("event_id") % 89 == 0), F.lit(None))
        .when(group == 3, F.concat("event_type", F.lit(" 3<*> <*>")))
        .when(group >= 5, F.concat("event_type", F.lit(" 5 <*>")))
        .when(
            (F.col("event_type") == "view") & (group == 1),
            F.concat(F.lit("view 1 "), (F.col("event_id") % 3).cast("string"), F.lit(" <*>")),
        )
        .otherwise(label).alias("EventTemplate"),
    )
    return truth, parsed


WANTED = ["view 0 <*>", "view 1 <*>", "click 3 <*>", "click 5 <*>", "signup 2 <*>", "error 6 <*>", "nothing <*>"]


def _pairs(spark, sf_dir):
    return Workspace(spark).table(evaluation.template_pairs(*_labels(spark, sf_dir)), "pairs")


def f1(spark, sf_dir):
    return evaluation.valid_rows(*_labels(spark, sf_dir))


def _metric(function, *args):
    def query(spark, sf_dir):
        return function(_pairs(spark, sf_dir), *args)

    return query


def f9(spark, sf_dir):
    return evaluation.evaluate(*_labels(spark, sf_dir))


def f10(spark, sf_dir):
    return evaluation.evaluate_full(*_labels(spark, sf_dir))


def f11(spark, sf_dir):
    events = _events(spark, sf_dir)
    messages = parse_log_lines(events, FORMAT)
    truth = events.select("LineId", _by_type(lambda kind: F.lit(TEMPLATES[kind])).alias("EventTemplate"))
    merged = events.select(
        "LineId", _by_type(lambda kind: F.lit(TEMPLATES["view" if kind == "error" else kind])).alias("EventTemplate")
    )
    suite = {"labelled": Labelled(messages, truth, PRESET), "mislabelled": Labelled(messages, merged, PRESET)}
    return benchmark_suite(suite).drop("P_Time")


# ---------------------------------------------------------------------------------------------------------------
# Streaming


def _event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return parse_log_lines(_with_lines(stream), FORMAT)


def g1(spark, sf_dir):
    out = Workspace(spark).path("assigned")

    def sink(lines, batch_id):
        lines.select("LineId", "EventId", "EventTemplate").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    TemplateStream(spark, PRESET, sink).start(_event_stream(spark, sf_dir), availableNow=True).awaitTermination()
    return spark.read.parquet(out).select("LineId", "EventId", "EventTemplate")


def g1_state(spark, sf_dir):
    state_store_options(spark)
    ws = Workspace(spark)
    out = ws.path("assigned")
    query = (
        assign_stream(_event_stream(spark, sf_dir), PRESET).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", ws.path("progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).select("LineId", "Template")


def g2(spark, sf_dir):
    ws = Workspace(spark)
    out = ws.path("running")
    stream = _event_stream(spark, sf_dir)
    level = F.lower("Level")
    labelled = stream.select(text.event_id(level).alias("EventId"), level.alias("EventTemplate"))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        template_counts_stream(labelled).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", ws.path("progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    # the newest count of every event is its largest
    return spark.read.parquet(out).groupBy("EventId", "EventTemplate").agg(F.max("Occurrences").alias("Occurrences"))


# ---------------------------------------------------------------------------------------------------------------
# Miners known from their descriptions


def h1(spark, sf_dir):
    messages = _messages(spark, sf_dir).select("LineId", "Content")
    return mined_template_counts(mine_slct(messages, support=_slct_support(spark, sf_dir)))


def _slct_support(spark, sf_dir):
    # numbers stay below one line in 20, sentence words lie above
    return spark.read.parquet(f"{sf_dir}/events.parquet").count() // 20


def h1_documents(spark, sf_dir):
    messages = _document_messages(spark, sf_dir)
    return mined_template_counts(mine_slct(messages, support=20, combine=False))


def h1_combined(spark, sf_dir):
    messages = _document_messages(spark, sf_dir)
    return mined_template_counts(mine_slct(messages, support=20, combine=True))


def h1_outliers(spark, sf_dir):
    messages = _document_messages(spark, sf_dir)
    return slct_outliers(messages, mine_slct(messages, support=20))


def h2(spark, sf_dir):
    messages = _messages(spark, sf_dir).select("LineId", "Content")
    return mined_template_counts(mine_iplom(messages))


def h3(spark, sf_dir):
    messages = _messages(spark, sf_dir).select("LineId", "Content")
    return mined_template_counts(mine_drain(messages, depth=4, st=0.5))


def h4(spark, sf_dir):
    messages = _messages(spark, sf_dir).select("LineId", "Content")
    return mined_template_counts(mine_spell(messages, tau=0.5))


# ---------------------------------------------------------------------------------------------------------------
# The contract


def entry(spark: SparkSession) -> DataFrame:
    """Raw lines to event templates with their ids and counts."""
    return parse_logs(_events(spark, "/root/testdata/sf0.001"), PRESET).templates


try:
    from lineloom.llm import oracles as _llm_oracles, queries as _llm_queries

    import corpus_pipeline
except ModuleNotFoundError as missing:  # the subpackage is optional: everything else works without it
    if missing.name not in ("lineloom.llm", "corpus_pipeline"):
        raise
    _llm_queries = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = _own_queries()
    if _llm_queries is not None:
        found |= _llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return found


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "A1_read_log_lines": a1,
        "A2_line_id_physical": a2_physical,
        "A2_line_id_matched": a2_matched,
        "A4_parse_log_lines": a4,
        "A4_optional_header": a4_optional,
        "A5_load_log": a5,
        "A6_load_report": a6,
        "A8_read_structured_csv": a8_structured,
        "A8_read_templates_csv": a8_templates,
        "A9_write_structured": a9,
        "A10_write_templates": a10,
        "A11_correct_templates_batch": a11,
        "A12_read_messages": a12,
        "B1_mask_patterns": b1,
        "B2_tokenize": b2,
        "B2_tokenize_documents": b2_documents,
        "B3_mask_assignment": _masked_urls(masking.mask_assignment),
        "B4_mask_user": b4,
        "B5_mask_leading_digit": _masked_urls(masking.mask_leading_digit),
        "B6_mask_special_chars": _masked_urls(masking.mask_special_chars),
        "B7_mask_path_dash": _masked_urls(masking.mask_path_dash),
        "B8_preprocess": b8,
        "C1_position_similarity": c1,
        "C2_ngram_similarity": c2,
        "C3_jaccard_similarity": c3,
        "C4_combined_similarity": c4,
        "C5_message_tokens": c5,
        "C6_template_similarity": c6,
        "C7_event_id": c7,
        "C8_render_template": c8,
        "C9_lenient_template_equal": c9,
        "C10_convert_date": c10,
        "D2_mine_sequential": d2,
        "D3_mine_leader": d3,
        "D3_mine_leader_jaccard": d3_jaccard,
        "D3_mine_leader_combined": d3_combined,
        "D4_merge_template": d4,
        "D5_assign_templates": d5,
        "D6_template_counts": d6,
        "D7_extract_parameters": d7,
        "D7_extract_parameters_documents": d7_documents,
        "D7_adjacent_wildcards": d7_adjacent,
        "D8_parse_logs": d8,
        "D8_parse_files": d8_files,
        "D8_parse_documents": d8_documents,
        "D9_match_templates": d9,
        "E1_correct_template": _corrected(correction.correct_template),
        "E1_correct_documents": e1_documents,
        "E1a_double_space": _corrected(correction.trim_blanks),
        "E1b_digit_token": _corrected(correction.digit_tokens),
        "E1c_word_with_variable": _corrected(correction.words_with_variable),
        "E1d_dotted_consecutive": _corrected(correction.dotted_and_consecutive),
        "E1e_hash_wrapped": _corrected(correction.hash_wrapped),
        "E1f_joined": _corrected(correction.joined_variables),
        "E1g_quoted": _corrected(correction.quoted_variables),
        "E2_correct_templates": e2,
        "F1_valid_rows": f1,
        "F2_grouping_accuracy": lambda spark, d: evaluation.grouping_accuracy(_pairs(spark, d)).select("GA"),
        "F3_pga_rga_fga": lambda spark, d: evaluation.grouping_accuracy(_pairs(spark, d)).drop("GA"),
        "F4_template_accuracy": _metric(evaluation.template_accuracy),
        "F5_parsing_accuracy": _metric(evaluation.parsing_accuracy),
        "F6_parsing_accuracy_lenient": _metric(evaluation.parsing_accuracy_lenient),
        "F7_exact_match_accuracy": _metric(evaluation.exact_match_accuracy),
        "F8_filtered_grouping": _metric(evaluation.grouping_accuracy, WANTED),
        "F8_filtered_template": _metric(evaluation.template_accuracy, WANTED),
        "F8_filtered_parsing": _metric(evaluation.parsing_accuracy, WANTED),
        "F8_filtered_lenient": _metric(evaluation.parsing_accuracy_lenient, WANTED),
        "F9_evaluate": f9,
        "F10_evaluate_full": f10,
        "F11_benchmark_suite": f11,
        "G1_mine_stream": g1,
        "G1_mine_stream_state": g1_state,
        "G2_template_counts_stream": g2,
        "H1_mine_slct": h1,
        "H1_mine_slct_documents": h1_documents,
        "H1_slct_combined": h1_combined,
        "H1_slct_outliers": h1_outliers,
        "H2_mine_iplom": h2,
        "H3_mine_drain": h3,
        "H4_mine_spell": h4,
    }


def oracle_sql() -> dict[str, str]:
    from oracles import build

    found = build(SENTENCES, TEMPLATES, WANTED, masking.KEEP_WORDS)
    if _llm_queries is not None:
        found |= _llm_oracles.oracle_sql()
        if corpus_pipeline.ORACLE_SQL is not None:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
