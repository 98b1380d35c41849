import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import brute
from lineloom.functions import correction, masking, similarity, text
from lineloom.operators.messages import preprocess
from lineloom.plans.presets import PRESETS, Preset


def on_tokens(spark, rows, mask):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    return [r.o for r in df.select("i", mask(F.col("t")).alias("o")).orderBy("i").collect()]


def on_text(spark, rows, function):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.o for r in df.select("i", function(F.col("x")).alias("o")).orderBy("i").collect()]


def test_tokenize(spark):
    assert on_text(spark, ["a  b=[c] d", "", "=="], lambda c: masking.tokenize(c, r"(\s+|\[|\]|=)")) == [
        ["a", "  ", "b", "=", "[", "c", "]", " ", "d"], [], ["=", "="],
    ]
    assert on_text(spark, [" a,b ,c"], lambda c: masking.tokenize(c, "[ ,]+")) == [["a", "b", "c"]]
    with pytest.raises(ValueError):
        masking.mark_tokens(F.lit("x"), "(a)(b)")


def test_token_masks(spark):
    assert on_tokens(spark, [["7", "7up", "up7"], []], masking.mask_leading_digit) == [["<*>", "<*>", "up7"], []]
    assert on_tokens(spark, [["a/b:c", "a_b_c", "a_b_c_d", "::", "#@", "a"]], masking.mask_special_chars) == [
        ["<*>", "a_b_c", "<*>", "::", "<*>", "a"]
    ]
    assert on_tokens(spark, [["a-b", "/x", "ab"]], masking.mask_path_dash) == [["<*>", "<*>", "ab"]]
    assert on_tokens(spark, [["=", "x", "=", "=", "y", "=", " ", "z", "="]], masking.mask_assignment) == [
        ["=", "<*>", "=", "=", "<*>", "=", " ", "z", "="]
    ]


def test_mask_user(spark):
    cases = {
        ("user", " ", "bob"): ["user", " ", "<*>"],
        ("User", " ", "bob", " ", "x"): ["User", " ", "<*>", " ", "x"],
        ("user", " ", "in", " ", "bob"): ["user", " ", "in", " ", "bob"],
        ("user", " ", "(x"): ["user", " ", "(x"],
        ("user", "bob"): ["user", "bob"],
        # the second name is gone before it could protect the third
        ("user", " ", "user", " ", "bob"): ["user", " ", "<*>", " ", "bob"],
        ("user", "user", "a", "b"): ["user", "user", "<*>", "<*>"],
        (): [],
    }
    assert on_tokens(spark, [list(c) for c in cases], masking.mask_user) == list(cases.values())


def test_preprocess_equals_single_steps(spark):
    contents = [
        "user 7up logged in /var/log x=5 y= 6", "a=b=c 12 [x] core.17", "", None, "uSer bob is at 10.0.0.1:80",
        "user user user bob", "k = v = w", "a__b__c #1@2",
    ]
    preset = Preset("", (r"(\d+\.){3}\d+(:\d+)?",), r"(\s+|\[|\]|=)", leading_digit=True)
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, Content string")
    marked = preprocess(df, preset).select("i", masking.marked_to_tokens(F.col("Signature")).alias("t"), "NTokens")
    fused = {r.i: r.t for r in marked.collect()}
    assert all(len(r.t) == r.NTokens for r in marked.collect())
    step = df.withColumn("t", masking.tokenize(masking.mask_patterns(F.coalesce("Content", F.lit("")), preset.masks), preset.splitters))
    for mask in (
        masking.mask_assignment, masking.mask_user, masking.mask_leading_digit, masking.mask_special_chars,
        masking.mask_path_dash,
    ):
        step = step.withColumn("t", mask(F.col("t")))
    assert fused == {r.i: r.t for r in step.collect()}
    assert fused[0][:3] == ["user", " ", "<*>"]


def test_presets_compile(spark):
    df = spark.createDataFrame([("x=1 a/b [q]",)], "Content string")
    for preset in PRESETS.values():
        assert preprocess(df, preset).first().NTokens > 0
    assert len(PRESETS) == 16
    assert sum(p.leading_digit for p in PRESETS.values()) == 9


def test_similarities(spark):
    t, m = ["a", " ", "<*>", " ", "c"], ["a", " ", "x", " ", "d"]
    df = spark.createDataFrame([(t, m), ([], [])], "t array<string>, m array<string>")
    row, empty = df.select(
        similarity.position_similarity(F.col("t"), F.col("m")).alias("p"),
        similarity.wildcard_count(F.col("t")).alias("w"),
        similarity.jaccard_similarity(F.col("t"), F.col("m")).alias("j"),
    ).collect()
    assert (row.p, row.w) == (0.6, 1)
    assert row.j == pytest.approx(2 / 6)
    assert (empty.p, empty.j) == (None, 0.0)
    pairs = [(a, b) for _, a in brute.random_messages(5, 20) for _, b in brute.random_messages(6, 20) if len(a) == len(b)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, t array<string>, m array<string>")
    for method in similarity.METHODS:
        out = df.select("i", similarity.combined_similarity(F.col("t"), F.col("m"), method, 3).alias("s"))
        for r in out.collect():
            assert r.s == pytest.approx(brute.scores(*pairs[r.i], 3)[method])
    bound = df.select(
        similarity.ngram_bound(similarity.ngrams(F.col("t"), 3), similarity.ngrams(F.col("m"), 3)).alias("b"),
        similarity.ngram_similarity(F.col("t"), F.col("m"), 3).alias("s"),
    )
    assert bound.where("b < s").count() == 0


def test_text_functions(spark):
    assert on_text(spark, ["", "abc"], text.event_id) == ["d41d8cd9", "90015098"]
    assert on_text(spark, ["2024-03-09"], text.convert_date) == ["09/03/2024"]
    assert on_text(spark, ["a <*> <*>.x(b) c'd", "  ", "f=1 <*>"], text.message_tokens) == [
        ["a", "<*>", "x", "(", "b", ")", "c", "d"], [], ["f", "=", "1", "<*>"],
    ]
    df = spark.createDataFrame([("x <*>y z", "x <*> z"), ("x <*> z", "x <*>y z"), ("a", "b")], "g string, p string")
    same = df.select(text.lenient_template_equal(F.col("g"), F.col("p")).alias("e")).collect()
    assert [r.e for r in same] == [True, False, False]


def test_correction_cases(spark):
    given_, expected = zip(
        ("on 10.0.0.1:80 at  <*>s", "on <*> at <*>"), ("x #12# y", "x <*> y"), ('say "<*>" ok', "say <*> ok"),
        ("a<*> #1# #2# '3' '4' x", "<*> <*> <*> <*> <*> x"),
    )
    assert on_text(spark, given_, correction.correct_template) == list(expected)


def test_correction_equals_stepwise(spark):
    rng = random.Random(11)
    parts = ["<*>", "12", " ", " ", ".", ":", "#", "/", "@", '"', "'", "a", "b7", "-", "="]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(6000)]
    assert on_text(spark, rows, correction.correct_template) == [brute.correct(r) for r in rows]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab=[] /-_:7", max_size=20), min_size=1, max_size=20))
def test_tokens_restore_the_text(spark, rows):
    done = on_text(spark, rows, lambda c: text.render_template(masking.tokenize(c, r"(\s+|\[|\]|=)")))
    assert done == rows


def test_message_tokens_are_computed_once(spark):
    df = spark.createDataFrame([("a <*> <*> b, c", "a <*> b"), (None, "a"), ("", " ")], "a string, b string")
    plan = lambda column: df.select(column.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    # a cleaning pattern for each text, not one for every use of its tokens
    assert plan(text.message_tokens(F.col("a"))).count("regexp_replace") == 1
    assert plan(text.template_similarity(F.col("a"), F.col("b"))).count("regexp_replace") == 2
    assert [r[0] for r in df.select(text.template_similarity(F.col("a"), F.col("b"))).collect()] == [0.75, None, None]


def test_ngram_ratio_is_computed_once_a_shape(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abc") for _ in range(rng.randrange(9))]) for _ in range(200)]
    pairs += [([str(i % 5), " "] * 110, [str(i % 3), " ", "x"] * 90) for i in range(3)] + [(None, ["a", "b"]), (["a", None, "b"], ["a", None])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, t array<string>, m array<string>")
    for n in (2, 3):
        got = {r.i: r.s for r in df.select("i", similarity.ngram_similarity(F.col("t"), F.col("m"), n).alias("s")).collect()}
        assert got == {i: None if t is None else similarity.sequence_ratio(t, m, n) for i, (t, m) in enumerate(pairs)}
    calls = []
    whole = similarity.sequence_ratio
    monkeypatch.setattr(similarity, "sequence_ratio", lambda *args: calls.append(args) or whole(*args))
    ratio = similarity.shaped_ratio(2)
    assert {ratio(["page", "<*>", "to", "<*>"], ["page", str(i), "to", f"u{i}"]) for i in range(50)} == {0.0}
    assert len(calls) == 1


def test_ngram_bound_on_numbers(spark):
    rng = random.Random(9)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(9))], [rng.choice("abcd") for _ in range(rng.randrange(9))]) for _ in range(150)]
    df = spark.createDataFrame(pairs, "t array<string>, m array<string>")
    grams = df.select("t", "m", similarity.ngram_hashes(F.col("t"), 2).alias("a"), similarity.ngram_hashes(F.col("m"), 2).alias("b"))
    assert dict(grams.dtypes)["a"] == "array<bigint>"
    for r in grams.withColumn("bound", similarity.ngram_bound(F.col("a"), F.col("b"))).collect():
        assert similarity.sequence_ratio(r.t, r.m, 2) <= r.bound <= 1.0
