"""The operators against plain loops on small tables with every awkward row."""

import hashlib
import re
import string
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lineloom.llm import (
    decontamination, license_scan, line_dedup, near_duplicates, secret_scan, source_mix, substring_dedup, toxicity,
    url_reputation, vector_search,
)

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id bigint, text string, source string, row string, n bigint, hits string, kept string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed, count):
    rng = np.random.default_rng(seed)
    return [f"w{rng.integers(0, 5000)}" for _ in range(count)]


BASE = prose(1, 120)
PASSAGE = " ".join(prose(2, 50))
LINE = "This Line stands in very many documents"


def rows():
    texts = [None, "", "   ", "\n\n", "one", "Ünïcode \t wörds\x0bhere"]
    texts += [" ".join(BASE)] * 3
    for i in range(1, 8):
        changed = list(BASE)
        for k in range(i):
            changed[(7 * i + 31 * k) % len(changed)] = f"x{i}{k}"
        texts.append(" ".join(changed))
    texts += [" ".join(prose(i, 30)) + " " + PASSAGE + " " + " ".join(prose(i + 50, 30)) for i in range(3, 6)]
    texts += [f"{LINE}\nown {i}\n  {LINE.upper()}  \nshort\nshort" for i in range(4)]
    texts += [" ".join(prose(9, 5000)), "All rights reserved. cc by cc-BY x General Public\nLicense"]
    out = [(i, t, (None, "a", "b", "ä")[i % 4], "r", 1, "h", "k") for i, t in enumerate(texts)]
    return out + [out[6], out[-1], (None, PASSAGE, "a", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def as_set(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_substring_dedup(docs, empty):
    texts = [(r[0], words(r[1])) for r in rows()]
    places = defaultdict(int)
    for _, w in texts:
        for i in range(len(w) - 34):
            places[tuple(w[i:i + 35])] += 1
    want = []
    for doc, w in texts:
        gone = {j for i in range(len(w) - 34) if places[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        want.append((doc, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    report = substring_dedup.removal_report(substring_dedup.remove_repeats(docs))
    assert as_set(report, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)
    assert substring_dedup.remove_repeats(empty).count() == 0
    paths = substring_dedup.repeated_paths(docs).collect()
    assert all(p.places > 1 and p.n_words >= 35 for p in paths) and any(p.n_words >= 50 for p in paths)


def test_line_dedup(docs, empty):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for r in rows():
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add(r[0])
    want = []
    for r in rows():
        lines = (r[1] or "").split("\n")
        gone = lambda l: len(key(l)) >= 20 and len(holders[key(l)]) >= 3 and r[0] != max(  # noqa: E731, E741
            i for i in holders[key(l)] if i is not None)
        kept = [x for x in lines if not gone(x)]
        want.append((r[0], len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    done = line_dedup.drop_shared_lines(docs)
    assert as_set(line_dedup.line_report(done), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=str)
    assert line_dedup.with_kept_text(done, docs.columns).columns == docs.columns
    assert line_dedup.drop_shared_lines(empty).count() == 0


def test_source_mix(docs, empty):
    shares, draws = source_mix.mix_plan(docs, block_words=200, shard_blocks=4)
    report = source_mix.mix_report(shares, draws).collect()
    assert sorted((r.doc_id, r.size) for r in report if r.doc_id is not None) == sorted(
        (r[0], len(words(r[1]))) for r in rows() if r[0] is not None)
    assert all(0 <= r.taken <= 2 * r.size for r in report)
    by = defaultdict(list)
    for r in report:
        by[(r.source_size, r.target)].append(r)
    for (size, target), members in by.items():
        assert sum(m.size for m in members) == size and abs(sum(m.taken for m in members) - target) <= 0.51
    again = source_mix.mix_report(*source_mix.mix_plan(docs, block_words=200, shard_blocks=4)).collect()
    assert sorted(map(str, again)) == sorted(map(str, report))
    shards = draws.collect()
    assert len({(d.source_no, d.block, d.round) for d in shards}) == len(shards)
    assert source_mix.mix_report(*source_mix.mix_plan(empty)).count() == 0


def test_source_mix_below_size(spark):
    """``b`` gives less than it holds: only blocks of which words are taken are drawn, and they spread over all shards."""
    rows_ = [(i, " ".join(prose(i, 10)), "abc"[i % 3]) for i in range(900)] + [(900 + i, "", "b") for i in range(5)]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string, source string")
    shares, draws = source_mix.mix_plan(docs, block_words=50, shard_blocks=12)
    shares, draws = shares.collect(), draws.collect()
    assert all(s.rounds == 0 and s.target < s.source_size for s in shares if s.source == "b")
    taken, want = defaultdict(int), set()
    for s in shares:
        for k in range(-(-s.taken // s.size) if s.size else 0):
            want.add((s.source_no, s.block, k))
            taken[(s.source_no, s.block, k)] += min(s.size, s.taken - k * s.size)
    assert {(d.source_no, d.block, d.round) for d in draws} == want and len(draws) == len(want)
    given, seats = defaultdict(int), defaultdict(int)
    for d in draws:
        given[(d.shard, d.source_no)] += taken[(d.source_no, d.block, d.round)]
        seats[(d.shard, d.source_no)] += 1
    shards = {d.shard for d in draws}
    assert shards == set(range(-(-len(want) // 12))) and max(
        sum(seats[(h, n)] for n in range(3)) for h in shards) <= 12
    for n in range(3):
        mean = sum(given[(h, n)] for h in shards) / sum(seats[(h, n)] for h in shards)
        for h in shards:  # a block holds about five documents of ten words
            assert abs(given[(h, n)] - mean * seats[(h, n)]) <= 5 * 22 * max(1, seats[(h, n)]) ** 0.5


def test_mixed_documents(spark):
    """The mix gives every source's target, by shard what the draws say, also where rows repeat an id and text."""
    table = [(i, " ".join(prose(i, 10)), ("a", "b", None)[i % 3]) for i in range(240)]
    table += [(900, " ".join(prose(900, 7)), "b")] * 60 + [(900, " ".join(prose(900, 7)), "a")]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, source string")
    shares, draws = source_mix.mix_plan(docs, block_words=50, shard_blocks=6)
    mixed = source_mix.mixed_documents(docs, shares, draws).collect()
    shares, draws = shares.collect(), draws.collect()
    block, want, target, got = defaultdict(list), defaultdict(int), {}, defaultdict(int)
    for s in shares:
        block[(s.source_no, s.block)].append(s)
        target[s.source] = s.target
    assert len({(d.source_no, d.block, d.round) for d in draws}) == len(draws)
    for d in draws:
        for s in block[(d.source_no, d.block)]:
            want[(d.shard, s.source, s.doc_id)] += min(s.size, max(0, s.taken - d.round * s.size))
    for m in mixed:
        assert 0 < m.words <= len(words(m.row.text))
        got[(m.shard, m.row.source, m.row.doc_id)] += m.words
    assert got == {k: n for k, n in want.items() if n}
    for name, aim in target.items():
        assert abs(sum(n for k, n in got.items() if k[1] == name) - aim) <= 0.51
    places = [(m.shard, m.place) for m in mixed]
    assert len(set(places)) == len(places)


def test_targets():
    found = source_mix.source_targets({"a": 100, "b": 100, None: 100, "c": 10})
    assert found == pytest.approx({"a": 200, "b": 83.333333, "c": 20, None: 161.666667}, abs=90)
    assert sum(found.values()) == pytest.approx(465)


def test_url_reputation(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.com/en/1?x#y", "https://a.example.com/en/2", "x://net/es/", "y://b.net/it/",
            "z://bad.org/1", "z://bad.org/2", "z://www.example.com", "q://h.co.uk#/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(7, "z://bad.org/1")], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(7, False), (8, False), (6, True), (None, True), (3, None)], "page_id bigint, good boolean")
    found = {r.page_id: r for r in url_reputation.judge_urls(pages, outcomes).collect()}
    assert (found[3].host, found[3].path, found[3].rule, found[3].verdict) == (
        "www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (found[4].rule, found[4].verdict) == ("example.com/en/", "block")
    assert (found[5].rule, found[9].rule, found[9].path, found[10].host, found[10].path) == ("net/es/", None, "", "h.co.uk", "")
    assert {(found[i].host, found[i].path) for i in (0, 1, 2)} == {("", "")}
    assert found[6].upper > found[7].upper
    assert url_reputation.judge_urls(pages.limit(0), outcomes.limit(0)).count() == 0


def test_license_scan(docs, empty):
    want = []
    for r in rows():
        w, places, labels = plain(r[1]), [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        want.append((r[0], len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    found = license_scan.scan_licences(docs)
    assert as_set(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=str)
    assert license_scan.scan_licences(empty).count() == 0


def test_license_templates(spark):
    text = "x y " + license_scan.TEMPLATES["mit"].text.replace("charge", "cost").upper() + " z"
    docs = spark.createDataFrame([(1, text), (2, "permission denied"), (3, "the software and the documentation")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in license_scan.scan_licences(docs).collect()}
    assert "mit" in found[1].labels.split(",") and 0.5 <= found[1].score <= 1
    assert found[2].labels == found[3].labels == ""


def test_license_templates_together(spark):
    """Every template is found in a text that holds all of them, and in one with rarer words of others strewn in."""
    everything = " filler words between ".join(t.text for t in license_scan.TEMPLATES.values())
    strewn = "redistribution attribution creative mozilla international binary permitted documentation compliance associated"
    texts = [everything, f"{strewn} released under the mit license", strewn]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in license_scan.template_matches(docs).groupBy("doc_id").agg(
        F.collect_set("label").alias("labels"), F.min("score").alias("score")).collect()}
    assert set(found[0].labels) == set(license_scan.TEMPLATES) and found[0].score == pytest.approx(1)
    assert found[1].labels == ["mit-notice"] and found[1].score == pytest.approx(1) and 2 not in found


def test_vector_search(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1500, 8))
    vectors[100:400] = vectors[0]
    table = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    table += [(5000, None), (5050, [0.0] * 8), (5100, [float("nan")] + [1.0] * 7), (5150, [None] + [1.0] * 7)]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>")
    found = vector_search.nearest_vectors(df, df.where("vec_id % 50 = 0")).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got, hit, asked = defaultdict(list), 0, range(0, 1500, 50)
    for r in sorted(found, key=lambda r: r.rank):
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(asked) and all(len(v) == 5 for v in got.values())
    for q in asked:
        score = np.round(unit @ unit[q], 12)
        score[q] = -2
        hit += len(set(np.lexsort((np.arange(1500), -score))[:5]) & set(got[q]))
    assert hit / (5 * len(asked)) >= 0.9
    assert got[100] == [0, 101, 102, 103, 104]
    assert vector_search.nearest_vectors(df.limit(0), df.limit(0)).count() == 0


def test_vector_search_repeated_rows(spark):
    """A row repeated ten times takes one place among the equal vectors."""
    same, other = [1.0, 2.0, 3.0], [-1.0, 0.5, 0.25]
    table = [(0, same)] * 10 + [(i, same) for i in range(1, 9)] + [(100 + i, other) for i in range(3)]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in sorted(vector_search.nearest_vectors(df, df.where("vec_id IN (0, 8)")).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    assert got == {0: [(i, 1.0) for i in range(1, 6)], 8: [(i, 1.0) for i in range(5)]}


def test_secret_scan(spark, docs, empty):
    key = "Zk3vQ9xT7bLw2RmN8pYcD5fH"
    texts = [f"password = '{key}' é", "token=secret=abcdefghijkl token: short", "AKIA" + "Z9" * 7 + " AKIAshort", "é deadbeefdeadbeef0 ff",
             f"id {key}! example{key} zzzzzzzzzzzzzzzzzzzzzzzz1 some-long-name-of-words-12", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in secret_scan.secret_report(secret_scan.find_secrets(df)).collect()}
    assert found[0] == "assign:0:36" and found[1] == "assign:0:25"
    assert found[2] == "access:0:18" and found[3] == "hex:2:19"
    assert found[4] == "entropy:3:27" and found[5] == ""
    assert secret_scan.find_secrets(docs).count() == docs.count() and secret_scan.find_secrets(empty).count() == 0


@pytest.mark.parametrize("value", ["aaaa", "abcdabcdabcd", "aabbccddeeff0011", "abc"])
def test_window_entropy(spark, value):
    def entropy(part):
        share = np.array([part.count(c) / len(part) for c in set(part)])
        return float(-(share * np.log2(share)).sum())

    want = max((entropy(value[i:i + 4]) for i in range(len(value) - 3)), default=-1)
    got = spark.range(1).select(secret_scan.window_entropy(F.lit(value), 4)).first()[0]
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("block_words", [200_000, 20])
def test_decontamination(spark, docs, empty, block_words, monkeypatch):
    items = [(1, " ".join(BASE[10:30])), (12, PASSAGE.upper()), (3, "rights reserved"), (4, None), (5, "?!"), (None, "one"), (3, "own 2")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    patterns = defaultdict(set)
    for i, t in items:
        w = plain(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            patterns[tuple(w[k:k + 10])].add("" if i is None else str(i))
    want = []
    for r in rows():
        w, hit, names = plain(r[1]), set(), set()
        for p, ids in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k:k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    names |= ids
        want.append((r[0], len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    found = decontamination.contamination_report(decontamination.find_contamination(docs, bench, block_words=block_words))
    assert as_set(found, *found.columns) == sorted(want, key=str)
    assert decontamination.find_contamination(empty, bench).count() == 0
    assert not decontamination.contamination_report(
        decontamination.find_contamination(docs, bench.limit(0))).where("contaminated").count()


@pytest.mark.parametrize("direct", [200, 1])
def test_near_duplicates(docs, empty, direct):
    sets = {}
    for r in rows():
        w = words((r[1] or "").translate(LOWER))
        sets[r[0]] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    part = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    found = near_duplicates.near_duplicates(docs, direct=direct)
    want = [(r[0], len(sets[r[0]]), part.get(r[0]), r[0] == part.get(r[0])) for r in rows()]
    assert as_set(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=str)
    if direct > 1:
        assert near_duplicates.near_duplicates(empty).count() == 0


def test_near_duplicate_stage(spark):
    """Similarities from 0.8 to below 0.85 are near copies for the pipeline and not for op9; below 0.8 for neither."""
    base, texts = prose(77, 300), {}
    for name, changed in ((1, ()), (2, (50, 100, 150, 200, 250, 280)), (3, (30, 60, 90, 120, 150, 180, 210))):
        own = [f"{name}_{i}" if i in changed else w for i, w in enumerate(base)]
        texts[name] = own
    shingles = {n: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for n, w in texts.items()}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    assert 0.8 <= alike(1, 2) < 0.85 and alike(1, 3) < 0.8 and alike(2, 3) < 0.8
    docs = spark.createDataFrame([(n, " ".join(w)) for n, w in texts.items()], "doc_id bigint, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert near_duplicates.near_duplicates(docs).where("kept").count() == 3
    assert (1 - 0.8 ** corpus_pipeline.NEAR_ROWS) ** corpus_pipeline.NEAR_BANDS < 1e-6


def labelled(spark):
    rng = np.random.default_rng(3)
    out, labels = [], []
    for i in range(400):
        lines = [" ".join(f"v{rng.integers(0, 60)}" for _ in range(8)).replace("v", "ab") + "." for _ in range(6)]
        toxic = i % 4 == 0
        if toxic:
            lines[3] = lines[3][:-1] + (" nasty." if i % 8 else " vile.")
        out.append((i, "\n".join(lines), "s"))
        labels.append((i, 1, int(toxic)))
    return (spark.createDataFrame(out + [(900, None, "s"), (901, "", None), (900, None, "s")], "doc_id bigint, text string, source string"),
            spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (901, 1, 0)], "doc_id bigint, quality int, toxic int"))


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    done = {r.doc_id: r for r in toxicity.toxicity_report(toxicity.score(docs, model)).collect()}
    held = [r for r in done.values() if r.held_out and r.doc_id < 400]
    assert held and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert done[900].score == done[901].score == 0
    text = {r.doc_id: r.text for r in docs.collect()}
    spans = [text[r.doc_id][s.start:s.end] for r in held if r.predicted for s in r.offending]
    assert spans and np.mean(["nasty" in s or "vile" in s for s in spans]) > 0.9
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark)
    docs.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("bigint")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing like it")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [s.__name__ for _, s in corpus_pipeline.STAGES] == [
        "toxicity_stage", "line_dedup_stage", "near_duplicate_stage", "decontamination_stage", "mixing_stage"]
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len([i for i in kept if i < 400 and i % 4]) >= 290 and len([i for i in kept if i < 400 and i % 4 == 0]) <= 8
