"""Brute force for the models, and cases of skew, repetition and length."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import DATA, brute_components, brute_fingerprint, brute_spans, documents

import corpus_pipeline
from jobloom.llm import components, decontamination, language_id, pii, quality_model, sampling, simhash, tables, tool_calls, url_filter, warc
from jobloom.llm.tables import fresh_path

# --- samples --------------------------------------------------------------------------------


@pytest.mark.parametrize("one_id", [7, 9, 10, 11, 12])
def test_rows_that_repeat_an_id_are_sampled(spark, one_id):
    rows = spark.range(3000).select(F.lit(one_id).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit("a").alias("lang"))
    rows = rows.union(spark.range(5000).selectExpr("1 AS doc_id", "'same' AS text", "'b' AS lang"))
    got = sampling.per_class_sample(rows, "lang", "doc_id", "text", 50).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"a": 50, "b": 1}


def test_no_class_is_left_out_of_the_sample(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "concat('t', id) AS text", "concat('l', id % 1500) AS lang")
    assert sampling.per_class_sample(rows, "lang", "doc_id", "text", 2).groupBy("lang").count().filter("count = 2").count() == 1500


# --- languages by brute force ---------------------------------------------------------------


def brute_grams(text):
    s = " " + " ".join("".join(c.lower() if len(c.lower()) == 1 and c.isalpha() else c if c.isalpha() else " " for c in text).split()) + " "
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} if any(c.isalpha() for c in text) else set()


def numbers(grams):
    return {int(language_id._numbers(np.array([ord(c) for c in g], np.uint32))[-1]) for g in grams}


def test_chunks_neither_add_nor_lose_ngrams():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("abé ,.ßX1") for _ in range(rng.randrange(40)))
        want = numbers(brute_grams(text))
        assert set(language_id.ngrams(text).tolist()) == want
        for chunk in (1, 2, 3, 7):
            assert set(np.concatenate([np.zeros(0, int), *language_id.ngram_chunks(text, chunk)]).tolist()) == want


def test_language_scores_by_brute_force(monkeypatch):
    rng = random.Random(2)
    make = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(5, 30)))
    texts = [(make("the of and that ing".split()), "en") for _ in range(30)] + [(make("der die und sch ung".split()), "de") for _ in range(30)]
    model = language_id.fit([language_id.ngrams(t) for t, _ in texts], [x for _, x in texts])
    new = ["the und", "sch sch", "thing of", "ab"]
    sets = [set(language_id.ngrams(t).tolist()) for t in new]
    marks = [set(np.flatnonzero(np.isin(model.column, m)).tolist()) for m in model.marks]
    k = np.array([[len(a & b) / np.sqrt(len(a)) / n for b, n in zip(marks, model.norms, strict=True)] for a in sets])
    want = np.hstack([k, np.ones((len(k), 1))]) @ model.weights
    for cells in (language_id.CELLS, 500):  # in one block and in many
        monkeypatch.setattr(language_id, "CELLS", cells)
        model.__dict__.pop("_kept", None)
        got, known = model.scores([language_id.ngram_chunks(t) for t in new])
        assert np.allclose(got, want, atol=1e-3) and known.all()
    # Kernel ridge regression on the Nyström features, solved by its dual.
    all_k = model.features(*model.presence([[language_id.ngrams(t)] for t, _ in texts])).astype(float)
    right = (all_k @ model.weights[:-1] + model.weights[-1]).argmax(axis=1)
    assert [model.languages[i] for i in right] == [x for _, x in texts]


def test_each_of_many_languages_has_landmarks():
    grams = [np.unique(np.random.default_rng(i).integers(0, 1 << 18, 20).astype(np.uint32)) for i in range(300)]
    model = language_id.fit(grams, [f"l{i % 150}" for i in range(300)])
    assert len(model.marks) == 300 and len(model.languages) == 150


# --- quality model by brute force -----------------------------------------------------------


def test_additive_scores_by_brute_force():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x, y)
    got = model.scores(x)
    for i in range(50):
        z = model.intercept
        place = [sum(v >= e for e in edges) for v, edges in zip(x[i], model.edges, strict=True)]
        z += sum(t[p] for t, p in zip(model.tables, place, strict=True)) + sum(t[place[a], place[b]] for a, b, t in model.pairs)
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
    assert ((got >= 0.5) == y).mean() > 0.9 and {(1, 0)} <= {(a, b) for a, b, _ in model.pairs}


def test_a_boosting_step_is_the_best_split():
    rng = np.random.default_rng(4)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.uniform(0.1, 1, 9)
        loss = lambda add: float((g * add + h * add * add / 2).sum() + quality_model.LAMBDA / 2 * sum(v * v for v in dict.fromkeys(add)))  # noqa: B023, E731
        leaf = lambda a, b: -g[a:b].sum() / (h[a:b].sum() + quality_model.LAMBDA)  # noqa: B023, E731
        every = [np.concatenate([np.full(c, leaf(0, c)), np.full(9 - c, leaf(c, 9))]) for c in range(1, 9)] + [np.full(9, leaf(0, 9))]
        assert abs(loss(quality_model._tree(g, h, 1)) - min(map(loss, every))) < 1e-9


def test_repeated_labelled_documents_stay_bounded(spark, monkeypatch):
    d = documents(spark, [(i % 3, f"word {i}", None, None, 0) for i in range(300)])
    seen = []
    monkeypatch.setattr(quality_model, "fit", lambda x, y: seen.append(len(x)) or quality_model.Model())
    quality_model.train(d, spark.range(3).selectExpr("id AS doc_id", "1 AS quality"))
    assert seen[0] <= 3


def test_keep_good_on_awkward_tables(spark):
    rows = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "x " * 300_000, 7)], "doc_id long, text string, `a.b` long")
    model = quality_model.Model(intercept=3.0)
    assert sorted(r["a.b"] for r in quality_model.keep_good(rows, model).collect()) == [5, 6, 7]
    assert quality_model.keep_good(rows.limit(0), model).count() == 0


# --- personal data by brute force -----------------------------------------------------------


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    model = pii.Model({}, np.zeros((1, k)), rng.normal(size=(k, k)))
    runs = [rng.normal(size=(n, k)) for n in (1, 2, 3, 3, 1, 4)]
    for run, got in zip(runs, pii.viterbi(model, runs), strict=True):
        value = lambda p: sum(run[i, x] for i, x in enumerate(p)) + sum(model.steps[a, b] for a, b in zip([0, *p], [*p, 0], strict=True))  # noqa: B023, E731
        best = max(itertools.product(range(k), repeat=len(run)), key=value)
        assert value(got.tolist()) == pytest.approx(value(best))


def test_gradient_by_differences():
    goal = pii.Likelihood(pii.labelled_rows(6, seed=1), 0.3)
    rng = np.random.default_rng(6)
    w, s = rng.normal(size=(len(goal.names) + 1, len(pii.LABELS))) / 5, rng.normal(size=(len(pii.LABELS),) * 2) / 5
    w[-1] = 0
    _, gw, gs = goal.value_and_slopes(w, s)
    for p, g in ((w, gw), (s, gs)):
        for _ in range(12):
            at = tuple(rng.integers(0, n - (p is w and i == 0)) for i, n in enumerate(p.shape))
            was = p[at]
            p[at] = was + 1e-5
            up = goal.value_and_slopes(w, s)[0]
            p[at] = was - 1e-5
            down = goal.value_and_slopes(w, s)[0]
            p[at] = was
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-3)


def test_query_of_personal_data_by_brute_force(spark):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in pii.op7_personal_data(spark, DATA).collect():
        want = sorted(brute_spans(texts[r["doc_id"]] or ""), key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert set(want) <= set(spans)
        more = sorted((a, b) for k, a, b in set(spans) - set(want))
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(more))


def test_neighbours_are_whole_and_however_far():
    far = "x" * 500 + "é" + " " * 900 + "12" + "\n" * 700 + "y" * 300
    a = far.index("12")
    assert pii._neighbours(far, a, a + 2) == ("x" * 500 + "é", "y" * 300)
    assert pii._neighbours("12", 0, 2) == ("", "") and pii._neighbours("  12  ", 2, 4) == ("", "")


def test_a_long_run_beside_short_ones_takes_its_own_time():
    import time

    model, start = pii.train(pii.labelled_rows(20), rounds=2), time.time()
    pii.all_spans([" ".join(["123"] * 40_000), *["a 12 b"] * 600, "1" * 300_000, "1 @ " * 5000], model)
    assert time.time() - start < 30


# --- SimHash, components and hot keys -------------------------------------------------------


def test_hot_keys_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 2)
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 3, "x") for i in range(200)], "id long, key long, `a.b` string")
    facts = spark.createDataFrame([(0, "zero"), (1, "one"), (9, "nine")], "key long, name string")
    for how in ("left", "inner"):
        got, want = tables.hot_join(rows, facts, ["key"], ["id"], how), rows.join(facts, ["key"], how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_dedup_with_large_groups(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 5)
    texts = [f"a b c d e {i % 4 and 'f g h i j k l m n o p'} {i // 40}" for i in range(160)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    fp = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    group = {x: min(i for i in fp if fp[i] in g) for g in map(set, brute_components(sorted(set(fp.values())))) for x in g}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == {i: group[f] for i, f in fp.items()}


def test_a_star_of_links_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(tables, "HOT_ROWS", 5)
    star = spark.range(1, 60).selectExpr("0L AS a", "id AS b").union(spark.range(100, 110).selectExpr("id AS a", "id + 100 AS b"))
    roots = [r["root"] for r in components.components(star, 3).collect()]
    assert len(roots) == 80 and len(set(roots)) == 11


def test_dedup_judges_rows_by_id_and_text(spark):
    """Rows that share an id are judged by their own texts; columns may have any name."""
    same = "one two three four five six seven"
    rows = [(i, f"only {i} " + " ".join(str((i + 3) * k) for k in range(30)), "u", 0) for i in range(20)] + [(i, same, "c", 0) for i in range(20)] + [(3, same, "c", 1), (3, same, "c", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, `row.of` string, row_of_id int")
    got = corpus_pipeline.near_dedup(spark, d, DATA)
    assert got.columns == d.columns
    rows = got.collect()
    assert sum(r["row.of"] == "u" for r in rows) == 20 and [r["doc_id"] for r in rows if r["row.of"] == "c"] == [0]


def test_stages_on_empty_and_awkward_tables(spark, tmp_path):
    texts = [None, "", "the the", "x" * 200_000, "é 日本 " * 20_000, "same text of some words here", "same text of some words here"]
    d = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (4, "other", "en", "s", 5)])
    for name, rows in (("labels", "SELECT 1L AS doc_id, 1 AS quality, 0 AS toxic WHERE false"), ("benchmark", "SELECT 'b' AS item_id, 'same text of some words here' AS text")):
        spark.sql(rows).write.parquet(f"{tmp_path}/{name}.parquet")
    for table, empty in ((d, False), (d.limit(0), True)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, str(tmp_path))
            assert got.columns[: len(d.columns)] == d.columns
            ids = [r["doc_id"] for r in got.collect()]
            assert not (empty and ids)
            if name == "near_dedup" and not empty:
                assert sorted(map(str, ids)) == sorted(["0", "2", "3", "4", "5", "None", "4"])
            if name == "decontaminate" and not empty:
                assert 5 not in ids and 6 not in ids and len(ids) == 7


def test_pipeline_of_no_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# --- tool calls -----------------------------------------------------------------------------


def calls_of(spark, deps):
    return spark.createDataFrame([(1, i, f"c{i}", "f", "{}", [f"c{d}" for d in need]) for i, need in deps.items()], "conv_id long, position long, call_id string, name string, arguments string, depends_on array<string>")


def brute_levels(deps):
    level = {}
    for _ in range(len(deps) + 1):
        for i, need in deps.items():
            need = [d for d in need if d in deps]
            if all(d in level for d in need):
                level[i] = max((level[d] + 1 for d in need), default=0)
    return {f"c{i}": level.get(i) for i in deps}


@pytest.mark.parametrize("seed", range(3))
def test_levels_by_brute_force(spark, seed):
    rng = random.Random(seed)
    deps = {i: [rng.randrange(34) for _ in range(rng.choice([0, 1, 1, 2]))] for i in range(30)}
    got = {r["call_id"]: r["level"] for r in tool_calls.levels(calls_of(spark, deps)).collect()}
    assert got == brute_levels(deps)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    deps = {i: [i + 1] for i in range(300)} | {300 + i: [300 + (i + 1) % 5] for i in range(5)}
    rounds = []
    monkeypatch.setattr(tool_calls, "hot_join", lambda *a: rounds.append(1) or tables.hot_join(*a))
    got = {r["call_id"]: r["level"] for r in tool_calls.levels(calls_of(spark, deps)).collect()}
    assert got == brute_levels(deps) and len(rounds) < 14


def test_tool_calls_that_repeat_and_odd_arguments(spark):
    rows = [(1, 0, "a", "f", '{"b":1,"b":2}', []), (1, 1, "a", "f", '{"b":1}', []), (None, 0, "a", "f", "null", []), (1, 2, None, "f", '{"b":"' + "x" * 100_000 + '"}', [None])]
    calls = spark.createDataFrame(rows, "conv_id long, position long, call_id string, name string, arguments string, depends_on array<string>").selectExpr("*", "1 AS fields", "2 AS args", "3 AS salt", "'e' AS errors", "'l' AS level")
    results = spark.createDataFrame([(1, 5, "a", "x"), (1, 5, "a", "x"), (None, 2, "a", "y"), (None, 3, "a", "z")], "conv_id long, position long, call_id string, content string")
    schemas = spark.createDataFrame([("f", "b", "integer", True)], "name string, field string, type string, required boolean")
    got = sorted((r["conv_id"] or 0, r["call_id"] or "", r["position"], r["status"], r["n_results"], r["errors"]) for r in tool_calls.link_tool_calls(calls, results, schemas).collect())
    assert got == [
        (0, "a", 0, "no_result", 0, "no JSON object"), (0, "a", 2, "orphan_result", 2, ""), (1, "", 2, "no_result", 0, "type:b"),
        (1, "a", 0, "linked", 2, "duplicate key"), (1, "a", 1, "linked", 2, "")]


# --- the others -----------------------------------------------------------------------------


def test_very_long_urls(spark):
    rows = [(1, "http://" + "a." * 3000 + "net/es/" + "x" * 100_000), (2, "x" * 100_000), (3, "://" + "/" * 50_000)]
    rules = spark.createDataFrame([*url_filter.RULES, ("net", "x", "block")], "host string, path string, action string")
    got = {r["page_id"]: r["rule"] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {1: "net/es/", 2: None, 3: None}


def test_benchmark_ids_of_any_type_and_items_of_any_length(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    items = [(f"i{n}", text(n)) for n in (3, 20, 33, 200, 900)]
    docs = documents(spark, [(n, text(50) + " " + t + " " + text(700), None, None, 0) for n, (_, t) in enumerate(items)] + [(99, text(3000), None, None, 0)])
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == {(n, f"i{k}") for n, k in enumerate((3, 20, 33, 200, 900))}
    assert [r["doc_id"] for r in decontamination.without_contaminated(docs, benchmark).collect()] == [99]
    assert len(list(decontamination.indexes(benchmark))) == 1


def test_archives_are_standard(spark, monkeypatch):
    """A member for each record, warcinfo first, and revisits that name the record they refer to."""
    import gzip
    import zlib
    from pathlib import Path

    monkeypatch.setattr(warc, "MAX_CAPTURES", 2)
    big = "".join(random.Random(1).choices("abcdefgh", k=1 << 10)) * (17 << 10)
    rows = [(i, f"http://a.b/{i}?q=1", big if i == 5 else "y" * 1500 if i % 2 else str(i)) for i in range(7)]
    path = fresh_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    files = sorted(Path(path.removeprefix("file://")).glob("*.txt"))
    records = []
    assert len(files) == 4
    for f in files:
        data = f.read_bytes()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        own = []
        while data:
            z = zlib.decompressobj(31)
            own.append(z.decompress(data) + z.flush())
            data = z.unused_data
        assert all(m == b"" or (m.count(b"WARC/1.1\r\n") == 1 and m.endswith(b"\r\n\r\n")) for m in own)
        records += [r for m in own for r in warc.parse_archive(m)]
    ids = {h["warc-record-id"]: (kind, h) for kind, h, _ in records}
    assert len(ids) == len(records) == 7 * 3 + 4
    revisits = [h for kind, h, _ in records if kind == "revisit"]
    assert [(h["page-id"], ids[h["warc-refers-to"]][0], ids[h["warc-refers-to"]][1]["page-id"]) for h in revisits] == [("1", "response", "3")]
    assert any(b"GET /3?q=1 HTTP/1.1\r\nHost: a.b" in block for _, _, block in records)
    assert warc.read_records(spark, path).filter("type = 'response' AND payload_length > 16000000").count() == 1


def test_no_pages_give_no_captures(spark):
    path = fresh_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0
