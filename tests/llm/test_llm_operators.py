"""Each operator against brute force or its SQL, and on awkward tables."""

import random
import re

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from jobloom.llm import bloom, components, decontamination, language_id, mixing, pii, quality_model, quality_rules, queries, sampling, simhash, tool_calls, url_filter, warc
from jobloom.llm.tables import fresh_path

DATA = "/root/testdata/sf0.001"
LONG = "the quick " * 30_000
TEXTS = [None, "", " \n\t", "a", "the the the the", "x" * 5000, LONG, LONG, "é ß 日本語 text", "a\nb\na\n\nb"]
#: Columns that operators use inside, as extra columns of the input.
EXTRA = "size long, key string, fp long, score double, word string, n long, host string, path string, rule string, src string, held_out int, block int, row int, digest string, position long"


def documents(spark, rows):
    extra = ", ".join(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in EXTRA.split(", "))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *extra.split(", CAST")[:1], *["CAST" + x for x in extra.split(", CAST")[1:]])


def awkward(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 0) for i, t in enumerate(TEXTS)]
    return documents(spark, [*rows, rows[4], (None, "no id here", None, None, None)])


OPERATORS = {
    "langid": lambda d: language_id.predict(d, language_id.train(d)),
    "simhash": simhash.near_duplicates,
    "mix": mixing.mix,
    "mixed": mixing.mixed_documents,
    "pii": pii.find_personal_data,
    "masked": pii.mask_personal_data,
    "rules": quality_rules.judge_quality,
    "leaks": lambda d: decontamination.contaminated(d, d.selectExpr("doc_id AS item_id", "text")),
    "clean": lambda d: decontamination.without_contaminated(d, d.limit(0).selectExpr("doc_id AS item_id", "text")),
    "model": lambda d: quality_model.score(d, quality_model.train(d, d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality"))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_and_empty_tables(spark, name):
    d = awkward(spark)
    got = OPERATORS[name](d).collect()
    if name not in ("leaks", "mixed"):
        assert len(got) == d.count()
    assert OPERATORS[name](d.limit(0)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert same_rows(queries.QUERIES[name](spark, DATA), queries.ORACLES[name], DATA)


# --- 1 --------------------------------------------------------------------------------------


def test_urls_edge_cases(spark):
    rows = [(1, None), (1, None), (2, "no scheme"), (None, "http://A.Example.COM/en/x"), (3, "http://www.example.com/en/?q"), (4, "x://net?/es/"), (5, "x://a.net/es/"), (6, "x://annet/es/"), (7, "http://com"), (8, "://com/#a"), (9, "a://b.com/c://d.net/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'z' AS host", "'z' AS key", "1 AS block", "'z' AS rule")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    got = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect())
    assert got == sorted([
        (1, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (0, "a.example.com", "/en/x", "example.com/en/", "block"), (3, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (4, "net", "", None, "allow"), (5, "a.net", "/es/", "net/es/", "block"), (6, "annet", "/es/", None, "allow"), (7, "com", "", None, "allow"), (8, "com", "/", "com/", "allow"), (9, "b.com", "/c://d.net/es/", "com/", "allow"),
    ])
    assert url_filter.filter_urls(pages, rules.limit(0), "block").filter("verdict = 'block'").count() == len(rows)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_full_bloom_filter_and_shuffled_list_change_nothing(spark, monkeypatch):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    want = sorted(url_filter.filter_urls(pages, rules).collect(), key=str)
    many = rules.union(spark.range(3000).selectExpr("concat('h', id, '.org')", "'/'", "'block'"))
    monkeypatch.setattr(bloom, "MAX_BLOCKS", 1)
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", 1)
    assert sorted(url_filter.filter_urls(pages, many).collect(), key=str) == want


# --- 2 and 10: held-out accuracy ------------------------------------------------------------


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in language_id.op2_language_id(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert len(rows) > 100 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_unknown(spark):
    d = documents(spark, [(1, None, "en", "s", 0), (2, "12 %", "en", "s", 0), (3, "the cat", "en", "s", 0)])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(d, language_id.train(d)).collect()}
    assert got[1] == got[2] == "und" and got[3] == "en"


def test_quality_held_out(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality_model.op10_quality_model(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) > 80 and sum(truth[r["doc_id"]] == r["predicted"] for r in rows) / len(rows) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_sample_is_bounded(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 50 = 0 THEN 'rare' ELSE 'hot' END AS lang")
    counts = {r["lang"]: r["count"] for r in sampling.per_class_sample(rows.withColumn("text", F.lit("x")), "lang", "doc_id", "text", 60).groupBy("lang").count().collect()}
    assert counts == {"rare": 60, "hot": 60}


# --- 3 --------------------------------------------------------------------------------------


def brute_components(fps, distance=4):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    f = np.array([x & (2**64 - 1) for x in fps], dtype=np.uint64)
    for a in range(len(f)):
        for b in np.flatnonzero(np.bitwise_count(f[a] ^ f[a + 1 :]) <= distance) + a + 1:
            x, y = root(a), root(int(b))
            up[max(x, y)] = min(x, y)
    groups = {}
    for i, x in enumerate(fps):
        groups.setdefault(root(i), set()).add(x)
    return sorted(map(sorted, groups.values()))


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def test_simhash_by_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in rows] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    fp = {i: brute_fingerprint(t) for i, t in rows}
    group = {x: min(i for i in fp if fp[i] in g) for g in map(set, brute_components(sorted(set(fp.values())))) for x in g}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents(spark, [(i, t, None, None, 0) for i, t in rows])).collect()}
    assert got == {i: (f"{f:016x}", group[f]) for i, f in fp.items()}


@pytest.mark.parametrize(("small", "cell", "last"), [(64, 4096, 50_000), (3, 16, 5)])
def test_dense_buckets_and_contraction(spark, small, cell, last):
    rng = random.Random(1)
    fps = set()
    for base in [rng.getrandbits(64) for _ in range(8)]:
        for _ in range(120):
            x = base
            for bit in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << bit
            fps.add(x - (1 << 64) if x >> 63 else x)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.near_links(nodes, 4, small, cell), last).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == brute_components(sorted(fps))


def test_choices_cover_all_close_pairs():
    rng = random.Random(2)
    for k in (5, 6, 7, 8):
        masks = simhash.choices(k, 4)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(diff & m == 0 for m in masks)


def test_long_chain_of_links(spark):
    chain = spark.range(400).selectExpr("id AS a", "id + 1 AS b")
    assert {r["root"] for r in components.components(chain, 3).select("root").distinct().collect()}.__len__() == 1


# --- 4 --------------------------------------------------------------------------------------


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, 0, "a", "f", '{"b":1,"a":[1,{"z":1,"y":null}]}', ["b"]), (1, 1, "b", "f", '{"a":"x"}', []), (1, 2, "c", "g", "oops", ["d"]), (1, 3, "d", "g", "{}", ["c"]),
        (1, 4, "e", "f", "[1]", ["d"]), (2, 0, None, None, None, None), (2, 1, "x", "f", '{"b":1.5,"q":true}', ["nope"]),
    ], "conv_id long, position long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, 5, "a", "r2"), (1, 4, "a", 'r"1\n'), (9, 1, "zz", None)], "conv_id long, position long, call_id string, content string")
    schemas = spark.createDataFrame([("f", "b", "integer", True), ("f", "a", "array", False)], "name string, field string, type string, required boolean")
    got = {r["call_id"]: r for r in tool_calls.link_tool_calls(calls, results, schemas).collect()}
    assert {k: (r["status"], r["level"], r["errors"]) for k, r in got.items()} == {
        "a": ("linked", 1, ""), "b": ("no_result", 0, "missing:b,type:a"), "c": ("cycle", None, "unknown tool"), "d": ("cycle", None, "unknown tool"), "e": ("cycle", None, "no JSON object"),
        None: ("no_result", 0, "unknown tool"), "x": ("no_result", 0, "type:b,unknown:q"), "zz": ("orphan_result", 0, ""),
    }
    assert got["a"]["json"] == '{"arguments":{"a":[1,{"y":null,"z":1}],"b":1},"content":"r\\"1\\n","id":"a","name":"f"}' and got["a"]["n_results"] == 2
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


# --- 5 --------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 90])), None, s, 0) for i in range(600) for s in [rng.choice(["hot"] * 8 + ["a", "b", "é", None])]]
    got = mixing.mix(documents(spark, rows)).collect()
    src = {r[0]: r[3] for r in rows}
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in set(src.values())}
    want = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if src[r["doc_id"]] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 1
    assert sorted(got) == sorted(mixing.mix(documents(spark, rows[::-1])).collect())


# --- 6 --------------------------------------------------------------------------------------


def test_wand_finds_all_above_threshold(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    index, rng = decontamination.Index(items), random.Random(1)
    for _ in range(400):
        q = rng.sample(range(len(index.term)), rng.randint(1, 40)) if rng.random() < 0.5 else sorted({index.term[w] for w in rng.choice(index.tokens)})
        score = {}
        for t in q:
            for i, x in zip(index.postings(t).items.tolist(), index.postings(t).weights.tolist(), strict=True):
                score[i] = score.get(i, 0) + x
        for least in (0.05, 0.2, 0.6):
            assert set(index.search(q, least)) == {i for i, x in score.items() if x >= least - 1e-9}


def test_leaks_by_brute_force(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.op6_decontaminate(spark, "/root/testdata/sf0.01").collect()}
    grams = {i: decontamination.shingles(decontamination.words(t)) for i, t in items}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        own = decontamination.shingles(decontamination.words(r["text"]))
        want |= {(r["doc_id"], i) for i, g in grams.items() if len(g & own) >= 0.8 * len(g)}
    assert got == want and want
    left = decontamination.without_contaminated(docs, spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"), pass_bytes=2000)
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - {d for d, _ in want}


# --- 7 --------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}
            if fits[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_by_brute_force():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("a.@+1 5-(9%é\n4736962573099581") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == [] and pii.base_spans("@" * 100_000) == []


def test_crf():
    model = pii.train()
    right = total = 0
    for words, labels in pii.labelled_rows(150, seed=99):
        e = model.emissions([pii.features(words[i - 1] if i else "", w, words[i + 1] if i + 1 < len(words) else "") for i, w in enumerate(words)])
        path = pii.viterbi(model, [e])[0]
        right, total = right + sum(pii.LABELS[a] == b for a, b in zip(path, labels, strict=True)), total + len(labels)
    assert right / total > 0.97
    (base, spans), (_, none) = pii.all_spans(["mail a.b@x.org or call (017) 555-7713 now", "Version 2.0 of 2024, no 17"], model)
    assert base == [("email", 5, 14)] and set(base) < set(spans) and none == []
    assert pii.masked("mail a.b@x.org now", base) == "mail [EMAIL] now"


# --- 8 --------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    x = "x" * 1200
    rows = [(1, "http://a.b/", x), (2, None, x), (3, "http://a.b/", x + "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", x), (5, "u\r\ni", None), (6, "é", "é\r\n"), (2, "z", x)]
    path = fresh_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS row", "'d' AS digest", "1 AS salt"), path)
    got = warc.assemble(warc.read_records(spark, path, True)).collect()
    assert len(got) == 7 and all(r["request"]["type"] == "request" and r["metadata"]["type"] == "metadata" for r in got)
    by = {(r["response"]["page_id"], r["response"]["uri"]): r for r in got}
    assert bytes(by[3, "http://a.b/"]["response"]["payload"]).decode() == rows[2][2] and bytes(by[6, "é"]["response"]["payload"]).decode() == "é\r\n"
    kinds = {k: (r["response"]["type"], r["response"]["refers_to"], r["metadata"]["payload_bytes"]) for k, r in by.items()}
    assert kinds[1, "http://a.b/"] == ("revisit", "2", 1200) and kinds[2, None] == ("response", None, 1200) and kinds[2, "z"][0] == "response" and kinds[None, "u"][0] == "revisit" and kinds[5, "u i"] == ("response", None, 0)


# --- 9 --------------------------------------------------------------------------------------


def test_repeated_windows_by_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc" if n % 2 else "abcdefghij") for _ in range(rng.randrange(90))) for n in range(120)]
    texts.append(" ".join(str(i % 60) for i in range(300)))  # more different windows than are looked up

    def brute(words):
        at = {}
        for i in range(len(words) - 2):
            at.setdefault(tuple(words[i : i + 3]), []).append(i)
        return len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)})

    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.judge_quality(documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])).filter("n_words >= 0").collect()}
    assert got == {i: brute(t.split()) for i, t in enumerate(texts)}


# --- the pipeline ---------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        path = fresh_path(spark, f"test-{name}")
        stage(spark, now, DATA).write.parquet(path)
        now = spark.read.parquet(path)
        rows = now.collect()
        assert now.columns[: len(columns)] == columns and {r["doc_id"] for r in rows} <= set(before)
        if name == "near_dedup":
            fp = {i: brute_fingerprint(r["text"]) for i, r in before.items()}
            keep = {min(i for i in fp if fp[i] in g) for g in map(set, brute_components(sorted(set(fp.values()))))}
            assert {r["doc_id"] for r in rows} == keep
        if name == "mask_pii":
            assert not any(pii.base_spans(r["text"]) for r in rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
    want = sorted(now.drop("mix_epochs").collect())
    assert want == sorted(corpus_pipeline.run(spark, DATA).drop("mix_epochs").collect())


def test_near_dedup_keeps_rows_without_id_and_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "a b c d e", "en", "s", 9), (None, "a b c d e", "en", "s", 9)]
    got = corpus_pipeline.near_dedup(spark, documents(spark, rows), DATA).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "None"]
