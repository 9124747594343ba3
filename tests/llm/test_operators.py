"""The operators as Spark plans: nulls, empty and long texts, ties, repeated rows, extra columns, empty tables."""

import hashlib
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.llm import common, components, decontam, gru, lm, pieces, privacy, quality, registry, sharding, simhash, tokenfiles, topk, urls

SF = "/root/testdata/sf0.001"
LONG = "long words go on " * 8000
#: Null and repeated ids, null, empty and long texts, equal texts; columns named as results.
ROWS = [
    (1, "One two three four five six"), (2, "one TWO three four five six"), (2, None), (3, ""), (None, "x y z"), (None, None), (4, LONG),
    (5, LONG), (6, "mail a.b@c.de now"), (6, "mail a.b@c.de now"),
]
EXTRA = "doc_id long, text string, score string, fp string, row string, shard string, ids string, spans string, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["no"] * 7) for r in ROWS], EXTRA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    df = registry.QUERIES[name](spark, SF)
    found = c.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert Counter(repr(tuple(r)) for r in df.select(*names).collect()) == Counter(map(repr, found.fetchall()))


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    r = quality.score_documents(docs, labels, pairs=500, rounds=5).collect()
    assert len(r) == len(ROWS) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in r)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in r if x.doc_id is not None)
    assert quality.score_documents(none, labels).count() == 0
    assert {x.score for x in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_simhash(spark, docs, none):
    r = simhash.group_documents(docs).collect()
    prints = [(d, simhash.fingerprint(t or "")) for d, t in ROWS]
    assert Counter((x.doc_id, x.fingerprint) for x in r) == Counter((d, f"{f:016x}") for d, f in prints)
    reach = {f: {g for _, g in prints if (f ^ g).bit_count() <= 4} for _, f in prints}
    for _ in ROWS:
        reach = {f: set().union(*(reach[g] for g in gs)) for f, gs in reach.items()}
    least = {f"{f:016x}": min((d for d, g in prints if g in gs and d is not None), default=None) for f, gs in reach.items()}
    assert all(x.component_id == least[x.fingerprint] for x in r)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({frozenset(g) for g in reach.values()})
    assert simhash.group_documents(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_simhash_keeps_one_of_unique_ids(spark):
    df = spark.createDataFrame(
        [(k, f"alpha beta gamma delta {k % 3}") for k in range(9)] + [(None, "other words of its own kind")], "doc_id long, text string",
    )
    assert sorted((r.doc_id is None, r.doc_id) for r in simhash.keep_one(df).collect()) == [(False, 0), (False, 1), (False, 2), (True, None)]


def test_large_groups_are_cut_into_blocks(spark):
    fs = [(k, (1 << (k % 40)) | (1 << (k * 7 % 40))) for k in range(200)]
    df = spark.createDataFrame(fs, "doc_id long, fp long")
    few = {r.fp: r.component_id for r in simhash.classes(df, group=16).collect()}
    assert few == {r.fp: r.component_id for r in simhash.classes(df).collect()} and set(few.values()) == {0}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    r = {x.u: x.v for x in components.stars(edges).collect()}
    assert r == {k: 0 for k in range(1, 61)} | {101: 100}


def test_sharding(spark, docs, none):
    r = sharding.assign(docs, shards=3).collect()
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in r) == Counter((
        d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()),
    ) for d, t in ROWS)
    for s in range(3):
        mine = sorted(x.slot for x in r if x.shard == s)
        assert mine == list(range(len(mine)))
    assert {x.law for x in r} == {"bytes"} and sharding.assign(none).count() == 0
    many = sharding.assign(spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) as text"))
    sizes = Counter()
    for x in many.collect():
        sizes[x.shard] += x["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 0.01 * sum(sizes.values()) / 8


def test_one_repeated_row_is_spread(spark):
    rows = spark.range(20_000).selectExpr("7L as doc_id", "'the same text' as text")
    r = sharding.assign(rows).collect()
    counts = Counter(x.shard for x in r)
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 200
    assert sorted(x.slot for x in r if x.shard == 3) == list(range(counts[3]))


def test_rebalancing_moves_few_slots(spark, tmp_path):
    weights = spark.range(256).selectExpr("id as virtual_slot", "1 as slot_rows", "100 + id % 7 as slot_bytes")
    old = sharding.first_map(spark, 4, 256)
    new = sharding.rebalance(old, weights, 5)
    a, b = {r.virtual_slot: r.shard for r in old.collect()}, {r.virtual_slot: r.shard for r in new.collect()}
    moved = {s for s in a if a[s] != b[s]}
    assert len(moved) < 256 / 5 + 12 and sum(b[s] == 4 for s in moved) > 40 and {r.version for r in new.collect()} == {2} and set(a) == set(b)
    load = Counter()
    for r in weights.collect():
        load[b[r.virtual_slot]] += r.slot_bytes
    assert max(load.values()) - min(load.values()) <= 4 * 106


def test_slot_map_has_versions(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('x', cast(id % 500 as int)) as text")
    path = str(tmp_path / "map")
    first = {r.doc_id: r for r in sharding.assign(docs, 4, map_path=path).collect()}
    again = {r.doc_id: r for r in sharding.assign(docs, 4, map_path=path).collect()}
    grown = {r.doc_id: r for r in sharding.assign(docs, 5, map_path=path).collect()}
    assert {r.map_version for r in first.values()} == {2} and {r.map_version for r in grown.values()} == {max(r.map_version for r in again.values()) + 1}
    assert sum(first[d].shard != again[d].shard for d in first) <= 0.02 * len(first)
    moved, total = sum(r["size"] for d, r in first.items() if grown[d].shard != again[d].shard), sum(r["size"] for r in first.values())
    assert 0.19 * total < moved < 0.21 * total and all(grown[d].virtual_slot == first[d].virtual_slot for d in first)
    sizes = Counter()
    for r in grown.values():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 5


def test_token_files(spark, docs, none):
    enc = tokenfiles.encoder(tokenfiles.default_tokenizer())
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    want, at = [], 0
    for d, t in order:
        ids = enc.whole([t or ""])[0] + (2).to_bytes(4, "little")
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    r = tokenfiles.round_trip(docs).collect()
    assert sorted(map(tuple, r), key=lambda x: x[1]) == want
    assert tokenfiles.round_trip(none).count() == 0


def test_top_k(spark):
    v = [1.0, -0.5, 0.25]
    rows = [
        (0, v), (20, v), (20, v), (1, v), (2, None), (3, [1.0, None, 0.0]), (4, [float("nan")] * 3), (5, [float("inf"), 0.0, 0.0]),
        (40, []), (6, [0.5]), (None, v),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    r = topk.search(df, k=3).collect()
    exact = lambda q, c: sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(q, c))
    usable = [(i, x) for k, (i, x) in enumerate(rows) if k not in (4, 5, 6, 7)]
    want = []
    for n, (i, q) in enumerate(usable):
        if i is not None and i % 20 == 0:
            best = sorted(((-exact(q, c), j is None, j or 0) for m, (j, c) in enumerate(usable) if m != n))[:3]
            want += [(i, k + 1, None if b[1] else b[2], -b[0]) for k, b in enumerate(best)]
    assert Counter(map(tuple, r)) == Counter(want)
    assert topk.search(df.limit(0)).count() == 0
    big = spark.range(700).selectExpr("id as vec_id", "transform(sequence(0, 7), k -> cast(sin(id * 7 + k * 3) as float)) as embedding")
    small = {tuple(x) for x in topk.search(big, k=5, rows=100, queries=10).collect()}
    assert small == {tuple(x) for x in topk.search(big, k=5).collect()} and len(small) == 175


def test_pii(spark, docs, none):
    r = privacy.scan(docs).collect()
    assert len(r) == len(ROWS) and sum(x.n_email for x in r) == 2
    assert {x.spans for x in r} == {"", "email:5:13"} and {x.base_sha256 for x in r} == {
        hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"email:5:13").hexdigest(),
    }
    out = privacy.redacted(docs)
    assert out.columns == docs.columns and sum(x.text is None for x in out.collect()) == 2 and privacy.scan(none).count() == 0
    counted = privacy.redacted(spark.createDataFrame([("a.b@c.de", 8)], "text string, n_chars long")).collect()[0]
    assert tuple(counted) == ("[EMAIL]", 7)


def test_decontamination(spark, docs, none):
    item = "the quick brown fox jumps over that lazy dog again and again"
    bench = spark.createDataFrame(
        [(1, item), (1, item), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (3, None), (4, "short one"), (5, ""), (6, "five words of a kind")],
        "item_id long, text string",
    )
    df = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame(
        [
            (70, f"so {item.upper()}! yes", "s"), (70, f"so {item}", "s"), (71, "w1 w2 w3 w4 other w6 w7 w8 w9", "s"),
            (72, "the fox jumps", "s"), (73, "Short, ONE!", "s"), (74, "a short one more", "s"), (75, "here: five words of a kind.", "s"),
            (76, "five words of any kind", "s"),
        ],
        "doc_id long, text string, score string",
    ))
    r = decontam.leaks(df, bench).collect()
    assert sorted((x.doc_id, x.item_id or -1) for x in r) == [(70, 1), (70, 1), (71, -1), (73, 4), (75, 6)] and all(0.4 <= x.score <= 1 for x in r)
    clean = decontam.keep_clean(df, bench)
    assert clean.columns == df.columns and clean.count() == len(ROWS) + 3
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0


#: Columns that bear the names which the stages use inside, and a map and an array.
CLASH = "doc_id long, text string, n_chars int, keep string, __keep string, fp string, __fp string, features string, Score string, predicted string, redacted string, __redacted string, hits string, row string, m map<string,int>, a array<int>"


def test_stages_keep_columns_of_any_name(spark):
    rows = [(d, t, -1, *[f"own {d}"] * 11, {"k": 1}, [2]) for d, t in ROWS]
    df = spark.createDataFrame(rows, CLASH).repartition(2)
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    stages = (lambda x: quality.keep_good(x, labels.limit(0)), simhash.keep_one, lambda x: decontam.keep_clean(x, bench), privacy.redacted)
    for stage in stages:
        out = stage(df)
        assert out.dtypes == df.dtypes and 0 < out.count() <= len(ROWS)
        assert all(r.keep == r["__keep"] == r.fp == r["__redacted"] == r.features == f"own {r.doc_id}" and r.m == {"k": 1} for r in out.collect())
        empty = stage(df.limit(0))
        assert empty.dtypes == df.dtypes and empty.count() == 0
    assert quality.keep_good(df, labels.limit(0)).count() == len(ROWS)
    assert decontam.keep_clean(df, bench.limit(0)).count() == len(ROWS) and decontam.keep_clean(df, bench).count() == len(ROWS) - 1
    assert sorted(r.text or "" for r in privacy.redacted(df).where("doc_id = 6").collect()) == ["mail [EMAIL] now"] * 2


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(*r, None, None, None) for r in ROWS], documents.schema[:2].add("lang", "string").add("source", "string").add("n_chars", documents.schema["n_chars"].dataType))
    odd.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = [(1, "One two three four five six"), (2, ""), (4, LONG), (6, "mail [EMAIL] now"), (None, "x y z")]
    assert Counter((r.doc_id, r.text) for r in out) == Counter(want) and all(r.round_trip for r in out)


def test_equal_ids_keep_the_same_row(spark):
    rows = [(7, "alpha beta gamma delta", k) for k in range(20)] + [(7, "alpha  beta gamma delta", 50)]
    kept = {tuple(simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(n)).collect()[0]) for n in (1, 3, 7)}
    assert len(kept) == 1 and kept.pop()[1] == "alpha  beta gamma delta"


def test_quality_by_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.score_documents(documents, labels, pairs=4000, rounds=20).collect()}
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    known = sorted(d for d in texts if d in marks and not held(d))
    model = quality.fit_pairs(
        np.array([quality.features(texts[d]) for d in known], float), np.array([marks[d] for d in known]), pairs=4000, rounds=20,
    )
    assert set(got) == set(texts)
    for d, t in texts.items():
        want = float(model.score(np.array([quality.features(t)], float))[0])
        assert got[d].score == pytest.approx(want, abs=1e-6) and got[d].predicted == (want >= 0.5) and got[d].held_out == held(d)
    out = [d for d in texts if d in marks and held(d)]
    assert np.mean([got[d].predicted == marks[d] for d in out]) > 0.8


def test_decontamination_by_brute_force(spark):
    documents, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.leaks(documents, bench).collect()}
    o, want = decontam.Options(), {}
    texts = {r.doc_id: decontam.words(r.text or "") for r in documents.collect()}
    for item in bench.collect():
        words = decontam.words(item.text or "")
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        seq = np.array([[number[w] for w in words]])
        for d, t in texts.items():
            near = np.array([[number.get(w, -1) for w in t]]) if t else np.full((1, 1), -1)
            if (near >= 0).sum() * o.match >= o.threshold * o.match * len(words):  # too few words in common can't reach the threshold
                score, _ = decontam.align(near, seq, o)
                if score[0] >= o.threshold * o.match * len(words):
                    want[d, item.item_id] = score[0] / (o.match * len(words))
    assert set(got) == set(want) and len(want) > 0 and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_added_spans_by_brute_force(spark):
    model = privacy.trained()
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ["call 415-555-2671 or (826) 555-4081 4485 2753 4485 2753 a.b (at) c (dot) de " * 3]
    for t in texts:
        base = privacy.base_spans(t)
        apart = lambda s, others: all(s[1] <= o[0] or s[0] >= o[1] for o in others)
        some = [s for s in privacy.candidates(t) if apart(s, base)]
        p = [float(model.probability(np.array([privacy.describe(t, s)]))[0]) for s in some]
        good = [k for k, s in enumerate(some) if p[k] >= model.thresholds[privacy.KINDS.index(s[2])]]
        taken = []
        for k in sorted(good, key=lambda k: (-p[k], some[k][0] - some[k][1], some[k])):
            if apart(some[k], taken):
                taken.append(some[k])
        assert privacy.find(t, model)[1] == sorted(base + taken, key=lambda s: (s[0], privacy.KINDS.index(s[2])))


def test_pieces(spark, docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    r = pieces.encoded(docs, carry=["doc_id"], decoded="back").collect()
    assert Counter((x.doc_id, tuple(x["ids"]), x.back) for x in r) == Counter((d, tuple(library.encode(t or "")), t or "") for d, t in ROWS)
    assert all(x.round_trip and x.n_tokens == len(x["ids"]) for x in r) and pieces.encoded(none).count() == 0


def test_urls(spark):
    rows = [
        (1, "http://A.Example.NET/fr/1?x#y"), (1, "http://A.Example.NET/fr/1?x#y"), (2, None), (3, "no scheme/x"), (4, "x://"),
        (5, "http://net"), (6, "http://b.net/"), (7, "http://q.example.net/en/a"), (None, "http://x.org/fr/"), (8, "http://xorg/fr/"),
        (9, "http://h.com/?a"), (10, "http://EXAMPLE.com/de/x"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, verdict string")
    r = {(x.page_id, x.host, x.path, x.rule, x.verdict) for x in urls.judge(df).collect()}
    assert (
        1, "a.example.net", "/fr/1", "net/", "block",
    ) in r and (2, "", "", None, "allow") in r and (3, "", "", None, "allow") in r and (4, "", "", None, "allow") in r
    assert {x[3] for x in r if x[0] == 5} == {None} and (6, "b.net", "/", "net/", "block") in r and (
        7, "q.example.net", "/en/a", "example.net/en/", "allow",
    ) in r
    assert (None, "x.org", "/fr/", "org/fr/", "allow") in r and {x[3] for x in r if x[0] in (8, 9)} == {None} and (
        10, "example.com", "/de/x", "example.com/de/", "block",
    ) in r
    assert urls.judge(df).count() == len(rows) and urls.judge(df.limit(0)).count() == 0
    marks = spark.createDataFrame(
        [(f"http://h.com/ad/{k}", True) for k in range(9)] + [(f"http://h.com/ok/{k}", False) for k in range(9)],
        "url string, blocked boolean",
    )
    pages = spark.createDataFrame([(1, "http://h.com/ad/77"), (2, "http://h.com/ok/77"), (3, "http://h.com/new/77")], "page_id long, url string")
    assert {x.page_id: x.verdict for x in urls.judge(pages, (), marks).collect()} == {1: "block", 2: "allow", 3: "allow"}
    deep = [(f"http://d.com/a/b/c/d/ad{'xyz'[k % 3]}{'pqr'[k // 3]}/z", True) for k in range(9)] + [(
        f"http://d.com/a/b/c/d/ok{'xyz'[k % 3]}{'pqr'[k // 3]}/z", False,
    ) for k in range(9)]
    r = urls.judge(
        spark.createDataFrame([(k, u) for k, (u, _) in enumerate(deep)], "page_id long, url string"), (),
        spark.createDataFrame(deep, "url string, blocked boolean"),
    ).collect()
    assert {(x.page_id < 9, x.template, x.verdict) for x in r} == {(True, "/a/b/c/d/*block/z", "block"), (False, "/a/b/c/d/*allow/z", "allow")}


def test_language_model(spark, docs, none):
    tok = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter(w for d, t in ROWS if not held(d) for w in tok(t))
    n, v = sum(counts.values()), len(counts)
    for listed in (3, 65_536):
        r = lm.score_documents(docs, listed=listed).collect()
        want = Counter((
            d, held(d), len(tok(t)), sum(counts[w] > 0 for w in tok(t)), n,
            round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)), 6),
        ) for d, t in ROWS)
        assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in r) == want
        assert all(np.isfinite(x.score) and x.score < 0 for x in r)
    assert lm.score_documents(none).count() == 0


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "simhash near-dedup"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    out = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = out
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert sorted(out.columns) == sorted(docs.columns)
        if k == 1:
            f = [(r.doc_id, simhash.fingerprint(r.text)) for r in before.collect()]
            keep = set(r.doc_id for r in out.collect())
            left = [g for d, g in f if d in keep]
            assert all((a ^ b).bit_count() > 4 for i, a in enumerate(left) for b in left[:i])
            assert all(any((a ^ b).bit_count() <= 8 for b in left) for _, a in f)
        if k == 2:
            gone = {r.doc_id for r in decontam.leaks(before, bench).collect()}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in out.collect()} == gone
        if k == 3:
            assert all(not privacy.base_spans(r.text) for r in out.collect())
    assert out.where("not round_trip").count() == 0 and labels.count() > 0


def test_model_learns_from_every_document(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 1000)
    docs = spark.createDataFrame([(k, f"one two w{k % 7} four") for k in range(400)] + [(7, "same same")] * 100, "doc_id long, text string")
    vocab = lm.vocabulary(lm.count_tokens(docs))
    coded = lm.encoded(docs, vocab).withColumn("uid", F.monotonically_increasing_id())

    rows = coded.collect()
    assert Counter(len(r.codes) for r in rows) == Counter({5: 400, 3: 100}) and vocab.total == 2300
    shards = Counter(r.n for r in coded.where("size(codes) = 3").selectExpr("pmod(xxhash64(uid), 2) as n").collect())
    assert len(shards) == 2  # equal rows are spread
    landed = common.landed(coded, "lm-codes")
    held = spark.sparkContext.broadcast((vocab, vocab.start().flat()))
    copies = landed.withColumn(
        "shard", F.pmod(F.xxhash64("uid"), F.lit(2)),
    ).select("uid", "codes", "shard").groupBy("shard").applyInArrow(lm._learner(held, 0), lm._PARTS)
    assert copies.where("part = 0").agg(F.sum("weight")).first()[0] == vocab.total  # every token is seen
    model = lm.fit(landed, vocab)
    assert np.isfinite(model.flat()).all() and not np.array_equal(model.flat(), vocab.start().flat())


def test_language_model_score_by_brute_force(spark):
    """The score is the model's probability of each token, one after another, with words outside it by their share of the counts."""
    texts = [" ".join(f"w{(k * j) % 11}" for j in range(1, 9)) for k in range(60)] + ["w1 rare1 w2", "never seen before w3", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [(d, t) for d, t in enumerate(texts) if zlib.crc32(str(d).encode()) % 5 != 1]
    counts = Counter(w for _, t in train for w in [*t.encode().split(), b""])
    kept, fit = [], lm.fit
    try:
        lm.fit = lambda *a, **k: kept.append((fit(*a, **k), a[1])) or kept[-1][0]
        got = {r.doc_id: r.score for r in lm.score_documents(docs, listed=8).collect()}
    finally:
        lm.fit = fit
    model, vocab = kept[0]
    sig = lambda x: 1 / (1 + np.exp(-x))
    p, h2 = {k: v.astype(float) for k, v in model.p.items()}, 2 * gru.HIDDEN
    for d, t in enumerate(texts):
        h, last, total = np.zeros(gru.HIDDEN), lm.MODEL + gru.BUCKETS, 0.0
        for w in [*t.encode().split(), b""]:
            gx, gh = p["emb"][last] @ p["wx"] + p["bx"], h @ p["u"]
            zr = sig(gx[:h2] + gh[:h2])
            c = np.tanh(gx[h2:] + zr[gru.HIDDEN :] * gh[h2:])
            h = c + zr[: gru.HIDDEN] * (h - c)
            soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
            classes = soft(h @ p["wc"] + p["bc"])
            k = vocab.place.get(w)
            if k is not None:
                row = k // gru.WIDTH
                total += classes[row] + soft(h @ p["wo"][row] + p["bo"][row])[k % gru.WIDTH]
                last = k
            else:
                share = (counts[w] + 0.5) / (vocab.rare_mass + 0.5 * (vocab.rare_distinct + 1))
                total += classes[gru.CLASSES + 1] + math.log(share)
                last = lm.MODEL + zlib.crc32(w) % gru.BUCKETS
        assert got[d] == pytest.approx(total / math.log(10), rel=1e-4)
