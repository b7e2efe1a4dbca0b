"""The training-data operators against plain versions, on the smallest tables
and on rows with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import base64
import gzip
import hashlib
import heapq
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import assert_same
from driftline.llm import byte_bpe, graph_index, line_frequency, minhash, mixing, queries, ranks, secrets, sharding, store, suffix_repeats, toxic_spans, warc
from driftline.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(12_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash."""
    same = "the quick brown fox jumps over the lazy dog again and again " * 8
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, LONG, None, "a", None), (4, same, "en", "b", 1), (4, same, "en", "b", 1), (5, same, "en", "a", 1), (6, " \n\t ", "en", "a", 1), (None, "no id here", "en", "a", 1), (7, "é" * 300, "fr", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    clash = [F.lit(1).alias(c) for c in ("key", "row", "h", "g", "n", "size", "group", "start", "shard", "spans", "bands", "node", "label", "core", "ctx")]
    return df.select("*", *clash)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(name, spark, sf_dir, duck):
    assert_same(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name])


def texts_of(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# 1


def test_nearest_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, vectors = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    found = defaultdict(list)
    for r in graph_index.op1_nearest(spark, sf_dir).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        scores = (vectors * vectors[k]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if i != k][:20]
        got = found[ids[k]]
        assert len(got) == len(order) and [s for _, s in got] == sorted((s for _, s in got), reverse=True)
        exact = dict(zip(ids.tolist(), scores.tolist(), strict=True))
        assert all(exact[v] == s for v, s in got)
        hits += len({v for v, _ in got} & set(ids[order].tolist()))
        total += len(order)
    assert hits >= 0.9 * total


def test_nearest_over_several_shards(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1500, 8)) * rng.uniform(0.5, 2, size=(1500, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rules = graph_index.GraphRules(shard_rows=400)
    found = defaultdict(set)
    for r in graph_index.nearest(df, F.col("vec_id") % 50 == 0, 10, rules).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 1500, 50):
        order = [i for i in np.argsort(-(vectors @ vectors[q])) if i != q][:10]
        hits += len(found[q] & set(order))
    assert hits >= 0.9 * 300


def recall_of(found, vectors, queries, k):
    hits = 0
    for q in queries:
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.argpartition(-scores, k)[:k].tolist()))
    return hits / (k * len(queries))


def test_nearest_recall_in_full_shards(spark):
    """Two shards of production size, with clusters."""
    n = 2 * graph_index.GraphRules().shard_rows
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(64, 32))[rng.integers(0, 64, n)] + 0.6 * rng.normal(size=(n, 32))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 32 * n + 1, 32, dtype="int32")), pa.array(vectors.ravel()))
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": flat})).repartition(4)
    found = defaultdict(set)
    for r in graph_index.nearest(df, F.col("vec_id") % 160 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    assert recall_of(found, vectors, range(0, n, 160), 20) >= 0.9


def test_nearest_over_waves(spark):
    """Blocks dealt over several tasks a shard give the same."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], "vec_id long, embedding array<double>")
    one = graph_index.nearest(df, F.col("vec_id") % 5 == 0, 10, graph_index.GraphRules(shard_rows=200)).collect()
    many = graph_index.nearest(df, F.col("vec_id") % 5 == 0, 10, graph_index.GraphRules(shard_rows=200, block=16, wave=2)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_nearest_of_integers_and_of_huge_values(spark):
    rng = np.random.default_rng(9)
    whole = rng.integers(-9, 10, size=(120, 6))
    for scale, kind in ((1, "int"), (1, "long"), (1e200, "double"), (1e-200, "double"), (1e30, "float")):
        vectors = (whole * scale).astype(np.float32 if kind == "float" else float)
        rows = [(i, v.tolist() if kind in ("float", "double") else [int(x) for x in v]) for i, v in enumerate(vectors)]
        got = defaultdict(list)
        for r in graph_index.nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["vec_id"])
        for q in range(0, 120, 20):
            scores = whole @ whole[q]
            order = [i for i in np.lexsort((np.arange(120), -scores)) if i != q][:20]
            assert len(got[q]) == 20 and (scale != 1 or got[q] == order)
            if scale == 1e30:  # rounded to floats, two may swap at the end
                assert len(set(got[q]) & set(order)) >= 19
            if scale == 1e200:  # beyond a double's range: infinite, so ties
                assert all(scores[i] > 0 for i in got[q]) or (scores > 0).sum() <= 20


def test_nearest_odd_rows(spark):
    v = [1.0, 0.0]
    rows = [(20, v), (20, v), (1, v), (2, v), (3, v), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (5, [None, 1.0]), (None, v), (4, [0.5, 0.5]), (100, [1.0, 2.0, 3.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("rank", F.lit(9))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in graph_index.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1), (20, 2, 2), (20, 3, 3), (20, 4, 4)]
    assert graph_index.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_many_copies_keep_the_smallest_ids(spark):
    df = spark.range(0, 400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    got = [r["vec_id"] for r in graph_index.nearest(df, F.col("vec_id") == 20, 20, graph_index.GraphRules(shard_rows=100)).orderBy("rank").collect()]
    assert got == [i for i in range(22) if i != 20][:20]


# 2


def test_line_quality_odd_rows(odd, empty):
    out = line_frequency.line_quality(odd, keep=["doc_id", "key"])
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 9 and rows[1]["n_words"] == 0 and rows[1]["base_failed"] and not rows[2]["kept"]
    assert rows[3]["n_words"] == 12_000 and rows[3]["kept"] and rows[5]["n_repeat_words"] == 96
    assert line_frequency.line_quality(empty).count() == 0


def test_line_quality_removes_frequent_lines(spark):
    own = lambda i: " ".join(f"own{i}word{k}" for k in range(60))
    rows = [(i, f"Accept  ALL cookies now\n{own(i)}", "h") for i in range(60)] + [(100, "accept all cookies now\n" * 30 + own(100)[:40], "h"), (101, f"accept all cookies now\n{own(101)}", "other")]
    out = {r["doc_id"]: r for r in line_frequency.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0]["clean_text"] == own(0) and out[0]["removed_words"] == 4 and out[0]["kept"]
    assert not out[100]["kept"] and out[101]["removed_words"] == 0


def test_line_limit_is_a_share_of_the_host(spark):
    """A small host loses a line that a tenth of it holds; a large one keeps it there at five documents."""
    own = lambda i: " ".join(f"own{i}word{k}" for k in range(60))
    rows = [(i, f"share this page\n{own(i)}" if i < 6 else own(i), "small") for i in range(60)]
    rows += [(1000 + i, f"share this page\n{own(i)}" if i < 6 else own(1000 + i), "large") for i in range(1300)]
    rows += [(5000 + i, f"share this page\n{own(i)}" if i < 5 else own(i), "tiny") for i in range(8)]
    out = line_frequency.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("removed_words > 0").collect()
    assert {r["doc_id"] for r in out} == set(range(6))


def test_line_quality_of_a_text_that_a_third_of_all_rows_have(spark):
    own = lambda i: " ".join(f"own{i}word{k}" for k in range(60))
    rows = [(i, f"read more\n{own(-1 if i % 3 == 0 else i)}", "h") for i in range(900)]
    out = line_frequency.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 900 and all(r["removed_words"] == 2 and r["kept"] and r["clean_text"].startswith("own") for r in out)


# 3


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    scores = {r["doc_id"]: r for r in toxic_spans.op3_toxicity(spark, sf_dir).collect()}
    rows = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if scores[r["doc_id"]]["held_out"]]
    y = np.array([r["toxic"] for r in rows])
    s = np.array([scores[r["doc_id"]]["score"] for r in rows])
    order = s.argsort().argsort()
    auc = (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    predicted = s >= 0.7
    assert auc > 0.88 and y[predicted].mean() > 0.85 and predicted[y == 1].mean() > 0.7


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    scores, transitions = [rng.normal(size=6), rng.normal(size=3)], rng.normal(size=(2, 2))
    p, counts = toxic_spans.forward_backward(scores, transitions)
    seen = np.zeros((2, 2))
    for k, own in enumerate(scores):
        total, on = 0.0, np.zeros(len(own))
        pairs = np.zeros((2, 2))
        for path in range(1 << len(own)):
            tags = [path >> i & 1 for i in range(len(own))]
            w = np.exp(sum(own[i] * t for i, t in enumerate(tags)) + sum(transitions[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            total += w
            on += w * np.array(tags)
            for a, b in zip(tags, tags[1:], strict=False):
                pairs[a, b] += w
        assert np.allclose(p[: len(own), k], on / total)
        seen += pairs / total
    assert np.allclose(counts, seen)


def test_long_chains_are_tagged_in_parts():
    rng = np.random.default_rng(11)
    chains = [3 * rng.normal(size=n) for n in (0, 1, 300, 2_500, 1_000)]
    transitions = np.array([[0.5, -1.0], [-0.5, 1.5]])
    rules = toxic_spans.ToxicRules(score_chain=256, score_overlap=64)
    for whole, parts in zip(toxic_spans.marginals(chains, transitions), toxic_spans.cut_marginals(chains, transitions, rules), strict=True):
        assert len(whole) == len(parts) and np.allclose(whole, parts, atol=1e-9)


def test_toxicity_spans_and_odd_rows(spark, odd, empty):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "su") for b in ("ra", "te", "vo", "zi") for c in ("n", "s", "t")]
    rows = [(i, " ".join([*rng.choice(words, 40), *(["badword", "nastier"] if i % 4 == 0 else []), *rng.choice(words, 10)]), int(i % 4 == 0)) for i in range(200)]
    texts, toxic = [r[1] for r in rows], [r[2] == 1 for r in rows]
    model = toxic_spans.train(texts, toxic, toxic_spans.ToxicRules()).to_bytes()
    probe = spark.createDataFrame([(1, "é kalon BADWORD nastier mivos"), (2, "kalon mivos"), (3, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxic_spans.score(probe, model).collect()}
    assert [(s["start"], s["end"]) for s in out[1]["spans"]] == [(8, 23)] and out[1]["score"] > out[2]["score"] and out[3]["spans"] == []
    assert toxic_spans.score(odd, model).count() == 9 and toxic_spans.score(empty, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] < 0.7 for r in toxic_spans.score(probe, toxic_spans.fit(probe, labels, F.lit(True))).collect())


# 4


def loads_plain(sizes, shards=40):
    heap = [0] * shards
    for size in sorted(sizes, reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    return sorted(heap)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shards_are_those_of_a_plain_heap(spark, sf):
    rows = sharding.op4_shards(spark, f"/root/testdata/{sf}").collect()
    texts = texts_of(spark, f"/root/testdata/{sf}")
    loads, groups, slots, sizes = Counter({k: 0 for k in range(40)}), defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 16
        loads[r["shard"]] += r["size"]
        sizes[text] += r["size"]
        groups[text].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and all(len(g) == 1 for g in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(loads.values()) == loads_plain(sizes.values())


def test_shards_of_many_groups(spark):
    """More groups than any heap should see one by one, and a third of all rows in one."""
    df = spark.range(0, 30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.repeat(F.lit("x"), (F.col("id") % 17).cast("int")), F.col("id").cast("string"))).alias("text"))
    loads, sizes = Counter(), Counter()
    for r in df.join(sharding.assign(df), "doc_id").collect():
        loads[r["shard"]] += r["size"]
        sizes[r["text"]] += r["size"]
    assert sorted(loads.values()) == loads_plain(sizes.values())


def test_runs_of_equal_sizes_are_placed_like_single_items():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        shards = int(rng.choice([1, 3, 40]))
        sizes = np.concatenate([rng.integers(1, 20, 1500), rng.integers(1, 100_000, 40)]).tolist()
        heap, plain = [(0, k) for k in range(shards)], defaultdict(lambda: [0] * shards)
        for size in sorted(sizes, reverse=True):
            load, shard = heap[0]
            plain[size][shard] += 1
            heapq.heapreplace(heap, (load + size, shard))
        runs = sorted(Counter(sizes).items(), reverse=True)
        loads, found = sharding.Loads(shards), []
        for at in range(0, len(runs), 7):  # the heap outlives batches
            found += sharding.planned(loads, *map(list, zip(*runs[at : at + 7], strict=True))).to_pylist()
        for row, (size, count) in zip(found, runs, strict=True):
            given = [row["each"].count(k) for k in range(shards)] if row["each"] is not None else np.diff([0, *row["upto"]]).tolist()
            assert (row["bytes"], row["count"], given) == (size, count, plain[size])


def test_a_million_sizes_take_bounded_memory_of_the_driver():
    import tracemalloc

    loads = sharding.Loads(40)
    batch = sharding.ShardRules().batch
    tracemalloc.start()
    for at in range(1_000_000, 0, -batch):
        sizes = list(range(at, at - batch, -1))
        table = sharding.planned(loads, sizes, [1 + (s % 50 == 0) * 60 for s in sizes])
        assert table.num_rows == batch
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000_000 and max(loads.heap)[0] - min(loads.heap)[0] < 1_000


def test_shards_over_several_batches_of_sizes(spark):
    df = spark.range(0, 900).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 150).cast("int")).alias("text"))
    one, many = (sorted(map(tuple, sharding.assign(df, sharding.ShardRules(batch=n)).select("doc_id", "shard").collect())) for n in (50_000, 40))
    assert one == many


def test_shards_odd_rows(odd, empty):
    rows = sharding.assign(odd).collect()
    assert len(rows) == 9 and len({r["shard"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert sharding.assign(empty).count() == 0


def test_running_sums(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), F.col("id").alias("v")).withColumn("k", ranks.order_key(F.col("v")))
    rows = ranks.running(store.written(df, "r"), "g", "k", ["v"], F.col("v"), "before", per_bucket=20).collect()
    for g in range(3):
        own = sorted((r["k"], r["v"], r["before"]) for r in rows if r["g"] == g)
        total = 0
        for _, v, before in own:
            assert before == total
            total += v


# 5


def spans_plain(text):
    out = []
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets_base_rules(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = texts_of(spark, sf_dir)
    names = ("assign", "access", "hex", "markov")
    some = 0
    for r in secrets.op5_secret_scan(spark, sf_dir).collect():
        want = spans_plain(texts[r["doc_id"]])
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
        some += len(want)
    assert some > 0


def markov_plain(text, table, rules=secrets.MarkovRules()):
    out = []
    for m in re.finditer(secrets.TOKEN, text):
        t = m[0]
        ratio = sum(table[(ord(a) - secrets.FIRST) * secrets.WIDTH + ord(b) - secrets.FIRST] for a, b in zip(t, t[1:], strict=False))
        if ratio >= rules.min_ratio and ratio >= rules.min_ratio_per_char * len(t):
            out.append((m.start(), 3, m.end()))
    return out


def redacted_plain(text, spans):
    out, at = "", 0
    for start, _, end in spans:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_secrets_of_long_texts_against_a_plain_version(spark):
    """Texts full of tokens, with and without line ends, of up to 2 MB."""
    rng = np.random.default_rng(12)
    alphabet = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    token = lambda n: "".join(rng.choice(alphabet, n))
    pieces = lambda n: [[f"password = {token(12)}", token(24), "get_user_profile_by_account", f"AKIA{token(16).upper()}", "é😀", f"token:{'0123456789abcdef' * 3}", f"secret={token(20)}x"][k] for k in rng.integers(0, 7, n)]
    texts = ["", " ".join(pieces(3)), "\n".join(pieces(400)), " ".join(pieces(9_000)), "".join(f"{token(24)}, " for _ in range(78_000))]
    table = [0.0] * secrets.WIDTH**2
    for k in rng.integers(0, len(table), 4_000):
        table[k] = 1.4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.monotonic()
    rows = {r["doc_id"]: r for r in secrets.scan(df, table=table).collect()}
    assert time.monotonic() - began < 60 and len(texts[4]) > 2_000_000
    for i, text in enumerate(texts):
        base = spans_plain(text)
        edges = np.array([(a, b) for a, _, b in base]).reshape(-1, 2)
        more = [m for m in markov_plain(text, table) if not ((edges[:, 0] < m[2]) & (m[0] < edges[:, 1])).any()]
        assert [(s["start"], s["kind"], s["end"]) for s in rows[i]["spans"]] == sorted(base + more)
        assert rows[i]["redacted"] == redacted_plain(text, sorted(base + more))


def test_secrets_markov_and_odd_rows(spark, odd, empty):
    rng = np.random.default_rng(2)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    random = ["".join(rng.choice(alphabet, 24)) for _ in range(60)]
    ordinary = [f"get_user_profile_by_{x}" for x in ("account", "session", "customer", "identifier", "reference") for _ in range(12)]
    rows = [(i, f"password = {a} and {b} then", "s") for i, (a, b) in enumerate(zip(random, ordinary, strict=True))]
    table = secrets.train(secrets.labelled_tokens(spark.createDataFrame(rows, "doc_id long, text string, source string"), secrets.MarkovRules()))
    probe = spark.createDataFrame([(99, f"😀 here {random[0][::-1]} and get_user_session_by_account")], "doc_id long, text string")
    out = {99: secrets.scan(probe, table=table).first()}
    assert [(s["start"], s["end"], s["kind"]) for s in out[99]["spans"]] == [(7, 31, 3)]
    assert out[99]["redacted"] == "😀 here [SECRET] and get_user_session_by_account"
    assert secrets.scan(odd, keep=["row"]).count() == 9 and secrets.scan(empty).count() == 0


# 6


def near_plain(texts):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in texts.items()}
    sets = {i: set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set()) for i, w in words.items()}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        both = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n) and top(i) != top(j):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    want = near_plain(texts_of(spark, sf_dir))
    for r in minhash.op6_near_duplicates(spark, sf_dir).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_in_a_large_family(spark, monkeypatch):
    """Copies of one text with so many edits that many don't link with the least."""
    monkeypatch.setattr(minhash, "CELL", 16)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(150):
        words = list(base)
        for k in rng.choice(200, rng.integers(0, 9), replace=False):
            words[k] = f"e{i}x{k}"
        texts[i] = " ".join(words)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in near_plain(texts).items()}


def test_near_duplicates_when_one_text_is_a_third_of_all_rows(spark):
    texts = {i: ("same " + " ".join(f"w{k}" for k in range(80))) if i % 3 == 0 else " ".join(f"d{i}w{k}" for k in range(30)) for i in range(1_500)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == near_plain(texts)


def test_near_duplicates_of_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (9, 5)]


def test_near_duplicates_odd_rows(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 9 and by[5]["component_id"] == 4 and not by[5]["kept"] and by[1]["n_shingles"] == 0 and by[1]["kept"] and by[None]["kept"] and by[3]["n_shingles"] > 11_000
    assert minhash.near_duplicates(empty).count() == 0


def test_sketch_fills_every_coordinate():
    for n in (1, 3, 100, 5000):
        x = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        assert (minhash.sketch(x) != np.uint64((1 << 64) - 1)).all()


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 99), (100, 98), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}
    assert components(edges.limit(0)).count() == 0 and components(edges.where("a = b")).count() == 0


def test_components_of_a_star_and_a_tree(spark):
    edges = [(5_000 + i, 5_000) for i in range(1, 2_000)] + [(i, i // 2) for i in range(2, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{5_000 + i: 5_000 for i in range(2_000)}, **{i: 1 for i in range(1, 300)}}


# 7


def test_mix_stays_near_targets(spark):
    rows = mixing.op7_mix(spark, "/root/testdata/sf0.01").collect()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    again = mixing.op7_mix(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    docs = {r["doc_id"]: r["source"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in rows:
        taken[docs[r["doc_id"]]] += r["taken"]
        target[docs[r["doc_id"]]] = r["target"]
    assert abs(sum(target.values()) - sum(r["size"] for r in rows)) < 1
    assert all(abs(taken[s] - target[s]) <= max(512, 0.02 * target[s]) for s in target)


def test_mix_odd_rows(odd, empty):
    rows = mixing.mix(odd, keep=["doc_id", "size"]).documents.collect()
    assert len(rows) == 9 and all(r["taken"] <= 3 * r["size"] for r in rows) and next(r for r in rows if r["doc_id"] == 1)["taken"] == 0
    assert mixing.mix(empty).documents.count() == 0


# 8


def tiktoken_of(tokenizer):
    import tiktoken

    ranks_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer.ranks, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizer.pattern, mergeable_ranks=ranks_, special_tokens={})


def test_byte_bpe_like_the_library(spark, sf_dir, odd, empty):
    tokenizer = byte_bpe.public_tokenizer()
    library = tiktoken_of(tokenizer)
    texts = texts_of(spark, sf_dir)
    for r in byte_bpe.op8_byte_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert byte_bpe.encode(odd, tokenizer).count() == 9 and byte_bpe.encode(empty, tokenizer).count() == 0


def test_byte_bpe_stitches_chunks(spark):
    tokenizer = byte_bpe.public_tokenizer()
    library = tiktoken_of(tokenizer)
    texts = [LONG[:3000], "a" * 2000, "x  \n\n   y " * 300, "日本語 text " * 200, ("word " * 30 + " " * 90) * 10, "end   "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = byte_bpe.encode(df, tokenizer, chunk=200, overlap=60)
    rows = encoded.select("doc_id", "ids", byte_bpe.decode(F.col("ids"), tokenizer).alias("b")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and bytes(r["b"]) == texts[r["doc_id"]].encode()


def test_byte_bpe_joins_only_around_lost_seams(spark, monkeypatch):
    """Runs of letters and digits longer than the overlap lose seams; the rest stays in chunks."""
    tokenizer = byte_bpe.public_tokenizer()
    library, rng = tiktoken_of(tokenizer), np.random.default_rng(2)
    words = lambda n: " ".join("".join(rng.choice(list("abcdef"), rng.integers(1, 9))) for _ in range(n))
    texts = [words(600) + "1" * 500 + words(600), words(300) + "日" * 333 + "7" * 401 + "\n" * 250 + words(300), "2" * 3001 + " " + words(200), " " * 1999 + words(50), words(900)]
    joined, sizes = byte_bpe.joined_parts, []
    monkeypatch.setattr(byte_bpe, "joined_parts", lambda *args, **kw: sizes.append(out := joined(*args, **kw)) or out)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rounds in (byte_bpe.ROUNDS, 1):
        monkeypatch.setattr(byte_bpe, "ROUNDS", rounds)
        for r in byte_bpe.encode(df, tokenizer, chunk=200, overlap=60).collect():
            assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]), r["doc_id"]
        lengths = {r["doc_id"]: r["l"] for r in sizes[-1].groupBy("doc_id").agg(F.array_sort(F.collect_list(F.length("part"))).alias("l")).collect()}
        assert lengths[4][-1] == 200  # nothing of it is joined
        if rounds > 1:
            assert lengths[0][-2:] == [200, lengths[0][-1]] and 500 < lengths[0][-1] < 1100 and lengths[0].count(200) > 30
        else:
            assert lengths[0][-1] > 3000  # all that follows


def test_byte_bpe_engines_agree_on_awkward_texts():
    """What is encoded whole and what is encoded by pre-token have the same ids."""
    tokenizer = byte_bpe.public_tokenizer()
    library, code = tiktoken_of(tokenizer), byte_bpe.codec(tokenizer)
    rng = np.random.default_rng(13)
    parts = ["'s", "'LL", "I'm", "don't", " ", "  ", "\t", "\n", "\r\n", "\u00a0", "\u3000", "\u200b", "ß", "İ", "ſ", "日本", "١٢٣", "½", "1234", "a", "Zz", "_", "!?", "...", "😀", "👩‍👩‍👧", "e\u0301", "\x00", "\x1c", "\x85", "\u2028", "K", "Å"]
    for _ in range(400):
        text = "".join(rng.choice(parts, rng.integers(1, 30)))
        assert code.ids(code.pattern.findall(text)) == library.encode_ordinary(text), text


def test_byte_bpe_digests_with_ids(odd):
    rows = byte_bpe.digests(odd, byte_bpe.public_tokenizer(), with_ids=True).collect()
    assert len(rows) == 9 and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert {r["ids_sha256"] for r in rows if r["doc_id"] in (1, 2)} == {hashlib.sha256(b"").hexdigest()}


def test_byte_bpe_digests_take_one_worker_a_task(spark):
    """No step in Python feeds another one of the same task: each would hold the ranks."""
    tokenizer = byte_bpe.public_tokenizer()
    library = tiktoken_of(tokenizer)
    texts = ["a short text", "", LONG[:3000] * 20, "x1 " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string")
    found = byte_bpe.digests(df, tokenizer, with_ids=True)
    rows = found.collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()

    def in_a_task(plan, above: int = 0) -> int:
        name = plan.nodeName()
        here = 0 if re.search("Aggregate|Join|Window|Sort|Repartition", name) else above + ("Arrow" in name)
        return max([here, *(in_a_task(plan.children().apply(i), here) for i in range(plan.children().size()))])

    assert in_a_task(found._jdf.queryExecution().optimizedPlan()) == 1


# 9


def test_warc_round_trip(spark, sf_dir):
    html = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    last = {}
    for i in sorted(html):
        last[html[i]] = i
    rows = warc.op9_warc_revisits(spark, sf_dir).collect()
    assert len(rows) == len(html)
    for r in rows:
        body = html[r["page_id"]]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        original = last[body]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if original == r["page_id"] else ("revisit", original))


def test_warc_odd_rows_and_payloads(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (3, "u\r\nX: y", "a\r\n\r\nb"), (3, "u", "a\r\n\r\nb"), (None, "u", "a\r\n\r\nb"), (4, "u", "z" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", F.lit(1))
    out = warc.archive_pages(pages).collect()
    assert len(out) == 6 and Counter(r["record_type"] for r in out) == {"response": 3, "revisit": 3}
    assert {(r["page_id"], r["refers_to"]) for r in out if r["record_type"] == "revisit"} == {(1, 2), (3, 3), (None, 3)}
    warc.write_responses(pages, str(tmp_path / "w"))
    bodies = sorted(bytes(r["payload"]) for r in warc.read(spark, str(tmp_path / "w"), with_record=True).collect())
    assert bodies == sorted((r[2] or "").encode() for r in rows)
    for file in (tmp_path / "w").glob("part-*"):
        data = file.read_bytes()
        whole = gzip.decompress(data)  # members one after another, and nothing else
        assert b"".join(warc.members(data)) == whole and all(m.startswith(b"WARC/1.1\r\n") for m in warc.members(data))
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    """Large pages, one beyond 16 MB, fill a file sooner than small ones."""
    rng = np.random.default_rng(14)
    noise = lambda n: rng.integers(33, 127, n, dtype=np.uint8).tobytes().decode()
    rows = [(i, "u", noise(300_000)) for i in range(12)] + [(100 + i, "u", "small") for i in range(300)] + [(999, "u", "z" * (17 << 20))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_responses(pages, str(tmp_path / "w"), file_bytes=1 << 20)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert 3 <= len(sizes) <= 6 and max(sizes) < 1_500_000
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, str(tmp_path / "w"), with_record=True).collect()}
    assert back == {i: body for i, _, body in rows}


def test_warc_when_one_payload_is_a_third_of_all_pages(spark):
    pages = spark.createDataFrame([(i, "u", "hot" if i % 3 == 0 else f"page {i}") for i in range(900)], "page_id long, url string, html string")
    rows = warc.archive_pages(pages).collect()
    assert len(rows) == 900
    assert {(r["page_id"], r["refers_to"]) for r in rows if r["record_type"] == "revisit"} == {(i, 897) for i in range(0, 897, 3)}


# 10


def repeats_plain(texts, least):
    holders = defaultdict(set)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            holders[tuple(w[k : k + least])].add(i)
    out = set()
    for i, w in words.items():
        hit = [k for k in range(len(w) - least + 1) if len(holders[tuple(w[k : k + least])]) > 1]
        runs = []
        for k in hit:
            if runs and k - runs[-1][1] <= least:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        out |= {(i, a, b + least) for a, b in runs}
    return out


def test_repeats_against_brute_force(spark):
    rng = np.random.default_rng(4)
    shared = [[f"s{k}x{i}" for i in range(n)] for k, n in enumerate((49, 50, 51, 64, 90, 130))]
    texts = {}
    for d in range(120):
        words = []
        for _ in range(3):
            words += [f"d{d}y{x}" for x in rng.integers(0, 10_000, rng.integers(5, 60))]
            if d % 3:
                part = shared[rng.integers(0, 6)]
                cut = rng.integers(0, 12)
                words += part[cut if rng.random() < 0.3 else 0 :]
        texts[d] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["start"], r["end"]) for r in suffix_repeats.repeated_passages(df).collect()}
    assert got == repeats_plain(texts, 50)


@pytest.mark.parametrize("max_core", [4_096, 2])
def test_repeats_of_passages_with_many_contexts(spark, max_core):
    """One passage in a third of all documents, cut short on either side, with other words around it; sorted and counted."""
    rng = np.random.default_rng(15)
    passage = [f"s{i}" for i in range(110)]
    texts = {}
    for d in range(240):
        words = [f"d{d}y{i}" for i in range(rng.integers(0, 70))]
        if d % 3 == 0:
            a, b = sorted(rng.choice(111, 2, replace=False))
            words += passage[a:b]
        texts[d] = " ".join([*words, *[f"e{d % 7}y{i}" for i in range(rng.integers(0, 60))]])
    rules = suffix_repeats.RepeatRules(max_core=max_core)
    got = {(r["doc_id"], r["start"], r["end"]) for r in suffix_repeats.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), rules).collect()}
    assert got == repeats_plain(texts, 50)


def test_repeats_of_rows_that_share_an_id(spark):
    """Texts of one id keep lists of their own, and don't repeat one another."""
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    own = [f"o{i}" for i in range(20)]
    rows = [(1, " ".join(a)), (2, " ".join(own + a)), (2, " ".join(b)), (3, " ".join(b)), (4, " ".join(own * 4)), (4, " ".join(own * 4 + ["x"]))]
    got = sorted((r["doc_id"], r["start"], r["end"]) for r in suffix_repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, 60), (2, 0, 60), (2, 20, 80), (3, 0, 60)]


def test_repeats_odd_rows(odd, empty):
    rows = suffix_repeats.repeated_passages(odd).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in rows} == {(4, 0, 96), (5, 0, 96)}
    assert suffix_repeats.repeated_passages(empty).count() == 0
