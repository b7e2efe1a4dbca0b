"""Licenses, conversation tries and manifests against plain versions, on rows
with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from driftline.llm import licenses, merkle, prefix_trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NOTICE = "Licensed under the Apache License, Version 2.0."
LONG = " ".join(f"w{i % 977}x{i}" for i in range(12_000))


def crc(value):
    return zlib.crc32(str(value).encode())


# 11


def licensed_rows():
    mit = licenses.TEMPLATES[5][1]
    changed = mit.replace("free of charge", "wholly free of charge").replace("copyright notice", "copyright line").upper()
    return [
        (1, None), (2, ""), (3, " .,-\n"), (4, "mit license"), (5, "MIT-License mit license, x Mit\tLICENSE"), (6, f"{LONG} {NOTICE} {LONG}"), (6, f"{LONG} {NOTICE} {LONG}"),
        (7, f"alpha {mit} omega"), (8, f"before it\n{changed}\nafter it"), (9, "licensed under the moon and the stars"), (10, "cc by cc by-nc submit license mit licensee"), (None, NOTICE),
        (11, f"{NOTICE} {mit} {NOTICE}"), (12, "é mit license ü"), (13, " ".join([NOTICE] * 40)), (14, "gnu general public license apache license"),
    ]


def plain_base(text):
    w = re.findall(licenses.WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = sorted(i for i, _ in found)
    return len(w), len(at), at[0] if at else None, at[-1] if at else None, sorted({x for _, x in found})


def test_license_base_and_labels_of_odd_rows(spark):
    clash = [F.lit(1).alias(c) for c in ("a", "b", "t", "d", "h", "p", "q", "words", "spans", "found", "label", "n", "salt")]
    df = spark.createDataFrame(licensed_rows(), "doc_id long, text string").select("*", *clash)
    for rules in (licenses.LicenseRules(), licenses.LicenseRules(broadcast_grams=0, broadcast_texts=0)):
        got = licenses.scan(df, rules).collect()
        key = lambda x: repr(x)
        assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=key) == sorted(((i, *plain_base(t)) for i, t in licensed_rows()), key=key)
        spans = {r["doc_id"]: r["spans"] for r in got}
        assert [s["label"] for s in spans[6]] == ["apache-2.0"] and (spans[6][0]["start"], spans[6][0]["end"]) == (12_000, 12_008)
        assert [s["label"] for s in spans[7]] == ["mit"] and spans[7][0]["share"] == 1.0 and spans[7][0]["start"] == 1
        assert [s["label"] for s in spans[8]] == ["mit"] and 0.9 < spans[8][0]["share"] < 1.0
        assert not spans[9] and not spans[1] and not spans[3] and not spans[10]
        assert sorted(s["label"] for s in spans[11]) == ["apache-2.0", "apache-2.0", "mit"] and len(spans[13]) == 40
        assert all(0 <= r["score"] <= 1 and (r["score"] == 1 or not r["n_base"]) for r in got)


def test_licenses_of_an_empty_table_and_other_templates(spark):
    df = spark.createDataFrame(licensed_rows(), "doc_id long, text string")
    assert licenses.scan(df.where("false")).count() == 0
    own = licenses.scan(df, templates=[("moon", "under the moon and stars"), ("none", "a b"), ("empty", "")])
    assert {(r["doc_id"], s["label"]) for r in own.collect() for s in r["spans"]} == {(9, "moon")}


# 12


def plain_trie(rows, base=lambda c: c - int(math.fmod(c, 5)), head=lambda c: crc(c) % 9):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            h = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append(((turn is not None, turn or 0, h), (role, text)))
    turns = {c: [x for _, x in sorted(t)] for c, t in turns.items()}
    rebuilt = {c: turns.get(base(c), [])[: head(c)] + turns[c][head(c) :] for c in turns}
    members = {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    children, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k in members:
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += children[k] == 0
    ends = {k: ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(k)))) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


def built(df, block=256):
    c = F.col("conv_id")
    return sorted(map(tuple, prefix_trie.trie(df, c - c % 5, F.crc32(c.cast("string")) % 9, 8, prefix_trie.TrieRules(block=block)).collect()))


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_of_odd_rows(spark):
    rnd = random.Random(4)
    rows = [(None, 1, "u", "q")]
    for c in range(-12, 60):
        for t in range(rnd.choice([0, 1, 3, 9, 40]) + 1):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["u", None]), rnd.choice(["a", "b", "", "é"]) if t < 6 else rnd.choice(["x", None])))
    rows += rows[-30:] + [(77, 1, "ab", "c"), (78, 1, "a", "bc"), (900, 0, "u", "long " * 40_000)]
    df = spark.createDataFrame(rows, TURNS).select("*", *[F.lit(1).alias(c) for c in ("depth", "owner", "n", "block", "h", "bytes", "parent", "first")])
    assert built(df) == built(df, block=4) == plain_trie(rows)


def test_trie_whose_chains_hang_in_a_row(spark):
    """Each conversation is one turn longer than the one before: as high as there are conversations."""
    rows = [(c * 5, t, "u", f"t{t}") for c in range(20) for t in range(c + 1)]
    assert built(spark.createDataFrame(rows, TURNS), block=4) == plain_trie(rows)


def test_trie_with_a_third_of_all_rows_in_one_conversation(spark):
    rows = [(3, t, "u", f"t{t}") for t in range(250)] + [(c, t, "u", f"t{t}") for c in range(10, 135) for t in range(4)]
    assert built(spark.createDataFrame(rows, TURNS), block=16) == plain_trie(rows)


def test_trie_of_no_and_of_equal_conversations(spark):
    df = spark.createDataFrame([(c, 0, "u", "same") for c in range(40)] * 2, TURNS)
    assert built(df.where("false")) == []
    assert built(df) == plain_trie([tuple(r) for r in df.collect()])


# 13


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in ("doc_id", "source", "lang", "n_chars", "text"))])


def plain_tree(nodes):
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        for i, k in enumerate(at):
            paths[i].append((k % 2, now[k ^ 1]) if k ^ 1 < len(now) else None)
        now, at = [h(*now[a : a + 2]) for a in range(0, len(now), 2)], [k >> 1 for k in at]
    return now[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: plain_tree([x[2] for x in groups[g].sort(key=lambda x: x[:3]) or groups[g]]) for g in langs}
    root, up = plain_tree([subs[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(groups[g]):
            path = subs[g][1][i] + up[k]
            changed = r["doc_id"] is not None and crc(r["doc_id"]) % 7 == 0 and r["n_chars"] is not None
            node = plain_leaf(r | {"n_chars": r["n_chars"] + 1}) if changed else leaf
            for p in path:
                node = h(node) if p is None else h(p[1], node) if p[0] else h(node, p[1])
            out.append((r["doc_id"], leaf, subs[g][0], root, h(*[p[1] for p in path if p]), node, node == root))
    return sorted(out, key=repr)


def listed(df, rules=merkle.TreeRules()):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = [F.col("n_chars").cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in names]
    return sorted(map(tuple, merkle.manifest(df, [F.col(c) for c in names], F.col("lang"), F.col("doc_id"), tampered, changed, rules).collect()), key=repr)


@pytest.mark.parametrize("rules", [merkle.TreeRules(), merkle.TreeRules(block_bits=2, top_nodes=8)])
def test_manifest_of_odd_rows(spark, rules):
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["a", "", None, "é" * 9]), rnd.choice(["en", "en", "en", None, "", "fr", "=x"]), rnd.choice(["s", None]), rnd.choice([None, 5, (1 << 63) - 1])) for i in range(150)]
    rows += rows[:9] + [(None, "no id", "en", "s", 1), (None, None, None, None, None), (5_000, LONG, "only", "s", 3)]
    df = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in ("g", "n", "pos", "hash", "block", "path", "root", "other", "id", "of")])
    got = listed(df, rules)
    assert got == plain_manifest([r.asDict() for r in df.collect()])
    assert {x[-1] for x in got} == {True, False}


def test_manifest_of_small_tables(spark):
    df = spark.createDataFrame([(1, "x", "en", "s", 1)], DOCS)
    assert listed(df.where("false")) == []
    assert listed(df) == plain_manifest([df.first().asDict()])
    three = spark.createDataFrame([(i, "x", "en", "s", 1) for i in range(3)], DOCS)
    assert listed(three) == plain_manifest([r.asDict() for r in three.collect()])


def test_blocks_are_bounded(spark):
    """No task of the reduction sees more leaves than a block has."""
    df = spark.range(5_000).select(F.lit("").alias("g"), F.col("id").alias("pos"), F.lit(5_000).cast("long").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    rules = merkle.TreeRules(block_bits=4, top_nodes=64)
    found, roots = merkle.tree(df, rules)
    want, _ = plain_tree([h(str(i)) for i in range(5_000)])
    assert {r["root"] for r in found.select("root").distinct().collect()} == {want} and roots.first()["root"] == want
