"""Toxic spans by a linear-chain conditional random field.

Each word is a position of the chain with the tag clean or toxic. A tag's
score is a sum over the word's features: hashed byte n-grams of the word and
the blank before it, lower-cased, so stems count as well as words; and the
word before. Forward-backward gives each word's probability of the tag toxic;
a document's score is a logistic function of how many toxic words are
expected, how sure the surest is, and how long the text is.

Labels are given per document. Words of toxic documents whose features are
far more frequent, in documents, among toxic than among clean ones are
labelled toxic; all other words are labelled clean. These labelled words train
the field, by stochastic gradients; documents that were held back from it fit
the logistic function.

Training takes at most ``max_docs`` labelled documents of each class, the
first by a hash of their ids, and runs in one task. The model has a fixed
size, whatever the corpus. Scoring reads every whole text once, and shuffles
nothing.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: Buckets of the hashed features.
BITS = 18
#: Bytes of the n-grams.
GRAMS = (4, 7)
_MASK = np.uint64((1 << BITS) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that separate words become blanks, and A-Z lower case.
_FOLD = bytes(32 if c in (9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class ToxicRules:
    #: Labelled documents of each class that train.
    max_docs: int = 2_000
    #: Texts longer than this aren't training samples; they are scored like all others.
    max_bytes: int = 20_000
    #: A feature marks a word as toxic from this log-odds ratio and number of toxic documents on.
    min_log_odds: float = 2.5
    min_docs: int = 6
    epochs: int = 8
    rate: float = 0.3
    decay: float = 1e-6
    #: Longest part of a text that is one chain in training.
    chain: int = 256
    #: From this probability on, a word is part of an offending span.
    span_at: float = 0.5
    #: Longest part of a text that is one chain in scoring, and the words on
    #: each side that it shares with its neighbours and that only they keep.
    score_chain: int = 4_096
    score_overlap: int = 128


@dataclass(frozen=True)
class Field:
    """weights: of the tag toxic, per feature; transitions[a, b]: from tag a
    to b; calibration: of the document score."""

    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    calibration: np.ndarray

    def to_bytes(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, weights=self.weights, bias=self.bias, transitions=self.transitions, calibration=self.calibration)
        return file.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Field:
        with np.load(io.BytesIO(data)) as x:
            return Field(x["weights"], float(x["bias"]), x["transitions"], x["calibration"])


@functools.lru_cache(maxsize=2)
def loaded(data: bytes) -> Field:
    return Field.from_bytes(data)


@dataclass
class Words:
    """The words of a text. begins, ends: byte offsets; features: buckets;
    owners: the word that each feature belongs to."""

    begins: np.ndarray
    ends: np.ndarray
    features: np.ndarray
    owners: np.ndarray


def words_of(text: str) -> Words:
    data = text.encode("utf-8").translate(_FOLD)
    padded = np.frombuffer(b" " + data + b" " * max(GRAMS), np.uint8)
    blank = padded == 32
    begins = np.flatnonzero(blank[:-1] & ~blank[1:])  # in data: the word's first byte
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    n = len(data) + 1
    # the word of a byte; a blank belongs to the word that follows it
    word = np.cumsum(np.concatenate([[0], blank[1:n] & ~blank[: n - 1]])) if n else np.empty(0, np.int64)
    features, owners = [], []
    bytes64 = padded.astype(np.uint64)
    code = np.zeros(n, np.uint64)
    done = 0
    has_word = word < len(begins)
    for size in GRAMS:
        for k in range(done, size):
            code = code * _STEP + bytes64[k : k + n] + np.uint64(1)
        done = size
        mixed = (code ^ (code >> np.uint64(29))) * _STEP
        # grams that run into the next word say nothing of this one
        inside = has_word & (np.arange(n) + size - 1 <= (ends[np.minimum(word, len(ends) - 1)] if len(ends) else 0))
        features.append(((mixed >> np.uint64(40)) & _MASK)[inside])
        owners.append(word[inside])
    if len(begins):
        # each word as a whole, and as what stands before the next
        whole = np.add.reduceat(np.where(blank[1:n], np.uint64(0), bytes64[1:n]) * _place(n - 1, begins), begins)
        whole = (whole ^ (whole >> np.uint64(31))) * _STEP
        features += [(whole >> np.uint64(41)) & _MASK, ((whole * _STEP) >> np.uint64(42) & _MASK)[:-1]]
        owners += [np.arange(len(begins)), np.arange(1, len(begins))]
    return Words(begins, ends, np.concatenate(features).astype(np.int32), np.concatenate(owners).astype(np.int32))


_PLACES = np.random.default_rng(4_447).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _place(n: int, begins: np.ndarray) -> np.ndarray:
    """A factor for each byte by its place in its word."""
    at = np.arange(n)
    lengths = np.diff(np.concatenate([begins, [n]]))
    place = at[begins[0] :] - np.repeat(begins, lengths)
    return np.concatenate([np.zeros(begins[0], np.uint64), _PLACES[place & 63]])


def scores_of(words: Words, field: Field) -> np.ndarray:
    """The score of the tag toxic against clean, per word."""
    return np.bincount(words.owners, field.weights[words.features], len(words.begins)) + field.bias


def cut_marginals(chains: list[np.ndarray], transitions: np.ndarray, rules: ToxicRules) -> list[np.ndarray]:
    """P(toxic) of each position of chains of any length. Long ones are cut
    into parts that run in step, with some words more on each side; what a word
    tells of another one fades with each word between."""
    size, side = rules.score_chain, rules.score_overlap
    parts, owners = [], []
    for i, chain in enumerate(chains):
        for at in range(0, max(1, len(chain)), size):
            low, high = max(0, at - side), min(len(chain), at + size + side)
            parts.append(chain[low:high])
            owners.append((i, at - low, min(size, len(chain) - at)))
    found: list[list[np.ndarray]] = [[] for _ in chains]
    for p, (i, skip, n) in zip(marginals(parts, transitions), owners, strict=True):
        found[i].append(p[skip : skip + n])
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in found]


def marginals(chains: list[np.ndarray], transitions: np.ndarray) -> list[np.ndarray]:
    """P(toxic) of each position of each chain. Chains of like length run in
    step."""
    out: list[np.ndarray] = [np.empty(0)] * len(chains)
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    at = 0
    while at < len(order) and len(chains[order[at]]):
        longest = len(chains[order[at]])
        group = [i for i in order[at : at + max(1, 400_000 // longest)] if len(chains[i])]
        at += len(group)
        p, _ = forward_backward([chains[i] for i in group], transitions)
        for row, i in enumerate(group):
            out[i] = p[: len(chains[i]), row].copy()
    return out


def forward_backward(chains: list[np.ndarray], transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, chain) of P(toxic), and the expected transition counts. Messages
    are ratios toxic / clean, so a chain of two tags needs one number each.
    ``chains`` are sorted by length, the longest first."""
    lengths = np.array([len(c) for c in chains])
    steps, n = int(lengths[0]), len(chains)
    own = np.zeros((steps, n))
    for k, c in enumerate(chains):
        own[: len(c), k] = c
    odds = np.exp(np.clip(own, -30, 30))
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # chains that reach a step
    (cc, ct), (tc, tt) = np.exp(transitions)
    ahead, back = np.ones((steps, n)), np.ones((steps, n))
    now = ahead[0] = odds[0]
    for t in range(1, steps):
        now = ahead[t] = (ct + now * tt) / (cc + now * tc) * odds[t]
    for t in range(steps - 2, -1, -1):
        k = live[t + 1]
        to = back[t + 1, :k] * odds[t + 1, :k]
        back[t, :k] = (tc + tt * to) / (cc + ct * to)
    ratio = ahead * back
    p = ratio / (1 + ratio)
    counts = np.zeros((2, 2))
    if steps > 1:
        a, b = ahead[:-1], back[1:] * odds[1:]
        inside = np.arange(1, steps)[:, None] < lengths[None, :]
        parts = np.stack([np.full_like(a, cc), ct * b, tc * a, tt * a * b])
        counts = ((parts / parts.sum(axis=0)) * inside).sum(axis=(1, 2)).reshape(2, 2)
    return p, counts


def summary(p: np.ndarray) -> list[float]:
    """What the document score is made of."""
    expected, n = float(p.sum()), len(p)
    surest = float(p.max()) if n else 0.0
    return [1.0, np.log(expected + 0.02), np.log((expected + 0.02) / (n + 50)), surest, np.log1p(n) / 5]


def document_score(p: np.ndarray, field: Field) -> float:
    z = float(np.dot(summary(p), field.calibration))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str], toxic: list[bool], rules: ToxicRules) -> Field:
    """The model, from labelled documents in any order."""
    labels = np.array(toxic, bool)
    docs = [words_of(t) for t in texts]
    fit = np.arange(len(docs)) % 4 != 3  # the rest are for the calibration
    size = 1 << BITS
    counts = np.zeros((2, size))
    for i in np.flatnonzero(fit):
        counts[int(labels[i]), np.unique(docs[i].features)] += 1
    n_clean, n_toxic = int((fit & ~labels).sum()), int((fit & labels).sum())
    log_odds = np.log((counts[1] + 0.5) / (n_toxic + 1)) - np.log((counts[0] + 0.5) / (n_clean + 1))
    marks = (log_odds >= rules.min_log_odds) & (counts[1] >= rules.min_docs)
    field = Field(np.zeros(size), -3.0, np.zeros((2, 2)), np.array([-3.0, 1, 0, 0, 0]))
    weights, bias, transitions = field.weights, field.bias, field.transitions
    chains = []  # (features, owners, tags)
    for i in np.flatnonzero(fit):
        w = docs[i]
        tags = np.zeros(len(w.begins), bool)
        if labels[i]:
            tags[w.owners[marks[w.features]]] = True
        order = np.argsort(w.owners, kind="stable")
        features, owners = w.features[order], w.owners[order]
        for at in range(0, len(tags), rules.chain):
            low, high = np.searchsorted(owners, [at, at + rules.chain])
            chains.append((features[low:high], owners[low:high] - at, tags[at : at + rules.chain]))
    squares, other = np.full(size, 1e-2), np.full(5, 1.0)
    rng = np.random.default_rng(len(chains))
    for _ in range(rules.epochs):
        order = rng.permutation(len(chains))
        for at in range(0, len(order), 128):
            batch = sorted((chains[i] for i in order[at : at + 128]), key=lambda c: -len(c[2]))
            scores = [np.bincount(o, weights[f], len(t)) + bias for f, o, t in batch]
            p, expected = forward_backward(scores, transitions)
            missed = [t - p[: len(t), k] for k, (_, _, t) in enumerate(batch)]
            gradient = np.bincount(np.concatenate([f for f, _, _ in batch]), np.concatenate([d[o] for d, (_, o, _) in zip(missed, batch, strict=True)]), size)
            d_bias = sum(d.sum() for d in missed)
            seen = np.bincount(np.concatenate([2 * t[:-1] + t[1:] for _, _, t in batch]).astype(int), minlength=4).reshape(2, 2)
            gradient -= rules.decay * weights * len(batch)
            squares += gradient * gradient
            weights = weights + rules.rate * gradient / np.sqrt(squares)
            rest = np.concatenate([[d_bias], (seen - expected).ravel()])
            other += rest * rest
            step = rules.rate * rest / np.sqrt(other)
            bias += step[0]
            transitions = transitions + step[1:].reshape(2, 2)
    field = Field(weights.astype(np.float32), float(bias), transitions, field.calibration)
    held = np.flatnonzero(~fit)
    if len(held) and labels[held].any() and not labels[held].all():
        p = marginals([scores_of(docs[i], field) for i in held], transitions)
        field = Field(field.weights, field.bias, transitions, calibrated(np.array([summary(x) for x in p]), labels[held]))
    return field


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = 0.05 * np.eye(len(w))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, may_train: Column, rules: ToxicRules = ToxicRules()) -> bytes:
    """A trained model. ``labels``: (doc_id, toxic 0 or 1); ``may_train``
    decides by doc_id which labels are learned. Null labels, ids and texts
    aren't learned. Without toxic or clean samples, all scores are low."""
    known = labels.where(may_train & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    order = F.xxhash64("doc_id", F.lit("sample"))
    # a bounded number of ids each; the texts of no other document are looked at
    picked = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(rules.max_docs) for k in (0, 1)]
    ids = store.written(picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "sample_ids")
    texts = docs.where(F.col("text").isNotNull() & (F.octet_length("text") <= rules.max_bytes)).select("doc_id", "text")
    sample = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        toxic: list[bool] = []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            toxic += [x == 1 for x in batch.column("toxic").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([train(texts, toxic, rules).to_bytes()])], ["model"])

    written = store.written(sample, "sample")
    one = written.coalesce(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "toxic")
    model = bytes(one.mapInArrow(learn, "model binary").first()["model"])
    for table in (ids, written):
        store.drop(table)
    return model


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", rules: ToxicRules = ToxicRules()) -> DataFrame:
    """(doc_id, score, spans): a row per input row. spans are the offending
    stretches, array<struct<start, end, p>>, in code points, end exclusive; p
    is the greatest probability in the stretch.

    Null texts count as empty; empty ones have the score that no toxic word
    gives. Very long texts are tagged in parts that overlap, so that no chain
    is longer than ``score_chain`` and its margins. Null ids and repeated rows are kept as they are. An empty table
    gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of a fixed size
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = loaded(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("text").to_pylist()
                found = [words_of(t) for t in texts]
                bounds = [(w.begins, w.ends) for w in found]
                p = cut_marginals([scores_of(w, field) for w in found], field.transitions, rules)
                del found
                spans = [spans_of(t, b, e, x, rules.span_at) for t, (b, e), x in zip(texts, bounds, p, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([document_score(x, field) for x in p]), pa.array(spans, span_type)], ["doc_id", "score", "spans"])

    return rows.mapInArrow(tag, f"doc_id {id_type}, score double, spans array<struct<start:int,end:int,p:double>>")


def spans_of(text: str, begins: np.ndarray, ends: np.ndarray, p: np.ndarray, least: float) -> list[dict]:
    """Stretches of neighbouring words that are at least so probable."""
    hits = np.flatnonzero(p >= least)
    if not len(hits):
        return []
    first = np.concatenate([[True], np.diff(hits) > 1])
    data = text.encode("utf-8")
    starts = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # code points up to and with each byte
    groups = np.split(hits, np.flatnonzero(first)[1:])
    return [{"start": int(starts[begins[g[0]]]) - 1, "end": int(starts[ends[g[-1]] - 1]), "p": float(p[g].max())} for g in groups]


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit(docs, labels, ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
