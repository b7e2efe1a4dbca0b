"""Secret scans: fixed rules plus two character Markov models, in DataFrame
functions only.

The rules find assignments, access keys and long hexadecimal runs. The models
give the log-likelihood of a token as a random string and as an ordinary
identifier; a token whose ratio is high, in all and per character, is a secret
too. Both models come from labelled samples: values that the rules find are
random, other long tokens are ordinary. All values in all documents are used
as random samples; ordinary samples come from at most
``max_ordinary_docs`` documents, picked by a hash. The trained model is a
table of ``WIDTH * WIDTH`` numbers, whatever the size of the corpus.

One pass over the texts trains, one scans; only transition counts are shuffled.
Places, overlaps and replacements come from running sums and greatest values
over a text's matches, so that a text full of matches takes no longer a
character than any other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import added, let, scanned

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Tokens that the models judge: from 16 characters on.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Characters of a token lie in FIRST .. FIRST + WIDTH - 1.
FIRST, WIDTH = ord("+"), 80


@dataclass(frozen=True)
class MarkovRules:
    max_ordinary_docs: int = 20_000
    #: Added to each count of the random model, so that it is uniform without samples.
    random_prior: float = 1.0
    #: Share of the uniform distribution in the ordinary model.
    ordinary_floor: float = 0.1
    min_ratio: float = 12.0
    min_ratio_per_char: float = 0.5


def placed(text: Column, pattern: str, group: int, kind: int, keep) -> Column:
    """array<struct<start, kind, end>> of the matches that ``keep(match,
    group)`` takes; code points, end exclusive. Starts are running sums of the
    lengths of what lies before: the pieces that a split leaves and earlier
    matches; so the work grows with the text, however many matches it has."""
    empty = F.array().cast(SPANS)

    def spans(m: Column) -> Column:
        taken = F.filter(F.transform(m.all, lambda x, k: F.struct(x.alias("m"), F.get(m.part, k).alias("g"), k.alias("k"))), lambda x: keep(x.m, x.g))
        gaps, lengths = F.transform(F.split(text, pattern, -1), F.length), F.transform(m.all, F.length)
        starts = let(F.struct(gaps.alias("gaps"), lengths.alias("lengths")), lambda at: scanned(F.transform(at.lengths, lambda _, k: F.get(at.gaps, k) + F.coalesce(F.get(at.lengths, k - 1), F.lit(0))), added))
        one = lambda s, x: F.struct(F.get(s, x.k).alias("start"), F.lit(kind).alias("kind"), (F.get(s, x.k) + F.length(x.m)).alias("end"))
        return let(taken, lambda t: F.when(F.size(t) > 0, let(starts, lambda s: F.transform(t, lambda x: one(s, x)))).otherwise(empty))

    matches = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    if group:
        found = let(F.struct(matches(0).alias("all"), matches(group).alias("part")), spans)
    else:
        found = let(matches(0), lambda m: let(F.struct(m.alias("all"), m.alias("part")), spans))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Spans of the fixed rules."""
    return F.concat(
        placed(text, ASSIGN, 2, 0, lambda m, g: F.length(g) >= 8),
        placed(text, ACCESS, 0, 1, lambda m, g: F.length(m) >= 16),
        # runs of hexadecimal digits are whole, so those of 32 and more are the matches of this
        placed(text, HEX[:-1] + "{32,}", 0, 2, lambda m, g: F.lit(True)),
    )


def transitions(token: Column) -> Column:
    """array<int>: the cell of the model for each pair of neighbouring characters."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST)
    return let(codes, lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: a * WIDTH + b))


def labelled_tokens(docs: DataFrame, rules: MarkovRules) -> DataFrame:
    """(token, random): values of the fixed rules, and other long tokens. One
    pass over the texts."""
    share = min(1.0, rules.max_ordinary_docs / max(1, docs.count()))
    found = lambda pattern, group=0: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    values = F.concat(
        F.filter(found(ASSIGN, 2), lambda g: (F.length(g) >= 8) & ~g.contains(".")),
        F.filter(found(ACCESS), lambda m: F.length(m) >= 16),
        found("[0-9a-f]{32,}"),
    )
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), "[0-9a-f]{32,}", " ")
    picked = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))
    some = lambda when, tokens, random: F.transform(F.when(when, F.array_distinct(tokens)).otherwise(F.array().cast("array<string>")), lambda t: F.struct(t.alias("token"), F.lit(random).alias("random")))
    both = F.concat(some(F.regexp_like("text", F.lit(f"{ASSIGN}|{ACCESS}|[0-9a-f]{{32,}}")), values, True), some(picked, F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0)), False))
    return docs.select(F.explode(both).alias("sample")).select("sample.token", "sample.random")


def train(samples: DataFrame, rules: MarkovRules = MarkovRules()) -> list[float]:
    """The log-likelihood ratio of each transition, from (token, random)."""
    cells = samples.select("random", F.explode(transitions(F.col("token"))).alias("cell")).groupBy("random", "cell").count()
    counts = {True: {}, False: {}}
    for row in cells.collect():  # WIDTH * WIDTH cells twice at most
        counts[row["random"]][row["cell"]] = row["count"]
    table = []
    for a in range(WIDTH):
        n_random, n_ordinary = (sum(counts[k].get(a * WIDTH + b, 0) for b in range(WIDTH)) for k in (True, False))
        for b in range(WIDTH):
            p = (counts[True].get(a * WIDTH + b, 0) + rules.random_prior) / (n_random + rules.random_prior * WIDTH)
            seen = counts[False].get(a * WIDTH + b, 0) / n_ordinary if n_ordinary else 1 / WIDTH
            q = (1 - rules.ordinary_floor) * seen + rules.ordinary_floor / WIDTH
            table.append(math.log(p / q))
    return table


def markov_spans(text: Column, table: list[float], rules: MarkovRules) -> Column:
    """Spans of the tokens that the models take for random strings."""
    model = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # folded to a constant

    def secret(m: Column, g: Column) -> Column:
        ratio = F.aggregate(transitions(m), F.lit(0.0), lambda acc, cell: acc + F.get(model, cell))
        return let(ratio, lambda r: (r >= rules.min_ratio) & (r >= F.lit(rules.min_ratio_per_char) * F.length(m)))

    return placed(text, TOKEN, 0, 3, secret)


def scan(docs: DataFrame, rules: MarkovRules = MarkovRules(), id_col: str = "doc_id", text_col: str = "text", table: list[float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``spans`` (array of start, end, kind, sorted by
    start, then kind), and ``redacted``, the text with spans replaced.

    Markov spans that overlap a span of the rules are left out. Null texts
    count as empty and have no spans; very long texts take time in proportion
    to their length; repeated rows each get theirs; an empty table gives an
    empty result. Other columns are ignored unless named in ``keep``; those
    come back unchanged in a struct ``row``, so that no name can clash.
    ``table`` is a trained model; by default it is trained on ``docs``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[F.col(c) for c in keep or [id_col]]).alias("row"))
    table = table or train(labelled_tokens(rows, rules), rules)
    both = F.concat(base_spans(F.col("text")), markov_spans(F.col("text"), table, rules))
    found = rows.select("doc_id", "text", let(F.sort_array(both), apart).alias("spans"), "row")
    return found.select("doc_id", "spans", F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")).alias("redacted"), "row")


def apart(spans: Column) -> Column:
    """Sorted spans without those of the models that overlap one of the rules:
    the rules' spans before reach to at most its start, and the next one
    starts at its end or later."""
    fixed = lambda x, value: F.when(x.kind < len(KINDS) - 1, value)
    reach = scanned(F.transform(spans, lambda x: fixed(x, x.end)), F.greatest)
    after = scanned(F.transform(spans, lambda x: fixed(x, x.start)), F.least, forward=False)
    alone = lambda at: F.filter(spans, lambda x, k: (x.kind < len(KINDS) - 1) | ((F.coalesce(F.get(at.reach, k), F.lit(0)) <= x.start) & F.coalesce(F.get(at.after, k) >= x.end, F.lit(True))))
    return F.when(F.exists(spans, lambda x: x.kind == len(KINDS) - 1), let(F.struct(reach.alias("reach"), after.alias("after")), alone)).otherwise(spans)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]", chunk: int = 512) -> Column:
    """The text with each stretch of overlapping spans replaced by ``mark``.
    What is kept is joined from chunks of the text, so no piece is sought from
    the text's start."""

    def joined_pieces(at: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first = F.floor(a / chunk).cast("int")
            piece = F.array_join(F.slice(at.chunks, first + 1, F.floor((b - 1) / chunk).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(piece, a % chunk + 1, b - a)).otherwise("")

        before = lambda k: F.coalesce(F.get(at.reach, k - 1), F.lit(0))
        heads = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda k: (k == 0) | (F.get(spans, k).start >= before(k)))
        pieces = F.transform(heads, lambda k: cut(before(k), F.get(spans, k).start))
        return F.array_join(F.concat(pieces, F.array(cut(F.element_at(at.reach, -1), F.length(text)))), mark)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    return let(F.struct(chunks.alias("chunks"), scanned(F.transform(spans, lambda x: x.end), F.greatest).alias("reach")), joined_pieces)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda x: x.kind < 3)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), number(3).alias("n_markov"),
    )
