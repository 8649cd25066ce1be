"""Mixing to target weights by soft domain membership, in DataFrame functions only.

1. A labelled table names the domain of some documents. A naive Bayes classifier on
   binned shape features of whole texts gives every document a posterior p over domains.
2. Document rates r >= 0 are fitted so that the expected tokens of each domain, the sum
   of r * n * p, match the targets: least squares by projected gradient. A step is
   r <- max(0, r - p . g), where g is the residual scaled by the Gram matrix of the
   posteriors of documents whose rate is above zero. One row of sums a step reaches the
   driver; a rate is the fold of the steps so far, so no state is kept a document.
3. A document is repeated floor(r + u) times, u in [0, 1) being a hash of id and text.

Defined cases: null text is empty with 0 tokens; documents without tokens keep rate 1;
null labels count as no label, repeated ones once each; a domain without labels is
not predicted; without any labels every posterior is equal over the domains; an empty
table gives an empty result; very long texts are counted whole; equal posteriors get equal
rates; other columns are carried by `apply`, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm import shared
from readloom.llm.shared import let

#: Upper bounds of the bins of each feature.
BINS: dict[str, tuple[float, ...]] = {
    "tokens": (20, 50, 100, 200, 500, 1000, 2000),
    "word_length": (3, 4, 4.5, 5, 5.5, 6, 8),
    "symbols": (0.0, 0.001, 0.005, 0.02, 0.05, 0.1),
    "digits": (0.0, 0.001, 0.005, 0.02, 0.05),
    "capitals": (0.005, 0.01, 0.02, 0.03, 0.05, 0.1),
    "stops": (0.002, 0.005, 0.01, 0.015, 0.02, 0.03),
    "repeats": (0.0, 0.02, 0.1, 0.3, 0.5),
}
SMOOTHING, STEPS, TOLERANCE = 1.0, 60, 1e-7
#: A step that moves rates by less than this, on average over tokens, ends the fit.
STILL = 1e-7
#: Weights by domain, as shares of all tokens: documents labelled good (1) and poor (0).
TARGETS = {"1": 0.94, "0": 0.06}


def features(text: Column) -> Column:
    """struct<n, bins array<int>> of a text."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))

    def body(c: Column) -> Column:
        chars = F.greatest(c["chars"], F.lit(1))
        value = {"tokens": c["n"], "word_length": (c["chars"] - c["n"]) / F.greatest(c["n"], F.lit(1)), "symbols": c["symbols"] / chars, "digits": c["digits"] / chars, "capitals": c["capitals"] / chars, "stops": c["stops"] / chars, "repeats": c["repeats"]}
        binned = [sum((F.when(value[f] > bound, 1).otherwise(0) for bound in bounds), F.lit(0)) for f, bounds in BINS.items()]
        return F.struct(c["n"].cast("long").alias("n"), F.array(*binned).alias("bins"))

    repeats = let(F.split(text, "\n", -1), lambda ls: 1 - F.size(F.array_distinct(ls)) / F.size(ls))
    counts = F.struct(F.length(text).alias("chars"), count(r"[^\x20\x09-\x0D]+").alias("n"), count(r"[#*$%&|<>]").alias("symbols"), count("[0-9]").alias("digits"), count("[A-Z]").alias("capitals"), count(r"[.!?]").alias("stops"), repeats.alias("repeats"))
    return let(counts, body)


@dataclass(frozen=True)
class Mixture:
    domains: tuple[str, ...]
    prior: tuple[float, ...]  # log
    table: tuple[tuple[tuple[float, ...], ...], ...]  # log likelihood [domain][feature][bin]
    steps: tuple[tuple[float, ...], ...]  # g of each step
    totals: tuple[float, ...]  # expected tokens reached
    targets: tuple[float, ...]

    def posterior(self, bins: Column) -> Column:
        """array<double> over the domains."""
        logs = F.array(*[sum((F.get(F.array(*[F.lit(x) for x in row]), F.get(bins, F.lit(f))) for f, row in enumerate(rows)), F.lit(p)) for p, rows in zip(self.prior, self.table, strict=True)])
        scaled = let(logs, lambda ls: F.transform(ls, lambda x: F.exp(x - F.array_max(ls))))
        return let(scaled, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))

    def rate(self, n: Column, p: Column) -> Column:
        return _rate(n, p, self.steps)


def _rate(n: Column, p: Column, steps: tuple[tuple[float, ...], ...]) -> Column:
    if not steps:
        return F.lit(1.0)
    dot = lambda g: F.aggregate(F.zip_with(p, g, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    every = F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in g) + ")" for g in steps) + ")")
    return F.when(n > 0, F.aggregate(every, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))).otherwise(1.0)


def classify(shapes: DataFrame, labelled: DataFrame, domains: tuple[str, ...]) -> tuple[tuple[float, ...], tuple]:
    """(log prior, log likelihoods) from `shapes` (doc_id, bins) and `labelled` (doc_id, domain); counts of bins reach the driver."""
    known = shapes.join(labelled.filter(F.col("domain").isin(*domains)).distinct(), "doc_id")
    rows = known.select("domain", F.posexplode("bins").alias("f", "bin")).groupBy("domain", "f", "bin").agg(F.count("*").alias("k")).collect()
    count = {(r["domain"], r["f"], r["bin"]): r["k"] for r in rows}
    sizes = {d: sum(k for (x, f, _), k in count.items() if x == d and f == 0) for d in domains}
    total = sum(sizes.values())
    prior = tuple(math.log((sizes[d] + SMOOTHING) / (total + SMOOTHING * len(domains))) for d in domains)
    table = tuple(tuple(tuple(math.log((count.get((d, f, b), 0) + SMOOTHING) / (sizes[d] + SMOOTHING * (len(bounds) + 1))) for b in range(len(bounds) + 1)) for f, bounds in enumerate(BINS.values())) for d in domains)
    return prior, table


def _solve(a: list[list[float]], y: list[float]) -> list[float]:
    """Gaussian elimination with a small ridge, for a matrix of the domains' size."""
    n = len(y)
    ridge = 1e-9 * max(max(abs(x) for x in row) for row in a) + 1e-300
    m = [row[:] + [y[i]] for i, row in enumerate(a)]
    for i in range(n):
        m[i][i] += ridge
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[k] = m[k], m[i]
        for r in range(i + 1, n):
            w = m[r][i] / m[i][i]
            m[r] = [x - w * z for x, z in zip(m[r], m[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (m[i][n] - sum(m[i][j] * out[j] for j in range(i + 1, n))) / m[i][i]
    return out


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = None) -> tuple[Mixture, DataFrame]:
    """(mixture, memberships): `targets` are shares of `total` tokens, by default as many as there are.

    memberships: doc_id, n, p of every row.
    """
    domains = tuple(targets)
    shapes = shared.materialize(docs.select("doc_id", features(shared.text_of()).alias("s")).select("doc_id", "s.n", "s.bins"), "shapes")
    prior, table = classify(shapes.select("doc_id", "bins"), labelled, domains)
    blank = Mixture(domains, prior, table, (), (), ())
    members = shared.materialize(shapes.select("doc_id", "n", blank.posterior(F.col("bins")).alias("p")), "members")
    k = len(domains)
    weighed = members.filter("n > 0").groupBy("p").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    weighed = shared.materialize(weighed, "weights")  # rates depend on p alone: equal posteriors are one row
    at = lambda i: F.get("p", F.lit(i))
    steps: list[tuple[float, ...]] = []
    # without a step yet, both tries are the rates of 1
    tries: list[list[tuple[float, ...]]] = [[], []]
    reached: list[float] = [0.0] * k
    goal: list[float] = []
    for _ in range(STEPS):
        columns = {f"r{c}": _rate(F.lit(1), F.col("p"), (*steps, *new)) for c, new in enumerate(tries)}
        rated = weighed.withColumns(columns | {"before": _rate(F.lit(1), F.col("p"), tuple(steps))})
        sums = [F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("r0") - F.col("before")) ** 2).alias("moved"), *[F.sum(F.col("n") * at(i)).alias(f"m{i}") for i in range(k)]]
        for c in range(len(tries)):
            live = F.when(F.col(f"r{c}") > 0, F.col("n")).otherwise(0)
            sums += [F.sum(F.col(f"r{c}") * F.col("n") * at(i)).alias(f"t{c}_{i}") for i in range(k)]
            sums += [F.sum(live * at(i) * at(j)).alias(f"g{c}_{i}_{j}") for i in range(k) for j in range(i, k)]
        got = rated.agg(*sums).first()
        if not got["all"]:
            break
        tokens, share = float(total or got["all"]), sum(targets.values())
        goal = [tokens * targets[d] / share for d in domains]
        offs = [[got[f"t{c}_{i}"] - goal[i] for i in range(k)] for c in range(len(tries))]
        best = min(range(len(tries)), key=lambda c: (sum(x * x for x in offs[c]), c))
        steps += tries[best]
        off, reached = offs[best], [got[f"t{best}_{i}"] for i in range(k)]
        started = bool(steps)
        if math.sqrt(sum(x * x for x in off)) < TOLERANCE * tokens or started and math.sqrt(got["moved"] / got["all"]) < STILL:
            break
        gram = [[got[f"g{best}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]
        most = max(got[f"m{i}"] for i in range(k))
        tries = [[tuple(x / most for x in off)], [tuple(_solve(gram, off))]]
    return Mixture(domains, prior, table, tuple(steps), tuple(reached), tuple(goal)), members


def copies(rate: Column, doc_id: Column, text: Column) -> Column:
    """floor(rate + u), u a hash of the document."""
    u = F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), text), 11) / F.lit(2.0**53)
    return F.floor(rate + u).cast("int")


def rates(members: DataFrame, mixture: Mixture) -> DataFrame:
    """Per row: doc_id, n_tokens, the posterior of each domain as p_<domain>, and rate."""
    p = [F.round(F.get("p", F.lit(i)), 9).alias(f"p_{d}") for i, d in enumerate(mixture.domains)]
    return members.select("doc_id", F.col("n").alias("n_tokens"), *p, mixture.rate(F.col("n"), F.col("p")).alias("rate"))


def apply(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """Rows of `docs`, each as often as its rate says; posteriors are computed anew from the text, so no row is shuffled."""
    text = shared.text_of()
    rate = let(features(text), lambda s: let(mixture.posterior(s["bins"]), lambda p: mixture.rate(s["n"], p)))
    times = shared.free_name(docs, "copies")
    taken = docs.withColumn(times, copies(rate, F.col("doc_id"), text)).filter(F.col(times) > 0)
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
