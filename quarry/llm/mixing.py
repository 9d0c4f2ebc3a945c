"""Mixing sources to target weights with soft membership.

1. A classifier of the labelled table gives every document posteriors of the
   domains: ``toxic`` where toxic is 1, ``low`` where quality is 0, else
   ``good``.  It is a softmax regression on those of the document's distinct
   words, sign runs (hashed to BUCKETS) and marks of form that tell the domains
   apart, fitted on at most ``sample`` rows of each domain (those with the least
   hash of their doc_id) and corrected for the domains' true frequencies.
   A document's tokens n_i are those of byte-level BPE.
2. Document rates r >= 0 are fitted so that the expected token totals
   S_d = sum(r_i * n_i * p_id) come near to targets T_d in the least-squares
   sense.  Projected gradient starts from r = 1; each step is one distributed
   sum of S, and moves every rate by its posteriors times the residual,
   preconditioned by the inverse Gram matrix of the posteriors (so the step is
   safe), then cuts it off at 0; Nesterov's momentum, dropped whenever the
   residual grows, takes it on faster.  A rate is a function of the posteriors
   and the few moves so far, so no vector of rates is kept.  It ends where the
   targets are met, or where a step changes nothing, or after STEPS steps;
   ``Fit.ended`` says which.
3. A document with rate r is taken floor(r + u) times, u being a hash of its
   doc_id and text in [0, 1): r times in expectation, and the same in every run.

Targets are shares of ``budget`` tokens; by default the budget is such that
``good`` meets its share with HEADROOM times what it has, so good documents have
rates of about 1 and stay.

Defined results: a null or empty text has 0 tokens and the posteriors of a text
without features; a very long one counts whole.  Repeated rows share posteriors,
rate, u and copies; rows of equal or null doc_ids but different texts have each
their own u.  Labels that are null, or of unknown documents, train nothing; a
document with several labels trains once for each.  Domains without a labelled
document get no share.  Without any labels, or any token, all rates are 1.  An
empty table stays empty.  Of features with equal chi-squared those of the lower
bucket are taken.  All columns of df pass through ``resample``, under any names,
and nulls in them change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _shared, _text, bpe

DOMAINS = ("good", "low", "toxic")
WEIGHTS = {"good": 0.90, "low": 0.08, "toxic": 0.02}
SAMPLE = 2000
BUCKETS = 1 << 18
#: Features that tell the domains apart are chosen by chi-squared: at most FEATURES, in LEAST documents of the sample at least.
FEATURES, LEAST, CHI2 = 512, 3, 12.0
#: Buckets of the marks of form.
MARKS = 80
STEPS, TOLERANCE, HEADROOM = 60, 1e-4, 1.02
EPOCHS, RATE, DECAY = 300, 0.5, 2e-4


# --- features
def features(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices: (index of the first text, document and bucket of each distinct feature, words by document)."""
    for lo, hi in _text.slices(texts):
        cps, offsets = _text.code_points(texts[lo:hi])
        kind, fold = _text.class_tables()
        start, end, doc = _text.words(cps, offsets)
        h = _text.segment_hash(fold[cps], start, end)
        n = hi - lo
        count = np.bincount(doc, minlength=n)
        # Runs of signs.
        sign = np.zeros(len(cps) + 1, bool)
        sign[:-1] = kind[cps] == 0
        edge = np.zeros(len(cps) + 1, bool)
        edge[offsets] = True
        before = np.roll(sign, 1)
        before[0] = False
        s = np.flatnonzero(sign[:-1] & (~before[:-1] | edge[:-1]))
        e = np.flatnonzero(before & (~sign | edge))
        sdoc = np.searchsorted(offsets, s, side="right") - 1
        key = np.concatenate([h, _text.segment_hash(cps, s, e, _text.BASE2)]) >> np.uint64(24)
        signs = np.repeat(np.array([0, 1], np.uint64), [len(doc), len(sdoc)]) << np.uint64(63)
        both = signs | (np.concatenate([doc, sdoc]).astype(np.uint64) << np.uint64(40)) | key
        distinct = _text.unique(both)
        kinds = np.bincount((distinct[distinct < 1 << 63] >> np.uint64(40)).astype(np.int64), minlength=n)  # distinct words
        distinct &= np.uint64((1 << 63) - 1)
        # Marks of form: by tenths words that repeat the one before, distinct words, words in capitals, lines that repeat the one before; words by powers of two.
        again = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])], minlength=n) if len(h) else np.zeros(n)
        capital = fold[cps] != cps
        loud = np.add.reduceat(capital, start) >= np.maximum(end - start, 2) if len(start) else np.zeros(0, bool)
        loud = np.bincount(doc[loud], minlength=n)
        lines, repeated = repeated_lines(cps, offsets)
        marks = [np.floor(10 * x / np.maximum(y, 1)).astype(np.int64) + 16 * i for i, (x, y) in enumerate(((again, count), (kinds, count), (loud, count), (repeated, lines)))]
        marks.append(64 + np.minimum(np.log2(count + 1).astype(np.int64), 15))
        d = np.concatenate([(distinct >> np.uint64(40)).astype(np.int64), *[np.flatnonzero(count)] * len(marks)])
        b = np.concatenate([MARKS + ((distinct & np.uint64((1 << 40) - 1)) % np.uint64(BUCKETS - MARKS)).astype(np.int64), *(m[count > 0] for m in marks)])
        order = np.argsort(d, kind="stable")
        yield lo, d[order], b[order], count


def repeated_lines(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines, lines that another line of the text before it equals) of each text."""
    n = len(offsets) - 1
    start = _text.unique(np.concatenate([offsets[:-1], np.flatnonzero(cps == 10) + 1]))
    start = start[start < len(cps)]
    end = np.append(start[1:], len(cps))[: len(start)]
    end = np.where(cps[np.maximum(end - 1, 0)] == 10, end - 1, end) if len(start) else end
    full = end > start
    start, end = start[full], end[full]
    doc = np.searchsorted(offsets, start, side="right") - 1
    key = (doc.astype(np.uint64) << np.uint64(40)) | (_text.segment_hash(cps, start, end) >> np.uint64(24))
    lines = np.bincount(doc, minlength=n)
    return lines, lines - np.bincount((_text.unique(key) >> np.uint64(40)).astype(np.int64), minlength=n)


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    chosen: np.ndarray  # the buckets that count, ascending
    weights: np.ndarray  # (chosen, domains)
    bias: np.ndarray

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """((texts, domains) posteriors, words of each text)."""
        out, words = np.zeros((len(texts), len(self.domains))), np.zeros(len(texts), np.int64)
        place = np.full(BUCKETS, -1, np.int32)
        place[self.chosen] = np.arange(len(self.chosen))
        for lo, d, b, count in features(texts):
            n = len(count)
            at = place[b]
            d, at = d[at >= 0], at[at >= 0]
            z = np.stack([np.bincount(d, self.weights[at, j], n) for j in range(len(self.domains))], axis=1)
            out[lo : lo + n], words[lo : lo + n] = softmax(z + self.bias), count
        return out, words


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(docs: list[np.ndarray], label: np.ndarray, domains: tuple[str, ...], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> Classifier:
    """Softmax regression by Adagrad on whole passes, the classes weighted alike. docs: the distinct buckets of each document."""
    n, k = len(docs), len(domains)
    size = np.fromiter(map(len, docs), np.int64, n)
    b = np.concatenate(docs).astype(np.int64)
    row = np.repeat(np.arange(n), size)
    classes = np.bincount(label, minlength=k)
    # Chi-squared of each bucket's documents over the domains; ties go to the lower bucket.
    seen = np.bincount(b * k + label[row], minlength=BUCKETS * k).reshape(BUCKETS, k)
    total = seen.sum(axis=1)
    expected = np.maximum(total[:, None] * classes / n, 1e-12)
    chi = np.where(total >= LEAST, ((seen - expected) ** 2 / expected).sum(axis=1), 0)
    chosen = np.sort(np.lexsort((np.arange(BUCKETS), -chi))[: min(FEATURES, int((chi >= CHI2).sum()))])
    place = np.full(BUCKETS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    x[row[place[b] >= 0], place[b][place[b] >= 0]] = 1
    w, bias = np.zeros((len(chosen), k)), np.zeros(k)
    sum_w, sum_b = np.full(w.shape, 1e-6), np.full(k, 1e-6)
    goal = np.eye(k)[label]
    weight = (1 / classes)[label][:, None] / k
    for _ in range(epochs):
        g = (softmax(x @ w + bias) - goal) * weight
        grad = x.T @ g + decay * w
        sum_w += grad**2
        w -= rate * grad / np.sqrt(sum_w)
        sum_b += g.sum(axis=0) ** 2
        bias -= rate * g.sum(axis=0) / np.sqrt(sum_b)
    return Classifier(domains, chosen, w, bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Classifier | None:
    """Fit on at most ``sample`` labelled documents of each domain; None where no label is usable."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    known = labels.select(F.col("doc_id").alias("id"), domain.alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL").distinct()
    first = Window.partitionBy("domain").orderBy(F.xxhash64("id"))
    # At most 3 * sample rows, whatever the input.
    chosen = known.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("id", "domain")
    frequency = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "domain", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, d, b, count in features(_text.strings(batch.column(2))):
                cut = np.split(b.astype(np.int32), np.searchsorted(d, np.arange(1, len(count))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(count)), batch.column(1).slice(lo, len(count)), pa.array([c.tobytes() for c in cut], pa.binary())], names=["id", "domain", "f"])

    got = sorted(((r["id"], r["domain"], bytes(r["f"])) for r in rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("domain", T.IntegerType()), T.StructField("f", T.BinaryType())])).collect()))
    if not got:
        return None
    present = sorted({g[1] for g in got})
    label = np.array([present.index(g[1]) for g in got])
    model = fit([np.frombuffer(g[2], np.int32) for g in got], label, tuple(DOMAINS[d] for d in present))
    share = np.log([frequency[d] for d in present])
    return Classifier(model.domains, model.chosen, model.weights, model.bias + share - share.mean())


# --- rates
def replay(p: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    """The rates after the moves; a move is the momentum, then a number for each domain."""
    r = before = np.ones(len(p))
    for m in moves:
        r, before = np.maximum(0, r + m[0] * (r - before) - p @ m[1:]), r
    return r


def rate_column(domains: tuple[str, ...], moves: list[np.ndarray]):
    """replay as a column over the posterior columns p_domain."""
    if not moves:
        return F.lit(1.0)
    steps = F.array(*(F.array(*(F.lit(float(x)) for x in m)) for m in moves))
    change = lambda m: sum((m[i + 1] * F.col(f"p_{d}") for i, d in enumerate(domains)), F.lit(0.0))
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("before"))
    step = lambda s, m: F.struct(F.greatest(F.lit(0.0), s["r"] + m[0] * (s["r"] - s["before"]) - change(m)).alias("r"), s["r"].alias("before"))
    return F.aggregate(steps, start, step, lambda s: s["r"])


@dataclass(frozen=True)
class Fit:
    domains: tuple[str, ...]
    moves: list[np.ndarray]
    targets: np.ndarray
    totals: np.ndarray
    ended: str  # "met", "still" or "steps"


def fit_rates(members: DataFrame, domains: tuple[str, ...], weights: dict[str, float], budget: float | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> Fit:
    """Projected gradient; members has n_tokens and a posterior p_domain for each domain, and is read once a step."""
    w = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    k = len(domains)
    p = [F.col(f"p_{d}") for d in domains]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = members.agg(*(F.coalesce(F.sum(F.col("n_tokens") * p[i]), F.lit(0.0)) for i in range(k)), *(F.coalesce(F.sum(F.col("n_tokens") * p[i] * p[j]), F.lit(0.0)) for i, j in pairs)).first()
    totals = before = np.array(first[:k], float)
    if not totals.sum() or not w.sum():
        return Fit(domains, [], totals, totals, "met")
    w = w / w.sum()
    if budget is None:
        budget = HEADROOM * totals[0] / w[0] if domains[0] == DOMAINS[0] and w[0] > 0 else totals.sum()
    targets = w * budget
    gram = np.zeros((k, k))
    for x, (i, j) in zip(first[k:], pairs, strict=True):
        gram[i, j] = gram[j, i] = x
    inverse = np.linalg.pinv(gram, rcond=1e-10)
    moves: list[np.ndarray] = []
    t, ended = 1.0, "steps"
    for _ in range(steps + 1):
        if np.abs(totals - targets).max() <= tolerance * targets.max():
            ended = "met"
        if ended != "steps" or len(moves) == steps:
            break
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        momentum = (t - 1) / after
        # Totals are linear in the rates, so those of the extrapolated rates need no pass.
        ahead = totals + momentum * (totals - before)
        moves.append(np.concatenate([[momentum], inverse @ (ahead - targets)]))
        rated = members.select("n_tokens", *p, rate_column(domains, moves).alias("r"))
        new = np.array(rated.agg(*(F.sum(F.col("r") * F.col("n_tokens") * x) for x in p)).first()[:], float)
        still = np.abs(new - totals).max() <= 1e-3 * tolerance * targets.max()  # the targets cannot be met more closely
        t = 1.0 if np.linalg.norm(new - targets) > np.linalg.norm(totals - targets) else after
        before, totals = totals, new
        if still:
            ended = "still"
    return Fit(domains, moves, targets, totals, ended)


def posterior_table(df: DataFrame, model: Classifier, text: str = "text", doc_id: str = "doc_id", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, key, n_tokens, p_domain...) for each row; key is the text's hash."""
    kept = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(df[text]).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([kept.schema["doc_id"], kept.schema["key"], T.StructField("n_tokens", T.LongType()), *(T.StructField(f"p_{d}", T.DoubleType()) for d in model.domains)])
    shared = df.sparkSession.sparkContext.broadcast((model, bpe.ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier, table = shared.value
        tokens = bpe.TokenCounts(vocabulary, table)
        for batch in batches:
            texts = _text.strings(batch.column(2))
            n = tokens(texts)
            p, _ = classifier.posteriors(texts)
            del texts
            _text.release()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), *(pa.array(np.ascontiguousarray(c)) for c in p.T)], names=schema.names)

    return kept.mapInArrow(run, schema)


def copies(rate, doc_id: str = "doc_id", key: str = "key"):
    """floor(rate + u), u from the hash of doc_id and of the text."""
    u = F.xxhash64(F.lit("mix"), F.col(doc_id), F.col(key)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return F.floor(rate + u).cast("int")


def mix(df: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, budget: float | None = None, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, Classifier | None, Fit | None]:
    """((doc_id, n_tokens, p_domain..., rate, copies) of each row, the classifier, the fitted rates)."""
    model = train(df, labels, sample, doc_id, text)
    if model is None:
        rows = df.select(F.col(doc_id).alias("doc_id"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
        return rows, None, None
    members, _ = _shared.write_table(posterior_table(df, model, text, doc_id), "posteriors")
    fitted = fit_rates(members, model.domains, weights, budget)
    rate = rate_column(model.domains, fitted.moves)
    return members.withColumn("rate", rate).withColumn("copies", copies(F.col("rate"))).drop("key"), model, fitted


def resample(df: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, budget: float | None = None, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of df, each as often as its rate says. Posteriors are found again where the text is, which saves its shuffle."""
    _, model, fitted = mix(df, labels, weights, budget, sample, text, doc_id)
    if model is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast((model, fitted.moves))

    @F.arrow_udf(T.DoubleType())
    def rate(column: pa.Array) -> pa.Array:
        classifier, moves = shared.value
        out = pa.array(replay(classifier.posteriors(_text.strings(column))[0], moves))
        _text.release()
        return out

    n, copy, key = _shared.fresh(df.columns, "__copies", "__copy", "__key")
    # A deterministic function would be run once for the filter and once more for the copies.
    keyed = df.withColumn(key, F.xxhash64(df[text]))
    taken = keyed.withColumn(n, copies(rate.asNondeterministic()(df[text]), doc_id, key)).where(F.col(n) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]
