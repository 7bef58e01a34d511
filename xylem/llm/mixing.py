"""Mixing to target weights with soft membership.

A table of labels tells the domain of some documents.  A classifier learned from a bounded sample of them (`sample_rows`) gives every
document a posterior over the domains.  Nonnegative rates r, one per document, then solve

    least squares over domains k of (sum_d n_d p_dk r_d - target_k)^2 / have_k + small sum_d n_d (r_d - start)^2,   low <= r_d <= high

with n_d the document's words and have_k what the domain holds at rate 1; `small` only settles which of many solutions is taken, the one
nearest to the start.  Projected gradient: a step moves r_d by p_d . g, with g one number per domain.  The steps so far add up to mu and
the sum is projected, r_d = clip(start - p_d . mu), which loses nothing at the solution and keeps a rate a function of p_d and k numbers;
g is the gradient in the metric of the documents whose rate is not at a bound (k x k numbers), so that few steps are needed.
A step is one distributed sum over a table of (n, p) rows for several step lengths at once, of which the best by the dual objective is taken.
It ends when the gradient is within `tolerance` of the targets and raises if `steps` are not enough.  Targets that no rates in the bounds
reach end at the least squares; `missed` of the result tells by how much.  A document of rate r stands
floor(r + u) times, u a uniform hash of its key.

Nulls: a null text is empty; its posterior is the prior.  Labels of unknown ids, with null fields or repeated, are ignored
where they name no domain, else counted each.  Rows of equal id and text get equal rates and copies.  Without labels all domains are
equally likely.  Empty tables give empty ones.  Other columns are kept by `apply_mix`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, hashed_words, mapped, mix, row_key, settle, small_batches

SAMPLE_ROWS, FEATURES_LOG, STEPS, SMALL, TOLERANCE = 4000, 16, 60, 1e-5, 1e-3
DOMAINS = ("good", "poor", "toxic")
WEIGHTS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}
_SHAPE = 4


def label_domain():
    """Domain number of a row of labels: toxic, else good or poor by quality."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)


def features(column):
    """Yields for ranges of rows: first row, row of each feature, feature, words of each row, shape numbers of each row."""
    for i, rows, h, starts, ends, data in hashed_words(column, lower=True):
        k = len(rows) - 1
        row = np.repeat(np.arange(k), np.diff(rows))
        pair = np.unique((row.astype(np.uint64) << _U(FEATURES_LOG)) | (h >> _U(64 - FEATURES_LOG)))
        n = np.diff(rows)
        distinct = np.bincount((pair >> _U(FEATURES_LOG)).astype(np.int64), minlength=k)
        words = np.maximum(n, 1)
        upper = np.bincount(row, (data[starts] >= 65) & (data[starts] <= 90), k) if len(row) else np.zeros(k)
        short = np.bincount(row, ends - starts <= 2, k) if len(row) else np.zeros(k)
        shape = np.stack([distinct / words, upper / words, short / words, np.minimum(np.log1p(n), 10) / 10], 1)
        yield i, (pair >> _U(FEATURES_LOG)).astype(np.int64), (pair & _U((1 << FEATURES_LOG) - 1)).astype(np.int64), n, shape


@dataclass
class Classifier:
    weight: np.ndarray  # [features, domains]
    shape: np.ndarray  # [shape numbers, domains]
    bias: np.ndarray
    scale: np.ndarray = field(default_factory=lambda: np.ones(_SHAPE))

    def posteriors(self, row, feature, n, shape) -> np.ndarray:
        k = len(n)
        z = self.bias + (shape / self.scale) @ self.shape
        size = np.sqrt(np.maximum(np.bincount(row, minlength=k), 1))[:, None]
        for d in range(z.shape[1]):
            z[:, d] += np.bincount(row, self.weight[feature, d], k) / size[:, 0]
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)


def learn(texts: list[str], domains: np.ndarray, k: int = len(DOMAINS), rounds: int = 150, decay: float = 1e-5) -> Classifier:
    """Multinomial logistic regression on word presence (scaled by a text's root of different words) and shape, by Adam."""
    size = 1 << FEATURES_LOG
    model = Classifier(np.zeros((size, k)), np.zeros((_SHAPE, k)), np.zeros(k))
    if not texts:
        return model
    row, feature, shape, first = [], [], [], 0
    for i, r, f, n, s in features(pa.array(texts, pa.string())):
        row.append(r + i)
        feature.append(f)
        shape.append(s)
    row, feature, shape = np.concatenate(row), np.concatenate(feature), np.concatenate(shape)
    common = np.bincount(feature, minlength=size) >= 3
    m = len(texts)
    root = np.sqrt(np.maximum(np.bincount(row, minlength=m), 1))
    keep = common[feature]
    row, feature = row[keep], feature[keep]
    value = 1 / root[row]
    model.scale = np.maximum(shape.std(0), 1e-6)
    x = shape / model.scale
    y = np.eye(k)[domains]
    params = [model.weight, model.shape, model.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, rounds + 1):
        z = model.bias + x @ model.shape
        for d in range(k):
            z[:, d] += np.bincount(row, model.weight[feature, d] * value, m)
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = (p - y) / m
        grads = [np.stack([np.bincount(feature, g[row, d] * value, size) for d in range(k)], 1) + decay * model.weight, x.T @ g, g.sum(0)]
        for q, gr, (a, b) in zip(params, grads, moments, strict=True):
            a *= 0.9
            a += 0.1 * gr
            b *= 0.999
            b += 0.001 * gr * gr
            q -= 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return model


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    known = labels.select(F.col("doc_id").alias("_id"), label_domain().alias("domain")).where(F.col("domain").isNotNull() & F.col("_id").isNotNull())
    total = known.count()
    drawn = known.where(F.pmod(F.xxhash64("_id", F.lit(31)), F.lit(1 << 30)) < int(sample_rows / max(total, sample_rows) * (1 << 30)))
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(drawn), "_id").orderBy(F.xxhash64("_id", "t"), "domain").limit(2 * sample_rows).collect()
    return learn([r["t"] for r in found], np.array([r["domain"] for r in found], np.int64))


@dataclass
class Mix:
    classifier: Classifier | None
    mu: np.ndarray  # the steps' sum, one number per domain
    low: float
    high: float
    start: float = 1.0
    missed: np.ndarray | None = None  # (delivered - target) / target of each domain

    def rates(self, p: np.ndarray) -> np.ndarray:
        return np.clip(self.start - p @ self.mu, self.low, self.high)


def posterior_rows(docs: DataFrame, classifier: Classifier, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, key, n, p)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, row, feature, n, shape in features(b.column(2)):
                p = sent.value.posteriors(row, feature, n, shape)
                k = len(n)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * p.shape[1]), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0)[i : i + k], b.column(1)[i : i + k], pa.array(n), listed], names=["id", "key", "n", "p"])

    return docs.select(F.col(id_col), row_key(id_col, text_col), F.col(text_col)).transform(mapped, run, f"id {kind}, key long, n long, p array<double>")


def _matrix(column, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _sums(n: np.ndarray, p: np.ndarray, mix: Mix) -> np.ndarray:
    """Of rows (n, p): the dual objective without its target, words by domain, their change with mu (k x k)."""
    z = p @ mix.mu
    first, last = mix.start - mix.high, mix.start - mix.low  # below the first the rate is high, above the last low
    inner = np.clip(z, first, last)
    area = mix.start * inner - inner**2 / 2 + np.where(z < first, mix.high, mix.low) * (z - inner)
    free = n * ((z > first) & (z < last))
    return np.concatenate([[-(n @ area)], (n * mix.rates(p)) @ p, ((p * free[:, None]).T @ p).reshape(-1)])


def fit_rates(rows: DataFrame, targets_of, classifier: Classifier, k: int, low: float, high: float, steps: int = STEPS, small: float = SMALL, tolerance: float = TOLERANCE) -> Mix:
    """Projected gradient on rows (n, p); targets_of(have) gives the target words of each domain."""
    start = min(max(1.0, low), high)

    def sums(places: list[np.ndarray]) -> np.ndarray:
        each = [Mix(None, mu, low, high, start) for mu in places]

        def run(batches):
            total = np.zeros((len(each), 1 + k + k * k))
            have = np.zeros(k)
            for b in batches:
                n, p = b.column(0).to_numpy().astype(float), _matrix(b.column(1), k)
                have += n @ p
                for t, m in zip(total, each, strict=True):
                    t += _sums(n, p, m)
            flat = np.concatenate([have, total.reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "x"])

        out = np.zeros(k + len(each) * (1 + k + k * k))
        for r in rows.select("n", "p").transform(mapped, run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r["i"]] = r["x"]
        return out

    first = sums([np.zeros(k)])
    have = np.maximum(first[:k], 1e-9)
    targets = np.asarray(targets_of(have), float)
    mu, now = np.zeros(k), first[k:]
    dual = lambda mu, t: t[0] + targets @ mu + small / 2 * have @ mu**2
    for _ in range(steps):
        words, metric = now[1 : k + 1], now[k + 1 :].reshape(k, k)
        gradient = words - targets - small * have * mu
        if (np.abs(gradient) <= tolerance * np.maximum(targets, 1e-6 * have.sum())).all():
            return Mix(classifier, mu, low, high, start, (words - targets) / np.maximum(targets, 1e-9))
        g = np.linalg.solve(metric + np.diag(small * have), gradient)
        lengths = [mu + g * 4.0**-i for i in range(8)]
        found = sums(lengths)[k:].reshape(len(lengths), -1)
        best = min(range(len(lengths)), key=lambda i: dual(lengths[i], found[i]))
        mu, now = lengths[best], found[best]
    raise RuntimeError(f"rates have not settled after {steps} steps")


def weigh(weights: dict[str, float], total: str | float = "keep"):
    """Target words of each domain.  total: `keep` (as many words as there are), or `first`: so that the first domain's target lies 2 % above
    what it holds, and rates up to 1 keep it whole."""
    w = np.array([weights[d] for d in DOMAINS]) / sum(weights.values())

    def targets(have: np.ndarray) -> np.ndarray:
        return w * (have.sum() if total == "keep" else 1.02 * have[0] / max(w[0], 1e-9) if total == "first" else float(total))

    return targets


def fit_mix(docs: DataFrame, labels: DataFrame, weights=None, total="keep", low=0.0, high=4.0, id_col="doc_id", text_col="text", sample_rows=SAMPLE_ROWS) -> tuple[Mix, DataFrame]:
    """The mix, and the rows (id, key, n, p) that it was fitted on."""
    classifier = fit_classifier(docs, labels, id_col, text_col, sample_rows)
    rows = settle(posterior_rows(docs, classifier, id_col, text_col), "posteriors")
    return fit_rates(rows, weigh(weights or WEIGHTS, total), classifier, len(DOMAINS), low, high), rows


def _copies(rates: np.ndarray, keys: np.ndarray) -> np.ndarray:
    u = (mix(keys.view(np.uint64) ^ _U(0x5DEECE66D)) >> _U(11)).astype(float) / (1 << 53)
    return np.floor(rates + u).astype(np.int64)


def rate_rows(rows: DataFrame, model: Mix) -> DataFrame:
    """Rows (id, n, p, rate, copies)."""
    k = len(DOMAINS)
    light = Mix(None, model.mu, model.low, model.high, model.start)

    def run(batches):
        for b in batches:
            r = light.rates(_matrix(b.column(3), k))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(r), pa.array(_copies(r, b.column(1).to_numpy()))], names=["id", "n", "p", "rate", "copies"])

    return rows.select("id", "key", "n", "p").transform(mapped, run, f"id {rows.schema['id'].dataType.simpleString()}, n long, p array<double>, rate double, copies long")


def apply_mix(docs: DataFrame, model: Mix, id_col="doc_id", text_col="text") -> DataFrame:
    """Each row of docs as often as its rate says, with all its columns; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    n, at = len(docs.columns), docs.columns.index(text_col)
    names = [f"c{i}" for i in range(n)]
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def run(batches):
        m = sent.value
        for b in batches:
            keys, times = b.column(n).to_numpy(), np.zeros(b.num_rows, np.int64)
            for i, row, feature, words, shape in features(b.column(at)):
                k = len(words)
                times[i : i + k] = _copies(m.rates(m.classifier.posteriors(row, feature, words, shape)), keys[i : i + k])
            pick = pa.array(np.repeat(np.arange(b.num_rows), times))
            yield pa.RecordBatch.from_arrays([b.column(i).take(pick) for i in range(n)], names=names)

    out = docs.select(*[F.col(c).alias(x) for c, x in zip(docs.columns, names, strict=True)], row_key(id_col, text_col).alias("key")).transform(mapped, run, schema)
    return out.toDF(*docs.columns)


def op5_soft_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, rows = fit_mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = rate_rows(rows, model)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), *[F.get("p", i).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "copies")


def stage_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to the weights; rates go up to 1, and the good domain's target keeps it whole."""
    model, _ = fit_mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), total="first", high=1.0)
    return apply_mix(docs, model)
