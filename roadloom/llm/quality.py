"""Quality classifier: Bradley-Terry scores learned from preference pairs.

Every labelled document of quality 1 is preferred to every one of quality 0. The
Bradley-Terry model puts P(a preferred to b) = sigmoid(u(a) - u(b)) with
u(x) = w . f(x), so learning w is logistic regression without intercept on feature
differences. A threshold on u is then a quantile of the training scores, and the
reported score is sigmoid((u - threshold) / spread), at least 0.5 where u reaches the threshold.

Features are of the whole text: shares of character kinds, word shapes, repetition
of words, pairs and lines, and lengths. Id, source, language and labels are none.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import id_remainder, landed, map_text, unused

#: Features of a text, in order.
FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "space", "newline", "point_comma", "other_punct", "symbol", "pipe",
    "bang", "high_byte", "word_length", "word_spread", "distinct_words", "top_word", "distinct_pairs", "repeat_next",
    "distinct_lines", "lines_per_word", "upper_words", "capital_words", "marked_words", "short_words", "long_words",
    "byte_entropy", "distinct_halves", "byte_runs", "empty",
)

#: Byte kinds, one row of the counting matrix each.
_KINDS = (
    range(65, 91), range(48, 58), b" \t\r", b"\n", b".,;:'-", b"()\"/?", b"#$%&*@^~=+_<>[]{}\\`", b"|", b"!", range(128, 256),
)
_MATRIX = np.zeros((256, len(_KINDS)))
for _at, _kind in enumerate(_KINDS):
    _MATRIX[list(_kind), _at] = 1
_MARKED = re.compile(r"[^\w\s.,;:'()\"?-][^\w\s]*(?:\s|$)")


def features(text: str) -> np.ndarray:
    """The feature vector of one whole text; the empty text has only its own mark."""
    out = np.zeros(len(FEATURES), np.float32)
    words = text.split()
    if not words:
        out[-1] = 1
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, m = len(raw), len(words)
    counts = np.bincount(raw, minlength=256)
    shares = counts @ _MATRIX / n
    lengths = np.fromiter(map(len, words), np.int64, m)
    tally = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    p = counts[counts > 0] / n
    half = len(set(words[: m // 2]) & set(words[m // 2 :]))
    out[:] = (
        np.log1p(n), np.log1p(m), *shares, lengths.mean(), lengths.std(), len(tally) / m, max(tally.values()) / m,
        pairs / max(1, m - 1), same / m, len(set(lines)) / max(1, len(lines)), len(lines) / m,
        sum(map(str.isupper, words)) / m, sum(map(str.istitle, words)) / m, len(_MARKED.findall(text)) / m,
        (lengths <= 2).mean(), (lengths > 14).mean(), -(p * np.log2(p)).sum(), half / max(1, m // 2),
        float((raw[1:] == raw[:-1]).mean()) if n > 1 else 0.0, 0,
    )
    return out


@dataclass
class QualityModel:
    """Weights over standardised features, and the threshold of the utility."""

    weights: list[float]
    center: list[float]
    scale: list[float]
    threshold: float = 0.0
    spread: float = 1.0
    reject_share: float = 0.0
    pairs: int = 0
    knots: list[list[float]] = field(default_factory=list)

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and their soft steps at the knots: a monotone-per-feature basis."""
        z = np.clip((x - np.array(self.center)) / np.array(self.scale), -6, 6)
        steps = [np.tanh(2 * (z - k)) for k in np.array(self.knots)] if self.knots else []
        return np.concatenate([z, *steps], axis=1)

    def utility(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry utility of each row of features."""
        return self.expand(x) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Utilities mapped to 0..1 about the threshold."""
        return 1 / (1 + np.exp(-np.clip((self.utility(x) - self.threshold) / self.spread, -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 200_000, rounds: int = 200, l2: float = 1e-4, seed: int = 7) -> QualityModel:
    """Learns from feature rows and 0/1 labels; with one class only, every score is 0.5.

    ``pairs`` bounds how many (1, 0) pairs enter; their order is drawn with ``seed``.
    """
    x, y = np.asarray(x, float).reshape(-1, len(FEATURES)), np.asarray(y)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    center, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    scale = np.where(scale < 1e-9, 1, scale)
    knots = [[k] * x.shape[1] for k in (-2.0, -1.0, 0.0, 1.0, 2.0)]
    model = QualityModel([0.0] * (x.shape[1] * 6), center.tolist(), scale.tolist(), knots=knots)
    if not len(good) or not len(bad):
        return model
    rng = np.random.default_rng(seed)
    z = model.expand(x)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    w, m, v, block, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1]), 4096, 0
    for _ in range(max(1, rounds * block // pairs + 1)):
        for at in range(0, pairs, block):
            d = z[a[at : at + block]] - z[b[at : at + block]]
            grad = -(d / (1 + np.exp(np.clip(d @ w, -40, 40)))[:, None]).mean(0) + l2 * w
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.weights, model.pairs = w.tolist(), pairs
    u = model.utility(x)
    model.threshold, model.reject_share = quantile_threshold(u, y)
    model.spread = float(max(1e-6, np.std(u) / 2))
    return model


def quantile_threshold(u: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The quantile of the scores whose rejection of all below it errs least on the labels, and its share.

    The cut lies midway between neighbouring scores; of equal errors, the one nearest the share of label 0.
    """
    order = np.argsort(u, kind="stable")
    s, good = u[order], (y[order] == 1).astype(int)
    errors = np.concatenate([[0], np.cumsum(good)]) + (len(y) - good.sum() - np.concatenate([[0], np.cumsum(1 - good)]))
    cuts = np.concatenate([[True], s[1:] > s[:-1], [True]])  # equal scores stay together
    ks = np.flatnonzero(cuts)
    k = ks[np.lexsort((np.abs(ks - (len(y) - good.sum())), errors[ks]))[0]]
    cut = s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2
    return float(cut), float(k / len(y))


def featured(docs: DataFrame, text: str = "text", carry: list[str] | None = None, name: str = "features") -> DataFrame:
    """``docs`` (or its columns ``carry``) with the float array ``name``: the features of each whole text."""

    def rows(texts: list[str]) -> list[pa.Array]:
        flat = np.concatenate([features(t) for t in texts])
        return [pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32), pa.array(flat))]

    return map_text(docs, text, rows, [T.StructField(name, T.ArrayType(T.FloatType()))], carry)


def fit(feats: DataFrame, labels: DataFrame, max_labelled: int = 30_000, **options) -> QualityModel:
    """Learns from rows (doc_id, features) and labels (doc_id, quality).

    Of the labelled ids, about ``max_labelled`` are used: those whose hash is in the lowest share of that size.
    An id with several labels counts once, by their mean (0.5 and up: 1), and one with several rows by the
    least of their features; null labels and ids don't count. Only that bounded sample comes to the driver.
    """
    marks = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("quality"))
    )
    n = marks.count()
    share = 1 << 30 if n <= max_labelled else int((1 << 30) * max_labelled / n)
    some = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)  # about max_labelled rows, whatever n
    chosen = feats.select("doc_id", "features").join(some, "doc_id").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.min("features").alias("features"),
    )
    rows = chosen.toArrow().to_pylist()  # one row an id
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["features"] for r in rows], float) if rows else np.zeros((0, len(FEATURES)))
    return fit_pairs(x, np.array([r["quality"] for r in rows], int), **options)


def scored(feats: DataFrame, model: QualityModel, features: str = "features", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``feats`` with score (0..1) and predicted (1 if score >= 0.5) instead of its features; these win over columns of their names."""
    kept = [c for c in feats.columns if c not in (features, score, predicted)]
    packed = feats.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{features}`"))
    schema = T.StructType([packed.schema["row"], T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = model.score(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1).astype(float))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["row", score, predicted])

    out = packed.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], score, predicted)


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Learns only from rows whose crc32(doc_id as text) mod ``modulus`` isn't ``held``. Null and
    empty texts get the score of the empty text; whole texts are read, however long; equal texts get equal scores;
    repeated rows are scored each; other columns of ``docs`` are ignored, whatever their names; without labels of both
    kinds all scores are 0.5; an empty table gives an empty result.
    """
    feats = landed(featured(docs, carry=["doc_id"]).withColumn("held_out", id_remainder(F.col("doc_id"), modulus) == held), "quality")
    model = fit(feats.where(~F.col("held_out")), labels, **options)
    return scored(feats, model).select("doc_id", "held_out", "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns kept, whatever their names.

    Features are computed once and land beside the rows. Null and empty texts are judged as the empty text; whole
    texts are read, however long; repeated rows stay or go together; without labels of both kinds every row
    stays (each score is 0.5); an empty table gives an empty result.
    """
    names = [unused(n, *docs.columns) for n in ("features", "score", "predicted")]
    feats = landed(featured(docs, name=names[0]), "quality")
    known = feats.where(id_remainder(F.col("doc_id"), modulus) != held).select("doc_id", F.col(names[0]).alias("features"))
    model = fit(known, labels, **options)
    return scored(feats, model, *names).where(F.col(names[2]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
