"""Language identification by hierarchical discrimination.

First a linear model predicts the family (Germanic, Romance, ...), then one-versus-one linear support
vector machines tell the languages of that family apart by votes. Features are hashed n-grams of the
lower-cased UTF-8 bytes of the whole text (1 to 4 bytes), as square roots of relative frequencies.
Languages of unlisted families form a family of their own each.

The models are fitted on the driver on a bounded sample: SAMPLE_ROWS labelled rows at most (an equal
share for each language, chosen by a hash of the id). The model has a fixed size for each pair.

Defined cases: a null text, or one without a letter, is `und` with score 0; null labels are not learned
from; without any label every text is `und`; one label only: that label with score 1; repeated rows are
predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_map, columns_of, id_bucket, read, unused

#: Families of language codes.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sk": "slavic",
}
#: Features: a power of two.
DIMENSIONS = 1 << 12
#: Labelled rows that the models are fitted on, at most, over all languages.
SAMPLE_ROWS = 1600
EPOCHS = 30
#: Texts whose features are multiplied with the machines at once.
PREDICT_ROWS = 128
UND = "und"


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; numerals such as a half or a Roman eight are none."""
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the relative frequencies of hashed byte n-grams; the length is 1."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    counts = np.zeros(DIMENSIONS, np.float32)
    code = np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(n)
        mixed = code * np.uint32(2654435761)
        counts += np.bincount(mixed >> np.uint32(32 - DIMENSIONS.bit_length() + 1), minlength=DIMENSIONS)
    return np.sqrt(counts / counts.sum())


def fit_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, seed: int = 0, epochs: int = EPOCHS, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine (hinge loss, averaged stochastic sub-gradient) on some rows of x.

    The last feature is the constant 1; y is +1 or -1 for each of the rows. Both classes weigh the same.
    The result is (weights, bias). Rows are taken from x a few at a time, never copied as a whole.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, steps = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for k in np.array_split(rng.permutation(len(y)), max(1, len(y) // 16)):
            steps += 1
            rate = 4.0 / (1 + 0.01 * steps)
            bad = k[y[k] * (x[rows[k]] @ w) < 1]
            w *= 1 - rate * penalty
            if len(bad):
                w += rate / len(k) * (weight[bad] * y[bad]) @ x[rows[bad]]
            if epoch >= epochs // 2:
                mean += (w - mean) / (steps - (epochs // 2) * max(1, len(y) // 16))
    return mean[:-1].astype(np.float32), float(mean[-1])


class Model:
    """Family machines (one against the rest) and, inside each family, one machine for each pair."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        """x: features and a last column of ones."""
        lang = np.asarray(labels, object)
        self.langs = sorted(set(labels))
        family = {c: FAMILIES.get(c, c) for c in self.langs}
        self.families = sorted(set(family.values()))
        self.members = {f: [c for c in self.langs if family[c] == f] for f in self.families}
        of = np.asarray([family[c] for c in labels], object)
        self.family_machines = [] if len(self.families) < 2 else [fit_svm(x, np.arange(len(x)), np.where(of == f, 1, -1)) for f in self.families]
        self.pairs = {}
        for members in self.members.values():
            for a, b in combinations(members, 2):
                k = np.flatnonzero((lang == a) | (lang == b))
                self.pairs[a, b] = fit_svm(x, k, np.where(lang[k] == a, 1, -1))

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """The language and a score from 0 to 1 for each row of features."""
        sigmoid = lambda z: 1 / (1 + np.exp(-2 * np.clip(z, -30, 30)))

        def machines(found: list[tuple[np.ndarray, float]]) -> np.ndarray:
            return sigmoid(x @ np.stack([w for w, _ in found], axis=1) + np.array([b for _, b in found]))

        family, score = np.zeros(len(x), np.int64), np.ones(len(x))
        if self.family_machines:
            p = machines(self.family_machines)
            family = p.argmax(axis=1)
            score = p.max(axis=1) / p.sum(axis=1)
        of = machines(list(self.pairs.values())) if self.pairs else np.zeros((len(x), 0))
        pairs = list(self.pairs)
        out = []
        for f, s, p in zip(family.tolist(), score.tolist(), of, strict=True):
            members = self.members[self.families[f]]
            votes = dict.fromkeys(members, 0.0)
            mine = [(a, b, float(q)) for (a, b), q in zip(pairs, p, strict=True) if a in votes]
            for a, b, q in mine:
                votes[a] += (q >= 0.5) + q / 1e3
                votes[b] += (q < 0.5) + (1 - q) / 1e3
            lang = max(members, key=lambda c: (votes[c], c))
            for a, b, q in mine:
                if lang in (a, b):
                    s = min(s, q if lang == a else 1 - q)
            out.append((lang, min(1.0, max(0.0, s))))
        return out


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on a bounded sample of (doc_id, text, lang) rows whose lang is not null and text has a letter."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = max(1, sample_rows // len(counts))
    # thin out by a hash first, to about twice the share; the window then sees a bounded number of rows
    span = 1 << 30
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (F.col("h") < int(span * min(1.0, (2 * share + 50) / n))))
    thin = rows.withColumn("h", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(span))).filter(keep)
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    sample = thin.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= share).select("lang", "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept = [(c, features(t).tobytes()) for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.string()), pa.array([v for _, v in kept], pa.binary())], ["lang", "v"])

    found = arrow_map(sample, run, "lang string, v binary").toArrow()
    labels, vectors = found.column("lang").to_pylist(), found.column("v").to_pylist()
    if not labels:
        return None
    order = sorted(range(len(labels)), key=lambda k: (labels[k], vectors[k]))  # whatever order the rows came in
    x = np.ones((len(order), DIMENSIONS + 1), np.float32)
    for row, k in zip(x, order, strict=True):
        row[:-1] = np.frombuffer(vectors[k], np.float32)
    return Model(x, [labels[k] for k in order])


def predict(docs: DataFrame, model: Model | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns `keep` of docs, in their order there, then the language and its score under `names`, from the text alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m, texts = shared.value, batch.column(0).to_pylist()
        out = [(UND, 0.0)] * len(texts)
        some = [k for k, t in enumerate(texts) if m is not None and has_letter(t)]
        for at in range(0, len(some), PREDICT_ROWS):
            rows = some[at : at + PREDICT_ROWS]
            for k, found in zip(rows, m.predict(np.stack([features(texts[k]) for k in rows])), strict=True):
                out[k] = found
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], [*keep, *names])

    kept = docs.select([c for name, c in zip(docs.columns, columns_of(docs), strict=True) if name in keep])
    keep = kept.columns
    rows = docs.select(F.col("text").alias(unused(docs, "text_read")), *columns_of(kept))
    return arrow_map(rows, run, StructType([*rows.schema.fields[1:], StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def held_out_rows() -> Column:
    return id_bucket("doc_id", 4) == 2


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out_rows().alias("held_out"))
    model = train(docs.filter(~F.col("held_out")))
    return predict(docs, model, ["doc_id", "held_out"]).withColumnRenamed("lang_score", "score")
