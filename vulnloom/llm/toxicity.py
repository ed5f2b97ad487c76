"""Toxicity by compression distance.

Two zstandard dictionaries are trained separately, one on windows of toxic text and one on windows of ordinary text.  A window
is compressed with either; how much shorter the toxic one makes it is its evidence.  (A second measure puts the toxic
dictionary before the ordinary one and compares with the ordinary one alone: the same ordinary content is then behind both, so
chance matches of everyday words cancel out.)  A document's savings - mean, largest, share of telling windows - are turned into
a score by a calibration whose 0.5 is the threshold of best F1 on labelled documents the dictionaries have not seen, false
alarms weighed by the share of toxic documents among all labels.

Training takes a bounded sample, the ``per_class`` documents of each label with the smallest hash of their id, with their whole
texts; half of it trains dictionaries (one task a label), half calibrates.  Scoring is one narrow pass over whole texts.

Defined cases: a null or empty text has no window and gets the score of no evidence; documents without labels do not
train; if either label is missing, every score is the share of toxic labels (0 without labels); of windows too few to train
on, zstandard refuses, and the windows themselves are the dictionary; rows that repeat an id (or have none) are scored each; an
empty table gives an empty result; other columns pass through, but score and predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = 9


@dataclass(frozen=True)
class ToxicityOptions:
    per_class: int = 3000
    words: int = 10
    ordinary_size: int = 32768
    toxic_size: int = 2048


@dataclass(frozen=True)
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    constant: float = 0.0
    centre: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))


def windows(text: str | None, words: int) -> list[bytes]:
    """The lower-cased text in runs of ``words`` words."""
    split = (text or "").lower().split()
    return [f" {' '.join(split[i : i + words])} ".encode("utf-8", "replace") for i in range(0, len(split), words)]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's content; of few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=12, d=6, level=5).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        5, min_match=4, strategy=zstandard.STRATEGY_LAZY, write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    made.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=how)


class Evidence:
    """Savings of a text's windows as features."""

    def __init__(self, ordinary: bytes, toxic: bytes, words: int):
        self.words = words
        self.plain, self.toxic, self.joint = compressor(ordinary), compressor(toxic), compressor(toxic + ordinary)

    def features(self, text: str | None) -> list[float]:
        sizes = np.array([(len(self.plain.compress(w)), len(self.toxic.compress(w)), len(self.joint.compress(w))) for w in windows(text, self.words)], float)
        if not len(sizes):
            return [0.0] * FEATURES
        apart, saved = sizes[:, 0] - sizes[:, 1], sizes[:, 0] - sizes[:, 2]
        top = np.sort(saved)[-3:]
        return [
            apart.mean(), apart.max(), np.sort(apart)[-3:].mean(),
            saved.mean(), saved.max(), top.mean(), np.maximum(saved - 2, 0).mean(), (saved >= 3).mean(), np.log1p((saved >= 3).sum()),
        ]


def _known(labels: DataFrame) -> DataFrame:
    """(_id, toxic 0 or 1) of the labels."""
    return labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()


def _sample(docs: DataFrame, known: DataFrame, options: ToxicityOptions) -> DataFrame:
    """(toxic, dictionary, text) of the bounded sample; the ids, not the documents, are ranked and sent out."""
    picked = None
    for label in (0, 1):
        one = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(options.per_class)
        picked = one if picked is None else picked.union(one)
    half = (F.xxhash64("_id", F.lit("half")) % 2 == 0).alias("dictionary")
    met = docs.select("doc_id", "text").join(F.broadcast(picked.select("_id", "toxic", half)), F.col("doc_id") == F.col("_id"))
    return met.select("toxic", "dictionary", "text")


def train(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> Model:
    """A model from labelled documents: ``labels`` (doc_id, toxic), ``docs`` (doc_id, text)."""
    known = _known(labels)
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    sample = _sample(docs, known, options)
    words = options.words

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(toxic, w) for toxic, text in zip(frame["toxic"], frame["text"], strict=True) for w in set(windows(text, words))]
            yield pd.DataFrame(rows, columns=["toxic", "w"])

    def make(frame: pd.DataFrame) -> pd.DataFrame:
        own = sorted(frame["w"])
        order = np.random.default_rng(7).permutation(len(own))
        toxic = int(frame["toxic"].iloc[0])
        return pd.DataFrame({"toxic": [toxic], "content": [dictionary([own[i] for i in order], options.toxic_size if toxic else options.ordinary_size)]})

    cuts = sample.filter("dictionary").select("toxic", "text").mapInPandas(cut, "toxic int, w binary").distinct()
    made = {r["toxic"]: bytes(r["content"]) for r in cuts.groupBy("toxic").applyInPandas(make, "toxic int, content binary").collect()}
    rest = sample.filter("NOT dictionary").select("toxic", "text")
    if len(made) < 2:
        return Model(constant=float(share))
    ordinary, toxic = made[0], made[1]

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = Evidence(ordinary, toxic, words)
        for frame in frames:
            rows = [evidence.features(t) for t in frame["text"]]
            out = pd.DataFrame(np.array(rows).reshape(-1, FEATURES), columns=[f"f{k}" for k in range(FEATURES)])
            yield out.assign(toxic=frame["toxic"].to_numpy())

    schema = ", ".join(f"f{k} double" for k in range(FEATURES)) + ", toxic int"
    measured = rest.mapInPandas(measure, schema).toPandas()
    return calibrate(ordinary, toxic, measured[[f"f{k}" for k in range(FEATURES)]].to_numpy(), measured["toxic"].to_numpy(), float(share))


def calibrate(ordinary: bytes, toxic: bytes, x: np.ndarray, y: np.ndarray, share: float) -> Model:
    """Ridge logistic regression by Newton steps, shifted so that 0.5 is the threshold of best F1 where ``share`` is toxic."""
    if len(set(y.tolist())) < 2:
        return Model(constant=share)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.eye(len(w)) * 1.0
    ridge[-1, -1] = 0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), a.T @ (y - p) - ridge @ w)
    order = np.argsort(-(a @ w), kind="stable")
    hits = np.cumsum(y[order])
    # The sample has its own share of toxic documents: false alarms weigh as they would among all labels.
    alarms = np.cumsum(1 - y[order]) * (1 - share) / share * y.sum() / (1 - y).sum()
    f1 = 2 * hits / (hits + alarms + y.sum())
    k = int(f1.argmax())
    z = (a @ w)[order]
    w[-1] -= (z[k] + z[min(k + 1, len(z) - 1)]) / 2
    return Model(ordinary, toxic, 0.0, centre, scale, w)


def score(docs: DataFrame, model: Model, options: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on), from ``text`` alone."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spot = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        evidence = Evidence(model.ordinary, model.toxic, options.words) if model.ordinary else None
        for batch in batches:
            if evidence is None:
                p = np.full(batch.num_rows, model.constant)
            else:
                x = np.array([evidence.features(t.as_py()) for t in batch.column(spot)]).reshape(-1, FEATURES)
                p = 1 / (1 + np.exp(-np.clip((x - model.centre) / model.scale @ model.weights[:-1] + model.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, *added]))
