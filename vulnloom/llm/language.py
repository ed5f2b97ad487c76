"""Language identification by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier per bit tells the languages whose bit is 1 from the others.
A text's bits are decoded by loss: the codeword whose expected bits cost least, each bit weighted by how well its classifier
parts the two groups.  Where the second-best codeword is nearly as good, the text is flagged as ambiguous.

Training is one pass over all labelled rows: tasks count hashed byte trigrams per language and one small group-by adds
the counts up (languages x 8,192 numbers), from which the weights of all bits follow.  Prediction reads the text alone.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows without a label do not train; if no
row trains, all are ``und``; one learned language is predicted for every text with a letter; rows that repeat an id are
predicted each by its own text, rows without an id too; an empty table gives an empty result; other columns pass through, but columns of the
added names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnloom.llm import textkit

BUCKETS = 1 << 13
#: Rows of trigram counts at a time: 64 kB each, so that a batch of very short texts does not fill the memory.
ROWS = 256

_FOLD = textkit._LOWER.copy()
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass(frozen=True)
class Model:
    """``languages``; ``code`` (languages x bits, +-1); per bit a weight per trigram bucket, an offset and a trust."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    trust: np.ndarray


def codewords(n: int) -> np.ndarray:
    """n rows of +-1 bits: exhaustive to seven languages, beyond that a drawn code of 12 bits a doubling or more."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = np.arange(1, 2 ** (n - 1))
        rows = (columns[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.vstack([np.zeros((1, len(columns))), rows]) * 2 - 1
    # Any two words differ in a quarter of their bits at least: codes are drawn, and grow, until that holds.
    bits, seed = 12 * int(np.ceil(np.log2(n))), 0
    while True:
        seed += 1
        drawn = textkit.mix(np.arange(n * bits, dtype=np.uint64) + np.uint64(seed << 32)) >> np.uint64(40)
        code = (drawn & np.uint64(1)).reshape(n, bits).astype(float) * 2 - 1
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2
        if (apart[~np.eye(n, dtype=bool)] * 4 >= bits).all():
            return code
        bits += seed % 20 == 0


def _grams(block: textkit.Block) -> np.ndarray:
    """Trigram counts of a block's rows (rows x BUCKETS); runs of anything but letters are one space."""
    data = _FOLD[block.data]
    rows = np.repeat(np.arange(len(block)), np.diff(block.offsets))
    again = np.zeros(len(data), bool)
    again[1:] = (data[1:] == 32) & (data[:-1] == 32)
    data, rows = data[~again].astype(np.uint32), rows[~again]
    if len(data) < 3:
        return np.zeros((len(block), BUCKETS))
    gram = ((data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
    bucket = (gram >> np.uint32(32 - 13)).astype(np.int64)
    inside = rows[:-2] == rows[2:]
    return np.bincount((rows[:-2] * BUCKETS + bucket)[inside], minlength=len(block) * BUCKETS).reshape(len(block), BUCKETS)


def train(labelled: DataFrame) -> Model:
    """A model from (text, lang); rows with a null in either do not count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for block in textkit.blocks(batch.column(0), rows=ROWS):
                langs = np.array(batch.column(1).slice(block.first, len(block)).to_pylist(), object)
                grams = _grams(block)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + grams[langs == lang].sum(axis=0)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", F.col("lang").cast("string"))
    counts = rows.mapInArrow(work, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(set(counts["lang"])))
    table = np.zeros((len(languages), BUCKETS))
    table[counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"]
    return fit(languages, table)


def fit(languages: tuple[str, ...], table: np.ndarray) -> Model:
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, code.shape[1])), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    share = (table + 0.5) / (table + 0.5).sum(axis=1, keepdims=True)
    weights, offset, trust = [], [], []
    for bit in code.T:
        one, zero = share[bit > 0].mean(axis=0), share[bit < 0].mean(axis=0)
        weight = np.log(one) - np.log(zero)
        expected = share @ weight
        high, low = expected[bit > 0].min(), expected[bit < 0].max()
        gap = max(high - low, 1e-3)
        weights.append(weight * 2 / gap)
        offset.append(-(high + low) / gap)
        trust.append(gap)
    trust = np.array(trust) / np.sum(trust)
    return Model(languages, code, np.array(weights, np.float32).T, np.array(offset), trust)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of ``margins`` (rows x bits): the nearest codeword, a score, and whether another is nearly as near."""
    losses = np.logaddexp(0, -2 * margins[:, None, :] * model.code[None]) @ model.trust
    best = losses.argmin(axis=1)
    shares = np.exp(-4 * (losses - losses.min(axis=1, keepdims=True)))
    score = 1 / shares.sum(axis=1)
    return best, score, score < 0.6


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous, from ``text`` alone."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spot = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            for block in textkit.blocks(batch.column(spot), rows=ROWS):
                n = len(block)
                sums = np.concatenate([[0], np.cumsum(_LETTER[block.data])])
                letter = sums[block.offsets[1:]] > sums[block.offsets[:-1]]
                wide = np.concatenate([[0], np.cumsum(block.data >= 128)])
                for i in np.flatnonzero(~letter & (wide[block.offsets[1:]] > wide[block.offsets[:-1]])):
                    letter[i] = any(c.isalpha() for c in block.text(i))
                best, score, unsure = np.zeros(n, int), np.ones(n), np.zeros(n, bool)
                if len(model.languages) > 1:
                    grams = _grams(block)
                    margins = grams.astype(np.float32) @ model.weights / np.maximum(grams.sum(axis=1), 1)[:, None] + model.offset
                    best, score, unsure = decode(model, margins)
                letter &= len(model.languages) > 0
                best, score = np.where(letter, best, len(model.languages)), np.where(letter, score, 0.0)
                own = batch.slice(block.first, n)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(unsure & letter)], names=[*own.schema.names, "lang_pred", "score", "ambiguous"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(work, schema)
