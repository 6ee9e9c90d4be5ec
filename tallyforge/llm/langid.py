"""Language identification with error-correcting output codes.

Each language gets a codeword of bits; one binary classifier per bit, on hashed character 2- and 3-grams of the
lower-cased letters, predicts that bit. Decoding weighs the loss of every bit by how well its classifier does on
the training texts and takes the language whose codeword loses least; the losses also give a score from 0 to 1.
A text is ambiguous when the runner-up comes close.

Training: at most SAMPLE documents of each language, and MOST / languages where there are more than MOST / SAMPLE
languages (those with the smallest hash of doc_id), whole texts. The bounds are the parameters `sample` and `most`;
nothing else is bounded. Rows that cannot be among them, by their hash and the language's count, are left out before
the languages are grouped, so that a language of a third of all rows makes no large group. The features of the
sample, some 8192 small numbers for each document, come to the driver, where each bit's ridge regression is solved in
closed form on a matrix of MOST x MOST at most. The model, bits x 8192 numbers, goes out with the function. Prediction
sees the text alone.

Cases: null texts and texts without a letter are `und` with score 0. Empty training data: all are `und`. One
language only: all texts with a letter get it, score 1. A null doc_id is never held out and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, releasing, small_batches

DIM = 1 << 13
SAMPLE, MOST = 400, 4800
RIDGE = 0.05
#: Columns of features that the solver widens at a time.
BLOCK = 512
#: The runner-up's score over the best one's from which a text counts as ambiguous.
CLOSE = 0.8
_LETTER = regex.compile(r"\p{L}")
_ASCII = np.array([chr(c).isalpha() for c in range(128)])


def features(text: str) -> np.ndarray:
    """Square roots of the shares of the hashed 2- and 3-grams of letters; other characters count as one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(np.where(c < 128, _ASCII[np.minimum(c, 127)], c > 0xBF), c, np.uint32(32))
    c = np.concatenate((np.array([32], np.uint32), c, np.array([32], np.uint32)))
    a = c * np.uint32(0x9E3779B1)
    two = a[:-1] + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    n = np.bincount(two >> np.uint32(20), minlength=DIM) + np.bincount((three >> np.uint32(20)) + np.uint32(4096), minlength=DIM)
    return np.sqrt(n / n.sum()).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all two-way splits for up to six languages, else the best spread of seeded random codes."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 6:
        return np.array([[1 if i == 0 or not split >> (i - 1) & 1 else -1 for split in range(1, 1 << (n - 1))] for i in range(n)], np.int8).reshape(n, -1)
    bits, best, least = int(np.ceil(10 * np.log2(n))), None, -1
    rng = np.random.default_rng(6)
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if (np.abs(code.sum(0)) == n).any():
            continue
        spread = min(int((code[i] != code[j]).sum()) for i, j in combinations(range(n), 2))
        if spread > least:
            best, least = code, spread
    return best


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, scale: np.ndarray, trust: np.ndarray):
        self.langs, self.weights, self.bias, self.scale, self.trust = langs, weights, bias, scale, trust
        self.code = codewords(len(langs)).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        margin = (features(text) @ self.weights + self.bias) * self.scale
        loss = (np.logaddexp(0, -2 * self.code * margin) * self.trust).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.langs[order[0]], float(p[order[0]]), bool(p[order[1]] >= CLOSE * p[order[0]])


def solve(langs: list[str], x: np.ndarray, y: np.ndarray) -> Model:
    """x: features, y: language numbers. Ridge regression in its dual form, then each bit's scale and trust by leaving one out."""
    code = codewords(len(langs)).astype(np.float64)
    if len(langs) < 2:
        return Model(langs, np.zeros((DIM, 0), np.float32), np.zeros(0), np.zeros(0), np.zeros(0))
    mean = x.mean(0, dtype=np.float64)
    # the features are centred and widened some columns at a time: all at once they would be the driver's largest arrays
    blocks = [slice(at, at + BLOCK) for at in range(0, DIM, BLOCK)]
    products = RIDGE * np.eye(len(x))
    for b in blocks:
        z = x[:, b] - mean[b]
        products += z @ z.T
    inverse = np.linalg.inv(products)
    bits = code[y]
    centre = bits.mean(0)
    dual = inverse @ (bits - centre)
    weights = np.concatenate([(x[:, b] - mean[b]).T @ dual for b in blocks])
    left_out = bits - dual / np.diag(inverse)[:, None]
    good = (bits * left_out).mean(0)
    wrong = (bits * left_out <= 0).mean(0)
    scale = np.clip(good, 0.05, None) / np.clip(((bits * left_out - good) ** 2).mean(0), 0.02, None)
    return Model(langs, weights.astype(np.float32), (centre - mean @ weights).astype(np.float32), scale.astype(np.float32), np.clip(1 - 2 * wrong, 0.01, None).astype(np.float32))


def train(labelled: DataFrame, sample: int = SAMPLE, most: int = MOST, text: str = "text", lang: str = "lang") -> Model:
    """Learn from labelled (doc_id, text, lang): rows without doc_id, text or lang, or without a letter, teach nothing."""
    named = labelled.where(F.col(lang).isNotNull() & F.col("doc_id").isNotNull())
    usable = named.where(F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in named.groupBy(lang).count().collect()}  # a row for each language
    sample = max(1, min(sample, most // max(1, len(counts))))
    # rows with small hashes, four times as many as are wanted and some more: the smallest ones are among them
    share = {k: min(1.0, (4 * sample + 50) / n) for k, n in counts.items()}
    if share:
        limit = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col(lang))
        usable = usable.where(F.col(lang).isin(*share) & (F.xxhash64("doc_id").cast("double") <= (limit * 2.0**64 - 2.0**63)))
    first = Window.partitionBy("_lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("doc_id", F.col(lang).alias("_lang")).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample)
    chosen = [r[0] for r in ids.select("doc_id").distinct().collect()]  # sample x languages at most
    if not chosen:
        return solve([], np.zeros((0, DIM)), np.zeros(0, int))

    @releasing
    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf = pdf[[bool(_LETTER.search(t)) for t in pdf["t"]]]
            yield pd.DataFrame({"id": pdf["id"], "l": pdf["l"], "x": [features(t).astype(np.float16).tobytes() for t in pdf["t"]]})

    picked = usable.where(F.col("doc_id").isin(chosen)).select(F.col("doc_id").alias("id"), F.col(lang).alias("l"), F.col(text).alias("t"))
    got = picked.mapInPandas(rows, "id long, l string, x binary").toPandas().sort_values(["l", "id", "x"]).groupby("l").head(sample)
    langs = sorted(got["l"].unique())
    y = got["l"].map({v: i for i, v in enumerate(langs)}).to_numpy(int)
    x = np.frombuffer(b"".join(got.pop("x")), np.float16).reshape(-1, DIM)
    with freed():
        return solve(langs, x, y)


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fourth document, by crc32 of doc_id's digits, is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a struct column lang_id: lang, score, ambiguous."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with freed():
            for s in texts:
                yield pd.DataFrame([sent.value.predict(t) for t in s], columns=["lang", "score", "ambiguous"])

    # as if it had side effects: else a filter on the result would have every text predicted twice
    return docs.withColumn("lang_id", predict.asNondeterministic()(F.col(text)))
