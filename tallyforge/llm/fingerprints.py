"""Document fingerprints: one-permutation MinHash over word shingles.

Each shingle is hashed once; the top bits of the hash choose one of BINS bins and each bin keeps its least hash.
Empty bins are filled by optimal densification: each has its own fixed random order of all bins and takes the value
of the first non-empty one, so two documents with equal neighbours borrow alike. Stored are the BITS low-order bits
of each bin, packed and written in hex. Two unlike bins agree by chance once in 2**BITS, so likeness corrects the
share of equal bins for that bias.

Shingles have five words (A-Z lower-cased, cut at ASCII white space); fewer words are one shingle.

Neighbours: `with_next` pairs each document with the following one in descending doc_id order without sorting all
rows in one place. The documents are dealt by ranges of doc_id (quantiles, so many numbers as ranges), each range is
sorted and read in a stream, and the first document of each range goes to the range before it as well.

Cases: null text counts as empty. Very long texts are read whole. Columns other than doc_id and text are not read. No
rows: no rows. A text without words has the empty fingerprint, like only to itself (1, else 0).
Null doc_ids come last; equal doc_ids follow their text's hash. One document only is its own neighbour.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, mix, releasing, shingle_hashes

BINS, BITS = 512, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _orders(bins: int) -> np.ndarray:
    """For each bin, the order in which it asks the others."""
    rng = np.random.default_rng(bins)
    return np.array([rng.permutation(bins) for _ in range(bins)], np.int32)


def sketch(text: str | None, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """The low-order bits of each bin as small numbers; empty for a text without words."""
    h = shingle_hashes(text)
    if not len(h):
        return np.empty(0, np.uint8)
    shift = np.uint64(64 - bins.bit_length() + 1)
    at = (h >> shift).astype(np.int64)  # sorted, as h is
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    least, there = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    least[at[first]], there[at[first]] = h[first], True
    empty = np.flatnonzero(~there)
    if len(empty):
        order, out, width = _orders(bins), least.copy(), 0
        while len(empty):
            ask = order[empty, width : 2 * width + 8]
            hit = there[ask]
            k = hit.argmax(1)
            found = hit[np.arange(len(empty)), k]
            # hashed anew with the bin's number: bins that borrow the same value must not all agree by one chance
            to = empty[found]
            out[to] = mix(least[ask[found, k[found]]] + to.astype(np.uint64) * _STEP)
            empty, width = empty[~found], 2 * width + 8
        least = out
    return (least & np.uint64((1 << bits) - 1)).astype(np.uint8)


def pack(values: np.ndarray, bits: int = BITS) -> str:
    if not len(values):
        return ""
    return np.packbits(np.unpackbits(values[:, None], axis=1)[:, 8 - bits :].ravel()).tobytes().hex()


def unpack(fingerprint: str, bits: int = BITS) -> np.ndarray:
    if not fingerprint:
        return np.empty(0, np.uint8)
    b = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8)).reshape(-1, bits)
    return np.packbits(np.pad(b, ((0, 0), (8 - bits, 0))), axis=1).ravel()


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> float:
    """Estimate of the Jaccard similarity from two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 2.0**-bits
    return float(min(1.0, max(0.0, (np.count_nonzero(a == b) / len(a) - chance) / (1 - chance))))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a column of fingerprints."""

    @F.pandas_udf("string")
    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with freed():
            for s in texts:
                yield s.map(lambda t: pack(sketch(t)))

    return docs.withColumn(out, made(F.coalesce(F.col(text), F.lit(""))))


def dealt_by_range(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with span and extra: sorted spans of descending doc_id; extra rows hold the next span's first document."""
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)) - {None}) or [0.0]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # a binary search for each row; equal ids fall into one span, the largest ones into span 0
    place = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_id", outputCol="_place", handleInvalid="keep")
    docs = place.transform(docs.withColumn("_id", F.col("doc_id").cast("double")))
    docs = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), n).otherwise(len(cuts) - F.col("_place")).cast("int").alias("span"))
    heads = sorted((r[0], r[1]) for r in docs.groupBy("span").agg(F.max("doc_id")).collect())  # one row for each span
    before = {head: (heads[i - 1][0], i) for i, (_, head) in enumerate(heads)}
    named = [h for h in before if h is not None]
    extra = docs.where(F.col("doc_id").isin(named)) if named else docs.limit(0)
    if None in before:
        extra = extra.union(docs.where("doc_id IS NULL").orderBy(F.xxhash64("text"), "text").limit(1))
    if before:
        target = F.lit(None).cast("int")
        if named:
            target = F.element_at(F.create_map(*[F.lit(x) for h in named for x in (h, before[h][0])]), F.col("doc_id"))
        extra = extra.withColumn("span", F.when(F.col("doc_id").isNull(), before.get(None, (0,))[0]).otherwise(target).cast("int"))
    both = docs.withColumn("extra", F.lit(False)).union(extra.withColumn("extra", F.lit(True)))
    return both.repartition("span").sortWithinPartitions("span", "extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")


def edited_text(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by as many code points from the start of the next document.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    @releasing
    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # span, doc_id, text, sketch, extra
        for pdf in it:
            out = []
            for span, extra, doc_id, text in zip(pdf["span"], pdf["extra"], pdf["doc_id"], pdf["text"], strict=True):
                if last is not None and last[0] == span and last[4]:
                    continue  # only the first of equal extra rows counts
                own = sketch(text)
                if last is not None and last[0] == span:
                    changed = edited_text(last[2], text)
                    other = sketch(changed)
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((last[1], len(last[2]), sha, pack(last[3]), pack(other), likeness(last[3], other), likeness(last[3], own)))
                last = (span, doc_id, text, own, extra)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})

    return dealt_by_range(docs).mapInPandas(rows, schema)
