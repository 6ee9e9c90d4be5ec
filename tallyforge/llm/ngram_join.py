"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its 64-bit word shingle hashes (tokens). Two sets with Jaccard similarity of at least
`percent` % differ from each other in few tokens; of x's tokens at most x - ceil(percent * x / 100). All tokens have
one order: rare ones first, then frequent ones, each by hash. A set's prefix is extended until that many mismatches
cannot spoil all of its signatures: a rare token is a signature itself; frequent tokens fall into many small classes
and each pair of tokens of a class is one, so a class of n tokens stands n - 1 mismatches. Two sets that link share
a signature, so two documents that only share a frequent passage seldom meet. The number of classes follows the set
size (powers of two of the larger set's), which keeps the pairs linear in the size of the prefix.

1. One reading of the texts gives each document's set size and set digest, and the counts of all tokens in a table
   of 2^20 counters, summed over the tasks. Tokens whose counter stands well above the mean are frequent. One bit a
   counter, 128 KB whatever the corpus, goes to all tasks; it steers the order only and never decides a link.
2. A second reading gives the signatures. Equal sets collapse, within each task and then by digest, to the document
   with the smallest id. Signatures that one set alone has are dropped; those with the same sets count once.
3. In each signature's group, every set is held against the group's first (a star, linear in the group), and links
   are closed to components. Then only pairs of a group that lie in different components remain; all of them are
   held against each other, none is skipped. So no link is lost, and near copies by the thousands do not make all
   their pairs. Stars of more than STAR members are dealt over several tasks, each with the group's first.
4. To hold two sets against each other, first their histograms are compared (tokens in each of 512 classes): what
   they have in common bounds the common tokens from above, and most pairs end there, inside their group's task.
   The whole sets of the rest, read anew, meet at their star's centre. Large stars are dealt over several tasks.

Cases: null text, and text without words, is an empty set, linked with nothing. Fewer words than a shingle make one
token of the whole. Equal or null doc_ids are told apart (see common.keyed); the component's id is then that of its
first row. Repeated rows are equal sets. No rows: no rows. Columns other than doc_id and text are not read (keep_first
hands them on, whatever their names). Digests of sets have 128 bits, tokens 64.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, components, keyed, mix, packed, releasing, shingle_hashes, stage, unpacked

COUNTER_BITS = 20
CHUNK, BLOOM_CHUNK = 1 << 12, 1 << 16
FEWEST = 32
STAR = 2048
#: A Bloom filter has eight bits a key, within these powers of two; 2^26 bits are 8 MB. More keys are joined instead.
LEAST_BITS, MOST_BITS = 20, 26
BUCKETS = 512
_A, _B, _C, _D = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _sizes(words: int):
    """First reading: key, n, digest of each document; the counters, cut in chunks, in rows of their own."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    @releasing
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in it:
            n, digest = [], []
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text, words)
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                at = (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
                np.add.at(counts, at, 1)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        rows = [(i, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(counts.reshape(-1, CHUNK)) if c.any()]
        none = pa.nulls(len(rows))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    return run


def frequent_tokens(counts: DataFrame, total: int) -> np.ndarray:
    """A bit for each counter (packed): does it stand well above the mean? counts: chunk, counts; total: of all counters."""
    mean = total / (1 << COUNTER_BITS)
    least = mean + max(FEWEST, 6 * mean**0.5)

    @releasing
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(chunk, np.zeros(CHUNK, np.uint64))
                sums[chunk] += np.frombuffer(zlib.decompress(data), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(s > least).tobytes() for s in sums.values()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros((1 << COUNTER_BITS) // 8, np.uint8).reshape(-1, CHUNK // 8)
    for chunk, bits in counts.repartition("chunk").mapInArrow(run, "chunk int, bits binary").collect():  # 16 rows of 8 KB
        out[chunk] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def signatures(h: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set of sorted hashes."""
    n = len(h)
    if n < 4:  # links to equal sets only, which have collapsed, or for low thresholds to any set that shares a token
        return h if n > (percent * n + 99) // 100 else h[:0]
    need = n - (percent * n + 99) // 100 + 1
    at = (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
    often = (frequent[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    rare = h[~often]
    if len(rare) >= need:
        return rare[:need]
    out, often, need = [rare], h[often], need - len(rare)
    for band in range(n.bit_length(), (100 * n // percent).bit_length() + 1):  # sizes of all sets that may link to this one as the larger
        kind = (mix(often * _D) % np.uint64(max(1, (1 << band - 1) // 12))).astype(np.int64)
        first = np.zeros(len(kind), bool)
        first[np.unique(kind, return_index=True)[1]] = True
        reach = np.searchsorted(np.cumsum(~first), need)
        if reach >= len(kind):  # low thresholds only: not enough tokens, so each stands for itself
            out.append(often)
            continue
        order = np.argsort(kind[: reach + 1], kind="stable")
        k, t = kind[: reach + 1][order], often[: reach + 1][order]
        for lag in range(1, len(k)):
            same = k[lag:] == k[:-lag]
            if not same.any():
                break
            out.append(mix(t[:-lag][same] * _A + t[lag:][same] * _B + np.uint64(band * int(_C) & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(out)


def _signed(words: int, percent: int, frequent):
    @releasing
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        bits = frequent.value
        for batch in it:
            keys, sigs = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = shingle_hashes(text, words)
                digest = xxhash.xxh3_128_digest(h.tobytes())
                if digest in seen:
                    continue
                if len(seen) < 1 << 18:
                    seen.add(digest)
                sigs.append(signatures(h, bits, percent))
                keys.append(np.full(len(sigs[-1]), key, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], names=["sig", "key"])

    return run


def _bloom(keys: DataFrame, power: int) -> np.ndarray:
    """2^power bits, a bit for each key's hash."""
    bit = F.pmod(F.xxhash64("key"), F.lit(1 << power))
    bits = keys.select(bit.alias("bit")).distinct().withColumn("chunk", F.shiftright("bit", 16).cast("int")).withColumn("bit", F.col("bit").bitwiseAND(0xFFFF).cast("int"))

    @releasing
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in it:
            bit, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(chunk):
                found.setdefault(int(c), np.zeros(BLOOM_CHUNK, bool))[bit[chunk == c]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(s).tobytes() for s in found.values()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros((1 << power) // 8, np.uint8).reshape(-1, BLOOM_CHUNK // 8)
    for chunk, b in bits.repartition("chunk").mapInArrow(run, "chunk int, bits binary").collect():  # 1,024 rows of 8 KB at most
        out[chunk] = np.frombuffer(b, np.uint8)
    return out.ravel()


def _sets(words: int, bloom, short: bool):
    @releasing
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bloom is None else bloom.value
        for batch in it:
            bit = batch.column("bit").to_numpy()
            keep = np.arange(len(bit)) if bits is None else np.flatnonzero(bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
            texts, keys = batch.column("text").take(pa.array(keep)).to_pylist(), batch.column("key").take(pa.array(keep))
            sets = [shingle_hashes(t, words) for t in texts]
            data = [histogram(h) if short else h.tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(h) for h in sets], pa.int64()), pa.array(data, pa.binary())], names=["key", "n", "tokens"])

    return run


def histogram(h: np.ndarray) -> bytes:
    """Tokens in each of BUCKETS classes, a byte each; empty if one overflows."""
    n = np.bincount((h >> np.uint64(8) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else b""


def _candidates(percent: int, star: bool):
    """Pairs of a group that can reach the similarity, as their histograms have enough in common.

    star: each with the first, which is the smallest id. Else: those of different components, one of them at home in
    this part of the group; it is sorted by size, and only sets near enough in size are looked at.
    """

    def pairs(key: np.ndarray, n: np.ndarray, comp: np.ndarray, home: np.ndarray, hist: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = np.array([len(x) == BUCKETS for x in hist])
        table = np.frombuffer(b"".join(x or bytes(BUCKETS) for x in hist), np.uint8).reshape(-1, BUCKETS)
        a, b = [], []
        for i in [0] if star else range(1, len(key)):
            if star:
                j = np.arange(1, len(key))
                j = j[100 * np.minimum(n[0], n[j]) >= percent * np.maximum(n[0], n[j])]
            else:
                j = np.arange(np.searchsorted(n, (percent * n[i] + 99) // 100), i)
                j = j[(comp[j] != comp[i]) & (home[i] | home[j])]
            if not len(j):
                continue
            common = np.concatenate([np.minimum(table[i], table[j[k : k + 8192]]).sum(1, dtype=np.int64) for k in range(0, len(j), 8192)])
            j = j[~whole[i] | ~whole[j] | (100 * common >= percent * (n[i] + n[j] - common))]
            a.append(np.minimum(key[i], key[j])), b.append(np.maximum(key[i], key[j]))
        none = np.empty(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    @releasing
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        here, a_out, b_out, size = None, [], [], 0

        def close() -> None:
            nonlocal held, size
            if len(held) > 1:
                key, n, comp, home, hist = zip(*held, strict=True)
                a, b = pairs(np.array(key, np.int64), np.array(n, np.int64), np.array(comp, np.int64), np.array(home, bool), list(hist))
                a_out.append(a), b_out.append(b)
                size += len(a)
            held = []

        out = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (a_out, b_out)], names=["a", "b"])
        for batch in it:
            for sig, salt, *row in zip(*(batch.column(c).to_pylist() for c in ("sig", "salt", "rep", "n", "comp", "home", "tokens")), strict=True):
                if (sig, salt) != here:
                    close()
                    here = sig, salt
                    if size > 100_000:
                        yield out()
                        a_out, b_out, size = [], [], 0
                held.append(tuple(row))
        close()
        yield out()

    return run


def _judge(percent: int):
    """Pairs of a centre, which comes first, and those after it that reach the similarity."""

    @releasing
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre = None, None
        for batch in it:
            a_out, b_out = [], []
            for a, salt, key, data in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "key", "tokens")), strict=True):
                t = np.frombuffer(data, np.uint64)
                if (a, salt) != star:
                    star, centre = (a, salt), t
                    continue
                at = np.searchsorted(centre, t)
                at[at == len(centre)] = 0
                common = int(np.count_nonzero(centre[at] == t))
                if 100 * common >= percent * (len(centre) + len(t) - common):
                    a_out.append(a), b_out.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return run


def _read_sets(docs: DataFrame, keys: DataFrame, words: int, short: bool) -> DataFrame:
    """key, n, tokens of the documents in keys (and of a few more). The texts are not shuffled, but for more keys than the largest Bloom filter is for."""
    keys = stage(keys.distinct(), "keys")
    power = max(LEAST_BITS, (8 * keys.count()).bit_length())
    if power > MOST_BITS:
        docs, power, bloom = docs.join(keys, "key", "left_semi"), LEAST_BITS, None
    else:
        bloom = docs.sparkSession.sparkContext.broadcast(_bloom(keys, power))
    bit = F.pmod(F.xxhash64("key"), F.lit(1 << power)).alias("bit")
    return docs.select("key", "text", bit).mapInArrow(_sets(words, bloom, short), "key long, n long, tokens binary")


def _wanted(pairs: DataFrame) -> DataFrame:
    """key, a, salt, member: where each document's set goes; large stars have several parts, each with the centre."""
    salts = pairs.groupBy("a").agg((F.floor(F.count("*") / STAR) + 1).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select(F.col("b").alias("key"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"))
    centres = salts.select(F.col("a").alias("key"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    return members.union(centres)


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) that link; each a is the centre of a star."""
    pairs = stage(pairs, "pairs")
    sets = _read_sets(docs, pairs.select(F.col("a").alias("key")).union(pairs.select("b")), words, False)
    stars = sets.join(_wanted(pairs), "key").repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "key")
    out = stage(stars.select("a", "salt", "key", "tokens").mapInArrow(_judge(percent), "a long, b long"), "links")
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (the first document with an equal set) for each row of docs (doc_id, text)."""
    d, plain = keyed(docs.select("doc_id", "text"))
    d = d.select(F.col("_key").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = d.select("key", "text")
    read = stage(texts.mapInArrow(_sizes(words), "key long, n long, digest binary, chunk int, counts binary"), "sizes")
    sizes = read.where("key IS NOT NULL").select("key", "n", "digest")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(read.where("chunk IS NOT NULL").select("chunk", "counts"), total))
    first = sizes.where("n > 0").groupBy("digest").agg(F.min("key").alias("rep"), F.count("*").alias("c")).where("c > 1")
    copies = stage(sizes.join(first, "digest").select("key", "rep"), "copies")

    # groups: the sets that share a signature, two at least
    signed = texts.mapInArrow(_signed(words, percent, frequent), "sig long, key long")
    signed = signed.withColumn("c", F.expr("count(*) OVER (PARTITION BY sig)")).where("c > 1").select("sig", "key")
    signed = signed.join(copies, "key", "left").select("sig", F.coalesce("rep", "key").alias("rep")).distinct()
    signed = stage(signed, "signed")
    group = signed.groupBy("sig").agg(F.count("*").alias("c"), F.sum(F.expr("cast(xxhash64(rep) as decimal(20,0))")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x"), F.min("rep").alias("a"))
    # written tables on both sides of a join let adaptive execution split a signature that many sets have
    group = stage(group.where("c > 1").groupBy("c", "s", "x", "a").agg(F.min("sig").alias("sig")).select("sig", "c", "a"), "group")
    groups = stage(signed.join(group, "sig"), "groups")

    hist = stage(_read_sets(texts, groups.select(F.col("rep").alias("key")), words, True).withColumnRenamed("key", "rep"), "histograms")
    # each with the group's first; a large group is dealt over several tasks, each of which has the first, too
    parts = (F.floor(F.col("c") / STAR) + 1).cast("int")
    members = groups.where("rep <> a").select("sig", "rep", F.pmod(F.xxhash64("rep"), parts).cast("int").alias("salt"), F.lit(1).alias("member"))
    centres = groups.where("rep = a").select("sig", "rep", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.lit(0).alias("member"))
    star = members.union(centres).withColumns({"comp": F.lit(0).cast("long"), "home": F.lit(True)}).join(hist, "rep").repartition("sig", "salt").sortWithinPartitions("sig", "salt", "member", "rep")
    star = stage(star.select("sig", "salt", "rep", "n", "comp", "home", "tokens").mapInArrow(_candidates(percent, True), "a long, b long").distinct(), "star")
    links = verified(texts, star, words, percent)
    comp = components(links)

    # what the stars leave open
    g = stage(groups.select("sig", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "rep", F.coalesce("comp", "rep").alias("comp")), "open")
    # a large group is dealt, too: of the first's component each set is in one part, the others are in all and at home in one
    several = g.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min_by("comp", "rep").alias("first"), (F.floor(F.count("*") / STAR) + 1).cast("int").alias("parts"))
    several = stage(several.where("x <> y").select("sig", "first", "parts"), "several")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    salts = F.when(F.col("comp") == F.col("first"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rest = g.join(several, "sig").select("sig", "rep", "comp", own.alias("own"), F.explode(salts).alias("salt"))
    rest = rest.withColumn("home", F.col("salt") == F.col("own")).join(hist, "rep").repartition("sig", "salt").sortWithinPartitions("sig", "salt", "n", "rep")
    rest = rest.select("sig", "salt", "rep", "n", "comp", "home", "tokens").mapInArrow(_candidates(percent, False), "a long, b long").distinct()
    more = verified(texts, rest.join(star, ["a", "b"], "left_anti"), words, percent)
    if more.limit(1).count():
        comp = components(links.union(more))

    all_ = sizes.join(copies, "key", "left").select("key", "n", F.coalesce("rep", "key").alias("rep"))
    all_ = all_.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"), F.col("rep").alias("class_id"))
    if plain:
        return all_.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", "class_id")
    ids = d.select("key", "doc_id")
    named = lambda c: ids.select(F.col("key").alias(c), F.col("doc_id").alias(f"{c}_named"))
    return all_.join(ids, "key").join(named("component_id"), "component_id").join(named("class_id"), "class_id").select("doc_id", "n_shingles", F.col("component_id_named").alias("component_id"), F.col("class_id_named").alias("class_id"))


def keep_first(docs: DataFrame, percent: int = 80, words: int = SHINGLE_WORDS) -> DataFrame:
    """docs without the near duplicates: of each component the document with the smallest doc_id stays; null and shared doc_ids are told apart by common.keyed."""
    d, _ = keyed(packed(docs, "doc_id", "text"))
    found = near_duplicates(d.select(F.col("_key").alias("doc_id"), "text"), percent, words).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return unpacked(d.join(found, d["_key"] == found["_gone"], "left_anti"), docs.columns)
