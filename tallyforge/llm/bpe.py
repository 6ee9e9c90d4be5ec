"""BPE encoding and decoding.

Encoding backtracks over longest matches: an Aho-Corasick automaton finds, for each place of a word, the longest
token that starts there. The encoder takes it if it is compatible with the token before, else the next shorter
token that is its prefix, else it gives the place up and steps back. Two neighbours are compatible if merging the
text of both from single symbols would keep the border between them; that is read off the merge table and kept in a
pair table. Every place is given up at most once, so the time is linear in the word. The result is exactly what
merging by rank yields. Decoding gathers token strings from one blob by an offset table.

The tokenizer file's path is a parameter; its bytes (of fixed size) go to the workers with the function. Byte-level
BPE files of the tokenizers library are read, with or without a word-end suffix, with NFC, Lowercase and regular
expression Replace normalizers and Split pre-tokenizers.

Cases: null text counts as empty and gives no token. Very long texts and words are taken whole. Texts that hold a
special token's string give its id, as in that library. Repeated rows are encoded each; extra columns stay,
but one named as the result is replaced by it. No rows: no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, small_batches

#: Unicode White_Space: what \s means in tokenizer files (Python's also takes U+001C to U+001F).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words, and pairs of tokens, that a worker remembers: some 60 MB each at most, dropped with the encoder when its task ends.
CACHED_WORDS = 1 << 17
CACHED_PAIRS = 1 << 19


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable in Latin-1, else the next from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairTable:
    """Which tokens can stand side by side; tokens are numbered by merge rank after the single symbols."""

    def __init__(self, merged: dict[tuple[int, int], int], parts: list[tuple[int, int] | None]):
        self.merged, self.parts, self.known = merged, parts, {}

    def fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (known := self.known.get(key)) is None:
            if len(self.known) >= CACHED_PAIRS:
                self.known.clear()
            known = self.known[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Undo, latest first, the merges that made the two sides; a merge across the border must not be due earlier."""
        due = float("inf")  # merges of this rank or later had not happened when the sides looked as they do now
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < due:
                return False
            a, b = self.parts[left], self.parts[right]
            if a is None and b is None:
                return True
            # equal ranks: the left one is merged first, so the right one is undone first
            if b is None or (a is not None and left > right):
                due, left = left, a[1]
            else:
                due, right = right + 1, b[0]


class Encoder:
    def __init__(self, spec: bytes):
        j = json.loads(spec)
        model = j["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        letters = byte_letters()
        self.letters = {i: c for i, c in enumerate(letters)}
        # a word's end is one letter of its own, outside of the byte letters
        self.end = "Ȁ" if self.suffix else ""
        inner = lambda t: t[: -len(self.suffix)] + self.end if self.suffix and t.endswith(self.suffix) else t
        single = [c for c in letters if c in vocab] + [c + self.end for c in letters if self.suffix and c + self.suffix in vocab]
        rank = {t: i for i, t in enumerate(single)}
        outer = [t.replace(self.end, self.suffix) if self.end else t for t in single]
        parts: list[tuple[int, int] | None] = [None] * len(single)
        merged = {}
        for a, b in merges:
            x, y = inner(a), inner(b)
            if x in rank and y in rank and x + y not in rank and a + b in vocab:
                rank[x + y] = merged[rank[x], rank[y]] = len(parts)
                parts.append((rank[x], rank[y]))
                outer.append(a + b)
        self.pairs, self.rank = PairTable(merged, parts), rank
        self.ids = [vocab[t] for t in outer]
        self.length = [len(t) for t in rank]
        self.shorter = [next((rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in rank), -1) for t in rank]
        self.automaton = ahocorasick.Automaton()
        for t, i in rank.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        added = {t["content"]: t["id"] for t in j.get("added_tokens") or [] if not t.get("normalized")}
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.normalizers = self._steps(j.get("normalizer"), "normalizers")
        split = [s for s in self._steps(j.get("pre_tokenizer"), "pretokenizers") if s["type"] == "Split"]
        byte_level = next(s for s in self._steps(j.get("pre_tokenizer"), "pretokenizers") if s["type"] == "ByteLevel")
        pattern = split[0]["pattern"]["Regex"] if split else "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
        if byte_level.get("add_prefix_space"):
            raise ValueError("add_prefix_space is not supported")
        self.pattern = self._regex(pattern)
        strings = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
        size = max(strings) + 1
        blob = [strings.get(i, "").encode() for i in range(size)]
        self.offsets = np.concatenate(([0], np.cumsum([len(b) for b in blob]))).astype(np.int64)
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.decoder = j.get("decoder")
        self.numbers = [str(i) for i in range(size)]
        # words of late, and those of before: one that comes again moves back to the first
        self.late: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}

    @staticmethod
    def _steps(part: dict | None, key: str) -> list[dict]:
        return [] if part is None else part[key] if part["type"] == "Sequence" else [part]

    @staticmethod
    def _regex(pattern: str):
        inside = regex.sub(r"\[\^\\s", lambda m: "[^" + SPACE, pattern)
        return regex.compile(inside.replace("\\S", f"[^{SPACE}]").replace("\\s", f"[{SPACE}]"))

    def normalize(self, text: str) -> str:
        for step in self.normalizers:
            if step["type"] == "NFC":
                text = text if text.isascii() else unicodedata.normalize("NFC", text)
            elif step["type"] == "Lowercase":
                # letter by letter: no final form of sigma
                text = text.replace("Σ", "σ").lower()
            elif step["type"] == "Replace" and step["pattern"].get("Regex") == "\\s+" and self.spaces_dropped:
                pass
            elif step["type"] == "Replace":
                text = self._regex(step["pattern"]["Regex"]).sub(step["content"].replace("\\", "\\\\"), text)
            else:
                raise ValueError(f"normalizer {step['type']} is not supported")
        return text

    @functools.cached_property
    def spaces_dropped(self) -> bool:
        """White space never reaches a token, so runs of it need not be made one."""
        return not any(self.pattern.findall(f"a{c}{c} b") != ["a", "b"] for c in "\t\n 　")

    def encode_word(self, word: str) -> list[int]:
        # letters and digits of ASCII stand for themselves
        letters = word + self.end if word.isascii() and word.isalnum() else "".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass"))) + self.end
        n, length, fits = len(letters), self.length, self.pairs.fits
        longest = [-1] * n
        for last, token in self.automaton.iter(letters):
            longest[last + 1 - length[token]] = token  # ends come in order: of one start the longest is the last
        known, shorter, fits = self.pairs.known.get, self.shorter, self.pairs.fits
        out, closed, at, left, token = [], (), 0, -1, longest[0]
        while at < n:
            # the longest token here that does not end at a place given up and is compatible with the one before
            while token >= 0:
                if not closed or at + length[token] not in closed:
                    if left < 0:
                        break
                    fit = known(left << 32 | token)
                    if fit or (fit is None and fits(left, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                left, token = token, longest[at] if at < n else -1
            elif out:
                closed = closed or set()
                closed.add(at)
                token = out.pop()
                at -= length[token]
                left, token = out[-1] if out else -1, shorter[token]
            else:
                raise ValueError(f"no tokens spell {word!r}")
        ids = self.ids
        return [ids[t] for t in out]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for k, piece in enumerate(self.special.split(text or "") if self.special else [text or ""]):
            if k % 2:
                out.append(self.added[piece])
                continue
            late = self.late
            for w in self.pattern.findall(self.normalize(piece)):
                ids = late.get(w)
                if ids is None:
                    if len(late) >= CACHED_WORDS:
                        self.before, self.late = late, {}
                        late = self.late
                    ids = late[w] = self.before.get(w) or self.encode_word(w)
                out += ids
        return out

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """Token strings joined by spaces where the file names no decoder; byte letters turned back where it names ByteLevel."""
        if not len(ids):
            return b""
        i = np.asarray(ids, np.int64)
        spaced = self.decoder is None
        start, size = self.offsets[i], self.offsets[i + 1] - self.offsets[i] + spaced
        ends = np.cumsum(size)
        take = np.arange(ends[-1], dtype=np.int64)
        take += np.repeat(start - (ends - size), size)
        if spaced:
            out = self.blob[np.minimum(take, len(self.blob) - 1)]
            out[ends - 1] = 32
            return out[:-1].tobytes()
        back = {c: b for b, c in self.letters.items()}
        return bytes(back[c] for c in self.blob[take].tobytes().decode())


def _spec(spark: SparkSession, path: str) -> Broadcast:
    small_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of token ids."""
    spec = _spec(docs.sparkSession, path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with freed():
            e = Encoder(spec.value)
            for column in texts:
                # numbers, not Python objects: a batch may hold millions of tokens
                found = [np.array(e.encode(t.as_py()), np.int32) for t in column]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found])))
                del found
            del e

    return docs.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the decoded text of a column of token ids."""
    spec = _spec(docs.sparkSession, path)

    @F.arrow_udf(T.StringType())
    def decoded(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with freed():
            e = Encoder(spec.value)
            for column in rows:
                yield pa.array([e.decode(x.values.to_numpy()).decode("utf-8", "replace") for x in column], pa.string())
            del e

    return docs.withColumn(out, decoded(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding and decoding; ids and texts stay in the workers."""
    spec = _spec(docs.sparkSession, path)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        with freed():
            e = Encoder(spec.value)
            for column in texts:
                rows = []
                for t in column:
                    ids = e.encode(t.as_py())
                    rows.append((len(ids), sha(" ".join(map(e.numbers.__getitem__, ids)).encode()), sha(e.decode(ids))))
                n, given, back = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(given, pa.string()), pa.array(back, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])
            del e

    d = docs.select("doc_id", digests(F.coalesce(F.col(text), F.lit(""))).alias("d"))
    return d.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
