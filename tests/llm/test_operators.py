"""Each operator against a brute-force version or an exact round trip, with nulls, empty and long texts, ties, repeats, no rows and extra columns."""

import base64
import datetime
import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import ann, bpe, fingerprints, langid, line_dedup, mixing, ngram_join, pii, suffix_dedup, warc
from tallyforge.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, a int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, shared passages, repeated lines, odd cases, and columns with clashing names."""
    rng = random.Random(3)
    out = []
    passage = prose(rng, 60)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(30)]
    for i in range(90):
        t = base[i % 30]
        if i >= 60:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif i >= 30:
            t = f"{prose(rng, 20)}\n{passage}\n{t}\nline one\nline two\nline three\n{prose(rng, 5)}"
        out.append((i, t))
    out += [(100, None), (101, ""), (102, "   "), (103, "a b"), (104, "a b"), (105, "A  b"), (106, "x" * 5000), (107, "\n\n"), (108, "one\ntwo"), (109, "one\ntwo"), (110, prose(rng, 20000)), (111, "!!! 123")]
    return [(d, t, "en" if d % 2 else None, ["s1", "s2", None][d % 3], len(t or ""), "k", d) for d, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    common, where = defaultdict(int), defaultdict(list)
    for d, s in sets.items():
        for g in s:
            for other in where[g]:
                common[other, d] += 1
            where[g].append(d)
    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("fewest", [32, 1])
def test_ngram_join(docs, rows, none, monkeypatch, fewest):
    monkeypatch.setattr(ngram_join, "FEWEST", fewest)  # 1: shared shingles are frequent ones
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    sets = {r[0]: shingles(r[1]) for r in rows}
    want = components(sets)
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}
    assert ngram_join.near_duplicates(none).count() == 0


def test_ngram_join_of_dealt_stars_and_joined_keys(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR", 2)
    monkeypatch.setattr(ngram_join, "MOST_BITS", 2)
    want = components({r[0]: shingles(r[1]) for r in rows})
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == want


def test_ngram_join_repeated_ids(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q r s t u")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.near_duplicates(d).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (2, 2)]


def test_signatures_find_every_link():
    """Whatever is frequent, two sets that link share a signature."""
    rng = np.random.default_rng(0)
    for k in range(300):
        n = int(rng.integers(4, 120))
        x = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        drop = int(rng.integers(0, max(1, len(x) // 9)))
        y = np.unique(np.concatenate((x[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, len(x) // 10))), np.uint64))))
        if 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)) or np.array_equal(x, y):
            continue
        bits = np.full((1 << 20) // 8, [0, 255, 0x55][k % 3], np.uint8)
        assert np.intersect1d(ngram_join.signatures(x, bits, 80), ngram_join.signatures(y, bits, 80)).size


@pytest.mark.parametrize("percent", [20, 30, 40, 60])
def test_signatures_find_links_of_low_thresholds(percent):
    """Nested sets of all sizes that may link, all of their tokens frequent."""
    rng, bits, linked = np.random.default_rng(percent), np.full((1 << 20) // 8, 255, np.uint8), 0
    for _ in range(250):
        y = np.unique(rng.integers(0, 1 << 63, int(rng.integers(8, 300)), np.uint64))
        x = np.sort(rng.choice(y, int(rng.integers(max(4, len(y) * percent // 100), len(y))), replace=False))
        if 100 * len(x) >= percent * len(y):
            linked += 1
            assert np.intersect1d(ngram_join.signatures(x, bits, percent), ngram_join.signatures(y, bits, percent)).size
    assert linked > 100


def test_suffix_dedup(docs, rows, none):
    seen, want = set(), {}
    for d, t in sorted((r[0], r[1]) for r in rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[d] = (len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()}
    assert got == want
    assert suffix_dedup.dedup(none).count() == 0


def test_longest_previous_factors():
    rng = random.Random(1)
    for _ in range(60):
        depth, text = rng.choice([8, 9, 17, 40, 100]), bytes(rng.choice(b"ab") for _ in range(300))
        slices = []
        for _ in range(rng.randint(1, 6)):
            at, n = rng.randint(0, 150), depth + rng.randint(0, 30)
            s = bytearray(text[at : at + n])
            s[rng.randrange(n)] = rng.choice(b"abc")
            slices.append(bytes(s))
        group = np.array([rng.randint(0, 1) for _ in slices])
        raw, begin = b"".join(slices), np.cumsum([0, *map(len, slices)])
        starts, groups = (np.array(z) for z in zip(*[(begin[i] + o, group[i]) for i, s in enumerate(slices) for o in range(len(s) - depth + 1)], strict=True))
        got = suffix_dedup.longest_previous_factor(np.frombuffer(raw, np.uint8), starts, groups, depth)
        common = lambda a, b, raw=raw, depth=depth: next((i for i in range(depth) if raw[a + i] != raw[b + i]), depth)
        for k in range(0, len(starts), 7):
            assert got[k] == max((common(starts[k], starts[j]) for j in range(len(starts)) if groups[j] == groups[k] and starts[j] < starts[k]), default=0)


def test_suffix_dedup_repeated_ids_and_bytes(spark):
    t = "0123456789" * 15
    d = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    got = suffix_dedup.dedup(d, with_bytes=True).collect()
    assert sorted(r.n_removed for r in got) == [140, 150, 150]
    assert {bytes(r.kept) for r in got} == {b"0123456789", b""}


def lines_wanted(rows, run=3):
    seqs = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")] for d, t in rows}
    seen, out = set(), {}
    for d in sorted(seqs):
        s, gone = seqs[d], set()
        w = min(run, len(s))
        for j in range(len(s) - w + 1 if s else 0):
            key = (w, tuple(x for _, x in s[j : j + w]))
            if key in seen:
                gone |= set(range(s[j][0], s[j + w - 1][0] + 1))
            seen.add(key)
        out[d] = gone
    return out


def test_line_dedup(docs, rows, none):
    want = lines_wanted([(r[0], r[1]) for r in rows])
    for r in line_dedup.dedup(docs).collect():
        t = next(x[1] for x in rows if x[0] == r.doc_id)
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[r.doc_id])
        assert r.text == kept
        assert (r.key, r.a) == ("k", r.doc_id)
        assert r.n_removed == sum(bool((t or "").split("\n")[i].strip(" ")) for i in want[r.doc_id])
    assert line_dedup.dedup(none).count() == 0


def test_line_dedup_replaces_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a\nb\nc\nd", 9, 8), (2, "x\na\nb\nc\nd", 9, 8)], ["doc_id", "text", "n_runs", "a.b"])
    got = sorted(line_dedup.dedup(d).collect(), key=lambda r: r.doc_id)
    assert [(r.text, r["a.b"], r.n_runs) for r in got] == [("a\nb\nc\nd", 8, 0), ("x", 8, 1)] and got[0].__fields__.count("n_runs") == 1


def test_line_dedup_of_long_runs_at_any_place(spark):
    rng = random.Random(12)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = lines_wanted(rows)
    assert got == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]) for d, t in rows}


def test_line_dedup_within_a_document(spark):
    d = spark.createDataFrame([(1, "a\nb\nc\nx\n\na\nb\nc\ny")], "doc_id long, text string")
    r = line_dedup.dedup(d).first()
    assert (r.text, r.n_removed, r.n_runs) == ("a\nb\nc\nx\n\ny", 3, 1)


def test_line_dedup_of_long_passages(spark):
    rng = random.Random(8)
    one, a, b, short = prose(rng, 60), prose(rng, 30), prose(rng, 25), prose(rng, 9)
    rows = [(1, f"x\n{one}\ny\n{a}\n{b}\n{short}\nz"), (2, f"p\nq\n{one}\n{short}\nr"), (3, one), (4, f"s\n\n{a}\n\n{b}\nt\n{short}"), (5, f"u\n{a}\nv\n{b}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in line_dedup.dedup(d, enough=50).collect()}
    assert got == {1: (rows[0][1], 0, 0), 2: (f"p\nq\n{short}\nr", 1, 1), 3: ("", 1, 1), 4: (f"s\n\nt\n{short}", 2, 1), 5: (rows[4][1], 0, 0)}


def luhn(s):
    return sum((lambda d: d if i % 2 == 0 else d * 2 - 9 * (d > 4))(int(c)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pii(spark, none):
    rows = [
        (1, "mail ann.92@mail2.example.com, card 4785380592391139 or 4785-3805-9239-1139; 152.143.123.131 +1 (743) 555-3824 2024-02-29 31.12.1999", 1),
        (2, "4785380592391139\ntoken = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" 02/30/2020 1234567890123456 300.1.1.1", 2),
        (3, None, 3), (4, "", 4), (5, "nothing here, 12 or 3.4", 5), (6, "word " * 20000 + "4785380592391139", 6), (2, None, 2),
    ]
    got = pii.pseudonyms(spark.createDataFrame(rows, "doc_id long, text string, m int"), "k").collect()
    a, b, long = got[0], got[1], got[5]
    card = b.text.split("\n")[0]
    assert card != "4785380592391139" and luhn(card) and len(card) == 16
    assert a.text.count(card) == 1 and f"{card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}" in a.text and long.text.endswith(card)
    assert "@mail2.example.com" in a.text and "ann.92" not in a.text and "+1 (" in a.text and "555-3824" not in a.text
    assert "24be64439e3e" not in b.text and "02/30/2020 1234567890123456 300.1.1.1" in b.text
    assert [(r.n_card, r.n_email, r.n_ip, r.n_phone, r.n_date, r.n_secret) for r in got[:2]] == [(2, 1, 1, 1, 2, 0), (1, 0, 0, 0, 0, 1)]
    assert got[2].text is None and got[3].text == "" and got[4].text == rows[4][1] and [r.m for r in got] == [r[2] for r in rows]
    assert pii.pseudonyms(spark.createDataFrame(rows[:1], "doc_id long, text string, m int"), "other").first().text != a.text
    assert pii.pseudonyms(none, "k").count() == 0


def test_pii_takes_whole_secrets_and_long_domains(spark):
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(n)) for n in (512, 513, 3000, 100000)]
    mails = ["ann.lee@mail.international", "ann.lee@x.cancerresearch", "ann.lee@mail.xn--p1ai", "ann.lee@a.xn--vermgensberatung-pwb"]
    rows = [(i, f"token = {k}; end") for i, k in enumerate(keys)] + [(9, " ".join(mails)), (10, "ann.lee@host.12 ann.lee@host ann.lee@a.x1")]
    got = {r.doc_id: r for r in pii.pseudonyms(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, k in enumerate(keys):
        new = got[i].text.removeprefix("token = ").removesuffix("; end")
        assert got[i].n_secret == 1 and len(new) == len(k) and sum(x == y for x, y in zip(k, new, strict=True)) < len(k) / 8
        assert not any(k[j : j + 12] in new for j in range(0, len(k) - 12, 97))
    assert got[9].n_email == 4 and "ann.lee" not in got[9].text and [m.split("@")[1] for m in got[9].text.split()] == [m.split("@")[1] for m in mails]
    assert got[10].n_email == 0 and got[10].text == rows[-1][1]


def test_pii_is_a_bijection(spark):
    n = spark.range(189 * 773).select(pii.feistel_number(F.floor(F.col("id") / 773), F.col("id") % 773, (189, 773), "k", "date").alias("p"))
    assert n.distinct().count() == 189 * 773
    s = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s")).select(pii.feistel_string(F.col("s"), "k", "card").alias("p"))
    assert s.distinct().count() == 1000 and s.where(~F.col("p").rlike("^[0-9]{3}$")).count() == 0


def test_warc_round_trip(spark):
    same = "<p>" + "x" * 200
    rows = [(5, "http://a/é", same), (3, None, same), (7, "u", same), (1, "u\r\nX: y", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", same), (8, "u", "ünï" * 5000), (9, "u", "WARC/1.1\r\n" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.read_archives(warc.write_archives(pages, segment=2000), payload=True).collect()
    assert len(got) == len(rows) and all(r.fault is None for r in got)
    by = {r.page_id: r for r in got}
    for page_id, _, html in rows:
        b = (html or "").encode()
        assert (by[page_id].payload_bytes, by[page_id].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert {p: r.refers_to for p, r in by.items() if r.record_type == "revisit"} == {5: 3, 7: 3, None: 3}
    assert bytes(by[3].payload).decode() == same
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_warc_salvage(packed):
    whole = []
    for i in range(6):
        body = f"page {i} WARC/1.1\r\n".encode() * 20
        rec = warc.record(i, "u", body, hashlib.sha256(body).hexdigest())
        whole.append(warc.member(rec) if packed else rec)
    data = bytearray(b"".join(whole))
    at = len(whole[0]) + len(whole[1])
    data[at + 20 : at + 40] = b"\0" * 20  # damages the third record
    data = bytes(data[: -len(whole[5]) // 2])  # and cuts the last
    got = list(warc.salvage(data))
    assert [r["page_id"] for r in got if "page_id" in r] == [0, 1, 3, 4]
    gaps = [(r["start"], r["stop"]) for r in got if "fault" in r]
    assert gaps[0] == (at, at + len(whole[2])) and gaps[1][1] == len(data)
    assert list(warc.salvage(b"")) == []


def test_warc_reads_in_blocks(monkeypatch):
    """Records and gaps are the same whatever the size of the blocks, and nothing is read twice."""
    rng, whole = random.Random(4), []
    for i in range(40):
        body = f"page {i} WARC/1.1\r\n{prose(rng, rng.randint(0, 300))}".encode() * rng.randint(1, 5)
        rec = warc.record(i, "u", body, hashlib.sha256(body).hexdigest())
        rec = rec[:-9] + b"\0\0" + rec[-7:] if i % 9 == 4 else rec
        whole.append(warc.member(rec) if i % 3 else rec)
    data = b"".join(whole) + whole[0][:30]
    want = list(warc.salvage(data))
    assert sum("fault" not in r for r in want) >= 36 and sum("fault" in r for r in want) == 5
    for block, ahead in ((1, 1), (7, 3), (64, 16), (5000, 1024), (1 << 22, 1 << 10)):
        monkeypatch.setattr(warc, "BLOCK", block)
        monkeypatch.setattr(warc, "AHEAD", ahead)
        at = 0

        def read(n):
            nonlocal at
            part = data[at : at + n]
            at += len(part)
            return part

        assert list(warc.salvage(read)) == want


def test_warc_is_linear():
    body = b"x" * 2000
    one = warc.member(warc.record(1, "u", body, hashlib.sha256(body).hexdigest()))

    def took(n):
        began = time.process_time()
        assert sum(1 for _ in warc.salvage(one * n)) == n
        return time.process_time() - began

    took(200)
    assert took(8000) < 16 * took(1000)


def test_warc_salvage_in_spark(spark, tmp_path):
    body = "päge".encode() * 100
    good = warc.member(foreign("response", b"HTTP/1.1 200 OK\r\n\r\n" + body, "Content-Type: application/http; msgtype=response"))
    (tmp_path / "a.warc.gz").write_bytes(good + good[:40] + good)
    (tmp_path / "b.warc.gz").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.gz", 0, 0) for n in "ab"], warc.MANIFEST)
    got = warc.read_archives(files, payload=True).orderBy("start").collect()
    assert [(r.start, r.stop, r.fault is None) for r in got] == [(0, len(good), True), (len(good), len(good) + 40, False), (len(good) + 40, 2 * len(good) + 40, True)]
    assert {bytes(r.payload) for r in got if r.payload} == {body} and got[1].record_type is None


def foreign(kind, block, *head):
    return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("how", ["plain", "members", "one member"])
def test_warc_of_other_writers(how):
    body, http = b"<p>page</p>", "Content-Type: application/http; msgtype=response"
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    sha1 = hashlib.sha1(body).digest()
    b32 = base64.b32encode(sha1).decode()
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    good = [
        foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        foreign("response", block + body, http, f"WARC-Payload-Digest: sha1:{b32}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block + body).digest()).decode()}"),
        foreign("response", block + body, http, f"WARC-Payload-Digest: sha1:{sha1.hex()}"), foreign("response", block + body, http), foreign("response", block + body, http, "WARC-Payload-Digest: blake9:zz"),
        foreign("response", chunked + b"b\r\n" + body + b"\r\n0\r\n\r\n", http, f"WARC-Payload-Digest: sha1:{b32}"),
        foreign("response", b"dns a 1.2.3.4", "Content-Type: text/dns", "X-Page-ID: none"), foreign("resource", b"bytes", "WARC-Payload-Digest: md5:" + hashlib.md5(b"bytes").hexdigest()),
        foreign("metadata", b""), foreign("conversion", b"text"), foreign("revisit", b"", f"WARC-Payload-Digest: sha1:{b32}"), foreign("new-type", b"z"),
    ]
    bad = [foreign("response", block + body + b"!", http, f"WARC-Payload-Digest: sha1:{b32}"), foreign("metadata", b"x", "WARC-Block-Digest: sha1:AAAA")]
    whole = [good[0], bad[0], *good[1:], bad[1]]
    data = b"".join(whole) if how == "plain" else warc.member(b"".join(whole)) if how == "one member" else b"".join(map(warc.member, whole))
    got = list(warc.salvage(data))
    kinds = ["warcinfo", "request", "response", "response", "response", "response", "response", "response", "resource", "metadata", "conversion", "revisit", "new-type"]
    assert [r["record_type"] for r in got if "fault" not in r] == kinds
    assert [r["fault"] for r in got if "fault" in r] == ["payload and digest differ", "block and digest differ"]
    pages = [r for r in got if "fault" not in r]
    assert [r["payload"] for r in pages[2:6]] == [body] * 4 and pages[7]["payload"] == b"dns a 1.2.3.4" and pages[11]["payload"] is None
    assert {r["payload_digest"] for r in pages[2:6]} == {hashlib.sha256(body).hexdigest()} and pages[11]["payload_digest"] == f"sha1:{b32}"


def test_language_id(spark, none):
    rng = random.Random(1)
    sounds = {"aa": ["the", "ing", "and", "sh"], "bb": ["eau", "que", "les", "é"], "cc": ["sch", "ung", "ü", "ein"], "dd": ["ción", "ar", "os", "ñ"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[g], k=2)) for _ in range(rng.randint(5, 60))), g) for i in range(400) for g in [list(sounds)[i % 4]]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !!", "bb"), (1003, "the ing and", None), (None, "the", "bb"), (0, rows[0][1], "aa")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", langid.held_out())
    model = langid.train(d.where("NOT held_out"))
    got = langid.identify(d, model).collect()
    held = [r for r in got if r.held_out and r.lang and r.text and r.doc_id < 1000]
    assert len(held) > 50 and sum(r.lang_id.lang == r.lang for r in held) >= 0.97 * len(held)
    assert {r.lang_id.lang for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert all(0 <= r.lang_id.score <= 1 for r in got)
    assert langid.identify(d, langid.train(none)).where("lang_id.lang <> 'und'").count() == 0
    assert {r.lang_id.lang for r in langid.identify(d, langid.train(d.where("lang = 'aa'"))).collect()} == {"aa", "und"}


def test_language_id_of_a_bounded_sample(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["shing", "thand", "other"] if i % 3 else ["eauque", "lesdes", "nous"]) for _ in range(9)), "aa" if i % 3 else "bb") for i in range(3000)]
    d = spark.createDataFrame([*rows, *rows[:9]], "doc_id long, text string, lang string")
    for sample, most in ((20, 4800), (400, 40)):
        model = langid.train(d, sample, most)
        got = langid.identify(d.withColumn("lang_id", F.lit(1)), model).collect()
        assert all(r.lang_id.lang == r.lang for r in got) and len(got) == 3009


def test_language_id_by_hand(spark):
    """The decoder against a plain version of it."""
    rng = np.random.default_rng(3)
    langs = ["a", "b", "c", "d"]
    m = langid.Model(langs, rng.normal(size=(langid.DIM, 7)).astype(np.float32), rng.normal(size=7), np.abs(rng.normal(size=7)), np.abs(rng.normal(size=7)))
    for text in ("one two", "Ünd so weiter", "xyz " * 500, "ß"):
        margin = [(float(langid.features(text) @ m.weights[:, b]) + m.bias[b]) * m.scale[b] for b in range(7)]
        loss = [sum(m.trust[b] * np.log1p(np.exp(-2 * langid.codewords(4)[i][b] * margin[b])) for b in range(7)) for i in range(4)]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        lang, score, ambiguous = m.predict(text)
        assert lang == langs[int(p.argmax())] and score == pytest.approx(p.max(), rel=1e-4) and ambiguous == bool(np.sort(p)[-2] >= langid.CLOSE * p.max())


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 30):
        c = langid.codewords(n).astype(int)
        assert min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i)) >= 1 + (n > 2)


def test_mixing(docs, rows, none):
    got = mixing.mix_plan(docs).collect()
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    assert {r.doc_id: r["size"] for r in got} == size
    for s in ("s1", "s2", None):
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target) and own[0].source_size == sum(r["size"] for r in own)
        assert own[0].target <= 3 * own[0].source_size
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, mixing.mix_plan(docs.repartition(2)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix_plan(none).count() == 0 and mixing.mixed(none).count() == 0
    assert set(mixing.mixed(docs).columns) == set(docs.columns)


def test_stages_tell_null_and_shared_ids_apart(spark):
    same, near = " ".join(f"w{i}" for i in range(60)), " ".join([*(f"w{i}" for i in range(59)), "other"])
    rows = [(1, same, "a"), (2, near, "a"), (2, "q r s t u v", "a"), (None, near, "a"), (None, "k l m n o p", None), (7, "one two three four five", None), (7, "one two three four five", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = ngram_join.keep_first(d)
    assert kept.columns == d.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[2], rows[4], rows[5]], key=repr)
    rows = [(None, "a b c d", "s"), (None, "e f g h", "s"), (3, "i j k l", "s"), (3, "m n o p", "s"), (3, "m n o p", "s"), (None, None, "s")]
    got = sorted(map(tuple, mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()), key=repr)
    assert got == sorted(rows[:5], key=repr)  # one source: each document once


def test_water_filling(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 5)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(s).collect()}
    assert t["a"] == 30 and t["c"] == 300 and t[None] == 15 and t["b"] == pytest.approx(1115 - 345)


def test_fingerprints(docs, rows, none):
    got = {r.doc_id: r for r in fingerprints.with_next(docs).collect()}
    order = sorted((r[0] for r in rows), reverse=True)
    text = {r[0]: r[1] or "" for r in rows}
    for d, n in zip(order, order[1:] + order[:1], strict=True):
        r, k = got[d], len(text[d]) // 2
        e = text[d][: len(text[d]) - k] + text[n][:k]
        assert (r.n_chars, r.edited_sha256) == (len(text[d]), hashlib.sha256(e.encode()).hexdigest())
        x, y, z = shingles(text[d]), shingles(e), shingles(text[n])
        for value, other in ((r.near_edited, y), (r.near_next, z)):
            assert abs(value - (len(x & other) / len(x | other) if x or other else 1.0)) < 0.13
    assert got[103].fingerprint == got[104].fingerprint == got[105].fingerprint and got[101].fingerprint == ""
    assert fingerprints.with_next(none).count() == 0


def test_fingerprints_of_one_and_of_null_ids(spark):
    one = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert fingerprints.with_next(one).first().near_next == 1.0
    more = spark.createDataFrame([(None, "x y"), (None, "x z"), (4, "a b"), (4, "a c")], "doc_id long, text string")
    assert fingerprints.with_next(more).count() == 4
    p = fingerprints.sketch("a b c d e f g h")
    assert (fingerprints.unpack(fingerprints.pack(p)) == p).all()


def test_bpe(docs, rows, none):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path()).collect()}
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        assert list(got[r[0]].ids) == ids and got[r[0]].decoded == t.decode(ids, skip_special_tokens=False)
    trip = {r.doc_id: r for r in bpe.round_trip(docs, tokenizer_path()).collect()}
    assert all(trip[d].n_tokens == len(r.ids) for d, r in got.items())
    assert bpe.round_trip(none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_on_random_strings(name):
    tokenizers = pytest.importorskip("tokenizers")
    t, e = tokenizers.Tokenizer.from_file(tokenizer_path(name)), bpe.Encoder(open(tokenizer_path(name), "rb").read())
    rng = random.Random(2)
    letters = "aábßΣςİ 's'tdonll've12³½\t\n\x1c\x85　<|endoftext|>ÀÀ中文😀.,!?"
    for _ in range(1500):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        ids = t.encode(s, add_special_tokens=False).ids
        assert e.encode(s) == ids and e.decode(ids).decode("utf-8", "replace") == t.decode(ids, skip_special_tokens=False)


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[50:80] = x[0]  # copies: ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5100, [0.0] * 16, 1), (5200, [float("nan")] * 16, 1), (5300, [1.0, 2.0], 1), (None, x[3].tolist(), 1), (2, x[2].tolist(), 1)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(4), F.col("vec_id") % 100 == 0).toPandas()
    y = x.astype(np.float64)
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and np.allclose(g.score, d[g.vec_id])
        hits += len(set(want) & set(g.vec_id))
    assert got.query_id.nunique() == 30 and hits >= 0.9 * 300
    assert list(got[got.query_id == 0].sort_values("rank").vec_id) == list(range(50, 60))
    few = ann.search(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>, rank int"), F.col("vec_id") == 0)
    assert few.count() == 3
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_ann_reads_little_of_clustered_vectors(spark):
    """Work for a query grows slower than the rows, and the neighbours are found."""
    rng, share = np.random.default_rng(5), []
    for n in (3000, 12000):
        x = (rng.normal(size=(n // 30, 24))[rng.integers(0, n // 30, n)] * 4 + rng.normal(size=(n, 24)) * 0.3).astype(np.float32)
        got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, block=32).toPandas()
        y, hits = x.astype(np.float64), 0
        for q, g in got.groupby("query_id"):
            d = ((y - y[q]) ** 2).sum(1)
            d[q] = np.inf
            hits += len(set(np.argsort(d, kind="stable")[:10]) & set(g.vec_id))
        assert hits >= 0.9 * 10 * (n // 100)
        share.append(got.groupby("query_id").compared.first().mean() / n)
    assert share[1] < share[0] / 2


def test_hilbert_visits_neighbours():
    grid = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    place = ann.hilbert(grid, 3)
    path = grid[np.argsort(place)]
    assert sorted(place) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


class Plain:
    """Pseudonyms in plain Python, forwards and backwards, from the description of the network."""

    def __init__(self, key, back=False):
        self.key, self.rounds, self.sign = key, range(7, -1, -1) if back else range(8), -1 if back else 1

    def number(self, *parts):
        return int(hashlib.sha256(":".join(map(str, (self.key, *parts))).encode()).hexdigest()[:10], 16)

    def pair(self, x, y, sizes, kind):
        for i in self.rounds:
            if i % 2 == 0:
                x = (x + self.sign * self.number(kind, i, y)) % sizes[0]
            else:
                y = (y + self.sign * self.number(kind, i, x)) % sizes[1]
        return x, y

    def string(self, s, kind, hexadecimal=False):
        kinds = ("0123456789", "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz", "ABCDEF" if hexadecimal else "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        half = [s[: len(s) // 2], s[len(s) // 2 :]]
        for i in self.rounds:
            part, other = half[i % 2], half[1 - i % 2]
            other = hashlib.sha256(other.encode()).hexdigest() if len(other) > 256 else other
            out = ""
            for k, c in enumerate(part, 1):
                a = next((a for a in kinds if c in a), c)
                out += a[(a.index(c) + self.sign * self.number(kind, i, k, other)) % len(a)]
            half[i % 2] = out
        return "".join(half)

    def refill(self, form, new):
        new = iter(new)
        return "".join(next(new) if c.isalnum() else c for c in form)

    def card(self, m):
        body = self.string(re.sub(r"\D", "", m)[:-1], "card")
        return self.refill(m, body + next(c for c in "0123456789" if luhn(body + c)))

    def iban(self, m):
        p = m.replace(" ", "")
        body = self.string(p[4:], "iban")
        n = int("".join(str(int(c, 36)) for c in body + p[:2] + "00"))
        return self.refill(m, f"{p[:2]}{98 - n % 97:02d}{body}")

    def ssn(self, m):
        a, g, s = map(int, m.split("-"))
        areas = [x for x in range(1, 900) if x != 666]
        x, y = self.pair(areas.index(a), (g - 1) * 9999 + s - 1, (898, 99 * 9999), "ssn")
        return f"{areas[x]:03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"

    def ip(self, m):
        o = list(map(int, m.split(".")))
        x, y = self.pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "ip")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"

    def date(self, m):
        form = "%Y-%m-%d" if "-" in m else "%d.%m.%Y" if "." in m else "%m/%d/%Y"
        first = datetime.date(1900, 1, 1)
        n = (datetime.datetime.strptime(m, form).date() - first).days
        x, y = self.pair(n // 773, n % 773, (189, 773), "date")
        return (first + datetime.timedelta(x * 773 + y)).strftime(form)

    def email(self, m):
        local, _, host = m.partition("@")
        return f"{self.string(local, 'email')}@{host}"

    def phone(self, m):
        local = re.search(r"\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}$", m)[0]
        return m.removesuffix(local) + self.refill(local, self.string(re.sub(r"\D", "", local), "phone"))

    def secret(self, m):
        return self.string(m, "secret", bool(re.fullmatch("[0-9a-f]{16,}|[0-9A-F]{16,}", m)))


def sample_of(kind, rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "card":
        body = digits(rng.choice([14, 15]))
        whole = body + next(c for c in "0123456789" if luhn(body + c))
        return f"{whole[:4]} {whole[4:10]} {whole[10:]}" if len(whole) == 15 else rng.choice([whole, "-".join(whole[i : i + 4] for i in (0, 4, 8, 12))])
    if kind == "iban":
        country, body = rng.choice(["DE", "GB", "FR"]), digits(4) + "".join(rng.choice("ABCXYZ0123456789") for _ in range(rng.randint(10, 20)))
        whole = f"{country}{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}{body}"
        return whole if rng.random() < 0.5 or len(whole) % 4 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))
    if kind == "ssn":
        return f"{rng.choice([1, 665, 667, 899, 123]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "date":
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(146097))
        return day.strftime(rng.choice(["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"]))
    if kind == "email":
        return "".join(rng.choice("abcXYZ019._") for _ in range(rng.randint(1, 9))) + "@mail.example.org"
    if kind == "phone":
        return rng.choice([f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
    return "".join(rng.choice(rng.choice(["0123456789abcdef", "abcXYZ012+/_-"])) for _ in range(rng.choice([16, 40, 700])))


def test_pii_against_a_plain_version_and_back(spark):
    rng = random.Random(11)
    rows = [(i, kind, sample_of(kind, rng)) for i, kind in enumerate(list(pii.MASKS) * 12)]
    d = spark.createDataFrame(rows, "doc_id long, kind string, value string")
    d = d.withColumn("text", F.concat(F.when(F.col("kind") == "secret", "x token=").otherwise("x "), "value", F.lit(" y")))
    forward, back = Plain("k"), Plain("k", back=True)
    for r in pii.pseudonyms(d, "k").collect():
        new = r.text.removeprefix("x token=").removeprefix("x ").removesuffix(" y")
        assert (r.kind, new) == (r.kind, getattr(forward, r.kind)(r.value))
        assert getattr(back, r.kind)(new) == r.value
        assert {k: r[f"n_{k}"] for k in pii.MASKS} == {k: int(k == r.kind) for k in pii.MASKS}


def test_pii_of_hostile_texts_and_clashing_columns(spark):
    texts = ["x@" + "b." * 500_000, "x@" + "bb." * 300_000 + "com", "1" * 1_000_000, "a@" * 300_000, "1-" * 400_000, "GB" + "12 " * 300_000, "token=" * 150_000, "(123) " * 150_000, "GB82 WEST 1234 5698 7654 33", "000-12-3456 666-12-3456 900-12-3456 123-00-4567"]
    d = spark.createDataFrame([(i, t, 5, 6, 7) for i, t in enumerate(texts)], ["doc_id", "text", "n_card", "found", "a.b"])
    got = sorted(pii.pseudonyms(d, "k").collect(), key=lambda r: r.doc_id)
    assert [len(r.text) for r in got] == [len(t) for t in texts] and [r["a.b"] for r in got] == [7] * len(texts) and {r.found for r in got} == {6}
    assert [r.text for r in got if r.doc_id != 1] == [t for i, t in enumerate(texts) if i != 1] and got[1].n_email == 1 and not got[1].text.startswith("x@")
    assert got[0].__fields__.count("n_card") == 1 and {r.n_card for r in got} == {0}
