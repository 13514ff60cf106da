"""Source divergence, web archives and importance resampling against brute force, and their edge cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orrery.llm import divergence, resample, warc
from tests.llm.test_operators import DOC, docs, odd  # noqa: F401

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows: list[tuple], least: int, top: int) -> set[tuple]:
    """The contract word by word: rows are (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(_LOWER)), la, so) for t, la, so in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        docs_of, all_n, by = Counter(), Counter(), {s: Counter() for _, la, s in rows if la == lang}
        for words, la, so in found:
            if la == lang:
                docs_of.update(set(words))
                all_n.update(words)
                by[so].update(words)
        kept = [w for w, k in docs_of.items() if k >= least]
        p = lambda n, every: 1 + 10**9 * (n + 2) // (every + 2 * len(kept))  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // (a + b)
        probs = {s: {w: p(c[w], sum(c[k] for k in kept)) for w in kept} for s, c in by.items()}
        q = {w: p(all_n[w], sum(all_n[k] for k in kept)) for w in kept}
        for s in by:
            pairs = sorted((-sum(f(probs[s][w], probs[o][w]) for w in kept), o.encode(), o) for o in by if o != s)
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            best = sorted((-f(probs[s][w], q[w]), w.encode(), w) for w in kept if by[s][w] and probs[s][w] > q[w])[:top]
            out |= {(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(best)}
    return out


@pytest.mark.parametrize("bucket", [None, "one", "thirds"])
def test_divergence(spark, monkeypatch, bucket):
    """Null and empty columns, a lonely source, a language without kept terms, ties, more sources than a tile, and any
    cut into buckets: the bounds alone decide what is evaluated."""
    if bucket:
        monkeypatch.setattr(divergence, "bucket", lambda n: F.lit(0) if bucket == "one" else (n % 3).cast("int"))
        monkeypatch.setattr(divergence, "TILE", 3)
        monkeypatch.setattr(divergence, "TERMS", 8)
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "aeiouäßЖ" for b in ("n", "Rst", "xx", "y", "zé")]
    rows = [(" ".join(rng.choices(vocabulary[: 10 + 3 * (i % 10)], k=rng.randint(0, 40))) + ("\x00 1 A_b" if i % 7 == 0 else ""), ("en", "de", None)[i % 3], f"s{i % 10}" if i % 11 else None) for i in range(400)]
    rows += [(None, None, None), ("", "", ""), ("lonely words " * 3, "xx", "only"), (None, "yy", "a"), ("rare", "yy", "b"), ("same same", "zz", "a"), ("same same", "zz", "a"), ("same", "zz", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("n", F.lit("x")).withColumn("bucket", F.lit(1)).withColumn("term", F.lit(None))
    for least, top in ((2, 10), (1, 3)):
        got = divergence.audit(df, least, top).collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == audited(rows, least, top)
    assert divergence.audit(df.limit(0)).collect() == []


def test_bounded_search_leaves_buckets_unseen(spark):
    """One bucket of great values and many of small: only the first buckets are evaluated."""
    rows = [("top " * 500 + " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)} " * (1 + k % 40) for k in range(600)), "en", "a")] + [("x", "en", "b"), (" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)), "en", "b")]
    a = divergence.Audit(spark.createDataFrame(rows, "text string, lang string, source string"), 1)
    seen, distance = [], divergence.distance
    try:
        divergence.distance = lambda p, q: seen.append(1) or distance(p, q)
        found = divergence.standing_out(a, 1).where("source = 'a'").collect()
    finally:
        divergence.distance = distance
    assert [r["item"] for r in found] == ["top"] and len(seen) <= 3  # the bounds and one or two rounds


def plain_resample(rows: list[tuple], target: list[str | None], percent: int = 25) -> list[tuple]:
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))
        return w, [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    mine = [(i, *feats(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in mine for b in f), Counter(b for x in target for b in feats(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000.0) / ((s[b] + 1.0) * (all_t + 10_000.0))))
    out = []
    for i, w, f in mine:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    drawn = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for k, r in enumerate(drawn[: len(drawn) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_resampling(spark, odd, docs):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    rows += [(i, f"Word{i % 5} und GRÜSSE {i} " * (i % 30)) for i in range(20, 140)] + [(20, "twice " * 30), (None, "no id " * 15), (None, "no id " * 15)]
    target = [None, "", "word1 und grÜsse 21 word1", "common1 common2 aaa aaa"]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_words", F.lit("x")).withColumn("score", F.lit(1)).withColumn("docs", F.lit(None))
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for percent, block in ((25, 1 << 17), (100, 50)):
        resample.BLOCK, old = block, resample.BLOCK
        try:
            got = [tuple(r) for r in resample.resample(frame, aim, percent).collect()]
        finally:
            resample.BLOCK = old
        assert sorted(got, key=key) == sorted(plain_resample(rows, target, percent), key=key)
    none = aim.limit(0)
    assert sorted((tuple(r) for r in resample.resample(frame, none).collect()), key=key) == sorted(plain_resample(rows, []), key=key)
    assert resample.resample(frame.limit(0), aim).collect() == []


def test_blocks_are_the_matrix(spark, docs):  # noqa: F811
    """Every row's entries come back from the blocks, and columns add up."""
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    blocks = resample.matrix(docs, F.col("doc_id"))
    seen, total = set(), Counter()
    for b in blocks.collect():
        assert b["starts"][0] == 0 and b["starts"][-1] == len(b["buckets"]) == len(b["counts"])
        for k, i in enumerate(b["docs"]):
            part = slice(b["starts"][k], b["starts"][k + 1])
            want = Counter(resample.features(resample.words(texts[i])).tolist())
            assert dict(zip(b["buckets"][part], b["counts"][part])) == want
            seen.add(i)
            total.update(want)
    assert seen == set(texts)
    assert {r["bucket"]: r["n"] for r in resample.column_sums(blocks).collect()} == total


PAGES = "page_id bigint, url string, html string"


def test_archives(spark, tmp_path):
    """Equal, empty, null and very long payloads, repeated rows, pages without id or url, marks of the format in texts."""
    evil = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/", "same é"), (5, "http://b/ x\r\nWARC-Type: no", "same é"), (3, None, "same é"), (None, "http://n/", "same é"), (7, "http://c/", None), (8, "", ""), (9, "http://d/", evil), (9, "http://d/", evil), (4, "u", evil), (None, None, "alone"), (None, None, "alone"), (10, "http://l/", "long \x00" * 900_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit(1)).withColumn("revisit", F.lit("x")).withColumn("response", F.lit(None))
    best = {}
    for i, _, html in rows:
        best[html or ""] = max((x for x in (best.get(html or ""), i) if x is not None), default=None)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(i, len((t or "").encode()), sha(t or ""), "response" if i == best[t or ""] else "revisit", None if i == best[t or ""] else best[t or ""]) for i, _, t in rows]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in warc.digest(pages).collect()), key=key) == sorted(want, key=key)
    assert warc.digest(pages.limit(0)).collect() == []
    # whole texts come back, revisits by their response
    index, folder = warc.archive(pages)
    back = warc.resolved(warc.read(index, folder)).collect()
    assert Counter((r["page_id"], bytes(r["payload"]).decode()) for r in back) == Counter((i, t or "") for i, _, t in rows)
    # part of an index reads part of the records, and the sidecar says the same as the index
    some = index.orderBy("name", "offset").limit(3)
    assert warc.read(some, folder).count() == 3
    lines = spark.read.text(f"{folder}/*.cdxj").count()
    assert lines == len(rows) == index.count()
    # no payload is short enough to be told apart
    assert warc.write(pages, f"file://{tmp_path}/all", least=1 << 30).agg(F.sum("records")).first()[0] == len(rows)


def test_small_archives_and_large_ones_hold_the_same(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for k, size in enumerate((1, 20_000, 1 << 30)):
        raw, done = f"file://{tmp_path}/raw{k}", f"file://{tmp_path}/done{k}"
        manifest = spark.createDataFrame(warc.write(pages, raw, archive=size).collect(), warc.MANIFEST)
        index = spark.createDataFrame(warc.normalise(manifest, raw, done).collect(), warc.INDEX)
        got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.resolved(warc.read(index, done)).collect()}
        assert got == {r["page_id"]: r["html"] for r in pages.collect()}
        assert (manifest.count() == pages.count()) == (k == 0)


@pytest.mark.parametrize("form", ["stream", "members", "plain", "padded"])
def test_normaliser(form, monkeypatch):
    """One gzip stream, a member a record, no compression, padding between members: the same members come out, each of
    which inflates by itself; pieces of seven bytes cut everywhere."""
    monkeypatch.setattr(warc, "PIECE", 7)
    made = [b"".join(warc.record(i, f"http://h/{i}", b"\r\n\r\n" * i + b"x" * 50 * i, None, False, "2001-01-01T00:00:00Z")) + b"\r\n\r\n" for i in range(9)]
    data = {"stream": gzip.compress(b"".join(made)), "members": b"".join(map(gzip.compress, made)), "plain": b"".join(made), "padded": b"\0\0\0".join(map(gzip.compress, made)) + b"\0" * 20}[form]
    out = io.BytesIO()
    members = list(warc.rewrite(io.BytesIO(data), out))
    assert [gzip.decompress(out.getvalue()[at : at + n]) for _, at, n in members] == made
    assert [warc.unpack(out.getvalue()[at : at + n])[:5] for _, at, n in members] == [(i, f"http://h/{i}", "response", None, 54 * i) for i in range(9)]
    for cut in (len(data) - 30, len(data) // 2):
        if form != "padded":
            with pytest.raises((EOFError, KeyError)):
                list(warc.rewrite(io.BytesIO(data[:cut]), io.BytesIO()))


def test_damaged_payloads_are_told():
    head, block = warc.record(1, "u", b"abcdef", None, False, "2001-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warc.unpack(gzip.compress(head + block.replace(b"abc", b"abd")))
    assert warc.unpack(gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"))[2:5:2] == ("warcinfo", 2)


def test_matrix_blocks_are_small(spark, docs, tmp_path):  # noqa: F811
    """Readers and writers of the matrix hold row groups of a bounded size: a task's memory doesn't grow with its rows."""
    import pyarrow.parquet as pq

    from orrery.llm.common import Workspace

    many = docs.crossJoin(spark.range(40)).coalesce(1)
    saved = Workspace(spark).save(resample.matrix(many, F.col("doc_id")), "matrix", options=resample.ROW_GROUP)
    groups = [f.metadata.row_group(k) for p in saved.inputFiles() for f in [pq.ParquetFile(p.removeprefix("file://"))] for k in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 100 and all(g.num_rows <= 100 and g.total_byte_size < 32 << 20 for g in groups)
