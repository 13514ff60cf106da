"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the whole corpus, cut into blocks where its content says so: every window of 35 words has an
anchor, the 8-word phrase in it with the least hash, and a block holds the windows of one anchor. Blocks are
indexed by anchor and content hash, with two places where each stands (its first and its last). Where an anchor also
stands in other blocks, matches begin or end inside the block; there each window is indexed by its own hash in the
same way. A document is parsed from left to right against the index: at each place the candidate is taken that goes
on longest, that is, whose next blocks and windows stand at the same distance in the same reference document; the run
is a factor (place, length, reference document, reference place), and the next one starts behind its last window.
What no candidate covers is literal. Equal windows have equal anchors, so each window of a factor's length that stands
elsewhere is in a factor, and each factor is at least a window long; factors are the duplicate spans.

Hot passages: blocks and windows are counted with partial aggregation, and documents learn of their repeats by
joins whose sides are plain exchanges, which adaptive execution splits. Distinct blocks, not their occurrences,
are checked at factor boundaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Workspace, map_rows, small_batches

WINDOW, PHRASE = 35, 8
#: Words whose hashes one worker keeps between documents.
CACHE = 1_000_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _pair(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return _signed(h >> 64), _signed(h & 0xFFFFFFFFFFFFFFFF)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    size, m = 1, x
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (width - size)], m[width - size :]) if width > size else m


def blocks(words: list[bytes], hashes: dict, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor hash) of each block; windows are numbered by their first word."""
    n = len(words)
    if n < window:
        none = np.empty(0, np.int64)
        return none, none, none
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    g = np.zeros(n - phrase + 1, np.uint64)
    for i in range(phrase):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : n - phrase + 1 + i]
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    low = np.uint64((1 << 32) - 1)
    place = _least((g & ~low) | np.arange(len(g), dtype=np.uint64), window - phrase + 1) & low
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:] - 1, [len(place) - 1]))
    return first, last, g[place[first].astype(np.int64)].view(np.int64)


def _places(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words joined by one space, and where each begins (and, at the end, the length plus one)."""
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return joined, np.concatenate(([0], np.cumsum(size)))


def _text_key(text: str | None) -> int:
    return _signed(xxhash.xxh3_64_intdigest((text or "").encode()))


_KEY = "doc_id bigint, th bigint"


def _anchored(docs: DataFrame) -> DataFrame:
    def make():
        hashes = _Hashes()

        def fn(cols):
            out = [[] for _ in range(7)]
            for i, t in zip(*cols, strict=True):
                words = (t or "").encode().split()
                if len(words) < WINDOW:
                    continue
                a, b, kg = blocks(words, hashes)
                joined, at = _places(words)
                key = _text_key(t)
                lo, hi = at[a].tolist(), (at[b + WINDOW] - 1).tolist()
                pairs = [_pair(joined[x:y]) for x, y in zip(lo, hi, strict=True)]
                n = len(lo)
                for o, x in zip(out, ([i] * n, [key] * n, a.tolist(), b.tolist(), kg.tolist(), [p[0] for p in pairs], [p[1] for p in pairs]), strict=True):
                    o += x
                if len(out[0]) >= 100_000:
                    yield out
                    out = [[] for _ in range(7)]
            yield out

        return fn

    return map_rows(docs.select("doc_id", "text"), make, f"{_KEY}, a int, b int, kg bigint, h1 bigint, h2 bigint")


def _windows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, th, todo: blocks to check) -> a row for each window of these blocks."""

    def make():
        def fn(cols):
            out = [[] for _ in range(6)]
            for i, t, key, todo in zip(*cols, strict=True):
                joined, at = _places((t or "").encode().split())
                for block in todo:
                    for p in range(block["a"], block["b"] + 1):
                        h = _pair(joined[at[p] : at[p + WINDOW] - 1])
                        for o, x in zip(out, (i, key, p, block["n"] == 1, *h), strict=True):
                            o.append(x)
                if len(out[0]) >= 100_000:
                    yield out
                    out = [[] for _ in range(6)]
            yield out

        return fn

    return map_rows(docs.select("doc_id", "text", "th", "todo"), make, f"{_KEY}, a int, single boolean, h1 bigint, h2 bigint")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with th, the hash of the text: rows with one doc_id but other texts are told apart."""

    def make():
        def fn(cols):
            yield [*cols, [_text_key(t) for t in cols[1]]]

        return fn

    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, text string, th bigint")


def _with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    keyed = _keyed(docs)
    other = lists.withColumnRenamed("doc_id", "_i").withColumnRenamed("th", "_t")
    return keyed.join(other, keyed["doc_id"].eqNullSafe(other["_i"]) & (keyed["th"] == other["_t"]), how).drop("_i", "_t")


def _ends() -> list:
    """The first and the last place of equal blocks or windows."""
    place = F.struct("doc_id", "th", "a")
    return [F.min(place).alias("first"), F.max(place).alias("last")]


def factors(ws: Workspace, docs: DataFrame) -> DataFrame:
    """(doc_id, th, factors: array of (start, length, ref_id, ref_th, ref_start)), a row per text that has any: `length` words
    from word `start` on are those from ref_start on in the text of hash ref_th with doc_id ref_id. A text that only its
    own repeated row equals refers to that row, which has the same doc_id and text."""
    found = ws.save(_anchored(docs), "blocks")
    known = ws.save(found.groupBy("kg").count().where("count > 1").select("kg"), "anchors")
    seen = ws.save(found.join(known, "kg"), "seen")
    ws.drop(found, known)
    distinct = seen.groupBy("kg", "h1", "h2").agg(F.count("*").alias("n"), *_ends(), F.min(F.struct("doc_id", "th", "a", "b")).alias("at"))
    distinct = ws.save(distinct, "distinct")
    whole = seen.join(distinct.where("n > 1").select("kg", "h1", "h2", "first", "last"), ["kg", "h1", "h2"]).select("doc_id", "th", "a", "b", "first", "last")
    whole = ws.save(whole, "whole")
    ws.drop(seen)
    # factors end inside blocks whose anchor also stands in another block
    mixed = distinct.groupBy("kg").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 AND least = 1").select("kg")
    mixed = ws.save(mixed, "mixed")
    todo = distinct.join(mixed, "kg").select("at.*", "n").groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b", "n")).alias("todo"))
    todo = ws.save(todo, "todo")
    windows = ws.save(_windows(_with_lists(docs, todo, "inner")), "windows")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), *_ends()).where("n > 1")
    twice = ws.save(twice.select("h1", "h2", "first", "last"), "twice")
    parts = windows.where("single").join(twice, ["h1", "h2"]).select("doc_id", "th", "a", F.col("a").alias("b"), "first", "last")
    items = ws.save(whole.union(parts).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("a", "b", "first", "last"))).alias("items")), "items")
    ws.drop(whole, distinct, mixed, todo, windows, twice)
    parsed = ws.save(_parsed(items), "factors")
    ws.drop(items)
    return parsed


#: Stands for a null doc_id where numbers are compared.
NO_ID = -(1 << 63)


def parse(doc: tuple[int, int], a, b, id0, th0, id1, th1, w0, w1) -> tuple[np.ndarray, ...]:
    """Greedy factors of a document (a pair: doc_id and th). Items from left to right, without overlap: windows a..b also
    start at window w0 of text (id0, th0), their first place, and at w1 of (id1, th1), their last. Gives (first word,
    words, doc_id, th and first word of the reference) of each factor. Of two candidates that go on equally far the
    first place is taken."""
    n = len(a)
    # the place of the item itself is no candidate, unless its row is there twice
    own0 = (id0 == doc[0]) & (th0 == doc[1]) & (w0 == a)
    own1 = (id1 == doc[0]) & (th1 == doc[1]) & (w1 == a)
    refs = [tuple(np.where(own, x, y) for x, y in pairs) for own, pairs in ((own0, ((id1, id0), (th1, th0), (w1 - a, w0 - a))), (own1, ((id0, id1), (th0, th1), (w0 - a, w1 - a))))]
    near = a[1:] == b[:-1] + 1
    # goes[p][q]: candidate p of an item is candidate q of the next
    goes = [[(near & (f[0][:-1] == t[0][1:]) & (f[1][:-1] == t[1][1:]) & (f[2][:-1] == t[2][1:])).tolist() for t in refs] for f in refs]
    run = [[1] * n, [1] * n]
    for i in range(n - 2, -1, -1):
        for p in (0, 1):
            if goes[p][0][i]:
                run[p][i] = run[0][i + 1] + 1
            elif goes[p][1][i]:
                run[p][i] = run[1][i + 1] + 1
    first, kind, i = [], [], 0
    while i < n:
        p = int(run[1][i] > run[0][i])
        first.append(i)
        kind.append(p)
        i += run[p][i]
    at, which = np.array(first, np.int64), np.array(kind, bool)
    last = np.append(at[1:], n)[: len(at)] - 1
    ref = [np.where(which, y[at], x[at]) for x, y in zip(*refs, strict=True)]
    return a[at], b[last] - a[at] + WINDOW, ref[0], ref[1], a[at] + ref[2]


_FACTORS = "array<struct<start:bigint,length:bigint,ref_id:bigint,ref_th:bigint,ref_start:bigint>>"


def _parsed(items: DataFrame) -> DataFrame:
    """(doc_id, th, items) -> (doc_id, th, factors). Lists of numbers go to the workers and back as they lie in memory."""
    number = {"a": "a", "b": "b", "id0": "first.doc_id", "th0": "first.th", "id1": "last.doc_id", "th1": "last.th", "w0": "first.a", "w1": "last.a"}

    def column(path: str):
        def of(x):
            for name in path.split("."):
                x = x[name]
            return F.coalesce(x.cast("bigint"), F.lit(NO_ID)) if path.endswith("doc_id") else x.cast("bigint")

        return F.transform("items", of)

    rows = items.select("doc_id", "th", *[column(path).alias(name) for name, path in number.items()])
    factor = pa.struct([(k, pa.int64()) for k in ("start", "length", "ref_id", "ref_th", "ref_start")])
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("factors", pa.list_(factor))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(k + 2) for k in range(len(number))]
            ends = lists[0].offsets.to_numpy()
            flat = [x.values.to_numpy() for x in lists]
            got = []
            for k, (i, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                got.append(parse((NO_ID if i is None else i, key), *(x[ends[k] : ends[k + 1]] for x in flat)))
            whole = [np.concatenate([g[c] for g in got]) if got else np.empty(0, np.int64) for c in range(5)]
            values = [pa.array(x, pa.int64(), mask=(x == NO_ID) if c == 2 else None) for c, x in enumerate(whole)]
            sizes = np.concatenate(([0], np.cumsum([len(g[0]) for g in got]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(values, fields=list(factor)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed], schema=schema)

    small_batches(items.sparkSession)
    return rows.mapInArrow(run, f"{_KEY}, factors {_FACTORS}")


def covered(n: int, starts: list[int], lengths: list[int]) -> np.ndarray:
    """Which of n words the factors cover."""
    edge = np.zeros(n + 1, np.int64)
    a, size = np.array(starts, np.int64), np.array(lengths, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, a + size, -1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, others ignored) -> (doc_id, kept, n_words, n_removed, kept_sha256), a row per row.

    kept is the words left, joined by one space. Null text has no words. Rows are told apart by doc_id and text:
    a row that is there twice repeats itself wholly, and both lose all windows. Rows without doc_id are told apart
    by their text. An empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession)
    listed = _with_lists(docs, factors(ws, docs), "left")

    def make():
        def fn(cols):
            kept, n, gone, sha = [], [], [], []
            for t, starts, lengths in zip(*cols[1:], strict=True):
                words, removed = (t or "").encode().split(), 0
                n.append(len(words))
                if starts:
                    cut = covered(len(words), starts, lengths)
                    removed = int(cut.sum())
                    words = [w for w, c in zip(words, cut.tolist(), strict=True) if not c]
                text = b" ".join(words)
                kept.append(text.decode())
                gone.append(removed)
                sha.append(hashlib.sha256(text).hexdigest())
            yield [cols[0], kept, n, gone, sha]

        return fn

    starts, lengths = F.transform("factors", lambda f: f["start"]).alias("starts"), F.transform("factors", lambda f: f["length"]).alias("lengths")
    return map_rows(listed.select("doc_id", "text", starts, lengths), make, "doc_id bigint, kept string, n_words bigint, n_removed bigint, kept_sha256 string")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns; nulls, ties, repeated rows and empty tables as in remove_repeats."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
