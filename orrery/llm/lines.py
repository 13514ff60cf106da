"""Line deduplication against levelled sorted runs of line hashes.

Documents are taken in batches in order of doc_id. A batch's distinct line hashes, sorted, are merge-anti-joined with
every run that exists; the hashes that no run holds become a run of level 0. When a level holds `fan` runs, they are
merged into one run of the next level. Runs and batches are tables bucketed and sorted by hash, a file a bucket: bucket k
of a batch meets bucket k of each run in one task, as two sorted streams, without an exchange or a sort of the
history. A hash's owner is the smallest doc_id that has it: as batches come in that order, the first run that gets a
hash holds its owner. Runs can be kept for batches that come later (see Runs).
"""

from __future__ import annotations

from functools import reduce

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Workspace, map_rows

STRIP = b" \t\n\x0b\x0c\r"
#: A row without doc_id counts as the last document.
LAST = (1 << 63) - 1
#: Names beside the input's own columns.
_DOC, _LOST, _N, _DROPPED, _KEPT = (f"__orrery_{x}" for x in ("doc", "lost", "n", "dropped", "kept"))
#: Documents of a batch at most, and batches at least.
BATCH_DOCS, BATCHES = 1 << 28, 2
_HASH = ["h1", "h2"]


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each \n-split line: ends stripped of [\\x20\\x09-\\x0D], A-Z lower-cased; None if too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(STRIP).lower()
        # fewer bytes than code points asked for are surely too few; ASCII bytes are code points
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        out.append(key if long else None)
    return out


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return (a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b)


def hashed_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc, h1, h2): a row for each distinct key of each row of docs. 128-bit hashes stand for the keys."""

    def make():
        def fn(cols):
            doc, a, b = [], [], []
            for i, t in zip(*cols, strict=True):
                for h in {_hash(k) for k in line_keys(t, min_chars) if k is not None}:
                    doc.append(i)
                    a.append(h[0])
                    b.append(h[1])
                    if len(doc) >= 100_000:
                        yield [doc, a, b]
                        doc, a, b = [], [], []
            yield [doc, a, b]

        return fn

    return map_rows(docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text"), make, "doc bigint, h1 bigint, h2 bigint")


class Runs:
    """The levels: lists of runs (h1, h2, owner), no hash in two of them.

    They belong to a workspace and live as long as it. A caller that keeps the object and passes it on with documents
    that come later has these lose what earlier documents have.
    """

    def __init__(self, ws: Workspace, fan: int = 2):
        self.ws, self.fan, self.levels = ws, fan, [[]]

    def all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def unknown(self, keys: DataFrame) -> DataFrame:
        """The rows of a bucketed table whose hash no run holds: one merge-anti-join a run."""
        for r in self.all():
            keys = keys.join(r.hint("merge"), _HASH, "left_anti")
        return keys

    def held(self, keys: DataFrame) -> list[DataFrame]:
        """For each run its rows (h1, h2, owner) of the hashes in keys."""
        return [r.join(keys.select(*_HASH).hint("merge"), _HASH, "left_semi").select(*_HASH, "owner") for r in self.all()]

    def add(self, keys: DataFrame) -> None:
        """keys (h1, h2, owner; more columns may follow) that no run holds. A table that is bucketed already is the run."""
        self.levels[0].append(keys if hasattr(keys, "_orrery_table") else self.ws.save_bucketed(keys, _HASH, "run"))
        at = 0
        while len(self.levels[at]) >= self.fan:
            if at + 1 == len(self.levels):
                self.levels.append([])
            old, self.levels[at] = self.levels[at], []
            self.levels[at + 1].append(self.ws.save_bucketed(reduce(merged, old), _HASH, "run", aligned=len(old) == 2))
            self.ws.drop(*old)
            at += 1

    def drop(self) -> None:
        self.ws.drop(*self.all())
        self.levels = [[]]


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sorted runs as one: an outer merge, as no hash is in both."""
    return a.select(*_HASH, "owner").hint("merge").join(b.select(*_HASH, F.col("owner").alias("_other")), _HASH, "full").select(*_HASH, F.coalesce("owner", "_other").alias("owner"))


def _cuts(docs: DataFrame, batches: int | None) -> list[int]:
    """Upper bounds of doc_id for batches of about as many documents each; the last batch has none."""
    ids = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("i"))
    if batches is None:
        batches = max(BATCHES, -(-ids.count() // BATCH_DOCS))
    if batches < 2:
        return []
    shares = ",".join(str((i + 1) / batches) for i in range(batches - 1))
    return sorted(set(ids.agg(F.expr(f"percentile_approx(i, array({shares}), 10000)")).first()[0] or []))


def repeated_lines(runs: Runs, docs: DataFrame, min_chars: int = 10, batches: int | None = None) -> DataFrame:
    """(doc, h1, h2): the hashes that document `doc` loses, as an earlier one has them. All batches' hashes, the last
    one's too, are in the runs afterwards."""
    ws, cuts = runs.ws, _cuts(docs, batches)
    batch_of = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc"))) if cuts else F.lit(0)
    # written by batch: a batch reads its own lines only
    lines = ws.save(hashed_lines(docs, min_chars).withColumn("batch", batch_of), "lines", partition_by="batch")
    lost = []
    for k in range(len(cuts) + 1):
        batch = lines.where(F.col("batch") == k).select("doc", *_HASH)
        keys = ws.save_bucketed(batch.groupBy(*_HASH).agg(F.min("doc").alias("owner"), F.max("doc").alias("last")), _HASH, "keys")
        new = ws.save_bucketed(runs.unknown(keys), _HASH, "new", aligned=True)
        repeated = ws.save(reduce(DataFrame.union, [new.where("owner < last").select(*_HASH, "owner"), *runs.held(keys)]), "repeated")
        # both sides are plain exchanges: a line that a third of all documents have is split at run time
        lost.append(ws.save(batch.join(repeated, _HASH).where("doc <> owner").select("doc", *_HASH), "lost"))
        runs.add(new)
        ws.drop(keys, repeated)
    ws.drop(lines)
    return reduce(DataFrame.union, lost)


def _without_repeats(docs: DataFrame, min_chars: int, batches: int | None, fan: int, runs: Runs | None) -> DataFrame:
    """docs with all its columns, and the counts and text left under names of ours."""
    ws = Workspace(docs.sparkSession)
    own = runs or Runs(ws, fan)
    lost = repeated_lines(own, docs, min_chars, batches)
    if runs is None:
        own.drop()
    lost = lost.groupBy(F.col("doc").alias(_DOC)).agg(F.collect_set(F.struct(*_HASH)).alias(_LOST))
    with_lost = docs.join(lost, F.coalesce(docs["doc_id"], F.lit(LAST)) == lost[_DOC], "left").drop(_DOC)
    names = docs.columns
    at, text = len(names), names.index("text")

    def make():
        def fn(cols):
            n, dropped, kept = [], [], []
            for t, gone in zip(cols[text], cols[at], strict=True):
                lines, out = (t or "").split("\n"), t or ""
                drop = 0
                if gone:
                    hashes = {(g["h1"], g["h2"]) for g in gone}
                    left = [x for x, k in zip(lines, line_keys(t, min_chars), strict=True) if k is None or _hash(k) not in hashes]
                    drop, out = len(lines) - len(left), "\n".join(left)
                n.append(len(lines))
                dropped.append(drop)
                kept.append(out)
            yield [*cols[:at], n, dropped, kept]

        return fn

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_rows(with_lost.select(*names, _LOST), make, f"{schema}, {_N} bigint, {_DROPPED} bigint, {_KEPT} string")


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fan: int = 2, runs: Runs | None = None) -> DataFrame:
    """docs (doc_id, text, others) -> all its columns, and _n_lines, _n_dropped, _kept.

    _kept is the text without lines whose key (>= min_chars code points) a document with a smaller doc_id, or one of
    an earlier call with the same runs, has. Null text is one empty line and stays null in `text`; rows with one
    doc_id are one document, rows without doc_id together the last one; input columns named like the added ones
    are replaced. An empty table gives an empty one. batches: None takes two, or more so that none has over
    BATCH_DOCS documents.
    """
    out = _without_repeats(docs, min_chars, batches, fan, runs)
    added = {"_n_lines": _N, "_n_dropped": _DROPPED, "_kept": _KEPT}
    return out.select(*[c for c in docs.columns if c not in added], *[F.col(x).alias(c) for c, x in added.items()])


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns, a row per row of docs; nulls, ties and empty tables as in dedup_lines."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.encode("_kept", "UTF-8"), 256).alias("kept_sha256"))


def clean(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out of text, and n_chars (where there is one) counted anew. Null text stays null;
    ties and repeated rows as in dedup_lines; every other column stays as it is, whatever its name."""
    out = _without_repeats(docs, 10, None, 2, None)
    text = F.when(F.col("text").isNotNull(), F.col(_KEPT))
    new = {"text": text, "n_chars": F.length(text)}
    return out.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col(f"`{f.name}`") for f in docs.schema])
