"""Byte-level BPE over Arrow batches with the tokenizers library.

The rank file is turned into a vocabulary over the byte-to-character alphabet (each byte is one printable
character) and the merges that its ranks imply. Encoding gives ids with the character offsets of each token;
decoding maps ids back through the reversed byte table, so that a character split over several tokens comes
together again.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from orrery.llm.common import map_rows

#: Characters of text that the library is given at once.
PIECE = 50_000
#: Characters of pieces in one call for many texts. What the library makes of them, and lists of ids, take some 200 bytes a token.
CALL = 200_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last pair that merges to token when only lower ranks are used."""
    parts, top = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1))
        if rank >= top:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


#: The splitting pattern of the library's byte level, which the vocabulary's pattern must be (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """One vocabulary: encode whole texts, decode ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, alphabet = read_ranks(path), byte_alphabet()
        spell = lambda token: "".join(alphabet[b] for b in token)
        pairs = [m for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (m := _merge_of(t, ranks))]
        model = models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=[(spell(a), spell(b)) for a, b in pairs], ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in self.tokenizer.get_vocab().items()}
        self.size_of = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.size_of[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        self.decimal = {i: str(i) for i in self.bytes_of}

    @staticmethod
    def pieces(text: str) -> Iterator[str]:
        """The text cut where the splitting pattern never reaches across: before a space that follows a
        character which isn't white space."""
        at = 0
        while len(text) - at > PIECE:
            cut = at + PIECE
            while 0 < (cut := text.find(" ", cut)) and text[cut - 1].isspace():
                cut += 1
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        if at < len(text):
            yield text[at:] if at else text

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text or ""):
            out += self.tokenizer.encode(piece, add_special_tokens=False).ids
        return out

    def encode_many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text its ids (int32); the library gets about CALL characters of pieces at once, those of a long text in
        several calls."""
        waiting: list[tuple[str, bool]] = []  # pieces, and whether a piece ends its text
        size, whole = 0, []

        def flush() -> Iterator[np.ndarray]:
            nonlocal waiting, size
            part, waiting, size = waiting, [], 0
            for e, (_, last) in zip(self.tokenizer.encode_batch_fast([p for p, _ in part], add_special_tokens=False), part, strict=True):
                whole.append(np.array(e.ids, np.int32))
                if last:
                    yield whole[0] if len(whole) == 1 else np.concatenate(whole)
                    whole.clear()

        for t in texts:
            pieces = list(self.pieces(t or "")) or [""]
            for k, piece in enumerate(pieces, 1):
                waiting.append((piece, k == len(pieces)))
                size += len(piece)
                if size >= CALL:
                    yield from flush()
        if waiting:
            yield from flush()

    def offsets(self, text: str, ids: list[int] | np.ndarray) -> np.ndarray:
        """(start, end) of each token in code points of text, a row a token: tokens' bytes lie end to end, and bytes map
        to characters. Parts of a split character all have its place."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32) - 1
        ends = np.cumsum(self.size_of[np.asarray(ids, np.int64)])
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return np.stack([char_of[starts], char_of[ends - 1] + 1], 1).astype("<i4") if len(ends) else np.empty((0, 2), "<i4")

    def encode_with_offsets(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """ids and their offsets."""
        ids = self.encode(text)
        return ids, self.offsets(text or "", ids)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Ids that end inside a character give U+FFFD there."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One tokenizer a path and process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def slices(bpe: ByteBpe, texts: list[str | None]) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Places of texts and their ids, some CALL tokens at a time: ids of a whole batch are never held."""
    start, held, size = 0, [], 0
    for k, ids in enumerate(bpe.encode_many(texts), 1):
        held.append(ids)
        size += len(ids)
        if size >= CALL:
            yield slice(start, k), held
            start, held, size = k, [], 0
    if held:
        yield slice(start, len(texts)), held


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text, others ignored) -> (doc_id, ids, starts, ends), a row per row; null text is empty."""
    path = path or default_ranks()

    def make():
        bpe = load(path)

        def fn(cols):
            got = [bpe.encode_with_offsets(t) for t in cols[1]]
            yield [cols[0], [g[0] for g in got], [g[1][:, 0].tolist() for g in got], [g[1][:, 1].tolist() for g in got]]

        return fn

    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>")


def encode_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text, others ignored) -> (doc_id, n_tokens, ids, offsets_sha256, decoded_sha256), a row per row; null
    text is empty, repeated rows stay, an empty table gives an empty one. The digests are those of round_trip: the ids are
    decoded again."""
    path = path or default_ranks()

    def make():
        bpe = load(path)

        def fn(cols):
            for at, got in slices(bpe, cols[1]):
                offsets = [hashlib.sha256(bpe.offsets(t or "", ids).tobytes()).hexdigest() for t, ids in zip(cols[1][at], got, strict=True)]
                yield [cols[0][at], [len(x) for x in got], got, offsets, [hashlib.sha256(bpe.decode_bytes(x.tolist())).hexdigest() for x in got]]

        return fn

    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, n_tokens bigint, ids array<int>, offsets_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text). Null ids are an empty text; an unknown id is an error."""
    path = path or default_ranks()

    def make():
        bpe = load(path)

        def fn(cols):
            yield [cols[0], [bpe.decode(i or []) for i in cols[1]]]

        return fn

    return map_rows(encoded.select("doc_id", "ids"), make, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs -> (doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256): ids in decimal joined by spaces, the bytes
    that they decode to, and the offsets (starts and ends in turn, 32-bit, low byte first). Null text is empty; repeated
    rows and ids stay as rows; an empty table gives an empty one."""
    path = path or default_ranks()

    def make():
        bpe = load(path)

        def fn(cols):
            out = [[] for _ in range(4)]
            for t, ids in zip(cols[1], map(np.ndarray.tolist, bpe.encode_many(cols[1])), strict=True):
                row = (" ".join(map(bpe.decimal.__getitem__, ids)).encode(), bpe.decode_bytes(ids), bpe.offsets(t or "", ids).tobytes())
                for o, x in zip(out, (len(ids), *(hashlib.sha256(x).hexdigest() for x in row)), strict=True):
                    o.append(x)
            yield [cols[0], *out]

        return fn

    return map_rows(docs.select("doc_id", "text"), make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, offsets_sha256 string")
