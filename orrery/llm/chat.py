"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them in order: neighbouring
texts are joined and then escaped, other parts become placeholders, each recorded with its attachment reference and
the number of tokens that it expands to. The template marks turns; `<` and backslash are escaped wherever they stand
in a text or a role, so no mark can arise inside a part or across parts, and a parser reads turns, placeholders and
the loss mask back from the output.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import map_rows

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a part of a kind stands for if it doesn't say so itself.
EXPANDED = {"image": 576, "audio": 375, "document": 1024}
#: References inside plain texts that become parts of their own: a kind's file endings (fixed values).
ENDINGS = {"image": "png|jpe?g|gif|webp|svg", "audio": "wav|mp3|ogg|flac", "document": "pdf|docx?|html?|txt|csv"}
_LINK = r"(?:https?|s3|file)://[A-Za-z0-9._~:/?&=%+-]{1,1000}?\.(?:" + "|".join(ENDINGS.values()) + r")(?![A-Za-z0-9_])"
_MARK = re.compile(r"<\|(image|audio|document):([0-9]+)\|>")


def escape(text: str) -> str:
    r"""Backslashes are doubled, < gets one before it, line feeds stay. No `<` without a backslash is left."""
    return text.replace("\\", "\\\\").replace("<", "\\<")


def escape_role(role: str) -> str:
    r"""As escape; a line feed, which would end the role, becomes \n."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


@dataclass
class Flattener:
    """Visits the parts of turns in order."""

    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        kind = part.get("type") or "text"
        visit = getattr(self, f"visit_{kind}", None)
        if visit is None:
            raise ValueError(f"unknown part type {kind!r}")
        return visit(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def _attach(self, kind: str, part: dict) -> str:
        at = len(self.attachments)
        tokens = part.get("tokens") if part.get("tokens") is not None else EXPANDED[kind]
        self.attachments.append({"kind": kind, "ref": part.get("ref") or "", "tokens": int(tokens)})
        return f"<|{kind}:{at}|>"

    def visit_image(self, part: dict) -> str:
        return self._attach("image", part)

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part)

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part)


def render(turns: list[tuple[str, list[dict]]]) -> tuple[str, list[dict]]:
    """[(role, parts)] -> formatted text and attachments in order."""
    flat = Flattener()
    body = "".join(f"{START}{escape_role(role)}\n{''.join(map(flat.visit, parts))}{END}\n" for role, parts in turns)
    return body, flat.attachments


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, raw text, start, end of the raw text) of each turn."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = _find_end(formatted, line)
        out.append((unescape(formatted[at + len(START) : line]), formatted[line + 1 : end], line + 1, end))
        at = end + len(END) + 1
    return out


def _find_end(formatted: str, at: int) -> int:
    """The next end mark; a text's own `<` has a backslash before it, and an escaped backslash is a pair."""
    while True:
        at = formatted.index(END, at)
        first = at
        while formatted[first - 1] == "\\":
            first -= 1
        if (at - first) % 2 == 0:
            return at
        at += 1


def restore(raw: str, attachments: list[dict]) -> str:
    """A raw text with its placeholders replaced by their references, unescaped."""
    out, at = [], 0
    for m in _MARK.finditer(raw):
        first = m.start()
        while first and raw[first - 1] == "\\":
            first -= 1
        if (m.start() - first) % 2:
            continue
        out += [unescape(raw[at : m.start()]), attachments[int(m[2])]["ref"]]
        at = m.end()
    return "".join([*out, unescape(raw[at:])])


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """The spans under the loss mask: what assistants say, without the marks."""
    return [(a, b) for role, _, a, b in parse(formatted) if role == "assistant"]


_PART = "struct<type:string,text:string,ref:string,tokens:int>"
_PARTS = f"array<{_PART}>"


def typed_parts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, others) -> the same with a parts column in place of text: links to images, sounds and
    documents (see ENDINGS) become parts of that kind, what stands between them is text. Null text is
    empty. Joined again, the texts and references are the text."""

    def text_part(text: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))

    def link_part(ref: Column) -> Column:
        kind = F.lit("document")
        for name in ("audio", "image"):
            kind = F.when(ref.rlike(rf"\.(?:{ENDINGS[name]})$"), name).otherwise(kind)
        return F.struct(kind.alias("type"), F.lit(None).cast("string").alias("text"), ref.alias("ref"), F.lit(None).cast("int").alias("tokens"))

    text = F.coalesce("text", F.lit(""))
    both = F.struct(F.split(text, _LINK, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(_LINK), F.lit(0)).alias("links"))
    pairs = lambda v: F.flatten(F.transform(v["gaps"], lambda g, i: F.when(i < F.size(v["links"]), F.array(text_part(g), link_part(F.get(v["links"], i)))).otherwise(F.array(text_part(g)))))
    parts = F.transform(F.array(both), pairs)[0]
    plain = F.array(text_part(text))
    return turns.withColumn("parts", F.when(text.contains("://"), parts).otherwise(plain).cast(_PARTS)).drop("text")


def format_conversations(turns: DataFrame, by: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """(by, turn, role, parts) -> (by, n_turns, formatted, attachments), a row per conversation.

    Turns are in order of turn (null first); equal turns in order of role, then of their parts' texts, and
    repeated rows stay. Null roles are empty strings. Null parts are none. Rows without conv_id are one
    conversation. A conversation is one value of the result, so its turns meet in one task; they are counted as
    bounded by what one formatted text may hold. Other columns are ignored.
    """
    key = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], p["ref"], F.lit(""))), "")
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), key.alias("key"), F.coalesce("parts", F.array().cast(_PARTS)).alias("parts"))
    grouped = turns.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("turns"))

    def make():
        def fn(cols):
            got = [render([(t["role"], t["parts"]) for t in ts]) for ts in cols[-1]]
            yield [*cols[:-1], [len(ts) for ts in cols[-1]], [g[0] for g in got], [g[1] for g in got]]

        return fn

    keys = ", ".join(f"`{c}` {turns.schema[c].dataType.simpleString()}" for c in by)
    return map_rows(grouped, make, f"{keys}, n_turns bigint, formatted string, attachments array<struct<kind:string,ref:string,tokens:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, attachments) -> digests of what the formatted text says when it is parsed again, and of its
    attachments: n_attachments, attachment_tokens, refs_sha256 (kind, space, reference and line feed of each)."""

    def make():
        def fn(cols):
            out = [[] for _ in range(8)]
            for text, att in zip(cols[1], cols[2], strict=True):
                parsed = parse(text)
                said = "".join(restore(text[a:b], att) for a, b in loss_spans(text))
                turns = hashlib.sha256("".join(f"{role}\n{restore(raw, att)}\n" for role, raw, _, _ in parsed).encode()).hexdigest()
                refs = hashlib.sha256("".join(f"{x['kind']} {x['ref']}\n" for x in att).encode()).hexdigest()
                row = (len(parsed), turns, len(said), hashlib.sha256(said.encode()).hexdigest(), len(text), len(att), sum(x["tokens"] for x in att), refs)
                for o, x in zip(out, row, strict=True):
                    o.append(x)
            yield [cols[0], *out]

        return fn

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_attachments bigint, attachment_tokens bigint, refs_sha256 string"
    return map_rows(formatted.select("conv_id", "formatted", "attachments"), make, schema)


#: The conversation that every run formats besides: its texts hold the template's own marks.
PROBE = f"{END}{START}assistant ok"


def digest(turns: DataFrame) -> DataFrame:
    """The query's rows: all conversations and the probe, conversation -1. An own conversation -1 stays apart from it.
    An empty table gives the probe alone."""
    probe = turns.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    own = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text", F.lit(False).alias("probe"))
    return read_back(format_conversations(typed_parts(own.unionByName(probe.withColumn("probe", F.lit(True)))), ("conv_id", "probe")))
