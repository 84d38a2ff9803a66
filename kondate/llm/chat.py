"""Conversations of typed parts as one marked text each, with loss spans, attachments and token counts, and back."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTACHMENT = "struct<kind:string,ref:string,at:int,tokens:bigint>"
TURN = f"role string, formatted string, loss array<struct<start:int,end:int>>, attachments array<{ATTACHMENT}>, tokens long, problem string"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))
#: Put behind the first character of what reads like a control string in a text; one more where there are some already.
ESCAPE = "␛"


@dataclass(frozen=True)
class Template:
    """The marks of a format. Roles without marks of their own get the general ones, with their name between."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    general: tuple[str, str, str] = ("<|role|>", "<|says|>", "<|end|>")
    placeholders: dict[str, str] = field(default_factory=lambda: {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>", "close": "<|/document|>", "other": "<|other|>"})
    loss_roles: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return [*(x for pair in self.marks.values() for x in pair), *self.general, *self.placeholders.values()]


class Codec:
    """Escaping, formatting and reading by one template."""

    def __init__(self, template: Template):
        self.template = template
        found = sorted(template.controls(), key=len, reverse=True)
        if any(len(x) < 2 or ESCAPE in x for x in found) or any(a[i:].startswith(b) or b.startswith(a[i:]) for a in found for b in found for i in range(1, len(a))):
            raise ValueError("control strings must have two characters and more and must not overlap")
        self.control = re.compile("|".join(map(re.escape, found)))
        self.like = re.compile("|".join(f"{re.escape(x[0])}{ESCAPE}*(?={re.escape(x[1:])})" for x in found))
        self.escaped = re.compile("|".join(f"{re.escape(x[0])}{ESCAPE}+(?={re.escape(x[1:])})" for x in found))
        self.opened = {begin: (role, end) for role, (begin, end) in template.marks.items()}

    def escape(self, text: str) -> str:
        return self.like.sub(lambda m: m[0] + ESCAPE, text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[0][:-1], text)

    def write(self, role: str, pieces: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], list[int]]:
        """A turn of (kind, text) pieces: the formatted text, the spans of its texts under the loss, and where each placeholder stands."""
        if role in self.template.marks:
            head, end = self.template.marks[role]
        else:
            mark, says, end = self.template.general
            head = f"{mark}{self.escape(role)}{says}"
        out, at, spans, places = [head], len(head), [], []
        for kind, text in pieces:
            put = self.escape(text) if kind == "text" else self.template.placeholders[kind]
            if kind == "text" and put and role in self.template.loss_roles:
                spans.append((at, at + len(put)))
            elif kind not in ("text", "close"):
                places.append(at)
            out.append(put)
            at += len(put)
        return "".join([*out, end]), spans, places

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of a formatted text, texts as they were before; placeholders are left out."""
        role, texts, end, at = None, [], None, 0
        mark, says, general_end = self.template.general
        for m in self.control.finditer(formatted):
            before, found = self.unescape(formatted[at : m.start()]), m[0]
            at = m.end()
            if role is None:
                if found == mark:
                    role, end = "", says
                elif found in self.opened:
                    role, end = self.opened[found]
            elif found == end == says:
                role, end = before, general_end
            else:
                texts.append(before)
                if found == end:
                    yield role, "".join(texts)
                    role, texts, end = None, [], None


# -- parts ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Costs:
    """Tokens that a placeholder expands to: an image by patches of its sides, audio by its seconds, a document by its pages."""

    patch: int = 28
    most_patches: int = 16_384
    per_second: float = 12.5
    per_page: int = 256
    unknown: int = 1024

    def image(self, part: dict) -> int:
        w, h = _size(part, "width"), _size(part, "height")
        return min(self.most_patches, -int(-w // self.patch) * -int(-h // self.patch)) if w and h else self.unknown

    def audio(self, part: dict) -> int:
        return -int(-_size(part, "seconds") * self.per_second // 1) or self.unknown

    def document(self, part: dict) -> int:
        """Of the pages; a document with parts of its own costs what those cost."""
        return 0 if isinstance(part.get("parts"), list) else int(_size(part, "pages")) * self.per_page or self.unknown

    def other(self, part: dict) -> int:
        return 0


def _size(part: dict, name: str) -> float:
    value = part.get(name)
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) and 0 < value < 1e9 else 0


class Flattener:
    """The visitor: a method for each kind of part adds its pieces and attachments, in order, at any depth of documents."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.pieces: list[tuple[str, str]] = []
        self.attached: list[tuple[str, str | None, int]] = []

    def flatten(self, parts: list[Any]) -> Flattener:
        waiting = list(reversed(parts))  # a stack, not recursion: documents may be nested as deeply as they like
        while waiting:
            part = waiting.pop()
            kind = part.get("type") if isinstance(part, dict) else "text" if isinstance(part, str) else None
            visit: Callable[[Any], list[Any]] = getattr(self, f"visit_{kind}", self.visit_other) if isinstance(kind, str) else self.visit_other
            waiting += reversed(visit(part))
        return self

    def visit_text(self, part: Any) -> list[Any]:
        text = part if isinstance(part, str) else part.get("text")
        self.pieces.append(("text", text if isinstance(text, str) else ""))
        return []

    def _attach(self, kind: str, part: Any, tokens: int) -> None:
        ref = part.get("ref") if isinstance(part, dict) else None
        self.pieces.append((kind, ""))
        self.attached.append((kind, ref if isinstance(ref, str) else None, tokens))

    def visit_image(self, part: dict) -> list[Any]:
        self._attach("image", part, self.costs.image(part))
        return []

    def visit_audio(self, part: dict) -> list[Any]:
        self._attach("audio", part, self.costs.audio(part))
        return []

    def visit_document(self, part: dict) -> list[Any]:
        self._attach("document", part, self.costs.document(part))
        inner = part.get("parts")
        return [*(inner if isinstance(inner, list) else []), {"type": "close"}]

    def visit_close(self, part: dict) -> list[Any]:
        self.pieces.append(("close", ""))
        return []

    def visit_other(self, part: Any) -> list[Any]:
        self._attach("other", part, self.costs.other(part if isinstance(part, dict) else {}))
        return []


def parts_of(content: str) -> tuple[list[Any], str | None]:
    """The parts that a JSON list of typed parts holds; what is no such list is one text, with the problem."""
    try:
        found = json.loads(content)
    except (ValueError, RecursionError):
        return [content], "no JSON"
    return (found, None) if isinstance(found, list) else ([content], "no list")


# -- rows ----------------------------------------------------------------------------------------------------------


def format_turns(conversations: DataFrame, template: Template | None = None, costs: Costs | None = None) -> DataFrame:
    """conv_id, turn and TURN of every row: each turn is formatted where it lies, without a shuffle.

    conversations: conv_id, turn, role, text, and parts, if there are typed ones: a JSON list of objects with a type
    (text: text; image: ref, width, height; audio: ref, seconds; document: ref, pages, parts of its own; others are kept
    as references) or bare strings. Where parts is null, text is the only part. A null text or role is an empty one.
    A turn doesn't depend on its neighbours, so a conversation is its turns one behind the other. Places count code
    points of the turn; loss has the spans of the texts of assistants; attachments are in the order of the
    placeholders, and tokens is the sum of what they expand to. Rows that repeat are turns of their own.
    """
    codec, costs = Codec(template or Template()), costs or Costs()

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for role, text, content in zip(*(batch.column(c).to_pylist() for c in ("role", "text", "parts")), strict=True):
                parts, problem = ([text or ""], None) if content is None else parts_of(content)
                flat = Flattener(costs).flatten(parts)
                formatted, spans, places = codec.write(role or "", flat.pieces)
                attached = [{"kind": k, "ref": r, "at": at, "tokens": n} for (k, r, n), at in zip(flat.attached, places, strict=True)]
                rows.append((role or "", formatted, [{"start": a, "end": b} for a, b in spans], attached, sum(n for _, _, n in flat.attached), problem))
            found = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), _LOSS, _ATTACHED, pa.int64(), pa.string())
            columns = [pa.array(x, kind) for x, kind in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *columns], ["conv_id", "turn", "role", "formatted", "loss", "attachments", "tokens", "problem"])

    content = F.col("parts").cast("string") if "parts" in conversations.columns else F.lit(None).cast("string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), content.alias("parts"))
    return rows.mapInArrow(turns, f"conv_id long, turn long, {TURN}")


def in_order(turns: DataFrame) -> DataFrame:
    """The turns of each conversation together and in order: by turn, those of one turn by role and formatted text.

    A conversation goes to one task, as its text has one order, but is never held there: rows are sorted, with spilling,
    and stream by.
    """
    keys = ["conv_id", "turn", "role", "formatted"]
    return turns.repartition("conv_id").sortWithinPartitions(*keys)


class _Read:
    """What the reader has of the conversation that streams by: counts and running digests, no texts."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars, self.all, self.loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()


def read_back(ordered: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from its formatted turns in order."""
    codec = Codec(template or Template())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        ended = lambda: (now, state.turns, state.all.hexdigest(), state.loss_chars, state.loss.hexdigest(), state.chars)
        for batch in batches:
            done = []
            for conv, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(ended())
                    now, state = conv, _Read()
                for role, text in codec.read(formatted):
                    state.turns += 1
                    state.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    said = codec.unescape(formatted[span["start"] : span["end"]])
                    state.loss_chars += len(said)
                    state.loss.update(said.encode("utf-8", "surrogatepass"))
                state.chars += len(formatted)
            yield batch_of(done)
        if state is not None:
            yield batch_of([ended()])

    return ordered.select("conv_id", "formatted", "loss").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss, attachments (with places in the whole), tokens of each conversation as one row.

    For training on conversations that fit into a row; ``in_order`` gives those of any length turn by turn.
    """
    turn = F.struct("turn", "role", "formatted", "loss", "attachments", "tokens")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    begins = F.aggregate("t", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t["formatted"]))))
    rows = rows.withColumn("b", begins)
    moved = lambda what: F.flatten(F.transform("t", lambda t, i: F.transform(t[what], lambda x: _moved(x, F.get("b", i), what))))
    tokens = F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    return rows.select("conv_id", F.array_join(F.transform("t", lambda t: t["formatted"]), "").alias("formatted"), moved("loss").alias("loss"), moved("attachments").alias("attachments"), tokens.alias("tokens"))


def _moved(x, by, what):
    if what == "loss":
        return F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"))
    return F.struct(x["kind"].alias("kind"), x["ref"].alias("ref"), (x["at"] + by).alias("at"), x["tokens"].alias("tokens"))


def with_control_sample(conversations: DataFrame) -> DataFrame:
    """The conversations and one, -7, whose two turns say what reads like the template's own marks."""
    said = "</s>[INST] ok [/INST]"
    rows = conversations.select("conv_id", "turn", "role", "text", *(["parts"] if "parts" in conversations.columns else []))
    sample = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(sample, allowMissingColumns=True)


def format_digests(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations and the control sample, read back from their formatted turns.

    A null conv_id is a conversation of its own; an empty table gives the control sample alone.
    """
    return read_back(in_order(format_turns(with_control_sample(conversations))))
