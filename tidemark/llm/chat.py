"""Chat formatting of typed content parts.

A message is a list of parts: text, image, audio or document. A visitor flattens them in order: texts are
escaped, everything else becomes a placeholder, an attachment record and the number of tokens that the
placeholder expands to. A null part counts as an empty text; a part of another kind keeps its kind and
reference in its record, stands as a placeholder of its own and expands to one token. Turns stand between marks; control strings inside texts are broken by a backslash
behind their first character and backslashes are doubled, so reading back restores every text.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_schema, map_rows, table

PART = "struct<kind:string,text:string,ref:string,width:double,height:double,seconds:double,pages:double>"
START, END = "<|turn|>", "<|end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"
CONTROL = (START, END, *PLACEHOLDER.values(), OTHER, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
HOLDER = re.compile("|".join(map(re.escape, (*PLACEHOLDER.values(), OTHER))))


def sized(value: float | None, least: float) -> float:
    """A size to reckon with: one that is missing, not finite or below ``least`` counts as ``least``."""
    return value if value is not None and least < value < math.inf else least


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


@dataclass(frozen=True)
class Settings:
    """Tokens an attachment expands to: by image patches, audio frames and document pages; sizes that are missing, not finite or not positive count as one unit."""

    patch: int = 28
    frames: float = 25.0
    page: int = 256
    loss_roles: tuple[str, ...] = ("assistant",)


@dataclass
class Visitor:
    """Collects one message; ``loss`` has the [start, end) of the texts that count, ``attached`` (position, kind, ref, tokens)."""

    settings: Settings
    role: str
    out: list[str] = field(default_factory=list)
    length: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attached: list[tuple[int, str, str, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def visit(self, part: dict | None) -> None:
        part = part or {}
        kind = part.get("kind") or "text"
        if kind == "text":
            start = self.length
            self.add(escape(part.get("text") or ""))
            if self.role in self.settings.loss_roles and self.length > start:
                self.loss.append((start, self.length))
        else:
            count = getattr(self, f"{kind}_tokens")(part) if kind in PLACEHOLDER else 1
            self.attached.append((self.length, kind, part.get("ref") or "", count))
            self.add(PLACEHOLDER.get(kind, OTHER))

    def image_tokens(self, part: dict) -> int:
        return math.ceil(sized(part.get("width"), 1.0) / self.settings.patch) * math.ceil(sized(part.get("height"), 1.0) / self.settings.patch)

    def audio_tokens(self, part: dict) -> int:
        return max(1, math.ceil(sized(part.get("seconds"), 0.0) * self.settings.frames))

    def document_tokens(self, part: dict) -> int:
        return math.ceil(sized(part.get("pages"), 1.0)) * self.settings.page

    def turn(self, parts: list[dict | None]) -> Visitor:
        self.add(START + escape(self.role).replace("\n", "\\\n") + "\n")
        for part in parts:
            self.visit(part)
        self.add(END + "\n")
        return self


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted string; placeholders are left out of the text."""
    return [(unescape(m[1]), unescape(HOLDER.sub("", m[2]))) for m in TURN.finditer(formatted)]


def render(messages: DataFrame, s: Settings | None = None) -> DataFrame:
    """conv_id, turn, role, formatted, loss, attached, expanded_tokens of each message; no shuffle.

    ``parts`` is an array of typed parts (structs with a kind); without such a column ``text`` is the only part.
    Null texts, roles, parts and lists of parts count as empty. Spans and positions are code points in
    ``formatted``. Messages that repeat are rendered again, no messages give no rows, other columns are not read.
    """
    s = s or Settings()
    own = messages.schema["parts"].dataType if "parts" in messages.columns else None
    if not (isinstance(own, T.ArrayType) and isinstance(own.elementType, T.StructType) and "kind" in own.elementType.names):
        one = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"))
        messages = messages.withColumn("parts", F.array(one))
    schema = "conv_id long, turn long, role string, formatted string, loss array<struct<start:int,end:int>>, attached array<struct<position:int,kind:string,ref:string,tokens:long>>, expanded_tokens long"

    def make():
        def batch(convs, turns, roles, parts):
            seen = [Visitor(s, r or "").turn(p or []) for r, p in zip(roles, parts, strict=True)]
            return (
                convs, turns, [r or "" for r in roles], ["".join(v.out) for v in seen],
                [[{"start": a, "end": b} for a, b in v.loss] for v in seen],
                [[dict(zip(("position", "kind", "ref", "tokens"), x, strict=True)) for x in v.attached] for v in seen],
                [sum(x[3] for x in v.attached) for v in seen],
            )

        return batch

    return map_rows(messages, ["conv_id", "turn", "role", "parts"], schema, make)


def conversations(rendered: DataFrame) -> DataFrame:
    """What is read back from the formatted turns of each conversation, in order of turn, then formatted text.

    A digest of a conversation needs its turns in order, so they meet in one task; they stream through it
    sorted, and only the digests' states are held, however long a conversation is. Messages that repeat are
    turns of their own; a null conv_id is a conversation like any other; no rows give none.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"
    arrow = arrow_schema(schema)

    def run(batches):
        now: list | None = None

        def closed():
            return [now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), *now[5:]]

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now is not None:
                        done.append(closed())
                    now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in read_back(r["formatted"]):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in r["loss"]:
                    own = unescape(r["formatted"][span["start"] : span["end"]])
                    now[3] += len(own)
                    now[4].update(own.encode("utf-8", "surrogatepass"))
                now[5] += len(r["formatted"])
                now[6] += len(r["attached"])
                now[7] += r["expanded_tokens"]
            if done:
                yield emit(done)
        if now is not None:
            yield emit([closed()])

    dealt = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return dealt.select("conv_id", "formatted", "loss", "attached", "expanded_tokens").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return conversations(render(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))
