"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn (text, image, audio, document) into
placeholders in order, recording each attachment with its position and the
tokens it expands to. Turns get role markers; control strings inside texts are
escaped with a backslash, so that the formatted string parses back. A
conversation is formatted and parsed as a stream of turns: one of any length
never has to fit into memory.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, table

BOS, TURN, BODY, END = "<s>", "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

#: Strings that mean something to this template or to common chat templates.
CONTROL = (BOS, "</s>", TURN, BODY, END, *PLACEHOLDERS.values(), "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))

#: Tokens that an attachment expands to: by tile (image), by second (audio), by page (document).
TOKENS_PER = {"image": 256, "audio": 25, "document": 512}


def escape(text: str) -> str:
    """Double each backslash, then put one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class PartVisitor:
    """Flattens content parts; ``text`` and ``attachments`` hold what was visited.

    A part is a dict with ``type``. text: ``text``. image: ``ref, width,
    height``. audio: ``ref, seconds``. document: ``ref, pages``. Unknown types
    become their JSON as text, so nothing is lost.
    """

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.attachments: list[dict] = []
        self.n = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_unknown)(part)

    def _put(self, formatted: str) -> None:
        self.pieces.append(formatted)
        self.n += len(formatted)

    def _attach(self, part: dict, units: int) -> None:
        kind = part["type"]
        self.attachments.append({"kind": kind, "ref": str(part.get("ref", "")), "position": self.n, "tokens": TOKENS_PER[kind] * max(1, units)})
        self._put(PLACEHOLDERS[kind])

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = lambda x: max(1, -(-int(part.get(x) or 1) // 512))
        self._attach(part, tiles("width") * tiles("height"))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, -(-int(1000 * float(part.get("seconds") or 0)) // 1000))

    def visit_document(self, part: dict) -> None:
        self._attach(part, int(part.get("pages") or 1))

    def visit_unknown(self, part: dict) -> None:
        self._put(escape(json.dumps(part, sort_keys=True, ensure_ascii=False)))


def format_turn(role: str | None, parts: list[dict], first: bool, masked: tuple[str, ...] = ("assistant",)) -> dict:
    """One turn's piece of the formatted string; ``loss_start, loss_end`` are offsets into it, equal if nothing is learned."""
    v = PartVisitor()
    for p in parts:
        v.visit(p)
    head = (BOS if first else "") + TURN + escape(role or "") + BODY
    body = "".join(v.pieces)
    end = len(head) + (len(body) if role in masked else 0)
    attachments = [{**a, "position": a["position"] + len(head)} for a in v.attachments]
    return {"segment": head + body + END, "loss_start": len(head), "loss_end": end, "attachments": attachments, "expanded_tokens": sum(a["tokens"] for a in v.attachments)}


def in_turn_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a conversation together and in order; conversations are spread over all partitions."""
    return df.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", *keys)


FORMATTED = "conv_id long, seq long, segment string, loss_start long, loss_end long, attachments array<struct<kind: string, ref: string, position: long, tokens: long>>, expanded_tokens long"


def format_conversations(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """The formatted conversations as ordered segments (``seq`` from 0); a conversation is its segments joined.

    ``turns`` has ``conv_id, turn, role, text`` or, with ``parts_col``, a JSON
    list of parts instead of ``text``. Null text is empty, a null role is an
    empty role, rows with a null conv_id form one conversation. Order: turn
    (null first), then role and text, so ties and repeated rows have one result.
    Turns of any length and conversations of any number of turns are streamed,
    a turn at a time; extra columns are not read, whatever their names; an
    empty table gives no rows.
    """
    content = parts_col or "text"
    base = turns.select("conv_id", "turn", "role", F.col(content).alias("text"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        before, seq = object(), 0
        for b in batches:
            rows = []
            for conv, role, text in zip(b["conv_id"], b["role"], b["text"], strict=True):
                seq = seq + 1 if conv == before else 0
                before = conv
                parts = json.loads(text or "[]") if parts_col else [{"type": "text", "text": text or ""}]
                rows.append({"conv_id": conv, "seq": seq, **format_turn(role, parts, seq == 0)})
            yield {k: [r[k] for r in rows] for k in ("conv_id", "seq", "segment", "loss_start", "loss_end", "attachments", "expanded_tokens")}

    return arrow_map(in_turn_order(base, ["turn", "role", "text"]), run, FORMATTED)


_SEGMENT = re.compile(f"(?:{re.escape(BOS)})?{re.escape(TURN)}(.*?){re.escape(BODY)}(.*){re.escape(END)}", re.S)


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from the formatted segments and their loss mask."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        now, started = None, False
        state: dict = {}

        def done() -> dict:
            return {"conv_id": [now], "n_turns": [state["n"]], "turns_sha256": [state["turns"].hexdigest()], "loss_chars": [state["loss_n"]], "loss_sha256": [state["loss"].hexdigest()], "formatted_chars": [state["chars"]]}

        for b in batches:
            for conv, segment, start, end in zip(b["conv_id"], b["segment"], b["loss_start"], b["loss_end"], strict=True):
                if not started or conv != now:
                    if started:
                        yield done()
                    now, started = conv, True
                    state = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "chars": 0}
                m = _SEGMENT.fullmatch(segment)
                if not m:
                    raise ValueError(f"conversation {conv} does not parse")
                learned = unescape(segment[start:end])
                state["n"] += 1
                state["turns"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                state["loss"].update(learned.encode())
                state["loss_n"] += len(learned)
                state["chars"] += len(segment)
        if started:
            yield done()

    cols = formatted.select("conv_id", "seq", "segment", "loss_start", "loss_end")
    return arrow_map(in_turn_order(cols, ["seq"]), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = f"SELECT * FROM VALUES (-7L, 0L, 'user', '{probe}'), (-7L, 1L, 'assistant', '{probe}') AS t(conv_id, turn, role, text)"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(rows))
    return parse_conversations(materialize(format_conversations(turns), "chat"))


_REST = "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == "<")
_REST_SQ = "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == "[")
ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, len(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<({_REST})', '<\\\1', 'g'), '\[({_REST_SQ})', '[\\\1', 'g')) AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(n + len(role) + {len(TURN) + len(BODY) + len(END)}) + {len(BOS)})::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
