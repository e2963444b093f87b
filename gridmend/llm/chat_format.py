"""Format conversations for training by a compiled template, with the mask of what the model is to learn, and read back.

The template is compiled once (``templates``) and rendered inside tasks: turns arrive sorted and stream through the
closures, and the formatted text leaves in parts of bounded size, so a conversation of any length never sits in memory.
A text, a digest and a mask are sequences, so one conversation is one stream of one task; conversations are spread by id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmend.llm.templates import compiled, unescaped

#: What opens a turn, parts role and text, and closes a turn.
CONTROLS = ("<turn>", "<says>", "</turn>")
TEMPLATE = """\
{% for m in messages -%}
<turn>{{ m.role | escape }}<says>
{%- if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif -%}
</turn>{{ '\\n' }}
{%- endfor %}"""
#: Characters after which a part of a formatted conversation ends (it ends with a whole fragment).
PART_CHARS = 1 << 20
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
PARTS = "part long, text string, loss array<struct<start:bigint,end:bigint>>"


def in_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text) of whole conversations, each in one partition and in order: by turn, null first, then role,
    then text. A null role or text is empty."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _by_first(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of equal first values; what a reader leaves of a run is skipped."""
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def run() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:
                now, row = row, next(rows, None)
                yield now

        own = run()
        yield key, own
        for _ in own:
            pass


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def _sent(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Record batches of some thousand rows, or of about ``weight`` characters in the third column."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for r in rows:
        held.append(r)
        size += len(r[2]) if isinstance(r[2], str) else 0
        if len(held) >= 4096 or size >= weight:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, controls: Sequence[str] = CONTROLS, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, text, loss: the formatted text of every conversation, in parts numbered from 0 (nearly always one),
    and the spans under the loss mask (code points of the whole formatted conversation, end exclusive).

    Parts of a conversation come together and in order within a partition. Turns are ordered and nulls taken as in
    ``in_turns``; rows repeated exactly are turns of their own; the null conv_id is a conversation. An empty table gives no
    rows. Further columns are not read.
    """
    compiled(template, controls)  # a wrong template fails here, not in a task
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        render = compiled(template, controls)
        for conv, rows in _by_first(_rows(batches, "conv_id", "role", "text")):
            part, at, texts, length, spans = 0, 0, [], 0, []
            for text, marked in render({"role": r, "text": t} for _, r, t in rows):
                if not text:
                    continue
                texts.append(text)
                if marked and spans and spans[-1]["end"] == at:
                    spans[-1]["end"] = at + len(text)
                elif marked:
                    spans.append({"start": at, "end": at + len(text)})
                at += len(text)
                length += len(text)
                if length >= part_chars:
                    yield conv, part, "".join(texts), spans
                    part, texts, length, spans = part + 1, [], 0, []
            if texts or not part:
                yield conv, part, "".join(texts), spans

    turns = in_turns(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            schema = pa.schema([("conv_id", first.schema.field("conv_id").type), ("part", pa.int64()), ("text", pa.string()), ("loss", SPANS)])
            yield from _sent(parts(_chained(first, batches)), schema, 8 * part_chars)

    return turns.mapInArrow(run, f"conv_id {kind}, {PARTS}")


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def in_order(parts: DataFrame) -> DataFrame:
    """Stored parts brought together again for ``read_back``."""
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")


def pieces(texts: Iterator[str], controls: Sequence[str]) -> Iterator[tuple[str, str]]:
    """('open' | 'middle' | 'close' | 'text', content) of a formatted text; content is unescaped."""
    names = dict(zip(controls, ("open", "middle", "close"), strict=True))
    token = re.compile(r"\\.|" + "|".join(map(re.escape, sorted(controls, key=len, reverse=True))), re.DOTALL)
    for text in texts:
        at = 0
        for m in token.finditer(text):
            if m.group() in names:
                yield "text", unescaped(text[at:m.start()])
                yield names[m.group()], ""
                at = m.end()
        yield "text", unescaped(text[at:])


def read_back(parts: DataFrame, controls: Sequence[str] = CONTROLS) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations, from their texts
    and masks alone; parts as ``format_conversations`` or ``in_order`` gives them."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    schema_of = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, rows in _by_first(_rows(batches, "conv_id", "text", "loss")):
            turns, loss, n, learned, at = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            inside = False

            def texts() -> Iterator[str]:
                nonlocal at, learned
                for _, text, spans in rows:  # noqa: B023 - read before the next conversation
                    for s in spans:
                        own = unescaped(text[s["start"] - at:s["end"] - at])
                        learned += len(own)
                        loss.update(own.encode())  # noqa: B023
                    at += len(text)
                    yield text

            for kind_of, content in pieces(texts(), controls):
                if kind_of == "open":
                    inside = True
                elif kind_of == "text":
                    if inside:
                        turns.update(content.encode())
                else:
                    turns.update(b"\n")
                    if kind_of == "close":
                        n, inside = n + 1, False
            yield conv, n, turns.hexdigest(), learned, loss.hexdigest(), at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _sent(digests(_chained(first, batches)), pa.schema([("conv_id", first.schema.field("conv_id").type), *schema_of]), PART_CHARS)

    return parts.select("conv_id", "text", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, '<turn>' || regexp_replace(role, '(\\|<turn>|<says>|</turn>)', '\\\1', 'g') || '<says>' || regexp_replace(text, '(\\|<turn>|<says>|</turn>)', '\\\1', 'g') || '</turn>' || chr(10) AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
