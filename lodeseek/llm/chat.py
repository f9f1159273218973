"""Chat formatting: conversations through a compiled template, with generation marks as the loss mask.

Control strings inside roles and texts are escaped: every backslash is doubled, and a backslash is set
behind the first character of each control string.  What remains holds no control string, so turns can be
read back from the formatted text, and dropping single backslashes restores each text exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm._common import arrow_schema
from lodeseek.llm.template import compile_template

#: Control strings of the format.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[TEXT]")
TEMPLATE = (
    "<s>{% for m in messages %}[TURN]{{ m.role | escape }}[TEXT]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}"
    "{% endfor %}</s>"
)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_SLASH = re.compile(r"\\(\\?)")
_TURN = re.compile(r"\[TURN\](.*?)\[TEXT\](.*?)(?=\[TURN\]|</s>)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _SLASH.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that ``TEMPLATE`` made."""
    turns = []
    for role, body in _TURN.findall(formatted):
        if body.startswith("[INST]"):
            body = body[len("[INST]") : -len("[/INST]")]
        turns.append((unescape(role), unescape(body)))
    return turns


def format_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Per conversation: conv_id, formatted, loss_start and loss_end (code points of the marked spans).

    Turns go by turn, then role, then text, nulls first; repeated rows are turns of their own.  Null roles and
    texts are empty; rows with a null conv_id are one conversation; an empty table gives an empty table; other
    columns are ignored.  Rows are dealt by conv_id and sorted, and a task holds one conversation at a time:
    a conversation's text is one value, so it has to meet in one place.
    """
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"))
    schema, arrow = arrow_schema("conv_id long, formatted string, loss_start array<int>, loss_end array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, escape)
        done: list[tuple] = []
        size, current, messages = 0, None, []

        def finish():
            nonlocal size
            text, marks = render(messages=messages)
            done.append((current, text, [a for a, _ in marks], [b for _, b in marks]))
            size += len(text)

        def flush():
            nonlocal size
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*done), arrow)]
            done.clear()
            size = 0
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if messages and conv != current:
                    finish()
                    messages = []
                    if size > 4 << 20:
                        yield flush()
                current = conv
                messages.append({"role": role, "text": text})
        if messages:
            finish()
        if done:
            yield flush()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from ``format_chats``' output, as digests, one row per conversation.

    A conversation without assistant texts has zero loss_chars and the digest of nothing; a null conv_id stays; an
    empty table gives an empty table; columns behind the first four are ignored.
    """
    schema, arrow = arrow_schema("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4))):
                turns = read_back(text)
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends))
                sha = hashlib.sha256()
                for role, said in turns:
                    sha.update(f"{role}\n{said}\n".encode())
                out.append((conv, len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return formatted.mapInArrow(run, schema)


#: A conversation whose texts are control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(len(PROBE)).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(*(F.lit(p[2]) for p in PROBE)), (F.col("id") + 1).cast("int")).alias("role"), F.lit(PROBE[0][3]).alias("text"))
    return chat_digests(format_chats(turns.unionByName(probe)))
