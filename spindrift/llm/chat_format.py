"""Conversations rebuilt from event logs and rendered with turn marks and a loss mask."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks of a turn.
START, END = "<|im_start|>", "<|im_end|>"
CHUNK = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)
ESCAPED = re.compile(r"<\\(\\*)\|")


def unescaped(text: str) -> str:
    """Undo the escape of control strings: one backslash goes between < and |."""
    return ESCAPED.sub(r"<\1|", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescaped(role))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as events: each is one whole message at its turn, named by its row, so that equal rows stay apart."""
    name = F.monotonically_increasing_id().cast("string")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), name.alias("message_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, pos, role, text) of events (conv_id, seq, kind, message_id, role, text).

    message: a whole message. delta: text put behind the message's text.
    edit: replaces it. regenerate: empties it, deltas follow. delete: the message goes. A message stands at the
    smallest seq of its events and has the first role given. Events of a message are folded in the order of (seq,
    kind, role, text); null kinds count as message, null texts as empty, unknown kinds are ignored.

    An event without message_id is folded alone: message, delta, edit and regenerate each make a message of their
    own text, delete makes none.

    Only the events that name a message are shuffled, by conversation and message, so that a conversation with
    very many messages is folded by many tasks; a task holds the text of one message at a time.
    """
    columns = ["conv_id", "seq", "kind", "message_id", "role", "text"]
    e = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.col("message_id").cast("string").alias("message_id"), "role", F.coalesce("text", F.lit("")).alias("text"))
    whole = e.filter("message_id is null and kind in ('message', 'delta', 'edit', 'regenerate')").select("conv_id", F.col("seq").alias("pos"), F.coalesce("role", F.lit("")).alias("role"), "text")
    parts = e.filter("message_id is not null").repartition("conv_id", "message_id").sortWithinPartitions("conv_id", "message_id", *columns[1:3], "role", "text")

    def fold(stream):
        import pyarrow as pa

        key, state = None, None

        def close():
            return [] if state is None or state["gone"] else [(key[0], state["pos"], state["role"] or "", "".join(state["text"]))]

        for batch in stream:
            out = []
            for conv, seq, kind, message, role, text in zip(*(batch.column(c).to_pylist() for c in columns)):
                if (conv, message) != key:
                    out += close()
                    key, state = (conv, message), {"pos": seq, "role": None, "text": [], "gone": False}
                if state["role"] is None:
                    state["role"] = role
                if kind in ("message", "edit"):
                    state |= {"text": [text], "gone": False}
                elif kind == "delta":
                    state["text"].append(text)
                elif kind == "regenerate":
                    state |= {"text": [text] if text else [], "gone": False}
                elif kind == "delete":
                    state["gone"] = True
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "pos", "role", "text"), r)) for r in out], schema=schema(pa))
        if out := close():
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "pos", "role", "text"), r)) for r in out], schema=schema(pa))

    def schema(pa):
        return pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    return whole.unionByName(parts.mapInArrow(fold, "conv_id long, pos long, role string, text string"))


def rendered(final: DataFrame) -> DataFrame:
    """final with the columns chunk (its rendering), loss_start and loss_end (code points of the chunk under the mask).

    A control string in a text gets a backslash between < and |, also before backslashes that stand there; this is
    undone by taking one away. In a role, backslashes and line ends are escaped too. Only assistants are in the mask.
    """
    role = F.replace(F.replace(F.col("role"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    shut = lambda c: F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")
    head = F.concat(F.lit(START), shut(role), F.lit("\n"))
    body = shut(F.col("text"))
    masked = F.col("role") == "assistant"
    out = final.withColumn("head", head).withColumn("body", body)
    start = F.when(masked, F.length("head"))
    return out.withColumns({"chunk": F.concat("head", "body", F.lit(END + "\n")), "loss_start": start, "loss_end": start + F.length("body")}).drop("head", "body")


def formatted(final: DataFrame) -> DataFrame:
    """(conv_id, text, loss_mask): whole renderings with their mask as spans of code points.

    For conversations that fit a task's memory; others stay in the chunks of rendered(), in the order of pos.
    """
    item = F.struct("pos", "role", "text", "chunk", "loss_start", "loss_end")
    joined = rendered(final).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda acc, x: F.struct((acc.at + F.length(x.chunk)).alias("at"), F.when(x.loss_start.isNull(), acc.spans).otherwise(F.concat(acc.spans, F.array(F.struct((acc.at + x.loss_start).alias("start"), (acc.at + x.loss_end).alias("end"))))).alias("spans"))
    return joined.select("conv_id", F.concat_ws("", F.col("c.chunk")).alias("text"), F.aggregate("c", zero, step).spans.alias("loss_mask"))


def digests(final: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the renderings.

    Each chunk is parsed again: roles and texts come from its marks, loss text from its mask. Chunks are sorted by
    conversation and position (then role and text) and hashed as they pass, so no conversation is held in memory.
    """
    chunks = rendered(final).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "role", "text")

    def run(stream):
        import pyarrow as pa

        kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        key, state = None, None

        def close():
            n, turns, chars, loss, every = state
            return dict(zip(kinds.names, (key, n, turns.hexdigest(), chars, loss.hexdigest(), every)))

        for batch in stream:
            out = []
            for conv, chunk, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "loss_start", "loss_end"))):
                if state is None or conv != key:
                    if state is not None:
                        out.append(close())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, body = CHUNK.fullmatch(chunk).groups()
                state[0] += 1
                state[1].update(f"{unescaped_role(role)}\n{unescaped(body)}\n".encode())
                if start is not None:
                    text = unescaped(chunk[start:end])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(chunk)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
        if state is not None:
            yield pa.RecordBatch.from_pylist([close()], schema=kinds)

    return chunks.select("conv_id", "chunk", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
