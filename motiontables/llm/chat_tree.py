"""Chat formatting as a prefix tree: turns that conversations share are emitted once.

A node is a turn with all turns before it; its key is a hash chained over them. Conversations sorted by
their chain of keys are a depth-first walk: a node belongs to the first conversation that has it. A node
holds its formatted text, its token ids, the stretch of them under the loss mask (an assistant's words),
its place in the tree's sequence, the position id of its first token (the tokens of its ancestors) and
the intervals of the sequence its ancestors cover: a token attends to these and to its own node so far.

The sequence is a range sort of the distinct conversations and running sums per slice of that order
carried over slice sums, so a first turn that very many conversations share is no single task's.

Template: ``[INST] user [/INST]``, `` assistant </s>``, ``<<SYS>> system <</SYS>>``, any other role
``<role:name> text </role>``. Control strings inside texts are escaped reversibly: a backslash doubles,
and a control string's first character is written ``\\l`` for ``<`` or ``\\b`` for ``[``.

Defined cases: null texts and roles are empty; a null conv_id is a conversation of its own; turns go by
turn, role, text, nulls first, and repeated rows stay; an empty table gives empty results; further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

KEY = 16  # bytes of a node key
CONTROL = re.compile(r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<role:|</role>")
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}


def escaped(text: str) -> str:
    return CONTROL.sub(lambda m: {"\\": "\\\\", "<": "\\l", "[": "\\b"}[m[0][0]] + m[0][1:], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\([\\lb])", lambda m: {"\\": "\\", "l": "<", "b": "["}[m[1]], text)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the words of a turn, the words, and what stands after them."""
    before, after = MARKS.get(role) or (f"<role:{base64.b16encode(role.encode()).decode()}> ", " </role>")
    return before, escaped(text), after


def read_turn(text: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    for role, (before, after) in MARKS.items():
        if text.startswith(before) and text.endswith(after) and len(text) >= len(before) + len(after):
            return role, unescaped(text[len(before): len(text) - len(after)])
    name, _, rest = text.removeprefix("<role:").partition("> ")
    return base64.b16decode(name).decode(), unescaped(rest.removesuffix(" </role>"))


def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def keyed(turns: DataFrame) -> DataFrame:
    """Every turn with its number in the conversation, its node key and its parent's; streamed in order."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, key, depth = object(), b"", 0
        for batch in batches:
            keys, parents, depths = [], [], []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if c != conv:
                    conv, key, depth = c, b"", 0
                parents.append(key or None)
                key = hashlib.sha256(b"%s%d\0%s\0%s" % (key, len(role), role.encode(), text.encode())).digest()[:KEY]
                keys.append(key)
                depths.append(depth)
                depth += 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depths, pa.int32()), pa.array(keys, pa.binary()),
                                              pa.array(parents, pa.binary()), batch.column("role"), batch.column("text")],
                                             ["conv_id", "depth", "node", "parent", "role", "text"])

    return ordered.mapInArrow(run, "conv_id long, depth int, node binary, parent binary, role string, text string")


def paths_of(rows: DataFrame) -> DataFrame:
    """(conv_id, path): the node keys of each conversation, one after the other."""
    ordered = rows.select("conv_id", "depth", "node").repartition("conv_id").sortWithinPartitions("conv_id", "depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, path = None, []
        for batch in batches:
            out = []
            for c, depth, node in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "depth", "node"))):
                if depth == 0 and path:
                    out.append((conv, b"".join(path)))
                    path = []
                conv = c
                path.append(node)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())],
                                             ["conv_id", "path"])
        if path:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([b"".join(path)], pa.binary())], ["conv_id", "path"])

    return ordered.mapInArrow(run, "conv_id long, path binary")


def node_tokens(nodes: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path)
        for batch in batches:
            ids, start, end = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                before, words, after = (own.encode_ordinary(x) for x in formatted(role, text))
                ids.append(before + words + after)
                start.append(len(before))
                end.append(len(before) + (len(words) if role == "assistant" else 0))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("parent"), batch.column("depth"),
                                              pa.array(ids, pa.list_(pa.int32())), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                                             ["node", "parent", "depth", "token_ids", "loss_start", "loss_end"])

    return nodes.mapInArrow(run, "node binary, parent binary, depth int, token_ids array<int>, loss_start int, loss_end int")


def prefix_tree(conversations: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, turns). nodes: tree, node, parent, depth, token_ids, loss_start, loss_end, offset (place in the tree's
    sequence), position (id of its first token), ancestors (intervals of the sequence). turns: conv_id, depth, node."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = written(keyed(turns_of(conversations)))
    nodes = written(node_tokens(rows.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("role").alias("role"),
        F.first("text").alias("text")), tokenizer))
    walk = written(paths_of(rows).select("path").distinct().orderBy("path").withColumn("rank", F.monotonically_increasing_id()))
    number = F.sequence(F.lit(0), (F.length("path") / KEY).cast("int") - 1)
    steps = walk.select("rank", F.expr(f"substring(path, 1, {KEY})").alias("tree"), "path", F.explode(number).alias("depth")).select(
        "rank", "tree", "depth", F.expr(f"substring(path, depth * {KEY} + 1, {KEY})").alias("node"))
    owners = steps.groupBy("node").agg(F.min("rank").alias("owner"), F.first("tree").alias("tree"))
    sized = owners.join(nodes.select("node", "depth", F.size("token_ids").alias("n")), "node").withColumn(
        "slice", F.shiftright("owner", 33))  # the range partition the owner was sorted into
    inside = F.sum("n").over(Window.partitionBy("tree", "slice").orderBy("owner", "depth")) - F.col("n")
    sums = sized.groupBy("tree", "slice").agg(F.sum("n").alias("total"))
    before = sums.withColumn("base", F.sum("total").over(Window.partitionBy("tree").orderBy("slice")) - F.col("total")).drop("total")
    placed = written(sized.withColumn("inside", inside).join(before, ["tree", "slice"]).select(
        "node", "tree", "owner", "n", (F.col("base") + F.col("inside")).alias("offset")))

    along = steps.select("rank", "depth", "node").join(placed, "node").repartition("rank").sortWithinPartitions("rank", "depth")

    def ancestry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, spans, position = None, [], 0
        for batch in batches:
            out = []
            for r, node, tree, owner, n, offset in zip(*(batch.column(x).to_pylist() for x in ("rank", "node", "tree", "owner", "n", "offset"))):
                if r != rank:
                    rank, spans, position = r, [], 0
                if owner == r:
                    out.append((node, tree, offset, position, [{"start": a, "end": b} for a, b in spans]))
                if spans and spans[-1][1] == offset:
                    spans[-1] = (spans[-1][0], offset + n)
                elif n:
                    spans.append((offset, offset + n))
                position += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.int64(),
                 pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))], ["node", "tree", "offset", "position", "ancestors"])

    places = along.mapInArrow(ancestry, "node binary, tree binary, offset long, position long, "
                                        "ancestors array<struct<start: long, end: long>>")
    out = nodes.join(places, "node").select("tree", "node", "parent", "depth", "token_ids", "loss_start", "loss_end",
                                            "offset", "position", "ancestors")
    return out, rows.select("conv_id", "depth", "node")


def read_back(nodes: DataFrame, turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per conversation, from the tree's tokens: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = turns.join(nodes.select("node", "token_ids", "loss_start", "loss_end"), "node").select(
        "conv_id", "depth", "token_ids", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(tokenizer)
        state = None

        def closed() -> tuple:
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        def table(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)

        for batch in batches:
            out = []
            for conv, depth, ids, a, b in zip(*(batch.column(x).to_pylist() for x in batch.schema.names)):
                if depth == 0:
                    if state:
                        out.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = own.decode_bytes(ids).decode("utf-8")
                role, words = read_turn(text)
                loss = unescaped(own.decode_bytes(ids[a:b]).decode("utf-8"))
                state[1] += 1
                state[2].update(f"{role}\n{words}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(text)
            yield table(out)
        if state:
            yield table([closed()])

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
