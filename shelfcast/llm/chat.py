"""Chat formatting as prefix trees: conversations that share their first turns share the tokens of these turns.

Every turn is rendered with a template. A node is a turn together with all turns before it; its name is a chained
digest. Conversations are sorted by the names of their nodes, so each follows the one with which it shares most, and
adds a *segment*: the turns that are not shared. The segments of a tree, in this order, are its depth-first order, in
which each shared turn is emitted once. A token's position id is its place in its conversation; it attends to the
tokens before it in its segment and to the intervals of the shared turns, the segment's ancestors.

A tree may hold a third of all conversations: the sort is by ranges, each task compares neighbours in its range, and
what crosses a range boundary (one row per range) is put right afterwards. Equal conversations are one.

Template: ``<s>role[INST] text [/INST]</s>`` for each turn. Where a role or text contains a control string, a backslash
goes after its first character, as after that of one that has such backslashes already; reading takes one away. So
text never shows a control string and every text can be read back. The loss mask covers the texts of the assistant.

Tokens are the UTF-8 bytes of the rendered text, or the ids of a public tokenizer whose file is given by its path.

Defined results: a null role or text is empty; rows with a null id are one conversation; rows of one conversation are
ordered by turn, then role, then text, a null turn first.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from shelfcast.llm.common import map_rows, materialize

OPEN, MIDDLE, CLOSE = "<s>", "[INST] ", " [/INST]</s>"
#: First character and rest of the control strings ``<s> </s> [INST] [/INST]``.
CONTROL = r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])"
ESCAPED = r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])"
TURN = r"(?s)<s>(.*?)\[INST\] (.*?) \[/INST\]</s>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$2$3")


def rendered(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, turns)``: the rendered turns in order, each with the interval of its loss mask in characters."""
    speaker, body = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    head = F.concat(F.lit(OPEN), escape(speaker), F.lit(MIDDLE))
    start = F.when(speaker == ASSISTANT, F.length(head)).otherwise(F.lit(0))
    stop = F.when(speaker == ASSISTANT, F.length(head) + F.length(escape(body))).otherwise(F.lit(0))
    row = F.struct(
        F.col(turn).alias("turn"), speaker.alias("role"), body.alias("text"),
        F.concat(head, escape(body), F.lit(CLOSE)).alias("formatted"), start.alias("loss_start"), stop.alias("loss_stop"),
    )
    one = conversations.groupBy(F.col(conv_id).alias("conv")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    turns = F.transform("rows", lambda r: F.struct(r["formatted"], r["loss_start"], r["loss_stop"]))
    return one.select("conv", turns.alias("turns"))


def named(conversations: DataFrame, tokenizer: str | None) -> DataFrame:
    """Adds ``nodes``, ``lengths`` (tokens per turn), ``tree`` and ``leaf``."""

    def make():
        if tokenizer is None:
            count = lambda text: len(text.encode())
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(tokenizer)
            count = lambda text: len(model.encode(text, add_special_tokens=False).ids)

        def kernel(_, part):
            nodes, lengths = [], []
            for turns in part.column("turns").to_pylist():
                name, own = b"", []
                for t in turns:
                    name = md5(name + t["formatted"].encode()).digest()
                    own.append(name.hex())
                nodes.append(own)
                lengths.append([count(t["formatted"]) for t in turns])
            return [pa.array(nodes, pa.list_(pa.string())), pa.array(lengths, pa.list_(pa.int64()))]

        return kernel

    sized = conversations.withColumn("_size", F.array_join("turns.formatted", ""))
    fields = [StructField("nodes", ArrayType(StringType())), StructField("lengths", ArrayType(LongType()))]
    out = map_rows(sized, make, fields, "_size", conversations.columns)
    return out.withColumn("tree", F.element_at("nodes", 1)).withColumn("leaf", F.element_at("nodes", -1))


def shared_nodes(a: Column, b: Column) -> Column:
    """Equal elements at the start of two arrays; zero if one is null."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first_other = F.array_position(same, False)
    return F.coalesce(F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int"), F.lit(0))


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda n, x: n + x)


def segments(classes: DataFrame) -> DataFrame:
    """Adds ``shared`` (turns taken from before), ``start`` (first token in the tree) and ``position`` (first id)."""
    ranged = classes.repartitionByRange("nodes").sortWithinPartitions("nodes")
    extra = [("part", IntegerType()), ("at", LongType()), ("shared", IntegerType()), ("before", LongType())]
    schema = StructType([*classes.schema.fields, *[StructField(n, t) for n, t in extra]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        last: list[str] = []
        emitted = 0
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for nodes, lengths in zip(batch.column("nodes").to_pylist(), batch.column("lengths").to_pylist()):
                n = 0
                while n < min(len(nodes), len(last)) and nodes[n] == last[n]:
                    n += 1
                if not n:
                    emitted = 0
                rows.append((part, at, n, emitted))
                emitted += sum(lengths[n:])
                last, at = nodes, at + 1
            columns = list(zip(*rows)) or [()] * 4
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            new = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    rows = materialize(ranged.mapInArrow(compare, schema), "ordered-chats")
    # The first row of a range against the last row of the range before: one row per range.
    edges = rows.groupBy("part").agg(F.min_by(F.struct("nodes", "lengths"), "at").alias("first"), F.max_by("nodes", "at").alias("last"))
    in_order = Window.orderBy("part")
    carried = shared_nodes(F.col("first.nodes"), F.lag("last").over(in_order))
    edges = edges.select(
        "part", carried.alias("carried"), F.element_at("first.nodes", 1).alias("first_tree"), F.col("first.lengths").alias("lens")
    ).select("part", "carried", "first_tree", total(F.slice("lens", 1, F.col("carried"))).alias("saved"))
    edges = materialize(edges.where("carried > 0"), "range-edges")
    rows = rows.join(edges, "part", "left")
    first, continued = F.col("at") == 0, F.col("tree") == F.col("first_tree")
    saved = F.coalesce("saved", F.lit(0))
    rows = rows.select(
        *classes.columns, "part", "at",
        F.when(first, F.coalesce("carried", F.lit(0))).otherwise(F.col("shared")).alias("shared"),
        (F.col("before") - F.when(continued & ~first, saved).otherwise(0)).alias("before"),
    )
    new = total(F.col("lengths")) - total(F.slice("lengths", 1, F.col("shared")))
    sums = rows.groupBy("tree", "part").agg(F.sum(new).alias("tokens"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("tree", "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("offset"))
    placed = rows.join(materialize(sums, "tree-offsets"), ["tree", "part"])
    return placed.select(
        *classes.columns, "shared", (F.col("before") + F.col("offset")).alias("start"),
        total(F.slice("lengths", 1, F.col("shared"))).alias("position"),
    )


NODE = StructType(
    [StructField(n, StringType()) for n in ("node", "parent")]
    + [StructField("depth", IntegerType())]
    + [StructField(n, LongType()) for n in ("start", "length", "position")]
    + [StructField("formatted", StringType())]
    + [StructField(n, IntegerType()) for n in ("loss_start", "loss_stop")]
)


def emitted_nodes(segs: DataFrame) -> DataFrame:
    """One row per node, with its place in the depth-first tokens of its tree."""

    def make():
        def kernel(_, part):
            out = []
            for row in part.select(["turns", "nodes", "lengths", "shared", "start", "position"]).to_pylist():
                own, start, position = [], row["start"], row["position"]
                for d in range(row["shared"], len(row["nodes"])):
                    n = row["lengths"][d]
                    own.append(
                        {"node": row["nodes"][d], "parent": row["nodes"][d - 1] if d else None, "depth": d, "start": start,
                         "length": n, "position": position, **row["turns"][d]}
                    )
                    start, position = start + n, position + n
                out.append(own)
            kind = pa.list_(pa.struct([(f.name, _ARROW[type(f.dataType)]) for f in NODE.fields]))
            return [pa.array(out, kind)]

        return kernel

    sized = segs.withColumn("_size", F.array_join("turns.formatted", ""))
    return map_rows(sized, make, [StructField("rows", ArrayType(NODE))], "_size", ["tree"]).select("tree", F.inline("rows"))


_ARROW = {StringType: pa.string(), IntegerType: pa.int32(), LongType: pa.int64()}


def format_chats(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    tokenizer: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables.

    * nodes: ``tree, node, parent, depth, start, length, position, formatted, loss_start, loss_stop``, a row per turn
      and history; ``start`` counts the tokens of the tree in depth-first order, ``position`` is its first position id;
    * segments: ``tree, leaf, nodes, start, length, position, ancestors``, a row per different conversation;
      ``ancestors`` are the ``[start, stop]`` token intervals to which all its tokens attend besides its own earlier
      ones;
    * members: ``conv, leaf``, a row per conversation.
    """
    chats = materialize(named(rendered(conversations, conv_id, turn, role, text), tokenizer), "chats")
    classes = chats.groupBy("leaf").agg(*[F.first(c).alias(c) for c in ("tree", "nodes", "lengths", "turns")])
    segs = materialize(segments(materialize(classes, "chat-classes")), "segments")
    nodes = materialize(emitted_nodes(segs), "nodes")
    # The intervals of shared turns; the root of a large tree is a hot key of this join.
    asked = segs.select("leaf", F.explode(F.slice("nodes", 1, F.col("shared"))).alias("node"))
    spot = nodes.select("node", F.struct("depth", "start", (F.col("start") + F.col("length")).alias("stop")).alias("spot"))
    spots = asked.join(spot, "node").groupBy("leaf").agg(F.sort_array(F.collect_list("spot")).alias("spots"))
    touching = F.aggregate(
        "spots",
        F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, stop: BIGINT>>)"),
        lambda done, s: F.when(
            F.try_element_at(done, F.lit(-1))["stop"] == s["start"],
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), s["stop"].alias("stop"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))),
    )
    ancestors = materialize(spots.select("leaf", touching.alias("ancestors")), "ancestors")
    length = total(F.slice("lengths", F.col("shared") + 1, F.size("lengths")))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, stop: BIGINT>>)")
    full = segs.join(ancestors, "leaf", "left").select(
        "tree", "leaf", "nodes", "start", length.alias("length"), "position",
        F.coalesce("ancestors", none).alias("ancestors"),
    )
    return nodes, full, chats.select("conv", "leaf")


def read_back(nodes: DataFrame, segs: DataFrame) -> DataFrame:
    """``(leaf, formatted, roles, texts, learned)`` of every different conversation, from the emitted nodes alone.

    ``learned`` is the unescaped text under the loss mask, joined.
    """
    path = segs.select("leaf", F.explode("nodes").alias("node"))
    own = nodes.select("node", F.struct("depth", "formatted", "loss_start", "loss_stop").alias("row"))
    rows = path.join(own, "node").groupBy("leaf").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    formatted = F.array_join(F.transform("rows", lambda r: r["formatted"]), "")
    masked = F.transform(
        "rows", lambda r: unescape(F.substring(r["formatted"], r["loss_start"] + 1, r["loss_stop"] - r["loss_start"]))
    )
    parts = rows.select("leaf", formatted.alias("formatted"), F.array_join(masked, "").alias("learned"))
    each = lambda i: F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(i)), unescape)
    return parts.select("leaf", "formatted", each(1).alias("roles"), each(2).alias("texts"), "learned")
