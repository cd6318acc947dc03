"""Prefix trie of conversations by most-significant-digit radix partitioning.

Turns (role, text) become numbers of a dictionary, and a conversation blocks of up to `block` numbers. Conversations of
one block and one past are collapsed to a weighted sequence first, so that copies cost one row. From the root on, buckets
of sequences are dealt by their next number, level by level, in joins and groupings over all buckets at once; every dealt
group is a node. Buckets of at most `local` sequences leave the recursion: a task sorts each of them with multikey
quicksort (three-way partitions by one number after the other), and the recursion emits their nodes. Totals of subtrees go
up the same levels. Blocks follow each other: the next block of a conversation lies in the bucket that its last node is.

A node is named by its smallest member and its depth, since a conversation has one node of each depth.

No step depends on a conversation's or a group's size: turns are numbered by a range sort that splits a conversation,
equal turns, starts and copies are combined in every task before they meet, joins can be split by the skew join, and lists
of members are hashed from sorted chunks.

Defined results: rows without a conv_id take no part; null roles and texts are empty; turns are ordered by number (null
first), of equals by role and then text; repeated rows are turns each; a conversation without turns of its own does not
exist, but may become turnless when it is rebuilt and is then a member of the root alone; an empty table gives no rows;
other columns are ignored. Numbers of negative conversations are rebuilt by a remainder of the dividend's sign.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import checkpoint

#: Turns of a block, and sequences that a task finishes by itself.
BLOCK, LOCAL = 512, 4096
_EMPTY = hashlib.sha256(b"").hexdigest()


# --- Turns: positions and dictionary -----------------------------------------------------------------------------------


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, conv_id, ...) with `at`, their place among the conversation's rows of the partition."""
    last, seen = None, 0
    for batch in batches:
        at = []
        for c in batch.column("conv_id").to_pylist():
            seen = seen + 1 if c == last else 0
            last = c
            at.append(seen)
        yield batch.append_column("at", pa.array(at, pa.int64()))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars) of every turn; `pos` is its place in its conversation, from 0.

    Rows are range-sorted by conversation and turn, so that a long conversation spans several tasks; a task numbers its
    own rows, and what the tasks before hold of its first conversation is added.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn"), text("role").alias("role"), text("text").alias("text")).where("conv_id IS NOT NULL")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    one = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = dealt.select(F.spark_partition_id().alias("part"), "conv_id", F.unhex(F.sha2(one.cast("binary"), 256)).alias("digest"), F.length("text").cast("long").alias("chars"))
    local = checkpoint(kept.mapInArrow(_numbered, "part int, conv_id long, digest binary, chars long, at long"))
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at")).alias("last")).orderBy("part").collect()  # a row a task
    carried, shift, before = {}, 0, None
    for r in ends:
        shift = shift if r["first"] == before else 0
        carried[r["part"]] = (r["first"], shift)
        shift = r["last"]["at"] + 1 + (shift if r["last"]["conv_id"] == r["first"] else 0)
        before = r["last"]["conv_id"]
    moved = [(p, c, s) for p, (c, s) in carried.items() if s]
    at = F.col("at")
    if moved:
        extra = F.broadcast(local.sparkSession.createDataFrame(moved, "part int, conv_id long, shift long"))  # a row a task at most
        return local.join(extra, ["part", "conv_id"], "left").select("conv_id", (at + F.coalesce("shift", F.lit(0))).alias("pos"), "digest", "chars")
    return local.select("conv_id", at.alias("pos"), "digest", "chars")


def encoded(turns: DataFrame) -> DataFrame:
    """`turns` with `code`, the turn's number in a dictionary of all digests, in place of `digest`."""
    words = checkpoint(turns.groupBy("digest").agg(F.count("*").alias("n")).select("digest", F.monotonically_increasing_id().alias("code")))
    return checkpoint(turns.join(words.hint("merge"), "digest").select("conv_id", "pos", "code", "chars"))


def rebuilt(turns: DataFrame, base: Column, most: int, head: Column) -> DataFrame:
    """Turns of the conversations that begin with the first `head` turns (of at most `most`) of conversation `base`, and
    go on with their own after as many; both are columns of conv_id."""
    starts = turns.where(F.col("pos") < most).join(turns.select(base.alias("conv_id")).distinct(), "conv_id", "left_semi")
    starts = checkpoint(starts.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "code", "chars"))).alias("start")))
    of_base = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), head.alias("head"))
    heads = checkpoint(of_base.join(starts.hint("merge"), "base", "left").select("conv_id", "head", F.slice(F.coalesce("start", F.array().cast("array<struct<pos:bigint,code:bigint,chars:bigint>>")), F.lit(1), F.col("head")).alias("start")))
    first = heads.select("conv_id", F.explode("start").alias("t")).select("conv_id", "t.pos", "t.code", "t.chars")
    own = turns.join(heads.select("conv_id", "head", F.size("start").alias("given")).hint("merge"), "conv_id").where(F.col("pos") >= F.col("head"))
    return own.select("conv_id", (F.col("pos") - F.col("head") + F.col("given")).alias("pos"), "code", "chars").unionByName(first)


# --- One task's bucket --------------------------------------------------------------------------------------------------

#: A sequence of a bucket: numbers from `depth` on, their texts' lengths, smallest member, members, members that end with
#: it, the smallest of those, and what follows its end in later blocks (children, leaves, saved).
Sequence = tuple[list[int], list[int], int, int, int, "int | None", int, int, int]


def finish(top: int, depth: int, rows: list[Sequence], at: int = 0) -> list[list]:
    """Nodes [conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, n_end, end] of the trie of distinct
    sequences, compared from number `at` on; the first is the bucket's own node `top`, of which the caller knows the members.

    >>> finish(1, 0, [([7, 8], [2, 3], 1, 1, 1, 1, 0, 0, 0), ([7], [2], 4, 2, 2, 4, 0, 0, 0)])
    [[1, 0, None, 3, 1, 1, 4, 0, None], [1, 1, 1, 3, 1, 1, 4, 2, 4], [1, 2, 1, 1, 0, 1, 0, 1, 1]]
    """
    out = [[top, depth, None, sum(r[3] for r in rows), 0, 0, 0, 0, None]]
    above, todo = [-1], [(rows, at, 0)]
    while todo:
        some, d, node = todo.pop()
        number = [r[0][d] if d < len(r[0]) else -1 for r in some]
        pivot = number[len(some) // 2]
        same = [r for r, k in zip(some, number) if k == pivot]
        if len(same) < len(some):
            parts = [r for r, k in zip(some, number) if k < pivot], [r for r, k in zip(some, number) if k > pivot]
            todo += [(part, d, node) for part in parts if part]
        if pivot == -1:  # sequences are distinct: one ends here
            r = same[0]
            of = out[node]
            of[4], of[5], of[6], of[7], of[8] = of[4] + r[6], of[5] + r[7], of[6] + r[8], r[4], r[5]
            continue
        n, chars = sum(r[3] for r in same), same[0][1][d]
        above.append(node)
        out[node][4] += 1
        out.append([min(r[2] for r in same), depth + d + 1 - at, out[node][0], n, 0, 0, (n - 1) * chars, 0, None])
        todo.append((same, d + 1, len(out) - 1))
    for k in range(len(out) - 1, -1, -1):
        row = out[k]
        if not row[4]:
            row[5] = 1
        if k:
            up = out[above[k]]
            up[5] += row[5]
            up[6] += row[6]
    return out


_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_end long, end_id long"
_NODE_ARROW = pa.schema([("top", pa.bool_()), *((f.split()[0], pa.int32() if f.endswith(" int") else pa.int64()) for f in _NODE.split(", "))])
_FIELDS = ("bucket", "depth", "skip", "codes", "chars", "m", "n", "n_end", "end_id", "children", "leaves", "saved")


def _finish_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all buckets of a partition, whose rows are sorted by bucket; one bucket is held at a time."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in _FIELDS))

    made: list[list] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _NODE_ARROW)], schema=_NODE_ARROW)
        made.clear()
        return out

    for (bucket, depth), some in groupby(rows(), key=lambda r: r[:2]):
        held = list(some)
        nodes = finish(bucket, depth, [r[3:] for r in held], held[0][2])
        made += [[k == 0, *n] for k, n in enumerate(nodes)]
        if len(made) >= 20_000:
            yield flush()
    if made:
        yield flush()


# --- Levels ---------------------------------------------------------------------------------------------------------------


def _sums(rows: DataFrame) -> DataFrame:
    """What children add to their parents: (conv_id, depth, children, leaves, saved) of the parent."""
    return rows.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).cast("int").alias("depth")).agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )


def _block_nodes(sequences: DataFrame, local: int, force: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes below the buckets of one block's `sequences`, and what they add to the buckets (conv_id, depth, children, leaves, saved).

    Buckets are (bucket, depth). Those of more than `local` sequences are dealt by their next number; with `force` the
    first level is dealt, whatever its size. `skip` numbers of a sequence lie above its bucket.
    """
    todo, small, levels = sequences.withColumn("skip", F.lit(0)), [], []
    while True:
        sizes = todo.groupBy("bucket", "depth").agg(F.count("*").alias("sequences"), F.max(F.size("codes") - F.col("skip")).alias("longest"))
        if not (force and not levels):
            big = checkpoint(sizes.where((F.col("sequences") > local) & (F.col("longest") > 0)).select("bucket", "depth"))
            if big.isEmpty():
                small.append(todo)
                break
            small.append(todo.join(big.hint("merge"), ["bucket", "depth"], "left_anti"))
            todo = todo.join(big.hint("merge"), ["bucket", "depth"], "left_semi")
        ends = todo.where(F.size("codes") == F.col("skip"))
        small.append(ends)  # the sequence that ends with its bucket
        live = todo.where(F.size("codes") > F.col("skip")).withColumn("code", F.element_at("codes", F.col("skip") + 1))
        dealt = live.groupBy("bucket", "depth", "code").agg(F.min("m").alias("child"), F.sum("n").alias("n_convs"), F.first(F.element_at("chars", F.col("skip") + 1)).alias("last"))
        dealt = checkpoint(dealt)
        levels.append(dealt.select(F.col("child").alias("conv_id"), (F.col("depth") + 1).cast("int").alias("depth"), F.col("bucket").alias("parent_conv_id"), "n_convs", ((F.col("n_convs") - 1) * F.col("last")).alias("own")))
        todo = live.join(dealt.select("bucket", "depth", "code", "child").hint("merge"), ["bucket", "depth", "code"])
        todo = checkpoint(todo.select(F.col("child").alias("bucket"), (F.col("depth") + 1).cast("int").alias("depth"), (F.col("skip") + 1).alias("skip"), *_FIELDS[3:]))
    pool = small[0]
    for s in small[1:]:
        pool = pool.unionByName(s)
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pool.select(*_FIELDS).repartition(parts, "bucket", "depth").sortWithinPartitions("bucket", "depth", "m")
    found = checkpoint(dealt.mapInArrow(_finish_all, f"top boolean, {_NODE}"))
    nodes = found.where("NOT top").drop("top")
    # A bucket's own row says what its sequences add; where it was dealt, only the one that ends with it is in the pool.
    tops = found.where("top").select("conv_id", "depth", F.col("n_children").alias("children"), F.when(F.col("n_children") == 0, 0).otherwise(F.col("n_leaves")).alias("leaves"), F.col("saved_tokens").alias("saved"), "n_end", "end_id")
    below = tops
    for level in reversed(levels):
        total = below.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")], F.max("n_end").alias("n_end"), F.max("end_id").alias("end_id"))
        joined = level.join(total.hint("merge"), ["conv_id", "depth"], "left")
        children = F.coalesce("children", F.lit(0))
        done = checkpoint(
            joined.select(
                "conv_id", "depth", "parent_conv_id", "n_convs", children.alias("n_children"), F.when(children == 0, F.lit(1)).otherwise(F.col("leaves")).alias("n_leaves"),
                (F.col("own") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), F.coalesce("n_end", F.lit(0)).alias("n_end"), "end_id",
            )
        )
        nodes = nodes.unionByName(done)
        below = tops.unionByName(_sums(done).withColumn("n_end", F.lit(0).cast("long")).withColumn("end_id", F.lit(None).cast("long")))
    return nodes, below.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])


def _ids(batches: Iterator[pa.RecordBatch], chunk: int = 512) -> Iterator[pa.RecordBatch]:
    """(end_id, first, text): sorted ids of a group, up to `chunk` of them to a row."""
    pair = lambda b: zip(b.column("end_id").to_pylist(), b.column("conv_id").to_pylist())
    rows = (r for b in batches for r in pair(b))
    made: list[tuple] = []
    for end, some in groupby(rows, key=lambda r: r[0]):
        held: list[int] = []
        for _, c in some:
            held.append(c)
            if len(held) == chunk:
                made.append((end, held[0], ",".join(map(str, held))))
                held = []
        if held:
            made.append((end, held[0], ",".join(map(str, held))))
        if len(made) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["end_id", "first", "text"])
            made = []
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["end_id", "first", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(end_id, sha256) of each group's chunks, hashed one after the other."""
    rows = (r for b in batches for r in zip(b.column("end_id").to_pylist(), b.column("text").to_pylist()))
    ends, digests = [], []
    for end, some in groupby(rows, key=lambda r: r[0]):
        h = None
        for _, text in some:
            if h is None:
                h = hashlib.sha256()
            else:
                h.update(b",")
            h.update(text.encode())
        ends.append(end)
        digests.append(h.hexdigest())
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array(digests)], ["end_id", "sha256"])


def id_digests(members: DataFrame) -> DataFrame:
    """(end_id, sha256) of the ascending, comma-joined conv_ids of each group of `members` (end_id, conv_id). Ids are
    sorted over all tasks and joined to chunks, and a group's chunks are hashed in a stream."""
    chunks = members.repartitionByRange("end_id", "conv_id").sortWithinPartitions("end_id", "conv_id").mapInArrow(_ids, "end_id long, first long, text string")
    return chunks.repartition("end_id").sortWithinPartitions("end_id", "first").mapInArrow(_digests, "end_id long, sha256 string")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, local: int = LOCAL) -> DataFrame:
    """The nodes of the trie of `turns` (conv_id, pos, code, chars) of the conversations `convs` (conv_id), which may have
    none: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs = checkpoint(convs.select("conv_id").distinct())
    everyone = convs.agg(F.min("conv_id").alias("m"), F.count("*").alias("n")).first()
    kind = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not everyone["n"]:
        return convs.sparkSession.createDataFrame([], kind)
    k = F.floor(F.col("pos") / block).cast("int")
    pairs = turns.groupBy("conv_id", k.alias("k")).agg(F.sort_array(F.collect_list(F.struct("pos", "code", "chars"))).alias("t"))
    blocks = pairs.select("conv_id", "k", F.col("t.code").alias("codes"), F.col("t.chars").alias("chars"))
    last = turns.groupBy("conv_id").agg(F.max(k).alias("last"))
    blocks = checkpoint(blocks.join(last.hint("merge"), "conv_id").select("conv_id", "k", "codes", "chars", (F.col("k") == F.col("last")).alias("final")))
    rounds = (blocks.agg(F.max("k").alias("k")).first()["k"] or 0) + 1

    # Forward: conversations of one past and one block collapse, and are the bucket of the next block.
    state = blocks.where("k = 0").select("conv_id", "codes", "chars", "final", F.lit(everyone["m"]).cast("long").alias("bucket"))
    collapsed, members = [], []
    for r in range(rounds):
        by = ["bucket", "codes"]
        classes = checkpoint(state.groupBy(*by).agg(
            F.min("conv_id").alias("m"), F.count("*").alias("n"), F.count_if("final").alias("n_end"), F.min(F.when(F.col("final"), F.col("conv_id"))).alias("end_id"), F.first("chars").alias("chars")))
        collapsed.append(classes)
        several = classes.where("n_end > 1").select(*by, "end_id")
        members.append(state.where("final").select("conv_id", *by).join(several.hint("merge"), by).select("end_id", "conv_id"))
        if r + 1 < rounds:
            going = state.where("NOT final").select("conv_id", *by).join(classes.select(*by, "m").hint("merge"), by).select("conv_id", F.col("m").alias("bucket"))
            state = checkpoint(blocks.where(F.col("k") == r + 1).select("conv_id", "codes", "chars", "final").join(going.hint("merge"), "conv_id"))

    # Backward: what follows a sequence's end is known when its own block's turn comes.
    nodes, after = None, None
    for r in reversed(range(rounds)):
        rows = collapsed[r].withColumn("depth", F.lit(r * block).cast("int"))
        if after is None:
            rows = rows.select("*", *[F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")])
        else:
            kept = after.select(F.col("conv_id").alias("m"), "children", "leaves", "saved")
            rows = rows.join(kept.hint("merge"), "m", "left").fillna(0, ["children", "leaves", "saved"])
        got, after = _block_nodes(rows, local, force=r == 0)
        after = checkpoint(after.where(F.col("depth") == r * block))
        nodes = got if nodes is None else nodes.unionByName(got)

    # The root; conversations without turns end there.
    silent = convs.join(blocks.select("conv_id").distinct(), "conv_id", "left_anti").select(F.lit(None).cast("long").alias("end_id"), "conv_id")
    for m in members:
        silent = silent.unionByName(m)
    lists = silent.withColumn("end_id", F.coalesce("end_id", F.lit(everyone["m"]) - 1))  # below every conversation: the root's
    digests = checkpoint(id_digests(lists))
    total = after.first()
    children = total["children"] if total else 0
    root = convs.sparkSession.createDataFrame(
        [(everyone["m"], 0, None, everyone["n"], children, total["leaves"] if children else 1, total["saved"] if children else 0, 2, everyone["m"] - 1)], _NODE)
    every = nodes.unionByName(root)
    alone = F.when(F.col("n_end") == 1, F.sha2(F.col("end_id").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY))
    both = every.join(digests.hint("merge"), "end_id", "left")
    return both.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", alone).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, group: int = 100, heads: int = 6, block: int = BLOCK, local: int = LOCAL) -> DataFrame:
    """The trie of rebuilt `conversations` (conv_id, turn, role, text): conversation c begins with the first h turns of
    conversation c - c % `group`, h = crc32(c as text) % `heads`, and goes on with its own after its first h."""
    c = F.col("conv_id")
    turns = encoded(numbered_turns(conversations))
    head = (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    return trie(checkpoint(rebuilt(turns, c - c % group, heads - 1, head)), turns.select("conv_id"), block, local)
