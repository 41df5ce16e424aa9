"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

1. Turns are put in order by ranges of (conv_id, turn), so that a conversation of any
   length is spread over tasks. Each task numbers its rows and keeps a running
   polynomial hash of the turns so far (modulo 2**127 - 1); what a conversation brings
   over a border between tasks, one entry a border, is added afterwards. Conversations
   that begin with the same turns have the same hash there: a node of the trie.
2. Nodes are counted by their hash, so a node below which a third of all conversations
   lie is summed up before it is shuffled.
3. Subtree totals come from tree contraction. A phase first compresses: every unary
   chain is followed by pointer doubling, one join a round, and its nodes leave the tree,
   each knowing the node at the chain's end and what lies between. Then it rakes: leaves
   give their totals to their parents. Afterwards every inner node has two children or
   more, or is the root, so a phase removes more than half of what is left. Nodes that
   were compressed are expanded in reverse order, each from the end of its chain.
4. The ids of the conversations that end at a node are put in order by ranges as well;
   text blocks of a node that reaches over a border are digested in order, a block at a time.

Cases: rows with a null conv_id are left out; a null role or text is empty; turns of equal
number (or null) come in the order of their digests, repeated rows count as often as they
occur; very long texts enter by their digest only; columns other than conv_id, turn, role
and text are ignored; an empty table has no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitile.llm.shared import materialize

PRIME, RATIO = (1 << 127) - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15
ROOT = bytes(16)
#: Ids of a text block of a node's ends.
BLOCK_IDS = 512
_SCANNED = "part int, conv_id long, pos long, size long, digest binary, before binary, path binary"


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _scan(batches):
    """Number of each row within its conversation, hash before and after it, as far as this task has seen."""
    conv, pos, path = None, 0, 0
    for batch in batches:
        out = []
        for part, c, digest, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if c != conv:
                conv, pos, path = c, 0, 0
            before = path
            pos, path = pos + 1, (path * RATIO + int.from_bytes(digest, "big")) % PRIME
            out.append((part, c, pos, size, digest, _bytes(before), _bytes(path)))
        if out:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in _SCANNED.split(", ")])


def _carry(batches):
    """Adds what came before a task's rows of a conversation: ``shift`` rows of hash ``start``."""
    for batch in batches:
        rows = batch.to_pydict()
        shift = rows.pop("shift")
        start = [int.from_bytes(s, "big") for s in rows.pop("start")]
        for name, back in (("before", 1), ("path", 0)):
            rows[name] = [_bytes((int.from_bytes(x, "big") + s * pow(RATIO, p - back, PRIME)) % PRIME) for x, s, p in zip(rows[name], start, rows["pos"], strict=True)]
        rows["pos"] = [p + s for p, s in zip(rows["pos"], shift, strict=True)]
        yield pa.RecordBatch.from_pydict(rows, schema=batch.schema.remove(batch.schema.get_field_index("start")).remove(batch.schema.get_field_index("shift")))


def scanned(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of (conv_id, digest, size, order) with pos, before and path; (conv_id, n, path) of whole conversations."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    placed = placed.select(F.spark_partition_id().alias("part"), "conv_id", "digest", "size")
    local = materialize(placed.mapInArrow(_scan, _SCANNED), "scan")
    ends = local.groupBy("conv_id", "part").agg(F.max("pos").alias("n"), F.max_by("path", "pos").alias("path"))
    ends = materialize(ends, "scan-ends")
    # conversations over a border: at most one for each border between two tasks
    over = ends.groupBy("conv_id").agg(F.count("*").alias("parts"), F.array_sort(F.collect_list(F.struct("part", "n", "path"))).alias("of")).filter("parts > 1")
    shifts, finals = [], []
    for r in over.collect():
        n, path = 0, 0
        for x in r.of:
            if n:
                shifts.append((x.part, r.conv_id, n, bytearray(_bytes(path))))
            n, path = n + x.n, (path * pow(RATIO, x.n, PRIME) + int.from_bytes(x.path, "big")) % PRIME
        finals.append((r.conv_id, n, bytearray(_bytes(path))))
    border = F.broadcast(spark.createDataFrame(shifts, "part int, conv_id long, shift long, start binary"))
    final = F.broadcast(spark.createDataFrame(finals, "conv_id long, n long, path binary"))
    moved = local.join(border, ["part", "conv_id"]).mapInArrow(_carry, local.schema)
    whole = ends.join(final, "conv_id", "left_anti").select("conv_id", "n", "path").union(final)
    return local.join(border, ["part", "conv_id"], "left_anti").select(local.columns).union(moved.select(local.columns)), whole


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, size, digest) of all turns, numbered from 1, and (conv_id, n) of all conversations."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.octet_length(text).cast("long").alias("size"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
    )
    turns, whole = scanned(rows, ["turn", "digest"])
    return turns.select("conv_id", "pos", "size", "digest"), whole.select("conv_id", "n")


def _digests(batches):
    """SHA-256 of each node's ids where this task holds all of them for certain, else blocks of text."""
    node, first, ids, whole = None, None, [], False
    out: list[tuple] = []

    def cut(end: bool):
        """Puts out what is held; ``end``: another node follows in this task."""
        nonlocal ids, whole
        if ids:
            text = ",".join(map(str, ids))
            out.append((node, first, None, hashlib.sha256(text.encode()).hexdigest()) if whole and end else (node, first, text, None))
        ids = []

    def batch_of():
        rows = [list(x) for x in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "first", "ids", "ends_sha256"])

    seen = False
    for batch in batches:
        for path, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if path != node:
                cut(True)
                # the first node of a task may have begun in the task before
                node, first, whole, seen = path, conv, seen, True
            elif len(ids) >= BLOCK_IDS:
                cut(False)
                first, whole = conv, False
            ids.append(conv)
        if out:
            yield batch_of()
    cut(False)
    if out:
        yield batch_of()


def _joined(batches):
    """SHA-256 of the text blocks of each node, which come in order."""
    node, sha = None, None
    for batch in batches:
        out = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if path != node:
                if sha is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = path, hashlib.sha256(text.encode())
            else:
                sha.update(("," + text).encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["path", "ends_sha256"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], ["path", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(path, ends_sha256) from (path, conv_id): SHA-256 of a node's ids in ascending order, joined by commas."""
    rows = ends.select("path", "conv_id").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    cut = materialize(rows.mapInArrow(_digests, "path binary, first long, ids string, ends_sha256 string"), "ends")
    # a node has a digest or blocks, never both: it is cut in blocks from its first id on
    blocks = cut.filter("ids is not null").repartition("path").sortWithinPartitions("path", "first").select("path", "ids")
    return cut.filter("ids is null").select("path", "ends_sha256").union(blocks.mapInArrow(_joined, "path binary, ends_sha256 string"))


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(id, saved, leaves): sums over the subtree of each of ``nodes(id, parent, saved)``; the root's parent is null."""
    alive = nodes.select("id", "parent", "saved", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("edge_saved"), F.lit(0).cast("long").alias("edge_leaves"))
    phases: list[tuple[DataFrame, DataFrame]] = []
    while True:
        kids = alive.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"), F.max("id").alias("only"), F.max("edge_saved").alias("kid_saved"), F.max("edge_leaves").alias("kid_leaves"))
        state = alive.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
        if not phases:
            state = state.withColumn("leaves", F.when(F.col("kids") == 0, 1).otherwise(0).cast("long"))
        state = materialize(state, "trie-state")
        # compress: each node of a unary chain learns the chain's end and what lies between
        is_chain = (F.col("kids") == 1) & F.col("parent").isNotNull()
        links = state.filter(is_chain).select("id", F.col("only").alias("next"), (F.col("saved") + F.col("kid_saved")).alias("saved"), (F.col("leaves") + F.col("kid_leaves")).alias("leaves"))
        marks = links.select(F.col("id").alias("next"), F.lit(True).alias("goes_on"))
        links = materialize(links.join(marks, "next", "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False))).select("id", "next", "saved", "leaves", "goes_on"), "trie-links")
        rounds = [links.filter("not goes_on")]
        pending = links.filter("goes_on")
        while not pending.isEmpty():
            ahead = pending
            for done in rounds:
                ahead = ahead.union(done)
            ahead = ahead.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("saved").alias("s"), F.col("leaves").alias("l"), F.col("goes_on").alias("on"))
            step = pending.drop("goes_on").join(ahead, "next").select("id", F.col("further").alias("next"), (F.col("saved") + F.col("s")).alias("saved"), (F.col("leaves") + F.col("l")).alias("leaves"), F.col("on").alias("goes_on"))
            step = materialize(step, "trie-step")
            rounds.append(step.filter("not goes_on"))
            pending = step.filter("goes_on")
        chains = rounds[0]
        for done in rounds[1:]:
            chains = chains.union(done)
        chains = chains.drop("goes_on")
        # the node at a chain's end now hangs from the parent of the chain's first node
        firsts = state.filter(is_chain).select("id", "parent", "edge_saved", "edge_leaves").join(marks.select(F.col("next").alias("parent")), "parent", "left_anti")
        hung = firsts.join(chains, "id").select(F.col("next").alias("id"), F.col("parent").alias("up"), (F.col("saved") + F.col("edge_saved")).alias("up_saved"), (F.col("leaves") + F.col("edge_leaves")).alias("up_leaves"))
        rest = state.filter(~is_chain).join(hung, "id", "left").select(
            "id", F.coalesce("up", "parent").alias("parent"), "saved", "leaves", F.coalesce("up_saved", "edge_saved").alias("edge_saved"), F.coalesce("up_leaves", "edge_leaves").alias("edge_leaves"), "kids"
        )
        rest = materialize(rest, "trie-rest")
        # rake: leaves give what they hold, and what lies between, to their parents
        leaves = rest.filter("kids = 0").select("id", "saved", "leaves")
        phases.append((chains, leaves))
        inner = rest.filter("kids > 0").drop("kids")
        given = rest.filter("kids = 0 and parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("saved") + F.col("edge_saved")).alias("s"), F.sum(F.col("leaves") + F.col("edge_leaves")).alias("l"))
        if inner.isEmpty():
            break
        alive = inner.join(given, "id", "left").select(
            "id", "parent", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), "edge_saved", "edge_leaves"
        )
    # expand, last phase first
    totals: DataFrame | None = None
    for chains, leaves in reversed(phases):
        totals = leaves if totals is None else totals.union(leaves)
        ends = totals.select(F.col("id").alias("next"), F.col("saved").alias("s"), F.col("leaves").alias("l"))
        back = chains.join(ends, "next").select("id", (F.col("saved") + F.col("s")).alias("saved"), (F.col("leaves") + F.col("l")).alias("leaves"))
        totals = totals.union(materialize(back, "trie-back"))
    return totals


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of the turn sequences of ``turns(conv_id, pos, size, digest)``.

    ``convs(conv_id)`` names all conversations, those without turns included. Returns
    conv_id (the smallest member, which with depth names the node), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    rows, whole = scanned(turns, ["pos"])
    root = F.lit(bytearray(ROOT))
    ends = convs.select("conv_id").distinct().join(whole, "conv_id", "left").select("conv_id", F.coalesce("path", root).alias("path"))
    ends = materialize(ends, "trie-ends")
    nodes = rows.groupBy(F.col("path").alias("id")).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("pos").alias("depth"), F.max("before").alias("parent"), F.max("size").alias("size")
    )
    top = ends.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    top = top.select(root.alias("id"), "n_convs", "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("size"))
    nodes = materialize(nodes.unionByName(top).withColumn("saved", (F.col("n_convs") - 1) * F.col("size")), "trie-nodes")
    sums = subtree_sums(nodes.select("id", "parent", "saved"))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    up = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(up, "parent", "left").join(children, "id", "left").join(sums.select("id", F.col("saved").alias("saved_tokens"), F.col("leaves").alias("n_leaves")), "id")
    out = out.join(ends_digests(ends).withColumnRenamed("path", "id"), "id", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table of conversations as they are."""
    turns, whole = numbered(conversations)
    return prefix_trie(turns, whole.select("conv_id"))


#: Conversations that share a first one, and the most turns they take over from it, plus one.
SIBLINGS, HEADS = 5, 9


def with_shared_heads(turns: DataFrame, whole: DataFrame) -> DataFrame:
    """Turns in which conversation c begins with the first h of c - c % SIBLINGS, h = crc32(c) % HEADS.

    Its own turns follow after its own first h. ``turns`` and ``whole`` as ``numbered`` gives them.
    """
    c = F.col("conv_id")
    convs = whole.select("conv_id", (c - c % SIBLINGS).alias("first"), (F.crc32(c.cast("string").cast("binary")) % HEADS).alias("heads"))
    heads = turns.filter(F.col("pos") < HEADS).select(F.col("conv_id").alias("first"), "pos", "size", "digest")
    taken = convs.join(heads, "first").filter("pos <= heads").select("conv_id", "pos", "size", "digest")
    known = convs.join(whole.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first")), "first", "left")
    known = known.select("conv_id", "heads", F.least(F.col("heads"), F.coalesce("n_first", F.lit(0))).alias("n_taken"))
    own = turns.join(known, "conv_id").filter("pos > heads").select("conv_id", (F.col("pos") - F.col("heads") + F.col("n_taken")).alias("pos"), "size", "digest")
    return taken.union(own)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with shared heads."""
    turns, whole = numbered(conversations)
    turns, whole = materialize(turns, "turns"), materialize(whole, "conversations")
    return prefix_trie(with_shared_heads(turns, whole), whole.select("conv_id"))
