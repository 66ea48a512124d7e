"""Conversations as a trie of their turns, rolled up by centroid decomposition.

**Numbering.** Turns become digests. They are sorted by (conversation, turn) in ranges, so a
long conversation lies in several; each range numbers its run of a conversation and sums the
digests as digits of a number modulo the prime 2^127 - 1. Runs are joined by their counts and
sums alone, and so are the borrowed first turns of another conversation and a conversation's
own rest. The sum of the first d turns is the name of the node they lead to.

**Trie.** Nodes are counts of rows by name. A node's ``weight`` is the number of rows at or
below it, known from the lengths of its conversations without walking the trie.

**Rollup.** Without the root, the parent edges form a forest of components, each named by its
top node. A component heavier than ``LIMIT`` is cut at its weighted centroid, the deepest node
that holds more than half of it: what lies at or below the centroid is totalled, and the total
is added to the centroid and to every node from there to the top; then the centroid goes, and
the parts below and above it are components of at most half the weight. Membership is read
from the rows of one conversation through each node. Lighter components go through the same
decomposition within one task each, many to a task.

Rules for odd input: rows of equal (conversation, turn) are ordered by the digest of role and
text, repeated rows are turns each; rows without ``conv_id`` belong to no conversation and are
left out; null turns come first; null role and text are empty; an empty table has no node, not
even a root; very long conversations and nodes with many conversations are split over tasks;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from textpace.llm.common import staged
from textpace.session import guard

# Conversations of one hundred share the first turns of the least, at most HEADS - 1 of them.
GROUP = 100
HEADS = 6
# A component of more rows than this is cut over the cluster, a lighter one within a task.
LIMIT = 16_384
# Nodes that one task of the last step takes on average, or fewer.
NODES_A_TASK = 65_536
# Conversation ids in one text of a node's list of ends.
IDS_AT_ONCE = 4096

PRIME = (1 << 127) - 1
BASE = 0x1F83D9ABFB41BD6B5BE0CD19137E2179 % PRIME
ROOT = bytes(16)


def _name(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _value(name: bytes | None) -> int:
    return int.from_bytes(name, "big") if name else 0


def borrowed(conv_id: int) -> int:
    """How many first turns a conversation takes from the least of its hundred."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])


RUNS = "conv bigint, run int, i bigint, total binary, before binary, chars bigint"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted turns of each conversation within this range, with running sums."""
    run, conv, i, total, power = TaskContext.get().partitionId(), None, 0, 0, BASE
    for batch in batches:
        out = []
        for c, digest, chars in zip(*(batch.column(n).to_pylist() for n in ("conv", "digest", "chars"))):
            if c != conv:
                conv, i, total, power = c, 0, 0, BASE
            before = total
            total = (total + _value(digest) * power) % PRIME
            out.append((c, run, i, _name(total), _name(before), chars))
            i, power = i + 1, power * BASE % PRIME
        yield _table(RUNS, out)


SPANS = "conv bigint, run int, offset bigint, carried binary, turns bigint"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each run of a conversation begins, and the sum of the runs before it."""
    for batch in batches:
        out = []
        for conv, runs in zip(batch.column("conv").to_pylist(), batch.column("runs").to_pylist()):
            offset, carried, turns = 0, 0, sum(r["n"] for r in runs)
            for r in runs:
                out.append((conv, r["run"], offset, _name(carried), turns))
                carried = (carried + _value(r["total"]) * pow(BASE, offset, PRIME)) % PRIME
                offset += r["n"]
        yield _table(SPANS, out)


def _first_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first turns of conversations with the sums up to them."""
    for batch in batches:
        rows = batch.to_pydict()
        out = [(c, o + i, _name((_value(s) + _value(t) * pow(BASE, o, PRIME)) % PRIME), n, turns) for c, o, i, s, t, n, turns
               in zip(*(rows[k] for k in ("conv", "offset", "i", "carried", "total", "chars", "turns")))]
        yield _table("conv bigint, i bigint, total binary, chars bigint, turns bigint", out)


REBUILT = "conv bigint, taken int, lent int, start binary, skipped binary, first binary, length bigint, parts binary, sizes binary"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each conversation is rebuilt: turns taken off, turns lent, and the sums where its own go on."""
    for batch in batches:
        out = []
        for conv, own, base, turns, base_turns in zip(*(batch.column(n).to_pylist() for n in (
                "conv", "heads", "base_heads", "turns", "base_turns"))):
            taken = borrowed(conv)
            lent = min(taken, base_turns or 0)
            sums = [_value(x["total"]) for x in own]
            base = [(x["total"], x["chars"]) for x in (base or [])[:lent]]
            start = _value(base[-1][0]) if base else 0
            skipped = sums[min(taken, turns) - 1] if taken else 0
            first = base[0][0] if base else None
            if not base and turns > taken:
                first = _name((sums[taken] - skipped) * pow(BASE, -taken, PRIME) % PRIME)
            out.append((conv, taken, lent, _name(start), _name(skipped), first, lent + max(turns - taken, 0),
                        b"".join(t for t, _ in base), b"".join(n.to_bytes(8, "big") for _, n in base)))
        yield _table(REBUILT, out)


ROWS = "conv bigint, pos bigint, node binary, parent binary, first binary, chars bigint, length bigint"


def _lent_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, lent, first, length, parts, sizes in zip(*(batch.column(n).to_pylist() for n in (
                "conv", "lent", "first", "length", "parts", "sizes"))):
            names = [ROOT] + [parts[16 * j:16 * j + 16] for j in range(lent)]
            out += [(conv, j + 1, names[j + 1], names[j], first, int.from_bytes(sizes[8 * j:8 * j + 8], "big"), length)
                    for j in range(lent)]
        yield _table(ROWS, out)


def _own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, out, conv, known = batch.to_pydict(), [], None, None
        names = ("conv", "run", "i", "total", "before", "chars", "offset", "carried", "taken", "lent", "start", "skipped",
                 "first", "length")
        for c, run, i, total, before, chars, offset, carried, taken, lent, start, skipped, first, length in zip(
                *(rows[n] for n in names)):
            if (c, run) != conv:
                # Name = start + (carried + total * BASE^offset - skipped) * BASE^(lent - taken).
                conv, shift = (c, run), pow(BASE, lent - taken, PRIME)
                known = (_value(start) + (_value(carried) - _value(skipped)) * shift, pow(BASE, offset, PRIME) * shift % PRIME)
            node, parent = (_name((known[0] + _value(x) * known[1]) % PRIME) for x in (total, before))
            out.append((c, offset + i - taken + lent + 1, node, parent, first, chars, length))
        yield _table(ROWS, out)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (one for each turn of each rebuilt conversation) and conversations with their lengths."""
    guard(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = staged(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("digest"),
        F.length(text).cast("bigint").alias("chars"), F.monotonically_increasing_id().alias("tie")), "turns")
    order = (F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie"))
    runs = staged(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_number, RUNS), "runs")
    ends = runs.groupBy("conv", "run").agg((F.max("i") + 1).alias("n"), F.max_by("total", "i").alias("total"))
    spans = staged(ends.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("run", "n", "total"))).alias("runs"))
                   .mapInArrow(_place, SPANS), "spans")
    early = runs.where(F.col("i") < HEADS).join(spans.where(F.col("offset") < HEADS), ["conv", "run"])
    heads = staged(early.where(F.col("i") + F.col("offset") < HEADS).select(
        "conv", "offset", "i", "carried", "total", "chars", "turns")
        .mapInArrow(_first_turns, "conv bigint, i bigint, total binary, chars bigint, turns bigint")
        .groupBy("conv", "turns").agg(F.sort_array(F.collect_list(F.struct("i", "total", "chars"))).alias("heads")), "heads")
    bases = heads.where(F.col("conv") % GROUP == 0).select(
        F.col("conv").alias("base"), F.col("heads").alias("base_heads"), F.col("turns").alias("base_turns"))
    convs = staged(heads.withColumn("base", F.col("conv") - F.col("conv") % GROUP).join(bases, "base", "left")
                   .select("conv", "heads", "base_heads", "turns", "base_turns").mapInArrow(_rebuild, REBUILT), "rebuilt")
    placed = spans.join(convs, "conv").select("conv", "run", "offset", "carried", "taken", "lent", "start", "skipped", "first", "length")
    own = runs.join(placed, ["conv", "run"]).where(F.col("offset") + F.col("i") >= F.col("taken"))
    rows = staged(own.mapInArrow(_own_rows, ROWS).union(
        convs.where("lent > 0").select("conv", "lent", "first", "length", "parts", "sizes").mapInArrow(_lent_rows, ROWS)), "rows")
    return rows, convs.select("conv", "length")


def trie(rows: DataFrame) -> DataFrame:
    """One row for each node but the root."""
    nodes = staged(rows.groupBy("node", "parent", "first", F.col("pos").alias("depth"), "chars").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"),
        F.sum(F.col("length") - F.col("pos") + 1).alias("weight")), "nodes")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    n = F.coalesce("n_children", F.lit(0))
    return nodes.join(children, "node", "left").select(
        "node", "parent", "depth", "conv", "n_convs", n.alias("n_children"), "weight", F.col("first").alias("part"),
        F.lit(None).cast("bigint").alias("above"), F.when(n == 0, 1).otherwise(0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        F.lit(0).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"))


def cut(nodes: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """Cut heavy components at their centroids until all are light; cut nodes have no component (``part`` null)."""
    done, columns, through = [], nodes.columns, None
    while True:
        heavy = nodes.where((F.col("node") == F.col("part")) & (F.col("weight") > limit)).select(
            "part", F.col("weight").alias("all"), F.col("depth").alias("top"))
        heavy = staged(heavy, "heavy")
        if not heavy.limit(1).count():
            return _all([*done, nodes])
        if through is None:
            # Rows of the heavy components, which name each node's way down.
            through = staged(rows.join(heavy.select(F.col("part").alias("first")), "first", "left_semi")
                             .select("conv", "pos", "node", "parent"), "ways")
        done.append(nodes.join(heavy, "part", "left_anti").select(columns))
        big = nodes.join(heavy, "part")
        centre = staged(big.where(2 * F.col("weight") > F.col("all")).groupBy("part", "top").agg(
            F.max_by(F.struct("node", "conv", "depth", "weight"), "depth").alias("c")).select(
            "part", "top", F.col("c.node").alias("c_node"), F.col("c.conv").alias("c_conv"), F.col("c.depth").alias("c_depth"),
            F.col("c.weight").alias("c_weight")), "centres")
        # The row one turn below the centroid, of a conversation through the node: it names the
        # node's new component, and its parent tells whether the node lies below the centroid.
        step = through.select(F.col("conv"), F.col("pos").alias("c_below"), F.col("node").alias("s_node"), F.col("parent").alias("s_parent"))
        low = nodes.join(centre, "part").withColumn("c_below", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1))
        low = low.join(step, ["conv", "c_below"], "left")
        way = through.join(centre.select("top", "c_depth", F.col("c_conv").alias("conv")), "conv").where(
            (F.col("pos") >= F.col("top")) & (F.col("pos") < F.col("c_depth"))).select("node", F.lit(True).alias("on_way"))
        marked = staged(low.join(way, "node", "left").select(
            *columns, "c_node", "c_conv", "c_weight", "s_node", F.coalesce("on_way", F.lit(False)).alias("on_way"),
            F.coalesce(F.col("s_parent") == F.col("c_node"), F.lit(False)).alias("below")), "marked")
        totals = marked.where(F.col("below") | (F.col("node") == F.col("c_node"))).groupBy("part").agg(
            F.sum("leaf").alias("add_leaves"), F.sum("saved").alias("add_saved"))
        at, gains = F.col("node") == F.col("c_node"), (F.col("node") == F.col("c_node")) | F.col("on_way")

        def if_(condition: Column, value: Column, other: str) -> Column:
            return F.when(condition, value).otherwise(F.col(other)).alias(other)

        nodes = staged(marked.join(totals, "part").select(
            "node", "parent", "depth", "conv", "n_convs", "n_children",
            if_(F.col("on_way"), F.col("weight") - F.col("c_weight"), "weight"),
            F.when(at, F.lit(None)).when(F.col("below"), F.col("s_node")).otherwise(F.col("part")).alias("part"),
            if_(F.col("below"), F.col("c_conv"), "above"), "leaf", "saved",
            if_(gains, F.col("n_leaves") + F.col("add_leaves"), "n_leaves"),
            if_(gains, F.col("saved_tokens") + F.col("add_saved"), "saved_tokens")), "parts")
        done.append(nodes.where("part is null"))
        nodes = nodes.where("part is not null")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def decompose(parent: list[int], leaf: list[int], saved: list[int]) -> tuple[list[int], list[int]]:
    """Subtree totals of one component, whose nodes are listed by depth (the top's parent is -1)."""
    leaves, tokens = [0] * len(parent), [0] * len(parent)
    label, waiting = [0] * len(parent), [list(range(len(parent)))]
    size, sum_leaf, sum_saved = [0] * len(parent), [0] * len(parent), [0] * len(parent)
    while waiting:
        part = waiting.pop()
        top = part[0]
        for v in part:
            size[v], sum_leaf[v], sum_saved[v] = 1, leaf[v], saved[v]
        centre, half = top, len(part) / 2
        for v in reversed(part):
            if size[v] > half:
                centre = v
                break
            p = parent[v]
            size[p] += size[v]
            sum_leaf[p] += sum_leaf[v]
            sum_saved[p] += sum_saved[v]
        v = centre
        while True:
            leaves[v] += sum_leaf[centre]
            tokens[v] += sum_saved[centre]
            if v == top:
                break
            v = parent[v]
        pieces: dict[int, list[int]] = {}
        for v in part:
            if v != centre:
                label[v] = v if v == top or parent[v] == centre else label[parent[v]]
                pieces.setdefault(label[v], []).append(v)
        waiting.extend(pieces.values())
    return leaves, tokens


LOCAL = "node binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _light(table: pa.Table) -> pa.Table:
    """All components of a task, each by itself."""
    rows = table.sort_by("depth").to_pydict()
    parts: dict[bytes, list[int]] = {}
    for i, part in enumerate(rows["part"]):
        parts.setdefault(part, []).append(i)
    out = []
    for part, members in parts.items():
        at = {rows["node"][i]: j for j, i in enumerate(members)}
        parent = [-1 if rows["node"][i] == part else at[rows["parent"][i]] for i in members]
        leaves, tokens = decompose(parent, [rows["leaf"][i] for i in members], [rows["saved"][i] for i in members])
        for i, p, n, t in zip(members, parent, leaves, tokens):
            out.append((rows["node"][i], rows["conv"][i], rows["depth"][i], rows["above"][i] if p < 0 else rows["conv"][members[p]],
                        rows["n_convs"][i], rows["n_children"][i], rows["n_leaves"][i] + n, rows["saved_tokens"][i] + t))
    return pa.Table.from_batches([_table(LOCAL, out)])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, read in order."""
    node, state = None, None
    for batch in batches:
        out = []
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if name != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in out], pa.binary()),
                                          "ends_sha256": pa.array([h for _, h in out], pa.string())})
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})


def ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node with conversations that end there: the hash of their ids."""
    stop = rows.where("pos = length").select("node", "conv").union(
        convs.where("length = 0").select(F.lit(ROOT).alias("node"), "conv"))
    # Each id ends at one node, so a span of ids gives a short text; the texts of a node are read one by one.
    texts = stop.groupBy("node", F.floor(F.col("conv") / IDS_AT_ONCE).alias("span")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return texts.repartition("node").sortWithinPartitions("node", "span").mapInArrow(_digests, "node binary, ends_sha256 string")


def rollup(conversations: DataFrame, limit: int = LIMIT, nodes_a_task: int = NODES_A_TASK) -> DataFrame:
    """The nodes of the trie with their totals."""
    spark = conversations.sparkSession
    rows, convs = rebuilt(conversations)
    nodes = staged(trie(rows), "trie")
    least, members = convs.agg(F.min("conv"), F.count("*")).first()
    n_nodes, n_leaves, saved, tops = nodes.agg(
        F.count("*"), F.sum("leaf"), F.sum("saved"), F.count(F.when(F.col("depth") == 1, 1))).first()
    cut_ = cut(nodes.withColumn("above", F.lit(least).cast("bigint")), rows, limit)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_nodes // nodes_a_task))
    light = cut_.where("part is not null").withColumn("task", F.pmod(F.xxhash64("part"), F.lit(tasks))) \
        .groupBy("task").applyInArrow(_light, LOCAL)
    gone = cut_.where("part is null")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    heavy = gone.join(parents, "parent", "left").select(
        "node", F.col("conv").alias("conv_id"), "depth", F.coalesce("parent_conv", F.lit(least)).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens")
    nothing = hashlib.sha256(b"").hexdigest()
    root = [(bytearray(ROOT), least, 0, None, members, tops, n_leaves or 1, saved or 0)] if members else []
    return light.unionByName(heavy).unionByName(spark.createDataFrame(root, LOCAL)).join(ends(rows, convs), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
