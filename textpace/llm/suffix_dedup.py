"""Removal of passages that repeat across documents, by deep-shallow suffix sorting.

A byte goes if a 50-byte string that covers it also starts in a document of smaller id.
Suffixes are compared to that depth only, and only where they can repeat:

1. Documents are dealt to buckets of bounded size by id. Each bucket names the anchors of
   its windows (``anchors``) and posts every distinct anchor with a hash of the window run
   around it and the least document id, dealt by anchor.
2. Where all runs of an anchor are one, its least id is answered at once, by one number.
   Where runs differ, one bucket for each distinct run sends the bytes.
3. The suffixes in differing runs are sorted: multikey quicksort, eight bytes a key, to a
   shallow depth; groups still tied whose rest is not one string go to blind tries. Each
   class of equal strings has a least id, answered per window to the buckets that wait.
4. Buckets compare with their own ids and cut.

A bucket posts a run once however many of its documents hold it, so neither a large group
of copies nor a common passage gathers more rows than there are buckets.

Rules for odd input: null text is the empty text; a row with a null id loses nothing and
makes no other row lose anything; rows that repeat an id are judged alike, none before the
other; texts of any length are read whole, in overlapping pieces; texts shorter than the
string length stay whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textpace.llm import anchors
from textpace.llm.common import per_row, utf8

WIDTH = 50
# Bytes of text of one bucket, about.
BUCKET_BYTES = 2 << 20
# Bytes that the multikey quicksort looks at before blind tries take over.
SHALLOW = 24
NOBODY = np.iinfo(np.int64).max
MESSAGE = "target int, origin int, body binary"
_MESSAGE = pa.schema([("target", pa.int32()), ("origin", pa.int32()), ("body", pa.binary())])


# --- packed arrays ------------------------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as bytes, each with like bytes side by side, in as few bytes as its values need."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, np.int64)
        low = int(a.min()) if len(a) else 0
        used = max(1, (int(a.max() - low).bit_length() + 7) // 8) if len(a) else 1
        planes = (a - low).view(np.uint8).reshape(len(a), 8)[:, :used].T
        out += [np.array([len(a), low, used], np.int64).tobytes(), planes.tobytes()]
    return b"".join(out)


def unpack(body: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(body):
        n, low, used = np.frombuffer(body, np.int64, 3, at)
        planes = np.frombuffer(body, np.uint8, n * used, at + 24).reshape(used, n)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :used] = planes.T
        out.append(wide.view(np.int64).reshape(n) + low)
        at += 24 + n * used
    return out


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MESSAGE)], schema=_MESSAGE)


# --- sorting ------------------------------------------------------------------------------

class BlindTrie:
    """Strings of one length by their branching bytes alone; one comparison settles an insertion."""

    def __init__(self, first: bytes, item: int):
        self.root = [None, first, [item]]          # leaf: no depth, string, items

    def add(self, text: bytes, item: int) -> None:
        node = self.root
        while node[0] is not None:                 # descend on branching bytes only
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        if other == text:
            node[2].append(item)
            return
        split = next(i for i, (a, b) in enumerate(zip(text, other)) if a != b)
        parent, node = None, self.root
        while node[0] is not None and node[0] < split:
            parent, node = (node, text[node[0]]), node[1][text[node[0]]]
        leaf = [None, text, [item]]
        if node[0] == split:
            node[1][text[split]] = leaf
            return
        branch = [split, {text[split]: leaf, other[split]: node}]
        if parent is None:
            self.root = branch
        else:
            parent[0][1][parent[1]] = branch

    def classes(self) -> list[list[int]]:
        """Items of equal strings, in order of the strings."""
        out, open_ = [], [self.root]
        while open_:
            node = open_.pop()
            if node[0] is None:
                out.append(node[2])
            else:
                open_ += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow(data: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings at ``starts``, and for each place in it the class of equal strings."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), strides=(1,))
    order, group, tied = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for depth in range(0, SHALLOW, 8):
        key = words[starts[order[tied]] + depth].astype(np.uint64)
        by = np.lexsort((key, group[tied]))
        order[tied], key = order[tied[by]], key[by]
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        inner = np.zeros(len(tied), bool)
        inner[1:] = key[1:] != key[:-1]
        new[tied] |= inner
        group = np.cumsum(new) - 1
        same = np.zeros(n, bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        tied = np.flatnonzero(same)
        if not len(tied):
            return order, group
    # Deep: where all of a tied group have one rest, the group is a class already.
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    leader = starts[order[head]][group[tied]]
    mine, differs = starts[order[tied]], np.zeros(len(tied), bool)
    for depth in [*range(SHALLOW, width - 7, 8), width - 8]:
        differs |= words[mine + depth] != words[leader + depth]
    label, raw = 2 * np.arange(n)[head][group], data.tobytes() if differs.any() else b""
    for g in np.unique(group[tied[differs]]):
        at = np.arange(head[g], head[g + 1] if g + 1 < len(head) else n)
        items = order[at].tolist()
        rest = [raw[s + SHALLOW:s + width] for s in starts[items].tolist()]
        trie = BlindTrie(rest[0], items[0])
        for text, item in zip(rest[1:], items[1:]):
            trie.add(text, item)
        place = int(head[g])
        for members in trie.classes():
            order[place:place + len(members)] = members
            label[place:place + len(members)] = 2 * place + 1
            place += len(members)
    return order, np.cumsum(np.concatenate([[0], label[1:] != label[:-1]]))


# --- steps --------------------------------------------------------------------------------

class Bucket:
    """One bucket's texts and its distinct runs, in the order of (anchor, mark)."""

    def __init__(self, table: pa.Table, width: int):
        ids = table.column("doc_id").combine_chunks()
        self.ids = ids
        self.null = np.asarray(ids.is_null())
        self.doc = np.where(self.null, NOBODY, np.asarray(ids.fill_null(0), np.int64))
        self.data, self.offsets = utf8(table.column("text").combine_chunks())
        self.found = found = anchors.find(self.data, self.offsets, width)
        order = np.lexsort((found.mark, found.name))
        name, mark = found.name[order], found.mark[order]
        new = np.ones(len(order), bool)
        new[1:] = (name[1:] != name[:-1]) | (mark[1:] != mark[:-1])
        head = np.flatnonzero(new)
        self.run_of = np.empty(len(order), np.int64)
        self.run_of[order] = np.cumsum(new) - 1
        self.name, self.mark, self.one = name[head], mark[head], order[head]
        least = np.full(len(head), NOBODY)
        np.minimum.at(least, self.run_of, self.doc[found.row])
        self.least = least

    def dealt(self, targets: int):
        """(target, its runs) for each target that any run goes to."""
        to = self.name % targets
        order = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.diff(to[order])) + 1
        for runs in np.split(order, cut) if len(order) else []:
            yield int(to[runs[0]]), runs


# Answers to a posted run: it is alone, its least id is known, it waits, it waits and sends its bytes.
ALONE, KNOWN, WAITS, SENDS = range(4)


def post(table: pa.Table, width: int, targets: int) -> pa.Table:
    bucket = Bucket(table, width)
    number = table.column("bucket")[0].as_py()
    return messages([(to, number, pack(bucket.name[r], bucket.mark[r], bucket.least[r]))
                     for to, r in bucket.dealt(targets)])


def answer(table: pa.Table) -> pa.Table:
    """For one target: compare the runs that all buckets posted."""
    target = table.column("target")[0].as_py()
    origins = table.column("origin").to_pylist()
    posted = [unpack(b) for b in table.column("body").to_pylist()]
    size = np.array([len(p[0]) for p in posted])
    name, mark, least = (np.concatenate([p[i] for p in posted]) for i in range(3))
    order = np.lexsort((least, mark, name))
    name, mark, least = name[order], mark[order], least[order]
    new_name = np.concatenate([[True], name[1:] != name[:-1]])
    new_run = new_name | np.concatenate([[True], mark[1:] != mark[:-1]])
    runs_of_name = np.add.reduceat(new_run.astype(np.int64), np.flatnonzero(new_name))
    several = (runs_of_name > 1)[np.cumsum(new_name) - 1]
    head = np.flatnonzero(new_run)
    run = np.cumsum(new_run) - 1
    rows_of_run = np.diff(np.append(head, len(run)))
    code = np.where(several, np.where(new_run, SENDS, WAITS), np.where(rows_of_run[run] > 1, KNOWN, ALONE))
    codes, firsts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    codes[order], firsts[order] = code, least[head][run]
    out, at = [], 0
    for origin, n in zip(origins, size):
        c, f = codes[at:at + n], firsts[at:at + n]
        out.append((origin, target, pack(c, f[c == KNOWN])))
        at += n
    return messages(out)


def send(table: pa.Table, answers: pa.Table, width: int, targets: int) -> pa.Table:
    """A bucket sends the bytes asked for, and passes the answers on to its own later turn."""
    if not table.num_rows or not answers.num_rows:
        return messages([])
    bucket = Bucket(table, width)
    number = table.column("bucket")[0].as_py()
    told = dict(zip(answers.column("origin").to_pylist(), answers.column("body").to_pylist()))
    found, rows = bucket.found, []
    for to, runs in bucket.dealt(targets):
        code, _ = unpack(told[to])
        sent = runs[code == SENDS]
        occ = bucket.one[sent]
        base = bucket.offsets[found.row[occ]]
        begin, end = base + found.first[occ], base + found.last[occ] + width
        text = b"".join(bucket.data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist()))
        wait = runs[code >= WAITS]
        head = pack(bucket.name[sent], bucket.mark[sent], bucket.least[sent], end - begin,
                    bucket.name[wait], bucket.mark[wait])
        rows.append((to, number, np.int64(len(told[to])).tobytes() + told[to] + np.int64(len(head)).tobytes() + head + text))
    return messages(rows)


def settle(table: pa.Table, width: int) -> pa.Table:
    """For one target: sort the suffixes of the differing runs, and answer each run's windows."""
    target = table.column("target")[0].as_py()
    names, marks, docs, sizes, texts, waits = [], [], [], [], [], []
    for origin, body in zip(table.column("origin").to_pylist(), table.column("body").to_pylist()):
        n = int(np.frombuffer(body, np.int64, 1)[0])
        m = int(np.frombuffer(body, np.int64, 1, 8 + n)[0])
        name, mark, doc, size, wait_name, wait_mark = unpack(body[16 + n:16 + n + m])
        names.append(name), marks.append(mark), docs.append(doc), sizes.append(size)
        texts.append(body[16 + n + m:])
        waits.append((origin, body[8:8 + n], wait_name, wait_mark))
    name, mark, doc, size = map(np.concatenate, (names, marks, docs, sizes))
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    windows = size - width + 1
    at = np.concatenate([[0], np.cumsum(windows)]).astype(np.int64)
    starts = np.repeat(begin - at[:-1], windows) + np.arange(at[-1])
    order, label = deep_shallow(data, starts.astype(np.int64), width)
    owner = np.repeat(doc, windows)
    least = np.full(len(starts), NOBODY)
    if len(order):
        heads = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        least[order] = np.minimum.reduceat(owner[order], heads)[label]
    place = {(a, b): i for i, (a, b) in enumerate(zip(name.tolist(), mark.tolist()))}
    out = []
    for origin, told, wait_name, wait_mark in waits:
        runs = np.array([place[x] for x in zip(wait_name.tolist(), wait_mark.tolist())], np.int64)
        n = windows[runs]
        flat = least[np.repeat(at[runs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] \
            if len(runs) else np.zeros(0, np.int64)
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        head = np.flatnonzero(new)
        body = pack(n, np.diff(np.append(head, len(flat))), flat[head])
        out.append((origin, target, np.int64(len(told)).tobytes() + told + body))
    return messages(out)


def covered(bucket: Bucket, told: dict[int, bytes], width: int, targets: int) -> np.ndarray:
    """Which bytes of the bucket go."""
    found = bucket.found
    least = bucket.least.copy()
    waits = np.full(len(least), -1)
    flat, filled = [], 0
    for to, runs in bucket.dealt(targets):
        body = told[to]
        n = int(np.frombuffer(body, np.int64, 1)[0])
        code, known = unpack(body[8:8 + n])
        windows, times, value = unpack(body[8 + n:])
        least[runs[code == KNOWN]] = known
        late = runs[code >= WAITS]
        waits[late] = filled + np.concatenate([[0], np.cumsum(windows)[:-1]]).astype(np.int64) if len(late) else 0
        flat.append(np.repeat(value, times))
        filled += int(windows.sum())
    flat = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    own = bucket.doc[found.row]
    own = np.where(bucket.null[found.row], np.iinfo(np.int64).min, own)
    base = bucket.offsets[found.row]
    change = np.zeros(len(bucket.data) + 1, np.int32)
    whole = (waits[bucket.run_of] < 0) & (least[bucket.run_of] < own)
    np.add.at(change, (base + found.first)[whole], 1)
    np.add.at(change, (base + found.last + width)[whole], -1)
    late = np.flatnonzero(waits[bucket.run_of] >= 0)
    n = found.last[late] - found.first[late] + 1
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    gone = flat[np.repeat(waits[bucket.run_of[late]], n) + step] < np.repeat(own[late], n)
    window = (np.repeat((base + found.first)[late], n) + step)[gone]
    np.add.at(change, window, 1)
    np.add.at(change, window + width, -1)
    return np.cumsum(change[:-1]) > 0


def cut(table: pa.Table, answers: pa.Table, width: int, targets: int, out: pa.Schema) -> pa.Table:
    if not table.num_rows:
        return out.empty_table()
    bucket = Bucket(table, width)
    told = dict(zip(answers.column("origin").to_pylist(), answers.column("body").to_pylist()))
    gone = covered(bucket, told, width, targets)
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    begins = bucket.offsets[:-1][np.diff(bucket.offsets) > 0]
    first[begins] = gone[begins]
    kept = [bucket.data[a:b][~gone[a:b]].tobytes() for a, b in zip(bucket.offsets, bucket.offsets[1:])]
    columns = [bucket.ids, pa.array(np.diff(bucket.offsets)), pa.array(per_row(gone, bucket.offsets)),
               pa.array(per_row(first, bucket.offsets)),
               pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
    if "kept" in out.names:
        columns.append(pa.array(kept, pa.binary()))
    return pa.Table.from_arrays(columns, schema=out)


def dedup(docs: DataFrame, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES, with_bytes: bool = False) -> DataFrame:
    """A row per document (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the bytes kept."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = total // bucket_bytes + 1
    targets = buckets // 2 + 1
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.pmod("doc_id", F.lit(buckets)), F.pmod(F.xxhash64("text"), F.lit(buckets))).cast("int").alias("bucket"))
    by_bucket = placed.groupBy("bucket")
    posted = by_bucket.applyInArrow(lambda t: post(t, width, targets), MESSAGE)
    answered = posted.groupBy("target").applyInArrow(answer, MESSAGE)
    sent = by_bucket.cogroup(answered.withColumnRenamed("target", "bucket").groupBy("bucket")) \
        .applyInArrow(lambda t, a: send(t, a, width, targets), MESSAGE)
    settled = sent.groupBy("target").applyInArrow(lambda t: settle(t, width), MESSAGE)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_bytes else [])]
    schema = pa.schema(fields)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return by_bucket.cogroup(settled.withColumnRenamed("target", "bucket").groupBy("bucket")) \
        .applyInArrow(lambda t, a: cut(t, a, width, targets, schema), ddl)
