"""Exact self-join of documents by the Jaccard similarity of their word shingles, with set-relation skipping.

1. Equal sets become one class. 2. Each class lists its rarest shingles under a global order; two sets that
link share one of them. Index lists are cut into blocks by size, ordered by position: what lies in a block
behind the last position that can still reach the needed overlap is skipped. 3. Parity sketches refute most candidate
pairs without a false refusal. 4. What is left falls into clusters, inside of which a set's links are
derived from the answers of a similar set: the size of the symmetric difference is a metric, so a set far
from the leader of a group cannot link to its members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doculith.llm.common import SLICE_BYTES, components, cut, fresh, lean, runs, slices, small_batches, utf8

#: Tokens are 64-bit hashes. A row of a slice, a level and the upper bits of a token fill one sortable integer.
ROW_BITS, LEVEL_BITS = 11, 4
SLICE_ROWS = 1 << ROW_BITS
SKETCH_BITS, SEGMENT = 22, 4096
#: Least bits of a parity sketch; a larger set has the least power of four times as many that is at least its size.
SKETCH = 1024
#: Index lists up to this length give their pairs at once; longer ones are split into blocks and compared by sketch.
SHORT_LIST, BLOCK = 48, 4096
#: Tokens of a block of a cluster at most, but for a single larger set.
BLOCK_TOKENS = 2_000_000
#: A table of cluster members is broadcast up to this many rows; beyond, documents are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64 and of its inverse, at least n of each; kept in the worker."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        with np.errstate(over="ignore"):
            both = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_ODD, inverse))
        _POWERS[:] = [both]
    return _POWERS[0]


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (bytes other than blanks, A-Z lower-cased) and its row."""
    offsets = offsets - offsets[0]
    ink = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.append(True, ~ink)[:-1] | edge[:-1]
    start = np.flatnonzero(ink & before)
    end = np.flatnonzero(ink & (np.append(~ink[1:], True) | edge[1:])) + 1
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(offsets, start, "right") - 1


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, token) pairs of a slice of up to SLICE_ROWS rows, sorted; a text with fewer words has its whole sequence as one token."""
    rows = len(offsets) - 1
    h, row = words(offsets, data)
    n = len(h) - size + 1
    token, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        token = np.zeros(n, np.uint64)
        for i in range(size):
            token = token * _ODD + h[i : i + n]
        whole = row[:n] == row[size - 1 :]
        token, own = _mix(token[whole]), row[:n][whole]
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    for r in np.flatnonzero((count > 0) & (count < size)):
        value = np.uint64(int(count[r]) + 1)
        for x in h[first[r] : first[r] + count[r]]:
            value = np.uint64((int(value) * int(_ODD) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        token, own = np.append(token, _mix(np.array([value], np.uint64))), np.append(own, r)
    order = _order(token, own, np.zeros(0, np.uint64))
    token, own = token[order], own[order].astype(np.int64)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
    return own[new], token[new]


def _order(token: np.ndarray, row: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order by row, rank (if any) and token. One sort by the upper bits of all; where these tie for different tokens, by every bit."""
    bits = LEVEL_BITS if len(rank) else 0
    key = (row.astype(np.uint64) << np.uint64(64 - ROW_BITS)) | (token >> np.uint64(ROW_BITS + bits))
    if bits:
        key |= rank << np.uint64(64 - ROW_BITS - LEVEL_BITS)
    order = np.argsort(key)
    key, value = key[order], token[order]
    if ((key[1:] == key[:-1]) & (value[1:] != value[:-1])).any():
        return np.lexsort((token, rank, row) if bits else (token, row))
    return order


def _sliced(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    offsets, data = utf8(batch.column(column))
    for start, stop in slices(offsets):
        for a in range(start, stop, SLICE_ROWS):
            b = min(stop, a + SLICE_ROWS)
            yield a, b, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]


def levels(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """For each of 2 ** SKETCH_BITS buckets of tokens how common it is, from 0 to 15, counted over all documents.

    The levels only order tokens: any order gives the same links, a good one short lists.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        held, n = [], 0

        def flush():
            bucket, times = np.unique(np.concatenate(held), return_counts=True)
            total[bucket] += times.astype(np.int32)

        for b in batches:
            for _, _, offsets, data in _sliced(b, 0):
                _, token = shingle_sets(offsets, data, size)
                held.append((token >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                n += len(token)
                if n > 1 << 20:
                    flush()
                    held, n = [], 0
        if held:
            flush()
        part = np.minimum(total, 255).astype(np.uint8).reshape(-1, SEGMENT)  # a count beyond 255 in one task is common anyway
        some = np.flatnonzero(part.any(1))
        for i in range(0, len(some), 128):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 128]), pa.array([part[s].tobytes() for s in some[i : i + 128]], pa.binary())], names=["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(x.as_buffer(), np.uint8)
                sums[s] = sums[s] + part if s in sums else part.astype(np.int32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.astype(np.int32).tobytes() for v in sums.values()], pa.binary())], names=["segment", "counts"])

    shape = "segment bigint, counts binary"
    found = docs.select(text_col).mapInArrow(lean(count), shape).repartition("segment").mapInArrow(lean(add), shape).toArrow()  # 2 ** SKETCH_BITS integers
    total = np.zeros((1 << SKETCH_BITS) // SEGMENT * SEGMENT, np.int64).reshape(-1, SEGMENT)
    for s, x in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        total[s] = np.frombuffer(x, np.int32)
    total = total.ravel()
    base = max(1.0, 2.0 * total.mean())
    return np.where(total > base, np.minimum(15, 1 + np.floor(2 * np.log2(np.maximum(total, 1) / base))), 0).astype(np.uint8)


def _ceil_div(a, b):
    return -(-a // b)


def probe_length(n, percent: int):
    """How many of a set's rarest tokens a linked set that is no larger must meet."""
    return n - _ceil_div(percent * n, 100) + 1


def index_length(n, percent: int):
    """How many of a set's rarest tokens a linked set that is no smaller must meet."""
    return n - _ceil_div(2 * percent * n, 100 + percent) + 1


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the sketches of sets of n tokens. Unrelated sets of that size differ in about half of them, far more than linked ones may."""
    bits = np.full(len(n), SKETCH, np.int64)
    while (short := bits < n).any():
        bits[short] *= 4
    return bits


def parity(row: np.ndarray, token: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Each row's sketch: a bit is the parity of the tokens that hash to it, so sketches differ in at most as many bits as sets in tokens."""
    out: list[bytes] = [b""] * len(n)
    size = sketch_bits(n)
    for bits in np.unique(size).tolist():
        which = np.flatnonzero(size == bits)
        at = np.full(len(n), -1)
        at[which] = np.arange(len(which))
        mine = at[row] >= 0
        spot = at[row[mine]] * bits + (_mix(token[mine]) & np.uint64(bits - 1)).astype(np.int64)
        packed = np.packbits((np.bincount(spot, minlength=len(which) * bits) & 1).astype(np.uint8).reshape(-1, bits), axis=1, bitorder="little")
        for i, r in enumerate(which):
            out[r] = packed[i].tobytes()
    return out


def described(docs: DataFrame, level: np.ndarray, size: int, percent: int) -> DataFrame:
    """(doc, tag, n, h1, h2, prefix, sketch) for each row (doc, tag, text)."""
    held = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = held.value
        for b in batches:
            for start, stop, offsets, data in _sliced(b, 2):
                rows = stop - start
                row, token = shingle_sets(offsets, data, size)
                n = np.bincount(row, minlength=rows)
                mixed = _mix(token + np.uint64(11))
                first = np.cumsum(n) - n
                h1, h2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                full = n > 0
                if len(row):
                    h1[full] = np.add.reduceat(mixed, first[full])
                    h2[full] = np.add.reduceat(_mix(mixed ^ _ODD), first[full])
                rank = level[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                ranked = token[_order(token, row, rank)]
                place = np.arange(len(ranked)) - np.repeat(first, n)
                length = np.where(full, probe_length(n, percent), 0)
                prefix = ranked[place < np.repeat(length, n)].view(np.int64)
                cuts = np.append(0, np.cumsum(length)).astype(np.int32)
                named = [b.column(i).slice(start, rows) for i in (0, 1)]
                found = [pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(prefix)), pa.array(parity(row, token, n), pa.binary())]
                yield pa.RecordBatch.from_arrays([*named, *found], names=["doc", "tag", "n", "h1", "h2", "prefix", "sketch"])

    return docs.select("doc", "tag", "text").mapInArrow(lean(run), "doc bigint, tag bigint, n bigint, h1 bigint, h2 bigint, prefix array<bigint>, sketch binary")


def needed(n, m, percent: int):
    """The least intersection of linked sets of n and m tokens."""
    return _ceil_div(percent * (n + m), 100 + percent)


def list_pairs(token: np.ndarray, doc: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of index lists sorted by (token, n, pos) that size and position leave.

    The entries of a token and size are a block, ordered by position. Step j takes each entry to the j-th block from
    its own on and finds, by one search, the last position there that still reaches the overlap: what lies behind is
    skipped unread. An entry drops out of all later steps when the sizes no longer fit, the token changes or its own
    position is behind the last that reaches the overlap, which only grows with the size.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    head = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (n[1:] != n[:-1]))) if len(token) else np.zeros(0, np.int64)
    block = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(token))))
    key = (block.astype(np.int64) << 32) | pos
    # The position of the smaller set lies in its index prefix, or the pair is met at an earlier token.
    at = np.flatnonzero(pos < index_length(n, percent))
    step = 0
    while len(at):
        at = at[block[at] + step < len(head)]
        other = block[at] + step
        size = n[head[other]]
        need = needed(n[at], size, percent)
        alive = (token[at] == token[head[other]]) & (100 * n[at] >= percent * size) & (n[at] - pos[at] >= need)
        at, other, last = at[alive], other[alive], (size - need)[alive]
        begin = head[other] if step else at + 1
        count = np.maximum(0, np.searchsorted(key, (other.astype(np.int64) << 32) | np.maximum(last, 0), "right") - begin)
        count[last < 0] = 0
        left = np.repeat(at, count)
        right = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        hit = doc[left] != doc[right]
        out.append((doc[left[hit]], doc[right[hit]]))
        step += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate([o[i] for o in out]) for i in (0, 1))
    return np.minimum(a, b), np.maximum(a, b)


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """(token, x, y, n, pos) of the classes (node, n, prefix): pairs x < y with a null token from short lists, and entries with a null y of long ones."""
    rows = reps.select("node", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "n", F.col("pos").cast("int").alias("pos"), "node")
    dealt = rows.repartition("token").sortWithinPartitions("token", "n", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(t, n, p, d):
            # Lists of one entry need no look.
            same = np.append(False, t[1:] == t[:-1]) | np.append(t[1:] == t[:-1], False)
            a, b = list_pairs(t[same], d[same], n[same], p[same], percent)
            a, b = np.unique(np.stack([a, b]), axis=1) if len(a) else (a, b)
            for i in range(0, len(a), 1 << 16):
                k = len(a[i : i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(a[i : i + k]), pa.array(b[i : i + k]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32())], names=["token", "x", "y", "n", "pos"])

        def entries(t, n, p, d):
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(d), pa.nulls(len(t), pa.int64()), pa.array(n), pa.array(p)], names=["token", "x", "y", "n", "pos"])

        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        long_token = None
        for b in batches:
            cols = [np.concatenate([h, np.asarray(b.column(i))]) for i, h in enumerate(held)]
            if not len(cols[0]):
                continue
            starts = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
            lengths = np.diff(np.append(starts, len(cols[0])))
            long = lengths > SHORT_LIST
            if cols[0][0] == long_token:
                long[0] = True
            tail = len(cols[0]) - lengths[-1]
            mark = np.repeat(long, lengths)
            if long[-1]:  # its entries go out as they come, so that no list has to fit in memory
                tail, long_token = len(cols[0]), cols[0][-1]
            body = np.arange(len(cols[0])) < tail
            if (mark & body).any():
                yield from entries(*[c[mark & body] for c in cols])
            if (~mark & body).any():
                yield from pairs(*[c[~mark & body] for c in cols])
            held = [c[tail:] for c in cols]
        if len(held[0]):
            yield from pairs(*held)

    return dealt.mapInArrow(lean(run), "token bigint, x bigint, y bigint, n bigint, pos int")


def groups(n: np.ndarray, distance: Callable[[int, np.ndarray], np.ndarray], percent: int) -> np.ndarray:
    """For each set the first of its group, where groups are what links reach and a link is a distance of at most (n + m)(1 - t)/(1 + t).

    One set after another leads: its distances to all that have no group are computed once. For a member of its
    group only those sets are compared that the triangle inequality on the leader's distances leaves over.
    """
    root = np.full(len(n), -1)
    free = np.arange(len(n))
    far = (100 - percent) / (100 + percent)
    while len(free):
        lead, rest = free[0], free[1:]
        root[lead] = lead
        from_lead = distance(lead, rest).astype(np.int64)
        linked = (100 + percent) * from_lead <= (100 - percent) * (n[lead] + n[rest])
        queue = list(zip(rest[linked].tolist(), from_lead[linked].tolist(), strict=True))
        root[rest[linked]] = lead
        rest, from_lead = rest[~linked], from_lead[~linked]
        while queue and len(rest):
            member, own = queue.pop()
            near = np.flatnonzero(np.abs(from_lead - own) <= far * (n[member] + n[rest]) + 1e-9)
            if not len(near):
                continue
            d = distance(member, rest[near])
            hit = near[(100 + percent) * d.astype(np.int64) <= (100 - percent) * (n[member] + n[rest[near]])]
            if len(hit):
                root[rest[hit]] = lead
                queue += list(zip(rest[hit].tolist(), from_lead[hit].tolist(), strict=True))
                keep = np.ones(len(rest), bool)
                keep[hit] = False
                rest, from_lead = rest[keep], from_lead[keep]
        free = rest
    return root


def blocked(members: DataFrame, key: str, doc: str, tokens: str | None = None) -> DataFrame:
    """The rows with (key, bi, bj): a key with more than BLOCK rows, or BLOCK_TOKENS tokens, is dealt into blocks, and each pair of blocks becomes a task of its own."""
    most = F.count("*") / BLOCK if tokens is None else F.greatest(F.count("*") / BLOCK, F.sum(tokens) / BLOCK_TOKENS)
    sizes = members.groupBy(key).agg(F.ceil(most).cast("int").alias("blocks"))
    joined = members.join(sizes, key)
    own = F.pmod(F.xxhash64(doc), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("bi"), F.greatest(i, F.col("own")).alias("bj")))
    return joined.withColumn("own", own).withColumn("pair", F.explode(pair)).select("*", "pair.bi", "pair.bj").drop("blocks", "own", "pair")


def fold(sketches: list[bytes], bits: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, those of more bits folded by exclusive or."""
    out = np.zeros((len(sketches), bits // 64), np.uint64)
    for size in {len(s) for s in sketches}:
        which = [i for i, s in enumerate(sketches) if len(s) == size]
        words = np.frombuffer(b"".join(sketches[i] for i in which), np.uint64).reshape(len(which), -1, bits // 64)
        out[which] = np.bitwise_xor.reduce(words, axis=1)
    return out


def long_list_edges(entries: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(x, y): for the entries of long lists, links to the first of the groups that sketches leave connected.

    Sets with sketches of one length form groups of their own. A link between two lengths needs sizes on both sides of
    their border: those sets are grouped once more, by the shorter sketches.
    """
    rows = blocked(entries.select("token", F.col("x").alias("node"), "n"), "token", "node", "n").join(sketches, "node")
    dealt = rows.select("token", "bi", "bj", "node", "n", "sketch").repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            node, n, sketch = t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("sketch").to_pylist()
            size = sketch_bits(n)
            for bits in np.unique(size).tolist():
                border = (100 * n >= percent * bits) & (percent * n <= 100 * bits)
                for which in (size == bits, border if (border & (size > bits)).any() else np.zeros(len(n), bool)):
                    at = np.flatnonzero(which)
                    if len(at) < 2:
                        continue
                    words = fold([sketch[i] for i in at], bits)
                    root = groups(n[at], lambda i, js, words=words: np.bitwise_count(words[js] ^ words[i]).sum(1), percent)
                    other = np.flatnonzero(root != np.arange(len(root)))
                    if len(other):
                        yield pa.RecordBatch.from_arrays([pa.array(node[at[other]]), pa.array(node[at[root[other]]])], names=["x", "y"])

    return dealt.mapInArrow(lean(run), "x bigint, y bigint")


def unrefuted(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches leave a link possible."""
    left = sketches.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
    right = sketches.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 8192):
                part = b.slice(i, 8192)
                nx, ny = np.asarray(part.column(2)), np.asarray(part.column(4))
                size = sketch_bits(np.minimum(nx, ny))
                keep = np.zeros(len(part), bool)
                for bits in np.unique(size).tolist():
                    which = np.flatnonzero(size == bits)
                    sx, sy = (fold(part.column(c).take(pa.array(which)).to_pylist(), bits) for c in (3, 5))
                    keep[which] = (100 + percent) * np.bitwise_count(sx ^ sy).sum(1).astype(np.int64) <= (100 - percent) * (nx + ny)[which]
                yield part.select(["x", "y"]).filter(pa.array(keep))

    return pairs.join(left, "x").join(right, "y").select("x", "y", "nx", "sx", "ny", "sy").mapInArrow(lean(run), "x bigint, y bigint")


def cluster_links(clustered: DataFrame, percent: int) -> DataFrame:
    """(node, root): exact groups inside clusters, from rows (cluster, bi, bj, node, tokens)."""
    dealt = clustered.select("cluster", "bi", "bj", "node", "tokens").repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, roots = [], []
        for t in runs(batches, 3):
            node = t.column("node").to_numpy().copy()
            tokens = t.column("tokens").combine_chunks()
            del t
            flat, n = np.asarray(tokens.flatten()), np.diff(np.asarray(tokens.offsets)).astype(np.int64)
            name = np.unique(flat)
            ident = np.empty(len(flat), np.int32)
            for k in range(0, len(flat), 1 << 20):
                ident[k : k + (1 << 20)] = np.searchsorted(name, flat[k : k + (1 << 20)])
            del flat, tokens
            start = np.cumsum(n) - n
            mark = np.zeros(len(name), bool)

            def distance(i, js, n=n, ident=ident, start=start, mark=mark):
                mark[ident[start[i] : start[i] + n[i]]] = True
                if len(js) * 4 < len(n):
                    shared = np.array([mark[ident[start[j] : start[j] + n[j]]].sum() for j in js], np.int64)
                else:
                    shared = np.add.reduceat(mark[ident], start, dtype=np.int64)[js]
                mark[ident[start[i] : start[i] + n[i]]] = False
                return n[i] + n[js] - 2 * shared

            root = groups(n, distance, percent)
            nodes.append(node)
            roots.append(node[root])
            if len(nodes) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(roots))], names=["node", "root"])
                nodes, roots = [], []
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(roots))], names=["node", "root"])

    return dealt.mapInArrow(lean(run), "node bigint, root bigint")


def _components(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """For rows (doc, tag, text): each row's (doc, tag, n, h1, h2), and each class's (h1, h2, least, keep).

    Rows with equal sets are a class, named by `node`, the first of its two hashes. `least` is the smallest id of the
    class's component, `keep` the (doc, tag) of its first row: the smallest id, null behind all, and then tag.
    """
    with small_batches(docs.sparkSession):
        per = cut(described(docs, levels(docs, "text", shingle), shingle, percent))
        first = F.struct(F.col("doc").isNull().alias("none"), "doc", "tag")
        classes = per.where("n > 0").groupBy("h1", "h2").agg(F.min_by(F.struct("n", "prefix", "sketch"), first).alias("r"), F.min("doc").alias("least"), F.min(first).alias("keep"))
        classes = cut(classes.select(F.col("h1").alias("node"), "h2", "r.*", "least", "keep"))
        found = cut(candidates(classes, percent))
        sketches = classes.select("node", "n", "sketch")
        pairs = unrefuted(found.where("y is not null").select("x", "y").distinct(), sketches, percent)
        long = long_list_edges(found.where("y is null"), sketches.select("node", "sketch"), percent)
        near = components(pairs.union(long), "x", "y").select("node", F.col("component").alias("cluster"))
        clusters = cut(near.join(classes.select("node", "n", "keep"), "node"))
        roots = _verified(docs, per, clusters, shingle, percent)
    linked = cut(classes.select("node", "h2", "least", "keep").join(roots, "node"))
    whole = linked.groupBy("root").agg(F.min("least").alias("least"), F.min("keep").alias("keep"))
    named = linked.select("node", "h2", "root").join(whole, "root").select(F.col("node").alias("h1"), "h2", "least", "keep")
    alone = classes.select(F.col("node").alias("h1"), "h2", "least", "keep").join(named.select("h1", "h2"), ["h1", "h2"], "left_anti")
    return per.select("doc", "tag", "n", "h1", "h2"), named.unionByName(alone)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, text): a row's id and a hash of its text, so that rows with one id, or none, stay apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), _tag(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))


def _tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def join(docs: DataFrame, shingle: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row: the size of its set, and the smallest id that links reach.

    Sets link when 100 * intersection >= percent * union. A null, empty or blank text has an empty set and no
    link. Rows with one id are sets of their own that share the id. Rows without an id link as all others do; a
    component of such rows alone has a null component_id. Repeated rows each give a row, an empty table none. Other
    columns are not read.
    """
    per, named = _components(_keyed(docs, id_col, text_col), shingle, percent)
    out = per.join(named.select("h1", "h2", "least"), ["h1", "h2"], "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")).alias("component_id"))


def _verified(docs: DataFrame, per: DataFrame, clusters: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, root) of the clusters' members, root being the least node of the exact component."""
    split = blocked(clusters.select("node", "cluster", "n"), "cluster", "node", "n").groupBy("node", "cluster").agg(F.collect_set(F.struct("bi", "bj")).alias("pairs"))
    split = cut(split.join(clusters.select("node", "keep.doc", "keep.tag"), "node"))
    small = split.agg(F.sum(F.size("pairs"))).first()[0] or 0
    wanted = F.broadcast(split) if small <= BROADCAST_ROWS else split
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t"))
    texts = docs.join(wanted.withColumnsRenamed({"doc": "d", "tag": "t"}), same).select("node", "text", "cluster", "pairs")
    often = per.join(wanted.select(F.col("doc").alias("d"), F.col("tag").alias("t"), "node"), same).groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1")
    if not often.isEmpty():  # rows that are equal in id and text give their set once
        texts = texts.groupBy("node").agg(*[F.first(c).alias(c) for c in ("text", "cluster", "pairs")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, offsets, data in _sliced(b, 1):
                row, token = shingle_sets(offsets, data, shingle)
                cuts = np.searchsorted(row, np.arange(stop - start + 1)).astype(np.int32)
                part = b.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.ListArray.from_arrays(pa.array(cuts), pa.array(token.view(np.int64)))], names=["node", "cluster", "pairs", "tokens"])

    pair = "array<struct<bi:int,bj:int>>"
    sets = texts.mapInArrow(lean(run), f"node bigint, cluster bigint, pairs {pair}, tokens array<bigint>")
    sets = sets.select("node", "cluster", "tokens", F.explode("pairs").alias("pair")).select("node", "cluster", "tokens", "pair.bi", "pair.bj")
    edges = cut(cluster_links(sets, percent))
    divided = not split.where(F.size("pairs") > 1).isEmpty()
    if divided:
        return components(edges, "node", "root").select("node", F.col("component").alias("root"))
    return edges


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, but for those of a component that has an earlier row: one with a smaller id, no id being the last.

    Each row goes by its own text, whatever other rows share its id. Of rows that are equal in id and text one stays,
    whichever it is. Rows without a set (null, empty and blank texts) all stay; an empty table stays empty.
    """
    per, named = _components(_keyed(docs, id_col, text_col), shingle, percent)
    names = {name: fresh(f"llm_{name}", docs.columns) for name in ("doc", "tag", "row")}
    per = per.where("n > 0").join(named.select("h1", "h2", "keep"), ["h1", "h2"])
    first = F.col("doc").eqNullSafe(F.col("keep.doc")) & (F.col("tag") == F.col("keep.tag"))
    judged = cut(per.select("doc", "tag", first.alias("first")).groupBy("doc", "tag").agg(F.max("first").alias("first"), F.count("*").alias("rows")).where("not first or rows > 1"))
    found = judged.select(F.col("doc").alias(names["doc"]), F.col("tag").alias(names["tag"]), F.struct("first", "rows").alias(names["row"]))
    found = F.broadcast(found) if judged.count() <= BROADCAST_ROWS else found
    same = docs[id_col].cast("long").eqNullSafe(F.col(names["doc"])) & (_tag(docs[text_col]) == F.col(names["tag"]))
    joined = docs.join(found, same, "left").where(F.coalesce(F.col(names["row"])["first"], F.lit(True)))
    once = joined.where(F.col(names["row"]).isNull()).select(*docs.columns)
    if judged.where("first").isEmpty():
        return once
    again = joined.where(F.col(names["row"]).isNotNull()).dropDuplicates([names["doc"], names["tag"]])
    return once.unionByName(again.select(*docs.columns))
