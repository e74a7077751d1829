"""Near-duplicate embeddings by NN-descent: a neighbour graph refined by joins with neighbours' neighbours.

Equal vectors form one node. Random hyperplanes deal the nodes of a label into blocks, which give the first
neighbour lists; each round compares what meets in a node's neighbourhood, forward and backward. A list full of
links is saturated and is enlarged, up to ENLARGED links. What links reach is a component, inside of which every pair
is compared, block by block, so that counts are complete also where a list cannot hold all. A label has as many
tables of hyperplanes as a pair right at the threshold needs to share a side with the wanted probability. Recall is
audited against brute force on a sample after every batch of rounds; while it is low, new tables follow, twice as
many each time, and after MOST_TABLES every pair of a label is compared, in pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doculith.llm.common import components, cut, lean, runs

#: Neighbours kept for a node, least tables of hyperplanes of a label of several blocks, rows of a first block, and of a block of a component.
NEIGHBOURS, TABLES, START_BLOCK, BLOCK = 8, 4, 512, 1024
#: Neighbours kept where all of them are links.
ENLARGED = 32
#: Improvements that one neighbourhood proposes to each of its members.
PROPOSED = 4
#: Rounds after the first tables, and after each further batch of tables.
ROUNDS, MORE_ROUNDS = 2, 1
#: Nodes of a label compared with all others for the audit, and the recall that ends the rounds.
AUDIT, WANTED = 400, 0.97
#: The audit's sample of a label grows by a factor until it holds so many nodes of few links, or so many nodes.
AUDIT_GROWTH, LINKED, AUDIT_MOST = 8, 100, 25_600
#: Rows of a block that the audit's sample is compared with; at least as many as the sample has.
AUDIT_BLOCK = 4096
#: Tables of a label in all; if the recall is still low then, every pair is compared.
MOST_TABLES = 256
CODE_BITS = 30
#: Sizes of labels are broadcast up to this many labels; beyond, they are joined by a shuffle.
BROADCAST_LABELS = 10_000


def usable(vector: str, label: str) -> Column:
    """Whether a row can link at all."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & x.isNotNull() & finite & F.exists(x, lambda e: e != 0), F.lit(False))


def unit(column: pa.Array, width: str) -> np.ndarray:
    """Rows of the binary vectors in double precision, each divided by its largest component and then by its norm."""
    n = len(column)
    offsets, data = column.buffers()[1:3]
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(width) if n else np.zeros(0, width)
    x = flat.astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def first_linked(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the smallest row that links reach."""
    n = len(link)
    root = np.arange(n)
    if not link.any():
        return root
    while True:
        low = np.minimum(root, np.where(link, root[None, :], n).min(1))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _nodes(rows: DataFrame, width: str) -> DataFrame:
    """(id, g, w, vec) for each class of equal vectors of a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            size = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten()).astype(width)
            start = np.cumsum(size) - size
            raw = [flat[s : s + k].tobytes() for s, k in zip(start, size, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(raw, pa.binary())], names=["id", "g", "w", "vec"])

    return rows.select("id", "g", "w", "x").mapInArrow(lean(run), "id bigint, g bigint, w bigint, vec binary")


def _labels(nodes: DataFrame, threshold: float) -> DataFrame:
    """(g, size, bits, tables) of each label: the hyperplanes of a table, and the tables that a pair at the threshold needs.

    Such a pair lies on one side of a random hyperplane with probability 1 - angle / pi, and on one side of all `bits`
    of a table with the power of that. A label of one block needs one table, which compares all of its pairs.
    """
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    sizes = nodes.groupBy("g").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("bits", F.least(F.lit(CODE_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / START_BLOCK)) + 1)).cast("int"))
    miss = 1 - F.pow(F.lit(same), F.col("bits"))
    needed = F.when(miss <= 0, F.lit(TABLES)).otherwise(F.least(F.lit(float(MOST_TABLES)), F.ceil(math.log(1 - WANTED) / F.log(miss)).cast("double")))
    return cut(sizes.withColumn("tables", F.when(F.col("bits") == 0, 1).otherwise(F.greatest(F.lit(float(TABLES)), needed)).cast("int")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_LABELS else df


_FOUND = "kind int, a bigint, b bigint, sim double"


def _compared(dealt: DataFrame, keys: int, threshold: float, width: str, proposed: int, least: bool) -> DataFrame:
    """Compares the rows of each run of the first `keys` columns, followed by id, vec and, if `least`, the similarity to beat.

    Gives (0, a, b, sim): b is one of the `proposed` nearest of a; (1, a, b, 1): links reach b, the first of a's run, from a.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        size = 0

        def flush():
            kind, a, b, s = (np.concatenate(h) for h in held)
            return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(a), pa.array(b), pa.array(s)], names=["kind", "a", "b", "sim"])

        for t in runs(batches, keys):
            n = t.num_rows
            if n < 2:
                continue
            ident = t.column(keys).to_numpy()
            x = unit(t.column(keys + 1).combine_chunks(), width)
            s = x @ x.T
            s[ident[:, None] == ident[None, :]] = -2.0
            root = first_linked(s >= threshold)
            k = min(proposed, n - 1)
            top = np.argpartition(-s, k - 1, 1)[:, :k]
            value = np.take_along_axis(s, top, 1)
            better = value > (t.column(keys + 2).to_numpy()[:, None] if least else -2.0)
            i, j = np.nonzero(better)
            linked = np.flatnonzero(root != np.arange(n))
            for h, v in zip(held, ((np.zeros(len(i), np.int32), np.ones(len(linked), np.int32)), (ident[i], ident[linked]), (ident[top[i, j]], ident[root[linked]]), (value[i, j], np.ones(len(linked)))), strict=True):
                h += v
            size += len(i) + len(linked)
            if size > 50_000:
                yield flush()
                held, size = [[], [], [], []], 0
        if size:
            yield flush()

    return dealt.mapInArrow(lean(run), _FOUND)


def _coded(nodes: DataFrame, labels: DataFrame, width: str, batch: int) -> DataFrame:
    """(g, bits, id, vec, codes): the sides of the hyperplanes of a batch of tables. Each batch after the first has as many as all before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            count = np.asarray(b.column(2)).astype(np.int64)
            first, last = (count << (batch - 1), np.minimum(count << batch, MOST_TABLES)) if batch else (count * 0, count)
            size = np.maximum(0, last - first)
            codes = np.zeros((len(b), int(size.max(initial=0))), np.int64)
            length = np.asarray(pc.binary_length(b.column(4)))
            for dim in np.unique(length).tolist():
                which = np.flatnonzero(length == dim)
                x = unit(b.column(4).take(pa.array(which)), width)
                for t in np.unique(np.concatenate([np.arange(f, f + n) for f, n in set(zip(first[which].tolist(), size[which].tolist(), strict=True))])).tolist():
                    if (dim, t) not in planes:
                        planes[dim, t] = np.random.default_rng((dim + 1, t)).standard_normal((x.shape[1], CODE_BITS))
                    at = np.flatnonzero((first[which] <= t) & (t < first[which] + size[which]))
                    sign = x[at] @ planes[dim, t] > 0
                    codes[which[at], t - first[which[at]]] = (sign << np.arange(CODE_BITS - 1, -1, -1)).sum(1)
            cuts = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            own = codes[np.arange(codes.shape[1])[None, :] < size[:, None]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.ListArray.from_arrays(cuts, pa.array(own))], names=["g", "bits", "id", "vec", "codes"])

    rows = nodes.join(_small(labels), "g").select("g", "bits", "tables", "id", "vec")
    return cut(rows.mapInArrow(lean(run), "g bigint, bits int, id bigint, vec binary, codes array<bigint>"))


def _started(nodes: DataFrame, labels: DataFrame, threshold: float, width: str, batch: int = 0) -> DataFrame:
    """Lists from a batch of tables: nodes that share a side of enough hyperplanes are compared in blocks of about START_BLOCK."""
    rows = _coded(nodes, labels, width, batch).select("g", "bits", "id", "vec", F.posexplode("codes").alias("t", "code"))
    side = F.expr(f"shiftright(code, {CODE_BITS} - depth)")
    # A bucket that is too large is split by more hyperplanes; what stays too large is dealt into blocks, each table in its own way.
    rows = rows.withColumn("depth", F.col("bits")).withColumn("bucket", side)
    full = cut(rows.groupBy("g", "t", "bucket").agg(F.count("*").alias("members")).where(F.col("members") > 2 * START_BLOCK))
    more = F.coalesce(F.ceil(F.log2(F.col("members") / START_BLOCK)), F.lit(0))
    rows = rows.join(_small(full), ["g", "t", "bucket"], "left").withColumn("depth", F.least(F.lit(CODE_BITS), F.col("bits") + more).cast("int"))
    rows = rows.drop("members").withColumn("bucket", side)
    full = cut(rows.groupBy("g", "t", "depth", "bucket").agg(F.count("*").alias("members")).where(F.col("members") > 2 * START_BLOCK))
    parts = F.ceil(F.coalesce("members", F.lit(1)) / (2 * START_BLOCK))
    rows = rows.join(_small(full), ["g", "t", "depth", "bucket"], "left").withColumn("sub", F.pmod(F.xxhash64("id", "t", F.lit(batch)), parts).cast("int"))
    rows = rows.withColumn("key", F.xxhash64("g", "t", "depth", "bucket", "sub")).select("g", "key", "id", "vec")
    return _compared(rows.repartition("g", "key").sortWithinPartitions("g", "key", "id"), 2, threshold, width, NEIGHBOURS, False)


def _best(edges: DataFrame, threshold: float) -> DataFrame:
    """The NEIGHBOURS nearest of each node, and up to ENLARGED while they are links; a node has a bounded number of proposals."""
    own = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return own.withColumn("rank", rank).where((F.col("rank") <= NEIGHBOURS) | (F.col("rank") <= ENLARGED) & (F.col("sim") >= threshold)).drop("rank")


def _round(nodes: DataFrame, graph: DataFrame, threshold: float, width: str) -> DataFrame:
    """One round: each neighbourhood, forward and backward, is compared within itself."""
    sides = graph.select(F.col("a").alias("c"), F.col("b").alias("m")).union(graph.select(F.col("b").alias("c"), F.col("a").alias("m"))).union(graph.select(F.col("a").alias("c"), F.col("a").alias("m"))).distinct()
    # Many lists may name one node: its neighbourhood is dealt into blocks then.
    many = sides.groupBy("c").agg(F.count("*").alias("members"))
    sides = sides.join(many, "c").withColumn("sub", F.pmod(F.xxhash64("m", "c"), F.ceil(F.col("members") / START_BLOCK)).cast("int"))
    # What a list takes: anything while it has room, then what beats its last, and as long as it can be enlarged every link.
    link = F.lit(float(np.nextafter(threshold, -2.0)))
    room = F.when(F.count("*") >= ENLARGED, F.min("sim")).when(F.count("*") >= NEIGHBOURS, F.least(F.min("sim"), link)).otherwise(F.lit(-2.0))
    bar = graph.groupBy(F.col("a").alias("id")).agg(room.alias("bar"))
    known = nodes.select("id", "vec").join(bar, "id", "left").select(F.col("id").alias("m"), "vec", F.coalesce("bar", F.lit(-2.0)).alias("bar"))
    rows = sides.join(known, "m").select("c", "sub", F.col("m").alias("id"), "vec", "bar")
    return _compared(rows.repartition("c", "sub").sortWithinPartitions("c", "sub", "id"), 2, threshold, width, PROPOSED, True)


def _paired(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """(component, bi, bj, id, own, w, vec): the nodes of each component in pairs of blocks, each pair once, in one task."""
    sizes = reached.groupBy("component").agg(F.count("*").alias("members"))
    rows = reached.join(sizes, "component").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("bi"), F.greatest(i, F.col("own")).alias("bj")))
    rows = rows.withColumn("pair", F.explode(pair)).select("component", "pair.bi", "pair.bj", F.col("node").alias("id"), "own")
    rows = rows.join(nodes.select("id", "w", "vec"), "id").select("component", "bi", "bj", "id", "own", "w", "vec")
    return rows.repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj", "id")


def _counted(nodes: DataFrame, reached: DataFrame, threshold: float, width: str) -> DataFrame:
    """(id, links, near): for the nodes of each component the rows and the nodes linked, every pair compared once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            bi, bj = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            ident, own, w = (t.column(i).to_numpy() for i in (3, 4, 5))
            x = unit(t.column(6).combine_chunks(), width)
            if bi == bj:
                link = x @ x.T >= threshold
                np.fill_diagonal(link, False)
                total, near = link @ w, link.sum(1)
            else:
                one, two = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
                link = x[one] @ x[two].T >= threshold
                total, near = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
                total[one], total[two] = link @ w[two], link.T @ w[one]
                near[one], near[two] = link.sum(1), link.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(ident), pa.array(total.astype(np.int64)), pa.array(near.astype(np.int64))], names=["id", "links", "near"])

    found = _paired(nodes, reached).mapInArrow(lean(run), "id bigint, links bigint, near bigint")
    return found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("near").alias("near"))


def _every_link(nodes: DataFrame, labels: DataFrame, threshold: float, width: str) -> DataFrame:
    """(a, b): links that connect what all pairs of the labels of several blocks connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            ident = t.column(3).to_numpy()
            x = unit(t.column(6).combine_chunks(), width)
            root = first_linked(x @ x.T >= threshold)
            linked = np.flatnonzero(root != np.arange(len(ident)))
            yield pa.RecordBatch.from_arrays([pa.array(ident[linked]), pa.array(ident[root[linked]])], names=["a", "b"])

    large = nodes.join(_small(labels.where("bits > 0").select("g")), "g")
    return cut(_paired(nodes, large.select(F.col("id").alias("node"), F.col("g").alias("component"))).mapInArrow(lean(run), "a bigint, b bigint"))


def _asked(nodes: DataFrame, labels: DataFrame, threshold: float, width: str) -> DataFrame:
    """(g, id, real): the nodes that brute force finds linked to each sampled node; `labels` has g, low and high, the part of the hashes to sample."""
    hashed = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    block = F.greatest(F.lit(float(AUDIT_BLOCK)), (F.col("high") - F.col("low")) * F.col("size"))
    rows = nodes.join(_small(labels), "g").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("hashed", hashed)
    own = rows.select("g", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("sub"), F.lit(False).alias("asked"), "id", "vec")
    part = rows.where((F.col("hashed") >= F.col("low")) & (F.col("hashed") < F.col("high")))
    part = part.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("sub"), F.lit(True).alias("asked"), "id", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            asked, ident, vec = np.asarray(t.column(2)), t.column(3).to_numpy(), t.column(4).combine_chunks()
            one, two = np.flatnonzero(asked), np.flatnonzero(~asked)
            if not len(one) or not len(two):
                continue
            x = unit(vec.take(pa.array(two)), width)
            near = np.zeros(len(one), np.int64)
            for i in range(0, len(one), 512):
                at = one[i : i + 512]
                link = unit(vec.take(pa.array(at)), width) @ x.T >= threshold
                link[ident[at][:, None] == ident[two][None, :]] = False
                near[i : i + 512] = link.sum(1)
            yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(one)).combine_chunks(), pa.array(ident[one]), pa.array(near)], names=["g", "id", "real"])

    dealt = own.union(part).repartition("g", "sub").sortWithinPartitions("g", "sub")
    return dealt.mapInArrow(lean(run), "g bigint, id bigint, real bigint").groupBy("g", "id").agg(F.sum("real").alias("real")).where("real > 0")


def sampled(nodes: DataFrame, labels: DataFrame, threshold: float, width: str) -> DataFrame:
    """(g, id, real): linked nodes of each label of several blocks, with the nodes that brute force finds linked to them.

    About AUDIT nodes of a label are asked, and more while under LINKED of them have links to at most NEIGHBOURS
    nodes, up to the whole label or AUDIT_MOST nodes.
    """
    left = labels.where("bits > 0").select("g", "size", F.lit(0.0).alias("low"), F.least(F.lit(1.0), AUDIT / F.col("size")).alias("high"))
    most, found = AUDIT, None
    while True:
        part = cut(_asked(nodes, left, threshold, width))
        found = part if found is None else found.union(part)
        most *= AUDIT_GROWTH
        if most > AUDIT_MOST:
            return found
        held = found.where(F.col("real") <= NEIGHBOURS).groupBy("g").agg(F.count("*").alias("linked"))
        left = left.join(held, "g", "left").where((F.coalesce("linked", F.lit(0)) < LINKED) & (F.col("high") < 1))
        left = cut(left.select("g", "size", F.col("high").alias("low"), F.least(F.lit(1.0), most / F.col("size")).alias("high")))
        if left.isEmpty():
            return found


def audit(asked: DataFrame, counted: DataFrame) -> float:
    """The least recall of a label's nodes of few links, or of its nodes of many, as the mean share of a node's linked nodes that was found.

    Groups of under LINKED nodes are taken together over the labels. Without any linked node it is 1.
    """
    share = F.least(F.lit(1.0), F.coalesce("near", F.lit(0)) / F.col("real"))
    rows = asked.join(counted.select("id", "near"), "id", "left").groupBy("g", (F.col("real") > NEIGHBOURS).alias("many")).agg(F.count("*").alias("n"), F.sum(share).alias("found"))
    rows = rows.groupBy("many", F.when(F.col("n") >= LINKED, F.col("g")).alias("g")).agg((F.sum("found") / F.sum("n")).alias("recall"))
    least = rows.agg(F.min("recall")).first()[0]
    return 1.0 if least is None else least


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Rows link when labels and lengths are equal and the cosine in double precision is at least `threshold`; no
    pair below it counts. Null, zero or partly null or non-finite vectors and rows without a label have no links.
    Copies of a vector are links of each other. component_id is the smallest id that links reach. Other columns are
    not read, and an empty table gives no row.

    Rows are told apart by themselves, not by their ids: rows that share an id, or have none, are vectors of their
    own, which count each other like any others. A row without an id has the smallest id of its component, null if
    there is none; it is kept only then, since nothing else of its component would be.
    """
    width = "float32" if "float" in vectors.schema[vector_col].dataType.simpleString() else "float64"
    base = vectors.select(F.col(id_col).cast("long").alias("row_id"), F.col(vector_col).alias("x"), F.col(label_col).alias("label"))
    ok = usable("x", "label")
    keyed = base.where(ok).withColumn("g", F.xxhash64("label", F.size("x"))).withColumn("h1", F.xxhash64("x")).withColumn("h2", F.xxhash64("x", F.lit(7)))
    grouped = keyed.groupBy("g", "h1", "h2").agg(F.min("row_id").alias("least"), F.count("*").alias("w"), F.first("x").alias("x"))
    classes = cut(grouped.withColumn("id", F.monotonically_increasing_id()))
    nodes = cut(_nodes(classes, width))
    labels = _labels(nodes, threshold)
    least = labels.where("bits > 0").agg(F.min("tables")).first()[0] or MOST_TABLES
    found = cut(_started(nodes, labels, threshold, width))
    links = found.where("kind = 1").select("a", "b")
    graph = cut(_best(found.where("kind = 0").select("a", "b", "sim"), threshold))
    asked = sampled(nodes, labels, threshold, width)
    rounds, batch = ROUNDS, 0
    while True:
        for _ in range(rounds):
            found = cut(_round(nodes, graph, threshold, width))
            links = links.union(found.where("kind = 1").select("a", "b"))
            graph = cut(_best(graph.select("a", "b", "sim").union(found.where("kind = 0").select("a", "b", "sim")), threshold))
        reached = components(links, "a", "b")
        counted = cut(_counted(nodes, reached, threshold, width))
        if audit(asked, counted) >= WANTED:
            break
        # A label that has had all of its tables gets no more; while others have not, they go on.
        if least << batch >= MOST_TABLES:
            reached = components(links.union(_every_link(nodes, labels, threshold, width)), "a", "b")
            counted = cut(_counted(nodes, reached, threshold, width))
            break
        rounds, batch = MORE_ROUNDS, batch + 1
        found = cut(_started(nodes, labels, threshold, width, batch))
        links = links.union(found.where("kind = 1").select("a", "b"))
        graph = cut(_best(graph.select("a", "b", "sim").union(found.where("kind = 0").select("a", "b", "sim")), threshold))
    # The smallest id of each component, then of each class of equal vectors.
    members = reached.withColumnRenamed("node", "id").join(classes.select("id", "least"), "id")
    smallest = members.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = reached.withColumnRenamed("node", "id").join(smallest, "component").select("id", "component_id", F.lit(True).alias("linked"))
    per = classes.select("g", "h1", "h2", "id", "w", "least").join(counted.select("id", "links"), "id", "left").join(of_node, "id", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least"))
    per = per.select("g", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), component.alias("component_id"))
    linked = keyed.select("row_id", "g", "h1", "h2").join(per, ["g", "h1", "h2"]).select("row_id", "n_links", "component_id")
    alone = base.where(~ok).select("row_id", F.lit(0).cast("long").alias("n_links"), F.col("row_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("row_id").alias(id_col), "n_links", "component_id", F.col("row_id").eqNullSafe(F.col("component_id")).alias("kept"))
