"""The trie of all conversations' beginnings, with subtree totals by centroid decomposition.

A prefix of a conversation has two 64-bit keys, each the exclusive or of hashes of (place, role, text)
over its turns, so keys of long conversations are put together from parts and texts are hashed where they are
read. A node is a distinct prefix; it is named by its smallest conversation and its depth.

Totals over subtrees are rolled up along a centroid decomposition of the parent edges. The centroid of a component
is its deepest node that has at least half of the component below it. What lies below the centroid
inside the component is summed once and added to the nodes on the way from the centroid to the component's top;
then the centroid is taken out, its children become tops of components of their own and the rest stays with
the old top. Every node has at most log2(n) centroids above it, however deep the tree. Components of more
than `piece` nodes are split by joins over all of them at once; smaller ones are spread over
the tasks and split there, many at a time.

Where one key may hold many rows: turns are ranked after a sort by range, so a long conversation lies in many
partitions; prefixes are summed in runs of `RUN` turns; members meet their node under partial aggregation only;
nodes with many children are joined by broadcast, of which there can only be `HOT` at most; the ids that end
at a node are joined in ranges of 4096 before they are hashed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from perfattr.llm.common import ship, stored

#: Turns of a conversation that are put in order in one task at most.
RUN = 4096
#: Nodes of a component that one task splits.
PIECE = 8192
#: Most parents that are broadcast for their many children: each has a HOT-th of all nodes at least.
HOT = 50_000
#: Rows of a component table up to which it is broadcast.
SMALL = 10_000
_TASK_ROWS = 50_000


# -- turns ----------------------------------------------------------------------------------------


def ranked(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, part, at, t1, t2, n_bytes) and their runs (conv, part, first_at, before, n), both stored.

    A turn's rank in its conversation is `before + at - first_at` of its run. Turns are ordered by `turn`, null first;
    equal ones by hashes of role and text, so repeated rows are turns of their own, one after the other. Null
    role or text is empty; rows without a conversation are left out.
    """
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    order = ["conv", "turn", "t1", "t2"]
    rows = (
        conversations.select(
            F.col(f"`{conv}`").cast("long").alias("conv"),
            F.col(f"`{turn}`").alias("turn"),
            F.xxhash64(F.lit(1), *said).alias("t1"),
            F.xxhash64(F.lit(2), *said).alias("t2"),
            F.octet_length(said[1]).cast("long").alias("n_bytes"),
        )
        .where("conv is not null")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    turns = stored(rows.withColumn("part", F.shiftright("at", 33)).drop("turn"), "turns")
    earlier = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = turns.groupBy("conv", "part").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    return turns, stored(runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "runs")


def as_they_are(turns: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (conv, pos, t1, t2, n_bytes, is_last) and conversations (conv, n_turns) without changes."""
    convs = runs.groupBy("conv").agg(F.sum("n").alias("n_turns"))
    pos = F.col("before") + F.col("at") - F.col("first_at") + 1
    sized = runs.drop("n").join(convs, "conv")
    members = turns.join(sized, ["conv", "part"]).select(
        "conv", pos.alias("pos"), "t1", "t2", "n_bytes", (pos == F.col("n_turns")).alias("is_last")
    )
    return members, convs


def spliced(turns: DataFrame, runs: DataFrame, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """The same where conversation c begins with turns of conversation c - c % every.

    Of that one it takes the first h turns (all if there are fewer, none if it is absent), then its own turns
    after its first h; h is crc32 of c in decimal, modulo most + 1. It may end up without turns. The remainder of
    a number below zero is not above zero, as in SQL.
    """
    c = F.col("conv")
    own = runs.groupBy("conv").agg(F.sum("n").alias("own"))
    own = own.withColumn("base", c - c % every).withColumn(
        "h", F.crc32(c.cast("string").cast("binary")) % (most + 1)
    )
    of_base = own.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = own.join(of_base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = convs.withColumn("n_turns", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = stored(convs.select("conv", "base", "h", "m", "n_turns"), "convs")
    rank = F.col("before") + F.col("at") - F.col("first_at")
    said = ["t1", "t2", "n_bytes"]
    tails = (
        turns.join(runs.drop("n").join(convs, "conv"), ["conv", "part"])
        .where(rank >= F.col("h"))
        .select("conv", (F.col("m") + rank - F.col("h") + 1).alias("pos"), *said, "n_turns")
    )
    first = turns.join(runs.where(F.col("before") < most).drop("n"), ["conv", "part"])
    first = first.where(rank < most).select(F.col("conv").alias("base"), rank.alias("rank"), *said)
    heads = (
        first.join(convs, "base")
        .where(F.col("rank") < F.col("h"))
        .select("conv", (F.col("rank") + 1).alias("pos"), *said, "n_turns")
    )
    members = tails.unionByName(heads).withColumn("is_last", F.col("pos") == F.col("n_turns")).drop("n_turns")
    return members, convs.select("conv", "n_turns")


def paths_of(members: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, n_bytes, is_last) stored: keys of every prefix and of the one before."""
    run = F.floor(F.col("pos") / RUN).cast("long")
    rows = members.select(
        "conv",
        "pos",
        run.alias("run"),
        F.xxhash64(F.lit(1), "pos", "t1", "t2").alias("x1"),
        F.xxhash64(F.lit(2), "pos", "t1", "t2").alias("x2"),
        "n_bytes",
        "is_last",
    )
    so_far = W.partitionBy("conv", "run").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = rows.select("*", F.bit_xor("x1").over(so_far).alias("y1"), F.bit_xor("x2").over(so_far).alias("y2"))
    within = stored(within, "runs-of-turns")
    # Ends of runs only: few rows even of the longest conversation.
    ends = within.where((F.col("pos") + 1) % RUN == 0)
    earlier = W.partitionBy("conv").orderBy("run").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = ends.select(
        "conv",
        (F.col("run") + 1).alias("run"),
        F.bit_xor("y1").over(earlier).alias("c1"),
        F.bit_xor("y2").over(earlier).alias("c2"),
    )

    def key(n: int) -> Column:
        return F.col(f"y{n}").bitwiseXOR(F.coalesce(f"c{n}", F.lit(0)))

    keyed = within.join(carried, ["conv", "run"], "left").select(
        "conv",
        F.col("pos").alias("depth"),
        key(1).alias("k1"),
        key(2).alias("k2"),
        key(1).bitwiseXOR(F.col("x1")).alias("p1"),
        key(2).bitwiseXOR(F.col("x2")).alias("p2"),
        "n_bytes",
        "is_last",
    )
    return stored(keyed, "paths")


# -- nodes ----------------------------------------------------------------------------------------


def _nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node with its own figures and the size of its subtree; the root has the keys 0, 0."""
    below = paths.groupBy("k1", "k2").agg(
        F.min("conv").alias("conv"),
        F.min("depth").alias("depth"),
        F.count("*").alias("n_convs"),
        F.min("n_bytes").alias("n_bytes"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(
        zero.alias("k1"), zero.alias("k2"), "conv", zero.alias("depth"), "n_convs", zero.alias("n_bytes"),
        none.alias("p1"), none.alias("p2"),
    )
    return stored(below.unionByName(root), "nodes")


def _sizes(paths: DataFrame, convs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of the conversations that name a node (stored), and the number of nodes below each node but the root.

    A conversation names its nodes from some depth on. Below a node on its path it names those at or under both.
    """
    named = nodes.where("depth > 0").groupBy("conv").agg(F.min("depth").alias("names_from"))
    reach = named.join(convs, "conv").withColumn(
        "run", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_turns") / RUN).cast("int")))
    )
    own = paths.withColumn("run", F.floor(F.col("depth") / RUN).cast("int")).join(reach, ["conv", "run"])
    own = stored(own.select("conv", "depth", "k1", "k2", "p1", "p2", "names_from", "n_turns"), "naming")
    under = F.col("n_turns") - F.greatest("depth", "names_from") + 1
    return own.drop("names_from", "n_turns"), own.groupBy("k1", "k2").agg(F.sum(under).alias("size"))


def _with_parents(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """Nodes with `n_children` and their parent's conversation."""
    children = nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
    children = stored(children, "children")
    named = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv"))
    parents = stored(named.join(children, ["p1", "p2"]), "parents")
    many = F.col("n_children") > max(200, n_nodes // HOT)
    hot = F.broadcast(parents.where(many).drop("n_children"))  # HOT rows at most, as their children are all different
    rest = nodes.join(hot, ["p1", "p2"], "left_anti")
    joined = nodes.join(hot, ["p1", "p2"]).unionByName(
        rest.join(parents.where(~many).drop("n_children"), ["p1", "p2"], "left")
    )
    counts = children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    return joined.join(counts, ["k1", "k2"], "left").fillna(0, "n_children")


# -- centroid decomposition ---------------------------------------------------------------------


def _tops(parent: np.ndarray) -> np.ndarray:
    """The topmost node above each node; -1 is no parent."""
    up = np.where(parent < 0, np.arange(len(parent)), parent)
    while True:
        again = up[up]
        if (again == up).all():
            return up
        up = again


def rollup(parent: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of `values` over the subtrees of a forest, by centroids.

    parent: a node's number, -1 at tops; size: nodes of its subtree; values: one row per node.
    """
    parent, size, totals = parent.copy(), size.copy(), np.zeros_like(values)
    alive = np.ones(len(parent), bool)
    while alive.any():
        top, live = _tops(parent), np.flatnonzero(alive)
        heavy = live[2 * size[live] >= size[top[live]]]
        order = heavy[np.lexsort((size[heavy], top[heavy]))]
        centroid = order[np.concatenate([[True], top[order[1:]] != top[order[:-1]]])]
        cut = parent.copy()
        cut[centroid] = -1
        label = _tops(cut)
        chosen = np.zeros(len(parent), bool)
        chosen[centroid] = True
        below = live[chosen[label[live]]]
        found = np.zeros_like(values)
        np.add.at(found, label[below], values[below])
        found, taken = found[centroid], size[centroid]
        totals[centroid] += found
        up = parent[centroid]
        while len(up):  # one centroid per component, so no node is on two ways
            on = up >= 0
            up, found, taken = up[on], found[on], taken[on]
            totals[up] += found
            size[up] -= taken
            up = parent[up]
        alive[centroid] = False
        parent[(parent >= 0) & chosen[parent]] = -1
        parent[centroid] = -1
    return totals


_TOTALS = "k1 long, k2 long, n_leaves long, saved long"


def _split_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole components, sorted by top, several at a time."""
    names = ["k1", "k2", "p1", "p2", "t1", "t2", "size", "leaf", "saved", "add_leaves", "add_saved"]

    def done(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        keys = np.stack([rows["k1"], rows["k2"]], axis=1)
        above = np.stack([rows["p1"], rows["p2"]], axis=1)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        flat = np.ascontiguousarray(keys[order]).view([("a", np.int64), ("b", np.int64)]).ravel()
        wanted = np.ascontiguousarray(above).view(flat.dtype).ravel()
        at = np.minimum(np.searchsorted(flat, wanted), len(flat) - 1)
        is_top = (rows["k1"] == rows["t1"]) & (rows["k2"] == rows["t2"])
        parent = np.where(is_top, -1, order[at])
        values = np.stack([rows["leaf"], rows["saved"]], axis=1)
        totals = rollup(parent, rows["size"], values)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows["k1"]),
                pa.array(rows["k2"]),
                pa.array(totals[:, 0] + rows["add_leaves"]),
                pa.array(totals[:, 1] + rows["add_saved"]),
            ],
            ["k1", "k2", "n_leaves", "saved"],
        )

    held = {name: np.zeros(0, np.int64) for name in names}
    for batch in batches:
        part = {name: batch.column(name).fill_null(0).to_numpy() for name in names}
        held = {name: np.concatenate([held[name], part[name]]) for name in names}
        n = len(held["t1"])
        if n < _TASK_ROWS:
            continue
        edges = np.flatnonzero((held["t1"][1:] != held["t1"][:-1]) | (held["t2"][1:] != held["t2"][:-1]))
        if len(edges):  # the last component may go on in the next batch
            to = int(edges[-1]) + 1
            yield done({name: x[:to] for name, x in held.items()})
            held = {name: x[to:] for name, x in held.items()}
    if len(held["t1"]):
        yield done(held)


def _small(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= SMALL else rows


def subtree_totals(nodes: DataFrame, naming: DataFrame, piece: int = PIECE) -> DataFrame:
    """(k1, k2, n_leaves, saved): sums of `leaf` and `saved` over every node's subtree.

    nodes: k1, k2, p1, p2, conv, depth, size, leaf, saved; naming: paths of the conversations that name nodes.
    """
    ship(nodes.sparkSession)
    zero = F.lit(0).cast("long")
    live = nodes.select("*", zero.alias("t1"), zero.alias("t2"), zero.alias("add_leaves"), zero.alias("add_saved"))
    done, settled = [], []
    while True:
        top = (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))
        large = stored(live.where(top & (F.col("size") > piece)).select("t1", "t2", F.col("size").alias("total")), "large")
        n = large.count()
        if not n:
            settled.append(live)
            break
        settled.append(live.join(_small(large, n), ["t1", "t2"], "left_anti"))
        big = live.join(_small(large, n), ["t1", "t2"])
        centroid = F.max_by(F.struct("k1", "k2", "conv", "depth", "size"), "depth").alias("g")
        centroids = big.where(2 * F.col("size") >= F.col("total")).groupBy("t1", "t2").agg(centroid)
        centroids = _small(stored(centroids, "centroids"), n)
        own = naming.alias("o")
        # Conversations that go on below a centroid, with the child they go to; nodes on the way to the top.
        below = own.join(centroids, (F.col("p1") == F.col("g.k1")) & (F.col("p2") == F.col("g.k2")))
        below = below.select(F.col("o.conv").alias("conv"), "t1", "t2", F.col("o.k1").alias("c1"), F.col("o.k2").alias("c2"))
        way = own.join(centroids, (F.col("o.conv") == F.col("g.conv")) & (F.col("o.depth") <= F.col("g.depth")))
        way = way.select(F.col("o.k1").alias("k1"), F.col("o.k2").alias("k2"), "t1", "t2")
        root = centroids.where("t1 = 0 and t2 = 0").select(zero.alias("k1"), zero.alias("k2"), "t1", "t2")
        way = way.unionByName(root).withColumn("on_way", F.lit(True))
        marked = (
            big.join(centroids, ["t1", "t2"])
            .join(below, ["conv", "t1", "t2"], "left")
            .join(way, ["k1", "k2", "t1", "t2"], "left")
            .withColumn("is_g", (F.col("k1") == F.col("g.k1")) & (F.col("k2") == F.col("g.k2")))
            .withColumn("under", F.col("c1").isNotNull() & (F.col("depth") > F.col("g.depth")))
        )
        marked = stored(marked, "marked")
        sums = marked.where("under or is_g").groupBy("t1", "t2").agg(
            F.sum("leaf").alias("sum_leaves"), F.sum("saved").alias("sum_saved")
        )
        on_way = F.col("on_way").isNotNull()

        def moved(name: str, to: str) -> Column:
            return F.when(F.col("under"), F.col(to)).otherwise(F.col(name)).alias(name)

        after = marked.join(_small(sums, n), ["t1", "t2"]).select(
            "k1", "k2", "p1", "p2", "conv", "depth", "leaf", "saved", "is_g",
            (F.col("size") - F.when(on_way & ~F.col("is_g"), F.col("g.size")).otherwise(0)).alias("size"),
            (F.col("add_leaves") + F.when(on_way, F.col("sum_leaves")).otherwise(0)).alias("add_leaves"),
            (F.col("add_saved") + F.when(on_way, F.col("sum_saved")).otherwise(0)).alias("add_saved"),
            moved("t1", "c1"), moved("t2", "c2"),
        )
        after = stored(after, "after")
        done.append(after.where("is_g").select("k1", "k2", F.col("add_leaves").alias("n_leaves"), F.col("add_saved").alias("saved")))
        live = after.where("not is_g").drop("is_g")
    rest = settled[0].select(*live.columns)
    for other in settled[1:]:
        rest = rest.unionByName(other.select(*live.columns))
    pieces = rest.drop("conv", "depth").repartition("t1", "t2").sortWithinPartitions("t1", "t2")
    totals = pieces.mapInArrow(_split_in_tasks, _TOTALS)
    for rows in done:
        totals = totals.unionByName(rows)
    return totals


# -- ends -----------------------------------------------------------------------------------------


def _digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the conversations that end at a node, in ascending order."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    ranges = ends.groupBy("k1", "k2", F.shiftright("conv", 12).alias("range")).agg(ids.alias("ids"))
    ranges = ranges.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "range")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            found = []
            for k1, k2, part in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids"))):
                if (k1, k2) == key:
                    state.update(b"," + part.encode())
                    continue
                if key is not None:
                    found.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(part.encode())
            yield _digest_rows(found)
        yield _digest_rows([] if key is None else [(*key, state.hexdigest())])

    return ranges.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _digest_rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [(), (), ()]
    types = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["k1", "k2", "ends_sha256"])


def prefix_trie(members: DataFrame, convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per node of the trie.

    members: conv, pos (1, 2, ... in each conversation), t1, t2, n_bytes, is_last; convs: conv, n_turns.
    `conv_id`, `depth` name the node, `parent_conv_id` its parent (null for the root); `n_convs` conversations go through
    it, `n_children` nodes follow it, `n_leaves` childless nodes are at or below it; `saved_tokens` sums
    (n_convs - 1) * bytes of the last text over its subtree; `ends_sha256` is of the conversations that
    end there, comma-joined. Without conversations there are no rows, not even a root.
    """
    ship(members.sparkSession)
    convs = stored(convs, "convs")
    paths = paths_of(members)
    nodes = _nodes(paths, convs)
    n_nodes = nodes.count()
    naming, sizes = _sizes(paths, convs, nodes)
    every = _with_parents(nodes, n_nodes).join(sizes, ["k1", "k2"], "left").select(
        "k1", "k2", "p1", "p2", "conv", "depth", "parent_conv", "n_convs", "n_children",
        F.coalesce("size", F.lit(n_nodes).cast("long")).alias("size"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    )
    every = stored(every, "tree")
    figures = every.select("k1", "k2", "p1", "p2", "conv", "depth", "size", "leaf", "saved")
    totals = subtree_totals(figures, naming, piece)
    zero = F.lit(0).cast("long")
    ends = paths.where("is_last").select("k1", "k2", "conv")
    ends = ends.unionByName(convs.where("n_turns = 0").select(zero.alias("k1"), zero.alias("k2"), "conv"))
    return (
        every.drop("saved")
        .join(totals, ["k1", "k2"])
        .join(_digests(ends), ["k1", "k2"], "left")
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            F.col("parent_conv").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
