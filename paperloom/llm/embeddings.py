"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.common import forget, settle, travels
from paperloom.llm.graph import components

travels(__name__)

#: Vectors link at this cosine or more.
THRESHOLD = 0.9
#: Length of a neighbour list at first, and the most it is enlarged to; beyond that a group is compared in blocks.
LIST, LIST_MOST = 8, 64
#: Vectors that are compared with each other at once. The graph starts from so many random cuts that two vectors at the
#: threshold share a cell in one of them with probability MEET; cells that are too large are cut again so many times.
LEAF, MEET, RECUTS = 64, 0.99, 4
#: Bits of a code from which a cut takes as many as it needs.
CODE = 62
#: A full list grows by this factor. Refining ends when no list grows and a round finds less than this share of the links
#: anew (in lists that are not full of links), or after so many rounds; neighbours below the threshold may still change then, which changes no answer.
GROWTH, SETTLED, ROUNDS = 4, 0.002, 6
#: Vectors of a block when the links of a large group are counted.
BLOCK = 256
#: Centres of cells that are compared at once, and the angle (radians) by which a bound is widened against rounding.
CENTRES, SLACK = 512, 1e-3
#: Vectors of the recall audit (compared with all others), the share of their links that must be found, and the tries.
AUDIT, RECALL, TRIES = 512, 0.98, 3


def usable(vector: Column) -> Column:
    """Whether a vector can link at all: neither null nor zero, all components finite."""
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & sound & (squares > 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision; scaled first, so that no square over- or underflows."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines of two sets of unit vectors. What falls next to the threshold is summed again in a fixed order."""
    s = a @ b.T
    for i, j in zip(*np.nonzero(np.abs(s - THRESHOLD) < 1e-9), strict=True):
        s[i, j] = np.einsum("i,i->", a[i], b[j])
    return s


def in_groups(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work on each group of rows with the same long `g`, many groups to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            g = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(start, end - start)
                if held and (not part.num_rows or held[-1].column("g")[0] != part.column("g")[0]):
                    yield from work(pa.Table.from_batches(held).combine_chunks())
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return df.repartition("g").sortWithinPartitions("g").mapInArrow(run, schema)


LINKED = "u long, v long, sim double, link boolean"


def _table(u, v, sim, link) -> pa.RecordBatch:
    columns = [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64()), pa.array(link, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["u", "v", "sim", "link"])


def compare_group(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Compare the vectors of a group; each keeps what beats the last place of its list (floor), its best LIST of them and the
    links up to the length of its list. Where a group has old members only pairs with a fresh one are new."""
    node = group.column("node").to_numpy()
    if len(node) < 2:
        return
    fresh = group.column("fresh").to_numpy()
    floor, room = group.column("floor").to_numpy(), group.column("room").to_numpy()
    s = cosines(unit := matrix(group.column("vector").combine_chunks()), unit)
    allowed = (fresh[:, None] | fresh[None, :]) & (node[:, None] != node[None, :])
    s = np.where(allowed & (s > floor[:, None]), s, -2.0)
    most = np.minimum(np.where((s >= THRESHOLD).sum(1) > LIST, room, LIST), len(node) - 1)
    order = np.argsort(-s, axis=1, kind="stable")[:, : int(most.max())]
    best = np.take_along_axis(s, order, 1)
    i, k = np.nonzero((best > -2) & (np.arange(order.shape[1])[None, :] < most[:, None]))
    if len(i):
        yield _table(node[i], node[order[i, k]], np.round(best[i, k], 9), best[i, k] >= THRESHOLD)


def trees_for(bits: int) -> int:
    """Random cuts of so many bits in one of which two vectors at the threshold share a cell with probability MEET."""
    together = (1 - np.arccos(THRESHOLD) / np.pi) ** bits
    return int(np.ceil(np.log(1 - MEET) / np.log1p(-together)))


def leaves(vectors: DataFrame, trees: int, seed: int) -> DataFrame:
    """(node, size, tree, code) for every vector in each of the random cuts of the space: the signs of CODE projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            lengths = np.array(batch.column("size").to_pylist())
            for size in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == size))
                unit = matrix(part.column("vector"))
                for tree in range(trees):
                    if (size, tree) not in planes:
                        planes[size, tree] = np.random.default_rng([seed, size, tree]).normal(size=(size, CODE))
                    codes = (unit @ planes[size, tree] > 0) @ (1 << np.arange(CODE, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node"), part.column("size"), pa.array(np.full(part.num_rows, tree), pa.int64()), pa.array(codes, pa.int64())],
                        ["node", "size", "tree", "code"],
                    )

    return vectors.select("node", "size", "vector").mapInArrow(run, "node long, size int, tree long, code long")


def recut(codes: DataFrame, bits: int) -> DataFrame:
    """(node, size, tree, depth, cell): the first bits of each code; a cell of more than LEAF is cut by further bits, as its size asks."""
    cell = F.expr("code & (shiftleft(1L, depth) - 1)")
    open_ones = codes.withColumn("depth", F.lit(min(bits, CODE)))
    done = []
    for _ in range(RECUTS):
        cut = open_ones.withColumn("cell", cell)
        keys = ["tree", "size", "depth", "cell"]
        further = F.ceil(F.log2(F.col("members") / LEAF)).cast("int")
        over = settle(cut.groupBy(*keys).agg(F.count("*").alias("members")).where((F.col("members") > LEAF) & (F.col("depth") < CODE)))
        if over.isEmpty():
            break
        done.append(cut.join(over, keys, "left_anti").drop("code"))
        deeper = F.least(F.col("depth") + F.greatest(further, F.lit(1)), F.lit(CODE)).alias("depth")
        open_ones = settle(cut.join(over, keys).select("node", "size", "tree", "code", deeper))
    out = open_ones.withColumn("cell", cell).drop("code")
    for part in done:
        out = out.unionByName(part)
    return out


def dealt(members: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """members with g: their group by *keys*; a group of more than LEAF is dealt out anew each time, so that nothing is left out for
    good and no task holds it whole."""
    counted = members.groupBy(*keys).agg(F.count("*").alias("members"))
    parts = F.ceil(F.col("members") / LEAF)
    part = F.when(parts > 1, F.pmod(F.xxhash64(F.lit(seed), "node", *keys), parts)).otherwise(F.lit(0).cast("long"))
    return members.join(counted, keys).withColumn("g", F.xxhash64(*keys, part)).drop("members")


def best_lists(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The best `room` neighbours of every node, each once. found: (u, v, sim, link, fresh)."""
    once = found.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("link").alias("link"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    ranked = once.withColumn("rank", rank).where(F.col("rank") <= LIST_MOST)
    return ranked.join(nodes.select(F.col("node").alias("u"), "room"), "u").where("rank <= room").drop("room", "rank")


def places(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, room, floor, grows): the length of each node's list, enlarged where it is full of links, and the cosine to beat.

    A list with room left is beaten by anything.
    """
    state = lists.groupBy(F.col("u").alias("node")).agg(
        F.count("*").alias("held"), F.min("sim").alias("last"), F.min("link").alias("full")
    )
    joined = nodes.select("node", "room").join(state, "node", "left")
    grows = F.coalesce(F.col("full") & (F.col("held") >= F.col("room")) & (F.col("room") < LIST_MOST), F.lit(False))
    room = F.when(grows, F.least(F.col("room") * GROWTH, F.lit(LIST_MOST))).otherwise(F.col("room"))
    floor = F.when(F.coalesce(F.col("held"), F.lit(0)) >= room, F.col("last")).otherwise(F.lit(-1.5))
    return joined.select("node", room.cast("long").alias("room"), floor.alias("floor"), grows.alias("grows"))


def open_links(lists: DataFrame) -> DataFrame:
    """(u, links, new) for the lists that are not full of links: what large groups still find says nothing about the others."""
    state = lists.groupBy("u").agg(F.count_if("link").alias("links"), F.count_if(F.col("link") & F.col("fresh")).alias("new"))
    return state.where(F.col("links") < LIST)


def neighbour_graph(vectors: DataFrame, seed: int = 0, start: DataFrame | None = None, rooms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lists, nodes) after NN-descent: lists (u, v, sim, link, fresh), nodes (node, room, floor).

    Lists start from the leaves of random cuts (and from *start* with the lengths in *rooms*, if given). Each round compares, for every node, the
    nodes that it lists or that list it, if one of the two is new there; members of a long list of them are dealt into groups of LEAF.
    """
    count = vectors.count()
    bits = max(1, int(np.ceil(np.log2(max(2, count / LEAF)))))
    room = F.lit(LIST).cast("long").alias("room")
    nodes = settle((vectors.select("node", room) if rooms is None else rooms.select("node", "room")).withColumn("floor", F.lit(-1.5)))
    base = vectors.select("node", "vector")
    codes = settle(leaves(vectors, trees_for(bits), seed))
    cuts = dealt(recut(codes, bits), ["tree", "size", "depth", "cell"], seed)
    first = cuts.join(base.join(nodes, "node"), "node").withColumn("fresh", F.lit(True))
    found = in_groups(first.select("g", "node", "fresh", "floor", "room", "vector"), compare_group, LINKED)
    found = found.withColumn("fresh", F.lit(True))
    lists = settle(best_lists(found if start is None else found.unionByName(start.withColumn("fresh", F.lit(False))), nodes))
    few = False
    for turn in range(1, ROUNDS + 1):
        following = settle(places(lists, nodes))
        forget(nodes)
        nodes = following
        if few and nodes.where("grows").isEmpty():
            break
        both = lists.select(F.col("u").alias("hub"), F.col("v").alias("node"), "fresh").union(lists.select(F.col("v"), F.col("u"), "fresh"))
        around = both.groupBy("hub", "node").agg(F.max("fresh").alias("fresh"))
        grouped = dealt(around, ["hub"], seed + turn).join(base.join(nodes, "node"), "node")
        better = in_groups(grouped.select("g", "node", "fresh", "floor", "room", "vector"), compare_group, LINKED)
        merged = lists.withColumn("fresh", F.lit(False)).unionByName(better.withColumn("fresh", F.lit(True)))
        renewed = settle(best_lists(merged, nodes))
        forget(lists)
        lists = renewed
        found = open_links(lists).agg(F.sum("links").alias("links"), F.sum("new").alias("new")).first()
        few = (found["new"] or 0) <= SETTLED * (found["links"] or 0)
    return lists, nodes


def count_block(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links between the two blocks of a group (or within one), as sums for each of their vectors."""
    node, side, weight = (group.column(c).to_numpy() for c in ("node", "side", "n"))
    unit = matrix(group.column("vector").combine_chunks())
    left, right = side != 1, side != 0  # 2: the same block is both
    hit = cosines(unit[left], unit[right]) >= THRESHOLD
    if (side == 2).any():
        np.fill_diagonal(hit, False)
        out = [(node, hit @ weight)]
    else:
        out = [(node[left], hit @ weight[right]), (node[right], weight[left] @ hit)]
    for own, links in out:
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(links, pa.int64())], ["node", "links"])


def count_in_blocks(members: DataFrame) -> DataFrame:
    """(node, links) for all members (component, node, n, vector) of components, every pair of a component compared, none emitted.

    A component is dealt into blocks, and each pair of blocks is one group of work: no task holds more than two blocks.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt_out = members.join(sizes, "component").withColumn("block", block)
    pairs = dealt_out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") == low, 0).otherwise(1)
    work = pairs.select(F.xxhash64("component", low, high).alias("g"), "node", "n", side.cast("long").alias("side"), "vector")
    return in_groups(work, count_block, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def audit(vectors: DataFrame, links: DataFrame, among: DataFrame | None = None) -> float:
    """The share of the links of AUDIT vectors (those with the smallest hashes, of *among* if given) that are in links (node, links),
    as a mean over the vectors that have a link, so that one with very many hides nothing.

    Each is compared with every vector; the audited ones are the only vectors that leave the executors.
    """
    chosen = (vectors if among is None else among).select("node", "vector", "size").orderBy(F.xxhash64("node")).limit(AUDIT).collect()
    by_size: dict[int, tuple] = {}
    for size in {r["size"] for r in chosen}:
        own = [r for r in chosen if r["size"] == size]
        by_size[size] = np.array([r["node"] for r in own]), matrix(pa.array([r["vector"] for r in own], pa.list_(pa.float64())))
    shared = vectors.sparkSession.sparkContext.broadcast(by_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(batch.column("size").to_pylist())
            for size in set(lengths.tolist()) & set(shared.value):
                part = batch.filter(pa.array(lengths == size))
                nodes, unit = shared.value[size]
                other, weight = part.column("node").to_numpy(), part.column("n").to_numpy()
                hit = (cosines(unit, matrix(part.column("vector"))) >= THRESHOLD) & (nodes[:, None] != other[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hit @ weight, pa.int64())], ["node", "true"])

    true = vectors.select("node", "n", "size", "vector").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    share = F.least("true", F.coalesce("links", F.lit(0))) / F.col("true")
    found = true.where(F.col("true") > 0).join(links, "node", "left").agg(F.avg(share).alias("share")).first()
    return 1.0 if found["share"] is None else found["share"]


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, rows of the left side, rows of the right side) of a group of work; side 2 is on both."""
    side = group.column("side").to_numpy()
    return matrix(group.column("vector").combine_chunks()), np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def compare_centres(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """The cells of different components that are near enough for a link between two of their vectors."""
    unit, left, right = _sides(group)
    node, root, radius = (group.column(c).to_numpy() for c in ("node", "root", "radius"))
    apart = np.arccos(np.clip(unit[left] @ unit[right].T, -1, 1))
    near = apart <= radius[left][:, None] + radius[right][None, :] + np.arccos(THRESHOLD) + SLACK
    near &= root[left][:, None] != root[right][None, :]
    if len(left) == len(right) == len(node):  # the same block twice
        near &= node[left][:, None] < node[right][None, :]
    i, j = np.nonzero(near)
    yield pa.RecordBatch.from_arrays([pa.array(node[left[i]], pa.int64()), pa.array(node[right[j]], pa.int64())], ["a", "b"])


def find_link(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """One link between the two sides of a group, if there is any: it joins their components, whose links are then counted."""
    unit, left, right = _sides(group)
    node = group.column("node").to_numpy()
    i, j = np.nonzero(cosines(unit[left], unit[right]) >= THRESHOLD)
    if len(i):
        yield pa.RecordBatch.from_arrays([pa.array(node[left[i[:1]]], pa.int64()), pa.array(node[right[j[:1]]], pa.int64())], ["a", "b"])


def bridges(members: DataFrame, lists: DataFrame) -> DataFrame:
    """(a, b): a link between any two components of members (node, root, size, vector) that have one. None is missed.

    Every vector goes to the cell of the one with the smallest hash among itself and the links in its list, so a cell lies in one
    component and within a known angle of its centre. Cells of different components are compared with all their vectors if
    the angle between their centres allows a link at all.
    """
    own = members.select("node", F.xxhash64("node").alias("h"), F.col("node").alias("centre"), F.lit(1.0).alias("sim"))
    listed = lists.where("link").select(F.col("u").alias("node"), F.xxhash64("v").alias("h"), F.col("v").alias("centre"), "sim")
    least = own.unionByName(listed).groupBy("node").agg(F.min(F.struct("h", "centre", "sim")).alias("x"))
    placed = settle(members.join(least, "node").select("node", "root", "size", "vector", "x.centre", "x.sim"))
    radius = F.acos(F.greatest(F.min("sim") - 1e-9, F.lit(-1.0)))
    cells = placed.groupBy("centre").agg(radius.alias("radius"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cells = settle(members.join(cells, F.col("node") == F.col("centre")).drop("centre"))
    counts = cells.groupBy("size").agg(F.ceil(F.count("*") / CENTRES).alias("parts"))
    dealt_out = cells.join(counts, "size").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    pairs = dealt_out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") == low, 0).otherwise(1).cast("long")
    work = pairs.select(F.xxhash64("size", low, high).alias("g"), side.alias("side"), "node", "root", "radius", "vector")
    near = in_groups(work, compare_centres, "a long, b long")
    for end in ("a", "b"):
        blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias(f"block_{end}")
        near = near.join(cells.select(F.col("node").alias(end), "blocks"), end).select(*near.columns, blocks)
    near = settle(near.withColumn("g", F.xxhash64("a", "block_a", "b", "block_b")))
    inside = placed.join(cells.select(F.col("node").alias("centre"), "blocks"), "centre").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    ends = [
        near.select("g", F.col(end).alias("centre"), F.col(f"block_{end}").alias("block"))
        .join(inside, ["centre", "block"])
        .select("g", F.lit(k).cast("long").alias("side"), "node", "vector")
        for k, end in enumerate(("a", "b"))
    ]
    return in_groups(ends[0].unionByName(ends[1]), find_link, "a long, b long")


def bridged(edges: DataFrame, groups: DataFrame, members: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups (node, root) and members with the components joined that have a link between members, which full lists may leave out."""
    if members.select("root").distinct().limit(2).count() < 2:
        return groups, members
    joined = settle(bridges(members.drop("n"), lists))
    if joined.isEmpty():
        return groups, members
    groups = settle(components(edges.unionByName(joined)).withColumnRenamed("component", "root"))
    return groups, settle(members.drop("root").join(groups, "node"))


def recounted(listed: DataFrame, members: DataFrame) -> DataFrame:
    """(node, links): as listed, and counted anew over all pairs of a component for members (node, root, n, vector)."""
    counted = count_in_blocks(members.select(F.col("root").alias("component"), "node", "n", "vector"))
    both = listed.join(counted.withColumnRenamed("links", "exact"), "node", "full")
    return both.select("node", F.coalesce("exact", "links").alias("links"))


def link_classes(vectors: DataFrame) -> DataFrame:
    """(node, links, root): for each of the vectors (node, n, size, vector) the vectors of other nodes linked to it, and its component."""
    lists = nodes = None
    alike = settle(vectors.withColumn("n", F.lit(1).cast("long")))
    for attempt in range(TRIES):
        lists, nodes = neighbour_graph(vectors, 1000 * attempt, lists, nodes)
        edges = settle(lists.where("link").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
        groups = settle(components(edges).withColumnRenamed("component", "root"))
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("node", "other")
        weights = vectors.select(F.col("node").alias("other"), "n")
        listed = settle(both.join(weights, "other").groupBy("node").agg(F.sum("n").alias("links"), F.count("*").alias("others")))
        lengths = lists.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("held"), F.min("link").alias("full"))
        crowded = lengths.where("full").join(nodes.select("node", "room"), "node").where("held >= room")
        large = groups.join(crowded, "node", "left_semi").select("root").distinct()
        inside = settle(groups.join(large, "root").join(vectors, "node").select("node", "root", "n", "size", "vector"))
        found = audit(alike, listed.select("node", F.col("others").alias("links")), alike.join(inside, "node", "left_anti"))
        if found >= RECALL:
            break
    else:  # cuts do not find them: every component, lone vectors among them, is compared as large ones are
        rooted = vectors.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        inside = settle(rooted.select("node", "root", "n", "size", "vector"))
    groups, inside = bridged(edges, groups, inside, lists)
    return recounted(listed.select("node", "links"), inside.join(groups, ["node", "root"], "left_semi")).join(groups, "node")


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) per row of *table*; other columns, labels among them, are not read.

    Equal vectors are one node with a weight. Vectors that are null, empty, zero or hold null or non-finite components, and vectors
    of different lengths, link with nothing. component_id is the smallest id reachable; rows that share an id count as different
    vectors. A null id never names a component that holds another id. An empty table gives no rows.
    """
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    sound = rows.where(usable(F.col("vector")))
    classes = sound.groupBy("vector").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.count("id").alias("known"))
    nodes = settle(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("vector")))
    linked = settle(link_classes(nodes.select("node", "n", "size", "vector")))
    rooted = nodes.select("node", "n", "least").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = settle(rooted.withColumn("links", F.coalesce("links", F.lit(0)) + F.col("n") - 1))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = rooted.join(least, "root").select("node", "links", "component_id")
    by_vector = nodes.select("node", F.col("vector").alias("own")).join(answer, "node").drop("node")
    told = rows.where(usable(F.col("vector"))).join(by_vector, F.col("vector") == F.col("own")).select("id", "links", "component_id")
    alone = rows.where(~usable(F.col("vector"))).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component_id"))
    return told.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("links").cast("long").alias("n_links"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


QUERIES = {"op1_nn_descent": lambda spark, sf_dir: near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))}
SQL: dict[str, str] = {}
