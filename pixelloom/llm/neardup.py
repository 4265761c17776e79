"""Near-duplicate documents by chosen-path similarity join.

A document is the set of its five-word shingles (``shingling``); documents of equal sets are one vertex.
Each vertex has MinHash values under ``COORDINATES`` functions. A tree starts with one node that holds all
vertices. A node chooses a coordinate, the same for all its members, and sends every member to the child
named by its value there, so a pair of similarity s stays together with probability s. Nodes of at most
``LEAF`` members are compared exhaustively, larger ones branch again, and ``TREES`` independent trees repeat
this: a pair at the threshold that meets in small nodes after k choices is missed with probability
(1 - 0.75^k)^TREES, which is 4e-15 for k = 1 and 1e-5 for k = 3.

Dense groups, such as thousands of copies with a few edits, would stay together for many levels. So at the
first level every member of a node is estimated against the node's least member, its pivot, if that one is
the least in ``HEADED`` of its own root nodes at least. A vertex with an estimate of ``CORE`` or more is a core
of its best pivot. Whatever is similar to it has at least ``CORE`` - 0.25 in common with the pivot (Jaccard
distance is a metric), so it meets the pivot in a node that the pivot heads, but for a chance of
0.45^HEADED = 3e-6, and stands in the pivot's cluster, which ends at ``SHELL``, 4.5 standard deviations under
0.55. Cores are compared with their whole cluster at once, on full sets, and do not branch; all others do, also
those close to a pivot that heads fewer roots. Clusters of any size are cut into blocks. Each block is compared
with itself and the pivot first. Only members outside the pivot's class after that, the rest, then meet the other
blocks, so thousands of copies that are all similar to the pivot cost one task per block and no pairs of blocks.

Only classes count: pairs already in one class are not compared again, and a task reports each member's link to
one that stands for its class, not all similar pairs. What pairs of a small node join whose estimate is at most
4.5 standard deviations under the threshold, and nodes that are still large after ``DEPTH`` levels, are clusters
of a second round, compared on full sets in the same way.

Defined cases: NULL or empty text has the empty set and is linked with nothing, each such row a class of
its own; fewer than five words make one shingle; repeated rows are in one class; the id of a class is its
least id, NULL ids being left out; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import shingling
from pixelloom.llm.components import components
from pixelloom.llm.store import small, written
from pixelloom.llm.text import fresh

PERCENT = 75
COORDINATES, TREES, DEPTH, LEAF = 128, 24, 2, 256
#: Members and shingles of a block on average.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: What is similar to a core has 0.55 in common with its pivot; SHELL is 0.55 - 4.5 * sqrt(0.55 * 0.45 / 128).
CORE, SHELL = 0.8, 0.35
#: A table with sketches of COORDINATES bytes is broadcast up to so many rows (some 40 MB).
SMALL_SKETCHES = 200_000
#: Estimates from COORDINATES values that are let through: 0.75 - 4.5 * sqrt(0.75 * 0.25 / 128).
ESTIMATE = 0.578
#: A pivot has to head so many root nodes: what is similar to its cores must not miss them all.
HEADED = 16
SEED = 7


def _roots(trees: int) -> list[int]:
    """The coordinate that the root of each tree chooses."""
    return [int(c) for c in np.random.default_rng(SEED).permutation(COORDINATES)[:trees]]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors, roots = shingling.multipliers(COORDINATES, SEED), _roots(TREES)
    for batch in batches:
        digests, counts, sketches, values = [], [], [], []
        for found in shingling.shingle_sets(batch.column(2).to_pylist()):
            counts.append(len(found))
            if not len(found):
                digests.append(None), sketches.append(None), values.append(None)
                continue
            least = shingling.minhash(found, factors)
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            sketches.append((shingling.mixed(least) & np.uint64(255)).astype(np.uint8).tobytes())
            values.append(least[roots].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()),
             pa.array(sketches, pa.binary()), pa.array(values, pa.list_(pa.int64()))],
            names=["id", "tk", "digest", "n", "sketch", "roots"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, text): ``tk`` tells apart texts under one id."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tk, digest, n, sketch, roots): set digest and size, eight bits of every MinHash value, and the roots' values."""
    rows = _rows(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_signed, f"id {kind}, tk bigint, digest binary, n bigint, sketch binary, roots array<bigint>")


def _bytes(column: pa.Array) -> np.ndarray:
    """The sketches of a column as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated similarity of sketches, row by row."""
    return (a == b).mean(axis=1)


def _close(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    sizes = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    return sizes & (_alike(a, b) >= ESTIMATE)


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            alike = _alike(_bytes(cols["sketch"]), _bytes(cols["sketch_b"]))
            yield pa.RecordBatch.from_arrays([cols["vid"], cols["pivot"], pa.array(alike)], names=["vid", "pivot", "alike"]).filter(
                pa.array(alike >= SHELL))


def estimated(pairs: DataFrame, sketches: DataFrame, heads: DataFrame) -> DataFrame:
    """(vid, pivot, alike) for the pairs in one cluster; ``heads`` are the pivots with their sketches (pivot, sketch_b)."""
    both = pairs.join(sketches.select("vid", "sketch"), "vid").join(small(heads, SMALL_SKETCHES), "pivot")
    return both.select("vid", "pivot", "sketch", "sketch_b").mapInArrow(_estimates, "vid bigint, pivot bigint, alike double")


class _Classes:
    """Union-find over the members of one group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared > 0 and 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _joined(vids: list[int], comps: list[int], cores: np.ndarray, pivot: int, sketch: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(member, member that stands for its class) of a group, joined by its similar pairs (core, any)."""
    classes, first = _Classes(len(vids)), {}
    for i, c in enumerate(comps):
        classes.join(first.setdefault(c, i), i)

    def test(i: int, j: int) -> None:
        if classes.root(i) != classes.root(j) and _similar(sets[i], sets[j]):
            classes.join(i, j)

    def roots() -> np.ndarray:
        return np.array([classes.root(j) for j in range(len(vids))])

    center = vids.index(pivot) if pivot in vids else None
    if center is not None:
        for i in range(len(vids)):
            test(center, i)
    sizes, here = np.array([len(x) for x in sets]), roots()
    for i in np.flatnonzero(cores):
        rest = np.flatnonzero(here != here[i])
        if len(rest):
            alike = (sketch[rest] == sketch[i]).mean(axis=1)
            good = (alike >= ESTIMATE) & (100 * np.minimum(sizes[rest], sizes[i]) >= PERCENT * np.maximum(sizes[rest], sizes[i]))
            if good.any():
                for j in rest[good][np.argsort(-alike[good], kind="stable")]:
                    test(int(i), int(j))
                here = roots()
    stands = {} if center is None else {classes.root(center): pivot}
    for i in np.argsort(vids):
        stands.setdefault(classes.root(int(i)), vids[i])
    return [(v, stands[classes.root(i)]) for i, v in enumerate(vids) if stands[classes.root(i)] != v]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each (pivot, i, j) to the vertex that stands for a's class there; rows come sorted by it.

    A vertex that comes twice counts once.
    """
    key, vids, comps, cores, sketches, sets, seen = None, [], [], [], [], [], set()

    def links() -> Iterator[pa.RecordBatch]:
        if len(vids) > 1:
            found = _joined(vids, comps, np.array(cores), key[0], np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, COORDINATES), sets)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        pivots, i, j, vid, comp, core, sketch = (batch.column(c).to_pylist() for c in range(7))
        for r, found in enumerate(shingling.shingle_sets(batch.column(7).to_pylist())):
            if (pivots[r], i[r], j[r]) != key:
                yield from links()
                key, vids, comps, cores, sketches, sets, seen = (pivots[r], i[r], j[r]), [], [], [], [], [], set()
            if vid[r] not in seen:
                seen.add(vid[r])
                vids.append(vid[r]), comps.append(comp[r]), cores.append(core[r])
                sketches.append(sketch[r]), sets.append(found)
    yield from links()


def clusters(near: DataFrame) -> DataFrame:
    """(pivot, vid, comp, core) from the estimates (vid, pivot, alike): clusters that have a core beside the pivot."""
    best = near.groupBy("vid").agg(F.max(F.struct("alike", (-F.col("pivot")).alias("p"))).alias("b")).where(F.col("b.alike") >= CORE).select(
        "vid", (-F.col("b.p")).alias("pivot"))
    heads = small(written(best.select("pivot").distinct(), "cluster-heads"))
    own = heads.select("pivot", F.col("pivot").alias("vid"), F.lit(True).alias("core"))
    rest = near.select("pivot", "vid").join(heads, "pivot", "left_semi").join(
        best.withColumn("core", F.lit(True)), ["pivot", "vid"], "left").select("pivot", "vid", F.coalesce("core", F.lit(False)).alias("core"))
    return own.unionByName(rest).withColumn("comp", F.col("vid"))


def _blocks(count: str, shingles: str) -> Column:
    """Blocks for so many members with so many shingles."""
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _task_links(tasks: DataFrame, vertices: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) found by the tasks (pivot, i, j, vid, comp, core), on full sets."""
    known = vertices.select("vid", "sketch", F.col("rep.id").alias("rid"), F.col("rep.tk").alias("rtk"))
    wanted = small(written(tasks.join(known, "vid"), "cluster-tasks"), SMALL_SKETCHES)
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("rid")) & (F.col("tk") == F.col("rtk")))
    return (texts.select("pivot", "i", "j", "vid", "comp", "core", "sketch", "text").repartition("pivot", "i", "j")
            .sortWithinPartitions("pivot", "i", "j").mapInArrow(_grouped, "a bigint, b bigint"))


def cluster_links(members: DataFrame, vertices: DataFrame, rows: DataFrame) -> DataFrame:
    """Links within clusters (pivot, vid, comp, core), on full sets: every core with its whole cluster.

    Blocks are compared with themselves and the pivot first. The members that this leaves outside the pivot's class,
    the rest, are then compared with all blocks; rows grow with members times blocks of the rest.
    """
    sized = members.join(vertices.select("vid", "n"), "vid")
    total = written(sized.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).select("pivot", _blocks("m", "s").alias("blocks")), "cluster-sizes")
    dealt = written(sized.join(small(total), "pivot").withColumn("block", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")), "cluster-members")
    # the pivot goes to every block
    at = F.when(F.col("vid") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    own = dealt.select("pivot", F.explode(at).alias("i"), "vid", "comp", "core").select("pivot", "i", F.col("i").alias("j"), "vid", "comp", "core")
    first = written(_task_links(own, vertices, rows), "block-links")

    more = dealt.where("blocks > 1 and vid <> pivot").join(first.select(F.col("a").alias("vid"), F.col("b").alias("pivot")).distinct(), ["pivot", "vid"], "left_anti")
    more = written(more.select("pivot", "vid", "n", "blocks", "core"), "cluster-rest")
    if _empty(more):
        return first
    rests = written(more.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).select("pivot", _blocks("m", "s").alias("rests")), "rest-sizes")
    # what is known to be linked already has one class: that of the pivot, else the least vertex it was linked to
    now = first.groupBy("a").agg(F.min("b").alias("b")).withColumnRenamed("a", "vid")
    inside = dealt.where("blocks > 1").join(small(rests), "pivot").join(more.select("pivot", "vid", F.lit(True).alias("rest")), ["pivot", "vid"], "left").join(now, "vid", "left")
    inside = written(inside.select("pivot", "vid", "core", "block", "blocks", "rests", F.coalesce("rest", F.lit(False)).alias("rest"),
                                   F.when(F.col("rest").isNull(), F.col("pivot")).otherwise(F.coalesce("b", "comp")).alias("comp")), "rest-members")
    left = inside.where("rest").select("pivot", F.pmod(F.xxhash64("vid"), F.col("rests")).cast("int").alias("i"),
                                       F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "vid", "comp", "core")
    right = inside.select("pivot", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), F.col("block").alias("j"), "vid", "comp", "core")
    return first.union(_task_links(left.union(right), vertices, rows))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vid, pivot) of members that pairs which may be similar join in their node, across classes; rows come sorted by node."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            node = held.column("node").to_numpy()
            whole = int(np.searchsorted(node == node[-1], True)) if node[0] != node[-1] else 0
            if whole:
                yield from _in_nodes(held.slice(0, whole))
                held = held.slice(whole)
    if held is not None:
        yield from _in_nodes(held)


def _in_nodes(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The same for whole nodes of at most LEAF members each."""
    node, vid, comp, n = (table.column(c).to_numpy() for c in ("node", "vid", "comp", "n"))
    sketch, classes, met = _bytes(table.column("sketch")), _Classes(table.num_rows), set()
    for step in range(1, LEAF):
        i = np.flatnonzero(node[step:] == node[:-step])
        if not len(i):
            break
        i = i[comp[i] != comp[i + step]]
        for x in i[_close(sketch[i], sketch[i + step], n[i], n[i + step])].tolist():
            classes.join(x, x + step)
            met.update((x, x + step))
    if met:
        rows, pivots = sorted(met), {}
        for x in rows:
            r = classes.root(x)
            pivots[r] = min(pivots.get(r, vid[x]), vid[x])
        yield pa.RecordBatch.from_arrays(
            [pa.array(vid[rows]), pa.array(np.array([pivots[classes.root(x)] for x in rows], dtype=np.int64))], names=["vid", "pivot"])


def _unfinished(rows: DataFrame) -> DataFrame:
    """Rows (node, vid, comp, members) of nodes whose members are in two classes or more."""
    stats = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("members"), F.min("comp").alias("__c"), F.max("comp").alias("__d")).where("__c <> __d").select("node", "members")
    return rows.join(stats, "node")


def _branches(rows: DataFrame) -> DataFrame:
    """(node, vid, comp) of the children, by the coordinate that the node chooses."""
    chosen = rows.withColumn("at", F.pmod(F.xxhash64("node"), F.lit(COORDINATES)).cast("int"))
    return chosen.select(F.xxhash64("node", "at", F.expr("substring(sketch, at + 1, 1)")).alias("node"), "vid", "comp")


def _empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, tk (64-bit hash of the text), n_shingles, component_id, kept, class (NULL for an empty set)."""
    rows = _rows(docs, id_col, text_col)
    signed = written(signatures(docs, id_col, text_col), "signatures")
    vertices = written(signed.where("digest is not null").groupBy("digest").agg(
        F.min(F.struct("id", "tk")).alias("rep"), F.min("id").alias("least"), F.first("n").alias("n"),
        F.first("sketch").alias("sketch"), F.first("roots").alias("roots")).withColumn("vid", F.monotonically_increasing_id()), "vertices")
    sketches = vertices.select("vid", "sketch", "n")

    roots = vertices.select("vid", F.posexplode("roots")).select(F.xxhash64("pos", "col").alias("node"), "vid")
    pivots = roots.groupBy("node").agg(F.min("vid").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    level = written(roots.join(pivots, "node"), "tree-roots")
    heads = level.where("vid = pivot").groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEADED).select("pivot")
    heads = written(heads.join(sketches.select(F.col("vid").alias("pivot"), F.col("sketch").alias("sketch_b")), "pivot"), "heads")
    met = level.where("vid <> pivot").join(small(heads.select("pivot")), "pivot", "left_semi").select("vid", "pivot").distinct()
    members = written(clusters(written(estimated(met, sketches, heads), "estimates")), "clusters")
    links = written(cluster_links(members, vertices, rows), "cluster-links")
    known = links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "vid")
    cores = members.where("core").select("vid", F.lit(True).alias("done")).distinct()
    level = level.select("node", "vid").join(known, "vid", "left").join(cores, "vid", "left").select(
        "node", "vid", F.coalesce("root", "vid").alias("comp"), F.coalesce("done", F.lit(False)).alias("done"))
    found = []
    for depth in range(DEPTH + 1):
        live = written(_unfinished(level).join(sketches, "vid"), "tree-nodes")
        large = live.where(F.col("members") > LEAF)
        if depth == 0:
            large = large.where(~F.col("done"))
        leaf = live.where(F.col("members") <= LEAF).select("node", "vid", "comp", "n", "sketch")
        found.append(leaf.repartition("node").sortWithinPartitions("node").mapInArrow(_compared, "vid bigint, pivot bigint"))
        if depth == DEPTH:
            found.append(large.join(large.groupBy("node").agg(F.min("vid").alias("pivot")), "node").select("vid", "pivot"))
        elif _empty(large):
            break
        level = _branches(large)
    pairs = written(reduce(DataFrame.union, found).distinct(), "candidates")
    again = pairs.union(pairs.select("pivot", "pivot")).distinct().join(known, "vid", "left").select(
        "pivot", "vid", F.lit(True).alias("core"), F.coalesce("root", "vid").alias("comp"))
    links = links.union(written(cluster_links(again, vertices, rows), "links"))
    classes = written(components(links), "classes")

    of = written(vertices.select("vid", "digest", "least").join(classes.withColumnRenamed("node", "vid"), "vid", "left").select(
        "digest", "least", F.coalesce("root", "vid").alias("root")), "vertex-classes")
    first = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(first, "root").select("digest", "component_id", F.col("root").alias("class"))
    out = signed.select("id", "tk", F.col("n").alias("n_shingles"), "digest").join(of, "digest", "left").withColumn(
        "component_id", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "tk", "n_shingles", "component_id", "class",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per class, that of its least id, and all rows with an empty set; the columns of ``docs``.

    Of rows that repeat the chosen id and text any one stays.
    """
    known, mark, many = fresh(docs, "__known", "__mark", "__many")
    found = written(near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("id"), "tk", "class"), "near-duplicates")
    best = found.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tk")).alias("b"))
    rows = found.groupBy("class", "id", "tk").agg(F.count(F.lit(1)).alias("n")).join(best, "class", "left").where(
        "class is null or (id <=> b.id and tk = b.tk)")
    kept = written(rows.select(F.col("id").alias(known), F.col("tk").alias(mark), F.expr("class is not null and n > 1").alias(many)), "kept")
    same: Column = docs[id_col].eqNullSafe(kept[known]) & (F.xxhash64(docs[text_col]) == kept[mark])
    chosen = docs.join(small(kept), same)
    if not _empty(kept.where(F.col(many))):
        chosen = chosen.where(~F.col(many)).unionByName(chosen.where(F.col(many)).dropDuplicates([known, mark]))
    return chosen.drop(known, mark, many)
