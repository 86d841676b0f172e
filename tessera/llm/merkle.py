"""A Merkle manifest of a table: leaves for rows, a tree for each source, one root, and proofs.

A row's leaf is the hash of its fields. The leaves of a source ascend by
doc_id; runs of three become the hash of their digests until one is left, the
source's subroot; the subroots, in order of sources, become the root likewise.

The trees are climbed and descended in supersteps over RDDs. A vertex is a
unit of 3 ** LEVELS consecutive nodes of one level, whatever the level. Climbing, children message
their unit ((tree, place // 81), (place, digest)); a unit that has all its
children hashes LEVELS levels and forwards its digest to the unit above. As
all nodes of a tree climb together, a superstep has as many messages as the
level has nodes, and LEVELS levels cost one shuffle. Descending, a unit gets
the siblings on the path from its top to the root, once, and sends each child
its own; leaves fold their digest with them. A unit has 81 children at most (3 ** 4),
whatever a source holds: no task gets a group that grows with the data.

Places come from sorting the leaves by source and doc_id over range
partitions. A partition's rows are counted, and the counts, one number each,
shift the places inside it; a source's first place is joined to its rows by
(partition, source), so that a hot source is one small key in each of many
partitions. Tables of a superstep are checkpointed in the shared folder.

Defined results: each field that is null counts as ``-``; null sources are a
source of their own, before all others; rows with one doc_id stand in order of
their digests, null doc_ids first, and such rows are never tampered with;
repeated rows are leaves each; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, cleanup_after, shared_dir

#: Nodes of a run, and levels that a superstep climbs.
RUN, LEVELS = 3, 4
#: Messages of a task, at most about so many.
MESSAGES = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The hash of fields: ``-`` for null, else the count of bytes, ``:`` and the value."""
    named = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*named), 256)


def _levels(digests: list[str], levels: int | None) -> list[list[str]]:
    """A unit's digests, level by level up to its top: so many levels, or of a whole tree (None) until one is left."""
    out = [digests]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        out.append([digest(out[-1][i : i + RUN]) for i in range(0, len(out[-1]), RUN)])
    return out


def _tasks(n: int, least: int) -> int:
    return max(least, -(-n // MESSAGES))


class Tree:
    """Supersteps of one forest: trees of any sizes, climbed together.

    nodes: (tree, n, place, digest, extra) with n nodes in the tree; extra goes
    with a node down again. The units of each superstep are kept, checkpointed,
    for the way down.
    """

    def __init__(self, nodes: RDD, count: int, most: int, levels: int):
        self.least, self.levels, self.unit = nodes.context.defaultParallelism, levels, RUN**levels
        self.units: list[RDD] = []
        self.counts: list[int] = []
        unit, tops, more = self.unit, [], True
        while more:
            units = self._arrived(nodes, count)
            self.units.append(units)
            self.counts.append(count)
            tops.append(units.filter(lambda u: u[1][0] <= unit).map(lambda u: (u[0][0], _levels([d for _, d, _ in u[1][1]], None)[-1][0])))
            nodes = units.filter(lambda u: u[1][0] > unit).map(lambda u: (u[0][0], -(-u[1][0] // unit), u[0][1], _levels([d for _, d, _ in u[1][1]], levels)[-1][0], None))
            more = most > unit
            most, count = -(-most // unit), -(-count // unit) + self.least
        #: (tree, top digest)
        self.tops = nodes.context.union(tops)

    def _arrived(self, nodes: RDD, count: int) -> RDD:
        """((tree, place of the unit), (n, children in order)): the messages of a level by their receiver."""
        unit = self.unit
        grouped = nodes.map(lambda x: ((x[0], x[2] // unit), (x[1], x[2], x[3], x[4]))).groupByKey(_tasks(count, self.least))

        def arrive(messages) -> tuple[int, list]:
            got = sorted(messages, key=lambda m: m[1])
            return got[0][0], [m[1:] for m in got]

        units = grouped.mapValues(arrive).persist(StorageLevel.DISK_ONLY)
        units.checkpoint()
        units.count()
        units.unpersist()
        return units

    def descend(self, paths: RDD) -> RDD:
        """(extra, digest, path, carried) of each leaf; paths: (tree, (carried, path)) for the tops, which gets longer below.

        A path is a list of (digests to the left, digests to the right) in a node's run, from the node up.
        """
        down, unit, levels = None, self.unit, self.levels
        for k in range(len(self.units) - 1, -1, -1):
            units, lowest, tasks = self.units[k], k == 0, _tasks(self.counts[k] // unit, self.least)
            arriving = units.filter(lambda u: u[1][0] <= unit).map(lambda u: (u[0][0], u)).join(paths, tasks).map(lambda x: x[1])
            if down is not None:
                arriving = arriving.union(units.join(down, tasks).map(lambda x: ((x[0], x[1][0]), x[1][1])))
            down = arriving.flatMap(lambda x, lowest=lowest: _children(*x, lowest, levels))
        return down


def _children(unit: tuple, message: tuple, lowest: bool, levels: int) -> Iterator[tuple]:
    """A unit's messages to its children: each one's siblings on the way to the unit's top, then the unit's own path."""
    (tree, _), (n, children) = unit
    carried, path = message
    runs = []
    for level in _levels([d for _, d, _ in children], None if n <= RUN**levels else levels)[:-1]:
        runs.append([("".join(level[i - i % RUN : i]), "".join(level[i + 1 : i - i % RUN + RUN])) for i in range(len(level))])
    for i, (place, own, extra) in enumerate(children):
        own_path = [run[i // RUN**k] for k, run in enumerate(runs)] + path
        yield (extra, own, own_path, carried) if lowest else ((tree, place), (carried, own_path))


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a digest and the siblings on its path give."""
    for left, right in path:
        node = digest((left, node, right))
    return node


def _placed(rows: DataFrame, work: Workspace, name: str, order: list[Column]) -> DataFrame:
    """rows with _p, a partition, and _at, their place in the whole order; written."""
    inside = (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_i")
    partitions = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = work.write(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), inside), name)
    counts = held.groupBy("_p").agg(F.count("*").alias("n")).collect()  # one number for each partition
    before, total = [], 0
    for p, n in sorted(map(tuple, counts)):
        before.append((p, total))
        total += n
    shift = F.broadcast(held.sparkSession.createDataFrame(before, "_p int, _before long"))
    return held.join(shift, "_p").withColumn("_at", F.col("_before") + F.col("_i")).drop("_i", "_before")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    The proof is the hash of the siblings on the way to the root. For the rows
    where two divides the checksum of doc_id, folded_root starts from the leaf
    that the text without its line ends gives; verified says whether it is the root.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "merkle")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    given = [F.col(f) for f in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(*given).alias("leaf"), F.when(tampered, leaf(*given[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("other"))
    placed = _placed(leaves, work, "leaves", [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")])

    # the sources of each partition, a few rows each, and of all
    parts = work.write(placed.groupBy("_p", "source").agg(F.min("_at").alias("first"), F.count("*").alias("n")), "parts")
    sources = _placed(parts.groupBy("source").agg(F.min("first").alias("first"), F.sum("n").alias("n")), work, "sources", [F.col("first")])
    sizes = sources.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    if not sizes[0]:
        return spark.createDataFrame([], OUT)
    trees = sources.select(F.col("source").alias("_source"), F.col("first").alias("_first"), F.col("n").alias("_n"), F.col("_at").alias("_tree"))
    known = parts.select("_p", "source").join(trees, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("_p").alias("_part"), "_source", "_first", "_n", "_tree")
    nodes = placed.join(known, (F.col("_p") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    rows = nodes.select("_tree", "_n", F.col("_at") - F.col("_first"), "leaf", "doc_id", "other").rdd.map(lambda r: (r[0], r[1], r[2], r[3], (r[4], r[5])))

    with cleanup_after(spark):
        forest = Tree(rows, sizes[1], sizes[2], levels)
        tops = forest.tops.map(lambda t, n=sizes[0]: (0, n, t[0], t[1], t[0]))
        crown = Tree(tops, sizes[0], sizes[0], levels)
        # one message to the crown's one top, then one to each source's
        paths = crown.descend(crown.tops.map(lambda t: (t[0], (t[1], [])))).map(lambda x: (x[0], ((x[1], x[3]), x[2])))
        found = forest.descend(paths)

    def row(x: tuple) -> tuple:
        (doc_id, other), own, path, (subroot, root) = x
        folded = fold(own if other is None else other, path)
        return doc_id, own, subroot, root, digest(s for sides in path for s in sides), folded, folded == root

    return spark.createDataFrame(found.map(row), OUT, verifySchema=False)


def root(spark: SparkSession, made: DataFrame) -> str | None:
    """The root that a manifest's rows name; None of an empty table."""
    first = made.select("root").first()
    return first and first["root"]
