"""Operator 8: near copies among embeddings by sorted projection passes.

Equal vectors are one node, so copies take no places of others. In each pass every distinct vector gets a key of 64 bits, the signs of its products with random
directions of that pass, and vectors are ordered by it, which is lexicographically by the
concatenated hashes. Each is compared with the NEIGHBOURS that follow it; pairs whose cosine is at
least `least` are verified. Groups are the connected components of the pairs of all passes together.

All passes are one range-partitioned sort. Windows go over the ends of partitions: each partition
also hands on its first and last NEIGHBOURS rows, with its number of rows. Those get their place in the
whole order (from one number a partition) and are compared in parallel, each block of NEIGHBOURS places
with itself and the block before. Recall is approximate: a pass
finds a pair that shares about log2(vectors / NEIGHBOURS) first bits, so the number of passes grows
with that of distinct vectors (`passes_for`) to find RECALL of the pairs at the threshold itself; a
group is found whole if its pairs connect it. Tests hold it against brute force and at 400,000 vectors.

Null, empty and zero vectors and those with a null or non-finite element are in no group. Vectors
are compared only with those of the same length. A null vec_id is a row like any other and goes
after the others of its group; repeated rows are copies; equal keys are ordered by the hash of the
vector; a long vector is a row like any other; an empty table gives an empty result. Other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import checkpointed, connected_components

LEAST = 0.95
PASSES, NEIGHBOURS, SEED = 8, 24, 5  # PASSES at least
RECALL = 0.95


def passes_for(distinct: int, least: float = LEAST, width: int = NEIGHBOURS) -> int:
    """Passes that find RECALL of the pairs of cosine `least` among so many vectors.

    One bit of two such vectors is equal with probability 1 - angle / pi; a window spans the vectors
    that share about log2(distinct / width) bits.
    """
    equal = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    found = equal ** max(0.0, math.log2(max(distinct, 1) / width))
    if found >= RECALL:
        return PASSES
    return min(1000, max(PASSES, math.ceil(math.log(1 - RECALL) / math.log1p(-found)))) if found > 0 else PASSES


def directions(dim: int, nth: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, nth, dim]).standard_normal((dim, 64)).astype(np.float32)


def sort_keys(vectors: np.ndarray, nth: int, seed: int) -> np.ndarray:
    """Keys whose order as signed numbers is the lexicographic order of the hashes."""
    bits = np.packbits(vectors @ directions(vectors.shape[1], nth, seed) > 0, axis=1)
    return (bits.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _keyed(passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            lengths = np.diff(np.asarray(column.offsets))
            values = np.asarray(column.values, np.float32)
            starts = np.asarray(column.offsets)[:-1]
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                v = values[starts[rows][:, None] + np.arange(dim)].astype(np.float64)
                norm = np.sqrt((v * v).sum(1))
                fine = np.isfinite(norm) & (norm > 0)
                rows = rows[fine]
                v = (v[fine] / norm[fine][:, None]).astype(np.float32)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * int(dim)), len(v), [None, pa.py_buffer(np.ascontiguousarray(v))]).cast(pa.binary())
                node = batch.column("node").take(pa.array(rows))
                for nth in range(passes if len(rows) else 0):
                    part = pa.array(np.full(len(rows), int(dim) * 1024 + nth, np.int64))
                    yield pa.RecordBatch.from_arrays([part, pa.array(sort_keys(v, nth, seed)), node, packed], names=["part", "key", "node", "vector"])

    return run


_EDGE = "kind int, u long, v long, pid int, at long, n long, part long, node long, vector binary"


def _rows(kind: int, **of: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(of.values())))
    types = {"kind": pa.int32(), "pid": pa.int32(), "vector": pa.binary()}
    names = [x.split()[0] for x in _EDGE.split(", ")]
    of["kind"] = np.full(n, kind)
    return pa.RecordBatch.from_arrays([pa.array(of[c], types.get(c, pa.int64())) if c in of else pa.nulls(n, types.get(c, pa.int64())) for c in names], names=names)


def _pairs(part: np.ndarray, node: np.ndarray, vectors: list[bytes], place: np.ndarray, width: int, least: float, fresh: int = 0, pid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of rows at most `width` places apart in the same part, the second from `fresh` on; with pid, of two partitions."""
    us, vs = [], []
    sizes = part // 1024
    for dim in np.unique(sizes):
        of = np.flatnonzero(sizes == dim)
        m = np.frombuffer(b"".join(vectors[i] for i in of), np.float32).reshape(len(of), dim)
        for lag in range(1, min(width, len(of) - 1) + 1):
            i, j = of[:-lag], of[lag:]
            ok = (part[i] == part[j]) & (place[j] - place[i] <= width) & (j >= fresh)
            if pid is not None:
                ok &= pid[i] != pid[j]
            k = np.flatnonzero(ok)
            near = k[np.einsum("ij,ij->i", m[k], m[k + lag]) >= least] if len(k) else k
            us.append(node[i[near]])
            vs.append(node[j[near]])
    return (np.concatenate(us), np.concatenate(vs)) if us else (node[:0], node[:0])


def _windows(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        seen, head, tail = 0, [], []  # rows (place, part, node, vector)
        for batch in batches:
            part, node, vectors = batch.column("part").to_numpy(), batch.column("node").to_numpy(), batch.column("vector").to_pylist()
            n = len(part)
            if not n:
                continue
            head += [(i, part[i], node[i], vectors[i]) for i in range(min(n, width - len(head)))] if seen < width else []
            old = len(tail)
            p = np.concatenate([np.array([t[1] for t in tail], np.int64), part])
            x = np.concatenate([np.array([t[2] for t in tail], np.int64), node])
            all_ = [t[3] for t in tail] + vectors
            for a in range(0, n, 20_000):  # dense matrices of a bounded size
                lo, hi = max(0, old + a - width), min(old + n, old + a + 20_000)
                u, v = _pairs(p[lo:hi], x[lo:hi], all_[lo:hi], np.arange(lo, hi), width, least, old + a - lo)
                yield _rows(0, u=u, v=v)
            tail = [(seen + k - old, p[k], x[k], all_[k]) for k in range(max(0, old + n - width), old + n)]
            seen += n
        head = [(k, *h[1:]) for k, h in enumerate(head)]
        rows = head + [t for t in tail if t[0] >= len(head)]
        if rows:
            at, part, node, vector = zip(*rows)
            yield _rows(1, pid=np.full(len(rows), pid), at=np.array(at), n=np.full(len(rows), seen), part=np.array(part), node=np.array(node), vector=list(vector))

    return run


def _over_ends(width: int, least: float):
    """Pairs over the ends of partitions: of each block the rows that are its own with all that are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            block, place, own = (table.column(c).to_numpy() for c in ("block", "place", "own"))
            part, node, pid = (table.column(c).to_numpy() for c in ("part", "node", "pid"))
            vectors = table.column("vector").to_pylist()
            edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            for a, b in zip(edges[:-1], edges[1:]):
                # rows are in order of place, so those of the block before come first
                u, v = _pairs(part[a:b], node[a:b], vectors[a:b], place[a:b], width, least, int((own[a:b] == 0).sum()), pid[a:b])
                yield pa.RecordBatch.from_pydict({"u": u, "v": v})

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            block = table.column("block").to_numpy()
            whole = int(np.searchsorted(block, block[-1])) if len(block) else 0
            if whole:
                yield from pairs(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held and sum(map(len, held)):
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return run


def _nodes(table: DataFrame) -> DataFrame:
    vector = F.col("embedding").cast("array<float>")
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).withColumn("node", F.xxhash64("vector"))


def near_pairs(nodes: DataFrame, least: float = LEAST, passes: int | None = None, width: int = NEIGHBOURS, seed: int = SEED) -> DataFrame:
    """Verified pairs u, v of nodes (node, vector). passes: by the number of distinct vectors, if not given."""
    whole = nodes.filter("size(vector) > 0 and not exists(vector, x -> x is null)").select("node", "vector").dropDuplicates(["node"])
    if passes is None:
        passes = passes_for(nodes.agg(F.approx_count_distinct("node")).first()[0], least, width)
    keyed = whole.mapInArrow(_keyed(passes, seed), "part long, key long, node long, vector binary")
    ordered = keyed.repartitionByRange("part", "key", "node").sortWithinPartitions("part", "key", "node")
    found = checkpointed(ordered.mapInArrow(_windows(width, least), _EDGE))
    ends = found.filter("kind = 1")
    base = F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    bases = ends.groupBy("pid").agg(F.max("n").alias("n")).select("pid", F.coalesce(base, F.lit(0)).alias("base"))
    placed = ends.join(bases, "pid").withColumn("place", F.col("base") + F.col("at"))
    block = F.expr(f"place div {width}")
    both = placed.select("pid", "part", "node", "vector", "place", F.explode(F.array(F.struct(block.alias("block"), F.lit(1).alias("own")), F.struct((block + 1).alias("block"), F.lit(0).alias("own")))).alias("b"))
    blocks = both.select("pid", "part", "node", "vector", "place", "b.*").repartition("block").sortWithinPartitions("block", "place")
    return found.filter("kind = 0").select("u", "v").union(blocks.mapInArrow(_over_ends(width, least), "u long, v long"))


def embedding_groups(table: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, group_id (the least vec_id of the group), n_members and keep, for groups of two or more.

    keep: the row that stays, the first by (vec_id, hash of the row), nulls last.
    """
    nodes = _nodes(table)
    roots = connected_components(near_pairs(nodes, least))
    usable = nodes.filter("size(vector) > 0 and exists(vector, x -> x <> 0) and not exists(vector, x -> x is null or isnan(x) or abs(x) = float('inf'))")
    all_ = Window.partitionBy("root")
    first = all_.orderBy(F.asc_nulls_last("vec_id"), "row")
    return (
        usable.select("vec_id", "node", F.xxhash64("vec_id", "vector").alias("row"))
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .withColumns({"n_members": F.count(F.lit(1)).over(all_), "group_id": F.min("vec_id").over(all_), "n": F.row_number().over(first)})
        .filter("n_members > 1")
        .select("vec_id", "group_id", "n_members", (F.col("n") == 1).alias("keep"))
    )


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
