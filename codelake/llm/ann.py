"""Nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of sign flips and a fast Hadamard transform) sends a unit vector somewhere on the sphere;
its hash is the nearest signed axis. Each of ``tables`` rotations deals every vector to one of 2 d' axes (d' = the
dimension filled up to a power of two); a query looks up its ``probes`` nearest signed axes in every table. What it meets is
ranked by the exact inner product in double precision.

Nothing is capped: a bucket with many vectors is split into blocks of about BLOCK by a hash of the id, and every block of
the bucket is searched. Queries that meet fewer than ``k`` vectors look up all axes of one table, which is an exact search.
What the driver gets is a histogram of tables * 2 d' buckets.

Defined cases: vectors that are null, empty, zero, or hold nulls or non-finite numbers take no part, nor do null ids.
Vectors are compared with those of their own length. Rows that repeat an id are one candidate, with the larger score.
Ties go to the smaller id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, mix

BLOCK, QUERY_BLOCK = 4096, 1024


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows of ``x`` (a power of two wide) under the pseudo-rotation ``seed``."""
    n, d = x.shape
    rng = np.random.default_rng([97, seed, d])
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            x = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
            h *= 2
        x = x / np.sqrt(d)
    return x


def filled(x: np.ndarray) -> np.ndarray:
    """Unit rows, with zeros up to a power of two columns."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def axes(x: np.ndarray, seed: int, probes: int) -> np.ndarray:
    """For each row the numbers of its ``probes`` nearest signed axes (2 i: plus, 2 i + 1: minus), nearest first."""
    y = rotate(x, seed)
    if probes == 1:
        at = np.abs(y).argmax(1)
        return (2 * at + (y[np.arange(len(y)), at] < 0))[:, None]
    signed = np.stack([y, -y], 2).reshape(len(y), -1)
    probes = min(probes, signed.shape[1])
    near = np.argpartition(-signed, probes - 1, 1)[:, :probes]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(signed, near, 1), 1, kind="stable"), 1)


def usable(vector: str) -> Column:
    v = F.col(vector)
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, ok), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a batch for each length of vectors."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    if not len(ids):
        return
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    flat = lists.values.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield ids[rows], flat[ends[rows][:, None] + np.arange(d)].astype(np.float64)


def keyed(x: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """Bucket keys, a column for each table and probe: (dimension, table, axis)."""
    unit, d = filled(x), x.shape[1]
    return np.concatenate([(np.int64(d) << 40) + (np.int64(t) << 24) + axes(unit, t, probes) for t in range(tables)], 1)


def histogram(rows: DataFrame, tables: int, probes: int) -> dict[int, int]:
    """Rows of each bucket; at most tables * 2 d' entries for each length of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in matrices(batch):
                keys, counts = np.unique(keyed(x, tables, probes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    return {r.key: r.n for r in rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}


def blocks(rows: DataFrame, tables: int, probes: int, size: int, name: str) -> DataFrame:
    """key, {name}_ids, {name}_vecs: the vectors of a bucket in blocks of about ``size``, packed."""
    parts = {k: -(-n // size) for k, n in histogram(rows, tables, probes).items() if n > size}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in matrices(batch):
                keys = keyed(x, tables, probes)
                at = np.repeat(np.arange(len(ids)), keys.shape[1])
                keys = keys.ravel()
                salts = np.zeros(len(keys), np.int64)
                for k, n in parts.items():
                    m = np.flatnonzero(keys == k)
                    salts[m] = mix(ids[at[m]].view(np.uint64)) % np.uint64(n)
                order = np.lexsort((salts, keys))
                keys, salts, at = keys[order], salts[order], at[order]
                starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1])])
                for lo in range(0, len(starts), 512):
                    some = starts[lo : lo + 512]
                    ends = np.r_[starts[lo + 1 : lo + 513], len(keys)][: len(some)]
                    columns = [pa.array(keys[some]), pa.array(salts[some]), pa.array([ids[at[a:b]].tobytes() for a, b in zip(some, ends)], pa.binary()), pa.array([x[at[a:b]].tobytes() for a, b in zip(some, ends)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "salt", "ids", "vecs"])

    packed = rows.mapInArrow(run, "key long, salt long, ids binary, vecs binary").groupBy("key", "salt")
    return packed.agg(F.collect_list("ids").alias(f"{name}_ids"), F.collect_list("vecs").alias(f"{name}_vecs")).drop("salt")


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best of ``x`` by inner product, ties to the smaller id, without its own id."""
    scores = q @ x.T
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0][: len(ids)])
    tops = scores if len(starts) == len(ids) else np.maximum.reduceat(scores[:, order], starts, 1)  # one for each id
    n = tops.shape[1]
    least = np.partition(tops, n - k, 1)[:, n - k] if n > k else np.full(len(q), -np.inf)
    for i, row in enumerate(scores):
        slack = 1e-9 * max(1.0, abs(least[i])) if np.isfinite(least[i]) else 0.0
        at = np.flatnonzero((row >= least[i] - slack) & (row > -np.inf))
        if len(at):
            exact = (x[at] * q[i]).sum(1)  # in one order of adding, whatever the block
            order = np.lexsort((ids[at], -exact))
            kept, first = np.unique(ids[at][order], return_index=True)
            order = order[np.sort(first)][:k]
            yield q_ids[i], ids[at][order], exact[order]


def search(queries: DataFrame, rows: DataFrame, k: int, tables: int, probes: int) -> DataFrame:
    """query_id, found: its k best (score, vec_id) among what the probed buckets hold."""
    joined = blocks(queries, tables, probes, QUERY_BLOCK, "q").join(blocks(rows, tables, 1, BLOCK, "x"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                q_ids, q, ids, x = (np.frombuffer(b"".join(batch.column(c)[i].as_py()), np.float64 if c in (2, 4) else np.int64) for c in range(1, 5))
                found = list(best(q_ids, q.reshape(len(q_ids), -1), ids, x.reshape(len(ids), -1), k))
                ends = np.concatenate([[0], np.cumsum([len(f[1]) for f in found])]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([f[2] for f in found]) if found else np.empty(0)), pa.array(np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64))], ["score", "vec_id"])
                lists = pa.ListArray.from_arrays(pa.array(ends), pairs).cast(kind)
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([key] * len(found), pa.int64()), lists], ["query_id", "key", "found"])

    some = joined.select("key", "q_ids", "q_vecs", "x_ids", "x_vecs").mapInArrow(run, "query_id long, key long, found array<struct<score:double,vec_id:long>>")
    return topped(topped(some, ["query_id", "key"], k), ["query_id"], k)


def topped(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, found: the k best of a group's lists, by score, then the smaller id; an id in several lists counts once, with its best score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(len(by))
            ends, scores, ids = [0], [np.empty(0)], [np.empty(0, np.int64)]
            for i in range(batch.num_rows):
                hits = rows[i].values.flatten() if rows[i].is_valid else []
                score, vec = (h.to_numpy(zero_copy_only=False) for h in hits)
                order = np.lexsort((vec, -score))
                order = order[np.sort(np.unique(vec[order], return_index=True)[1])][:k]
                ends.append(ends[-1] + len(order))
                scores.append(score[order])
                ids.append(vec[order])
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.array(np.concatenate(ids))], ["score", "vec_id"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(by))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], [*by, "found"])

    keys = ", ".join(f"{c} long" for c in by)
    grouped = lists.groupBy(*by).agg(F.flatten(F.collect_list("found")).alias("found"))
    return grouped.mapInArrow(run, f"{keys}, found array<struct<score:double,vec_id:long>>")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 12, probes: int = 12, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that is a query."""
    own = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable("embedding"))
    asked = own.where(is_query)
    found = materialize(search(asked, own, k, tables, probes), "found")
    short = asked.join(found.where(F.size("found") >= k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if not short.isEmpty():
        found = found.where(F.size("found") >= k).union(search(materialize(short, "short"), own, k, 1, 1 << 30))
    return found.select("query_id", F.posexplode("found").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
