"""Approximate nearest neighbours by inner product, with cross-polytope hashing.

A table rotates vectors pseudo-randomly (three rounds of random signs and a fast Hadamard transform) and files each under the
signed axis that it is nearest to; ``axes`` rotations together name a bucket, their number growing with the logarithm of the
table. A query probes the buckets whose axes it is nearest to, in order; how many is fitted on a bounded sample, for the wanted recall.
Vectors and probing queries meet by bucket (a bucket beyond BLOCK vectors is split, and its queries go to every part), where all inner
products are computed exactly, in double precision, and the best of each part are merged.

The largest inner product becomes the largest cosine by one more coordinate, sqrt(greatest norm^2 - norm^2), 0 for
queries; it is left out where all norms are equal. Equal vectors are one vector, searched once, until the result is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerscope.session import materialize, spread

TABLES, BLOCK, SAMPLE, SAMPLE_QUERIES, MOST_PROBES, QUERIES_AT_ONCE = 8, 20_000, 4096, 256, 1024, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, width, step = *x.shape, 1
    while step < width:
        pairs = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


class CrossPolytope:
    def __init__(self, dims: int, top: float, lift: bool, axes: int, tables: int = TABLES):
        self.dims, self.top, self.lift, self.axes, self.tables = dims, top, lift, axes, tables
        self.width = 1 << max(0, (dims + lift - 1).bit_length())
        signs = np.random.default_rng(11).choice([-1.0, 1.0], size=(tables, axes, 3, self.width))
        self.signs = signs

    def widened(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        out[:, : x.shape[1]] = x / self.top
        if self.lift and not query:
            out[:, self.dims] = np.sqrt(np.maximum(0, 1 - (out[:, : self.dims] ** 2).sum(1)))
        return out

    def rotated(self, wide: np.ndarray, table: int, axis: int) -> np.ndarray:
        """Nearness to each signed axis: first the positive ones, then the negative ones."""
        for signs in self.signs[table, axis]:
            wide = hadamard(wide * signs)
        return np.concatenate([wide, -wide], axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        wide = self.widened(x, False)
        out = np.zeros((len(x), self.tables), dtype=np.int64)
        for t in range(self.tables):
            for a in range(self.axes):
                out[:, t] = out[:, t] * (2 * self.width) + self.rotated(wide, t, a).argmax(1)
        return out

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """For each query, the ``count`` buckets (at most all) with the largest sums of nearness, best first."""
        wide, best, sums = self.widened(x, True), None, None
        for a in range(self.axes):
            near = self.rotated(wide, table, a)
            order = np.argsort(-near, axis=1, kind="stable")[:, :count]
            value = np.take_along_axis(near, order, 1)
            if best is None:
                best, sums = order.astype(np.int64), value
                continue
            all_sums = (sums[:, :, None] + value[:, None, :]).reshape(len(x), -1)
            all_codes = (best[:, :, None] * (2 * self.width) + order[:, None, :]).reshape(len(x), -1)
            keep = np.argsort(-all_sums, axis=1, kind="stable")[:, :count]
            best, sums = np.take_along_axis(all_codes, keep, 1), np.take_along_axis(all_sums, keep, 1)
        return best


def fitted_probes(index: CrossPolytope, sample: np.ndarray, total: int, k: int, recall: float) -> tuple[int, float]:
    """The fewest probes a table with which a sample finds ``recall`` of its neighbours, or the most, and the share found with them.

    Of ``total`` vectors' k nearest, a sample of s holds k s / total on average: so many of each sampled query's nearest are looked for.
    A neighbour that no probe reaches is a miss. With one axis all buckets may be probed, and nothing is missed.
    """
    queries = sample[:SAMPLE_QUERIES]
    wanted = max(1, min(len(sample) - 1, round(k * len(sample) / max(1, total))))
    if len(sample) < 2:
        return 1, 1.0
    near = queries @ sample.T
    near[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    best = np.argsort(-near, axis=1)[:, :wanted]
    codes = index.codes(sample)
    most = 2 * index.width if index.axes == 1 else min(MOST_PROBES, (2 * index.width) ** index.axes)
    first = np.full(best.shape, most + 1)  # beyond the last probe: a miss
    for t in range(index.tables):
        for at in range(0, len(queries), 32):
            probes = index.probes(queries[at : at + 32], t, most)
            hit = probes[:, None, :] == codes[best[at : at + 32], t][:, :, None]
            first[at : at + 32] = np.minimum(first[at : at + 32], np.where(hit.any(2), hit.argmax(2) + 1, most + 1))
    probes = min(most, int(np.sort(first.reshape(-1))[min(first.size - 1, math.ceil(recall * first.size) - 1)]))
    return probes, float((first <= probes).mean())


def _vectors(values: list) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<f8").reshape(len(values), -1)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.97, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per query and neighbour: query_id, rank (from 1), vec_id, score, fitted_recall (the share found of a sample's neighbours).

    Queries are the rows whose id is divisible by ``every``; candidates are all other ids. Nearest first by inner product, ties to the smaller id.
    Rows without an id, and vectors that are null, empty, zero or hold null or non-finite numbers, take no part; shorter vectors are filled up with
    zeros. Rows that repeat an id and a vector are one. An empty table, or a query without candidates, gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(embedding)
    usable = F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(usable).select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id long, rank int, vec_id long, score double, fitted_recall double"
    if dims is None:
        return spark.createDataFrame([], schema)

    def equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's distinct vectors, each with its k + 1 smallest ids: no result shows more of a class."""
        found: dict[bytes, list[int]] = {}
        salt = TaskContext.get().partitionId() % 16

        def out() -> pa.RecordBatch:
            ids = [sorted(set(x))[: k + 1] for x in found.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array([salt] * len(ids), pa.int32())], ["v", "ids", "salt"])

        for batch in batches:
            for key, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.asarray(values.values, dtype="<f8") + 0.0  # no negative zeros
                ids = found.setdefault(np.pad(values, (0, dims - len(values))).tobytes(), [])
                ids.append(key)
                if len(ids) > 1000:
                    ids[:] = sorted(set(ids))[: k + 1]
            if len(found) > 100_000:
                yield out()
                found.clear()
        if found:
            yield out()

    def smallest(lists) -> F.Column:
        return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists)))), 1, k + 1)

    classes = rows.mapInArrow(equal, "v binary, ids array<long>, salt int").groupBy("v", "salt").agg(smallest("ids").alias("ids")).groupBy("v").agg(smallest("ids").alias("ids"))
    classes = materialize(classes.select(F.element_at("ids", 1).alias("c"), F.xxhash64("v").alias("h"), "ids", "v").select(F.struct("c", "h").alias("c"), "ids", "v"))
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("c.h"), "c").limit(SAMPLE).select("v").toArrow()
    sample = _vectors(sample.column(0).to_pylist())

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.sqrt((_vectors(batch.column(0).to_pylist()) ** 2).sum(1)) if batch.num_rows else np.empty(0)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([x.min()]), pa.array([x.max()])], ["low", "high"])

    low, high = classes.select("v").mapInArrow(norms, "low double, high double").agg(F.min("low"), F.max("high")).first()
    lift = low < high * (1 - 1e-6)
    width = 1 << max(0, (dims + lift - 1).bit_length())
    axes = 1  # so many that a bucket holds 2 x BLOCK vectors on average at most
    while total > 2 * BLOCK * (2 * width) ** axes:
        axes += 1
    while True:  # fewer axes make larger buckets, until the probes reach the recall; one axis always does
        index = CrossPolytope(dims, high, lift, axes)
        probes, reached = fitted_probes(index, sample, total, k, recall)
        if reached >= recall or axes == 1:
            break
        axes -= 1
    shared = spark.sparkContext.broadcast(index)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                codes = index.codes(_vectors(part.column(1).to_pylist()))
                where = pa.array(np.repeat(np.arange(len(codes)), index.tables))
                tables = pa.array(np.tile(np.arange(index.tables, dtype=np.int32), len(codes)))
                yield pa.RecordBatch.from_arrays([tables, pa.array(codes.reshape(-1)), part.column(0).take(where), part.column(1).take(where)], ["t", "code", "c", "v"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                x = _vectors(part.column(1).to_pylist())
                for t in range(index.tables):
                    codes = index.probes(x, t, probes)
                    where = pa.array(np.repeat(np.arange(len(codes)), codes.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(codes.size, t, dtype=np.int32)), pa.array(codes.reshape(-1)), part.column(0).take(where), part.column(1).take(where)], ["t", "code", "c", "v"])

    kind = "t int, code long, c struct<c:long,h:long>, v binary"
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v")
    asked = materialize(asked.mapInArrow(_as_binary(dims), "vec_id long, v binary").distinct().join(classes.select("v", "c"), "v").select("vec_id", "c"))
    wanted = classes.join(asked.select("c").distinct(), "c", "left_semi").select("c", "v")
    entries = classes.select("c", "v").mapInArrow(filed, kind)
    parts = entries.groupBy("t", "code").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("t", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    parts = materialize(parts)
    entries = entries.join(parts, ["t", "code"], "left").select("t", "code", F.pmod(F.xxhash64("c"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(0).alias("asks"), "c", "v")
    asking = wanted.mapInArrow(probing, kind).join(parts, ["t", "code"], "left")
    asking = asking.select("t", "code", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(1).alias("asks"), "c", "v")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, names, values, queries, asked_by = None, [], [], [], []
        matrix = None

        def answers() -> pa.RecordBatch:
            nonlocal matrix
            if matrix is None:
                matrix = _vectors(values)
            asked = _vectors(queries)
            scores = asked @ matrix.T
            most = min(k + 1, scores.shape[1])
            best = np.argpartition(-scores, most - 1, axis=1)[:, :most]
            # a matrix product's last bits depend on its shape: candidates within them are kept, and each score is summed anew in one fixed order
            slack = 1e-12 * np.sqrt((asked**2).sum(1)) * high
            edge = np.take_along_axis(scores, best, 1).min(1) - slack
            rows_at, columns = np.nonzero(scores >= edge[:, None])
            found = (asked[rows_at] * matrix[columns]).sum(axis=1)
            of_query, of_vector = pa.array(asked_by, type=PLACE), pa.array(names, type=PLACE)
            return pa.RecordBatch.from_arrays([of_query.take(pa.array(rows_at)), of_vector.take(pa.array(columns)), pa.array(found)], ["q", "c", "score"])

        for batch in batches:
            fields = [batch.column(i).to_pylist() for i in range(6)]
            for t, code, part, asks, c, value in zip(*fields, strict=True):
                if (t, code, part) != bucket:
                    if queries and values:
                        yield answers()
                    bucket, names, values, queries, asked_by, matrix = (t, code, part), [], [], [], [], None
                if asks:
                    queries.append(value)
                    asked_by.append(c)
                    if len(queries) >= QUERIES_AT_ONCE:
                        if values:
                            yield answers()
                        queries, asked_by = [], []
                else:
                    names.append(c)
                    values.append(value)
        if queries and values:
            yield answers()

    dealt = spread(entries.unionByName(asking), "t", "code", "part").sortWithinPartitions("t", "code", "part", "asks")
    pair = "q struct<c:long,h:long>, c struct<c:long,h:long>, score double"
    found = dealt.mapInArrow(meet, pair).groupBy("q", "c").agg(F.max("score").alias("score"))
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("at") <= k + 1)
    listed = best.join(classes.select("c", "ids"), "c").select("q", F.explode("ids").alias("id"), "score")
    listed = listed.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))), 1, k + 1).alias("near"))
    answer = asked.join(listed, asked["c"] == listed["q"]).select("vec_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k).alias("near"))
    answer = answer.select(F.col("vec_id").alias("query_id"), F.posexplode("near").alias("at", "n"))
    return answer.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.far")).alias("score"), F.lit(reached).alias("fitted_recall"))


PLACE = pa.struct([("c", pa.int64()), ("h", pa.int64())])


def _as_binary(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.asarray(x.values, dtype="<f8") + 0.0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.pad(x, (0, dims - len(x))).tobytes() for x in values], pa.binary())], ["vec_id", "v"])

    return run
