"""Exact top-k inner products: longest vectors first, SVD-rotated partial sums, Cauchy-Schwarz bounds on the rest.

The longest vectors, a bounded number of them, first give each query a bar, a score that its k-th best reaches for certain. By
Cauchy-Schwarz a candidate can reach it only if it is as long as the bar over the query's length. So queries are dealt in blocks by
the length they need, candidates in stripes by the length they have, and only blocks and stripes that can do with each other meet
in a cell, both of bounded size. In a cell, candidates come by falling length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

QUERIES, CANDIDATES, TILE, PARTIAL = 8192, 16384, 1024, 16
#: Numbers of the longest vectors at most, and of bands of lengths.
LONGEST, LONGEST_CELLS, BANDS = 4096, 1 << 21, 64


def whole_parts(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where a component is null, infinite or no number, or the vector is null."""
    x = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(x, lambda x: F.floor(x * scale).cast("long")))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros, which no inner product notices."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.array(lists.value_lengths().to_pylist(), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a and rows of b, exact: in doubles where no sum can leave their whole numbers, else in longs,
    else in Python's integers, held to the range of a long.
    """
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def cell_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int, least: np.ndarray | None = None, partial: int = PARTIAL, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the best k of a cell for each query; ties go to smaller ids.

    Candidates come by falling length. A query is done when its length times the next candidate's cannot reach its k-th score;
    before that, a candidate is scored in full only where the product of the first rotated components, and of the lengths of
    what is left, can reach it. least: scores that are known to be reached, below which nothing is wanted.
    """
    n = len(queries)
    least = np.full(n, -np.inf) if least is None else least
    turned, turned_q = vectors @ rotation, queries @ rotation
    length, length_q = np.linalg.norm(turned, axis=1), np.linalg.norm(turned_q, axis=1)
    rest, rest_q = np.linalg.norm(turned[:, partial:], axis=1), np.linalg.norm(turned_q[:, partial:], axis=1)
    order = np.argsort(-length, kind="stable")
    top_id, top = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.iinfo(np.int64).min)
    filled = np.zeros(n, np.int64)
    for at in range(0, len(order), tile):
        part = order[at : at + tile]
        bar = np.maximum(least, np.where(filled >= k, top[:, -1].astype(float), -np.inf))
        slack = 1e-9 * length_q * length[part[0]] + 1e-6
        live = np.flatnonzero(length_q * length[part[0]] + slack >= bar)
        if not len(live):
            break
        bound = turned_q[live, :partial] @ turned[part, :partial].T + rest_q[live, None] * rest[None, part]
        rows, cols = np.nonzero(bound + slack[live, None] >= bar[live, None])
        if 64 * len(rows) > bound.size:  # a whole product is cheaper than so many single ones
            scores = products(queries[live], vectors[part])[rows, cols]
        else:
            a, b = queries[live[rows]], vectors[part[cols]]
            large = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1] >= 2**63
            scores = np.clip((a.astype(object) * b.astype(object)).sum(1), -(2**63), 2**63 - 1).astype(np.int64) if large and len(a) else (a * b).sum(1)
        rows = live[rows]
        ok = (ids[part[cols]] != query_ids[rows]) & (scores >= bar[rows] - slack[rows])
        rows, found, scores = rows[ok], ids[part[cols[ok]]], scores[ok]
        seen = np.flatnonzero(filled > 0)
        rows = np.concatenate([rows, np.repeat(seen, filled[seen])])
        kept = np.arange(k)[None, :] < filled[seen][:, None]
        found, scores = np.concatenate([found, top_id[seen][kept]]), np.concatenate([scores, top[seen][kept]])
        by = np.lexsort((found, ~scores, rows))  # ~ turns longs around without leaving their range
        rows, found, scores = rows[by], found[by], scores[by]
        first = np.searchsorted(rows, np.arange(n))
        place = np.arange(len(rows)) - first[rows]
        best = place < k
        top_id[rows[best], place[best]], top[rows[best], place[best]] = found[best], scores[best]
        filled = np.bincount(rows[best], minlength=n)
    rows, place = np.nonzero(np.arange(k)[None, :] < filled[:, None])
    return rows, top_id[rows, place], top[rows, place]


def rotation_of(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, from the sums of their outer products: width squared numbers reach the driver."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column(0)]), width).astype(float)
            total += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "x"])

    got = vectors.select("v").mapInArrow(gram, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros((width, width))
    total[got["i"], got["j"]] = got["x"]
    if not np.isfinite(total).all():
        return np.eye(width)
    values, turned = np.linalg.eigh(total)
    return turned[:, np.argsort(-values)]


def top_products(vectors: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k highest inner products of the rounded vectors for each row that queries holds for.

    A query's own id is no candidate for it. Rows without an id and vectors that are null or hold null or non-finite components
    take no part; repeated candidate rows each count, repeated query rows answer once.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), whole_parts(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    rows = written(rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))), "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("width")).first()
    width = max(1, facts["width"] or 1)
    rotation = rotation_of(rows, width)

    longest = rows.orderBy(F.desc("length"), "id").limit(max(k + 1, min(LONGEST, LONGEST_CELLS // width))).select("id", "v").toArrow()
    long_ids, long_vectors = longest.column("id").to_numpy(), matrix(longest.column("v"), width)

    def bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's k-th best score among the longest vectors, as a double from below; null if there are fewer."""
        for batch in batches:
            ids, own = batch.column("id").to_numpy(zero_copy_only=False), matrix(pa.chunked_array([batch.column("v")]), width)
            found = []
            for at in range(0, len(ids), 512):
                scores = products(own[at : at + 512], long_vectors).astype(float)
                scores[ids[at : at + 512, None] == long_ids[None, :]] = -np.inf
                kept = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), -np.inf)
                found.append(np.where(np.isfinite(kept), kept - np.abs(kept) * 1e-12, np.nan))
            bar = pa.array(np.concatenate(found or [np.zeros(0)]), from_pandas=True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("length"), bar], ["id", "v", "length", "bar"])

    asked = rows.where("asks").select("id", "v", "length").distinct().mapInArrow(bars, "id long, v array<long>, length double, bar double")
    need = F.when((F.col("bar") > 0) & (F.col("length") > 0), F.col("bar") / F.col("length") * (1 - 1e-9)).otherwise(F.lit(0.0))
    asked = written(asked.withColumns({"need": need, "number": F.xxhash64("v")}), "asked")
    # As many bands as blocks and stripes are needed for, and of stripes as many as there are tasks at a time, if that is more.
    spread = min(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-facts["n"] // 256))
    needs = banded(asked, "need", min(BANDS, -(-facts["q"] // QUERIES)))
    lengths = banded(rows, "length", min(BANDS, max(-(-facts["n"] // CANDIDATES), spread)))
    blocks = parts_by_band(asked, "need", needs, QUERIES)
    stripes = parts_by_band(rows, "length", lengths, CANDIDATES)
    uppers = [*lengths[1:], float("inf")]
    # What block and stripe meet is settled by their bands alone, so that both sides deal themselves out alike.
    meets = [[s for s in range(len(lengths)) if uppers[s] >= needs[b]] for b in range(len(needs))]
    met_by = [[b for b in range(len(needs)) if s in meets[b]] for s in range(len(lengths))]
    lists = lambda of: F.array(*[F.array(*map(F.lit, some)).cast("array<int>") for some in of])
    all_parts = lambda band, parts: F.explode(F.sequence(F.lit(0), F.element_at(F.array(*map(F.lit, parts)), F.col(band) + 1) - 1))
    asked = asked.withColumn("b", band_of("need", needs)).withColumn("bp", part_of("b", blocks, "id", "v"))
    asked = asked.withColumn("s", F.explode(F.element_at(lists(meets), F.col("b") + 1))).withColumn("sp", all_parts("s", stripes))
    there = rows.select("id", "v", band_of("length", lengths).alias("s")).withColumn("sp", part_of("s", stripes, "id", "v"))
    there = there.withColumn("b", F.explode(F.element_at(lists(met_by), F.col("s") + 1))).withColumn("bp", all_parts("b", blocks))
    answer = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return answer.empty_table()
        of = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        query_ids, ids, number, least = of(left, "id"), of(right, "id"), of(left, "number"), np.nan_to_num(of(left, "bar"), nan=-np.inf)
        asking, there, out = matrix(left.column("v"), width), matrix(right.column("v"), width), []
        for own in np.array_split(np.arange(len(asking)), max(1, round(len(asking) / TILE))):
            q, found, score = cell_top(query_ids[own], asking[own], ids, there, rotation, k, least[own])
            out.append(pa.table([query_ids[own][q], number[own][q], found, score], schema=answer))
        return pa.concat_tables(out)

    cells = ["b", "bp", "s", "sp"]
    best = asked.groupBy(*cells).cogroup(there.groupBy(*cells)).applyInArrow(search, "query_id long, query long, id long, score long")
    ranked = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")


def banded(rows: DataFrame, value: str, bands: int) -> list[float]:
    """Lower ends of at most so many bands of a value that hold about as many rows each; the first is 0."""
    if bands < 2:
        return [0.0]
    got = rows.agg(F.percentile_approx(value, F.array(*[F.lit(x / bands) for x in range(1, bands)]), 1000)).first()[0]
    return [0.0, *sorted({x for x in got or [] if x > 0})]


def band_of(value: str, lower: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, lower)), lambda x: x <= F.col(value))) - 1


def parts_by_band(rows: DataFrame, value: str, lower: list[float], most: int) -> list[int]:
    """How many parts of at most about so many rows each band is dealt over."""
    counts = {r["b"]: r["n"] for r in rows.groupBy(band_of(value, lower).alias("b")).agg(F.count("*").alias("n")).collect()}
    return [max(1, -(-counts.get(b, 0) // most)) for b in range(len(lower))]


def part_of(band: str, parts: list[int], *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.element_at(F.array(*map(F.lit, parts)), F.col(band) + 1)).cast("int")
