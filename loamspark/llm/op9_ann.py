"""Largest inner products by score-aware (anisotropic) product quantisation, four-bit table scans and exact reranking.

A vector x is cut into subspaces of ``width`` dimensions, each coded by one of 16 centroids. Coding and codebooks minimise
|r|^2 + (eta - 1) (r . x/|x|)^2 for the residual r, so errors along x, which change large inner products, cost eta times as much as errors
across it; eta = (d - 1) t^2 / (1 - t^2). Codes are chosen by coordinate descent over the subspaces, and each centroid by its normal
equations. The codebooks are fitted to a bounded sample (``max_sample`` vectors in order of a seeded hash); every row is coded.

A search deals index and query rows into blocks and meets each query block with each index block once: for a query, a table of 16 partial
products per subspace is looked up by the codes of the block, the ``rerank`` best rows are scored exactly in double precision, and the best
of the blocks are merged. Equal vectors of a block are one entry with its ids in order, so large groups of copies neither fill the candidates
nor lose the smallest ids.

Codes are of vectors divided by a power of two near the sample's median length, and queries are looked up at length one, so no value of theirs leaves the range
of single precision. A row more than ``LARGE`` times as long as the median takes no part in the fit, has no code that means anything, and is scored exactly
for every query: its products are among the largest or the smallest there are. So some huge vectors cost nobody's recall.

Defined results: vectors that are null, zero, of another width than most, or hold null or non-finite numbers take no part, and a query of
that kind returns nothing; products beyond double precision are infinite, and equal so; ties go to the smaller vec_id; an empty table gives no rows; rows with equal ids are candidates each; a query's
own row is left out by its id; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import seeded_draw, table, written

CENTROIDS = 16
#: Rows of an index block and of a query block.
INDEX_BLOCK, QUERY_BLOCK = 16_384, 1024
#: Rows so many times as long as the median are scored for every query.
LARGE = 16.0


@dataclass
class Codebook:
    centroids: np.ndarray  # subspaces x 16 x width, of vectors divided by scale
    eta: float
    scale: float = 1.0

    @property
    def width(self) -> int:
        return self.centroids.shape[2]

    def split(self, x: np.ndarray) -> np.ndarray:
        pad = self.centroids.shape[0] * self.width - x.shape[1]
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, self.width)

    def large(self, x: np.ndarray) -> np.ndarray:
        return lengths(x) > LARGE * self.scale

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """x divided by the scale, rows that are too large for codes as zeros."""
        return np.where(self.large(x)[:, None], 0.0, x) / self.scale

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x subspaces) by coordinate descent on the score-aware loss."""
        parts = self.split(self.scaled(x).astype(np.float32))
        unit = parts / np.maximum(np.linalg.norm(parts, axis=(1, 2), keepdims=True), 1e-30)
        m = parts.shape[1]
        codes = np.zeros((len(x), m), np.uint8)
        along = np.zeros((len(x), m), np.float32)  # each subspace's residual along x
        for sweep in range(sweeps + 1):  # the first sweep takes the nearest centroid
            total = along.sum(1)
            for j in range(m):
                residual = parts[:, j, None, :] - self.centroids[j].astype(np.float32)
                parallel = np.einsum("nkw,nw->nk", residual, unit[:, j])
                loss = np.einsum("nkw,nkw->nk", residual, residual)
                if sweep:
                    loss += np.float32(self.eta - 1) * (total[:, None] - along[:, j, None] + parallel) ** 2
                codes[:, j] = best = loss.argmin(1)
                new = parallel[np.arange(len(x)), best]
                total += new - along[:, j]
                along[:, j] = new
        return codes


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow on the way."""
    top = np.maximum(np.abs(x).max(1, initial=0.0), np.finfo(np.float64).tiny)
    return top * np.linalg.norm(x / top[:, None], axis=1)


def fit(x: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 6, seed: int = 9) -> Codebook:
    """Codebooks from sample vectors (rows x dimensions)."""
    d = x.shape[1]
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    m = -(-d // width)
    rng = np.random.default_rng(seed)
    book = Codebook(np.zeros((m, CENTROIDS, width)), eta, float(2.0 ** np.round(np.log2(np.median(lengths(x))))))
    x = x[~book.large(x)]
    parts = book.split(book.scaled(x))
    unit = parts / np.maximum(np.linalg.norm(parts, axis=(1, 2), keepdims=True), 1e-30)
    book.centroids = np.stack([parts[rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS), j] for j in range(m)])
    for _ in range(rounds):
        codes = book.encode(x)
        residual = parts - book.centroids[np.arange(m), codes]
        along = np.einsum("nmw,nmw->nm", residual, unit)
        total = along.sum(1)
        for j in range(m):
            u = unit[:, j]
            outer = (eta - 1) * np.einsum("nv,nw->nvw", u, u)
            rest = total - along[:, j]
            target = parts[:, j] + np.einsum("nvw,nw->nv", outer, parts[:, j]) + (eta - 1) * rest[:, None] * u
            for k in range(CENTROIDS):
                mine = codes[:, j] == k
                if mine.any():
                    a = mine.sum() * np.eye(width) + outer[mine].sum(0)
                    book.centroids[j, k] = np.linalg.solve(a, target[mine].sum(0))
            along[:, j] = np.einsum("nw,nw->n", parts[:, j] - book.centroids[j, codes[:, j]], u)
            total = rest + along[:, j]
    return book


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", v.alias("embedding")).where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.where(finite & F.exists("embedding", lambda x: x != 0))
    width = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").select("w").first()
    return rows.where(F.size("embedding") == (width[0] if width else 0))


def train(rows: DataFrame, max_sample: int = 10_000, seed: int = 9) -> Codebook | None:
    """Codebooks from at most max_sample vectors, drawn by a hash of their ids."""
    drawn = rows.orderBy(seeded_draw(seed, F.col("vec_id")), "vec_id").limit(max_sample).select("embedding").toPandas()
    # copies would draw the centroids to themselves
    return fit(np.unique(np.stack(drawn["embedding"].to_numpy()), axis=0)) if len(drawn) else None


def blocks(rows: DataFrame, size: int, columns: tuple[str, str], book: Codebook | None = None) -> DataFrame:
    """Rows as blocks of about size rows each: columns[0] (block), columns[1] (vec_ids and vectors as binary), codes (with a book)."""
    n = max(1, -(-rows.count() // size))

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        ids, x = frame["vec_id"].to_numpy(np.int64), np.stack(frame["embedding"].to_numpy())
        codes = book.encode(x).tobytes() if book else b""
        return pd.DataFrame({columns[0]: [int(frame["block"].iloc[0])], columns[1]: [ids.tobytes() + x.tobytes()], "codes": [codes]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInPandas(gather, f"{columns[0]} int, {columns[1]} binary, codes binary")


def _unpack(data: bytes, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (8 * (dimensions + 1))
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, n * dimensions, 8 * n).reshape(n, dimensions)


def tables(book: Codebook, queries: np.ndarray) -> np.ndarray:
    """Partial products of each query for pairs of subspaces: queries x pairs x 256 (two four-bit codes)."""
    q = np.einsum("qmw,mkw->qmk", book.split(queries.astype(np.float32)), book.centroids.astype(np.float32))
    if q.shape[1] % 2:
        q = np.concatenate([q, np.zeros_like(q[:, :1])], 1)
    return (q[:, 0::2, :, None] + q[:, 1::2, None, :]).reshape(len(q), -1, CENTROIDS * CENTROIDS)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte: pairs x rows."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], 1)
    return np.ascontiguousarray((codes[:, 0::2] * CENTROIDS + codes[:, 1::2]).T)


def search_block(book: Codebook, codes: np.ndarray, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, rerank: int) -> list[np.ndarray]:
    """query_id, vec_id, score: the best of one index block for each query."""
    # equal vectors: one entry each, with their ids in order; k + 1 of them are all that can count, the query's own row included
    _, first, group = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, group))
    begins = np.searchsorted(group[order], np.arange(len(first)))
    sizes = np.minimum(np.diff(np.append(begins, len(ids))), k + 1)
    entries, bytes_, large = x[first], packed(codes[first]), book.large(x[first])
    always = np.flatnonzero(large)
    out: list[list] = [[], [], []]
    for lookup, qid, query in zip(tables(book, q / lengths(q)[:, None]), qids, q, strict=True):
        rough = np.zeros(len(first), np.float32)
        for table_, row in zip(lookup, bytes_, strict=True):
            rough += table_[row]
        near = np.arange(len(rough))
        if len(rough) - len(always) > rerank:
            rough[large] = -np.inf
            near = np.append(np.argpartition(-rough, rerank)[:rerank], always)
        with np.errstate(over="ignore", invalid="ignore"):
            exact = (entries[near] * query).sum(1)
        n = sizes[near]
        at = np.repeat(begins[near] - np.cumsum(n) + n, n) + np.arange(n.sum())
        found, score = ids[order[at]], np.repeat(exact, n)
        keep = found != qid
        found, score = found[keep], score[keep]
        best = np.lexsort((found, -score))[:k]
        out[0].append(np.full(len(best), qid)), out[1].append(found[best]), out[2].append(score[best])
    return [np.concatenate(c) if c else np.zeros(0) for c in out]


def search(queries: DataFrame, index: DataFrame, book: Codebook, k: int = 20, rerank: int = 600) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query among index rows with another id. Both have vec_id, embedding."""
    first = index.select(F.size("embedding").alias("d")).first()
    d = first["d"] if first else 0
    stored = written(blocks(index, INDEX_BLOCK, ("block", "rows"), book), "ann-index")
    numbers = [r["block"] for r in stored.select("block").collect()]  # one number per block
    asked = blocks(queries, QUERY_BLOCK, ("query_block", "queries")).drop("codes").withColumn("block", F.explode(F.array(*map(F.lit, numbers)) if numbers else F.array().cast("array<int>")))

    def meet(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[int, tuple] = (-1, ())
        for frame in pairs:
            for block, rows, codes, own in zip(frame["block"], frame["rows"], frame["codes"], frame["queries"], strict=True):
                if held[0] != block:
                    ids, x = _unpack(rows, d)
                    held = (block, (np.frombuffer(codes, np.uint8).reshape(len(ids), -1), ids, x))
                qids, q = _unpack(own, d)
                coded, ids, x = held[1]
                found = search_block(book, coded, ids, x, qids, q, k, rerank)
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    pairs = asked.join(stored.repartition("block"), "block").sortWithinPartitions("block")
    found = pairs.mapInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    book = train(rows)
    if book is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(rows.where("vec_id % 20 = 0"), rows, book)
