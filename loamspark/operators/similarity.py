"""Set and vector similarity, retrieval and its quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import few_at_once, kept

#: Rows of a block of points and of a block of queries.
POINT_BLOCK, QUERY_BLOCK = 1024, 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def cosines(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Queries x points, in double precision; 0 where a vector is zero. Equal vectors have equal cosines, as each pair is summed alike."""
    size = np.sqrt(np.einsum("qd,qd->q", q, q))[:, None] * np.sqrt(np.einsum("pd,pd->p", p, p))
    return np.divide(np.einsum("qd,pd->qp", q, p), size, out=np.zeros_like(size), where=size > 0)


def met(queries: DataFrame, points: DataFrame, keys: list[str], use: Callable[..., pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What use(query ids, their labels, point ids, their labels, cosines) makes of each block of queries and each block of points.

    A task takes its pairs by query block and passes what it has of one through merge after each pair, so that what it sends on does not grow with the points.

    Both have vec_id, embedding and a numeric label. They are dealt into blocks by a hash of the id, and only rows with equal keys and as many
    dimensions meet. Vectors that are null or hold null or non-finite numbers take no part; labels that are null come as NaN.
    """
    rows = [_finite(r, keys) for r in (queries, points)]

    def blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        parts = max(1, -(-largest // size))
        return _blocks(rows.withColumn(f"{name}_part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")), [*keys, "width", f"{name}_part"], name), parts

    asked, _ = blocks(rows[0], QUERY_BLOCK, "q")
    stored, parts = blocks(rows[1], POINT_BLOCK, "p")
    asked = asked.withColumn("p_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = _of_blocks(asked, stored, [*keys, "width", "p_part"]).withColumn("asked", F.xxhash64(*keys, "width", "q_part"))
    return _meetings(pairs, use, merge, schema)


def _finite(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vec_id, label, embedding (doubles) and width of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    values = [F.col("label").cast("double").alias("label")] if "label" not in keys else []
    out = rows.where(F.col("vec_id").isNotNull() & finite).select(*keys, "vec_id", *values, F.col("embedding").cast("array<double>").alias("embedding"))
    return out.withColumn("width", F.size("embedding"))


def _blocks(rows: DataFrame, of: list[str], name: str, *more: Column) -> DataFrame:
    """The rows of each combination of ``of`` as arrays: name_ids, name_labels, name_rows (components, one vector after the other)."""
    held = rows.groupBy(*of).agg(F.collect_list(F.struct("vec_id", F.col("label").cast("double").alias("label"), "embedding")).alias("r"), *more)
    return held.select(*[c for c in held.columns if c != "r"], F.col("r.vec_id").alias(f"{name}_ids"), F.col("r.label").alias(f"{name}_labels"), F.flatten("r.embedding").alias(f"{name}_rows"))


def _of_blocks(asked: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """The join of two sides of blocks, by shuffle: a row's arrays are far larger than Spark takes them for, and a side that it broadcasts goes through the driver."""
    return asked.join(stored.hint("merge"), on)


def _meetings(pairs: DataFrame, use: Callable[..., pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """use and merge over pairs of blocks, those with the same ``asked`` in turn."""
    pairs = pairs.sortWithinPartitions("asked").select("asked", "width", *[f"{n}_{c}" for n in "qp" for c in ("ids", "labels", "rows")])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[int | None, pd.DataFrame | None] = (None, None)
        for frame in frames:
            for of, width, q_ids, q_labels, q, p_ids, p_labels, p in frame.itertuples(index=False):
                sized = [np.asarray(x, np.float64).reshape(len(i), width) for i, x in ((q_ids, q), (p_ids, p))]
                found = use(np.asarray(q_ids), np.asarray(q_labels, np.float64), np.asarray(p_ids), np.asarray(p_labels, np.float64), cosines(*sized))
                if held[0] == of:
                    found = merge(pd.concat([held[1], found]))
                elif held[1] is not None:
                    yield held[1]
                held = (of, found)
        if held[1] is not None:
            yield held[1]

    return pairs.mapInPandas(meet, schema)


#: Points that others are grouped around, and how many groups a query meets before its bound is known.
PIVOTS, FIRST = 64, 2


def _pivots(points: DataFrame) -> np.ndarray:
    """Directions to group points around: at most PIVOTS different ones, drawn by a hash of the id from the points of the most frequent width."""
    width = points.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return np.zeros((0, 0))
    drawn = points.where((F.col("width") == width["width"]) & F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("embedding")
    x = np.array([r["embedding"] for r in drawn.collect()], np.float64).reshape(-1, width["width"])
    size = np.abs(x).max(1, keepdims=True)
    x = x / size
    return np.unique(x / np.sqrt((x * x).sum(1, keepdims=True)), axis=0)


def _angles(pivots: np.ndarray) -> Callable[[pd.Series], pd.Series]:
    """The angles of vectors to each pivot; none for zero vectors and for those of another width, which no bound holds for."""

    def angles(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            top = np.abs(v).max(initial=0.0)
            if not top or len(v) != pivots.shape[1]:
                out.append(np.zeros(0))
                continue
            v = v / top
            out.append(np.arccos(np.clip(pivots @ v / np.sqrt((v * v).sum()), -1.0, 1.0)))
        return pd.Series(out)

    return angles


def best(queries: DataFrame, points: DataFrame, k: int, floor: float, keys: list[str], boost: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, most: float = 0.0) -> DataFrame:
    """query_id, vec_id, score, rank: the k best other points of each query at or above a floor; ties to the smaller id.

    boost(query ids, point ids), at most ``most``, is added to the cosine. Points are grouped around pivots. A query meets the groups of its nearest pivots first; its k-th best
    score there, or the floor, is what others must reach, and a group whose nearest possible point (by the triangle inequality of angles) does not is not met. Tasks
    send on their k best of a query alone.
    """

    def of_block(q_ids: np.ndarray, _: np.ndarray, p_ids: np.ndarray, __: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        score = score + boost(q_ids[:, None], p_ids[None]) if boost else score
        fit = (q_ids[:, None] != p_ids[None]) & (score >= floor)
        if len(p_ids) > k:
            held = np.where(fit, score, -np.inf)
            fit &= held >= np.partition(held, -k, axis=1)[:, -k, None]
        of, at = np.nonzero(fit)
        order = np.lexsort((p_ids[at], -score[of, at], of))
        of, at = of[order], at[order]
        best = np.arange(len(of)) - np.searchsorted(of, of) < k
        of, at = of[best], at[best]
        return pd.DataFrame({"query_id": q_ids[of], "vec_id": p_ids[at], "score": score[of, at]})

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return found[found.groupby("query_id").cumcount() < k]

    def ranked(found: DataFrame) -> DataFrame:
        at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", at).where(F.col("rank") <= k)

    asked, stored, groups = grouped(queries, points, keys)
    reach = asked.drop("embedding", *({"label"} - set(keys))).join(groups, [*keys, "width"]).withColumn("nearest", _nearest())
    reach = reach.groupBy(*keys, "vec_id", "width", "pivot").agg(F.min("nearest").alias("nearest"))  # rows with one id ask as one
    order = F.row_number().over(Window.partitionBy(*keys, "vec_id", "width").orderBy("nearest", "pivot"))
    reach = kept(reach.withColumn("nth", order), "reach")

    def met_groups(pairs: DataFrame) -> DataFrame:
        rows = asked.drop("angles").join(pairs.select(*keys, "vec_id", "width", "pivot"), [*keys, "vec_id", "width"])
        parts = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-queries.count() // QUERY_BLOCK)))).cast("int")
        blocks = _blocks(rows.withColumn("q_part", parts), [*keys, "width", "pivot", "q_part"], "q")
        both = _of_blocks(blocks, stored, [*keys, "width", "pivot"]).withColumn("asked", F.xxhash64(*keys, "width", "pivot", "q_part"))
        return _meetings(both, of_block, merge, "query_id long, vec_id long, score double")

    first = kept(met_groups(reach.where(F.col("nth") <= FIRST)), "first-groups")
    last = ranked(first).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    bound = F.greatest(F.coalesce("least", F.lit(floor)), F.lit(floor)) - 1e-9
    rest = reach.where(F.col("nth") > FIRST).join(last, "vec_id", "left").where(F.cos("nearest") + most >= bound)
    return ranked(first.unionByName(met_groups(rest)))


def _nearest() -> Column:
    """The least angle that a query and a point of a group can have."""
    angle = F.try_element_at("angles", F.col("pivot") + 1)
    return F.when(F.col("pivot") < 0, 0.0).otherwise(F.coalesce(F.greatest(angle - F.col("radius") - 1e-7, F.lit(0.0)), F.lit(0.0)))


def grouped(queries: DataFrame, points: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries with their angles to the pivots, points in blocks of one pivot (-1: those no bound holds for), and the groups: keys, width, pivot, radius."""
    rows = _finite(points, keys)
    pivots = _pivots(rows)
    angles = F.pandas_udf(_angles(pivots), "array<double>")
    placed = rows.withColumn("angles", angles("embedding"))
    near = F.array_min("angles")
    pivot = F.when(F.size("angles") > 0, F.array_position("angles", near).cast("int") - 1).otherwise(-1)
    placed = kept(placed.select(*rows.columns, pivot.alias("pivot"), F.coalesce(near, F.lit(0.0)).alias("angle")), "placed")
    groups = placed.groupBy(*keys, "width", "pivot").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / F.lit(float(POINT_BLOCK))).cast("int").alias("parts"))
    groups = kept(groups, "groups")
    dealt = placed.join(groups.drop("radius"), [*keys, "width", "pivot"]).withColumn("p_part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    asked = _finite(queries, keys)
    return asked.withColumn("angles", angles("embedding")), _blocks(dealt, [*keys, "width", "pivot", "p_part"], "p"), groups.drop("parts")


def nearest(queries: DataFrame, points: DataFrame, k: int, floor: float, payload: str) -> DataFrame:
    """query_id, vec_id, score, rank: points of the query's payload value with the best cosine, at or above a floor; ties to the smaller id.

    Both have vec_id, embedding and the payload column (numeric), which is the join's key.
    """
    queries, points = (rows.select("vec_id", "embedding", F.col(payload).alias("label")) for rows in (queries, points))
    return best(queries, points, k, floor, ["label"])


def jaccard_join(rows: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """a, b, jaccard of pairs that share a token and reach the threshold: tokens are matched, shared ones counted, and sizes give the rest.

    Only the rarest tokens of a set are matched (prefix filter), so frequent tokens do not pair everything.
    """
    sized = rows.select(F.col(key).alias("id"), F.array_distinct(tokens).alias("set")).where(F.size("set") > 0)
    counts = sized.select(F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    ranked = sized.select("id", F.explode("set").alias("token")).join(counts, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"))
    prefix = (F.size("order") - F.ceil(F.size("order") * F.lit(least)) + 1).cast("int")
    entries = ranked.select("id", F.explode(F.slice("order", 1, prefix)).alias("e")).select("id", "e.token")
    pairs = entries.alias("x").join(entries.alias("y"), "token").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both = pairs.join(sized.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sized.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("jaccard")).where(F.col("jaccard") >= least)


#: Members of posting lists that a first look at a question scores, for each of the best that are asked for.
SEEDS = 40


def best_overlaps(sets: DataFrame, questions: DataFrame, limit: int, by: list[str] | None = None) -> DataFrame:
    """by, question, set, owner, score: every set that is as much like a question (Jaccard, above 0) as the limit-th best owner of its group, and no others but some below it.

    sets has the columns by, set, owner, weight (how many of the limit an owner takes) and tokens; questions has by, question and tokens. A set is found in two looks:

    1. The posting lists of a question's rarest tokens, about SEEDS entries for each place (more do not change the result), give sets whose scores are worked out; the limit-th best
       owner among them bounds the question's threshold from below.
    2. A set of n tokens that reaches the threshold t of a question of m shares t (n + m) / (1 + t) of them at least. So one of the shared tokens is among
       the rarest of both sides, as many as may be missing and one more: only these meet, and only where the sizes allow it. What the question with the
       least threshold could not use is not read at all.
    """
    by = by or []
    sized = sets.where(F.size("tokens") > 0)
    asked = questions.where(F.size("tokens") > 0)
    # tokens that the other side does not have are missing in any case: they count for sizes, but have no entries
    vocabulary = asked.select(*by, F.explode("tokens").alias("token")).distinct()
    entries = sized.select(*by, "set", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(vocabulary, [*by, "token"])
    counts = kept(entries.groupBy(*by, "token").agg(F.count("*").alias("df")), "token-counts")

    def ranked(rows: DataFrame, key: str, place: str, size: str) -> DataFrame:
        """rows (by, key, token) with each token's place among those of its key, the rarest first, and their number."""
        of = Window.partitionBy(*by, key)
        return rows.join(counts, [*by, "token"]).withColumn(place, F.row_number().over(of.orderBy("df", "token")) - 1).withColumn(size, F.count("*").over(of))

    posted = kept(ranked(entries, "set", "place", "n_met").drop("df"), "postings")
    wanted = kept(ranked(asked.select(*by, "question", F.size("tokens").alias("m"), F.explode("tokens").alias("token")), "question", "at", "m_met"), "questions")

    def scored(met: DataFrame) -> DataFrame:
        pairs = met.select(*by, "question", "set").distinct()
        with_sets = pairs.join(asked.select(*by, "question", F.col("tokens").alias("_q")), [*by, "question"]).join(sized.select(*by, "set", "owner", "weight", "tokens"), [*by, "set"])
        both = F.size(F.array_intersect("_q", "tokens"))
        return with_sets.select(*by, "question", "set", "owner", "weight", (both / (F.size("_q") + F.size("tokens") - both)).alias("score"))

    before = F.sum("df").over(Window.partitionBy(*by, "question").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rare = wanted.withColumn("_before", F.coalesce(before, F.lit(0))).where(f"_before + df <= {SEEDS * limit} or _before = 0")
    first = scored(rare.join(posted, [*by, "token"]))
    owners = first.groupBy(*by, "question", "owner").agg(F.max("score").alias("score"), F.max("weight").alias("weight"))
    so_far = F.sum("weight").over(Window.partitionBy(*by, "question").orderBy(F.desc("score")))  # with equals
    least = owners.withColumn("_n", so_far).where(F.col("_n") >= limit).groupBy(*by, "question").agg(F.max("score").alias("least"))

    bound = kept(wanted.join(least, [*by, "question"], "left").select(*by, "question", "m", "m_met", "token", "at", F.coalesce("least", F.lit(0.0)).alias("t")), "bounds")

    def shared(t: Column, n: Column, m: Column) -> Column:
        """How many tokens two sets of n and m share at least, if their similarity is t."""
        return F.greatest(F.lit(1), F.ceil(t * (n + m) / (1 + t) - 1e-9))

    lowest = bound.agg(F.min("t").alias("t_min"), F.min("m").alias("m_min"))  # one row
    n, m, t = F.col("n"), F.col("m"), F.col("t")
    useful = posted.join(F.broadcast(lowest), F.col("place") <= F.col("n_met") - shared(F.col("t_min"), n, F.col("m_min"))).drop("t_min", "m_min")
    fits = (F.col("place") <= F.col("n_met") - shared(t, n, m)) & (F.col("at") <= F.col("m_met") - shared(t, n, m)) & (n >= t * m - 1e-9) & (m >= t * n - 1e-9)
    return scored(useful.join(bound, [*by, "token"]).where(fits)).drop("weight")


#: Bits of a number that count the sets of a block (1,024), blocks that a task gets at once, and blocks of questions whose best a task holds.
SET_BITS, BLOCKS, HELD = 10, 16, 64
#: Tokens shared by a set and a question that are counted at once.
MEETINGS = 1 << 20
#: What stands between tokens in one string, which takes a third of the room of an array.
BETWEEN = " "


class _Asked:
    """A block of questions by their tokens, and the best owners that a task has found for each."""

    def __init__(self, rows: pa.StructArray, limit: int) -> None:
        self.questions, tokens = rows.flatten()
        self.sizes, words = pc.list_value_length(tokens).to_numpy(), tokens.flatten()
        self.vocabulary, self.limit, self.least = pc.unique(words), limit, np.zeros(len(rows))
        of = np.repeat(np.arange(len(rows)), self.sizes)
        token = pc.index_in(words, self.vocabulary).to_numpy()
        self.posted, self.starts = of[np.argsort(token, kind="stable")], np.append(0, np.cumsum(np.bincount(token)))
        self.best: tuple[np.ndarray, ...] | None = None

    def meet(self, rows: pa.StructArray) -> None:
        """Count what sets (owner, text, at, tokens in one string) share with each question, and take over those that are among the best."""
        owners, *places, joined = rows.flatten()
        tokens = pc.split_pattern(joined, BETWEEN)
        sizes = pc.list_value_length(tokens).to_numpy()
        token = pc.index_in(tokens.flatten(), self.vocabulary)
        known = token.is_valid().to_numpy(zero_copy_only=False)
        token, of = token.drop_null().to_numpy(), np.repeat(np.arange(len(rows)), sizes)[known]
        n = self.starts[token + 1] - self.starts[token]
        ends, both = np.cumsum(n), np.zeros(len(rows) * len(self.sizes), np.int64)
        cuts = [0, *np.searchsorted(ends, np.arange(MEETINGS, n.sum(), MEETINGS)).tolist(), len(n)]
        for part in map(slice, cuts, cuts[1:]):
            m, before = n[part], ends[part] - n[part]
            entry = np.arange(m.sum()) + np.repeat(self.starts[token[part]] - before + before[:1].sum(), m)
            both += np.bincount(np.repeat(of[part], m) * len(self.sizes) + self.posted[entry], minlength=len(both))
        cell = np.flatnonzero(both)
        both, (of, question) = both[cell], np.divmod(cell, len(self.sizes))
        score = both / (self.sizes[question] + sizes[of] - both)
        fit = score >= self.least[question]
        of, new = of[fit], (question[fit], score[fit])
        if not len(of):
            return
        plain, text, at = np.array(owners.to_pylist(), object)[of], *(c.to_numpy()[of] for c in places)
        found = (*new, plain, text, at)
        first = self._first(*found)
        found = tuple(c[first] for c in found)
        if self.best is not None:
            found = tuple(map(np.concatenate, zip(self.best, found, strict=True)))
            first = self._first(*found)
            found = tuple(c[first] for c in found)
        self.best = found
        last, number = np.flatnonzero(np.append(found[0][1:] != found[0][:-1], True)), np.bincount(found[0], minlength=len(self.sizes))
        full = last[number[found[0][last]] >= self.limit]
        self.least[found[0][full]] = found[1][full]

    def _first(self, question: np.ndarray, score: np.ndarray, owner: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each question's owners the limit best: where the best row of each is, by question, score and owner."""
        owner = pd.factorize(owner, sort=True)[0]  # null: -1
        order = np.lexsort((text, at, -score, owner, question))
        a, b = question[order], owner[order]
        order = order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))]
        order = order[np.lexsort((owner[order], -score[order], question[order]))]
        place = np.arange(len(order)) - np.searchsorted(question[order], question[order])
        return order[place < self.limit]

    def rows(self, owner: pa.DataType) -> pa.RecordBatch:
        question, score, owners, text, at = self.best
        columns = [self.questions.take(pa.array(question)), pa.array(owners.tolist(), owner), pa.array(text), pa.array(at), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, ["question", "owner", "text", "at", "score"])


def best_owners(sets: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """question, owner, text, at, score, rank: the owners of the sets that are most like each question (Jaccard, above 0), each with its best set.

    sets has owner, text (a number), at and tokens, questions has question and tokens; tokens are distinct, not empty and without blanks. Ties of sets go to the first by at and
    text, ties of owners to the smaller. Every block of sets meets every block of questions, which counts all tokens that two share and leaves no pair out; a task
    sends on the best of each question alone.
    """
    joined = F.coalesce(F.array_join("tokens", BETWEEN), F.lit("")).alias("tokens")
    asked = kept(questions.where(F.col("question").isNotNull()).select("question", "tokens"), "questions").where(F.size("tokens") > 0)
    parts = F.pmod(F.xxhash64("question", "tokens"), F.lit(max(1, -(-asked.count() // QUERY_BLOCK))))
    asked = kept(asked.groupBy(parts.alias("part")).agg(F.collect_list(F.struct("question", "tokens")).alias("asked")), "question-blocks")
    # rows that stand together are a block; those without tokens stay, as a filter on tokens would have them worked out twice
    blocks = sets.select("owner", F.col("text").cast("long"), F.col("at").cast("long"), joined, F.shiftright(F.monotonically_increasing_id(), SET_BITS).alias("block"))
    blocks = blocks.groupBy("block").agg(F.collect_list(F.struct("owner", "text", "at", "tokens")).alias("said"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Asked] = {}
        done = lambda x: [x.rows(owner)] if x.best is not None else []
        for batch in batches:
            owner = batch.column(2).type.value_type.field("owner").type
            for part, wanted, said in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if part not in held:
                    if len(held) == HELD:
                        yield from done(held.pop(next(iter(held))))
                    held[part] = _Asked(wanted.values, limit)
                held[part].meet(said.values)
        for x in held.values():
            yield from done(x)

    kinds = dict(sets.dtypes) | dict(questions.dtypes)
    schema = f"question {kinds['question']}, owner {kinds['owner']}, text long, at long, score double"
    with few_at_once(sets.sparkSession, BLOCKS):
        found = kept(asked.crossJoin(blocks).select("part", "asked", "said").mapInArrow(meet, schema), "best-owners")
    best = found.groupBy("question", "owner").agg(F.min(F.struct(-F.col("score"), "at", "text")).alias("b"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "owner"))
    return best.withColumn("rank", place).where(F.col("rank") <= limit).select("question", "owner", "b.text", "b.at", "score", "rank")


def pair_cells(queries: DataFrame, points: DataFrame) -> DataFrame:
    """cell, same, n: how many pairs of a query and another point have a cosine (0 at least) in each twentieth, by whether their labels are equal."""

    def of_block(q_ids: np.ndarray, q_labels: np.ndarray, p_ids: np.ndarray, p_labels: np.ndarray, score: np.ndarray) -> pd.DataFrame:
        known = (q_ids[:, None] != p_ids[None]) & ~np.isnan(q_labels[:, None] + p_labels[None])
        cell = np.floor(np.maximum(score, 0.0) * 20 + 1e-9).astype(np.int64)
        n = np.bincount((cell * 2 + (q_labels[:, None] == p_labels[None]))[known], minlength=1)
        at = np.flatnonzero(n)
        return pd.DataFrame({"cell": at // 2, "same": at % 2 == 1, "n": n[at]})

    def merge(cells: pd.DataFrame) -> pd.DataFrame:
        return cells.groupby(["cell", "same"], as_index=False)["n"].sum()

    return met(queries, points, [], of_block, merge, "cell int, same boolean, n long").groupBy("cell", "same").agg(F.sum("n").alias("n"))


def threshold_costs(pairs: DataFrame, score: str, same: str, merge_cost: float = 5.0) -> DataFrame:
    """threshold, false_merges, false_splits, cost for 19 thresholds from 0.05 to 0.95: one pass over the pairs, by their grid cell."""
    cells = pairs.groupBy(F.floor(F.col(score) * 20 + F.lit(1e-9)).cast("int").alias("cell"), F.col(same).alias("same")).agg(F.count("*").alias("n"))
    return cell_costs(cells, merge_cost)


def cell_costs(cells: DataFrame, merge_cost: float = 5.0) -> DataFrame:
    """threshold_costs of pairs counted by cell and same."""
    thresholds = cells.sparkSession.range(1, 20).select((F.col("id") * 5 / 100).alias("threshold"), F.col("id").cast("int").alias("i"))
    met_cells = thresholds.join(F.broadcast(cells), F.lit(True))  # some dozen rows on either side
    merges = F.sum(F.when(~F.col("same") & (F.col("cell") >= F.col("i")), F.col("n")).otherwise(0))
    splits = F.sum(F.when(F.col("same") & (F.col("cell") < F.col("i")), F.col("n")).otherwise(0))
    out = met_cells.groupBy("threshold").agg(merges.alias("false_merges"), splits.alias("false_splits"))
    return out.withColumn("cost", F.col("false_merges") * merge_cost + F.col("false_splits"))
