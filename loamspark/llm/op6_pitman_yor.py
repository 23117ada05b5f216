"""Language-model scores of a hierarchical Pitman-Yor model.

Every context has a Chinese restaurant; its dishes are words, and each of its tables sends one customer to the parent restaurant that all
contexts share, whose own base is uniform over the V known words and one unknown. A context is the previous word. Frequent words have
restaurants of their own (one for every HALF_BUCKET occurrences, dealt by a hash of the text, so none grows without bound); the others are
hashed to the rest of the restaurants. There are at least ``least_contexts`` restaurants, and more as the tokens grow. Seating is sampled by
Gibbs, a dish at a time: given the seats of all others, the number of tables of a dish with c customers has weights
S_d(c, t) prod_{i<t}(strength + d (other tables + i)) p^t (S_d: generalised Stirling numbers, p: the dish's probability in the parent), which
is sampled exactly up to EXACT customers; more customers are seated one after the other, in runs of a part of those seated, with a binomial
number of new tables. Predictive probabilities are averaged over samples. Discounts are estimated from counts of counts.

Occurrences are dealt to buckets by word, so a dish's customers in all contexts, and so its parent customers, are in one bucket, and a Gibbs
sweep needs totals by restaurant alone: these are summed between rounds. A chain depends on its bucket, the totals and the seed, so the
scoring pass repeats the last round's chain rather than storing seats. Buckets depend on the texts alone, so neither partitions nor their
number change a score. Words with more than HALF_BUCKET occurrences are split by restaurant over as many parts as they need; their parent
customers are summed between rounds like the restaurants' totals. Buckets also hold which documents their words occur in, so scoring
sends back one sum for each document and bucket instead of joining tokens to a model.

Up to LISTED restaurants their totals come to the driver and go to every task. Beyond, they are a table: buckets write what they add to each of
their restaurants, Spark sums that by restaurant, and each bucket is joined to the totals of its own. A restaurant seats a bounded number of
occurrences, so no key of that join is hot. Both ways give the same scores. What else comes to the driver are the frequent words: OWN at most, or those that are split
(one for every HALF_BUCKET tokens at most, far fewer in texts), 16 bytes each.

Probabilities of one context add up to 1 but for what a round moves: its buckets are sampled at once, each against the totals that the round began with, and
the tables that the others open or close meanwhile are missing in them (in tests less than 2 %).

Defined results: null and empty texts are one end token; a null doc_id counts as the empty text for the training split; repeated rows are
learnt from and scored each; ties in the frequency of words go to the smaller hash; a text of any length is scored whole; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_ROWS, BATCH_ROWS, column_hashes, crc32_mod, doc_text, mix64, settings, table, written

#: Restaurants that there are at least; a quarter of them is for the most frequent words, or for OWN of them.
CONTEXTS, OWN = 1 << 17, 1 << 20
#: Restaurants whose totals may go through the driver; beyond, totals are a table.
LISTED = 1 << 18
#: Occurrences that a bucket should hold, of which one dish may be half; tokens that are counted at once; tokens and documents that a map task gathers before it hands them on.
BUCKET_TOKENS, COUNT_TOKENS, FLUSH_TOKENS, FLUSH_DOCS = 800_000, 1_000_000, 400_000, 60_000
HALF_BUCKET = BUCKET_TOKENS // 2
#: Buckets that there are at least.
LEAST_BUCKETS = 16
#: Up to so many customers of a dish the number of tables is sampled exactly; beyond, runs are so small a part of those seated.
EXACT, RUN = 32, 1 / 32
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
NULL_ID = -(1 << 63)
#: A row holds a whole bucket, so readers take few at once.
ROW_AT_A_TIME = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "2"}
#: Document number, base_score and score of a partial sum; of documents with unknown tokens, the number and how many.
SUMS, UNKNOWN = (np.uint16, np.float64, np.float64), (np.uint16, np.uint32)


class Own:
    """Totals of a bucket's own restaurants, looked up by restaurant."""

    def __init__(self, restaurants: np.ndarray, values: np.ndarray):
        self.restaurants, self.values = restaurants, values

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.restaurants, at)]


@dataclass
class Sample:
    """Tables by restaurant, the parent's customers and tables, and those of the hot words."""

    tables: np.ndarray | Own | None
    parent: tuple[float, float]
    hot: tuple[np.ndarray, np.ndarray]


@dataclass
class Totals:
    """Sums over all buckets. customers are by restaurant. Where totals are a table, what is by restaurant is None until a bucket brings its own."""

    n: float
    v: float
    customers: np.ndarray | Own | None
    discounts: tuple[float, float]
    samples: list[Sample]
    hot: np.ndarray  # hot words in order, and how many training tokens each has
    hot_tokens: np.ndarray
    strength: float = 1.0
    round: int = 0


# ---- occurrences by bucket


@dataclass
class Layout:
    """Which restaurants contexts have and which buckets words have. Arrays of words are sorted."""

    contexts: int
    buckets: int
    frequent: np.ndarray  # words with restaurants of their own: the first one's number, and how many
    first: np.ndarray
    many: np.ndarray
    hot: np.ndarray  # words that are split, and over how many parts
    parts: np.ndarray

    def restaurants(self, before: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The restaurant of each previous word in a text, which is known by a hash."""
        at = np.minimum(np.searchsorted(self.frequent, before), len(self.frequent) - 1)
        taken = int(self.many.sum())
        own = self.first[at] + (text % self.many[at].astype(np.uint64)).astype(np.int64)
        rest = taken + (mix64(before) % np.uint64(self.contexts - taken)).astype(np.int64)
        return np.where(self.frequent[at] == before, own, rest).astype(np.uint32)

    def bucket_of(self, word: np.ndarray, restaurant: np.ndarray) -> np.ndarray:
        part = np.zeros(len(word), np.uint64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, word), len(self.hot) - 1)
            split = self.hot[at] == word
            part[split] = mix64(restaurant[split].astype(np.uint64) + END) % self.parts[at[split]].astype(np.uint64)
        return (mix64(word + part) % np.uint64(self.buckets)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word, the end and the start stand in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for batch in batches:
            hashes, words = column_hashes(batch.column(0))
            held += [hashes, np.repeat(np.array([END, START]), len(words))]
            tokens += len(hashes)
            if tokens > COUNT_TOKENS:
                yield found(held)
                held, tokens = [], 0
        if held:
            yield found(held)

    def found(held: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    return docs.select(doc_text().alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def layout(docs: DataFrame, least_contexts: int) -> Layout:
    """A layout for the words of docs. What comes to the driver are the words that are split or have restaurants of their own."""
    counts = written(word_counts(docs), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    contexts = max(least_contexts, 1 << (4 * total // HALF_BUCKET).bit_length())
    split = counts.where(F.col("n") > HALF_BUCKET).count()  # as many as contexts // 4 at most
    top = counts.orderBy(F.desc("n"), "word").limit(max(min(contexts // 4, OWN), split)).collect()
    words, n = np.array([r["word"] for r in top] or [0], np.int64).view(np.uint64), np.array([r["n"] for r in top] or [0], np.int64)
    order = np.argsort(words)
    words, n = words[order], n[order]
    many = np.maximum(-(-n // HALF_BUCKET), 1)
    split = n > HALF_BUCKET  # there are more places than words as frequent as that
    return Layout(contexts, max(LEAST_BUCKETS, -(-total // BUCKET_TOKENS)), words, np.cumsum(many) - many, many, words[split], many[split])


def occurrences(docs: DataFrame, plan: Layout) -> DataFrame:
    """bucket, flush, n_train, n_docs, held: packed occurrences of the bucket's words; a flush's training documents have the lowest numbers. Rows with a negative bucket hold ids and token counts of a flush's documents."""
    buckets = plan.buckets

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush_id, held, tokens, n = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            hashes, words = column_hashes(batch.column(2))
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), hashes, words))
            tokens, n = tokens + len(hashes), n + len(words)
            if tokens > FLUSH_TOKENS or n > FLUSH_DOCS - 1024:
                yield from flush(flush_id, held)
                flush_id, held, tokens, n = flush_id + 1, [], 0, 0
        if n:
            yield from flush(flush_id, held)

    def flush(flush_id: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, train, hashes, words = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(~train, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        token, ends = np.insert(hashes, np.cumsum(words), END), np.cumsum(words + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(token))])
        text = np.repeat(mix64(total[ends] - total[ends - words - 1]), words + 1)
        doc = np.repeat(number, words + 1).astype(np.uint16)
        before = np.concatenate([[START], token[:-1]])
        before[ends[:-1]] = START
        context = plan.restaurants(before, text)
        bucket = plan.bucket_of(token, context)
        by = np.lexsort((token, bucket))
        token, doc, context, bucket = token[by], doc[by], context[by], bucket[by]
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = [(-1 - flush_id, ids[order].astype(np.int64).tobytes() + (words[order] + 1).astype(np.int64).tobytes())]
        for b in np.flatnonzero(np.diff(ends)).tolist():
            part = slice(ends[b], ends[b + 1])
            word, many = np.unique(token[part], return_counts=True)
            rows.append((b, np.int64(len(word)).tobytes() + word.tobytes() + many.astype(np.int32).tobytes() + context[part].tobytes() + doc[part].tobytes()))
        for b, blob in rows:
            values = [[b], [flush_id], [int(train.sum())], [len(ids)], [blob]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "flush", "n_train", "n_docs", "held"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "train", doc_text().alias("text"))
    return rows.mapInArrow(gather, "bucket long, flush long, n_train int, n_docs int, held binary")


class Bucket:
    """The occurrences of a bucket: word, entry (word and context) and document of each, and the customers of each entry."""

    def __init__(self, parts: list[dict], contexts: int, hot: np.ndarray):
        parts = sorted(parts, key=lambda p: p["flush"])
        words, counts, context, doc, train = [], [], [], [], []
        for p in parts:
            blob = p["held"]
            m = int(np.frombuffer(blob, np.int64, 1)[0])
            words.append(np.frombuffer(blob, np.uint64, m, 8))
            counts.append(np.frombuffer(blob, np.int32, m, 8 + 8 * m))
            o = (len(blob) - 8 - 12 * m) // 6
            context.append(np.frombuffer(blob, np.uint32, o, 8 + 12 * m))
            doc.append(np.frombuffer(blob, np.uint16, o, 8 + 12 * m + 4 * o))
            train.append(doc[-1] < p["n_train"])
        self.flushes, self.n_occurrences = [p["flush"] for p in parts], [len(d) for d in doc]
        self.doc = np.concatenate(doc)
        train = np.concatenate(train)
        words, inverse = np.unique(np.concatenate(words), return_inverse=True)
        self.word = np.repeat(inverse.astype(np.int32), np.concatenate(counts))
        self.of_word = np.bincount(self.word[train], minlength=len(words))  # training tokens
        keys, entry = np.unique(self.word.astype(np.int64) * contexts + np.concatenate(context), return_inverse=True)
        self.entry = entry.astype(np.int32)
        del entry
        self.c = np.bincount(self.entry[train], minlength=len(keys))
        self.entry_word, self.entry_context = keys // contexts, keys % contexts
        self.n_words = len(words)
        self.words = words
        self.hot_words = np.flatnonzero(np.isin(words, hot))  # of this bucket, and their numbers among the hot words
        self.hot_numbers = np.searchsorted(hot, words[self.hot_words])


# ---- seating


def stirling(d: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers of up to EXACT customers: [customers, tables]."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(EXACT):
            t = np.arange(1, n + 2)
            out[n + 1, t] = np.logaddexp(out[n, t - 1], np.log(np.maximum(n - d * t, 1e-300)) + out[n, t])
    return out


def sample_tables(rng: np.random.Generator, c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, strength: float) -> np.ndarray:
    """A number of tables for each dish with c customers, given its probability in the parent and the other tables of its restaurant."""
    t, log_s = (c > 0).astype(np.int64), stirling(d)
    base = strength + d * np.maximum(others, 0)
    order = np.argsort(c, kind="stable")
    ends = np.searchsorted(c[order], np.arange(EXACT + 2))
    for n in range(2, EXACT + 1):
        for begin in range(ends[n], ends[n + 1], 20_000):
            at = order[begin : min(begin + 20_000, ends[n + 1])]
            weights = np.cumsum(np.log(base[at, None] + d * np.arange(n)) + np.log(p[at])[:, None], 1) + log_s[n, 1 : n + 1]
            weights = np.cumsum(np.exp(weights - weights.max(1, keepdims=True)), 1)
            t[at] = 1 + (weights < rng.random(len(at))[:, None] * weights[:, -1:]).sum(1)
    at = order[ends[EXACT + 1] :]
    if len(at):
        tables, seated, most = np.ones(len(at), np.int64), np.ones(len(at), np.int64), c[at]
        while (seated < most).any():
            step = np.minimum(np.maximum((seated * RUN).astype(np.int64), 1), most - seated)
            new = (base[at] + d * tables) * p[at]
            tables += rng.binomial(step, new / (new + np.maximum(seated - d * tables, 1e-9)))
            seated += step
        t[at] = np.minimum(tables, most)
    return t


def chain(bucket: Bucket, number: int, known: Totals, sweeps: int, keep: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gibbs sweeps over the dishes of a bucket; yields (tables of entries, parent customers and parent tables of words) of the last ``keep``."""
    rng = np.random.default_rng([seed, number])
    last = known.samples[-1]
    tables_of, (c0, t0) = last.tables, last.parent
    d1, d0 = known.discounts
    base = 1 / (known.v + 1)
    mine = np.flatnonzero(bucket.c > 0)
    c, word, others = bucket.c[mine], bucket.entry_word[mine], tables_of[bucket.entry_context[mine]]
    t, parent = np.ones(len(mine), np.int64), np.ones(bucket.n_words, np.int64)
    for sweep in range(sweeps):
        sent = np.bincount(word, t, bucket.n_words).astype(np.int64)
        sent[bucket.hot_words] = last.hot[0][bucket.hot_numbers]
        parent = sample_tables(rng, sent, np.full(len(sent), base), t0 - parent, d0, known.strength)
        parent[bucket.hot_words] = last.hot[1][bucket.hot_numbers]
        rest = np.maximum(sent[word] - t, 0)  # the parent's customers without the dish's own
        there = np.minimum(parent[word], rest)
        p = (rest - d0 * there + (known.strength + d0 * t0) * base) / (known.strength + c0)
        t = sample_tables(rng, c, p, others - t, d1, known.strength)
        if sweep >= sweeps - keep:
            sent = np.bincount(word, t, bucket.n_words).astype(np.int64)
            out = np.zeros(len(bucket.c), np.int64)
            out[mine] = t
            yield out, sent, np.minimum(np.maximum(parent, sent > 0), sent)


# ---- rounds

#: What a bucket adds to sums over all buckets, by kind, and to its restaurants' totals: a weight of each entry, by kind.
Added = tuple[dict[str, list | np.ndarray], dict[str, np.ndarray]]


class Listed:
    """Totals by restaurant as vectors at the driver, which go to every task."""

    def __init__(self, stored: DataFrame, contexts: int, hot: np.ndarray):
        self.stored, self.contexts, self.hot = stored, contexts, hot
        self.totals: dict[str, np.ndarray] = {}

    def summed(self, of: Callable[[int, Bucket, Totals | None], Added], known: Totals | None, kinds: list[str]) -> dict[str, np.ndarray]:
        """Sums of what ``of(number, bucket, known)`` adds, {kind: vector}, and from now on the totals by restaurant of ``kinds``; one row a kind and place from each task."""
        contexts, hot = self.contexts, self.hot

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                for number, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    b = Bucket(parts.as_py(), contexts, hot)
                    sums, weights = of(number, b, known)
                    for kind, vector in [*sums.items(), *((kind, np.bincount(b.entry_context, w, contexts)) for kind, w in weights.items())]:
                        total[kind] = total.get(kind, 0) + np.asarray(vector, np.float64)
            for kind, vector in total.items():
                places = np.flatnonzero(vector)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(places), pa.string()), pa.array(places, pa.int32()), pa.array(vector[places], pa.float64())], ["kind", "place", "value"])

        out: dict[str, np.ndarray] = {}
        rows = self.buckets().mapInArrow(add, "kind string, place int, value double")
        for kind, place, value in rows.groupBy("kind", "place").agg(F.sum("value")).collect():  # LISTED rows of some kinds at most
            out.setdefault(kind, np.zeros(contexts))[place] = value
        self.totals |= {k: out.get(k, np.zeros(contexts)) for k in kinds}
        return out

    def total(self, kind: str) -> np.ndarray:
        return self.totals[kind]

    def buckets(self) -> DataFrame:
        """bucket, parts."""
        return self.stored.where("bucket >= 0").select("bucket", "parts")

    @staticmethod
    def known(batch: pa.RecordBatch, at: int, totals: Totals) -> Totals:
        """The totals for a row of buckets()."""
        return totals


class Tabled:
    """Totals by restaurant as a table, of which each bucket is joined to its own."""

    def __init__(self, stored: DataFrame, contexts: int, hot: np.ndarray):
        self.stored, self.contexts, self.hot = stored, contexts, hot
        self.seated: DataFrame | None = None  # bucket, place
        self.tables: list[tuple[list[str], DataFrame]] = []  # kinds, and (place, one column a kind)

    def summed(self, of: Callable[[int, Bucket, Totals | None], Added], known: Totals | None, kinds: list[str]) -> dict[str, np.ndarray]:
        """As Listed.summed, but the totals by restaurant become a table."""
        contexts, hot, here = self.contexts, self.hot, self.known

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                for at, number in enumerate(batch.column(0).to_pylist()):
                    b = Bucket(batch.column(1)[at].as_py(), contexts, hot)
                    sums, weights = of(number, b, known and here(batch, at, known))
                    for kind, vector in sums.items():
                        total[kind] = total.get(kind, 0) + np.asarray(vector, np.float64)
                    places, inverse = np.unique(b.entry_context, return_inverse=True)
                    yield rows("", number, places, [np.bincount(inverse, weights[k]) for k in kinds])
            for kind, vector in total.items():
                places = np.flatnonzero(vector)
                yield rows(kind, -1, places, [vector[places]] * len(kinds))

        def rows(kind: str, number: int, places: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
            heads = [pa.array([kind] * len(places), pa.string()), pa.array(np.full(len(places), number)), pa.array(places.astype(np.int64))]
            return pa.RecordBatch.from_arrays([*heads, *(pa.array(v.astype(np.float64)) for v in values)], ["kind", "bucket", "place", *columns])

        columns = [f"value_{i}" for i in range(len(kinds))]
        added = written(self.buckets().mapInArrow(add, ", ".join(["kind string, bucket long, place long", *(f"{c} double" for c in columns)])), "restaurants")
        by_place = added.where("kind = ''")
        if self.seated is None:
            self.seated = by_place.select("bucket", "place")
        self.tables.append((kinds, written(by_place.groupBy("place").agg(*[F.sum(c).alias(k) for c, k in zip(columns, kinds, strict=True)]), "totals")))
        out: dict[str, np.ndarray] = {}
        for kind, place, value in added.where("kind != ''").groupBy("kind", "place").agg(F.sum(columns[0])).collect():  # a few, and one a hot word
            out.setdefault(kind, np.zeros(max(len(hot), 2)))[place] = value
        return out

    def total(self, kind: str) -> None:
        return None

    def buckets(self) -> DataFrame:
        """bucket, parts, own: the totals of the bucket's restaurants, where there are any yet."""
        rows = self.stored.where("bucket >= 0").select("bucket", "parts")
        if not self.tables:
            return rows
        own, used = self.seated, [self.tables[0], *self.tables[1:][-2:]]  # customers, and the last two rounds
        for _, totals in used:
            own = own.join(totals, "place")
        kinds = [k for names, _ in used for k in names]
        return rows.join(own.groupBy("bucket").agg(F.collect_list(F.struct("place", *kinds)).alias("own")), "bucket").select("bucket", "parts", "own")

    @staticmethod
    def known(batch: pa.RecordBatch, at: int, totals: Totals) -> Totals:
        """The totals for a row of buckets()."""
        own = batch.column(2)[at].values
        places = own.field("place").to_numpy()
        order = np.argsort(places)
        total = lambda kind: Own(places[order], own.field(kind).to_numpy()[order])
        return replace(totals, customers=total("customers"), samples=[replace(s, tables=total(_tables(totals.round, i))) for i, s in enumerate(totals.samples)])


def _tables(number: int, sample: int) -> str:
    """The kind of a round's and sample's tables by restaurant."""
    return f"tables_{number}_{sample}"


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == 1).sum()), int((c == 2).sum())]


def _discount(n: np.ndarray) -> float:
    return float(min(0.95, max(0.05, n[0] / (n[0] + 2 * n[1])))) if n[0] else 0.5


def _at(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(places, values, size)


def learn(store: Listed | Tabled, rounds: int = 2, sweeps: int = 3, keep: int = 2, seed: int = 6) -> tuple[Totals, Totals]:
    """What the last round's chains start from, and their samples' totals."""
    hot = store.hot

    def count(_: int, b: Bucket, __: None) -> Added:
        seen = b.c > 0
        by_word = np.bincount(b.entry_word[seen], minlength=b.n_words)
        cold = np.ones(b.n_words, bool)
        cold[b.hot_words] = False
        sums = {
            "scalars": [b.c.sum(), (b.of_word[cold] > 0).sum()],
            "seen": [seen.sum()],
            "dishes": _counts_of_counts(b.c),
            "words": _counts_of_counts(by_word[cold]),
            "hot tokens": _at(b.hot_numbers, b.of_word[b.hot_words], len(hot)),
            "hot types": _at(b.hot_numbers, by_word[b.hot_words], len(hot)),
        }
        return sums, {"customers": b.c, _tables(0, 0): seen}

    got = store.summed(count, None, ["customers", _tables(0, 0)])
    get = lambda kind, size: got.get(kind, np.zeros(size))[:size]
    n, v = get("scalars", 2)
    hot_tokens, hot_types = get("hot tokens", len(hot)), get("hot types", len(hot))
    v += (hot_tokens > 0).sum()
    start = Sample(store.total(_tables(0, 0)), (get("seen", 1)[0], v), (hot_types, (hot_types > 0).astype(float)))
    begin = known = Totals(n, v, store.total("customers"), (_discount(get("dishes", 2)), _discount(get("words", 2))), [start], hot, hot_tokens)
    for number in range(1, rounds + 1):
        begin = known

        def seat(bucket: int, b: Bucket, begin: Totals, number: int = number) -> Added:
            sums: dict[str, list | np.ndarray] = {}
            weights: dict[str, np.ndarray] = {}
            for s, (t, sent, parent) in enumerate(chain(b, bucket, begin, sweeps, keep, seed)):
                weights[_tables(number, s)] = t
                cold = parent.sum() - parent[b.hot_words].sum()
                sums[f"parent {s}"] = [sent.sum(), cold]
                sums[f"hot {s}"] = _at(b.hot_numbers, sent[b.hot_words], len(hot))
            return sums, weights

        got = store.summed(seat, begin, [_tables(number, s) for s in range(keep)])
        samples = []
        for s in range(keep):
            (c0, t0), sent = get(f"parent {s}", 2), get(f"hot {s}", len(hot))
            rng = np.random.default_rng([seed, s])
            seats = sample_tables(rng, sent.astype(np.int64), np.full(len(sent), 1 / (v + 1)), t0 + 0 * sent, begin.discounts[1], begin.strength)
            samples.append(Sample(store.total(_tables(number, s)), (c0, t0 + seats.sum()), (sent, seats)))
        known = replace(begin, samples=samples, round=number)
    return begin, known


def probabilities(b: Bucket, number: int, begin: Totals, known: Totals, sweeps: int, keep: int, seed: int) -> np.ndarray:
    """The averaged predictive probability of each entry of a bucket."""
    total, (d1, d0) = np.zeros(len(b.c)), known.discounts
    for (t, sent, parent), sample in zip(chain(b, number, begin, sweeps, keep, seed), known.samples, strict=True):
        tables, (c0, t0) = sample.tables, sample.parent
        sent[b.hot_words], parent[b.hot_words] = (x[b.hot_numbers] for x in sample.hot)
        p0 = (sent - d0 * parent + (known.strength + d0 * t0) / (known.v + 1)) / (known.strength + c0)
        new = known.strength + d1 * tables[b.entry_context]
        total += (b.c - d1 * t + new * p0[b.entry_word]) / (known.strength + known.customers[b.entry_context])
    return total / keep


def partial_scores(store: Listed | Tabled, begin: Totals, known: Totals, sweeps: int, keep: int, seed: int) -> DataFrame:
    """flush, sums: for documents of a flush, what a bucket's words add to n_known, base_score and score."""
    contexts, here = store.contexts, store.known

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number in enumerate(batch.column(0).to_pylist()):
                b = Bucket(batch.column(1)[row].as_py(), contexts, known.hot)
                b.of_word[b.hot_words] = known.hot_tokens[b.hot_numbers]
                log_p = np.log10(probabilities(b, number, here(batch, row, begin), here(batch, row, known), sweeps, keep, seed))
                base = np.log10((b.of_word + 1) / (known.n + known.v + 1))
                flush, sums, at = [], [], 0
                for flush_id, n in zip(b.flushes, b.n_occurrences, strict=True):
                    part = slice(at, at + n)
                    at += n
                    doc, word = b.doc[part], b.word[part]
                    docs = np.flatnonzero(np.bincount(doc))
                    columns = [np.bincount(doc, w)[docs] for w in (base[word], log_p[b.entry[part]])]
                    unknown = np.bincount(doc[b.of_word[word] == 0])
                    lacking = np.flatnonzero(unknown)
                    flush.append(flush_id)
                    sums.append(np.int32(len(docs)).tobytes() + b"".join(c.astype(kind).tobytes() for c, kind in zip((docs, *columns, lacking, unknown[lacking]), SUMS + UNKNOWN, strict=True)))
                out = pa.RecordBatch.from_arrays([pa.array(flush, pa.int64()), pa.array(sums, pa.binary())], ["flush", "sums"])
                del b, log_p, sums
                yield out

    return store.buckets().mapInArrow(score, "flush long, sums binary")


def score_documents(docs: DataFrame, least_contexts: int = CONTEXTS, rounds: int = 2, sweeps: int = 3, keep: int = 2, seed: int = 6) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, train, text); rows with train true are learnt from."""
    store, begin, known, _ = trained(docs, least_contexts, rounds, sweeps, keep, seed)
    with settings(docs.sparkSession, ROW_AT_A_TIME):
        return written(_scored(store, begin, known, sweeps, keep, seed), "scores")


def trained(docs: DataFrame, least_contexts: int = CONTEXTS, rounds: int = 2, sweeps: int = 3, keep: int = 2, seed: int = 6) -> tuple[Listed | Tabled, Totals, Totals, Layout]:
    """The occurrences of docs by bucket with their totals, what the last chains start from, their samples' totals, and the layout."""
    spark = docs.sparkSession
    with settings(spark, {ARROW_ROWS: str(BATCH_ROWS)}):
        plan = layout(docs, least_contexts)
        parts = F.collect_list(F.struct("flush", "n_train", "held")).alias("parts")
        stored = written(occurrences(docs, plan).groupBy("bucket").agg(parts, F.first("n_docs").alias("n_docs")), "occurrences", {"parquet.block.size": 16 << 20})
    with settings(spark, ROW_AT_A_TIME):
        store = (Listed if plan.contexts <= LISTED else Tabled)(stored, plan.contexts, plan.hot)
        begin, known = learn(store, rounds, sweeps, keep, seed)
    return store, begin, known, plan


def _scored(store: Listed | Tabled, begin: Totals, known: Totals, sweeps: int, keep: int, seed: int) -> DataFrame:
    partial = partial_scores(store, begin, known, sweeps, keep, seed)
    heads = store.stored.where("bucket < 0").select(F.col("parts")[0]["flush"].alias("flush"), "n_docs", F.col("parts")[0]["held"].alias("sums"))
    together = heads.unionByName(partial.withColumn("n_docs", F.lit(-1)))
    n_train = int(known.n)

    def add(data: pa.Table) -> pa.Table:
        n_docs, blobs = np.asarray(data.column("n_docs")), data.column("sums").to_pylist()
        head = int(np.flatnonzero(n_docs >= 0)[0])
        n = int(n_docs[head])
        ids, tokens = np.frombuffer(blobs[head], np.int64, n), np.frombuffer(blobs[head], np.int64, n, 8 * n)
        total = np.zeros((3, n))
        for i, blob in enumerate(blobs):
            if i != head:
                m, at, columns = int(np.frombuffer(blob, np.int32, 1)[0]), 4, []
                k = (len(blob) - 4 - 18 * m) // 6
                for kind, n_values in zip(SUMS + UNKNOWN, (m, m, m, k, k), strict=True):
                    size = n_values * np.dtype(kind).itemsize
                    columns.append(np.frombuffer(blob[at : at + size], kind))
                    at += size
                total[1:, columns[0]] += columns[1:3]
                total[0, columns[3]] += columns[4]
        columns = [pa.array(ids, mask=ids == NULL_ID), pa.array(tokens), pa.array(tokens - np.rint(total[0]).astype(np.int64)), pa.array(np.full(n, n_train)), pa.array(total[1]), pa.array(total[2])]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return together.groupBy("flush").applyInArrow(add, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scores: DataFrame) -> float:
    """10 ** (-log10 probability of a token)."""
    total, n = scores.agg(F.sum("score"), F.sum("n_tokens")).first()
    return 10 ** (-total / n) if n else math.nan


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc32_mod(F.col("doc_id"), 7) == 2
    scores = score_documents(table(spark, sf_dir, "documents").select("doc_id", (~held_out).alias("train"), "text"))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
