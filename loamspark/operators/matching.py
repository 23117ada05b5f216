"""Matching proposed entities to known ones, and relation labels to known types."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from . import similarity

# At or above which similarity a candidate is the same entity, and below which none is.
LEXICAL_BAND, EMBEDDING_BAND = (0.85, 0.5), (0.75, 0.6)
REUSE = 0.86


def name_text(name: Column, aliases: Column) -> Column:
    """The match form of the name and aliases as one text."""
    return fn.match_form(F.array_join(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), " "))


def name_words(name: Column, aliases: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name_text(name, aliases), " "), lambda w: w != ""))


def set_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def narrowed_others(subjects: DataFrame, candidates: DataFrame, limit: int = 20) -> DataFrame:
    """narrowed for subjects that are candidates too, by the same ids: each subject's own row is left out. It is among one more than the limit or not needed to fill it."""
    more = narrowed(subjects, candidates, limit + 1).where("subject <> candidate")
    place = F.row_number().over(Window.partitionBy("subject").orderBy("place"))
    return more.withColumn("place", place).where(F.col("place") <= limit)


def narrowed(subjects: DataFrame, candidates: DataFrame, limit: int = 20) -> DataFrame:
    """subject, type, candidate, overlap, place: for each subject the ``limit`` candidates of its type with most words of the name in common, ties by ``nth``.

    subjects has subject, type, words; candidates has candidate, type, words, nth. Where all candidates of a type are within the limit, all are
    taken. Candidates with equal words are one class, of which only the first ``limit`` members can be among the best; subjects and classes meet
    by rare words, within what their sizes and the best found so far allow (similarity.best_overlaps), and the first ``limit`` candidates of a type fill up
    places that no common word earns.
    """
    words = F.array_sort("words")
    within = F.row_number().over(Window.partitionBy("type", "class").orderBy("nth"))
    members = candidates.withColumn("class", F.xxhash64(words)).withColumn("_m", within).where(F.col("_m") <= limit).drop("_m")
    classes = members.groupBy("type", "class").agg(F.first("words").alias("tokens"), F.count("*").alias("weight"))
    asked = subjects.select("type", F.xxhash64(words).alias("asked"), F.col("words").alias("tokens")).dropDuplicates(["type", "asked"])
    sets = classes.select("type", F.col("class").alias("set"), F.col("class").alias("owner"), "weight", "tokens")
    near = similarity.best_overlaps(sets, asked.withColumnRenamed("asked", "question"), limit, ["type"])
    scored = near.select("type", F.col("question").alias("asked"), F.col("set").alias("class"), F.col("score").alias("overlap")).where("overlap > 0")
    scored = scored.join(members.select("type", "class", "candidate", "nth"), ["type", "class"]).select("type", "asked", "candidate", "nth", "overlap")
    first = F.row_number().over(Window.partitionBy("type").orderBy("nth"))
    fill = candidates.withColumn("_f", first).where(F.col("_f") <= limit).select("type", "candidate", "nth")
    filled = asked.select("type", "asked").join(fill, "type").join(scored.select("type", "asked", "candidate"), ["type", "asked", "candidate"], "left_anti").withColumn("overlap", F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("type", "asked").orderBy(F.desc("overlap"), "nth"))
    best = scored.unionByName(filled).withColumn("place", place).where(F.col("place") <= limit)
    return subjects.select("subject", "type", F.xxhash64(words).alias("asked")).join(best, ["type", "asked"]).select("subject", "type", "candidate", "overlap", "place")


def decisions(subjects: DataFrame, scored: DataFrame, exact: DataFrame, band: tuple[float, float] = LEXICAL_BAND) -> DataFrame:
    """subject, outcome, candidates, similarity: 'exact' by reference, else 'match', 'ask' or 'new' by the band.

    scored has subject, candidate, similarity, overlap; exact has subject, candidate. 'ask' lists all candidates within the band, best first.
    """
    above, below = band
    order = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), (-F.col("overlap")).alias("o"), "place", "candidate")))
    best = scored.where(F.col("similarity") >= below).groupBy("subject").agg(order.alias("r"))  # at most as many as were narrowed
    top = F.get("r", 0)
    in_band = F.transform(F.filter("r", lambda x: -x["s"] < above), lambda x: x["candidate"])
    found = subjects.select("subject").join(exact.select("subject", F.col("candidate").alias("known")), "subject", "left").join(best, "subject", "left")
    outcome = F.when(F.col("known").isNotNull(), "exact").when(F.col("r").isNull(), "new").when(-top["s"] >= above, "match").otherwise("ask")
    out = found.withColumn("outcome", outcome)
    given = F.when(F.col("outcome") == "exact", F.array("known")).when(F.col("outcome") == "match", F.array(top["candidate"])).when(F.col("outcome") == "ask", in_band)
    return out.select("subject", "outcome", given.alias("candidates"), F.when(F.col("outcome").isin("match", "ask"), -top["s"]).alias("similarity"))


def band_costs(pairs: DataFrame, above: list[float], below: list[float], merge_cost: float = 5.0, ask_cost: float = 0.5, many: str | None = None) -> DataFrame:
    """A row for each (match_above, new_below) with what pairs (similarity, same; each ``many`` times) come to: outcomes, recall, precision, costs.

    Pairs are counted by the bounds they lie between first, so the grid meets some hundred rows whatever the number of pairs.
    """
    bounds = sorted({*above, *below})
    cell = sum((F.when(F.col("similarity") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    cells = pairs.groupBy("same", cell.alias("cell")).agg((F.sum(many) if many else F.count("*")).alias("n"))
    grid = [(a, b, bounds.index(a) + 1, bounds.index(b) + 1) for a in above for b in below if b <= a]
    sweep = pairs.sparkSession.createDataFrame(grid, "match_above double, new_below double, _a int, _b int")
    met = F.broadcast(sweep).join(cells, F.lit(True))  # both sides have as many rows as there are bounds, or that squared
    sums = lambda same, when: F.sum(F.when((F.col("same") == same) & when, F.col("n")).otherwise(0))
    match, new = F.col("cell") >= F.col("_a"), F.col("cell") < F.col("_b")
    ask = ~match & ~new
    out = met.groupBy("match_above", "new_below").agg(
        sums(True, match).alias("correct_matches"), sums(False, new).alias("correct_news"), sums(False, match).alias("false_merges"), sums(True, new & ~match).alias("false_splits"),
        sums(True, ask).alias("asks_on_positives"), sums(False, ask).alias("asks_on_negatives"), sums(True, F.lit(True)).alias("_positives"),
    )
    matched = F.col("correct_matches") + F.col("false_merges")
    weighted = F.col("false_merges") * merge_cost + F.col("false_splits")
    total = weighted + (F.col("asks_on_positives") + F.col("asks_on_negatives")) * ask_cost
    recall = F.when(F.col("_positives") == 0, 0.0).otherwise(F.col("correct_matches") / F.col("_positives"))
    precision = F.when(matched == 0, 1.0).otherwise(F.col("correct_matches") / matched)
    return out.select(*[c for c in out.columns if c != "_positives"], F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), weighted.alias("weighted_cost"), total.alias("total_cost"))


def fragile(pairs: DataFrame, match_above: float, new_below: float, floor: float = 0.001) -> DataFrame:
    """id, risk: pairs (id, similarity, spread, same) nearer to a bound than they jitter: 'error' at the bound that would make a mistake of them, else 'ask'."""
    margin = F.greatest(F.col("spread"), F.lit(floor))
    error = F.abs(F.col("similarity") - F.when(F.col("same"), new_below).otherwise(match_above)) < margin
    ask = F.abs(F.col("similarity") - F.when(F.col("same"), match_above).otherwise(new_below)) < margin
    return pairs.select("id", F.when(error, "error").when(ask, "ask").alias("risk")).where("risk is not null")


def preferred(types: DataFrame, key: str, owner: str, order: str) -> DataFrame:
    """One row of each key: the first that is owned, else the first."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(owner).isNull(), order))
    return types.withColumn("_p", place).where("_p = 1").drop("_p")


def admitted(allowed_from: Column, allowed_to: Column, source: Column, target: Column) -> Column:
    """Whether both ends' types are among those that a relation type allows."""
    return F.array_contains(allowed_from, source) & F.array_contains(allowed_to, target)


def relation_types(asked: DataFrame, types: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """id, kind, type, swapped: which relation type each asked label (id, label, source, target: the types of its ends) takes.

    A type's label first, then its inverse label with the ends swapped, then a similar type (similar: id, type, similarity of at least REUSE);
    owned types before shipped ones, then by ``nth``. Where the type does not admit the ends it is to be widened (owned) or made anew (shipped).
    types has type, owner, label, inverse, allowed_from, allowed_to, nth.
    """
    want = asked.withColumn("_key", fn.relation_label(F.col("label")))
    facts = ["type", "owner", "allowed_from", "allowed_to", "nth"]
    forward = want.join(types.select(fn.relation_label(F.col("label")).alias("_key"), *facts), "_key").withColumn("_way", F.lit(0)).withColumn("_sim", F.lit(0.0))
    inverse = want.join(types.select(fn.relation_label(F.col("inverse")).alias("_key"), *facts), "_key").withColumn("_way", F.lit(1)).withColumn("_sim", F.lit(0.0))
    found = forward.unionByName(inverse)
    if similar is not None:
        near = want.join(similar.where(F.col("similarity") >= REUSE), "id").join(types.select(*facts), "type")
        found = found.unionByName(near.withColumn("_way", F.lit(2)).withColumn("_sim", F.col("similarity")).select(found.columns))
    place = F.row_number().over(Window.partitionBy("id").orderBy("_way", F.desc("_sim"), F.col("owner").isNull(), "nth"))
    best = found.withColumn("_p", place).where("_p = 1")
    swapped = F.col("_way") == 1
    ok = F.when(swapped, admitted(F.col("allowed_from"), F.col("allowed_to"), F.col("target"), F.col("source"))).otherwise(admitted(F.col("allowed_from"), F.col("allowed_to"), F.col("source"), F.col("target")))
    kind = F.when(ok & (F.col("_way") == 2), "reuse-proposed").when(ok, "existing").when(F.col("owner").isNotNull(), "widen-proposed").otherwise("new-proposed")
    chosen = best.select("id", kind.alias("kind"), "type", swapped.alias("swapped"))
    return asked.select("id").join(chosen, "id", "left").select("id", F.coalesce("kind", F.lit("new-proposed")).alias("kind"), "type", F.coalesce("swapped", F.lit(False)).alias("swapped"))


def hash_bucket(token: Column, dimensions: int) -> Column:
    """The place of a token in a hashed vector: FNV-1a over its UTF-16 units, as a signed 32-bit number without sign, modulo the dimensions.

    Characters beyond the basic plane are two units each.
    """
    codes = F.flatten(F.transform(F.split(token, ""), _units))
    mixed = F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619).cast("bigint"), F.lit(1 << 32)))
    return (F.least(mixed, F.lit(1 << 32) - mixed) % dimensions).cast("int")


def _units(char: Column) -> Column:
    code = F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("bigint")
    beyond = code - 0x10000
    return F.when(F.length(char) == 0, F.array().cast("array<bigint>")).when(code < 0x10000, F.array(code)).otherwise(F.array(F.floor(beyond / 1024) + 0xD800, F.pmod(beyond, F.lit(1024)) + 0xDC00))


def _hash_places(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, dimensions: int) -> np.ndarray:
    """hash_bucket of the tokens of an array of code points, a character of all tokens that still have one at a time."""
    h = np.full(len(begin), 2166136261, np.uint64)
    order = np.argsort(-size, kind="stable")
    at, most = begin[order], int(size.max(initial=0))
    for k, n in enumerate(np.searchsorted(-size[order], -np.arange(1, most + 1), "right").tolist()):
        code = codes[at[:n] + k].astype(np.uint64)
        beyond = code > 0xFFFF
        first = np.where(beyond, ((code - np.uint64(0x10000)) >> np.uint64(10)) + np.uint64(0xD800), code)
        h[:n] = ((h[:n] ^ first) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
        if beyond.any():
            second = ((code - np.uint64(0x10000)) & np.uint64(0x3FF)) + np.uint64(0xDC00)
            h[:n] = np.where(beyond, ((h[:n] ^ second) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF), h[:n])
    out = np.empty(len(h), np.int64)
    out[order] = np.minimum(h, np.uint64(1 << 32) - h).astype(np.int64) % dimensions
    return out


def _hashed(texts: pd.Series, tokens: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], dimensions: int) -> pd.Series:
    """How often each place is hit by the tokens of each text, as a vector of length one; zeros where there is no token, null for null. One pass over the tokens."""
    out = []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        hits = np.bincount(_hash_places(codes, *tokens(codes), dimensions), minlength=dimensions).astype(np.float64)
        norm = np.sqrt((hits * hits).sum())
        out.append(hits / norm if norm else hits)
    return pd.Series(out)


def _word_places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57)), [False]]).astype(np.int8)
    edge = np.diff(inside)
    begin = np.flatnonzero(edge == 1)
    return begin, np.flatnonzero(edge == -1) - begin


def _run_places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.arange(max(0, len(codes) - 2))
    return begin, np.full(len(begin), 3)


def word_vector(text: Column, dimensions: int = 256) -> Column:
    """How often each place is hit by a text's ASCII words, repeats counted, as a vector of length one."""
    return F.pandas_udf(lambda t: _hashed(t, _word_places, dimensions), "array<double>")(F.lower(text))


def trigram_vector(text: Column, dimensions: int = 256) -> Column:
    """How often each place is hit by a text's runs of three characters, two blanks before it and behind, as a vector of length one."""
    padded = F.concat(F.lit("  "), fn.trimmed(F.regexp_replace(F.lower(text), rf"{fn.BLANK}+", " ")), F.lit("  "))
    return F.pandas_udf(lambda t: _hashed(t, _run_places, dimensions), "array<double>")(padded)
