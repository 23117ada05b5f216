"""The language of texts and of readers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import MARKERS

LOCALES = ("en", "it")
#: Words that a text and a sentence must have, hits that the winner must have and by how much more, and the share of sentences that makes a text mixed.
MIN_WORDS, MIN_SENTENCE_WORDS, MIN_HITS, MIN_MARGIN, MIXED_SHARE = 8, 5, 2, 1.5, 0.25


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{M}]+"), lambda t: t != "")


def marker_hits(text: Column) -> Column:
    """(words, en, it): how many words a text has, and how many of each language's markers stand in lower case."""
    tokens = _tokens(text)
    small = F.filter(tokens, lambda t: F.substring(t, 1, 1) == F.lower(F.substring(t, 1, 1)))

    def hits(locale: str) -> Column:
        return F.size(F.filter(small, lambda t: F.lower(t).isin(MARKERS[locale]))).alias(locale)

    return F.struct(F.size(tokens).alias("words"), *map(hits, LOCALES))


def _decided(counted: Column, least: int) -> Column:
    en, it = counted["en"], counted["it"]
    best, second = F.greatest(en, it), F.least(en, it)
    clear = (counted["words"] >= least) & (best >= MIN_HITS) & (best >= second * MIN_MARGIN)
    return F.when(clear, F.when(en >= it, F.lit("en")).otherwise(F.lit("it")))


def detected(text: Column) -> Column:
    """'en', 'it', or null for a text that is short, undecided or mixed."""
    parts = F.split(text, r"(?<=[.!?;:\n])\s+")
    votes = F.transform(parts, lambda s: _decided(marker_hits(s), MIN_SENTENCE_WORDS))

    def of(counted: Column, votes: Column) -> Column:
        whole = _decided(counted, MIN_WORDS)
        all_votes = F.size(F.filter(votes, lambda v: v.isNotNull()))
        lost = F.size(F.filter(votes, lambda v: v.isNotNull() & (v != whole)))
        return F.when((all_votes > 1) & (lost / F.greatest(all_votes, F.lit(1)) >= MIXED_SHARE), None).otherwise(whole)

    one = F.array(F.struct(marker_hits(text).alias("counted"), votes.alias("votes")))  # each is computed once
    return F.get(F.transform(one, lambda x: of(x["counted"], x["votes"])), 0)


def primary(tag: Column) -> Column:
    """The locale of a language tag, null where it is none of ours."""
    first = F.element_at(F.split(F.lower(F.trim(tag)), "[-_]"), 1)
    return F.when(first.isin(*LOCALES), first)


def writing_language(target: Column, target_body: Column, trigger: Column, trigger_body: Column) -> Column:
    """The stored language of the target, the one of its text, the same of what triggered the change, else English."""
    return F.coalesce(primary(target), detected(target_body), primary(trigger), detected(trigger_body), F.lit("en"))


def kept_language(stored: Column, source: Column, found: Column) -> Column:
    """What a person has set stays; else what was found."""
    return F.when(source == "human", stored).otherwise(found)


def accepted(header: Column) -> Column:
    """The tags of an Accept-Language header by falling weight; ties keep their order, weight 0 is dropped."""

    def entry(part: Column, i: Column) -> Column:
        fields = F.transform(F.split(part, ";"), lambda p: F.trim(p))
        weights = F.filter(F.slice(fields, 2, 100), lambda p: p.rlike(r"^q\s*(=|$)"))
        given = F.trim(F.element_at(F.split(F.element_at(weights, -1), "="), 2))
        weight = F.when(F.size(weights) == 0, F.lit(1.0)).otherwise(F.coalesce(given.try_cast("double"), F.lit(0.0)))
        return F.struct((-weight).alias("weight"), i.alias("at"), F.lower(F.get(fields, 0)).alias("tag"))

    entries = F.filter(F.transform(F.split(header, ","), entry), lambda e: (e["tag"] != "") & (e["weight"] < 0))
    return F.transform(F.array_sort(entries), lambda e: e["tag"])


def negotiated(preference: Column, cookie: Column, header: Column) -> Column:
    """The reader's choice, the cookie, the header's first locale before any '*', else English."""
    tags = accepted(header)
    star = F.array_position(tags, F.lit("*"))
    before = F.when(star > 0, F.slice(tags, F.lit(1), (star - 1).cast("int"))).otherwise(tags)
    known = F.filter(F.transform(before, primary), lambda t: t.isNotNull())
    return F.coalesce(primary(preference), primary(cookie), F.get(known, 0), F.lit("en"))
