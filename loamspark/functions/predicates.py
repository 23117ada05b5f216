"""Predicates and decisions as column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reasons as people write them, tiers of artifacts, the share of a budget that a tier leaves alone.
REASONS = {"wrong": "wrong", "already true": "already_true", "already_true": "already_true", "not canon yet": "not_canon_yet", "not_canon_yet": "not_canon_yet", "too much": "too_much", "too_much": "too_much", "prose": "prose"}
RESERVES = {"media": 0.3, "draft": 0.1, "text": 0.0}
TIERS = ["text", "draft", "media"]
REASON_WEIGHTS = {"wrong": -1.0, "already_true": -1.0, "too_much": -0.4, "not_canon_yet": 0.0, "prose": 0.0, "other": 0.0}


def lookup(values: dict[str, object], key: Column) -> Column:
    """The value of a key in a literal map, null where it has none."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def all_of(given: Iterable[Column | None]) -> Column:
    """The conjunction of the conditions that are given; none is true."""
    return reduce(and_, [c for c in given if c is not None], F.lit(True))


def equals_or_null(column: Column, key: object) -> Column:
    return column.eqNullSafe(F.lit(key))


def global_or_owned(owner: Column, universe: object) -> Column:
    return owner.isNull() | (owner == universe)


def within_days(ts: Column, anchor: Column, days: int) -> Column:
    """Not older than so many days before the anchor; 0 lets everything through."""
    return F.lit(True) if not days else ts >= anchor - F.expr(f"interval {days} days")


def matches_any(term: str, name: Column, aliases: Column, body: Column) -> Column:
    """Case-insensitive substring of the name, any alias or the body; % and _ of the term are wildcards."""
    pattern = f"%{term}%"
    return name.ilike(pattern) | F.exists(aliases, lambda a: a.ilike(pattern)) | body.ilike(pattern)


def visible(visibility: Column) -> Column:
    return visibility != "gm_only"


def empty_object(json: Column) -> Column:
    """Whether a JSON text is an object without keys."""
    return F.size(F.json_object_keys(json)) == 0


def glob_pattern(pattern: Column) -> Column:
    """A regular expression for a pattern in which * stands for anything: case-insensitive, for the whole text."""
    quoted = F.regexp_replace(pattern, r"[.+?^${}()|\[\]\\]", r"\\$0")
    return F.concat(F.lit("(?is)^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("$"))


def other_end(edge_from: Column, edge_to: Column, seen_from: Column) -> Column:
    return F.when(edge_from == seen_from, edge_to).otherwise(edge_from)


def label_from(edge_from: Column, seen_from: Column, label: Column, inverse: Column) -> Column:
    return F.when(edge_from == seen_from, label).otherwise(inverse)


def style(override: Column, universe: Column) -> tuple[Column, Column]:
    """The style and where it is from: the entry's (an empty one too), else the universe's, else none."""
    return F.coalesce(override, universe), F.when(override.isNotNull(), "entry").when(universe.isNotNull(), "universe").otherwise("none")


def reason(raw: Column) -> Column:
    return F.coalesce(lookup(REASONS, F.lower(F.trim(raw))), F.lit("other"))


def quota(jobs_quota: Column, jobs: Column, documents_quota: Column, documents: Column, asked: Column, credits: Column, cost: Column) -> Column:
    """Why an import is not allowed, null where it is: jobs, then documents, then credits. A quota that is null is no limit."""
    return F.when(jobs_quota.isNotNull() & (jobs + 1 > jobs_quota), "jobs_quota").when(documents_quota.isNotNull() & (documents + asked > documents_quota), "documents_quota").when(credits < cost, "insufficient_credits")


def may_spend(tier: Column, total: Column, remaining: Column, cost: Column) -> Column:
    """Whether the budget keeps the tier's reserve after the cost."""
    return remaining - cost >= lookup(RESERVES, tier) * total


def radius(rate: Column) -> Column:
    return F.when(rate < 0.3, 1).otherwise(2)


def effective_cap(cap: Column, recent: Column) -> Column:
    """The cap less how often 'too much' is among the recent reasons, 3 at least; no cap stays none."""
    many = F.size(F.filter(recent, lambda r: reason(r) == "too_much"))
    return F.when(cap.isNotNull(), F.greatest(F.lit(3), cap - many))


def merged_params(old: Column, new: Column, owned: list[str]) -> Column:
    """Two JSON objects (of texts) as one: foreign keys of the old, owned keys of the new."""
    texts = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    foreign = F.map_filter(texts(old), lambda k, _: ~k.isin(owned))
    mine = F.map_filter(texts(new), lambda k, v: k.isin(owned) & v.isNotNull())
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(foreign, mine)))))


# What supports a proposal that an edit led to; the first two are links of the canon.
EVIDENCE_KINDS = ["relation", "mention", "embedding", "instruction"]


def evidence_views(trigger: Column, evidence: Column) -> Column:
    """(views, caveat) of a proposal's evidence, a JSON text.

    A view is (quote, kind, path, hops, direction, matched, source, count), with what its kind has and nulls else. An edit's evidence is a list
    of what supports it; entries that are none of EVIDENCE_KINDS are left out. An import's is an object with a sourceRef: one view without a
    quote, by whether a match was ambiguous ('importAmbiguous', of so many others), likely ('importMatched') or not needed ('importExtracted').
    The caveat is 'embeddingOnly' or 'instructionOnly' where nothing stronger supports the proposal; it is null where a relation or mention
    does, or an import was extracted. Nulls, broken JSON and other shapes have no views and no caveat.
    """
    given = F.try_parse_json(evidence)
    of = lambda v, path, kind: F.try_variant_get(v, path, kind)
    type_of = lambda path: F.schema_of_variant(of(given, path, "variant"))
    empty = {"quote": "string", "kind": "string", "path": "array<string>", "hops": "int", "direction": "string", "matched": "string", "source": "string", "count": "int"}

    def view(**has: Column) -> Column:
        return F.struct(*[has.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in empty.items()])

    def linked_view(e: Column) -> Column:
        kind, sentence = of(e, "$.kind", "string"), of(e, "$.sourceSentence", "string")
        relation = view(kind=kind, path=of(e, "$.path", "array<string>"), hops=of(e, "$.hops", "int"))
        mention = view(quote=sentence, kind=kind, direction=of(e, "$.direction", "string"), matched=of(e, "$.matchedText", "string"))
        other = view(quote=F.when(kind == "instruction", of(e, "$.instruction", "string")).otherwise(sentence), kind=kind)
        return F.when(kind == "relation", relation).when(kind == "mention", mention).otherwise(other)

    entries = F.filter(of(given, "$", "array<variant>"), lambda e: of(e, "$.kind", "string").isin(EVIDENCE_KINDS))
    views = F.coalesce(F.transform(entries, linked_view), F.array().cast(f"array<struct<{', '.join(f'{n}: {k}' for n, k in empty.items())}>>"))
    said = F.transform(views, lambda v: v["kind"])
    told = F.when(F.array_contains(said, "instruction"), "instructionOnly").otherwise("embeddingOnly")
    linked = F.array_contains(said, "relation") | F.array_contains(said, "mention")
    edited = F.struct(views.alias("views"), F.when((F.size(said) > 0) & ~linked, told).alias("caveat"))

    source = F.when(type_of("$.sourceRef.path") == "STRING", of(given, "$.sourceRef.path", "string"))
    likely = F.coalesce(type_of("$.similarity").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    others = F.coalesce(F.size(of(given, "$.ambiguousCandidateIds", "array<variant>")), F.lit(0))
    kind = F.when(likely & (others > 0), "importAmbiguous").when(likely, "importMatched").otherwise("importExtracted")
    found = view(kind=kind, source=source, count=F.when(likely & (others > 0), others))
    is_import = F.coalesce(F.array_contains(F.json_object_keys(evidence), "sourceRef"), F.lit(False))
    imported = F.struct(F.when(is_import, F.array(found)).otherwise(F.slice(views, 1, 0)).alias("views"), F.when(is_import & likely, "embeddingOnly").alias("caveat"))
    return F.when(trigger == "import", imported).otherwise(edited)


def evidence_caveat(trigger: Column, evidence: Column) -> Column:
    """The caveat of evidence_views."""
    return evidence_views(trigger, evidence)["caveat"]


def job_estimate(documents: Column, seconds: Column, credits: Column, factor: int = 6) -> Column:
    """(minutes, credits, budget, timeout_ms) of an import job: a minute and five minutes at least."""
    minutes, cost = F.greatest(F.lit(1), F.ceil(documents * seconds / 60)), F.ceil(documents * credits)
    return F.struct(minutes.cast("long").alias("minutes"), cost.cast("long").alias("credits"), (cost * factor).cast("long").alias("budget"), F.greatest(F.lit(300_000), minutes * 60_000 * 3).cast("long").alias("timeout_ms"))


# The text of a failed run, and the reason it stands for.
RUN_REASONS = {
    "this document's step ceiling was reached": "step_ceiling",
    "cancelled before this step started": "cancelled_before_step",
    "cancelled mid-step": "cancelled_mid_step",
    "every tool call in this step failed to parse, most likely truncated by the output limit": "tool_calls_unparseable",
    "this step's worst case would not fit this job's remaining credit budget": "step_worst_case_exceeds_budget",
    "this job's credit budget is exhausted": "job_budget_exhausted",
    "never started": "never_started",
}
LOOP = r"^stuck in a loop: (.+) was called with identical arguments (\d+) times in a row, so this document was ended rather than run to its step ceiling$"


def run_reason(detail: Column) -> Column:
    """(reason, detail): the reason code of a run's detail, and the error's or tool's name or the text itself."""
    failed, loop = F.regexp_extract(detail, "^model call failed: (.+)$", 1), F.regexp_extract(detail, LOOP, 1)
    code = F.coalesce(lookup(RUN_REASONS, detail), F.when(failed != "", "model_call_failed").when(loop != "", "loop_guard").otherwise("other"))
    about = F.when(code == "model_call_failed", failed).when(code == "loop_guard", loop).when(code == "other", detail)
    return F.struct(code.alias("reason"), about.alias("about"))
