"""State that follows from logs of writes: confirmations, debounced rows, budgets, decisions, revisions, vocabularies and publishing plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_kept(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """One row of each key with the time of its first write that has one: later ones do not move it."""
    return rows.groupBy(*key).agg(F.min(at).alias(at), F.count("*").alias("writes"))


def coalesced(writes: DataFrame, key: list[str], at: str, old: str, new: str, gap: str) -> DataFrame:
    """key, old, new, run_after, writes: pending writes of a key as one row, as long as each comes within the gap of the one before: the first old value, the last new one, and the gap's end.

    Works on streams too (with a watermark on ``at``): a session window holds one row of state for each open key.
    """
    session = F.session_window(at, gap)
    grouped = writes.groupBy(*key, session.alias("w")).agg(F.min_by(old, at).alias(old), F.max_by(new, at).alias(new), F.count("*").alias("writes"))
    return grouped.select(*key, old, new, F.col("w.end").alias("run_after"), "writes")


def spent(steps: DataFrame, job: str, order: str, cost: str, budget: str) -> DataFrame:
    """steps with accepted and spent: a step that does not fit what its job has left is rejected, and later ones may still fit.

    Decisions depend on those before, so a job's steps are folded in order: streamed in sorted batches, with one number of state for each job.
    """

    def fold(frames):
        job_now, used = object(), 0.0
        for frame in frames:
            accepted, total = [], []
            for j, c, b in zip(frame[job], frame[cost], frame[budget], strict=True):
                if j != job_now:
                    job_now, used = j, 0.0
                fits = used + c <= b
                used += c if fits else 0.0
                accepted.append(fits)
                total.append(used)
            yield frame.assign(accepted=accepted, spent=total)

    dealt = steps.where(F.col(job).isNotNull()).repartition(job).sortWithinPartitions(job, order)
    return dealt.mapInPandas(fold, steps.select("*", F.lit(True).alias("accepted"), F.lit(0.0).alias("spent")).schema)


def gated(steps: DataFrame, job: str, order: str, worst: str, cost: str, proposes: str, budget: str, reserve: str) -> DataFrame:
    """steps with allowed: whether the worst case of a step fits its job's budget; before a first proposal the reserve may be drawn on once.

    A step that is not allowed ends its job: later ones are not allowed either. Costs count for steps that ran.
    """

    def fold(frames):
        job_now, used, proposed, drawn, ended = object(), 0.0, False, False, False
        for frame in frames:
            out = []
            for j, w, c, p, b, r in zip(frame[job], frame[worst], frame[cost], frame[proposes], frame[budget], frame[reserve], strict=True):
                if j != job_now:
                    job_now, used, proposed, drawn, ended = j, 0.0, False, False, False
                fits = used + w <= b
                if not fits and not proposed and not drawn and used + w <= b + r:
                    fits = drawn = True
                ended = ended or not fits
                out.append(not ended)
                if not ended:
                    used, proposed = used + c, proposed or bool(p)
            yield frame.assign(allowed=out)

    dealt = steps.where(F.col(job).isNotNull()).repartition(job).sortWithinPartitions(job, order)
    return dealt.mapInPandas(fold, steps.select("*", F.lit(True).alias("allowed")).schema)


def repeats(calls: DataFrame, group: str, order: str, call: Column, warn: int = 3, end: int = 4) -> DataFrame:
    """calls with run (how many equal calls in a row this is) and verdict: null, 'warn' at the third and 'end' from the fourth on."""
    in_order = Window.partitionBy(group).orderBy(order)
    marked = calls.withColumn("_call", call)
    fresh = F.when(F.col("_call").eqNullSafe(F.lag("_call").over(in_order)) & (F.row_number().over(in_order) > 1), 0).otherwise(1)
    runs = marked.withColumn("_run", fresh).withColumn("_run", F.sum("_run").over(in_order))
    n = F.row_number().over(Window.partitionBy(group, "_run").orderBy(order))
    return runs.withColumn("run", n).withColumn("verdict", F.when(F.col("run") >= end, "end").when(F.col("run") == warn, "warn")).drop("_call", "_run")


def transitions(log: DataFrame, key: str, order: str, action: str) -> DataFrame:
    """log with state (after the action) and valid: 'accept' and 'reject' decide a pending proposal, repeating a decision changes nothing, 'undo' makes it pending again, anything else on a decided one is an error.

    An undo always leads to 'pending', so between two of them the first decision holds: no fold is needed, a window over the key's log gives it.
    """
    in_order = Window.partitionBy(key).orderBy(order)
    parts = log.withColumn("_undo", F.sum(F.when(F.col(action) == "undo", 1).otherwise(0)).over(in_order))
    decision = F.when(F.col(action).isin("accept", "reject"), F.col(action))
    held = parts.withColumn("_first", F.first(decision, True).over(Window.partitionBy(key, "_undo").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    state = F.when(F.col("_first") == "accept", "accepted").when(F.col("_first") == "reject", "rejected").otherwise("pending")
    known = F.col(action).isin("accept", "reject", "undo")
    valid = known & ((F.col(action) == "undo") | F.col(action).eqNullSafe(F.col("_first")))
    return held.withColumn("state", state).withColumn("valid", F.coalesce(valid, F.lit(False))).drop("_undo", "_first")


def current(revisions: DataFrame, entity: str, order: str) -> DataFrame:
    """The latest revision of each entity: its current state."""
    return revisions.groupBy(entity).agg(F.max_by(F.struct(*revisions.columns), order).alias("r")).select("r.*")


def accepted_revisions(entities: DataFrame, accepted: DataFrame) -> DataFrame:
    """The entities after accepted proposals, in order of their decision: entity, slug, name, body, revisions.

    entities has entity, slug, name, body; accepted has proposal, kind ('update', 'create', 'flag'), entity, slug, name, body, decided. A flag
    cannot be accepted and changes nothing; a create whose slug is taken becomes an update of the entity that has it. Texts that are null stay
    as they were. Each entity's state is its last text in order, so one shuffle on the entity does it.
    """
    real = accepted.where(F.col("kind").isin("update", "create"))
    taken = entities.select(F.col("slug").alias("_slug"), F.col("entity").alias("_known"))
    new = real.where("kind = 'create'").join(taken, F.col("slug") == F.col("_slug"), "left")
    first = F.first("proposal").over(Window.partitionBy("slug").orderBy("decided", "proposal"))
    new = new.withColumn("entity", F.coalesce("_known", F.concat(F.lit("new-"), first.cast("string")))).select(accepted.columns)
    writes = real.where("kind = 'update'").join(entities.select("entity"), "entity", "left_semi").select(accepted.columns).unionByName(new)
    log = entities.select("entity", "slug", "name", "body", F.lit(None).cast(accepted.schema["decided"].dataType).alias("decided"), F.lit(0).alias("write"))
    log = log.unionByName(writes.select("entity", "slug", "name", "body", "decided", F.lit(1).alias("write")))
    order = F.struct("write", "decided")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    return log.groupBy("entity").agg(F.min_by("slug", order).alias("slug"), last("name"), last("body"), F.sum("write").alias("revisions"))


def vocabulary(proposals: DataFrame, pending: DataFrame, key: Column, relation: str) -> DataFrame:
    """key, label, relations, times: pending rows (key, label, relations) with the relations of proposals of their key appended, and new rows for other keys.

    The label that came first stays. proposals has label, the relation and nth; relations are in the order they came, without repeats.
    """
    old = pending.select("key", "label", F.posexplode_outer("relations").alias("_at", "_relation")).select("key", "label", F.lit(0).alias("_new"), F.col("_at").cast("bigint").alias("_at"), "_relation")
    new = proposals.select(key.alias("key"), "label", F.lit(1).alias("_new"), F.col("nth").cast("bigint").alias("_at"), F.col(relation).alias("_relation"))
    both = old.unionByName(new).withColumn("_order", F.struct("_new", "_at"))
    each = both.where("_relation is not null").groupBy("key", "_relation").agg(F.min("_order").alias("_order"))
    lists = each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_order", "_relation"))), lambda x: x["_relation"]).alias("relations"))
    heads = both.groupBy("key").agg(F.min_by("label", "_order").alias("label"), F.sum("_new").alias("times"))
    return heads.join(lists, "key", "left").select("key", "label", F.coalesce("relations", F.array().cast("array<string>")).alias("relations"), "times")


def publish_problems(plan: DataFrame, entities: DataFrame) -> DataFrame:
    """slug, problem for each planned row (session, slug) that cannot be published: 'missing', 'hidden', 'not a session' (of the session's slug) or 'duplicated'.

    entities has slug, type, visibility. All problems are found before anything is written.
    """
    about = entities.select(F.col("slug").alias("_slug"), "type", "visibility")
    rows = plan.select("slug", F.lit(False).alias("_is_session")).unionByName(plan.select(F.col("session").alias("slug"), F.lit(True).alias("_is_session")).distinct())
    met = rows.join(about, F.col("slug") == F.col("_slug"), "left")
    problem = F.when(F.col("_slug").isNull(), "missing").when(F.col("visibility") == "gm_only", "hidden").when(F.col("_is_session") & (F.col("type") != "session"), "not a session")
    found = met.select("slug", problem.alias("problem")).where("problem is not null").distinct()
    again = plan.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1").select("slug", F.lit("duplicated").alias("problem"))
    return found.unionByName(again)


def revealed_relations(plan: DataFrame, relations: DataFrame, sessions: DataFrame) -> DataFrame:
    """source, target, session: relations whose ends are both planned, in the later of their sessions by ``nth``."""
    order = plan.join(sessions.select("session", "nth"), "session").groupBy("slug").agg(F.min("nth").alias("nth"))
    a, b = (order.select(F.col("slug").alias(end), F.col("nth").alias(f"_{end}")) for end in ("source", "target"))
    met = relations.join(a, "source").join(b, "target").withColumn("nth", F.greatest("_source", "_target"))
    return met.join(sessions.select("session", "nth"), "nth").select("source", "target", "session")


def before_accepted(revisions: DataFrame, key: str, order: str, accepted: Column) -> DataFrame:
    """key, restored: what undoing the last accepted revision brings back: the revision before it, null where it is the first."""
    in_order = Window.partitionBy(key).orderBy(order)
    marked = revisions.withColumn("_before", F.lag("revision").over(in_order)).where(accepted)
    return marked.groupBy(key).agg(F.max_by(F.struct("_before"), order).alias("b")).select(key, F.col("b._before").alias("restored"))


def swapped(rows: DataFrame, parent: str, position: str, moves: DataFrame, key: str) -> DataFrame:
    """rows with their new position after moves (key, up): each moved row changes places with its neighbour; at an edge nothing changes. Moves must not touch the same rows."""
    siblings = Window.partitionBy(parent).orderBy(position)
    near = rows.withColumn("_above", F.lag(key).over(siblings)).withColumn("_below", F.lead(key).over(siblings)).withColumn("_up_to", F.lag(position).over(siblings)).withColumn("_down_to", F.lead(position).over(siblings))
    met = near.join(moves.select(F.col(key), "up"), key)
    own = met.select(key, F.when(F.col("up"), F.col("_up_to")).otherwise(F.col("_down_to")).alias("_to"))
    other = met.select(F.when(F.col("up"), F.col("_above")).otherwise(F.col("_below")).alias(key), F.col(position).alias("_to"))
    changed = own.unionByName(other).where(f"{key} is not null and _to is not null")
    return rows.join(changed, key, "left").withColumn(position, F.coalesce("_to", position)).drop("_to")


def merged_edges(edges: DataFrame, losing: object, winning: object, kind: str = "type") -> tuple[DataFrame, DataFrame]:
    """edges (source, target, type) after the losing type is merged into the winning one, and the counts (moved, deleted): losing edges between a pair that has a surviving one go."""
    held = edges.where(F.col(kind) == winning).select("source", "target").distinct()
    lost = edges.where(F.col(kind) == losing)
    gone, moved = lost.join(held, ["source", "target"], "left_semi"), lost.join(held, ["source", "target"], "left_anti")
    out = edges.where(~F.col(kind).eqNullSafe(F.lit(losing))).unionByName(moved.withColumn(kind, F.lit(winning).cast(edges.schema[kind].dataType)))
    counts = gone.agg(F.count("*").alias("deleted")).join(moved.agg(F.count("*").alias("moved")), F.lit(True))  # two single rows
    return out, counts.select("moved", "deleted")


def freshness(artifacts: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """key, status of the wanted artifacts (fingerprints: key, fingerprint): 'fresh' where the latest artifact has the fingerprint, 'reused' where an older one has, 'stale' where none has but some are there, 'missing' else.

    artifacts has key, fingerprint, created.
    """
    latest = artifacts.groupBy("key").agg(F.max_by("fingerprint", "created").alias("_latest"))
    exact = artifacts.select("key", "fingerprint").distinct().withColumn("_exact", F.lit(True))
    met = fingerprints.join(latest, "key", "left").join(exact, ["key", "fingerprint"], "left")
    status = F.when(F.col("_latest") == F.col("fingerprint"), "fresh").when(F.col("_exact"), "reused").when(F.col("_latest").isNotNull(), "stale").otherwise("missing")
    return met.select("key", status.alias("status"))


def warmed(start: DataFrame, ring: DataFrame, rates: DataFrame, active: DataFrame) -> DataFrame:
    """universe, entity, trigger: what triggers ask to be warmed. start has universe, entity and trigger ('write', 'prep', 'open', 'consumption', 'nightly').

    A consumption also warms the ring of its entity (ring: universe, entity, near, depth) as far as the universe's hit rate lets it (rates: universe,
    rate); nightly ones only count in active universes.
    """
    from ..functions import predicates

    reach = active.select("universe").distinct().join(rates, "universe", "left").select("universe", predicates.radius(F.col("rate")).alias("_radius"))
    used = start.where(F.col("trigger") == "consumption").join(ring, ["universe", "entity"]).join(reach, "universe", "left").where(F.col("depth") <= F.coalesce("_radius", F.lit(2)))
    around = used.select("universe", F.col("near").alias("entity"), "trigger")
    nightly = start.where("trigger = 'nightly'").join(active.select("universe").distinct(), "universe", "left_semi")
    return start.where("trigger <> 'nightly'").unionByName(nightly).unionByName(around).distinct()


def deletion_impact(owned: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """name, n: how many rows of each table belong to the owned keys; 0 where none does."""
    out = None
    keys = owned.select(key).distinct()
    for name, rows in tables.items():
        one = rows.join(keys, key, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def one_of_each(first: DataFrame, second: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of both sets, one of each key; those of the first set win, then the order."""
    both = first.withColumn("_second", F.lit(0)).unionByName(second.withColumn("_second", F.lit(1)))
    return both.withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy("_second", *order))).where("_p = 1").drop("_p", "_second")


def canonical_json(json: Column) -> Column:
    """A JSON text with the keys of all objects in order and no white space; null where it is no JSON."""
    return F.pandas_udf(_canonical, "string")(json)


def _canonical(texts: pd.Series) -> pd.Series:
    import json

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            return None
        return None if text is None else json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    return texts.map(one)


def _plain(value):
    """Numbers as a script would write them: 1.0 is 1."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 1e21 else value


def keyed(rows: DataFrame, key: str, path: str, types: DataFrame) -> DataFrame:
    """rows (key, path: a JSON array of labels) with the labels' keys in their place; labels without a type stay. types has label, key, owner, nth; owned ones come first."""
    first = F.row_number().over(Window.partitionBy("label").orderBy(F.col("owner").isNull(), "nth"))
    keys = types.withColumn("_p", first).where("_p = 1").select("label", F.col("key").alias("_key"))
    each = rows.select(key, F.posexplode(F.from_json(path, "array<string>")).alias("_at", "label")).join(keys, "label", "left")
    back = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_key", "label").alias("_v")))).alias("_parts"))
    return rows.select(key, F.col(path).alias("_old")).join(back, key, "left").select(key, F.coalesce(F.to_json("_parts._v"), "_old").alias(path))
