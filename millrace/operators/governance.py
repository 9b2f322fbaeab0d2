"""Governance of published generations: what may be published, released, pointed to, admitted or merged. Every check is a
join or a grouped fold; what fails one changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity_digest(identity: Column, content_hash: Column) -> Column:
    """The digest of a set of children: SHA-256 of the compact JSON list of their (id, hash) pairs in order; null if an id
    comes twice."""
    pairs = F.array_sort(F.collect_list(F.array(identity.cast("string"), content_hash)))
    return F.when(F.size(F.array_distinct(F.transform(pairs, lambda p: p[0]))) == F.size(pairs), F.sha2(F.to_json(pairs), 256))


def released(rows: DataFrame, members: DataFrame, generation: str, member: str, child: str, content_hash: str) -> DataFrame:
    """rows(generation, member, child, hash, is_active) with `is_active` as a release leaves it: in each generation that
    members(generation, member, digest) releases, exactly the members' rows are active if every member's children
    have the digest given. One that differs, or isn't there, and the whole generation stays as it is."""
    live = rows.groupBy(generation, member).agg(identity_digest(F.col(child), F.col(content_hash)).alias("_live"))
    checked = members.join(live, [generation, member], "left")
    ok = checked.groupBy(generation).agg(F.min(F.coalesce((F.col("_live") == F.col("digest")).cast("int"), F.lit(0))).alias("_ok"))
    named = members.select(generation, member, F.lit(True).alias("_named")).distinct()
    out = rows.join(ok, generation, "left").join(named, [generation, member], "left")
    return out.withColumn("is_active", F.when(F.col("_ok") == 1, F.coalesce("_named", F.lit(False))).otherwise(F.col("is_active"))).select(*rows.columns)


def published(versions: DataFrame, staged: DataFrame, active: DataFrame) -> DataFrame:
    """(document_id, version_id, step, action, target): the steps, in order, that publish versions(document_id, version_id,
    version_no, parent_count, child_count, manifest_hash, rebuilt_hash): 1 activate parents, 2 activate children,
    3 deactivate the version before (target), 4 move the document's pointer.

    A version whose manifest isn't what a rebuild gives, or whose staged(version_id, parents, children) counts aren't its
    manifest's, is one row of step 0 with `quarantine`; one older than the document's active(document_id,
    active_version_id, active_no) is `deactivate`. The active version itself has nothing to do."""
    rows = versions.join(staged, "version_id", "left").join(active, "document_id", "left").where(F.col("active_version_id").isNull() | (F.col("active_version_id") != F.col("version_id")))
    whole = (F.col("manifest_hash") == F.col("rebuilt_hash")) & (F.coalesce("parents", F.lit(0)) == F.col("parent_count")) & (F.coalesce("children", F.lit(0)) == F.col("child_count"))
    step = lambda n, action, target=None: F.struct(F.lit(n).alias("step"), F.lit(action).alias("action"), (F.lit(None).cast("long") if target is None else target.cast("long")).alias("target"))
    before = F.when(F.col("active_version_id").isNotNull(), step(3, "deactivate previous", F.col("active_version_id")))
    steps = F.array_compact(F.array(step(1, "activate parents"), step(2, "activate children"), before, step(4, "move pointer", F.col("version_id"))))
    todo = F.when(F.col("active_no") > F.col("version_no"), F.array(step(0, "deactivate"))).when(F.coalesce(whole, F.lit(False)), steps).otherwise(F.array(step(0, "quarantine")))
    return rows.select("document_id", "version_id", F.explode(todo).alias("s")).select("document_id", "version_id", "s.*")


def switched(requests: DataFrame, indexes: DataFrame, pointers: DataFrame, prefix: str) -> DataFrame:
    """requests(alias, wanted) to (alias, target, outcome) over pointers(alias, target), the table that says where names
    point: switched, if indexes(target) has what is wanted; unchanged, if it points there alone. It fails closed: an
    index that isn't there is missing, and a name that points to anything but ours (targets beginning with prefix) is
    foreign and stays; both leave the target null."""
    now = pointers.groupBy("alias").agg(F.array_sort(F.collect_set("target")).alias("_now"))
    there = indexes.select(F.col("target").alias("wanted"), F.lit(True).alias("_there")).distinct()
    rows = requests.join(there, "wanted", "left").join(now, "alias", "left")
    foreign = F.exists("_now", lambda t: ~t.startswith(prefix))
    outcome = F.when(F.col("_there").isNull(), "missing").when(F.coalesce(foreign, F.lit(False)), "foreign").when(F.col("_now") == F.array("wanted"), "unchanged").otherwise("switched")
    return rows.select("alias", F.when(outcome.isin("switched", "unchanged"), F.col("wanted")).alias("target"), outcome.alias("outcome"))


def merged_results(items: DataFrame, run: str, expected: Column | None = None) -> DataFrame:
    """items(run, todo, evidence, relation, generation) of several researchers to (run, evidence, todo, relations,
    problem): evidence once, by the first todo, with all its relations in order. Results of a run must agree on one
    non-empty generation, that expected if one is: else the run is one row with its problem and no evidence."""
    of = items.groupBy(run).agg(F.collect_set(F.coalesce("generation", F.lit(""))).alias("_g"))
    problem = F.when(F.array_contains("_g", ""), "no generation").when(F.size("_g") > 1, "several generations")
    if expected is not None:
        problem = problem.when(F.element_at("_g", 1) != expected, "another generation")
    of = of.select(run, problem.alias("problem"))
    fine = items.join(of.where("problem is null").select(run), run, "left_semi")
    out = fine.groupBy(run, "evidence").agg(F.min("todo").alias("todo"), F.array_sort(F.collect_set("relation")).alias("relations"))
    bad = of.where("problem is not null").select(run, F.lit(None).cast(dict(items.dtypes)["evidence"]).alias("evidence"), F.lit(None).cast(dict(items.dtypes)["todo"]).alias("todo"), F.lit(None).cast("array<string>").alias("relations"), "problem")
    return out.select(run, "evidence", "todo", "relations", F.lit(None).cast("string").alias("problem")).union(bad)


def rejections(candidates: DataFrame, messages: DataFrame, batch: str) -> DataFrame:
    """candidates(batch, id, sources) with `reason`, why a memory isn't admitted, or null: a source that isn't among the
    batch's messages(batch, message, role, confirmed, confirmation); a system message; an assistant's that no user's
    message confirms which is a source itself."""
    each = candidates.select(batch, "id", "sources", F.explode_outer("sources").alias("message"))
    rows = each.join(messages, [batch, "message"], "left")
    who = messages.select(batch, F.col("message").alias("confirmation"), F.col("role").alias("_by"))
    rows = rows.join(who, [batch, "confirmation"], "left")
    confirmed = F.coalesce(F.col("confirmed") & (F.col("_by") == "user") & F.array_contains("sources", F.col("confirmation")), F.lit(False))
    kind = F.when(F.col("message").isNull(), 9).when(F.col("role").isNull(), 1).when(F.col("role") == "system", 2).when((F.col("role") == "assistant") & ~confirmed, 3).otherwise(9)
    worst = rows.groupBy(batch, "id").agg(F.min(kind).alias("_worst"))
    reason = F.when(F.col("_worst") == 1, "unknown_source_message").when(F.col("_worst") == 2, "system_source").when(F.col("_worst") == 3, "unconfirmed_assistant_source")
    return candidates.join(worst, [batch, "id"]).withColumn("reason", reason).drop("_worst")


def narrowed_only(authorized: Column, asked: Column) -> Column:
    """Whether a request's scope (struct of user_id, generation, match_none and arrays, null or empty: unrestricted) sees
    nothing beyond what is authorized."""

    def within(name: str) -> Column:
        a, b = F.coalesce(authorized[name], F.array().cast("array<string>")), F.coalesce(asked[name], F.array().cast("array<string>"))
        return (F.size(a) == 0) | ((F.size(b) > 0) & (F.size(F.array_except(b, a)) == 0))

    same = authorized["user_id"].eqNullSafe(asked["user_id"]) & authorized["generation"].eqNullSafe(asked["generation"])
    return asked["match_none"] | (~authorized["match_none"] & same & within("search_types") & within("document_ids") & within("content_types"))


def gold_problems(cases: DataFrame, sources: DataFrame, groups: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, problem) of the first rule each of cases(case_id, snapshot_id, user_id, wanted_snapshot, wanted_user)
    breaks: repeated; another corpus or user; a source(case_id, version_id, hash) that documents(version_id, hash) don't
    have so; a fact of groups(case_id, version_id, chunk_id) without such a source; a chunk that chunks(chunk_id, user_id,
    version_id) don't have for that user and version. Chunks meet by their ids first, and what is found goes to the cases
    without them, once; a case's sources are an array."""
    times = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"), F.max(((F.col("snapshot_id") != F.col("wanted_snapshot")) | (F.col("user_id") != F.col("wanted_user"))).cast("int")).alias("_other"), F.min("user_id").alias("user_id"))
    known = documents.select("version_id", F.col("hash").alias("_hash"))
    wrong = ~F.coalesce(F.col("hash") == F.col("_hash"), F.lit(False))
    own = sources.join(known, "version_id", "left").groupBy("case_id").agg(F.max(wrong.cast("int")).alias("_source"), F.collect_set("version_id").alias("_own"))
    there = chunks.select("chunk_id", F.col("user_id").alias("_user"), F.col("version_id").alias("_version"))
    facts = groups.join(there, "chunk_id", "left").select("case_id", "version_id", F.when(F.col("_version") == F.col("version_id"), F.col("_user")).alias("_user"), F.lit(True).alias("_is"))
    rows = times.join(own, "case_id", "left").join(facts, "case_id", "left")
    fact = F.col("_is") & ~F.coalesce(F.array_contains("_own", F.col("version_id")), F.lit(False))
    foreign = F.col("_is") & ~F.coalesce(F.col("_user") == F.col("user_id"), F.lit(False))
    most = {"_n": F.col("_n"), "_other": F.col("_other"), "_source": F.col("_source"), "_fact": fact.cast("int"), "_chunk": foreign.cast("int")}
    rows = rows.groupBy("case_id").agg(*(F.max(c).alias(k) for k, c in most.items()))
    problem = F.when(F.col("_n") > 1, "repeated").when(F.col("_other") == 1, "another corpus or user").when(F.col("_source") == 1, "source differs").when(F.col("_fact") == 1, "fact without source").when(F.col("_chunk") == 1, "foreign or missing chunk")
    return rows.select("case_id", problem.alias("problem")).where("problem is not null")


def answer_tail(events: DataFrame, after: Sequence[int], limit: int = 100) -> DataFrame:
    """The next events of an answer's stream behind (epoch, seq), in that order."""
    epoch, seq = after
    return events.where((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("seq") > seq))).orderBy("epoch", "seq").limit(limit)
