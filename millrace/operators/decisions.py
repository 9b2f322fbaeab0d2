"""Decision tables and audits as columns and aggregates: routes, grades, plans of work, spans, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of a plan of work, and what each reason leads to.
TODOS, BLOCKERS, PATH, ATTEMPTS = 12, 8, 4, 2
OUTSIDE = ("external_realtime", "external_lookup")
GAPS = ("external_realtime_required", "external_lookup_required")
MODES = {"clarification_required": "clarify", "capability_unavailable": "capability_unavailable", "retrieval_unavailable": "technical_error", "general_conversation": "conversation"}
ENDS = {"clarification_required": "clarify", "capability_unavailable": "cannot_answer", "retrieval_unavailable": "cannot_answer", "refuse": "refuse", "research_round_limit": "research_round_limit"}


def _by(reason: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[reason]


def routed(sources: Column, needed: Column, unclear: Column, steps: Column, lookups: Column, tools: Column, kb: Column) -> Column:
    """Where a question goes: struct(route, mode, ends, reason). `steps` and `lookups` say that several are
    needed; `tools` are the capabilities at hand, `kb` whether there is a knowledge base."""
    own = F.array_contains(sources, "knowledge_base")
    outside = F.arrays_overlap(sources, F.array(*map(F.lit, OUTSIDE)))
    able = outside & (F.size(needed) > 0) & (F.size(F.array_except(needed, tools)) == 0)
    reason = (
        F.when(unclear | F.array_contains(sources, "unknown"), "clarification_required")
        .when(own & ~kb & (able | ~outside), "retrieval_unavailable")
        .when(able, "available_tool_capabilities")
        .when(outside, F.when(own, "clarification_required").otherwise("capability_unavailable"))
        .when(own, F.when(lookups, "knowledge_base_research").otherwise("knowledge_base_lookup"))
        .otherwise("general_conversation")
    )
    far = (reason == "knowledge_base_research") | ((reason == "available_tool_capabilities") & (own | steps))
    near = reason.isin("knowledge_base_lookup", "available_tool_capabilities")
    route = F.when(far, "research").when(near, "fast_rag").otherwise("chat")
    return F.struct(route.alias("route"), _by(reason, MODES).alias("mode"), _by(reason, ENDS).alias("ends"), reason.alias("reason"))


def graded(decision: Column, gap: Column, sources: Column, tools: Column, kb: Column, rounds: Column, most: int) -> Column:
    """What follows a grade of the evidence: struct(next, reason); a null gap is unknown."""
    outside = F.coalesce(gap.isin(*GAPS), F.lit(False))
    mixed = F.array_contains(sources, "knowledge_base") & F.array_contains(sources, F.regexp_replace(gap, "_required$", ""))
    reason = (
        F.when(decision.isin("refuse", "sufficient"), decision)
        .when((decision == "clarify") | (gap == "query_ambiguous"), "clarification_required")
        .when(outside & (F.size(tools) > 0) & (rounds < most), "discover_missing_capability")
        .when(outside, F.when(mixed, "clarification_required").otherwise("capability_unavailable"))
        .when(~kb, "retrieval_unavailable")
        .when(rounds >= most, "research_round_limit")
        .otherwise(F.coalesce(gap, F.lit("unknown")))
    )
    step = F.when(reason.isin("refuse", "research_round_limit"), "end").when(reason == "sufficient", "generate").when(reason.isin(*MODES), "chat").otherwise("research_agent")
    return F.struct(step.alias("next"), reason.alias("reason"))


def plan_problems(todos: DataFrame, edges: DataFrame) -> DataFrame:
    """(run, problem) for todos(run, id, attempts) and edges(run, id, blocker): the first limit or rule that
    a run breaks, else null. Edges are gathered of runs within the limits only, so at most 96 each: an edge
    whose blocker waits for nothing is peeled off, round by round; what stays after three rounds is on a
    path of over four todos, what stays after twelve on a cycle."""
    one = todos.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("attempts").alias("low"), F.max("attempts").alias("high"))
    per = edges.groupBy("run", "id").agg(F.count(F.lit(1)).alias("k"), F.count_distinct("blocker").alias("kinds"))
    per = per.groupBy("run").agg(F.max("k").alias("k"), F.max(F.col("k") > F.col("kinds")).alias("twice"))
    lost = edges.join(todos.select("run", F.col("id").alias("blocker")), ["run", "blocker"], "left_anti").groupBy("run").agg(F.lit(True).alias("lost"))
    size = (
        F.when(F.col("n") > TODOS, "too many todos").when(F.col("k") > BLOCKERS, "too many dependencies").when(F.col("twice"), "repeated dependency")
        .when((F.col("low") < 0) | (F.col("high") > ATTEMPTS), "too many attempts").when(F.col("ids") < F.col("n"), "repeated todo").when(F.col("lost"), "unknown dependency")
    )
    runs = one.join(per, "run", "left").join(lost, "run", "left").select("run", size.alias("size"))
    links = edges.join(runs.where("size is null").select("run"), "run", "left_semi").groupBy("run").agg(F.collect_list(F.struct("id", "blocker")).alias("left"))
    peel = lambda left, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), left, lambda x, _: F.filter(x, lambda e: F.exists(x, lambda f: f["id"] == e["blocker"])))
    links = links.withColumn("long", peel(F.col("left"), PATH - 1)).withColumn("loop", peel(F.col("long"), TODOS - PATH + 1))
    shape = F.when(F.size("loop") > 0, "cycle").when(F.size("long") > 0, "path too long")
    return runs.join(links.select("run", shape.alias("shape")), "run", "left").select("run", F.coalesce("size", "shape").alias("problem"))


def span_levels(spans: DataFrame) -> DataFrame:
    """spans(trace, id, parent, start, end, status) with a root (id 0) for each trace, which takes spans whose
    parent is missing: each span's seconds, those of its children, their number, and its status; the root has
    the worst status and the whole time."""
    ids = spans.select("trace", F.col("id").alias("parent"), F.lit(True).alias("known")).distinct()
    s = spans.join(ids, ["trace", "parent"], "left").withColumn("parent", F.when(F.col("known"), F.col("parent")).otherwise(0)).drop("known")
    worst = F.element_at(F.array(*map(F.lit, ("ok", "cancelled", "error"))), F.max(F.when(F.col("status") == "error", 3).when(F.col("status") == "cancelled", 2).otherwise(1)))
    root = spans.groupBy("trace").agg(F.min("start").alias("start"), F.max("end").alias("end"), worst.alias("status"))
    root = root.select("trace", F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), "start", "end", "status")
    tree = s.select(*root.columns).union(root).withColumn("seconds", F.col("end") - F.col("start")).drop("start", "end")
    below = tree.where("parent is not null").groupBy("trace", F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"), F.sum("seconds").alias("child_seconds"))
    return tree.join(below, ["trace", "id"], "left").fillna(0, ["children", "child_seconds"])


def manifest_problems(manifests: DataFrame, staged: DataFrame) -> DataFrame:
    """(version_id, problem): manifests(version_id, user_id, uri, parents, children, digest, artifact) against the
    staged rows (version_id, parent_id, child_id, hash). Null means that it may be published."""
    pair = F.array_sort(F.collect_list(F.struct("child_id", "hash")))
    text = F.array_join(F.transform(pair, lambda x: F.concat_ws(":", x["child_id"].cast("string"), x["hash"])), ",")
    g = staged.groupBy("version_id").agg(F.count_distinct("parent_id").alias("_p"), F.count(F.lit(1)).alias("_c"), F.sha2(text, 256).alias("_d"))
    own = F.concat(F.lit("store://"), F.col("user_id").cast("string"), F.lit("/"))
    problem = (
        F.when(F.col("_d").isNull(), "nothing staged").when(~F.col("uri").startswith(own), "out of scope")
        .when(~F.col("digest").eqNullSafe(F.col("artifact")), "artifact differs").when(F.col("digest") != F.col("_d"), "rebuilt differs")
        .when((F.col("parents") != F.col("_p")) | (F.col("children") != F.col("_c")), "counts differ")
    )
    return manifests.join(g, "version_id", "left").select("version_id", problem.alias("problem"))


def derived(kind: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """The value that a stated derivation gives: b - a, b + c - d, or the percentage by which c is below b;
    null where that can't be (other kinds, b not above 0)."""
    return F.when(kind == "difference", b - a).when(kind == "balance", b + c - d).when((kind == "reduction") & (b > 0), (1 - c / b) * 100)


def derivation_holds(stated: Column, value: Column, tolerance: Column) -> Column:
    return F.coalesce(F.abs(stated - value) <= tolerance + 1e-10, F.lit(False))
