"""What a question is about: names that a directory knows, and the asker's own profile where they ask for themselves.
The directory, profiles and coverage are tables that their owners provide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how a question says that it is about the asker's own company.
OWN = "我们公司|我的公司|我(?:去|要|出差)|本公司"


def mentioned_names(questions: DataFrame, directory: DataFrame, key: str, text: str) -> DataFrame:
    """(key, field, value, start, end, status): the names of directory(alias, field, value) in the questions, where they
    first are; a name within a longer one isn't one. An alias of several values is ambiguous, with a row for each.

    Questions are short: their pieces of the lengths that names have meet the names by equality."""
    values = directory.where(F.length("alias") > 0).groupBy("alias", "field").agg(F.collect_set("value").alias("_values"))
    lengths = values.agg(F.coalesce(F.array_sort(F.collect_set(F.length("alias"))), F.array().cast("array<int>")).alias("_lengths"))  # one row
    rows = questions.select(key, F.col(text).alias("_text")).where(F.length("_text") > 0).crossJoin(F.broadcast(lengths))

    def of(n: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_text") - n + 1, F.lit(1))), lambda i: F.struct((i - 1).alias("start"), (i - 1 + n).alias("end"), F.substring(F.col("_text"), i, n).alias("alias")))
        return F.filter(each, lambda p: F.length(p["alias"]) == n)

    pieces = rows.select(key, F.explode(F.flatten(F.transform("_lengths", of))).alias("_p")).select(key, "_p.*")
    found = pieces.join(values, "alias")
    all_ = found.groupBy(key).agg(F.collect_list(F.struct("start", "end", "alias", "field", F.col("_values").alias("values"))).alias("_all"))
    inside = lambda m, o: (o["start"] <= m["start"]) & (o["end"] >= m["end"]) & (o["end"] - o["start"] > m["end"] - m["start"])
    kept = F.filter("_all", lambda m: ~F.exists("_all", lambda o: inside(m, o)))
    rows = all_.select(key, F.explode(kept).alias("m")).select(key, "m.*")
    first = rows.groupBy(key, "alias", "field").agg(F.min(F.struct("start", "end")).alias("_at"), F.first("values").alias("_values"))
    return first.select(key, "field", F.explode("_values").alias("value"), "_at.start", "_at.end", F.when(F.size("_values") > 1, "ambiguous").otherwise("resolved").alias("status"))


def scoped(questions: DataFrame, mentions: DataFrame, profiles: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    """(key, status, scope): what each question is about, as structs (field, value, source_kind) in order of fields.

    Names in the question are its scope. A question for the asker's own company whose profile(owner, companies,
    population) has one company, and that names no other, takes company and population from it where it names none:
    defaulted. It is unresolved if neither it nor the profile has a company, ambiguous if only the profile has, and
    several. A profile holds for its owner alone; others' questions never see it."""
    said = mentions.groupBy(key).agg(F.collect_set(F.struct("field", "value", F.lit("explicit_user").alias("source_kind"))).alias("_said"))
    rows = questions.select(key, owner, F.coalesce(F.col(text).rlike(OWN), F.lit(False)).alias("_own")).join(said, key, "left").join(profiles.select(owner, "companies", "population"), owner, "left")
    none = F.array().cast("array<struct<field:string,value:string,source_kind:string>>")
    rows = rows.withColumn("_said", F.coalesce("_said", none)).withColumn("_has", F.coalesce(F.size("companies"), F.lit(0)))
    rows = rows.withColumn("_has", F.greatest("_has", F.lit(0)))
    named = F.array_distinct(F.transform(F.filter("_said", lambda s: s["field"] == "company"), lambda s: s["value"]))
    nothing, one = F.size(named) == 0, F.col("_has") == 1
    mine = F.try_element_at("companies", F.lit(1))
    takes = F.col("_own") & one & (nothing | ((F.size(named) == 1) & (F.element_at(named, 1) == mine)))
    fields = F.transform("_said", lambda s: s["field"])

    def default(field: str, value: Column) -> Column:
        missing = takes & value.isNotNull() & (value != "") & ~F.array_contains(fields, field)
        return F.when(missing, F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit("trusted_profile").alias("source_kind")))

    more = F.array_compact(F.array(default("company", mine), default("population", F.col("population"))))
    rows = rows.withColumn("_more", more)
    status = (
        F.when(~F.col("_own"), "resolved").when(nothing & (F.col("_has") == 0), "unresolved").when(nothing & ~one, "ambiguous")
        .when(F.size("_more") > 0, "defaulted").otherwise("resolved")
    )
    return rows.select(key, status.alias("status"), F.array_sort(F.concat("_said", "_more")).alias("scope"))


def covered_documents(companies: DataFrame, coverage: DataFrame, binding: DataFrame, key: str) -> DataFrame:
    """(key, document_id): the documents that a question about companies(key, owner, company) may keep to, by
    coverage(owner, generation, revision, complete, document_id, company). Only coverage that is complete and of the
    generation and revision that binding(owner, generation, revision) says are current counts: questions of other
    owners have no rows here, and so no narrowing.

    Documents are made distinct for each set of companies that is asked, not for each question: the pairs that are
    returned are neither shuffled nor held."""
    current = coverage.where("complete").join(binding, ["owner", "generation", "revision"], "left_semi").select("owner", "company", "document_id")
    asked = companies.where("owner is not null and company is not null").groupBy(key).agg(F.sort_array(F.collect_set(F.struct("owner", "company"))).alias("_set"))
    each = asked.select("_set").distinct().select("_set", F.explode("_set").alias("_one")).select("_set", "_one.*")
    return asked.join(each.join(current, ["owner", "company"]).select("_set", "document_id").distinct(), "_set").select(key, "document_id")
