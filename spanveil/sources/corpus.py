"""Golden cases: reading, checking, evaluating and comparing corpora of texts with their expected matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators import expr
from spanveil.operators.engine import Engine

_MATCH = "struct<ruleId:string,packId:string,text:string,start:int,end:int,targetText:string,targetStart:int,targetEnd:int>"
CASE = f"id string, text string, profile string, tags array<string>, provenance array<string>, review struct<status:string,nativeReview:string,reviewedAt:string,note:string>, note string, matches array<{_MATCH}>"


def read(spark: SparkSession, path: str, package: str) -> DataFrame:
    """Cases of the JSON files at ``path``, each an array of cases or an object with a ``cases`` array; malformed files fail."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(CASE)
    return reader.json(path).withColumn("package", F.lit(package)).withColumn("file", F.col("_metadata.file_path"))


def union(*corpora: DataFrame) -> DataFrame:
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c)
    return out


def violations(cases: DataFrame) -> DataFrame:
    """(package, id, problem): repeated or malformed ids, empty profiles, and matches out of bounds or not as declared."""
    bad = []
    repeated = cases.groupBy("package", "id").count().where("count > 1").select("package", "id", F.lit("repeated id").alias("problem"))
    say = lambda where, what: cases.where(where).select("package", "id", F.lit(what).alias("problem"))
    bad.append(say(~F.coalesce(F.col("id").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)), "malformed id"))
    bad.append(say(F.col("text").isNull() | F.col("profile").isNull() | F.col("matches").isNull() | F.col("tags").isNull(), "missing field"))
    bad.append(say(F.size(F.array_distinct("tags")) < F.size("tags"), "repeated tag"))
    m = cases.select("package", "id", "text", F.explode("matches").alias("m"))
    n = expr.units(F.col("text"))
    inside = (F.col("m.start") >= 0) & (F.col("m.end") > F.col("m.start")) & (F.col("m.end") <= n) & (F.col("m.targetStart") >= F.col("m.start")) & (F.col("m.targetEnd") > F.col("m.targetStart")) & (F.col("m.targetEnd") <= F.col("m.end"))
    bad.append(m.where(~F.coalesce(inside, F.lit(False))).select("package", "id", F.lit("range out of bounds").alias("problem")))
    cut = lambda a, b: expr.cut(F.col("text"), F.col(a), F.col(b))
    same = (cut("m.start", "m.end") == F.col("m.text")) & (cut("m.targetStart", "m.targetEnd") == F.col("m.targetText"))
    bad.append(m.where(inside & ~F.coalesce(same, F.lit(False))).select("package", "id", F.lit("text is not as declared").alias("problem")))
    return union(repeated, *bad)


def evaluate(cases: DataFrame, engines: dict[str, Engine]) -> DataFrame:
    """(package, id, profile, failures, expected, actual) of the cases that fail; a profile without an engine is a failure.

    Each profile's engine runs over its own cases; matches must equal in order, and segments must give the text back.
    """
    shape = lambda m: F.struct(m["ruleId"].alias("rule_id"), m["packId"].alias("pack_id"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), m["targetText"].alias("target_text"), m["targetStart"].alias("target_start"), m["targetEnd"].alias("target_end"))
    got = lambda m: F.struct(*(m[c].alias(c) for c in ("rule_id", "pack_id", "text", "start", "end", "target_text", "target_start", "target_end")))
    parts = []
    for name, engine in engines.items():
        rows = cases.where(F.col("profile") == name).withColumn("both", engine.find_and_segment(F.col("text")))
        actual, expected = F.transform("both.matches", got), F.transform("matches", shape)
        failures = F.array_compact(F.array(F.when(~expected.eqNullSafe(actual), F.lit("matches differ")), F.when(F.concat_ws("", F.transform("both.segments", lambda s: s["text"])) != F.col("text"), F.lit("segments do not restore the text"))))
        parts.append(rows.select("package", "id", "profile", failures.alias("failures"), expected.alias("expected"), actual.alias("actual")))
    rest = cases.where(~F.col("profile").isin(*engines)) if engines else cases
    none = F.array().cast("array<struct<rule_id:string,pack_id:string,text:string,start:int,end:int,target_text:string,target_start:int,target_end:int>>")
    parts.append(rest.select("package", "id", "profile", F.array(F.concat(F.lit("no engine for profile "), F.col("profile"))).alias("failures"), F.transform("matches", shape).alias("expected"), none.alias("actual")))
    return union(*parts).where(F.size("failures") > 0)


def check(cases: DataFrame, engines: dict[str, Engine]) -> None:
    """Raises with all failing cases' names."""
    failed = evaluate(cases, engines).select(F.concat_ws("/", "package", "id").alias("name"), F.concat_ws("; ", "failures").alias("why")).orderBy("name").collect()
    if failed:
        raise AssertionError(f"{len(failed)} cases failed:\n" + "\n".join(f"- {r.name}: {r.why}" for r in failed))


def summary(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count(F.lit(1)).alias("case_count"), F.coalesce(F.sum(F.size("matches")), F.lit(0)).alias("match_count"))


def report(changes: DataFrame) -> str:
    """A diff's counts and changed cases as text; for small corpora, on the driver."""
    rows = changes.where("bucket <> 'unchanged'").orderBy("bucket", *[c for c in changes.columns if c != "bucket"]).collect()
    lines = [f"{r.bucket}: " + ":".join(str(r[c]) for c in changes.columns if c != "bucket") for r in rows]
    return "\n".join([f"{len(rows)} changed", *lines])
