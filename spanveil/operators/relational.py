"""Relational work on match tables: reports, differences, overlaps, groups, policies and budgets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.operators import expr
from spanveil.operators.engine import Engine


def matches(docs: DataFrame, engine: Engine, key: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """A row for each match, with its position and id and the columns to ``keep``; a narrow map and an explode."""
    found = docs.select(F.col(key), *keep, engine.find_column(F.col(text)).alias("m"))
    return found.select(key, *keep, F.posexplode("m").alias("pos", "m")).select(key, *keep, "pos", F.concat(F.lit("m"), F.col("pos").cast("string")).alias("match_id"), "m.*")


def segments(docs: DataFrame, engine: Engine, key: str = "doc_id", text: str = "text") -> DataFrame:
    parts = docs.select(F.col(key), engine.segment_column(F.col(text)).alias("s"))
    return parts.select(key, F.posexplode("s").alias("pos", "s")).select(key, "pos", "s.*")


def diff(base: DataFrame, head: DataFrame, keys: list[str], matches_: str = "matches", text: str = "text", meta: list[str] = ()) -> DataFrame:
    """Each case of either side with what became of it: added, removed, text, matches, target, metadata or unchanged.

    One full outer join on the case keys. A case whose matches differ only in targets is a ``target`` change.
    """
    b, h = base.alias("b"), head.alias("h")
    on = [F.col(f"b.{k}") == F.col(f"h.{k}") for k in keys]
    both = b.join(h, on, "full_outer")
    col = lambda side, c: F.col(f"{side}.{c}")
    ranges = lambda side: F.transform(col(side, matches_), lambda m: F.struct(m["rule_id"], m["start"], m["end"]))
    same_meta = F.lit(True)
    for m in meta:
        same_meta = same_meta & col("b", m).eqNullSafe(col("h", m))
    bucket = (
        F.when(col("b", keys[0]).isNull(), "added")
        .when(col("h", keys[0]).isNull(), "removed")
        .when(~col("b", text).eqNullSafe(col("h", text)), "text")
        .when(~ranges("b").eqNullSafe(ranges("h")), "matches")
        .when(~col("b", matches_).eqNullSafe(col("h", matches_)), "target")
        .when(~same_meta, "metadata")
        .otherwise("unchanged")
    )
    return both.select(*(F.coalesce(col("b", k), col("h", k)).alias(k) for k in keys), bucket.alias("bucket"))


def overlaps(segments_: DataFrame, matches_: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, segment, match) of covered segments and the matches whose targets they overlap and whose rule they name."""
    s, m = segments_.where("covered").alias("s"), matches_.alias("m")
    on = (F.col(f"s.{key}") == F.col(f"m.{key}")) & (F.col("s.start") < F.col("m.target_end")) & (F.col("s.end") > F.col("m.target_start")) & F.array_contains(F.col("s.rule_ids"), F.col("m.rule_id"))
    return s.join(m, on).select(F.col(f"s.{key}").alias(key), F.col("s.pos").alias("segment"), F.col("m.pos").alias("match"))


_GROUP = pa.list_(pa.struct([("reveal_id", pa.string()), ("match_ids", pa.list_(pa.string())), ("segments", pa.list_(pa.struct([("index", pa.int32()), ("edge", pa.string())])))]))


def disclosure_groups(both: Column) -> Column:
    """Groups of matches that share covered segments, from ``Engine.find_and_segment``; named by their least match.

    Within one text; each group lists its matches and its segments with their edge: solo, start, middle or end.
    """

    @F.arrow_udf("array<struct<reveal_id:string,match_ids:array<string>,segments:array<struct<index:int,edge:string>>>>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _groups(x["matches"], x["segments"]) for x in column.to_pylist()], _GROUP)

    return run.asNondeterministic()(both)


def _groups(found: list[dict], parts: list[dict]) -> list[dict]:
    up = list(range(len(found)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    owners: dict[int, list[int]] = {}
    for k, s in enumerate(parts):
        if s["covered"]:
            mine = [i for i, m in enumerate(found) if s["start"] < m["target_end"] and s["end"] > m["target_start"] and m["rule_id"] in s["rule_ids"]]
            owners[k] = mine
            for i in mine[1:]:
                a, b = sorted((root(mine[0]), root(i)))
                up[b] = a
    groups: dict[int, dict] = {}
    for i in range(len(found)):
        groups.setdefault(root(i), {"matches": [], "segments": []})["matches"].append(f"m{i}")
    for k, mine in owners.items():
        if mine:
            groups[root(mine[0])]["segments"].append(k)
    out = []
    for r, g in sorted(groups.items()):
        n = len(g["segments"])
        edge = lambda p, n=n: "solo" if n == 1 else "start" if p == 0 else "end" if p == n - 1 else "middle"
        out.append({"reveal_id": f"m{r}", "match_ids": g["matches"], "segments": [{"index": k, "edge": edge(p)} for p, k in enumerate(g["segments"])]})
    return out


def site_policy(pages: DataFrame, overrides: DataFrame, paused: bool = False, default: bool = True, url: str = "url") -> DataFrame:
    """``pages`` with host and whether they are processed: paused beats everything, then the host's mode, then the default.

    ``overrides``: (host, mode); modes other than on and off don't count, the last of a host's does. A left join whose
    small side Spark broadcasts by its size.
    """
    clean = overrides.select(F.lower(F.trim("host")).alias("_host"), "mode", *([] if "position" not in overrides.columns else ["position"])).where(F.col("mode").isin("on", "off") & (F.col("_host") != ""))
    order = F.col("position") if "position" in overrides.columns else F.lit(0)
    clean = clean.groupBy("_host").agg(F.max_by("mode", order).alias("mode"))
    host = F.lower(F.parse_url(F.col(url), F.lit("HOST")))
    out = pages.withColumn("host", host).join(clean, F.col("host") == F.col("_host"), "left").drop("_host")
    active = F.when(F.lit(paused), False).when(F.col("mode") == "on", True).when(F.col("mode") == "off", False).otherwise(F.lit(default))
    return out.withColumn("active", active)


def term_list(value: Column) -> Column:
    """Terms of a text: split at line ends and commas, trimmed, blanks dropped, first of each spelling kept."""
    parts = F.filter(F.transform(F.split(value, "[\n,]"), lambda t: F.trim(t)), lambda t: t != "")
    first = lambda out, t: F.when(F.exists(out, lambda x: F.lower(x) == F.lower(t)), out).otherwise(F.concat(out, F.array(t)))
    return F.aggregate(parts, F.array().cast("array<string>"), first)


def budgeted_terms(terms: Column, longest: int = 200, most: int = 500, total: int = 20_000, terms_used=0, chars_used=0) -> Column:
    """struct(kept, added, duplicates, too_long, over_budget): first of each spelling within the budgets, in order.

    What is skipped takes nothing of the budgets, so the fold carries its own counts. The arguments may start from what other
    lists have used.
    """
    state = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(terms_used).alias("n"), F.lit(chars_used).alias("chars"), F.lit(0).alias("duplicates"), F.lit(0).alias("too_long"), F.lit(0).alias("over"))

    def step(s: Column, raw: Column) -> Column:
        t = F.trim(raw)
        blank = t == ""
        again = F.exists(s["kept"], lambda x: F.lower(x) == F.lower(t))
        long = F.length(t) > longest
        over = (s["n"] + 1 > most) | (s["chars"] + F.length(t) > total)
        take = ~blank & ~again & ~long & ~over
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct(
            F.when(take, F.concat(s["kept"], F.array(t))).otherwise(s["kept"]).alias("kept"),
            (s["n"] + one(take)).alias("n"),
            (s["chars"] + F.when(take, F.length(t)).otherwise(0)).alias("chars"),
            (s["duplicates"] + one(~blank & ~long & again)).alias("duplicates"),
            (s["too_long"] + one(~blank & long)).alias("too_long"),
            (s["over"] + one(~blank & ~long & ~again & over)).alias("over"),
        )

    done = lambda s: F.struct(s["kept"].alias("kept"), F.size(s["kept"]).alias("added"), s["duplicates"].alias("duplicates"), s["too_long"].alias("too_long"), s["over"].alias("over_budget"))
    return F.aggregate(terms, state, step, done)


def compacted_roots(roots: DataFrame, page: str = "page_id", path: str = "path") -> DataFrame:
    """Queued roots without those that have a queued ancestor; paths are arrays of child indexes from the page's root.

    An anti join on the page and each proper prefix of the path.
    """
    above = roots.select(page, path, F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size(path) - 1, F.lit(0))), lambda n: F.slice(F.col(path), 1, n))).alias("_up")).where(F.size(path) > F.size("_up"))
    queued = roots.select(F.col(page).alias("_p"), F.col(path).alias("_q")).distinct()
    covered = above.join(queued, (F.col(page) == F.col("_p")) & (F.col("_up") == F.col("_q")), "left_semi").select(page, path).distinct()
    return roots.distinct().join(covered, [page, path], "left_anti")


def profile_lenses(profiles: DataFrame, lenses: DataFrame) -> DataFrame:
    """(profile_id, pos, lens columns) of each profile's lenses that exist, in the lenses' own order."""
    wanted = profiles.select("profile_id", F.explode("lens_ids").alias("lens_id")).distinct()
    return lenses.join(wanted, "lens_id")


def inverse_segments(text: Column, found: Column) -> Column:
    """Segments that keep whole matches, joined where they touch, and cover all else."""
    return expr.segments(text, expr.merge(expr.target_ranges(found, "match"), touching=True), inverse=True)


def rule_stats(found: DataFrame, by: list[str], key: str = "doc_id") -> DataFrame:
    """Matches and distinct documents by rule and the columns ``by`` that came with the matches, with all subtotals.

    Matches are counted by document before they meet, so what moves and is expanded to subtotals is a row a rule and document.
    """
    counted = found.groupBy(key, *by, "rule_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.rollup(*by, "rule_id").agg(F.sum("n").alias("n_matches"), F.countDistinct(key).alias("n_docs"))


def first_per_document(found: DataFrame, k: int = 1, key: str = "doc_id") -> DataFrame:
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_n") <= k).drop("_n")

