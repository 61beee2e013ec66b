"""Registered queries over the rule-matching operators, each with its SQL where SQL can express it.

The SQL walks tokens: runs of word characters and runs of all others, whose lengths add up to offsets. It shares nothing with
the engine's own way to a result.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil import packs
from spanveil.operators import expr
from spanveil.operators import relational as rel
from spanveil.operators import views
from spanveil.operators.engine import Engine, vowels
from spanveil.operators.rules import Entry, confusable_rule, matcher_rule, obfuscated_rule, regex_rule, repeated_rule, rules_from_packs, targeted_rule, term_rule, transformed_rule, width_rule
from spanveil.sources import html, state
from spanveil.streaming import range_index

WORDS = ["the", "of", "was", "éa", "worthless"]
PHRASES = ["of the", "the of", "the", "in the", "of"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: Tables whose texts go to Python, and the bytes of a split that keeps a core busy there.
TEXTS, SPLIT_BYTES = ("documents", "pages", "conversations"), 128 << 20


def read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table; texts that lie in fewer files than there are cores are dealt to all of them, if a few splits hold them all.

    A row group can't be split, so a small table in one file would be one task however many cores there are. Larger
    tables have row groups for all, and are left as they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name not in TEXTS or len(df.inputFiles()) >= cores:
        return df
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def _words(**options) -> Engine:
    return Engine([term_rule("words", WORDS, **options)])



def _matched(spark, sf_dir, engine, *keep):
    return read(spark, sf_dir).select("doc_id", "text", *keep, engine.find_column(F.col("text")).alias("m"))


def _rows(df: DataFrame, *more) -> DataFrame:
    return df.select("doc_id", *more, F.posexplode("m").alias("pos", "x"))


# SQL pieces

_CLASS = r"\p{L}\p{N}\p{M}\p{Pc}"


def _tokens(text: str = "text", table: str = "documents", keys: str = "doc_id") -> str:
    pattern = rf"'[{_CLASS}]+|[^{_CLASS}]+'"
    return f"""
      src AS (SELECT {keys}, {text} AS t FROM {table}),
      tok AS (SELECT {keys}, unnest(regexp_extract_all(t, {pattern})) AS w, generate_subscripts(regexp_extract_all(t, {pattern}), 1) AS i FROM src),
      pos AS (SELECT {keys}, i, w, CAST(sum(length(w)) OVER (PARTITION BY {keys} ORDER BY i) - length(w) AS BIGINT) AS s, CAST(sum(length(w)) OVER (PARTITION BY {keys} ORDER BY i) AS BIGINT) AS e FROM tok)"""


_LIST = ", ".join(f"'{w}'" for w in WORDS)
_HITS = f"WITH {_tokens()}, hit AS (SELECT doc_id, i, w, s, e FROM pos WHERE lower(w) IN ({_LIST}))"
_PHRASE = f"""WITH {_tokens()},
  two AS (SELECT doc_id, i, w, s, e, lead(w, 1) OVER o AS sep, lead(w, 2) OVER o AS w2, lead(e, 2) OVER o AS e2 FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  hit AS (SELECT doc_id, s, e, w AS m FROM two WHERE lower(w) IN ('the', 'of')
    UNION ALL SELECT doc_id, s, e2, w || sep || w2 FROM two WHERE sep = ' ' AND lower(w) || ' ' || lower(w2) IN ('of the', 'the of', 'in the'))"""


def _split(text: str, needle: str) -> str:
    """Occurrences of a needle that can't overlap itself."""
    n = len(needle)
    parts = f"string_split({text}, '{needle}')"
    return f"""part AS (SELECT doc_id, t, unnest(string_split({text}, '{needle}')) AS p, generate_subscripts({parts}, 1) AS i, len({parts}) AS k FROM src),
      hit AS (SELECT doc_id, t, i, k, CAST(sum(length(p) + {n}) OVER (PARTITION BY doc_id ORDER BY i) - {n} AS BIGINT) AS s FROM part)"""


def _plain(df: DataFrame) -> DataFrame:
    return _rows(df).select("doc_id", F.col("x.text").alias("match_text"), F.col("x.start").cast("long").alias("start_at"), F.col("x.end").cast("long").alias("end_at"))


# matching


@query("term_find_offsets", f"{_HITS} SELECT doc_id, w AS match_text, s AS start_at, e AS end_at FROM hit")
def term_find_offsets(spark, sf_dir):
    return _plain(_matched(spark, sf_dir, _words()))


@query("term_case_sensitive", f"WITH {_tokens()} SELECT doc_id, w AS match_text, s AS start_at, e AS end_at FROM pos WHERE w IN ({_LIST})")
def term_case_sensitive(spark, sf_dir):
    return _plain(_matched(spark, sf_dir, _words(case_sensitive=True)))


@query("term_substring_find", f"WITH src AS (SELECT doc_id, text AS t FROM documents), {_split('lower(t)', 'tion')} SELECT doc_id, substr(t, CAST(s AS INTEGER) + 1, 4) AS match_text, s AS start_at, s + 4 AS end_at FROM hit WHERE i < k")
def term_substring_find(spark, sf_dir):
    return _plain(_matched(spark, sf_dir, Engine([term_rule("tion", ["tion"], boundary="substring")])))


@query("term_overlap_find", f"{_PHRASE} SELECT doc_id, m AS match_text, s AS start_at, e AS end_at FROM hit")
def term_overlap_find(spark, sf_dir):
    return _plain(_matched(spark, sf_dir, Engine([term_rule("phrases", PHRASES)])))


@query("match_identity", f"{_PHRASE} SELECT doc_id, 'm' || (row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC) - 1) AS match_id, s AS start_at, e AS end_at FROM hit")
def match_identity(spark, sf_dir):
    df = _matched(spark, sf_dir, Engine([term_rule("phrases", PHRASES)]))
    ids = df.select("doc_id", F.explode(expr.identified(F.col("m"))).alias("x"))
    return ids.select("doc_id", "x.match_id", F.col("x.start").cast("long").alias("start_at"), F.col("x.end").cast("long").alias("end_at"))


@query("first_match", f"{_PHRASE} SELECT doc_id, min(s) AS start_at FROM hit GROUP BY doc_id")
def first_match(spark, sf_dir):
    df = _matched(spark, sf_dir, Engine([term_rule("phrases", PHRASES)])).where(F.size("m") > 0)
    return df.select("doc_id", F.element_at("m", 1)["start"].cast("long").alias("start_at"))


@query("regex_target_find", f"WITH {_tokens()} SELECT doc_id, w AS match_text, s AS target_start, s + 1 AS target_end, e AS end_at FROM pos WHERE regexp_full_match(lower(w), 't(he|o|hat)')")
def regex_target_find(spark, sf_dir):
    rule = regex_rule("t", packs.EDGE_BEFORE + "(?<head>t)(?:hat|he|o)" + packs.EDGE_AFTER, "giu", group="head")
    rows = _rows(_matched(spark, sf_dir, Engine([rule])))
    return rows.select("doc_id", F.col("x.text").alias("match_text"), F.col("x.target_start").cast("long").alias("target_start"), F.col("x.target_end").cast("long").alias("target_end"), F.col("x.end").cast("long").alias("end_at"))


_INJECTED = "replace(replace(replace(text, ' the ', ' motherfucking '), ' was ', ' Shitty '), ' in ', ' assholes ')"


@query(
    "en_canonical_find",
    f"""WITH {_tokens(_INJECTED)}, named AS (SELECT *, CASE WHEN regexp_full_match(lower(w), '(mother)?fuck(ing|ed|er|ers|s)?') THEN 'fuck' WHEN regexp_full_match(lower(w), '(bull)?shit(ting|ted|ter|ters|s|ty)?') THEN 'shit'
      WHEN regexp_full_match(lower(w), 'bitch(es|ing|ed|y)?') THEN 'bitch' WHEN regexp_full_match(lower(w), 'assholes?') THEN 'asshole' WHEN regexp_full_match(lower(w), 'cunts?') THEN 'cunt' END AS rule_id FROM pos)
      SELECT doc_id, rule_id, s AS start_at, e AS end_at, s + strpos(lower(w), rule_id) - 1 AS target_start FROM named WHERE rule_id IS NOT NULL""",
)
def en_canonical_find(spark, sf_dir):
    engine = Engine(rules_from_packs(packs.CANONICAL))
    docs = read(spark, sf_dir).select("doc_id", F.expr(_INJECTED).alias("text"))
    rows = _rows(docs.select("doc_id", engine.find_column(F.col("text")).alias("m")))
    return rows.select("doc_id", "x.rule_id", *(F.col(f"x.{a}").cast("long").alias(b) for a, b in (("start", "start_at"), ("end", "end_at"), ("target_start", "target_start"))))


@query("en_obfuscated_find", f"WITH src AS (SELECT doc_id, replace(text, ' of ', ' sh1ts ') AS t FROM documents), {_split('t', ' sh1ts ')} SELECT doc_id, 'shit-obfuscated' AS rule_id, s + 1 AS start_at, s + 6 AS end_at, s + 5 AS target_end FROM hit WHERE i < k")
def en_obfuscated_find(spark, sf_dir):
    engine = Engine(rules_from_packs(packs.OBFUSCATED))
    docs = read(spark, sf_dir).select("doc_id", F.replace("text", F.lit(" of "), F.lit(" sh1ts ")).alias("text"))
    rows = _rows(docs.select("doc_id", engine.find_column(F.col("text")).alias("m")))
    return rows.select("doc_id", "x.rule_id", *(F.col(f"x.{a}").cast("long").alias(b) for a, b in (("start", "start_at"), ("end", "end_at"), ("target_end", "target_end"))))


@query("obfuscated_term_find", f"WITH {_tokens()} SELECT doc_id, w AS match_text, s AS start_at, e AS end_at FROM pos WHERE lower(w) <> 'ea' AND translate(w, 'éÉ', 'ee') IN ('ea', 'eA', 'Ea', 'EA') AND translate(w, 'é', 'e') <> w AND strpos(w, 'É') = 0")
def obfuscated_term_find(spark, sf_dir):
    return _plain(_matched(spark, sf_dir, Engine([obfuscated_rule("ea", ["ea"], substitutions={"e": ["é"]}, max_substitutions=1)])))


def _evasion(name: str, rule, *forms: tuple) -> None:
    """Forms of a term put in the place of every " of ", one form a document: (form, target start and end, or None if no match)."""
    pick = lambda k: "CASE doc_id % {} {} END".format(len(forms), " ".join(f"WHEN {i} THEN {value(f, k)}" for i, f in enumerate(forms)))
    value = lambda f, k: "NULL" if f[k] is None else f"'{f[k]}'" if k == 0 else str(f[k])
    sql = f"""WITH src AS (SELECT doc_id, text AS t, {pick(0)} AS f, {pick(1)} AS a, {pick(2)} AS b FROM documents),
      part AS (SELECT doc_id, f, a, b, unnest(string_split(t, ' of ')) AS p, generate_subscripts(string_split(t, ' of '), 1) AS i, len(string_split(t, ' of ')) AS k FROM src),
      hit AS (SELECT *, CAST(sum(length(p) + length(f) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(f) - 2 AS BIGINT) AS s FROM part)
      SELECT doc_id, f AS match_text, s + 1 AS start_at, s + 1 + length(f) AS end_at, s + 1 + a AS target_start, s + 1 + b AS target_end FROM hit WHERE i < k AND a IS NOT NULL"""

    @query(name, sql)
    def run(spark, sf_dir):
        engine = Engine([rule])
        docs = read(spark, sf_dir).select("doc_id", F.replace("text", F.lit(" of "), F.concat(F.lit(" "), F.expr(pick(0)), F.lit(" "))).alias("text"))
        rows = _rows(docs.select("doc_id", engine.find_column(F.col("text")).alias("m")))
        at = (("start", "start_at"), ("end", "end_at"), ("target_start", "target_start"), ("target_end", "target_end"))
        return rows.select("doc_id", F.col("x.text").alias("match_text"), *(F.col(f"x.{a}").cast("long").alias(b) for a, b in at))


_evasion("repeated_term_find", repeated_rule("z", ["zorbal"], 3), ("zzorbal", 0, 7), ("zorrrbal", 0, 8), ("zorbaaaaal", None, None), ("ZORBBAL", 0, 7), ("zorbal", None, None))
_evasion("fullwidth_term_find", width_rule("z", ["zorbal"], {"o": ["\uff4f"], "a": ["\uff41"]}, 1, 0, max_changes=1), ("z\uff4frbal", 0, 6), ("z\uff4frb\uff41l", None, None), ("zorb\uff41l", 0, 6), ("zorbal", None, None))
_evasion("lookalike_term_find", confusable_rule("z", ["zorbal"], {"o": ["\u043e"], "a": ["\u0430"]}, 1, 1, max_changes=2), ("z\u043erbal", 0, 6), ("z\u043erb\u0430l", None, None), ("zorrb\u0430l", 0, 7), ("z\u043e\u043erbal", None, None))
_evasion("separated_term_find", obfuscated_rule("z", ["zorbal"], ignored=[".", "-"], max_ignored=2, max_changes=2), ("z.orbal", 0, 7), ("z-o.rbal", 0, 8), ("z.o.r.bal", None, None), ("zorbal", None, None))
_evasion("targeted_term_find", targeted_rule("z", [Entry("zorbal", target="bal")], substitutions={"o": ["0"]}, max_substitutions=1, max_changes=1), ("z0rbal", 3, 6), ("Z0RBAL", 3, 6), ("zorbal", None, None))


def _bare(g: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", g) if unicodedata.category(c) != "Mn")


@query("transformed_term_find", f"WITH {_tokens()} SELECT doc_id, w AS match_text, s AS start_at, e AS end_at FROM pos WHERE lower(strip_accents(w)) IN ('ea', 'mas', 'fur')")
def transformed_term_find(spark, sf_dir):
    return _plain(_matched(spark, sf_dir, Engine([transformed_rule("bare", ["ea", "mas", "fur"], _bare)])))


def _capitals(text: str):
    import re

    for m in re.finditer("[A-Z]{2,}", text):
        yield m.span()


@query("custom_matcher_find", r"WITH src AS (SELECT doc_id, text AS t FROM documents), tok AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Z]{2,}|[^A-Z]+|[A-Z]')) AS w, generate_subscripts(regexp_extract_all(t, '[A-Z]{2,}|[^A-Z]+|[A-Z]'), 1) AS i FROM src), pos AS (SELECT *, CAST(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM tok) SELECT doc_id, w AS match_text, e - length(w) AS start_at, e AS end_at FROM pos WHERE regexp_full_match(w, '[A-Z]{2,}')")
def custom_matcher_find(spark, sf_dir):
    return _plain(_matched(spark, sf_dir, Engine([matcher_rule("capitals", _capitals)])))


# coverage


def _coverage(name: str, start: str, end: str) -> None:
    short = {"full": 0, "tail": 1, "inner": 2, "middle": 1}[name]
    sql = f"{_HITS}, n AS (SELECT *, length_grapheme(w) AS n FROM hit) SELECT doc_id, CASE WHEN n <= {short} THEN s ELSE {start} END AS start_at, CASE WHEN n <= {short} THEN e ELSE {end} END AS end_at FROM n"

    @query(f"coverage_{name}", sql)
    def run(spark, sf_dir):
        df = _matched(spark, sf_dir, _words())
        rows = df.select("doc_id", F.explode(expr.preset_covers(F.col("m"), name)).alias("r"))
        return rows.select("doc_id", F.col("r.start").cast("long").alias("start_at"), F.col("r.end").cast("long").alias("end_at"))


_coverage("full", "s", "e")
_coverage("tail", "s + 1", "e")
_coverage("inner", "s + 1", "e - 1")
_coverage("middle", "s + CAST(floor((n - ceil(n / 2)) / 2) AS BIGINT)", "s + CAST(floor((n - ceil(n / 2)) / 2) + ceil(n / 2) AS BIGINT)")


@query("coverage_vowel", f"{_HITS}, c AS (SELECT doc_id, s, w, unnest(range(1, length(w) + 1)) AS k FROM hit) SELECT doc_id, CAST(s + k - 1 AS BIGINT) AS start_at, CAST(s + k AS BIGINT) AS end_at FROM c WHERE lower(strip_accents(substr(w, k, 1))) IN ('a', 'e', 'i', 'o', 'u')")
def coverage_vowel(spark, sf_dir):
    engine = Engine([term_rule("words", WORDS)], coverage=vowels)
    rows = read(spark, sf_dir).select("doc_id", F.explode(expr.covered(engine.segment_column(F.col("text")))).alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"))


_ISLANDS = f"""{_PHRASE}, o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hit),
  g AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS island FROM o),
  merged AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM g GROUP BY doc_id, island)"""


@query("merge_ranges", f"{_ISLANDS} SELECT doc_id, s AS start_at, e AS end_at FROM merged")
def merge_ranges(spark, sf_dir):
    df = _matched(spark, sf_dir, Engine([term_rule("phrases", PHRASES)]))
    rows = df.select("doc_id", F.explode(expr.merge(expr.full_covers(F.col("m")))).alias("r"))
    return rows.select("doc_id", F.col("r.start").cast("long").alias("start_at"), F.col("r.end").cast("long").alias("end_at"))


def _partition(merged: str, on: str, off: str) -> str:
    return f"""stops AS (SELECT doc_id, s, e FROM {merged} UNION ALL SELECT doc_id, length(text), length(text) FROM documents),
      gaps AS (SELECT doc_id, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, s AS b FROM stops),
      parts AS (SELECT doc_id, a, b, {off} AS covered FROM gaps WHERE b > a UNION ALL SELECT doc_id, s, e, {on} FROM {merged} UNION ALL SELECT doc_id, 0, 0, {off} FROM documents WHERE length(text) = 0)
      SELECT doc_id, CAST(a AS BIGINT) AS start_at, CAST(b AS BIGINT) AS end_at, covered, substr(text, CAST(a AS INTEGER) + 1, CAST(b - a AS INTEGER)) AS segment_text FROM parts JOIN documents USING (doc_id)"""


def _parts(df: DataFrame, segments) -> DataFrame:
    rows = df.select("doc_id", F.explode(segments).alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), "s.covered", F.col("s.text").alias("segment_text"))


@query("segments_located", f"{_ISLANDS}, {_partition('merged', 'true', 'false')}")
def segments_located(spark, sf_dir):
    return _parts(read(spark, sf_dir), Engine([term_rule("phrases", PHRASES)]).segment_column(F.col("text")))


@query("segments_native", f"{_ISLANDS}, {_partition('merged', 'true', 'false')}")
def segments_native(spark, sf_dir):
    df = _matched(spark, sf_dir, Engine([term_rule("phrases", PHRASES)]))
    return _parts(df, expr.segments(F.col("text"), expr.merge(expr.full_covers(F.col("m")))))


@query("inverse_segments", f"{_ISLANDS}, {_partition('merged', 'false', 'true')}")
def inverse_segments(spark, sf_dir):
    df = _matched(spark, sf_dir, Engine([term_rule("phrases", PHRASES)]))
    return _parts(df, rel.inverse_segments(F.col("text"), F.col("m")))


@query("restore_text", "SELECT doc_id, text FROM documents")
def restore_text(spark, sf_dir):
    return read(spark, sf_dir).select("doc_id", expr.restored(_words().segment_column(F.col("text"))).alias("text"))


def _of_all(sql: str, **empty: str) -> str:
    """``sql``, which has no rows for texts without tokens, with all documents: nulls for null texts, these values for empty ones."""
    cols = ", ".join(f"CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.{c}, {value}) END AS {c}" for c, value in empty.items())
    return f"SELECT d.doc_id, {cols} FROM documents d LEFT JOIN ({sql}) x ON x.doc_id = d.doc_id"


def _mask(name: str, hidden: str) -> None:
    @query(f"mask_{name}", _of_all(f"WITH {_tokens()} SELECT doc_id, string_agg(CASE WHEN lower(w) IN ({_LIST}) THEN {hidden} ELSE w END, '' ORDER BY i) AS masked FROM pos GROUP BY doc_id", masked="''"))
    def run(spark, sf_dir):
        df = _matched(spark, sf_dir, _words())
        return df.select("doc_id", expr.masked(expr.segments(F.col("text"), expr.merge(expr.full_covers(F.col("m")))), name).alias("masked"))


_mask("asterisk", "repeat('*', length(w))")
_mask("grawlix", "substr(repeat('@#$%&!', 10), 1, length(w))")


# sanitizing


def _sanitize(name: str, replacement: str | None) -> None:
    said = (replacement or "").replace("'", "''")

    @query(name, _of_all(f"WITH {_tokens()} SELECT doc_id, string_agg(CASE WHEN lower(w) IN ({_LIST}) THEN '{said}' ELSE w END, '' ORDER BY i) AS clean, CAST(sum(CASE WHEN lower(w) IN ({_LIST}) THEN 1 ELSE 0 END) AS BIGINT) AS n_ranges FROM pos GROUP BY doc_id", clean="''", n_ranges="0"))
    def run(spark, sf_dir):
        docs = read(spark, sf_dir)
        out = docs.select("doc_id", _words().sanitize_column(F.col("text"), replacement).alias("r"))
        return out.select("doc_id", F.col("r.text").alias("clean"), F.col("r.range_count").cast("long").alias("n_ranges"))


_sanitize("sanitize_target", "[x]")
_sanitize("sanitize_omit", None)


@query("sanitize_match", _of_all(f"WITH {_tokens()} SELECT doc_id, string_agg(CASE WHEN regexp_full_match(lower(w), 't(he|o|hat)') THEN '#' ELSE w END, '' ORDER BY i) AS clean FROM pos GROUP BY doc_id", clean="''"))
def sanitize_match(spark, sf_dir):
    rule = regex_rule("t", packs.EDGE_BEFORE + "(?<head>t)(?:hat|he|o)" + packs.EDGE_AFTER, "giu", group="head")
    df = _matched(spark, sf_dir, Engine([rule]))
    return df.select("doc_id", expr.spliced(F.col("text"), expr.merge(expr.target_ranges(F.col("m"), "match")), "#").alias("clean"))


_VERIFIED = f"""WITH {_tokens()}, clean AS (SELECT doc_id, string_agg(CASE WHEN lower(w) IN ({_LIST}) THEN '[x]' ELSE w END, '' ORDER BY i) AS c FROM pos GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, w FROM pos WHERE lower(w) IN ({_LIST})), still AS (SELECT doc_id, count(*) AS n FROM gone JOIN clean USING (doc_id) WHERE contains(c, w) GROUP BY doc_id)"""


@query("sanitize_verify", _of_all(f"{_VERIFIED} SELECT doc_id, coalesce(n, 0) AS n_present, coalesce(n, 0) = 0 AS absent FROM clean LEFT JOIN still USING (doc_id)", n_present="0", absent="true"))
def sanitize_verify(spark, sf_dir):
    docs = read(spark, sf_dir)
    out = docs.select("doc_id", _words().sanitize_column(F.col("text"), "[x]", verify=True).alias("r"))
    return out.select("doc_id", F.size("r.source_absence.present").cast("long").alias("n_present"), F.col("r.source_absence.absent").alias("absent"))


@query("export_gate", f"{_VERIFIED} SELECT doc_id, c AS clean FROM clean LEFT JOIN still USING (doc_id) WHERE n IS NULL UNION ALL SELECT doc_id, '' FROM documents WHERE text = ''")
def export_gate(spark, sf_dir):
    docs = read(spark, sf_dir)
    out = docs.select("doc_id", _words().sanitize_column(F.col("text"), "[x]", verify=True).alias("report"))
    return views.exportable(out).select("doc_id", F.col("report.text").alias("clean"))


@query("xray_stages", f"{_PHRASE}, f AS (SELECT doc_id, s, e, m, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC) AS r FROM hit) SELECT doc_id, m AS match_text, CAST(0 AS BIGINT) AS target_start, e - s AS target_end FROM f WHERE r = 1")
def xray_stages(spark, sf_dir):
    df = read(spark, sf_dir).select("doc_id", views.stages(Engine([term_rule("phrases", PHRASES)]), F.col("text")).alias("s")).where("s IS NOT NULL")
    return df.select("doc_id", F.col("s.match").alias("match_text"), F.col("s.target_start").cast("long").alias("target_start"), F.col("s.target_end").cast("long").alias("target_end"))


@query("visual_controls", f"{_ISLANDS} SELECT doc_id, count(*) AS n_controls FROM merged GROUP BY doc_id")
def visual_controls(spark, sf_dir):
    df = read(spark, sf_dir).select("doc_id", views.visual_column(Engine([term_rule("phrases", PHRASES)]), F.col("text"), "grawlix").alias("v"))
    return df.select("doc_id", F.size("v.controls").cast("long").alias("n_controls")).where("n_controls > 0")


@query("covered_edges", f"{_ISLANDS} SELECT doc_id, s AS start_at, CASE WHEN count(*) OVER d = 1 THEN 'solo' WHEN row_number() OVER (PARTITION BY doc_id ORDER BY s) = 1 THEN 'start' WHEN row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) = 1 THEN 'end' ELSE 'middle' END AS edge FROM merged WINDOW d AS (PARTITION BY doc_id)")
def covered_edges(spark, sf_dir):
    """A document's covers as one group: the place of each among them."""
    parts = rel.segments(read(spark, sf_dir), Engine([term_rule("phrases", PHRASES)])).where("covered")
    return views.edges(parts.select("doc_id", F.lit("m0").alias("reveal_id"), F.col("start").cast("long").alias("pos"))).select("doc_id", F.col("pos").alias("start_at"), "edge")


@query("reveal_clicks", "WITH l AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN event_id END) AS r FROM events GROUP BY user_id) SELECT user_id, 'm0' AS reveal_id FROM events JOIN l USING (user_id) WHERE event_type = 'click' AND (r IS NULL OR event_id > r) GROUP BY user_id HAVING count(*) % 2 = 1")
def reveal_clicks(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "reset").when(F.col("event_type") == "click", "click").otherwise("other")
    log = read(spark, sf_dir, "events").select("user_id", F.lit("m0").alias("reveal_id"), kind.alias("kind"), F.col("event_id").alias("seq"))
    return views.revealed(log, "user_id")


# relational


def _by_word(spark, sf_dir, only: DataFrame | None = None, keep: list[str] = ()):
    """Matches of the words, one rule each, in all documents or in those that ``only`` names."""
    docs = read(spark, sf_dir)
    docs = docs if only is None else docs.join(only.select("doc_id"), "doc_id", "left_semi")
    return rel.matches(docs, Engine([term_rule(w, [w]) for w in WORDS]), keep=keep)


@query("rule_stats_by_lang", f"{_HITS} SELECT lang, lower(w) AS rule_id, count(*) AS n_matches, count(DISTINCT doc_id) AS n_docs FROM hit JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, lower(w))")
def rule_stats_by_lang(spark, sf_dir):
    return rel.rule_stats(_by_word(spark, sf_dir, keep=["lang"]), ["lang"])


@query("toxic_join", f"{_HITS} SELECT toxic, lower(w) AS rule_id, count(*) AS n_matches FROM hit JOIN labels USING (doc_id) GROUP BY 1, 2")
def toxic_join(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = _by_word(spark, sf_dir, labels).groupBy("doc_id", "rule_id").count()
    return found.join(labels, "doc_id").groupBy("toxic", "rule_id").agg(F.sum("count").alias("n_matches"))


@query("top_documents", f"{_HITS} SELECT doc_id, count(*) AS n_matches FROM hit GROUP BY doc_id ORDER BY n_matches DESC, doc_id LIMIT 20")
def top_documents(spark, sf_dir):
    df = _matched(spark, sf_dir, _words()).select("doc_id", F.size("m").cast("long").alias("n_matches"))
    return df.where("n_matches > 0").orderBy(F.desc("n_matches"), "doc_id").limit(20)


EPISODES = {"the": 1, "of": 2, "was": 3}


@query(
    "progress_filter",
    f"WITH {_tokens('text', 'conversations', 'conv_id, turn')} SELECT conv_id, turn, lower(w) AS rule_id, s AS start_at FROM pos WHERE CASE lower(w) WHEN 'the' THEN 1 WHEN 'of' THEN 2 WHEN 'was' THEN 3 ELSE 0 END > least(turn, 3) AND lower(w) IN ('the', 'of', 'was')",
)
def progress_filter(spark, sf_dir):
    """Rules of episodes beyond what was watched; here the turn stands for progress. One engine for each of the few stages."""
    talk = read(spark, sf_dir, "conversations").withColumn("watched", F.least(F.col("turn"), F.lit(3)))
    out = []
    for watched in range(3):
        engine = Engine([term_rule(w, [w]) for w, episode in EPISODES.items() if episode > watched])
        part = talk.where(F.col("watched") == watched).select("conv_id", "turn", F.explode(engine.find_column(F.col("text"))).alias("m"))
        out.append(part.select("conv_id", "turn", "m.rule_id", F.col("m.start").cast("long").alias("start_at")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "site_policy",
    """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, url FROM pages),
    o AS (SELECT host, arg_max(CASE WHEN contains(url, '/en/') THEN 'off' ELSE 'on' END, page_id) AS mode FROM p WHERE contains(url, '/en/') OR contains(url, '/de/') GROUP BY host)
    SELECT page_id, host, coalesce(mode <> 'off', true) AS active FROM p LEFT JOIN o USING (host)""",
)
def site_policy(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    mode = F.when(F.contains("url", F.lit("/en/")), "off").when(F.contains("url", F.lit("/de/")), "on").otherwise("inherit")
    overrides = pages.select(F.upper(F.parse_url("url", F.lit("HOST"))).alias("host"), mode.alias("mode"), F.col("page_id").alias("position"))
    return rel.site_policy(pages, overrides).select("page_id", "host", "active")


@query(
    "corpus_diff",
    f"""WITH {_tokens("replace(text, ' the ', ' teh ')")}, head AS (SELECT doc_id, count(*) FILTER (lower(w) = 'the') AS n FROM pos GROUP BY doc_id)
    SELECT doc_id, CASE WHEN source = 'src0' THEN 'removed' WHEN source = 'src1' THEN 'added' WHEN replace(text, ' the ', ' teh ') <> text THEN 'text' ELSE 'unchanged' END AS bucket FROM documents""",
)
def corpus_diff(spark, sf_dir):
    engine = Engine([term_rule("the", ["the"])])
    case = lambda df: df.select("doc_id", "text", engine.find_column(F.col("text")).alias("matches"))
    docs = read(spark, sf_dir)
    head = docs.where("source IS DISTINCT FROM 'src0'").withColumn("text", F.replace("text", F.lit(" the "), F.lit(" teh ")))
    return rel.diff(case(docs.where("source IS DISTINCT FROM 'src1'")), case(head), ["doc_id"])


@query("segment_match_overlap", f"{_ISLANDS}, hits AS (SELECT doc_id, s, e FROM hit) SELECT m.doc_id, m.s AS segment_start, count(*) AS n_matches FROM merged m JOIN hits h ON m.doc_id = h.doc_id AND m.s < h.e AND m.e > h.s GROUP BY 1, 2")
def segment_match_overlap(spark, sf_dir):
    engine, docs = Engine([term_rule("phrases", PHRASES)]), read(spark, sf_dir)
    parts = rel.segments(docs, engine)
    joined = rel.overlaps(parts, rel.matches(docs, engine)).groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("n_matches"))
    return joined.join(parts.select("doc_id", F.col("pos").alias("segment"), F.col("start").cast("long").alias("segment_start")), ["doc_id", "segment"]).select("doc_id", "segment_start", "n_matches")


@query("disclosure_groups", f"{_ISLANDS} SELECT doc_id, count(*) AS n_groups FROM merged GROUP BY doc_id")
def disclosure_groups(spark, sf_dir):
    both = read(spark, sf_dir).select("doc_id", Engine([term_rule("phrases", PHRASES)]).find_and_segment(F.col("text")).alias("b"))
    groups = both.select("doc_id", F.size(rel.disclosure_groups(F.col("b"))).cast("long").alias("n_groups"))
    return groups.where("n_groups > 0")


@query("term_list", "WITH t AS (SELECT item_id, trim(unnest(string_split(replace(text, chr(10), ','), ','))) AS term, generate_subscripts(string_split(replace(text, chr(10), ','), ','), 1) AS i FROM benchmark), f AS (SELECT *, row_number() OVER (PARTITION BY item_id, lower(term) ORDER BY i) AS r FROM t WHERE term <> '') SELECT item_id, term FROM f WHERE r = 1")
def term_list(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.explode(rel.term_list(F.col("text"))).alias("term"))


@query(
    "budgeted_terms",
    """WITH RECURSIVE w AS (SELECT item_id, unnest(string_split(text, ' ')) AS term, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark),
    f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lower(trim(term)) ORDER BY i) AS q FROM w WHERE trim(term) <> '' AND length(trim(term)) <= 12) WHERE q = 1),
    walk AS (SELECT item_id, 0::BIGINT AS r, 0::BIGINT AS n, 0::BIGINT AS chars FROM (SELECT DISTINCT item_id FROM w)
      UNION ALL SELECT k.item_id, f.r, k.n + CASE WHEN k.n < 20 AND k.chars + length(trim(term)) <= 60 THEN 1 ELSE 0 END, k.chars + CASE WHEN k.n < 20 AND k.chars + length(trim(term)) <= 60 THEN length(trim(term)) ELSE 0 END FROM walk k JOIN f ON f.item_id = k.item_id AND f.r = k.r + 1)
    SELECT item_id, max(n) AS n_kept, max(chars) AS n_chars FROM walk GROUP BY item_id""",
)
def budgeted_terms(spark, sf_dir):
    kept = rel.budgeted_terms(F.split("text", " "), longest=12, most=20, total=60)["kept"]
    rows = read(spark, sf_dir, "benchmark").select("item_id", kept.alias("kept"))
    return rows.select("item_id", F.size("kept").cast("long").alias("n_kept"), F.aggregate("kept", F.lit(0), lambda a, t: a + F.length(t)).cast("long").alias("n_chars"))


# pages


@query("page_text_find")
def page_text_find(spark, sf_dir):
    return html.covered_nodes(read(spark, sf_dir, "pages"), _words())


@query("page_apply_counts")
def page_apply_counts(spark, sf_dir):
    return html.apply_counts(read(spark, sf_dir, "pages"), _words(), html.profile("page"))


@query("page_render")
def page_render(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", html.render(F.col("html"), _words()).alias("html"))


# change feeds and state


def _feed(spark, sf_dir) -> DataFrame:
    op = F.when(F.col("value") < 5, "delete").otherwise("upsert")
    return read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("page_id"), F.col("user_id").alias("node_id"), op.alias("op"), F.concat_ws(" ", "event_type", "props").alias("text"), F.col("event_id").alias("seq"))


@query("range_index", "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS v FROM events GROUP BY user_id) SELECT user_id % 7 AS page_id, user_id AS node_id, CAST(0 AS BIGINT) AS start_at, CAST(length(kind) AS BIGINT) AS end_at FROM l WHERE v >= 5 AND kind IN ('error', 'signup', 'click')")
def range_index_query(spark, sf_dir):
    found = range_index.index(_feed(spark, sf_dir), Engine([term_rule("kinds", ["error", "signup", "click"])]))
    return found.select("page_id", "node_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"))


@query("metric_window", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def metric_window(spark, sf_dir):
    return range_index.windowed_counts(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("state_fold", "SELECT user_id, arg_max(event_type = 'error', event_id) AS paused FROM events GROUP BY user_id")
def state_fold(spark, sf_dir):
    intent = F.to_json(F.struct(F.lit("set_paused").alias("type"), (F.col("event_type") == "error").alias("value")))
    log = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), intent.alias("intent"))
    return state.fold_log(log).select("user_id", F.get_json_object("state", "$.paused").cast("boolean").alias("paused"))
