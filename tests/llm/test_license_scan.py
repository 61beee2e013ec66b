import re

import pytest

from spanveil.llm import license_scan as ls
from spanveil.llm import queries
from tests.llm.helpers import DOCS, LONG, awkward, clashing


def shingles(text):
    w = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows, texts=None):
    """Every template against every stretch of twice its length."""
    out = []
    for key, text in rows:
        have = shingles(text)
        for name, t in (texts or ls.TEMPLATES).items():
            want = set(shingles(t))
            best = max((len(want & set(have[i : i + 2 * len(want)])) for i in range(len(have))), default=0)
            if best * 10 >= len(want) * 8:
                out.append((key, name, len(want), best))
    return sorted(out, key=str)


def found(df, texts=None):
    return sorted(((r[0], r.license, r.n_template, r.n_found) for r in ls.scan(df, texts).collect()), key=str)


def planted():
    mit = ls.TEMPLATES["MIT"].split()
    rows = [(i, f"{' '.join(LONG.split()[: i * 7])} {t} and then more of it") for i, t in enumerate(ls.TEMPLATES.values())]
    rows += [(100, " ".join(mit[: len(mit) // 2])), (101, " ".join(mit[8:])), (102, " ".join(w for i, w in enumerate(mit) if i != 60)), (103, ls.TEMPLATES["MIT"].upper().replace(" ", "\n * ")), (104, LONG), (105, ls.TEMPLATES["GPL-3.0-line"][:60])]
    rows += [(106, ls.TEMPLATES["ISC"]), (106, ls.TEMPLATES["ISC"]), (None, ls.TEMPLATES["MIT-line"]), (107, " ".join(ls.TEMPLATES.values()))]
    return rows


@pytest.mark.parametrize("extra", [False, True])
def test_against_brute_force(spark, extra):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(clashing(df) if extra else df) == brute(rows)


def test_awkward_and_empty(spark):
    assert found(clashing(awkward(spark))) == []
    assert found(spark.createDataFrame([], DOCS)) == []
    assert found(awkward(spark), {}) == []
    assert found(awkward(spark), {"x": "too short"}) == []


def test_query_equals_brute_force_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = {k: v for k, v in ls.TEMPLATES.items()}
    got = sorted(((r.doc_id, r.license, r.n_template, r.n_found) for r in queries.op10_license_scan(spark, sf).collect()), key=str)
    assert got == brute(rows, short) and got


def test_place_of_the_copy(spark):
    df = spark.createDataFrame([(1, "one two three " + ls.TEMPLATES["MIT-line"])], "doc_id long, text string")
    assert [(r.license, r.first_shingle, r.containment) for r in ls.scan(df).collect()] == [("MIT-line", 3, 1.0)]


def test_native(spark, tmp_path):
    plan = ls.scan(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_catalog_is_bounded(spark):
    with pytest.raises(ValueError, match="in parts"):
        ls.scan(awkward(spark), {"x": " ".join(f"w{i}" for i in range(60_000))})


def test_cut_notices_are_not_whole(spark):
    isc, gpl = ls.TEMPLATES["ISC"], ls.TEMPLATES["GPL-3.0-notice"]
    rows = [(1, isc[: isc.index(" IN NO EVENT SHALL THE AUTHOR BE LIABLE")]), (2, gpl[: gpl.index(" You should have received a copy")])]
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.containment < 1 for r in got) and not any(r.doc_id == 1 for r in got)


def test_common_licences_are_in_the_catalog():
    assert {"BSD-2-Clause", "BSD-3-Clause", "LGPL-3.0-notice", "AGPL-3.0-notice", "Unlicense"} <= set(ls.TEMPLATES)
