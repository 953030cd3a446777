"""Spelling proposals against all pairs of a plain edit distance, and planted misspellings of county names."""

import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators.spelling import propose_spellings
from panelspark.traffic import spelling_report
from tests.test_traffic import _sources


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def expected(left, right, most):
    out = set()
    for mine, theirs, side in ((left, right, True), (right, left, False)):
        for name in {n for n in mine if n is not None} - set(theirs):
            a, near = " ".join(name.split()).lower(), []
            for other in {n for n in theirs if n is not None}:
                b = " ".join(other.split()).lower()
                d = edit_distance(a, b)
                if d <= min(most, len(a) // 3, len(b) // 3):
                    near.append((other, d))
            out |= {(name, side, mine.count(name), o, theirs.count(o), d, d == min(x for _, x in near)) for o, d in near}
    return out


def frame(spark, names):
    return spark.createDataFrame([(n, "extra") for n in names], "county string, proposal string")


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_proposals_equal_all_pairs(spark, most):
    rng = random.Random(most)
    base = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 11))) for _ in range(60)]
    damaged = [n[:2] + rng.choice("abcx") + n[3:] for n in base] + ["", "", None, " Lake  Of", "LAKE of", "ab", "éa bäc"]
    other = [*base, "lake of", "ea bäc", None, "abcabcabca"]
    got = propose_spellings(frame(spark, damaged), frame(spark, other), "county", max_distance=most)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected(damaged, other, most)


def test_a_planted_misspelling_is_proposed_without_an_all_pairs_join(spark):
    got = propose_spellings(frame(spark, ["Aikin", "Aikin", "Carlson", "Penningham", "Cass"]),
                            frame(spark, ["Aitkin", "Carlton", "Pennington", "Cass"]), "county", max_distance=3)
    best = {r.name: r.proposal for r in got.where("in_left and best").collect()}
    assert best == {"Aikin": "Aitkin", "Carlson": "Carlton", "Penningham": "Pennington"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_lists_and_wrong_distances(spark):
    some, none = frame(spark, ["Aitkin"]), frame(spark, [])
    assert propose_spellings(some, none, "county").count() == 0 == propose_spellings(none, none, "county").count()
    with pytest.raises(ValueError):
        propose_spellings(some, some, "county", max_distance=4)


def test_the_report_proposes_what_the_rules_miss(spark):
    src = _sources(spark, "traffic-spelling")
    src["current_stations"] = src["current_stations"].withColumn("county_name", F.lit("Saint Luis"))
    got = {(r.comparison, r.name, r.in_left, r.proposal, r.distance) for r in spelling_report(src).collect()}
    assert ("stations~cases", "Saint Luis", True, "Saint Louis", 1) in got
