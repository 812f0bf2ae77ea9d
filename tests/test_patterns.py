"""Patterns by their literals: nothing is lost, whatever the pattern."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veristry.functions.patterns import Patterns, found_literals, required_literal
from veristry.operators.terms import TERMS

CASES = {
    r"portrait\s+of\s+(a\s+)?graduate": "portrait",
    r"graduate\s+competenc(y|ies)": "competenc",
    r"future[- ]?ready\s+skills": "future",
    r"frameworks?\s+for": "framework",
    r"(capstone)": "capstone",
    r"a|bcd": None,
    r"(?i)capstone": None,
    r"ab\s": None,
    r"(?:abc)+x": "abc",
    r"(abcd)?xy": None,
    r"\bword\b": "word",
    r"x{2}abcd": "abcd",
    r"(": None,
    "": None,
}


@pytest.mark.parametrize("pattern", CASES)
def test_required_literal(pattern):
    assert required_literal(pattern) == CASES[pattern]


def test_every_match_holds_its_literal():
    words = ["portrait", "of", "a", "graduate", "competency", "competencies", "future", "ready", "skills", "learning", "labs", "strategic", "plan", "planning", "p", "l"]
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(words) + rng.choice([" ", "-", "  ", ""]) for _ in range(6))
        for _, _, pattern, _, _ in TERMS:
            for m in re.finditer(pattern, text):
                assert required_literal(pattern) in m.group()


def test_all_standard_terms_need_a_literal():
    assert all(required_literal(p) for _, _, p, _, _ in TERMS)


def test_literals_that_overlap_and_contain_each_other(spark):
    literals = ["abcd", "bc", "cde", "de f", "é中", "abc"]
    texts = ["xabcdef", "abcd", "de f", "é中bc", "", None, "ABCD", "a" * 5000 + "bc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: list(r.f) for r in df.select("i", found_literals(F.col("t"), literals).alias("f")).collect()}
    assert got == {i: [k for k, x in enumerate(literals) if t and x in t] for i, t in enumerate(texts)}


def test_patterns_without_a_literal_are_always_tried(spark):
    known = Patterns([r"a|b", r"capstone", r"\d+"])
    df = spark.createDataFrame([("1",), ("capstone",)], "t string").withColumn("f", known.found(F.col("t")))
    assert [tuple(r) for r in df.select(*[known.may_match(F.col("f"), k) for k in range(3)], known.any_may_match(F.col("f"))).collect()] == [(True, False, True, True), (True, True, True, True)]
    assert Patterns([r"\d"]).found(F.lit("x")) is not None
