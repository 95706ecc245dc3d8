"""Splitting of symptom lists: the patterns against a plain reading in Python, and no lambda in the plan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from carelake.functions import text as T

STRIP = T.STRIP_CHARS
SPACE = r"[\t-\r \x85\xa0  -     　]+"


def plain_trim(t):
    return [x for x in (p.strip(" ") for p in re.split("[,;|]+", t)) if x]


def plain_tokens(t):
    parts = (re.sub(SPACE, " ", p).strip(" ").lower() for p in re.split("[,;|\n]+", t or ""))
    return [x for x in parts if x]


def plain_quick(t):
    return [x for x in (p.strip(STRIP).lower() for p in re.split("[,;|\n]+", t or "")) if x]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    made = ["".join(r.choice(" ,;|\n\t\r\x0b\x1c\x85\xa0　abÉ.") for _ in range(r.randint(0, 14))) for _ in range(1500)]
    return made + ["", " ", ",", "a  ,  b", " ;a; ;b ", "unknown", None]


def test_splits_equal_plain_reading(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("t", T.split_trim(F.col("t")).alias("trim"), T.symptom_tokens("t").alias("tokens"),
                    T.quick_tokens("t").alias("quick"), T.standardize_symptoms("t").alias("std")).collect()
    for r in got:
        assert r.tokens == plain_tokens(r.t) and r.quick == plain_quick(r.t), repr(r.t)
        assert r.trim == (None if r.t is None else plain_trim(r.t)), repr(r.t)
        clean = re.sub(SPACE, " ", r.t or "").strip(" ").lower()
        parts = [] if clean in T.NULL_LIKE_VALUES else list(dict.fromkeys(plain_trim(clean)))
        assert r.std == (", ".join(parts) or "unknown"), repr(r.t)


@pytest.mark.parametrize("make", [T.standardize_symptoms, T.split_symptoms, T.symptom_tokens, T.quick_tokens])
def test_splits_are_generated_code(spark, make):
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(make("t"))
    assert "lambda" not in plan._jdf.queryExecution().executedPlan().toString()
