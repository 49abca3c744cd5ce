"""Alias tables against all pairs of names and rules."""

import random

import pytest
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.operators import aliases


def squeezed(x):
    return (x or "").strip(" ").lower().replace(" ", "").replace("-", "")


def plain(rows, rules):
    by = {}
    for rule in sorted(rules, key=lambda r: (r[1] is None, r[0])):
        by.setdefault(rule[2].strip(" ").lower(), []).append(rule)
    out = []
    for i, name, domain in rows:
        d = squeezed(domain)
        found = name
        for _, where, _, canonical in by.get(name.strip(" ").lower(), []) if name is not None else []:
            r = squeezed(where)
            if where is None or (d and r and (r in d or d in r)):
                found = canonical
                break
        out.append((i, found))
    return sorted(out)


@pytest.mark.parametrize(("n", "words", "letters"), [(300, 20, "ab"), (10_000, 800, "abcdef")])
def test_rules_against_all_pairs(spark, n, words, letters):
    rng = random.Random(n)
    word = lambda k: "".join(rng.choice(letters) for _ in range(rng.randint(1, k)))
    names, domains = [word(6) for _ in range(words)], [rng.choice(["{}", "{} {}", "{}-{}"]).format(word(5), word(5)) for _ in range(words)]
    rules = [(i, rng.choice([None, rng.choice(domains)[: rng.randint(1, 9)], rng.choice(domains)]), rng.choice([" {} ", "{}"]).format(rng.choice(names)).upper(), f"c{i}") for i in range(n)]
    rows = [(i, rng.choice(names), rng.choice([None, "", *domains])) for i in range(1000)] + [(1000, None, "ab"), (1001, "unknown", "ab")]
    got = aliases.resolved(spark.createDataFrame(rows, "i int, name string, domain string"), spark.createDataFrame(rules, aliases.RULES))
    assert sorted((r["i"], r["canonical"]) for r in got.collect() if r["i"] != 1000) == [x for x in plain([r for r in rows if r[0] != 1000], rules)]
    assert got.columns == ["i", "name", "domain", "canonical"] and got.where("i = 1000").first()["canonical"] is None


def test_the_fixed_rules_as_a_table(spark):
    rules = [(i, d, a, to) for i, (d, a, to) in enumerate([(d, a, to) for d, m in N.DOMAIN_ALIASES.items() for a, to in m.items()] + [(None, a, to) for a, to in N.GLOBAL_ALIASES.items()])]
    said = [(n, d) for n in sorted({r[2] for r in rules} | {"nobody"}) for d in ("french revolution", "the french-revolution", "cloud", None, "x")]
    rows = spark.createDataFrame(said, "name string, domain string")
    got = aliases.resolved(rows, spark.createDataFrame(rules, aliases.RULES))
    want = rows.withColumn("canonical", N.canonical_name(F.col("name"), F.col("domain")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
