"""Nulls, blank, repeated and very long texts, empty tables and clashing columns; results by brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.mixing import mix_sources, source_targets
from graphloom.llm.quality_rules import Rule, compile_rules, quality_rules

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, source string, md5 string, norm string, n long, size long, words array<string>"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 7, 9, ["z"]) for i, t, s in rows], SCHEMA)


ROWS = [
    (1, "a b  c", "s0"), (2, "ab c", "s0"), (3, "abc", None), (4, None, "s1"), (5, "", "s1"), (6, " \t\n", None), (7, "other text", "s0"),
    (7, "other text", "s0"), (None, "abc ", "s1"), (8, "é ü", "s2"), (9, "éü", "s2"), (10, "w " * 30000, "s2"), (11, "a bc", "s0"),
]


def dedup_by_hand(rows):
    groups = {}
    for k, (i, t, _) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            i = rows[m[3]][0]
            out.append((i, rows[best[3]][0], len(members), m[3] == best[3], hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup(spark):
    got = exact_dedup(table(spark, ROWS)).drop("n_chars").collect()
    assert Counter(tuple(r) for r in got) == dedup_by_hand(ROWS)


def test_exact_dedup_collisions_are_told_apart_by_bytes(spark):
    got = exact_dedup(table(spark, ROWS), content_hash=lambda c: F.lit("same")).drop("n_chars").collect()
    assert Counter(tuple(r) for r in got) == dedup_by_hand(ROWS)


def test_empty_tables(spark):
    empty = table(spark, [])
    assert exact_dedup(empty).count() == 0
    assert mix_sources(empty).count() == 0
    assert quality_rules(empty).count() == 0


def fill(sizes, weights, share=1.0, cap=3):
    """Water-filling by repeated redistribution."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        rest = {s: w[s] for s in names if s not in fixed}
        left = total - sum(fixed.values())
        target = {s: left * rest[s] / sum(rest.values()) for s in rest}
        over = [s for s in rest if target[s] > cap * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_agree_with_repeated_redistribution(spark):
    r = random.Random(3)
    for trial in range(4):
        sizes = {f"s{k}": r.choice([0, 1, 10, 500, 4000]) for k in range(r.randint(1, 9))} | ({None: 50} if trial % 2 else {})
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {row["source"]: row["target"] for row in source_targets(df).collect()}
        assert got == pytest.approx(fill(sizes, (5, 2, 1)))


def test_mix_meets_targets(spark):
    r = random.Random(5)
    rows = [(k, " ".join(["w"] * int(r.paretovariate(1.1) * 20)), r.choice(["a", "b", "b", "c", None])) for k in range(800)] + ROWS
    docs = table(spark, rows)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(WORD, t or ""))
    want = fill(sizes, (5, 2, 1))
    for s, target in want.items():
        mine = [x for x in got if x["source"] == s]
        assert {x["source_size"] for x in mine} == {sizes[s]} and mine[0]["target"] == pytest.approx(target)
        assert target - 1 - 1e-6 < sum(x["taken"] for x in mine) <= target + 1e-6
        assert all(x["taken"] <= 3 * x["size"] and x["taken"] == x["repeats"] * x["size"] + x["part"] for x in mine)
        assert sum(x["part"] > 0 for x in mine) <= 1
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix_sources(docs.repartition(7)).collect()))


def base_by_hand(t):
    words = re.findall(WORD, t or "")
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_against_brute_force(spark):
    r = random.Random(7)
    texts = [None, "", " \n\t", "a b c d e f g h " * 3, "x\nx\n\ny\nx \n", "#1 <b> 100% & | $5 **"] + [
        " ".join(r.choice("abcd") + "\n" * (r.random() < 0.1) for _ in range(r.randint(1, 120))) for _ in range(40)
    ]
    texts.append("the cat sat on a mat and looked at " * 6000)
    got = quality_rules(table(spark, [(k, t, None) for k, t in enumerate(texts)])).collect()
    assert len(got) == len(texts)
    for row in got:
        n, chars, symbols, dup, rep = base_by_hand(texts[row["doc_id"]])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (n, chars, symbols, dup, rep), texts[row["doc_id"]]
        assert row["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        assert not (row["base_failed"] and row["kept"])


def test_rules_table_is_one_projection_without_user_functions(spark):
    verdict, failed = compile_rules((Rule("long", "n", 5, None), Rule("short", "n", None, 8), Rule("ratio", "q", 0.5, None)))
    rows = spark.createDataFrame([(3, 0.7), (6, 0.1), (6, None), (9, 0.9)], "n int, q double").select("n", verdict.alias("ok"), failed.alias("failed"))
    assert [(x["ok"], x["failed"]) for x in rows.collect()] == [(False, ["long"]), (False, ["ratio"]), (True, []), (False, ["short"])]
    plan = quality_rules(table(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
