"""Merkle manifest against a tree built by hand; ties, nulls, empty and single rows, small bounds of the broadcast part."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm.merkle import half_of_ids, merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, node int, tree long, n long, first string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return h(*[field(x) for x in (row[0], row[1], row[2], row[3], text)])


def climb(level, at, hashed):
    """(root, siblings, folded) of a leaf."""
    siblings = ""
    while len(level) > 1:
        family = level[at // 3 * 3 : at // 3 * 3 + 3]
        place = at % 3
        siblings += "".join(family[:place] + family[place + 1 :])
        hashed = h(*family[:place], hashed, *family[place + 1 :])
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at //= 3
    return level[0], siblings, hashed


def by_hand(rows):
    even = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 2 == 0
    found = lambda r: r[4].replace("\n", "") if r[4] is not None and even(r[0]) else r[4]
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0, leaf(r, r[4])), r))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        trees[s].sort(key=lambda x: x[0])
    leaves = {s: [k[2] for k, _ in trees[s]] for s in sources}
    subroots = [climb(leaves[s], 0, "")[0] for s in sources]
    out = []
    for i, s in enumerate(sources):
        for at, (k, r) in enumerate(trees[s]):
            _, siblings, folded = climb(leaves[s], at, leaf(r, found(r)))
            root, more, folded = climb(subroots, i, folded)
            out.append((r[0], k[2], subroots[i], root, h(siblings + more), folded, folded == root))
    return Counter(out)


def row(i, source, text="a\nb", lang="en", chars=3):
    return (i, source, lang, chars, text)


CASES = {
    "one": [row(1, None)],
    "one source": [row(i, "s") for i in range(10)],
    "single rows": [row(i, f"s{i}") for i in range(5)],
    "mixed": [row(i, f"s{i % 3}", text=f"line {i}\nmore") for i in range(40)] + [row(i, None, None, None, None) for i in range(100, 104)] + [row(None, "s1"), row(None, "s1", ""), row(7, "", "é\n"), row(2, "s2", "x\n"), row(2, "s2", "x\n"), row(2, "s2", "y")]
    + [row(500, "é", "long\n" * 20000), row(501, "a" * 300)],
}


@pytest.mark.parametrize("name,upper", [("one", 40_000), ("one source", 0), ("single rows", 40_000), ("mixed", 0)])
def test_manifest(spark, name, upper):
    rows = CASES[name]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], SCHEMA)
    found = {"text": F.when(half_of_ids(F.col("doc_id")), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    got = merkle_manifest(docs, found, upper_nodes=upper)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == by_hand(rows)


def test_untouched_rows_are_verified(spark):
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in CASES["mixed"]], SCHEMA)
    assert merkle_manifest(docs).where("not verified").count() == 0


def test_many_sources_and_a_hot_one(spark):
    rows = [row(i, "hot" if i % 3 == 0 else f"s{i % 50}") for i in range(400)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], SCHEMA)
    found = {"text": F.when(half_of_ids(F.col("doc_id")), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    assert Counter(tuple(r) for r in merkle_manifest(docs, found, upper_nodes=20).collect()) == by_hand(rows)


def test_empty_table(spark):
    got = merkle_manifest(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns[-1] == "verified"
