"""Recall of the chosen-path join on the given tables with near copies planted just above the threshold."""

import os
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from graphloom.llm.jaccard_join import jaccard_join

from .test_jaccard_join import shingles

SF = os.environ.get("RECALL_SF_DIR", "/root/testdata/sf0.01")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies(text, r, tries):
    """Copies with some words changed whose similarity to the text is from 0.80 to 0.85."""
    own, words = shingles(text), WORD.findall(text)
    for _ in range(tries):
        changed = list(words)
        for place in r.sample(range(len(words)), max(1, round(len(words) * 0.02))):
            changed[place] = f"planted{r.randrange(10**9)}"
        copy = " ".join(changed)
        other = shingles(copy)
        if 0.8 * len(own | other) <= len(own & other) <= 0.85 * len(own | other):
            yield copy


def links_by_hand(texts, queries):
    """Query -> number of other sets of all texts with a similarity of at least 0.8, by counting common shingles."""
    sets = list({shingles(t) for t in texts} - {frozenset()})
    wanted = {q: shingles(texts[q]) for q in queries}
    asked = set().union(*wanted.values())
    holders = defaultdict(list)
    for k, x in enumerate(sets):
        for token in x & asked:
            holders[token].append(k)
    out = {}
    for q, x in wanted.items():
        common = Counter(k for token in x for k in holders[token])
        out[q] = sum(10 * c >= 8 * (len(x) + len(sets[k]) - c) for k, c in common.items() if sets[k] != x)
    return out


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
def test_recall_on_planted_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts, r = [t or "" for _, t in docs], random.Random(11)
    queries = [k for k, (i, _) in enumerate(docs) if i % 50 == 0]
    for q in list(queries):
        if 40 <= len(WORD.findall(texts[q])) <= 2000:
            for copy in near_copies(texts[q], r, 20):
                queries.append(len(texts))
                texts.append(copy)
    want = links_by_hand(texts, queries)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {x["doc_id"]: x["n_links"] for x in jaccard_join(rows).select("doc_id", "n_links").collect()}
    assert all(got[q] <= want[q] for q in queries)
    found, all_links = sum(got[q] for q in queries), sum(want.values())
    print(f"{len(queries)} queries, {all_links} links, {found} found: recall {found / all_links:.6f}")
    assert all_links > 100 and found >= 0.999 * all_links
