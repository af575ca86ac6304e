"""The chosen-path join against all pairs."""

import math
import random
import re
from collections import defaultdict

import graphloom.llm.jaccard_join as jj
from graphloom.llm.jaccard_join import Settings, jaccard_join

SCHEMA = "doc_id long, text string, key string, n int, copies int, leaf long, tokens string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, "x") for i, t in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def by_hand(rows, threshold=0.8):
    """doc_id -> (class, group, links) for rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    classes = defaultdict(list)
    for i, x in sets.items():
        classes[x if x else ("blank", i)].append(i)
    names = {x: min(m) for x, m in classes.items()}
    real = [x for x in names if isinstance(x, frozenset)]
    links = defaultdict(set)
    for a in range(len(real)):
        for b in range(a + 1, len(real)):
            x, y = real[a], real[b]
            if len(x & y) >= threshold * len(x | y) - 1e-12:
                links[x].add(y)
                links[y].add(x)
    group = {}
    for x in names:
        if x in group:
            continue
        seen, front = {x}, [x]
        while front:
            for y in links[front.pop()] - seen:
                seen.add(y)
                front.append(y)
        low = min(names[y] for y in seen)
        group.update(dict.fromkeys(seen, low))
    return {i: (names[x], group[x], len(links[x])) for x, m in classes.items() for i in m}


def corpus(seed=1, groups=40, hot=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(r.choice([3, 5, 6, 40, 120, 300]))]
        if g % 3 == 0:
            base += passage
        for _ in range(r.choice([1, 1, 2, 3, 8])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = word()
            texts.append(r.choice([" ", "\n", "  "]).join(w))
    base = [word() for _ in range(150)]
    for _ in range(hot):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    r.shuffle(texts)
    return list(enumerate(texts, 10))


def check(spark, rows, settings=None):
    got = {r["doc_id"]: (r["class_id"], r["group_id"], r["n_links"]) for r in jaccard_join(table(spark, rows), settings).collect()}
    assert got == by_hand(rows)


def test_all_links_are_found(spark):
    check(spark, corpus() + [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (6, "one two three four")])


def test_large_leaves_are_split_and_compared_in_blocks(spark):
    check(spark, corpus(2, 30, 150), Settings(leaf_size=20, block=40))


def test_repeated_rows_ids_and_nulls(spark):
    text = " ".join(f"w{k}" for k in range(50))
    near = text.replace("w49", "zz")
    rows = [(1, text), (1, text), (1, near), (2, near), (None, near), (None, "alone in the world of words"), (3, None), (3, None)]
    got = sorted(map(tuple, jaccard_join(table(spark, rows)).collect()), key=str)
    by = {(r[0], r[3]): r for r in got}
    assert len(got) == len(rows)
    assert all(r[2] == 1 and r[5] == 1 for r in got if r[3] == 46)
    assert sorted(r[4] for r in got if r[3] == 46) == [2, 2, 3, 3, 3]
    assert by[(None, 2)][1:3] == (None, None) and by[(3, 0)][4:] == (1, 0, 0)


def test_empty_table_and_a_very_long_text(spark):
    assert jaccard_join(table(spark, [])).count() == 0
    long = " ".join(f"w{k}" for k in range(60_000))
    check(spark, [(1, long), (2, long + " end"), (3, "short one")])


def test_runs_follow_the_recall():
    assert Settings(target_recall=0.9).runs < Settings(target_recall=0.999).runs


def test_links_at_a_lower_threshold(spark):
    r, rows = random.Random(4), []
    for k in range(60):
        base = [f"{k}w{i}" for i in range(60)]
        changed = r.choice([16, 17, 18, 19])  # similarity 40/72, 39/73, 38/74 and, below the threshold, 37/75
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([f"{k}x{i}" for i in range(changed)] + base[changed:]))]
    got = {r["doc_id"]: (r["class_id"], r["group_id"], r["n_links"]) for r in jaccard_join(table(spark, rows), Settings(threshold=0.5)).collect()}
    want = by_hand(rows, 0.5)
    assert 60 < sum(x[2] for x in want.values()) < 120
    assert got == want


def test_likely_pairs_follow_threshold_and_coordinates():
    assert (Settings().likely, Settings().runs) == (36, 6)
    for threshold in (0.3, 0.5, 0.6, 0.7, 0.9):
        for n in (8, 32, 64, 128):
            s = Settings(threshold=threshold, coordinates=n)
            lost = sum(math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(s.likely))
            assert lost <= s.sketch_loss < 1 - s.target_recall


def test_wide_columns_are_shuffled_once_and_texts_go_to_blocks(spark, monkeypatch):
    inputs, keep = {}, jj.written

    def spy(df, name, *more):
        text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        inputs[name] = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", text)
        return keep(df, name, *more)

    monkeypatch.setattr(jj, "written", spy)
    words = [f"w{i}" for i in range(40)]
    # Two rows of id 1 with one set, one of another; id 3 with white space of its own.
    texts = [(1, " ".join(words)), (1, "  ".join(words)), (1, "other words of one and the same id"), (2, " ".join([*words, "end"])), (3, "\n".join(words)), (None, " ".join(["start", *words]))]
    got = jj.jaccard_join(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = sorted((r["doc_id"] or 9, r["class_id"] or 9, r["group_id"], r["n_copies"], r["n_links"], r["n_link_docs"]) for r in got.collect())
    assert rows == [(1, 1, 1, 1, 0, 0), (1, 1, 1, 3, 2, 2), (1, 1, 1, 3, 2, 2), (2, 2, 1, 1, 2, 4), (3, 1, 1, 3, 2, 2), (9, 9, 1, 1, 2, 4)]
    assert sum("first#" in x for x in inputs["jaccard-classes"]) == 1
    assert "jaccard-sets" not in inputs
    assert any("text#" in x for x in inputs["jaccard-found"]) and not any("tokens#" in x and "leaf_tokens#" not in x for x in inputs["jaccard-found"])
