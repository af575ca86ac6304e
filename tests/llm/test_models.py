"""Classifiers on held-out rows, segmentation by enumeration, and the pipeline's decisions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm.arrays import mix, run_hashes
from graphloom.llm.common import held_out
from graphloom.llm.labelled import bounded_sample
from graphloom.llm.passage_features import CLASS_OF, N_CLASSES, N_FEATURES, passages, word_bucket
from graphloom.llm.quality_classifier import Model, fit_quality, score_quality
from graphloom.llm.sentencepiece_lattice import BLANK, DEFAULT_MODEL, Encoded, Memo, Vocabulary, decode, encode, merge_nbest
from graphloom.llm.toxicity import fit_toxicity, score_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLEAN, BAD = "abcdefghijklmnop", ["scum", "idiot", "trash"]


def documents(seed, n):
    """(doc_id, text, quality, toxic): junk is loud, toxic texts hold a bad word in one sentence."""
    r, out = random.Random(seed), []
    for k in range(n):
        words = ["".join(r.choice(CLEAN) for _ in range(r.randint(2, 9))) for _ in range(r.randint(5, 200))]
        quality, toxic = int(r.random() < 0.8), int(r.random() < 0.3)
        if not quality:
            words = [w.upper() + "!!" if k % 2 else w + "$$$" for w in words]
        if toxic:
            words[r.randrange(len(words))] = r.choice(BAD)
        for i in range(0, len(words), r.randint(6, 12)):
            words[i] += "."
        out.append((k, " ".join(words), quality, toxic))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = documents(1, 700)
    docs = spark.createDataFrame([(i, t, "xx", f"s{i % 3}", i) for i, t, _, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def accuracy(scored, labels, column):
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", column).collect()
    assert len(rows) > 80
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_quality_on_held_out_documents(spark, corpus):
    docs, labels = corpus
    model = fit_quality(docs, labels, max_labelled=400)
    assert accuracy(score_quality(docs, model), labels, "quality") > 0.97


def test_toxicity_on_held_out_documents_and_sentences(spark, corpus):
    docs, labels = corpus
    model = fit_toxicity(docs, labels)
    scored = score_toxicity(docs, model)
    assert accuracy(scored, labels, "toxic") > 0.97
    found = [x["text"].lower() for r in scored.where("predicted = 1").select("offending").collect() for x in r[0]]
    assert len(found) > 50 and sum(any(b in f for b in BAD) for f in found) > 0.97 * len(found)


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (None, "no id"), (5, "long. idiot " * 40_000), (6, "…。"), (7, "a\x00b")]


@pytest.mark.parametrize("fit, score", [(fit_quality, score_quality), (fit_toxicity, score_toxicity)])
def test_odd_rows_get_scores(spark, corpus, fit, score):
    docs, labels = corpus
    odd = spark.createDataFrame([(i, t, None, None, None, 1, 2.0) for i, t in EDGE], SCHEMA + ", label int, score double")
    void = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for model in (fit(docs, labels, 100), fit(docs, void), fit(docs, labels.limit(0))):
        rows = score(odd, model).collect()
        assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert score(odd.limit(0), None).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark, corpus):
    docs, labels = corpus
    other = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: {r["doc_id"]: r["score"] for r in score_quality(docs, fit_quality(docs, x, 200)).collect()}
    assert score(labels) == pytest.approx(score(other), abs=1e-9)


def slow_toxicity(text, model):
    """(score, offending) of one text: sentences by hand, noisy-or over them and the document's own instance."""
    raw = text.encode()
    letters = lambda x: re.findall(rb"[A-Za-z\x80-\xff]+", x)
    lower = lambda w: bytes(b + 32 if 65 <= b <= 90 else b for b in w)
    whole = lambda w: int(run_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    twist = lambda h: int(mix(np.array([h & (2**64 - 1)], np.uint64))[0])
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    seen, logits, sentences = Counter(), [], [x for x in re.split(rb"[.!?\n]", raw) if letters(x)]
    for sentence in sentences:
        features = set()
        for w in map(lower, letters(sentence)):
            features.add(whole(w))
            for k in (4, 5, 6, 7):
                if len(w) > k:
                    stem = twist(whole(w[:k]) + k)
                    seen[stem] += 1
                    features.add(twist(stem + 1))
        logits.append(model.bias + sum(weight.get(f, 0) for f in features))
    if not sentences:
        return 0.0, []
    again = {twist(stem + least) for stem, n in seen.items() for least in (2, 3) if n >= least}
    own = [1 / (1 + math.exp(-t)) for t in logits]
    doc = 1 / (1 + math.exp(-(model.bias + sum(weight.get(f, 0) for f in again))))
    bare = lambda x: re.search(rb"[A-Za-z\x80-\xff](?:.*[A-Za-z\x80-\xff])?", x, re.S)[0].decode()
    return 1 - (1 - doc) * math.prod(1 - p for p in own), [(i, p, bare(x)) for i, (p, x) in enumerate(zip(own, sentences)) if p >= 0.5]


def test_toxicity_by_hand(spark, corpus):
    docs, labels = corpus
    model = fit_toxicity(docs, labels, 300)
    model.bias, model.weights = -4.0, model.weights * 1.5
    more = [(9001, "Idiot! scum\nétrash trash?? x"), (9002, "..."), (9003, "trashes trashed trashing. idiotic idiots IDIOTS"), (9004, ""), (9005, "trash" * 9)]
    rows = docs.limit(150).select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    for r in score_toxicity(rows, model).join(rows, "doc_id").collect():
        score, offending = slow_toxicity(r["text"], model)
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert [(x["sentence"], x["text"]) for x in r["offending"]] == [(i, t) for i, _, t in offending]
        assert [x["score"] for x in r["offending"]] == pytest.approx([p for _, p, _ in offending])


def test_sample_is_bounded_by_rows_and_characters(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(3, "y"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    took = lambda *bound: {r["ticket"]: r["text"] for r in bounded_sample(docs, labels, "quality", *bound).collect()}
    everything = took(100)
    assert len(everything) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(50))
    assert list(sorted(took(7))) == list(sorted(everything))[:7]
    assert 1 <= len(took(100, 520)) <= 6 and set(took(100, 520).values()) <= {"", "x" * 100}
    assert took(100, 0) == {} or set(took(100, 0).values()) == {""}


@pytest.mark.parametrize("fit,column", [(fit_quality, "quality"), (fit_toxicity, "toxic")])
def test_a_very_long_text_costs_its_own_place_only(spark, corpus, fit, column):
    docs, labels = corpus
    tickets = bounded_sample(docs, labels, column, 100).orderBy("ticket").collect()
    whole = sum(len(r["text"]) for r in tickets)
    first = next(r["doc_id"] for r in docs.collect() if r["text"] == tickets[0]["text"])
    monster = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("word "), whole)).otherwise(F.col("text")))
    kept = bounded_sample(monster, labels, column, 100, whole).collect()
    assert {r["ticket"] for r in kept} == {r["ticket"] for r in tickets[1:]}
    assert fit(monster, labels, 100, max_chars=whole) is not None


def slow_quality(text, m):
    """(score, attention) of one text: passages of 64 words one by one, gate and weights by hand."""
    words = [w for w in re.split("[ \t\n\v\f\r]+", text) if w]
    parts = [passage_by_hand(words, text, i) for i in range(0, max(len(words), 1), 64)]
    h = [np.tanh((x - m.mean) / m.scale @ m.w["W"] + m.w["b"]) for x in parts]
    e = [float(np.tanh(v @ m.w["V"]) / (1 + np.exp(-(v @ m.w["U"]))) @ m.w["w"]) for v in h]
    a = np.exp(e) / np.exp(e).sum()
    return 1 / (1 + math.exp(-(sum(x * v for x, v in zip(a, h)) @ m.w["c"] + m.w["d"][0]))), a


def passage_by_hand(words, text, i):
    """Features of words[i:i + 64]: byte classes between its first and last byte, its words, shares of new words and pairs."""
    part, out = words[i : i + 64], np.zeros(N_FEATURES)
    if not part:
        return out
    spans = [x.span() for x in re.finditer(rb"[^ \t\n\v\f\r]+", text.encode())]
    raw = text.encode()[spans[i][0] : spans[i + len(part) - 1][1]]
    for b in raw:
        out[CLASS_OF[b]] += 1 / len(raw)
    out[:N_CLASSES] = np.sqrt(out[:N_CLASSES])
    pairs, earlier = list(zip(words, words[1:] + [None])), set()
    for p in pairs[:i]:
        earlier.add(p)
    fresh = 0
    for p in pairs[i : i + len(part)]:
        fresh += p not in earlier
        earlier.add(p)
    out[N_CLASSES : N_CLASSES + 5] = [sum(len(w.encode()) for w in part) / len(part) / 10, math.log1p(len(part)) / 4, len(set(part)) / len(part), fresh / len(part), math.log1p(len(words)) / 8]
    for w in part:
        out[N_CLASSES + 5 + word_bucket(w.encode())] += 1
    out[N_CLASSES + 5 :] = np.sqrt(out[N_CLASSES + 5 :] / len(part))
    return out


def test_quality_by_hand(spark, corpus):
    docs, labels = corpus
    model = fit_quality(docs, labels, 300)
    more = [(9001, ""), (9002, " one\n"), (9003, "été " * 200), (9004, "a b " * 70 + "$$$ c\td")]
    rows = docs.limit(60).select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    for r in score_quality(rows, model).join(rows, "doc_id").collect():
        score, attention = slow_quality(r["text"], model)
        assert r["score"] == pytest.approx(score, abs=1e-5)
        assert r["n_passages"] == len(attention) and r["top_weight"] == pytest.approx(max(attention), abs=1e-5)


def test_gradient_of_the_attention_model():
    r = np.random.default_rng(0)
    x, owner, y = r.normal(size=(7, 5)), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    first, model = np.array([0, 3, 4]), Model(5, 4, 3)
    model.w["w"], model.w["c"] = r.normal(size=3), r.normal(size=4)
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := model.forward(x, owner, first)["p"], 1 - p)))
    for name, g in model._gradient(x, owner, first, y).items():
        for at in np.ndindex(model.w[name].shape):
            keep = model.w[name][at]
            model.w[name][at] = keep + 1e-6
            up = loss()
            model.w[name][at] = keep - 1e-6
            down = loss()
            model.w[name][at] = keep
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_passages_cover_whole_rows():
    texts = ["", "a b", " ".join(["w"] * 64), " ".join(["w"] * 130), "\n"]
    raw = [t.encode() for t in texts]
    x, owner = passages(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw]))))
    assert owner.tolist() == [0, 1, 2, 3, 3, 3, 4] and x.shape == (7, N_FEATURES)
    assert not x[0].any() and not x[6].any()


def enumerate_scores(text, v):
    m = BLANK + text.replace(" ", BLANK)

    def paths(i):
        if i == len(m):
            yield 0.0, ()
        for j in range(i + 1, len(m) + 1):
            piece = v.ids.get(m[i:j])
            if piece is not None or j == i + 1:
                for s, rest in paths(j):
                    yield (v.scores[piece] if piece is not None else v.fallback) + s, (m[i:j], *rest)

    return sorted(paths(0), key=lambda x: -x[0])


def test_nbest_against_all_segmentations():
    r = random.Random(2)
    for _ in range(120):
        pieces = {c: -float(r.randint(1, 9)) for c in "ab" + BLANK}
        for _ in range(8):
            pieces[BLANK * (r.random() < 0.4) + "".join(r.choice("ab") for _ in range(r.randint(1, 3)))] = -float(r.randint(1, 9))
        v = Vocabulary.of(pieces)
        texts = ["".join(r.choice("ab c") for _ in range(r.randint(1, 8))) for _ in range(3)]
        e = Encoded(texts, v)
        for row, text in enumerate(texts):
            got = e.nbest(row, 5, Memo())
            want = enumerate_scores(text, v)
            assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:5]])
            ids = [tuple(e.ids_of(row, c)) for _, c in got]
            assert len(set(ids)) == len(ids)
            for (score, _), own in zip(got, ids):
                plain = [i for i in own if i > 256]
                lost = sum(c == "c" for c in text)
                assert sum(v.scores[i] for i in plain) + lost * v.fallback == pytest.approx(score)


def test_merge_of_lists():
    lists = [[0.0, -1.0, -5.0], [0.0, -2.0], [-1.0]]
    want = sorted((sum(x) for x in ((a, b, c) for a in lists[0] for b in lists[1] for c in lists[2])), reverse=True)
    assert [s for s, _ in merge_nbest(lists, 10)] == want


def test_encode_decode_round_trip(spark):
    texts = ["Hello world", "  two  blanks ", "x\ny\t z", "日本語 🙂 é", "", None, " ", "a" * 3000, "tail" + BLANK, "w " * 20_000, "퟿\x00"]
    docs = spark.createDataFrame([(k, t, "i", 1.0) for k, t in enumerate(texts)], "doc_id long, text string, ids string, score double")
    v = Vocabulary(DEFAULT_MODEL)
    coded = encode(docs, v, 3, alternatives=True).cache()
    rows = {r["doc_id"]: r for r in coded.collect()}
    back = {r["doc_id"]: r["text"] for r in decode(coded, v).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert rows[k]["round_trip"] == (BLANK not in (t or ""))
        assert back[k] == (t or "").replace(BLANK, " ")
        assert len(rows[k]["nbest_ids"]) == len(rows[k]["nbest_scores"])
        assert len({tuple(x) for x in rows[k]["nbest_ids"]}) == len(rows[k]["nbest_ids"])
        assert list(rows[k]["nbest_ids"][0]) == list(rows[k]["ids"]) and rows[k]["nbest_scores"] == sorted(rows[k]["nbest_scores"], reverse=True)
    assert encode(docs.limit(0), v).count() == 0


def test_segmentations_are_about_as_short_as_the_librarys(spark):
    import sentencepiece

    r, words = random.Random(5), "the of people government house water international between under information would school program around number state".split()
    texts = [" ".join(r.choice(words) + r.choice(["", "s", ",", ".", "ing"]) for _ in range(300)) for _ in range(20)]
    rows = encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Vocabulary(DEFAULT_MODEL)).collect()
    own, other = sum(len(x["ids"]) for x in rows), sum(map(len, sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL).encode(texts)))
    assert abs(own - other) < 0.03 * other
    v = Vocabulary(DEFAULT_MODEL)
    assert v.scores[v.ids["▁and"]] > v.scores[v.ids["▁a"]] + v.scores[v.ids["nd"]]
    assert Vocabulary(DEFAULT_MODEL, by_rank=False).scores[v.ids["▁t"]] == -2


def test_pipeline_stages(spark, corpus, tmp_path):
    docs, labels = corpus
    base = [(r["doc_id"], r["text"]) for r in docs.collect()]
    long = max((t for _, t in base if "!!" not in t and "$$$" not in t), key=len)
    near = long.rsplit(" ", 1)[0] + " changed"
    more = [(1001, long.replace(" ", "\n")), (1002, near), (1003, None), (1004, ""), (1004, "")]
    everything = docs.unionByName(spark.createDataFrame([(i, t, "xx", None, 0) for i, t in more], SCHEMA))
    everything.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf_dir, now, kept = str(tmp_path), everything, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf_dir).write.parquet(f"{sf_dir}/stage{k}")
        now = spark.read.parquet(f"{sf_dir}/stage{k}")
        kept.append([r["doc_id"] for r in now.select("doc_id").collect()])
        if k + 1 < len(corpus_pipeline.STAGES):
            assert now.columns == everything.columns
    scores = score_quality(everything, fit_quality(everything, labels)).collect()
    assert Counter(kept[0]) == Counter(r["doc_id"] for r in scores if r["predicted"])
    assert len(set(kept[1])) == len(kept[1]) and 1001 not in kept[1]
    assert set(kept[1]) - set(kept[2]) == {1002}
    assert set(kept[3]) <= set(kept[2]) and max(Counter(kept[3]).values()) <= 4
    assert Counter(kept[4]) == Counter(kept[3]) and now.where("not round_trip").count() == 0
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()) == Counter(kept[4])


def stage_texts(spark, stage, rows, sf_dir=""):
    """(id, text) of what a pipeline stage keeps of rows (id, text)."""
    docs = spark.createDataFrame([(i, t, "xx", f"s{k % 3}", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_pipeline_rejects_rows_of_null_and_repeated_ids(spark, corpus, tmp_path):
    docs, labels = corpus
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scores = {r["doc_id"]: r["predicted"] for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    good, junk = (next(t for i, t in reversed(rows) if scores[i] == p) for p in (1, 0))
    more = [(None, junk), (None, good), (5001, good), (5001, junk), (5001, junk)]
    got = stage_texts(spark, corpus_pipeline.quality_classifier, rows + more, str(tmp_path))
    assert [x for x in got if x[0] is None or x[0] > 5000] == sorted([(None, good), (5001, good)], key=str)


def test_pipeline_drops_exact_copies_of_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (1, "a b"), (2, "a b"), (2, "other"), (3, "other"), (3, "c d"), (3, "c  d"), (4, "c d"), (None, "alone"), (None, "alone"), (None, "x"), (5, ""), (6, None), (5, "")]
    got = stage_texts(spark, corpus_pipeline.exact_copies, rows)
    assert got == sorted([(1, "a b"), (2, "other"), (3, "c  d"), (None, "alone"), (None, "x"), (5, "")], key=str)


def test_pipeline_drops_near_copies_of_null_and_repeated_ids(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    near = lambda t, w="zz": t.rsplit(" ", 1)[0] + " " + w
    rows = [(1, one), (None, near(one)), (2, two), (1, near(two)), (3, three), (3, "quite another text of an id"), (4, near(three)), (None, "no id and no copy"), (None, None), (None, None), (9, "x y"), (9, "x y")]
    got = stage_texts(spark, corpus_pipeline.near_copies, rows)
    assert got == sorted([(1, one), (1, near(two)), (3, three), (3, "quite another text of an id"), (None, "no id and no copy"), (None, None), (None, None), (9, "x y")], key=str)


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_copies, corpus_pipeline.near_copies, corpus_pipeline.source_mix])
def test_pipeline_stages_take_clashing_columns_empty_tables_and_long_texts(spark, stage):
    schema = SCHEMA + ", row int, _size int, once int, of int, first string"
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(1, "a b c", "xx", "s", 1), (2, "a b c", None, None, None), (None, None, None, "s", 0), (3, long, "xx", None, 3), (4, long + " tail", "xx", None, 3)]
    docs = spark.createDataFrame([(*r, 7, 8, 9, 10, "x") for r in rows], schema)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {(7, 8, 9, 10, "x")}
    assert stage(spark, docs.limit(0), "").count() == 0


def test_first_and_last_stage_take_clashing_columns_empty_tables_and_long_texts(spark, corpus, tmp_path):
    docs, labels = corpus
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    clash = {"row": F.lit(7), "predicted": F.lit(8), "once": F.lit(9), "score": F.lit("s"), "label": F.lit("x"), "ids": F.lit(3), "codes": F.lit("c")}
    long = " ".join(f"word{k}" for k in range(30_000))
    more = spark.createDataFrame([(7001, None, None, None, None), (7002, "", "xx", "s", 0), (7003, long, "xx", "s", 1), (None, "a clean text", "xx", "s", 1)], SCHEMA)
    rows = docs.unionByName(more).withColumns(clash)
    kept = corpus_pipeline.quality_classifier(spark, rows, str(tmp_path))
    assert kept.columns == rows.columns and {tuple(r)[5:] for r in kept.collect()} == {(7, 8, 9, "s", "x", 3, "c")}
    assert corpus_pipeline.quality_classifier(spark, rows.limit(0), str(tmp_path)).count() == 0
    # Without any label there is no model, and nothing is known against a text.
    assert corpus_pipeline.quality_classifier(spark, rows, str(tmp_path / "none")).count() == rows.count()
    few = more.drop("lang").withColumn("row", F.lit(7))
    coded = corpus_pipeline.sentencepiece(spark, few, "").collect()
    assert sorted(r["doc_id"] or 0 for r in coded) == [0, 7001, 7002, 7003] and all(r["round_trip"] for r in coded)
    assert corpus_pipeline.sentencepiece(spark, few.limit(0), "").count() == 0
