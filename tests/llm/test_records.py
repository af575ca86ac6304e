"""URL lists, tool calls and archives by brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import json
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat_tools
from graphloom.llm.chat_tools import canonical_json, format_messages, link_tool_calls, topological_levels, valid_arguments
from graphloom.llm.common import join_counted, repeated
from graphloom.llm.queries import derived_calls
from graphloom.llm.url_filters import host_of, url_filter, validity_intervals
from graphloom.llm.warc import archive_pages, build_records, read_archives, write_archives

DAY = datetime(2024, 1, 1)
ENTRIES = "kind string, pattern string, category string, action string, effective_at timestamp"


def entry(kind, pattern, category, action, day):
    return (kind, pattern, category, action, DAY + timedelta(days=day) if day is not None else None)


def test_intervals_of_adds_and_removals(spark):
    rows = [
        entry("domain", "a.com", "spam", "add", 1), entry("domain", "a.com", "spam", "add", 5), entry("domain", "a.com", "spam", "remove", 9),
        entry("domain", "a.com", "spam", "add", 20), entry("domain", "b.com", "spam", "add", 3), entry("domain", "b.com", "spam", "remove", 3),
        entry("domain", None, "spam", "add", 1), entry("domain", "c.com", "spam", "add", None),
    ]
    got = {(r["pattern"], (r["valid_from"] - DAY).days, r["valid_to"].year > 9000 or (r["valid_to"] - DAY).days) for r in validity_intervals(spark.createDataFrame(rows, ENTRIES)).collect()}
    assert got == {("a.com", 1, 5), ("a.com", 5, 9), ("a.com", 20, True)}


def test_every_capture_sees_the_list_of_its_time(spark):
    entries = [
        entry("domain", "a.com", "spam", "add", 10), entry("domain", "a.com", "spam", "remove", 20), entry("prefix", "b.com/x/", "adult", "add", 15),
        entry("domain", "com", "never", "add", 400), entry("domain", "sub.c.org", "malware", "add", 0),
    ]
    captures = [(k, url, DAY + timedelta(days=d) if d is not None else None, "p", 1) for k, (url, d) in enumerate([
        ("http://a.com/q", 9), ("http://a.com/q", 10), ("https://www.deep.A.com:80/q", 19), ("http://a.com/q", 20), ("http://nota.com/", 15),
        ("http://b.com/x/y?z=/x/", 15), ("http://b.com/xy", 15), ("http://b.com/?/x/", 15), ("http://user@sub.c.org", 5), ("http://c.org/", 5),
        (None, 5), ("no url", 5), ("http://a.com/q", None), ("http://a.com/q", 10),
    ])]
    df = spark.createDataFrame(captures, "page_id long, url string, fetch_time timestamp, kind string, n_active int")
    got = {r["page_id"]: (r["blocked"], r["n_active"], r["first_match"]) for r in url_filter(df, spark.createDataFrame(entries, ENTRIES)).collect()}
    hit = {1: "spam domain a.com", 2: "spam domain a.com", 5: "adult prefix b.com/x/", 8: "malware domain sub.c.org", 13: "spam domain a.com"}
    assert got == {k: (k in hit, int(k in hit), hit.get(k)) for k in range(len(captures))}
    assert url_filter(df.limit(0), spark.createDataFrame(entries, ENTRIES)).count() == 0
    assert url_filter(df, spark.createDataFrame([], ENTRIES)).where("blocked").count() == 0


def test_entries_are_normalised_and_end_at_segments(spark):
    entries = [entry("domain", "WWW.A.com", "spam", "add", 0), entry("prefix", "B.com/x", "adult", "add", 0), entry("prefix", "b.com/X/page.html", "adult", "add", 0), entry("prefix", "c.com", "spam", "add", 0)]
    urls = ["http://a.com/", "http://b.com/x", "http://b.com/x/", "http://b.com/x/y", "http://b.com/xy", "http://b.com/X/page.html?q", "http://c.com", "http://c.com/q/", "http://c.com.org/"]
    df = spark.createDataFrame([(k, u, DAY, "h", "u", 1, 2) for k, u in enumerate(urls)], "page_id long, url string, fetch_time timestamp, host string, _url string, _found int, match_found int")
    out = url_filter(df, spark.createDataFrame(entries, ENTRIES))
    assert out.columns == [*df.columns, "blocked", "n_active", "first_match"]
    rows = out.collect()
    assert {r["page_id"]: r["n_active"] for r in rows} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 1, 7: 1, 8: 0}
    assert all(tuple(r)[3:7] == ("h", "u", 1, 2) for r in rows)


def test_host_of(spark):
    urls = ["HTTP://WWW.Ex.Com:8080/a", "ftp://u:p@h/x", "//h/x", None, "http://", "https://e.org?q"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u"))).collect()]
    assert got == ["ex.com", "h", None, None, None, "e.org"]


TOOLS = {"search": {"query": ("string", True), "limit": ("integer", True)}, "measure": {"query": ("string", True), "limit": ("number", False)}}


def test_arguments_against_schemas(spark):
    cases = [
        ("search", '{"limit": 3, "query": "a"}', True), ("search", '{"query": "a"}', False), ("search", '{"query": "a", "limit": 1.5}', False),
        ("search", '{"query": "a", "limit": 1, "more": 2}', False), ("measure", '{"query": "a"}', True), ("measure", '{"query": "a", "limit": 1.5}', True),
        ("measure", '{"query": 5}', False), ("other", "{}", False), ("search", None, False), (None, "{}", False), ("search", "{", False), ("search", "[1]", False),
    ]
    df = spark.createDataFrame([(t, a) for t, a, _ in cases], "tool string, a string")
    assert [r[0] for r in df.select(valid_arguments(F.col("tool"), F.col("a"), TOOLS)).collect()] == [x for _, _, x in cases]


def test_canonical_json(spark):
    texts = ['{"b": [1, {"z": null, "a": "é\\n"}], "a": true}', "[]", "no json", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical_json(F.col("t"))).collect()]
    assert got[2:] == [None, None] and json.loads(got[0]) == json.loads(texts[0]) and got[0].index('"a":true') < got[0].index('"b"') and got[1] == "[]"


def test_levels_of_a_graph_with_cycles(spark):
    calls = [(1, x) for x in "abcdefg"] + [(2, "a")]
    edges = [(1, "b", "a"), (1, "c", "a"), (1, "d", "b"), (1, "d", "c"), (1, "d", "a"), (1, "e", "f"), (1, "f", "e"), (1, "g", "e"), (2, "a", "b"), (1, "c", "missing")]
    got = topological_levels(spark.createDataFrame(calls, "conv_id long, call_id string"), spark.createDataFrame(edges, "conv_id long, call_id string, needs string"))
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 1, (1, "d"): 2, (1, "e"): None, (1, "f"): None, (1, "g"): None, (2, "a"): 0}


def test_calls_meet_their_results(spark):
    calls = [(1, "a", 1, "search", '{"query": "x", "limit": 2}', None, 0), (1, "b", 1, "search", "{}", ["a"], 0), (1, "b", 2, "late", "{}", [], 0), (1, None, 1, "t", "{}", [], 0), (2, "a", 0, "measure", None, ["a"], 0)]
    results = [(1, "a", 3, "late"), (1, "a", 2, "first"), (1, "z", 2, None), (None, "a", 1, "void")]
    got = link_tool_calls(spark.createDataFrame(calls, "conv_id long, call_id string, turn long, tool string, arguments string, needs array<string>, level int"), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), TOOLS)
    got = got.collect()
    apart = Counter((r["conv_id"], r["call_id"], r["turn"], r["tool"], r["status"], r["content"], r["level"]) for r in got if r["status"] in ("duplicate", "void"))
    assert apart == Counter([(1, "b", 2, "late", "duplicate", None, None), (1, None, 1, "t", "void", None, None), (1, "a", 3, None, "duplicate", "late", None), (None, "a", 1, None, "void", "void", None)])
    rows = {(r["conv_id"], r["call_id"]): r for r in got if r["status"] not in ("duplicate", "void")}
    assert {k: (r["status"], r["level"], r["valid"], r["turn"], r["content"]) for k, r in rows.items()} == {
        (1, "a"): ("answered", 0, True, 1, "first"), (1, "b"): ("unanswered", 1, False, 1, None), (1, "z"): ("orphan", None, False, 2, None), (2, "a"): ("cycle", None, False, 0, None),
    }
    assert json.loads(rows[(1, "a")]["json"]) == {"arguments": '{"limit":2,"query":"x"}', "call_id": "a", "result": "first", "status": "answered", "tool": "search", "valid": True}
    assert link_tool_calls(spark.createDataFrame(calls[:0], "conv_id long, call_id string, turn long, tool string, arguments string, needs array<string>"), spark.createDataFrame(results[:0], "conv_id long, call_id string, turn long, content string"), TOOLS).count() == 0


def test_equal_numbers_have_one_form(spark):
    texts = ['[1, 1.0, 1e0, 10E-1, -0, -0.0]', '{"b": 1e2, "a": "1.0 \\" 1e2 \\\\"}', '[1.50, 15e-1, 0.1, 1e-1]', '[1e22, 12345678901234567890, 1.0e3]', '["\\\\", 2.0, "\\\\\\"3.0"]', '2.0', '"2.0"', '{"1.0": 1.0}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical_json(F.col("t"))).collect()]
    assert got == ["[1,1,1,1,0,0]", '{"a":"1.0 \\" 1e2 \\\\","b":100}', "[1.5,1.5,0.1,0.1]", "[1.0E22,12345678901234567890,1000]", '["\\\\",2,"\\\\\\"3.0"]', "2", '"2.0"', '{"1.0":1}']
    long = json.dumps({"text": "a\n\"b\\" * 30000, "n": [1.0] * 5})
    assert json.loads(spark.createDataFrame([(long,)], "t string").select(canonical_json(F.col("t"))).first()[0]) == json.loads(long)


def levels_by_hand(calls, edges):
    needs = {c: {n for i, n in edges if i == c and n in calls} for c in calls}
    level, changed = {c: 0 for c in calls if not needs[c]}, True
    while changed:
        changed = False
        for c in calls:
            if c not in level and all(n in level for n in needs[c]):
                level[c], changed = 1 + max(level[n] for n in needs[c]), True
    return level


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_chains_joins_and_cycles(spark, seed):
    rng = random.Random(seed)
    calls = [f"c{i}" for i in range(60)]
    edges = [(f"c{i}", f"c{i - 1}") for i in range(1, 25)]
    for i in range(25, 60):
        edges += [(f"c{i}", f"c{rng.randrange(60 if rng.random() < 0.1 else i)}") for _ in range(rng.choice([0, 1, 1, 2, 3]))]
    edges.append(("c3", "unknown"))
    rows = spark.createDataFrame([(k, c) for k in (1, 2) for c in calls], "conv_id long, call_id string")
    need = spark.createDataFrame([(1, a, b) for a, b in edges], "conv_id long, call_id string, needs string")
    got = {(r[0], r[1]): r[2] for r in topological_levels(rows, need).collect()}
    want = levels_by_hand(calls, edges)
    assert got == {**{(1, c): want.get(c) for c in calls}, **{(2, c): 0 for c in calls}}


def test_a_chain_takes_as_many_rounds_as_its_length_has_digits(spark, monkeypatch):
    made, write = [], chat_tools.written
    monkeypatch.setattr(chat_tools, "written", lambda df, name, *more: made.append(name) or write(df, name, *more))
    calls = spark.range(200).select(F.lit(1).alias("conv_id"), F.concat(F.lit("c"), "id").alias("call_id"))
    edges = spark.range(1, 200).select(F.lit(1).alias("conv_id"), F.concat(F.lit("c"), "id").alias("call_id"), F.concat(F.lit("c"), F.col("id") - 1).alias("needs"))
    assert {r[1]: r[2] for r in topological_levels(calls, edges).collect()} == {f"c{i}": i for i in range(200)}
    assert made.count("chat-jumps") <= 10


def test_no_conversation_row_is_lost(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "abcd"), (1, 1, "assistant", "abcd"), (1, 1, "assistant", "abce"), (1, 2, "user", "x"), (1, 2, "user", "x"), (1, 2, "user", "y"), (1, None, "assistant", "v"), (None, 3, "assistant", "w"), (None, None, "user", "z"), (1, None, None, None), (None, 4, "user", "u")]
    calls, results, messages = derived_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = link_tool_calls(calls, results, TOOLS).unionByName(format_messages(messages)).collect()
    assert Counter(r["status"] for r in got) == {"answered": 1, "duplicate": 4, "void": 3, "message": 3}
    assert len(got) == len(turns) - 1  # the linked call and result are one row


def test_whole_long_texts_and_ordinary_messages(spark):
    long = 'é "quoted" \\ \n\t\u0001 end. ' * 20_000
    schema = "conv_id long, turn int, role string, text string, json string, level int"
    rows = [(1, 0, "user", long), (1, 1, "assistant", "a" * 12 + long), (1, 2, "user", long), (1, 3, "system", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 4, "tool", ""), (3, 0, "system", "s")]
    calls, results, messages = derived_calls(spark.createDataFrame([(*r, "j", 3) for r in rows], schema))
    got = link_tool_calls(calls, results, TOOLS).unionByName(format_messages(messages)).collect()
    assert Counter(r["status"] for r in got) == {"answered": 1, "message": 6}
    answered = next(json.loads(r["json"]) for r in got if r["status"] == "answered")
    assert answered["result"] == long and (answered["arguments"] == "null" or json.loads(answered["arguments"])["query"] == "a" * 12 + long)
    said = Counter((r["conv_id"], r["turn"], json.loads(r["json"])["role"], json.loads(r["json"])["content"]) for r in got if r["status"] == "message")
    assert said == Counter((c, t, role, text or "") for c, t, role, text in rows if (c, t) not in ((1, 1), (1, 2)))


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, bytes long")


def test_archives_round_trip(spark):
    big, odd = "<p>" + "x" * 200, "WARC/1.1\r\n\r\n\r\nContent-Length: 3\r\n\r\né " * 9
    rows = [(5, "http://a/1", big), (3, "http://a/2", big), (9, None, big), (1, "", "small"), (2, "http://a/\r\nX: y", "small"), (4, "http://b", None), (6, "u", odd), (7, "u", odd), (None, "n", "null id"), (8, "z", "long " * 300_000)]
    got = {r["page_id"]: r for r in archive_pages(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    first = {big: 3, odd: 6}
    for i, _, html in rows:
        raw, r = (html or "").encode(), got[i]
        revisit = html in first and first[html] != i
        assert (bytes(r["payload"]), r["payload_digest"]) == (raw, hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[html]) if revisit else ("response", None))
        assert r["headers"].startswith("WARC/1.1\r\n") and r["headers"].endswith("\r\n\r\n") and "\r\nX: y" not in r["headers"]


def test_payloads_are_stored_once_and_headers_are_exact(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "same " * 100) for i in range(20)]
    records = build_records(pages(spark, rows))
    path = write_archives(records, str(tmp_path / "warc"))
    back = read_archives(spark, path).collect()
    assert Counter(r["record_type"] for r in back) == {"response": 1, "revisit": 19}
    written = {r["page_id"]: r["record"] for r in records.collect()}
    for r in back:
        block = r["http_headers"].encode() + bytes(r["payload"] or b"")
        assert r["headers"].encode() + block == written[r["page_id"]].encode()


def test_repeated_pages_share_one_payload(spark, tmp_path):
    big = "<p>" + "y" * 300
    rows = [(3, "u", big)] * 4 + [(3, None, big), (3, "v", big), (5, "u", big), (5, "u", big), (None, "u", big), (1, "u", "tiny"), (1, "u", "tiny")] + [(None, "w", "z" * 150)] * 3
    got = archive_pages(pages(spark, rows), str(tmp_path / "warc")).collect()
    assert Counter((r["page_id"], bytes(r["payload"]).decode(), r["record_type"], r["refers_to"]) for r in got) == Counter(
        (i, h, *(("revisit", 3) if h == big and i != 3 else ("response", None))) for i, _, h in rows
    )
    parsed = read_archives(spark, str(tmp_path / "warc")).collect()
    assert Counter(bytes(r["payload"]).decode() for r in parsed if r["payload"] is not None) == {big: 1, "tiny": 2, "z" * 150: 1}


def test_records_of_one_page_have_ids_of_their_own_and_revisits_name_the_response(spark, tmp_path):
    big = "<p>" + "y" * 300
    rows = [(3, "u", big), (3, "v", big), (3, None, big), (3, "u", "other " * 50), (5, "u", big), (None, "u", big)]
    path = write_archives(build_records(pages(spark, rows)), str(tmp_path / "warc"))
    field = lambda name: F.regexp_extract("headers", rf"(?m)^{name}: (\S+)", 1).alias(name)
    got = read_archives(spark, path).select("page_id", "record_type", field("WARC-Record-ID"), field("WARC-Refers-To"), field("WARC-Target-URI")).collect()
    assert len({r["WARC-Record-ID"] for r in got}) == len(rows)
    response = next(r["WARC-Record-ID"] for r in got if r["record_type"] == "response" and r["WARC-Target-URI"] == "u" and r["page_id"] == 3 and any(x["WARC-Refers-To"] == r["WARC-Record-ID"] for x in got))
    assert {r["WARC-Refers-To"] for r in got if r["record_type"] == "revisit"} == {response}


def test_hot_keys_are_broadcast_and_the_rest_is_dealt_out(spark):
    df = spark.createDataFrame([("hot", k) for k in range(5000)] + [(f"k{k % 40}", k) for k in range(200)] + [(None, 1)], "key string, v int")
    keys = df.where("key < 'k30'").groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    for how in ("inner", "left"):
        want = Counter(map(tuple, df.join(keys, "key", how).collect()))
        assert Counter(map(tuple, join_counted(df, keys, "key", "n", how, bound=5, share=10).collect())) == want
        assert Counter(map(tuple, join_counted(df, keys, "key", "n", how).collect())) == want
    counts = spark.createDataFrame([(k, k) for k in (1, 2, 3, 9, 10, 11, 25)], "x int, copies long")
    assert Counter((r[0], r[1]) for r in repeated(counts, "copies", 3).collect()) == Counter((k, i) for k in (1, 2, 3, 9, 10, 11, 25) for i in range(k))


def test_damage_is_noticed_and_empty_tables_pass(spark):
    from graphloom.llm.warc import reconstruct

    records = spark.createDataFrame([(1, "response", "h", "x", bytearray(b"payload"), "00", None, 1)], "page_id long, record_type string, headers string, http_headers string, payload binary, payload_digest string, refers_to long, copies long")
    with pytest.raises(Exception, match="does not match its digest"):
        reconstruct(records).collect()
    assert archive_pages(pages(spark, [])).count() == 0
