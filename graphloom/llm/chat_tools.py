"""Chat formatting: tool calls linked to their results and written as canonical JSON.

Calls and results meet in a hash join on (conversation, call id).  Calls are ordered topologically by
level: a call lies one level above the deepest call whose result it uses.  Calls that use one result only
form chains, which pointer jumping contracts in as many rounds of joins as the length of the longest has
binary digits; calls that use several take a round a level of theirs.  Each round is written to the
shared folder once.  Arguments are parsed once to a variant, checked against the tool's schema by SQL
expressions and written back with sorted keys, one form for equal numbers and no blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, repeated, written

#: schema of arguments: tool -> {argument: (type, required)}
Schemas = dict[str, dict[str, tuple[str, bool]]]
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",)}


NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
_ESCAPES = (("\\\\", "\\u005c"), ('\\"', "\\u0022"))


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys; null where the text is no JSON.

    Numbers that are written as integers stay; others print as their nearest double, without fraction or
    exponent where it is whole and below 2^53: 1, 1.0 and 1e0 are all 1."""
    plain = F.to_json(F.try_parse_json(text))
    # Every second part between quotation marks is outside of texts, once marks inside them are escaped otherwise.
    split = plain
    for mark, other in _ESCAPES:
        split = F.replace(split, F.lit(mark), F.lit(other))
    parts = F.transform(F.split(split, '"'), lambda p, i: F.when(i % 2 == 0, _one_form(p)).otherwise(p))
    joined = F.array_join(parts, '"')
    for mark, other in _ESCAPES:
        joined = F.replace(joined, F.lit(other), F.lit(mark))
    return joined


def _one_form(part: Column) -> Column:
    """A part of JSON without texts, its numbers in their one form."""
    between, numbers = F.split(part, NUMBER), F.regexp_extract_all(part, F.lit(NUMBER), F.lit(0))

    def form(n: Column) -> Column:
        value = n.cast("double")
        whole = (F.abs(value) < F.lit(float(1 << 53))) & (value == F.floor(value))
        return F.when(n.rlike("^-?[0-9]+$"), F.when(n == "-0", "0").otherwise(n)).when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))

    pieces = F.zip_with(between, numbers, lambda b, n: F.concat(F.coalesce(b, F.lit("")), F.coalesce(form(n), F.lit(""))))
    return F.when(part.rlike("[0-9]"), F.array_join(pieces, "")).otherwise(part)


def valid_arguments(tool: Column, text: Column, schemas: Schemas) -> Column:
    """True when the arguments are a JSON object that has all required arguments of the tool, no
    others than it knows, and the stated types.  Unknown tools, null and broken JSON are invalid."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    verdict = F.lit(False)
    for name, spec in sorted(schemas.items()):
        ok = kind.startswith("OBJECT")
        for arg, (type_, required) in sorted(spec.items()):
            found = F.schema_of_variant(F.try_variant_get(v, f"$.{arg}", "variant"))
            right = F.lit(False)
            for t in TYPES[type_]:
                right = right | found.startswith(t)
            ok = ok & F.coalesce(right, F.lit(not required))
        extra = F.array_except(F.json_object_keys(text), F.array(*[F.lit(a) for a in sorted(spec)]))
        verdict = F.when(tool == name, ok & (F.size(extra) == 0)).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def contracted(singles: DataFrame) -> DataFrame:
    """(conv_id, call_id, end, steps) from calls with one need each (conv_id, call_id, needs): the first call on the way that is none of them.

    Every round doubles the steps.  Calls on or behind a cycle are left out."""
    jump = written(singles.select("conv_id", "call_id", F.col("needs").alias("end"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open")), "chat-jumps")
    rounds = jump.count().bit_length() + 1
    for k in range(rounds):
        on = jump.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("next"), F.col("steps").alias("more"))
        jump = jump.join(on, ["conv_id", "end"], "left")
        jump = jump.select("conv_id", "call_id", F.coalesce("next", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("open"))
        jump = written(jump, "chat-jumps")
        if not jump.where("open").limit(1).count():
            break
    # After these rounds a way without a cycle has ended; the steps of others are not used.
    return jump.where("not open").drop("open")


def topological_levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): level 0 uses no call's result; null marks a call on or behind a cycle.

    edges: (conv_id, call_id, needs).  Edges to unknown calls do not count.  Chains of calls with one need each
    are contracted; the calls with several needs then take one round a level among themselves.
    """
    keys = ["conv_id", "call_id"]
    nodes = calls.select(*keys).distinct()
    edges = edges.join(nodes.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi").select(*keys, "needs").distinct()
    needs = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.min("needs").alias("needs"))
    needs = written(needs, "chat-needs")
    if not needs.limit(1).count():
        return nodes.withColumn("level", F.lit(0))
    chains = contracted(needs.where("n = 1").select(*keys, "needs"))
    known = nodes.join(needs.select(*keys), keys, "left_anti").withColumn("level", F.lit(0))
    several = needs.where("n > 1").select(*keys)
    if several.limit(1).count():
        known = known.unionByName(_levels_of_several(edges.join(several, keys, "left_semi"), needs, chains, known))
        known = written(known, "chat-levels")
    below = known.select("conv_id", F.col("call_id").alias("end"), F.col("level").alias("below"))
    chained = chains.join(below, ["conv_id", "end"]).select(*keys, (F.col("below") + F.col("steps")).cast("int").alias("level"))
    return nodes.join(known.unionByName(chained), keys, "left").select(*keys, "level")


def _levels_of_several(edges: DataFrame, needs: DataFrame, chains: DataFrame, roots: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls with several needs that end, by rounds over these calls."""
    keys, end = ["conv_id", "call_id"], ["conv_id", "end"]
    on = chains.select("conv_id", F.col("call_id").alias("needs"), F.col("end").alias("_end"), "steps")
    edges = edges.join(on, ["conv_id", "needs"], "left")
    # A need on or behind a cycle has no end; it stays itself and never becomes known.
    edges = edges.select(*keys, F.coalesce("_end", "needs").alias("end"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    found, new = [], roots
    known = F.lit(None).cast("int").alias("below")
    open_ = edges.select("*", known)
    while True:
        levels = new.select("conv_id", F.col("call_id").alias("end"), F.col("level").alias("_level"))
        open_ = open_.join(levels, end, "left").select(*keys, "end", "steps", F.coalesce("below", "_level").alias("below"))
        open_ = written(open_, "chat-open")
        new = open_.groupBy(*keys).agg(F.max(F.col("below") + F.col("steps")).cast("int").alias("level"), F.count_if(F.col("below").isNull()).alias("unknown"))
        new = written(new.where("unknown = 0").drop("unknown"), "chat-several")
        if not new.limit(1).count():
            break
        found.append(new)
        open_ = open_.join(new.select(*keys), keys, "left_anti")
    empty = roots.limit(0)
    for part in found:
        empty = empty.unionByName(part)
    return empty


def format_messages(messages: DataFrame) -> DataFrame:
    """Ordinary messages (conv_id, turn, role, content) in the columns of link_tool_calls: one row each, status 'message'.

    Null fields stand as null in the JSON; repeated rows are kept."""
    body = F.to_json(F.struct("content", "role"), {"ignoreNullFields": "false"})
    none = lambda kind: F.lit(None).cast(kind)
    return messages.select("conv_id", none("string").alias("call_id"), none("int").alias("level"), "turn", none("string").alias("tool"), F.lit("message").alias("status"), F.lit(False).alias("valid"), none("string").alias("arguments"), "content", body.alias("json"))


def _first_and_others(rows: DataFrame, value: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Per key (conv_id, call_id) the smallest value once, and all other rows; rows of keys with a null among the others with `void`.

    Equal rows are counted before they are dealt out, so one key may hold many of them."""
    void = F.col("conv_id").isNull() | F.col("call_id").isNull()
    key = F.when(~void, F.struct("conv_id", "call_id")).alias("key")
    distinct = written(rows.groupBy(key, void.alias("void"), "conv_id", "call_id", value).agg(F.count("*").alias("copies")), name)
    keys = distinct.where("not void")
    first = written(keys.groupBy("key").agg(F.min(value).alias("first"), F.count("*").alias("rows")), f"{name}-first")
    marked = join_counted(keys, first, "key", "rows").withColumn("extra", F.col("copies") - F.col(value).eqNullSafe(F.col("first")).cast("long"))
    others = marked.select("conv_id", "call_id", value, "void", "extra").unionByName(distinct.where("void").select("conv_id", "call_id", value, "void", F.col("copies").alias("extra")))
    return first.select("key.conv_id", "key.call_id", F.col("first").alias(value)), repeated(others.where("extra > 0"), "extra").drop("extra")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call and per result without a call; no input row is lost.

    calls: conv_id, call_id, turn, tool, arguments, needs array<string>; results: conv_id, call_id,
    turn, content.  Of several calls with one id the first by (turn, tool, arguments, needs) is linked, of several
    results the first by (turn, content), nulls first; the others are rows of their own.  status: 'answered',
    'unanswered', 'orphan' (a result without call), 'cycle' (the call waits for itself), 'duplicate' (another call or
    result with the id), 'void' (conv_id or call_id is null).  level is null where a row is not ordered; (level, turn,
    call_id) orders a conversation topologically.  json: the record in canonical form.  Further input
    columns are ignored; an empty side is allowed.
    """
    keys = ["conv_id", "call_id"]
    c = F.struct(F.col("turn").alias("turn"), "tool", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs")).alias("c")
    one, more_calls = _first_and_others(calls.select(*keys, c), "c", "chat-calls")
    one = one.select(*keys, "c.turn", "c.tool", "c.arguments", "c.needs")
    r = F.struct(F.col("turn").alias("result_turn"), F.col("content").alias("content")).alias("r")
    answers, more_results = _first_and_others(results.select(*keys, r), "r", "chat-results")
    answers = answers.select(*keys, "r.result_turn", "r.content", F.lit(True).alias("has_result"))
    edges = one.select(*keys, F.explode("needs").alias("needs"))
    levels = topological_levels(one, edges)
    linked = one.join(levels, keys).withColumn("has_call", F.lit(True)).join(answers.hint("shuffle_hash"), keys, "full_outer")
    status = F.when(F.col("has_call").isNull(), "orphan").when(F.col("level").isNull(), "cycle").when(F.col("has_result").isNull(), "unanswered").otherwise("answered")
    linked = linked.select(*keys, "level", F.coalesce("turn", "result_turn").alias("turn"), "tool", status.alias("status"), F.col("has_call").isNotNull().alias("has_call"), "arguments", "content")
    apart = F.when(F.col("void"), "void").otherwise("duplicate").alias("status")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    more_calls = more_calls.select(*keys, none("int", "level"), "c.turn", "c.tool", apart, F.lit(True).alias("has_call"), "c.arguments", none("string", "content"))
    more_results = more_results.select(*keys, none("int", "level"), F.col("r.result_turn").alias("turn"), none("string", "tool"), apart, F.lit(False).alias("has_call"), none("string", "arguments"), "r.content")
    linked = linked.unionByName(more_calls).unionByName(more_results)
    valid = F.col("has_call") & valid_arguments(F.col("tool"), F.col("arguments"), schemas)
    out = linked.select(*keys, "level", "turn", "tool", "status", valid.alias("valid"), canonical_json(F.col("arguments")).alias("arguments"), "content")
    body = F.to_json(F.struct(F.coalesce("arguments", F.lit("null")).alias("arguments"), "call_id", F.col("content").alias("result"), "status", "tool", "valid"), {"ignoreNullFields": "false"})
    return out.withColumn("json", body)
