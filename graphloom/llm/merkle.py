"""Operator 12: Merkle manifest of a dataset, with a proof and a tamper check of every row.

Rows are leaves of a tree per source, the trees' roots are leaves of one more tree.  The levels are built
once and written as node rows, linked to their parents; then a recursive query climbs them: the leaves
start with the hash of the row as it is found now, and every step appends the siblings on the way and
folds the hash one level up; both are gathered by leaf family.  A row is unchanged if its folded hash is the root.

Leaves below one lowest node share all further siblings, so they climb as one row with an array of their
folded hashes.  The upper nodes, at most `UPPER_NODES`, are broadcast to the climb; below them every node
covers a small share of the rows, so that joins by node deal them out evenly.

Defined cases: null values print as `-`; ids ascend with null first, equal ids by leaf hash; a null source
is a source of its own and comes first; repeated rows are leaves of their own; an empty table gives an
empty result; further columns of the table are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_running
from .common import join_counted, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Nodes that are broadcast to the climb; a node row has less than 400 bytes.
UPPER_NODES = 20_000
#: A level of at most so many nodes is built in one task.
SMALL_LEVEL = 10_000
#: Rows of a range when leaves are numbered.
RANGE_ROWS = 2_000
#: Levels of the tree over the sources are numbered from here.
TOP = 1_000
#: An id is level * LEVEL + position of the node's first leaf.
LEVEL = 1 << 50


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else number of UTF-8 bytes, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return digest(*[encoded(c) for c in columns.values()])


def half_of_ids(doc_id: Column) -> Column:
    """True where 2 divides crc32 of the id as text (null: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 2 == 0


def leaves_of(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", found: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, source, leaf, found): hash of each row as listed and as `found` (changed columns) has it now.

    source is a text that is never null and sorts like the column, null first."""
    listed = {f: F.col(f) for f in FIELDS}
    key = F.coalesce(F.concat(F.lit("+"), F.col(source_col)), F.lit(""))
    now = leaf_digest(listed | (found or {}))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("source"), leaf_digest(listed).alias("leaf"), now.alias("found"))
    return written(rows, "merkle-rows")  # texts are read once


def numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with first (position in the order of source and id), tree (first of the source), at (position in it) and n (leaves of the source); the sources."""
    order = [F.col("source"), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("found")]
    placed = with_running(leaves, [], order, range_rows=RANGE_ROWS).withColumnRenamed("position", "first").drop("total")
    placed = written(placed, "merkle-leaves")  # cuts the windows off, which would run for each use
    sources = written(placed.groupBy("source").agg(F.min("first").alias("tree"), F.count("*").alias("n")), "merkle-sources")
    return join_counted(placed, sources, "source", "n").withColumn("at", F.col("first") - F.col("tree")), sources


def with_family(level: DataFrame, number: int) -> DataFrame:
    """Rows (tree, at, n, first, hash, ...) of one level with id, before, after, and where n > 1 parent and parent_hash.

    Every FANOUT consecutive nodes of a tree have a parent; before and after are the siblings' hashes."""
    place, inner = F.col("at") % FANOUT, F.col("n") > 1
    family = Window.partitionBy("tree", F.floor(F.col("at") / FANOUT))
    rows = level.withColumns({f"_{k}": F.coalesce(F.max(F.when(place == k, F.col("hash"))).over(family), F.lit("")) for k in range(FANOUT)})
    rows = rows.withColumn("_first", F.min("first").over(family))
    beside = lambda side: F.concat(*[F.when(side(k), F.col(f"_{k}")).otherwise("") for k in range(FANOUT)])
    rows = rows.withColumns({
        "id": F.lit(number * LEVEL) + F.col("first"),
        "parent": F.when(inner, F.lit((number + 1) * LEVEL) + F.col("_first")),
        "parent_hash": F.when(inner, digest(*[F.col(f"_{k}") for k in range(FANOUT)])),
        "before": beside(lambda k: F.lit(k) < place),
        "after": beside(lambda k: F.lit(k) > place),
    })
    return rows.drop("_first", *[f"_{k}" for k in range(FANOUT)])


def next_level(level: DataFrame) -> DataFrame:
    """The parents of a level's nodes, once each."""
    parents = level.where((F.col("n") > 1) & (F.col("at") % FANOUT == 0))
    first = F.col("parent") % F.lit(LEVEL)
    return parents.select("tree", F.floor(F.col("at") / FANOUT).alias("at"), F.ceil(F.col("n") / FANOUT).alias("n"), first.alias("first"), F.col("parent_hash").alias("hash"))


def levels_of(level: DataFrame, number: int, sizes: DataFrame) -> list[tuple[int, int, DataFrame]]:
    """(number, nodes, rows) of `level` and those above it, written; sizes: a row with n leaves for each tree."""
    most = sizes.agg(F.max("n")).first()[0]
    heights = range(next(h for h in range(99) if FANOUT**h >= most) + 1)
    nodes = [F.sum(F.when(F.lit(h == 0) | (F.col("n") > FANOUT ** max(h - 1, 0)), F.ceil(F.col("n") / FANOUT**h))) for h in heights]
    levels = []
    for height, count in zip(heights, sizes.agg(*nodes).first(), strict=True):
        if count <= SMALL_LEVEL:
            level = level.coalesce(1)  # narrow rows of bounded number need no exchange for their families
        level = written(with_family(level, number + height), f"merkle-level-{number + height}")
        levels.append((number + height, count, level))
        level = next_level(level)
    return levels


def build(leaves: DataFrame) -> tuple[DataFrame, list[tuple[int, int, DataFrame]], DataFrame]:
    """Leaf rows (numbered, with id, parent, before, after), (number, nodes, rows) of the levels above, and (tree, subroot, n leaves), all written.

    The root of a source's tree (its only node on its level, n = 1) is a leaf of the tree over the sources;
    there its `parent` continues."""
    placed, sources = numbered(leaves)
    if not sources.limit(1).count():
        return placed, [], sources
    below = levels_of(placed.withColumnRenamed("leaf", "hash"), 0, sources)
    subroots = together([level.where("n = 1").select(F.col("tree").alias("first"), F.col("id").alias("subroot_id"), "hash") for _, _, level in below])
    ranked = written(with_running(subroots, [], [F.col("first")], range_rows=RANGE_ROWS), "merkle-subroots")
    top = ranked.select(F.lit(-1).cast("long").alias("tree"), F.col("position").alias("at"), F.col("total").alias("n"), "first", "hash", "subroot_id")
    above = levels_of(top, TOP, top.limit(1))
    # A leaf of the upper tree is the root of a source's tree, so it keeps that id.
    above[0] = (*above[0][:2], above[0][2].withColumn("id", F.col("subroot_id")))
    roots = ranked.select(F.col("first").alias("tree"), F.col("hash").alias("subroot")).join(sources.select("tree", "n"), "tree")
    return below[0][2], [*below[1:], *above], written(roots, "merkle-roots")


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: One step up for every row whose node is listed; the query ends where no node is.  Each step appends a row of siblings.
CLIMB = """
WITH RECURSIVE climb(family, step, node, folds, siblings, ended) AS (
  SELECT family, step, node, folds, unhex('') AS siblings, ended FROM {start}
  UNION ALL
  SELECT c.family, c.step + 1, n.parent, transform(c.folds, x -> unhex(sha2(CAST(concat(n.before, lower(hex(x)), n.after) AS BINARY), 256))),
    unhex(concat(n.before, n.after)), n.ended
  FROM climb c JOIN {nodes} n ON n.id = c.node)
SELECT family, step, node, CASE WHEN ended THEN folds END AS folds, siblings FROM climb
"""


def ascend(start: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Climb (family, step, node, folds, ended) over node rows (id, parent, before, after, ended); all steps, with folds where one ended; written."""
    spark, limit = start.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return written(spark.sql(CLIMB, start=start, nodes=nodes), name)
    finally:
        spark.conf.set(limit, before)


def climb(leaf_rows: DataFrame, levels: list[tuple[int, int, DataFrame]], root_id: int, upper_nodes: int = UPPER_NODES) -> DataFrame:
    """(family, folds, siblings): for every lowest node the hashes of the root as its leaves fold to it, and the siblings above, level by level; bytes."""
    rest, upper, count = list(levels), [], 0
    while rest and (count := count + rest[-1][1]) <= max(upper_nodes, 1 + FANOUT):
        upper.append(rest.pop())
    cut = upper[-1][0]

    def leaves_lower(number: int) -> Column:
        """Whether the parent of a node is of the upper levels; a source's root counts to the lowest level over the sources."""
        return F.when((F.col("n") <= FANOUT) & F.lit(number < TOP), F.lit(cut <= TOP)).otherwise(F.lit(number + 1 >= cut))

    rows = lambda parts, ended: together([x.where("parent is not null").select("id", "parent", "before", "after", ended(number).alias("ended")) for number, _, x in parts])
    # Leaves of a family start together, each with the hash that its parent would have.
    folded = F.when(F.col("n") > 1, digest(F.col("before"), F.col("found"), F.col("after"))).otherwise(F.col("found"))
    leaves = leaf_rows.select(F.coalesce("parent", "id").alias("node"), "at", F.unhex(folded).alias("hash"), leaves_lower(0).alias("ended"))
    start = leaves.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "hash"))).alias("folds"), F.first("ended").alias("ended"))
    start = start.select(F.col("node").alias("family"), F.lit(0).alias("step"), "node", F.col("folds.hash").alias("folds"), "ended")
    steps = []
    if rest:
        lower = ascend(start, rows(rest, leaves_lower), "merkle-lower")
        start = lower.where("folds is not null").select("family", "step", "node", "folds")
        steps.append(lower.withColumn("folds", F.lit(None).cast("array<binary>")))
    start = start.withColumn("ended", F.col("node") == root_id)
    steps.append(ascend(start, F.broadcast(rows(upper, lambda _: F.col("parent") == root_id)), "merkle-upper"))
    # Every step of a family once; where the second climb takes over, its first row has no siblings.
    by_step = F.sort_array(F.collect_list(F.struct("step", "siblings")))["siblings"]
    gathered = together(steps).groupBy("family").agg(F.max("folds").alias("folds"), by_step.alias("steps"))
    return gathered.select("family", "folds", F.aggregate("steps", F.unhex(F.lit("")), lambda a, x: F.concat(a, x)).alias("siblings"))


def merkle_manifest(docs: DataFrame, found: dict[str, Column] | None = None, upper_nodes: int = UPPER_NODES) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    found: columns as they are found now (a changed text, say); verified says whether the row is as listed."""
    leaf_rows, levels, roots = build(leaves_of(docs, found=found))
    if not levels:
        nothing = {c: F.lit(None).cast("string") for c in ("subroot", "root", "proof_sha256", "folded_root")}
        return leaf_rows.select("doc_id", "leaf").withColumns(nothing).withColumn("verified", F.lit(None).cast("boolean"))
    root_id, root = levels[-1][2].select("id", "hash").first()
    climbed = climb(leaf_rows, levels, root_id, upper_nodes)

    own = leaf_rows.select("doc_id", F.col("hash").alias("leaf"), "tree", F.coalesce("parent", "id").alias("family"), (F.col("at") % FANOUT).cast("int").alias("place"), F.unhex(F.concat("before", "after")).alias("beside"))
    rows = join_counted(own.join(climbed, "family"), roots, "tree", "n")
    folded, text = F.lower(F.hex(F.get("folds", F.col("place")))), lambda c: F.lower(F.hex(c))
    rows = rows.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), digest(text("beside"), text("siblings")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
