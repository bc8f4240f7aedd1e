"""Merkle manifest of a dataset, and inclusion proofs by a recursive climb.

Leaves of a tree (one for each source) ascend by doc_id; every three nodes in a
row become their hash, until one is left.  The subroots, ordered by source, are
the leaves of the top tree, and what that leaves is the root.

**Build.**  Leaves are numbered within their tree by a range sort and counts per
range, so no tree is ordered in one task.  729 consecutive nodes are a *cell*:
its six levels are made where its nodes meet, so one shuffle serves six levels.
Every node above the leaves becomes a row ``cell, node`` with the digests of its
children, and the node of its parent, with its own place there.

**Climb.**  A recursive query starts with a row per leaf; each step joins the
rows with their parent nodes, folds the digest with its siblings and emits these
as the proof's next link, until there is no parent.  Nodes that lie above a
cell are few and are repeated for every cell below them; so a join key never
has more than 729 rows, however large a source is.  A step emits only its own
link, not the whole proof up to there; links are put together at the end.

Edge cases: a null field counts as `-`; null doc_ids come first in their source,
and rows that share a doc_id go by their leaf digest; repeated rows are leaves
of their own; null source is a tree of its own, before all others; an empty
text and null differ; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm.common import bounded, materialize, scratch, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Levels that a cell holds above its lowest nodes, and how many these are.
CELL_LEVELS = 6
CELL = FANOUT**CELL_LEVELS


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Hash of a row's fields, each with its length before it."""
    parts = []
    for name in FIELDS:
        text = fields[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """``tree, doc_id, leaf, shown``: each row's digest, and that of the text
    which is shown for it (``tampered``).  Trees of sources start with ``+``; that
    of null is empty, and so the first."""
    columns = {c: F.col(f"`{c}`") for c in FIELDS}
    digest = leaf_digest(columns)
    shown = F.when(tampered.eqNullSafe(columns["text"]), F.lit(None)).otherwise(leaf_digest(columns | {"text": tampered}))
    tree = F.coalesce(F.concat(F.lit("+"), columns["source"].cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), columns["doc_id"].cast("long").alias("doc_id"), F.unhex(digest).alias("leaf"), F.unhex(shown).alias("shown"))
    return rows.select("tree", "doc_id", "leaf", F.coalesce("shown", "leaf").alias("shown"))


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``rank``, the number of their ``tree``, ``n``, its rows, and ``i``,
    their number in it, in place of ``tree``; and the trees as ``rank, n``.  Rows
    are sorted by ranges; what is counted has a row for each range and tree."""
    ranged = materialize(rows.repartitionByRange("tree", *order).withColumn("range", F.spark_partition_id()), "merkle-ranged")
    counts = materialize(ranged.groupBy("tree", "range").agg(F.count("*").alias("here")), "merkle-counts")
    # Trees are numbered within the range they begin in, from the number of
    # trees that begin in earlier ranges: a row for each range.
    begins = counts.groupBy("tree").agg(F.min("range").alias("first"), F.sum("here").alias("n"))
    starts = begins.groupBy("first").agg(F.count("*").alias("k"))
    before = starts.select("first", (F.sum("k").over(Window.orderBy("first")) - F.col("k")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("first").orderBy("tree")) - 1
    trees = materialize(begins.join(F.broadcast(before), "first").select("tree", rank.alias("rank"), "n"), "merkle-trees")
    earlier = F.sum("here").over(Window.partitionBy("tree").orderBy("range")) - F.col("here")
    offsets = counts.select("tree", "range", earlier.alias("offset")).join(bounded(trees, trees.count(), 96), "tree")
    offsets = materialize(offsets, "merkle-offsets")
    here = F.row_number().over(Window.partitionBy("rank", "range").orderBy(*order)) - 1
    placed = ranged.join(bounded(offsets, offsets.count(), 112), ["tree", "range"]).withColumn("i", F.col("offset") + here)
    return placed.drop("tree", "range", "offset"), trees.select("rank", "n")


def levels_above(n: int) -> int:
    """Levels above ``n`` leaves."""
    depth, reach = 0, 1
    while reach < n:
        depth, reach = depth + 1, reach * FANOUT
    return depth


def with_depth(rows: DataFrame) -> DataFrame:
    """``levels_above(n)`` of a column ``n``, as ``depth``."""
    powers = ", ".join(f"{FANOUT**k}L" for k in range(40))
    return rows.withColumn("depth", F.expr(f"size(filter(array({powers}), x -> x < n))"))


def build(nodes: DataFrame, deepest: int) -> tuple[DataFrame, DataFrame]:
    """All nodes above ``nodes(rank, n, depth, i, digest)`` as ``rank, n, depth, level,
    i, kids, digest``, and each tree's last one as ``rank, n, depth, digest``.
    Digests are binary, ``kids`` those of the children, joined.  One shuffle for
    six levels; ``deepest`` is the largest ``depth``."""
    tree = ["rank", "n", "depth"]
    made, tops, low, current = [], [], 0, nodes
    while True:
        cells = current.groupBy(*tree, F.expr(f"i div {CELL}").alias("cell")).agg(F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("a"))
        lower = "element_at(all, -1)"
        parents = f"transform(sequence(0, int((size({lower}) - 1) div 3)), p -> unhex(sha2(array_join(transform(slice({lower}, 3 * p + 1, 3), x -> lower(hex(x))), ''), 256)))"
        steps = f"least({CELL_LEVELS}, depth - {low})"
        grown = F.expr(f"if({steps} = 0, array(a.digest), aggregate(sequence(1, greatest(1, {steps})), array(a.digest), (all, x) -> concat(all, array({parents}))))")
        # Written once: its top goes up, and its levels become nodes.
        cells = materialize(cells.select(*tree, "cell", grown.alias("all")).withColumn("digest", F.expr(f"{lower}[0]")), "merkle-cells")
        rows = cells.select(*tree, "cell", "all", F.explode(F.expr("if(size(all) < 2, array(), sequence(1, size(all) - 1))")).alias("l"))
        rows = rows.select(*tree, "cell", "l", F.expr("get(all, l - 1)").alias("under"), F.posexplode(F.expr("get(all, l)")).alias("p", "digest"))
        i = F.col("cell") * F.expr(f"bigint(pow(3, {CELL_LEVELS} - l))") + F.col("p")
        kids = F.expr("aggregate(slice(under, 3 * p + 1, 3), unhex(''), (t, x) -> concat(t, x))")
        made.append(rows.select(*tree, (F.col("l") + low).alias("level"), i.alias("i"), kids.alias("kids"), "digest"))
        low += CELL_LEVELS
        tops.append(cells.where(F.col("depth").between(low - CELL_LEVELS + (low > CELL_LEVELS), low)).select(*tree, "digest"))
        if deepest <= low:
            return _all(made), _all(tops)
        current = cells.where(F.col("depth") > low).select(*tree, F.col("cell").alias("i"), "digest")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _node(level: str, i: str) -> str:
    return f"(bigint({level}) * {1 << 48} + {i})"


def parent(level: str, i: str, top_depth: int) -> list[Column]:
    """``up, slot``: the parent of the node that is ``i`` of its level, and its
    own place among the children.  A subroot's parents are those of its place in
    the top tree, counted as further levels; the root has none."""
    at = f"if({level} < depth, {i}, rank div bigint(pow(3, {level} - depth)))"
    last = f"{level} >= depth + {top_depth}"
    return [F.expr(f"if({last}, null, {_node(f'{level} + 1', f'{at} div 3')})").alias("up"), F.expr(f"int({at} % 3)").alias("slot")]


def spread_over(rows: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each ``block`` from ``first`` to ``last``, in two steps so that no
    array is long."""
    chunks = rows.withColumn("block0", F.explode(F.expr(f"sequence({first}, {last}, {CELL}L)")))
    return chunks.withColumn("block", F.explode(F.expr(f"sequence(block0, least(block0 + {CELL - 1}, {last}))"))).drop("block0")


def manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame, str] | None:
    """Of ``leaves``: these with their places (``rank, n, depth, i, up, slot``), the
    nodes as ``rank, block, node, kids, up, slot, subroot`` (null but at a tree's
    top), and the root in hex; None where there are none.

    A node is there once for every block of 729 leaves below it."""
    placed, trees = numbered(rows, "doc_id", "leaf")
    facts = trees.agg(F.count("*").alias("trees"), F.max("n").alias("n")).first()
    if not facts["trees"]:
        return None
    top_depth = levels_above(facts["trees"])
    placed = with_depth(placed)
    placed = materialize(placed.select("*", *parent("0", "i", top_depth)), "merkle-placed")
    low, subroots = build(placed.select("rank", "n", "depth", "i", F.col("leaf").alias("digest")), levels_above(facts["n"]))
    subroots = materialize(subroots, "merkle-subroots")
    top = subroots.select(F.lit(0).cast("long").alias("rank"), F.lit(facts["trees"]).alias("n"), F.lit(top_depth).alias("depth"), F.col("rank").alias("i"), "digest")
    high, root = build(top, top_depth)

    in_tree = low.select("*", *parent("level", "i", top_depth))
    out = ["rank", "block", F.expr(_node("level", "at")).alias("node"), "kids", "up", "slot", F.expr("if(level = depth, digest, null)").alias("subroot")]
    last = f"(n - 1) div {CELL}"
    in_cell = in_tree.where(f"level <= {CELL_LEVELS}").withColumn("block", F.expr(f"i div bigint(pow(3, {CELL_LEVELS} - level))"))
    reach = f"bigint(pow(3, level - {CELL_LEVELS}))"
    over_cells = spread_over(in_tree.where(f"level > {CELL_LEVELS}"), f"i * {reach}", f"least({last}, (i + 1) * {reach} - 1)")
    # The path of each subroot through the top tree, for each of its blocks.
    path = subroots.select("rank", "n", "depth", F.explode(F.expr(f"if({top_depth} = 0, array(), sequence(1, greatest(1, {top_depth})))")).alias("t"))
    path = path.withColumn("i", F.expr("rank div bigint(pow(3, t))"))
    path = path.join(high.select(F.col("level").alias("t"), "i", "kids"), ["t", "i"]).withColumn("level", F.expr("depth + t"))
    path = spread_over(path.select("*", *parent("level", "i", top_depth)), "0L", last).withColumn("digest", F.lit(None).cast("binary"))
    nodes = _all([rows.withColumn("at", F.col("i")).select(*out) for rows in (in_cell, over_cells, path)])
    return placed, materialize(nodes, "merkle-nodes"), root.select(F.lower(F.hex("digest"))).first()[0]


#: Each step goes from a node to its parent: the digest is folded with those of
#: the siblings, which are this step's part of the proof.
CLIMB = """
with recursive climb(rank, i, level, up, slot, fold, link, doc_id, leaf, subroot) as (
  select rank, i, 0, up, slot, shown, cast(null as binary), doc_id, leaf, if(depth = 0, leaf, cast(null as binary)) from {leaves}
  union all
  select c.rank, c.i, c.level + 1, n.up, n.slot,
    unhex(sha2(lower(hex(concat(substring(n.kids, 1, 32 * c.slot), c.fold, substring(n.kids, 32 * c.slot + 33)))), 256)),
    concat(substring(n.kids, 1, 32 * c.slot), substring(n.kids, 32 * c.slot + 33)),
    cast(null as bigint), cast(null as binary), n.subroot
  from climb c join {nodes} n on n.rank = c.rank and n.block = c.i div {cell} and n.node = c.up)
select rank, i, level, if(up is null, fold, null) as folded, link, doc_id, leaf, subroot from climb"""


def climbed(spark: SparkSession, placed: DataFrame, nodes: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, proof, folded`` of each leaf; ``proof`` has the
    siblings' digests from the leaf to the root, joined."""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        steps = spark.sql(CLIMB.replace("{cell}", str(CELL)), leaves=placed, nodes=nodes)
        links = F.transform(F.array_sort(F.collect_list(F.when(F.col("level") > 0, F.struct("level", "link")))), lambda x: x["link"])
        proof = F.aggregate(links, F.unhex(F.lit("")), lambda t, x: F.concat(t, x))
        only = lambda c: F.max(c).alias(c)
        found = steps.groupBy("rank", "i").agg(only("doc_id"), only("leaf"), only("subroot"), proof.alias("proof"), only("folded"))
        found = found.drop("rank", "i")
        return written(found, path) if path else materialize(found, "merkle-climbed")
    finally:
        spark.conf.set(limit, before)


def prove(docs: DataFrame, tampered: Column) -> DataFrame:
    """One row per document: ``doc_id``, ``leaf``, ``subroot`` and ``root`` of the rows
    as they are, ``proof`` (binary: siblings from the leaf to the root), the
    ``folded_root`` that it gives for the text ``tampered`` in place of the row's own,
    and whether that is the root (``verified``)."""
    spark = docs.sparkSession
    with scratch(spark) as result:
        found = manifest(leaves(docs, tampered))
        if found is None:
            empty = "doc_id long, leaf string, subroot string, root string, proof binary, folded_root string, verified boolean"
            return spark.createDataFrame([], empty)
        placed, nodes, root = found
        rows = climbed(spark, placed, nodes, result)
    text = lambda c: F.lower(F.hex(c))
    rows = rows.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), F.lit(root).alias("root"), "proof", text("folded").alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; those whose id has an even crc32 are shown
    without their line ends."""
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    shown = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = prove(spark.read.parquet(f"{sf_dir}/documents.parquet"), shown)
    proof = F.sha2(F.lower(F.hex("proof")).cast("binary"), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


#: crc32 of a text, bit by bit over its bytes.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({0}, ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, s: case when s >= 0 then xor(a, s) when a % 2 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end), 4294967295::bigint)"""


def _leaf_sql(text: str) -> str:
    part = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    return "sha256(concat(" + ", ".join(part(v) for v in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + "))"


ORACLE_SQL = f"""
with recursive d as (select *, coalesce('+' || source, '-') as tree, {_leaf_sql('text')} as leaf,
  {_leaf_sql("case when " + _CRC.format('doc_id::varchar') + " % 2 = 0 then replace(text, chr(10), '') else text end")} as shown from documents),
lf as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as n from d),
up(tree, l, i, h, n) as (select tree, 0, i, leaf, n from lf
  union all select tree, l + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value((n + 2) // 3) from up where n > 1 group by tree, l, i // 3),
subs as (select tree, l as depth, h, row_number() over (order by tree = '-' desc, encode(tree)) - 1 as i, count(*) over () as n from up where n = 1),
tu(l, i, h, n) as (select 0, i, h, n from subs
  union all select l + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value((n + 2) // 3) from tu where n > 1 group by l, i // 3),
every as (select tree, l, i, h, n from up where n > 1 union all select '', l, i, h, n from tu where n > 1),
sibs as (select a.tree, a.l, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as lft, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as rgt
  from every a join every b on a.tree = b.tree and a.l = b.l and a.i // 3 = b.i // 3 group by all),
path as (select lf.tree, lf.i, s.l as step, s.lft, s.rgt from lf join sibs s on s.tree = lf.tree and s.i = lf.i // (3 ** s.l)::bigint
  union all select lf.tree, lf.i, 1000 + s.l, s.lft, s.rgt from lf join subs on subs.tree = lf.tree join sibs s on s.tree = '' and s.i = subs.i // (3 ** s.l)::bigint),
ordered as (select *, row_number() over (partition by tree, i order by step) as k from path),
proofs as (select tree, i, sha256(string_agg(lft || rgt, '' order by k)) as p from ordered group by tree, i),
fold(tree, i, k, h) as (select tree, i, 0::bigint, shown from lf union all select f.tree, f.i, o.k, sha256(o.lft || f.h || o.rgt) from fold f join ordered o on o.tree = f.tree and o.i = f.i and o.k = f.k + 1),
folded as (select tree, i, arg_max(h, k) as h from fold group by tree, i),
root as (select h as root from tu where n = 1)
select lf.doc_id, lf.leaf, subs.h as subroot, root, coalesce(p, sha256('')) as proof_sha256, folded.h as folded_root, folded.h = root as verified
from lf join subs using (tree) join folded on folded.tree = lf.tree and folded.i = lf.i left join proofs on proofs.tree = lf.tree and proofs.i = lf.i, root order by all
"""
