"""Merkle manifest of a dataset: a tree over the rows of each group, a tree over the groups, and a proof for every row.

Rows are ranked in their group by running sums over a range-partitioned table, so no task ranks a whole group. The rank's digits to the
base ``fan_out`` are columns; blocks of ``digits`` of them (1,024 rows) are rolled up one digit at a time: each grouping drops the last digit,
nests its children as structs and hashes their digests. All groupings of a block need one shuffle, by block, and end in one row that holds
the block's whole tree. One transform walks down that tree, gathers the siblings of every leaf, and an explode emits the leaves: leaves are
never joined with inner nodes. Blocks are the leaves of the next table of blocks, 1,024 times smaller; there a row per block meets its own
upper siblings before it is exploded. Columns carry digests only; texts are read once, to hash them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.operators.ranking import running_sum
from peerscope.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a proof: digests of the run's nodes before and after the own one, put together.
LEVEL = "struct<before:string,after:string>"


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field is ``-`` if null, else its UTF-8 length, a colon and its text."""
    texts = [x.cast("string") for x in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])


def group_key(by: Column) -> Column:
    """A key that is never null and keeps the bytewise order, null first."""
    return F.coalesce(F.concat(F.lit("="), by.cast("string")), F.lit("-"))


def _levels(n: Column, fan_out: int) -> Column:
    """Levels above ``n`` nodes; counted in whole numbers, as logarithms round."""
    found = F.lit(0)
    size, level = 1, 0
    while size < 1 << 62:
        found = F.when(n > size, F.lit(level + 1)).otherwise(found)
        size, level = size * fan_out, level + 1
    return found


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["hash"]), "")


def _blocks(nodes: DataFrame, fan_out: int, digits: int) -> DataFrame:
    """(group, block, levels, hash, tree) with a tree of ``digits`` levels, from (group, rank, levels, hash, row).

    ``levels`` is how many levels the group still has above these nodes; a block stops hashing there, where one node is left.
    """
    places = [F.pmod(F.floor(F.col("rank") / fan_out**k), F.lit(fan_out)).cast("int").alias(f"digit{k}") for k in range(digits)]
    block = F.floor(F.col("rank") / fan_out**digits).cast("long").alias("block")
    rows = nodes.select("group", block, "levels", *places, "hash", "row").repartition("group", "block")
    below = "row"
    for k in range(digits):
        node = F.struct(F.col(f"digit{k}").alias("digit"), "hash", F.col(below).alias("below"))
        keys = ["group", "block", "levels", *[f"digit{j}" for j in range(digits - 1, k, -1)]]
        rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(node)).alias("run"))
        above = F.when(F.col("levels") > k, F.sha2(_joined(F.col("run")), 256)).otherwise(F.col("run")[0]["hash"])
        rows, below = rows.withColumn("hash", above), "run"
    return rows.select("group", "block", "levels", "hash", F.col("run").alias("tree"))


def _leaves(tree: Column, digits: int, levels: Column, upper: Column) -> Column:
    """An array of (row, hash, path) of all leaves; a path lists the levels from the leaf upwards and goes on with ``upper``."""

    def down(run: Column, k: int, path: Column) -> Column:
        def child(node: Column, at: Column) -> Column:
            others = F.struct(_joined(F.slice(run, F.lit(1), at)).alias("before"), _joined(F.slice(run, at + 2, F.size(run))).alias("after"))
            longer = F.concat(F.when(levels > k, F.array(others)).otherwise(F.array().cast(f"array<{LEVEL}>")), path)
            return down(node["below"], k - 1, longer) if k else F.struct(node["below"].alias("row"), node["hash"].alias("hash"), longer.alias("path"))

        found = F.transform(run, child)
        return F.flatten(found) if k else found

    return down(tree, digits - 1, upper)


def _ranked(rows: DataFrame, order: list[str], fan_out: int) -> DataFrame:
    """Add rank (from 0) within the group, and the levels above the group's nodes."""
    ranked = materialize(running_sum(rows.withColumn("one", F.lit(1).cast("long")), ["group"], order, "one", "rank").drop("one"))
    sizes = ranked.groupBy("group").agg(F.max("rank").alias("n"))
    # a group's size meets its rows in pieces of 2^16 ranks, so that no task gets a large group
    pieces = sizes.select("group", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("n", 16))).alias("piece"))
    with_n = ranked.withColumn("piece", F.shiftright("rank", 16)).join(pieces, ["group", "piece"])
    return with_n.withColumn("levels", _levels(F.col("n"), fan_out)).withColumn("rank", F.col("rank") - 1).drop("piece", "n")


def _rolled(nodes: DataFrame, fan_out: int, digits: int) -> list[DataFrame]:
    """Tables of blocks from the leaves up, each 1,024 times smaller; the last one has a block for each group, whose digest is the group's."""
    steps = nodes.agg(F.max("levels")).first()[0] or 0
    found = []
    for _ in range(max(1, -(-steps // digits))):
        found.append(materialize(_blocks(nodes, fan_out, digits)))
        left = F.greatest(F.col("levels") - digits, F.lit(0)).alias("levels")
        nodes = found[-1].select("group", F.col("block").alias("rank"), left, "hash", F.col("block").alias("row"))
    return found


def _unrolled(tables: list[DataFrame], ends: DataFrame, digits: int) -> DataFrame:
    """(row, hash, path, subroot, root) of the leaves below tables of blocks, whose last one starts from (group, upper, root)."""
    paths = ends.join(tables[-1].select("group", "block", F.col("hash").alias("subroot")), "group")
    for table in reversed(tables):
        met = table.drop("hash").join(paths, ["group", "block"])
        leaves = met.select("group", "subroot", "root", F.explode(_leaves(F.col("tree"), digits, F.col("levels"), F.col("upper"))).alias("leaf"))
        paths = leaves.select("group", F.col("leaf.row").alias("block"), F.col("leaf.hash").alias("hash"), F.col("leaf.path").alias("upper"), "subroot", "root")
    return paths.select("group", F.col("block").alias("row"), "hash", F.col("upper").alias("path"), "subroot", "root")


def manifest(rows: DataFrame, fan_out: int = 2, digits: int = 10) -> DataFrame:
    """(by, key, hash, others, path, subroot, root) of rows with a group ``by``, an order ``key`` in it and a digest ``hash``.

    Nodes of a group ascend by key (null first; ties by digest). While a level has several nodes, each ``fan_out`` consecutive ones become the
    digest of theirs put together, the last run even with one node; what remains is the subroot, and a lone row is its group's
    subroot. Subroots, in the order of their groups (null first, bytewise), give the root in the same way. ``path`` lists, from the
    row up to the root, the digests before and after the own one in each run. Rows that repeat are leaves of their own.
    An empty table gives no rows; other columns are handed through, whatever their names.
    """
    others = [c for c in rows.columns if c not in ("by", "key", "hash")]
    row = F.struct("by", "key", F.monotonically_increasing_id().alias("place"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"))
    nodes = materialize(rows.select(group_key(F.col("by")).alias("group"), "key", "hash", row.alias("row")))
    nodes = _ranked(nodes.withColumn("place", F.col("row.place")), ["key", "hash", "place"], fan_out)
    tables = _rolled(nodes, fan_out, digits)
    subroots = tables[-1].select(F.lit("").alias("group"), F.col("group").alias("row"), "hash")
    tops = _rolled(_ranked(subroots, ["row"], fan_out), fan_out, digits)
    root = tops[-1].select("group", F.array().cast(f"array<{LEVEL}>").alias("upper"), F.col("hash").alias("root"))
    ends = _unrolled(tops, root, digits).select(F.col("row").alias("group"), F.col("path").alias("upper"), "root")
    leaves = _unrolled(tables, materialize(ends), digits)
    return leaves.select("row.by", "row.key", "hash", *[F.col(f"row.others.`{c}`") for c in others], "path", "subroot", "root")


def siblings(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def folded(hash: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, hash, lambda found, x: F.sha2(F.concat(x["before"], found, x["after"]), 256))


def document_manifest(docs: DataFrame, tampered: Column | None = None, fan_out: int = 2, digits: int = 10) -> DataFrame:
    """One row per document: doc_id, leaf, path, subroot, root, folded_root, verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text; groups are langs, in which leaves ascend by doc_id. Where ``tampered`` (a
    condition on the documents) holds, n_chars is taken as one more when the root is folded from the leaf and its siblings; null n_chars
    stay. ``verified`` says that the folded root is the root. Nulls, repeated rows and empty tables are as in ``manifest``;
    columns besides these five are ignored.
    """
    fields = {c: F.col(c) for c in FIELDS}
    own = leaf(*fields.values())
    changed = leaf(*{**fields, "n_chars": F.col("n_chars") + 1}.values())
    now = F.when(F.lit(False) if tampered is None else tampered, changed)
    rows = docs.select(F.col("lang").alias("by"), F.col("doc_id").alias("key"), own.alias("hash"), now.alias("now"))
    found = manifest(rows, fan_out, digits).withColumn("folded_root", folded(F.coalesce("now", "hash"), F.col("path")))
    return found.select(F.col("key").alias("doc_id"), F.col("hash").alias("leaf"), "path", "subroot", "root", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
