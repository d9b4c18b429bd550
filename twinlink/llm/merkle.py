"""Merkle manifest of a dataset: leaves, group roots, the dataset's root and every row's proof.

A row's leaf is the hash of its fields, each ``-`` if null, else its UTF-8 length, ``:`` and
its value.  Within a group the leaves stand in key order and every ``FANOUT`` consecutive
nodes (the last run has fewer) become the hash of their hashes, until one is left, the
group's root; the group roots, in order of their group, become the dataset's root alike.

1. Leaves are written as a narrow table and sorted by (group, key); a row's rank is its
   place in its partition plus the rows of its group in the partitions before, which a
   table of one row per partition and group tells.
2. ``DIGITS`` base-16 digits of the rank are grouped away one after the other within blocks
   of ``FANOUT ** DIGITS`` rows: each grouping nests the child structs in the array of their
   parent.  One shuffle by block serves all groupings of a layer; a block is bounded however
   large its group is, and the roots of the blocks are the nodes of the next layer.
3. Downwards, a block meets its own path in a union that is grouped by block (two rows a
   group); transforms give each child its siblings, explodes emit the children.  No joins.

Everything is DataFrame functions.  Hashes are lower-case hex text.

Edge cases: null keys come first, equal keys in order of their leaf (equal rows have equal
proofs only if they share a run, each row keeps its own place); a null group is a group of
its own, before all others; an empty text counts as ``0:``; a group of one row has its leaf
as root; an empty table gives no rows; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import small, written

BITS = 4
FANOUT = 1 << BITS
DIGITS = 3


def encoded(column: Column) -> Column:
    """A field of a leaf: ``-`` for null, else byte count, ``:`` and value."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def _nodes_at(level: int) -> Column:
    """Nodes of a group of ``n`` leaves after ``level`` rounds."""
    return F.shiftright(F.col("n") + F.lit((1 << (BITS * level)) - 1), BITS * level)


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` (column g is the group; a written table) with idx, the rank in the group, and n, the group's size."""
    # The row number breaks ties, so that a large group of equal rows can be cut between partitions.
    placed = written(rows.withColumn("tie", F.monotonically_increasing_id()).orderBy("g", *order, "tie").drop("tie")
                     .withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.shiftright("pos", 33)),
                     f"{name}-placed")
    runs = placed.groupBy("g", "part").agg(F.min("pos").alias("start"), F.count("*").alias("c"))
    group = Window.partitionBy("g")
    before = F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = written(runs.select(F.col("g").alias("run_g"), F.col("part").alias("run_part"),
                               (F.coalesce(before, F.lit(0)) - F.col("start")).alias("shift"),
                               F.sum("c").over(group).alias("n")), f"{name}-runs")
    same = placed["g"].eqNullSafe(F.col("run_g")) & (placed["part"] == F.col("run_part"))
    return (placed.join(small(runs), same).withColumn("idx", F.col("pos") + F.col("shift"))
            .drop("pos", "part", "shift", "run_g", "run_part"))


def rollup(nodes: DataFrame, level: int) -> DataFrame:
    """Blocks of ``FANOUT ** DIGITS`` nodes (g, n, idx, h, own) as g, n, idx, h and kids, ``DIGITS`` arrays deep."""
    digit = [F.shiftright("idx", BITS * k).bitwiseAND(FANOUT - 1).cast("int").alias(f"d{k}") for k in range(DIGITS)]
    rows = nodes.select("g", "n", F.shiftright("idx", BITS * DIGITS).alias("block"), *digit, "h", F.col("own").alias("kids"))
    rows = rows.repartition("g", "block")
    for k in range(DIGITS):
        child = F.struct(F.col(f"d{k}").alias("digit"), "h", "kids")
        rows = rows.groupBy("g", "n", "block", *[f"d{j}" for j in range(k + 1, DIGITS)]).agg(
            F.sort_array(F.collect_list(child)).alias("kids"))
        hashes = F.col("kids")["h"]
        rows = rows.withColumn("h", F.when(_nodes_at(level + k) > 1, F.sha2(F.concat_ws("", hashes), 256)).otherwise(hashes[0]))
    return rows.withColumnRenamed("block", "idx")


def descend(blocks: DataFrame, level: int) -> DataFrame:
    """The nodes in ``blocks`` (g, n, idx, kids, path and others): idx and path become the node's own, kids its ``own``."""
    others = [c for c in blocks.columns if c not in ("idx", "h", "kids", "path")]
    rows = blocks
    for k in reversed(range(DIGITS)):
        many = _nodes_at(level + k) > 1

        def step(child, at):
            beside = F.struct(F.array_join(F.slice(F.col("kids")["h"], 1, at), "").alias("left"),
                              F.array_join(F.slice(F.col("kids")["h"], at + 2, FANOUT), "").alias("right"))
            return F.struct((F.col("idx") * FANOUT + child["digit"]).alias("idx"), child["h"].alias("h"),
                            child["kids"].alias("kids"),
                            F.when(many, F.concat(F.array(beside), F.col("path"))).otherwise(F.col("path")).alias("path"))
        rows = rows.select(*others, F.inline(F.transform("kids", step)))
    return rows.withColumnRenamed("kids", "own")


def _tree(rows: DataFrame, order: Sequence[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """The layers of blocks above ``rows`` (g, h, own and the columns of ``order``), and the roots (g, h)."""
    nodes = ranked(rows, order, name)
    most = nodes.agg(F.max("n")).first()[0] or 1
    layers = []
    while not layers or FANOUT ** (DIGITS * len(layers)) < most:
        layers.append(written(rollup(nodes, DIGITS * len(layers)), f"{name}-blocks"))
        nodes = layers[-1].select("g", "n", "idx", "h", F.lit(None).cast("boolean").alias("own"))
    return layers, layers[-1].select("g", "h")


def _meet(paths: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block with its path: the two rows of a (g, idx) are grouped."""
    both = paths.unionByName(blocks.drop("h"), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("g", "idx")]
    return both.groupBy("g", "idx").agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest])


def _paths(layers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """All rows under ``tops`` (g, path and what is to be handed down), with their paths."""
    rows = tops.withColumn("idx", F.lit(0).cast("long"))
    for k in reversed(range(len(layers))):
        rows = descend(_meet(rows, layers[k]), DIGITS * k)
        if k:
            rows = rows.drop("n", "h", "own")
    return rows


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source",
             fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), carry: dict[str, Column] | None = None) -> DataFrame:
    """``key, group, leaf, subroot, root, path`` of every row, and ``carry`` (name to a narrow column of ``docs``).

    ``path`` holds the row's siblings from its leaf to the root: (left, right) of each round,
    the hashes of the run's other nodes concatenated."""
    carry = carry or {}
    leaves = written(docs.select(docs[group].alias("g"), docs[key].alias("key"), leaf_of(*[docs[c] for c in fields]).alias("h"),
                                 F.struct(F.lit(0).alias("none"), *[c.alias(k) for k, c in carry.items()]).alias("rest")), "merkle-leaves")
    rows = leaves.select("g", "key", "h", F.struct("key", "rest").alias("own"))
    layers, tops = _tree(rows, ["key", "h"], "merkle")
    # The group roots are the leaves of a second tree, of one group.
    groups = written(tops.select(F.lit(0).alias("g"), F.col("g").alias("key"), "h", F.struct(F.col("g").alias("key")).alias("own")),
                     "merkle-groups")
    above, root = _tree(groups, ["key"], "merkle-top")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    down = _paths(above, root.select("g", F.col("h").alias("root"), nothing.alias("path")))
    down = down.select(F.col("own")["key"].alias("g"), "root", F.col("h").alias("subroot"), "path")
    out = _paths(layers, down)
    return out.select(F.col("own")["key"].alias(key), *([F.col("g").alias(group)] if group != key else []),
                      F.col("h").alias("leaf"), "subroot", "root", "path",
                      *[F.col("own")["rest"][k].alias(k) for k in carry])


def proof_text(path: Column) -> Column:
    """All siblings of a path, left to right, level by level."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def report(docs: DataFrame, tamper: int = 5) -> DataFrame:
    """Digests of each row's proof, and whether a row that may have been tampered with still folds to the root.

    Tampered: rows whose crc32 of the key's decimal text ``tamper`` divides get A-Z of their text lower-cased."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % tamper == 0
    other = F.when(hit, leaf_of(docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], lowered))
    rows = manifest(docs, carry={"other": other})
    rows = rows.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
