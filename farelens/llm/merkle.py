"""Merkle manifest of a table: a hash tree per group of rows, and one over the groups.

Nodes carry the interval ``[lo, hi)`` of leaf ranks that they cover in their tree (nested-interval
labels), so no node stores a pointer. Runs of ``FANOUT`` nodes become their parent; the parent of a
node at level ``l`` is the node at level ``l + 1`` whose interval contains it, found by an equi-join on
(tree, level, bucket of the interval) plus containment, and its siblings are what is left of the
parent's interval without its own.

Scale: ranks come from one range sort, so a group that holds a third of all rows is many tasks.
Levels are built ``SPAN`` at a time from bounded blocks of ``FANOUT ** SPAN`` nodes; ancestors are
attached the same way downwards, so no join key has more than a block of rows on either side. The
leaf blocks meet the path of their block root in one shuffle of narrow rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farelens.llm.ranks import groups, ranked, sorted_runs
from farelens.llm.scratch import write_once

SPAN = 6
FANOUT = 3


def _value(col: str) -> F.Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = F.col(f"`{col}`").cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[str], changed: dict[str, F.Column] | None = None) -> F.Column:
    """Hex SHA-256 of the concatenated ``columns``; ``changed`` puts other text in place of some."""
    parts = []
    for c in columns:
        if changed and c in changed:
            text = changed[c].cast("string")
            parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
        else:
            parts.append(_value(c))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height_of(n: int, fanout: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves (0 for a lone leaf)."""
    h, width = 0, 1
    while width < n:
        h, width = h + 1, width * fanout
    return h


class Block:
    """The subtree over consecutive nodes of one level: intervals and digests of every level."""

    def __init__(self, lo: list[int], hi: list[int], digests: list[str], width: int, levels: int, fanout: int):
        self.levels = [(lo, hi, digests)]
        for _ in range(levels):
            width *= fanout
            lo, hi, digests = self.levels[-1]
            up: tuple[list[int], list[int], list[str]] = ([], [], [])
            a = 0
            while a < len(lo):
                end, b = (lo[a] // width + 1) * width, a
                while b < len(lo) and hi[b] <= end:       # children: nodes inside the parent's interval
                    b += 1
                up[0].append(lo[a])
                up[1].append(hi[b - 1])
                up[2].append(_hash(digests[a:b]))
                a = b
            self.levels.append(up)

    def paths(self) -> list[list[tuple[list[str], list[str]]]]:
        """Per node of the lowest level: (left siblings, right siblings) on each level up to the block root."""
        below: list[list] = [[] for _ in self.levels[-1][0]]
        for (lo, hi, digests), (p_lo, p_hi, _) in zip(self.levels[-2::-1], self.levels[:0:-1]):
            out, p = [], 0
            first = 0
            for i, (x, y) in enumerate(zip(lo, hi)):
                while not (p_lo[p] <= x and y <= p_hi[p]):
                    p, first = p + 1, i
                last = first
                while last < len(lo) and hi[last] <= p_hi[p]:
                    last += 1
                out.append([(digests[first:i], digests[i + 1:last]), *below[p]])
            below = out
        return below


def _pack(path) -> str:
    """One text per path: per level the number of left and of right siblings, then their digests."""
    return "".join(f"{len(a):04x}{len(b):04x}{''.join(a)}{''.join(b)}" for a, b in path)


def _unpack(path: str):
    at = 0
    while at < len(path):
        a, b = int(path[at:at + 4], 16), int(path[at + 4:at + 8], 16)
        at += 8
        found = [path[at + 64 * i:at + 64 * (i + 1)] for i in range(a + b)]
        at += 64 * (a + b)
        yield found[:a], found[a:]


_NODE = "tree string, tree_size long, level int, lo long, hi long, digest string"


def build_nodes(items: DataFrame, fanout: int = FANOUT, span: int = SPAN) -> list[DataFrame]:
    """Node tables of a forest, one per ``span`` levels: ``tree, tree_size, level, lo, hi, digest``.

    ``items`` holds the leaves: ``tree``, ``rank``, ``group_size`` and ``digest``. The tables hold levels 1
    to ``span``, then the next ``span`` and so on; leaves themselves are not listed.
    """
    schema = pa.schema([("tree", pa.string()), ("tree_size", pa.int64()), ("level", pa.int32()), ("lo", pa.int64()),
                        ("hi", pa.int64()), ("digest", pa.string())])

    def build(base: int):
        width = fanout ** base

        def run(batches):
            for t in groups(batches, 2):
                tree, size = t["tree"][0].as_py(), t["tree_size"][0].as_py()
                block = Block(t["lo"].to_pylist(), t["hi"].to_pylist(), t["digest"].to_pylist(), width,
                              min(span, height_of(size, fanout) - base), fanout)
                for up, (lo, hi, digests) in enumerate(block.levels[1:], 1):
                    n = len(lo)
                    yield pa.record_batch([pa.array([tree] * n, pa.string()), pa.array([size] * n, pa.int64()),
                                           pa.array([base + up] * n, pa.int32()), pa.array(lo, pa.int64()),
                                           pa.array(hi, pa.int64()), pa.array(digests, pa.string())], schema=schema)
        return run

    def round_of(nodes: DataFrame, base: int) -> DataFrame:
        block = F.expr(f"lo div {fanout ** (base + span)}")
        rows = nodes.where(F.col("tree_size") > fanout ** base).select("tree", block.alias("block"), "tree_size", "lo", "hi", "digest")
        return write_once(sorted_runs(rows, ["tree", "block"], ["lo"]).mapInArrow(build(base), _NODE), "merkle-nodes")

    largest = items.agg(F.max("group_size")).first()[0] or 0
    nodes = items.select("tree", F.col("group_size").alias("tree_size"), F.col("rank").alias("lo"),
                         (F.col("rank") + 1).alias("hi"), "digest")
    out, base = [], 0
    while fanout ** base < largest:
        out.append(round_of(nodes, base))
        base += span
        nodes = out[-1].where(F.col("level") == base)
    return out


def roots(items: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``tree, tree_size, root`` of every tree (a lone leaf is its own root)."""
    out = items.where("group_size = 1").select("tree", F.col("group_size").alias("tree_size"), F.col("digest").alias("root"))
    for t in tables:
        out = out.unionByName(t.where("lo = 0 and hi = tree_size").select("tree", "tree_size", F.col("digest").alias("root")))
    return out


def _climb(nodes: DataFrame, table: DataFrame, base: int, upper: DataFrame, carried: list[str], fanout: int, span: int) -> DataFrame:
    """Paths of the nodes at level ``base`` (``tree, lo, hi, ...``): siblings found in ``table``, then the path of ``upper``.

    Ancestors are attached by level-bucketed containment joins; siblings are the children of an
    ancestor that lie outside the node's own interval.
    """
    child = nodes.select("tree", F.lit(base).alias("level"), "lo", "hi", "digest").unionByName(
        table.where(F.col("level") < base + span).select("tree", "level", "lo", "hi", "digest"))
    bucket = "lo div cast(power({f}, level) as bigint)".format(f=fanout)
    families = child.withColumn("level", F.col("level") + 1).withColumn("bucket", F.expr(bucket)).groupBy("tree", "level", "bucket").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
    parents = table.withColumn("bucket", F.expr(bucket)).select("tree", "level", "bucket", F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"))
    families = parents.join(families, ["tree", "level", "bucket"])
    asked = nodes.select("tree", "lo", "hi", F.explode(F.sequence(F.lit(base + 1), F.lit(base + span))).alias("level"))
    met = asked.withColumn("bucket", F.expr(bucket)).join(families, ["tree", "level", "bucket"]).where("p_lo <= lo and hi <= p_hi")
    left = F.filter("children", lambda c: c["hi"] <= F.col("lo"))
    right = F.filter("children", lambda c: c["lo"] >= F.col("hi"))
    step = F.concat(F.lpad(F.lower(F.hex(F.size(left))), 4, "0"), F.lpad(F.lower(F.hex(F.size(right))), 4, "0"),
                    F.array_join(F.transform(F.concat(left, right), lambda c: c["digest"]), ""))
    own = met.groupBy("tree", "lo", "hi").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", step.alias("step")))),
                                                                        lambda s: s["step"]), "").alias("own"))
    block = F.expr(f"lo div {fanout ** (base + span)}")
    joined = own.withColumn("block", block).join(upper.withColumn("block", block).select(
        "tree", "block", F.col("lo").alias("u_lo"), F.col("hi").alias("u_hi"), "path", *carried), ["tree", "block"])
    return joined.where("u_lo <= lo and hi <= u_hi").select("tree", "lo", "hi", F.concat("own", "path").alias("path"), *carried)


def block_paths(tables: list[DataFrame], tops: DataFrame, carried: list[str], fanout: int = FANOUT, span: int = SPAN) -> DataFrame:
    """``tree, block, path`` and the ``carried`` columns for every block of leaves.

    ``tops`` has one row per tree: ``tree``, ``tree_size``, the ``path`` above its root, and the carried columns.
    """
    found = None
    for j in range(len(tables) - 1, -1, -1):
        base = span * (j + 1)
        # trees that end in this span start with the path above their root
        ending = tops.where((F.col("tree_size") > (fanout ** (span * j) if j else 0)) & (F.col("tree_size") <= fanout ** base)).select(
            "tree", F.lit(0).cast("long").alias("lo"), F.col("tree_size").alias("hi"), "path", *carried)
        if found is not None:
            higher = _climb(tables[j].where((F.col("level") == base) & (F.col("tree_size") > fanout ** base)),
                            tables[j + 1], base, found, carried, fanout, span)
            ending = write_once(ending.unionByName(higher), "merkle-paths")
        found = ending
    if found is None:
        found = tops.select("tree", F.lit(0).cast("long").alias("lo"), F.col("tree_size").alias("hi"), "path", *carried)
    return found.withColumn("block", F.expr(f"lo div {fanout ** span}"))


def with_paths(items: DataFrame, paths: DataFrame, emit, schema: str, own: tuple[str, ...] = (),
               carried: tuple[str, ...] = (), fanout: int = FANOUT, span: int = SPAN) -> DataFrame:
    """Leaves with their whole path: ``emit(leaves, paths, path row)`` makes the rows of one block.

    The leaves of a block and the one path row of its block root meet in one sorted run (``FANOUT ** SPAN``
    leaves at most), so the upper path travels once a block and not once a leaf.
    """
    block = F.expr(f"rank div {fanout ** span}")
    leaves = items.select("tree", block.alias("block"), "rank", F.col("group_size").alias("tree_size"), "digest", *own)
    ways = paths.select("tree", "block", F.lit(-1).cast("long").alias("rank"), "path", *carried)

    def run(batches):
        for t in groups(batches, 2):
            head, rows = {c: t[c][0].as_py() for c in ("path", *carried)}, t.slice(1)
            lo = rows["rank"].to_pylist()
            levels = min(span, height_of(rows["tree_size"][0].as_py(), fanout))
            block = Block(lo, [x + 1 for x in lo], rows["digest"].to_pylist(), 1, levels, fanout)
            yield emit(rows, block.paths(), head)

    return sorted_runs(ways.unionByName(leaves, allowMissingColumns=True), ["tree", "block"], ["rank"]).mapInArrow(run, schema)


def _leaf_path(rows: pa.Table, own_paths, head: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(rows["tree"].to_pylist(), pa.string()), pa.array(rows["rank"].to_pylist(), pa.int64()),
                            pa.array([_pack(p) + head["path"] for p in own_paths], pa.string())], ["tree", "rank", "path"])


def _prove(rows: pa.Table, own_paths, head: dict) -> pa.RecordBatch:
    upper = list(_unpack(head["path"]))
    proofs, folded = [], []
    for start, path in zip(rows["presented"].to_pylist(), own_paths):
        steps = [*path, *upper]
        proofs.append(_hash([d for left, right in steps for d in (*left, *right)]))
        node = start
        for left, right in steps:
            node = _hash([*left, node, *right])
        folded.append(node)
    n = len(proofs)
    return pa.record_batch([pa.array(rows["id"].to_pylist(), pa.int64()), pa.array(rows["digest"].to_pylist(), pa.string()),
                            pa.array([head["subroot"]] * n, pa.string()), pa.array([head["root"]] * n, pa.string()),
                            pa.array(proofs, pa.string()), pa.array(folded, pa.string()),
                            pa.array([f == head["root"] for f in folded], pa.bool_())],
                           ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _forest(docs: DataFrame, id_col: str, group_col: str, leaf: F.Column, presented: F.Column, fanout: int, span: int):
    """(ranked leaves, node tables, subroots, ranked subroots, their node tables)."""
    # 's' before the name keeps the bytewise order and leaves the empty text for null, which comes first
    tree = F.coalesce(F.concat(F.lit("s"), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    slim = write_once(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), tree.alias("tree"), leaf.alias("digest"),
                                  presented.alias("presented")), "merkle-leaves")
    items = write_once(ranked(slim, "tree", ["id", "digest", "presented"]), "merkle-items")
    tables = build_nodes(items, fanout, span)
    subroots = write_once(roots(items, tables), "merkle-subroots")
    tops = write_once(ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")),
                             "tree", ["name"]), "merkle-tops")
    return items, tables, subroots, tops, build_nodes(tops, fanout, span)


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: list[str] | None = None,
                    fanout: int = FANOUT, span: int = SPAN) -> DataFrame:
    """The nodes of the manifest: ``tree`` ('s' + group, '' for the null group), ``level`` (0: leaves), ``lo``, ``hi``,
    ``digest``; the tree over the subroots has ``tree`` null and ranks of groups in place of ranks of leaves.

    Leaves hash ``columns`` (all by default) as ``leaf_digest`` says. Defined cases are those of ``merkle_report``.
    """
    digest = leaf_digest(columns or docs.columns)
    items, tables, _, tops, top_tables = _forest(docs, id_col, group_col, digest, digest, fanout, span)
    cols = ["tree", "level", "lo", "hi", "digest"]

    def listed(leaves, levels, tree):
        out = leaves.select(tree.alias("tree"), F.lit(0).alias("level"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")
        for t in levels:
            out = out.unionByName(t.select(tree.alias("tree"), *cols[1:]))
        return out

    return listed(items, tables, F.col("tree")).unionByName(listed(tops, top_tables, F.lit(None).cast("string")))


def merkle_report(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: list[str] | None = None,
                  tampered: dict[str, F.Column] | None = None, where: F.Column | None = None,
                  fanout: int = FANOUT, span: int = SPAN) -> DataFrame:
    """Per row: ``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    Leaves of a group ascend by id; groups by their name's bytes, null first. The proof holds the
    siblings of each level, left to right, from the leaf over its subroot to the root, and
    ``proof_sha256`` is the hash over them (of nothing, where there are none). ``folded_root`` is
    recomputed from the leaf as presented: for rows that meet ``where``, from the row with the
    columns of ``tampered`` put in place; ``verified`` tells whether it equals the root.

    Defined cases: nulls in any column hash as ``-``; a null id comes first in its group and a null
    group first of all; empty and very long texts hash whole; rows that repeat an id are ordered by
    their leaf, equal rows are interchangeable leaves of their own; a lone leaf is its subroot, a
    lone subroot the root; an empty table gives an empty result; columns not named are not read.
    """
    columns = columns or docs.columns
    digest = leaf_digest(columns)
    presented = digest if not tampered else F.when(where, leaf_digest(columns, tampered)).otherwise(digest)
    items, tables, subroots, tops, top_tables = _forest(docs, id_col, group_col, digest, presented, fanout, span)
    root = (roots(tops, top_tables).select("root").first() or [None])[0]       # one row: the root of all
    above = with_paths(tops, block_paths(top_tables, tops.select("tree", F.col("group_size").alias("tree_size"),
                                                                 F.lit("").alias("path")).distinct(), [], fanout, span),
                       _leaf_path, "tree string, rank long, path string", fanout=fanout, span=span)
    named = tops.select(F.col("name").alias("of"), "rank").join(above.select("rank", "path"), "rank")
    ways = write_once(subroots.select("tree", "tree_size", F.col("root").alias("subroot")).join(
        named.select(F.col("of").alias("tree"), "path"), "tree").withColumn("root", F.lit(root).cast("string")), "merkle-tree-paths")
    paths = block_paths(tables, ways, ["subroot", "root"], fanout, span)
    return with_paths(items, paths, _prove, "id long, leaf string, subroot string, root string, proof_sha256 string, "
                      "folded_root string, verified boolean", ("id", "presented"), ("subroot", "root"), fanout, span)
