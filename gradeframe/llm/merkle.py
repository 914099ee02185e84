"""A Merkle manifest of a table: a digest per row, a tree of digests per language, and a root over all languages.

Rows of a language ascend by doc_id, null first; equal ids by their digests. Every 8 nodes in a row become one, until one
is left; the languages' roots are the leaves of the tree above, null first, then by their bytes. A node is the SHA-256 of
its children's digests as hex text.

Rows are sorted by ranges of (language, doc_id, digest), so that neither a language nor an id nor copies of a row are one
task's; what is sorted are digests, not texts. A tree is worked on in aligned blocks of `BLOCK` leaves: a block's task
builds its nodes and gives its root to the next round, so that a round has one row for `BLOCK` of the one before. The
way from a block to the root, as the texts left and right of it on each level, comes back down the same rounds.

Trees are persistent: a changed leaf makes a version that shares all nodes but its ancestors. Inside its block the
ancestors are copied from the block's nodes; above it the version goes on along the block's way to the root. Versions
are independent, so that blocks make theirs side by side, and none needs another block's nodes.

Null values are marked as such and differ from empty ones. Repeated rows are leaves each. Null doc_ids are never tampered
with. Extra columns are left out. A table without rows has no leaf and no root. A text of any length is one digest.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeframe.llm.rows import prepared, written

FAN = 8
#: Levels of a block, and its leaves.
LEVELS = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WAY = "array<struct<left:string,right:string>>"


def row_digest(columns: Sequence[str | Column] = COLUMNS) -> Column:
    """Binary SHA-256 over the columns: `-` for null, else the bytes' count, `:` and the value."""
    parts = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered_digest() -> Column:
    """The digest of a row whose text has lost its capitals A-Z, where 3 divides the CRC-32 of doc_id; else null."""
    text = F.translate("text", _UPPER, _LOWER)
    changed = row_digest([*COLUMNS[:-1], text])
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changed)


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(tree, doc_id, digest, changed), written. tree: `=` and the language, or `-` where it is null."""
    prepared(docs.sparkSession)
    tree = F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), "lang"))
    other = F.lit(None).cast("binary") if changed is None else changed
    return written(docs.select(tree.alias("tree"), "doc_id", row_digest().alias("digest"), other.alias("changed")), "leaves")


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with `pos`, dense from 0 along the order within each tree, and `n`, the tree's rows; written.

    Rows that agree in the whole order are spread over ranges by their number in the scan, which leaves their order open.
    """
    spread = rows.withColumn("_spread", F.monotonically_increasing_id())
    ranges = spread.repartitionByRange("tree", *order, "_spread").sortWithinPartitions("tree", *order)
    ranges = written(ranges.drop("_spread").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).alias("_part")
    runs = ranges.groupBy("tree", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    runs = runs.select(
        "tree",
        "_part",
        (F.sum("_n").over(tree.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"),
        F.sum("_n").over(tree).alias("n"),
    )
    joined = ranges.withColumn("_part", part).join(runs, ["tree", "_part"])
    return written(joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n"), "placed")


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


class Block:
    """The nodes of one aligned block, as hex text, level by level from its leaves."""

    def __init__(self, leaves: list[str], levels: int):
        self.nodes = [leaves]
        for _ in range(levels):
            below = self.nodes[-1]
            self.nodes.append([hashed("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
        # the runs' texts, from which a node's siblings are cut
        self.runs = [["".join(x[i : i + FAN]) for i in range(0, len(x), FAN)] for x in self.nodes[:-1]]

    def way(self, at: int) -> list[tuple[str, str]]:
        """What stands left and right of a leaf and of each of its ancestors in the block."""
        out = []
        for runs in self.runs:
            text, within = runs[at // FAN], 64 * (at % FAN)
            out.append((text[:within], text[within + 64 :]))
            at //= FAN
        return out


def copied(way: list[tuple[str, str]], digest: str) -> list[str]:
    """A version's own nodes: the changed one and its ancestors' copies; all others are shared with the tree."""
    out = [digest]
    for left, right in way:
        out.append(hashed(left + out[-1] + right))
    return out


def _levels(n: int, round_: int) -> int:
    return max(0, min(LEVELS, height(n) - LEVELS * round_))


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by("pos")


def _block(rows: pa.Table, round_: int) -> Block:
    return Block([d.hex() for d in rows.column("digest").to_pylist()], _levels(rows.column("n")[0].as_py(), round_))


def _raise_block(round_: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        root = _block(rows, round_).nodes[-1]
        pos = rows.column("pos")[0].as_py() // FAN**LEVELS
        return pa.table(
            {
                "tree": pa.array([rows.column("tree")[0].as_py()], pa.string()),
                "pos": pa.array([pos], pa.int64()),
                "n": pa.array([rows.column("n")[0].as_py()], pa.int64()),
                "digest": pa.array([bytes.fromhex(root[0])], pa.binary()),
            }
        )

    return run


def raised(rows: DataFrame) -> list[DataFrame]:
    """The trees' blocks round by round: the given leaves, their blocks' roots, and so on up to one row per tree."""
    rounds = [rows.select("tree", "pos", "n", "digest")]
    most = rows.agg(F.max("n")).first()[0] or 0
    while len(rounds) == 1 or FAN ** (LEVELS * (len(rounds) - 1)) < most:
        # trees that have come down to one row go through unchanged: they have no level left
        by = F.shiftright("pos", 3 * LEVELS).alias("block")
        up = rounds[-1].groupBy("tree", by).applyInArrow(_raise_block(len(rounds) - 1), "tree string, pos long, n long, digest binary")
        rounds.append(written(up, "blocks"))
    return rounds


def _ways_down(round_: int):
    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        block = _block(rows, round_)
        rest = [(x["left"], x["right"]) for x in above.column("way")[0].as_py()]
        first = rows.column("pos")[0].as_py()
        ways = [block.way(p - first) + rest for p in rows.column("pos").to_pylist()]
        listed = [[{"left": a, "right": b} for a, b in way] for way in ways]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        size = len(rows)
        return pa.table(
            {
                "tree": rows.column("tree"),
                "pos": rows.column("pos"),
                "way": pa.array(listed, kind),
                "subroot": pa.array([above.column("subroot")[0].as_py()] * size, pa.string()),
                "root": pa.array([above.column("root")[0].as_py()] * size, pa.string()),
            }
        )

    return run


def ways(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, pos, way, subroot, root) of the leaves' blocks, i.e. of the rows of rounds[1]; tops: the same per tree."""
    for round_ in range(len(rounds) - 2, 0, -1):
        below = rounds[round_].groupBy("tree", F.shiftright("pos", 3 * LEVELS).alias("block"))
        tops = written(
            below.cogroup(tops.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(
                _ways_down(round_), f"tree string, pos long, way {_WAY}, subroot string, root string"
            ),
            "ways",
        )
    return tops


def _no_way(rows: DataFrame) -> DataFrame:
    """One row per tree, each a root of its own."""
    hexed = F.lower(F.hex("digest"))
    return rows.select("tree", "pos", F.array().cast(_WAY).alias("way"), hexed.alias("subroot"), hexed.alias("root"))


class Manifest:
    """The rounds of all trees of a table and the way of each block to the root."""

    def __init__(self, docs: DataFrame, changed: Column | None = None):
        self.rows = placed(leaves(docs, changed), ["doc_id", "digest"])
        self.rounds = raised(self.rows)
        # the languages' roots are the leaves of one more tree
        roots = self.rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest")
        top = placed(roots, ["lang"])
        self.top_rounds = raised(top)
        upper = ways(self.top_rounds, _no_way(self.top_rounds[-1]))
        schema = f"tree string, pos long, way {_WAY}, subroot string, root string"
        tops = _by_block(top, upper).applyInArrow(_tops, schema)
        self.ways = ways(self.rounds, written(tops, "tops"))

    def _leaves(self, fn, schema: str) -> DataFrame:
        return _by_block(self.rows, self.ways).applyInArrow(fn, schema)

    def proofs(self) -> DataFrame:
        """A row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (digests as hex text)."""
        kind = dict(self.rows.dtypes)["doc_id"]
        names = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return self._leaves(_proofs, f"doc_id {kind}, {names}")

    def versions(self) -> DataFrame:
        """A row per node that a changed leaf's version has of its own: doc_id, level (0: the leaf; levels of the tree of
        languages follow on those of the language's own), tree, pos on that level (of the language's tree), digest."""
        kind = dict(self.rows.dtypes)["doc_id"]
        return self._leaves(_versions, f"doc_id {kind}, tree string, pos long, level int, digest string")


def _by_block(rows: DataFrame, above: DataFrame):
    """Blocks of leaves, each with its own way."""
    below = rows.groupBy("tree", F.shiftright("pos", 3 * LEVELS).alias("block"))
    return below.cogroup(above.groupBy("tree", F.col("pos").alias("block")))


def _tops(rows: pa.Table, above: pa.Table) -> pa.Table:
    """For each language's root, its own way to the root of all."""
    made = _ways_down(0)(rows, above)
    rows = _sorted(rows)
    made = made.set_column(0, "tree", rows.column("lang"))
    made = made.set_column(1, "pos", pa.array([0] * len(rows), pa.int64()))
    return made.set_column(3, "subroot", pa.array([d.hex() for d in rows.column("digest").to_pylist()], pa.string()))


def _with_ways(rows: pa.Table, above: pa.Table):
    """Each leaf's place, digest and changed digest as hex text, and way to the root."""
    block = _block(rows, 0)
    rest = [(x["left"], x["right"]) for x in above.column("way")[0].as_py()]
    changed = [c.hex() if c is not None else None for c in rows.column("changed").to_pylist()]
    first = rows.column("pos")[0].as_py()
    for at, (digest, other) in enumerate(zip(block.nodes[0], changed, strict=True)):
        yield first + at, digest, other, block.way(at) + rest


def _proofs(rows: pa.Table, above: pa.Table) -> pa.Table:
    rows = _sorted(rows)
    root = above.column("root")[0].as_py()
    leaf, proof, folded = [], [], []
    for _, digest, other, way in _with_ways(rows, above):
        leaf.append(digest)
        proof.append(hashed("".join(left + right for left, right in way)))
        # every leaf is folded, a changed one or its own, along the siblings: the root is what is checked, not an input
        folded.append(copied(way, digest if other is None else other)[-1])
    size = len(rows)
    return pa.table(
        {
            "doc_id": rows.column("doc_id"),
            "leaf": pa.array(leaf, pa.string()),
            "subroot": pa.array([above.column("subroot")[0].as_py()] * size, pa.string()),
            "root": pa.array([root] * size, pa.string()),
            "proof_sha256": pa.array(proof, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([f == root for f in folded], pa.bool_()),
        }
    )


def _versions(rows: pa.Table, above: pa.Table) -> pa.Table:
    rows = _sorted(rows)
    ids, places, levels, digests = [], [], [], []
    for i, (pos, _, other, way) in enumerate(_with_ways(rows, above)):
        if other is None:
            continue
        for level, digest in enumerate(copied(way, other)):
            ids.append(i)
            places.append(pos // FAN**level)
            levels.append(level)
            digests.append(digest)
    return pa.table(
        {
            "doc_id": rows.column("doc_id").take(pa.array(ids, pa.int64())),
            "tree": rows.column("tree").take(pa.array(ids, pa.int64())),
            "pos": pa.array(places, pa.int64()),
            "level": pa.array(levels, pa.int32()),
            "digest": pa.array(digests, pa.string()),
        }
    )


def digest(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, with the contract's tampered rows as versions."""
    return Manifest(docs, tampered_digest()).proofs()
