"""A Merkle manifest of a dataset of which every few levels are stored, and proofs that regenerate the levels between."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kondate.llm.common import Scratch, broadcast_if_small

ARITY = 8
#: One of so many levels is stored; the nodes between are made again from the stored ones below them.
STORED_EVERY = 3
SPAN = ARITY**STORED_EVERY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A proof: from the leaf upwards the place in each run, and the digests of the run's other nodes.
PROOF = "array<struct<place:int,others:array<binary>>>"
_PROOF = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.binary()))]))
Step = tuple[int, list[bytes]]


@dataclass
class Manifest:
    """What is stored: of each tree and of the tree of their roots every third level, in aligned subtrees; and the root."""

    strata: list[DataFrame]  # tree, sub, nodes: those of the leaves first
    top: list[DataFrame]
    root: bytes | None


def digest(nodes: list[bytes]) -> bytes:
    """A parent's digest: that of its children's digests as hex text, one behind the other."""
    return hashlib.sha256("".join([x.hex() for x in nodes]).encode()).digest()


def levels(nodes: list[bytes], only: bool) -> list[list[bytes]]:
    """The stored nodes of an aligned subtree and the levels above them up to the next stored one.

    A tree that is one subtree alone (only) ends where one node is left.
    """
    out = [nodes]
    while len(out) <= STORED_EVERY and not (only and len(out[-1]) == 1):
        out.append([digest(out[-1][i : i + ARITY]) for i in range(0, len(out[-1]), ARITY)])
    return out


def regenerated(sub: int, nodes: list[bytes]) -> list[list[bytes]]:
    return levels(nodes, sub == 0 and len(nodes) < SPAN)


def siblings(made: list[list[bytes]], i: int) -> list[Step]:
    """The steps from node i of a subtree to its top."""
    steps = []
    for level in made[:-1]:
        begin, place = i - i % ARITY, i % ARITY
        steps.append((place, level[begin : begin + place] + level[begin + place + 1 : begin + ARITY]))
        i //= ARITY
    return steps


def fold(node: bytes, steps: list[Step]) -> bytes:
    """The root that a node and its siblings give."""
    for place, others in steps:
        node = digest([*others[:place], node, *others[place:]])
    return node


def leaf_digest(values: dict[str, Column]) -> Column:
    """The digest (binary) of fields: '-' for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in values.values()]
    written = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*written).cast("binary"), 256))


def leaf_rows(documents: DataFrame, now: Column | None = None) -> DataFrame:
    """doc_id, tree, h (the leaf) and now (the leaf with this text, where it is another)."""
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    h, tree = leaf_digest(fields), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    later = F.lit(None).cast("binary") if now is None else F.when(now.isNotNull(), leaf_digest(fields | {"text": now}))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), h.alias("h"), later.alias("now"), F.monotonically_increasing_id().alias("tie"))


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """The rows (a written table) with idx, their place in their tree by order.

    Ranges of the order are counted side by side, and a table of counts says what stands before each range; so no tree
    goes through one task, whatever part of the rows it has.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for found in batch.column("tree").to_pylist():
                tree, n = found, (n + 1 if found == tree else 0)
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], [*batch.schema.names, "part", "at"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    ranges = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = scratch.table(ranges.mapInArrow(place, f"{kind}, part int, at long"), f"{name}-placed")
    counts = scratch.table(placed.groupBy("tree", "part").agg(F.count("*").alias("n")), f"{name}-counts")
    size = counts.agg(F.count("*").alias("rows"), F.max(F.octet_length("tree")).alias("longest")).first()
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "part", before.alias("before"))  # as many rows of a tree as there are ranges
    return placed.join(broadcast_if_small(starts, size["rows"], 48 + (size["longest"] or 0)), ["tree", "part"]).withColumn("idx", F.col("at") + F.col("before")).drop("part", "at", "before")


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = [regenerated(sub, nodes)[-1][0] for sub, nodes in zip(batch.column("sub").to_pylist(), batch.column("hs").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("sub"), pa.array(tops, pa.binary())], ["tree", "idx", "h"])


def grow(nodes: DataFrame, scratch: Scratch, name: str, items: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The stored strata of all trees and their roots (tree, h). nodes: tree, idx, h and, at the leaves, items.

    A row has the nodes below one node of the next stored level, at most 512; trees that are done go along as one node.
    """
    strata: list[DataFrame] = []
    while True:
        node = F.array_sort(F.collect_list(F.struct("idx", "h", *([] if strata else items))))
        stored = nodes.groupBy("tree", F.floor(F.col("idx") / SPAN).alias("sub")).agg(node.alias("nodes"))
        strata.append(scratch.table(stored, f"{name}-level-{STORED_EVERY * len(strata)}"))
        nodes = strata[-1].select("tree", "sub", F.transform("nodes", lambda x: x["h"]).alias("hs")).mapInArrow(_climb, "tree string, idx long, h binary")
        if not strata[-1].where("sub > 0").limit(1).count():
            return strata, scratch.table(nodes, f"{name}-roots")


def build_manifest(leaves: DataFrame, scratch: Scratch) -> Manifest:
    """The manifest of leaves (from ``leaf_rows``): a tree for each value of tree, and one over their roots in that order."""
    rows = numbered(scratch.table(leaves, "leaves"), ["doc_id", "h", "tie"], scratch, "leaves")
    strata, roots = grow(rows, scratch, "trees", ["doc_id", "now"])
    over = roots.select(F.lit("").alias("tree"), "h", F.col("tree").alias("of"))
    top, root = grow(numbered(over, ["of"], scratch, "roots"), scratch, "top", ["of"])
    found = root.first()
    return Manifest(strata, top, bytes(found["h"]) if found else None)


def _steps(path: list[dict]) -> list[Step]:
    return [(x["place"], x["others"]) for x in path]


def _written(paths: list[list[Step]]) -> pa.Array:
    return pa.array([[{"place": p, "others": o} for p, o in path] for path in paths], _PROOF)


def _below(stratum: DataFrame, above: DataFrame) -> DataFrame:
    """The subtrees of a stored level with the path from their top upwards."""
    return stratum.join(above.withColumnRenamed("idx", "sub"), ["tree", "sub"])


def _subtrees(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[dict], list[list[bytes]], list[Step]]]:
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        yield row, row["nodes"], regenerated(row["sub"], [x["h"] for x in row["nodes"]]), _steps(row["path"])


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of a stored level's nodes: their siblings, made again, and then the path of the subtree's top."""
    for batch in batches:
        for row, nodes, made, upper in _subtrees(batch):
            paths = [siblings(made, i) + upper for i in range(len(nodes))]
            columns = [pa.array([row["tree"]] * len(nodes), pa.string()), pa.array([x["idx"] for x in nodes], pa.int64()), _written(paths), pa.array([row["subroot"]] * len(nodes), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "idx", "path", "subroot"])


def _down(strata: list[DataFrame], above: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The lowest stored level's subtrees with their paths."""
    for i in range(len(strata) - 1, 0, -1):
        above = scratch.table(_below(strata[i], above).mapInArrow(_descend, f"tree string, idx long, path {PROOF}, subroot binary"), f"{name}-{i}")
    return _below(strata[0], above)


def leaf_subtrees(manifest: Manifest, scratch: Scratch) -> DataFrame:
    """tree, sub, nodes, path, subroot: the subtrees of leaves, with the path from their top to the root."""
    spark = manifest.strata[0].sparkSession

    def of_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, nodes, made, upper in _subtrees(batch):
                columns = [pa.array([x["of"] for x in nodes], pa.string()), pa.array([0] * len(nodes), pa.int64()), _written([siblings(made, i) + upper for i in range(len(nodes))]), pa.array([x["h"] for x in nodes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "idx", "path", "subroot"])

    start = spark.range(1).select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("idx"), F.array().cast(PROOF).alias("path"), F.lit(None).cast("binary").alias("subroot"))
    above = _down(manifest.top, start, scratch, "top-paths").mapInArrow(of_roots, f"tree string, idx long, path {PROOF}, subroot binary")
    return _down(manifest.strata, scratch.table(above, "root-paths"), scratch, "paths")


def extract_proofs(manifest: Manifest, scratch: Scratch) -> DataFrame:
    """doc_id, leaf, subroot, proof (PROOF) of every document: what anyone with the root needs to check it by ``fold``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, nodes, made, upper in _subtrees(batch):
                columns = [pa.array([x["doc_id"] for x in nodes], pa.int64()), pa.array([x["h"] for x in nodes], pa.binary()), pa.array([row["subroot"]] * len(nodes), pa.binary()), _written([siblings(made, i) + upper for i in range(len(nodes))])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "proof"])

    return leaf_subtrees(manifest, scratch).mapInArrow(emit, f"doc_id long, leaf binary, subroot binary, proof {PROOF}")


def audit(manifest: Manifest, scratch: Scratch) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    A document's siblings are made, folded with the leaf that its present text gives, digested and let go in the task
    that has its subtree; what stands above the subtree is shared by its 512 leaves.
    """
    root = manifest.root or b""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, nodes, made, upper in _subtrees(batch):
                above, proofs, folded = "".join([x.hex() for _, others in upper for x in others]), [], []
                known: dict[bytes, bytes] = {}
                for i, node in enumerate(nodes):
                    lower = siblings(made, i)
                    proofs.append(hashlib.sha256(("".join([x.hex() for _, others in lower for x in others]) + above).encode()).hexdigest())
                    top = fold(node["h"] if node["now"] is None else node["now"], lower)
                    if top not in known:
                        known[top] = fold(top, upper)
                    folded.append(known[top])
                n = len(nodes)
                columns = [pa.array([x["doc_id"] for x in nodes], pa.int64()), pa.array([x["h"].hex() for x in nodes]), pa.array([row["subroot"].hex()] * n), pa.array([root.hex()] * n), pa.array(proofs), pa.array([x.hex() for x in folded]), pa.array([x == root for x in folded])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return leaf_subtrees(manifest, scratch).mapInArrow(check, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered_text() -> Column:
    """The text with its letters A-Z in lower case where 3 divides the checksum of doc_id; null elsewhere, as for null texts."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def audit_documents(documents: DataFrame) -> DataFrame:
    """Manifest of documents, and the audit of a copy of which every third row, about, is tampered with.

    Leaves of a language go by doc_id (null first), then by their digest, so that rows which repeat doc_id have one order;
    a null language comes first. Null and empty fields differ ('-' and '0:'). A row without doc_id, or whose text has no
    capital letters, isn't changed and verifies. An empty table gives no rows; other columns don't count. Texts are read
    once and never shuffled: what moves are 32-byte digests.
    """
    scratch = Scratch(documents.sparkSession, "merkle")
    return audit(build_manifest(leaf_rows(documents, tampered_text()), scratch), scratch)
