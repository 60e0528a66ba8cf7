"""Merkle manifest of a dataset, with proofs by coordinate lookup.

Every row is a leaf; the leaves of a source stand in the order of their ids and form a tree of threes, and the roots of all sources form one
more. A node is known by its coordinates: tree, level and index. Nodes are made a few levels at a time, block by block, and written to one
table. For a proof, each leaf works out the coordinates of the siblings on its way up from its index and the number of leaves alone, looks
them up in the node table, puts them in order, concatenates and folds them.

Leaves are numbered by a range exchange and the row counts of its parts, so no source has to fit in one task. Leaves and nodes meet by
(tree, block of 3**BLOCK leaves): a node below that level belongs to one block, a node above is copied to the blocks under its parent, which adds
a tenth of the leaves at most. Therefore no key holds more than a few thousand rows, however large a source is and however
many leaves need its topmost nodes. Only digests are shuffled, never texts.

Defined results: a null source comes first and is no empty string; null ids come first in their source and aren't tampered with; rows with equal ids
go by their leaf; repeated rows are leaves each; null values are `-`; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

WAYS = 3
#: Levels that are made by one exchange, and levels (as a power of WAYS, leaves) of the blocks in which proofs are looked up.
CLIMB, BLOCK = 5, 6
NODES = "tree string, level int, idx long, n long, leaves long, digest string"
#: Block numbers that one row is unfolded to at once.
SPREAD = 4096


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def hashed(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def height(n: int) -> int:
    """Levels above n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // WAYS), h + 1
    return h


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part and at: the number of this partition and each row's place in its run of equal trees."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        tree = batch.column("tree")
        new = np.flatnonzero(np.concatenate(([tree[0].as_py() != last], np.asarray(pc.not_equal(tree[1:], tree[:-1])).astype(bool))))
        base = np.arange(n) + seen
        if len(new):
            run = np.searchsorted(new, np.arange(n), side="right")
            base = np.where(run > 0, np.arange(n) - new[np.maximum(run - 1, 0)], base)
        last, seen = tree[n - 1].as_py(), int(base[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, dtype=np.int64)), pa.array(base.astype(np.int64))], names=[*batch.schema.names, "part", "at"])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with idx (place in its ``tree`` by ``order``, nulls first) and n (rows of its tree)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = ["tree", *order, "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *sort).sortWithinPartitions(*sort).drop("tie")
    kinds = ", ".join(f"{name} {kind}" for name, kind in ranged.dtypes)
    placed = materialize(ranged.mapInArrow(_places, f"{kinds}, part long, at long"), "placed")
    runs = placed.groupBy("tree", "part").agg(F.count("*").alias("own"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("own").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", before.alias("before"), F.sum("own").over(tree).alias("n"))
    out = placed.join(runs, ["tree", "part"]).select(*rows.columns, (F.col("before") + F.col("at")).alias("idx"), "n")
    done = materialize(out, "numbered")
    release(placed)
    return done


def _cell(total: int, block: Column) -> Column:
    """One of so many groups that each holds about a block of leaves: large trees are dealt by block, small ones share a group."""
    return F.pmod(F.xxhash64("tree", block), F.lit(max(1, total // WAYS**BLOCK)))


def _climbed(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of up to CLIMB levels over whole blocks of one level."""
    out: list[tuple[str, int, int, int, int, str]] = []
    rows = rows.sort_values(["tree", "idx"], kind="stable")
    for (tree, block), own in rows.groupby(["tree", rows["idx"] // WAYS**CLIMB], sort=False):
        level, n, digests = int(own["level"].iloc[0]), int(own["n"].iloc[0]), own["digest"].tolist()
        at, leaves = int(block) * WAYS**CLIMB, int(own["leaves"].iloc[0])
        for up in range(1, CLIMB + 1):
            if n <= 1:
                break
            digests = [digest(*digests[i : i + WAYS]) for i in range(0, len(digests), WAYS)]
            at, n = at // WAYS, -(-n // WAYS)
            out += [(tree, level + up, at + i, n, leaves, d) for i, d in enumerate(digests)]
    return pd.DataFrame(out, columns=["tree", "level", "idx", "n", "leaves", "digest"])


def nodes(leaves: DataFrame) -> DataFrame:
    """All nodes of all trees over numbered leaves (tree, idx, n, digest): tree, level, idx, n (nodes of that level), leaves (of the tree), digest. A written table."""
    facts = leaves.agg(F.max("n").alias("most"), F.count("*").alias("total")).first()
    out = materialize(leaves.select("tree", F.lit(0).alias("level"), "idx", "n", F.col("n").alias("leaves"), "digest"), "nodes")
    for level in range(0, height(facts["most"] or 0), CLIMB):
        front = out.where((F.col("level") == level) & (F.col("n") > 1))
        made = front.groupBy(_cell(-(-facts["total"] // WAYS**level), F.floor(F.col("idx") / WAYS**CLIMB)).alias("cell")).applyInPandas(lambda rows: _climbed(rows), NODES)
        out = materialize(made, "nodes", out)
    return out


def roots(made: DataFrame) -> DataFrame:
    return made.where("n = 1").select("tree", "digest", "leaves")


def _copied(made: DataFrame, leaves: int) -> DataFrame:
    """The nodes that can be siblings, each in every block of leaves that may look it up."""
    size, under = WAYS**BLOCK, F.pow(F.lit(float(WAYS)), F.col("level") + 1).cast("long")
    first = F.floor(F.col("idx") / WAYS) * under
    counts = F.when(F.col("level") < BLOCK, first).otherwise(F.least(first + under - 1, F.col("leaves") - 1))
    spans = made.where("n > 1").withColumn("block", F.explode(F.sequence(F.floor(first / size), F.floor(counts / size))))
    return spans.select(_cell(leaves, F.col("block")).alias("cell"), "tree", "block", "level", "idx", "digest")


def coordinates(idx: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, level, index) of the siblings that each leaf needs, from its own index and the number of leaves alone."""
    rows, levels, found, at, left, level = [], [], [], idx, n, 0
    row = np.arange(len(idx))
    while (left > 1).any():
        row, at, left = row[left > 1], at[left > 1], left[left > 1]
        for k in range(WAYS):
            sibling = at // WAYS * WAYS + k
            ok = (sibling != at) & (sibling < left)
            rows.append(row[ok])
            levels.append(np.full(ok.sum(), level))
            found.append(sibling[ok])
        at, left, level = at // WAYS, -(-left // WAYS), level + 1
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x).astype(np.int64) if x else none for x in (rows, levels, found))  # type: ignore[return-value]


def looked_up(leaves: pd.DataFrame, table: pd.DataFrame) -> list[list[str]]:
    """The siblings of each leaf, level by level, left to right."""
    row, level, idx = coordinates(leaves["idx"].to_numpy(np.int64), leaves["n"].to_numpy(np.int64))
    block = leaves["idx"].to_numpy(np.int64) // WAYS**BLOCK
    want = pd.DataFrame({"row": row, "tree": leaves["tree"].to_numpy()[row], "block": block[row], "level": level, "idx": idx})
    got = want.merge(table[["tree", "block", "level", "idx", "digest"]], on=["tree", "block", "level", "idx"], how="left", validate="many_to_one")
    if got["digest"].isna().any():
        raise ValueError("a sibling is missing from the node table")
    got = got.sort_values(["row", "level", "idx"], kind="stable")
    ends = np.searchsorted(got["row"].to_numpy(), np.arange(len(leaves) + 1))
    digests = got["digest"].tolist()
    return [digests[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def folded(leaf: str, idx: int, n: int, siblings: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    at = 0
    while n > 1:
        place, size = idx % WAYS, min(WAYS, n - idx // WAYS * WAYS) - 1
        run = siblings[at : at + size]
        leaf = digest(*run[:place], leaf, *run[place:])
        idx, n, at = idx // WAYS, -(-n // WAYS), at + size
    if at != len(siblings):
        raise ValueError("a proof has siblings left over")
    return leaf


def proofs(leaves: DataFrame, made: DataFrame) -> DataFrame:
    """tree, idx, siblings (array of digests, in order) of every numbered leaf."""
    total = leaves.count()
    left = leaves.select(_cell(total, F.floor(F.col("idx") / WAYS**BLOCK)).alias("cell"), "tree", "idx", "n")

    def run(own: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": own["tree"], "idx": own["idx"], "siblings": looked_up(own, table)})

    return left.groupBy("cell").cogroup(_copied(made, total).groupBy("cell")).applyInPandas(run, "tree string, idx long, siblings array<string>")


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, tree, digest of every row, and tried: the leaf after tampering (line ends deleted where 2 divides the id's crc32)."""
    text = F.col("text").cast("string")
    rest = [F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]
    doc_id = F.col("doc_id").cast("long")
    tampered = (F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    tree = F.when(rest[0].isNull(), F.lit("-")).otherwise(F.concat(F.lit("s"), rest[0]))  # in the order of sources, null first
    leaf = hashed(doc_id, *rest, text)
    rows = docs.select(doc_id.alias("doc_id"), tree.alias("tree"), leaf.alias("digest"), F.when(tampered, hashed(doc_id, *rest, F.replace(text, F.lit("\n"), F.lit("")))).alias("tried"))
    return rows


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    leaves = numbered(leaves_of(docs), "doc_id", "digest")
    made = nodes(leaves)
    sources = numbered(roots(made).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "leaves"), "name")
    tops = nodes(sources)
    top = roots(tops).first()
    root = top.digest if top else None
    ways = sources.select("idx", "name", "n", "leaves", F.col("digest").alias("subroot")).join(proofs(sources, tops).select("idx", "siblings"), "idx")
    ways = materialize(ways.select(F.col("name").alias("tree"), F.col("idx").alias("rank"), F.col("n").alias("sources"), "leaves", "subroot", "siblings"), "ways")
    release(sources, tops)
    total, size = leaves.count(), WAYS**BLOCK
    # a row of its source goes to every block of leaves, beside the nodes
    last = F.floor((F.col("leaves") - 1) / size)
    above = ways.withColumn("some", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / SPREAD))))
    above = above.withColumn("block", F.explode(F.sequence(F.col("some") * SPREAD, F.least(last, F.col("some") * SPREAD + SPREAD - 1))))
    above = above.select(_cell(total, F.col("block")).alias("cell"), "tree", "block", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), "rank", "sources", "subroot", "siblings")
    right = _copied(made, total).unionByName(above, allowMissingColumns=True)
    left = leaves.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("cell", _cell(total, F.floor(F.col("idx") / size)))

    def run(own: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        node = table["level"] >= 0
        heads = {r.tree: r for r in table[~node].drop_duplicates("tree").itertuples()}
        out = []
        for r, below in zip(own.itertuples(), looked_up(own, table[node]), strict=True):
            head = heads[r.tree]
            over = list(head.siblings)
            rank, sources = int(head.rank), int(head.sources)
            sub = folded(r.tried or r.digest, int(r.idx), int(r.n), below)
            reached = folded(sub, rank, sources, over)
            out.append((r.digest, head.subroot, root, digest(*below, *over), reached, reached == root))
        cols = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        found = pd.DataFrame(out, columns=cols)
        found.insert(0, "doc_id", own["doc_id"].to_numpy())
        return found

    kinds = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(run, kinds).withColumn("doc_id", F.col("doc_id").cast("long"))
