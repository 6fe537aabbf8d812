"""Merkle manifest of a table: a tree per language over its rows, one over the languages, and every row's proof.

Rows are range-partitioned and numbered within their language. ``FANOUT ** LEVELS`` consecutive rows are a block, which
one task hashes up to its root. From there blocks exchange roots like a butterfly network: in round ``r`` the blocks are
taken in aligned groups of ``FANOUT`` subtrees of ``FANOUT ** r`` blocks each, and every block meets the one block of each
other subtree that has its own place there. All then hash their common parent, so the same ancestor is hashed in many
places, and each block has the upper part of its proof after as many rounds as there are levels: nothing is passed down.
A last subtree with fewer blocks sends each of its blocks to several places. A round is one grouping of one small row per
block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tokens import row_count, settled

FANOUT = 8
LEVELS = 4  # levels inside a block
BROADCAST_ROWS = 20_000  # a table of block starts or proofs with more rows is joined by a shuffle
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "array<struct<place: int, siblings: array<binary>>>"


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 of the values, each as its byte count, a colon and its bytes, or ``-`` where it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves_of(docs: DataFrame, claimed_text: Column) -> DataFrame:
    """``doc_id, lang, leaf, claimed`` of each row: the hash of the row, and that with ``claimed_text`` instead of its text."""
    values = [F.col(c) for c in FIELDS]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_hash(values).alias("leaf"), leaf_hash([*values[:-1], claimed_text]).alias("claimed"))


def node_hash(children: list[bytes]) -> bytes:
    """Hash of child digests, which enter as lower-case hexadecimal text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def block_levels(leaves: list[bytes], levels: int | None) -> list[list[bytes]]:
    """Nodes level by level: ``levels`` levels above the leaves, or (None) as many as it takes until one node is left."""
    out = [leaves]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        out.append([node_hash(out[-1][at : at + FANOUT]) for at in range(0, len(out[-1]), FANOUT)])
    return out


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if row_count(df) <= BROADCAST_ROWS else df


def blocks_of(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``tree, block, blocks, members`` from ``leaves(tree, key, leaf, claimed)``.

    Members are in the order of ``key`` within their tree (nulls first), those with equal keys in that of their leaf.
    """
    fields = ["tree", "key", "leaf", "claimed"]
    order = [F.asc_nulls_first(c) for c in ("tree", "key", "leaf", "claimed", "tie")]
    # the tie breaker spreads rows that are equal in everything; whichever comes first, the tree is the same
    tied = leaves.select(*fields).withColumn("tie", F.monotonically_increasing_id())
    sorted_rows = tied.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = settled(sorted_rows.select(*fields, F.spark_partition_id().alias("part"), at.alias("at")), "leaves")
    starts = placed.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("tree")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("part", "tree", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    starts = _sized(settled(starts, "starts"))
    size = FANOUT**levels
    joined = placed.alias("p").join(starts.alias("s"), (F.col("p.part") == F.col("s.part")) & F.col("p.tree").eqNullSafe(F.col("s.tree")))
    place = F.col("before") + F.col("at") - F.col("first")
    member = F.struct(place.alias("place"), "key", "leaf", "claimed")
    blocks = F.ceil(F.col("total") / size).cast("bigint")
    grouped = joined.groupBy(F.col("p.tree").alias("tree"), F.floor(place / size).cast("bigint").alias("block"), blocks.alias("blocks"))
    return settled(grouped.agg(F.sort_array(F.collect_list(member)).alias("members")), "blocks")


def block_roots(blocks: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``tree, block, blocks, root, proof``: each block's root with an empty proof."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                leaves = row.column("leaves").flatten().to_pylist()
                alone = row.column("blocks")[0].as_py() == 1
                root = block_levels(leaves, None if alone else levels)[-1][0]
                yield pa.RecordBatch.from_arrays([row.column("tree"), row.column("block"), row.column("blocks"), pa.array([root], pa.binary())], names=["tree", "block", "blocks", "root"])

    plain = blocks.select("tree", "block", "blocks", F.col("members.leaf").alias("leaves"))
    kind = dict(blocks.dtypes)["tree"]
    return plain.mapInArrow(run, f"tree {kind}, block bigint, blocks bigint, root binary").withColumn("proof", F.array().cast(_PROOF))


def _round(state: DataFrame, r: int) -> DataFrame:
    """One exchange: subtrees of ``FANOUT ** r`` blocks become subtrees of ``FANOUT ** (r + 1)``."""
    width = FANOUT**r
    nodes = F.ceil(F.col("blocks") / width).cast("bigint")
    node, low = F.floor(F.col("block") / width).cast("bigint"), F.col("block") % width
    group = F.floor(node / FANOUT).cast("bigint")
    size = lambda n: F.least(F.lit(width).cast("bigint"), F.col("blocks") - n * width)
    open_ = nodes > 1
    # a short last subtree stands at every place that the others have
    places = F.when(open_, F.sequence(low, size(group * FANOUT) - 1, size(node))).otherwise(F.array(low))
    sent = state.select(
        "tree",
        F.when(open_, group).otherwise(-1 - F.col("block")).alias("group"),
        F.explode(places).alias("at"),
        open_.alias("open"),
        F.struct((node % FANOUT).cast("int").alias("place"), "root", "block", "blocks", low.alias("low"), "proof").alias("sent"),
    )
    met = sent.groupBy("tree", "group", "at", "open").agg(F.sort_array(F.collect_list("sent")).alias("sent"))
    digests = F.array_join(F.transform("sent.root", lambda h: F.lower(F.hex(h))), "")
    root = F.when(F.col("open"), F.unhex(F.sha2(digests.cast("binary"), 256))).otherwise(F.col("sent")[0]["root"])
    own = met.withColumn("root", root).select("tree", "at", "open", "root", "sent", F.explode(F.filter("sent", lambda s: s["low"] == F.col("at"))).alias("own"))
    others = F.transform(F.filter("sent", lambda s: s["place"] != F.col("own.place")), lambda s: s["root"])
    level = F.array(F.struct(F.col("own.place").alias("place"), others.alias("siblings")))
    proof = F.when(F.col("open"), F.concat("own.proof", level)).otherwise(F.col("own.proof"))
    return own.select("tree", "own.block", "own.blocks", "root", proof.alias("proof"))


def exchanged(roots: DataFrame) -> DataFrame:
    """Every block with its tree's root and the upper part of its members' proofs."""
    most = roots.agg(F.max("blocks")).first()[0] or 1
    r = 0
    while FANOUT**r < most:
        roots = _round(roots, r)
        r += 1
    return settled(roots, "exchanged")


def _others(nodes: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Per node the digests left and right of it in its run, as hexadecimal text."""
    out = []
    for at in range(0, len(nodes), FANOUT):
        run = [n.hex().encode() for n in nodes[at : at + FANOUT]]
        out.extend((b"".join(run[:i]), b"".join(run[i + 1 :])) for i in range(len(run)))
    return out


def _prove(blocks: DataFrame, proofs: bool, levels: int) -> DataFrame:
    """Rows of ``blocks(tree, block, blocks, members, upper, subroot, root)`` with proof digest and folded root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                members = row.column("members").flatten()
                keys, leaves, claims = (members.field(i) for i in (1, 2, 3))
                nodes = block_levels(leaves.to_pylist(), None if row.column("blocks")[0].as_py() == 1 else levels)
                around = [_others(level) for level in nodes[:-1]]
                upper = []
                for step in row.column("upper")[0].as_py():
                    texts = [s.hex().encode() for s in step["siblings"]]
                    upper.append((b"".join(texts[: step["place"]]), b"".join(texts[step["place"] :])))
                digests, folded, written = [], [], []
                for i, claim in enumerate(claims.to_pylist()):
                    path = [side[i // FANOUT**level] for level, side in enumerate(around)] + upper
                    digests.append(hashlib.sha256(b"".join(a + b for a, b in path)).hexdigest())
                    text = claim.hex().encode()
                    for a, b in path:
                        text = hashlib.sha256(a + text + b).hexdigest().encode()
                    folded.append(text.decode())
                    if proofs:
                        written.append([{"left": a.decode(), "right": b.decode()} for a, b in path])
                same = lambda name: pa.array([row.column(name)[0].as_py().hex()] * len(members), pa.string())
                leaf = pa.array([x.hex() for x in leaves.to_pylist()], pa.string())
                columns = [keys, leaf, same("subroot"), same("root"), pa.array(digests, pa.string()), pa.array(folded, pa.string())]
                names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
                if proofs:
                    columns.append(pa.array(written, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))))
                    names.append("proof")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    fields += ", proof array<struct<left: string, right: string>>" if proofs else ""
    return blocks.mapInArrow(run, fields).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(leaves: DataFrame, proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """Root, proof and verification of every row of ``leaves(doc_id, lang, leaf, claimed)``.

    A row's language tree holds the leaves of the rows with its ``lang``, by ascending ``doc_id``; ``FANOUT`` nodes in a
    row become one, the last run of a level as it is, until one is left, the subroot. The subroots, by language, give the
    root in the same way. Returns ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (digest of all siblings up to
    the root, level by level), ``folded_root`` (what ``claimed`` and the siblings give), ``verified``, and with ``proofs``
    the digests left and right of the path at each level.

    Nulls: rows without a language are a tree of their own, the first; rows without an id come first in their tree. Rows
    with one id are ordered by their leaf, so the tree does not depend on the input's order. A lone leaf is its own
    subroot with no siblings, so an only row has the digest of nothing. An empty table gives no rows.
    """
    blocks = blocks_of(leaves.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), "leaf", "claimed"), levels)
    trees = exchanged(block_roots(blocks, levels))
    subroots = trees.where("block = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf"), F.col("root").alias("claimed"))
    top_blocks = blocks_of(subroots, levels)
    top = exchanged(block_roots(top_blocks, levels))
    by_language = _language_proofs(top_blocks.alias("b").join(_sized(top).alias("t"), F.col("b.block") == F.col("t.block")).select("b.blocks", "b.members", "t.root", "t.proof"), levels)
    by_language = settled(by_language, "languages")
    upper = trees.alias("t").join(_sized(by_language).alias("l"), F.col("t.tree").eqNullSafe(F.col("l.tree")))
    upper = settled(upper.select("t.tree", "t.block", F.col("t.root").alias("subroot"), "l.root", F.concat("t.proof", "l.proof").alias("upper")), "upper")
    both = blocks.alias("b").join(_sized(upper).alias("u"), (F.col("b.block") == F.col("u.block")) & F.col("b.tree").eqNullSafe(F.col("u.tree")))
    return _prove(both.select("b.blocks", "b.members", "u.subroot", "u.root", "u.upper"), proofs, levels)


def _language_proofs(top: DataFrame, levels: int) -> DataFrame:
    """``tree, root, proof`` of each language from the blocks of the tree over the languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                members = row.column("members").flatten()
                nodes = block_levels(members.field(2).to_pylist(), None if row.column("blocks")[0].as_py() == 1 else levels)
                proofs = []
                for i in range(len(members)):
                    steps = []
                    for level, some in enumerate(nodes[:-1]):
                        own = i // FANOUT**level
                        first = own - own % FANOUT
                        steps.append({"place": own - first, "siblings": some[first:own] + some[own + 1 : first + FANOUT]})
                    proofs.append(steps + row.column("proof")[0].as_py())
                kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.binary()))]))
                roots = pa.array([row.column("root")[0].as_py()] * len(members), pa.binary())
                yield pa.RecordBatch.from_arrays([members.field(1), roots, pa.array(proofs, kind)], names=["tree", "root", "proof"])

    return top.mapInArrow(run, f"tree string, root binary, proof {_PROOF}")
