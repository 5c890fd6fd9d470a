"""11. Merkle dataset manifest: trees of SHA-256 digests over documents, by time-forward processing.

Every group of documents (a language) is a binary tree over its leaves in order of their ids; the groups' roots are the leaves of
one more tree. A tree is cut into aligned blocks of 2 ** ``BITS`` nodes, tier by tier. Inside a block, digests go to their parents through a priority
queue ordered by node label (the last leaf below a node, then its level), so a node is computed once its children's messages are
the least in the queue, and the queue never holds more than one message a level. Between blocks the queue is Spark's: a
table of messages, sorted externally by (tree, block, place). The reversed sweep goes down the tiers the same
way: every node hands its proof's rest to its children, labels descending, until the leaves have theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlace.llm.common import map_arrow, slices
from overlace.operators.relabel import dense_ranks
from overlace.plans.lineage import stage

#: Levels of a block: a task holds 2 ** BITS digests of one block at a time.
BITS = 10

Label = tuple[int, int]


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def forward(digests: list[str], levels: int) -> tuple[str, dict[Label, list[tuple[Label, str]]]]:
    """The digest ``levels`` above the given ones, and the messages that each node got: (child's label, its digest), left to right.

    A node's label is (position of the last leaf below it, its level), so labels ascend in the order in which nodes can be computed.
    """
    last, queue, got = len(digests) - 1, [], {}

    def send(label: Label, digest: str) -> None:
        level = label[1] + 1
        parent = label[0] >> level
        heappush(queue, ((min(((parent + 1) << level) - 1, last), level), label, digest))

    if not levels:
        return digests[0], got
    for place, digest in enumerate(digests):
        send((place, 0), digest)
        while queue and queue[0][0][0] <= place:
            label = queue[0][0]
            got[label] = []
            while queue and queue[0][0] == label:
                got[label].append(heappop(queue)[1:])
            value = digest_of([d for _, d in got[label]])
            if label[1] == levels:
                return value, got
            send(label, value)
    raise AssertionError("a block ends with its top")


def backward(got: dict[Label, list[tuple[Label, str]]], last: int, levels: int, rest: list[str]) -> list[list[str]]:
    """The proof of each leaf of a block, from the leaf up: its siblings in the block, then ``rest``, the block's own proof.

    An item is L or R and a digest for a sibling on the left or right, and empty where a node is alone.
    """
    out, queue = [rest] * (last + 1), []
    if levels:
        heappush(queue, (-last, -levels, rest))
    while queue:
        end, level, above = heappop(queue)
        kids = got[-end, -level]
        for k, (label, _) in enumerate(kids):
            other = kids[1 - k][1] if len(kids) == 2 else ""
            mine = [other and ("L" if k else "R") + other, *above]
            if label[1]:
                heappush(queue, (-label[0], -label[1], mine))
            else:
                out[label[0]] = mine
    return out


def _levels(n: int, bits: int) -> int:
    """Levels that a block of a tier of ``n`` nodes has above its nodes."""
    return min(bits, (n - 1).bit_length())


def _blocks(batches) -> Iterator[tuple[tuple, list[tuple]]]:
    """((tree, block), rows) of rows that are sorted by these."""
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in slices(batches, 4096))
    return ((key, list(group)) for key, group in groupby(rows, itemgetter(0, 1)))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "i")


def fold(nodes: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """Tiers of (tree, n, i, digest), n the nodes that the tree has in the tier: the given one, then that of the blocks' tops, until every tree has one node."""

    def run(batches):
        for (tree, block), rows in _blocks(batches):
            n = rows[0][3]
            top, _ = forward([r[4] for r in rows], _levels(n, bits))
            yield {"tree": [tree], "n": [-(-n >> bits)], "i": [block], "digest": [top]}

    tiers = [nodes]
    while not (more := tiers[-1].where("n > 1")).isEmpty():
        rows = more.select("tree", F.shiftright("i", bits).alias("block"), "i", "n", "digest")
        tiers.append(stage(map_arrow(_dealt(rows), run, "tree long, n long, i long, digest string")))
    return tiers


def tops(tiers: list[DataFrame]) -> DataFrame:
    """(tree, tier, digest): the root of each tree and the tier that it was found in."""
    out = [t.where("n = 1").select("tree", F.lit(k).alias("tier"), "digest") for k, t in enumerate(tiers)]
    for other in out[1:]:
        out[0] = out[0].unionByName(other)
    return out[0]


def proofs(tiers: list[DataFrame], heads: DataFrame, payload: str = "", bits: int = BITS) -> DataFrame:
    """(tree, i, digest, subroot, proof[, payload]) of each node of the lowest tier: the reversed sweep from the trees' roots.

    ``heads`` is (tree, tier, subroot, proof), a root and its own proof's rest; ``payload`` is the schema of further columns of the lowest tier.
    """
    extra = [c.split()[0] for c in payload.split(",") if c]

    def run(batches):
        for (tree, _), (head, *rows) in _blocks(batches):
            digests, levels = [r[4] for r in rows], _levels(rows[0][3], bits)
            _, got = forward(digests, levels)
            out = {"tree": [tree] * len(rows), "i": [r[2] for r in rows], "digest": digests, "subroot": [head[5]] * len(rows), "proof": backward(got, len(rows) - 1, levels, head[6])}
            yield out | {c: [r[7 + k] for r in rows] for k, c in enumerate(extra) if len(rows[0]) > 7}

    above = None
    for k in reversed(range(len(tiers))):
        more = extra if k == 0 else []
        head = heads.where(F.col("tier") == k).select("tree", F.lit(0).cast("long").alias("block"), "subroot", "proof")
        head = head if above is None else head.unionByName(above)
        head = head.select("tree", "block", F.lit(-1).cast("long").alias("i"), F.lit(0).cast("long").alias("n"), F.lit("").alias("digest"), "subroot", "proof")
        rows = tiers[k].select("tree", F.shiftright("i", bits).alias("block"), "i", "n", "digest", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("array<string>").alias("proof"), *more)
        found = map_arrow(_dealt(rows.unionByName(head, allowMissingColumns=True)), run, "tree long, i long, digest string, subroot string, proof array<string>" + (f", {payload}" if more else ""))
        if k:
            above = stage(found.select("tree", F.col("i").alias("block"), "subroot", "proof"))
    return found


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields one after the other, each "-" if null, else the count of its UTF-8 bytes, ":" and itself."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]).cast("binary"), 256)


def folded(proof: str, leaf: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""

    def up(node: Column, item: Column) -> Column:
        other = F.substring(item, 2, 64)
        return F.sha2(F.when(item.startswith("L"), F.concat(other, node)).when(item.startswith("R"), F.concat(node, other)).otherwise(node).cast("binary"), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: str) -> Column:
    """SHA-256 of a proof's digests, from the leaf up."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.substring(x, 2, 64)), "").cast("binary"), 256)


def manifest(leaves: DataFrame, group: str = "lang", bits: int = BITS) -> DataFrame:
    """(doc_id, leaf, checked, subroot, root, proof) of every row of ``leaves`` (``group``, doc_id, leaf, checked).

    ``leaf`` is a hexadecimal digest and ``checked`` any string that goes along. A group's leaves are in order of doc_id, nulls first; rows of one
    id in order of their digests. Groups are in order of their names as bytes, null first. Each row has a result, repeated rows too; an empty
    table gives none. A proof grows with the logarithm of the rows; no task holds more than a block, whatever a group's size.
    """
    order = [F.col(group).asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.asc("leaf")]
    numbered = dense_ranks(leaves.select(group, F.col("doc_id").cast("long").alias("doc_id"), "leaf", "checked"), order, "place")
    groups = numbered.groupBy(group).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stage(dense_ranks(stage(groups), [F.asc("first")], "tree"))
    names = groups.select(F.col(group).alias("name"), "tree", "first", "n")
    nodes = numbered.join(names, F.col(group).eqNullSafe(F.col("name"))).select("tree", "n", (F.col("place") - F.col("first")).alias("i"), F.col("leaf").alias("digest"), "doc_id", "checked")
    tiers = fold(nodes, bits)
    roots = stage(tops(tiers))
    upper = fold(roots.select(F.lit(0).cast("long").alias("tree"), F.lit(groups.count()).cast("long").alias("n"), F.col("tree").alias("i"), "digest"), bits)
    top = tops(upper).withColumns({"subroot": F.lit(""), "proof": F.array().cast("array<string>")})
    root = top.first()
    rest = proofs(upper, top.drop("digest"), bits=bits).select(F.col("i").alias("tree"), F.col("digest").alias("subroot"), "proof")
    found = proofs(tiers, roots.drop("digest").join(rest, "tree"), "doc_id long, checked string", bits)
    return found.select("doc_id", F.col("digest").alias("leaf"), "checked", "subroot", F.lit(root and root.digest).cast("string").alias("root"), "proof")


def verified_manifest(docs: DataFrame, group: str = "lang", tampered: Column | None = None, bits: int = BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    Where ``tampered`` holds, the proof is checked against the row with one more in n_chars (a null stays). Other columns are left out,
    nulls in any column are told from empty texts, and texts are hashed whole.
    """
    docs = docs.select("doc_id", "source", "lang", "n_chars", "text", (F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))).alias("_tampered"))
    fields = lambda n: leaf_digest(F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), n.cast("string"), F.col("text"))
    n = F.col("n_chars").cast("decimal(20,0)")
    other = F.when(F.col("_tampered") & n.isNotNull(), fields(n + 1))
    found = manifest(docs.select(group, "doc_id", fields(n).alias("leaf"), other.alias("checked")), group, bits)
    found = found.withColumn("folded_root", folded("proof", F.coalesce("checked", "leaf")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root")).drop("checked")
