"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its distinct shingles of five words. Documents with equal sets are one from the start. In
each of `TREES` independent trees a document goes down `ROOTS` branches, each named by one of its minwise tokens (the
least shingle under a random function); a node holds the documents that share the tokens on its path. Nodes of up
to `LEAF` documents are compared exhaustively on their full sets. Larger nodes branch again, by `BRANCHES` further
tokens a level that the node selects, unless all their documents are known to be connected already; what is still
large at `DEPTH` is compared in tiles. Two documents of similarity 3/4 share none of the 12 roots with probability 0.25 ** 12, below
one in ten million; deeper levels lose a pair only where its nodes are large, and then independently per root.

Links are confirmed on full sets, and a comparison returns a spanning star per group of linked documents instead of
all pairs, which keeps every connection. Tree 0 goes first with its large nodes cut into blocks that share one
leader, then the most linked document so found, so that dense groups are connected by few comparisons; after that,
nodes within one component are skipped.

Defined results: null and wordless texts have an empty set, link with nothing and are kept; with fewer than five
words the whole sequence is the one shingle; repeated rows and equal doc_ids are ordinary copies, of which all rows
with the smallest doc_id are kept; a null doc_id takes the smallest id of its group and is kept only if there is
none; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import if_small, join_back, scratch_path
from . import scan

SHINGLE = 5
# Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
TREES, ROOTS, BRANCHES, DEPTH = 3, 4, 2, 3
# Documents compared exhaustively: in a leaf, and in a block of tree 0's first round.
LEAF, BLOCK = 2048, 128
# Tokens that one of the branches below the roots is selected from, by the node.
CHOICE = 6
TOKENS = TREES * ROOTS + BRANCHES * CHOICE

_GRAM = [scan.coefficients(n, 100 + n) for n in range(SHINGLE + 1)]
_MINWISE = scan.coefficients(TOKENS, 200)
_STARS = "a binary, b binary, degree int"
_SET = "doc_id {kind}, n_shingles long, key binary, text_key binary, tokens array<long>"


def _grams(w: scan.Words) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every row with words."""
    grams = scan.grams(w.hashes, _GRAM[SHINGLE])
    bounds = scan.segments(w.row, w.first, w.last)
    for i in range(w.last - w.first):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= SHINGLE:
            yield w.first + i, np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:
            yield w.first + i, scan.grams(w.hashes[a:b], _GRAM[b - a])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        sizes, keys = np.zeros(n, dtype=np.int64), [None] * n
        tokens = np.zeros((n, TOKENS), dtype=np.uint64)
        for w in scan.words(batch.column("text"), lower=True):
            found = list(_grams(w))
            if not found:
                continue
            rows = np.array([r for r, _ in found])
            every = np.concatenate([g for _, g in found])
            size = np.array([len(g) for _, g in found])
            starts = np.cumsum(size) - size
            sizes[rows] = size
            for r, g in found:
                keys[r] = hashlib.blake2b(g.tobytes(), digest_size=16).digest()
            for t, factor in enumerate(_MINWISE):
                value = every * factor
                value ^= value >> np.uint64(32)
                value *= _MINWISE[t - 1]
                tokens[rows, t] = np.minimum.reduceat(value, starts)
        flat = pa.array(tokens.view(np.int64).ravel())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(sizes), pa.array(keys, pa.binary()), batch.column("text_key"),
                pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * TOKENS, TOKENS, dtype=np.int32)), flat),
            ],
            ["doc_id", "n_shingles", "key", "text_key", "tokens"],
        )


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _linked(sets: list[np.ndarray]) -> list[tuple[list[int], int, int]]:
    """Groups of two and more sets that links connect, each with its most linked member and that one's links."""
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    starts = np.cumsum(size) - size
    member = np.zeros(int(ids.max()) + 1, dtype=bool)
    left, groups = np.ones(len(sets), dtype=bool), []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        group, at, hub, most = [first], 0, first, 0
        while at < len(group):
            i = group[at]
            own = ids[starts[i] : starts[i] + size[i]]
            member[own] = True
            common = np.add.reduceat(member[ids], starts, dtype=np.int64)
            member[own] = False
            link = 100 * common >= SIMILARITY * (size + size[i] - common)
            if link.sum() - 1 > most:
                hub, most = i, int(link.sum()) - 1
            group += np.flatnonzero(left & link).tolist()
            left &= ~link
            at += 1
        if len(group) > 1:
            groups.append((group, hub, most))
    return groups


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node: compare each node's documents, one node in memory at a time."""
    node, keys, sets = None, [], []

    def star() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            a, b, n = [], [], []
            for group, hub, most in _linked(sets):
                others = [keys[i] for i in group if keys[i] != keys[hub]]
                a += [keys[hub]] * len(others)
                b += others
                n += [most] * len(others)
            if a:
                columns = [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "degree"])

    for batch in batches:
        nodes, names = batch.column("node").to_pylist(), batch.column("key").to_pylist()
        for w in scan.words(batch.column("text"), lower=True):
            for row, grams in _grams(w):
                if nodes[row] != node:
                    yield from star()
                    node, keys, sets = nodes[row], [], []
                keys.append(names[row])
                sets.append(grams)
    yield from star()


def _edges(tasks: DataFrame, texts: DataFrame) -> DataFrame:
    """Stars (a, b, degree) of confirmed groups, a the most linked, from (node, key) rows; equal nodes count once."""
    alike = tasks.groupBy("node").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")
    ).where("n > 1").groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node")
    rows = join_back(tasks, alike, ["node"], "left_semi")
    rows = join_back(rows, texts, ["key"])
    found = rows.repartition("node").sortWithinPartitions("node").mapInArrow(_compare, _STARS)
    return found.groupBy("a", "b").agg(F.max("degree").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(key, component) of every key in an edge; the component is its least key. Large and small stars in turn."""
    links = _stored(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "links"
    )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()

    before = mark(links)
    while True:
        both = links.union(links.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = join_back(both, least, ["u"]).where("v > u AND v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = join_back(large, low, ["hi"]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links = _stored(small.union(low.select("hi", "m")).distinct(), "links")
        after = mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("hi").alias("key"), F.col("lo").alias("component")).union(
        links.select("lo", "lo").distinct().toDF("key", "component")
    )


def _roots(tokens: DataFrame, places: range) -> DataFrame:
    """(node, key) of the branches at the root, one for every token at `places`."""
    nodes = F.array(*(F.xxhash64(F.lit(i), F.get("tokens", F.lit(i))) for i in places))
    return tokens.select(F.explode(nodes).alias("node"), "key")


def _children(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(node, key) one level down. The node selects its branches' tokens, so the ways below different roots differ."""

    def branch(j: int):
        place = TREES * ROOTS + j * CHOICE + F.pmod(F.xxhash64("node", F.lit(j)), F.lit(CHOICE)).cast("int")
        return F.xxhash64("node", place, F.get("tokens", place))

    return join_back(rows, tokens, ["key"]).select(F.explode(F.array(*map(branch, range(BRANCHES)))).alias("node"), "key")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes with two documents or more, with the node's size."""
    size = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    return join_back(rows, size, ["node"])


def _with_component(rows: DataFrame, known: DataFrame) -> DataFrame:
    return join_back(rows, known, ["key"], "left").withColumn("component", F.coalesce("component", "key"))


def _open(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of nodes that hold more than one component, with the node's size."""
    own = _with_component(rows, known)
    nodes = own.groupBy("node").agg(
        F.count("*").alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1")
    ).where("c0 <> c1").select("node", "n")
    return join_back(rows, nodes, ["node"])


def _blocks(big: DataFrame, leaders: DataFrame) -> DataFrame:
    """Large nodes cut into blocks of about half of BLOCK, with the node's leader (node, key) in each of them."""
    count = F.ceil(F.col("n") * 2 / BLOCK)
    block = big.withColumn("block", F.pmod(F.xxhash64("key", F.lit(3)), count))
    sizes = big.groupBy("node").agg(F.first("n").alias("n"))
    leader = join_back(leaders, sizes, ["node"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    )
    return block.select("node", "block", "key").union(leader.select("node", "block", "key")).distinct().select(
        F.xxhash64("node", "block").alias("node"), "key"
    )


def _tiles(big: DataFrame, known: DataFrame) -> DataFrame:
    """Large nodes of several components: every document outside the main one against all, block by block."""
    own = _with_component(big, known)
    parts = own.groupBy("node", "component").agg(F.count("*").alias("size"))
    main = parts.groupBy("node").agg(F.max(F.struct("size", "component"))["component"].alias("main"))
    own = join_back(own, main, ["node"])
    outside = own.where("component <> main")
    count = F.ceil(F.col("n") * 2 / LEAF)
    few = outside.groupBy("node").agg(F.ceil(F.count("*") * 2 / LEAF).alias("few"))
    every = join_back(own, few, ["node"]).select(
        "node", "key", F.pmod(F.xxhash64("key", F.lit(4)), count).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("few") - 1)).alias("odd"),
    )
    odd = join_back(outside, few, ["node"]).select(
        "node", "key", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"),
        F.pmod(F.xxhash64("key", F.lit(5)), F.col("few")).alias("odd"),
    )
    return every.union(odd.select("node", "key", "block", "odd")).distinct().select(
        F.xxhash64("node", "block", "odd").alias("node"), "key"
    )


def _union(spark: SparkSession, frames: list[DataFrame], schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for frame in frames:
        out = out.union(frame)
    return out


def _labels(stars: DataFrame) -> DataFrame:
    """(key, component) such that equal components mean connected sets; cheaper than, and coarse beside, `components`.

    Every set takes the best linked centre of its stars, and then that centre's own centre.
    """
    both = stars.select(F.col("b").alias("key"), "a", "degree").union(stars.select(F.col("a").alias("key"), "a", "degree"))
    centre = _stored(both.groupBy("key").agg(F.max(F.struct("degree", "a"))["a"].alias("component")), "labels")
    further = centre.toDF("component", "further")
    return join_back(centre, further, ["component"], "left").select("key", F.coalesce("further", "component").alias("component"))


def links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, component) of the sets that are linked with another set."""
    spark = docs.sparkSession
    reps = _stored(
        sets.where("key IS NOT NULL").groupBy("key").agg(
            F.min("text_key").alias("text_key"), F.first("tokens").alias("tokens")
        ),
        "reps",
    )
    tokens = reps.select("key", "tokens")
    roots = _stored(_sized(_roots(tokens, range(TREES * ROOTS)).distinct()), "roots")
    # Texts of all documents that share a node, once each.
    wanted = if_small(
        join_back(reps.select("key", "text_key"), roots.select("key").distinct(), ["key"], "left_semi")
        .select("text_key", "key")
    )
    texts = _stored(
        docs.select("text").withColumn("text_key", F.unhex(F.md5("text"))).join(wanted, "text_key")
        .groupBy("key").agg(F.first("text").alias("text")),
        "texts",
    )

    first = _roots(tokens, range(ROOTS))
    first = _stored(join_back(roots, first.select("node").distinct(), ["node"], "left_semi"), "first")
    small, big = first.where(F.col("n") <= BLOCK), first.where(F.col("n") > BLOCK)
    least = big.groupBy("node").agg(F.min("key").alias("key"))
    found = _stored(_edges(small.select("node", "key").union(_blocks(big, least)), texts), "edges")
    # In a dense group some member, such as the text that all others were made from, links with nearly all of it.
    # Its block shows it by its number of links; as leader of all blocks it then connects the group.
    hubs = join_back(big.select("node", "key"), found.withColumnRenamed("b", "key"), ["key"]).groupBy("node").agg(
        F.max(F.struct("degree", "a"))["a"].alias("key")
    )
    hubs = _stored(_blocks(big, hubs), "blocks")
    found = found.union(_stored(_edges(hubs, texts), "edges"))
    # Written, as every level below looks it up; planned anew each time, it would fill the driver with plans.
    known = _stored(_labels(found), "known")

    rows, tasks = roots.select("node", "key"), []
    for level in range(1, DEPTH + 1):
        rows = _stored(_open(rows, known), "open")
        tasks.append(rows.where(F.col("n") <= LEAF).select("node", "key"))
        big = rows.where(F.col("n") > LEAF)
        if big.isEmpty():
            break
        if level == DEPTH:
            tasks.append(_stored(_tiles(big, known), "tiles"))
            break
        rows = _stored(_children(big.select("node", "key"), tokens), "children")
    more = _stored(_edges(_union(spark, tasks, "node long, key binary"), texts), "edges")
    return components(found.union(more))


def _judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' sets, and (key, component_id) of all sets."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("text_key"))
    sets = _stored(texts.mapInArrow(_sets, _SET.format(kind=kind)), "sets")
    # The smallest id of every set, then of every component.
    low = sets.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("low"))
    low = join_back(low, links(sets, docs), ["key"], "left")
    low = low.withColumn("component", F.coalesce("component", "key"))
    least = low.groupBy("component").agg(F.min("low").alias("component_id"))
    return sets, join_back(low.select("key", "component"), least, ["component"]).select("key", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id is its component's smallest) of every document."""
    sets, ids = _judged(docs)
    # Empty sets get keys of another length, so that they match nothing and do not gather in one partition.
    apart = F.concat(F.unhex(F.md5(F.col("doc_id").cast("string"))), F.lit(b"-"))
    rows = sets.select("doc_id", "n_shingles", F.coalesce("key", apart).alias("key"))
    own = F.coalesce("component_id", "doc_id")
    return join_back(rows, ids, ["key"], "left").select(
        "doc_id", "n_shingles", own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    sets, ids = _judged(docs)
    # Only texts of components with a document to drop are looked up, so most texts stay where they are.
    texts = join_back(sets.where("key IS NOT NULL").select("doc_id", "key", "text_key"), ids, ["key"])
    crowded = texts.groupBy("text_key").agg(
        F.min("component_id").alias("_component"), F.max("doc_id").alias("high"), F.count("*").alias("n")
    ).where("n > 1 OR NOT (high <=> _component)").select(F.col("text_key").alias("_text_key"), "_component")
    held = docs.select(
        *(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)), F.col("doc_id").alias("_doc_id"),
        F.unhex(F.md5("text")).alias("_text_key"),
    )
    small = if_small(_stored(crowded, "crowded"))
    return held.join(small, "_text_key", "left").where(
        F.col("_component").isNull() | F.coalesce(F.col("_doc_id") == F.col("_component"), F.lit(False))
    ).select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))
