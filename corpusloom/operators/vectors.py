"""Hashed TF-IDF vectors, cosine neighbours and locality-sensitive buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.features import Tally, compacted, tally_texts
from ..functions.text import nfkc, words
from ..session import cut, if_small, join_back, keyed, lookup, spread

# Dimensions, neighbour count and floor, bands, bits of a band and seed.
DIMENSIONS = 512
NEIGHBOURS = 10
FLOOR = 0.48
BANDS, BAND_BITS = 4, 12
PLANE_SEED = 3719

# Rows of one side of a tile; a tile is the most one task multiplies at once.
TILE_ROWS = 2_048
# Neighbouring blocks of a pivot and, in small tables, pivots that move together: a vector meets as many others each
# time it is sent. Their product is at most 62, as a team's blocks are bits.
TOGETHER, PIVOTS_TOGETHER = 8, 7
# Pivots, the rings of like angles around one, and the coarser rings by which blocks meet.
PIVOTS, RINGS, COARSE = 32, 1_024, 64

# Characters of the texts that one task tallies at once, teams whose features meet in a slice on average, and teams
# whose counts may be broadcast.
TEAM_CHARS, TEAMS_A_SLICE, BROADCAST_TEAMS = 2 << 20, 8, 16


def _slices(features: Tally, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Features in the order of their slices, and where each slice begins."""
    at = (features.signs >> 1) % slices
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(slices + 1))


def _feature_counts(slices: int):
    def run(team: pa.Table) -> pa.Table:
        team = team.combine_chunks()
        found = tally_texts(*(pa.concat_arrays(team[c].chunks) for c in ("tokens", "compact")))
        order, ends = _slices(found, slices)
        docs = np.bincount(found.feature, minlength=len(found.names))
        offsets = pa.array(ends, pa.int32())
        return pa.table(
            {
                "team": pa.array(np.full(slices, team["team"][0].as_py()), pa.int32()),
                "slice": pa.array(np.arange(slices), pa.int32()),
                "features": pa.ListArray.from_arrays(offsets, found.names.take(pa.array(order))),
                "df": pa.ListArray.from_arrays(offsets, pa.array(docs[order], pa.int64())),
            }
        )

    return run


def _frequencies(parts: pa.Table) -> pa.Table:
    parts = parts.combine_chunks()
    features, df = (pa.concat_arrays(parts[c].chunks) for c in ("features", "df"))
    codes = features.flatten().dictionary_encode().indices.to_numpy()
    counts = np.bincount(codes, weights=df.flatten().to_numpy()).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(df).to_numpy())])
    known = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts[codes], pa.int64()))
    return pa.table({"team": parts["team"], "slice": parts["slice"], "df": known})


def _weights(total: int, slices: int, dimensions: int, kind: pa.DataType):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, tokens, compact, known = (batch.column(c)[at].values for c in ("ids", "tokens", "compact", "known"))
                found = tally_texts(tokens, compact)
                order, _ = _slices(found, slices)
                known = known.take(pc.sort_indices(known.field("slice")))
                df = np.empty(len(order), dtype=np.int64)
                df[order] = known.field("df").flatten().to_numpy()
                weight = np.where(found.signs % 2 == 1, 1, -1) * (np.log((total + 1) / (df + 1)) + 1)
                codes = ids.dictionary_encode(null_encoding="encode")
                cell = codes.indices.to_numpy()[found.owner] * dimensions + (found.buckets % dimensions)[found.feature]
                sums = np.bincount(cell, weights=weight[found.feature] * (1 + np.log(found.tf)))
                own, bucket = np.divmod(np.flatnonzero(np.bincount(cell)), dimensions)
                for low in range(0, len(own), 1 << 17):
                    o, k = own[low : low + (1 << 17)], bucket[low : low + (1 << 17)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            codes.dictionary.take(pa.array(o)).cast(kind), pa.array(k, pa.int32()),
                            pa.array(sums[o * dimensions + k], pa.float64()),
                        ],
                        ["id", "bucket", "weight"],
                    )

    return run


def hashed_tfidf(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """rows(id, text) as (id, bucket, weight): signed sums of (1 + ln tf) * idf.

    Texts go in teams of about TEAM_CHARS, an id in one team. A team sends each of its distinct features once to the
    feature's slice, which adds up the teams' counts and answers with them; no feature is a row of its own.
    """
    total, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    teams = max(least, -(-chars // TEAM_CHARS))
    slices = -(-teams // TEAMS_A_SLICE)
    lowered = F.lower(nfkc("text"))
    placed = (
        spread(rows.where("text IS NOT NULL"))
        .select("id", F.pmod(F.xxhash64("id"), F.lit(teams)).cast("int").alias("team"), lowered.alias("lowered"))
        .repartition(teams, "team")
    )
    counts = placed.select("team", words("lowered").alias("tokens"), compacted("lowered").alias("compact")).groupBy("team")
    counts = counts.applyInArrow(_feature_counts(slices), "team int, slice int, features array<string>, df array<long>")
    known = (
        counts.repartition(max(least, slices), "slice")
        .groupBy("slice")
        .applyInArrow(_frequencies, "team int, slice int, df array<long>")
        .repartition(teams, "team")
        .groupBy("team")
        .agg(F.collect_list(F.struct("slice", "df")).alias("known"))
    )
    known = cut(known)
    near = if_small(known, BROADCAST_TEAMS)
    kind = rows.schema["id"].dataType
    return (
        placed.groupBy("team")
        .agg(F.collect_list(F.struct("id", "lowered")).alias("docs"))
        .join(known.hint("shuffle_hash") if near is known else near, "team")
        .select(
            F.col("docs.id").alias("ids"),
            F.transform("docs.lowered", words).alias("tokens"),
            F.transform("docs.lowered", compacted).alias("compact"),
            "known",
        )
        .mapInArrow(
            _weights(total, slices, dimensions, to_arrow_type(kind)),
            T.StructType().add("id", kind).add("bucket", T.IntegerType()).add("weight", T.DoubleType()),
        )
    )


def densify(weights: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, bucket, weight) as (id, vector) with zeros filled in; at most `dimensions` entries a row."""
    entries = weights.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    at = F.sequence(F.lit(0), F.lit(dimensions - 1))
    return entries.select("id", F.transform(at, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


def l2_normalize(vector) -> Column:
    value = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(F.aggregate(value, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(value, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def valid_vector(vector, dimensions: int) -> Column:
    value = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(value) == dimensions) & finite, F.lit(False))


def pending_vectors(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct input hashes of wanted(input_hash, text) that cache(input_hash, ...) lacks."""
    return wanted.dropDuplicates(["input_hash"]).join(cache, "input_hash", "left_anti")


def planes(dimensions: int, count: int = BANDS * BAND_BITS) -> np.ndarray:
    """The first hyperplanes of the seeded 32-bit xorshift sequence."""
    state, out = PLANE_SEED, np.empty(count * dimensions)
    for at in range(out.size):
        state ^= (state << 13) & 0xFFFFFFFF
        state ^= state >> 17
        state ^= (state << 5) & 0xFFFFFFFF
        out[at] = state / 4294967296 - 0.5
    return out.reshape(count, dimensions)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def signature(vector, dimensions: int, bits: int = BAND_BITS) -> Column:
    """A signature of `bits` bits in each of four bands of a vector."""
    normals = planes(dimensions, BANDS * bits)

    @arrow_udf(T.ArrayType(T.IntegerType()))
    def bands(vectors: pa.Array) -> pa.Array:
        side = (_matrix(vectors) @ normals.T >= 0).reshape(len(vectors), BANDS, bits)
        packed = (side * (1 << np.arange(bits))).sum(axis=2)
        return pa.array(packed.astype(np.int32).tolist(), pa.list_(pa.int32()))

    return bands(vector)


def _tile_best(count: int, floor: float):
    def best(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        probe, bits = cell["probe"].to_numpy(zero_copy_only=False), cell["bits"].to_numpy()
        ids, vectors = cell["id"], _matrix(cell["vector"].combine_chunks())
        keys = ids.to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(probe), np.flatnonzero(~probe)
        src = dst = np.empty(0, dtype=np.int64)
        kept = np.empty(0)
        if len(left) and len(right):
            scores = vectors[left] @ vectors[right].T
            fits = np.isfinite(scores) & (scores >= floor) & (keys[left][:, None] != keys[right][None, :])
            # Signatures that differ in one bit at most; where there are none they are all 0.
            apart = bits[left][:, None] ^ bits[right][None, :]
            src, dst = np.nonzero(fits & (apart & (apart - 1) == 0))
            kept = scores[src, dst]
            order = np.lexsort((keys[right[dst]], -kept, src))
            src, dst, kept = src[order], dst[order], kept[order]
            place = np.arange(len(src)) - np.searchsorted(src, src)
            src, dst, kept = left[src[place < count]], right[dst[place < count]], kept[place < count]
        return pa.table({"src": ids.take(pa.array(src)), "dst": ids.take(pa.array(dst)), "score": kept})

    return best


def _cells_best(both: DataFrame, count: int, floor: float) -> DataFrame:
    """The best `count` of each probe over cells(cell, id, vector, bits, probe), as (src, dst, score).

    A cell holds two blocks at most and returns only its best rows, never a list of all its pairs.
    """
    kind = dict(both.dtypes)["id"]
    found = keyed(both, "cell").groupBy("cell").applyInArrow(_tile_best(count, floor), f"src {kind}, dst {kind}, score double")
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))
    merged = found.groupBy("src", "dst").agg(F.max("score").alias("score"))
    return merged.withColumn("place", rank).where(F.col("place") <= count).drop("place")


def _best_of(src: np.ndarray, dst: np.ndarray, score: np.ndarray, keys: np.ndarray, count: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((keys[dst], -score, src))
    src, dst, score = src[order], dst[order], score[order]
    kept = np.arange(len(src)) - np.searchsorted(src, src) < count
    return src[kept], dst[kept], score[kept]


def _groups_best(count: int, floor: float):
    def best(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        ids, vectors = cell["id"], _matrix(cell["vector"].combine_chunks())
        keys, at = ids.to_numpy(zero_copy_only=False), cell["at"].to_numpy()
        first, meets = cell["first"].to_numpy(zero_copy_only=False), cell["meets"].to_numpy()
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        # A group that meets itself comes once, and all its ordered pairs of blocks are gone through.
        alone = not len(right)
        right = left if alone else right
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        for i in np.unique(at[left]):
            rows = left[at[left] == i]
            for j in np.unique(at[right]):
                if not meets[rows[0]] >> j & 1:
                    continue
                others = right[at[right] == j]
                scores = vectors[rows] @ vectors[others].T
                src, dst = np.nonzero(np.isfinite(scores) & (scores >= floor))
                src, dst, score = rows[src], others[dst], scores[src, dst]
                apart = src != dst
                src, dst, score = src[apart], dst[apart], score[apart]
                found.append(_best_of(src, dst, score, keys, count))
                if not alone:
                    found.append(_best_of(dst, src, score, keys, count))
        src, dst, score = _best_of(*(np.concatenate(c) for c in zip(*found)), keys, count)
        return pa.table({"src": ids.take(pa.array(src)), "dst": ids.take(pa.array(dst)), "score": score})

    return best


def half_signatures(signed: DataFrame, bits: int) -> DataFrame:
    """(bucket, id, vector, bits): each band's signature under both of its halves.

    Of two signatures that differ in one bit at most, one half is equal, so two copies a band meet all such pairs.
    """
    low = bits // 2
    halves = F.explode(F.array(*(
        F.struct(F.lit(side).alias("side"), (F.shiftright("bits", low) if side else F.col("bits").bitwiseAND((1 << low) - 1)).alias("half")) for side in (0, 1)
    )))
    return signed.select("id", "vector", "band", "bits", halves.alias("h")).select(
        F.concat_ws("-", "band", "h.side", "h.half").alias("bucket"), "id", "vector", "bits"
    )


def _bucket_best(rows: DataFrame, count: int, floor: float) -> DataFrame:
    """Best `count` others within equal buckets of rows(bucket, id, vector, bits).

    A bucket is cut into blocks of about TILE_ROWS rows, and each pair of blocks is one tile, so a bucket that holds
    a third of the table becomes many tasks.
    """
    plan = cut(rows.groupBy("bucket").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("blocks")))
    placed = lookup(rows, plan, ["bucket"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = placed.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def side(row: str, col: str, probe: bool) -> DataFrame:
        return each.select(F.concat_ws("-", "bucket", row, col).alias("cell"), "id", "vector", "bits", F.lit(probe).alias("probe"))

    return _cells_best(side("mine", "theirs", True).unionByName(side("theirs", "mine", False)), count, floor)


def pivot_blocks(reps: DataFrame, rows: int = TILE_ROWS) -> DataFrame:
    """reps(id, vector) with `block`, of about `rows` vectors around one pivot at like angles, and all pivots' `angles`.

    Neighbouring blocks are a `team`, in which `at` numbers them.
    """
    chosen = reps.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = np.array([r["vector"] for r in chosen], dtype=np.float64)

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def angles(vectors: pa.Array) -> pa.Array:
        near = np.nan_to_num(_matrix(vectors) @ pivots.T)
        return pa.array(np.arccos(np.clip(near, -1, 1)).tolist(), pa.list_(pa.float64()))

    seen = cut(reps.withColumn("angles", angles("vector")))
    nearest = seen.withColumn("least", F.array_min("angles")).withColumn("pivot", F.array_position("angles", F.col("least")).cast("int"))
    nearest = nearest.withColumn("ring", F.floor(F.col("least") * (RINGS / np.pi)).cast("int"))
    # At most PIVOTS * RINGS rings exist, whatever the number of vectors.
    rings = nearest.groupBy("pivot", "ring").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("pivot").orderBy("ring"))
    plan = cut(rings.select("pivot", "ring", F.floor((upto - F.col("n")) / rows).alias("group"), F.ceil(F.col("n") / rows).alias("parts")))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    # A ring that is cut into parts makes teams of its own.
    cut_up, nth = F.col("parts") > 1, F.when(F.col("parts") > 1, part).otherwise(F.col("group"))
    team = F.floor(nth / TOGETHER)
    merged = max(1, min(PIVOTS_TOGETHER, TOGETHER * rows * PIVOTS // max(1, seen.count())))
    return nearest.join(F.broadcast(plan), ["pivot", "ring"]).select(
        "id", "vector", "angles", "pivot", F.concat_ws("-", "pivot", "group", F.when(cut_up, F.concat_ws(".", "ring", part))).alias("block"),
        F.when(cut_up, F.concat_ws("-", "pivot", "ring", team)).otherwise(F.concat_ws("-", F.floor(F.col("pivot") / merged), team)).alias("team"),
        (F.when(cut_up, 0).otherwise(F.col("pivot") % merged * TOGETHER) + nth % TOGETHER).cast("int").alias("at"),
    )


def near_blocks(blocks: DataFrame, floor: float) -> DataFrame:
    """(a, b) of the blocks that can hold a pair at or above `floor`, by the triangle inequality over all pivots.

    Both lie at angles to each pivot; where these differ by more than the floor's angle everywhere in two blocks, no
    pair is close enough. Blocks meet by rings around the first one's own pivot, so no all-pairs join is made.
    """
    theta = float(np.arccos(max(-1.0, min(1.0, floor)))) + 1e-6
    count = blocks.select(F.size("angles").alias("n")).first()
    at = range(count["n"] if count else 0)
    bounds = cut(blocks.groupBy("block").agg(
        F.first("pivot").alias("pivot"), F.array(*(F.min(F.get("angles", F.lit(i))) for i in at)).alias("low"),
        F.array(*(F.max(F.get("angles", F.lit(i))) for i in at)).alias("high"),
    ))

    def ring(angle):
        return F.floor(angle * (COARSE / np.pi)).cast("int")

    own = F.col("pivot") - 1
    wanted = bounds.select(
        F.col("block").alias("a"), F.col("low").alias("alow"), F.col("high").alias("ahigh"), "pivot",
        F.explode(F.sequence(ring(F.greatest(F.get("low", own) - theta, F.lit(0.0))), ring(F.least(F.get("high", own) + theta, F.lit(float(np.pi)))))).alias("ring"),
    )
    spans = F.posexplode(F.arrays_zip("low", "high")).alias("p", "z")
    offered = bounds.select(F.col("block").alias("b"), F.col("low").alias("blow"), F.col("high").alias("bhigh"), spans).select(
        "b", "blow", "bhigh", (F.col("p") + 1).alias("pivot"), F.explode(F.sequence(ring(F.col("z.low")), ring(F.col("z.high")))).alias("ring")
    )
    gap = F.array_max(F.zip_with(F.zip_with("alow", "bhigh", lambda x, y: x - y), F.zip_with("blow", "ahigh", lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    return join_back(wanted, offered, ["pivot", "ring"]).where(gap <= theta).select("a", "b").distinct()


def _pruned_best(reps: DataFrame, count: int, floor: float) -> DataFrame:
    """Best `count` others at or above `floor`, exactly: tiles of blocks that the pivots cannot keep apart.

    Two teams of blocks with such a pair are a cell, once for both directions; no pair of vectors meets twice.
    """
    blocks = cut(pivot_blocks(reps))
    places = cut(blocks.select("block", "team", "at").distinct())
    near = near_blocks(blocks, floor)
    named = near.join(places.selectExpr("block AS a", "team AS x", "at AS i"), "a").join(places.selectExpr("block AS b", "team AS y", "at AS j"), "b")
    met = named.select("x", "y", "i", "j").union(named.select("y", "x", "j", "i")).where("x <= y")
    cell = F.concat_ws("|", "x", "y").alias("cell")
    meets = cut(met.groupBy("x", "y", "i").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("meets")))
    firsts = meets.select(F.col("x").alias("team"), F.col("i").alias("at"), cell, "meets", F.lit(True).alias("first"))
    seconds = cut(met.where("x < y").select(F.col("y").alias("team"), F.col("j").alias("at"), cell, F.lit(0).cast("long").alias("meets"), F.lit(False).alias("first")).distinct())
    both = lookup(blocks.select("id", "vector", "team", "at"), firsts.union(seconds), ["team", "at"]).select("cell", "id", "vector", "at", "meets", "first")
    kind = dict(reps.dtypes)["id"]
    found = keyed(both, "cell").groupBy("cell").applyInArrow(_groups_best(count, floor), f"src {kind}, dst {kind}, score double")
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))
    return found.withColumn("place", rank).where(F.col("place") <= count).drop("place")


def nearest_neighbours(
    vectors: DataFrame, count: int = NEIGHBOURS, floor: float = FLOOR, *, method: str, bits: int = BAND_BITS
) -> DataFrame:
    """(src, dst, score, place) for vectors(id, vector): the best `count` others at or above `floor`.

    `method` is `exact`, which compares all blocks that pivots cannot keep apart, or `buckets`, which compares
    vectors whose signatures of `bits` bits differ in one bit at most in some band. Equal vectors are compared once: a group of copies is one row with its smallest ids, and each copy gets the shared
    answer back with itself left out. No bucket and no candidate list is capped.
    """
    unit = cut(vectors.select("id", l2_normalize(F.transform("vector", lambda x: x.cast("double"))).alias("vector")))
    dimensions = unit.select(F.size("vector").alias("d")).limit(1).collect()
    if not dimensions:
        kind = dict(vectors.dtypes)["id"]
        return vectors.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, score double, place int")
    if method not in ("exact", "buckets"):
        raise ValueError("method is exact or buckets")
    exact = method == "exact"

    marked = unit.withColumn("copy", F.struct(F.xxhash64(F.lit(1), "vector").alias("a"), F.xxhash64(F.lit(2), "vector").alias("b")))
    nth = F.row_number().over(W.partitionBy("copy").orderBy("id"))
    heads = (
        marked.withColumn("nth", nth)
        .where(F.col("nth") <= count + 1)
        .groupBy("copy")
        .agg(F.min("id").alias("rep"), F.min_by("vector", "id").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))
    )
    heads = cut(heads)
    reps = heads.select(F.col("rep").alias("id"), "vector")
    if exact:
        near = _pruned_best(reps, count, floor)
    else:
        signed = reps.select("id", "vector", F.posexplode(signature("vector", dimensions[0].d, bits)).alias("band", "bits"))
        near = _bucket_best(half_signatures(signed, bits), count, floor)

    members = heads.select(F.col("rep").alias("dst"), "ids")
    spread_out = near.join(members, "dst").select("src", F.explode("ids").alias("dst"), "score")
    own = heads.where(F.size("ids") > 1).select(
        F.col("rep").alias("src"), F.explode("ids").alias("dst"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).alias("score")
    ).where(F.col("score") >= floor)
    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("score"), "dst"))
    answers = (
        spread_out.unionByName(own)
        .withColumn("place", place)
        .where(F.col("place") <= count + 1)
        .groupBy("src")
        .agg(F.sort_array(F.collect_list(F.struct("place", "dst", "score"))).alias("list"))
    )
    owner = marked.select("id", "copy").join(heads.select("copy", F.col("rep").alias("src")), "copy").select("id", "src")
    kept = F.slice(F.filter("list", lambda n: n["dst"] != F.col("id")), 1, count)
    return (
        join_back(owner, answers, ["src"])
        .select(F.col("id").alias("src"), F.posexplode(kept).alias("at", "n"))
        .select("src", F.col("n.dst").alias("dst"), F.round("n.score", 6).alias("score"), (F.col("at") + 1).alias("place"))
    )
