"""Near-duplicate documents: b-bit MinHash with bands, then full shingle sets.

1. Every text becomes its set of five-word shingles, band keys over the minima, and a signature
   of 4 low bits of each of the 192 minima. Equal sets are one class.
2. In every band bucket each class is paired with the least class. Pairs whose similarity, as
   estimated from the signatures and corrected for chance collisions, comes near the threshold
   are decided on full sets, and the links give first components.
3. What is left are pairs between components inside a bucket. Members of its largest component
   need no comparison with each other; the others are compared with all, in blocks of bounded
   size: first by estimate, each pair in the first band that it shares, then on full sets. A
   block returns only links that join components.

The threshold sets the bands, so that at exactly this similarity no band agrees in less than one
of a million pairs: 32 bands of 6 minima for 0.85 and 38 of 5 for 0.80, each with 3 of 10 million.
The estimate is 5 of its deviations too low about as seldom.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewell.llm.common import mix, runs, shingle_sets, slim
from casewell.llm.components import components
from casewell.session import stage

MINIMA, ROWS, LOW_BITS = 192, 6, 4
MISSED = 1e-6
PACKED = MINIMA * LOW_BITS // 64
BLOCK = 512
VOLUME = 200_000
_RANDOM = np.random.default_rng(1914)
_TIMES = _RANDOM.integers(1, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_ROW = _RANDOM.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), 4096):
        part = short[start : start + 4096]
        np.minimum(least, (part * _TIMES[:, None] + _PLUS[:, None]).min(1), out=least)
    return least


def missed(least: float, rows: int) -> float:
    """Share of pairs of similarity `least` that agree in no band of `rows` minima."""
    return (1 - least**rows) ** (MINIMA // rows)


def band_rows(percent: int) -> int:
    """Minima per band, at most `ROWS`, with which less than `MISSED` of the pairs at the threshold are missed."""
    return max((r for r in range(1, ROWS + 1) if missed(percent / 100, r) < MISSED), default=1)


def band_keys(least: np.ndarray, rows: int) -> np.ndarray:
    """A key per band of `rows` minima; the band's number is part of it."""
    bands = MINIMA // rows
    cells = least[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    return mix((mix(cells) * _ROW[:rows]).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def packed_bits(least: np.ndarray) -> np.ndarray:
    """Four bits of each (spread) minimum, sixteen to a word."""
    bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - LOW_BITS)).astype(np.uint64).reshape(-1, PACKED, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64)


def estimate(differing: np.ndarray | float) -> np.ndarray | float:
    """Similarity from the number of differing low-bit groups, without chance agreements."""
    chance = 1 / (1 << LOW_BITS)
    return ((1 - differing / MINIMA) - chance) / (1 - chance)


def most_differing(least: float) -> int:
    """Differing groups up to which a pair is looked at: five deviations below `least`."""
    chance = 1 / (1 << LOW_BITS)
    agree = least + (1 - least) * chance
    return int(np.floor(MINIMA * (1 - agree + 5 * np.sqrt(agree * (1 - agree) / MINIMA))))


def signatures(df: DataFrame, key: str, text: str, rows: int) -> DataFrame:
    """key, n_shingles, set_key (two longs that name the set), bits, bands; null without words."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_shingles bigint, set_a bigint, set_b bigint, bits array<bigint>, bands array<bigint>"

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start, end, data, bounds in runs(frame.column(1)):
                sets = shingle_sets(data, bounds)
                least = np.stack([minima(s) for s in sets])
                empty = np.asarray([not len(s) for s in sets])
                name_a = [int(np.add.reduce(mix(s), dtype=np.uint64)) for s in sets]
                name_b = [int(np.add.reduce(mix(s * _ROW[0]), dtype=np.uint64)) for s in sets]
                longs = lambda x, w: pa.ListArray.from_arrays(
                    pa.array(np.arange(0, x.size + 1, w, dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64)), mask=pa.array(empty)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        frame.column(0).slice(start, end - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.asarray(name_a, np.uint64).view(np.int64), mask=empty),
                        pa.array(np.asarray(name_b, np.uint64).view(np.int64), mask=empty),
                        longs(packed_bits(least), PACKED),
                        longs(band_keys(least, rows), MINIMA // rows),
                    ],
                    names=[key, "n_shingles", "set_a", "set_b", "bits", "bands"],
                )

    return slim(df, key, text).mapInArrow(task, schema)


def differing(a: str, b: str) -> Column:
    """Number of differing low-bit groups of two packed signatures."""
    return F.expr(
        f"aggregate(zip_with({a}, {b}, (x, y) -> x ^ y), 0, (n, x) -> n + "
        "bit_count((x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2) | shiftrightunsigned(x, 3)) & 1229782938247303441L))"
    )


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start, end, data, bounds in runs(frame.column(1)):
                sets = [s.view(np.int64) for s in shingle_sets(data, bounds)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(start, end - start), lists], names=["id", "items"])

    kind = docs.schema[key].dataType.simpleString()
    return slim(docs, key, text).mapInArrow(task, f"id {kind}, items array<bigint>")


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    sets = stage(_sets(docs.join(wanted, key, "left_semi"), key, text), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("_y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_x", "_y"))
    return both.filter(100 * common >= percent * (F.size("_x") + F.size("_y") - common)).select("a", "b").distinct()


def _block_links(
    ids: np.ndarray, role: np.ndarray, comp: np.ndarray, bits: np.ndarray, bands: np.ndarray,
    items: list[np.ndarray], bucket: int, limit: int, percent: int,
) -> list[tuple[int, int]]:
    """Links of one block of a bucket between components that nothing in the block joins yet."""
    comp = comp.copy()
    band = int(np.flatnonzero(bands[0] == bucket)[0])
    found = []
    for i in np.flatnonzero(role != 2):
        # Both sides of a block pair hold rows to compare; inside one block each pair once.
        other = (role == 2) if role[i] == 1 else (ids > ids[i])
        at = np.flatnonzero(other & (comp != comp[i]))
        x = bits[at] ^ bits[i]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        apart = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1)
        near = (apart <= limit) & ~(bands[at, :band] == bands[i, :band]).any(1)
        for j in at[near][np.argsort(apart[near], kind="stable")]:
            if comp[j] == comp[i]:
                continue
            common = len(np.intersect1d(items[i], items[j], assume_unique=True))
            if 100 * common >= percent * (len(items[i]) + len(items[j]) - common):
                found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                comp[comp == comp[j]] = comp[i]
    return found


def _links_of_blocks(limit: int, percent: int):
    """`_block_links` over the blocks of a sorted partition; the block that a batch cuts waits."""
    n_bands = MINIMA // band_rows(percent)

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: pa.Table, last: bool) -> tuple[pa.Table, list[tuple[int, int]]]:
            keys = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in ("bucket", "kind", "x", "y")])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            edges = [0, *cuts.tolist(), *([len(keys)] if last else [])]
            column = {c: table.column(c).combine_chunks() for c in ("bits", "bands", "items")}
            ids, role, comp = (table.column(c).to_numpy() for c in ("id", "role", "component"))
            bits = column["bits"].flatten().to_numpy().view(np.uint64).reshape(-1, PACKED)
            bands = column["bands"].flatten().to_numpy().reshape(-1, n_bands)
            ends = np.concatenate([[0], np.cumsum(column["items"].value_lengths().to_numpy())])
            values = column["items"].flatten().to_numpy()
            found = []
            for low, high in zip(edges, edges[1:], strict=False):
                if high - low > 1:
                    items = [values[ends[k] : ends[k + 1]] for k in range(low, high)]
                    own = slice(low, high)
                    found += _block_links(ids[own], role[own], comp[own], bits[own], bands[own], items, keys[low, 0], limit, percent)
            return table.slice(edges[-1]), found

        waiting = None
        for frame in frames:
            table = pa.Table.from_batches([frame])
            waiting, found = links(table if waiting is None else pa.concat_tables([waiting, table]), False)
            yield _link_batch(found, frame.schema.field("id").type)
        if waiting is not None and waiting.num_rows:
            yield _link_batch(links(waiting, True)[1], waiting.schema.field("id").type)

    return task


def _link_batch(found: list[tuple[int, int]], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], kind) for i in (0, 1)], names=["a", "b"])


def residual_links(
    members: DataFrame, labels: DataFrame, sketches: DataFrame, docs: DataFrame, key: str, text: str, percent: int
) -> DataFrame:
    """Links that the first components leave open.

    `members` (bucket, id), without the pivots, which were compared with all. A block holds
    about `VOLUME` shingles of loose rows at most, and as many of the rows they meet.
    """
    own = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = own.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))
    open_ = sizes.groupBy("bucket").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"),
        F.max(F.struct("n", "component", "volume")).alias("most"),
        F.sum("n").alias("all"),
        F.sum("volume").alias("volume"),
    ).filter("all > most.n")
    blocks = lambda n, volume: F.ceil(F.greatest(n / BLOCK, volume / VOLUME)).cast("int")
    counts = open_.select(
        "bucket",
        "main",
        blocks(F.col("all") - F.col("most.n"), F.col("volume") - F.col("most.volume")).alias("loose_blocks"),
        blocks(F.col("most.n"), F.col("most.volume")).alias("settled_blocks"),
    )
    opened = stage(own.join(counts, "bucket"), "open")
    sets = stage(_sets(docs.join(opened.select(F.col("id").alias(key)).distinct(), key, "left_semi"), key, text), "sets")
    joined = opened.join(sketches.select("id", "bits", "bands"), "id").join(sets, "id")
    place = F.col("place")
    placed = joined.withColumn("loose", F.col("component") != F.col("main")).withColumn(
        "place",
        F.pmod(F.xxhash64("id"), F.when(F.col("loose"), F.col("loose_blocks")).otherwise(F.col("settled_blocks"))).cast("int"),
    )
    # Role 0: inside one loose block; 1 and 2: the two sides of a pair of blocks.
    def cell(kind, x, y, role):
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), F.lit(role).alias("role"))

    loose, settled = F.sequence(F.lit(0), F.col("loose_blocks") - 1), F.sequence(F.lit(0), F.col("settled_blocks") - 1)
    lower = F.transform(F.filter(loose, lambda k: k < place), lambda k: cell(1, k, place, 2))
    upper = F.transform(F.filter(loose, lambda k: k > place), lambda k: cell(1, place, k, 1))
    main = F.transform(settled, lambda k: cell(2, place, k, 1))
    against = F.transform(loose, lambda k: cell(2, k, place, 2))
    cells = F.when(F.col("loose"), F.concat(F.array(cell(0, place, place, 0)), lower, upper, main)).otherwise(against)
    dealt = placed.select("bucket", "id", "component", "bits", "bands", "items", F.explode(cells).alias("cell")).select(
        "bucket", "id", "component", "bits", "bands", "items", "cell.*"
    )
    kind = members.schema["id"].dataType.simpleString()
    block = ["bucket", "kind", "x", "y"]
    task = _links_of_blocks(most_differing(percent / 100), percent)
    return dealt.repartition(*block).sortWithinPartitions(*block).mapInArrow(task, f"a {kind}, b {kind}").distinct()


def shared_keys(known: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Links (a, b) between the names of the classes that one key is in."""
    own = ["set_a", "set_b", "n_shingles"]
    ends = known.groupBy(key).agg(F.min(F.struct(*own)).alias("_least"), F.max(F.struct(*own)).alias("_most"))
    several = known.join(ends.filter("_least <> _most").select(key), key, "left_semi").select(key, *own).distinct()
    names = several.join(classes, own).select(key, F.col("id").alias("b"))
    least = names.groupBy(key).agg(F.min("b").alias("a"))
    return names.join(least, key).filter("a < b").select("a", "b").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per row of `df`: `key`, `n_shingles`, `component_id`, `kept`.

    `component_id` is the least key reachable over links of at least `percent` per cent
    similarity. Texts that are null, empty or blank have an empty set and are linked with
    nothing. A row without a key is linked with nothing, has no component and is kept. Rows
    that share a key are one document: what links one of them links the others. The key is an
    integer.
    """
    rows = stage(signatures(df, key, text, band_rows(percent)), "signatures")
    known = rows.filter(F.col(key).isNotNull() & F.col("set_a").isNotNull())
    # Equal sets are one class, named by its least key.
    classes = stage(
        known.groupBy("set_a", "set_b", "n_shingles").agg(F.min(key).alias("id")), "classes"
    )
    chosen = known.join(
        classes.select(F.col("id").alias(key), "set_a", "set_b", "n_shingles"), [key, "set_a", "set_b", "n_shingles"], "left_semi"
    )
    sketches = stage(
        chosen.select(F.col(key).alias("id"), F.col("n_shingles").alias("size"), "bits", "bands").dropDuplicates(["id", "bands"]),
        "sketches",
    )
    banded = sketches.select("id", "size", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("_last")).filter("pivot < _last")
    members = stage(banded.join(shared.select("bucket", "pivot"), "bucket").filter("id <> pivot"), "members")
    bits = sketches.select("id", "bits")
    stars = members.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    near = stage(
        stars.join(bits.select(F.col("id").alias("a"), F.col("bits").alias("_p")), "a")
        .join(bits.select(F.col("id").alias("b"), F.col("bits").alias("_q")), "b")
        .filter(differing("_p", "_q") <= most_differing(percent / 100))
        .select("a", "b"),
        "stars",
    )
    first = stage(confirmed(near, df, key, text, percent), "links")
    rest = residual_links(members.drop("pivot"), components(first), sketches, df, key, text, percent)
    final = components(first.unionByName(rest).unionByName(shared_keys(known, classes, key))).withColumnRenamed("component", "_component")
    named = classes.join(final, "id", "left").withColumn("component", F.coalesce("_component", "id"))
    out = rows.join(named.select("set_a", "set_b", "n_shingles", "component"), ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col(key).isNull(), F.lit(None)).otherwise(F.coalesce("component", key))
    return out.select(
        key, "n_shingles", component.alias("component_id"),
        (F.col(key).isNull() | (F.col(key) == component)).alias("kept"),
    )
