"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has bit i set if more than half of the document's shingle hashes do.
Two fingerprints within radius r share a variant within r/2 of both (of an odd
radius, within the half rounded down of one and rounded up of the other), so every
distinct fingerprint emits all its variants within half the radius, variants are
shuffled, and colliding pairs are deduplicated and verified.

What travels in the shuffle is not the 2,081 variants of a 64-bit fingerprint but
the fingerprint: partitions are prefixes of the variants, a fingerprint goes once
to each prefix that one of its variants has (prefixes within r/2 bits of its own),
and there those of its variants that have this prefix are made. The length of the
prefix follows the number of distinct fingerprints, so the variants of a partition
stay bounded, and the copies of a fingerprint grow as the square of the logarithm.

Fingerprints that share a variant are within r of the one that is nearest to it,
so a partition may return a spanning forest of its verified pairs instead of all of
them: components lose nothing, and a large group of near copies costs a link per
member.

One fingerprint of 64 bits misses most pairs of documents whose shingle sets have a
similarity of 0.8: they differ in ten bits or so. ``similar_documents`` therefore takes
several short independent fingerprints of the set of a document's shingles, finds the
pairs within the radius in any of them by the same balls, and verifies these pairs on
the bits of all fingerprints together, whose distance follows from the similarity. As
links may be refused there, a partition returns a spanning forest of least distances.

Defined results: null text is the empty text; texts without words have fingerprint
zero, which links like any other; rows that repeat join one component; a row with
a null id stays in its component and names it only if none of its rows has an id;
a text of any length is taken whole; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphspark.llm._batches import avalanche, column, slices, utf8
from graphspark.llm._salting import join_groups
from graphspark.operators.connectivity import component_labels
from graphspark.session import ensure_importable, materialize, release

#: Variants that one partition of the shuffle is meant to hold.
PART = 1_500_000


def shingle_hashes(text: bytes, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words, lower-cased in A-Z, joined by spaces; repeats included."""
    import xxhash

    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], dtype=np.uint64)
    line = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(line[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """64 flags from the highest bit on: set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return ones * 2 > len(hashes)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set if set in over half the hashes."""
    return int.from_bytes(np.packbits(majority(hashes)).tobytes(), "big")


def short_fingerprints(hashes: np.ndarray, sketches: int, bits: int) -> list[int]:
    """Fingerprints of ``bits`` bits of the set of hashes: the majority bits of the hashes, then of the hashes mixed anew, cut up."""
    hashes = np.unique(hashes)
    rounds = -(-sketches * bits // 64)
    flags = np.concatenate([majority(mixed(hashes, k) if k else hashes) for k in range(rounds)])[: sketches * bits]
    return [int.from_bytes(np.packbits(part).tobytes(), "big") >> -bits % 8 for part in flags.reshape(sketches, bits)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, sketches: int = 1, bits: int = 64) -> DataFrame:
    """id and ``fp``, the fingerprint as a signed long; with several ``sketches``, id and ``fps``, an array of short ones."""
    ensure_importable(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = source.schema["__id"].dataType
    out = pa.int64() if sketches == 1 else pa.list_(pa.int64())
    schema = pa.schema([("__id", to_arrow_type(kind)), ("fp", out)])

    def printed(batches):
        for batch in slices(batches, "__text"):
            found = np.empty((batch.num_rows, sketches), dtype=np.uint64)
            for i, text in enumerate(utf8(batch, "__text")):
                h = shingle_hashes(text, words)
                found[i] = fingerprint(h) if sketches == 1 else short_fingerprints(h, sketches, bits)
            flat = pa.array(found.view(np.int64).reshape(-1))
            own = flat if sketches == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, sketches, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), own], schema=schema)

    found = source.mapInArrow(printed, f"__id {kind.simpleString()}, fp {'long' if sketches == 1 else 'array<long>'}")
    return found.withColumnsRenamed({"__id": id_col} if sketches == 1 else {"__id": id_col, "fp": "fps"})


def mixed(hashes: np.ndarray, sketch: int) -> np.ndarray:
    """The hashes of another sketch."""
    return avalanche(hashes + np.uint64(sketch * 0x9E3779B97F4A7C15 % (1 << 64)))


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` low bits with at most ``radius`` set."""
    masks = [sum(1 << b for b in chosen) for r in range(min(radius, bits) + 1) for chosen in combinations(range(bits), r)]
    return np.array(masks, dtype=np.uint64)


def spanning_forest(pairs: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """Those of ``pairs`` (two columns of node numbers) that make up a spanning forest of least distances: every component takes
    its nearest pair to another one, until none is left."""
    pairs = pairs[np.argsort(distance, kind="stable")]
    parent, left, chosen = np.arange(n), np.arange(len(pairs)), []
    while len(left):
        a, b = parent[pairs[left, 0]], parent[pairs[left, 1]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        best = np.full(n, len(pairs))
        np.minimum.at(best, a, left)
        np.minimum.at(best, b, left)
        taken = np.unique(best[best < len(pairs)])
        chosen.append(taken)
        todo = pairs[taken]
        while len(todo):  # hook along the pairs taken, then jump
            x, y = parent[todo[:, 0]], parent[todo[:, 1]]
            todo, x, y = todo[x != y], x[x != y], y[x != y]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    return pairs[np.concatenate(chosen)] if chosen else pairs


def colliding(fps: np.ndarray, prefix: int, prefix_bits: int, radius: int, bits: int = 64, chains: bool = False) -> np.ndarray:
    """Links, as two columns of fingerprints, between those of ``fps`` that share a variant with this prefix. Those of a variant
    are compared with its first one, with ``chains`` also each with the next, as the first may be refused later."""
    half, low_bits = (radius + 1) // 2, bits - prefix_bits
    fps = np.unique(fps)
    low_mask = np.uint64((1 << low_bits) - 1)
    away = np.bitwise_count((fps >> np.uint64(low_bits)) ^ np.uint64(prefix)) if prefix_bits else np.zeros(len(fps), dtype=np.uint8)
    slots, owners, far = [], [], []
    for used in range(half + 1):  # bits spent on the prefix; the rest may go to the low bits
        at = np.flatnonzero(away == used)
        masks = ball(low_bits, half - used)
        slots.append(((fps[at] & low_mask)[:, None] ^ masks[None, :]).reshape(-1))
        owners.append(np.repeat(at.astype(np.int32), len(masks)))
        if radius % 2:
            far.append(np.tile(np.bitwise_count(masks) + used > radius // 2, len(at)))
    slot, owner = np.concatenate(slots), np.concatenate(owners)
    del slots, owners
    if radius % 2:  # the owners that are nearer to a variant come first
        far = np.concatenate(far)
        order = np.lexsort((far, slot))
        far = far[order]
    else:
        order = np.argsort(slot)
    slot, owner = slot[order], owner[order]
    same = np.concatenate(([False], slot[1:] == slot[:-1]))[: len(slot)]
    hub = np.maximum.accumulate(np.where(same, 0, np.arange(len(slot))))
    other = np.flatnonzero(same & ~far[hub]) if radius % 2 else np.flatnonzero(same)
    if not len(other):
        return np.zeros((0, 2), dtype=np.uint64)
    a, b = owner[hub[other]], owner[other]
    if chains:
        a, b = np.concatenate([a, owner[other - 1]]), np.concatenate([b, b])
    keys = np.unique(np.minimum(a, b) * np.int64(len(fps)) + np.maximum(a, b))
    pairs = np.stack([keys // len(fps), keys % len(fps)], axis=1)
    distance = np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]])
    near = distance <= radius
    return fps[spanning_forest(pairs[near], distance[near], len(fps))]


def links_under(fps: np.ndarray, prefix: int, prefix_bits: int, radius: int, bits: int = 64, part: int = PART, chains: bool = False) -> np.ndarray:
    """As ``colliding``, in memory of about ``part`` variants: a prefix that too many fingerprints reach is gone through in halves."""
    half = (radius + 1) // 2
    if prefix_bits:
        fps = fps[np.bitwise_count((fps >> np.uint64(bits - prefix_bits)) ^ np.uint64(prefix)) <= half]
    low = bits - prefix_bits
    close = np.count_nonzero(fps >> np.uint64(low) == np.uint64(prefix)) if prefix_bits else len(fps)
    if close * len(ball(low, half)) > 2 * part and prefix_bits < bits // 2:
        return np.concatenate([links_under(fps, prefix * 2 + b, prefix_bits + 1, radius, bits, part, chains) for b in (0, 1)])
    return colliding(fps, prefix, prefix_bits, radius, bits, chains)


def near_links(distinct: DataFrame, radius: int = 4, bits: int = 64, part: int = PART, group: int = PART) -> DataFrame:
    """Links (a, b) that connect all fingerprints of column ``fp`` (distinct longs) within ``radius``, or a forest of them per
    partition; with a column ``sketch``, among the fingerprints of each sketch, and (sketch, a, b). Prefixes of the shuffle
    have ``group`` variants or so, which are gone through by ``part`` at a time."""
    spark = distinct.sparkSession
    ensure_importable(spark)
    many = "sketch" in distinct.columns
    n, half = distinct.groupBy("sketch").count().agg(F.max("count")).first()[0] or 0 if many else distinct.count(), (radius + 1) // 2
    variants = n * len(ball(bits, half))
    prefix_bits = min(20, max(0, (variants // group).bit_length()))
    near, low = ball(prefix_bits, half), np.uint64(bits - prefix_bits)
    sent_schema = pa.schema([("sketch", pa.int32()), ("prefix", pa.int64()), ("fps", pa.binary())])

    def deal(sketch: int, fps: np.ndarray) -> pa.RecordBatch:
        """The fingerprints of one prefix, as bytes, to every prefix that one of their variants has."""
        fps = np.sort(fps)
        own = fps >> low if prefix_bits else np.zeros(len(fps), dtype=np.uint64)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        cuts = np.append(first, len(fps)) * 8
        data = fps.tobytes()
        bodies = pa.array([data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
        prefixes = (own[first][:, None] ^ near[None, :]).reshape(-1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(prefixes), sketch), pa.int32()), pa.array(prefixes), bodies.take(pa.array(np.repeat(np.arange(len(first)), len(near))))], schema=sent_schema)

    def dealt(batches):
        held: dict[int, list[np.ndarray]] = {}
        rows = 0
        for batch in batches:
            fps = np.ascontiguousarray(column(batch, "fp").to_numpy()).view(np.uint64)
            of = column(batch, "sketch").to_numpy()
            for k in np.unique(of).tolist():
                held.setdefault(k, []).append(fps[of == k])
            rows += len(fps)
            if rows > DEALT:
                for k, parts in held.items():
                    yield deal(k, np.concatenate(parts))
                held, rows = {}, 0
        for k, parts in held.items():
            yield deal(k, np.concatenate(parts))

    sent = distinct.select(F.col("sketch").cast("int") if many else F.lit(0).alias("sketch"), "fp").mapInArrow(dealt, "sketch int, prefix long, fps binary")
    schema = pa.schema([("sketch", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def met(key, table):
        fps = np.unique(np.frombuffer(b"".join(table.column("fps").to_pylist()), dtype=np.uint64))
        links = np.ascontiguousarray(links_under(fps, key[1].as_py(), prefix_bits, radius, bits, part, many)).view(np.int64)
        return pa.Table.from_arrays([pa.array(np.full(len(links), key[0].as_py()), pa.int32()), pa.array(links[:, 0]), pa.array(links[:, 1])], schema=schema)

    links = sent.groupBy("sketch", "prefix").applyInArrow(met, "sketch int, a long, b long")
    return links if many else links.select("a", "b")


#: Fingerprints that a task deals at a time.
DEALT = 200_000


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words: int = 4) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id, the least id reachable."""
    printed = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    firsts = materialize(printed.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "fps")
    labels = materialize(component_labels(near_links(firsts.select("fp"), radius)), "labels")
    # The least id of a component of several fingerprints, then of every fingerprint.
    linked = firsts.join(labels, firsts["fp"] == labels["node"])
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    named = firsts.join(labels.join(least, "label").select(F.col("node").alias("fp"), "least"), "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"))
    return join_groups(printed, named, "fp", per_key=ROWS_PER_KEY).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Documents of one fingerprint that get their component under one key: a larger group is dealt over several.
ROWS_PER_KEY = 1_000_000


#: Variants under one prefix of the shuffle for several sketches: fewer prefixes, so fewer copies of a fingerprint.
GROUP = 32 * PART


def expected_distance(similarity: float, bits: int) -> int:
    """Bits by which the fingerprints of two sets of this similarity differ at most: the mean and half a standard deviation."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi  # of sets of equal size
    return int(bits * share + np.sqrt(bits * share * (1 - share)) / 2)


def similar_documents(docs: DataFrame, row_col: str, text_col: str = "text", radius: int = 4, words: int = 5, sketches: int = 12, bits: int = 48, similarity: float = 0.8) -> DataFrame:
    """(row_col, component) of rows that are numbered by ``row_col`` (distinct longs): the least number reachable over documents
    one of whose ``sketches`` short fingerprints are within ``radius`` and all of them together within the distance that sets
    of this ``similarity`` have.

    Rows of equal fingerprints are one class, named by its least row. A fingerprint that several classes have links them to
    the least of these, and near fingerprints link the least classes that have them, so links are few and no pairs are listed.
    """
    printed = materialize(fingerprints(docs, row_col, text_col, words, sketches, bits), "fingerprints")
    classes = materialize(printed.groupBy("fps").agg(F.min(row_col).alias("first"), F.count("*").alias("n")), "classes")
    each = classes.select("first", F.posexplode("fps").alias("sketch", "fp"))
    owners = materialize(each.groupBy("sketch", "fp").agg(F.min("first").alias("owner"), F.count("*").alias("n")), "owners")
    near = materialize(near_links(owners.select("sketch", "fp"), radius, bits, group=GROUP), "near")
    a, b = (owners.select("sketch", F.col("fp").alias(x), F.col("owner").alias(f"own_{x}")) for x in ("a", "b"))
    by_near = near.join(a, ["sketch", "a"]).join(b, ["sketch", "b"]).select(F.col("own_a").alias("a"), F.col("own_b").alias("b"))
    pairs = by_near.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a, b = (classes.select(F.col("first").alias(x), F.col("fps").alias(f"fps_{x}")) for x in ("a", "b"))
    apart = F.aggregate(F.zip_with("fps_a", "fps_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    verified = pairs.join(a, "a").join(b, "b").where(apart <= expected_distance(similarity, sketches * bits)).select("a", "b")
    shared = each.join(owners.where("n > 1").select("sketch", "fp", "owner"), ["sketch", "fp"]).select(F.col("first").alias("a"), F.col("owner").alias("b"))
    labels = component_labels(verified.unionByName(shared.where("a <> b")))
    named = classes.join(labels, F.col("first") == F.col("node"), "left").select("fps", "n", F.coalesce("label", "first").alias("component"))
    out = materialize(join_groups(printed, named, "fps", per_key=ROWS_PER_KEY).select(row_col, "component"), "components")
    release(printed, classes, owners, near)
    return out
