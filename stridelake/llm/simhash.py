"""SimHash near-duplicate groups with bit-sliced comparison.

Fingerprints are compared only inside buckets that agree on two of four
16-bit blocks: two fingerprints at most two bits apart leave at least two
blocks untouched, so every link falls into one of the six tables of block
pairs and none is lost.  Inside a block of rows the 64 bit planes are stored
vertically; one pass over the planes updates the distances of many rows at
once in carry-save bit counters, and a block is abandoned as soon as every
counter has passed the radius.

Edge cases: null or blank text has fingerprint zero and links like any other
fingerprint; repeated rows share a fingerprint; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import connected_components, materialize, merge_labels, scratch, small_batches, small_side, trimmed, unused, written

RADIUS = 2
#: Rows of one bit-sliced block; a fuller bucket is compared chunk by chunk.
CHUNK = 1024
BATCH_ROWS = 192


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    width = min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist())), np.uint64, len(tokens) - width + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long), one row per input row."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def near_pairs(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Forest of links between the rows of one block: ``(row, row)`` with
    Hamming distance at most ``radius``, enough to connect all that link.

    ``fps`` holds one row of 64-bit words per fingerprint.  ``planes[b]`` holds
    bit ``b`` of every row, packed; ``counters`` are bit-sliced sums, ``over``
    marks rows beyond the radius.
    """
    fps = fps.reshape(len(fps), -1)
    n = len(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8), axis=1, bitorder="little")
    planes = np.packbits(bits.T, axis=1, bitorder="little")
    width = 8 * planes.shape[1]
    levels = max(1, int(radius).bit_length())
    label = np.arange(n)
    for at in range(0, n, BATCH_ROWS):
        own = bits[at : at + BATCH_ROWS]
        # Padding, the row itself and the rows before it, which met it already,
        # count as beyond the radius, so that a block without links is abandoned.
        done = np.tri(len(own), width, at, np.uint8)
        done[:, n:] = 1
        over = np.packbits(done, axis=1, bitorder="little")
        counters = [np.zeros_like(over) for _ in range(levels)]
        for b in range(len(planes)):
            carry = planes[b] ^ (own[:, b : b + 1] * np.uint8(255))
            for counter in counters:
                counter ^= carry
                carry &= ~counter
            over |= carry
            if b % 8 == 7:
                over |= _above(counters, radius)
                if (over == 255).all():
                    break
        else:
            near = np.unpackbits(~over, axis=1, bitorder="little")[:, :n]
            a, c = np.nonzero(near)
            a += at
            label = merge_labels(label, a, c)
    row = np.arange(n)
    return np.stack([row[label != row], label[label != row]], axis=1)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Rows whose bit-sliced count exceeds ``radius``."""
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], 255)
    for level in reversed(range(len(counters))):
        if radius >> level & 1:
            equal &= counters[level]
        else:
            more |= equal & counters[level]
            equal &= ~counters[level]
    return more


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``src, dst`` that connect all fingerprints within ``radius`` (at
    most 2) of each other; ``distinct`` has one row per ``fp``."""
    if radius > 2:
        raise ValueError("four blocks leave two untouched only up to radius 2")
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    tables = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = F.array(*[F.lit(t << 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j)) for t, (i, j) in enumerate(tables)])
    return compared(distinct.select(F.col("fp").alias("node"), F.explode(keys).alias("g")), None, radius)


def compared(rows: DataFrame, bits: DataFrame | None, radius: int) -> DataFrame:
    """Edges ``src, dst`` that connect all nodes of ``rows(node, g)`` that share
    a ``g`` and whose bits differ at ``radius`` places at most.  ``bits(node,
    bits)`` holds the bits; without it a node is its own 64 bits."""

    def blocks(dealt: DataFrame) -> DataFrame:
        with_bits = dealt.withColumn("bits", F.array("node")) if bits is None else dealt.join(bits, "node")

        @trimmed
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for nodes, own in _blocks(batches):
                a = near_pairs(own, radius)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a[:, 0]]), pa.array(nodes[a[:, 1]])], names=["src", "dst"])

        return with_bits.select("node", "bits", "p").repartition("p").sortWithinPartitions("p").mapInArrow(run, "src long, dst long")

    return linked_in_parts(rows.select("g", "node", F.lit(1).alias("w")), CHUNK, blocks)


def linked_in_parts(rows: DataFrame, capacity: int, blocks) -> DataFrame:
    """Edges that connect, in each group of ``rows(g, node, w, ...)``, all nodes
    that link, however large the group is.

    ``blocks`` takes rows with ``p`` and ``label`` columns and gives edges that
    connect what links within each ``p``; nodes with equal labels are connected
    already.  A group of more weight than ``capacity`` is dealt to parts that
    all hold its smallest node too, which connects most of it.  Where that
    leaves several components, the smaller ones also meet every part, and
    nothing meets again inside the largest.  So a row is copied once for each
    part of the rest, not for each part of its group.
    """
    sized = rows.groupBy("g").agg(F.count("*").alias("n"), F.ceil(F.sum("w") / capacity).cast("int").alias("parts"), F.min("node").alias("hub")).where("n > 1")
    rows = rows.join(sized.drop("n"), "g")
    share = lambda parts: F.pmod(F.xxhash64("node", "g"), parts).cast("int")
    places = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(share(F.col("parts"))))
    dealt = rows.withColumn("c", F.explode(places)).withColumn("p", F.when(F.col("parts") > 1, F.xxhash64("g", "c")).otherwise(F.col("g")))
    first = materialize(blocks(dealt.drop("parts", "hub", "c", "g", "w").withColumn("label", F.col("node"))), "links")
    crowded = rows.where("parts > 1").drop("parts", "hub")
    if crowded.isEmpty():
        return first
    named = connected_components(first).withColumnRenamed("node", "of")
    crowded = materialize(crowded.join(named, F.col("node") == F.col("of"), "left").withColumn("label", F.coalesce("component", "node")).drop("of", "component"), "crowded")
    sums = crowded.groupBy("g", "label").agg(F.sum("w").alias("w"))
    rest = sums.groupBy("g").agg(F.max_by("label", "w").alias("main"), F.max("w").alias("most"), F.sum("w").alias("all")).where("all > most")
    part = lambda c: F.ceil(c / capacity).cast("int")
    open_ = crowded.join(rest.select("g", "main", part(F.col("most")).alias("a"), part(F.col("all") - F.col("most")).alias("b")), "g")
    inside = F.col("label") == F.col("main")
    open_ = open_.withColumn("c", F.when(inside, share(F.col("a"))).otherwise(F.col("a") + share(F.col("b"))))
    open_ = open_.withColumn("o", F.explode(F.sequence(F.when(inside, F.col("a")).otherwise(0), F.col("a") + F.col("b") - 1)))
    met = open_.withColumn("p", F.xxhash64("g", F.least("c", "o"), F.greatest("c", "o")))
    return first.unionByName(materialize(blocks(met.drop("main", "a", "b", "c", "o", "g", "w")), "links"))


def _blocks(batches: Iterable[pa.RecordBatch], least: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole groups of the sorted stream, small neighbours joined into one
    block: a link found across groups is a link as well."""
    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
        new = (batch.column(2).to_numpy(), batch.column(0).to_numpy(), words.view(np.uint64))
        held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
        at = 0
        while len(held[0]) - at > least:
            cut = int(np.searchsorted(held[0], held[0][at + least - 1], "right"))
            if cut == len(held[0]):
                break
            yield _once(held[1][at:cut], held[2][at:cut])
            at = cut
        held = tuple(x[at:] for x in held)
    if held is not None and len(held[0]):
        yield _once(held[1], held[2])


def _once(nodes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(nodes, return_index=True)
    return nodes, bits[at]


def near_duplicate_groups(docs: DataFrame, words: int = 3, radius: int = RADIUS, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id reachable by links.

    A row with null doc_id takes part, but never names a component unless no
    row of its component has an id.
    """
    marked = materialize(fingerprints(docs, words, seed), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fp")
    found = connected_components(links(distinct.select("fp"), radius))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "component").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


# -- near copies by similarity -----------------------------------------------
#: Words of a fingerprint (64 bits each) and pairs of least shingle hashes that
#: bring documents together.
WIDE = 4
BANDS = 14
#: Shingles of one part of a component; a fuller one is compared part by part.
CHUNK_SHINGLES = 2_000_000


def wide_radius(similarity: float, words: int = WIDE) -> int:
    """Bits within which documents of that Jaccard similarity or more differ:
    the expected number plus six standard deviations.  The chance that one bit
    differs is exact for unions of up to 64 shingles, where ties of the
    majority count, and never less than its limit for large ones."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    law = [np.array([comb(n, k) for k in range(n + 1)]) / 2.0**n for n in range(65)]
    for union in range(1, 65):
        for own in range(int(union * (1 - similarity) + 1e-9) + 1):
            common = union - own
            for left in range(own // 2 + 1):
                right = own - left
                at = np.arange(common + 1)
                # One side's majority, given the count among the common shingles.
                one = np.array([law[left][2 * (x + np.arange(left + 1)) > common + left].sum() for x in at])
                two = np.array([law[right][2 * (x + np.arange(right + 1)) > common + right].sum() for x in at])
                share = max(share, float((law[common] * (one * (1 - two) + two * (1 - one))).sum()))
    bits = 64 * words
    return int(bits * share + 6 * np.sqrt(bits * share * (1 - share)))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``words`` words."""
    tokens = (text or "").lower().split()
    width = max(1, min(words, len(tokens)))
    digest = xxhash.xxh64_intdigest
    own = np.fromiter({digest(" ".join(tokens[k : k + width])) for k in range(max(1, len(tokens) - width + 1))}, np.uint64)
    own.sort()
    return own


def wide_fingerprint(own: np.ndarray) -> tuple[list[int], list[int]]:
    """SimHash of ``WIDE`` words, and ``BANDS`` keys, over distinct shingles."""
    fp = []
    for salt in range(WIDE):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(own), 4096):
            mixed = _mixed(own[at : at + 4096], salt)
            counts += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        fp.append(int(np.packbits(2 * counts > len(own), bitorder="little").view("<i8")[0]))
    least = np.array([_mixed(own, 100 + k).min() for k in range(2 * BANDS)], np.uint64)
    keys = _mixed(least[::2] ^ (least[1::2] * np.uint64(3)) ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(56)), 7)
    return fp, keys.view(np.int64).tolist()


def exact_pairs(bits: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int, label: np.ndarray | None = None) -> np.ndarray:
    """Forest of links ``(row, row)`` that connects all rows whose ``sets``
    (sorted, distinct) have a Jaccard similarity of at least ``similarity``;
    sets are counted where the bits differ at ``radius`` places at most, and
    where equal labels do not connect the rows already."""
    part = Fraction(str(similarity))
    size = np.array([len(x) for x in sets])
    label = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1]
    found = []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        rest = rest[label[rest] != label[i]]
        least, most = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
        rest = rest[least * part.denominator >= most * part.numerator]
        rest = rest[np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64) <= radius]
        if not len(rest):
            continue
        every = np.concatenate([sets[j] for j in rest])
        place = np.minimum(np.searchsorted(sets[i], every), size[i] - 1)
        starts = np.concatenate(([0], np.cumsum(size[rest])[:-1]))
        common = np.add.reduceat((sets[i][place] == every).astype(np.int64), starts)
        near = rest[common * part.denominator >= (size[rest] + size[i] - common) * part.numerator]
        for j in near.tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((i, j))
    return np.array(found, np.int64).reshape(-1, 2)


def exact_links(docs: DataFrame, members: DataFrame, words: int, similarity: float, radius: int) -> DataFrame:
    """Edges ``src, dst`` that connect the nodes of each component of
    ``members(node, bits, component, doc, h)`` (a written table) by exact
    Jaccard similarity; ``doc`` and ``h`` (a hash of the text) name the row of
    ``docs`` that a node's shingles are taken from."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(x.as_py(), words).view(np.int64) for x in batch.column(3)]
            size = pa.array([len(x) for x in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own, pa.list_(pa.int64())), size], names=["node", "g", "bits", "own", "w"])

    texts = docs.select(F.col("doc_id").cast("long").alias("of"), "text", F.xxhash64("text").alias("own_h"))
    wanted = small_side(members, 120)
    rows = texts.join(wanted, (F.col("own_h") == F.col("h")) & F.col("of").eqNullSafe(F.col("doc")))
    rows = materialize(rows.select("node", "component", "bits", "text").mapInArrow(run, "node long, g long, bits array<long>, own array<long>, w long"), "wide-sets")

    def blocks(dealt: DataFrame) -> DataFrame:
        @trimmed
        def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for nodes, bits, sets, label in _whole_groups(batches):
                a = exact_pairs(bits, sets, similarity, radius, label)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a[:, 0]]), pa.array(nodes[a[:, 1]])], names=["src", "dst"])

        return dealt.select("node", "bits", "own", "label", "p").repartition("p").sortWithinPartitions("p").mapInArrow(compare, "src long, dst long")

    # At least so much for a row that a part never holds too many short texts.
    return linked_in_parts(rows.withColumn("w", F.greatest("w", F.lit(CHUNK_SHINGLES // CHUNK))), CHUNK_SHINGLES, blocks)


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """``node, bits, own, label`` of each group of the sorted stream, one row a
    node."""

    def made(held: dict) -> tuple:
        rows = list(held.values())
        return np.array(list(held), np.int64), np.array([x[0] for x in rows]), [x[1] for x in rows], np.array([x[2] for x in rows])

    held: dict = {}
    last = None
    for batch in batches:
        for node, bits, own, label, p in zip(*batch.columns):
            if p.as_py() != last:
                if len(held) > 1:
                    yield made(held)
                held, last = {}, p.as_py()
            # Copied, so that a group does not hold whole batches.
            held[node.as_py()] = (bits.values.to_numpy().view(np.uint64).copy(), own.values.to_numpy().view(np.uint64).copy(), label.as_py())
    if len(held) > 1:
        yield made(held)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, component_id`` for documents whose word shingles have a Jaccard
    similarity of ``similarity`` or more; links are transitive.

    Rows that share a pair of least shingle hashes and whose wide fingerprints,
    compared bit-sliced, are not too far apart make coarse components; inside
    these the distinct shingles of the rows are compared exactly.  At 0.8 about
    one link in a million shares none of the ``BANDS`` pairs.  Rows are one node where
    128 bits over their distinct shingles agree; nodes are numbered, not hashed.

    Null and blank texts have one common shingle and are copies of each other;
    shorter texts than ``words`` have one shingle, all their words."""
    radius = wide_radius(similarity)

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, nodes = [], []
            for x in batch.column(1):
                own = shingles(x.as_py(), words)
                made.append(wide_fingerprint(own))
                nodes.append(xxhash.xxh3_128_digest(own.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array(nodes, pa.binary())], names=["doc_id", "h", "bits", "keys", "own"])

    with small_batches(docs.sparkSession):
        marked = materialize(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, bits array<long>, keys array<long>, own binary"), "wide")
        rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
        distinct = materialize(marked.groupBy("own").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits"), F.first("keys").alias("keys"), rep.alias("rep")).withColumn("node", F.monotonically_increasing_id()), "wide-fp")
        coarse = connected_components(compared(distinct.select("node", F.explode("keys").alias("g")), distinct.select("node", "bits"), radius))
        members = materialize(distinct.select("node", "bits", F.col("rep.doc_id").alias("doc"), F.col("rep.h").alias("h")).join(coarse, "node"), "members")
        found = connected_components(exact_links(docs, members, words, similarity, radius))
    rooted = distinct.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("own", "least", F.coalesce("component", "node").alias("component"))
    named = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "own").join(rooted.join(named, "component").select("own", "component_id"), "own").select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without all but one document of each near-duplicate group: the
    one with the smallest doc_id stays, once if its row is repeated; rows
    without a doc_id stay.  Only ids go through the decision; the texts meet
    its outcome once."""
    gone, of, text = unused(docs, "_gone", "_of", "_text")
    with scratch(docs.sparkSession) as result:
        groups = similar_groups(docs, words, similarity).where("doc_id is not null")
        verdict = groups.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("first"), F.count("*").alias("copies"))
        verdict = written(verdict.where("first = 0 or copies > 1"), result)
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = small_side(verdict.select(F.col("doc_id").alias(of), F.lit(True).alias(gone)), 32)
    kept = docs.join(out, F.col("doc_id") == F.col(of), "left").where(F.col(gone).isNull()).select(*names)
    again = verdict.where("first = 1").select(F.col("doc_id").alias(of))
    if again.isEmpty():
        return kept
    # Ids that several rows have: few, so their rows alone are compared by text.
    twice = docs.join(small_side(materialize(again, "again"), 24), F.col("doc_id") == F.col(of)).withColumn(text, F.xxhash64("text"))
    return kept.unionByName(twice.dropDuplicates([of, text]).select(*names))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
