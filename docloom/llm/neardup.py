"""MinHash near-duplicates: HyperMinHash registers, bands, and links confirmed on full shingle sets.

Equal sets are one class, so that copies meet once. Each class has 256 registers: the least hash in a
bucket, stored as its count of leading zeros and ten bits of mantissa. Six registers make a band, and
classes with equal bands are candidates. In a bucket of the band index

1. in a large bucket, a class's shingles that no other class of large buckets has are counted: what
   is left bounds its similarity to the others, and a class that can't reach the threshold goes;
2. every class is compared with one class of the bucket (a star, not all pairs), in the first round
   the one with the fewest shingles of its own, then another one, if they are in different
   components and likely to be linked;
3. where a bucket then still holds several components, classes of different components are compared.
   A small bucket gives pairs, which are estimated and confirmed as in the rounds. A large one is joined
   with itself, a pair in one of the large buckets that it shares: the rows carry the registers and, up
   to WHOLE shingles, the sets, so that of these only pairs that reach the threshold come out at all.

The rounds make few comparisons join most of what belongs together; the last step leaves nothing out,
and pairs of short sets that don't reach the threshold are never written anywhere. Estimates, corrected
for the registers' collisions, drop a pair only if it is five standard errors below the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import documents, keep_marked, materialise, parallelism, release, slices, sweep, text_key
from docloom.llm.components import connected_components

REGISTERS, BAND, BANDS = 256, 6, 42
MANTISSA = 10
#: Probability that two registers of different least hashes agree, with ten bits of mantissa.
COLLISION = 0.169919487159739 / 2**MANTISSA
#: Standard errors that an estimate may be off.
ERRORS = 5.0
#: Rounds of stars.
ROUNDS = 2
#: Buckets of more classes are large: there, shingles that no other class has bound the similarity first.
LARGE = 32
#: Comparisons with one class that one task makes at most; beyond, they are dealt over several.
FAN = 512
#: Sets up to this size are compared in the join itself (8 bytes a shingle in each row of it).
WHOLE = 1024
#: Rows of a bucket that one part of the last join holds on its first side.
BLOCK = 1024
#: Ids of texts to compare that are broadcast at most (8 bytes each); more are joined by a shuffle.
WANTED = 2_000_000

_BITS = 64 - (REGISTERS.bit_length() - 1)
_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_BITS)
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = np.random.Generator(np.random.PCG64(6)).integers(1, 2**63, BANDS, dtype=np.uint64)
_word_hashes: dict[bytes, int] = {}
WORD_HASHES = 100_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``width`` words, A-Z lower-cased."""
    words = text.encode().lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=width)] if words else [], np.uint64)
    if len(_word_hashes) > WORD_HASHES:
        _word_hashes.clear()
    found = list(map(_word_hashes.get, words))
    at = -1
    for _ in range(found.count(None)):
        at = found.index(None, at + 1)
        found[at] = _word_hashes[words[at]] = xxhash.xxh3_64_intdigest(words[at])
    w = np.array(found, np.uint64)
    last = len(w) - width + 1
    h = np.zeros(last, np.uint64)
    for k in range(width):
        h += w[k : k + last] * _FACTORS[k]
    return np.unique(_mix(h))


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: leading zeros and mantissa of the least hash per bucket."""
    at = np.minimum(np.searchsorted(hashes, _STARTS), len(hashes) - 1)
    least = hashes[at]
    value = least - _STARTS
    here = (least >= _STARTS) & (value < np.uint64(1 << _BITS))
    value = np.where(here, value, np.uint64(0))
    length = np.frexp(value.astype(np.float64))[1].astype(np.uint64)
    shift = np.minimum(np.uint64(65) - length, np.uint64(63))
    mantissa = (value << shift) >> np.uint64(64 - MANTISSA)
    return np.where(here, ((np.uint64(_BITS + 1) - length) << np.uint64(MANTISSA)) | mantissa, np.uint64(0)).astype(np.uint16)


def bands(regs: np.ndarray) -> list[int]:
    """Keys of the bands that are not empty; the key tells the band, too."""
    rows = regs[: BANDS * BAND].reshape(BANDS, BAND).astype(np.uint64)
    h = _BAND_SALT.copy()
    for k in range(BAND):
        h = _mix((h ^ rows[:, k]) * _FACTORS[k])
    return h[rows.any(axis=1)].view(np.int64).tolist()


def bits(regs: np.ndarray) -> list[int]:
    """One bit of each register, as 64-bit integers: sets at a similarity of s differ in half of 1 - s."""
    mixed = (regs ^ (regs >> 5) ^ (regs >> 9)) & 1
    return np.packbits(mixed.astype(np.uint8)).view(np.int64).tolist()


def most_bits(threshold: float, used: Column, errors: float = ERRORS) -> Column:
    """Differing bits of sets at the threshold that use so many registers, with so many standard errors."""
    share = (1 - threshold) / 2
    return used * share + errors * F.sqrt(used * share * (1 - share))


def corrected(share):
    """The similarity that a share of equal registers stands for (a column or numbers): some unlike ones collide."""
    return (share - COLLISION) / (1 - COLLISION)


def least_estimate(threshold: float, used: Column, smaller: Column) -> Column:
    """The estimate that a pair at the threshold does not fall below, ERRORS standard errors allowed.

    The registers used are a sample without replacement of a union that has at most
    ``smaller / threshold`` members, so short texts, whose sets the registers nearly hold, are
    estimated with less error.
    """
    left_out = F.greatest(F.lit(0.05), 1 - used * threshold / F.greatest(smaller, F.lit(1)))
    return threshold - ERRORS * F.sqrt(threshold * (1 - threshold) * left_out / F.greatest(used, F.lit(1)))


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    types = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("u", pa.int64()), ("regs", pa.binary()), ("bits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                hashes = shingles(text.as_py(), width)
                if len(hashes):
                    digest, regs = xxhash.xxh3_128_digest(hashes.tobytes()), registers(hashes)
                    row = (len(hashes), *np.frombuffer(digest, "<i8").tolist(), int(np.count_nonzero(regs)), regs.tobytes(), bits(regs), bands(regs))
                else:
                    row = (0, 0, 0, 0, None, None, None)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t.type) for c, t in zip(columns, list(types)[2:], strict=True))], schema=types)

    found = documents(docs).withColumn("text_hash", text_key(F.col("text"))).mapInArrow(run, "doc_id long, text_hash long, n long, h1 long, h2 long, u long, regs binary, bits array<long>, bands array<long>")
    return found.withColumn("row", F.monotonically_increasing_id())


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the registers' estimate lets through."""
    regs = lambda name: classes.select(F.col("node").alias(name), F.col("regs").alias(f"regs_{name}"), F.col("n").alias(f"n_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3))
            used = ((a != 0) | (b != 0)).sum(axis=1)
            similar = corrected(((a == b) & (a != 0)).sum(axis=1) / np.maximum(used, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(similar), pa.array(used.astype(np.int32))], ["a", "b", "smaller", "similar", "used"])

    joined = pairs.join(regs("a"), "a").join(regs("b"), "b").select("a", "b", "regs_a", "regs_b", F.least("n_a", "n_b").alias("smaller"))
    found = joined.mapInArrow(run, "a long, b long, smaller long, similar double, used int")
    return found.where(F.col("similar") >= least_estimate(percent / 100, F.col("used"), F.col("smaller"))).select("a", "b")


def _texts(docs: DataFrame, named: DataFrame) -> DataFrame:
    """``named`` (_id and others, a written table) with the text of every document that has the id."""
    read, ids = documents(docs), named.select(F.col("_id").alias("_w")).distinct()
    if ids.count() <= WANTED:  # few enough to send to every task, so that other texts stay where they are
        read = read.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_w")), "left_semi")
    return read.join(named, F.col("doc_id").eqNullSafe(F.col("_id")))


def _read(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int, row: Callable[[int, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``row(node, shingles)`` of every class of ``nodes``, read from the text of one of its documents."""
    named = materialise(nodes.join(classes.select("node", "doc_id", "h1", "h2"), "node").select(F.col("doc_id").alias("_id"), "node", "h1", "h2"), "open-classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # of ids that occur several times in this task
        for batch in slices(batches):
            for node, h1, h2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes = shingles(text, width)
                if node in done or np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist() != [h1, h2]:
                    continue
                done.add(node)
                yield row(node, hashes)

    return _texts(docs, named).select("node", "h1", "h2", "text").mapInArrow(run, schema)


def _alone(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, alone): how many of a class's shingles no other class of ``nodes`` has; rows only where some are alone.

    What two classes have in common can't exceed what either shares with any class, so this bounds
    their similarity from above, and never wrongly: shingles whose hashes collide count as shared.
    """

    def row(node: int, hashes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), node, np.int64)), pa.array(hashes.view(np.int64))], ["node", "shingle"])

    each = _read(nodes, classes, docs, width, row, "node long, shingle long")
    single = each.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    return materialise(single.groupBy("node").agg(F.count("*").alias("alone")), "alone")


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, places, shingles): the registers that are not empty, each with its place, and the whole set
    up to WHOLE shingles, else null."""

    def row(node: int, hashes: np.ndarray) -> pa.RecordBatch:
        regs = registers(hashes)
        places = (np.flatnonzero(regs) << 16 | regs[regs != 0]).tolist()
        whole = hashes.view(np.int64).tolist() if len(hashes) <= WHOLE else None
        return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([places], pa.list_(pa.int32())), pa.array([whole], pa.list_(pa.int64()))], ["node", "places", "shingles"])

    return materialise(_read(nodes, classes, docs, width, row, "node long, places array<int>, shingles array<long>"), "open-sets")


def _cross(bands: DataFrame, sets: DataFrame, percent: int, reach: Column) -> DataFrame:
    """(a, b, sure) for classes of different components in one bucket of ``bands``; ``reach`` is a cheap condition.

    The registers' estimate decides which sets are compared. sure: the whole sets were compared and reach
    the threshold. Other rows are pairs of large sets that the estimate lets through. A bucket of many rows is dealt over several keys: a row is on the first
    side of one and on the second side of all of them.
    """
    parts = bands.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    # A class meets its set once, with its buckets (at most BANDS) as a list.
    listed = bands.join(parts, "key").groupBy("node").agg(F.collect_list(F.struct("parts", *[c for c in bands.columns if c != "node"])).alias("_b"))
    rows = materialise(listed.join(sets, "node").select("node", F.explode("_b").alias("_b"), "places", "shingles").select("node", "_b.*", "places", "shingles"), "open-bands")
    one = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).alias("x")
    two = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    threshold = percent / 100
    exact = F.col("x.shingles").isNotNull() & F.col("y.shingles").isNotNull()
    common = F.size(F.array_intersect("x.shingles", "y.shingles"))
    used = F.greatest("x.u", "y.u")  # at least so many: the share of equal registers is not estimated too low
    share = F.size(F.array_intersect("x.places", "y.places")) / used
    likely = corrected(share) >= least_estimate(threshold, used, F.least("x.n", "y.n"))
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.component") < F.col("y.component"))
    held = ~exact | ((100 + percent) * common >= percent * (F.col("x.n") + F.col("y.n")))
    joined = one.join(two, met & reach & likely & held)
    return joined.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), exact.alias("sure")).distinct()


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as edges (u, v).

    Every class is read from the text of one of its documents. Texts are brought to the pair's first
    class, which a task holds while the texts compared with it pass by; a class with many comparisons
    is sent to as many tasks.
    """
    parts = parallelism(docs.sparkSession)
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"))
    large = fans.where("fan > 1")
    dealt = pairs.join(large, "a", "left").withColumn("salt", F.when(F.col("fan").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("fan")).cast("int"))).drop("fan")
    first = fans.select("a", F.col("a").alias("node"), F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"))
    wanted = dealt.select("a", F.col("b").alias("node"), F.lit(1).alias("side"), "salt").unionByName(first)
    named = wanted.join(classes.select("node", "doc_id", "h1", "h2"), "node").select(F.col("doc_id").alias("_id"), "a", "node", "side", "salt", "h1", "h2")
    named = materialise(named, "comparisons")
    texts = _texts(docs, named).select("a", "salt", "side", "node", "h1", "h2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, base = None, None
        for batch in slices(batches):
            out: list[list[int]] = [[], []]
            for a, salt, side, node, h1, h2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, salt) != group:
                    group, base = (a, salt), None
                if side == 0 and base is not None:
                    continue
                hashes = shingles(text, width)
                if np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist() != [h1, h2]:
                    continue  # another text under the same id
                if side == 0:
                    base = hashes
                elif base is not None:
                    common = len(np.intersect1d(base, hashes, assume_unique=True))
                    if 100 * common >= percent * (len(base) + len(hashes) - common):
                        out[0].append(a)
                        out[1].append(node)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["u", "v"])

    return texts.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "side").mapInArrow(run, "u long, v long").distinct()


def _mixed(bands: DataFrame) -> DataFrame:
    """The rows of ``bands`` (key, component, ...) in buckets of several components. Others never become mixed again."""
    several = bands.groupBy("key").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("key")
    return materialise(bands.join(several, "key", "left_semi"), "mixed-bands")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash and first.

    Two texts are linked if ``100 * common >= percent * union`` of their sets of shingles of ``width``
    words (a shorter text is one shingle). component_id is the smallest doc_id that links reach, kept
    tells whether it is the row's own, and first marks one row of each component.

    Null texts and texts without words have no shingles and no links. Texts of any length are read
    whole. Rows that repeat an id are separate texts with that id; equal texts are one class; a row
    with a null id takes the component's smallest id, or null, and is then not kept. An empty table
    gives an empty one; other columns are not read.

    Registers and bands make candidates, never decisions: links are confirmed on full sets. The chance
    that a pair at a similarity of 0.8 shares none of 42 bands is 3e-6, at 0.85 2e-9. All tables of rows, classes,
    candidates and links stay distributed.
    """
    wide = materialise(_sketches(docs, width), "sketches")
    sketched = materialise(wide.select("doc_id", "text_hash", "row", "n", "h1", "h2"), "rows")
    grouped = sketched.where("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.count("*").alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("least"))
    grouped = materialise(grouped, "classes")
    members = grouped.select("node", "rows", "least")
    classes = materialise(wide.join(members, F.col("row") == F.col("node")).select("node", "doc_id", "n", "h1", "h2", "u", "regs", "bits", "bands"), "class-sketches")
    release(wide)
    sweep(docs.sparkSession)

    # 1. Buckets, and bounds in the large ones; 2. stars.
    shape = ["n", "most", "u", *[f"b{i}" for i in range(REGISTERS // 64)]]
    words_of = [f"b{i}" for i in range(REGISTERS // 64)]
    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", (F.col("size") > LARGE).alias("large"))
    crowded = materialise(keys.join(shared, "key"), "crowded-bands")
    in_large = crowded.where("large")
    alone = _alone(in_large.select("node").distinct(), classes, docs, width)
    # A class's large buckets (at most BANDS) tell whether a pair meets in a bucket with a lesser key.
    large_keys = in_large.groupBy("node").agg(F.collect_list("key").alias("keys"))
    least_alone = F.coalesce(F.when(F.col("large"), F.col("alone")), F.lit(0))
    shaped = classes.select("node", "n", "u", *[F.get("bits", F.lit(i)).alias(name) for i, name in enumerate(words_of)]).join(alone, "node", "left").join(large_keys, "node", "left")
    lesser = F.when(F.col("large"), F.filter("keys", lambda key: key < F.col("key"))).alias("lesser")
    able = crowded.join(shaped, "node").select("key", "node", "n", "u", *words_of, (F.col("n") - least_alone).alias("most"), "large", lesser, F.col("node").alias("component"))
    now = materialise(able.where(100 * F.col("most") >= percent * F.col("n")), "able-bands")  # later, buckets of several components only
    release(crowded, alone)
    sweep(docs.sparkSession)
    threshold = percent / 100
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(REGISTERS // 64)])
    # Registers that a pair at the threshold uses together, at most.
    used = F.least(F.lit(float(REGISTERS)), F.least("x.u", "y.u") * (2 - threshold) / threshold)
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    pair = (F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    common = (100 + percent) * F.least("x.most", "y.most") >= percent * (F.col("x.n") + F.col("y.n"))
    links = label = None
    for turn in range(ROUNDS):
        chance = F.xxhash64(F.lit(turn), "node")
        order = F.struct((1 - F.col("most") / F.col("n")).alias("share"), chance.alias("chance")) if turn == 0 else chance
        head = F.min_by(F.struct("node", "component", *shape), order)
        heads = materialise(now.groupBy("key").agg(head.alias("h")).select("key", "h.*"), "band-heads")
        met = now.alias("x").join(heads.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & sizes & common & (differ <= most_bits(threshold, used, 1.0)))
        pairs = materialise(met.select(*pair).distinct(), "stars")
        if pairs.isEmpty():
            release(heads, pairs)
            break
        before = [heads, pairs] + [df for df in (links, label) if df is not None]
        found = _confirmed(pairs, classes, docs, width, percent)
        links = materialise(found if links is None else links.unionByName(found), "links")
        label = connected_components(links)
        release(*before)
        labelled = materialise(now.drop("component").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled-bands")
        release(now)
        now = _mixed(labelled)
        release(labelled)
        sweep(docs.sparkSession)

    # 3. Classes of different components in one bucket: of a small one by pairs, a large one by sets.
    reach = sizes & common & (differ <= most_bits(threshold, used))
    one, two = (now.where("NOT large").alias(name) for name in "xy")
    few = one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & reach).select(*pair).distinct()
    candidates = [materialise(_likely(few, classes, percent), "candidates")]
    more = []
    crowd = now.where("large")
    if not crowd.isEmpty():
        sets = _sets(crowd.select("node").distinct(), classes, docs, width)
        unmet = ~F.coalesce(F.arrays_overlap("x.lesser", "y.lesser"), F.lit(False))
        found = materialise(_cross(crowd, sets, percent, reach & unmet), "compared-sets")
        more.append(found.where("sure").select(F.col("a").alias("u"), F.col("b").alias("v")))
        candidates.append(found.where("NOT sure").select("a", "b"))
    unsure = reduce(DataFrame.unionByName, candidates).distinct()
    if not unsure.isEmpty():
        more.append(_confirmed(unsure, classes, docs, width, percent))
    if more:
        links = materialise(reduce(DataFrame.unionByName, more if links is None else [links, *more]), "links")
        label = connected_components(links)
        sweep(docs.sparkSession)
    if label is None:
        label = docs.sparkSession.createDataFrame([], "node long, component long")

    # The smallest id of each component, for classes that have several rows or links.
    joined = members.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "rows", "least", F.col("component").isNotNull().alias("linked"))
    touched = materialise(joined.where("linked OR rows > 1"), "touched")
    least = touched.groupBy("component").agg(F.min("least").alias("of_all"))
    per_class = touched.drop("least").join(least, "component").select(F.col("node").alias("_node"), F.col("of_all.id").alias("component_id"), F.col("of_all.row").alias("first_row"))
    named = materialise(grouped.join(per_class, F.col("node") == F.col("_node")).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "component_id", "first_row"), "class-components")
    rows = sketched.select("doc_id", "text_hash", "row", F.col("n").alias("n_shingles"), "h1", "h2").join(named, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "text_hash", F.coalesce(F.col("first_row") == F.col("row"), F.lit(True)).alias("first"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The first row of each component of :func:`near_duplicates`, with all columns.

    Texts without words are linked with nothing and all stay.
    """
    return keep_marked(docs, near_duplicates(docs, width, percent).select("doc_id", "text_hash", F.col("first").alias("stays")))
