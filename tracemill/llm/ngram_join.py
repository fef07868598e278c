"""N-gram Jaccard join by PartEnum signatures: exact components of near-duplicate documents.

Documents with one shingle set are one class. Two classes of sizes a and b with similarity of 0.8 or more differ in at
most k = min(a, b) / 4 shingles. The domain of shingle hashes is partitioned into as many ranges as the size band asks
for; a class's content of a range is a token. A differing shingle spoils one range, so of the k + j smallest tokens of
two linked sets, j are the same in both: the signatures of a class are all subsets of j of its k + j smallest tokens.
Bands are powers of two, and sets that reach into the next band sign there too. Short sets (bands up to SHORT_BAND)
enumerate pairs of ranges, j = 2, at most ten, as one range of theirs holds a single shingle; longer ones take j = 1,
since pairs would be (k + 2)(k + 1) / 2 signatures, 2,926 for 300 shingles.

Shingles that very many documents have are left out of the ranges, since leaving out shingles only lowers the
difference. Classes that keep too few tokens then ("poor" ones) have an exact fallback of another kind, a prefix filter:
they sign among themselves with single shingles, rare ones first, for each narrow band of sizes that a linked set may
have; a pair of which one class isn't poor is found by tokens. No link is lost, whichever shingles are left out.

Buckets of classes with one signature are never expanded into all pairs. First each class is compared with one member
of its largest bucket, the one whose buckets are largest in sum. Then in each round the first members of a bucket are
compared with the others that are not yet in their component; buckets whose members are all connected are done, and
members that were compared with all others leave. From the second round on, pairs whose parity bits already show too
many differences are not made (no linked pair is among them); each pair made is verified on whole shingle sets. Only a bucket
whose members are all unlike costs all its pairs, m (m - 1) / 2, as any exact answer on its signature does; frequent
shingles, which make such buckets, sign nothing unless a class has little else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import cut, discard, small_side
from tracemill.llm.textarrays import CHUNK_BYTES, chunks, mix64, slices, text_bytes, trim, words

SIZE = 5
#: Frequent shingles: counted in windows of this many, kept if this often in a window and in all windows together.
#: They only steer which shingles sign, so the bound on their number costs no link.
WINDOW = 4_000_000
OFTEN_LOCAL, OFTEN = 4, 48
MAX_OFTEN = 500_000
#: Members of a bucket that are compared with the others in the first round, and the growth of that number a round.
FIRST_HEADS, GROWTH = 2, 8
#: Bands of sets from 2**level shingles up to which signatures are pairs of ranges, not single ones.
SHORT_BAND = 3
#: Longs of the parity bits of a class, eight of which tell most unlike sets of some hundred shingles apart.
PARITIES = 8
PARITY = tuple(f"p{c}" for c in range(PARITIES))
#: Rows of a side with parity bits (some hundred bytes each) up to which it is broadcast.
WIDE_ROWS = 100_000
POOR = np.uint64(0xA5A5A5A5A5A5A5A5)


def _narrow_bands() -> np.ndarray:
    """Lower ends of size bands that grow by a twentieth, from 0 to beyond any set's size."""
    ends = [0, 1]
    while ends[-1] < 1 << 40:
        ends.append(-(-ends[-1] * 21 // 20))
    return np.array(ends, np.int64)


#: The low bits of a signature: 0, or 2 and 3 for the lower and the upper band where only sets of different bands pair.
SIDES = np.uint64(3)
NARROW = _narrow_bands()
#: Bands between a size and the size of a linked set, at most.
NARROW_REACH = 6


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the sorted distinct shingle hashes of every text in a row, and how many each has."""
    w = words(*text_bytes(column))
    count = np.where(w.count >= SIZE, w.count - SIZE + 1, (w.count > 0).astype(np.int64))
    first = np.r_[0, np.cumsum(w.count)[:-1]] if len(w.count) else np.zeros(0, np.int64)
    steps = np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashed = [mix64(w.hash + steps[j : j + 1]) for j in range(SIZE)]
    owner = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count) + np.repeat(first, count)
    total = np.zeros(len(owner), np.uint64)
    size = np.minimum(w.count, SIZE)[owner]
    for j in range(SIZE):
        has = size > j
        if has.all():
            total += hashed[j][at + j]
        else:
            total[has] += hashed[j][at[has] + j]
    total = mix64(total + size.astype(np.uint64))
    ends = np.cumsum(count)
    for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
        total[a:b].sort()
    fresh = np.ones(len(total), bool)
    fresh[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[fresh], np.bincount(owner[fresh], minlength=len(count))


def _digests(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A 128-bit digest of every set."""
    out = np.zeros((len(counts), 2), np.uint64)
    has = np.flatnonzero(counts)
    if has.size:
        starts = (np.cumsum(counts) - counts)[has]
        out[has, 0] = np.add.reduceat(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
        out[has, 1] = np.add.reduceat(mix64(hashes ^ np.uint64(0x14057B7EF767814F)), starts)
    return [x.tobytes() for x in out]


def parities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 * PARITIES bits a set, as int64 columns: whether an odd number of its shingles falls into each bit's part of the domain.

    A shingle that only one of two sets has flips one bit, so sets differ in at least as many shingles as bits.
    """
    out = np.zeros((PARITIES, len(counts)), np.uint64)
    has = np.flatnonzero(counts)
    if has.size:
        starts = (np.cumsum(counts) - counts)[has]
        bit = np.uint64(1) << (hashes & np.uint64(63))
        column = (hashes >> np.uint64(6)) & np.uint64(PARITIES - 1)
        for c in range(PARITIES):
            out[c, has] = np.bitwise_xor.reduceat(np.where(column == c, bit, np.uint64(0)), starts)
    return out.view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, cls, n, parities) of documents, and rows (often, times) of shingles that are frequent in a window."""
    names = ["id", "cls", "n", "often", "times", *PARITY]
    held, used = np.empty(WINDOW, np.uint64), 0
    seen: set[bytes] = set()

    def often() -> pa.RecordBatch:
        value = held[:used]
        value.sort()
        first = np.unique(value[: max(0, used - OFTEN_LOCAL + 1)][value[OFTEN_LOCAL - 1 :] == value[: max(0, used - OFTEN_LOCAL + 1)]])
        times = np.searchsorted(value, first, "right") - np.searchsorted(value, first)
        k = len(first)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(first.view(np.int64)), pa.array(times), *[pa.nulls(k, pa.int64())] * PARITIES], names=names)

    for batch in batches:
        for part in chunks(batch, 1):
            hashes, counts = shingle_sets(part.column(1))
            digests = _digests(hashes, counts)
            n = len(counts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(counts), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *map(pa.array, parities(hashes, counts))], names=names)
            new = np.array([not (d in seen or seen.add(d)) for d in digests], bool)
            fresh = hashes[np.repeat(new, counts)]
            while len(fresh):
                some = fresh[: WINDOW - used]
                held[used : used + len(some)] = some
                used, fresh = used + len(some), fresh[len(some) :]
                if used == WINDOW:
                    yield often()
                    used = 0
    yield often()
    del held
    trim()


def _tokens(hashes: np.ndarray, owner: np.ndarray, ranges: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, owner): the content of every range that a set has shingles in; hashes sorted within their owner."""
    part = ((hashes >> np.uint64(32)) * ranges[owner]) >> np.uint64(32)
    new = np.ones(len(hashes), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
    starts = np.flatnonzero(new)
    if not starts.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = owner[starts]
    return mix64(np.add.reduceat(mix64(hashes), starts) ^ mix64((part[starts] << np.uint64(8)) + band[own])), own


def _smallest(tokens: np.ndarray, owner: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``limit[owner]`` smallest tokens of every owner."""
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(limit)))
    keep = np.arange(len(owner)) - first[owner] < limit[owner]
    return tokens[keep], owner[keep]


def _subsets_of_two(tokens: np.ndarray, owner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, owner): every pair of an owner's tokens; owners stand in a row with at most ``most`` tokens each."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for apart in range(1, most):
        same = owner[apart:] == owner[:-apart]
        out.append((mix64(mix64(tokens[:-apart][same]) + tokens[apart:][same]), owner[apart:][same]))
    return np.concatenate([t for t, _ in out]), np.concatenate([o for _, o in out])


def _rare_first(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray, frequent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signature, owner): for every band of sizes that linked sets may have, as many shingles as can't all be missing.

    Shingles are in one order everywhere, frequent ones last, so that sets which share little else don't meet by them.
    Sets of sizes a and b link with at least 4 (a + b) / 9 shingles in common, so the first a - that + 1 of one and
    b - that + 1 of the other have one in common.
    """
    if not len(hashes):
        return
    value = mix64(hashes ^ POOR)
    order = np.lexsort((value, frequent, owner))
    value, owner = value[order], owner[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(counts)))[owner]
    own = np.searchsorted(NARROW, counts, "right") - 1
    for step in range(-NARROW_REACH, NARROW_REACH + 1):
        other = np.clip(own + step, 0, len(NARROW) - 2)
        low, high = np.maximum(NARROW[other], (4 * counts + 4) // 5), np.minimum(NARROW[other + 1] - 1, 5 * counts // 4)
        reach = np.where((other == own + step) & (low <= high), counts - (4 * (counts + low) + 8) // 9 + 1, 0)
        keep = rank < reach[owner]
        pair = (np.minimum(own, other) << 16) + np.maximum(own, other)
        sig = mix64(value[keep] ^ mix64(pair.astype(np.uint64))[owner[keep]])
        yield (sig & ~SIDES) | np.uint64(0 if step == 0 else 2 + (step < 0)), owner[keep]


def signatures(hashes: np.ndarray, counts: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of all sets; sets of under four shingles are only like equal ones and sign nothing."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    big = counts >= 4
    k = counts // 4
    frequent = np.zeros(len(hashes), bool)
    if often.size and len(hashes):
        frequent = often[np.minimum(np.searchsorted(often, hashes), len(often) - 1)] == hashes
    use = big[owner] & ~frequent
    level = np.frexp(np.maximum(counts, 1).astype(float))[1].astype(np.int64) - 1  # 2**level <= size
    out: list[tuple[np.ndarray, np.ndarray]] = []
    poor = np.zeros(n, bool)
    for step in (0, 1):
        here = big if step == 0 else big & (counts * 5 >= (4 << (level + 1)))
        band = level + step
        pick = use & here[owner]
        tokens, own = _tokens(hashes[pick], owner[pick], (np.uint64(1) << band.astype(np.uint64)), band.astype(np.uint64))
        short = band <= SHORT_BAND
        poor |= here & (np.bincount(own, minlength=n) <= k + short)
        tokens, own = _smallest(tokens & ~SIDES, own, k + 1 + short)
        two = short[own]
        out.append((tokens[~two], own[~two]))
        pairs, own = _subsets_of_two(tokens[two], own[two], (1 << (SHORT_BAND + 1)) // 4 + 2)
        out.append((pairs & ~SIDES, own))
    out.extend(_rare_first(hashes[poor[owner]], owner[poor[owner]], counts, frequent[poor[owner]]))
    return np.concatenate([t for t, _ in out]), np.concatenate([o for _, o in out])


def _of_classes(docs: DataFrame, classes: DataFrame, run, schema: str) -> DataFrame:
    """Run over the texts of the given classes: (rid, cls, text), one row for each unless ids repeat."""
    rows = docs.join(small_side(classes.select("rep", "rid", "cls")), F.col("id").eqNullSafe(F.col("rep"))).select("rid", "cls", "text")
    return rows.mapInArrow(run, schema)


def _own(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of a slice of (rid, cls, text); of rows that share an id, only the one with the class's set."""
    hashes, counts = shingle_sets(part.column(2))
    right = np.array([a == b for a, b in zip(_digests(hashes, counts), part.column(1).to_pylist(), strict=True)], bool)
    return np.array(part.column(0)), hashes[np.repeat(right, counts)], np.where(right, counts, 0)


def _label(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Components after linking: (rid, comp), comp the smallest rid. Edges (a, b) are between rids of ``comps``.

    Minimum labels spread over the edges between components, and each component also takes the label of its label, so
    chains shorten by half a round.
    """
    a = edges.join(comps.select(F.col("rid").alias("a"), F.col("comp").alias("ca")), "a")
    both = a.join(comps.select(F.col("rid").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb").select("ca", "cb").distinct()
    links = cut(both.unionByName(both.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct(), "join-links")
    labels = cut(links.groupBy(F.col("ca").alias("c")).agg(F.least(F.min("cb"), F.col("c")).alias("l")), "join-labels")
    tables = [labels]
    while not labels.isEmpty():
        spread = links.join(labels, F.col("cb") == F.col("c")).groupBy("ca").agg(F.min("l").alias("m"))
        jump = labels.select(F.col("c").alias("j"), F.col("l").alias("jl"))
        new = labels.join(spread, F.col("c") == F.col("ca")).join(jump, F.col("l") == F.col("j")).select("c", F.least("l", "m", "jl").alias("nl"), "l")
        new = cut(new, "join-labels")
        tables.append(new)
        done = new.where("nl <> l").isEmpty()
        labels = new.select("c", F.col("nl").alias("l"))
        if done:
            break
    out = comps.join(labels, F.col("comp") == F.col("c"), "left").select("rid", F.coalesce("l", "comp").alias("comp"))
    out = cut(out, "join-comps")
    discard(links, *tables)
    return out


def _sizes_allow(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _parities_allow() -> Column:
    """Whether the sets of a row and its head differ in so few parity bits that they may differ in a quarter of the smaller one at most."""
    flipped = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"a{c}"))) for c in PARITY[1:]), F.bit_count(F.col(PARITY[0]).bitwiseXOR(F.col(f"a{PARITY[0]}"))))
    return 4 * flipped <= F.least(F.col("n"), F.col("na"))


def _compare(docs: DataFrame, classes: DataFrame, pairs: DataFrame, top: int, test) -> DataFrame:
    """The pairs (a, b, na, nb) whose shingle hashes below ``top`` pass ``test(common, sizes, na, nb)``."""
    needed = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    needed = cut(classes.join(needed, "rid", "left_semi").select("rep", "rid", "cls"), "join-needed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2):
                rid, hashes, counts = _own(part)
                data = []
                for end, c in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                    own = hashes[end - c : end]
                    data.append(own[: np.searchsorted(own, np.uint64(top), "right")].tobytes() if c else None)
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(data, pa.binary())], names=["rid", "hashes"])
        trim()

    made = _of_classes(docs, needed, sets, "rid long, hashes binary").where("hashes IS NOT NULL")
    made = written = cut(made.dropDuplicates(["rid"]), "join-sets")
    left = made.select(F.col("rid").alias("a"), F.col("hashes").alias("x"))
    right = made.select(F.col("rid").alias("b"), F.col("hashes").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, (4, 5), 4 * CHUNK_BYTES):
                keep = []
                for na, nb, x, y in zip(*(part.column(k).to_pylist() for k in (2, 3)), part.column(4), part.column(5), strict=True):
                    both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                    both.sort()
                    keep.append(test(int((both[1:] == both[:-1]).sum()), len(both), na, nb))
                yield part.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))
        trim()

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "x", "y")
    out = cut(joined.mapInArrow(check, "a long, b long, na long, nb long"), "join-compared")
    discard(needed, written)
    return out


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with similarity of 0.8 or more.

    Linked sets differ in at most a quarter of the smaller one, in any part of the domain; a quarter of the domain
    shows that of most other pairs at a quarter of the bytes. What is left is compared on whole sets.
    """
    close = _compare(docs, classes, pairs, (1 << 62) - 1, lambda common, total, na, nb: 4 * (total - 2 * common) <= min(na, nb))
    return _compare(docs, classes, close, (1 << 64) - 1, lambda common, total, na, nb: 100 * common >= 80 * (total - common))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row.

    Words are runs without ASCII white space, A-Z folded; the set of a text holds its distinct five-word shingles, or
    its whole sequence if it has fewer words. Texts link when 100 * intersection >= 80 * union; component_id is the
    smallest id that links lead to. Null, empty and blank texts have an empty set and their own id as component.

    Null ids rank behind others; rows that repeat an id are one node if their texts have one set, else a node each.
    Empty input gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scanned = cut(rows.mapInArrow(_scan, "id long, cls binary, n long, often long, times long, " + ", ".join(f"{c} long" for c in PARITY)), "join-scan")
    base = scanned.where("cls IS NOT NULL").select("id", "cls", "n", *PARITY)
    often = scanned.where("often IS NOT NULL").groupBy("often").agg(F.sum("times").alias("t")).where(F.col("t") >= OFTEN)
    # At most MAX_OFTEN numbers, whatever the input.
    often_hashes = np.sort(often.orderBy(F.desc("t"), "often").limit(MAX_OFTEN).select("often").toPandas()["often"].to_numpy(np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(often_hashes)

    classes = base.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), *[F.max(c).alias(c) for c in PARITY])
    classes = cut(classes.withColumn("rid", F.monotonically_increasing_id()), "join-classes")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2):
                rid, hashes, counts = _own(part)
                sig, owner = signatures(hashes, counts, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(rid[owner])], names=["sig", "rid"])
        trim()

    signed = _of_classes(rows, classes.where("n >= 4"), sign, "sig long, rid long")
    signed = signed.select(F.shiftright("sig", 2).alias("sig"), "rid", F.col("sig").bitwiseAND(F.lit(3)).cast("byte").alias("side"))
    inside = Window.partitionBy("sig")
    two_sided = (F.min("side").over(inside) == 0) | (F.min("side").over(inside) < F.max("side").over(inside))
    signed = signed.withColumn("m", F.count(F.lit(1)).over(inside)).withColumn("two", two_sided)
    open_ = cut(signed.where("m > 1 AND two").drop("two"), "join-buckets")
    # A text that many others are edits of has the signatures that most of them have: such ones are heads first.
    members = open_.groupBy("rid").agg(F.sum("m").alias("score"), F.max(F.struct(F.col("side") == 0, "m", "sig")).alias("largest"))
    members = cut(classes.join(members, "rid").select("rid", "n", "score", "largest.sig", *PARITY), "join-members")
    comps = members.select("rid", F.col("rid").alias("comp"))
    tops = open_.select("sig", "rid").join(small_side(members.select("rid", "n", "score")), "rid").groupBy("sig").agg(F.max(F.struct("score", "rid", "n")).alias("h"))
    tops = tops.select(F.col("sig").alias("hs"), "h.*").select("hs", F.col("rid").alias("a"), F.col("n").alias("na"), F.col("score").alias("sa"))
    pairs = members.join(tops, (F.col("sig") == F.col("hs")) & (F.col("a") != F.col("rid")) & _sizes_allow(F.col("n"), F.col("na")))
    pairs = cut(pairs.select("a", F.col("rid").alias("b"), "na", F.col("n").alias("nb")), "join-pairs")
    tested = pairs.select("a", "b")
    first = FIRST_HEADS
    while True:
        if not pairs.isEmpty():
            edges = _verified(rows, classes, pairs).select("a", "b")
            if not edges.isEmpty():
                comps = _label(edges, comps)
        info = cut(members.drop("sig").join(comps, "rid"), "join-info")
        state = open_.select("sig", "rid", "side").join(small_side(info, WIDE_ROWS), "rid").withColumn("two", two_sided)
        state = state.withColumn("lo", F.min("comp").over(inside)).withColumn("hi", F.max("comp").over(inside)).where("lo < hi AND two")
        at = F.row_number().over(inside.orderBy(F.desc("score"), F.desc("rid")))
        state = cut(state.select("sig", "rid", "side", "n", "comp", at.alias("at"), *PARITY), "join-state")
        if state.isEmpty():
            break
        heads = state.where(F.col("at") <= first).select(F.col("sig").alias("hs"), F.col("rid").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ac"), F.col("at").alias("aa"), F.col("side").alias("as"), *[F.col(c).alias(f"a{c}") for c in PARITY])
        unlike = (F.col("sig") == F.col("hs")) & (F.col("aa") < F.col("at")) & (F.col("ac") != F.col("comp")) & ((F.col("side") == 0) | (F.col("side") != F.col("as"))) & _sizes_allow(F.col("n"), F.col("na")) & _parities_allow()
        pairs = state.join(heads, unlike).select("a", F.col("rid").alias("b"), "na", F.col("n").alias("nb")).distinct()
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti"), "join-pairs")
        tested = tested.unionByName(pairs.select("a", "b"))
        open_ = state.where(F.col("at") > first).select("sig", "rid", "side")
        first *= GROWTH

    linked = classes.join(comps.select(F.col("rid").alias("r"), "comp"), F.col("rid") == F.col("r"), "left")
    linked = linked.select("cls", "rep", "copies", F.coalesce("comp", "rid").alias("comp"), "r")
    many = linked.where("r IS NOT NULL").groupBy("comp").agg(F.min("rep").alias("lowest")).withColumnRenamed("comp", "c")
    named = linked.where("r IS NOT NULL OR copies > 1").join(many, F.col("comp") == F.col("c"), "left")
    named = cut(named.select(F.col("cls").alias("k"), F.coalesce("lowest", "rep").alias("low")), "join-named")
    out = base.join(small_side(named), F.col("cls") == F.col("k"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))


def kept(component: Column, own: Column) -> Column:
    """Whether a row is the one of its component that stays."""
    return component.eqNullSafe(own)
