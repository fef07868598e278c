"""Hard-negative mining by product quantisation with stored residual norms.

Every row is stored as the codes of its nearest centroids, the norm of what they leave over, and its exact integer
vector. A lookup table per anchor gives the score of the coded vector; the true score differs from it by at most the
anchor's norm times the residual norm. So the table's score plus or minus that bound rules rows out without error, and the
exact integer product is taken for the rest only. Nothing is lost: the result is that of a full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import cut, gapless_rank

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores between this many hundredths of its positive and all of it.
FLOOR_PERCENT = 80
#: Codebooks are fitted on the rows with the smallest hashes of their id, this many at most.
SAMPLE = 4_096
SUB_DIMS, CENTROIDS, FIT_ROUNDS = 2, 256, 8
#: Anchors that one pass over all rows serves; what a pass hands to its tasks is bounded by it.
ANCHORS_A_PASS = 8_192
#: Scores are held for so many anchors and rows at once.
ANCHOR_BLOCK, ROW_BLOCK, PAIR_BLOCK = 512, 2_048, 200_000
#: Vectors whose scaled squares add up to less have products that fit a long.
LARGEST = 2.0**61
#: Beyond all scores.
NEVER = 2**62
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10


def _positions(n: int) -> list[slice]:
    """The slices of n dimensions that have a codebook each."""
    return [slice(i, min(i + SUB_DIMS, n)) for i in range(0, n, SUB_DIMS)]


def _nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1)[None, :] - 2.0 * (part @ book.T), axis=1)


def fit_codebooks(sample: np.ndarray) -> list[np.ndarray]:
    """A codebook per slice by Lloyd's rounds from evenly spaced rows of the sample; empty centroids stay where they are."""
    books = []
    for at in _positions(sample.shape[1]):
        part = sample[:, at].astype(float)
        distinct = np.unique(part, axis=0)
        book = distinct[np.unique(np.linspace(0, len(distinct) - 1, min(CENTROIDS, len(distinct))).astype(int))].copy()
        for _ in range(FIT_ROUNDS if len(book) < len(distinct) else 0):
            code = _nearest(part, book)
            n = np.bincount(code, minlength=len(book))
            for d in range(part.shape[1]):
                total = np.bincount(code, part[:, d], len(book))
                book[n > 0, d] = total[n > 0] / n[n > 0]
        books.append(book)
    return books


def encode(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and residual norms, the norms rounded up."""
    codes = np.zeros((len(vectors), len(books)), np.uint8)
    rest = np.zeros(len(vectors))
    for k, (at, book) in enumerate(zip(_positions(vectors.shape[1]), books, strict=True)):
        part = vectors[:, at].astype(float)
        codes[:, k] = _nearest(part, book)
        rest += ((part - book[codes[:, k]]) ** 2).sum(1)
    return codes, np.sqrt(rest) * (1 + 1e-9) + 1e-9


def table_scores(anchors: np.ndarray, codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """(rows, anchors): the sums of the entries that a row's codes pick from every anchor's lookup table."""
    out = np.zeros((len(codes), len(anchors)))
    for k, (at, book) in enumerate(zip(_positions(anchors.shape[1]), books, strict=True)):
        out += (book @ anchors[:, at].T.astype(float))[codes[:, k]]
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


class Best:
    """The first ``keep`` rows by exact score, then id, of each of many windows, fed block by block."""

    def __init__(self, n: int, keep: int):
        self.keep = keep
        self.rows: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        #: Scores below it cannot enter any more.
        self.least = np.full(n, -NEVER, np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Only the first few of a window in this block are looked at one by one."""
        order = np.lexsort((rows, ids, -scores, at))
        at, scores, ids, rows = at[order], scores[order], ids[order], rows[order]
        first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        for k in np.flatnonzero(place < self.keep):
            w = at[k]
            self.rows[w] = sorted([*self.rows[w], (-int(scores[k]), int(ids[k]), int(rows[k]))])[: self.keep]
            if len(self.rows[w]) == self.keep:
                self.least[w] = -self.rows[w][-1][0]


def exact(anchors: np.ndarray, vectors: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer products of the pairs (anchor a, row r)."""
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), PAIR_BLOCK):
        at = slice(lo, lo + PAIR_BLOCK)
        out[at] = np.einsum("ij,ij->i", anchors[a[at]], vectors[r[at]])
    return out


class Scan:
    """One pass over all rows for a bounded set of anchors: bounds rule pairs out, the rest is scored exactly.

    ``windows`` are (anchor, lowest, highest score, same label) each; a window keeps its first few rows.
    """

    def __init__(self, books: list[np.ndarray], anchors: np.ndarray, labels: np.ndarray, own: np.ndarray, windows: list[tuple[int, int, int]], same: bool, keep: int):
        self.books, self.anchors, self.labels, self.own, self.same, self.keep = books, anchors, labels, own, same, keep
        self.norms = np.sqrt((anchors.astype(float) ** 2).sum(1)) * (1 + 1e-9)
        self.anchor_of = np.array([w[0] for w in windows], np.int64)
        self.lowest, self.highest = (np.array([w[i] for w in windows], np.int64) for i in (1, 2))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(self.anchor_of), self.keep)
        for batch in batches:
            ids, rows, labels = (np.asarray(batch.column(i), np.int64) for i in range(3))
            vectors = _matrix(batch.column(3), self.anchors.shape[1])
            codes = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(len(ids), len(self.books))
            rest = np.asarray(batch.column(5), float)
            for a in range(0, len(self.anchors), ANCHOR_BLOCK):
                for lo in range(0, len(ids), ROW_BLOCK):
                    r = slice(lo, lo + ROW_BLOCK)
                    self.block(best, slice(a, a + ANCHOR_BLOCK), ids[r], rows[r], labels[r], vectors[r], codes[r], rest[r])
        flat = [(w, i, -s) for w, kept in enumerate(best.rows) for s, i, _ in kept]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], pa.int64()) for i in range(3)], names=["window", "id", "score"])

    def block(self, best: Best, of: slice, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codes: np.ndarray, rest: np.ndarray) -> tuple[int, int]:
        """Feeds one block of rows and anchors; the numbers of pairs that were bounded and that were scored exactly."""
        lo, hi = np.searchsorted(self.anchor_of, (of.start, of.stop))
        mine = self.anchor_of[lo:hi] - of.start
        if hi == lo:
            return 0, 0
        anchors, n = self.anchors[of], len(self.anchors[of])
        allowed = (labels[:, None] == self.labels[of][None, :]) == self.same
        if self.same:
            allowed &= rows[:, None] != self.own[of][None, :]
        told = table_scores(anchors, codes, self.books)
        slack = rest[:, None] * self.norms[of][None, :] + 1e-9 * (np.abs(told) + 1) + 1e-3
        # A row is looked at if it may lie in some window of the anchor and above what that window already holds.
        need, top = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(need, mine, np.maximum(self.lowest[lo:hi], best.least[lo:hi]))
        np.maximum.at(top, mine, self.highest[lo:hi])
        if self.same:  # the rows of the block itself raise what is needed: enough lower bounds lie above it
            low = np.where(allowed, told - slack, -np.inf)
            if len(ids) >= self.keep:
                need = np.maximum(need, np.partition(low, len(ids) - self.keep, axis=0)[len(ids) - self.keep])
        r, a = np.nonzero(allowed & (told + slack >= need[None, :]) & (told - slack <= top[None, :]))
        scores = exact(anchors, vectors, a, r)
        # Pairs meet the windows of their anchor.
        first, last = np.searchsorted(mine, a), np.searchsorted(mine, a, side="right")
        for k in range(int((last - first).max(initial=0))):
            fits = first + k < last
            w = np.where(fits, first + k + lo, lo)
            fits &= (scores >= np.maximum(self.lowest[w], best.least[w])) & (scores <= self.highest[w])
            best.add(w[fits], scores[fits], ids[r[fits]], rows[r[fits]])
        return int(allowed.sum()), len(a)


def prepared(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, vec): the rows that take part, their labels changed where the rule says so, components whole numbers."""
    x = F.col(vector_col)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    squares = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double") * float(SCALE * SCALE))
    fine = F.forall(x, lambda v: v.isNotNull()) & (squares < LARGEST)  # NaN and infinite sums are not below it
    label = F.col(label_col).cast("long")
    changed = F.when(F.col(id_col) % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    taken = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull()).where(F.coalesce(fine, F.lit(False)))
    return taken.select(F.col(id_col).cast("long").alias("id"), changed.alias("label"), whole.alias("vec"))


def index(rows: DataFrame) -> tuple[DataFrame, list[np.ndarray], int]:
    """The written index of (id, label, vec) rows, its codebooks, and its width; shorter vectors are filled up with zeros."""
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    filled = rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vec"))))
    sample = filled.select("vec").orderBy(F.xxhash64("id", "vec")).limit(SAMPLE).collect()
    books = fit_codebooks(np.array([r[0] for r in sample], np.int64).reshape(len(sample), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, rest = encode(_matrix(batch.column(3), width), books)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest)], names=["id", "row", "label", "vec", "codes", "rest"])

    numbered = filled.select("id", F.monotonically_increasing_id().alias("row"), "label", "vec")
    return cut(numbered.mapInArrow(run, "id long, row long, label long, vec array<long>, codes binary, rest double"), "negatives-index"), books, width


def mine(
    rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    Rows without an id, a label or a vector, and those with a null or non-finite component (or so long that its
    products would not fit a long: LARGEST), take no part. Missing components of shorter vectors count as zero. Equal scores go
    by the smaller id; rows that share an id are rows of their own, and an anchor's own row alone is left out. Columns
    besides the three are ignored. An empty table, or one without anchors, gives an empty result.

    Anchors go through in passes of at most ANCHORS_A_PASS; each task keeps ``positives`` (or ``negatives``) rows a window,
    so what is shuffled is tasks times windows, whatever the rows. The compared pairs are anchors times rows.
    """
    spark = rows.sparkSession
    made, books, width = index(prepared(rows, id_col, label_col, vector_col))
    is_anchor = (F.col("id") % ANCHOR_EVERY == 0) if anchor is None else anchor
    chosen = cut(made.where(is_anchor).select("id", "row", "label", "vec").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(64))), "negatives-anchors")
    ranked = cut(gapless_rank(chosen, [], "part", [F.col("row")], "place").drop("part"), "negatives-ranked")
    total = ranked.count()
    out = None
    for lo in range(0, total, ANCHORS_A_PASS):
        near = ranked.where(F.col("place").between(lo, lo + ANCHORS_A_PASS - 1)).orderBy("place").collect()
        a = (np.array([r["vec"] for r in near], np.int64).reshape(len(near), width), np.array([r["label"] for r in near]), np.array([r["row"] for r in near]))
        found = _scan(made, Scan(books, *a, [(i, -NEVER, NEVER) for i in range(len(near))], True, positives)).collect()
        pos = sorted(((int(r["window"]), -int(r["score"]), int(r["id"])) for r in found))
        windows = [(i, -(FLOOR_PERCENT * s // 100), -s) for i, s, _ in pos]  # s is less the score: rounded up, up to the score
        heads = spark.createDataFrame([(w, near[i]["id"], p, -s) for w, (i, s, p) in enumerate(pos)], "window long, anchor_id long, positive_id long, positive_score long")
        scan = Scan(books, *a, windows, False, negatives)
        part = _scan(made, scan).join(F.broadcast(heads), "window")
        part = cut(part.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives-pass")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def _scan(made: DataFrame, scan: Scan) -> DataFrame:
    """(window, id, score, rank): the first few of every window over all tasks."""
    found = made.select("id", "row", "label", "vec", "codes", "rest").mapInArrow(scan, "window long, id long, score long")
    first = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= scan.keep)


#: The same rows by a full comparison.
ORACLE_SQL = f"""WITH r AS (SELECT vec_id, label::BIGINT AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS rid
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, rid, v, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label FROM r),
s AS (SELECT a.vec_id AS anchor_id, a.rid AS arid, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
 FROM n a JOIN n b ON a.rid <> b.rid WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
w AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.arid, p.k ORDER BY s.score DESC, s.vec_id) AS rank
 FROM p JOIN s ON s.arid = p.arid AND NOT s.same AND {FLOOR_PERCENT} * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= {NEGATIVES}"""
