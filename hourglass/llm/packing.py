"""Pattern packing: few-document length patterns are repeated so that together they use up the length histogram.

Repeat counts come from non-negative least squares, are rounded down, and what they leave is packed best-fit. All of this works
on the histogram of lengths (as many numbers as a sequence has tokens), never on documents; documents only get ranks among
those of equal length, and the plan says where each rank goes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window, functions as F

from hourglass.llm.common import BYTE_PATTERN, ByteRanks, RankTokens, settle, sliced

LENGTH = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
Group = tuple[tuple[tuple[int, int], ...], int]  # runs (length, how many) of a sequence, number of such sequences


@lru_cache(maxsize=2)
def _tokens(path: str, pattern: str) -> ByteRanks | RankTokens:
    return ByteRanks(path) if pattern == BYTE_PATTERN else RankTokens(path, pattern)


def cut_pieces(docs: DataFrame, vocabulary: str, pattern: str, length: int = LENGTH, end_id: int = 2) -> DataFrame:
    """One row per piece: documents longer than ``length`` ids (the end id included) are cut so that only the first piece is shorter."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokens(vocabulary, pattern)
        for batch in batches:
            for part in sliced(batch):
                rows: list[tuple] = []
                for doc_id, coded in zip(part.column(0).to_pylist(), coder(part.column(1).to_pylist()), strict=True):
                    coded += end_id.to_bytes(4, "little")
                    n = len(coded) // 4
                    cuts = [0, *range(n % length or length, n + 1, length)]
                    rows += [(doc_id, k, a, b - a, zlib.crc32(coded[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def patterns(length: int):
    """All multisets of one to three lengths that fill a sequence exactly, as rows of three (0: no document)."""
    import numpy as np

    first = np.concatenate([np.full(max(0, (length - i) // 2 - i + 1), i) for i in range(0, length // 3 + 1)])
    second = np.concatenate([np.arange(i, (length - i) // 2 + 1) for i in range(0, length // 3 + 1)])
    return np.stack([first, second, length - first - second], 1)


def fit_repeats(histogram, rows, steps: int = 1200):
    """x >= 0 that minimises the squared, length-weighted difference between used and given counts (accelerated projected gradient)."""
    import numpy as np

    size = len(histogram)
    weight = (np.arange(size) / (size - 1)) ** 2
    weight[0] = 0
    scale = max(1.0, float(histogram.max()))
    target = histogram / scale
    use = lambda x: np.bincount(rows.ravel(), np.repeat(x, 3), size)
    back = lambda r: r[rows].sum(1)
    probe = np.ones(len(rows))
    for _ in range(20):  # largest curvature by power iteration
        probe = back(weight * use(probe))
        bound = float(np.linalg.norm(probe))
        probe /= bound
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(weight * (use(y) - target)) / (1.02 * bound))
        if (y - new) @ (new - x) > 0:
            t = 1.0
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x * scale


def pack_rest(counts: dict[int, int], length: int) -> list[Group]:
    """Best-fit decreasing on counts of lengths: equal sequences are filled together, so the work does not grow with the counts."""
    open_: dict[int, list[list]] = {}
    for item in sorted(counts, reverse=True):
        left = counts[item]
        while left:
            room = min((r for r in open_ if r >= item), default=length)
            if room in open_:
                runs, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            else:
                runs, n = (), -(-left // (length // item))
            each = min(room // item, left)
            filled = min(n, left // each)
            open_.setdefault(room - each * item, []).append([(*runs, (item, each)), filled])
            if n > filled:
                if runs:
                    open_.setdefault(room, []).append([runs, n - filled])
            left -= filled * each
    return [(runs, n) for groups in open_.values() for runs, n in groups]


def make_plan(counts: dict[int, int], length: int = LENGTH) -> list[Group]:
    """Sequences, as groups of equal ones, that hold exactly ``counts[l]`` documents of every length l <= ``length``."""
    import numpy as np

    histogram = np.zeros(length + 1)
    for item, n in counts.items():
        histogram[item] = n
    left = histogram.astype("int64")
    plan: list[Group] = []
    if left[length]:
        plan.append((((length, 1),), int(left[length])))
        left[length] = histogram[length] = 0
    rows = patterns(length)
    repeats = fit_repeats(histogram, rows)
    for at in np.argsort(-repeats, kind="stable"):
        if repeats[at] < 1:
            break
        need = {int(v): int((rows[at] == v).sum()) for v in rows[at] if v}
        n = min(int(repeats[at]), *(int(left[v]) // k for v, k in need.items()))
        if n > 0:
            for v, k in need.items():
                left[v] -= n * k
            plan.append((tuple(sorted(need.items(), reverse=True)), n))
    return plan + pack_rest({int(v): int(left[v]) for v in np.flatnonzero(left)}, length)


def place_rows(plan: list[Group]):
    """The plan as arrays sorted by (length, first rank): length, rank, how many of it in one sequence, first sequence, offset."""
    import numpy as np

    used: dict[int, int] = {}
    rows, sequence = [], 0
    for runs, n in plan:
        offset = 0
        for item, each in runs:
            rows.append((item, used.get(item, 0), each, sequence, offset))
            used[item] = used.get(item, 0) + each * n
            offset += item * each
        sequence += n
    return np.array(sorted(rows), "int64").reshape(-1, 5).T


def rank_in_length(pieces: DataFrame) -> DataFrame:
    """``rank`` (0, 1, ... without gaps) of each piece among those of its length; a length with most rows is spread over salts."""
    salts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = salted.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    return numbered.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("k") - 1).drop("salt", "k", "base")


def pack(docs: DataFrame, vocabulary: str, pattern: str, length: int = LENGTH, end_id: int = 2) -> DataFrame:
    """One row per piece with its sequence and offset. NULL text is empty (the end id alone); repeated rows are packed each;
    equal lengths are interchangeable, so ties only decide which of the equal places a piece gets; no rows give no rows."""
    import pyarrow as pa

    pieces = settle(cut_pieces(docs, vocabulary, pattern, length, end_id))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = place_rows(make_plan(counts, length) if counts else [])
    lengths, firsts, eachs, sequences, offsets = placed
    shift = 1 << 44
    keys = lengths * shift + firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            item, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, item * shift + rank, "right") - 1
            nth = rank - firsts[at]
            where = [pa.array(sequences[at] + nth // eachs[at]), pa.array(offsets[at] + nth % eachs[at] * item)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *where], names=[c.split()[0] for c in PLACED.split(", ")])

    return rank_in_length(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, PLACED)
