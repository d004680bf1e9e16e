"""Quality scores by a generalised additive model with pairwise interactions.

Features are cut into bins. Shallow trees are boosted on one feature at a time, round after round, and add up to one look-up
table per feature; then the pairs of features that explain most of what is left get tables in the same way. A score is the
logistic of table entries added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hourglass.llm.common import settle, sliced

FEATURES = (
    "log_chars", "log_words", "word_length", "long_words", "upper", "digits", "marks", "exclamations", "symbols", "bars", "line_ends",
    "non_ascii", "distinct_words", "top_word", "repeated_lines", "log_line_length", "ended_lines", "marked_words",
)
#: The bound of the training sample, in labelled rows.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 8, 150, 60, 0.1


def describe(text: str) -> list[float]:
    """The features of a whole text; all zeros for an empty one."""
    import math
    from collections import Counter

    import numpy as np

    data = np.frombuffer(text.encode(), "u1")
    if not len(data):
        return [0.0] * len(FEATURES)
    c = np.bincount(data, minlength=256)
    n = len(data)
    words = text.split()
    lines = [s for s in text.split("\n") if s]
    counts = Counter(words)
    w = max(1, len(words))
    marked = sum(k for word, k in counts.items() if len(word) > 2 and not word[-1].isalnum() and not word[-2].isalnum())
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / w, sum(k for word, k in counts.items() if len(word) > 20) / w, c[65:91].sum() / n, c[48:58].sum() / n,
        (c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()) / n, c[33] / n, (c[35:39].sum() + c[42] + c[64]) / n, c[124] / n, c[10] / n,
        c[128:].sum() / n, len(counts) / w, max(counts.values(), default=0) / w, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
        sum(s[-1] in ".!?:;\"'" for s in lines) / max(1, len(lines)), marked / w,
    ]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and ``f``, the features of every whole text (NULL: empty)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                rows = [describe(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias(text)).mapInArrow(run, "doc_id long, f array<float>")


@dataclass
class Additive:
    base: float
    cuts: list  # ascending inner bin edges of each feature
    tables: list
    pairs: list  # (feature, feature, coarse bins of the first, of the second, table)

    def logits(self, x):
        import numpy as np

        bins = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)]
        total = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables, strict=True):
            total += t[b]
        for i, j, a, b, t in self.pairs:
            total += t[a[bins[i]], b[bins[j]]]
        return total


def _newton(g, h):
    """A leaf's step, damped so that a small or pure leaf stays finite."""
    return g / (h + 1.0)


def _split(g, h, lo: int, hi: int):
    """The best cut of bins lo..hi-1 and its gain."""
    import numpy as np

    if hi - lo < 2:
        return None, 0.0
    cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
    gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
    k = int(gain.argmax())
    return lo + k + 1, float(gain[k])


def shallow_tree(g, h):
    """A tree of at most four leaves over ordered bins, as the value of every bin."""
    import numpy as np

    edges = [0, len(g)]
    middle, gain = _split(g, h, 0, len(g))
    if middle is not None and gain > 1e-9:
        edges = [0, middle, len(g)]
        for lo, hi in ((0, middle), (middle, len(g))):
            inner, gain = _split(g, h, lo, hi)
            if inner is not None and gain > 1e-9:
                edges.append(inner)
    edges = sorted(edges)
    out = np.zeros(len(g))
    for lo, hi in zip(edges, edges[1:], strict=False):
        out[lo:hi] = _newton(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def quadrant_tree(g, h):
    """The best cut on each axis of a grid: values of the four quadrants on the grid, and the gain."""
    import numpy as np

    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    right, low, tg, th = cg[:-1, -1:], cg[-1:, :-1], cg[-1, -1], ch[-1, -1]
    hr, hl = ch[:-1, -1:], ch[-1:, :-1]
    a, ha = cg[:-1, :-1], ch[:-1, :-1]
    cells = ((a, ha), (right - a, hr - ha), (low - a, hl - ha), (tg - right - low + a, th - hr - hl + ha))
    gain = sum(x * x / (y + 1) for x, y in cells)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros(g.shape)
    for rows, cols in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
        out[rows, cols] = _newton(g[rows, cols].sum(), h[rows, cols].sum())
    return out, float(gain[i, j])


def fit(x, y) -> Additive:
    """Cyclic boosting of the logistic loss, single features first, then the strongest pairs."""
    import numpy as np

    n, k = x.shape
    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if n else np.zeros(0) for j in range(k)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    model = Additive(base, cuts, tables, [])
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    logit = np.full(n, base)
    for _ in range(ROUNDS):
        for j in range(k):
            p = 1 / (1 + np.exp(-logit))
            g, h = np.bincount(bins[j], y - p, len(tables[j])), np.bincount(bins[j], p * (1 - p), len(tables[j]))
            step = RATE * shallow_tree(g, h)
            tables[j] += step
            logit += step[bins[j]]
    coarse = [np.arange(len(t)) * PAIR_BINS // len(t) for t in tables]
    p = 1 / (1 + np.exp(-logit))
    ranked = []

    def grid(i: int, j: int, values):
        return np.bincount(coarse[i][bins[i]] * PAIR_BINS + coarse[j][bins[j]], values, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    for i in range(k):
        for j in range(i):
            ranked.append((quadrant_tree(grid(j, i, y - p), grid(j, i, p * (1 - p)))[1], j, i))
    chosen = [(i, j) for _, i, j in sorted(ranked, reverse=True)[:PAIRS]]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((PAIR_BINS, PAIR_BINS))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, a, b, table in model.pairs:
            p = 1 / (1 + np.exp(-logit))
            step = RATE * quadrant_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0]
            table += step
            logit += step[a[bins[i]], b[bins[j]]]
    return model


def held_out(ident: Column) -> Column:
    """Rows whose labels training never sees; a NULL id counts as one."""
    return F.coalesce(F.crc32(ident.cast("string")) % 4 == 2, F.lit(True))


def first_by_hash(rows: DataFrame, most: int) -> list:
    """The ``most`` rows (f, y) that come first by hash of the id, fewer if there are fewer.

    One count gives the share of the hash space that holds half as many rows again; only those are sorted, so what tasks send
    does not grow with the table. Where repeated ids leave too few of them, all rows are sorted.
    """
    order = F.xxhash64("doc_id")
    first = lambda df: df.orderBy(order, "doc_id", "y").limit(most).select("f", "y").collect()
    n = rows.count()
    if n <= 2 * most:
        return first(rows)
    found = first(rows.filter(order < F.lit(int(-(2**63) + 2**64 * 1.5 * most / n))))
    return found if len(found) == most else first(rows)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Labels are joined on doc_id (NULL labels and ids are not used; a repeated label counts as often as it comes), the sample is
    the SAMPLE rows that come first by hash of the id, fewer if there are fewer. Without labels, or with one class only, every
    score is the base rate. Features are computed once and settled; no rows give no rows.
    """
    import numpy as np
    import pyarrow as pa

    known = settle(features(docs))
    learn = labels.filter("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    sample = first_by_hash(known.filter(~held_out(F.col("doc_id"))).join(learn, "doc_id"), SAMPLE)
    model = fit(np.array([r["f"] for r in sample], "f4").reshape(len(sample), len(FEATURES)), np.array([r["y"] for r in sample], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-model.logits(x))), pa.float64())], names=["doc_id", "score"])

    scored = known.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
