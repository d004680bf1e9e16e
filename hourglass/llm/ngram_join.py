"""Jaccard self-join on word 5-grams with Bayesian candidate pruning.

Banded MinHash proposes candidates: texts with one band key. MinHash values are compared a few at a time: a pair is dropped once
the posterior probability that it reaches the threshold is below the tolerance. Each text is first compared with the smallest
text of its key, which ties copies together at linear cost; then, inside keys that still hold texts of several groups, those of
different groups meet. Only pairs that pruning leaves join groups, never a shared key. Groups are verified on the exact 5-gram sets.
Large keys and groups are cut into blocks that meet in pairs. Pairs exist only inside a task; what leaves it is one row per
document: how many links it has there, and one link that keeps its class together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from hourglass.llm.common import components, settle, sliced
from hourglass.llm.fingerprint import WORDS, mix, shingle_hashes, word_hashes

BANDS, ROWS = 32, 4
BLOCK = 384  # texts that meet in one task
WIDE = 2048  # signatures that meet in one task
TOLERANCE = 1e-9
STEP = 16
SKETCH = "doc_id long, version long, words binary, n int, sig binary, bands array<long>"


def _functions():
    import numpy as np

    draw = np.random.default_rng(20)
    return draw.integers(0, 2**32, BANDS * ROWS, "u4") | np.uint32(1), draw.integers(0, 2**32, BANDS * ROWS, "u4")


def signatures(sets: list):
    """MinHash values, one row of BANDS * ROWS numbers for each array of shingle hashes."""
    import numpy as np

    a, b = _functions()
    out = np.full((len(sets), len(a)), 0xFFFFFFFF, "u4")
    with np.errstate(over="ignore"):
        for i, h in enumerate(sets):
            small = (h >> np.uint64(32)).astype("u4")
            for at in range(0, len(small), 2048):
                np.minimum(out[i], (small[at : at + 2048, None] * a + b).min(0), out=out[i])
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """Per row: a 128-bit name of its word sequence, the number of its words, an 8-bit signature and its band keys."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            for part in sliced(batch, 256):
                texts = part.column(2).to_pylist()
                hashes, offsets = word_hashes(texts)
                names = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                values = signatures(list(shingle_hashes(texts)))
                short = ((values ^ (values >> np.uint32(16))) & np.uint32(255)).astype("u1")
                with np.errstate(over="ignore"):
                    keys = np.broadcast_to(np.arange(BANDS, dtype="u8"), (len(texts), BANDS)).copy()
                    for k in range(ROWS):
                        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, k::ROWS])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype="i4") * BANDS), pa.array(keys.view("i8").ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.binary()), pa.array(np.diff(offsets).astype("i4")), pa.array([s.tobytes() for s in short], pa.binary()), bands], names=[c.split()[0] for c in SKETCH.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SKETCH)


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For STEP, 2 STEP, ... compared values: the fewest matches at which the posterior of reaching the threshold is not below the tolerance.

    The match probability has a uniform prior; 8-bit values also match by chance, which only raises the probability to reach.
    P(p >= p0 | m of t) = P(Binomial(t + 1, p0) <= m).
    """
    from math import comb

    p0 = threshold + (1 - threshold) / 256
    out = []
    for t in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(t + 1, m) * p0**m * (1 - p0) ** (t + 1 - m)
        out.append(m)
    return tuple(out)


def plausible_pairs(left, right, same: bool, threshold: float, tolerance: float):
    """Index pairs of two signature matrices that pruning leaves (i < j when both are the same matrix)."""
    import numpy as np

    need = least_matches(threshold, tolerance)
    found = np.zeros((len(left), len(right)), "i2")
    for k in range(STEP):
        found += left[:, k, None] == right[None, :, k]
    alive = found >= need[0]
    if same:
        alive = np.triu(alive, 1)
    i, j = np.nonzero(alive)
    count = found[i, j]
    for n, at in enumerate(range(STEP, left.shape[1], STEP)):
        count = count + (left[i, at : at + STEP] == right[j, at : at + STEP]).sum(1)
        keep = count >= need[n + 1]
        i, j, count = i[keep], j[keep], count[keep]
    return i, j


def exact_shingles(texts: list[str]):
    """Integer names of the distinct word 5-grams of each text: equal names mean equal 5-grams (no hashing). Returns names, owners."""
    import numpy as np

    import re

    ids: dict[str, int] = {}
    codes, owner = [], []
    for k, t in enumerate(texts):
        words = [ids.setdefault(w, len(ids) + 1) for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        words += [0] * (WORDS - len(words)) if words else []
        codes += words + [-1] * (WORDS - 1)
        owner += [k] * (len(words) + WORDS - 1)
    c, owner = np.array(codes, "i8"), np.array(owner, "i8")
    n = len(c) - WORDS + 1
    if n <= 0:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    whole = np.ones(n, bool)
    for k in range(WORDS):
        whole &= c[k : n + k] >= 0
    starts = np.flatnonzero(whole)
    name = c[starts]
    for k in range(1, WORDS):
        _, name = np.unique(name * (len(ids) + 1) + c[starts + k], return_inverse=True)
    pairs = np.unique(name * len(texts) + owner[starts])
    return pairs // len(texts), pairs % len(texts)


def common_counts(names, owners, n: int, left, right, i, j):
    """Number of common 5-grams for the index pairs (left[i], right[j])."""
    import numpy as np

    if not len(i):
        return np.zeros(0, "i8")
    distinct, place, count = np.unique(names, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    column = np.cumsum(count > 1)[place[shared]] - 1
    row = owners[shared]
    if len(i) * 2 < n:
        sets = {k: column[row == k] for k in {*left[i].tolist(), *right[j].tolist()}}
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left[i].tolist(), right[j].tolist(), strict=True)], "i8")
    total = np.zeros((len(left), len(right)), "f4")
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        dense = np.zeros((n, width), "f4")
        dense[row[a:b], column[a:b] - at] = 1
        total += dense[left] @ dense[right].T
    return total[i, j].astype("i8")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, pairs) -> list[int]:
        for a, b in pairs:
            a, b = self.top(a), self.top(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)
        return [self.top(x) for x in range(len(self.up))]


def plausible_links(pairs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` (a, b, left_sig, right_sig) that pruning leaves."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        need = least_matches(threshold, tolerance)
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "u1").reshape(-1, BANDS * ROWS) for k in (2, 3))
            at, count = np.arange(batch.num_rows), np.zeros(batch.num_rows, "i4")
            for k, least in enumerate(need):
                part = slice(k * STEP, (k + 1) * STEP)
                count = count + (left[at, part] == right[at, part]).sum(1)
                at, count = at[count >= least], count[count >= least]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["a", "b"])

    return pairs.select("a", "b", "left_sig", "right_sig").mapInArrow(run, "a long, b long")


def compare_blocks(members: DataFrame, threshold: float, tolerance: float, texts: DataFrame | None = None) -> DataFrame:
    """(a, b, links) for members (root, node, copies, sig) of candidate groups ``root``; with ``texts`` (doc_id, version, text)
    members name the row that holds theirs by doc_id and version.

    Groups of more than a block are cut into blocks, every pair of blocks is one task group; small groups share task groups.
    ``a`` is linked to ``b`` (or to itself only); ``links`` counts, with copies, the documents of this task group that are linked
    to ``a``. Without texts members have ``known``, what ties them already, and ``main``, whether that is the tie of most: pairs of
    one tie are left out, blocks of main members do not meet, and a link is a pair that pruning leaves. With texts it is a pair
    whose exact similarity suffices.
    """
    import pyarrow as pa

    exact = texts is not None
    block = BLOCK if exact else WIDE
    members = members.withColumns({"known": F.lit(0).cast("long"), "main": F.lit(False)}) if exact else members
    sizes = members.groupBy("root").agg(F.count_if(~F.col("main")).alias("others"), F.count_if("main").alias("mains"))
    # a shuffle join at every size: whether the members would fit a broadcast depends on the data
    rows = texts.join(members.hint("merge"), ["doc_id", "version"]).dropDuplicates(["node"]) if exact else members
    cut = lambda n: F.ceil(F.col(n) / block).cast("int")
    blocked = rows.join(sizes, "root").withColumns({"free": cut("others"), "tied": cut("mains"), "small": F.col("others") + F.col("mains") <= block})
    place = F.xxhash64("node")
    blocked = blocked.withColumn("own", F.when(F.col("main"), F.col("free") + F.pmod(place, F.col("tied"))).otherwise(F.pmod(place, F.col("free"))).cast("int"))
    packs = max(1, members.count() // 128)
    last = F.when(F.col("main"), F.col("free")).otherwise(F.col("free") + F.col("tied")) - 1
    meets = F.explode(F.transform(F.when(F.col("small"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last)), lambda t: F.struct(F.least("own", t).alias("i"), F.greatest("own", t).alias("j")))).alias("m")
    dealt = blocked.select("*", meets).select(
        F.when(F.col("small"), F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(F.col("root")).alias("g"),
        F.when(F.col("small"), -1).otherwise(F.col("m.i")).alias("i"), F.when(F.col("small"), -1).otherwise(F.col("m.j")).alias("j"),
        "root", "node", "known", "copies", "own", "sig", *(["text"] if exact else []),
    )

    def compare(table: pa.Table) -> pa.Table:
        import numpy as np

        root, node, known, copies, own = (table.column(k).to_numpy() for k in ("root", "node", "known", "copies", "own"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "u1").reshape(len(node), -1)
        names = owners = None
        if exact:
            names, owners = exact_shingles(table.column("text").to_pylist())
            sizes = np.bincount(owners, minlength=len(node))
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        links, tied = np.zeros(len(node), "i8"), []
        order = np.argsort(root, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            same = first == second or first < 0
            left, right = (part, part) if same else (part[own[part] == first], part[own[part] == second])
            i, j = plausible_pairs(sig[left], sig[right], same, threshold, tolerance)
            if not exact:
                apart = known[left[i]] != known[right[j]]
                i, j = i[apart], j[apart]
            elif len(i):
                mine = np.isin(owners, part)
                both = common_counts(names[mine], owners[mine], len(node), left, right, i, j)
                whole = sizes[left[i]] + sizes[right[j]] - both
                real = both * 1_000_000 >= round(threshold * 1_000_000) * whole
                i, j = i[real], j[real]
            a, b = left[i], right[j]
            links += np.bincount(a, copies[b], len(node)).astype("i8") + np.bincount(b, copies[a], len(node)).astype("i8")
            tied.append(np.stack([a, b], 1))
        tops = _Forest(len(node)).tie(np.concatenate(tied).tolist())
        seen = np.flatnonzero((links > 0) | (np.arange(len(node)) != tops))
        return pa.table({"a": pa.array(node[seen], pa.int64()), "b": pa.array(node[np.array(tops, "i8")[seen]], pa.int64()), "links": pa.array(links[seen], pa.int64())})

    return dealt.groupBy("g", "i", "j").applyInArrow(compare, "a long, b long, links long")


def plausible_groups(reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(node, root): the closure of the pairs of ``reps`` (node, copies, sig, bands) that share a band key and that pruning leaves."""
    keyed = reps.select("node", F.explode("bands").alias("key"))
    met = keyed.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    shared = settle(keyed.join(met, "key"))
    sigs = reps.select("node", "sig")
    pairs = shared.filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    pairs = pairs.join(sigs.toDF("b", "right_sig").hint("merge"), "b").join(sigs.toDF("a", "left_sig").hint("merge"), "a")
    stars = settle(components(plausible_links(pairs, threshold, tolerance)))
    tie = stars.withColumnRenamed("root", "tie")
    # two texts of a key have met, as one of them is the smallest
    tagged = shared.filter("n > 2").join(tie, "node", "left").withColumn("known", F.coalesce("tie", "node"))
    mixed = tagged.groupBy("key").agg(F.min("known").alias("low"), F.max("known").alias("high"), F.max(F.when(F.col("node") == F.col("a"), F.col("known"))).alias("centre"))
    left = tagged.select("key", "node", "known").join(mixed.filter("low < high").select("key", "centre"), "key").join(reps.select("node", "copies", "sig"), "node")
    members = settle(left.select(F.col("key").alias("root"), "node", "copies", "sig", "known", (F.col("known") == F.col("centre")).alias("main")))
    across = compare_blocks(members, threshold, tolerance).select("a", "b")
    return components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).union(across))


def linked_rows(docs: DataFrame, threshold: float = 0.8, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, version (hash of the text), class_id and n_links of every row; see ``jaccard_join``.

    The nodes of the graph are word sequences under a 64-bit name, so texts that share a doc_id stay apart.
    """
    rows = settle(sketch(docs).withColumn("node", F.when(F.expr("doc_id IS NOT NULL AND n > 0"), F.xxhash64("words"))))
    first = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "version", "sig", "bands")).alias("f"), F.count("*").alias("copies"))
    reps = settle(first.select("node", "f.doc_id", "f.version", "copies", "f.sig", "f.bands"))
    refined = plausible_groups(reps, threshold, tolerance)
    members = settle(refined.join(reps.select("node", "doc_id", "version", "copies", "sig"), "node"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    linked = settle(compare_blocks(members, threshold, tolerance, texts))
    counts = linked.groupBy("a").agg(F.sum("links").alias("links"))
    classes = components(linked.select("a", "b"))
    ids = reps.select("node", "doc_id", "copies")
    with_root = ids.join(classes, "node", "left").select("node", "doc_id", "copies", F.coalesce("root", "node").alias("root"))
    # a root has as many rows as its class has texts, so its smallest id is found with map-side combine and a class is split by the skew join
    least = classes.join(ids, "node").groupBy("root").agg(F.min("doc_id").alias("least"))
    per_text = with_root.join(least, "root", "left").join(counts, F.col("node") == F.col("a"), "left")
    found = per_text.select("node", F.coalesce("least", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = rows.select("doc_id", "version", "node").join(found, "node", "left")
    return joined.select("doc_id", "version", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id and n_links of every row: documents linked to it (Jaccard of 5-gram sets >= threshold), and its class.

    Words are what ASCII white space separates; a text of fewer than five words is one shingle; a text without words (NULL
    or empty) links with nothing. Rows with equal word sequences are copies: they link with each other and share all links.
    class_id is the smallest doc_id that links reach. Rows that share a doc_id but not their words are separate texts with links
    of their own; a NULL doc_id gets NULL class_id and 0 links. No rows give no rows. A pair of similarity s is proposed by at
    least one band with probability 1 - (1 - s^4)^32: at 0.8 all but 5 pairs in 100 million.
    """
    return linked_rows(docs, threshold, tolerance).drop("version")
