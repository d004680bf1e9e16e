"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash space is kept.

A shingle is five words in a row (all words of a shorter text). The same fraction holds for every text, so sketches merge by
union, and containment of a short text in a long one is estimated as well as likeness of equals. The smallest hash of a text is
kept as well, so that a short text has a fingerprint too; estimates use it only where nothing lies below the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from hourglass.llm.common import buckets_wanted, id_splits, range_of

WORDS = 5
FRACTION = 1 / 8
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def word_hashes(texts: list[str]):
    """64-bit hashes of all white-space separated words of ``texts`` and the offsets of each text; distinct words are hashed once."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    words = lists.values.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()), "u8", len(words.dictionary))
    real = np.fromiter((w != "" for w in words.dictionary.to_pylist()), bool, len(words.dictionary))
    codes = words.indices.to_numpy()
    keep = real[codes] if len(codes) else np.zeros(0, bool)
    offsets = np.concatenate([[0], np.cumsum(keep)])[lists.offsets.to_numpy()]
    return (table[codes[keep]] if len(codes) else np.zeros(0, "u8")), offsets


def mix(x):
    """A bijection of 64-bit numbers that spreads every input bit."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str], words: int = WORDS):
    """For each text the hashes of its word shingles, in text order and with repeats; none for a text without words."""
    import numpy as np

    hashes, offsets = word_hashes(texts)
    with np.errstate(over="ignore"):
        joined = np.zeros(len(hashes), "u8")
        for k in range(words):
            joined = mix(joined + np.uint64(0x9E3779B97F4A7C15) + np.concatenate([hashes[k:], np.zeros(min(k, len(hashes)), "u8")]))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= words:
            yield joined[a : b - words + 1]
        elif b > a:
            with np.errstate(over="ignore"):
                h = np.zeros(1, "u8")
                for x in hashes[a:b]:
                    h = mix(h + np.uint64(0x9E3779B97F4A7C15) + x)
            yield mix(h + np.uint64(b - a))
        else:
            yield joined[:0]


def sketches(texts: list[str], fraction: float = FRACTION, words: int = WORDS) -> list:
    """Ascending distinct hashes below the threshold, and the smallest hash in any case."""
    import numpy as np

    top = np.uint64(int(fraction * 2**64) - 1)
    out = []
    for h in shingle_hashes(texts, words):
        low = h[h <= top]
        out.append(np.unique(low) if len(low) else h.min(keepdims=True) if len(h) else h)
    return out


def likeness(a, b) -> float:
    """Estimated Jaccard similarity; two texts without words are alike."""
    import numpy as np

    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common) if len(a) or len(b) else 1.0


def containment(a, b) -> float:
    """Estimated share of the shorter text's shingles that the other one has."""
    import numpy as np

    least = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / least if least else float(not len(a) and not len(b))


def as_text(sketch) -> str:
    """Sixteen hexadecimal digits for each hash, ascending."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(fingerprint: str):
    import numpy as np

    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype("u8")


def edited_pairs(docs: DataFrame, fraction: float = FRACTION, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text (last quarter replaced by as much of the next document), and estimates.

    Documents follow each other by doc_id (NULL first, equal ids by text hash), the last by the first. Ids are cut into ranges
    of about equal row counts; the rows of a range's first id are copied to the range before, so each range finds all its
    successors without a global order. NULL text counts as empty; repeated rows each get a row; an empty table gives none.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    splits = id_splits(rows.select("doc_id"), buckets_wanted(spark))
    placed = rows.withColumn("at", range_of(F.col("doc_id"), splits))
    # the first id of every range that has rows: a few numbers, as many as there are ranges
    firsts = sorted((r["at"], r["id"]) for r in placed.select("at", "doc_id").groupBy("at").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("id")).collect())
    heads = {i: firsts[k - 1][0] for k, (_, i) in enumerate(firsts)}  # first id of a range -> the range before, cyclically
    if not firsts:
        return spark.createDataFrame([], OUT)
    back = F.create_map(*[F.lit(x) for pair in heads.items() for x in pair])
    before = back[F.coalesce("doc_id", F.lit(-(2**63)))]
    both = placed.select("doc_id", "text", F.explode(F.when(before.isNull(), F.array(F.struct("at", F.lit(False).alias("halo")))).otherwise(F.array(F.struct("at", F.lit(False).alias("halo")), F.struct(before.alias("at"), F.lit(True).alias("halo"))))).alias("p"))
    # only the first quarter of what the longest predecessor needs is unknown here, so a copied row carries its whole text
    dealt = both.select("doc_id", "text", "p.at", "p.halo").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "at").sortWithinPartitions("at", "halo", F.asc_nulls_first("doc_id"), F.xxhash64("text"))

    def emit(pairs: list[tuple]) -> pa.RecordBatch:
        texts, edited, n = [], [], []
        for (_, text), (_, following) in pairs:
            q = len(text) // 4
            texts.append(text)
            n.append(len(text))
            edited.append(text[: len(text) - q] + following[:q])
        own = sketches([*texts, pairs[-1][1][1]], fraction, words)
        new = sketches(edited, fraction, words)
        mine, following = own[:-1], own[1:]
        chained = all(pairs[i][1] is pairs[i + 1][0] for i in range(len(pairs) - 1))
        if not chained:
            following = sketches([p[1][1] for p in pairs], fraction, words)
        columns = [pa.array([p[0][0] for p in pairs], pa.int64()), pa.array(n, pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited])]
        columns += [pa.array([as_text(x) for x in mine]), pa.array([as_text(x) for x in new])]
        columns += [pa.array([f(x, y) for x, y in zip(mine, others, strict=True)], pa.float64()) for f, others in ((likeness, new), (likeness, following), (containment, new), (containment, following))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, closed, pairs = None, None, True, []
        for batch in batches:
            for doc_id, text, where, halo in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if where != at:
                    held, at, closed = None, where, False
                if closed:
                    continue  # more rows with the id of the successor
                row = (doc_id, text)
                if held is not None:
                    pairs.append((held, row))
                held, closed = row, halo
                if len(pairs) >= 128:
                    yield emit(pairs)
                    pairs = []
        if pairs:
            yield emit(pairs)

    return dealt.mapInArrow(run, OUT)
