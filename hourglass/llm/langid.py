"""Language identification by a byte convolutional network, trained in numpy on a bounded sample of labelled text.

Bytes are embedded, filters of several widths slide over a fixed-length window, each filter keeps its largest response in the
window, and a softmax layer gives the languages. A text is cut into windows without a rest and their probabilities are averaged
by length. For prediction, embedding and filters are folded into tables of byte pairs, so a window costs look-ups and additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hourglass.llm.common import sliced

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 24
EMBEDDING = 8
#: The bound of the training sample: so many documents of each language, so many windows of each.
SAMPLE_PER_LANGUAGE, WINDOWS_PER_DOCUMENT = 700, 3


@dataclass
class Net:
    languages: list[str]
    embedding: object
    filters: list
    biases: list
    dense: object
    dense_bias: object


def held_out(ident: Column) -> Column:
    """Rows that training never sees; a NULL id counts as one."""
    return F.coalesce(F.crc32(ident.cast("string")) % 3 == 1, F.lit(True))


def training_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """At most SAMPLE_PER_LANGUAGE texts of each language, chosen by hash of id and text, as windows from all over the text.

    Repeated rows have equal hashes and count once before anything reaches the driver, so one id on many rows stays bounded.
    """
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    draw = (F.xxhash64("doc_id", "text") / float(2**64) + 0.5).alias("draw")
    shares = reduce(lambda c, kv: c.when(F.col("lang") == kv[0], F.lit(min(1.0, 1.5 * SAMPLE_PER_LANGUAGE / kv[1]))), counts.items(), F.when(F.lit(False), 0.0))
    n = F.length("text")
    parts = F.array(*[F.substr("text", F.floor(n * k / WINDOWS_PER_DOCUMENT).cast("int") + 1, F.lit(WINDOW)) for k in range(WINDOWS_PER_DOCUMENT)])
    rows = usable.withColumn("draw", draw).filter(F.col("draw") < shares).select("lang", "draw", F.array_distinct(parts).alias("parts")).dropDuplicates(["lang", "draw"]).collect()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["draw"], r["lang"], r["parts"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= SAMPLE_PER_LANGUAGE:
            out += [(r["lang"], p) for p in r["parts"] if p]
    return out


def scrambled(sample: list[tuple[str, str]], name: str, seed: int = 7) -> list[tuple[str, str]]:
    """Texts in no language, under ``name``: a window in three with its characters in random order, or as many random printable ones."""
    import random

    draw = random.Random(seed)
    out = []
    for at, (_, text) in enumerate(sample):
        if at % 3 == 0:
            out.append((name, "".join(draw.sample(text, len(text)))))
        elif at % 3 == 1:
            out.append((name, "".join(map(chr, draw.choices(range(0x21, 0x7F), k=len(text))))))
    return out


def as_windows(data: list[bytes]):
    """Byte strings of at most WINDOW bytes as rows, padded with zeros."""
    import numpy as np

    out = np.zeros((len(data), WINDOW), "u1")
    for row, d in zip(out, data, strict=True):
        row[: len(d)] = np.frombuffer(d, "u1")
    return out


def train(sample: list[tuple[str, str]], epochs: int = 4, batch: int = 64, rate: float = 0.004, seed: int = 5) -> Net | None:
    """Adam on cross-entropy with balanced classes; half of the windows are shortened at random, so short texts are learned too."""
    import numpy as np

    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    label = np.array([languages.index(lang) for lang, _ in sample])
    draw = np.random.default_rng(seed)
    x = as_windows([t.encode()[:WINDOW] for _, t in sample])
    c = len(languages)
    weight = (len(label) / c / np.bincount(label, minlength=c))[label].astype("f4")
    p = {"e": draw.normal(0, 0.3, (256, EMBEDDING)), "d": draw.normal(0, 0.1, (FILTERS * len(WIDTHS), c)), "c": np.zeros(c)}
    for w in WIDTHS:
        p |= {f"w{w}": draw.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)), f"b{w}": np.zeros(FILTERS)}
    p = {k: v.astype("f4") for k, v in p.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            xb = x[rows].copy()
            for row, cut in zip(xb, draw.integers(8, 2 * WINDOW, len(rows)), strict=True):
                row[cut:] = 0
            emb = p["e"][xb]
            hidden, where, cols = [], [], []
            for w in WIDTHS:
                col = np.concatenate([emb[:, k : WINDOW - w + 1 + k] for k in range(w)], 2)
                response = col @ p[f"w{w}"]
                best = response.argmax(1)
                cols.append(col)
                where.append(best)
                hidden.append(np.take_along_axis(response, best[:, None], 1)[:, 0] + p[f"b{w}"])
            z = np.concatenate(hidden, 1)
            h = np.maximum(z, 0)
            logits = h @ p["d"] + p["c"]
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            delta = prob
            delta[np.arange(len(rows)), label[rows]] -= 1
            delta *= weight[rows, None] / len(rows)
            grad = {"d": h.T @ delta, "c": delta.sum(0), "e": np.zeros_like(p["e"])}
            dz = (delta @ p["d"].T) * (z > 0)
            for n, w in enumerate(WIDTHS):
                dw = dz[:, n * FILTERS : (n + 1) * FILTERS]
                picked = np.take_along_axis(cols[n], where[n][:, :, None], 1)  # batch x filters x inputs
                grad[f"w{w}"] = np.einsum("bfi,bf->if", picked, dw)
                grad[f"b{w}"] = dw.sum(0)
                back = (dw[:, :, None] * p[f"w{w}"].T[None]).reshape(len(rows), FILTERS, w, EMBEDDING)
                spots = where[n][:, :, None] + np.arange(w)
                np.add.at(grad["e"], xb[np.arange(len(rows))[:, None, None], spots], back)
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return Net(languages, p["e"], [p[f"w{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["d"], p["c"])


class Scorer:
    """The network as look-up tables: filters of width w are sums over byte pairs and a last byte.

    Tables cover the pairs of bytes seen so far, printable ASCII from the start, and are made anew for new bytes; sums stay the same.
    """

    def __init__(self, net: Net):
        import numpy as np

        self.net, self.seen = net, np.zeros(256, bool)
        self.bias = np.concatenate(net.biases)
        self._cover(np.r_[0, 0x20:0x7F])

    def _cover(self, values) -> None:
        import numpy as np

        self.seen[values] = True
        used = np.flatnonzero(self.seen)
        self.place, self.tables = np.zeros(256, "i4"), []
        self.place[used] = np.arange(len(used))
        for w, f in zip(WIDTHS, self.net.filters, strict=True):
            single = [(self.net.embedding @ f[k * EMBEDDING : (k + 1) * EMBEDDING])[used] for k in range(w)]
            pairs = [(single[k][:, None] + single[k + 1][None]).reshape(len(used) ** 2, -1).astype("f4", copy=False) for k in range(0, w - 1, 2)]
            self.tables.append((w, pairs, single[-1].astype("f4") if w % 2 else None))

    def windows(self, x):
        """Probabilities of the languages for rows of WINDOW bytes."""
        import numpy as np

        out = []
        for at in range(0, len(x), 64):
            present = np.flatnonzero(np.bincount(x[at : at + 64].ravel(), minlength=256))
            if not self.seen[present].all():
                self._cover(present)
            part, size = self.place[x[at : at + 64]], int(self.seen.sum())
            pair = part[:, :-1] * size + part[:, 1:]
            hidden = []
            for w, pairs, last in self.tables:
                n = WINDOW - w + 1
                total = pairs[0][pair[:, :n]]
                for k, table in enumerate(pairs[1:], 1):
                    total += table[pair[:, 2 * k : 2 * k + n]]
                if last is not None:
                    total += last[part[:, w - 1 :]]
                hidden.append(total.max(1))
            logits = np.maximum(np.concatenate(hidden, 1) + self.bias, 0) @ self.net.dense + self.net.dense_bias
            prob = np.exp(logits - logits.max(1, keepdims=True))
            out.append(prob / prob.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.net.languages)))

    def texts(self, texts: list[str]):
        """Mean probabilities of every whole text, windows weighted by their bytes; an empty text is one empty window."""
        import numpy as np

        data = [t.encode() for t in texts]
        cut = [[d[a : a + WINDOW] for a in range(0, max(1, len(d)), WINDOW)] for d in data]
        counts = np.array([len(c) for c in cut])
        flat = [w for c in cut for w in c]
        total = np.zeros((len(texts), len(self.net.languages)))
        owner = np.repeat(np.arange(len(texts)), counts)
        for at in range(0, len(flat), 4096):
            probability = self.windows(as_windows(flat[at : at + 4096]))
            sizes = np.array([max(1, len(w)) for w in flat[at : at + 4096]], float)
            np.add.at(total, owner[at : at + 4096], probability * sizes[:, None])
        return total / total.sum(1, keepdims=True)


def predict(docs: DataFrame, net: Net | None, text: str = "text") -> DataFrame:
    """The rows with lang_pred and score. A NULL text or one without a letter is ``und`` with score 0, as is every text when there
    was nothing to learn from. A narrow map; columns named like results are replaced; repeated rows get equal results."""
    import pyarrow as pa

    kept = docs.drop("lang_pred", "score", "__letters")
    if net is None:
        return kept.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    marked = kept.withColumn("__letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    names = kept.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields], "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            for part in sliced(batch):
                texts = part.column(names.index(text)).to_pylist()
                letters = part.column(len(names)).to_pylist()
                mean = iter(scorer.texts([t for t, ok in zip(texts, letters, strict=True) if ok]) if any(letters) else ())
                found = [(net.languages[(m := next(mean)).argmax()], min(1.0, float(m.max()))) if ok else ("und", 0.0) for ok in letters]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return marked.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Train on a sample of ``docs`` and predict all of them: doc_id, held_out, lang_pred, score."""
    net = train(training_sample(docs))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
