"""Alignment of two tokenisers' tokens over the same bytes, by an associative composition of fragments.

Where tokens of both tokenisers end at the same byte the text is cut; what lies between two cuts is a group. A byte range of a
text gives a fragment: the open prefix before its first cut, closed groups, and the open suffix behind its last cut. Two
neighbouring fragments compose to one, the suffix and the prefix between them becoming a group, and composing is associative;
so ranges of a very long text are read by different tasks and put together by a tree of small steps. Tokens next to a range
edge come from text up to the nearest place where both tokenisers can start afresh, and a token belongs to the range it ends in.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hourglass.llm.common import byte_letters, library_encoder, settle, sliced

#: Both tokenisers start afresh at a space that follows no space and is not followed by white space: the byte-level pattern begins
#: a new match there, and no piece of the other vocabulary goes on across a space (checked when it is read).
FRESH = re.compile(r"(?<=[^ ]) (?=\S)")
TOUCHING = re.compile(r" (?:\s|\Z)|\A ")
RANGE, HALO = 65_536, 4_096  # code points of a range; code points searched for a fresh start beside a range edge
BLOCK = 4_000_000  # code points of short texts that share one table of id pairs
FAN = 16  # fragments composed at a time
REMEMBERED = 300_000  # words of one generation of the memory
LARGE = 4096  # links of a group from which its pairs are counted by distinct ids
WORD = 100  # longer words are not remembered

Ids = tuple[int, ...]


class Record(NamedTuple):
    """Closed groups: their tokens, links and linked id pairs (a << 32 | b, with how often)."""

    a: int
    b: int
    groups: int
    links: int
    exact: bool
    text: str
    pairs: list[int]
    times: list[int]


class Fragment(NamedTuple):
    """``head`` is open to the left and ends with the first cut; ``tail`` is open to the right; without a cut all is in ``head``.

    What is closed is a record of groups, or a word: a whole stretch between fresh starts.
    """

    cut: bool
    head: tuple[Ids, Ids]
    closed: tuple[Record | str, ...]
    tail: tuple[Ids, Ids]


NOTHING: tuple[Ids, Ids] = ((), ())
EMPTY = Fragment(False, NOTHING, (), NOTHING)
EDGE = Fragment(True, NOTHING, (), NOTHING)


def joined(x: tuple[Ids, Ids], y: tuple[Ids, Ids]) -> tuple[Ids, Ids]:
    return x[0] + y[0], x[1] + y[1]


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring stretches; associative, with EMPTY as neutral element."""
    if not y.cut:
        return Fragment(True, x.head, x.closed, joined(x.tail, y.head)) if x.cut else Fragment(False, joined(x.head, y.head), (), NOTHING)
    if not x.cut:
        return Fragment(True, joined(x.head, y.head), y.closed, y.tail)
    between = joined(x.tail, y.head)
    made = (group_record(*between),) if between != NOTHING else ()
    return Fragment(True, x.head, x.closed + made + y.closed, y.tail)


def _pairs_of(groups: Iterable[tuple[Ids, Ids]]) -> Counter:
    """How often each id pair is linked; large groups are counted by their distinct ids."""
    pairs: Counter = Counter()
    for a, b in groups:
        if len(a) * len(b) == 1:
            pairs[a[0] << 32 | b[0]] += 1
        else:
            right = Counter(b).items()
            for i, n in Counter(a).items():
                for j, m in right:
                    pairs[i << 32 | j] += n * m
    return pairs


def groups_record(groups: list[tuple[Ids, Ids]]) -> Record:
    pairs = _pairs_of(groups)
    text = ";".join([f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups])
    return Record(sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(len(a) * len(b) for a, b in groups), True, text, list(pairs), list(pairs.values()))


def group_record(a: Ids, b: Ids) -> Record:
    return groups_record([(a, b)])


def fragment(a: Iterable[tuple[int, int]], b: Iterable[tuple[int, int]]) -> Fragment:
    """The fragment of tokens (id, end) of both tokenisers, each in order; cuts are the ends that both have."""
    ends: dict[int, tuple[list[int], list[int]]] = {}
    for side, tokens in enumerate((a, b)):
        for ident, end in tokens:
            ends.setdefault(end, ([], []))[side].append(ident)
    parts: list[tuple[Ids, Ids]] = []
    open_: tuple[list[int], list[int]] = ([], [])
    for end in sorted(ends):
        left, right = ends[end]
        open_[0].extend(left)
        open_[1].extend(right)
        if left and right:
            parts.append((tuple(open_[0]), tuple(open_[1])))
            open_ = ([], [])
    rest = tuple(open_[0]), tuple(open_[1])
    if not parts:
        return Fragment(False, rest, (), NOTHING)
    return Fragment(True, parts[0], (groups_record(parts[1:]),) if parts[1:] else (), rest)


class Coder:
    """Tokens of both vocabularies, with a bounded memory of the ids of words (two generations)."""

    def __init__(self, byte_file: str, piece_file: str, pattern: str):
        import numpy as np
        import sentencepiece

        self.encode_a = library_encoder(byte_file, pattern, False)
        back = {letter: b for b, letter in enumerate(byte_letters())}
        with open(byte_file, encoding="utf-8") as source:
            entries = {i: bytes(back[c] for c in entry) for entry, i in json.load(source)["model"]["vocab"].items() if all(c in back for c in entry)}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of the vocabulary go on across a space")
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(t) for t in table], "int64") for table in (self.bytes_a, self.bytes_b)]
        #: Each id as it is spelled inside a group and at its end.
        self.spelled = [f"{i}{mark}" for table, end in ((self.bytes_a, "|"), (self.bytes_b, ";")) for i in range(len(table)) for mark in (",", end)]
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def ids(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of distinct words in both vocabularies, as little-endian 32-bit numbers; each is encoded with the space before it."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        out = [known.get(w) or older.get(w) for w in words]
        missing = [i for i, got in enumerate(out) if got is None]
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            fresh = [words[i] for i in part]
            for i, a, b in zip(part, self.encode_a([" " + w for w in fresh]), self.model.encode(fresh, num_threads=1), strict=True):
                out[i] = array("I", a).tobytes(), array("I", b).tobytes()
        for w, got in zip(words, out, strict=True):
            if len(w) <= WORD:
                known[w] = got
        return out

    def ended(self, word: str, start: int = 0) -> list[list[tuple[int, int]]] | None:
        """Ids of a word with the byte places where their tokens end, by vocabulary; None where they do not spell it."""
        import numpy as np

        out = []
        for coded, table in zip(self.ids([word])[0], (self.bytes_a, self.bytes_b), strict=True):
            ids = np.frombuffer(coded, "<u4").tolist()
            if b"".join([table[i] for i in ids]) != b" " + word.encode():
                return None
            out.append(list(zip(ids, (start + np.cumsum([len(table[i]) for i in ids])).tolist(), strict=True)))
        return out


class Words(NamedTuple):
    """Arrays over words (tokens, groups, links, whether the tokens spell them), their texts (each group ends with ``;``), and the id
    pairs of all words in order, with how often and how many rows each word has."""

    a: object
    b: object
    groups: object
    links: object
    exact: object
    texts: list[str]
    pairs: object
    times: object
    counts: object


def words_aligned(coder: Coder, words: list[str]) -> Words:
    """All words aligned at once: their bytes lie one behind the other, and every word's end is a cut."""
    import numpy as np

    count = len(words)
    coded = coder.ids(words)
    plain = [b" " + w.encode() for w in words]
    size = np.array([len(p) for p in plain], "int64")
    exact = np.ones(count, bool)
    sides = []
    for side, table in enumerate((coder.bytes_a, coder.bytes_b)):
        raw = [c[side] for c in coded]
        ids = np.frombuffer(b"".join(raw), "<u4").astype("int64")
        each = np.array([len(r) for r in raw], "int64") // 4
        if b"".join([table[i] for i in ids.tolist()]) != b"".join(plain):
            for i, r in enumerate(raw):
                exact[i] &= b"".join([table[j] for j in np.frombuffer(r, "<u4").tolist()]) == plain[i]
        sides.append((ids, each))
    (a, n_a), (b, n_b) = [(ids[np.repeat(exact, each)], np.where(exact, each, 0)) for ids, each in sides]
    ends = [np.cumsum(sizes[ids]) for sizes, ids in zip(coder.sizes, (a, b), strict=True)]
    cuts = np.intersect1d(*ends, assume_unique=True)
    group_a, group_b = (np.searchsorted(cuts, e) for e in ends)
    in_a, in_b = (np.bincount(g, minlength=len(cuts)) for g in (group_a, group_b))
    kept = np.flatnonzero(exact)
    word = kept[np.searchsorted(np.cumsum(size[kept]), cuts)]
    links = in_a * in_b
    total = lambda values: np.bincount(word, values, count).astype("int64")

    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    codes = np.empty(len(a) + len(b), "int64")
    codes[np.arange(len(a)) + first_b[group_a]] = 2 * a + (np.arange(len(a)) == (first_a + in_a - 1)[group_a])
    codes[np.arange(len(b)) + (first_a + in_a)[group_b]] = 2 * (len(coder.bytes_a) + b) + (np.arange(len(b)) == (first_b + in_b - 1)[group_b])
    spelled = list(map(coder.spelled.__getitem__, codes.tolist()))
    edges = np.cumsum(n_a + n_b).tolist()
    texts = ["".join(spelled[x:y]) for x, y in zip([0, *edges], edges, strict=False)]

    small = links <= LARGE
    mine = np.flatnonzero(small[group_a])
    each = in_b[group_a[mine]]
    right = np.repeat(first_b[group_a[mine]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    pairs, of = np.repeat(a[mine], each) << 32 | b[right], np.repeat(word[group_a[mine]], each)
    times = np.ones(len(pairs), "int64")
    if not small.all():
        for g in np.flatnonzero(~small).tolist():
            found = _pairs_of([(tuple(a[first_a[g] : first_a[g] + in_a[g]].tolist()), tuple(b[first_b[g] : first_b[g] + in_b[g]].tolist()))])
            pairs, times = np.append(pairs, list(found)), np.append(times, list(found.values()))
            of = np.append(of, np.full(len(found), word[g]))
        order = np.argsort(of, kind="stable")
        pairs, times, of = pairs[order], times[order], of[order]
    return Words(n_a, n_b, total(None), total(links), exact, texts, pairs, times, np.bincount(of, minlength=count))


@lru_cache(maxsize=2)
def _coder(byte_file: str, piece_file: str, pattern: str) -> Coder:
    return Coder(byte_file, piece_file, pattern)


def words_of(text: str) -> list[str]:
    """The stretches between fresh starts of space + text, each without the space before it."""
    return FRESH.split(text) if TOUCHING.search(text) else text.split(" ")


class Numbers(dict):
    """Numbers of closed stretches in the order of their first use."""

    def __init__(self):
        super().__init__()
        self.items_ = []

    def __missing__(self, item) -> int:
        self[item] = n = len(self.items_)
        self.items_.append(item)
        return n


UNIT = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "exact": "boolean", "text": "string", "refs": "array<int>", "times": "array<int>"}


class Block:
    """Words of several texts, or the closed stretches of one range, and the table of id pairs that they share."""

    def __init__(self):
        self.numbers, self.units, self.records, self.size = Numbers(), [], [], 0

    def add(self, closed) -> None:
        """One more unit: words, and records of groups, in order."""
        import numpy as np

        held = []
        for c in closed:
            if isinstance(c, Record):
                self.records.append(c)
                held.append(-len(self.records))
            else:
                held.append(self.numbers[c])
        self.units.append(np.array(held, "int64"))

    def add_words(self, words: list[str]) -> None:
        import numpy as np

        self.units.append(np.fromiter(map(self.numbers.__getitem__, words), "int64", len(words)))

    def tables(self, coder: Coder, digest: bool):
        """Columns of UNIT for every unit, and (a, b, units that hold the pair) of the shared pairs; ``text`` is digested or whole."""
        import numpy as np

        made = words_aligned(coder, self.numbers.items_)
        more = self.records[::-1]  # a record has a number below 0, which counts from the end
        joined_ = lambda values, name: np.concatenate([values, np.array([getattr(r, name) for r in more], values.dtype)])
        table = [joined_(values, name) for values, name in zip(made[:4], Record._fields, strict=False)]
        texts = made.texts + [r.text + ";" for r in more]
        fine = joined_(made.exact, "exact")
        exact = np.array([bool(fine[u].all()) for u in self.units], bool)
        units = [u % len(texts) if ok and len(u) else u[:0] for u, ok in zip(self.units, exact, strict=True)]
        sums = [[int(values[u].sum()) for u in units] for values in table]
        spelled = ["".join([texts[i] for i in u.tolist()])[:-1] for u in units]
        if digest:
            spelled = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in spelled]

        counts = np.concatenate([made.counts, np.array([len(r.pairs) for r in more], "int64")])
        packed = np.concatenate([made.pairs, np.array([p for r in more for p in r.pairs], "int64")])
        times = np.concatenate([made.times, np.array([n for r in more for n in r.times], "int64")])
        pairs, ref = np.unique(packed, return_inverse=True)
        first = np.cumsum(counts) - counts
        # stretches of each unit, once with how often; then their pairs, once with how often
        flat = np.concatenate([*units, np.zeros(0, "int64")])
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        word, often = np.unique(unit * max(1, len(texts)) + flat, return_counts=True)
        unit, flat = np.divmod(word, max(1, len(texts)))
        each = counts[flat]
        place = np.repeat(first[flat] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        held, where = np.unique(np.repeat(unit, each) * max(1, len(pairs)) + ref[place], return_inverse=True)
        weight = np.bincount(where, np.repeat(often, each) * times[place], len(held)).astype("int64")
        unit, ref = np.divmod(held, max(1, len(pairs)))
        edges = np.searchsorted(unit, np.arange(len(units) + 1))
        return (*sums, exact.tolist(), spelled, (edges, ref), (edges, weight)), (pairs >> 32, pairs & 0xFFFFFFFF, np.bincount(ref, minlength=len(pairs)))


def _lists(edges, values):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(edges.astype("int32")), pa.array(values.astype("int32")))


PAIRS = {"pair_a": "array<int>", "pair_b": "array<int>", "pair_units": "array<int>"}
OPEN = {"cut": "boolean", "head_a": "array<int>", "head_b": "array<int>", "tail_a": "array<int>", "tail_b": "array<int>"}
SHORT = {"block": "long", "doc_id": "long"} | UNIT | PAIRS
LEAVES = {"block": "long", "key": "long", "part": "int", "doc_id": "long"} | UNIT | PAIRS | OPEN


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


def _rows(coder: Coder, lead: list, block: Block, digest: bool, behind: list):
    """An Arrow batch with the units of a block; the first row carries the table of pairs."""
    import numpy as np
    import pyarrow as pa

    (a, b, groups, links, exact, text, refs, times), table = block.tables(coder, digest)
    edges = np.concatenate([[0], np.full(len(text), len(table[0]))])
    longs = [pa.array(c, pa.int64()) for c in (a, b, groups, links)]
    shared = [_lists(edges, np.asarray(t)) for t in table]
    return [*lead, *longs, pa.array(exact, pa.bool_()), pa.array(text, pa.string()), _lists(*refs), _lists(*times), *shared, *behind]


def short_units(docs: DataFrame, byte_file: str, piece_file: str, pattern: str) -> DataFrame:
    """One row per text (columns SHORT), in blocks whose first row carries the block's id pairs."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = _coder(byte_file, piece_file, pattern), TaskContext.get().partitionId() << 32
        block, ids = Block(), []

        def done() -> pa.RecordBatch:
            lead = [pa.array([number] * len(ids), pa.int64()), pa.array(ids, pa.int64())]
            return pa.RecordBatch.from_arrays(_rows(coder, lead, block, True, []), names=list(SHORT))

        for batch in batches:
            for part in sliced(batch):
                for text in part.column(1).to_pylist():
                    block.add_words(words_of(text) if text else [])
                    block.size += len(text)
                ids += part.column(0).to_pylist()
                if block.size > BLOCK or len(ids) >= 16_384:
                    yield done()
                    block, ids, number = Block(), [], number + 1
        if ids:
            yield done()

    return docs.select("doc_id", "text").mapInArrow(run, _schema(SHORT))


def cut_ranges(text: str, size: int, halo: int) -> Iterator[tuple[int, int, int, str]]:
    """(first byte, last byte, byte where the given text begins, text without the space before it) of ranges of space + text.

    Range edges lie every ``size`` code points, in the middle of tokens too; an edge with no fresh start within ``halo`` on
    either side is left out. The text of a range begins and ends at the fresh starts around it.
    """
    whole = " " + text
    edges = [(0, 0, 0)]
    for at in range(size, len(whole), size):
        before = [m.start() for m in FRESH.finditer(whole, max(0, at - halo), at + 2) if m.start() <= at]
        after = FRESH.search(whole, at, min(len(whole), at + halo))
        if before and after:
            edges.append((before[-1], at, after.start()))
    edges.append((len(whole),) * 3)
    places = sorted({p for e in edges for p in e})
    byte, total = {}, 0
    for a, b in zip([0, *places], places, strict=False):
        total += len(whole[a:b].encode())
        byte[b] = total
    byte[0] = 0
    for (from_, start, _), (_, end, to) in zip(edges, edges[1:], strict=False):
        yield byte[start], byte[end], byte[from_], whole[from_ + 1 : to]


def ranges(docs: DataFrame, size: int, halo: int) -> DataFrame:
    """The ranges of texts, with a key for each input row (unique once written)."""
    import pyarrow as pa

    names = "key long, doc_id long, part int, first long, last long, begin long, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [(key, doc_id, k, *r) for k, r in enumerate(cut_ranges(text, size, halo))]
                key += 1
                for at in range(0, len(parts), 64):
                    columns = zip(*parts[at : at + 64], strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[n.split()[0] for n in names.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, names)


BAD = Record(0, 0, 0, 0, False, "", [], [])


def range_fragment(coder: Coder, first: int, last: int, begin: int, text: str) -> Fragment:
    """The fragment of the bytes (first, last], from a text that begins at byte ``begin``; closed is BAD where tokens do not spell
    a word at an edge."""
    made, inside, at = EDGE if first == 0 else EMPTY, [], begin
    for w in words_of(text):
        start, at = at, at + 1 + len(w.encode())
        if first <= start and at <= last:
            inside.append(w)
            continue
        if inside:
            made, inside = compose(made, Fragment(True, NOTHING, tuple(inside), NOTHING)), []
        if (sides := coder.ended(w, start)) is None:
            return Fragment(True, NOTHING, (BAD,), NOTHING)
        made = compose(made, fragment(*[[t for t in side if first < t[1] <= last] for side in sides]))
    return compose(made, Fragment(True, NOTHING, tuple(inside), NOTHING)) if inside else made


def leaves(parts: DataFrame, byte_file: str, piece_file: str, pattern: str) -> DataFrame:
    """One row per range (columns LEAVES): closed groups as a unit with its own pairs, open prefix and suffix as ids."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = _coder(byte_file, piece_file, pattern), -1 - (TaskContext.get().partitionId() << 32)
        ids = pa.list_(pa.int32())
        for batch in batches:
            for row in batch.to_pylist():
                made = range_fragment(coder, row["first"], row["last"], row["begin"], row["text"])
                block = Block()
                block.add(made.closed)
                lead = [pa.array([v], k) for v, k in ((number, pa.int64()), (row["key"], pa.int64()), (row["part"], pa.int32()), (row["doc_id"], pa.int64()))]
                open_ = [pa.array([made.cut], pa.bool_()), *[pa.array([list(side)], ids) for side in (*made.head, *made.tail)]]
                yield pa.RecordBatch.from_arrays(_rows(coder, lead, block, False, open_), names=list(LEAVES))
                number -= 1

    return parts.mapInArrow(run, _schema(LEAVES))


JOINTS = {"n_a": "long", "n_b": "long", "n_links": "long", "text": "string", "pair_a": "array<int>", "pair_b": "array<int>", "times": "array<int>"}
NODES = {"key": "long", "part": "int", "last": "int"} | OPEN | JOINTS


def _composed(table):
    """The fragments of one group composed in order: a row of the result, and a row for each group that closes between them."""
    import pyarrow as pa

    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    made, last, joints = EMPTY, None, []
    for r in rows:
        nxt = Fragment(r["cut"], (tuple(r["head_a"]), tuple(r["head_b"])), (), (tuple(r["tail_a"]), tuple(r["tail_b"])))
        made = compose(made, nxt)
        for g in made.closed:
            shared = {"n_a": g.a, "n_b": g.b, "n_links": g.links, "text": g.text, "times": g.times}
            joints.append({"key": r["key"], "last": last, "pair_a": [p >> 32 for p in g.pairs], "pair_b": [p & 0xFFFFFFFF for p in g.pairs]} | shared)
        made = made._replace(closed=())
        if r["cut"]:
            last = r["last"]
    root = {"key": rows[0]["key"], "part": rows[0]["part"] // FAN, "last": last, "cut": made.cut}
    root |= {"head_a": made.head[0], "head_b": made.head[1], "tail_a": made.tail[0], "tail_b": made.tail[1]}
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.Table.from_pylist([root, *joints], schema=pa.schema([(k, types[t]) for k, t in NODES.items()]))


def tree(found: DataFrame) -> DataFrame | None:
    """Groups that close between ranges, by composing FAN neighbouring fragments at a time until each text has one.

    A level shuffles open prefixes and suffixes only and is settled; there are log_FAN(ranges of the longest text) levels.
    ``last`` is the range behind whose groups the group comes.
    """
    most = found.agg(F.max("part")).first()[0]
    nodes, closed = found.select("key", "part", F.col("part").alias("last"), *OPEN), None
    while most:
        level = settle(nodes.groupBy("key", F.floor(F.col("part") / FAN)).applyInArrow(_composed, _schema(NODES)))
        here = level.filter("part is null").select("key", "last", *JOINTS)
        closed = here if closed is None else closed.union(here)
        nodes, most = level.filter("part is not null").select("key", "part", "last", *OPEN), most // FAN
    return closed


def ordered_digest(pieces: DataFrame) -> DataFrame:
    """(key, sha256 of the texts joined by ``;`` in the order of part and step) where no text is empty; a task holds one batch at a time."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.hexdigest()])], names=["key", "sha"])

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if state is None or k != key:
                    if state is not None:
                        yield row()
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b";")
                state.update(text.as_buffer())
        if state is not None:
            yield row()

    laid = pieces.filter("text <> ''").repartition("key").sortWithinPartitions("key", "part", "step")
    return laid.select("key", "text").mapInArrow(run, "key long, sha string")


VALUES = {"key": "long", "doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups_sha256": "string"}


def _valued(units, values):
    """n_best and count_sum of the units of one block, from the counts of its pairs."""
    import numpy as np
    import pyarrow as pa

    pos = values.column("pos").to_numpy()
    count, best = np.zeros((2, pos.max(initial=-1) + 1), "int64")
    count[pos], best[pos] = values.column("n_docs").to_numpy(), values.column("best").to_numpy()
    refs, times = units.column("refs").combine_chunks(), units.column("times").combine_chunks()
    edges = np.concatenate([[0], np.cumsum(refs.value_lengths().to_numpy())])
    ref, often = refs.flatten().to_numpy(), times.flatten().to_numpy().astype("int64")
    total = lambda v: np.concatenate([[0], np.cumsum(v[ref] * often)])[edges]
    made = {"n_best": pa.array(np.diff(total(best))), "count_sum": pa.array(np.diff(total(count)))}
    return pa.table([made.get(c, None) if c in made else units.column(c) for c in VALUES], names=list(VALUES))


class Alignment(NamedTuple):
    """``documents``: a row per input row. ``pairs``: (a, b, n_docs, best), the translation table of linked ids."""

    documents: DataFrame
    pairs: DataFrame


def pair_counts(held: DataFrame) -> DataFrame:
    """(a, b, n_docs, best) from rows (a, b, n_docs) that may repeat; an id has at most as many partners as the other vocabulary ids."""
    counted = settle(held.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs")))
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    return settle(counted.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).cast("long").alias("best")))


def align(docs: DataFrame, byte_file: str, piece_file: str, pattern: str, size: int = RANGE, halo: int = HALO) -> Alignment:
    """Alignment of the tokens of every row's whole text in both vocabularies.

    documents has doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; other input columns are ignored. A NULL
    or empty text, and one whose tokens do not spell it again, has zeros and an empty digest, and counts for no pair. Repeated rows
    are documents of their own, whatever their ids; a NULL doc_id stays NULL. Ties of the highest count are all best. No rows
    give no rows. Texts of more than ``size`` code points are cut into byte ranges, which are separate work.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = settle(short_units(source.filter(F.length("text") <= size), byte_file, piece_file, pattern))
    cut = settle(ranges(source.filter(F.length("text") > size), size, halo))
    tasks = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = settle(leaves(cut.repartition(tasks, "key", "part"), byte_file, piece_file, pattern))
    bad = found.filter("not exact").select("key").distinct()
    good = found.join(bad, "key", "left_anti")
    closed = tree(good)

    a_and_b = lambda df, *more: df.select("key", F.explode(F.arrays_zip("pair_a", "pair_b", *more)).alias("p")).select("key", "p.*").withColumnsRenamed({"pair_a": "a", "pair_b": "b"})
    held = short.select(F.explode(F.arrays_zip("pair_a", "pair_b", "pair_units")).alias("p")).filter("p.pair_units > 0").select(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_units").cast("long").alias("n_docs"))
    long_pairs = a_and_b(good) if closed is None else a_and_b(good).union(a_and_b(closed))
    pairs = pair_counts(held.union(long_pairs.distinct().select("a", "b", F.lit(1).cast("long").alias("n_docs"))))

    sums = ["n_a", "n_b", "n_groups", "n_links"]
    one = short.select("block", F.lit(None).cast("long").alias("key"), "doc_id", *sums, F.col("text").alias("groups_sha256"), "refs", "times", "pair_a", "pair_b")
    units = one.union(good.select("block", "key", "doc_id", *sums, F.lit(None).cast("string"), "refs", "times", "pair_a", "pair_b"))
    shared = units.select(F.col("block").alias("at"), F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("pos", "p")).select("at", "pos", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"))
    values = shared.join(pairs, ["a", "b"]).select("at", "pos", "n_docs", "best")
    valued = units.drop("pair_a", "pair_b").groupBy("block").cogroup(values.groupBy("at")).applyInArrow(_valued, _schema(VALUES))
    if closed is None and found.isEmpty():
        return Alignment(valued.drop("key"), pairs)

    valued = settle(valued)
    parts = valued.filter("key is not null").select("key", *sums, "n_best", "count_sum")
    texts = good.select("key", "part", F.lit(0).alias("step"), "text")
    if closed is not None:
        mine = a_and_b(closed, "times").join(pairs, ["a", "b"]).select("key", *[F.lit(0).cast("long").alias(c) for c in sums], (F.col("best") * F.col("times")).alias("n_best"), (F.col("n_docs") * F.col("times")).alias("count_sum"))
        counts = closed.select("key", "n_a", "n_b", F.lit(1).cast("long"), "n_links", F.lit(0).cast("long"), F.lit(0).cast("long"))
        parts = parts.union(mine).union(counts)
        texts = texts.union(closed.select("key", F.col("last").alias("part"), F.lit(1), "text"))
    added = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in [*sums, "n_best", "count_sum"]])
    names = cut.filter("part = 0").select("key", "doc_id")
    whole = names.join(added, "key", "left").join(ordered_digest(texts), "key", "left").withColumnRenamed("sha", "groups_sha256")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in [*sums, "n_best", "count_sum"]]
    long_rows = whole.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return Alignment(valued.filter("key is null").drop("key").union(long_rows), pairs)
