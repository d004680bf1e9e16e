"""Helpers shared by the text operators: reading, settling, key ranges, groups of linked rows, cached tokenisation."""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Callable, Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourglass.operators.lineage import shared_folder

#: The white space that contracts name, as a character class body valid in Java, DuckDB and Python.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Write rows as a Parquet table in the shared folder and read them back.

    Cuts the lineage so that a lost executor costs a re-read, and fixes what later passes see. Files stay until the folder is
    cleared: the returned frame reads them lazily.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets_wanted(spark: SparkSession, per_partition: int = 2) -> int:
    """Key ranges to cut: a fixed multiple of the session's shuffle partitions, so that hashing them fills partitions evenly."""
    return max(2, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_splits(ids: DataFrame, buckets: int) -> list[int]:
    """At most ``buckets - 1`` ascending ids that cut the column ``doc_id`` into ranges of about equal row counts."""
    shares = [i / buckets for i in range(1, buckets)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 20 * buckets)).first()[0]
    return sorted(set(found or []))


def range_of(value: Column, splits: list[int]) -> Column:
    """Number of splits not above ``value`` (its range, from 0), by bisection; NULL values belong to range 0."""
    if not splits:
        return F.lit(0)
    edges = F.array(*[F.lit(s) for s in splits])
    steps = len(splits).bit_length()
    low_high = F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = ((a.lo + a.hi) / 2).cast("int")
        above = F.element_at(edges, mid + 1) <= value
        done = a.lo >= a.hi
        return F.struct(F.when(~done & above, mid + 1).otherwise(a.lo).alias("lo"), F.when(done | above, a.hi).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), low_high, halve, lambda a: a.lo)
    return F.when(value.isNull(), F.lit(0)).otherwise(found)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b), where root is the smallest node of its component.

    Links point from the larger to the smaller node. Each round passes a link on to the smallest node its end is linked to, then
    ties all that one node is linked to to the smallest of them (large star, then small star), so the longest chain halves; it ends
    when every node but the roots has one link, to a root. A round only shuffles links and is settled; a root's links are the
    split side of a left join, whose other side has one row a node. The driver sees one row. Empty edges give no rows.
    """
    links = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        ends = links.selectExpr("a AS n", "1 AS o", "0 AS i").union(links.selectExpr("b AS n", "0 AS o", "1 AS i"))
        seen = ends.groupBy("n").agg(F.sum("o").alias("o"), F.max("i").alias("i")).agg(F.max(F.col("o") + F.least("i", "o")).alias("most")).first()
        if seen.most is None or seen.most == 1:
            break
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        down = links.join(least.withColumnRenamed("a", "n"), links.b == F.col("n"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        kept = down.join(down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), F.col("a") == F.col("n"))
        links = settle(kept.select("a", F.col("m").alias("b")).union(kept.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class ChunkTokens:
    """Ids of texts as little-endian unsigned 32-bit bytes, remembering the ids of chunks between single spaces.

    ``encode`` maps strings to lists of ids. ``lead`` says that a chunk is encoded with the space before it; texts in which a
    space touches other white space or the end are then encoded whole. The memory is cleared when it holds ``most`` bytes.
    """

    TOUCHING = re.compile(r" (?:\s|\Z)")

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], lead: bool, most: int = 320_000_000):
        self.encode, self.lead, self.most, self.held, self.known, self.older = encode, lead, most, 0, {}, {}

    def _learn(self, keys: set[str]) -> None:
        """Know all keys. Two generations: what was not asked for while one generation filled up is forgotten."""
        if self.held > self.most / 2:
            self.older, self.known, self.held = self.known, {}, 0
        known = self.known
        missing = [key for key in keys if key not in known]
        if self.older:
            kept = {key: coded for key in missing if (coded := self.older.get(key)) is not None}
            known |= kept
            self.held += sum(len(coded) + 4 * len(key) + 120 for key, coded in kept.items())
            missing = [key for key in missing if key not in kept]
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            for key, ids in zip(part, self.encode(part), strict=True):
                self.known[key] = coded = array("I", ids).tobytes()
                self.held += len(coded) + 4 * len(key) + 120

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = []
        for t in texts:
            if not self.lead:
                split.append([c for c in t.replace("\n", " ").split(" ") if c])
            elif self.TOUCHING.search(t):
                split.append([t])
            else:
                head, *rest = t.split(" ")
                split.append([head, *[" " + c for c in rest]] if head else [" " + c for c in rest])
        wanted: set[str] = set()
        for chunks in split:
            wanted.update(chunks)
        self._learn(wanted)
        out = [b"".join(map(self.known.__getitem__, chunks)) for chunks in split]
        for c in [c for c in wanted if len(c) > 100]:
            self.held -= len(self.known.pop(c)) + 4 * len(c) + 120
        return out


def byte_letters() -> list[str]:
    """One printable character for each byte value: itself where Latin-1 prints it, else the next free one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, free = [], 0x100
    for b in range(256):
        letters.append(chr(b if b in printable else free))
        free += b not in printable
    return letters


def library_encoder(path: str, pattern: str, fold: bool) -> Callable[[list[str]], list[list[int]]]:
    """Ids by the tokenizers library for the byte-level file at ``path``; special token strings in a text are ordinary text.

    Strings below U+0250 need no Unicode tables: they are folded to lower case (``fold``), split by ``pattern`` and passed to the
    library's merge model. All others go through the library's whole chain.
    """
    import os

    import regex

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    merge, find, table = whole.model.tokenize, regex.compile(pattern).findall, dict(enumerate(byte_letters()))

    def encode(texts: list[str]) -> list[list[int]]:
        seen: dict[str, list[int]] = {}
        out = []
        for t in texts:
            if not t.isascii() and max(t) > "\u024f":
                out.append(whole.encode(t, add_special_tokens=False).ids)
                continue
            ids: list[int] = []
            for word in find(t.lower() if fold else t):
                if (got := seen.get(word)) is None:
                    mapped = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(table)
                    seen[word] = got = [token.id for token in merge(mapped)]
                ids += got
            out.append(ids)
        return out

    return encode


class _Chunks(dict):
    """Coded chunks that are worked out when first asked for."""

    def __init__(self, code: Callable[[str], bytes]):
        super().__init__()
        self.code = code

    def __missing__(self, chunk: str) -> bytes:
        return self.code(chunk)


class RankTokens:
    """Ids of texts as little-endian unsigned 32-bit bytes, by the merge ranks of the byte-level file at ``path``.

    Merges become ranks in their order for the tiktoken library, and ranks become the file's ids afterwards; that equals the file's
    own library where every merge makes a token of its own. Strings beyond U+024F (Unicode tables may differ there) and strings
    that may hold long runs (ranks are merged in quadratic time) are left to ``library_encoder``, as is everything if two merges
    make one token. Texts are cut at single spaces and the ids of chunks are remembered in two generations of ``most`` / 2 bytes;
    texts in which a space touches other white space or the end are encoded whole. Python workers outlive their tasks with what
    they remember, so ``most`` counts once for every core of an executor; the library is loaded when a string needs it.
    """

    LONG = 400
    RUN = re.compile(r"\S{%d}|\s{%d}" % (LONG, LONG))

    def __init__(self, path: str, pattern: str, most: int = 40_000_000):
        import json

        import tiktoken

        self.path, self.pattern, self.most, self.held, self.older = path, pattern, most, 0, {}
        self.known = _Chunks(self._learn)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        ranks = {bytes([b]): b for b in range(256)}
        ids = [model["vocab"].get(c) for c in letters]
        for merge in model["merges"]:
            token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            ranks[bytes(byte[c] for c in token)] = len(ids)
            ids.append(model["vocab"][token])
        self.ranked = None
        if len(ranks) == len(ids) and None not in ids:
            self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.coded = [i.to_bytes(4, "little") for i in ids]

    @cached_property
    def library(self) -> Callable[[list[str]], list[list[int]]]:
        return library_encoder(self.path, self.pattern, False)

    def encode(self, text: str) -> bytes:
        if self.ranked and (text.isascii() or max(text) <= "\u024f") and (len(text) < self.LONG or not self.RUN.search(text)):
            return b"".join(map(self.coded.__getitem__, self.ranked(text)))
        return array("I", self.library([text])[0]).tobytes()

    def _learn(self, chunk: str) -> bytes:
        coded = self.older.get(chunk)
        if coded is None:
            coded = self.encode(" " + chunk)
        if len(chunk) <= 100:
            self.known[chunk] = coded
            self.held += len(coded) + 4 * len(chunk) + 120
        return coded

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if self.held > self.most / 2:
                self.older, self.known, self.held = self.known, _Chunks(self._learn), 0
            if ChunkTokens.TOUCHING.search(t):
                out.append(self.encode(t))
            else:
                head, *rest = t.split(" ")
                out.append(b"".join([self.encode(head), *map(self.known.__getitem__, rest)]))
        return out


class WordTokens:
    """Ids of texts as little-endian unsigned 32-bit bytes, by the tokenizers library for the word-end vocabulary at ``path``.

    Equals ``library_encoder`` with ``fold`` on chunks between single spaces and line ends. A chunk is put together from its
    words, which are remembered like chunks, so that capitals and punctuation around a word do not merge it again. What is
    remembered has two generations of ``most`` / 2 bytes.
    """

    def __init__(self, path: str, pattern: str, most: int = 120_000_000):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.most, self.held, self.older = most, 0, {}
        self.known = _Chunks(self._learn)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.merge, self.find = self.whole.model.tokenize, regex.compile(pattern).findall
        letters = byte_letters()
        self.table = {n: "".join(letters[b] for b in chr(n).encode()) for n in range(0x250)}

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isalnum() else word.translate(self.table)
        return array("I", [token.id for token in self.merge(mapped)]).tobytes()

    def _encode(self, chunk: str) -> bytes:
        if not chunk.isascii() and max(chunk) > "\u024f":
            return array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()
        low = chunk.lower()
        words = [low] if low.isalpha() else self.find(low)
        return b"".join([self._word(w) if w == chunk else self.known[w] for w in words])

    def _learn(self, chunk: str) -> bytes:
        coded = self.older.get(chunk)
        if coded is None:
            coded = self._encode(chunk)
        if len(chunk) <= 100:
            self.known[chunk] = coded
            self.held += len(coded) + 4 * len(chunk) + 120
        return coded

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if self.held > self.most / 2:
                self.older, self.known, self.held = self.known, _Chunks(self._learn), 0
            out.append(b"".join(map(self.known.__getitem__, t.replace("\n", " ").split(" "))))
        return out


class _Ranks:
    """Ids of texts as little-endian unsigned 32-bit bytes, by the merge ranks of the vocabulary at ``path``; nothing is remembered.

    All texts of a call are cut into pieces by array operations on the classes of their characters and merged by one call of the
    tiktoken library, a NUL after each piece and \\x01 as a piece of its own after each text. Texts beyond U+024F, with one of these
    two characters or with a piece over LONG bytes (ranks are merged in quadratic time) are left to ``library``, as is everything if
    two merges make one token. With a suffix for word ends in the vocabulary, the NUL belongs to the piece and stands for it: its byte
    merges with the one before it first of all.
    """

    LONG = 400
    SPACE, LETTER, NUMBER, OTHER, END = range(5)

    def __init__(self, path: str):
        import json

        import numpy as np
        import regex
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, suffix = byte_letters(), model.get("end_of_word_suffix") or ""
        byte = {c: bytes([b]) for b, c in enumerate(letters)}
        raw = lambda t: b"".join(map(byte.__getitem__, t.removesuffix(suffix))) + b"\0" * (suffix != "" and t.endswith(suffix))
        ranks = {bytes([b]): b for b in range(256)} | ({bytes([b, 0]): 256 + b for b in range(256)} if suffix else {})
        ids = [model["vocab"].get(c) for c in [*letters, *([c + suffix for c in letters] if suffix else ())]]
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            ranks[raw(left) + raw(right)] = len(ids)
            ids.append(model["vocab"][left + right])
        self.ranked = None
        if len(ranks) == len(ids) and None not in ids:
            piece = r"[^\x00]+\x00" if suffix else r"[^\x00]+"
            self.ranked = tiktoken.Encoding("ranks", pat_str=piece, mergeable_ranks=ranks, special_tokens={"\0\0\0": len(ids)}).encode_to_numpy
            self.ids, self.text_end = np.array(ids, "<u4"), ranks[b"\x01\0" if suffix else b"\x01"]
        self.kinds = np.full(1 << 16, self.OTHER, "u1")
        known = "".join(map(chr, range(0x3000)))  # small letters of those below U+0250 included
        for kind, pattern in ((self.SPACE, r"\s"), (self.LETTER, r"\p{L}"), (self.NUMBER, r"\p{N}"), (self.END, r"\x01")):
            self.kinds[[ord(c) for c in regex.findall(pattern, known)]] = kind

    def _cut(self, chars, kinds):
        """Marks in the order of ``chars``: a piece starts there. Characters that no piece has become NULs."""
        raise NotImplementedError

    def _contractions(self, chars, kinds, starts, free) -> None:
        """A quote that starts a piece (``free``: by the place before it) and s, t, m, d, re, ve or ll are one piece."""
        import numpy as np

        quotes = np.flatnonzero(chars[:-2] == ord("'"))
        quotes = quotes[(quotes == 0) | free[quotes - 1]]
        first, second = chars[quotes + 1], chars[quotes + 2]
        short = np.isin(first, [*map(ord, "stmd")])
        long = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        starts[quotes[short | long] + 1] = False
        starts[quotes[short] + 2] = True
        starts[quotes[long] + 3] = True

    def _pieces(self, texts: list[str]) -> str:
        import numpy as np

        chars = np.frombuffer("\x01".join([*texts, "", ""]).encode("utf-16-le"), "<u2").copy()
        starts = self._cut(chars, self.kinds[chars])
        out = np.zeros(len(chars) + np.count_nonzero(starts), "<u2")
        out[np.arange(len(chars)) + np.cumsum(starts)] = chars
        return out[:-1].tobytes().decode("utf-16-le")

    def _plain(self, text: str) -> bool:
        import numpy as np

        return "\0" not in text and "\x01" not in text and (text.isascii() or np.frombuffer(text.encode("utf-16-le"), "<u2").max() <= 0x24F)

    def __call__(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        plain = [self.ranked is not None and self._plain(t) for t in texts]
        pieces = self._pieces([t for t, ok in zip(texts, plain, strict=True) if ok])
        if not pieces:
            return self.library(texts)
        ends = np.flatnonzero(np.frombuffer(pieces.encode(), "u1") == 0)
        if np.diff(ends, prepend=-1).max() > self.LONG:
            return [c for t in texts for c in self([t])] if len(texts) > 1 else self.library(texts)
        ranks = self.ranked(pieces, disallowed_special=())
        cuts = (4 * np.flatnonzero(ranks == self.text_end)).tolist()
        coded = self.ids[ranks].tobytes()
        found = iter([coded[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], cuts, strict=False)])
        rest = iter(self.library(others) if (others := [t for t, ok in zip(texts, plain, strict=True) if not ok]) else ())
        return [next(found if ok else rest) for ok in plain]


#: The pattern of the word-end vocabulary's own file: what it matches are the words, the rest is dropped.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class WordRanks(_Ranks):
    """Equals ``WordTokens`` with WORD_PATTERN: words in lower case."""

    @cached_property
    def library(self) -> WordTokens:
        return WordTokens(self.path, WORD_PATTERN)

    def _pieces(self, texts: list[str]) -> str:
        return super()._pieces([t.lower() for t in texts])

    def _cut(self, chars, kinds):
        import numpy as np

        starts = np.concatenate([[False], (kinds[1:] != kinds[:-1]) | (kinds[1:] == self.NUMBER) | (kinds[1:] == self.END)])
        self._contractions(chars, kinds, starts, kinds != self.OTHER)
        chars[kinds == self.SPACE] = 0
        return starts


#: The pattern of byte-level vocabularies: a space belongs to what follows it, other white space stands alone.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteRanks(_Ranks):
    """Equals ``RankTokens`` with BYTE_PATTERN."""

    @cached_property
    def library(self) -> RankTokens:
        return RankTokens(self.path, BYTE_PATTERN)

    def _cut(self, chars, kinds):
        import numpy as np

        starts = np.concatenate([[False], (kinds[1:] != kinds[:-1]) | (kinds[1:] == self.END)])
        space, blank = kinds == self.SPACE, chars == ord(" ")
        last = np.flatnonzero(space[:-1] & ~space[1:] & (kinds[1:] != self.END))  # of white space before something else
        starts[last[(last > 0) & space[last - 1]]] = True
        starts[last[blank[last]] + 1] = False
        self._contractions(chars, kinds, starts, (kinds != self.OTHER) & ~blank)
        return starts


def set_aside(df: DataFrame, used: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """The frame with all columns but ``used`` renamed out of the way, and the columns that name them back, in their order."""
    used = set(used)
    names = {c: f"__given_{i}" for i, c in enumerate(df.columns) if c not in used}
    return df.withColumnsRenamed(names), [F.col(names.get(c, f"`{c}`")).alias(c) for c in df.columns]


def sliced(batch, rows: int = 128):
    """An Arrow batch in slices of few rows, so that what a task derives from long texts stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)

