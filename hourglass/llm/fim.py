"""Fill-in-the-middle by displacement: every byte of a batch moves by a shift that is constant between cuts.

Unit ends are scanned over the bytes of all texts of a slice at once. The cuts of each document give three segments with one
shift each; differences of shifts, put at the cuts and summed up, give the output place of every byte, and one scatter builds
all outputs. Restoring reads the three markers from the outputs, makes the inverse shifts in the same way and gathers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

RESULTS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "fim_text": "string"}
RATE, SUFFIX_FIRST = 50, 80  # of 100 documents so many are rearranged; of 100 rearranged ones so many begin with the suffix
WINDOW = 1 << 22  # bytes moved at a time
SLICE_ROWS, SLICE_BYTES = 4096, 8_000_000


def text_slices(batch, column: int, rows: int = SLICE_ROWS, most: int = SLICE_BYTES):
    """Parts of an Arrow batch of few rows and few bytes of text (one text at least)."""
    import numpy as np

    sizes = text_bytes(batch.column(column))[1][1:]
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(sizes, before + most, "right"))))
        yield batch.slice(at, end - at)
        at = end


def text_bytes(array):
    """The UTF-8 bytes of an Arrow string array without NULLs, and the offsets of its texts in them."""
    import numpy as np
    import pyarrow as pa

    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    edges = np.frombuffer(offsets, "int64" if wide else "int32")[array.offset : array.offset + len(array) + 1].astype("int64")
    whole = np.frombuffer(data, "uint8")[edges[0] : edges[-1]] if data is not None else np.zeros(0, "uint8")
    return whole, edges - edges[0]


def as_strings(data, offsets):
    import pyarrow as pa

    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype("int32").tobytes()), pa.py_buffer(data))


def unit_ends(data, offsets):
    """Positions after each unit (white space with the word after it, or white space at the end of a text), ascending."""
    import numpy as np

    space = np.zeros(256, bool)
    space[[0x20, *range(9, 14)]] = True
    blank = space[data]
    last = ~blank
    last[:-1] &= blank[1:]
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return np.flatnonzero(last) + 1


def markers(data, offsets):
    """Places of ``<P>``, ``<S>`` and ``<M>`` inside single texts: (position, letter, text)."""
    import numpy as np

    if len(data) < 3:
        return (np.zeros(0, "int64"),) * 3
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")))
    at = at[np.isin(data[at + 1], [ord(c) for c in "PSM"])]
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[row + 1]
    return at[inside], data[at[inside] + 1], row[inside]


def shifts(starts, values, size: int, window: int = WINDOW):
    """Windows (from, to, shift of each byte) over ``size`` bytes, where from ``starts[i]`` on bytes move by ``values[i]``.

    ``starts`` ascend; of segments with the same start the last one counts, since the differences add up.
    """
    import numpy as np

    deltas = np.diff(values, prepend=0)
    carry = 0
    for a in range(0, size, window):
        b = min(size, a + window)
        i, j = np.searchsorted(starts, [a, b])
        change = np.zeros(b - a, "int64")
        np.add.at(change, starts[i:j] - a, deltas[i:j])
        moved = np.cumsum(change) + carry
        carry = moved[-1]
        yield a, b, moved


def _draws(seed: str, ident) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(data, offsets, ids: list, seed: str, rate: int, suffix_first: int):
    """(n, form, prefix_chars, middle_chars, output bytes, output offsets) of the texts of one slice."""
    import numpy as np

    count = len(offsets) - 1
    start, end = offsets[:-1], offsets[1:]
    ends = unit_ends(data, offsets)
    first = np.searchsorted(ends, start, "right")
    n = np.searchsorted(ends, end, "right") - first
    draw = np.array([_draws(seed, i) for i in ids], "int64").reshape(count, 4)
    cut = np.sort(draw[:, :2] % (n + 1)[:, None], 1)
    place = np.concatenate([[0], ends])
    after = lambda k: np.where(k == 0, start, place[np.where(k == 0, 0, first + k)])
    p, m = after(cut[:, 0]), after(cut[:, 1])
    plain = (n == 0) | (draw[:, 2] % 100 >= rate)
    plain[markers(data, offsets)[2]] = True
    spm = ~plain & (draw[:, 3] % 100 < suffix_first)
    psm = ~plain & ~spm

    out_offsets = np.concatenate([[0], np.cumsum(end - start + np.where(plain, 0, 9))])
    o, prefix, suffix = out_offsets[:-1], p - start, end - m
    to_prefix = np.where(plain, o, np.where(spm, o + suffix + 6, o + 3))
    to_suffix = np.where(spm, o + 3, o + prefix + 6)
    to_middle = o + prefix + suffix + 9
    plain_shift = o - start
    moves = np.stack([to_prefix - start, np.where(plain, plain_shift, to_middle - p), np.where(plain, plain_shift, to_suffix - m)], 1).ravel()
    out = np.empty(out_offsets[-1], "uint8")
    for a, b, moved in shifts(np.stack([start, p, m], 1).ravel(), moves, len(data)):
        out[np.arange(a, b) + moved] = data[a:b]
    for letter, before, rows in (("P", to_prefix, ~plain), ("S", to_suffix, ~plain), ("M", to_middle, ~plain)):
        out[before[rows, None] + np.arange(-3, 0)] = np.frombuffer(f"<{letter}>".encode(), "uint8")

    edges = np.unique(np.concatenate([[0], start, p, m, [len(data)]]))
    heads = np.add.reduceat((data & 0xC0) != 0x80, edges[:-1], dtype="int64") if len(data) else np.zeros(0, "int64")
    chars = np.concatenate([[0], np.cumsum(heads)])
    at = lambda x: chars[np.searchsorted(edges, x)]
    form = np.where(plain, "plain", np.where(psm, "psm", "spm"))
    return n, form, (at(p) - at(start), at(m) - at(p), plain), out, out_offsets


def put_back(data, offsets, forms: list[str]):
    """(bytes, offsets) of the original texts, from outputs and their forms alone."""
    import numpy as np

    form = np.array(forms, dtype=object)
    moved = np.flatnonzero(form != "plain")
    at, letter, row = markers(data, offsets)
    mine = np.isin(row, moved)
    at, letter = at[mine], letter[mine]
    if len(at) != 3 * len(moved) or (letter.reshape(-1, 3) != np.where((form[moved] == "spm")[:, None], list(b"SPM"), list(b"PSM"))).any():
        raise ValueError("a rearranged text does not have one marker of each kind in the order of its form")
    at = at.reshape(-1, 3)
    start, end = offsets[:-1], offsets[1:]
    size = end - start
    size[moved] -= 9
    new = np.concatenate([[0], np.cumsum(size)])
    here = new[:-1]
    begins, moves = np.stack([here] * 3, 1), np.stack([start - here] * 3, 1)
    if len(moved):
        spm = form[moved] == "spm"
        one, two, three = at[:, 0] + 3, at[:, 1] + 3, at[:, 2] + 3
        first_size, second_size = at[:, 1] - one, at[:, 2] - two
        prefix, suffix = np.where(spm, two, one), np.where(spm, one, two)
        prefix_size = np.where(spm, second_size, first_size)
        middle_size = end[moved] - three
        to = np.stack([here[moved], here[moved] + prefix_size, here[moved] + prefix_size + middle_size], 1)
        begins[moved], moves[moved] = to, np.stack([prefix, three, suffix], 1) - to
    out = np.empty(new[-1], "uint8")
    for a, b, by in shifts(begins.ravel(), moves.ravel(), int(new[-1])):
        out[a:b] = data[np.arange(a, b) + by]
    return out, new


def _mapped(source: DataFrame, carried: list[str], added: dict[str, str], inputs: list[str], work) -> DataFrame:
    """The carried columns and what ``work`` makes of the input columns of each slice; the first input is the text."""
    import pyarrow as pa

    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in carried], *[f"{k} {v}" for k, v in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [batch.schema.get_field_index(c) for c in inputs]
            for part in text_slices(batch, places[0]):
                made = work(*[part.column(i) for i in places])
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in carried], *made], names=[*carried, *added])

    return source.mapInArrow(run, schema)


def transform(docs: DataFrame, seed: str = "42", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The input's rows with n (units), form, prefix_chars, middle_chars and fim_text.

    Cuts and form come from SHA-256 of ``seed:ident``, so a row gives the same wherever it is read. A narrow map: no shuffle, each
    row where it was read, in slices of at most 8 MB of text (or one text, at about ten times its size). NULL text counts as
    empty (n 0, plain), a NULL id as an empty one; texts that contain a marker stay plain; equal rows give equal results; input
    columns named like results are replaced, all others kept; no rows give no rows.
    """
    import pyarrow as pa

    carried = [c for c in docs.columns if c not in RESULTS]
    source = docs.withColumns({"__text": F.coalesce(F.col(f"`{text}`"), F.lit("")), "__ident": F.col(f"`{ident}`").cast("string")})

    def work(texts, ids):
        data, offsets = text_bytes(texts)
        n, form, (prefix, middle, plain), out, out_offsets = rearrange(data, offsets, ids.to_pylist(), seed, rate, suffix_first)
        return pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), as_strings(out, out_offsets)

    return _mapped(source, carried, RESULTS, ["__text", "__ident"], work)


def restore(rows: DataFrame, output: str = "fim_text", form: str = "form") -> DataFrame:
    """The input's rows with ``restored``, the exact text that each output was made of.

    Reads nothing but the output and its form. A NULL output counts as an empty plain text; a rearranged output without exactly
    its three markers raises; a column called ``restored`` is replaced.
    """
    kept = rows.drop("restored")
    source = kept.withColumns({"__text": F.coalesce(F.col(f"`{output}`"), F.lit("")), "__form": F.when(F.col(f"`{output}`").isNull(), "plain").otherwise(F.coalesce(F.col(f"`{form}`"), F.lit("plain")))})

    def work(texts, forms):
        return (as_strings(*put_back(*text_bytes(texts), forms.to_pylist())),)

    return _mapped(source, kept.columns, {"restored": "string"}, ["__text", "__form"], work)
