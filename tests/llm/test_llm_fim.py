import hashlib
import random
import re

import pytest
from llm_cases import hard_rows, no_rows

from hourglass.llm import fim
from hourglass.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(ident, text, rate=50, spm=80):
    """(n, form, prefix_chars, middle_chars, output) of one text, by plain slicing."""
    text = text or ""
    ends = [0] + [m.end() for m in UNIT.finditer(text)]
    h = hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(ends) - 1
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[: ends[a]], text[ends[a] : ends[b]], text[ends[b] :]
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(df, **options):
    names = ("n", "form", "prefix_chars", "middle_chars", "fim_text")
    rows = fim.restore(fim.transform(df, **options)).collect()
    for r in rows:
        assert tuple(r[c] for c in names) == brute(r.doc_id, r.text, options.get("rate", 50), options.get("suffix_first", 80)), r.doc_id
        assert r.restored == (r.text or "")
    return rows


@pytest.mark.parametrize("rate", [0, 50, 100])
def test_hard_rows_equal_slicing(spark, rate):
    docs = hard_rows(spark)
    rows = check(docs, rate=rate)
    assert len(rows) == docs.count() and rows[0].asDict().keys() == {*docs.columns, *fim.RESULTS, "restored"}
    assert check(no_rows(spark)) == []


def test_random_texts_equal_slicing(spark):
    rng = random.Random(5)
    bits = [" ", "  ", "\t", "\n", "\x0b", " ", " ", "a", "word", "é", "日本", "🙂", "<", ">", "<P", "S>", "<M", "<P>", "<s>", "\x00", "<S>x"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(30), weights=[6, 2, 1, 1, 1, 1, 1, 6, 6, 3, 3, 2, 2, 2, 1, 1, 1, 0.1, 1, 1, 0.1])) for _ in range(4000)]
    rows = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rate=90, suffix_first=50)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_long_text_moves_in_windows(spark, monkeypatch):
    import numpy as np

    text = "é word " * 3000
    data = np.frombuffer((text * 2).encode(), "uint8")
    offsets = np.array([0, len(data) // 2, len(data)])
    monkeypatch.setattr(fim.shifts, "__defaults__", (1000,))
    n, form, _, out, edges = fim.rearrange(data, offsets, ["1", "2"], "42", 100, 50)
    assert n.tolist() == [6001] * 2 and (form != "plain").all()
    for i in (1, 2):
        assert bytes(out[edges[i - 1] : edges[i]]).decode() == brute(i, text, 100, 50)[4]
    back, _ = fim.put_back(out, edges, form.tolist())
    assert bytes(back) == bytes(data)


def test_damaged_output_raises(spark):
    import numpy as np

    bad = np.frombuffer(b"<P>a<M>b<S>c", "uint8")
    with pytest.raises(ValueError):
        fim.put_back(bad, np.array([0, len(bad)]), ["psm"])


def test_query_on_the_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_displacement_fim"](spark, SF).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, p, m, out = brute(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(docs[r.doc_id] or ""))
