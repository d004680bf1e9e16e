import base64
import bz2
import codecs
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard
from llm_cases import hard_rows, no_rows

from hourglass.llm import secrets
from hourglass.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PLAIN = 'password = "hunter2hunter2"'


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def brute(text):
    """Open secrets by the patterns as stated, failing matches dropped without another try."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


WRAP = {
    "percent": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "quoted": urllib.parse.quote,
    "twice quoted": lambda t: urllib.parse.quote(urllib.parse.quote(t)),
    "u": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "u braces": lambda t: "".join(f"\\u{{{ord(c):x}}}" for c in t),
    "U": lambda t: "".join(f"\\U{ord(c):08x}" for c in t),
    "x": lambda t: "".join(f"\\x{b:02x}" for b in t.encode()),
    "html": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "html hex": lambda t: "".join(f"&#x{ord(c):x};" for c in t),
    "base64": b64,
    "base64 url": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
    "base64 twice": lambda t: b64(b64(t)),
    "base64 lines": lambda t: codecs.encode(("x" * 60 + " " + t + " " + "y" * 90).encode(), "base64").decode().strip(),
    "gzip": lambda t: b64(gzip.compress(t.encode())),
    "zlib": lambda t: b64(zlib.compress(t.encode())),
    "bz2": lambda t: b64(bz2.compress(t.encode())),
    "xz": lambda t: b64(lzma.compress(t.encode())),
    "zstd": lambda t: b64(zstandard.compress(t.encode())),
    "gzip twice": lambda t: b64(gzip.compress(gzip.compress(t.encode()))),
    "gzip percent": lambda t: "".join(f"%{b:02x}" for b in gzip.compress(t.encode())),
    "all": lambda t: urllib.parse.quote(b64(zlib.compress("".join(f"\\u{ord(c):04x}" for c in b64(t)).encode()))),
}
FINDS = {"assign": PLAIN, "access": "AKIA" + "Q" * 14, "hex": hashlib.md5(b"z").hexdigest()}


@pytest.mark.parametrize("kind", FINDS)
@pytest.mark.parametrize("wrap", WRAP)
def test_every_layer_is_unwrapped(wrap, kind):
    code = WRAP[wrap](FINDS[kind])
    text = f"é 🙂 prose before {code} and after"
    at = text.index(code)
    open_, every, layers, complete = secrets.search(text)
    mine = [(a, b) for a, rank, b in every if secrets.KINDS[rank] == kind and (a, rank, b) not in open_]
    if kind == "access" and wrap == "quoted" or kind == "hex" and wrap in ("quoted", "twice quoted") or kind == "access" and wrap == "twice quoted":
        assert mine == [] and (at, at + len(code)) in [(a, b) for a, _, b in open_]
    else:
        assert mine and all(at <= a < b <= at + len(code) for a, b in mine) and layers and complete


def test_spans_are_mapped_to_the_characters_that_encode_them():
    text = "é say pass%77ord%3A%22hunter2hunter2%22 ok"
    assert secrets.search(text)[1] == [(text.index("pass"), 0, text.index("%22 "))]
    inner = "some words é, then token=abcdefgh and more words"
    code = b64(inner)
    head = len(inner[: inner.index("token")].encode())
    first, last = head * 8 // 6, (head + len("token=abcdefgh")) * 8 // 6
    (span,) = secrets.search("x " + code)[1]
    assert span[1] == 0 and span[0] == 2 + first and abs(span[2] - 2 - last) <= 1
    joined = "/usr/lib/" + code  # letters of the alphabet stand before the code
    (span,) = secrets.search(joined)[1]
    assert span[0] == 9 + first


def test_open_spans_stay_and_equal_the_patterns():
    rng = random.Random(3)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", "ſecret", "toKen", ":", "=", " ", '"', "'", "abc", "12345678", "AKIA", "ABCDEFGH", "0123456789abcdef", "é", "%41", "\\u0041", "🙂", "&amp;", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 16)))
        open_, every, _, complete = secrets.search(text)
        assert open_ == brute(text) and set(open_) <= set(every) and complete


def test_a_code_that_yields_itself_ends(monkeypatch):
    monkeypatch.setattr(secrets, "unpacked", lambda data: iter([data]))
    open_, every, layers, complete = secrets.search(b64(gzip.compress(PLAIN.encode()) + b" " * 20))
    assert complete and layers < 20


def test_large_unpacked_data_are_read_in_blocks(monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 5000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    monkeypatch.setattr(secrets, "PIECE", 1000)
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.compress):
        for before in range(4900, 5100, 40):
            code = b64(pack((" x" * (before // 2) + PLAIN + " x" * 9000).encode()))
            assert (0, 0, len(code) - code.count("=")) in secrets.search(code)[1]
    open_, every, layers, complete = secrets.search(b64(gzip.compress(" ".join(map(str, range(200_000))).encode())), budget=1_000_000)
    assert not complete


def test_damaged_codes_and_clean_texts_give_nothing():
    code = b64(gzip.compress(PLAIN.encode()))
    for text in (code[:18], "%ff%fe", "&#x110000;", "\\ud800", "50%ab", "a" * 300_000, "ab/" * 50_000, "the-quick-brown-fox-jumps-over", ""):
        open_, every, _, complete = secrets.search(text)
        assert open_ == every and complete
    assert secrets.search(code[:-12])[1]  # the end is missing, the beginning is read


def test_hard_rows_and_query(spark):
    rows = secrets.find(hard_rows(spark)).collect()
    assert len(rows) == 14 and secrets.find(no_rows(spark)).collect() == []
    for r in rows:
        assert r.base_spans == secrets.spelled(brute(r.text or "")) and r.complete
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op12_layered_secrets"](spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        want = brute(docs[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(secrets.spelled(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == rank for _, k, _ in want) for rank in range(3))
        assert {s for s in r.spans.split(",") if s} >= {s for s in secrets.spelled(want).split(",") if s}
