"""Base spans against plain patterns, planted secrets under encodings, round trips of masks."""

import base64
import gzip
import hashlib
import re
import urllib.parse
import zlib

import pytest

from loomline.llm import secrets

KEY = "password: hunter2222"


def base(text):
    """The contract's patterns, one character class at a time."""
    kinds = (
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))


TEXTS = ["", "no secret", KEY, "API_KEY='abcdef' Secret=xy passwd = zzzzzz", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7, "f" * 24, "f" * 23 + "g", "toKen==abc12", "ſecret = abcdef", "x é😀 " + KEY]


@pytest.mark.parametrize("text", TEXTS)
def test_base(text):
    assert secrets.find(text)[0] == base(text)


LAYERS = {
    "url": lambda s: urllib.parse.quote(s, safe=""),
    "double url": lambda s: urllib.parse.quote(urllib.parse.quote(s, safe=""), safe=""),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "base64": lambda s: base64.b64encode(s.encode()).decode(),
    "url-safe base64": lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    "gzip": lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    "zlib twice": lambda s: base64.b64encode(zlib.compress(zlib.compress(s.encode()))).decode(),
    "base64 in url in base64": lambda s: base64.b64encode(urllib.parse.quote(base64.b64encode(s.encode()).decode()).encode()).decode(),
}


@pytest.mark.parametrize("name", LAYERS)
def test_layers(name):
    hidden = LAYERS[name]("my " + KEY)
    text = f"é before {hidden} after"
    found, every = secrets.find(text)
    assert set(found) <= set(every)
    assert any(k == 0 and text[a:b] in hidden and b - a >= len(hidden) // 2 for a, k, b in every)
    masked = secrets.redact(text, every)
    assert masked.startswith("é before ") and masked.endswith(" after") and secrets.MASK in masked
    assert secrets.find(masked)[1] == []


def test_cycles_end():
    quine = "%25" * 50 + "%2525%252525"
    assert secrets.find(quine)[1] == []
    assert secrets.find(base64.b64encode(b"A" * 64).decode() * 3)[0] == []


def test_query(spark, awkward, empty, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in secrets.scan_secrets(docs).collect():
        spans = base(texts[r["doc_id"]])
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in secrets.KINDS] == [sum(s[1] == i for s in spans) for i in range(3)]
    rows = secrets.scan_secrets(awkward).collect()
    assert len(rows) == awkward.count() and {r["base_sha256"] for r in rows if r["doc_id"] in (1, 2)} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.scan_secrets(empty).collect() == []
    masked = secrets.mask_secrets(awkward)
    assert masked.columns == awkward.columns and masked.count() == awkward.count()


def _b64(s):
    return base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()


def _wrap(s):
    return "\n".join(s[i : i + 76] for i in range(0, len(s), 76))


LONG = "the first line of a file that is longer than one line of base64 is " * 2 + KEY + " and more text follows after it" * 3
HIDDEN = {
    "path": "https://h.example/v1/blob/" + _b64("my " + KEY),
    "name": "key_" + _b64("my " + KEY),
    "one more": "/" + _b64("my " + KEY),
    "gzip in a path": "https://h.example/v1/blob/" + _b64(gzip.compress(KEY.encode())),
    "no-break space": _b64("my\u00a0" + KEY),
    "form feed, NUL, zero width": _b64("\f\0\u200b " + KEY),
    "no UTF-8": _b64(b"\xff\xfe\x80 " + KEY.encode() + b" \xc3"),
    "wrapped": _wrap(_b64(LONG)),
    "wrapped gzip": _wrap(_b64(gzip.compress(("".join(hashlib.sha256(bytes([i])).hexdigest()[:9] + " " for i in range(30)) + KEY).encode()))),
    "wrapped with CRLF and indent": _wrap(_b64(LONG)).replace("\n", "\r\n  "),
}


@pytest.mark.parametrize("name", HIDDEN)
def test_hidden_base64(name):
    text = f"é before {HIDDEN[name]} after"
    every = secrets.find(text)[1]
    assert any(k == 0 for _, k, _ in every)
    masked = secrets.redact(text, every)
    assert masked.startswith("é before ") and masked.endswith(" after") and secrets.MASK in masked
    assert not any(k == 0 for _, k, _ in secrets.find(masked)[1])


def test_every_place_of_a_line_break():
    """A secret across a line break of wrapped base64, at any alignment, is masked as a whole."""
    for n in range(40, 60):
        text = _wrap(_b64("a" * n + " " + KEY))
        assert any(k == 0 for _, k, _ in secrets.find(text)[1])


def _percent(data):
    return "".join(f"%{b:02x}" for b in data)


def _escaped(data):
    return "".join(f"\\x{b:02X}" for b in data)


NOISE = "".join(hashlib.sha256(bytes([i])).hexdigest()[:9] + " " for i in range(40))
COMPRESSED = {
    "behind 65 MB": _b64(gzip.compress(b" " * (65 << 20) + b"\n" + KEY.encode())),
    "across windows": _b64(gzip.compress(b" " * (secrets.WINDOW + secrets.OVERLAP - 12) + KEY.encode())),
    "compressed thrice": _b64(gzip.compress(zlib.compress(gzip.compress(b"\n" * (9 << 20) + KEY.encode())))),
    "second member": _b64(gzip.compress(b"nothing here") + gzip.compress(KEY.encode())),
    "truncated": _b64(zlib.compress((KEY + " " + NOISE).encode())[:-40]),
    "behind percents": _percent(gzip.compress(KEY.encode())),
    "behind escapes": _escaped(zlib.compress(KEY.encode())),
    "base64 in gzip": _b64(gzip.compress(_b64("my " + KEY + NOISE).encode())),
}


@pytest.mark.parametrize("name", COMPRESSED)
def test_compressed(name):
    text = f"é before {COMPRESSED[name]} after"
    every = secrets.find(text)[1]
    assert any(k == 0 for _, k, _ in every)
    masked = secrets.redact(text, every)
    assert masked.startswith("é before ") and masked.endswith(" after") and secrets.MASK in masked


def test_bombs_are_no_secrets():
    assert secrets.find(_b64(zlib.compress(b"z \n" * (7 << 20))))[1] == []
