"""Whole jobs: what an operator must not leave out."""

import base64
import bz2
import gzip
import json
import lzma
import urllib.parse
import zlib

import pytest

from inkfold.llm import langid, secrets

# --- 5 ---------------------------------------------------------------------------------

SECRET = 'api_key = "abcDEF1234"'
b64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
quoted = lambda b: urllib.parse.quote_from_bytes(b)
LAYERS = {
    "no-break space at the front": b64("\ufeff\u00a0\u200b" + SECRET),
    "one byte that is not UTF-8": b64(b"caf\xe9 " + SECRET.encode()),
    "mostly unprintable": b64(b"\x01\x02\x03\x80" * 40 + SECRET.encode()),
    "utf-16": b64(SECRET.encode("utf-16")),
    "utf-16 at an odd place": b64(b"\x07" + SECRET.encode("utf-16-be")),
    "utf-32": b64(SECRET.encode("utf-32")),
    "url and gzip": quoted(gzip.compress(SECRET.encode(), mtime=0)),
    "plus for a space": urllib.parse.quote_plus(zlib.compress(SECRET.encode() + bytes(range(256)))),
    "all of url and zlib": "".join(f"%{c:02x}" for c in zlib.compress(SECRET.encode())),
    "x and gzip": "".join(f"\\x{c:02x}" for c in gzip.compress(SECRET.encode(), mtime=0)),
    "bytes literal": repr(zlib.compress(SECRET.encode() * 2)),
    "bytes literal of bz2": repr(bz2.compress(SECRET.encode())),
    "xz in a JSON string": json.dumps(lzma.compress(SECRET.encode()).decode("latin-1")),
    "url twice and gzip": quoted(quoted(gzip.compress(SECRET.encode(), mtime=0)).encode()),
    "lone surrogate": "\\ud800" + "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "second gzip member": b64(gzip.compress(b"first") + gzip.compress(SECRET.encode())),
    "members of other kinds": b64(bz2.compress(b"first") + lzma.compress(b"second") + b"\0" * 9 + zlib.compress(SECRET.encode())),
    "text behind a member": b64(gzip.compress(b"first ") + SECRET.encode()),
    "gzip inside a second member": b64(gzip.compress(b"first") + gzip.compress(gzip.compress(SECRET.encode()))),
    "lines": base64.encodebytes(SECRET.rjust(80).encode()).decode().strip(),
    "short lines": "\r\n  ".join(b64("to" + SECRET)[i : i + 6] for i in range(0, 99, 6)).strip(),
    "escaped line breaks": "\\n".join(b64("to" + SECRET)[i : i + 9] for i in range(0, 36, 9)),
    "gzip over lines": base64.encodebytes(gzip.compress((SECRET + str(list(range(99)))).encode())).decode().strip(),
}


@pytest.mark.parametrize("name", LAYERS)
def test_every_layer_is_read(name):
    layer = LAYERS[name]
    text = f"é before {layer} after {layer}"
    a, b = text.index(layer), text.rindex(layer)
    got = {(x, y) for x, k, y, base in secrets.scan_text(text) if k == 0 and not base}
    assert any(a <= x < y <= a + len(layer) for x, y in got) and any(b <= x < y <= b + len(layer) for x, y in got)
    assert not any(k == 0 for _, k, _, _ in secrets.scan_text(secrets.redact(text))) and secrets.redact(text).startswith("é before ")


def test_read_past_64_megabytes():
    assert secrets.redact(b64(gzip.compress(bytes(70 << 20) + b" " + SECRET.encode()))) == "[assign removed]"


def test_a_window_ends_where_no_secret_can_go_on(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 64)
    monkeypatch.setattr(secrets, "_STEP", 16)
    for n in range(60, 140):
        assert secrets.redact(b64(gzip.compress(b"," * n + SECRET.encode() + b"," * 50))) == "[assign removed]"
    assert secrets.redact("clean\nlines\nof words and more\nwithout 100% of\nanything BZh9 x^2 x%01") == "clean\nlines\nof words and more\nwithout 100% of\nanything BZh9 x^2 x%01"


# --- 8 ---------------------------------------------------------------------------------


def test_long_texts_are_learned_to_their_end(spark):
    texts = [("same opening of all texts " * 200 + w * 300, lang) for k in range(30) for w, lang in ((f"zweifellos zwischen {k} ", "de"), (f"beaucoup toujours {k} ", "fr"))]
    model = langid.train(spark.createDataFrame(texts, "text string, lang string"))
    assert model.predict(["zweifellos zwischen", "beaucoup toujours"])[0] == ["de", "fr"]


def test_rare_labels_are_learned(spark):
    rows = [(f"common words everywhere {k}{chr(97 + k % 26)}", "en") for k in range(3000)] + [(f"zweifellos zwischen {chr(97 + k)}", "de") for k in range(4)] + [("żółć gęślą", "pl")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), max_rows=100)
    assert model.labels == ["de", "en", "pl"] and model.predict(["zweifellos zwischen", "common words"])[0] == ["de", "en"]


def test_quotas():
    assert langid.quotas({"a": 10, "b": 3}, 100) == {"a": 10, "b": 3}
    got = langid.quotas({"a": 10**6, "b": 10**5, "c": 7, "d": 1}, 6000)
    assert got["c"] == 7 and got["d"] == 1 and got["a"] > 8 * got["b"] and 5990 <= sum(got.values()) <= 6000
    held = langid.calibrates([*"aaaaaaaaaa", *"bb", "c"])
    assert held.tolist() == [False] * 4 + [True] + [False] * 4 + [True, False, True, False]
    assert langid.quotas({}, 10) == {}
