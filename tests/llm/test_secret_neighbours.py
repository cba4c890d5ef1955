"""Secrets in random nested layers that touch path signs, hyphens and words."""

import base64
import gzip
import random
import urllib.parse

import pytest

from driftloom.llm import secrets

SECRETS = ["token=abc123XYZ9", "AKIA" + "QZ7" * 6, "0123456789abcdef" * 2, 'password: "Tr0ub4dor"']
BEFORE = ["", "key=", "https://h.io/p/", "x/", "ab-", "a_b_", "p+", "one/two-three_", "abc/", "(", "seen at "]
WRAP = {
    "base64": lambda b: base64.b64encode(b).decode(),
    "urlsafe": lambda b: base64.urlsafe_b64encode(b).decode().rstrip("="),
    "wide": lambda b: base64.b64encode(b.decode("latin-1").encode("utf-16-le")).decode(),
    "wide_big": lambda b: base64.b64encode(b.decode("latin-1").encode("utf-16-be")).decode(),
    "gzip": lambda b: base64.b64encode(gzip.compress(b, mtime=0)).decode(),
    "percent": lambda b: urllib.parse.quote(b, safe="").replace("_", "%5F"),
}


def kinds(spans):
    return {kind for _, _, kind in spans}


@pytest.mark.parametrize("before", BEFORE)
def test_base64_after(before):
    for secret in SECRETS:
        for name in ("base64", "urlsafe", "wide", "wide_big", "gzip"):
            text = f"words {before}{WRAP[name](secret.encode())} and more"
            spans, _ = secrets.all_spans(text, secrets.base_spans(text))
            want = kinds(secrets.base_spans(secret))
            assert want <= kinds(spans), (text, spans)
            assert all(a <= len("words ") + len(before) + 2 and b <= len(text) for a, b, _ in spans)


def test_random_layers():
    rng = random.Random(11)
    for _ in range(400):
        secret = rng.choice(SECRETS)
        data, chain = secret, []
        for _ in range(rng.randint(1, 4)):
            chain.append(rng.choice(sorted(WRAP)))
            data = rng.choice(BEFORE) + WRAP[chain[-1]](data.encode())
        spans, _ = secrets.all_spans(data, secrets.base_spans(data))
        assert kinds(secrets.base_spans(secret)) <= kinds(spans), (chain, data)


def test_plain_words_have_none():
    words = "https://example.org/some/long/path-with-hyphens_and_underscores/index internationalisation-of-everything 00/11/22 "
    assert secrets.all_spans(words * 200, [])[0] == []
