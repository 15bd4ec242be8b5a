"""Secrets anywhere in compressed data: far behind its start, in later members, in nested layers, behind damage."""

import base64
import bz2
import gzip
import lzma
import random
import zlib

import pytest
import zstandard

from paramspark.llm import secret_scan

SECRET = b"\ntoken=abcdefgh12345678\n"
PACK = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.ZstdCompressor().compress}


def scan(data, most=None):
    text = "é before " + base64.b64encode(data).decode() + " after"
    spans, _, cut = secret_scan.decoded_spans(text, text.encode(), most)
    return {secret_scan.KINDS[k] for _, k, _ in spans}, cut, text


@pytest.mark.parametrize("kind", PACK)
def test_secrets_behind_eight_megabytes(kind):
    data = PACK[kind](b"some words, " * 900_000 + SECRET)
    found, cut, text = scan(data)
    assert (found, cut) == ({"assign"}, 0)
    assert secret_scan.redact(text) == "é before [SECRET] after"
    assert scan(PACK["gzip"](data))[:2] == ({"assign"}, 0)


@pytest.mark.parametrize("kind", PACK)
def test_all_members_are_read(kind):
    assert scan(PACK[kind](b"first, ") + PACK[kind](b"second") + PACK[kind](SECRET))[:2] == ({"assign"}, 0)


def test_members_of_different_kinds_and_bytes_behind_them():
    assert scan(b"".join(p(b"words ") for k, p in PACK.items() if k != "zstd") + SECRET)[:2] == ({"assign"}, 0)


def test_secrets_across_chunks_and_pieces():
    rng = random.Random(1)
    for _ in range(4):
        at = (1 << 20) - rng.randrange(40)
        assert scan(gzip.compress(b"words, " * 10 + b"x y " * (at // 4) + SECRET[1:] + b"z, " * 500_000))[0] == {"assign"}


def test_text_that_looks_compressed():
    assert scan(gzip.compress(b"x^2 is no zlib data" + SECRET))[:2] == ({"assign"}, 0)
    assert scan(gzip.compress(b"BZh is no bzip2 data" + SECRET))[:2] == ({"assign"}, 0)


def test_what_cannot_be_read_whole_is_redacted():
    noise = random.Random(2).randbytes(300_000)
    data = bytearray(gzip.compress(base64.b64encode(noise), 1))
    data[len(data) // 2 :] = bytes(255 - x for x in data[len(data) // 2 :])
    _, cut, text = scan(bytes(data))
    assert cut == 1 and secret_scan.redact(text) == "é before [SECRET] after"
    _, cut, text = scan(gzip.compress(b"words, " * 10_000 + SECRET), 1000)
    assert cut == 1 and secret_scan.redact(text, most=1000) == "é before [SECRET] after"
