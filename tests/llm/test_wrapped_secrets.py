"""Keys in the forms that they are written in: wrapped, of either alphabet, with headers, with blanks in a token's header."""

import base64
import struct

import pytest

from assayline.llm import secrets


def der(tag: int, body: bytes) -> bytes:
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


KEY = der(0x30, b"".join(der(2, bytes([1, 255 - i] + [(i * 37 + j * 91) % 256 for j in range(64)])) for i in range(5)))
FIELDS = [b"ssh-ed25519", bytes(range(180, 212))]
SSH = b"".join(struct.pack(">I", len(x)) + x for x in FIELDS)
PACK = lambda x: struct.pack(">I", len(x)) + x
OPEN = secrets.OPENSSH + PACK(b"none") + PACK(b"none") + PACK(b"") + struct.pack(">I", 1) + PACK(SSH) + PACK(bytes(range(200)))


def wrapped(text: str, width: int, wrap: str) -> str:
    return wrap.join(text[i : i + width] for i in range(0, len(text), width))


@pytest.mark.parametrize("wrap", ["\n", "\r\n", "\n    ", "\\n"])
@pytest.mark.parametrize("width", [40, 64, 76])
@pytest.mark.parametrize("encode", [base64.b64encode, base64.urlsafe_b64encode, lambda x: base64.b64encode(x).rstrip(b"=")])
@pytest.mark.parametrize(("data", "kind"), [(KEY, 5), (SSH, 6), (OPEN, 6)])
def test_wrapped_keys(data, kind, encode, width, wrap):
    body = wrapped(encode(data).decode(), width, wrap)
    for before, after in (("", ""), ("key: ", wrap + "and more"), (f"line{wrap}", " x"), ("a" * 30 + "\n", "\n" + "b" * 30)):
        assert secrets.confirmed_spans(before + body + after) == [(len(before), kind, len(before) + len(body))]
    assert secrets.confirmed_spans(body.replace(body[8:20], "A" * 12)[: len(body) // 2]) == []


def test_unbroken_keys_of_the_other_alphabet():
    text = base64.urlsafe_b64encode(KEY).decode()
    assert "-" in text or "_" in text
    assert secrets.confirmed_spans(f"a {text} b") == [(2, 5, 2 + len(text))]


def test_headers_of_pem_and_tokens():
    cipher = base64.b64encode(bytes(range(96))).decode()
    head = "-----BEGIN RSA PRIVATE KEY-----\n"
    tail = "\n-----END RSA PRIVATE KEY-----"
    said = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    for text in (f"{head}{said}{wrapped(cipher, 64, chr(10))}{tail}", f"{head}Key-Use: a-b\n\n{wrapped(base64.b64encode(KEY).decode(), 64, chr(10))}{tail}"):
        assert secrets.confirmed_spans(f"x {text} y") == [(2, 4, 2 + len(text))]
    assert secrets.confirmed_spans(f"{head}{wrapped(cipher, 64, chr(10))}{tail}") == []
    for raw in ('{"alg":"x"}', '{ "alg": "HS256" }', '{\n "alg": "HS256"}', '{\r\n"alg":"a"}', ' {"alg":"HS256"}', '{\t"alg":"HS256"}'):
        token = base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=") + ".eyJhIjoxfQ.c2ln"
        assert secrets.confirmed_spans(f"bearer {token}, www.name.{token}") == [(7, 3, 7 + len(token)), (18 + len(token), 3, 18 + 2 * len(token))]
    assert secrets.confirmed_spans("internationalisation.of.names") == []
