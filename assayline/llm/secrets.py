"""Secret scans: patterns, and structural confirmation of what is encoded.

Base spans are those of three patterns (assign, access, hex), each matched from left to right without overlap. The method
adds spans whose decoded content has the structure of a key:

- `token`: three base64url parts of which the first is a JSON object with a string "alg" (a signed token's header);
- `pem`: a PEM block of a private key whose body decodes to nested DER lengths that fit, or to an OpenSSH key, or, if its
  headers say that it is encrypted and how, to whole cipher blocks;
- `der`: a base64 or hex run that decodes to a DER sequence whose nested lengths fit to the last byte and hold integers or
  octet strings as keys do;
- `ssh`: a base64 or hex run that decodes to an SSH key: length-prefixed fields that fill it, the first naming an algorithm.

A base64 run may be of either alphabet, and may be wrapped into lines of 16 letters or more (the last of any length).

Nothing that does not parse is added; base spans always stay. Offsets are code points, ends exclusive. Null and empty texts
have no spans. Each row is judged by itself; texts of any length are read whole, one at a time.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from assayline.llm.common import shelved, slices

#: Fixed values of the contract: the three patterns, shortest lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "token", "pem", "der", "ssh")
#: Every match of the first pattern holds one of these, whatever the case of its letters.
CUES = ("passw", "secret", "token", "apikey", "api_key")

#: The shortest header, {"alg":""}, has 14 letters. Matched at every place, as names with dots may stand before a token.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{14,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*))")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
#: A line break written as a backslash and a letter ends there; the letter is not the first of a run.
BROKEN = r"(?!(?<=\\)[nr])"
BASE64 = re.compile(rf"(?:(?<=\\[nr])|(?<![A-Za-z0-9+/]){BROKEN})[A-Za-z0-9+/]{{40,}}={{0,2}}")
BASE64_URL = re.compile(rf"(?:(?<=\\[nr])|(?<![A-Za-z0-9_-]){BROKEN})[A-Za-z0-9_-]{{40,}}={{0,2}}")
WRAP = r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"
WRAPPED = re.compile(rf"(?:(?<=\\[nr])|(?<![A-Za-z0-9+/_-]){BROKEN})[A-Za-z0-9+/_-]{{16,}}(?:{WRAP}[A-Za-z0-9+/_-]{{16,}})*(?:{WRAP}[A-Za-z0-9+/_-]+)?={{0,2}}")
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
ENDS = re.compile(r"={0,2}(?![A-Za-z0-9+/_=-])")
TO_STANDARD = str.maketrans("-_", "+/")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}")
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")
OPENSSH = b"openssh-key-v1\x00"
MAX_DEPTH = 16


def from_base64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_ends(data: bytes, at: int, end: int, tags: set[int], depth: int = 0) -> bool:
    """Whether data[at:end] is a run of DER elements whose lengths fit exactly, nested ones too; tags: those met."""
    if depth > MAX_DEPTH:
        return False
    while at < end:
        if end - at < 2:
            return False
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or end - at < n:
                return False
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 0x80:  # DER asks for the short form here
                return False
        if size > end - at:
            return False
        tags.add(tag)
        if tag & 0x20 and not der_ends(data, at, at + size, tags, depth + 1):
            return False
        at += size
    return True


def is_der_key(data: bytes | None) -> bool:
    tags: set[int] = set()
    return bool(data) and len(data) >= 24 and data[0] == 0x30 and der_ends(data, 0, len(data), tags) and bool(tags & {0x02, 0x03, 0x04})


def ssh_fields(data: bytes) -> list[bytes] | None:
    out, at = [], 0
    while at < len(data):
        if len(data) - at < 4:
            return None
        (size,) = struct.unpack_from(">I", data, at)
        at += 4
        if size > len(data) - at:
            return None
        out.append(data[at : at + size])
        at += size
    return out


def is_ssh_key(data: bytes | None) -> bool:
    if not data:
        return False
    if data.startswith(OPENSSH):  # cipher, derivation and its options are length-prefixed, then comes the number of keys
        at = len(OPENSSH)
        for _ in range(3):
            if len(data) - at < 4:
                return False
            at += 4 + struct.unpack_from(">I", data, at)[0]
        return len(data) - at >= 4 and 1 <= struct.unpack_from(">I", data, at)[0] <= 16
    fields = ssh_fields(data)
    return bool(fields) and len(fields) >= 2 and fields[0].startswith(SSH_NAMES)


def ssh_end(data: bytes) -> list[int]:
    """Where an SSH key that `data` starts with may end."""
    at, out = 0, []
    if data.startswith(OPENSSH):  # three fields, the number of keys, as many public keys and the private part
        at, fields = len(OPENSSH), 3
        for count_next in (True, False):
            for _ in range(fields):
                if len(data) - at < 4:
                    return []
                at += 4 + struct.unpack_from(">I", data, at)[0]
            if count_next:
                if len(data) - at < 4 or not 1 <= (n := struct.unpack_from(">I", data, at)[0]) <= 16:
                    return []
                at, fields = at + 4, n + 1
        return [at] if at <= len(data) else []
    if not data[4:].startswith(SSH_NAMES):
        return []
    while len(data) - at >= 4:
        at += 4 + struct.unpack_from(">I", data, at)[0]
        if at > len(data):
            break
        out.append(at)
    return out[1:][::-1]


def wrapped_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of keys whose base64 is wrapped into lines; where a key ends follows from its own lengths."""
    out = []
    for m in WRAPPED.finditer(text):
        cuts = [(0, 0), *(x.span() for x in re.finditer(WRAP, m[0])), (len(m[0]), len(m[0]))]
        runs = [RUN.match(m[0], a, b).span() for (_, a), (b, _) in zip(cuts, cuts[1:], strict=False)]
        if len(runs) < 2:
            continue
        letters = "".join(m[0][a:b] for a, b in runs).translate(TO_STANDARD)
        begins, total = [], 0
        for a, b in runs:
            begins.append(total)
            total += b - a
        stops = {begin + b - a: m.start() + b for begin, (a, b) in zip(begins, runs, strict=True)}
        done = 0
        for begin, (a, _) in zip(begins, runs, strict=True):
            if begin < done:
                continue
            head = from_base64(letters[begin : begin + 32]) or b""
            sizes: list[int] = []
            if head[:1] == b"\x30" and len(head) >= 6:
                n = head[1] & 0x7F
                if not head[1] & 0x80:
                    sizes = [2 + head[1]]
                elif 1 <= n <= 4:
                    sizes = [2 + n + int.from_bytes(head[2 : 2 + n], "big")]
            elif head.startswith(OPENSSH) or head[4:].startswith(SSH_NAMES):
                left = letters[begin:]
                sizes = ssh_end(from_base64(left[: len(left) // 4 * 4] if len(left) % 4 == 1 else left) or b"")
            for size in sizes:
                stop = begin + -(-size * 4 // 3)
                end = stops.get(stop)
                if end is None or end <= m.start() + a or not (tail := ENDS.match(text, end)) or stop - begin < 40:
                    continue
                data = from_base64(letters[begin:stop])
                kind = 5 if is_der_key(data) else 6 if is_ssh_key(data) else 0
                if kind:
                    out.append((m.start() + a, kind, tail.end()))
                    done = stop
                    break
    return out


def is_encrypted_body(block: str, data: bytes | None) -> bool:
    """Whether the headers of a PEM block name encryption and cipher, and its body is whole cipher blocks."""
    said = re.search(r"^Proc-Type:\s*4\s*,\s*ENCRYPTED\s*$", block, re.M) and re.search(r"^DEK-Info:\s*[A-Za-z0-9-]+", block, re.M)
    return bool(said and data and len(data) % 8 == 0)


def is_signed_header(part: str) -> bool:
    try:
        head = json.loads(from_base64(part, url=True) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns."""
    out, low = [], text.lower()
    if any(c in low for c in CUES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what decodes to the structure of a key."""
    out = []
    done = 0
    for m in SIGNED.finditer(text):
        if m.start() >= done and is_signed_header(m[1].partition(".")[0]):
            done = m.end(1)
            out.append((m.start(), 3, done))
    blocks = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            block = m[2].replace("\\r", "").replace("\\n", "\n")
            body = "".join(x for x in block.splitlines() if ":" not in x)
            data = from_base64("".join(body.split()))
            if is_der_key(data) or is_ssh_key(data) or is_encrypted_body(block, data):
                blocks.append((m.start(), 4, m.end()))
    blocks += [x for x in wrapped_spans(text) if not any(a <= x[0] < b for a, _, b in blocks)]
    out += blocks
    for pattern, decode in ((BASE64, from_base64), (BASE64_URL, lambda x: from_base64(x, url=True)), (HEX_ANY, lambda x: bytes.fromhex(x[: len(x) // 2 * 2]))):
        for m in pattern.finditer(text):
            if any(a <= m.start() < b for a, _, b in blocks):
                continue
            data = decode(m[0])
            if is_der_key(data):
                out.append((m.start(), 5, m.end()))
            elif is_ssh_key(data):
                out.append((m.start(), 6, m.end()))
    return sorted(set(out))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), both by start and then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted({*base, *confirmed_spans(text)})


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [scan(x) for x in batch.column("text").to_pylist()]
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([joined(every) for _, every in found], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    docs = shelved(docs, ("doc_id", "text"))[0]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
