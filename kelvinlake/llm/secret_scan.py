r"""Secret scans: patterns, then structural confirmation of encoded candidates.

Base kinds are found by pattern: `assign` (a key word, a separator and a value of 6 characters or more), `access`
(AKIA identifiers of 20 characters or more) and `hex` (24 digits or more). Further kinds are reported only when
their bytes parse: a base64 run (one line, or lines of equal width with a shorter last one), or a hex run of either case,
is decoded and must be a key whose nested lengths add up (`der`, `ssh`), a token must carry a JSON header that names its
algorithm (`jwt`), and an armoured block must hold such a key (`pem`); its lines may end in newlines or in the two
characters backslash and n, and header lines (as of encrypted keys) may stand before its body. The body of an encrypted
armour is no key before it is decrypted, so there the header alone confirms it.

Spans are in code points, end exclusive. Defined cases: a null or empty text has no spans; every row is scanned by
itself, so repeated rows give repeated results and an empty table none; texts are scanned whole; spans of several kinds
may overlap or tie, and are ordered by start, then by kind as listed, then by end; a column of the same name as the
result is replaced, other columns pass through.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvinlake.llm.common import table

KINDS = ("assign", "access", "hex", "der", "ssh", "jwt", "pem")
SPANS = "array<struct<kind:string,start:int,end:int>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{40,}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: What may be a line of wrapped base64: it ends where its line does.
LINE = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]++)={0,2}+(?=\r?(?:\n|\Z))")
#: The least width of wrapped lines, and the largest wrapped key (RSA with 65,536 bits takes 37,000 bytes).
WIDTH, LARGEST = 48, 1 << 16
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{12,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
MARKER = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]+)-----")
HEADER = re.compile(r"[A-Za-z-]+: ")
PLAIN = re.compile(r"[A-Za-z0-9+/]+=*")
SSH_FILE = b"openssh-key-v1\0"
SSH_HEAD = re.compile(rb"ssh-|ecdsa-|sk-")
SSH_TYPE = re.compile(rb"(ssh-(rsa|dss|ed25519)|ecdsa-sha2-nistp\d+|sk-[a-z0-9@.-]+)\Z")


def decode64(body: str) -> bytes | None:
    plain = body.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that data consists of; None if a length is wrong."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


def is_algorithm(data: bytes) -> bool:
    """An object identifier, and at most one parameter behind it."""
    items = der_items(data)
    return bool(items) and items[0][0] == 0x06 and len(items) <= 2


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that is laid out as a PKCS#1, PKCS#8 (plain or encrypted), SEC1 or public key, with all nested lengths right."""
    outer = der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1 or not (inner := der_items(outer[0][1])):
        return False
    tags, parts = [tag for tag, _ in inner], [x for _, x in inner]
    if tags == [0x30, 0x03]:  # algorithm, bit string with its count of unused bits
        return is_algorithm(parts[0]) and len(parts[1]) > 1 and parts[1][0] < 8
    if tags == [0x30, 0x04]:  # encryption algorithm, encrypted key in whole blocks
        return is_algorithm(parts[0]) and len(parts[1]) >= 16 and len(parts[1]) % 8 == 0
    if tags[:3] == [0x02, 0x30, 0x04]:  # version, algorithm, a key that is DER itself
        return parts[0] in (b"\0", b"\1") and is_algorithm(parts[1]) and bool(der_items(parts[2]))
    if tags[:2] == [0x02, 0x04]:  # version, private value, curve and public key in tags 0 and 1
        return parts[0] == b"\1" and set(tags[2:]) <= {0xA0, 0xA1} and all(der_items(x) for x in parts[2:])
    return len(tags) in (2, 6, 9) and set(tags) == {0x02} and max(map(len, parts)) >= 16


def ssh_strings(data: bytes) -> list[bytes] | None:
    """The strings with 32-bit lengths that data consists of; None if a length is wrong."""
    parts, at = [], 0
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            return None
        parts.append(data[at + 4 : end])
        at = end
    return parts


def is_ssh_key(data: bytes) -> bool:
    """A private key file body, with its keys counted and nested, or strings of which the first names a key type."""
    if data.startswith(SSH_FILE):
        parts, at = [], len(SSH_FILE)
        for _ in range(3):  # cipher, key derivation and its options
            end = at + 4 + int.from_bytes(data[at : at + 4], "big")
            if end > len(data):
                return False
            parts.append(data[at + 4 : end])
            at = end
        n, rest = int.from_bytes(data[at : at + 4], "big"), ssh_strings(data[at + 4 :])
        return n >= 1 and bool(parts[0]) and rest is not None and len(rest) in (n + 1, n + 2) and all(is_ssh_key(x) for x in rest[:n])
    parts = ssh_strings(data)
    return bool(parts) and len(parts) >= 2 and bool(SSH_TYPE.match(parts[0]))


def is_token_head(segment: str) -> bool:
    data = decode64(segment)
    if not data or data[:1] != b"{":
        return False
    try:
        head = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def der_length(head: bytes) -> int | None:
    """How many bytes the SEQUENCE that head begins takes; None if it is none."""
    if len(head) < 6 or head[0] != 0x30:
        return None
    if head[1] < 0x80:
        return 2 + head[1]
    n = head[1] & 0x7F
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big") if 1 <= n <= 4 else None


def wrapped_keys(text: str) -> list[tuple[str, int, int]]:
    """Keys in base64 whose lines have one width, but for a shorter last one. A key may begin at any line that what went before
    does not belong to: its own lengths tell where a SEQUENCE ends, a shorter line where other keys do."""
    runs: list[list[re.Match]] = []
    for m in LINE.finditer(text):
        if runs and m.start() == (last := runs[-1][-1].end()) + (2 if text.startswith("\r\n", last) else 1):
            runs[-1].append(m)
        elif len(m[1]) >= WIDTH:
            runs.append([m])
    found = []
    for run in runs:
        sizes = [len(m[1]) for m in run]
        same = [1] * len(run)  # lines from each on that are as wide
        for i in range(len(run) - 2, -1, -1):
            if sizes[i] == sizes[i + 1]:
                same[i] += same[i + 1]
        i = 0
        while i < len(run):
            end = _wrapped_end(run, sizes, same, i) if sizes[i] >= WIDTH else None
            if end:
                found.append((end[0], run[i].start(), run[end[1] - 1].end()))
            i = end[1] if end else i + 1
    return found


def _wrapped_end(run: list[re.Match], sizes: list[int], same: list[int], i: int) -> tuple[str, int] | None:
    """(kind, the line behind it) of the key of two lines or more that begins at line i."""
    width, full = sizes[i], i + same[i]
    head = decode64(run[i][1][:48]) or b""
    if (size := der_length(head)) is not None:
        whole, rest = divmod(-(-size * 4 // 3), width)
        ends = [i + whole + (rest > 0)] if i + whole <= full and (not rest or i + whole < len(run) and sizes[i + whole] == rest) else []
    elif head.startswith(SSH_FILE) or (head[:2] == b"\0\0" and SSH_HEAD.match(head, 4)):
        ends = [full + 1] * (full < len(run) and sizes[full] < width) + [full]
    else:
        return None
    for end in ends:
        if end - i >= 2 and (end - i) * width <= LARGEST * 4 // 3 + width and (kind := _key_kind(decode64("".join(m[1] for m in run[i:end])))):
            return kind, end
    return None


def armoured_key(body: str) -> bool:
    """body, between the markers of an armour, is header lines and then the base64 of a key."""
    lines = [x.strip() for x in body.replace("\\r", "\r").replace("\\n", "\n").strip().split("\n")]
    at = next((i for i, x in enumerate(lines) if x and not HEADER.match(x)), len(lines))
    code = "".join("".join(lines[at:]).split())
    if not code or not PLAIN.fullmatch(code):
        return False
    data = decode64(code)
    return bool(data) and (_key_kind(data) is not None or (len(data) % 8 == 0 and any("ENCRYPTED" in x for x in lines[:at])))


def armours(text: str) -> list[tuple[str, int, int]]:
    """Blocks from a BEGIN marker to the END marker that comes next, of the same name, that hold a key."""
    found, begun = [], None
    for m in MARKER.finditer(text):
        if m[1] == "END" and begun and m[2] == begun[2] and armoured_key(text[begun.end() : m.start()]):
            found.append(("pem", begun.start(), m.end()))
        begun = m if m[1] == "BEGIN" else None
    return found


def find_spans(text: str) -> list[dict]:
    """All spans of one text, by start and then kind as listed."""
    found = {("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6}
    found |= {("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20}
    found |= {("hex", *m.span()) for m in HEX.finditer(text)}
    found |= {(kind, *m.span()) for m in ANY_HEX.finditer(text) if len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0])))}
    found |= {(kind, *m.span()) for m in BASE64.finditer(text) if (kind := _key_kind(decode64(m[0])))}
    found.update(wrapped_keys(text))
    found |= {("jwt", *m.span()) for m in TOKEN.finditer(text) if is_token_head(m[1])}
    if "-----BEGIN " in text:
        found.update(armours(text))
    return [{"kind": k, "start": a, "end": b} for k, a, b in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))]


def secret_spans(text: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: find_spans(x) if x else [])

    return F.pandas_udf(run, SPANS)(text)


def mask(text: str | None) -> str | None:
    """text with each secret (overlapping spans joined) replaced by [SECRET]."""
    if not text or not (spans := find_spans(text)):
        return text
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += [text[at : x["start"]], "[SECRET]"]
        at = max(at, x["end"])
    return "".join(out) + text[at:]


def masked(text: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(mask, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs with `secret_spans` added."""
    return docs.withColumn("secret_spans", secret_spans("text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    of = lambda *kinds: F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return out.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed(of(*KINDS[:3])).cast("binary"), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )
