"""Wrapped keys among other lines, and texts made to slow the scan down."""

import base64
import time

import pytest

from kelvinlake.llm import secret_scan
from tests.llm.test_llm import keys


def spans(text):
    return [(s["kind"], text[s["start"] : s["end"]]) for s in secret_scan.find_spans(text) if s["kind"] in ("der", "ssh", "pem")]


def rows(data, width=64, end="\n"):
    text = base64.b64encode(data).decode()
    return end.join(text[i : i + width] for i in range(0, len(text), width))


LAYOUTS = {
    "alone": "{k}",
    "word behind": "{k}\nend",
    "line before": "x" * 50 + "\n{k}\n",
    "line of the same width before": "x" * 64 + "\n{k}\nend\n",
    "line of the same width behind": "{k}\n" + "y" * 64 + "\n",
    "behind a sign": "key = {k}\nmore",
    "in prose": "see here:\n{k}\n\nand more words",
}


@pytest.mark.parametrize("layout", list(LAYOUTS))
@pytest.mark.parametrize("name", ["rsa", "file"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_keys_among_lines(name, layout, end):
    kind, data = keys()[name]
    key = rows(data)
    text = LAYOUTS[layout].format(k=key).replace("\n", end)
    assert (kind, key.replace("\n", end)) in spans(text)


def test_keys_that_follow_one_another():
    a, b = rows(keys()["rsa"][1]), rows(keys()["encrypted"][1])
    two = spans(f"{a}\n{a}\n{b}\n")
    assert two.count(("der", a)) == 2 and ("der", b) in two
    # the last line of the first is full
    full = next(d for n in range(200, 300) if len(base64.b64encode(d := rsa(n))) % 64 == 0 and not base64.b64encode(d).endswith(b"="))
    c = rows(full)
    assert spans(f"{c}\n{c}\nend") == [("der", c)] * 2


def rsa(n):
    from tests.llm.test_llm import der

    return der(0x30, b"".join(der(2, b"\1" * k) for k in (1, n, 3, n, 64, 64, 64, 64, 64)))


def test_armour():
    key = rows(keys()["rsa"][1])
    block = f"-----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----"
    assert ("pem", block) in spans(f"-----BEGIN RSA PRIVATE KEY-----\n a\n{block}\n-----END RSA PRIVATE KEY-----")
    locked = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011\n\n{rows(bytes(range(160)))}\n-----END RSA PRIVATE KEY-----"
    assert [k for k, _ in spans(locked)] == ["pem"]
    assert not spans(locked.replace("4,ENCRYPTED", "4,CLEAR"))
    assert not spans(block.replace("END RSA", "END DSA").replace(key, "no key"))


@pytest.mark.parametrize(
    "text",
    [
        "-----BEGIN A-----" + " " * 1_000_000,
        "-----BEGIN A-----" + "\\n" * 500_000,
        "-----BEGIN A-----\n" * 60_000,
        "-----BEGIN " + "A" * 1_000_000,
        "-" * 1_000_000,
        ("A" * 64 + "\n") * 15_000,
        ("MIIE" + "A" * 60 + "\n") * 15_000,
        ("MIT///8A" + "A" * 56 + "\n") * 15_000,
        ("A" * 63 + "\n" + "A" * 64 + "\n") * 8_000,
        "A" * 1_000_000,
        "\r" * 1_000_000,
        "=" * 1_000_000,
    ],
    ids=lambda t: t[:24],
)
def test_long_texts_are_scanned_in_linear_time(text):
    began = time.process_time()
    secret_scan.find_spans(text)
    assert time.process_time() - began < 3
