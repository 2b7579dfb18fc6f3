"""Plain Python versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def secrets(text: str | None) -> list[tuple]:
    t = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(t) if len(m[0]) >= 16]
    return found + [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(t) if len(m[0]) >= 32]


def luhn(digits: str) -> bool:
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def pii(text: str | None) -> list[tuple]:
    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(t)]
    found += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return found + [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contamination(text: str | None, items: list[tuple], window: int = 10) -> tuple[int, int, list[str]]:
    """Words, words hit, and items with occurring windows."""
    seq, hit, found = WORD.findall(lower(text)), set(), set()
    for item, item_text in items:
        own = WORD.findall(lower(item_text))
        k = min(window, len(own))
        wins = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(seq) - k + 1):
            if k and tuple(seq[i : i + k]) in wins:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(seq), len(hit), sorted(found)


def shingle_set(text: str | None, size: int) -> frozenset:
    w = SPACED.findall(lower(text))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def near_components(docs: list[tuple], size: int, percent: int) -> dict:
    """doc_id to the smallest id that is reachable over links."""
    sets = [(i, shingle_set(t, size)) for i, t in docs]
    label = {i: i for i, _ in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i in label}


def url_verdict(url: str | None, rules: list[tuple]) -> tuple:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))
