"""Plain single-machine versions of the operators, for small inputs. Rows are (doc_id, text) tuples."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None) -> set:
    own = words(lower_ascii(text or ""))
    if not own:
        return set()
    if len(own) < 5:
        return {tuple(own)}
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}


def near_duplicates(rows) -> dict[int, tuple[int, int, bool]]:
    sets = {i: shingles(t) for i, t in rows}
    index = defaultdict(list)
    for i, s in sets.items():
        for shingle in s:
            index[shingle].append(i)
    shared = defaultdict(int)
    for ids in index.values():
        for a in ids:
            for b in ids:
                if a < b:
                    shared[a, b] += 1
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def repeated_passages(rows, window: int = 50) -> dict[int, tuple[int, int, str]]:
    owner: dict[tuple, int] = {}
    for i, text in sorted(rows):
        own = words(text)
        for p in range(len(own) - window + 1):
            owner.setdefault(tuple(own[p : p + window]), i)
    out = {}
    for i, text in rows:
        own = words(text)
        gone = [False] * len(own)
        for p in range(len(own) - window + 1):
            if owner[tuple(own[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out[i] = (len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


SECRETS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def base_spans(text: str | None) -> list[tuple[str, int, int, str]]:
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(SECRETS.items()):
        for match in pattern.finditer(text or ""):
            if len(match.group(group)) >= least:
                found.append((match.start(), rank, kind, match.end(), match.group(group)))
    return [(kind, start, end, value) for start, _, kind, end, value in sorted(found)]


def secrets(rows) -> dict[int, tuple[int, int, int, str]]:
    out = {}
    for i, text in rows:
        spans = base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)
        kinds = [k for k, *_ in spans]
        out[i] = (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined.encode()).hexdigest())
    return out
