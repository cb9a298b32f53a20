"""Plain Python counterparts of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def spans_digest(spans) -> str:
    return sha(",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans))


def line_figures(text: str | None) -> dict:
    text = text or ""
    words = SPACE_WORDS.findall(text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "base_failed": len(words) < 10 or 100 * len(inside) > 20 * len(words),
    }


def tokens(text: str | None, ranks: dict[bytes, int], pattern: str) -> list[int]:
    """Merge the pair of least rank, again and again, within every match of the pattern."""
    import regex

    out = []
    for m in regex.finditer(pattern, text or ""):
        parts = [bytes([b]) for b in m[0].encode()]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def benchmark_hits(text: str | None, windows: dict[tuple, set[str]]) -> tuple[int, int, list[str]]:
    words = ITEM_WORDS.findall(ascii_lower(text or ""))
    hit, items = set(), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if found := windows.get(tuple(words[i : i + n])):
                hit.update(range(i, i + n))
                items |= found
    return len(words), len(hit), sorted(items)


def benchmark_windows(items: list[tuple]) -> dict[tuple, set[str]]:
    out: dict[tuple, set[str]] = {}
    for item, text in items:
        words = ITEM_WORDS.findall(ascii_lower(text or ""))
        if item is not None and words:
            for i in range(max(1, len(words) - 9)):
                out.setdefault(tuple(words[i : i + 10]), set()).add(str(item))
    return out


def shingles(text: str | None, width: int) -> set[tuple]:
    words = SPACE_WORDS.findall(ascii_lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near_components(rows: list[tuple], width: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, least doc_id reachable); candidates by shared shingles."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    having: dict[tuple, list[int]] = {}
    for i in sorted(sets):
        shared: dict[int, int] = {}
        for s in sets[i]:
            for j in having.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            having[s].append(i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def without_repeats(rows: list[tuple], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> bytes, bytes removed, runs removed, digest of the rest; doc_ids differ."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = len(data), sum(gone), runs, sha(bytes(b for b, g in zip(data, gone) if not g))
    return out
