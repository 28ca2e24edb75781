"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re


def sha(b: bytes | str) -> str:
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def repeats(rows: list[tuple[int, str | None]], tokenise, window: int = 50):
    """{doc_id: (n, covered flags, tokens)}"""
    toks = {d: tokenise(t or "") for d, t in rows}
    first: dict[tuple, int] = {}
    for d in sorted(toks):
        for i in range(len(toks[d]) - window + 1):
            first.setdefault(tuple(toks[d][i : i + window]) if not isinstance(toks[d], bytes) else toks[d][i : i + window], d)
    out = {}
    for d, ts in toks.items():
        gone = [False] * len(ts)
        end = 0
        for i in range(len(ts) - window + 1):
            k = ts[i : i + window] if isinstance(ts, bytes) else tuple(ts[i : i + window])
            if first[k] < d:
                for j in range(max(i, end), i + window):
                    gone[j] = True
                end = i + window
        out[d] = (len(ts), gone, ts)
    return out


def op9(rows):
    return {d: (n, sum(g), sha(" ".join(t for t, x in zip(ts, g) if not x))) for d, (n, g, ts) in repeats(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)).items()}


def op10(rows):
    out = {}
    for d, (n, g, ts) in repeats(rows, lambda t: t.encode()).items():
        spans = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        out[d] = (n, sum(g), spans, sha(bytes(b for b, x in zip(ts, g) if not x)))
    return out


def simhash(text: str | None, k: int) -> int:
    import xxhash

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def op8(rows, k=4, r=4):
    fp = {d: simhash(t, k) for d, t in rows}
    comp = {d: d for d in fp}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= r:
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {d: (f"{fp[d]:016x}", find(d)) for d in ids}
