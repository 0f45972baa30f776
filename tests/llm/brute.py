"""Plain-Python versions of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def exact(rows):
    out = []
    keyed = [(d, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for d, t in rows]
    groups = {}
    for i, (d, t, n) in enumerate(keyed):
        groups.setdefault(n, []).append((-len(t), d is None, d or 0, i))
    for i, (d, t, n) in enumerate(keyed):
        best = min(groups[n])
        out.append((d, None if best[1] else best[2], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()))
    return out


def substrings(rows, window=35):
    ws = [BLANK.findall(t or "") for _, t in rows]
    times = Counter(tuple(w[i:i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, ws):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if times[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffixes(rows, length=200):
    bs = [(t or "").encode() for _, t in rows]
    times = Counter(hash(b[i:i + length]) for b in bs for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, bs):
        gone, last = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if times[hash(b[i:i + length])] > 1:
                lo = max(i, last)
                gone[lo:i + length] = b"\x01" * (i + length - lo)
                last = i + length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        n_spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, n):
    w = BLANK.findall(lower(text or ""))
    if len(w) >= n:
        return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)] if w else [])


def near(rows, n):
    """doc_id -> (n_shingles, component) by comparing through a prefix index."""
    sets = [(d, shingles(t, n)) for d, t in rows]
    times = Counter(x for _, s in sets for x in s)
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i, (d, s) in enumerate(sets):
        order = sorted(s, key=lambda x: (times[x], x))
        seen = set()
        for x in order[:len(order) - -(-4 * len(order) // 5) + 1]:
            seen |= set(index.get(x, ()))
            index.setdefault(x, []).append(i)
        for j in seen:
            e, u = sets[j]
            both = len(s & u)
            if 100 * both >= 80 * (len(s) + len(u) - both):
                a, b = find(d), find(e)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets}


def benchmark(rows, items, window=13):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    owners = {}
    for item, text in items:
        w = word.findall(lower(text or ""))
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            owners.setdefault(tuple(w[i:i + window]), set()).add(item)
    sizes = sorted({len(k) for k in owners})
    out = []
    for d, text in rows:
        w = word.findall(lower(text or ""))
        hit, found = [False] * len(w), set()
        for i in range(len(w)):
            for n in sizes:
                k = tuple(w[i:i + n])
                if len(k) == n and k in owners:
                    hit[i:i + n] = [True] * n
                    found |= owners[k]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        n = sum(hit)
        out.append((d, len(w), n, len([x for x in found if x is not None]), hashlib.sha256(ids.encode()).hexdigest(),
                    n > 0 and 20 * n >= len(w)))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_pii(text):
    """Base spans as (start, kind rank, end)."""
    out = []
    for rank, (kind, pattern) in enumerate(PII.items(), 1):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((m.start(), rank, m.end()))
    return sorted(out)


def base_digest(text):
    kinds = ["", *PII]
    return hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in base_pii(text)).encode()).hexdigest()


def bootstrap(found, accept=0.5, support=5, smoothing=1.0):
    """Accepted {(pattern, form, kind): score} from (pattern, form, value, seed) rows."""
    values, seeds = {}, {}
    for pattern, form, value, seed in found:
        values.setdefault((pattern, form), set()).add(value)
        if seed:
            seeds.setdefault(value, {})[seed] = 1.0
    kinds = {k for s in seeds.values() for k in s}
    accepted, known = {}, dict(seeds)
    while True:
        scored = {}
        for (pattern, form), vs in values.items():
            for kind in kinds:
                scores = [known[v][kind] for v in vs if kind in known.get(v, {})]
                score = sum(scores) / (len(vs) + smoothing)
                if len(scores) >= support and score >= accept:
                    scored[pattern, form, kind] = score
        if len(scored) == len(accepted):
            return scored
        accepted, known = scored, {v: dict(s) for v, s in seeds.items()}
        for (pattern, form, kind), score in accepted.items():
            for v in values[pattern, form] - set(seeds):
                entry = known.setdefault(v, {})
                entry[kind] = max(entry.get(kind, 0.0), score)
