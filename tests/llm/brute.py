"""Plain single-process versions of the corpus operators, written from their contracts."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    """[(doc_id, text)] to {doc_id: (keep_id, group_size, kept, sha256)}."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {i: (min(own), len(own), i == min(own), sha(t)) for t, own in groups.items() for i in own}


def lines(rows, at_least=10):
    key = lambda x: lower(x.strip(WS))
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = {}
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (key(x) and held[key(x)] >= at_least)]
        out[i] = (len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept)), "\n".join(kept))
    return out


def warc(rows):
    """[(page_id, html)] to {page_id: (payload_bytes, digest, type, refers_to)}."""
    largest = {}
    for i, t in rows:
        largest[t or ""] = max(i, largest.get(t or "", i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        first = largest[t or ""]
        out[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)
    return out


def quality(text):
    w = words(text)
    lines_ = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines_) - len(set(lines_)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def secrets(text):
    """Base spans (start, kind, end) in order."""
    text = text or ""
    key = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    found = []
    for m in re.finditer(rf"""{key}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def spans_text(found):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)


def simhash(text, width=4, seed=42):
    w = words(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows, radius=4):
    """[(doc_id, text)] to {doc_id: (fingerprint, component)} by comparing all pairs."""
    prints = [(i, simhash(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        least[top(k)] = min(i, least.get(top(k), i))
    return {i: (f"{p:016x}", least[top(k)]) for k, (i, p) in enumerate(prints)}


def best_padding(histogram, buckets):
    """Fewest padding tokens with at most `buckets` bucket lengths, by trying all."""
    from itertools import combinations

    lengths = sorted(histogram)
    best = None
    for k in range(min(buckets, len(lengths))):
        for inner in combinations(lengths[:-1], k):
            ends = [*inner, lengths[-1]]
            cost = sum(n * (next(e for e in ends if e >= x) - x) for x, n in histogram.items())
            best = cost if best is None else min(best, cost)
    return best


def host_prior(hosts):
    """{host: (n, failed)} to {host: shrunk rate}, the prior's moments in plain floats."""
    total, failed = sum(n for n, _ in hosts.values()), sum(f for _, f in hosts.values())
    m = failed / total if total else 0.0
    weight, rho = sum((1 - n / total) * (n - 1) for n, _ in hosts.values()), 0.0
    if 0 < m < 1 and weight > 1e-9:
        rho = (sum(n * (f / n - m) ** 2 for n, f in hosts.values()) / (m * (1 - m)) - (len(hosts) - 1)) / weight
        rho = max(0.0, min(1.0, rho))
    return {h: (f * rho + m * (1 - rho)) / (n * rho + 1 - rho) for h, (n, f) in hosts.items()}


def kept_by_quality(rows, most=0.5):
    """Rows (doc_id, text, lang, source, ...) that pass the rules and whose source isn't rejected."""
    failed = [quality(r[1])[5] for r in rows]
    hosts = defaultdict(lambda: (0, 0))
    for r, f in zip(rows, failed, strict=True):
        n, k = hosts[r[3]]
        hosts[r[3]] = (n + 1, k + f)
    rate = host_prior(hosts)
    return [r for r, f in zip(rows, failed, strict=True) if not f and rate[r[3]] <= most]


def last_null(i):
    return (i is None, i or 0)


def one_of_each(rows, key):
    """The row with the smallest id (null last) of each key."""
    best = {}
    for r in rows:
        k = key(r)
        if k not in best or last_null(r[0]) < last_null(best[k][0]):
            best[k] = r
    return list(best.values())


def shingles(text, width=5):
    w = words(lower(text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_groups(texts):
    """A name of the component of each text, linked by a Jaccard similarity of 0.8 or more."""
    sets, top = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)) and 10 * (c := len(x & y)) >= 8 * (len(x) + len(y) - c):
                top[find(a)] = find(b)
    return [find(k) for k in range(len(texts))]


def mixed(rows, length, weights, share, max_epochs, seed):
    """Rows (doc_id, text, lang, source, ...), repeated as often as they are read: [(row, epoch)]."""
    domain = lambda s: "domain" + (str(int(m[1]) % 4) if (m := re.search("([0-9]+)$", s or "")) else "-")
    path = lambda r: (domain(r[3]), "<null>" if r[2] is None else r[2], "<null>" if r[3] is None else r[3])
    tokens = Counter()
    for r in rows:
        tokens[path(r)] += length(r)
    given = {(): min(int(sum(tokens.values()) * share), sum(tokens.values()) * max_epochs)}
    for depth, name in enumerate(("domain", "lang", "source")):
        below = defaultdict(Counter)
        for p, t in tokens.items():
            below[p[:depth]][p[depth]] += max_epochs * t
        now = {}
        for parent, caps in below.items():
            w = {c: weights.get(name, {}).get(c, weights.get(name, {}).get("*", 1)) for c in caps}
            order = sorted(caps, key=lambda c: (caps[c] / w[c], c))
            left, level = given[parent], None
            for k, c in enumerate(order):
                at = left / sum(w[x] for x in order[k:])
                if at < caps[c] / w[c]:
                    level = at
                    break
                left -= caps[c]
            for c in order:
                now[(*parent, c)] = caps[c] if level is None or caps[c] / w[c] <= level else max(0, int(level * w[c]))
        given = now
    out = []
    for p in tokens:
        own = [r for r in rows if path(r) == p]
        whole, rest = divmod(given[p], tokens[p]) if tokens[p] else (0, 0)
        key = lambda r: hashlib.md5(f"{seed}:{whole}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()  # noqa: E731, B023
        reached, inside = 0, set()
        for r in sorted(own, key=lambda r: (key(r), length(r))):
            if reached < rest:
                inside.add(key(r))
            reached += length(r)
        out += [(r, e) for r in own for e in range(whole + (key(r) in inside))]
    return out


def packed(rows, length, buckets, max_len=2048, token_budget=16384, seed=7):
    """Rows of the packing stage for mixed rows; readings of one (id, text) are numbered as they come. buckets: the bucket lengths."""
    seen, pieces = Counter(), []
    for r in rows:
        epoch = seen[r[0], r[1] or ""]
        seen[r[0], r[1] or ""] += 1
        total = length(r)
        for k in range(max(1, -(-total // max_len))):
            n = min(max_len, total - k * max_len)
            size = next((b for b in sorted(buckets) if b >= n), None) if n else None
            pieces.append((size or 0, epoch, hashlib.md5(f"{seed}:{'null' if r[0] is None else r[0]}:{k}".encode()).hexdigest(), last_null(r[0])[1], k, n, r[0]))
    out, batch, slot, before = [], -1, 0, None
    for size, epoch, _, _, k, n, i in sorted(pieces):
        if not size:
            out.append((i, epoch, k, k * max_len, n, None, None, None, None))
            continue
        if before is None or before[0] != size:
            batch, slot = 0, 0
        elif before[1] != epoch or slot + 1 == token_budget // size:
            batch, slot = batch + 1, 0
        else:
            slot += 1
        before = (size, epoch)
        out.append((i, epoch, k, k * max_len, n, size, batch, slot, size - n))
    return out
