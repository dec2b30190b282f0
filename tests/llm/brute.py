"""Plain single-process versions of the operators, for comparison on small fixtures."""

from __future__ import annotations

import hashlib
import re

SPACE = re.compile("[\x20\x09-\x0d]+")


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def exact(rows):
    """rows: (id, text) -> sorted (id, keep_id, group_size, kept, sha)."""
    groups = {}
    for i, text in rows:
        sha = hashlib.sha256(SPACE.sub("", text or "").encode()).hexdigest()
        groups.setdefault(sha, []).append((-len(text or ""), order(i), i))
    out = []
    for sha, members in groups.items():
        keep = min(members)[2]
        out += [(i, keep, len(members), i == keep, sha) for _, _, i in members]
    return sorted(out, key=lambda r: (order(r[0]), r[4]))


def levenshtein_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    if len(a) == len(b):
        return a[p + 1 :] == b[p + 1 :]
    return a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def lines(rows, min_chars):
    """-> {(id, line_no): (keep_id, keep_line)}."""
    taken = [(order(i), n, i, line) for i, text in rows for n, line in enumerate((text or "").split("\n")) if len(line) >= min_chars]
    taken.sort(key=lambda r: r[:2])
    return {(i, n): next((j, m) for _, m, j, other in taken if levenshtein_within_one(line, other)) for _, n, i, line in taken}


def shingles(text, width=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in SPACE.split(lowered) if w]
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near(rows, width=5, percent=80):
    """-> [(id, n_shingles, component_id)] in the order of rows."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for x in range(len(rows)):
        if rows[x][0] is not None:
            r = find(x)
            least[r] = min(least.get(r, rows[x][0]), rows[x][0])
    return [(rows[x][0], len(sets[x]), least.get(find(x))) for x in range(len(rows))]


def repeats(rows, length=100):
    """-> [(id, n_bytes, n_removed, n_spans, kept)] in the order of rows."""
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for s in range(len(b) - length + 1):
            at = (order(i), s)
            w = b[s : s + length]
            if w not in first or at < first[w]:
                first[w] = at
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (order(i), s):
                gone[s : s + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, kept))
    return out


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    """All levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def flanks(levels, at, fanout):
    """(left, right) siblings of the leaf at a place, by level."""
    out = []
    for level in levels[:-1]:
        run = level[at // fanout * fanout : at // fanout * fanout + fanout]
        out.append(("".join(run[: at % fanout]), "".join(run[at % fanout + 1 :])))
        at //= fanout
    return out


def manifest(rows, fanout=2):
    """rows: (id, group, leaf) -> sorted (id, group, leaf, subroot, root, path)."""
    groups = {}
    for i, g, h in rows:
        groups.setdefault(g, []).append((order(i), h, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([h for _, h, _ in sorted(groups[g], key=lambda x: x[:2])], fanout) for g in names}
    top = tree([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for at, (_, h, i) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            out.append((i, g, h, trees[g][-1][0], top[-1][0], flanks(trees[g], at, fanout) + flanks(top, k, fanout)))
    return out


def target_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered)


def resampled(rows, target, width=1, buckets=10000, percent=10, min_words=20, seed=2024):
    """rows: (id, text) -> sorted (id, n_features, weight, score, rank)."""
    import math
    import zlib

    def features(text):
        w = target_words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, width + 1) for i in range(len(w) - k + 1)]

    mine = [features(t) for _, t in rows]
    raw, wanted = [0] * buckets, [0] * buckets
    for f in mine:
        for b in f:
            raw[b] += 1
    for t in target:
        for b in features(t):
            wanted[b] += 1
    s, t = sum(raw), sum(wanted)
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for (i, text), f in zip(rows, mine):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(target_words(text))])
    able = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], order(x[0])))
    for rank, x in enumerate(able[: len(able) * percent // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=lambda x: (order(x[0]), x[1:4], x[4] or 0))


def edited(rows):
    """rows: (id, text) of distinct ids -> {id: edited text}."""
    ordered = sorted(((order(i), i, t or "") for i, t in rows), key=lambda x: x[0])
    out = {}
    for k, (_, i, t) in enumerate(ordered):
        half = len(t) // 2
        out[i] = t[: len(t) - half] + ordered[(k + 1) % len(ordered)][2][:half]
    return out
