"""Plain, slow versions of the operators."""

from __future__ import annotations

import hashlib
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> str:
    text, found = text or "", []
    for k, (name, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = name == "email" or name == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or name == "card" and 12 <= len(digits) <= 19 and luhn(digits) or name == "phone" and 9 <= len(digits) <= 15
            if ok:
                found.append((m.start(), k, m.end(), name))
    return ",".join(f"{name}:{s}:{e}" for s, _, e, name in sorted(found))


def base_counts(text: str | None) -> tuple[int, int, int, int]:
    spans = [x.split(":")[0] for x in base_spans(text).split(",") if x]
    return tuple(spans.count(k) for k in ("email", "ip", "card", "phone"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), all pairs that share a shingle compared."""
    sets = {i: shingle_set(t) for i, t in rows}
    by_shingle: dict = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in sets.items():
        common: dict = {}
        for x in s:
            for j in by_shingle[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def without_repeats(rows: list[tuple[int, str | None]], width: int = 35) -> list[tuple]:
    """(doc_id, n_words, n_removed, sha of the kept words), row by row."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen: dict = {}
    for _, w in words:
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            seen[x] = seen.get(x, 0) + 1
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def base_scores(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    import math
    import zlib
    from collections import Counter

    counts: Counter = Counter()
    split = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]
        split[i] = (zlib.crc32(str(i).encode()) % 5 == 1, words)
        if not split[i][0]:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    return {
        i: (held, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        for i, (held, words) in split.items()
    }


def lattice_scores(rows: list[tuple[int, str | None]], names: list[str], scores: list[float], data: dict[int, int], prior: float) -> dict[int, float]:
    """doc_id -> log10 of the document's probability, every segmentation of every word written out."""
    import math
    import zlib
    from collections import Counter

    usable = [i for i, n in enumerate(names) if n and (scores[i] > -1e8 or n == "▁") and "▁" not in n[1:]]
    p = [0.0] * len(names) + [0.0]
    for rank, i in enumerate(sorted(usable, key=lambda i: (-scores[i], i))):
        p[i] = 1 / (rank + 10)
    total = sum(p)
    p = [x / total for x in p]
    for i in data.values():
        p[i] = 1e-3 / len(data)
    p[-1] = 0.01
    p = [x / sum(p) for x in p]
    place = {names[i]: i for i in usable}

    def ways(w):
        if not w:
            return [[]]
        out = [[place[w[:k]], *rest] for k in range(1, len(w) + 1) if w[:k] in place for rest in ways(w[k:])]
        if w[0] not in place:
            out += [[*(data[b] for b in w[0].encode()), *rest] for rest in ways(w[1:])]
        return out

    split = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        split[i] = (zlib.crc32(str(i).encode()) % 5 == 1, words)
    counts = Counter(w for held, words in split.values() if not held for w in words)
    segmented = {w: ways("▁" + w.replace("▁", "\ue581")) for _, words in split.values() for w in words}
    expected = [0.0] * len(p)
    for w, c in counts.items():
        weight = [math.prod(p[x] for x in way) for way in segmented[w]]
        for way, x in zip(segmented[w], weight, strict=True):
            for piece in way:
                expected[piece] += c * x / (2 * sum(weight))
    expected[-1] = sum(not held for held, _ in split.values())
    total = sum(expected) + sum(counts.values()) / 2 + prior
    p = [(e + prior * x) / total for e, x in zip(expected, p, strict=True)]
    begin = p[-1] + sum(p[i] for i in usable if names[i].startswith("▁")) + sum(counts.values()) / 2 / total
    chance = {w: sum(math.prod(p[x] for x in way) for way in segmented[w]) + counts[w] / 2 / total / begin for w in segmented}
    return {i: sum(math.log10(chance[w]) for w in words) + math.log10(p[-1] / begin) for i, (_, words) in split.items()}


def mixed(rows: list[tuple], seed_order, weights=(1, 2, 3), epochs=3) -> dict:
    """(id, source, size) -> sorted copies of each of its rows; ``seed_order`` gives the place of (id, source) in its stream."""
    words: dict = {}
    for _, source, size in rows:
        words[source] = words.get(source, 0) + size
    sources = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, left, open_ = {}, float(sum(words.values())), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= epochs * words[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = float(epochs * words[s])
            left -= target[s]
        open_ -= full
    out: dict = {}
    for s in sources:
        start = 0
        for i, size in sorted(((i, n) for i, x, n in rows if x == s), key=lambda x: (seed_order(x[0], s), x[0] is not None, x[0] or 0, x[1])):
            taken = sum(size > 0 and e * words[s] + start + size / 2 <= target[s] for e in range(epochs))
            out.setdefault((i, s, size), []).append(taken)
            start += size
    return {k: sorted(v) for k, v in out.items()}


def longest_first(sizes: dict, n: int) -> dict:
    """group -> shard: largest first, each to the shard with the least so far, ties to the lower number and the smaller key."""
    load, out = [0] * n, {}
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        shard = min(range(n), key=lambda b: (load[b], b))
        out[key] = shard
        load[shard] += sizes[key]
    return out


def best_products(rows: list[tuple], k: int, step: int) -> list[tuple]:
    """(query, rank, id, score), all pairs compared in whole numbers of any size."""
    import math

    ok = {(i, tuple(x + 0.0 for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = {(i, tuple(math.floor(min(max(256 * x, -1.7976931348623157e308), 1.7976931348623157e308)) for x in v)) for i, v in ok}
    out = []
    for i, q in whole:
        if i % step == 0:
            scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(q, v, strict=True)))), j) for j, v in whole if j != i and len(v) == len(q)]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def trie(rows: list[tuple], block: int = 20, heads: int = 4) -> list[tuple]:
    """(node, depth, parent, n_convs, n_children, n_leaves, saved, ends) of every node; ``rows`` are (conv_id, turn, role, text)."""
    import math
    import zlib

    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        full[c] = own.get(c - int(math.fmod(c, block)), [])[:h] + ts[h:]
    members: dict = {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for seq, cs in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        children = {s[: len(seq) + 1] for s in below if len(s) > len(seq)}
        leaves = sum(not any(len(z) > len(s) and z[: len(s)] == s for z in below) for s in below)
        saved = sum((len(members[s]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) for s in below if s)
        parent = min(members[seq[:-1]]) if seq else None
        out.append((min(cs), len(seq), parent, len(cs), len(children), leaves, saved, sha(",".join(str(c) for c in sorted(cs) if len(full[c]) == len(seq)))))
    return sorted(out, key=lambda r: r[:2])


def resampled(rows: list[tuple], target: list[str | None], buckets: int = 10_000) -> list[tuple]:
    """(id, n_features, weight, score, rank) of each row (id, text), ranks by falling score, then id (null last)."""
    import math
    import zlib
    from collections import Counter

    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return words, [zlib.crc32(x.encode()) % buckets for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]

    source, wanted, made = Counter(), Counter(), []
    for i, text in rows:
        words, found = grams(text)
        source.update(found)
        made.append((i, len(words), found))
    for text in target:
        wanted.update(grams(text)[1])
    s_all, t_all = sum(source.values()) + buckets, sum(wanted.values()) + buckets
    out = []
    for i, n, found in made:
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((source[b] + 1) * t_all))) for b in found) // max(len(found), 1)
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: 25 * len(fit) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)
