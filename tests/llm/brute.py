"""Plain single-machine versions of the queries, written from their contracts."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def luhn(d):
    s = 0
    for i, c in enumerate(map(int, reversed(d))):
        s += c if i % 2 == 0 else sum(divmod(2 * c, 10))
    return s % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    out = {}
    spans = []
    for kind, pattern, ok in kinds:
        found = [m.span() for m in re.finditer(pattern, text) if ok(m)]
        out[f"n_{kind}"] = len(found)
        spans += [f"{kind}:{a}:{b}" for a, b in found]
    out["base_sha256"] = hashlib.sha256(",".join(spans).encode()).hexdigest()
    return out


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = np.zeros(64, dtype=int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        counts += np.array([h >> b & 1 for b in range(64)])
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def simhash(rows):
    prints = {i: fingerprint(t) for i, t in rows}
    by = {}
    for i, f in sorted(prints.items()):
        by.setdefault(f, []).append(i)
    keys = list(by)
    arr = np.array(keys, dtype=np.uint64)
    pairs = [(i, ids[0]) for ids in by.values() for i in ids[1:]]
    for a in range(len(keys)):
        near = np.bitwise_count(arr[: a + 1] ^ arr[a]) <= 2
        pairs += [(by[keys[a]][0], by[keys[b]][0]) for b in np.flatnonzero(near) if b != a]
    part = components(list(prints), pairs)
    return {i: (format(prints[i], "016x"), part[i]) for i in prints}


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(part):
    return zlib.crc32(np.array(part, dtype="<u4").tobytes())


def _removed(seqs, length):
    """For each sequence, which items a repeated window covers."""
    seen = Counter(tuple(s[i : i + length]) for s in seqs for i in range(len(s) - length + 1))
    out = []
    for s in seqs:
        gone = np.zeros(len(s), dtype=bool)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def bytes_removed(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = {}
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(t), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest())
    return out


def words_removed(rows, length=35):
    seqs = [WORD.findall(t or "") for _, t in rows]
    out = {}
    for (i, _), s, gone in zip(rows, seqs, _removed(seqs, length), strict=True):
        kept = " ".join(w for w, g in zip(s, gone, strict=True) if not g)
        out[i] = (len(s), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def targets(sizes):
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / w > 3 * sizes[s] * (1 + 1e-12)]
        if not over:
            return fixed | {s: left * weight[s] / w for s in rest}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def langid(rows):
    """(lang_pred, score) of each (doc_id, text, lang), learned from all rows that are not held out."""

    def words(t):
        """(letters, the four letters after them): a run of over 64 letters is cut into equal pieces."""
        out = []
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            marked = f"^{w}$"
            k = -(-len(marked) // 64) if len(w) > 64 else 1
            cuts = [i * len(marked) // k for i in range(k + 1)]
            out += [(marked[i:j], marked[j : j + 4]) for i, j in zip(cuts, cuts[1:], strict=False)]
        return out

    def grams(word, n):
        piece, after = word
        return [(piece + after)[i : i + n] for i in range(min(len(piece), len(piece + after) + 1 - n))] if n else [word]

    learn = [(t, lang) for i, t, lang in rows if lang is not None and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)]
    langs = sorted({lang for _, lang in learn})
    counts = [{lang: Counter(g for t, own in learn if own == lang for w in words(t) for g in grams(w, n)) for lang in langs} for n in range(6)]
    known = [set().union(*by.values()) for by in counts]
    total = [{lang: sum(by[lang].values()) + 0.5 * len(known[n] - set(by[lang])) + 0.5 * len(by[lang]) for lang in langs} for n, by in enumerate(counts)]

    def logs(word):
        for n in (0, 5, 4, 3, 2, 1):
            own = [g for g in grams(word, n) if g in known[n]]
            if own:
                return np.array([np.mean([np.log((counts[n][lang][g] + 0.5) / total[n][lang]) for g in own]) for lang in langs])
        return np.zeros(len(langs))

    memo, out = {}, []
    for _, text, _ in rows:
        own = words(text)
        if not own or not langs:
            out.append(("und", 0.0))
            continue
        table = np.array([memo.setdefault(w, logs(w)) if w not in memo else memo[w] for w in own])
        best = int(np.argmax((table - table.max(axis=1, keepdims=True)).sum(axis=0)))
        shares = np.exp(table) / np.exp(table).sum(axis=1, keepdims=True)
        out.append((langs[best], float(shares[:, best].mean())))
    return out


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def collocations(rows, least=100, top=2000):
    """``rows`` are (text, lang)."""
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            own.update(tuple(ws[i : i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in counts.items():
        own = {p: f for p, f in own.items() if f >= least}
        rows = []
        for p, a in own.items():
            inside = any(own[q] * 100 >= 100 * a for q in own if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if len(p) > 1 and not inside:
                score, _, left, right = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return out


def resampled(docs, target, n=1, buckets=10_000, percent=10, least=20):
    """``docs`` are (doc_id, text), ``target`` texts: rows of doc_id, n_features, weight, score, rank."""
    import math

    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(ws), [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, words, fs in own:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = Counter()
    place = {}
    for rank, r in enumerate(enough[: percent * len(enough) // 100], 1):
        place.setdefault(r, []).append(rank)
    out = []
    for r in rows:
        at, drawn[r] = drawn[r], drawn[r] + 1
        ranks = place.get(r, []) if r[1] >= least else []
        out.append((r[0], r[2], r[3], r[4], ranks[at] if at < len(ranks) else None))
    return out
