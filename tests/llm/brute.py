"""Plain versions of the corpus operators, over lists of rows."""

import collections
import hashlib
import math
import re
import zlib

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def secrets(text, extra=()):
    text = text or ""
    key = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k)
                   for k in ("password", "passwd", "secret", "token", "api_?key"))
    found = [(m.start(), 1, m.end(), "assign") for m in re.finditer(
        "(" + key + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [(m.start(), 2, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 3, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 4, m.end(), "pem") for m in re.finditer("-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", text)]
    return sorted(found)


def secret_row(doc_id, text):
    found = secrets(text)
    base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found if k != "pem")
    count = collections.Counter(f[3] for f in found)
    return (doc_id, count["assign"], count["access"], count["hex"], sha(base), ",".join(f"{k}:{a}:{b}" for a, _, b, k in found))


def redacted(text, mask="[secret]"):
    out, at, last = "", 0, None
    runs = []
    for a, _, b, _ in secrets(text):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    for a, b in runs:
        out += text[at:a] + mask
        at = b
    return text if not runs else out + text[at:]


def quality(rows, rules):
    """rows: (doc_id, text, host) -> the judged rows."""
    texts = {(h, t or "") for _, t, h in rows}
    hosts = collections.Counter(h for h, _ in texts)
    held = collections.Counter()
    for h, t in texts:
        held.update({(h, low(" ".join(words(line)))) for line in t.split("\n") if words(line)})
    out = []
    for doc_id, text, host in rows:
        text = text or ""
        w = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        windows = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        cover = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
        gone = 0
        for line in lines:
            n = held[host, low(" ".join(words(line)))]
            if n > rules.min_documents and n * 100 > hosts[host] * rules.host_percent:
                gone += len(words(line))
        failed = len(w) < rules.min_words or 100 * len(cover) > rules.repeat_percent * len(w)
        kept = not failed and len(w) - gone >= rules.min_left_words and 100 * (len(w) - gone) >= rules.min_left_percent * len(w)
        out.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
                    len(cover), gone, failed, kept))
    return out


def repeats(rows, n=50):
    """rows: (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    first = {}
    key = lambda d: -(1 << 63) if d is None else d
    for d, t in rows:
        t = (t or "").encode()
        for i in range(len(t) - n + 1):
            first[t[i:i + n]] = min(key(d), first.get(t[i:i + n], 1 << 63))
    out = []
    for d, t in rows:
        t = (t or "").encode()
        mark, last = bytearray(len(t)), -1
        for i in range(len(t) - n + 1):
            if first[t[i:i + n]] < key(d):
                mark[max(i, last):i + n] = b"\1" * (i + n - max(i, last))
                last = i + n
        out.append((d, len(t), sum(mark), len(re.findall(b"\1+", bytes(mark))), sha(bytes(b for b, m in zip(t, mark, strict=True) if not m))))
    return out


def shingle_set(text, size=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(rows, percent=80):
    """rows: (doc_id, text) -> (doc_id, n_shingles, component_id)."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and find(i) != find(j):
                both = len(s & sets[j])
                if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return [(d, len(sets[i]), min(ids[find(i)], default=None)) for i, (d, _) in enumerate(rows)]


def item_hits(rows, items, size=10):
    """rows: (doc_id, text); items: (item_id, text)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i:i + size])].add("" if item is None else str(item))
    out = []
    for d, text in rows:
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def jump(key, shards):
    b, j = -1, 0
    key %= 1 << 64
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def base_scores(rows, training):
    """rows: (doc_id, text) -> counts and the smoothed unigram score of each."""
    tokens = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    counts = collections.Counter(w for (d, _), ws in zip(rows, tokens, strict=True) if training(d) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    return [(d, not training(d), len(ws), sum(counts[w] > 0 for w in ws), total,
             sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)) for (d, _), ws in zip(rows, tokens, strict=True)], counts


def crc(text):
    return zlib.crc32((text or "").encode())
