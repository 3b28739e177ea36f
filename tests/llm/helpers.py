"""Brute-force versions that the operators are held against."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words long, h string, id long, text_hash long, size string, shard int, block int, part string, g int"


def docs_frame(spark, rows):
    """(doc_id, text) rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2, 3, "z", 4, 5, "p", 6) for i, t in rows], SCHEMA)


def shingles(text):
    w = SPACED.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs):
    """{row: (set size, least reachable id)} for [(id, text)], by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    inside = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            inside[x].append(k)
    both = Counter((a, b) for ks in inside.values() for i, a in enumerate(ks) for b in ks[i + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(len(sets[k]), least.get(top(k))) for k in range(len(docs))]


def contamination(docs, items):
    win = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(FOLD))
        for k in range(max(1, len(w) - 9) if w else 0):
            win[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(x) for x in win}
    out = []
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(FOLD))
        hit, ids = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in win:
                    hit.update(range(k, k + n))
                    ids |= win[x]
        out.append((i, len(w), len(hit), len(ids), sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


_ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    t = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in _ASSIGN.finditer(t) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def surface(text):
    t = text or ""
    w, seen, dup = SPACED.findall(t), set(), 0
    for line in t.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)
