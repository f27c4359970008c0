"""Plain versions of what the operators do, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often, covered = collections.Counter(runs), set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def shingles(text, n):
    w = words(text)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(docs, n, percent):
    """Smallest id of the component of each position of ``docs``."""
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        root = find(i)
        least[root] = min((k for k in (least.get(root), key) if k is not None), default=None)
    return [(len(sets[i]), least[find(i)]) for i in range(len(docs))]


def base_scores(docs):
    tokens = [words(t) + [None] for _, t in docs]
    counts = collections.Counter()
    for (key, _), t in zip(docs, tokens):
        if zlib.crc32(str(key if key is not None else "").encode()) % 7 != 2:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    return [(len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for t in tokens]


RULES = (
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 1, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def secrets(text):
    found = [
        (m.start(), i, kind, m.end())
        for i, (kind, pattern, group, least) in enumerate(RULES)
        for m in pattern.finditer(text or "")
        if len(m.group(group)) >= least
    ]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def copies(docs):
    groups = collections.defaultdict(list)
    for key, text in docs:
        groups[plain(text)].append((-len(text or ""), key is None, key or 0, key))
    return {t: (min(g)[3], len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items()}
