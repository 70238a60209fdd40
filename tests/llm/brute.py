"""Plain single-process versions of the operators, for small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(rows, percent=85, size=5):
    """doc_id -> (n_shingles, component_id), all pairs that share a shingle compared."""
    sets = {}
    for i, text in rows:
        w = WORDS.findall((text or "").translate(UPPER))
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = Counter(j for g in s for j in where[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeats(rows, size=13):
    """doc_id -> (n_words, n_removed, sha of the kept words)."""
    least, out = {}, {}
    split = {i: WORDS.findall(t or "") for i, t in rows}
    for i in sorted(split):
        w = split[i]
        for k in range(len(w) - size + 1):
            least.setdefault(tuple(w[k:k + size]), i)
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k:k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def line_measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    at = defaultdict(list)
    for k in range(len(w) - 2):
        at[tuple(w[k:k + 3])].append(k)
    twice = {k + j for places in at.values() if len(places) > 1 for k in places for j in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice)


def line_removals(rows, max_docs):
    """Per (doc_id, text, host) row: words that stand in lines of more distinct documents than the limit."""
    digits = re.compile("[1-9]")

    def norm(line):
        return digits.sub("0", " ".join(WORDS.findall(line)).lower())

    docs = defaultdict(set)
    for i, text, host in rows:
        for line in (text or "").split("\n"):
            if WORDS.search(line):
                docs[host, norm(line)].add((i, text))
    return [sum(len(WORDS.findall(x)) for x in (text or "").split("\n") if WORDS.search(x) and len(docs[host, norm(x)]) > max_docs) for _, text, host in rows]


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """Base spans (kind, start, end), found with three regular expressions."""
    out = []
    for k, (kind, pattern) in enumerate((("assign", ASSIGN), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+")))):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= (6, 20, 24)[k]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def branches(nodes):
    """tree -> messages of the best root-to-leaf path, by mean score, ties to the smaller leaf."""
    by_tree = defaultdict(dict)
    for tree, node, parent, score in nodes:
        by_tree[tree][node] = (parent, score or 0.0)
    best = {}
    for tree, ns in by_tree.items():
        parents = {p for p, _ in ns.values() if p in ns}
        for leaf in sorted(set(ns) - parents):
            path, x, seen = [], leaf, set()
            while x in ns and x not in seen:
                seen.add(x)
                path.append(x)
                x = ns[x][0]
            score = sum(ns[n][1] for n in path) / len(path)
            if x not in seen and (tree not in best or score > best[tree][0]):
                best[tree] = (score, path[::-1])
    return {t: p for t, (_, p) in best.items()}
