"""Plain Python versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

SEP = r"[^\x20\x09-\x0D]+"


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(SEP, text)


def shingles(text, k=5):
    w = words(text, True)
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def near_components(rows, percent=75):
    """{id: component} by comparing all pairs of rows (id, text)."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def base_counts(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if grams[g] > 1:
            inside.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if re.search(SEP, x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside)


def depleted(rows, limit, keep_percent=50):
    """Whether each row (host, text) loses too much to lines that more than ``limit`` texts of its host have."""

    def norm(line):
        return " ".join(words(re.sub("[0-9]+", "0", line.lower())))

    texts = defaultdict(set)
    for host, text in rows:
        for line in (text or "").split("\n"):
            if norm(line):
                texts[host, norm(line)].add(text)
    out = []
    for host, text in rows:
        total = gone = 0
        for line in (text or "").split("\n"):
            n = len(words(norm(line)))
            total += n
            gone += n if n and len(texts[host, norm(line)]) > limit else 0
        out.append(gone > 0 and 100 * (total - gone) < keep_percent * total)
    return out


def cut_lines(texts, least, depth=3, constant=60):
    """(text, n_lines, n_dropped) of each text after the template tree."""

    def mask(w):
        return "<*>" if re.search("[0-9]", w) else w

    leaves = defaultdict(set)
    for t in {t for t in texts if t is not None}:
        for line in t.split("\n"):
            w = tuple(mask(x) for x in words(line))
            if w:
                leaves[len(w), w[:depth]].add((t, w))
    drop = set()
    for rows in leaves.values():
        if len({t for t, _ in rows}) < least:
            continue
        cells = Counter((i, x) for _, w in rows for i, x in enumerate(w))
        template = {}
        for _, w in rows:
            fixed = [x if cells[i, x] >= least and x != "<*>" else None for i, x in enumerate(w)]
            few = 100 * sum(x is not None for x in fixed) < constant * len(w)
            template[w] = w if few else tuple(x or "<*>" for x in fixed)
        users = defaultdict(set)
        for t, w in rows:
            users[template[w]].add(t)
        drop |= {w for _, w in rows if len(users[template[w]]) >= least}
    out = []
    for t in texts:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if tuple(mask(w) for w in words(x)) not in drop or not words(x)]
        out.append((None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def tiles(a, b, shortest=5):
    """Greedy string tiling by looking at every pair of places in every round."""
    used_a, used_b, out = [0] * len(a), [0] * len(b), []
    while True:
        best, most = [], shortest
        for j in range(len(b)):
            for i in range(len(a)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > most:
                    best, most = [(i, j)], k
                elif k == most:
                    best.append((i, j))
        for i, j in best:
            if not any(used_a[i : i + most]) and not any(used_b[j : j + most]):
                used_a[i : i + most] = used_b[j : j + most] = [1] * most
                out.append((i, j, most))
        if not best:
            return sorted(out)


def leaks(rows, items, percent=75):
    """{(id, item)} whose item is covered by tiles."""
    out = set()
    for i, t in rows:
        for k, x in items:
            a, b = words(t, True), words(x, True)
            covered = sum(n for _, _, n in tiles(a, b, min(5, len(b)))) if b else 0
            if b and 100 * covered >= percent * len(b):
                out.add((i, k))
    return out


def repeats(rows, least=50):
    """{(id, start, words)}: unions of runs of ``least`` words that another id has too."""
    seen, texts = defaultdict(set), []
    for i, t in rows:
        w = words(t, True)
        texts.append((i, w))
        for p in range(len(w) - least + 1):
            seen[tuple(w[p : p + least])].add(i)
    out = set()
    for i, w in texts:
        covered = [0] * (len(w) + 1)
        for p in range(len(w) - least + 1):
            if len(seen[tuple(w[p : p + least])]) > 1:
                covered[p : p + least] = [1] * least
        start = None
        for p, c in enumerate(covered):
            if c and start is None:
                start = p
            if not c and start is not None:
                out.add((i, start, p - start))
                start = None
    return out


def periodic(w, least=6, times=4):
    """Sorted runs (start, length, period) of a word list, looking along every diagonal."""
    best = {}
    for p in range(1, len(w) // times + 1):
        i = p
        while i < len(w):
            if w[i] != w[i - p]:
                i += 1
                continue
            begin = i
            while i < len(w) and w[i] == w[i - p]:
                i += 1
            length = i - begin + p
            if length >= max(least, times * p):
                best.setdefault((begin - p, length), p)
    return sorted((s, n, p) for (s, n), p in best.items())


def without_repeats(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)
