"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def without_repeats(rows, depth=100):
    """{(id, text): (bytes, removed, runs, sha256)} of (id, text) rows in order of id, null first."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            w = b[p:p + depth]
            if w in seen:
                gone[p:p + depth] = b"\1" * depth
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text, size=5):
    w = WORD.findall(low(text))
    return frozenset(tuple(w[j:j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()


def near_duplicates(rows, percent=85):
    """{row number: (shingles, smallest id of the component)}; null ids are largest."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for a in range(len(rows)):
        groups[find(a)].append(a)
    out = {}
    for members in groups.values():
        ids = [rows[a][0] for a in members if rows[a][0] is not None]
        for a in members:
            out[a] = (len(sets[a]), min(ids) if ids else None)
    return out


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def base_spans(text):
    """The stated patterns as they are written."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def contaminated(text, items, size=5, percent=80):
    """{item: best weighted similarity of an item-sized window that reaches the threshold}."""
    def split(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(t))

    def counts(w):
        return collections.Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1))

    words, out = split(text), {}
    for name, item in items:
        own = split(item)
        if len(own) < size:
            continue
        target = counts(own)
        for i in range(len(words) - len(own) + 1):
            window = counts(words[i:i + len(own)])
            common = (target & window).total()
            alike = common / (target.total() + window.total() - common)
            if alike * 100 >= percent:
                out[name] = max(out.get(name, 0), alike)
    return out


def merkle(rows, fanout=16):
    """[(doc_id, leaf, subroot, root, proof, folded root, verified)] of (doc_id, text, lang, source, n_chars) rows."""
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(i, text, lang, source, n):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def tree(nodes):
        """Root and, per node, its segments from the bottom up."""
        paths, spans = [[] for _ in nodes], [[j] for j in range(len(nodes))]
        while len(nodes) > 1:
            up, upper = [], []
            for at in range(0, len(nodes), fanout):
                run = nodes[at:at + fanout]
                for j, members in enumerate(spans[at:at + fanout]):
                    for m in members:
                        paths[m].append(("".join(run[:j]), "".join(run[j + 1:])))
                up.append(h(*run))
                upper.append([m for members in spans[at:at + fanout] for m in members])
            nodes, spans = up, upper
        return nodes[0], paths

    groups = collections.defaultdict(list)
    for r in rows:
        changed = r[1]
        if zlib.crc32((str(r[0]) if r[0] is not None else "").encode()) % 5 == 0 and changed is not None:
            changed = low(changed)
        groups[r[3]].append((r[0], leaf(*r), leaf(r[0], changed, *r[2:])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for name in names:
        members = sorted(groups[name], key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        made.append((members, *tree([m[1] for m in members])))
    root, tops = tree([m[1] for m in made])
    out = []
    for (members, subroot, paths), top in zip(made, tops):
        for (i, a, b), path in zip(members, paths):
            node = b
            for lft, rgt in path + top:
                node = h(lft, node, rgt)
            out.append((i, a, subroot, root, h(*(lft + rgt for lft, rgt in path + top)), node, node == root))
    return out


def collocations(rows, least=100, longest=5, covered=100, top=2000):
    """[(lang, rank, phrase, a, l, r, n, score)] of (text, lang) rows."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", low(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in found.items():
            if any(100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in found.items() if len(q) > len(p)):
                continue
            cuts = [(1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, lft, rgt) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, lft, rgt, n[lang], -score))
    return sorted(out)
