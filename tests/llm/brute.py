"""Plain Python versions of the operators, for small tables."""
import hashlib
import re

SPACE = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def classes(docs, size, percent):
    """docs: (doc_id, text) -> doc_id -> (n_shingles, component)."""
    sets = []
    for doc, text in docs:
        w = words(lower(text))
        sets.append((doc, {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()))
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    post = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            post.setdefault(g, []).append(k)
    for k, (d, s) in enumerate(sets):
        seen = {}
        for g in s:
            for j in post[g]:
                if j < k:
                    seen[j] = seen.get(j, 0) + 1
        for j, inter in seen.items():
            if 100 * inter >= percent * (len(s) + len(sets[j][1]) - inter):
                a, b = root(d), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), root(d)) for d, s in sets)


def substring(docs, size=35):
    count = {}
    for _, text in docs:
        w = words(text)
        for i in range(len(w) - size + 1):
            count[tuple(w[i:i + size])] = count.get(tuple(w[i:i + size]), 0) + 1
    out = []
    for doc, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


BASE = {"assign": re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}


def secrets(text):
    text = text or ""
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            if kind == "assign" and len(m[1]) < 6 or kind == "access" and len(m[0]) < 20 or kind == "hex" and len(m[0]) < 24:
                continue
            found.append((m.start(), order, kind, m.end()))
    found.sort()
    line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
    return [sum(k == x for _, _, k, _ in found) for x in BASE], hashlib.sha256(line.encode()).hexdigest(), line


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    rep = {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(3)}
    n = len(w)
    return (n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), n < 50 or 100 * len(rep) > 50 * n)


LICENSE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def licenses(text):
    w = LICENSE.findall(lower(text))
    at, labels = [], []
    for label, phrase in PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        at += here
        labels += [label] * bool(here)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def suffixes(docs, size=100):
    """(doc_id, text), one row per doc_id -> (doc_id, bytes, removed, spans, kept hash)."""
    seen = {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        b = (text or "").encode()
        for i in range(len(b) - size + 1):
            seen.setdefault(b[i:i + size], (doc, i))
    out = []
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] != (doc, i):
                gone[i:i + size] = b"\1" * size
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def cheapest(turns):
    """(cost, audit) of the cheapest repair, by trying every edit with up to three inserts in a row. turns: one letter each, see turn_repair."""
    import functools

    @functools.lru_cache(None)
    def go(i, state, inserted):
        ways = [(0, "")] if i == len(turns) and state in (0, 3) else []
        want = "a" if state == 2 else "u"
        after = 2 if want == "u" else 3

        def add(cost, letter, rest):
            ways.append((cost + rest[0], letter + rest[1]))
        if inserted < 3:
            add(2, "I", go(i, after, inserted + 1))
        if i < len(turns):
            add(3, "D", go(i + 1, state, 0))
            if turns[i] != "d":
                cut = turns[i].isupper()
                if turns[i].lower() == want:
                    add(cut, "K", go(i + 1, after, 0))
                if turns[i].lower() == "s" and state == 0:
                    add(cut, "K", go(i + 1, 1, 0))
                add(2 + cut, "R", go(i + 1, after, 0))
        return min(ways, default=(10 ** 9, ""))
    return go(0, 0, 0)


def conversations(rows):
    """(conv_id, turn, role, text) after damage -> conv_id -> gaps, blank, duplicate, truncated, illegal, cost, audit, hash."""
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, turns in found.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, code, counts = set(), "", [0, 0, 0]
        for _, role, text in turns:
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            body = text.strip(SPACE)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            code += "d" if fault in (0, 1) else kind.upper() if fault == 2 else kind
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = cheapest(code)
        lines, state, at = [], 0, 0
        for letter in audit:
            want = "a" if state == 2 else "u"
            role, text = {"u": "user", "a": "assistant"}[want], ""
            if letter != "I":
                _, had, text = turns[at]
                at += 1
                role = had if letter == "K" else role
                if letter == "D":
                    continue
                if letter == "K" and state == 0 and had[0] == "s":
                    state = 1
                    lines.append(f"{role}:{text}")
                    continue
            lines.append(f"{role}:{text}")
            state = 2 if want == "u" else 3
        out.append((conv, gaps, *counts, illegal, cost, audit, digest("\n".join(lines))))
    return out


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def manifest(rows, fanout):
    """(doc_id, source, lang, n_chars, text) and the text that arrived -> doc_id, leaf, subroot, root, proof, folded root."""
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(tree, i):
        out = []
        for nodes in tree[:-1]:
            start = i // fanout * fanout
            out.append((nodes[start:i], nodes[i + 1:start + fanout]))
            i //= fanout
        return out
    trees = {}
    for row, arrived in rows:
        head = [field(x) for x in row[:4]]
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, digest(*head, field(row[4])), digest(*head, field(arrived)), row[0]))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for leaves in trees.values():
        leaves.sort(key=lambda x: x[:3])
    made = {s: levels([x[2] for x in trees[s]]) for s in names}
    top = levels([made[s][-1][0] for s in names]) if names else []
    out = []
    for k, s in enumerate(names):
        for i, x in enumerate(trees[s]):
            way = path(made[s], i) + path(top, k)
            root = x[3]
            for before, after in way:
                root = digest(*before, root, *after)
            out.append((x[4], x[2], made[s][-1][0], top[-1][0], digest(*[h for b, a in way for h in b + a]), root))
    return out
