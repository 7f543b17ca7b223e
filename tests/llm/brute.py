"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def digest(spans, kinds):
    s = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))
    return hashlib.sha256(s.encode()).hexdigest()


def repeats(ws, n=8):
    at = collections.defaultdict(list)
    for i in range(len(ws) - n + 1):
        at[tuple(ws[i : i + n])].append(i)
    hit = set()
    for ps in at.values():
        if len(ps) > 1:
            for p in ps:
                hit.update(range(p, p + n))
    return len(hit)


def quality(text):
    ws = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    n, r = len(ws), repeats(ws)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, r, n < 20 or 100 * r > 30 * n


def substring(texts, n=35):
    at = collections.Counter()
    for t in texts:
        ws = words(t)
        for i in range(len(ws) - n + 1):
            at[tuple(ws[i : i + n])] += 1
    out = []
    for t in texts:
        ws = words(t)
        gone = set()
        for i in range(len(ws) - n + 1):
            if at[tuple(ws[i : i + n])] > 1:
                gone.update(range(i, i + n))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, n=5):
    ws = words(text)
    return frozenset(tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))) if ws else frozenset()


def near(texts, t=0.8):
    """Per text: the smallest index its links lead to, and its number of links."""
    sets = [shingles(x) for x in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], links


def base_score(rows):
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    counts = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words(lower(t)))
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    return n, {i: (len(ws := [*words(lower(t)), None]), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, t in rows}


ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(t):
    t = t or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def personal(t):
    t = t or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
