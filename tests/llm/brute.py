"""Plain versions of the operators, straight from their definitions, for small inputs."""

import collections
import hashlib
import math
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeats(rows, least=100):
    """rows: (order, text); equal orders are one document. order -> (bytes, removed, spans, digest)."""
    first, out = {}, {}
    for o, text in rows:
        b = text.encode()
        for k in range(len(b) - least + 1):
            w = b[k : k + least]
            first[w] = min(first.get(w, (o, k)), (o, k))
    for o, text in rows:
        b = text.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < (o, k):
                gone[k : k + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[o] = (len(b), sum(gone), spans, sha(kept))
    return out


def contaminated(text, items, size=10):
    w, hit, found = CLEAN_WORDS.findall(low(text or "")), set(), set()
    for i, t in items:
        own = CLEAN_WORDS.findall(low(t or ""))
        for k in range(max(1, len(own) - size + 1)) if own and i is not None else ():
            win = own[k : k + size]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(str(i))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def shingle_set(text):
    w = WORDS.findall(low(text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(sets):
    """key -> set; key -> least key reachable by links."""
    keys, root = list(sets), {k: k for k in sets}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {k: find(k) for k in keys}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def joined(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'user', 'weak', 'endpoint')[k]}:{a}:{b}" for a, k, b in spans)


USER = re.compile(r"""\b(user(?:name)?|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", re.I | re.A)
WEAK = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}")
ENDPOINT = re.compile(r"(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!&*+,;=%-]+")


def all_spans(text, scope=200):
    """Base spans, and the weak parts clear of them whose complements start within scope."""
    text, base = text or "", base_spans(text)
    weak = [(m.start(), 3, m.end()) for m in USER.finditer(text) if len(m[2]) >= 2]
    weak += [(m.start(), 4, m.end()) for m in WEAK.finditer(text)]
    weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text) if len(m[0]) >= 8]
    free = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    role = {0: "secret", 1: "identifier", 2: "secret", 3: "identifier", 4: "secret", 5: "endpoint"}
    needs = {3: {"secret"}, 4: {"identifier"}, 5: {"identifier", "secret"}}
    found = [w for w in free if needs[w[1]] <= {role[k] for s, k, _ in base + free if abs(s - w[0]) <= scope}]
    return sorted(base + found)


def redacted(text, mark="<SECRET>"):
    out, at = "", 0
    for a, _, b in all_spans(text):
        out, at = (out + text[at:a] + mark, b) if a >= at and (a > at or not at) else (out, max(at, b))
    return out + text[at:]


def metrics(text):
    text = text or ""
    w = WORDS.findall(text)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def n_lines(text):
    return sum(1 for x in (text or "").split("\n") if WORDS.search(x))


def base_fails(m):
    return m[0] < 20 or 100 * m[4] > 30 * m[0]


def tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def kept(rows, good, ladder, risk=0.02, delta=0.05, pooled=False):
    """rows: (id, stratum, text); good: ids labelled good. The ids that the base rules and the certified steps keep.

    pooled: strata with labels, but too few, take the rule of all of them together."""
    measured = [(i, s, metrics(t), n_lines(t)) for i, s, t in rows]

    def fails(m, lines, step):
        return 100 * m[2] > step[0] * m[0] or 100 * m[3] > step[1] * lines or 10 * m[1] > step[2] * m[0]

    held = collections.defaultdict(list)
    for i, s, m, lines in measured:
        if i in good and not base_fails(m):
            held[s].append((m, lines))
    fewest = math.ceil(math.log(delta / max(1, len(held))) / math.log(1 - risk))
    thin = {s for s, own in held.items() if len(own) < fewest}
    pool = [x for s in thin for x in held[s]] if pooled else []
    groups = {s: own for s, own in held.items() if len(own) >= fewest}
    tested, rule = len(groups) + bool(pool), {}
    for s, own in [*groups.items(), (None, pool)]:
        rule[s] = None
        for step in ladder if own else ():
            k = sum(fails(m, lines, step) for m, lines in own)
            if not (k < risk * len(own) and tail(len(own), k, risk) <= delta / tested):
                break
            rule[s] = step
    out = set()
    for i, s, m, lines in measured:
        step = rule[s] if s in groups else rule[None] if pooled and s in thin else None
        if not base_fails(m) and not (step and fails(m, lines, step)):
            out.add(i)
    return out
