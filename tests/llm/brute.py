"""Plain loops that the operators are held against."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(text, items):
    words = TERM.findall(lower(text))
    hit, found = set(), set()
    for item, other in items:
        terms = TERM.findall(lower(other))
        k = min(13, len(terms))
        windows = {tuple(terms[i : i + k]) for i in range(len(terms) - k + 1)} if k else set()
        for i in range(len(words) - k + 1) if k else ():
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


def fingerprint(text):
    words = SPACE_WORD.findall(lower(text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(rows):
    """(doc_id, fingerprint, smallest doc_id reached over links of at most two bits) of (doc_id, fingerprint)."""
    values = np.array([p for _, p in rows], np.uint64)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values[:k] ^ values[k]) <= 2).tolist():
            parent[root(k)] = root(j)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return [(i, f"{p:016x}", min(least[root(k)], default=None)) for k, (i, p) in enumerate(rows)]


def near_duplicates(rows):
    return linked([(i, fingerprint(t)) for i, t in rows])


def components(prints):
    """Smallest id reached, of {id: fingerprint}."""
    return {i: least for i, _, least in linked(list(prints.items()))}


def counts(text):
    words = SPACE_WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, hit = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def check_packing(rows, capacity):
    """Pieces fill their sequences without gaps; gives the number of sequences."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def vector_codes(rows):
    """vec_id, code, error, label_error, digest of (vec_id, vector, label), with whole numbers only."""
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for length in {len(v) for _, v, _ in kept}:
        mine, w = [r for r in kept if len(r[1]) == length], length // 16
        best = {}
        for i, v, _ in mine:
            best[i] = min(best.get(i, v), v)
        first = [best[i] for i in sorted(best, key=lambda i: (i is None, i or 0))[:64]]
        books = [[v[p * w : p * w + w] for v in first] for p in range(16)]

        def code(v, p, books=books, w=w):
            part = v[p * w : p * w + w]
            far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in books[p]]
            return far.index(min(far)), min(far), part

        for _ in range(2):
            new = []
            for p in range(16):
                near = collections.defaultdict(list)
                for _, v, _ in mine:
                    entry, _, part = code(v, p)
                    near[entry].append(part)
                new.append([[sum(c) // len(near[e]) for c in zip(*near[e], strict=True)] if near[e] else old for e, old in enumerate(books[p])])
            books[:] = new
        digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, v, label in mine:
            found = [code(v, p) for p in range(16)]
            out.append((i, "".join(f"{f[0]:02x}" for f in found), sum(f[1] for f in found), label, digest))
    errors = collections.Counter()
    for r in out:
        errors[r[3]] += r[2]
    return [(*r[:3], errors[r[3]], r[4]) for r in out]


def _draw(digits, *parts):
    return int(hashlib.md5(":".join(str(p) for p in parts if p is not None).encode()).hexdigest()[:digits], 16)


def mix(rows, group):
    """doc_id, size, source_size, target, taken of (doc_id, text, source): pivotal rounding, one pair after another."""
    rows = [(i, len(SPACE_WORD.findall(t or "")), s) for i, t, s in rows]
    sizes = collections.Counter()
    for _, n, s in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, share = {}, 1.5 * sum(sizes.values())
    while len(target) < len(order):
        unit = (share - sum(target.values())) / sum(weight[s] for s in order if s not in target)
        full = {s: 2.0 * sizes[s] for s in order if s not in target and 2 * sizes[s] <= unit * weight[s]}
        target |= full or {s: unit * weight[s] for s in order if s not in target}
    many = collections.Counter(rows)
    per_source = collections.Counter(s for _, _, s in many)
    copies = {}
    for source in order:
        buckets, waiting, n_groups = collections.defaultdict(list), [], -(-per_source[source] // group)
        for (i, size, s), n in many.items():
            if s != source:
                continue
            wanted = n * (target[s] / sizes[s]) if sizes[s] else 0.0
            whole = math.floor(wanted)
            mass = (wanted - whole) * size
            if not 0 < mass < size:
                copies[i, size, s] = whole
                continue
            b = _draw(13, 42, i, size) % (n_groups + (n_groups > 1))
            (waiting if n_groups > 1 and b == n_groups else buckets[b]).append([i, size, whole, mass])
        levels = 1
        most = -(-max(per_source.values()) // group)
        while most > 1:
            levels, most = levels + 1, -(-most // group)
        for level in range(levels):
            if level == levels - 1:
                buckets[0] += waiting
            left = collections.defaultdict(list)
            for b, items in buckets.items():
                if not items:
                    continue
                drawn = {id(x): _draw(13, f"42:{level}", x[0], x[1]) / 16**13 for x in items}
                items.sort(key=lambda x, d=drawn: (-x[1], d[id(x)]))
                a = items[0]
                for x in items[1:]:
                    to_a, to_x = min(a[1] - a[3], x[3]), min(a[3], x[1] - x[3])
                    if drawn[id(x)] * (to_a + to_x) < to_x:
                        up = a[1] - a[3] <= x[3]
                        gone, stay, up, mass = (a, x, 1, x[3] - to_a) if up else (x, a, 0, a[3] + to_a)
                    else:
                        down = a[3] <= x[1] - x[3]
                        gone, stay, up, mass = (a, x, 0, x[3] + to_x) if down else (x, a, 1, a[3] - to_x)
                    copies[gone[0], gone[1], source] = gone[2] + up
                    stay[3] = mass
                    a = stay
                left[b // group].append(a)
            buckets = left
        for items in buckets.values():
            for x in items:
                copies[x[0], x[1], source] = x[2] + (2 * x[3] >= x[1])
    out = []
    for (i, size, s), n in many.items():
        base, over = divmod(copies[i, size, s], n)
        out += [(i, size, sizes[s], round(target[s], 6), (base + (k < over)) * size) for k in range(n)]
    return out


def filter_audit(docs, labels):
    """All orders run one by one over (doc_id, text, source), labels (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = SPACE_WORD.findall(text)
        bad = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        bad += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        bad += "E" * (i is not None and smallest[text] < i)
        fails.append((source or "", bad, i in good, i in toxic))
    out, removed_by = [], collections.Counter()
    for part in {f[0] for f in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for step, x in enumerate(order, 1):
                hit = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                all_hit = [f for f in fails if f[0] == part and x in f[1]]
                removed_by[part, x] += len(hit)
                out.append((part, "".join(order), step, len(left), len(hit), len(all_hit) - len(hit), sum(f[1] == x for f in all_hit), sum(f[2] for f in hit), sum(f[3] for f in hit)))
    return [(*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out]


def tree_score(trees, row):
    total = trees.base
    for node in trees.roots.tolist():
        while trees.left[node] != node:
            node = int(trees.left[node] if row[trees.feature[node]] < trees.border[node] else trees.right[node])
        total += trees.value[node]
    return 1 / (1 + math.exp(-total))


def additive_score(model, row):
    total = model.base
    for f, table in enumerate(model.tables):
        total += table[sum(cut <= row[f] for cut in model.borders[f])]
    for (f, g), table in zip(model.pairs, model.pair_tables, strict=True):
        total += table[sum(cut <= row[f] for cut in model.coarse[f])][sum(cut <= row[g] for cut in model.coarse[g])]
    return 1 / (1 + math.exp(-total))


def nearest(model, text):
    """Best cosine by language, one trigram after another."""
    raw = [c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in f" {text or ''} ".encode()]
    found = collections.Counter()
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        if (a, b, c) != (32, 32, 32):
            found[(a | b << 8 | c << 16) * 2654435761 % 2**32 >> 20] += 1
    weights = {k: math.log1p(n) * float(model.idf[k]) for k, n in found.items()}
    length = math.sqrt(sum(w * w for w in weights.values())) or 1.0
    best = {}
    for centre, of in zip(model.centroids, model.of.tolist(), strict=True):
        lang = model.languages[of]
        best[lang] = max(best.get(lang, 0.0), sum(w * float(centre[k]) for k, w in weights.items()) / length)
    return best


def markov_spans(text, table, run, margin):
    out = []
    for m in re.finditer(run, text or ""):
        steps = [table[ord(a) * 128 + ord(b)] for a, b in zip(m[0], m[0][1:], strict=False)]
        if sum(steps) / len(steps) > margin:
            out.append((m.start(), m.end()))
    return out
