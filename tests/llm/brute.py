"""Plain versions of the operators, one row at a time."""

import hashlib
import math
import re
import unicodedata
from collections import Counter

import xxhash

WS = r"[^\x20\x09-\x0D]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, k=3):
    words = re.findall(WS, lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs, radius=2):
    """[(doc_id, fingerprint, component_id)] by all pairs."""
    fps = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(docs)]


def contamination(docs, items, window=10):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for item, text in items:
        w = re.findall(word, lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for d, text in docs:
        w = re.findall(word, lower(text))
        hit, of = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    of |= windows[k]
        names = sorted(str(x) for x in of if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def secrets_base(text):
    text = text or ""
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def quality_base(text):
    text = text or ""
    words = re.findall(WS, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WS, line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeat = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeat), n < 10 or 100 * len(repeat) > 20 * n)


def warc(pages):
    rows = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        rows.append((page_id, len(raw), hashlib.sha1(raw).hexdigest()))
    best = {}
    for p, n, d in rows:
        if n >= 1000 and p is not None:
            best[d] = max(best.get(d, p), p)
    out, used = [], set()
    for p, n, d in rows:
        first = p == best.get(d) and (p, d) not in used
        used.add((p, d))
        revisit = n >= 1000 and d in best and not first
        out.append((p, n, d, "revisit" if revisit else "response", best[d] if revisit else None))
    return out


def char_class(c):
    kind = unicodedata.category(c)
    latin = ord(c) < 0x250 or 0x1E00 <= ord(c) <= 0x1EFF
    if c in "\r\n" or kind in ("Zl", "Zp"):
        return "end"
    if c == "\t" or kind == "Zs":
        return "blank"
    if kind in ("Ll", "Lu", "Lt"):
        return ("low" if kind == "Ll" else "up") if latin else "cased"
    return "letter" if kind in ("Lo", "Lm") else kind[0] if kind[0] in "MNPS" else "other"


def js(p, q):
    """Jensen-Shannon distance of two counters."""
    a, b = sum(p.values()), sum(q.values())
    if not a or not b:
        return float(bool(a) != bool(b))
    total = 0.0
    for k in set(p) | set(q):
        x, y = p[k] / a, q[k] / b
        total += sum(v * math.log2(2 * v / (x + y)) for v in (x, y) if v) / 2
    return math.sqrt(min(1.0, max(0.0, total)))


def quality(docs, least_words, common, spreads, least_excess, least_group):
    """[(doc_id, base..., kept, class distance, word distance)] of (doc_id, text, lang)."""
    rows, sums, words = [], {}, {}
    for d, text, lang in docs:
        base = quality_base(text)
        classes = Counter(map(char_class, text or ""))
        plain = Counter(w for w in (x.strip(".,;:!?'\"()-").lower() for x in re.findall(WS, text or "")) if w)
        held = not base[5] and base[0] >= least_words
        rows.append((d, lang, base, classes, plain, held))
        if held:
            sums[lang] = sums.get(lang, Counter()) + classes
            words[lang] = words.get(lang, Counter()) + plain
    words = {k: dict(sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:common]) for k, c in words.items()}
    far = [(js(c, sums[lang]), js(Counter({k: n for k, n in w.items() if k in words[lang]}), Counter(words[lang]))) if held else None for _, lang, _, c, w, held in rows]
    groups = {}
    for (_, lang, base, *_), f in zip(rows, far, strict=True):
        for key in ((lang, base[0].bit_length()), (base[0].bit_length(),), ()) if f else ():
            groups.setdefault(key, []).append(f)

    def cut(lang, n, i):
        for key in ((lang, n.bit_length()), (n.bit_length(),), ()):
            steps = sorted(int(f[i] * 1000 + 0.5) for f in groups[key])
            if len(steps) >= least_group or not key:
                q2, q3 = (steps[math.ceil(len(steps) * q) - 1] / 1000 for q in (0.5, 0.75))
                return q2 + max(spreads * (q3 - q2), least_excess)

    return [(d, *base, not base[5] and not (f and any(f[i] > cut(lang, base[0], i) for i in range(2))), f) for (d, lang, base, *_), f in zip(rows, far, strict=True)]
