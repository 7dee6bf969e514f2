"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
DECONTAMINATION_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str) -> frozenset:
    words = WORD.findall(lower(text))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def classes(rows: list[tuple[int, str | None]], least: float = 0.8) -> dict[int, int]:
    """doc_id to its class's smallest doc_id, by comparing all pairs."""
    parent = {i: i for i, _ in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, t, shingles(t or "")) for i, t in rows]
    for k, (i, t, a) in enumerate(sets):
        for j, u, b in sets[:k]:
            if t is not None and u is not None and (t == u or (a and b and len(a & b) >= least * len(a | b))):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def dedup_lines(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders: dict[str, set[int]] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def private(text: str | None) -> list[str]:
    def valid(kind: str, value: str) -> bool:
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def secrets(text: str | None) -> list[tuple[int, int]]:
    found = re.finditer(r"[A-Za-z0-9_-]{32,}", text or "")
    return [m.span() for m in found if len(re.sub("[^0-9]", "", m.group())) >= 6 and len(re.sub("[^A-Za-z]", "", m.group())) >= 4]


def disclosing(rows: list[tuple[int, str | None]], support: int = 5, least: float = 0.8, remove: float = 0.95) -> dict[int, list[str]]:
    """By doc_id: secret, removed and generalised spans, from document frequencies counted one by one."""
    word = re.compile(r"[^\W_]{2,}")
    texts, guarded, words, masked = dict(rows), {}, {}, {}
    for i, t in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in private(t))] + [("secret", a, b) for a, b in secrets(t)]
        guarded[i] = spans
        blank = list(t or "")
        for _, a, b in spans:
            blank[a:b] = " " * (b - a)
        masked[i] = lower("".join(blank))
        words[i] = set(word.findall(masked[i]))
    values = {i: {f"{k}:{(texts[i] or '')[a:b].lower()}" for k, a, b in spans} for i, spans in guarded.items()}
    beside: dict[str, dict[int, set[str]]] = {}

    def near(i: int, a: int, b: int) -> set[str]:
        first, last = max(0, a - 1000), min(len(masked[i]), b + 1000)
        inner = masked[i][first:last]
        inner = re.sub(r"^[^\W_]+", "", inner) if first else inner
        return set(word.findall(re.sub(r"[^\W_]+$", "", inner) if last < len(masked[i]) else inner))

    holders: dict[str, set[int]] = {}
    for i, own in values.items():
        for v in own:
            holders.setdefault(v, set()).add(i)
    entities = {f"kind {k}": (k, {i for i, own in values.items() if any(v.startswith(k + ":") for v in own)}) for k in (*PATTERNS, "secret")}
    for v, docs in holders.items():
        if len({texts[i] for i in docs}) >= support:
            name = f"value {sorted(docs)}"
            entities[name] = (min(v.split(":")[0], entities.get(name, ("~",))[0]), docs)
            for i in docs:
                beside.setdefault(name, {}).setdefault(i, set()).update(*(near(i, a, b) for k, a, b in guarded[i] if f"{k}:{texts[i][a:b].lower()}" == v))
    df_t = Counter(w for t in texts.values() for w in set(word.findall(lower(t or ""))))
    shares: dict[int, dict[str, float]] = {i: {} for i in texts}
    for name, (kind, docs) in entities.items():
        if not docs or len(docs) == len(texts):
            continue
        for t in set().union(*(words[i] for i in docs)):
            holds = (lambda i: t in beside[name][i]) if name.startswith("value") else (lambda i: t in words[i])
            own = [i for i in docs if holds(i)]
            # which value stands for a document of several: a stated choice of the operator; tests give one of a kind
            seen = {texts[i] for i in own} if name.startswith("value") else {min(v for v in values[i] if v.startswith(kind + ":")) for i in own}
            share = math.log2(len(texts) * len(own) / (df_t[t] * len(docs))) / math.log2(len(texts) / len(docs))
            if len(seen) >= support and share >= least:
                for i in docs:
                    if t in words[i]:
                        shares[i][t] = max(share, shares[i].get(t, 0))
    out = {}
    for i in texts:
        found = [("removed" if shares[i][m.group()] >= remove else "generalised", *m.span()) for m in word.finditer(masked[i]) if m.group() in shares[i]]
        told = [f"secret:{a}:{b}" for a, b in secrets(texts[i])]
        out[i] = told + [f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[0] == "generalised", x[1]))]
    return out


def rotations(turns: list[tuple]) -> dict[tuple, tuple[str, list[tuple[int, int]]]]:
    """By (conv_id, perspective): the whole rendering and the spans of the perspective's own turns."""
    clean = []
    for conv, turn, role, text in turns:
        role = re.sub("[\x00-\x1f\x7f-\x9f\u2028\u2029]", " ", "unknown" if role is None else role).translate(str.maketrans("<|>", "(/)"))
        clean.append((conv, -1 if turn is None else turn, role, (text or "").replace("<|", "< |")))
    out = {}
    for conv, role in {(c, r) for c, _, r, _ in clean if r != "system"}:
        whole, masks = "", []
        for _, speaker, text in sorted(t[1:] for t in clean if t[0] == conv):
            whole += "<|system|>\n" if speaker == "system" else "<|assistant|>\n" if speaker == role else f"<|user name={speaker}|>\n"
            if speaker == role:
                masks.append((len(whole), len(whole) + len(text)))
            whole += text + "\n<|end|>\n"
        out[conv, role] = whole, masks
    return out


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words, seen, repeated = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        repeated += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), repeated, len(hit)


def contamination(text: str | None, items: list[tuple[int, str | None]]) -> tuple[int, int, list[str]]:
    words = DECONTAMINATION_WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for item, body in items:
        w = DECONTAMINATION_WORD.findall(lower(body or ""))
        size = min(13, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def proximity(rows: list[tuple[int | None, str | None]], items: list[tuple[int, str | None]], slop: int = 5) -> dict[int | None, tuple[int, list[str]]]:
    """By doc_id: places and items of windows whose two rarest terms stand within slop of their distance, in any order."""
    said = {i: DECONTAMINATION_WORD.findall(lower(t or "")) for i, t in rows}
    times = Counter(w for own in said.values() for w in own)
    pairs = set()
    for item, body in items:
        w = DECONTAMINATION_WORD.findall(lower(body or ""))
        size = min(13, len(w))
        for i in range(len(w) - size + 1) if w else ():
            window = w[i : i + size]
            if size > 1 and all(times[x] for x in window):
                a, b = sorted(range(size), key=lambda k: (times[window[k]], k))[:2]
                pairs.add((window[a], window[b], b - a, str(item)))
    out = {}
    for i, own in said.items():
        at = {}
        for p, w in enumerate(own):
            at.setdefault(w, []).append(p)
        found = {(min(p, q), item) for a, b, want, item in pairs for p in at.get(a, ()) for q in at.get(b, ()) if p != q and abs(q - p - want) <= slop}
        out[i] = len({p for p, _ in found}), sorted({item for _, item in found})
    return out


def kneser_ney(texts: list[tuple[str | None, str | None]]) -> list[float | None]:
    """Mean bits a 4-gram of each (text, lang) under its language's modified Kneser-Ney model, by the recursive formula."""

    def grams(text: str | None) -> list[tuple]:
        data = "".join("0" if c in "0123456789" else " " if c in "\t\n\x0b\x0c\r" else lower(c) for c in text or "").encode("utf-16-le")
        units = [data[i : i + 2] for i in range(0, len(data), 2)]
        return [tuple(units[i : i + 4]) for i in range(len(units) - 3)]

    out: list[float | None] = [None] * len(texts)
    for lang in {x for _, x in texts}:
        own = [i for i, (_, x) in enumerate(texts) if x == lang]
        counts = {4: Counter(g for i in own for g in grams(texts[i][0]))}
        for order in (3, 2, 1):
            counts[order] = Counter(g[1:] for g in counts[order + 1])
        discount, total, spare = {}, {}, {}
        for order, c in counts.items():
            n = [sum(v == k for v in c.values()) for k in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if all(n[1:]) else 0
            discount[order] = [0] + [min(k, max(0, k - (k + 1) * y * n[k + 1] / n[k])) if all(n[1:]) else k / 2 for k in (1, 2, 3)]
            for g, v in c.items():
                total[g[:-1], order] = total.get((g[:-1], order), 0) + v
                spare[g[:-1], order] = spare.get((g[:-1], order), 0) + discount[order][min(v, 3)]

        def p(g: tuple, counts=counts, discount=discount, total=total, spare=spare) -> float:
            order = len(g)
            if order == 0:
                return 1 / (len(counts[1]) + 1)
            if (g[:-1], order) not in total:
                return p(g[1:])
            v, t = counts[order].get(g, 0), total[g[:-1], order]
            return (v - discount[order][min(v, 3)]) / t + spare[g[:-1], order] / t * p(g[1:])

        for i in own:
            if found := grams(texts[i][0]):
                out[i] = -sum(math.log2(p(g)) for g in found) / len(found)
    return out
