"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import regex
import xxhash


def words(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, width):
    own = words(text)
    if not own:
        return set()
    if len(own) < width:
        return {tuple(own)}
    return {tuple(own[i:i + width]) for i in range(len(own) - width + 1)}


def groups(nodes, linked):
    """Smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs, width, percent=80):
    """Rows (doc, size, group) of documents (doc, text) by comparing all pairs."""
    sets = {d: shingles(t, width) for d, t in docs}
    ids = sorted(sets)
    linked = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = groups(ids, linked)
    return sorted((d, len(sets[d]), found[d]) for d in ids)


def spark_hash(text):
    return xxhash.xxh64_intdigest(text.encode(), seed=42)


def norm(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def simhash(form):
    words = form.split(" ")
    value = 0
    for q, (at, width) in enumerate(((0, 16), (16, 16), (32, 16), (48, 15))):
        own = [(spark_hash(w), len(w)) for i, w in enumerate(words) if i * 4 // len(words) == q]
        total = sum(n for _, n in own)
        value |= sum(1 << k for k in range(at, at + width) if 2 * sum((h >> k & 1) * n for h, n in own) > total)
    return value


def blocks(value):
    return [value >> at & (1 << width) - 1 for at, width in ((0, 16), (16, 16), (32, 16), (48, 15))]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def dedup_lines(docs, min_words=5, bits=20, percent=90, met=True):
    """(doc, text left) of documents (doc, text); by edit similarity alone unless lines have to have ``met``."""
    placed = []
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            if norm(line):
                # NULL keys come first.
                placed.append(((d is not None, d if d is not None else 0), signed(spark_hash(t)), i, norm(line)))
    forms = sorted({p[3] for p in placed})
    hashes = {f: simhash(f) for f in forms}
    linked = []
    for i, a in enumerate(forms):
        for b in forms[i + 1:]:
            if min(len(a.split(" ")), len(b.split(" "))) < min_words:
                continue
            if met and (hashes[a] ^ hashes[b]).bit_count() > bits:
                continue
            if met and sum(x == y for x, y in zip(blocks(hashes[a]), blocks(hashes[b]))) < 2:
                continue
            longer = max(len(a), len(b))
            if abs(len(a) - len(b)) > longer * (100 - percent) // 100:
                continue  # as many edits at least
            if edit_distance(a, b) <= longer * (100 - percent) // 100:
                linked.append((a, b))
    group = groups(forms, linked)
    first = {}
    for p in placed:
        g = group[p[3]]
        first[g] = min(first.get(g, p[:3]), p[:3])
    out = []
    for d, t in docs:
        if t is None:
            out.append((d, None))
            continue
        key = (d is not None, d if d is not None else 0)
        kept = [
            line for i, line in enumerate(t.split("\n"))
            if not norm(line) or first[group[norm(line)]] == (key, signed(spark_hash(t)), i)
        ]
        out.append((d, "\n".join(kept)))
    return out


MARK = "\x01"


def template(text):
    """(template words, words as written) of a text, by scanning it word by word."""
    from eventrate.llm.templates import NUMBER_WORDS, UNITS

    tokens = list(regex.finditer(r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+", text.replace(MARK, " ")))
    kinds, raw = [], []
    for m in tokens:
        word, before = m.group(), m.string[:m.start()]
        apart = not regex.search(r"[\p{L}\p{M}\p{N}]$", before)
        apart_after = not regex.match(r"[\p{L}\p{M}\p{N}]", m.string[m.end():])
        kind = word.lower()
        if regex.match(r"\p{N}", word) or apart and apart_after and word.lower() in NUMBER_WORDS:
            kind = "number"
        elif regex.match(r"\p{Lu}\p{Ll}", word) and regex.search(r"[\p{L}\p{N},;]\s$", before):
            kind = "name"
        elif word.lower() in UNITS and kinds and kinds[-1] == "number" and regex.search(r"[\p{N}\p{L}]\s?$", before) and apart_after:
            kind = "unit" if regex.sub(r"\s$", "", before).endswith(raw[-1]) or before.lower().rstrip().endswith(raw[-1]) else kind
        kinds.append(kind)
        raw.append(word.lower())
    return kinds, raw


def contaminated(docs, items, window=8, literals=5, percent=40):
    """{(doc, item): (percent, verbatim)} by sliding every item window over every document."""
    slots = {"number", "unit", "name"}
    out = {}
    read = [(doc, *template(text or "")) for doc, text in docs]
    placed = {}

    def places(width):
        if width not in placed:
            placed[width] = []
            for doc, kinds, raw in read:
                at = {}
                for p in range(len(kinds) - width + 1):
                    at.setdefault(tuple(kinds[p:p + width]), []).append(p)
                placed[width].append((doc, at, raw))
        return placed[width]

    for item, asked in items:
        kinds, raw = template(asked or "")
        if len(kinds) < literals:
            continue
        width = min(window, len(kinds))
        starts = [q for q in range(len(kinds) - width + 1) if sum(k not in slots for k in kinds[q:q + width]) >= literals]
        for doc, at, dr in places(width):
            runs = {}
            for q in starts:
                for p in at.get(tuple(kinds[q:q + width]), ()):
                    runs.setdefault(p - q, []).append(q)
            covered, equal = set(), True
            for shift, found in runs.items():
                pairs = {
                    (kinds[i], raw[i], dr[i + shift]) for q in found for i in range(q, q + width) if kinds[i] in slots
                }
                if len({x[:2] for x in pairs}) == len(pairs) == len({(x[0], x[2]) for x in pairs}):
                    covered |= set(found)
                    equal &= all(a == b for _, a, b in pairs)
            if covered and 100 * len(covered) / len(starts) >= percent:
                out[(doc, item)] = (100 * len(covered) / len(starts), equal)
    return out
