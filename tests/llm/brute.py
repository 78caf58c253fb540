"""Brute-force versions of the contracts, in plain Python."""

import collections
import hashlib
import html.parser
import re
import statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def quality_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


SECRETS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}


def base_secrets(text):
    spans, counts = [], []
    for order, (kind, (pattern, group, least)) in enumerate(SECRETS.items()):
        found = [(m.start(), order, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
        spans += found
        counts.append(len(found))
    return (*counts, sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))))


def line_dedup(rows, least=10):
    """rows: {document: text}."""
    key = lambda x: x.strip("\x20\t\n\x0b\x0c\r").translate(LOWER)
    seen = collections.Counter(k for t in rows.values() for k in {key(x) for x in (t or "").split("\n")})
    for doc, text in rows.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= least)]
        yield doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))


def fingerprint(text):
    import xxhash

    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in hashes) * 2 > len(hashes))


def near(prints):
    """{key: number} to {key: smallest key reachable over at most two bits}."""
    keys, parent = list(prints), {k: k for k in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def repeats(rows, length=100):
    """rows: {document: text}, documents in order."""
    seen = set()
    for doc in sorted(rows):
        raw = (rows[doc] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            piece = raw[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(piece)
        runs = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        yield doc, len(raw), sum(gone), runs, sha(bytes(c for c, g in zip(raw, gone) if not g))


def matroska_samples(data):
    """The samples of all simple blocks, read byte by byte from the format's description."""

    def length(at):
        size = 8 - data[at].bit_length()
        return size, int.from_bytes(data[at : at + size + 1], "big") - (1 << 7 * (size + 1))

    found, todo = b"", [(0, len(data))]
    while todo:
        at, end = todo.pop()
        if at >= end:
            continue
        wide = 9 - data[at].bit_length()
        name, at = data[at : at + wide].hex(), at + wide
        extra, size = length(at)
        at += extra + 1
        todo.append((at + size, end))
        if name in ("18538067", "1f43b675"):
            todo.append((at, at + size))
        if name == "a3":
            stop, kind, body = at + size, data[at + 3] >> 1 & 3, at + 4
            if kind:
                frames, body, sizes = data[body] + 1, body + 1, []
                if kind == 1:
                    for _ in range(frames - 1):
                        sizes.append(0)
                        while data[body] == 255:
                            sizes[-1], body = sizes[-1] + 255, body + 1
                        sizes[-1], body = sizes[-1] + data[body], body + 1
                elif kind == 3:
                    for k in range(frames - 1):
                        extra, step = length(body)
                        sizes.append(step if k == 0 else sizes[-1] + step - (1 << 7 * (extra + 1) - 1) + 1)
                        body += extra + 1
                else:
                    assert (stop - body) % frames == 0
                assert sum(sizes) <= stop - body
            found += data[body:stop]
    return found


class _Words(html.parser.HTMLParser):
    """(elements from the root, text, block) of well-formed pages; an element is (tag, number, left out)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.runs, self.block, self.made = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        from spanweave.llm import html_text as H

        self.block += tag in H.BLOCK
        self.made += 1
        out = H._is_out(tag, {k: v or "" for k, v in attrs}, any(t in ("article", "main") for t, _, _ in self.open))
        if tag not in H.VOID:
            self.open.append((tag, self.made, out))

    def handle_endtag(self, tag):
        from spanweave.llm import html_text as H

        self.block += tag in H.BLOCK
        if self.open and self.open[-1][0] == tag:
            self.open.pop()

    def handle_data(self, data):
        if not any(out for _, _, out in self.open):
            self.runs.append((list(self.open), data, self.block))


def main_text(page, share):
    """The container rules by whole lists of ancestors, on paths written out."""
    from spanweave.llm import html_text as H

    parser = _Words()
    parser.feed(page)
    parser.close()
    path = lambda run: "/".join(t for t, _, _ in run[0])
    said = [r for r in parser.runs if r[1].strip()]
    link = lambda run: any(t == "a" for t, _, _ in run[0])
    by_path = collections.defaultdict(list)
    for r in said:
        by_path[path(r)].append(r)
    size = lambda r: len(r[1].strip()) * (0.2 if link(r) else 1)
    length = {p: sum(map(size, rs)) / len(rs) for p, rs in by_path.items()}
    points = {p: (sum(len(re.findall(H._PUNCT, r[1])) for r in rs) + 0.1) / len(rs) for p, rs in by_path.items()}
    line = [path(r) for r in said]
    near = lambda v, i: (v[line[max(i - 1, 0)]] + 4 * v[line[i]] + v[line[min(i + 1, len(line) - 1)]]) / 6
    fused = {}
    for p in by_path:
        at = [i for i, x in enumerate(line) if x == p]
        fused[p] = (statistics.fmean(near(length, i) for i in at) * statistics.fmean(near(points, i) for i in at)) ** 0.5
    chosen = {p for p, f in fused.items() if f >= share * statistics.pstdev(fused.values())}
    strong = [r for r in said if path(r) in chosen]
    if not strong:
        return ""
    weigh = lambda rs: sum(fused[path(r)] for r in rs)
    within = lambda r, tag: any(t == tag for t, _, _ in r[0])
    marked = next((t for t in ("article", "main") if weigh([r for r in strong if within(r, t)]) >= 0.8 * weigh(strong)), None)
    if marked:
        kept = [r for r in parser.runs if within(r, marked)]
    else:
        common = strong[0][0]
        for r in strong:
            common = [e for e, f in zip(common, r[0]) if e == f]
        while common and common[-1][0] not in H.BLOCK - H.NOT_AROUND:
            common = common[:-1]
        depth = len(common)
        tight = bool(common) and common[-1][0] not in ("html", "body")
        blocks = [r[2] for r in strong]

        before = lambda r: depth and r[0] and r[0][-1][1] < common[-1][1]
        titles = []
        for r in parser.runs if depth else ():
            for k, (tag, number, _) in enumerate(r[0]):
                if tag in H.HEADINGS and k < depth and r[0][:k] == common[:k] and number < common[-1][1]:
                    titles.append(number)
        if not titles:
            titles = [r[0][-1][1] for r in said if before(r) and r[0][-1][0] == "h1" and r[0][: depth - 1] == common[:-1]][-1:]

        def heads(r):
            return any(number in titles for _, number, _ in r[0])

        def stays(block):
            rs = [r for r in said if r[2] == block and (r[0][:depth] == common or heads(r))]
            if not rs or any(path(r) in chosen or any(t in H.HEADINGS for t, _, _ in r[0]) for r in rs):
                return True
            if all(map(link, rs)):
                return False
            free = all(tight or not any(t in H.MODULES for t, _, _ in r[0][depth:]) for r in rs)
            return free or blocks[0] < block < blocks[-1]

        held = [r for r in parser.runs if r[0][:depth] == common or heads(r)]
        kept = [r for r in held if stays(r[2])]
    out = {}
    for r in kept:
        out[r[2]] = out.get(r[2], "") + r[1]
    return " ".join(x for x in (" ".join(t.split()) for t in out.values()) if x)


def vote(model, row):
    """One text's features against every labelled vector, sorted by nearness."""
    import math

    if not any(row):
        return 0.5
    own = [sum(float(x) for x in (row * model.idf) * model.basis[:, k]) for k in range(model.basis.shape[1])]
    norm = math.sqrt(sum(x * x for x in own))
    near = [round(sum(a * float(b) for a, b in zip(own, v)) / norm, 4) for v in model.vectors]
    last = sorted(near, reverse=True)[:15][-1]
    votes = [(max(x, 0) ** 4 * w, y) for x, w, y in zip(near, model.weights, model.labels) if x >= last]
    total = sum(v for v, _ in votes)
    return sum(v for v, y in votes if y) / total if total > 1e-12 else 0.5
