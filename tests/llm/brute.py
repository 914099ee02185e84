"""Plain versions of the operators."""

import hashlib
import math
import re
from collections import Counter, defaultdict


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def blank_words(text, low=False):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text) if low else text or "")


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def contaminated(docs, items):
    windows = defaultdict(set)
    for name, text in items:
        w = letter_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(name))
    out = {}
    for key, text in docs:
        w, hit, found = letter_words(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                names = windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None
                if names:
                    hit |= set(range(i, i + n))
                    found |= names
        out[key] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def near_groups(docs):
    sets = {}
    for key, text in docs:
        w = blank_words(text, low=True)
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def repeated_words(docs, window=20):
    first, out = {}, {}
    for key, text in docs:
        w, gone = blank_words(text), set()
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), (key, i)) != (key, i):
                gone |= set(range(i, i + window))
        out[key] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def repeated_bytes(docs, span=50):
    first, out = {}, {}
    for key, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - span + 1):
            if first.setdefault(data[i : i + span], key) != key:
                gone[i : i + span] = b"\1" * span
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[key] = (len(data), sum(gone), runs, sha(bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def base_scores(docs, trained):
    counts = Counter()
    tokens = {k: [*blank_words(t, low=True), None] for k, t in docs}
    for k, t in tokens.items():
        if trained(k):
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    return {
        k: (len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t))
        for k, t in tokens.items()
    }


def merkle(rows):
    """(doc_id, source, lang, n_chars, text) rows -> per row (doc_id, leaf, subroot, root, proof, folded, verified), sorted."""
    import zlib

    def h(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(values):
        return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)

    def tree(nodes):
        """The root, and for each node the (left, right) lists of its own and its ancestors' siblings."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for way, i in zip(ways, at, strict=True):
                way.append((nodes[i // 8 * 8 : i], nodes[i + 1 : i // 8 * 8 + 8]))
            nodes, at = [h(nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
        return nodes[0], ways

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row, leaf(row)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for members in groups.values():
        members.sort(key=lambda m: (m[0][0] is not None, m[0][0] or 0, m[1]))
    trees = {lang: tree([d for _, d in groups[lang]]) for lang in langs}
    root, tops = tree([trees[lang][0] for lang in langs]) if langs else (None, [])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for (row, digest), way in zip(groups[lang], trees[lang][1], strict=True):
            way = way + top
            now = digest
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = row[4] if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                now = leaf((*row[:4], text))
            for left, right in way:
                now = h([*left, now, *right])
            proof = h(d for left, right in way for d in left + right)
            out.append((row[0], digest, trees[lang][0], root, proof, now, now == root))
    return sorted(out, key=repr)


def alignment(texts, path_a, path_b):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(path_a)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=path_b)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}

    def a_bytes(i):
        piece = a_model.id_to_token(i)
        return bytes(letters[c] for c in piece)

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    made = []
    for text in texts:
        groups = []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            in_a, in_b = list(map(a_bytes, a)), list(map(b_bytes, b))
            if b"".join(in_a) == b"".join(in_b) == (" " + text).encode():
                groups, left, right, i, j = [], [], [], 0, 0
                at_a = at_b = 0
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        left.append(a[i])
                        at_a, i = at_a + len(in_a[i]), i + 1
                    else:
                        right.append(b[j])
                        at_b, j = at_b + len(in_b[j]), j + 1
                    if at_a == at_b:
                        groups.append((left, right))
                        left, right = [], []
        made.append(groups)
    links = [Counter((x, y) for left, right in groups for x in left for y in right) for groups in made]
    held = Counter(pair for of in links for pair in of)
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for groups, of in zip(made, links, strict=True):
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(n for pair, n in of.items() if held[pair] == top[pair[0]])
        total = sum(n * held[pair] for pair, n in of.items())
        sizes = [sum(len(g[k]) for g in groups) for k in (0, 1)]
        out.append((*sizes, len(groups), sum(of.values()), best, total, spelled))
    return out
