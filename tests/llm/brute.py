"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, row long, key string, source string, n_chars long"


def corpus(seed=1, n=120):
    """Random texts with exact and near copies, shared passages, very short, empty and null ones; extra columns have names that operators use."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["ta", "re", "mi", "Ko", "é", "ß", "lu"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = text(60), "The common line of many."
    out = []
    for _ in range(n):
        kind = rng.random()
        old = rng.choice(out) if out else text(9)
        if kind < 0.12:
            new = old
        elif kind < 0.35 and old:
            words = old.split(" ")
            for _ in range(rng.randint(1, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            new = " ".join(words)
        elif kind < 0.45:
            new = text(rng.randint(5, 60)) + "\n" + passage + "\t" + text(rng.randint(0, 60))
        elif kind < 0.5:
            new = rng.choice([None, "", " ", "a", "one two", "\n\n"])
        else:
            new = (line + "\n" if rng.random() < 0.4 else "") + text(rng.choice([3, 20, 80, 200, 700]))
        out.append(new)
    return [(i * 7 % 1009, t, i, "k", f"src{i % 3}" if i % 10 else None, 0) for i, t in enumerate(out)]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n=4):
    w = tokens(text)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def components(sets, share):
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    items = [(i, s) for i, s in sets.items() if s]
    for k, (i, s) in enumerate(items):
        for j, r in items[:k]:
            both = len(s & r)
            if 100 * both >= share * (len(s) + len(r) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def removed(docs, width):
    """doc_id -> (bytes, removed, spans, digest of the rest)."""
    first, out = {}, {}
    texts = sorted((i, (t or "").encode()) for i, t in docs)
    for i, b in texts:
        for k in range(len(b) - width + 1):
            first.setdefault(b[k : k + width], i)
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    count, hit, seen, dup = collections.Counter(zip(w, w[1:], w[2:])), [0] * len(w), set(), 0
    for k in range(len(w) - 2):
        if count[w[k], w[k + 1], w[k + 2]] > 1:
            hit[k : k + 3] = [1] * 3
    for line in t.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(hit)


def contamination(docs, items, window=13):
    """doc_id -> (n_words, n_hit, item ids)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    sizes, out = {len(w) for w in windows}, {}
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (at := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= at
        out[i] = (len(w), len(hit), found)
    return out


def unigrams(docs, folds=10):
    """doc_id -> (n_tokens, n_known, N, base score)."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0
    texts = {i: [*tokens(t), 0] for i, t in docs}
    counts = collections.Counter(w for i, t in texts.items() if not held(i) for w in t)
    total, kinds = sum(counts.values()), len(counts)
    return {i: (len(t), sum(counts[w] > 0 for w in t), total, sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)) for i, t in texts.items()}


def line_features(text):
    """The features of each line, in the order of quality.FEATURES."""
    seen, out = set(), []
    for line in (text or "").split("\n"):
        w, raw = re.findall(r"[^\x20\x09-\x0D]+", line), line.encode()
        n, letters = max(len(w), 1), max(len(re.findall("[A-Za-z]", line)), 1)
        out.append([
            1.0, min(len(re.findall(r"[#*$%&|<>]", line)) / n, 1.0), min(line.count("|") / n * 2, 1.0), min(line.count("!") / n, 1.0), len(re.findall("[A-Z]", line)) / letters,
            float(raw[-1:] in (b".", b"!", b"?")), min(len(re.findall("[0-9]", line)) / max(len(line), 1) * 4, 1.0), min(len(line) / n / 20, 1.0),
            stutter(text, len(out), w) / n, float(line in seen and bool(w)), float(len(w) < 4), float(not w),
        ])
        seen.add(line)
    return out


def stutter(text, number, w):
    """Words of a line that equal the word before, be it in a line before."""
    before = [x for line in text.split("\n")[:number] for x in re.findall(r"[^\x20\x09-\x0D]+", line)][-1:] if text else []
    return sum(x == y for x, y in zip([*before, *w], w if before else w[1:]))


def viterbi(scores, moves):
    """The best labels of a chain whose label 1 scores as given; of equal paths the one that ends in 0, and comes from 0."""
    best, back = [0.0, scores[0]], []
    for s in scores[1:]:
        come = [max((best[i] + moves[i][j], -i) for i in (0, 1)) for j in (0, 1)]
        back.append([-c[1] for c in come])
        best = [come[0][0], come[1][0] + s]
    state = int(best[1] > best[0])
    out = [state]
    for step in reversed(back):
        state = step[state]
        out.append(state)
    return out[::-1]
