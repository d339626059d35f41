"""Made-up documents, and plain versions of the operators' results that tests of this folder share."""

import hashlib
import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, score double, _hash string, kept int, component_id long, toxicity string"


def make_docs(seed=1, groups=8, size=6):
    """Documents with copies, near copies, shared passages, nulls, empty, white and very long texts, and clashing columns."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéXY") for _ in range(rng.randrange(2, 7)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 12, 90, 200]))]
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w[len(w) // 2 : len(w) // 2] = passage.split()
            texts.append(rng.choice([" ", "\n", "  \t"]).join(w))
    texts += [None, "", "   \n", "one", "One", "one two", passage, passage + " " + passage, "long " * 3000 + "tail", "long " * 3000 + "tail"]
    rng.shuffle(texts)
    rows = [(i * 3, t, rng.choice(["en", "de", None]), 0.5, "x", 1, 7, "y") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, "no id here", None, None, None, None, None, None)]


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups_spec(rows):
    """Component of each row by number, from all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def removal_spec(rows, window):
    words = [WORD.findall(r[1] or "") for r in rows]
    seen = {}
    for i, w in enumerate(words):
        for p in range(len(w) - window + 1):
            seen.setdefault(tuple(w[p : p + window]), []).append((i, p))
    out = []
    for i, w in enumerate(words):
        gone = {q for p in range(len(w) - window + 1) if len(seen[tuple(w[p : p + window])]) > 1 for q in range(p, p + window)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((rows[i][0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)
