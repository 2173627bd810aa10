"""The stages before mixing, row by row."""

import re

from tercet.llm.toxicity import fit
from tests.llm.test_jaccard import grams
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_toxicity import brute_score


def words_of(text):
    return [w for w in re.sub(r"[^0-9a-z\u0080-\U0010ffff]+", " ", (text or "").lower()).split(" ") if w]


def run(rows, toxic, items):
    labelled = sorted(((d, t, lang) for d, t, lang, _ in rows if d is not None and t is not None and d < len(toxic)), key=lambda r: (hash((r[0], 7)), r[1]))
    model = fit([(t, lang, toxic[d]) for d, t, lang in labelled])
    assert model.dictionaries
    docs = [(d, t, s) for d, t, lang, s in rows if brute_score(model, t, lang) < model.thresholds[lang if lang in model.dictionaries else None]]
    # Lines: each row has its place; rows are alike in number and order in what comes back, less those emptied.
    source = {}
    for d, _, s in docs:
        source[d] = s
    docs = [(d, t, source[d]) for d, t in lines([(d, t) for d, t, _ in docs], drop_emptied=True)]
    parent = {d: d for d, _, _ in docs if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(d, grams(t)) for d, t, _ in docs if d is not None and grams(t)]
    for i, (a, g) in enumerate(own):
        for b, h in own[i + 1 :]:
            if a != b and len(g & h) >= 0.6 * len(g | h):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    docs = [(d, t, s) for d, t, s in docs if d is None or find(d) == d]
    windows = {tuple(w[i : i + 8]) for w in map(words_of, items) for i in range(max(1, len(w) - 7)) if w}
    sizes = {len(w) for w in windows}

    def bad(text):
        w = words_of(text)
        return any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1))

    return [(d, t, s) for d, t, s in docs if not bad(t)]
