import random
import re

from tercet.llm.decontamination import WuManber, contaminated, decontaminate


def words_of(text):
    return [w for w in re.sub(r"[\x00-/:-`{-\x7f]+", " ", (text or "").lower()).split(" ") if w]


def brute(docs, items, n=8):
    pats = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - n + 1) if w and i is not None else 0):
            pats.setdefault(" ".join(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        text, found = f" {' '.join(words_of(t))} ", {}
        for p, own in pats.items():
            if f" {p} " in text:
                for i in own:
                    found[i] = found.get(i, 0) + 1
        out += [(d, i, k) for i, k in found.items()]
    return sorted(out, key=repr)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_search_finds_every_occurrence():
    import numpy as np

    r = random.Random(4)
    for _ in range(60):
        text = "".join(r.choice("ab ") for _ in range(r.randint(0, 300)))
        patterns = {"".join(r.choice("ab ") for _ in range(r.randint(2, 14))).encode() for _ in range(r.randint(1, 12))}
        w = WuManber(list(patterns))
        got = sorted(w.search(np.frombuffer(text.encode(), np.uint8)))
        assert got == sorted((p, k) for k, x in enumerate(w.patterns) for p in range(len(text)) if text.encode().startswith(x, p))


def test_against_brute_force(spark, make, prose):
    texts, items = prose(120, 3), list(enumerate(prose(15, 9, 3, 30)))
    for i in range(0, 120, 5):
        words = items[i % 15][1].split()
        texts[i] += ", " + " ".join(words[:9]).upper() + "! " + texts[i][:30]
    got = sorted((tuple(r) for r in contaminated(make(texts), bench(spark, items)).collect()), key=repr)
    assert got == brute(list(enumerate(texts)), items) and len(got) >= 20
    parts = sorted((tuple(r) for r in contaminated(make(texts), bench(spark, items), most_bytes=200).collect()), key=repr)
    assert parts == got


def test_odd_rows(spark, odd):
    items = [(1, "same words in both rows today"), (None, "other words in this row today"), (2, None), (3, " ,. "), (4, "same words in both rows today"), (5, "a null id with some words here")]
    got = sorted(((r[0], r[1]) for r in contaminated(odd, bench(spark, items)).collect()), key=repr)
    assert got == sorted([(5, 1), (5, 4), (5, 1), (5, 4), (None, 5)], key=repr)
    left = decontaminate(odd, bench(spark, items))
    assert left.columns == odd.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 4, 5, 6]


def test_spaces_beyond_ascii(spark, make):
    """French punctuation follows a no-break space, in the item as in its copy."""
    item = "où est\u00a0: la gare\u202f? je ne sais pas\u00a0! merci beaucoup et bonne journée"
    texts = ["avant " + item + " après", item.replace("\u00a0", " ")]
    got = sorted(tuple(r) for r in contaminated(make(texts), bench(spark, [(1, item)]), n=5).collect())
    assert got == brute(list(enumerate(texts)), [(1, item)], 5) and got[0][:2] == (0, 1)
    assert [r["doc_id"] for r in decontaminate(make([*texts[:1], "autre"]), bench(spark, [(1, item)]), most_bytes=1).collect()] == [1]


def test_empty(spark, make, prose):
    assert contaminated(make([]), bench(spark, [(1, "a b")])).count() == 0
    assert contaminated(make(prose(3)), bench(spark, [])).count() == 0
    assert decontaminate(make(prose(3)), bench(spark, [])).count() == 3
