from tercet.llm.line_dedup import dedup_lines


def brute(rows, min_words=1, drop_emptied=False):
    places = sorted({((d is not None, d or 0), i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if len(x.split()) >= min_words})
    first = {}
    for d, i, x in places:
        first.setdefault(x, (d, i))
    out = []
    for d, t in rows:
        if t is not None:
            lines = t.split("\n")
            kept = [x for i, x in enumerate(lines) if len(x.split()) < min_words or first[x] == ((d is not None, d or 0), i)]
            if drop_emptied and len(kept) < len(lines) and not "".join(kept).strip():
                continue
            t = "\n".join(kept)
        out.append((d, t))
    return out


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_against_brute_force(spark, make, prose):
    lines = [x for t in prose(60, 1) for x in (t[:60], t[60:])]
    texts = ["\n".join(lines[(i * j) % len(lines)] for j in range(1, 9)) for i in range(80)]
    rows = list(enumerate(texts))
    rows[7] = (7, rows[7][1] + "\n\nEr.\n \t\nEr.\nhttps://an.address")
    rows[8] = (8, rows[8][1] + "\n \t\nEr.\nhttps://an.address\n")
    for drop, least in ((False, 1), (True, 1), (False, 4)):
        got = [tuple(r) for r in dedup_lines(make([(*r, "en", "s") for r in rows]), drop_emptied=drop, min_words=least).select("doc_id", "text").collect()]
        assert key(got) == key(brute(rows, drop_emptied=drop, min_words=least))


def test_full_filters_change_nothing(make, prose, monkeypatch):
    import tercet.llm.line_dedup as m

    monkeypatch.setattr(m, "SEGMENT_BITS", 64)
    texts = [t[:50] + "\n" + "a line that all the documents share" for t in prose(60, 2)]
    got = [tuple(r) for r in dedup_lines(make(texts), most_bits=64).select("doc_id", "text").collect()]
    assert key(got) == key(brute(list(enumerate(texts))))


def test_odd_rows(odd):
    out = dedup_lines(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[1][0]["n_chars"] is None and by[2][0]["text"] == ""
    assert sorted(r["text"] for r in by[5]) == ["other words in this row today", "same words in both rows today", "same words in both rows today"]
    assert all(r["__gone"] == "own __gone" for r in rows)


def test_empty(make):
    assert dedup_lines(make([])).count() == 0
    assert dedup_lines(make([None, ""])).count() == 2


def test_null_id_comes_first(make):
    rows = [(None, "the same line of words", "en", "a"), (0, "the same line of words", "en", "a")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(make(rows)).collect()}
    assert got == {None: "the same line of words", 0: ""}


def test_without_a_broadcast(make, prose, monkeypatch):
    """The other way of every join, and a line of more occurrences than HEAVY."""
    from tercet.llm import common, line_dedup

    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(line_dedup, "HEAVY", 3)
    rows = [(i, "\n".join([f"a line of its own number {i}", "a line that all of them have", t, f"shared by every seventh {i % 7}"])) for i, t in enumerate(prose(60, 2))]
    got = sorted((r["doc_id"], r["text"]) for r in dedup_lines(make([(i, t, "en", "s") for i, t in rows])).collect())
    assert got == sorted(brute(rows))
