import pytest

from changeloom.llm import substring_dedup as S

PASSAGE = "The quick brown fox jumps over the lazy dog tonight. Every good boy deserves fudge and a second helping too."


def test_units():
    text = "One two three.  Four five!\n\nSix seven"
    assert [(text[a:b], n, k) for a, b, n, k in S.units_of(text, "sentence", 1)] == [("One two three.", 3, "one two three"), ("Four five!", 2, "four five"), ("Six seven", 2, "six seven")]
    assert [text[a:b] for a, b, _, _ in S.units_of(text, "line", 1)] == ["One two three.  Four five!", "Six seven"]
    assert [text[a:b] for a, b, _, _ in S.units_of(text, "paragraph", 3)] == ["One two three.  Four five!"]


def brute(rows, min_words):
    units = sorted(((i is None, i or 0, a, b, k, i) for i, t in rows for a, b, _, k in S.units_of(t or "", "sentence", min_words)))
    first, gone = {}, []
    for none, _, a, b, k, i in units:
        if k in first:
            gone.append((i, a, b, *first[k]))
        else:
            first[k] = (i, a)
    return sorted(gone, key=repr)


def test_against_brute_force(small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    out = S.find_repeats(small, unit="sentence", min_words=8).collect()
    assert sorted(((r.doc_id, r.start, r.end, r.first_doc_id, r.first_start) for r in out), key=repr) == brute(rows, 8)
    assert len(out) > 50


def test_passage_inside_lines_and_odd_rows(make_docs):
    rows = [(3, f"Alpha beta. {PASSAGE} Gamma."), (1, f"start of it\n{PASSAGE.upper()}"), (None, PASSAGE), (2, "clean words that nobody else has written here today"), (4, None), (5, ""), (6, "word " * 100_000)]
    docs = make_docs(rows, ("start", "digest", "_spans"))
    out = S.find_repeats(docs, unit="sentence", min_words=8).collect()
    assert {r.doc_id for r in out} == {3, None} and all(r.first_doc_id == 1 for r in out) and len(out) == 4
    assert all(rows[0][1][r.start : r.end] in PASSAGE for r in out if r.doc_id == 3)
    stripped = S.strip_repeats(docs)
    assert stripped.columns == docs.columns and stripped.count() == len(rows)
    texts = {r.doc_id: r for r in stripped.collect()}
    assert texts[3].text.split() == ["Alpha", "beta.", "Gamma."] and texts[3].n_chars == len(texts[3].text)
    assert texts[1].text == rows[1][1] and texts[2].text == rows[3][1] and texts[4].text is None and texts[3]._spans == "x"


def test_repeated_rows_keep_one(make_docs):
    out = S.find_repeats(make_docs([(1, PASSAGE), (1, PASSAGE), (1, PASSAGE)])).collect()
    assert len(out) == 2 and all(r.first_doc_id == 1 for r in out)
    assert S.find_repeats(make_docs([])).count() == 0


def brute_runs(rows, min_words):
    """Marks (row, sentence) that any repeated run of whole sentences covers, by all runs of all lengths."""
    atoms = [S.units_of(t or "", "sentence", 1) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    first, gone = {}, set()
    places = [(r, a) for r in order for a in range(len(atoms[r]))]
    for r, a in places:
        words, key = 0, ()
        for b in range(a, len(atoms[r])):
            words, key = words + atoms[r][b][2], (*key, atoms[r][b][3])
            if words < min_words:
                continue
            if key not in first:
                first[key] = (r, b)
            else:
                gone |= {(r, k) for k in range(a, b + 1) if first[key][0] != r or k > first[key][1]}
    return atoms, gone


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_passages_of_short_sentences_against_brute_force(make_docs, unit):
    import random

    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("ab cd efg hi jk lmn".split()) for _ in range(n)) + rng.choice([". ", "!! ", "? ", "\n"])
    shared = ["".join(say(rng.choice([1, 2, 3, 5, 9])) for _ in range(6)) for _ in range(5)]
    rows = [(i, "".join(rng.choice([rng.choice(shared), say(rng.randrange(1, 12))]) for _ in range(5))) for i in range(40)] + [(None, shared[0]), (50, "Ha. " * 40), (51, None)]
    atoms, gone = brute_runs(rows, 8)
    covered = set()
    at = {i: r for r, (i, _) in enumerate(rows)}
    for f in S.find_repeats(make_docs(rows), unit=unit, min_words=8).collect():
        r = at[f.doc_id]
        covered |= {(r, k) for k, (start, end, _, _) in enumerate(atoms[r]) if f.start <= start and end <= f.end}
    assert covered == gone and len(gone) > 50
    assert {k for r, k in gone if rows[r][0] == 50} == set(range(8, 40))


def test_repeated_line_of_short_sentences_goes(make_docs):
    line = "One two. Three four!! Five six? Seven eight. Nine."
    rows = [(1, f"Head of the first\n{line}\nits tail"), (2, f"Another head\n{line}\nanother tail")]
    texts = {r.doc_id: r.text for r in S.strip_repeats(make_docs(rows), min_words=8).collect()}
    assert texts[1] == rows[0][1] and texts[2].split() == ["Another", "head", "another", "tail"]


def test_strip_keeps_the_passage_of_repeated_rows_once(make_docs):
    own = "Words that only this row has got and that nobody repeats."
    rows = [(1, PASSAGE), (1, PASSAGE), (1, PASSAGE), (2, f"{PASSAGE} {own}"), (2, f"{PASSAGE} {own}"), (3, "no stop"), (3, "no stop")]
    for unit in ("sentence", "line", "paragraph"):
        texts = sorted((r.doc_id, " ".join(r.text.split())) for r in S.strip_repeats(make_docs(rows), unit=unit, min_words=8).collect())
        assert texts == [(1, ""), (1, ""), (1, PASSAGE), (2, ""), (2, own), (3, "no stop"), (3, "no stop")]


def test_repeated_lines_are_units_whole(spark):
    """Every line of 8 words or more that stands in an earlier document, or earlier in its own, is a unit of its own."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, want = {}, set()
    for doc_id, text in sorted((r.doc_id, r.text) for r in docs.collect()):
        for start, end, n, plain in S.units_of(text or "", "line", 8):
            want |= {(doc_id, start, end, n)} if plain in first else set()
            first.setdefault(plain, doc_id)
    found = {(r.doc_id, r.start, r.end, r.n_words) for r in S.find_repeats(docs).collect()}
    assert len([x for x in want if x[3] < 16]) > 400 and want <= found


def test_long_text_of_repeated_lines_is_cut_in_linear_time():
    import time

    text = "".join(f"line {i} of many\n" for i in range(200_000))
    spans = [{"start": k, "end": k + 9} for k in range(0, len(text), 18)]
    start = time.process_time()
    assert len(S.without(text, spans)) == len(text) - sum(min(len(text), x["end"]) - x["start"] for x in spans)
    assert time.process_time() - start < 5
