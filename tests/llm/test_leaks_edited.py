import numpy as np

from bibspark.llm import leaked_passages as L

OWN = [f"own{i}" for i in range(40)]
TURN = "in exchange for many crates of salt and the men of the harbour went".split()


def found(items, doc):
    x = L.Items(list(enumerate(items)))
    return {i for _, k, _, _ in L.search_shard([np.array([x.vocab.get(w, 0) for w in doc], np.int64)], x) for i in x.ids[k]}


def test_edits_do_not_count_against_a_leak():
    # only the last phrase of the stretch is the item's own; the edit breaks four of the shared ones
    a, b = OWN[:8] + TURN[:12] + OWN[8:16], OWN[20:28] + TURN[:12] + OWN[28:36]
    doc = ["x"] * 20 + TURN[:4] + ["changed"] + TURN[5:12] + OWN[8:10] + ["y"] * 20
    assert found([a, b], doc) == {0}


def test_shared_turns_are_no_leak():
    a, b = OWN[:8] + TURN[:5] + ["red"] + TURN[6:12] + OWN[8:16], OWN[20:28] + TURN[:5] + ["blue"] + TURN[6:12] + OWN[28:36]
    assert found([a, b], ["x"] * 20 + TURN[:5] + ["green"] + TURN[6:12] + ["y"] * 20) == set()


def test_words_of_two_items_unchanged():
    a, b = OWN[:8] + TURN[:12] + OWN[8:16], OWN[20:28] + TURN[:12] + OWN[28:36]
    assert found([a, b], ["x"] * 20 + TURN[:12] + ["y"] * 20) == {0, 1}


def test_blocks_of_items_change_no_row(spark, monkeypatch):
    """The same stretches come out however the evaluation set is cut in blocks; other passages than the longest line may be taken."""
    turn = " ".join(TURN[:12])
    items = [(i, f"Read this.\n{turn} {' '.join(f'w{i}x{j}' for j in range(30))}\nWhy?") for i in range(12)]
    docs = [(100 + i, f"Before it {' '.join(f'w{i}x{j}' for j in range(3, 20))} and {turn} after.") for i in range(12)] + [(1, turn), (2, None), (3, "")]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **x: {tuple(r) for r in L.leaked_spans(d, "doc_id", "text", e, "item_id", "text", **x).collect()}
    one = rows()
    assert {(r[0], r[1]) for r in one if r[0] > 99} >= {(100 + i, i) for i in range(12)}
    monkeypatch.setattr(L, "ITEM_WORDS", 50)
    assert rows() == one
    assert rows(take=lambda t: (t or "").splitlines()[0]) == set()


def test_passages_of_several_lines(spark):
    """Every line between instruction and question counts, with stretches across line breaks; a long question does not."""
    lines = [" ".join(f"w{k}x{j}" for j in range(n)) for k, n in enumerate((20, 7, 30, 9))]
    ask = " ".join(f"q{j}" for j in range(60)) + "?"
    ends = "Read the long passage below with care, all of it, and then answer the question that follows."
    texts = ["\n".join(x) for x in (("Read this.", *lines, ask), (*lines, ask), (ends, "", *lines, ask, ""), (f"{lines[0]}.", f"{lines[2]}.", "Why?"))]
    assert [L.passage(t) for t in texts[:3]] == ["\n".join(lines)] * 3
    assert L.passage(texts[3]) == f"{lines[0]}.\n{lines[2]}."
    assert L.passage("Read this.\n" + lines[0]) == L.passage(lines[0]) == L.passage(lines[0] + "\n" + ask) == lines[0]
    docs = [(1, lines[0]), (2, f"{lines[0][-30:]} {lines[1]} {lines[2][:25]}"), (3, lines[2]), (4, ask), (5, ends)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(texts[:3])), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in L.leaked_spans(d, "doc_id", "text", e, "item_id", "text").collect()}
    assert got == {(i, k) for i in (1, 2, 3) for k in range(3)}
