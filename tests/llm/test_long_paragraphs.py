from bibspark.llm import scan_repair as R

LETTERS = "abcdefghijklmnopqrstuvwxyz"
LINE = "the quick harbour keeps a number of older records for survey"


def pages(n, tables=()):
    """Pages without any paragraph start; every line is marked by its page and place."""
    name = lambda no, j: f"{LETTERS[no // 26]}{LETTERS[no % 26]}{'uvwxyz'[j]}mark"
    rows = []
    for no in range(1, n + 1):
        body = ["12.5    14.8    19.1    22.7", "13.5    15.8    20.1    23.7"] if no in tables else [f"{name(no, j)} {LINE}" for j in range(6)]
        rows.append((no, 1, no, "\n".join(body)))
    return rows, [name(no, j) for no in range(1, n + 1) if no not in tables for j in range(6)]


def put_out(spark, rows):
    d = spark.createDataFrame(rows, "page_id long, file_id long, page_no int, txt string")
    return [(r["page_id"], r["par_no"], r["text"]) for r in R.repaired_paragraphs(d).collect()]


def test_no_line_is_lost(spark):
    rows, marks = pages(70)
    got = put_out(spark, rows)
    text = " ".join(t for _, _, t in got)
    assert [text.count(m) for m in marks] == [1] * len(marks)
    assert len({(p, n) for p, n, _ in got}) == len(got)


def test_past_a_page_of_tables(spark):
    rows, marks = pages(6, tables=(3,))
    text = {(p, n): t for p, n, t in put_out(spark, rows)}
    assert all(sum(t.count(m) for t in text.values()) == 1 for m in marks)
    assert "aeumark" in text[1, 1]
