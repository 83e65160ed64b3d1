import random

from pyspark.sql import functions as F

from bibspark.functions.fuzzy import best_matches, token_set_ratio
from bibspark.operators import crossref as C
from bibspark.plans import reference_queries as Q
from bibspark.tables import read

WORDS = "alpha bet gam of the in de é ᄒ zeta-long-word aa ab ba".split()


def brute(query, parts):
    score = [sum(token_set_ratio(x, query) for x in p) for p in zip(*parts)]
    at = max(range(len(score)), key=lambda i: (score[i], -i))
    return at, score[at]


def test_bounds_lose_nothing():
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(r.randint(0, n)))
    for _ in range(20):
        parts = [[text(3) or None for _ in range(80)], [text(r.choice((5, 12, 40))) for _ in range(80)]]
        queries = [text(20) for _ in range(15)]
        assert list(best_matches(queries, parts)) == [brute(q, parts) for q in queries]


def test_rank_without_equal_author_and_year(spark, monkeypatch):
    monkeypatch.setattr(C, "MESSAGES", 2)
    queries = spark.createDataFrame([(1, "Smyth, J. A study of kelp"), (2, "A study of kelp"), (3, "")], "rec_id long, text string")
    messages = spark.createDataFrame([(9, "Smith", "A study of kelp", None), (5, "Smith", "A study of kelp", None), (7, "", "Harbour logs", None), (6, "Doe", None, None), (8, "Roe", "Of tides", None)], "message_id long, author string, title string, abstract string")
    got = {r["rec_id"]: r["message_id"] for r in C.ranked(queries, messages, "rec_id").collect()}
    assert got == {1: 5, 2: 5, 3: 5}


def test_rank_is_that_of_all_pairs(spark, sf):
    m = C.records(read(spark, sf, "crossref_message")).select("message_id", F.array_join(Q.B.family_names(Q.B.field("author")), " "), F.col("field_map")["title"]).orderBy("message_id").collect()
    q = read(spark, sf, "bib_entry").where("rec_id % 50 = 0").select("rec_id", F.concat_ws(" ", Q.B.field("author"), Q.B.field("title"))).collect()
    want = {r[0]: brute(r[1], [[x[1] for x in m], [x[2] for x in m]]) for r in q}
    got = {r["rec_id"]: (r["message_id"], r["score"]) for r in Q.crossref_rank(spark, sf).collect()}
    assert len(want) > 0 and got == {k: (m[i][0], s) for k, (i, s) in want.items()}
