import pytest

from bibspark.llm import queries

COLUMNS = {
    "p2_found": ["rec_id", "field_name"], "p3_found": ["group_no", "field_name", "rec_id"], "p4_found": ["first_rec_id", "rec_id"], "p5_found": ["page_id", "line_no", "noise_kind"],
    "p7_found": ["rec_id", "pos", "person_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "pii_kind", "pii_text"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    d = queries.QUERIES[name](spark, sf)
    assert name not in COLUMNS or d.columns == COLUMNS[name]
    rows = d.collect()
    assert rows and (name not in COLUMNS or name == "p8_ids" or len(set(map(tuple, rows))) == len(rows))
