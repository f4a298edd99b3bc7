import pytest

from matchengine.llm import near_copies, simhash

DOCS = "doc_id long, text string"
NULLS = [(None, "a lone text of no id at all"), (None, "another text which is not like it in any way"), (1, "one text under the id"), (1, "a second and quite different text, same id"), (2, "one text under the id"), (None, "one text under the id")]
KEPT = [(None, NULLS[1][1]), (None, NULLS[0][1]), (1, NULLS[3][1]), (1, NULLS[2][1])]


@pytest.mark.parametrize("operator", [simhash, near_copies])
def test_null_ids_and_an_id_with_two_texts(spark, operator):
    d = spark.createDataFrame(NULLS + NULLS[:1], DOCS)
    assert sorted(map(tuple, operator.deduplicated(d).collect()), key=repr) == sorted(KEPT, key=repr)


def test_links_through_null_ids(spark, monkeypatch):
    d = spark.createDataFrame([(7, 0), (None, 3), (5, 15), (None, -1)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words=3: docs)
    assert {r.fp: r.component_id for r in simhash.groups(d).collect()} == {0: 5, 3: 5, 15: 5, -1: None}
