"""Rows that share a doc_id, or have none, are told apart by their texts."""

from parcelry.llm.common import KEY, keyed
from parcelry.llm.tokengroups import deduplicated


def test_texts_of_equal_32_bit_hash(spark):
    """These pairs have the same F.hash; they are different documents all the same."""
    texts = [" ".join(f"{c}{i}" for c in "abcdefghij") for i in (76563, 255385, 43610, 93107, 146032, 162914)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert docs.selectExpr("hash(text) AS h").distinct().count() == 3
    assert keyed(docs).select(*KEY).distinct().count() == 6
    assert sorted(r.text for r in deduplicated(docs).collect()) == sorted(texts)
