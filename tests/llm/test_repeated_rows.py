"""Near duplicates are decided per row."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COPIED = "the house stands in the garden of the old town and nobody knows who built it"
OWN = "another text that nothing else resembles speaks about ships and the weather at sea"
THIRD = "a third and rather different passage tells of bread and the people who bake it early"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_a_repeated_row_stays_once(spark):
    rows = [(3, COPIED), (3, COPIED), (5, OWN), (5, OWN), (5, OWN), (8, ""), (8, ""), (9, "")]
    assert kept(spark, rows) == [(3, COPIED), (5, OWN), (8, ""), (9, "")]


def test_another_text_of_a_copy_s_id_stays(spark):
    assert kept(spark, [(7, COPIED), (3, COPIED), (7, OWN), (7, THIRD)]) == sorted(
        [(3, COPIED), (7, OWN), (7, THIRD)], key=repr
    )


def test_rows_without_id(spark):
    assert kept(spark, [(None, COPIED), (4, COPIED), (None, OWN), (None, None), (None, None)]) == sorted(
        [(4, COPIED), (None, OWN), (None, None), (None, None)], key=repr
    )
