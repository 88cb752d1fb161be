"""Word vectors of the quality classifier come from all documents."""

import numpy as np

from packetloom.llm import quality


def test_vectors_learn_from_documents_without_label(spark):
    texts = ["good plain words about houses", "bad words bad words", "ships sail the northern sea"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    total = np.zeros((quality.CELLS, quality.DIMS), np.int64)
    for text in texts:
        quality.add_contexts(total, quality.cells_of(text), quality.index_vectors())
    assert np.allclose(model.vectors, quality.word_vectors(total))
