"""Documents in several languages stay in the pipeline."""

from pyspark.sql import functions as F

import corpus_pipeline
from assayline.llm import language, queries

FOLDER = "/root/testdata/sf0.01"


def test_no_language_with_half_of_the_words(spark):
    docs = queries.table(spark, FOLDER, "documents")
    texts = {x.lang: x.text for x in docs.where("length(text) between 200 and 2000").orderBy("doc_id").collect()}
    mixed = "\n".join(" ".join(t.split()[:25]) for _, t in sorted(texts.items()))
    more = [(10**6, mixed), (10**6 + 1, "12 - 34"), (10**6 + 2, None)]
    frame = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in more], docs.schema))
    kept = {x.doc_id for x in corpus_pipeline.identify_language(spark, frame, FOLDER).select("doc_id").collect()}
    assert kept == {x.doc_id for x in frame.where(F.col("text").rlike(language.LETTER)).collect()} and 10**6 in kept
    model = language.learn(docs.where(~queries.held_out()).select("text", "lang"))
    judged = language.predict(frame, model).select("doc_id", "lang", "_lang_pred", "_score").collect()
    low = [x for x in judged if x._lang_pred != language.UNKNOWN and x._score < 0.5]
    print("LOW", len(low), "of", len(judged), "UND", sum(x._lang_pred == language.UNKNOWN for x in judged))
    assert 10**6 in {x.doc_id for x in low}
