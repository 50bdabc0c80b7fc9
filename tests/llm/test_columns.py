"""Every operator that keeps the documents' columns, on documents that have columns of all names used inside."""

from loomwork.llm import decontamination, near, packing, pii, pseudo, quality, substrings, toxicity
from loomwork.llm.queries import tokenizer_path
from tests.llm import test_quality, test_toxicity
from tests.llm.helpers import awkward, sentences


def test_stages_keep_columns(spark):
    docs = awkward(spark, [*sentences(1, 12, 40), *sentences(1, 12, 40), "a jo@x.example.com b", "vile1 vile2 vile3 vile1 vile5 vile2"], clashing=True)
    bench = spark.createDataFrame([(1, sentences(1, 1, 40)[0])], "item_id long, text string")
    toxic_docs, toxic_labels, _ = test_toxicity.labelled(spark, 200)
    labels = docs.selectExpr("doc_id", "0 AS toxic", "1 AS quality").where("doc_id is not null").distinct()
    for kept in (toxicity.without_toxic(docs, labels), near.one_of_each(docs), decontamination.decontaminated(docs, bench), pii.without_personal_data(docs)):
        assert kept.schema.simpleString() == docs.schema.simpleString() and 0 < kept.count() <= docs.count()
    assert near.one_of_each(docs).count() == docs.count() - 12 - 2  # the copies, and of "one" what repeats: a row, and the text under a larger id
    model = quality.fit(docs, labels)
    for out in (toxicity.with_scores(docs, toxicity.fit(toxic_docs, toxic_labels), passages=True), quality.with_scores(docs, model, lines=True), decontamination.with_hits(docs, bench, block_bytes=10), pii.with_spans(docs, pii.fit(docs)), pseudo.with_scores(docs, pseudo.fit(docs, steps=5))):
        assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns) and out.count() == docs.count()
    for out in (quality.quality(docs, labels), substrings.substring_dedup(docs), near.jaccard_join(docs), packing.best_fit_packing(docs, tokenizer_path()).where("piece = 0"), pseudo.pseudo_likelihood(docs), pii.personal_data(docs)):
        assert out.count() == docs.count()


def test_no_length_column(spark):
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "to jo@x.example.com now"), (None, "x")], "key string, body string")
    got = pii.without_personal_data(docs, "key", "body").collect()
    assert sorted(map(str, (r.body for r in got))) == sorted(map(str, (None, "", "to [EMAIL] now", "x")))


def test_long_documents_teach_from_any_place(spark):
    docs, labels, _ = test_quality.labelled(spark, 60)
    bad = "\n".join(["A good line of plain words."] * 400 + ["BUY NOW!! $$$ CLICK!! HERE!!"] * 400)
    more = [(1000 + k, bad + f"\nWord {k}.") for k in range(30)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    labels = labels.unionByName(spark.createDataFrame([(i, 0) for i, _ in more], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    assert sum(got[i] < 0.5 for i, _ in more) >= 28
