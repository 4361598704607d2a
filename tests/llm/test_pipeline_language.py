"""The pipeline's language stage where little or nothing can be learned."""

import pytest

import corpus_pipeline
from evidquarry.llm import language_id

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("lang", [None, language_id.UNKNOWN])
def test_nothing_to_learn_keeps_texts_with_letters(spark, lang):
    rows = [(1, "some words", lang, "s", 10), (2, "12 34", lang, "s", 5), (3, None, lang, "s", None), (4, "Σίσυφος", lang, "s", 7), (None, "no id", lang, "s", 5)]
    got = corpus_pipeline._language_id(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert {(r.doc_id, r.text, r.lang) for r in got} == {(r[0], r[1], lang) for r in rows if r[0] in (1, 4, None)}


def test_the_held_out_fifth_is_learned_from(spark):
    ids = [r.id for r in spark.range(200).where(language_id.held_out("id")).collect()]
    words = {"en": "the house of the old man and the sea", "es": "la casa del hombre viejo y el mar"}
    rows = [(i, words["en" if n % 2 else "es"], "en" if n % 2 else "es", "s", 1) for n, i in enumerate(ids)] + [(1000, words["es"], None, "s", 1)]
    got = {r.doc_id: r.lang for r in corpus_pipeline._language_id(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == {r[0]: r[2] or "es" for r in rows}
