"""Languages in other scripts than the Latin one are learnt from their labelled rows."""

import random

from reportloom.llm import language

WORDS = {"en": "the and of house river green walk with this that", "ru": "это дом река зелёный идти вместе который был она время", "el": "το σπίτι και ποτάμι πράσινο μαζί αυτό που ήταν χρόνος", "zh": "我们 房子 河流 绿色 一起 这个 时间 他们 没有 可以"}


def test_labelled_languages_of_any_script_are_kept(spark):
    random.seed(3)
    rows = [(k, " ".join(random.choices(WORDS[lang].split(), k=40)), lang, "s") for k, lang in enumerate(list(WORDS) * 50)]
    junk = [(900, "שלום עולם בית נהר ירוק " * 8, "en", "s"), (901, "家はとても大きい" * 8, "ru", "s")]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")
    model = language.train(df)
    for _, text, lang, _ in rows:
        found = model.likelihoods(text)
        assert model.languages[found.index(max(found))] == lang
    found = model.likelihoods(junk[0][1])
    assert model.languages[found.index(max(found))] == language.UNKNOWN
    kept = {r.doc_id for r in language.keep(df).collect()}
    assert kept >= {r[0] for r in rows} and 900 not in kept
