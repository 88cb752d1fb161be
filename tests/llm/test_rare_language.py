"""Languages that few documents declare."""

from packetloom.llm import language

ENGLISH = "the house stands in the garden of the old town and nobody knows who built it number "
FINNISH = "talo seisoo vanhan kaupungin puutarhassa eikä kukaan tiedä kuka sen rakensi ja milloin "
JUNK = "xqzw kvjx qqxz wvkj zzxq jqvw xkzq vvjq zxwk qjxz kqvz wxjq zvkx qwzj xxvq jkzw "


def test_a_language_below_a_thousandth_is_learnt(spark):
    rows = [(i, ENGLISH + "abcdefghij"[i % 10] * 3, "en", "http://a.example.com/x") for i in range(4000)]
    rows += [(4000 + i, FINNISH, "fi", "http://b.example.fi/x") for i in range(3)]
    rows += [(4003, JUNK, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in language.identified(docs, language.train(docs)).collect()}
    assert all(found[i].language == "fi" and found[i].kept for i in range(4000, 4003))
    assert all(found[i].language == "en" and found[i].kept for i in range(4000))
    assert found[4003].language == "und" and not found[4003].kept


def test_more_than_two_hundred_languages(spark):
    syllables = ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "zu", "cha"]
    rows = []
    for i in range(240):
        a, b = syllables[i % 16], syllables[i // 16]
        words = [f"{a}{b}{x}{a}{a}{b}{b}{x}" for x in (a, b, "l", "r")]
        rows += [(2 * i + k, " ".join(words * 4), f"l{i}", None) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.train(docs)
    assert len(model.text.languages) == 240
    found = language.identified(docs, model).where("kept AND language = lang").count()
    assert found >= 0.95 * len(rows)
