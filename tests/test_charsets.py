"""Charsets of undeclared bytes."""

import pytest
from pyspark.sql import functions as F

from presslake.functions import charsets, text
from presslake.sources import pages

# Not among the sentences the model comes from.
TEXTS = {
    "gb18030": "北京大学的学生昨天参加了图书馆的开放日活动，老师向他们讲解了古代书籍的保护方法。",
    "big5": "臺北大學的學生昨天參加了圖書館的開放日活動，老師向他們講解了古代書籍的保護方法。",
    "shift_jis": "東京の大学生が昨日、図書館のイベントに参加して、古い本の守り方を学びました。カメラとテレビの取材も来ました。",
    "euc-jp": "東京の大学生が昨日、図書館のイベントに参加して、古い本の守り方を学びました。カメラとテレビの取材も来ました。",
    "euc-kr": "서울의 대학생들이 어제 도서관 행사에 참여해 오래된 책을 보존하는 방법을 배웠습니다.",
    "windows-1251": "Студенты московского университета вчера посетили библиотеку и узнали, как хранят старые книги.",
    "koi8-r": "Студенты московского университета вчера посетили библиотеку и узнали, как хранят старые книги.",
    "windows-1253": "Οι φοιτητές του πανεπιστημίου επισκέφθηκαν χθες τη βιβλιοθήκη και έμαθαν πώς φυλάσσονται τα παλιά βιβλία.",
    "iso-8859-1": "Les étudiants ont visité hier la bibliothèque et appris à protéger les livres âgés. Schöne Bücher für später.",
    "windows-1252": "“L’été” – les élèves ont déjà visité la bibliothèque… für 5 €",
}


@pytest.mark.parametrize("name", sorted(TEXTS))
@pytest.mark.parametrize("wrap", ["{}", "<html><head><title>x</title></head><body><p class='a'>{}</p></body></html>" + " " * 200])
def test_guess(name, wrap):
    assert charsets.default_model().guess(wrap.format(TEXTS[name]).encode(name)) == name


@pytest.mark.parametrize("body", ["café", "Müller", "naïve", "señor", "£5", "Ångström", "São"])
def test_a_single_accent_is_western(body):
    assert charsets.default_model().guess(body.encode("latin-1")) == "iso-8859-1"


def test_pages_without_any_declaration(spark):
    page = "<html><body><p>{}</p></body></html>"
    rows = [(f"u{i}", 200, bytearray(page.format(t).encode(n)), None if i % 2 else "ISO-8859-1", None) for i, (n, t) in enumerate(TEXTS.items())]
    rows += [("utf", 200, bytearray(page.format("été 北京").encode()), None, None), ("ascii", 200, bytearray(b"<p>x</p>"), "ISO-8859-1", None)]
    rows += [("empty", 200, bytearray(b""), None, None), ("cut", 200, bytearray(page.format(TEXTS["gb18030"]).encode("gb18030")[:-24]), None, None)]
    rows += [("none", 200, None, None, None), ("meta", 200, bytearray("<meta charset=windows-1251>Да".encode("cp1251")), None, None)]
    df = spark.createDataFrame(rows, "url string, status int, body binary, charset string, error_kind string")
    got = {r.url: r.html for r in pages.page_outcomes(df).collect()}
    for i, t in enumerate(TEXTS.values()):
        assert got[f"u{i}"] == page.format(t)
    assert (got["utf"], got["ascii"], got["empty"], got["none"]) == (page.format("été 北京"), "<p>x</p>", "", None)
    assert got["cut"].startswith("<html><body><p>北京大学的学生") and got["meta"].endswith("Да")


def test_fitted_from_a_table(spark):
    rows = [(n, t) for n, t in charsets.SAMPLES] + [(None, "x"), ("big5", None), ("koi8-r", "x")]
    model = charsets.fit(spark.createDataFrame(rows, "charset string, text string").repartition(5))
    assert set(model.names) == {n for n, _ in charsets.SAMPLES}
    for name, t in TEXTS.items():
        assert model.guess(t.encode(name)) == name
    df = spark.createDataFrame([(bytearray(t.encode(n)), n) for n, t in TEXTS.items()] + [(bytearray(b"abc"), None), (None, None)], "b binary, n string")
    assert [r.n == r.g for r in df.select("n", charsets.guess_charset(F.col("b"), model).alias("g")).collect()] == [True] * len(TEXTS) + [True, True]


def test_cjk_declared_as_latin_is_not_trusted(spark):
    df = spark.createDataFrame([(bytearray(TEXTS["shift_jis"].encode("shift_jis")),)], "b binary")
    assert df.select(text.decode_body(F.col("b"), F.lit("iso-8859-1")).alias("t")).first().t == TEXTS["shift_jis"]
