"""Encodings without a mark, told by what texts read like."""

import pytest

from loomwork.sources import encodings, files
from tests.conftest import SF

FRENCH = "Les élèves préfèrent étudier à la bibliothèque, près du théâtre. Où êtes-vous allés hier ? Ça dépend de la météo. " * 3
GERMAN = "Größere Städte hätten über Jahre höhere Gebühren für Bürger verlangt, sagte Müller. Äpfel, Öl und Übung. " * 3
SPANISH = "El niño pidió más información según la legislación española; mañana habrá una sesión aquí. ¿Quién vendrá? " * 3
RUSSIAN = "Вчера жители города обсудили новый план застройки. Мэр сказал, что решение будет принято весной. " * 3
JAPANESE = "昨日、市民は新しい計画について話し合いました。市長は春に決定すると言いました。" * 4
CHINESE = "昨天市民们讨论了新的建设计划。市长说春天会作出决定,大家都很高兴,学校和医院也会有变化。" * 4
TRADITIONAL = "昨天市民討論了新的建設計畫。市長說春天會作出決定,大家都很高興,學校和醫院也會有變化。" * 4
KOREAN = "어제 시민들은 새로운 계획에 대해 이야기했습니다. 시장은 봄에 결정하겠다고 말했습니다. " * 4


@pytest.fixture(scope="module")
def weights(spark):
    return encodings.learned(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize(
    ("text", "encoding"),
    [(t, e) for t in (FRENCH, GERMAN, SPANISH) for e in ("cp1252", "latin_1", "iso8859_15", "mac_roman")] + [(RUSSIAN, "cp1251"), (RUSSIAN, "koi8_r"), (JAPANESE, "shift_jis"), (JAPANESE, "euc_jp"), (CHINESE, "gb18030"), (TRADITIONAL, "big5"), (KOREAN, "euc_kr")],
)
def test_texts_without_a_mark(weights, text, encoding):
    assert files.decoded(text.encode(encoding), weights)[0] == text


def test_marks_utf8_and_fragments(weights):
    for text, encoding in (("Zoë Brontë — 1847", "utf-8"), ("Zoë Brontë", "utf-8-sig"), ("Zoë Brontë", "utf-16"), ("Zoë Brontë", "utf-32"), ("Zoë Brontë", "latin-1")):
        assert files.decoded(text.encode(encoding), weights)[0] == text
    assert files.decoded("Straße".encode("cp1252"), weights) == ("Straße", "cp1252")
    assert len(files.decoded(b"\xff\xfe\x00odd\x81\x82 bytes", weights)[0]) > 0 and files.decoded(b"", weights) == ("", "utf-8")


def test_accuracy_by_encoding(spark, weights):
    """Documents beyond ASCII, in each encoding that holds them: those of 128 bytes or more come back nearly all."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and not r.text.isascii()]
    for encoding in ("cp1252", "latin_1", "iso8859_15", "mac_roman"):
        own = []
        for t in texts:
            try:
                data = t.encode(encoding)
            except UnicodeEncodeError:
                continue
            if len(data) >= encodings.LEAST_BYTES:
                own.append(files.decoded(data, weights)[0] == t)
        assert len(own) > 50 and sum(own) / len(own) > 0.95, (encoding, sum(own), len(own))


@pytest.mark.parametrize("text", ["ENCHÖÜ!! NICHTÄ,!! KEITÜ EINÖ. ", "Üzu ößung Üzu. ", "raezí. LLÑ!! raezí. ", "ÇÉ!! OURÉ!! SONÈ, ÈÊ.\n"])
def test_letters_of_two_alphabets_in_a_word(weights, text):
    """Capitals and letters in odd places read no better as Cyrillic inside Latin words."""
    assert files.decoded((text * 12).encode("latin-1"), weights)[0] == text * 12


@pytest.mark.parametrize("word", ["Äau", "Äen", "Öie", "Éeautre", "Èelle", "Ñueco", "Íueie", "Çonch"])
def test_a_capital_with_a_mark_before_a_small_letter(weights, word):
    """Together they are one character of an Asian encoding, which doesn't stand alone in a Latin word: not even if it is all that the text has."""
    for text in (f"{word} " * 80, "then the others went away " * 20 + f"{word} " + "and came back " * 20):
        assert files.decoded(text.encode("latin-1"), weights)[0] == text


@pytest.mark.parametrize("word", ["Éè", "Ñí,", "ÉÇ!", "ÈÉÉ!", "Çê", "Üß", "SÍ!", "UÉÇÉÇ!", "ÉÉÉÉE"])
def test_letters_that_the_table_has(weights, word):
    """One word of marked letters in a text of ASCII ones: its letters are those of the table."""
    text = "then the others went away " * 20 + f"{word} " + "and came back " * 20
    assert files.decoded(text.encode("latin-1"), weights)[0] == text


@pytest.mark.parametrize("text", ["Ещё раз: объём, съезд, подъезд, ёж, щука. Я и он. У нас в саду. ", "Я и он. У нас в саду. Мы и вы. Он у них. "])
def test_short_words_of_another_alphabet(weights, text):
    assert files.decoded((text * 4).encode("cp1251"), weights)[0] == text * 4


def test_learned_from_little(spark):
    none = encodings.learned(spark.createDataFrame([("plain",), (None,)], "text string"))
    assert files.decoded(RUSSIAN.encode("cp1251"), none)[0] == RUSSIAN
