import random
import unicodedata

from relayscope.llm import lookalikes

WANT = {
    "ｏｆﬁce＠ｔ．test": "office@t.test",
    "pa​y­roll⁠": "payroll",
    "рaуrоll": "payroll",
    "Ѕörеn Ϲôtеbrսn": "Sören Côtebrun",
    "A B　C D": "A B C D",
    "no‑reply‐x": "no-reply-x",
    "Café Müller": "Café Müller",
    "q̣̇ q̣̇": "q̣̇ q̣̇",
    "Иго‍рь": "Игорь",
    "Игopь Лecняк": "Игорь Лесняк",
    "Νiκος": "Νικος",
    "𝐏𝐚𝐲𝐫𝐨𝐥𝐥": "Payroll",
    "ɡoοgle": "google",
}
PLAIN = ["Ольга Сторожева", "Νίκος Θαλασσινός", "Işıldak, Ağa", "Größe – “x” ’ 5 € n° №", "Łucja Peñaranda-Ruíl", "日本 한국", "ü"]


def forms(spark, values):
    df = spark.createDataFrame([(str(i), v, "clash") for i, v in enumerate(values)], "id string, v string, plain string")
    return {int(r["id"]): (r["plain"], r["mixed"]) for r in lookalikes.plain_forms(df.select("id", "v"), ["id"], "v").collect()}


def test_ordinary_spelling(spark):
    got = forms(spark, list(WANT))
    assert [got[i][0] for i in range(len(WANT))] == list(WANT.values())


def test_plain_values_stay(spark):
    got = forms(spark, PLAIN)
    assert [got[i][0] for i in range(len(PLAIN))] == PLAIN


def test_agrees_with_nfc_where_only_marks_differ(spark):
    values = [unicodedata.normalize("NFD", w) for w in ("crème brûlée", "ạ̈ ǘ", "Ελένη", "йод", "ệ")]
    got = forms(spark, values)
    assert [got[i][0] for i in range(len(values))] == [unicodedata.normalize("NFC", v) for v in values]


def test_random_marks_agree_with_nfc(spark):
    rng = random.Random(3)
    marks = [chr(o) for o in range(0x300, 0x370) if unicodedata.combining(chr(o)) and o not in (0x340, 0x341, 0x343, 0x344)]
    usual = "\u0300\u0301\u0302\u0306\u0308\u0309\u031b\u0323\u0327\u0328\u0331\u0304"
    letters = "aeiouyAEOUSsczqLdhη\u03b9ωАий"
    values = ["".join(rng.choice(letters) + "".join(rng.choices(usual if rng.random() < 0.7 else marks, k=rng.randrange(0, 6))) for _ in range(4)) + "aé" for _ in range(300)]
    values = [v for v in values if not set(v) & set("ηιωАий")] + ["e\u0323\u0302\u0301é", "a\u0327\u0301é", "\u1112\u1161\u11ab\u1100\u1173\u11af", "가\u11a8", "\u09c7\u09be\u09c7\u0981\u09be", "\u0cc6\u0cc2\u0cd5", "α\u0313\u0301\u0345"]
    got = forms(spark, values)
    assert [got[i][0] for i in range(len(values))] == [unicodedata.normalize("NFC", v) for v in values]


def test_letters_without_case_have_a_script(spark):
    got = forms(spark, ["Anna שלום", "שלום", "山田タロウ 김", "ꓑay", "nº 5ª"])
    assert [got[i][1] for i in range(5)] == [True, False, False, False, False]
    assert got[3][0] == "Pay"


def test_nulls_ascii_long_and_mixed(spark):
    got = forms(spark, [None, "", "ascii only", "е" * 3000 + "x", "Игорь Smith"])
    assert set(got) == {3, 4}
    assert got[3] == ("e" * 3000 + "x", False) and got[4] == ("Игорь Smith", True)


def test_empty_table(spark):
    assert forms(spark, []) == {}


def test_keys_may_be_called_anything(spark):
    df = spark.createDataFrame([("a", 1, "ｘ", True)], "text string, pos int, p string, garbled boolean")
    assert [tuple(r) for r in lookalikes.plain_forms(df, ["text", "pos"], "p").collect()] == [("a", 1, "x", False)]
