import pytest

from relayscope.llm import mojibake
from relayscope.llm.mojibake import read_value

CLEAN = ["", None, "plain", "Kündigung zum 5. April", "PROMOÇÃO DE VERÃO", "¿Olvidó el pago?", "Счёт 36242 ожидает оплаты", "Νίκος Θαλασσινός", "Votre facture n° 5 – réf. 3", "Dvořanek, Ağa Işıldak", "A & B &amp; C", "Payroll ✅ 😀 ‼", "ОПЛАТА", "Pауrоll", "£240 credit"]
PAIRS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp437"), ("utf-8", "mac_roman")]
TEXTS = ["Réservation confirmée à télécharger", "Überweisung prüfen – dringend", "Contraseña nueva", "Jürgen Müllbrandt"]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_values_stay(text):
    assert not read_value(text).garbled


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize(("right", "wrong"), PAIRS)
def test_round_trip(text, right, wrong):
    raw = text.encode(right)
    try:
        bad = raw.decode(wrong)
    except UnicodeDecodeError:
        bad = "".join(bytes([b]).decode(wrong, "replace") if b not in (0x81, 0x83, 0x88, 0x8D, 0x8F, 0x90, 0x98, 0x9D) else chr(b) for b in raw)
    got = read_value(bad)
    assert got.garbled and got.restored == text and got.complete


def test_twice_and_in_part():
    twice = "nómina".encode().decode("cp1252").encode().decode("cp1252")
    assert read_value(twice).restored == "nómina"
    assert read_value("Rückgabe: Gebühr 20 â‚¬ fällig").restored == "Rückgabe: Gebühr 20 € fällig"
    assert read_value("K&Atilde;&frac14;ndigung").restored == "Kündigung"


@pytest.mark.parametrize("times", [1, 3, 5, 7])
def test_any_number_of_times(times):
    text = "nómina für José"
    bad = text
    for _ in range(times):
        bad = bad.encode().decode("latin-1")
    got = read_value(bad)
    assert got.garbled and got.restored == text and got.complete


def test_single_letters_between_blanks():
    text = "я и ты"
    assert read_value(text.encode("cp1251").decode("cp1252")).restored == text


def test_cyrillic():
    for right, wrong in (("koi8-r", "cp1251"), ("cp1251", "cp1252"), ("utf-8", "cp1251")):
        text = "Подтвердите заказ"
        assert read_value(text.encode(right).decode(wrong, "replace")).restored == text


def test_lost_letters():
    got = read_value("contrase�a")
    assert got.garbled and got.restored is None and not got.complete
    assert read_value("acciï¿½n").garbled and not read_value("acciï¿½n").complete


def test_frame(spark):
    rows = [("1", "x", "Ã©tÃ©", "clash"), ("2", None, "", "clash"), ("2", "\udcff".encode("utf-8", "replace").decode(), "Größe für " * 2000, "clash"), ("3", "GrÃ¶ÃŸe fÃ¼r " * 2000, "ok", "clash")]
    df = spark.createDataFrame(rows, "id string, a string, b string, value string")
    got = {(r["id"], r["field"]): r["restored"] for r in mojibake.detect(df, ["a", "b"], ["id"]).collect()}
    assert got == {("1", "b"): "été", ("3", "a"): "Größe für " * 2000}
    assert mojibake.detect(df.limit(0), ["a"], ["id"]).count() == 0
