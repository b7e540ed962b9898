"""Garbled text: every channel restored, look-alikes left alone."""

from quarrylight.llm import garbled

WORDS = "Přehled zařízení vyhodnocují pořadí Größere Schlüssel später réseau déploiement gérants configuração política região właściciel urządzenie sprawdzeń служба возвращается ошибку задан naïve café".split()
CLEAN = [" ".join(WORDS) + " — the console’s “tab” 35 °C 15 € §"] * 60
KEEP = ["SÃO PÃO MÃE", "Ærø – Åse", "Ðorð ¿no?", "½ × 4 ¼", "├── mail\n│   └── logs", "Ângulo ¹ ²", "&amp; &#233;", "كلمة المرور", "設定の確認が必要です", "👍 ✅ ok", "", None, "plain ascii", "Müller & Söhne É»"]


def garble(text, true, wrong, errors="strict"):
    out = bytearray()
    for b in text.encode(true):
        try:
            out += bytes([b]).decode(wrong).encode()
        except UnicodeDecodeError:
            out += chr(b).encode() if errors == "strict" else "�".encode()
    return out.decode()


def run(spark, bad):
    texts = CLEAN + KEEP + bad
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, token string")
    found = {r.doc_id for r in garbled.affected(df).collect()}
    fixed = {r.doc_id: r.restored for r in garbled.affected(df, restore=True).collect()}
    assert set(fixed) == found
    n = len(CLEAN) + len(KEEP)
    return {texts[i] for i in found if i < n}, [fixed.get(n + k) for k in range(len(bad))]


def test_channels(spark):
    cases = [("Größere Schlüssel später", "utf-8", "cp1252"), ("réseau déploiement", "utf-8", "mac_roman"), ("właściciel urządzenie", "utf-8", "cp1250"), ("the console’s “tab”", "utf-8", "cp1252"), ("später 35 °C", "utf-8", "cp437"), ("política região", "utf-8", "cp850"), ("служба возвращается", "utf-8", "cp1251"), ("zařízení pořadí", "cp1250", "cp1252"), ("configuração política", "cp1252", "cp850"), ("ошибку задан", "koi8_r", "cp1251"), ("15 €", "utf-8", "latin-1")]
    wrong, fixed = run(spark, [garble(*c) for c in cases])
    assert not wrong
    assert fixed == [c[0] for c in cases]


def test_twice_in_part_and_lost(spark):
    twice = garble(garble("réseau", "utf-8", "cp1252"), "utf-8", "cp1252")
    part = "später " + garble("später", "utf-8", "cp1252") + " und später"
    lost = "Gr��ere Schl�ssel"
    gone = "a � b"
    wild = garble("“tab”", "utf-8", "cp1252", "lost")
    wrong, fixed = run(spark, [twice, part, lost, gone, wild])
    assert not wrong
    assert fixed == ["réseau", "später später und später", "Größere Schlüssel", "a � b", "“tab”"]


def test_the_joined_way_gives_the_same(spark, monkeypatch):
    bad = [garble("später  \n Größere", "utf-8", "cp1252"), "x � y"]
    first = run(spark, bad)
    monkeypatch.setattr(garbled, "BROADCAST_ROWS", 0)
    assert run(spark, bad) == first


def test_nothing_and_long(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert garbled.affected(df).count() == 0
    one = spark.createDataFrame([(1, "é" * 60000), (2, "Ã©" * 20000)], "doc_id bigint, text string")
    assert {r.doc_id for r in garbled.affected(one).collect()} == {2}


def test_lost_bytes_under_a_decoder_without_gaps():
    signs = garbled.Signs({"😀": 40, "é": 100, "✓": 9, "€": 30})
    assert garbled.wide_reading("ð\ufffd\ufffd\ufffd", "latin-1", signs) == "😀"
    assert garbled.wide_reading("â\ufffd¬", "latin-1", signs) == "€"
    assert garbled.Signs({}).fitting(0xF0, (tuple(range(0x80, 0xC0)),) * 3)[0][0] == "\U00010000"
    assert garbled.Signs({}).fitting(0xF1, (tuple(range(0x80, 0xC0)),) * 3) == []


def test_words_choose_between_paths(spark):
    # by its signs alone the lost byte would be the frequent letter; the corpus has the word with the other
    many = ["é à é ü é"] * 300 + ["Lösung der Lösung"] * 40 + ["gelöst"] * 30
    bad = ["die L" + "Ã\ufffd" + "sung"]
    df = spark.createDataFrame(list(enumerate(many + bad)), "doc_id bigint, text string")
    got = {r.doc_id: r.restored for r in garbled.affected(df, restore=True).collect()}
    assert got == {len(many): "die Lösung"}
