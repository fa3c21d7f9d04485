import pytest

from plumbline.llm import mojibake as m

GERMAN = "Die äußere Kühlwasserpumpe wurde geprüft, während die Öltemperatur 65 °C erreichte."
FRENCH = "La deuxième chaîne d'isolateurs a été livrée à Dunmarrow, puis montée après la révision."
RUSSIAN = "Группа испытаний сообщила: коррозия и течь фланца перед ремонтом."
CHINESE = "备用的循环水调速器运抵石渡口，升负荷期间完成安装。"


@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251"])
@pytest.mark.parametrize("text", [GERMAN, FRENCH])
def test_utf8_read_wrongly(text, wrong):
    garbled = m._garbled(text, "utf-8", wrong)
    if garbled:
        assert m.damage(garbled) == (True, text)


@pytest.mark.parametrize("right, wrong, text", [("cp850", "cp1252", FRENCH), ("latin-1", "cp437", FRENCH), ("mac_roman", "cp1252", FRENCH), ("latin-1", "cp1251", GERMAN), ("gbk", "latin-1", CHINESE), ("koi8-r", "cp1251", RUSSIAN), ("utf-8", "gbk", "背景"), ("utf-8", "cp1251", RUSSIAN)])
def test_other_pairs_are_found(right, wrong, text):
    garbled = m._garbled(text, right, wrong)
    assert garbled and m.damage(garbled)[0]


def test_whole_texts_are_recovered():
    assert m.damage(m._garbled(CHINESE, "gbk", "latin-1"))[1] == CHINESE
    twice = m._garbled(m._garbled(GERMAN, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert m.damage(twice) == (True, GERMAN)


def test_only_spans_are_replaced():
    text = "Label reads KÃ¼hlÃ¶l. Éclair works — “fine”, 5 °C."
    assert m.damage(text) == (True, "Label reads Kühlöl. Éclair works — “fine”, 5 °C.")


def test_lost_characters():
    assert m.damage("The limit at this spot is 65 �C.") == (True, None)


@pytest.mark.parametrize(
    "text",
    [
        "", "plain", GERMAN, FRENCH, RUSSIAN, CHINESE, "The export shows Ã¼ instead of ü in the tag list.", "Column “Remarks” printed â€™ for every apostrophe, see ticket 1.", "operators see ï»¿ at the head of the file",
        "说明：旧系统曾把“导致”显示为乱码“锟斤拷”，本文件内容正常。", "MANUTENÇÃO PREVENTIVA: REVISÃO DA VÁLVULA EM SÃO VELMO", "Åtgärd på plats i Ömsund", "See the crew’s note. “No further – action” – closed.", "«the» valve…", "№ 14/б", "👩‍🔧 notified", "Tolerance ≤ 0.3 mm, ±5 %, § 4, ½ year",
    ],
)
def test_sound_texts(text):
    assert m.damage(text) == (False, None)


def test_frame(spark):
    rows = [(1, None, None), (2, "", "x"), (3, "KÃ¼hl", "y"), (3, "KÃ¼hl", "y"), (4, "KÃ¼hlÃ¶l " * 20_000, "z")]
    got = m.damaged_documents(spark.createDataFrame(rows, "doc_id bigint, text string, original string")).collect()
    assert sorted(r.doc_id for r in got) == [3, 3, 4] and all(r.original.startswith("Kühl") for r in got)
    assert m.damaged_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


PAIRS = {
    "de": (GERMAN, [*(("utf-8", w) for w in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "iso8859-15", "cp1250", "iso8859-2", "cp1254", "cp852", "cp1257", "gbk")), ("cp850", "cp1252"), ("latin-1", "cp437"), ("latin-1", "cp850"), ("mac_roman", "cp1252"), ("latin-1", "cp1251"), ("latin-1", "koi8-r")]),
    "fr": (FRENCH, [*(("utf-8", w) for w in ("cp1252", "latin-1", "cp437", "iso8859-15", "cp1250", "cp1254", "cp852", "cp1257")), ("cp850", "cp1252"), ("latin-1", "cp437"), ("latin-1", "mac_roman"), ("latin-1", "cp1251")]),
    "ru": (RUSSIAN, [*(("utf-8", w) for w in ("cp1252", "latin-1", "cp437", "cp1251", "koi8-r", "cp866", "iso8859-15")), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "latin-1"), ("koi8-r", "latin-1"), ("cp866", "latin-1")]),
    "zh": (CHINESE, [*(("utf-8", w) for w in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp866")), ("gbk", "latin-1"), ("gbk", "cp1252"), ("gb18030", "latin-1")]),
}


def test_recovery_by_pair():
    """Of all pairs that keep every byte at least nine of ten texts come back, alone and beside correct lines; those that don't
    are reported as not recovered, but for a few."""
    tried = right = wrong = 0
    missed = []
    for language, (text, pairs) in PAIRS.items():
        for pair in pairs:
            garbled = m._garbled(text, *pair)
            if not garbled or garbled == text:
                continue
            for before in ("", "All is well here.\n", "备用水泵运行正常。\n" if language == "zh" else "Été à côté.\n"):
                found, original = m.damage(before + garbled)
                tried, right, wrong = tried + 1, right + (original == before + text), wrong + (original not in (None, before + text))
                if not found or original != before + text:
                    missed.append((language, pair, before, original))
    assert tried > 100 and right >= 0.9 * tried and wrong <= 0.04 * tried, missed
