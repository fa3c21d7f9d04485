import pytest

from plumbline.llm import chatdefects as d


@pytest.mark.parametrize("text", ["I can't help with that request.", "Sorry. That is outside what I may do, so no answer is given here. Try another question.", "很抱歉，我无法协助处理这个请求。", "Leider kann ich bei dieser Anfrage nicht helfen.", "Lo siento, no puedo ayudar con esta solicitud.", "Malheureusement, il m'est interdit de traiter ce sujet.", "I'm sorry, I can't share that.", "I would rather not say.", "That is something I refuse to talk about.", "As an AI language model I do not have access to this information.", "Sorry. I cannot help with that request. " * 50, "Mi dispiace. Non posso rispondere a questa domanda."])
def test_refusals(text):
    assert d.is_refusal(d.unify_lines(text))


@pytest.mark.parametrize("text", ["No.", "The relay refused to close, so the bay was isolated by hand.", "The cause cannot be confirmed from the evidence given.", "I cannot tell from these lines which seal failed.", "Die Frage lässt sich aus den Belegen nicht beantworten.", "现有证据不足以确认根因。", "Sorry for the delay. The pump tripped at 12:10."])
def test_no_refusals(text):
    assert not d.is_refusal(d.unify_lines(text))


def test_only_what_may_refuse_is_looked_at(monkeypatch):
    """The batch's matcher spares the exact look at plain answers and loses no refusal."""
    refusing = ["I can't help with that request.", "К сожалению, я не могу вам помочь.", "Das möchte ich hier leider nicht kommentieren.", "我拒绝。", "Não posso ajudar."]
    plain = ["The pump tripped at 12:10 and was not restarted.", "Das Lager wurde nicht geprüft.", "", "现有证据不足以确认根因。"]
    looked, exact = [], d.is_refusal
    monkeypatch.setattr(d, "is_refusal", lambda a: looked.append(a) or exact(a))
    answers = d.pd.Series([*refusing, *plain, None, *refusing], dtype=object)
    got = d.spoken_defects.func(d.pd.Series(["Why?"] * len(answers), dtype=object), answers).tolist()
    assert [x == "refusal" for x in got] == [True] * 5 + [False] * 5 + [True] * 5 and got[9] is None
    assert looked == [d.unify_lines(a) for a in refusing]


def test_placeholders(spark):
    """The look at the beginning comes first, and what it lets through is judged as a whole."""
    texts = {None: True, "": True, " \u200b…": True, "N/A": True, "( No Answer ). ": True, "." * 5000 + "placeholder" + "!" * 5000: True, "暂无。": True, "[]": False, " { } ": False, "placeholders": False, "none so": False, "n" * 5000: False, ". " * 5000 + "no answer was given": False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", d.is_placeholder(d.F.col("t")).alias("empty"))
    assert {r.t: r.empty for r in rows.collect()} == texts


USER = "Why did a runback follow at Ostrum? Keep the answer short.\nEvidence:\n[ev-1] The spare pump was delivered and fitted in the morning round.\n[ev-2] No wear was seen on the coupling."


@pytest.mark.parametrize("answer", ["Why did a runback follow at Ostrum? Keep the answer short.", "Question: " + USER, USER.upper().replace(".", ""), "> " + USER.replace("\n", "\n> "), "Why did a runback follow at Ostrum?"])
def test_copies(answer):
    assert d.spoken_defect(USER, answer) == "copy"


@pytest.mark.parametrize("answer", ["Why did a runback follow at Ostrum? Keep the answer short.\nThe spare pump was fitted late.", "No wear was seen on the coupling [ev-2].", "Yes, see [ev-1]."])
def test_no_copies(answer):
    assert d.spoken_defect(USER, answer) is None


def test_languages():
    german = "Die Pumpe wurde am Morgen geliefert und nach dem Anfahren eingebaut."
    assert d.spoken_defect(USER, german) == "language"
    assert d.spoken_defect(USER + "\nPlease answer in German.", german) is None
    assert d.spoken_defect(USER, "备用水泵于早班巡检时完成安装，振动幅值正常。") == "language"
    assert d.spoken_defect(USER, "Tag HX-1A-200") is None


@pytest.mark.parametrize("answer", [
    "La pompa di riserva è stata consegnata dopo il guasto e non ha funzionato nella notte.", "A bomba reserva foi entregue após a falha e não funcionou até o fim do turno com a equipe.",
    "Het reserveonderdeel werd naar de hal gebracht maar het is niet voor de nacht ingebouwd.", "Zapasowa pompa została dostarczona po awarii i nie była jeszcze gotowa, że jest.",
    "Reservpumpen är levererad och monterad efter felet, men den är inte provad för att delen saknas.", "Yedek pompa arıza sonra getirildi ve bir saat için çalıştı, ama çok iyi değil.",
    "Pompa de rezervă a fost adusă după defect și nu este montată din cauza unei piese pentru care nu sunt date.", "A szivattyú és a motor nem működött, hogy az egy órával később is meg volt.",
    "予備ポンプは朝の巡回で届けられ、取り付けられました。", "예비 펌프는 아침 순찰에서 설치되었습니다. 그 후 이상이 없습니다.", "Ο εφεδρικός κινητήρας παραδόθηκε και τοποθετήθηκε το πρωί.",
    "تم تسليم المضخة الاحتياطية وتركيبها في الصباح", "המשאבה הרזרבית נמסרה והותקנה בבוקר", "अतिरिक्त पंप सुबह पहुंचाया गया और लगाया गया", "ปั๊มสำรองถูกส่งมอบและติดตั้งในตอนเช้า",
])
def test_further_languages(answer):
    assert d.spoken_defect(USER, answer) == "language"


def test_length_decides_nothing():
    """Lead-ins are judged by what they say, refusals and copies whatever their length."""
    long = "Why did the runback follow at Ostrum and why was the spare pump not fitted before the restart of unit four?\n" * 40
    assert d.spoken_defect(long, "You asked the following, which is repeated here so that it can be read once more: " + long) == "copy"
    assert d.spoken_defect("Why so?", "Why so?") == "copy" and d.spoken_defect("Why so?", "Q: why so") == "copy"
    assert d.spoken_defect("Choose one.\nyes\nno", "yes") is None


def test_pairs_and_frame(spark):
    m = "array<struct<role string, content string>>"
    rows = [
        (1, [("system", "s"), (" User", "q?"), ("ASSISTANT", "n/a")], "x"),
        (2, [("user", "q?")], None),
        (3, [("human", "List it as JSON."), ("model", '{"entities": [], "claims": []}')], "x"),
        (4, [("user", "List it as JSON."), ("assistant", '{"entities": [{"id": "e1", "na')], "x"),
        (5, [], "x"), (6, None, "x"), (7, [("user", None), ("assistant", None)], "x"),
        (8, [("user", "a?"), ("assistant", "[]"), ("user", "b?"), ("assistant", "​")], "x"),
    ]
    frame = spark.createDataFrame(rows, f"record_id bigint, messages {m}, answer string")
    got = {(r.record_id, r.user_pos, r.defect) for r in d.defective_pairs(frame).collect()}
    assert got == {(1, 1, "empty"), (2, 0, "empty"), (4, 0, "truncated"), (7, 0, "empty"), (8, 2, "empty")}
    assert d.defective_pairs(frame.limit(0)).count() == 0
