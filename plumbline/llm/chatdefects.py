"""Broken prompt and response pairs.

Each user message and the answer behind it is one pair. The defect is, in this order: ``empty`` (no answer, a blank one
or a placeholder), ``refusal`` (nothing but phrases of the refusal dictionary), ``copy`` (the answer compressed with
its prompt as a zstandard dictionary holds next to nothing new, and an exact look finds only the question, the whole
message and perhaps a lead-in), ``language`` (by function words and scripts, a language that the user neither uses nor
asks for), ``truncated`` (open brackets in JSON, else the terminal-context classifier).

Defined results: records without messages have no pairs; a user message without an answer is ``empty``; a pair has at
most one defect; very long contents are looked at whole.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import question_answers
from plumbline.llm.charforms import unify
from plumbline.llm.truncation import fit_closing
from plumbline.session import spread, table

# What stands for a missing answer, without brackets, blanks and points around it.
PLACEHOLDERS = ("", "n/a", "na", "null", "none", "nil", "todo", "tbd", "empty", "no answer", "no response", "no content", "missing", "placeholder", "undefined", "nan", "暂无", "待补充", "无回答", "leer", "vide", "vacío", "пусто")
#: A compressed answer of at most this size, plus a share of its own length, is looked at as a copy.
NOVEL_BYTES, NOVEL_SHARE = 48, 0.25

# Words that only one of the languages has among its most frequent ones.
FUNCTION_WORDS = {
    "en": "the of and with for from has been that this shows to by had were which whether before because its it cannot should not there".split(),
    "de": "der das und wurde ist nicht auf von wegen zu einer einem hat sich über eine nach für ob wird zwischen durch bei um vor dem kann keine noch".split(),
    "fr": "le les une du et été sur pour avec au dans pas par avant après sans ce cette qui est sont aux sous d'un d'une l'examen encore peut".split(),
    "es": "el los las del por con se que y fue está hasta desde cuando después antes lo una para sin aún este esta puede al".split(),
}
# The like of further languages, by which an answer can be told from one in the languages above.
FURTHER_WORDS = {
    "it": "che della sono nel alla gli dei delle questo più è stato stata dopo dal nella anche perché non il".split(),
    "pt": "não uma foi são dos pelo pela ao mais já também após até você com na da em os um".split(),
    "nl": "het een niet zijn voor werd deze naar ook maar wordt aan".split(),
    "sv": "och att inte är som för av efter från ett även kan".split(),
    "da": "og ikke er blev fra til være efter også af på".split(),
    "pl": "nie się jest że po do przez została został oraz był dla jak".split(),
    "cs": "že je byl byla při nebo jsou pro bylo není také".split(),
    "tr": "ve bir bu için ile olarak değil sonra çok daha".split(),
    "fi": "ja ei oli että sekä myös mutta jälkeen ovat".split(),
    "hu": "és egy nem hogy az volt után meg csak".split(),
    "ro": "și nu este pentru din după cu fost sunt mai".split(),
    "id": "yang dan tidak dengan untuk pada dari ini adalah telah".split(),
    "vi": "và của là không được cho với một những đã".split(),
}


def _by_word(*tables: dict[str, list[str]]) -> dict[str, tuple[str, ...]]:
    found: dict[str, tuple[str, ...]] = {}
    for table in tables:
        for language, words in table.items():
            for w in words:
                found[w] = (*found.get(w, ()), language)
    return found


WORD_LANGUAGES = _by_word(FUNCTION_WORDS, FURTHER_WORDS)
#: Languages told by function words; those of the first table win a draw.
SPELT = (*FUNCTION_WORDS, *FURTHER_WORDS)
# The ranges of the scripts that tell a language, and how many letters count as much as its use.
SCRIPTS = {"zh": ("㐀-鿿", 8), "ru": ("Ѐ-ӿ", 12), "ja": ("ぁ-ヺ", 6), "ko": ("가-힣", 6), "ar": ("؀-ۿ", 12), "he": ("א-ת", 12), "el": ("Ͱ-Ͽ", 12), "hi": ("ऀ-ॿ", 12), "th": ("ก-๙", 12)}
_SCRIPT = {k: (re.compile(f"[{letters}]"), least) for k, (letters, least) in SCRIPTS.items()}
_ANY_SCRIPT = re.compile("[" + "".join(letters for letters, _ in SCRIPTS.values()) + "]")
# How the languages are named, in themselves and in the six languages of the corpus.
LANGUAGE_NAMES = {
    "zh": "chinese|mandarin|中文|汉语|chinesisch|chinois|chino|китайск", "en": "english|英文|英语|englisch|anglais|inglés|ingles|английск",
    "de": "german|德文|德语|deutsch|allemand|alemán|aleman|немецк", "fr": "french|法文|法语|französisch|français|francais|francés|frances|французск",
    "es": "spanish|西班牙|spanisch|espagnol|español|espanol|испанск", "ru": "russian|俄文|俄语|russisch|russe|ruso|русск",
    "it": "italian|意大利|italienisch|итальянск", "pt": "portugu|葡萄牙|португальск", "nl": "dutch|nederlands|niederländisch|荷兰|нидерландск", "sv": "swedish|svensk|schwedisch|шведск", "da": "danish|dansk|dänisch|датск",
    "pl": "polish|polski|polnisch|польск", "cs": "czech|česk|tschechisch|чешск", "tr": "turkish|türk|турецк", "fi": "finnish|suomi|finnisch|финск", "hu": "hungarian|magyar|ungarisch|венгерск", "ro": "romanian|român|rumänisch|румынск",
    "id": "indonesian|indonesia|indonesisch|印尼", "vi": "vietnam|việt|越南|вьетнамск", "ja": "japan|日本|日文|日语|японск", "ko": "korea|한국|韩文|韩语|корейск", "ar": "arab|عرب|阿拉伯|арабск", "he": "hebrew|עברית|hebräisch", "el": "greek|ελληνικ|griechisch|греческ",
    "hi": "hindi|हिन्दी", "th": "\\bthai|ไทย|泰文",
}
_NAMED = {k: re.compile(v) for k, v in LANGUAGE_NAMES.items()}
_LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

# The refusal dictionary. A sentence refuses if it holds one of the phrases and speaks of the speaker.
REFUSING = re.compile(
    "|".join([
        r"(?:can ?not|can't|won't|will not|unable to|not able to|not going to|could not|couldn't)(?: be able to)?(?: \w+)? (?:help|assist|comply|answer|respond|discuss|comment|provide|process|fulfil)", r"must decline|have to decline|decline to (?:answer|help|comment)",
        r"won't comment", r"inappropriate for me", r"outside what i (?:may|can)", r"guidelines (?:do not|don't|forbid|prevent)", r"(?:am|i'm) not (?:allowed|permitted)",
        "无法协助|无法帮助|不能协助|不能帮助|不能回答|无法回答|不便|恕不|恕难|拒绝回答|无法提供|不能提供|无法处理|不允许我|不被允许",
        r"nicht (?:weiter)?helfen|(?:kann|darf|möchte) (?:ich )?(?:\w+ ){0,4}nicht (?:beantworten|kommentieren|bearbeiten|unterstützen)|muss (?:ich )?(?:\w+ ){0,3}ablehnen|mir nicht (?:erlaubt|gestattet)|darf ich nicht|keine auskunft geben",
        r"no puedo (?:ayudar|responder|contestar|atender|proporcionar|comentar|tratar)|no me está permitid|no estoy autorizad|debo (?:declinar|rechazar|negarme)|no me es posible",
        r"(?:ne peux|ne puis|ne pourrai)(?: pas)?(?: \w+)? ?(?:répondre|aider|traiter|commenter|fournir)|m'est interdit|ne suis pas (?:autorisé|en mesure|habilité)|dois (?:décliner|refuser)",
        r"не могу (?:\w+ )?(?:помочь|ответить|отвечать|обсуждать|предоставить|выполнить)|вынужден\w* отказ|не имею права|мне (?:запрещено|не разрешено)|отказываюсь",
    ])
)
# What is declined, for the verbs that also have other objects.
DECLINED = re.compile(
    r"(?:can ?not|can't|won't|will not|unable to|not able to|not going to|could not|couldn't)(?: \w+)? (?:share|disclose|reveal|talk about|speak (?:about|to)|engage|support|offer|fulfil+|continue|do (?:that|this|so)|go into|take (?:part|on)|write|create|generate|tell you|say more|give (?:you )?(?:an? )?(?:answer|advice|information))|"
    r"(?:would|i'd) rather not|prefer not to|\brefuse to|\bi (?:must|have to|need to) refuse|not comfortable|not in a position|(?:do not|don't) have (?:access|permission|authori[sz]ation)|against (?:my|our) (?:rules|polic|guidelines)|not something (?:that )?i|my (?:rules|polic\w+|guidelines|instructions) (?:do not|don't|forbid|prevent)|"
    r"weigere mich|lehne (?:ich )?(?:\w+ ){0,3}ab\b|möchte (?:ich )?(?:\w+ ){0,3}nicht|keinen zugriff|"
    r"refuse de (?:répondre|traiter)|préfère ne pas|n'ai pas accès|ne souhaite pas|"
    r"me niego a|prefiero no|no tengo acceso|no quiero (?:responder|hablar)|"
    r"non posso (?:aiutar|risponder|fornir|condivider)|preferisco non|mi rifiuto|não posso (?:ajudar|responder|fornecer|compartilhar)|prefiro não|recuso|ik kan (?:\w+ ){0,3}niet (?:helpen|beantwoorden)|"
    r"нет доступа|предпоч\w+ не|не буду (?:отвечать|обсуждать)|我拒绝|拒绝讨论|我没有(?:权限|访问)|不愿意?(?:回答|讨论)"
)
_SPEAKER = re.compile(r"\b(?:io|eu|posso|ik|mi|mij|my|i'd|mich|me|je|n'ai|i|i'm|me|my|ich|mir|puedo|me|debo|estoy|je|m'est|мне|не могу|вынужден\w*|имею|отказываюсь)\b|kann ich|我|恕|不便")
_EVIDENCE = re.compile(r"evidence|record|\blines?\b|\bnotes?\b|beleg|protokoll|preuve|dossier|prueba|registro|证据|材料|记录|доказательств|журнал")
_FILLER = re.compile(
    r"sorry|apolog|dispiace|desculp|helaas|spijt|unfortunately|regret|as an assistant|as an ai|thanks for|thank you|please contact|try another|something else|qualified|entschuldig|leider|tut mir leid|bitte wenden|fachperson|fachmann|andere frage|désolé|malheureusement|veuillez|"
    r"spécialiste|autre question|lo siento|lamentablemente|disculp|consulte|especialista|otra pregunta|抱歉|对不起|作为助手|请咨询|请换|专业人员|换一个|к сожалению|извините|обратитесь|другой вопрос"
)
#: Matches whatever REFUSING or DECLINED does and perhaps more, for the linear matcher of whole batches, where \w is ASCII.
_MAY_REFUSE = f"{REFUSING.pattern}|{DECLINED.pattern}".replace(r"\w", r"\S").replace(r"\b", "")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n")


def is_refusal(answer: str) -> bool:
    """Whether every sentence of ``answer`` (unified) is a refusal or goes along with one, and at least one refuses."""
    refused = False
    for sentence in _SENTENCES.split(answer):
        if not sentence.strip(" .。!?"):
            continue
        if (REFUSING.search(sentence) or DECLINED.search(sentence)) and _SPEAKER.search(sentence) and not _EVIDENCE.search(sentence):
            refused = True
        elif not _FILLER.search(sentence):
            return False
    return refused


def may_refuse(answers: list[str]) -> list[bool]:
    """False for each of ``answers`` (unified) in which no sentence can refuse."""
    return pc.match_substring_regex(pa.array(answers, pa.large_string()), pattern=_MAY_REFUSE).to_pylist()


def _counts(text: str) -> dict[str, int]:
    """How many letters of each telling script and how many function words of each language a text (unified) holds."""
    counts = dict.fromkeys((*SCRIPTS, *SPELT), 0)
    if _ANY_SCRIPT.search(text):
        for language, (letters, _) in _SCRIPT.items():
            counts[language] = len(letters.findall(text))
        if counts["ja"] >= _SCRIPT["ja"][1]:
            counts["ja"], counts["zh"] = counts["ja"] + counts["zh"], 0
    find = WORD_LANGUAGES.get
    for w in _LETTERS.findall(text):
        for k in find(w) or ("'" in w and find(w.split("'")[1])) or ():
            counts[k] += 1
    return counts


def prose_language(text: str) -> str | None:
    """The language of prose, or None where too little speaks for one."""
    c = _counts(text)
    latin = sum(c[k] for k in FUNCTION_WORDS)
    for language, (_, least) in _SCRIPT.items():
        if c[language] >= least and c[language] > 3 * latin:
            return language
    ranked = sorted(SPELT, key=lambda k: -c[k])
    first, second = ranked[0], ranked[1]
    return first if c[first] >= (2 if first in FUNCTION_WORDS else 3) and c[first] >= 2 * c[second] else None


def user_takes(text: str, language: str) -> bool:
    """Whether a message uses a language or asks for it."""
    c = _counts(text)
    if language in _SCRIPT:
        used = c[language] >= _SCRIPT[language][1] // 2 + (language == "ru") * 2
    else:
        top = max(c[k] for k in SPELT)
        used = c[language] >= 3 and c[language] >= 0.3 * top or 0 < c[language] == top
    return used or bool(_NAMED[language].search(text))


_KEPT = re.compile(r"[^\W_]+")
#: A lead-in says nothing of its own: one clause up to a colon.
_LEAD_IN = re.compile(r"[^.!?。！？:：\n]*[:：]")
_OWN_WORDS = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")


#: The ASCII characters that are no letter and no digit, as blanks.
_SPACED = {i: " " for i in range(128) if not chr(i).isalnum()}


def _kept(text: str) -> list[str]:
    """The runs of letters and digits."""
    return text.translate(_SPACED).split() if text.isascii() else _KEPT.findall(text)


def _squeezed(text: str) -> str:
    return "".join(_kept(text))


def _questions(user: str) -> list[str]:
    """What a message asks, line by line and the lines' first sentences: three words at least, or a question mark. Lines of
    evidence ask nothing."""
    found = []
    for line in user.split("\n"):
        if line.strip() and not line.lstrip("> ").startswith("["):
            for part in {line, *re.split(r"(?<=[?？。.])\s*", line)[:1]}:
                if "?" in part or "？" in part or len(_OWN_WORDS.findall(part)) >= 3:
                    found.append(_squeezed(part))
    return sorted(filter(None, found), key=len, reverse=True)


def gives_back(answer: str, user: str) -> bool:
    """Exact look: ``answer`` is the question or the message, perhaps again, perhaps behind a lead-in; or nothing but four
    fifths of the message or more."""
    a, u = _squeezed(answer), _squeezed(user)
    if not a or not u:
        return False
    bodies = [a]
    if lead := _LEAD_IN.match(answer):
        bodies.append(_squeezed(answer[lead.end() :]))
    wholes = [u, *_questions(user)]
    if any(body and not body.replace(whole, "") for body in bodies for whole in wholes):
        return True
    return any(len(body) >= 0.8 * len(u) and body in u for body in bodies)


def novel_size(answer: str, prompt: str) -> int:
    """The bytes that ``answer`` takes compressed with ``prompt`` as its dictionary."""
    import zstandard

    dictionary = zstandard.ZstdCompressionDict(prompt.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=False, write_content_size=False).compress(answer.encode("utf-8", "replace")))


def spoken_defect(user: str | None, answer: str) -> str | None:
    """refusal, copy or language, or None."""
    return _spoken(unify_lines(user or ""), unify_lines(answer), True)


def _spoken(u: str, a: str, refusing: bool) -> str | None:
    """The defect of unified texts; without ``refusing`` no sentence of the answer refuses."""
    if refusing and is_refusal(a):
        return "refusal"
    words, prompt = " ".join(_kept(a)), " ".join(_kept(u))
    if prompt and words and novel_size(words, prompt) <= NOVEL_BYTES + NOVEL_SHARE * len(words) and gives_back(a, u):
        return "copy"
    spoken = prose_language(a)
    return "language" if spoken and not user_takes(u, spoken) else None


def unify_lines(text: str) -> str:
    return "\n".join(unify(line)[0] for line in text.replace("’", "'").split("\n"))


@F.pandas_udf(T.StringType())
def spoken_defects(users: pd.Series, answers: pd.Series) -> pd.Series:
    given = dict.fromkeys(pair for pair in zip(users, answers) if pair[1] is not None)
    unified = [(unify_lines(user or ""), unify_lines(answer)) for user, answer in given]
    looked = dict(zip(given, (_spoken(*texts, refusing) for texts, refusing in zip(unified, may_refuse([a for _, a in unified])))))
    return pd.Series([looked.get(pair) for pair in zip(users, answers)], index=users.index, dtype=object)


def message_pairs(records: DataFrame, *kept: Column) -> DataFrame:
    """(record_id, .. kept, user_pos, user, answer): every user message with the answer directly behind it, if there is one."""
    pairs = records.select(F.col("record_id").cast("bigint").alias("record_id"), *kept, F.explode(question_answers(F.col("messages"))).alias("p"))
    return pairs.select("*", F.col("p.pos").alias("user_pos"), F.col("p.asked").alias("user"), "p.answer").drop("p")


def is_placeholder(answer: Column) -> Column:
    """Whether an answer is missing, blank or a placeholder; an empty JSON list or object is an answer."""
    sign = r"[\s\p{P}\p{S}\p{Cf}\p{Z}]"
    bare = F.lower(F.regexp_replace(F.regexp_replace(answer, f"^{sign}+", ""), f"{sign}+$", ""))
    exact = (bare.isin(*PLACEHOLDERS) | answer.rlike(f"^{sign}*$")) & ~answer.rlike(r"^\s*(?:\[\s*\]|\{\s*\})\s*$")
    # one look at the beginning spares the exact look at whole answers: what stands between signs is as short as a placeholder
    short = answer.rlike(f"^{sign}*+[\\s\\S]{{0,{max(map(len, PLACEHOLDERS))}}}{sign}*$")
    return answer.isNull() | F.when(short, exact).otherwise(False)


def open_json(answer: Column) -> Column:
    """Whether a JSON answer ends inside a string or with brackets open."""
    rest = F.regexp_replace(answer, r'(?s)"(?:[^"\\]|\\.)*+"', "")
    opened = F.length(F.regexp_replace(rest, r"[^{\[]", ""))
    closed = F.length(F.regexp_replace(rest, r"[^}\]]", ""))
    return rest.contains('"') | (opened > closed)


def judged_pairs(records: DataFrame, *kept: Column) -> DataFrame:
    """(record_id, .. kept, user_pos, defect) of every pair; the defect is null where there is none."""
    pairs = message_pairs(records, *kept)
    names = [c for c in pairs.columns if c not in ("user", "answer")]
    answer = F.col("answer")
    json = F.coalesce(answer.rlike(r"^[\s\p{Z}\p{Cf}]*(?:```\w*\s*)?(?:[{]|```|\[[\s\p{Z}]*[{\]])"), F.lit(False))
    # an answer that closes its JSON and goes on is prose
    json = json & (answer.rlike(r"[}\]`][\s\p{Z}\p{Cf}]*$") | open_json(answer))
    kinds = pairs.withColumn("json", json).withColumn("empty", is_placeholder(answer))
    source = "source_name" if "source_name" in kinds.columns else None  # what field limits are told by
    model = fit_closing(kinds.where("not json and not empty"), "answer", source)
    looked = kinds.withColumn("prose", F.when(~F.col("json") & ~F.col("empty"), answer))
    looked = looked.withColumn("spoken", spoken_defects(F.when(F.col("prose").isNotNull(), F.col("user")), "prose"))
    scored = model.score(looked, "prose", source)
    cut_off = F.when(F.col("json"), open_json(answer)).otherwise(F.col("cut_probability") >= 0.5)
    defect = F.when(F.col("empty"), "empty").when(F.col("spoken").isNotNull(), F.col("spoken")).when(cut_off, "truncated")
    return scored.select(*names, defect.alias("defect"))


def defective_pairs(records: DataFrame) -> DataFrame:
    """(record_id, user_pos, defect) of every defective pair."""
    return judged_pairs(records).where("defect is not null")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judged_pairs(spread(table(spark, sf_dir, "chat_records")), F.col("metadata.source_name").alias("source_name"))
    return judged.where("defect is not null").select("record_id", "user_pos", "defect")


def p3_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and defect: how many pairs have it, of how many pairs of the source."""
    judged = judged_pairs(spread(table(spark, sf_dir, "chat_records")), F.col("metadata.source_name").alias("source_name"))
    counted = judged.groupBy("source_name", "defect").agg(F.count("*").alias("pairs"))
    whole = counted.withColumn("all_pairs", F.sum("pairs").over(Window.partitionBy("source_name")))  # a few rows a source
    return whole.where("defect is not null").select("source_name", "defect", "pairs", "all_pairs")
