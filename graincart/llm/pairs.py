"""Broken prompt and response pairs.

Each answer is parsed and compared with its question: markers of nothing said, a refusal grammar, greedy string
tiling against the question, script and function-word checks of the language, and a pushdown parser for what an
answer opens and never closes. Whether an answer breaks off inside a sentence is decided by the whole corpus: how
often its last words are followed by the end of a sentence, and whether its last word is the beginning of a longer one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.functions.text import name_key
from graincart.llm.common import first_deliveries
from graincart.session import cut_lineage

# ---------------------------------------------------------------- words

_HAN = re.compile(r"([぀-ヿ㐀-鿿])")
_WORD = re.compile(r"\d+(?:[.,]\d+)*|(?:[^\W\d_]|[̀-ͯऀ-ॣॱ-ॿ‌‍])+|[.!?…。।]+")
_STOP = frozenset(".!?…。।")
START = "^"


def words(text: str) -> list[str]:
    """Words in lower case, numbers as `#`, Han characters one by one; full stops left out."""
    return [w for w in stream(text) if w[0] not in _STOP]


def stream(text: str) -> list[str]:
    """Like words, with the marks that end sentences between them."""
    text = text.lower()
    if _HAN.search(text):
        text = _HAN.sub(r" \1 ", text)
    return ["#" if w[0].isdigit() else w for w in _WORD.findall(text)]


# ---------------------------------------------------------------- nothing said

#: Texts that stand for no answer, as letters and digits in lower case.
NOTHING = frozenset(["", "na", "null", "nonegiven", "nan", "nil", "undefined", "none", "noanswer", "tbd", "todo", "empty", "blank", "unanswered", "keineangabe", "sinrespuesta", "sansreponse", "semresposta"])
#: Those that answer a question for a number, or whether there are any; and such questions.
NUMBERS = frozenset(["nil", "none"])
_COUNTS = re.compile(r"\bhow (?:many|much)\b|\bnumber of\b|\bany\b|\bcombien\b|\bcu[aá]nt[oa]s?\b|\bquant[oa]s?\b|\bwie ?viele?\b|कितन|几|多少")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,40}>")
_LABEL = re.compile(r"^[\s>*#-]*(?:\*\*)?[A-Za-z][\w -]{0,24}(?:\*\*)?\s*:\s*$")


def says_nothing(answer: str | None, question: str = "") -> bool:
    """No letter or digit is left without tags and labels (`Answer:`, empty sections), or it is a word for nothing, and no number that was asked for."""
    if answer is None:
        return True
    bare = _TAG.sub(" ", answer) if "<" in answer else answer
    if ":" in bare:
        lines = [x for x in bare.splitlines() if any(ch.isalnum() for ch in x)]
        if lines and all(_LABEL.match(x) for x in lines):
            return True
    said = []
    for ch in bare.lower():
        if ch.isalnum():
            said.append(ch)
            if len(said) > 20:  # longer than any of them
                return False
    word = "".join(said)
    return word in NOTHING and not (word in NUMBERS and _COUNTS.search(question.lower()))


# ---------------------------------------------------------------- refusals

#: A refusal grammar: a sentence refuses if one of these productions derives a part of it, in lower case. Most are of the form
#: inability - gap - act of answering, or matter - gap - denial; the act is never left out, so that doubt (`I cannot say for certain`) is none.
_ALPHABETIC = [
    # who answers cannot, may not or will not say or do something about it
    r"\b(?:i|we) (?:do not|don'?t)\b.{0,10}\b(?:discuss|answer|comment|talk|advise|respond|handle|give (?:advice|answers))\b",
    r"\b(?:falls?|is|lies|goes) (?:outside|beyond)\b.{0,20}\b(?:i|we) (?:can|may|am|are|do)\b|\b(?:falls?|is|lies|goes) (?:outside|beyond) (?:my|our) (?:scope|remit|role|limits|guidelines)\b",
    r"\b(?:can(?:no|')?t|cannot|could not|can not|won'?t|will not|unable to|not able to|not in a position to|refuse to|decline to|must decline|have to decline|rather not|prefer not to|not going to|am not allowed|not permitted)\b.{0,25}\b(?:help|assist|answer|answering|comply|respond|discuss|say|speak|talk|comment|give|provide|offer|share|describe|look into|process|advise)\b",
    r"\b(?:i|we) (?:do not|don'?t) have (?:the )?permission\b|\b(?:do|does) not (?:permit|allow)\b|\bnot allowed\b|\b(?:allowed|permitted) to (?:discuss|answer|say|share|comment)",
    r"\bhave to pass on\b|\bpass on this\b|\bnot going there\b|\bnot a (?:subject|topic) for me\b",
    # what was asked is not dealt with
    r"\b(?:no|not any) (?:answer|comment|advice|statement|information|reply|assistance|help)\b.{0,20}\b(?:will|can|may|could|shall)\b.{0,15}\b(?:be )?(?:given|offered|made|provided)\b",
    r"\b(?:request|requests|question|questions|topic|topics|subject)\b.{0,60}\b(?:blocked|cannot be (?:processed|answered)|not (?:be )?(?:processed|answered|supported)|outside|off limits|prohibited|declined)\b",
    r"\b(?:assistance|help|an answer|advice)\b.{0,40}\b(?:not something|cannot be|can'?t be|is not)\b.{0,20}\b(?:provided|given|offered|available|possible)\b",
    r"\bdoes not (?:discuss|answer|comment|talk|advise|handle)\b|\bwould not be appropriate\b|\bpolicy prevents\b|\bguidelines (?:do not|prevent|forbid|prohibit)\b|\bfor safety reasons\b.{0,40}\bnot\b",
    # French
    r"\bne (?:peux|puis|pouvons|suis|souhaite|veux|vais|saurais)\b.{0,30}\b(?:pas|rien)\b.{0,40}\b(?:r[eé]pondre|aider|parler|commenter|donner|traiter|dire|mesure|autoris)|\baucun(?:e)? (?:r[eé]ponse|commentaire|conseil|avis)\b.{0,20}\b(?:sera|peut|ne)\b|\bd[eé]passe ce qui m'est permis\b|\bpr[eé]f[eè]re ne (?:pas|rien)\b|\bm'est (?:interdit|impossible)\b|\brefuse de\b",
    # Spanish
    r"\bno (?:puedo|podemos|voy a|quiero|me es posible|estoy autorizad[oa]|me est[aá] permitido|se me permite)\b.{0,25}\b(?:ayudar|responder|contestar|opinar|hablar|comentar|dar|tratar|ofrecer|decir|hablar)|\bprefiero no\b|\b(?:esta|su) (?:consulta|pregunta|solicitud)\b.{0,40}\b(?:no (?:puede|se puede|ser[aá])|fuera|supera|excede)|\bno (?:se dar[aá]|habr[aá]) (?:ninguna )?respuesta\b|\bninguna respuesta\b|\bme niego\b",
    # German
    r"\b(?:kann|darf|werde|m[oö]chte|will) (?:ich|wir)?\b.{0,40}\b(?:nicht|keine?n?)\b.{0,40}\b(?:beantworten|helfen|antworten|auskunft|sagen|geben|[aä]u[sß]+ern|sprechen|eingehen)|\b(?:kann|darf|werde) ich dazu\b.{0,15}\b(?:keine|nicht)|\b[aä]u[sß]+ere ich mich\b.{0,20}\bnicht\b|\bkeine (?:auskunft|antwort|stellungnahme)\b|\bist mir nicht (?:erlaubt|gestattet|m[oö]glich)\b|\b(?:anfrage|frage|thema)\b.{0,40}\b(?:nicht|abgelehnt|gesperrt)\b.{0,30}\b(?:beantwort|bearbeit|zul[aä]ss|erlaubt|behandel)",
    # Portuguese
    r"\bn[aã]o (?:posso|podemos|vou|quero|estou autorizad[oa]|me [eé] permitido|tenho permiss[aã]o|consigo)\b.{0,25}\b(?:ajudar|auxiliar|responder|comentar|falar|opinar|dar|tratar|dizer|oferecer|discutir|atender|fornecer|fazer isso)\b|\bn[aã]o (?:tenho permiss[aã]o|me [eé] permitido|estou autorizad[oa])\b|\bprefiro n[aã]o\b|\b(?:esta|sua) (?:pergunta|quest[aã]o|solicita[cç][aã]o)\b.{0,40}\b(?:n[aã]o (?:pode|ser[aá])|fora|ultrapassa|excede)|\bnenhuma resposta\b|\brecuso",
    # rules that forbid it
    r"\b(?:normas|reglas|pol[ií]ticas?|directrices|regras|diretrizes)\b.{0,20}\b(?:impiden|impide|proh[ií]ben|no (?:me )?permiten|n[aã]o (?:me )?(?:deixam|permitem)|impedem|pro[ií]bem)\b",
    r"\b(?:r[eè]gles|consignes|directives)\b.{0,20}\b(?:interdisent|emp[eê]chent|permettent pas)\b|\b(?:richtlinien|regeln|vorgaben)\b.{0,30}\b(?:verbieten|untersagen|erlauben|lassen)\b",
]
#: The same for Hindi and Chinese.
_OTHER_SCRIPTS = [
    r"(?:उत्तर|जवाब|मदद|सहायता|सलाह|टिप्पणी|जानकारी)[^।]{0,40}(?:नहीं (?:दे|कर|दी|की|दूं|दूँ|है)|असमर्थ|मना)|अनुमति नहीं|क्षमा करें",
    r"(?:无法|不能|不便|不会|拒绝|不予|不可以|没有权限)[^。]{0,12}(?:回答|答复|帮助|协助|提供|讨论|评论|处理|回应)|恕不|抱歉",
]
# every alphabetic production starts with a word, so that nothing is tried inside of one
_REFUSES = re.compile(r"(?<!\w)(?=\w)(?:" + "|".join(_ALPHABETIC) + ")|" + "|".join(_OTHER_SCRIPTS))
#: What a refusal may come with: greetings, thanks, apologies, and whom else to ask.
_FILLS = re.compile(
    r"^[\W_]*(?:(?:hmm+|noted|hello|hi|hey|ok(?:ay)?|well|sorry|apologies|my apologies|notice|unfortunately|regrettably|thanks?(?: you)?(?: for .{0,40})?|(?:i'?m |i am )?(?:very |so )?sorry|nope|no|please note|hola|lo siento|gracias.{0,30}|nota(?:do)?|aviso|perd[oó]n|d[eé]sol[eé]e?|bonjour|merci.{0,30}|remarque|leider|hallo|danke.{0,30}|entschuldigung|hinweis|verstanden|ol[aá]|desculpe|obrigad[oa].{0,30}|notei|anotado|entendido|infelizmente|नमस्ते|धन्यवाद|您好|你好|谢谢.{0,10}|抱歉|对不起)[\W_]*)+$"
    r"|^[\W_]*(?:please |kindly )?(?:ask|consult|contact|see|try|speak to|talk to)\b.{0,50}\b(?:someone|somebody|professional|expert|specialist|adviser|advisor|agronomist|doctor|else)\b"
    r"|\b(?:consulte|consultez|contactez|adressez|wenden sie sich|fragen sie|pregunte|procure)\b.{0,60}$"
)
#: Words of doubt: a sentence with one of them does answer.
_DOUBTS = re.compile(r"\b(?:for (?:certain|sure)|with (?:certainty|confidence)|definitively|com certeza|con (?:certeza|seguridad)|avec (?:certitude|assurance)|mit sicherheit|sicher sagen)\b|निश्चित|确定")
#: Words after which the same sentence goes on to answer.
_TURNS = re.compile(r"\b(?:but|yet|however|although|though|mais|cependant|pero|sin embargo|aber|jedoch|doch|trotzdem|mas|por[eé]m|no entanto|लेकिन|परंतु|但是|不过)\b[\s,:;]*(.*)$", re.S)
_BLANK = re.compile(r"[\s​-‍﻿]+")
_SCRIPTS = re.compile(r"[ऀ-ॣ㐀-鿿]")
_ENDS = re.compile(r"(?<=[.!?。।])\s+|\n+|(?<=[。।])")


def refuses(answer: str) -> bool:
    """Every sentence refuses or only accompanies a refusal, and one does refuse. Doubt within an answer is none.

    A sentence that refuses and then goes on to answer (`I cannot ..., but ...`) is content.
    """
    found = False
    for sentence in _ENDS.split(re.sub(r"\*\*[^*]{0,30}\*\*", " ", answer.lower().replace("’", "'"))):
        sentence = _BLANK.sub(" ", sentence).strip()
        if not any(ch.isalnum() for ch in sentence):
            continue
        if _REFUSES.search(sentence) and not _DOUBTS.search(sentence):
            turn = _TURNS.search(sentence)
            if turn and len(words(turn.group(1))) >= 4 and _REFUSES.search(sentence[: turn.start()]) and not _REFUSES.search(turn.group(1)):
                return False
            found = True
        elif not _FILLS.search(sentence):
            return False
    return found


# ---------------------------------------------------------------- copies of the question

#: Words that introduce a question that is given back.
_INTRODUCES = frozenset("q a question answer response the you asked your was is prompt frage antwort pregunta respuesta réponse reponse pergunta resposta".split())


def tiles(a: list[str], b: list[str], least: int) -> tuple[list[bool], list[bool]]:
    """Greedy string tiling: which words of `a` and `b` lie in common runs of at least `least`, the longest placed first.

    Runs found at one length don't overlap; marked words of `a` may meet the same words of `b` again, so that a
    question given back twice is covered twice.
    """
    in_a, in_b = [False] * len(a), [False] * len(b)
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    runs = []
    for i, w in enumerate(a):
        for j in where.get(w, ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 1
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                runs.append((-n, i, j))
    for n, i, j in sorted(runs):
        if not any(in_a[i : i - n]):
            in_a[i : i - n] = [True] * -n
            in_b[j : j - n] = [True] * -n
    return in_a, in_b


def copies_question(question: list[str], answer: list[str]) -> bool:
    """The answer is made of the question's words in their order, and holds nearly all of them to the end."""
    if len(answer) < 3 or len(question) < 3:
        return False
    asked = set(question)
    if sum(w in asked or w in _INTRODUCES for w in answer) < 0.9 * len(answer):
        return False
    in_a, in_b = tiles(answer, question, min(3, len(question)))
    rest = [w for w, covered in zip(answer, in_a) if not covered and w not in _INTRODUCES]
    return len(rest) <= 0.1 * len(answer) and sum(in_b) >= 0.7 * len(question) and sum(in_a) >= 3


def stops_in_question(question: list[str], answer: list[str]) -> bool:
    """The answer gives the question back and breaks off before the question is over, inside a word or not."""
    n = len(answer)
    if n < 4 or n > len(question):
        return False
    for at in range(0, min(4, len(question) - n) + 1):
        part = question[at : at + n]
        if part[:-1] == answer[:-1] and part[-1].startswith(answer[-1]):
            return part[-1] != answer[-1] or len(question) - at - n >= 2
    return False


# ---------------------------------------------------------------- languages

#: Frequent function words and forms by language.
FUNCTION_WORDS = {
    "en": "the of and is are was in on to for with this that these what which how does do did has have been be can could should would will not only if by from at or an a it its my your before after where when why there then than more most least about because so first".split(),
    "es": "el la los las un una de del y en es son está están hay que qué se su con por para como cómo cuál cuáles cuántas cuántos si no mi este esta estos estas al lo más pero muy debo puede así sobre sin ya antes después donde cuando también entre hasta desde".split(),
    "fr": "le la les un une des du de et en est sont il elle on que qui quoi quel quelle quels quelles se ce cet cette ces sur sous dans avec pour par pas plus ne au aux ou où y a t faut combien mon ma mes votre vous peut sans donc très peu mais comment pourquoi à avant après aussi entre depuis".split(),
    "de": "der die das den dem des ein eine einen einem einer und ist sind war in im an am auf aus bei mit nach von zu zum zur für wie viele was welche welcher welches wo warum wann wenn nicht nur noch sich es sie er ich wir man soll kann hier diese dieser dieses diesem diesen oder auch als so daher wohl gegen".split(),
    "pt": "o a os as um uma de do da dos das e em no na nos nas é são está estão há que se seu sua com por para como qual quais quantas quantos não mais mas muito esta este estas estes isso ao à ser então meu minha devo preciso só pelo pela você sobre sem já quando antes depois onde também entre até desde".split(),
}
_OF: dict[str, list[str]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in dict.fromkeys(_list):
        _OF.setdefault(_w, []).append(_lang)
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
#: Letters that only some of these languages write.
_LETTERS = {"ñ": "es", "¿": "es", "¡": "es", "ß": "de", "ä": "de", "ö": "de", "ã": "pt", "õ": "pt", "œ": "fr", "è": "fr", "ù": "fr", "û": "fr", "î": "fr", "ë": "fr"}
_DEVANAGARI, _CHINESE = re.compile(r"[ऀ-ॣ]"), re.compile(r"[㐀-鿿]")


def language(text: str, said: list[str]) -> tuple[str, float]:
    """The likeliest language of a text with words `said` and how far it is ahead of the next; ("", 0) if nothing tells.

    Script first, then function words and letters.
    """
    if not text.isascii():
        han, hindi = len(_CHINESE.findall(text)), len(_DEVANAGARI.findall(text))
        latin = len(text) - han - hindi
        if han * 3 > latin and han >= 3:
            return "zh", float(han)
        if hindi * 2 > latin and hindi >= 3:
            return "hi", float(hindi)
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in said:
        hit = _OF.get(w, ())
        for lang in hit:
            score[lang] += 1.0 / len(hit)
    if not text.isascii():
        for ch in set(text.lower()) & _LETTERS.keys():
            score[_LETTERS[ch]] += 1.0
    best, second = sorted(score.items(), key=lambda x: -x[1])[:2]
    return (best[0], best[1] - second[1]) if best[1] > second[1] else ("", 0.0)


def other_language(asked: tuple[str, float], answer: str, said: list[str]) -> bool:
    """The question's language `asked` and that of the answer are both clear, and not the same. A few words show none."""
    if not asked[0] or asked[1] < 1.0 or (len(said) < 5 and not _SCRIPTS.search(answer)):
        return False
    own = _SETS.get(asked[0])
    if own and len(said) >= 5 and sum(w in own for w in said) * 3 >= len(said) and not _SCRIPTS.search(answer):
        return False
    there, sure = language(answer, said)
    return sure >= (4 if there in ("zh", "hi") else 1.5) and asked[0] != there


@lru_cache(100_000)
def question_of(text: str) -> tuple[list[str], tuple[str, float]]:
    """The words and the language of a question."""
    said = words(text)
    return said, language(text, said)


# ---------------------------------------------------------------- truncation

_CLOSES = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“", "）": "（", "」": "「", "】": "【"}
_OPENS = frozenset(_CLOSES.values())
_TOKENS = re.compile(r"```|\*\*(?=\S)|(?<=\S)\*\*|(?<![\w`])`(?=\S)|(?<=\S)`(?!`)|</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>|(?<!\d)\"|\d\"|[()\[\]{}«»“”（）「」【】]")
_ITEM = re.compile(r"\n[ \t]*[-*•][ \t]*$|(?:^|\n)[ \t]*\d+[.)] [^\n]+\n(?s:.*)\n?[ \t]*\d+[.)][ \t]*$")
_NAME = re.compile(r"[A-Za-z][\w-]*")
#: Tags without content, and tags whose end may be left out.
_ENDLESS = frozenset("area base br col embed hr img input link meta param source track wbr p li dt dd option optgroup tr td th thead tbody tfoot colgroup caption rt rp".split())


def left_open(answer: str) -> bool:
    """Pushdown parser over fences, inline code, brackets, quotations, emphasis, markup and lists: true if something opened is never closed.

    Whatever is closed without having been opened (a list's `1)`, an apostrophe) is ignored. A bracket inside another one is still open when the
    outer one is closed; quotations, emphasis and tags end with what they stand in. In a fence or inline code only its own end
    counts; a double quote behind a digit ends a quotation or stands for inches; tags that need no end open nothing. A
    list that ends with an item's mark is open too.
    """
    stack: list[str] = []

    def close(mark: str, keep: bool) -> bool:
        """Take the last `mark` from the stack, and what was opened since, but for brackets if these are kept."""
        if mark not in stack:
            return False
        at = len(stack) - 1 - stack[::-1].index(mark)
        stack[at:] = [x for x in stack[at + 1 :] if keep and x in _OPENS]
        return True

    for found in _TOKENS.finditer(answer):
        m, at = found[0], found.start()
        if stack and stack[-1] in ("```", "`"):
            if m == stack[-1]:
                stack.pop()
        elif m == "`":
            # behind a letter it opens nothing
            if not (at and answer[at - 1].isalnum()):
                stack.append(m)
        elif m == "```" or m in _OPENS:
            stack.append(m)
        elif m == "**" or m == '"':
            if not close(m, False):
                stack.append(m)
        elif m[-1] == '"':
            close('"', False)
        elif m in _CLOSES:
            close(_CLOSES[m], True)
        elif not m.endswith("/>"):
            name = _NAME.search(m)[0].lower()
            if m.startswith("</"):
                close("<" + name, False)
            elif name not in _ENDLESS:
                stack.append("<" + name)
    return bool(stack) or bool(_ITEM.search(answer))


#: Words with which no sentence of these languages ends.
DANGLING = frozenset(
    "the a an of and or to for with because which that if than as by from "
    "el los las un una de del y que porque para con "
    "le les des du et qui que parce pour avec "
    "der das den dem ein eine und weil dass daß mit für "
    "os um uma do da dos das e porque com".split()
)
ORDERS = (5, 4, 3, 2)
#: How often a context of each order must have been seen elsewhere for its share of ends to be known (a shorter one says less); below which share of them it is
#: no end of a sentence. These are numbers of sightings, not parts of the corpus: how sure a share is does not depend on how much else is there.
SEEN, ENDS = {5: 8, 4: 12, 3: 25, 2: 60}, 0.03
#: The same for an answer with a full stop of its own, which is better evidence than rare words.
SEEN_STOPPED, ENDS_STOPPED = 500, 0.002
#: A last word is a piece if longer words beginning with it stood there PIECES times, and itself in less than PIECE_SHARE of these.
PIECES, PIECE_SHARE = 5, 0.02
_STOPPED = re.compile(r"(?:^|[^.!?。।…])[.!?。।][\s\"'»”)*]*$")


def contexts(items: list[str]) -> Iterator[tuple[str, bool]]:
    """(last words of the longest order, whether a sentence ends there) for each word of an answer's stream."""
    a = b = c = d = START
    last = len(items) - 1
    for i, w in enumerate(items):
        if w[0] in _STOP:
            a = b = c = d = START
            continue
        yield f"{a} {b} {c} {d} {w}", i == last or items[i + 1][0] in _STOP
        a, b, c, d = b, c, d, w


def stopped(answer: str) -> bool:
    """Ends with one full stop, question or exclamation mark (behind it quotes and brackets at most)."""
    return bool(_STOPPED.search(answer))


def last_context(items: list[str]) -> list[str | None]:
    """The last words in front of the end, by order.

    None for the shorter ones of a sentence that is no longer than they: without its start they say nothing about it as a whole.
    """
    end = len(items)
    while end and items[end - 1][0] in _STOP:
        end -= 1
    at = end
    while at and items[at - 1][0] not in _STOP:
        at -= 1
    if at == end:
        return [None] * len(ORDERS)
    run = [START] * (ORDERS[0] - 1) + items[at:end]
    return [" ".join(run[-n:]) if n == ORDERS[0] or end - at >= ORDERS[0] else None for n in ORDERS]


def dangles(items: list[str]) -> bool:
    """Four words or more, no full stop, and the last word can't be one."""
    return len(items) >= 4 and items[-1] in DANGLING


# ---------------------------------------------------------------- the operator

#: What can be told from one pair, in the order in which it is looked for. `truncated` may also come from the corpus.
DEFECTS = ("empty", "refusal", "copies_question", "other_language", "truncated")


def inspect(question: str, answer: str | None) -> tuple[str | None, bool, list[str | None]]:
    """(defect or None, whether the answer has a full stop, its last contexts). Contexts are given only without a defect."""
    none: list[str | None] = [None] * len(ORDERS)
    if says_nothing(answer, question):
        return "empty", False, none
    items = stream(answer)
    said = [w for w in items if w[0] not in _STOP]
    if refuses(answer):
        return "refusal", False, none
    asked, language_asked = question_of(question)
    if copies_question(asked, said):
        return "copies_question", False, none
    if other_language(language_asked, answer, said):
        return "other_language", False, none
    if left_open(answer) or dangles(items) or stops_in_question(asked, said):
        return "truncated", False, none
    return None, stopped(answer), last_context(items)


#: Contexts that a task holds before it hands on what it has counted.
HELD = 200_000


def _count_contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list[int]] = {}

    def out() -> pd.DataFrame:
        frame = pd.DataFrame([(k, n, e) for k, (n, e) in held.items()], columns=["context", "n", "ends"])
        held.clear()
        return frame

    for part in parts:
        for answer in part["answer"]:
            if answer:
                for context, end in contexts(stream(answer)):
                    counts = held.get(context)
                    if counts is None:
                        held[context] = [1, int(end)]
                    else:
                        counts[0] += 1
                        counts[1] += end
                if len(held) > HELD:
                    yield out()
    yield out()


def _inspect_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for key, question, answer in zip(part["sample_id"], part["question"], part["answer"]):
            defect, stop, last = inspect(question or "", answer)
            if defect or last[0]:
                rows.append((key, defect, stop, *last))
        yield pd.DataFrame(rows, columns=["sample_id", "defect", "stopped", *[f"c{n}" for n in ORDERS]])


def question_texts() -> Column:
    """The text of the user's messages; empty without any."""
    asked = F.filter("messages", lambda m: F.lower(m["role"]) == "user")
    texts = F.flatten(F.transform(asked, lambda m: F.transform(F.filter(m["content"], lambda p: p["text"].isNotNull()), lambda p: p["text"])))
    return F.coalesce(F.array_join(texts, " "), F.lit(""))


def question_answer(manifest: DataFrame) -> DataFrame:
    """sample_id, question, answer of each record that is no classification; the question is the text of the user's messages."""
    rows = first_deliveries(manifest, task=name_key("task_type"), question=question_texts(), answer=F.col("target.answer_text"))
    return rows.where("task <> 'classification'").drop("task")


def distinct_answers(pairs: DataFrame) -> DataFrame:
    """answer: that of each distinct question and answer, whatever their case and spaces, so that copies of a pair count once in the corpus."""
    pair = F.sha2(F.concat(name_key("question"), F.lit("\0"), name_key("answer")), 256)
    return pairs.where("answer IS NOT NULL").groupBy(F.unhex(pair).alias("_pair")).agg(F.min("answer").alias("answer")).select("answer")


def context_counts(answers: DataFrame) -> DataFrame:
    """context, n, ends over `answers`, for every order. Tasks count before they shuffle, and shorter contexts are summed from the longest."""
    longest = answers.mapInPandas(_count_contexts, "context string, n bigint, ends bigint").groupBy("context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    shorter = [F.substring_index("context", " ", -n) for n in ORDERS]
    return longest.select(F.explode(F.array(*shorter)).alias("context"), "n", "ends").groupBy("context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def _parts(context: str) -> tuple[Column, Column]:
    """What stands before the last word of a context, and that word."""
    word = F.substring_index(context, " ", -1)
    return F.substring(F.col(context), F.lit(1), F.length(context) - F.length(word)), word


def beginnings(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """context, longer: for contexts whose last word is the beginning of a longer word, how often such a word stood there. Only words behind the heads of wanted contexts are looked at."""
    head, word = _parts("context")
    heads = wanted.select(head.alias("_head")).distinct()
    rows = counts.select(word.alias("_w"), head.alias("_head"), "n").where("length(_w) > 1").join(heads, "_head", "left_semi")
    starts = F.transform(F.sequence(F.lit(1), F.length("_w") - 1), lambda i: F.concat(F.col("_head"), F.substring(F.col("_w"), F.lit(1), i)))
    return rows.select(F.explode(starts).alias("context"), "n").groupBy("context").agg(F.sum("n").alias("longer"))


def broken_off(last: DataFrame, counts: DataFrame) -> DataFrame:
    """`last` (stopped, c5 ... c2; distinct) of the answers that the corpus says break off, out of context_counts.

    Each row gives its contexts with their order; these are joined once with what was counted, and gathered again.
    """
    rows = last.withColumn("_id", F.xxhash64("stopped", *[f"c{n}" for n in ORDERS]))
    asked = rows.select("_id", "stopped", F.explode(F.array(*[F.struct(F.lit(n).alias("order"), F.col(f"c{n}").alias("context")) for n in ORDERS])).alias("x")).select("_id", "stopped", "x.order", "x.context").where("context IS NOT NULL")
    wanted = asked.select("context").distinct()
    seen = counts.select("context", "n", "ends", F.lit(0).cast("bigint").alias("longer"))
    known = seen.unionByName(beginnings(counts, wanted).select("context", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("ends"), "longer")).join(wanted, "context", "left_semi")
    known = known.groupBy("context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("longer").alias("longer"))
    told = asked.join(known, "context").withColumns({"n": F.col("n") - 1, "ends": F.col("ends") - 1})
    enough = F.when(F.col("stopped"), F.col("n") >= SEEN_STOPPED)
    for n in ORDERS:
        enough = enough.when(F.col("order") == n, F.col("n") >= SEEN[n])
    few = F.col("ends") < F.when(F.col("stopped"), ENDS_STOPPED).otherwise(ENDS) * F.col("n")
    piece = (F.col("longer") >= PIECES) & (F.greatest(F.col("n"), F.lit(0)) <= PIECE_SHARE * F.col("longer"))
    # the longest context seen often enough decides whether a sentence ends there
    verdict = told.groupBy("_id").agg(F.max(F.when(enough, F.struct("order", few.alias("few")))).alias("decides"), F.bool_or(piece).alias("piece"))
    return rows.join(verdict.where("coalesce(decides.few, false) OR piece").select("_id"), "_id", "left_semi").drop("_id")


def defective_pairs(manifest: DataFrame) -> DataFrame:
    """(sample_id, defect) of the records whose question and answer don't form a usable pair, one defect each (the first of DEFECTS).

    A null, blank or meaningless answer is `empty`; a null question copies nothing and has no language. An answer is
    `truncated` if it leaves a bracket, quotation, fence, emphasis or tag open, dangles, or if the corpus says so of its last words: they
    are seen elsewhere and sentences don't end with them, or the last one is the beginning of longer words seen there.
    Elsewhere means in other pairs: copies of one question and answer are one of them, and take their verdict together.
    """
    pairs = cut_lineage(question_answer(manifest))
    found = cut_lineage(pairs.mapInPandas(_inspect_rows, "sample_id string, defect string, stopped boolean, " + ", ".join(f"c{n} string" for n in ORDERS)))
    told = found.where("defect IS NOT NULL").select("sample_id", "defect")
    open_ = found.where("defect IS NULL")
    last = open_.select("stopped", *[f"c{n}" for n in ORDERS]).distinct()
    broken = broken_off(last, cut_lineage(context_counts(distinct_answers(pairs))))
    keys = [F.col("a.stopped") == F.col("b.stopped"), *[F.col(f"a.c{n}").eqNullSafe(F.col(f"b.c{n}")) for n in ORDERS]]
    condition = keys[0]
    for k in keys[1:]:
        condition = condition & k
    cut = open_.alias("a").join(broken.alias("b"), condition, "left_semi").select("sample_id", F.lit("truncated").alias("defect"))
    return told.unionByName(cut)
