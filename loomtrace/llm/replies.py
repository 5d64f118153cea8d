"""Problem 4: prompt and response pairs with a defect, by tagging the clauses of each answer.

A linear-chain conditional random field tags every clause as answer, refusal, echo, foreign or unfinished; the share of
the answer that each tag covers makes the pair's defect. Its features are hashed words, pairs of words and word beginnings
of the clause that the question doesn't have, and measurements: where the clause stands and how it ends, what it shares
with the question and the prompt, its language against the one expected, what `finish_reason` and `parsed` say.

The field is trained here, with numpy, on at most TRAIN_REPLIES replies of at most TRAIN_CHARS characters, chosen by a hash
of their key, so the choice does not depend on the order of rows. Labels come from distant evidence (wordings of
refusals, which are labels only and no features; `finish_reason`; objects that aren't closed) and from corruptions whose
labels are known by how they were made: an answer cut off, the question or a refusal in its place, the question before it, an
answer in another language. Everything else covers all rows: a reply is tagged where it is read, and only (key, defect) is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import is_shown

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: Bounds of the training sample: replies, and characters of prompt and content together. Rounds over it.
TRAIN_REPLIES, TRAIN_CHARS, ROUNDS = 3000, 8000, 80
#: Hashed features.
BITS = 16
#: Shares of an answer's characters from which a tag makes a defect.
ECHO_SHARE, REFUSAL_SHARE, FOREIGN_SHARE = 0.85, 0.4, 0.5

# Common words by language, instructions about the language, and wordings of refusals.
WORDS = {
    "en": "the of and to is are was were in on for from with by at it its that this be has have not an or as when which who how what why each every after before than then them they if only there less more and you your we our i my can will would about into".split(),
    "de": "der die das den dem des ein eine einen einem einer und ist sind war wird werden nicht mit von zu zum zur im am auf für bei nach aus als auch sich sie er es wie wer was wann warum hat haben oder wenn nur noch über unter jeder jedem seit dort ohne man weil durch ältere diese dieser dafür solche solchen".split(),
    "fr": "le la les des du un une et est sont était ont été a dans sur pour par avec de d l en au aux que qui ne pas plus ce cette ces se son sa ses il elle on nous vous leur à où comme quand depuis jamais sans mais ou cet y soit moins elles".split(),
    "es": "el la los las un una unos unas y es son fue ha han de del al en por para con que no se su sus lo le les este esta estos como cuando desde hasta nunca sin pero o más menos ya cada allí solo hay qué quién dónde cómo va".split(),
    "it": "il lo la i gli le un una uno e è sono era ha hanno di del della dei delle al alla ai nel nella sul sulla per con che non si suo sua questo questa come quando da dal anche ma o più tutti l ancora di queste".split(),
    "pt": "o a os as um uma e é são foi há de do da dos das em no na nos nas por para com que não se seu sua este esta como quando desde até mas ou mais já ao à pelo pela todos ainda está essas".split(),
    "nl": "de het een en is zijn was waren van in op voor met door aan bij te ten dat die dit niet er ze zij hij wij ook als wanneer maar of meer nog naar uit over worden wordt alle zulke vorig zonder".split(),
    "sv": "och att det som en ett är på av för med till den inte har de om vid från kan ska var vi när också efter alla utan".split(),
    "pl": "i w na z do nie się jest są to że od po dla przez o za jak ale lub oraz przy roku wszystkich który która które tego tej bez takie cena stronie nadal jeszcze".split(),
    "tr": "ve bir bu da de için ile olarak olan daha çok gibi her ne kadar sonra değil".split(),
}
ASKED = {
    "en": r"\b(?:in|into) english\b|auf englisch|ins englische|en anglais|en inglés|al inglés|in inglese|em inglês|in het engels",
    "de": r"\b(?:in|into) german\b|auf deutsch|ins deutsche|en allemand|en alemán|al alemán|in tedesco",
    "fr": r"\b(?:in|into) french\b|auf französisch|ins französische|en français|en francés|al francés|in francese",
    "es": r"\b(?:in|into) spanish\b|auf spanisch|ins spanische|en espagnol|en español|al español|in spagnolo",
    "it": r"\b(?:in|into) italian\b|auf italienisch|en italien|en italiano",
    "pt": r"\b(?:in|into) portuguese\b|auf portugiesisch|en portugais|en portugués",
    "nl": r"\b(?:in|into) dutch\b|auf niederländisch|en néerlandais|en neerlandés|en holandés",
    "pl": r"\b(?:in|into) polish\b|auf polnisch|en polonais|en polaco",
    "ru": r"\b(?:in|into) russian\b|auf russisch|en russe|en ruso",
    "ja": r"\b(?:in|into) japanese\b|auf japanisch|en japonais|en japonés",
    "zh": r"\b(?:in|into) chinese\b|auf chinesisch|en chinois|en chino",
}
ASKS = r"\b(?:answer|reply|respond|write|give|translate|say)\b|\b(?:antworte|antworten|schreibe?|gib|übersetze)\b|\b(?:réponds|répondez|répondre|écris|écrivez|donne|traduis)\b|\b(?:responde|responda|conteste|contesta|escribe|escriba|traduce)\b"
REFUSES = (
    r"\b(?:i|we)(?: a?m| are)?\s*(?:sorry,? (?:but )?(?:i|we) )?(?:can(?:not|['’]t| not)|could(?: not|n['’]t)|won['’]t|will not|wouldn['’]t|am not able to|['’]m not able to|are not able to|am unable to|['’]m unable to|must not|may not|do not want to|don['’]t want to|refuse to|have to (?:decline|refuse)|must (?:decline|refuse)|decline to|am not (?:allowed|permitted)|['’]m not (?:allowed|permitted)|['’]d rather not|would rather not|['’]d prefer not|would prefer not|prefer not to|am going to pass|['’]m going to pass|will pass|do(?: not|n['’]t) feel comfortable|am not comfortable|['’]m not comfortable)\b(?! (?:see|find|tell from|read|yet))",
    r"\b(?:is|are) not something (?:i|we) (?:can|could|may|will)\b", r"\boutside (?:of )?what (?:i|we) (?:am|are|may|can)\b|\bbeyond what (?:i|we) (?:may|can|am)\b", r"\bmy (?:instructions|guidelines|rules|policy|policies) (?:do not|don['’]t|forbid|prevent|prohibit)\b", r"\b(?:it would be|that would be) (?:inappropriate|wrong|irresponsible) for me\b", r"\bas an? (?:ai|assistant|language model)\b.{0,40}\b(?:can(?:not|['’]t)|must|have to|not)\b", r"\bfind that out without me\b|\bhave to do (?:that|this|it) without me\b", r"\b(?:may|might|could) go against (?:the|my) (?:guidelines|rules|policy)\b", r"\bi (?:apologi[sz]e|regret),? (?:but )?(?:i|that i)\b",
    r"\b(?:ich|wir) (?:kann|darf|möchte|werde|muss|können|dürfen)\b.{0,60}\b(?:nicht|ablehnen|leider)\b|\b(?:kann|darf|möchte|werde|muss) ich\b.{0,60}\b(?:nicht|ablehnen)\b|\b(?:dabei|damit|hierbei) kann ich (?:\w+ )?nicht\b|\bmuss ich\b.{0,50}\bablehnen\b",
    r"\bje (?:ne|n['’]).{0,40}\b(?:peux|puis|suis|veux|souhaite|saurais)\b.{0,30}\bpas\b|\bje (?:dois|préfère|regrette|me vois).{0,40}\b(?:refuser|décliner|ne pas)\b|\bje ne (?:peux|puis|suis)\b", r"\bno (?:puedo|podemos|me es posible|se me permite|estoy autorizad[oa]|debo|quiero|voy a)\b|\btengo que (?:rechazar|negarme|declinar)\b|\bdebo (?:rechazar|negarme|declinar)\b|\bprefiero no\b|\bme niego\b",
    r"\bnon posso\b|\bnão posso\b|\bik kan (?:hier|daar|u|je)?.{0,20}niet\b",
)
#: First-person sentences about what was looked up, and reports of what others say, only look like refusals.
REPORTS = r"\b(?:the|this|that) (?:office|page|shop|site|museum|library|council|notice|sign|help page|article|clerk)\b.{0,30}\b(?:says?|states?|declines?|refuses?|cannot|can['’]t)\b|\bis what the page\b|\bsorry to (?:report|say)\b|\b(?:can(?:not|['’]t)|could(?: not|n['’]t)) (?:see|find|read)\b"
COURTESY = r"^(?:sorry|i['’]m sorry|i apologi[sz]e|my apologies|thanks|thank you|unfortunately|regrettably|that is a good question|is there anything else|please (?:try|ask)|after some thought|tut mir leid|leider|désolée?|lo siento|perdón|as an? (?:ai|assistant))\b"

_REFUSES = re.compile("|".join(REFUSES), re.I)
_REPORTS = re.compile(REPORTS, re.I)
_COURTESY = re.compile(COURTESY, re.I)
_ASKS = re.compile(ASKS, re.I)
_ASKED = {k: re.compile(v, re.I) for k, v in ASKED.items()}
_OF = {k: frozenset(v) for k, v in WORDS.items()}
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_PLAIN = re.compile(r"[\W_]+")
_LEAD = re.compile(r"^\s*(?:q|question|you asked|frage|sie fragten|vous avez demandé|usted preguntó|pregunta|ha preguntado|prompt|task|user)\s*:\s*", re.I)
_CLAUSE = re.compile(r"(?<=[.!?…。！？])[\"”»’)]*\s+|(?<=[。！？])(?=\S)|\n+|(?<=[”\"»]) [–—-] ")
_END = re.compile(r"[.!?…。！？][\"”»’')\]]*$|[\"”»]$")
_TASK = re.compile(r"^\s*TASK:\s*\n(.*?)(?:\n\s*\n[A-Z][A-Z ]+:|\Z)", re.S)
_ITEM = re.compile(r"(?:\d+[.)]|[-*•])\s+\S")
_LISTED = re.compile(r"(?:^|\n)\s*(?:\d+[.)]|[-*•])\s*$")
_TAILS = frozenset("and or but the a an of to in with for because which that und oder der die das ein eine mit von weil dass et ou le la les de des du un une avec parce que qui y o el los las del con porque un una para".split())


def question_of(prompt: str | None) -> str:
    """What a prompt asks: the task of a prompt with page text around it, or all of a bare one."""
    m = _TASK.match(prompt or "")
    return (m.group(1) if m else prompt or "").strip()


def plain(text: str) -> str:
    return _PLAIN.sub(" ", text.casefold()).strip()


def script_of(text: str) -> str | None:
    """The language of a text by its script, None for Latin letters."""
    counts: dict[str, int] = {}
    for c in text:
        if c > "ʯ" and c.isalpha():
            k = next((k for k, lo, hi in _SCRIPTS if lo <= c <= hi), "x")
            counts[k] = counts.get(k, 0) + 1
    if not counts or sum(counts.values()) < 0.3 * sum(c.isalpha() for c in text):
        return None
    best = max(counts, key=counts.get)
    return None if best == "x" else "ja" if counts.get("ja") else best


_SCRIPTS = (("ja", "\u3040", "\u30ff"), ("zh", "\u4e00", "\u9fff"), ("ru", "\u0400", "\u04ff"), ("ko", "\uac00", "\ud7af"), ("ar", "\u0600", "\u06ff"), ("he", "\u0590", "\u05ff"), ("th", "\u0e00", "\u0e7f"), ("hi", "\u0900", "\u097f"), ("el", "\u0370", "\u03ff"))
_MARKS = (("de", "ßäöü"), ("es", "ñ"), ("pt", "ãõ"), ("pl", "łąęśźżńć"), ("sv", "å"), ("tr", "ığş"))
#: word: {language: weight}, learned from the sample; set where tagging runs.
_LEARNED: dict[str, dict[str, float]] = {}


def lower_words(text: str) -> list[str]:
    """The words that aren't names: those without a capital, and the first."""
    words = _WORD.findall(text)
    return [w.lower() for k, w in enumerate(words) if k == 0 or not w[0].isupper()]


def common_words(words: list[str]) -> tuple[str | None, float]:
    """(language, lead over the next) by common words and letters."""
    score = {k: float(sum(w in v for w in words)) for k, v in _OF.items()}
    for k, marks in _MARKS:
        score[k] += sum(any(m in w for m in marks) for w in words) * (1.5 if k in ("pl", "tr", "pt") else 0.5)
    ranked = sorted(score.items(), key=lambda x: -x[1])
    return (ranked[0][0], ranked[0][1] - ranked[1][1]) if ranked[0][1] else (None, 0)


def learn_words(texts: list[str], again: bool = False) -> dict[str, dict[str, float]]:
    """Weights of the words seen in sentences whose language their common words, or again the words learned, make sure."""
    counts: dict[str, dict[str, int]] = {}
    total: dict[str, int] = {}
    for t in texts:
        words = lower_words(t)
        lang, lead = (_language_of(t), len(words)) if again else common_words(words)
        if script_of(t) is None and lang and lead >= 2 and lead >= 0.15 * len(words):
            for w in set(words):
                counts.setdefault(w, {})[lang] = counts.get(w, {}).get(lang, 0) + 1
            total[lang] = total.get(lang, 0) + 1
    out = {}
    for w, by in counts.items():
        rate = {k: n / total[k] for k, n in by.items()}
        whole = sum(rate.values())
        if sum(by.values()) >= 2:
            out[w] = {k: r / whole for k, r in rate.items() if r / whole > 0.2}
    return out


def language_of(text: str) -> str | None:
    """The language a text shows, None if it shows none: by script, by common words, by the words learned from the sample.
    Kept for the worker for texts of ordinary length: 100,000 of at most 400 characters."""
    if len(text) > 400:
        return _language_of(text)
    if text not in _languages:
        if len(_languages) >= 100_000:
            _languages.clear()
        _languages[text] = _language_of(text)
    return _languages[text]


_languages: dict[str, str | None] = {}


def _weights() -> dict[str, dict[str, float]]:
    """word: {language: weight} of the learned and the common words together, made once for what has been learned."""
    if _WEIGHED.get("of") != id(_LEARNED) + len(_LEARNED):
        out = {w: dict(v) for w, v in _LEARNED.items()}
        for k, v in _OF.items():
            for w in v:
                by = out.setdefault(w, {})
                by[k] = by.get(k, 0) + 0.5
        _WEIGHED.update(of=id(_LEARNED) + len(_LEARNED), words=out)
    return _WEIGHED["words"]


_WEIGHED: dict = {}


def _language_of(text: str) -> str | None:
    script = None if text.isascii() else script_of(text)
    if script:
        return script
    words = lower_words(text)
    if len(words) < 3:
        return None
    score: dict[str, float] = {}
    if "¿" in text or "¡" in text:
        score["es"] = 1.5
    weights = _weights()
    for w in words:
        for k, v in weights.get(w, {}).items():
            score[k] = score.get(k, 0) + v
    if not text.isascii():
        low = text.lower()
        for k, marks in _MARKS:
            if any(m in low for m in marks):
                n = sum(any(m in w for m in marks) for w in words) * (1.5 if k in ("pl", "tr", "pt") else 0.3)
                score[k] = score.get(k, 0) + n
    ranked = sorted(score.values(), reverse=True)
    if not ranked:
        return None
    lead = ranked[0] - (ranked[1] if len(ranked) > 1 else 0)
    return max(score, key=score.get) if ranked[0] >= 1 and lead >= 0.4 else None


def expected_language(question: str) -> str | None:
    """The language the answer should have: one asked for, or that of the question."""
    if _ASKS.search(question):
        for k, rx in _ASKED.items():
            m = rx.search(question)
            if m:
                return k
    return language_of(question)


def answer_of(content: str | None) -> tuple[str | None, bool]:
    """(the answer in a reply's content, whether the content breaks off by its form: an object that isn't closed)."""
    if content is None:
        return None, False
    s = content.strip()
    if s.startswith("```"):
        s = re.sub(r"\s*```\s*$", "", re.sub(r"^```\w*\s*", "", s))
    if not s.startswith("{"):
        return content, False
    try:
        o = json.loads(s)
    except ValueError:
        m = re.search(r'"answer"\s*:\s*"', s)
        return (s[m.end() :] if m else ""), True
    a = o.get("answer") if isinstance(o, dict) else None
    return (a if isinstance(a, str) else None if a is None else json.dumps(a, ensure_ascii=False)), False


def clauses(text: str) -> list[str]:
    return [c for c in (x.strip() for x in _CLAUSE.split(text)) if c]


# Refusals that stand in the answer's place in corrupted pairs, by the language of the question.
EXAMPLES = {
    "en": ["I'm sorry, but I can't help with that.", "I cannot assist with this request.", "Sorry, I am not able to answer this question.", "I must decline to answer.", "As an AI assistant, I can't provide that information.", "I won't be able to do that for you.", "That is not something I can help with.", "This is beyond what I may do here.", "My guidelines do not allow me to comment on this.", "I'd rather not go into this.", "It would be inappropriate for me to answer that.", "Unfortunately, I have to refuse this request. Please try another question.", "Providing this is outside of what I am allowed to do."],
    "de": ["Dabei kann ich leider nicht helfen.", "Es tut mir leid, diese Frage darf ich nicht beantworten.", "Ich muss die Antwort ablehnen.", "Dazu möchte ich mich nicht äußern.", "Als Assistent kann ich diese Auskunft nicht geben.", "Das liegt außerhalb dessen, was ich tun darf."],
    "fr": ["Désolé, je ne peux pas vous aider sur ce point.", "Je ne suis pas autorisé à répondre à cette question.", "Je dois refuser de répondre.", "Je préfère ne pas me prononcer là-dessus.", "En tant qu'assistant, je ne peux pas fournir cette information.", "Cela dépasse ce que je peux faire."],
    "es": ["Lo siento, no puedo ayudar con eso.", "No estoy autorizado a responder a esta pregunta.", "Debo negarme a responder.", "Prefiero no hablar de este tema.", "Como asistente no puedo dar esa información.", "Eso queda fuera de lo que puedo hacer."],
}
#: Measurements of a clause; the first ids of the field. Hashed words come after them.
MEASURES = (
    "bias", "first", "last", "alone", "is_question", "is_echo", "echo_half", "in_prompt", "other_language", "own_language", "no_language", "ended", "open_end", "open_long", "broken_form", "tail_word", "open_list", "short", "short_alone", "number", "cut_by_length", "stopped", "filtered", "parsed_empty",
)
_M = {n: k for k, n in enumerate(MEASURES)}
MASK = (1 << BITS) - 1
_HASHES: dict[str, int] = {}


def _id(feature: str) -> int:
    k = _HASHES.get(feature)
    if k is None:
        k = zlib.crc32(feature.encode("utf-8", "replace")) & MASK
        k = k if k >= len(MEASURES) else k + len(MEASURES)
        if len(feature) <= 60:
            if len(_HASHES) >= 200_000:
                _HASHES.clear()
            _HASHES[feature] = k
    return k


class Clauses:
    """The clauses of one reply's answer: their texts, feature ids, and the measurements that hold for each."""

    __slots__ = ("parts", "ids", "echo")

    def __init__(self, parts: list[str], ids: list[list[int]], echo: bool) -> None:
        self.parts, self.ids, self.echo = parts, ids, echo

    def has(self, measure: str) -> np.ndarray:
        k = _M[measure]
        return np.array([k in x for x in self.ids], bool)


def features(parts: list[str], question: str, prompt: str, expected: str | None, broken: bool, raw: str, finish: str | None = None, parsed: dict | None = None) -> list[list[int]]:
    """The feature ids of each clause."""
    q, whole = plain(question), plain(prompt)
    asked = set(q.split())
    finish = (finish or "").strip().lower()
    out = []
    listed = bool(_LISTED.search(raw.rstrip(" ")))
    for i, p in enumerate(parts):
        c = plain(_LEAD.sub("", p))
        last = i == len(parts) - 1
        lang = language_of(p)
        words = c.split()
        ended = bool(_END.search(p))
        short = len(words) <= 3 and len(c) <= 24
        shared = sum(w in asked for w in words) / max(1, len(words))
        on = {
            "bias": True, "first": i == 0, "last": last, "alone": len(parts) == 1, "is_question": p.rstrip("”\"» ").endswith("?"), "is_echo": len(c) >= 8 and (c == q or c in q and len(c) >= 0.6 * len(q) or q in c and len(q) >= 0.8 * len(c)),
            "echo_half": shared >= 0.6 and len(words) >= 4, "in_prompt": len(c) >= 12 and c in whole, "other_language": lang is not None and expected is not None and lang != expected, "own_language": lang is not None and lang == expected, "no_language": lang is None, "ended": last and ended and not listed,
            "open_end": last and not ended and not _ITEM.match(p), "open_long": last and not ended and (len(words) >= 4 or len(parts) > 1) and not _ITEM.match(p), "broken_form": last and broken, "tail_word": last and not ended and bool(words) and words[-1] in _TAILS, "open_list": last and listed,
            "short": short, "short_alone": short and len(parts) == 1, "number": _DIGIT.search(c) is not None, "cut_by_length": last and finish == "length", "stopped": last and finish == "stop", "filtered": finish == "content_filter", "parsed_empty": parsed is not None and not is_shown(dict(parsed).get("answer")),
        }
        ids = [_M[k] for k, v in on.items() if v]
        own = [w for w in words if w not in asked and not w.isdigit()]
        ids += {_id(w) for w in own} | {_id(f"{a} {b}") for a, b in zip(own, own[1:])} | {_id("^" + w[:5]) for w in own if len(w) > 5}
        out.append(ids)
    return out


def sequence(prompt: str | None, content: str | None, finish: str | None = None, parsed: dict | None = None) -> Clauses | None:
    """The clauses of a reply's answer; None if there is no answer with visible characters."""
    answer, broken = answer_of(content)
    if not is_shown(answer):
        return None
    question = question_of(prompt)
    parts = clauses(answer) or [answer.strip()]
    said, q = plain(_LEAD.sub("", " ".join(parts))), plain(question)
    copied = bool(said) and said in (q, plain(prompt or ""), f"{q} {q}")
    return Clauses(parts, features(parts, question, prompt or "", expected_language(question), broken, answer, finish, parsed), copied)


def distant_tags(s: Clauses, finish: str | None) -> np.ndarray | None:
    """Labels of a reply as it is, from evidence outside the field's features where there is some; None where evidence contradicts itself, and the reply is left out."""
    tags = np.where(s.has("other_language"), FOREIGN, ANSWER)
    refuses = np.array([bool(_REFUSES.search(p)) and not _REPORTS.search(p) for p in s.parts])
    tags[refuses] = REFUSAL
    if refuses.any():
        tags[[bool(_COURTESY.search(p)) for p in s.parts]] = REFUSAL
    elif (finish or "").strip().lower() == "content_filter":
        return None
    if s.echo:
        tags[:] = ECHO
        return tags
    tags[s.has("is_echo")] = ECHO
    open_, cut = s.has("open_long")[-1], (finish or "").strip().lower() == "length"
    if s.has("broken_form")[-1] or s.has("open_list")[-1] or open_ and cut:
        tags[-1] = UNFINISHED
    elif open_ and tags[-1] != REFUSAL:
        return None
    return tags


class Field:
    """A linear-chain conditional random field over clauses with sparse features, in numpy."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        k = len(TAGS)
        self.emit = np.zeros((MASK + 1 + len(MEASURES), k)) if emit is None else emit
        self.move = np.zeros((k, k)) if move is None else move

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """The score of each tag for each clause; every clause has at least its bias."""
        lengths = np.array([len(r) for r in rows])
        flat = np.fromiter((x for r in rows for x in r), np.int64, int(lengths.sum()))
        return np.add.reduceat(self.emit[flat], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)

    def fit(self, xs: list[list[list[int]]], ys: list[np.ndarray], rounds: int = ROUNDS, rate: float = 0.08, decay: float = 1e-4) -> Field:
        """Maximises the likelihood by Adam. Sequences are padded within groups of about one length, so a long answer pads no short one."""
        groups: dict[int, list[int]] = {}
        for i, x in enumerate(xs):
            groups.setdefault(len(x).bit_length(), []).append(i)
        packed = [_Padded([xs[i] for i in g], [ys[i] for i in g]) for g in groups.values()]
        state = [np.zeros_like(w) for w in (self.emit, self.move) for _ in range(2)]
        for t in range(1, rounds + 1):
            g_emit, g_move = np.zeros_like(self.emit), np.zeros_like(self.move)
            for p in packed:
                p.gradient(self, g_emit, g_move)
            for w, g, m, v in ((self.emit, g_emit, state[0], state[1]), (self.move, g_move, state[2], state[3])):
                g = g / len(xs) - decay * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return self

    def tag(self, sequences: list[list[list[int]]]) -> list[np.ndarray]:
        """The likeliest tags of each sequence (Viterbi), all of a batch at once, in groups of about one length."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(sequences)
        if not sequences:
            return out
        flat = self.scores([r for s in sequences for r in s])
        ends = np.cumsum([len(s) for s in sequences])
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(sequences):
            groups.setdefault(len(s).bit_length(), []).append(i)
        for g in groups.values():
            lengths = np.array([len(sequences[i]) for i in g])
            longest, n = int(lengths.max()), len(g)
            score = np.zeros((n, longest, len(TAGS)))
            for j, i in enumerate(g):
                score[j, : lengths[j]] = flat[ends[i] - lengths[j] : ends[i]]
            best, back = score[:, 0], np.zeros((n, longest, len(TAGS)), int)
            for j in range(1, longest):
                all_ = best[:, :, None] + self.move
                back[:, j] = all_.argmax(1)
                best = np.where((j < lengths)[:, None], all_.max(1) + score[:, j], best)
            at = best.argmax(1)
            path = np.zeros((n, longest), int)
            for j in range(longest - 1, -1, -1):
                path[:, j] = at
                at = np.where((j > 0) & (j < lengths), back[np.arange(n), j, at], at)
            for j, i in enumerate(g):
                out[i] = path[j, : lengths[j]]
        return out


class _Padded:
    """Labelled sequences of about one length in one array."""

    def __init__(self, xs: list[list[list[int]]], ys: list[np.ndarray]) -> None:
        n, longest, k = len(xs), max(map(len, xs)), len(TAGS)
        self.real = np.zeros((n, longest), bool)
        y = np.zeros((n, longest), int)
        for i, (a, b) in enumerate(zip(xs, ys)):
            self.real[i, : len(a)], y[i, : len(a)] = True, b
        rows = [r for x in xs for r in x]
        lengths = np.array([len(r) for r in rows])
        self.flat = np.fromiter((v for r in rows for v in r), np.int64, int(lengths.sum()))
        self.starts, self.row = np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.repeat(np.arange(len(rows)), lengths)
        self.used, self.at = np.unique(self.flat, return_inverse=True)
        self.hot = np.eye(k)[y] * self.real[..., None]
        self.pairs = self.real[:, 1:]
        self.seen = (self.hot[:, :-1, :, None] * self.hot[:, 1:, None, :] * self.pairs[..., None, None]).sum((0, 1))

    def gradient(self, f: Field, g_emit: np.ndarray, g_move: np.ndarray) -> None:
        """Adds the gradient of the log likelihood."""
        (n, length), k, real = self.real.shape, len(TAGS), self.real
        score = np.zeros((n, length, k))
        score[real] = np.add.reduceat(f.emit[self.flat], self.starts, axis=0)
        alpha, beta = np.zeros((n, length, k)), np.zeros((n, length, k))
        alpha[:, 0] = score[:, 0]
        for j in range(1, length):
            alpha[:, j] = np.where(real[:, j, None], _logsum(alpha[:, j - 1, :, None] + f.move, 1) + score[:, j], alpha[:, j - 1])
        for j in range(length - 2, -1, -1):
            beta[:, j] = np.where(real[:, j + 1, None], _logsum(f.move[None] + (score[:, j + 1] + beta[:, j + 1])[:, None, :], 2), 0)
        z = _logsum(alpha[:, -1], 1)
        unary = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        slope = (self.hot - unary)[real]
        for t in range(k):
            g_emit[self.used, t] += np.bincount(self.at, slope[self.row, t], len(self.used))
        if length > 1:
            joint = np.exp(np.minimum(alpha[:, :-1, :, None] + f.move + (score + beta)[:, 1:, None, :] - z[:, None, None, None], 0)) * self.pairs[..., None, None]
            g_move += self.seen - joint.sum((0, 1))


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


Sample = list[tuple[str | None, str | None, str | None, dict | None]]
_TRAINED: dict[str, tuple[Field, dict]] = {}


def trained(sample: Sample, seed: int = 7) -> Field:
    """A field fitted to a sample of (prompt, content, finish_reason, parsed) and to corruptions of it. What was fitted to the same sample before is taken as it is."""
    key = hashlib.sha256(repr((seed, sample)).encode("utf-8", "replace")).hexdigest()
    if key not in _TRAINED:
        _TRAINED.clear()
        field = _train(sample, random.Random(seed))
        _TRAINED[key] = (field, dict(_LEARNED))
    field, learned = _TRAINED[key]
    _learn(learned)
    return field


def _learn(words: dict) -> None:
    _LEARNED.clear()
    _LEARNED.update(words)
    _languages.clear()
    _WEIGHED.clear()


def _train(sample: Sample, rng: random.Random) -> Field:
    _learn({})
    texts = [c for p, a, _, _ in sample for t in (question_of(p), answer_of(a)[0]) if t for c in clauses(t)]
    for again in (False, True):
        _learn(learn_words(texts, again))
    xs, ys, sound, refused = [], [], [], []

    def add(s: Clauses | None, tags) -> None:
        if s is not None:
            xs.append(s.ids)
            ys.append(tags(s) if callable(tags) else np.full(len(s.ids), tags))

    for prompt, content, finish, parsed in sample:
        s = sequence(prompt, content, finish, parsed)
        tags = None if s is None else distant_tags(s, finish)
        if tags is not None:
            add(s, lambda _: tags)
            if (tags == ANSWER).all():
                sound.append((prompt, " ".join(s.parts), finish))
            elif (tags == REFUSAL).all():
                refused.append(" ".join(s.parts))
    whole = lambda last: lambda s: np.array([ANSWER] * (len(s.ids) - 1) + [last])
    for prompt, text, finish in sound[: max(1, len(sound) // 2)]:
        question = question_of(prompt)
        if len(text) > 30:
            cut = rng.randint(12, len(text) - 2)
            # cut within a word or between words, not at a sentence's end
            if not _END.search(text[:cut].rstrip()) and len(text[:cut].split()) >= 4:
                add(sequence(prompt, text[:cut], rng.choice(["length", "stop", None])), whole(UNFINISHED))
        if rng.random() < 0.2:
            add(sequence(prompt, f"{text}\n\n1. {' '.join(text.split()[:2])}\n2. ", rng.choice(["length", "stop", None])), whole(UNFINISHED))
        if refused and rng.random() < 0.2:
            add(sequence(prompt, rng.choice(refused), finish), REFUSAL)
        add(sequence(prompt, rng.choice(EXAMPLES.get(expected_language(question) or "en", EXAMPLES["en"])), finish), REFUSAL)
        add(sequence(prompt, rng.choice(["{}", "{}", "Q: {}", "You asked: {}", "{} {}"]).format(question, question), finish), ECHO)
        add(sequence(prompt, f"{question} {text}", finish), lambda s: np.where(s.has("is_echo") & (np.arange(len(s.ids)) == 0), ECHO, ANSWER))
        other, foreign, _ = rng.choice(sound)
        if expected_language(question_of(other)) not in (None, expected_language(question)):
            add(sequence(prompt, foreign, finish), lambda s: np.where(s.has("own_language"), ANSWER, FOREIGN))
    return Field().fit(xs, ys) if xs else Field()


def _defect(s: Clauses, tags: np.ndarray) -> str | None:
    """The defect that the tags' shares make. Copies come before breaks, breaks before refusals, refusals before languages."""
    size = np.array([len(p) for p in s.parts], float)
    # a clause without a word of the question or the prompt copies nothing
    tags = np.where((tags == ECHO) & ~(s.has("is_echo") | s.has("echo_half") | s.has("in_prompt")), ANSWER, tags)
    share = np.bincount(tags, size, len(TAGS)) / size.sum()
    if share[ECHO] >= ECHO_SHARE or s.echo:
        return "copied_question"
    if tags[-1] == UNFINISHED:
        return "truncated"
    if share[REFUSAL] >= REFUSAL_SHARE:
        return "refusal"
    if share[FOREIGN] >= FOREIGN_SHARE or share[FOREIGN] > 0 and share[ANSWER] == 0:
        return "wrong_language"
    return None


def pair_defects(field: Field, pairs: Sample) -> list[str | None]:
    """The defect of each (prompt, content, finish_reason, parsed), None for a proper pair."""
    read = [sequence(*p) for p in pairs]
    some = [s for s in read if s is not None]
    tags = iter(field.tag([s.ids for s in some]))
    return ["empty" if s is None else _defect(s, next(tags)) for s in read]


def defects(replies: DataFrame, sample_size: int = TRAIN_REPLIES) -> DataFrame:
    """reply_id, defect for each reply with one: empty, truncated, refusal, copied_question, wrong_language.

    Null contents and answers, blank ones and objects without an answer are empty; a null prompt has no language and
    nothing to copy; repeated deliveries count once. `finish_reason` and `parsed` are evidence among other, since they
    aren't always right. An empty table gives no rows; further columns are ignored.
    """
    once = replies.where("reply_id IS NOT NULL").select(F.col("reply_id").cast("bigint"), "prompt", "content", "finish_reason", "parsed")
    short = F.length("content") + F.length("prompt") <= TRAIN_CHARS
    sample = once.where(F.col("content").isNotNull() & F.col("prompt").isNotNull() & short).orderBy(F.xxhash64("reply_id"), "reply_id", F.md5("content")).limit(sample_size).collect()
    field = trained([(r["prompt"], r["content"], r["finish_reason"], r["parsed"]) for r in sample])
    used = np.flatnonzero(field.emit.any(1))
    model = replies.sparkSession.sparkContext.broadcast((used.astype(np.int32), field.emit[used].astype(np.float32), field.move, dict(_LEARNED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, move, learned = model.value
        f = Field(move=move)
        f.emit[at] = values
        _learn(learned)
        for b in batches:
            pairs = list(zip(*(b.column(n).to_pylist() for n in ("prompt", "content", "finish_reason", "parsed"))))
            got = pair_defects(f, pairs)
            yield pa.RecordBatch.from_arrays([b.column("reply_id"), pa.array(got, pa.string())], names=["reply_id", "defect"]).filter(pa.array([g is not None for g in got], pa.bool_()))

    return once.mapInArrow(run, "reply_id BIGINT, defect STRING").groupBy("reply_id").agg(F.min("defect").alias("defect"))
