"""Problem 3: template residue, filler, error pages and demands for scripts where real content should stand.

Method. Normalised lines are counted by host (the counts of problem 2) and the recurrent ones, the host's boilerplate,
are subtracted; the residual of a page is searched for evidence. Unfilled placeholders, their rendered leftovers and
filler count wherever they stand in the residual. Error messages and demands for scripts count by their share of what is
left of the page: the plain wordings from SHARE on, sentences that only speak of an error or of scripts from LOOSE_SHARE
on, on a page without a heading of its own, so that a small notice beside a full page, or a page about such things, doesn't. The rest is weighed without the lines
that problem 2 finds thin. Sentences that explain or quote placeholders carry words of explanation and don't count.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import is_shown
from loomtrace.llm.page_body import _TITLE_SEP, BROADCAST_ENTRIES, Codes, each_page, with_pages

#: A line on more than the second of page_body's LEVELS of its host's pages is boilerplate.
RECURRENT = 2
#: The share of a page's residual from which evidence of an error page or of a demand for scripts counts: plain wordings, and sentences that speak of it.
SHARE, LOOSE_SHARE = 0.1, 0.5

# Shapes of unfilled slots, phrases of errors and fillers.
_NAME = r"[A-Za-z][\w.]*"
_HTML = "a|abbr|address|article|aside|audio|b|base|blockquote|body|br|button|canvas|caption|cite|code|col|dd|del|details|div|dl|dt|em|embed|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|legend|li|link|main|map|meta|nav|noscript|object|ol|optgroup|option|p|param|picture|pre|q|s|samp|script|section|select|small|source|span|strong|style|sub|summary|sup|svg|table|tbody|td|template|textarea|tfoot|th|thead|time|title|tr|track|u|ul|var|video|wbr"
SLOTS = (
    rf"\{{\{{\s*{_NAME}", rf"[$#]\{{\s*{_NAME}\s*\}}", rf"\{{%\s*{_NAME}\s*%\}}", rf"\{{\s*{_NAME}\s*\}}", r"\{\d\}", rf"<!--\s*{_NAME}\s*-->", rf"<%=?\s*{_NAME}\s*%>",
    rf"%%{_NAME}%%", rf"%{_NAME}%", rf"(?<!\w)__{_NAME}?__(?!\w)", rf"@@{_NAME}@@", r"(?<![\w$])\$[A-Za-z][\w.]{2,}\$", rf"\[\[{_NAME}\]\]", r"\[\[[A-Z]+(?:[ _][A-Z]+)+\]\]", r"\[[A-Za-z_. ]+ HERE\]", r"\[[A-Z]+(?:_[A-Z]+)+\]", r"\[(?:insert|your) [^\]]*\]",
    rf"XX_{_NAME}?_XX", rf"%\({_NAME}\)[sdf]", r"(?<![\w%])%[sd]\b", r"<(?:insert|your|no) [^>]*>", rf"(?:<|&lt;)(?!(?:{_HTML})\b){_NAME}(?:>|&gt;)",
)
EXPLAINS = r"\b(?:writes?|use|used|form|works|described|engine|templates?|placeholders?|brackets?|python|yields?|printf|syntax|variables?|chapter|fixed|machine|envelope|rank|matrix|subsets?|branch|means?|stands? for|replaced by|example|function|behaviou?r|sum|rows|stops|columns?|test|reader|schreib\w*|verwend\w*|écri\w*|utilis\w*|escrib\w*|usar?)\b"
LEFTOVER = r"(?<![\w'\"“])(?:undefined|NaN|null|None)(?![\w'\"”])"
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim est laborum vestibulum gravida porta mollis aliquam tempora facilis magnum ornatum nihilum".split())
FILLER = (
    r"placeholder (?:copy|text|content)\b.*$", r"^sample text\.? (?:please )?replace\b", r"\breplace this (?:paragraph|text|sentence)\b", r"^(?:tbd[.\s]*)+$", r"\basdf\b.*\basdf\b|\bqwertz?y? qwert", r"^(?:x{3,}[\s.,]*){2,}$",
    r"\bblah[, ]+blah\b", r"\b(?-i:TODO):? (?:write|add|insert|fill|describe|translate|replace|text|content|error)\b", r"\b(?:your|insert) (?:text|title|content|description|name) here\b", r"^(?:coming soon|under construction|new page|untitled document|page title|add a title)[.!…]*$",
    r"^(?:hier steht|hier kommt) (?:ein )?(?:blindtext|beispieltext)|^dies ist ein blindtext|\bblindtext\b.*$", r"^texte? (?:d'exemple|de relleno|de ejemplo)\b", r"\bfoo bar baz\b", r"^(?:product name|item name|heading|headline|paragraph) \d+$",
    r"\b(?:goes|go|comes) here\b[.!]?$", r"^(?:please )?(?:enter|add|type|put|insert|write|describe) (?:a|an|your|some|the) [\w ,-]*\b(?:here|to this section|in this section|for this page)[.!]?$", r"\btexte provisoire\b|\btexte à remplacer\b|\b(?:platzhalter|muster|füll)text\b|\btexto (?:provisional|de muestra|de relleno)\b|\bcontenido pendiente\b|\bhier text (?:einfügen|eingeben)\b", r"\b(\w{3,})(?:\s+\1\b){3,}",
)
ERROR = (
    r"http status \d+(?:\s*[–:-].*)?|.*\(http \d{3}\)", r"(?:http )?(?:status|error|fehler|erreur|code)\s*[:#]?\s*\d{3}(?:\s*[–:-]?\s*[\w' ]*)?", r"\d{3}\s*[–:-]?\s*(?:internal server error|not found|forbidden|bad gateway|service unavailable|unauthori[sz]ed|bad request|gateway time-?out|not acceptable|too many requests|gone)",
    r"(?:internal server error|bad gateway|service unavailable|gateway time-?out)(?:\s*[–-].*)?", r"(?:page|seite|file) not found(?:\. .*)?|seite nicht gefunden|page (?:introuvable|non trouvée)|página no encontrada|404",
    r"access denied|access to this page (?:is|was) denied|forbidden|acceso denegado|accès refusé|zugriff verweigert", r"(?:oops|whoops|hoppla|oups|uy|vaya)\b.*", r"(?:sorry, )?something went wrong.*|(?:ha ocurrido|se ha producido) un error.*|une erreur (?:est survenue|s'est produite).*|ein fehler ist aufgetreten.*|etwas ist schiefgelaufen.*",
    r"service (?:is )?(?:temporarily |currently )?unavailable.*|service momentanément indisponible.*|(?:der )?dienst (?:ist )?(?:vorübergehend|derzeit) nicht verfügbar.*|servicio (?:temporalmente )?no disponible.*", r"(?:we are |we're )?temporarily offline.*|offline", r"we['’]ll be right back.*|(?:we are|we're) (?:currently )?down for maintenance.*|scheduled works are under way.*|under maintenance.*",
    r"this site can['’]t be reached.*|the connection was (?:reset|refused|interrupted).*|(?:database )?connection (?:failed|lost).*|host did not answer.*|(?:connection|request) timed out.*", r"(?:your )?session (?:has )?expired.*", r"this (?:listing|page|item|product) (?:is no longer available|has moved|was deleted|does not exist).*", r"not available in your (?:region|country).*", r"the (?:link|address) you followed is (?:broken|wrong).*",
    r"we are experiencing heavy traffic.*|you are number \d+ in the queue.*|too many requests.*", r"traceback \(most recent call last\):.*|unhandled exception.*|fatal error.*", r"(?:checking|verifying) your browser.*|verify (?:that )?you are (?:a )?human.*|are you a robot\??", r"you do not have permission.*", r"the server (?:met|encountered) an? (?:unexpected condition|error).*", r"(?:sorry, )?(?:we|you) could(?: not|n['’]t) (?:find|load).*", r"(?:the|this) (?:page|address|file|document|resource) (?:you (?:are looking for|were looking for|requested|asked for) )?(?:does not exist|could not be found|was not found|has been removed).*", r"(?:no|nothing) (?:results )?found here.*", r"(?:la|esta) página (?:solicitada )?no existe.*|(?:cette|la) page (?:demandée )?n'existe (?:pas|plus).*|(?:diese|die angeforderte) seite existiert nicht.*",
    r"<html\b.*(?:bad gateway|error|unavailable|not found|forbidden|denied).*", r"\[object object\]",
)
SCRIPTS = (
    r"(?:please )?(?:enable|activate|turn on|switch on|allow) (?:javascript|scripts?|js)\b.*", r"you need to enable javascript.*", r"(?:this|our) (?:site|page|website|app) (?:requires|needs) (?:javascript|scripts?|js)\b.*", r"(?:js|javascript|scripts?|scripting) (?:is |are )?(?:disabled|switched off|turned off|required|needed|off)\b.*", r"(?:your browser is not supported\.? ?)?scripting must be active.*", r"if nothing happens, javascript is switched off.*", r"(?:.* )?scripts and cookies have to be on.*",
    r"veuillez activer javascript.*|javascript est désactivé.*", r"active javascript.*|(?:por favor, )?(?:habilite|active) (?:el )?javascript.*", r"(?:bitte )?(?:aktivieren sie|schalten sie) javascript.*|javascript (?:muss|ist) (?:aktiviert|deaktiviert).*",
)
WEAK = r"query .* timed out|(?:please )?(?:try|load|reload)\b.*|(?:our team|we) (?:has been told|have been told).*|go back\b.*|vuelva a intentarlo.*|réessayez.*|versuchen sie es.*|loading…?\.*|just a moment…?\.*|incident .*|(?:request|ray) [\w-]+|this takes up to .*|\w*(?:error|exception): .*|do not reload\.?|error|fehler|erreur"

# what a sentence that only speaks of scripts, or of a failed request, has: a word of each group
LOOSE = (
    (r"\b(?:java\s?scripts?|scripts?|scripting|js|skripte?)\b", r"\b(?:enabl\w*|activ\w*|aktiv\w*|turn\w*|switch\w*|allow\w*|requir\w*|needs?|must|only|without|disabled|off|eingeschaltet\w*|einschalten|benötig\w*|nur|ohne|désactiv\w*|nécessaire|sans|requis|habilit\w*|desactivad\w*|necesi\w*|sin|blocked|blockiert)\b"),
    (r"\b[45]\d\d\b", r"\b(?:errors?|fehler|erreurs?|errores|http\S*|upstream|gateway|denied|refused|forbidden|unavailable|not found|timed? ?out|overload\w*|server|proxy|status|verweigert|refusé|denegado|indisponible|nicht (?:gefunden|verfügbar)|introuvable|no (?:encontrad\w*|disponible))\b"),
)

#: A sentence with none of these, and no number of three digits, matches none of the patterns for errors and scripts.
HINTS = (
    "http", "error", "erreur", "fehler", "exception", "gateway", "unavailable", "not found", "gefunden", "introuvable", "trouvée", "encontrada", "denied", "forbidden", "denegado", "refusé", "verweigert", "oops", "whoops", "hoppla", "oups", "vaya", "uy", "wrong", "schiefgelaufen", "survenue", "s'est produite", "offline",
    "indisponible", "verfügbar", "no disponible", "right back", "maintenance", "scheduled works", "reached", "connection", "did not answer", "timed out", "expired", "available", "has moved", "was deleted", "not exist", "broken", "traffic", "queue", "too many", "traceback", "your browser", "human", "robot", "permission", "the server",
    "could not", "couldn't", "couldn’t", "found here", "n'existe", "no existe", "existiert nicht", "[object object]", "script", "skript", "js", "the address", "the file", "the document", "the resource", "this file", "was not found", "been removed", "try", "load", "been told", "go back", "vuelva", "réessayez", "versuchen", "moment", "incident", "request", "ray ", "takes up", "upstream", "status", "server", "proxy", "overload",
)
FILLER_HINTS = ("placeholder", "sample text", "replace this", "tbd", "asdf", "qwert", "xxx", "blah", "todo", " here", "coming soon", "construction", "new page", "untitled", "page title", "add a title", "blindtext", "beispieltext", "texte d", "texto d", "foo bar", "product name", "item name", "heading", "headline", "paragraph", "section", "provisoire", "remplacer", "text", "pendiente", "for this page")


def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """All words sought at once, in one pass over a text."""
    a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for w in words:
        a.add_word(w)
    a.make_automaton()
    return a


def has_any(a: ahocorasick.Automaton, text: str) -> bool:
    return next(a.iter(text), None) is not None


_HINTED, _FILLER_HINTED = automaton(HINTS), automaton(FILLER_HINTS)
_SLOT = re.compile("|".join(SLOTS))
_SLOT_HINT = re.compile(r"[{%$<&@\[_]|XX_")
_EXPLAINS = re.compile(EXPLAINS, re.I)
_LEFT = re.compile(LEFTOVER)
_FILLER = re.compile("|".join(FILLER), re.I)
_ERROR = re.compile("|".join(ERROR), re.I)
_SCRIPTS = re.compile("|".join(SCRIPTS), re.I)
_WEAK = re.compile(WEAK, re.I)
_LOOSE = [[re.compile(x, re.I) for x in group] for group in LOOSE]
_STATUS = re.compile(r"\b[1-5]\d\d\b")
_QUOTES = re.compile(r"[“”„«»]")
_STOP = re.compile(r"[\s.!…]+$")
_CODE = re.compile(r"^\s*(?:for |if |def |return |import |class |SELECT |[\[{]\s*\"|\w+ [+-]?= )|\bWHERE\b|;$")
_PARTS = re.compile(r"(?<=[.!?…])\s+")
_PREFIX = re.compile(r"^\w*(?:Error|Exception|Fehler|Erreur)\s?: ")

def slotted(line: str) -> bool:
    """An unfilled placeholder or its rendered leftover, in a sentence that doesn't explain it."""
    if _SLOT_HINT.search(line) and not _CODE.search(line):
        for part in _PARTS.split(line):
            if _SLOT.search(part) and not _EXPLAINS.search(_SLOT.sub(" ", part)):
                return True
    if "undefined" in line or "NaN" in line or "null" in line or "None" in line:
        for part in _PARTS.split(line):
            n = len(_LEFT.findall(part))
            if n and not _EXPLAINS.search(part) and (n >= 2 or re.search(rf"(?:^|,\s|\b(?:by|for|on|in|to|at|from|choosing|dear|hello|is|de|el|le|am|für|von|est|es)\s){LEFTOVER}\s*[.!,;:)]*$", part, re.I)):
                return True
    return "[object Object]" in line


def filler(line: str) -> bool:
    """Text that only fills the place of content."""
    low = line.lower()
    if has_any(_FILLER_HINTED, low) and _FILLER.search(line.strip()):
        return True
    words = low.replace(".", " ").replace(",", " ").split()
    return len(words) >= 3 and sum(w in LOREM for w in words) >= 0.3 * len(words) and ("lorem" in words or len(words) >= 8)


#: How much of a line is what: (it has residue or filler, characters of plain failure, of loose failure, beside a failure, of anything else).
Judged = tuple[bool, int, int, int, int]


def judged(line: str) -> Judged:
    """What the sentences of a line show, each by its whole length."""
    s = line.strip()
    if slotted(s) or filler(s):
        return True, 0, 0, 0, 0
    if not hinted(s):
        return False, 0, 0, 0, len(s)
    if failing(s):
        return False, len(s), 0, 0, 0
    n = [0, 0, 0, 0]
    for p in _PARTS.split(s):
        n[3 if not hinted(p) else 0 if failing(p) else 2 if _WEAK.fullmatch(p) else 1 if not _QUOTES.search(p) and any(all(x.search(p) for x in g) for g in _LOOSE) and not _EXPLAINS.search(p) else 3] += len(p)
    return False, *n


def hinted(s: str) -> bool:
    """Whether any of the patterns below can match at all: each needs one of the hints."""
    return has_any(_HINTED, s.lower()) or bool(_STATUS.search(s))


def failing(part: str) -> bool:
    """A plain wording of an error page or of a demand for scripts, not one that is quoted."""
    p = _STOP.sub("", part) or part
    return hinted(part) and not _QUOTES.search(part) and bool(_ERROR.fullmatch(p) or _ERROR.fullmatch(part) or _SCRIPTS.fullmatch(p))


_judged: dict[str, Judged] = {}


def known_judged(line: str) -> Judged:
    """The same, kept for the worker for lines of ordinary length: 100,000 of at most 400 characters."""
    if len(line) > 400:
        return judged(line)
    j = _judged.get(line)
    if j is None:
        if len(_judged) >= 100_000:
            _judged.clear()
        j = _judged[line] = judged(line)
    return j


def page_fails(text: str, title: str | None, frame: list[int], codes: np.ndarray) -> bool:
    """Whether a page's residual shows residue, filler, an error or a demand for scripts. codes: how recurrent each line is on its host."""
    frames = set(frame)
    plain, loose, beside, rest, headed = 0, 0, 0, 0, False
    levels = (codes & 3).tolist()
    heading = {p for p in (title or "", *_TITLE_SEP.split(title or ""))}
    for i, raw in enumerate(text.split("\n")):
        s = raw.strip()
        if not s:
            continue
        in_place, *n = known_judged(s)
        if s in heading and n[1] + n[3]:
            headed = True
        if levels[i] >= RECURRENT:
            continue
        if in_place:
            return True
        plain, loose, beside = plain + n[0], loose + n[1], beside + n[2]
        if n[3] and i not in frames and s not in heading and is_shown(s):
            rest += n[3]
    whole = plain + loose + beside + rest
    return bool(plain and plain + loose + beside >= SHARE * whole or loose and not headed and plain + loose >= LOOSE_SHARE * whole)


def error_fails(error: str) -> bool:
    """The same for an error report: ordinary ones of browser and harness, with status codes, selectors or braces, pass."""
    body = _PREFIX.sub("", error.strip())
    if not body:
        return False
    if re.fullmatch(r"undefined|null|NaN|None", body) or slotted(body) or filler(body) or re.search(r"\bTODO\b", body):
        return True
    return failing(body)


_errors: dict[str, bool] = {}


def known_error(error: str | None) -> bool:
    """error_fails, kept for the worker for reports of ordinary length."""
    if error is None or len(error) > 400:
        return error is not None and error_fails(error)
    if error not in _errors:
        if len(_errors) >= 100_000:
            _errors.clear()
        _errors[error] = error_fails(error)
    return _errors[error]


def _judge(b: pa.RecordBatch, codes: Codes) -> tuple[list[bool], list[bool]]:
    """(the text fails, the error report fails) for each row of a batch."""
    pages, which, got = each_page(b, codes)
    bad = [bool(text) and page_fails(text, title, frame, seen) for (text, title, _), (frame, _, seen) in zip(pages, got)]
    return [bad[k] for k in which], [known_error(e) for e in b.column("execution_error").to_pylist()]


def evidence(steps: DataFrame, broadcast: int = BROADCAST_ENTRIES) -> DataFrame:
    """step_id, text_fails, error_fails for each delivered row."""

    def run(b: pa.RecordBatch, codes: Codes) -> pa.RecordBatch:
        bad, err = _judge(b, codes)
        return pa.RecordBatch.from_arrays([b.column("step_id"), pa.array(bad, pa.bool_()), pa.array(err, pa.bool_())], names=["step_id", "text_fails", "error_fails"])

    return with_pages(steps, run, "step_id BIGINT, text_fails BOOLEAN, error_fails BOOLEAN", F.col("execution_error"), broadcast=broadcast)


def failing_fields(steps: DataFrame, broadcast: int = BROADCAST_ENTRIES) -> DataFrame:
    """step_id, field ('text' or 'execution_error'), one row for each failing field of a step. Null and empty fields
    don't fail; repeated deliveries count once; further columns are ignored."""
    fields = F.array_compact(F.array(F.when(F.col("text_fails"), F.lit("text")), F.when(F.col("error_fails"), F.lit("execution_error"))))
    return evidence(steps, broadcast).where("text_fails OR error_fails").select("step_id", F.explode(fields).alias("field")).distinct()


def kept_steps(steps: DataFrame) -> DataFrame:
    """The steps with failing texts and error reports taken out (set to null): step_id, text, execution_error. Texts are
    dropped where they are read; those kept are shuffled once, to be one for each step."""

    def run(b: pa.RecordBatch, codes: Codes) -> pa.RecordBatch:
        kept = []
        for name, bad in zip(("text", "execution_error"), _judge(b, codes)):
            c = b.column(name)
            kept.append(pa.compute.if_else(pa.array(bad, pa.bool_()), pa.scalar(None, c.type), c))
        return pa.RecordBatch.from_arrays([b.column("step_id"), *kept], names=["step_id", "text", "execution_error"])

    return with_pages(steps, run, "step_id BIGINT, text STRING, execution_error STRING", F.col("execution_error")).dropDuplicates(["step_id"])
